"""LM scoring: a hashed maximum-entropy model with a class-factored softmax.

P(token | context) = P(class | context) * P(branch | class, context) * P(leaf | class, branch, context) * P(token | leaf).
The class of a token is its own for the most frequent ones and follows from a hash of its last two bytes for all others;
the branch follows from its last three bytes and the leaf from the whole token, 16 of each. A frequent token is alone in
its class and has no further factors.

- Class: a softmax whose logits are sums of weight rows: one for the pair of the two classes before (class n-gram) and
  hashed ones for the word before and, as skip features, for the words two and three back.
- Branch: the smoothed log share of the branch in its class plus a weight row for the class and branch of the word before.
- Leaf: the smoothed log share of the leaf in its branch plus a hashed weight row for the word before and the own branch,
  so that a word's successors are told apart. These rows grow with the distinct tokens, up to 2^max_bits.
- Token: the smoothed share of its count in its leaf.

Training: in each round every task runs Adagrad steps on its part of the round's texts, starting from the same
weights, and hands on each weight row's change times the row's use; Spark sums those, and their quotient is the
update. The rounds' texts together are all training texts, so what is gathered grows with the corpus. The weights depend
on how files split into tasks.

Counts of all tokens are exact and stay distributed. The most frequent ones (`max_head` at most) are broadcast; the
others leave the scoring pass as (document, token) rows and are joined to their counts.

Null texts count as empty: one end token. Very long texts are read whole, in parts of bounded size. Rows are told apart
by a row number, so repeated ids do no harm. With nothing to learn from, all counts are 0 and the model is uniform over
classes, branches and leaves.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evspark.llm.shared import count_floor, join_group_facts, small_batches, written

END = b" "  # no word holds a space
SINGLE, SUFFIX = 8, 16
CLASSES = SINGLE + SUFFIX
HASHED = 4096  # 12 bits
FACTORS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)
ROWS = CLASSES * CLASSES + 3 * HASHED
WAYS = 16  # branches of a class, leaves of a branch
LEAVES = CLASSES * WAYS * WAYS
BRANCH_ROWS = CLASSES * WAYS * CLASSES
STEP = 16_384
EXTREME = 80.0  # logits beyond are cut, so that sums of their exponentials stay finite in single precision
NAN = float("nan")
FLUSH = 1 << 21  # tokens that a task counts at once
LOG10 = float(np.log(10.0))


def leaf_numbers(two: np.ndarray, three: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """Leaves of tokens without a class of their own, from the hashes of their last two and three bytes and of the whole."""
    return ((SINGLE + two % SUFFIX) * WAYS + (three >> 8) % WAYS) * WAYS + (whole >> 20) % WAYS


@dataclass
class Model:
    n: int  # training tokens
    v: int  # distinct ones
    single: dict[bytes, int]  # frequent token -> its class
    head: dict[bytes, int]  # frequent token -> count
    leaf_mass: np.ndarray  # smoothed count of each leaf, one unknown token included
    class_w: np.ndarray
    branch_w: np.ndarray
    leaf_w: np.ndarray

    def leaf_of(self, token: bytes) -> int:
        c = self.single.get(token)
        return self.leaves([token])[0] if c is None else c * WAYS * WAYS

    @staticmethod
    def leaves(tokens: list[bytes]) -> np.ndarray:
        """Leaf numbers of tokens that have no class of their own."""
        two, three, whole = (np.fromiter(map(crc32, x), np.uint32, len(tokens)) for x in ([t[-2:] for t in tokens], [t[-3:] for t in tokens], tokens))
        return leaf_numbers(two, three, whole)

    def biases(self) -> tuple[np.ndarray, np.ndarray]:
        """Log shares of the branches in each class and of the leaves in each branch."""
        leaf = self.leaf_mass.reshape(CLASSES, WAYS, WAYS)
        branch = leaf.sum(axis=2)
        return (
            np.log(branch / branch.sum(axis=1, keepdims=True)).astype(np.float32),
            np.log(leaf / branch[..., None]).reshape(-1, WAYS).astype(np.float32),
        )


def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, t >> 1 ^ np.uint32(0xEDB88320), t >> 1)
    return t


CRC, LONG = _crc_table(), 64


def word_crcs(words: pa.Array, last: int | None = None) -> np.ndarray:
    """zlib's crc32 of each word of a binary array, or of its `last` bytes: a byte of all words at once, long words alone."""
    ends = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    size, ends = np.diff(ends), ends[1:]
    if last is not None:
        size = np.minimum(size, last)
    data = np.frombuffer(words.buffers()[2] or b"", np.uint8)
    most = np.where(size > LONG, 0, size)
    order = np.argsort(-most)
    at, active = (ends - size)[order], np.searchsorted(-most[order], -np.arange(most.max(initial=0)), "left")
    crc = np.full(len(words), 0xFFFFFFFF, np.uint32)
    for i, k in enumerate(active):
        x = crc[:k]
        x[:] = np.take(CRC, (x ^ np.take(data, at[:k] + i)) & np.uint32(255)) ^ x >> np.uint32(8)
    out = np.empty_like(crc)
    out[order] = ~crc
    for i in np.flatnonzero(size > LONG):
        out[i] = crc32(data[ends[i] - size[i] : ends[i]])
    return out


class Reader:
    """Texts -> arrays of leaves and hashes."""

    PART = 1 << 19

    def __init__(self, model: Model):
        self.single = pa.array(model.single, pa.binary()), np.array(list(model.single.values()), np.int32)
        self.head = model.head

    def known(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Leaf, hash and log10(count + 0.1) of words."""
        h = word_crcs(words)
        leaf = leaf_numbers(word_crcs(words, 2), word_crcs(words, 3), h).astype(np.int32)
        at = pc.index_in(words, value_set=self.single[0]).fill_null(-1).to_numpy()
        own = at >= 0
        leaf[own] = self.single[1][at[own]] * (WAYS * WAYS)
        n = np.fromiter((self.head.get(w, NAN) for w in words.to_pylist()), float, len(words)) if self.head else np.full(len(words), NAN)
        return leaf, h, np.log10(n + 0.1)

    def tokens(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, Callable[[np.ndarray], list[bytes]]]:
        """Leaf, hash and log10(count + 0.1) (NaN outside the head) of each token of some texts one after the other, where
        each text starts, and a function that gives the tokens of some places. A word is looked up once a part."""
        flat, n = split(texts)
        ends = np.cumsum(n + 1) - 1
        total = int(ends[-1]) + 1 if len(ends) else 0
        inside = np.ones(total, bool)
        inside[ends] = False
        leaf, h, log_c = np.empty(total, np.int32), np.empty(total, np.uint32), np.empty(total)
        places = np.flatnonzero(inside)
        for i in range(0, len(flat), self.PART):
            part = flat.slice(i, self.PART).dictionary_encode()
            codes, at = part.indices.to_numpy(), places[i : i + self.PART]
            for to, known in zip((leaf, h, log_c), self.known(part.dictionary), strict=True):
                to[at] = np.take(known, codes)
        for to, known in zip((leaf, h, log_c), self.known(pa.array([END], pa.binary())), strict=True):
            to[ends] = known

        def words(at: np.ndarray) -> list[bytes]:
            is_end = ~inside[at]
            index = np.where(is_end, 0, at - np.searchsorted(ends, at))
            return [x or END for x in flat.take(pa.array(index, mask=is_end)).to_pylist()]

        return leaf, h, log_c, ends - n, words


def split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of some texts, A-Z in lower case, one after the other as binary, and how many each text has (null: none)."""
    parts = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    flat, bounds = parts.flatten(), parts.offsets.to_numpy()
    full = pc.greater(pc.binary_length(flat), 0)  # blanks at a text's ends leave empty words
    upto = np.r_[0, np.cumsum(full.to_numpy(zero_copy_only=False))]
    n = np.diff(upto[bounds - bounds[0]])
    return flat.filter(full).cast(pa.binary()), n


def before(x: np.ndarray, starts: np.ndarray, k: int) -> np.ndarray:
    """The value k tokens earlier in the same text; 0, as of an end token, before it."""
    out = np.zeros_like(x)
    out[k:] = x[: max(0, len(x) - k)]
    for i in range(k):
        at = starts + i
        # a text of fewer tokens than k: its later places belong to the next one, whose own start is in starts too
        out[at[at < len(x)]] = 0
    return out


ONE = np.zeros(1, np.int64)  # a single text


def features(cls: np.ndarray, hashes: np.ndarray, starts: np.ndarray = ONE) -> np.ndarray:
    """The weight rows active at each token of texts, one line a feature: before a text stand end tokens."""
    out = np.empty((4, len(cls)), np.uint16)
    out[0] = before(cls, starts, 1) * CLASSES + before(cls, starts, 2)
    for k in range(3):
        # an odd factor a feature, and the product's upper bits: neighbouring features don't collide alike
        out[k + 1] = (before(hashes, starts, k + 1) * FACTORS[k] >> np.uint32(20)) + np.uint32(CLASSES * CLASSES + k * HASHED)
    return out


def inner_rows(leaf: np.ndarray, hashes: np.ndarray, bits: int, starts: np.ndarray = ONE) -> tuple[np.ndarray, np.ndarray]:
    """The weight row of the branch factor and that of the leaf factor at each token of texts."""
    own = (leaf // WAYS).astype(np.uint32)
    hashed = ((before(hashes, starts, 1) * FACTORS[0]) ^ (own * FACTORS[1])) * FACTORS[2] >> np.uint32(32 - bits)
    return (before(leaf // WAYS, starts, 1) * CLASSES + leaf // (WAYS * WAYS)).astype(np.uint16), hashed


def _logits(w: np.ndarray, rows: np.ndarray, bias: np.ndarray | None = None) -> np.ndarray:
    z = np.take(w, rows[0], axis=0)
    for r in rows[1:]:
        z += np.take(w, r, axis=0)
    if bias is not None:
        z += bias
    return np.clip(z, -EXTREME, EXTREME, out=z)


def _softmax(z: np.ndarray) -> np.ndarray:
    np.exp(z, out=z)
    z /= (z @ np.ones(z.shape[1], np.float32))[:, None]
    return z


def log_prob(w: np.ndarray, rows: np.ndarray, classes: np.ndarray, bias: np.ndarray | None = None) -> np.ndarray:
    """Natural log probability of each token's class (branch, leaf)."""
    z = _logits(w, rows, bias)
    own = z[np.arange(len(z)), classes]
    return own - np.log(np.exp(z, out=z) @ np.ones(z.shape[1], np.float32))


class Adagrad:
    def __init__(self, weights: np.ndarray, rate: float):
        self.w, self.rate = weights.astype(np.float32), rate
        self.squares = np.full(weights.shape, 1e-2, np.float32)
        self.use = np.zeros(len(weights))

    def _move(self, hit: np.ndarray, counts: np.ndarray, total: np.ndarray) -> None:
        """Rows `hit` by their sums of gradients, of `counts` tokens each."""
        total /= counts[:, None].astype(np.float32)
        squares = np.take(self.squares, hit, axis=0)
        squares += total * total
        self.squares[hit] = squares
        total *= self.rate
        total /= np.sqrt(squares, out=squares)
        self.w[hit] -= total
        self.use[hit] += counts

    def step(self, rows: np.ndarray, classes: np.ndarray) -> None:
        z = _softmax(_logits(self.w, rows))
        z[np.arange(len(z)), classes] -= 1  # the gradient
        columns = z.T.astype(float, order="C")
        for r in rows:  # features have rows of their own, so one after the other is all at once
            low = int(r.min())
            at = r.astype(np.intp) - low
            counts = np.bincount(at)
            hit = np.flatnonzero(counts)
            total = np.stack([np.bincount(at, c)[hit] for c in columns], axis=1, dtype=np.float32, casting="same_kind")
            self._move(hit + low, counts[hit], total)

    def step_nodes(self, rows: np.ndarray, own: np.ndarray, nodes: np.ndarray, biases: np.ndarray) -> None:
        """A step where one row and the bias of a node make the logits: tokens that have both in common are taken together."""
        pairs, at = np.unique(rows.astype(np.int64) * len(biases) + nodes, return_inverse=True)
        row, node = np.divmod(pairs, len(biases))
        counts = np.bincount(at)
        z = _softmax(_logits(self.w, row[None], np.take(biases, node, axis=0)))
        z *= counts[:, None].astype(np.float32)
        z -= np.bincount(at * z.shape[1] + own, minlength=z.size).reshape(z.shape)
        first = np.r_[True, row[1:] != row[:-1]]
        if not first.all():  # nodes that share a row
            to, more = (np.cumsum(first) - 1)[~first], (counts[~first], z[~first])
            counts, z = counts[first], z[first]
            np.add.at(counts, to, more[0])
            np.add.at(z, to, more[1])
        self._move(row[first], counts, z)


class Scorer:
    """Natural log probabilities of tokens down to their leaves, from exponentials of the weights that are made once.
    Weights are cut so that products of theirs stay finite; shares still sum to 1."""

    def __init__(self, model: Model):
        biases = model.biases()
        cut = lambda w, most: np.exp(np.clip(w, -most, most))
        self.classes = cut(model.class_w, EXTREME / 4)
        branches = _softmax(_logits(model.branch_w, np.arange(BRANCH_ROWS)[None], np.tile(biases[0], (BRANCH_ROWS // CLASSES, 1))))
        self.branches = np.log(np.maximum(branches, np.finfo(np.float32).tiny)).ravel()
        self.leaves, self.shares = cut(model.leaf_w, EXTREME), np.exp(biases[1])

    def log_prob(self, rows: np.ndarray, leaf: np.ndarray, branch: np.ndarray, low: np.ndarray) -> np.ndarray:
        out = np.empty(len(leaf))
        for i in range(0, len(leaf), STEP // 4):  # what is held at once stays in the processor's cache
            at = slice(i, i + STEP // 4)
            x, own = leaf[at], out[at]
            z = np.take(self.classes, rows[0, at], axis=0)
            for r in rows[1:, at]:
                z *= np.take(self.classes, r, axis=0)
            own[:] = np.log(z[np.arange(len(z)), x // (WAYS * WAYS)] / (z @ np.ones(CLASSES, np.float32)))
            inner = np.flatnonzero(x >= SINGLE * WAYS * WAYS)
            x, r = x[inner], low[at][inner]
            z = np.take(self.leaves, r, axis=0)
            z *= np.take(self.shares, x // WAYS, axis=0)
            own[inner] += np.take(self.branches, branch[at][inner].astype(np.intp) * WAYS + x // WAYS % WAYS)
            own[inner] += np.log(z[np.arange(len(z)), x % WAYS] / (z @ np.ones(WAYS, np.float32)))
        return out


def token_counts(docs: DataFrame, text_col: str) -> DataFrame:
    """token (binary), n over all rows of docs; tasks sum first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            n = pa.chunked_array(held, pa.binary()).value_counts()
            return pa.RecordBatch.from_arrays([pa.concat_arrays([n.field("values"), pa.array([END], pa.binary())]), pa.concat_arrays([n.field("counts"), pa.array([ends], pa.int64())])], ["token", "n"])

        held, size, ends = [], 0, 0
        for b in batches:
            flat, _ = split(b.column(0))
            held.append(flat)
            size, ends = size + len(flat), ends + b.num_rows
            if size >= FLUSH:
                yield out()
                held, size, ends = [], 0, 0
        if ends:
            yield out()

    return small_batches(docs).select(F.col(text_col).alias("text")).mapInArrow(run, "token binary, n long").groupBy("token").agg(F.sum("n").alias("n"))


def _leaf_column(single: dict[bytes, int]) -> Column:
    """Model.leaf_of as a column."""
    branch = F.shiftright(F.crc32(F.substring("token", -3, 3)), 8) % WAYS
    leaf = ((SINGLE + F.crc32(F.substring("token", -2, 2)) % SUFFIX) * WAYS + branch) * WAYS + F.shiftright(F.crc32(F.col("token")), 20) % WAYS
    for token, k in single.items():
        leaf = F.when(F.col("token") == F.lit(token), k * WAYS * WAYS).otherwise(leaf)
    return leaf


class Trainer:
    """One task's steps: texts are gathered until a step is full."""

    def __init__(self, model: Model, rate: float):
        self.model = model
        self.reader, self.biases = Reader(model), model.biases()
        self.bits = len(model.leaf_w).bit_length() - 1
        self.parts = [Adagrad(w, rate) for w in (model.class_w, model.branch_w, model.leaf_w)]
        self.held: list[tuple] = []
        self.ready = 0

    def add(self, texts: pa.Array) -> None:
        leaf, h, _, starts, _ = self.reader.tokens(texts)
        self.held.append((features(leaf // (WAYS * WAYS), h, starts), leaf, *inner_rows(leaf, h, self.bits, starts)))
        self.ready += len(leaf)
        if self.ready >= STEP:
            self.flush(self.ready // STEP * STEP)

    def flush(self, most: int | None = None) -> None:
        """The steps of the first `most` tokens, or of all."""
        if not self.ready:
            return
        rows, leaf, branch, low = (np.concatenate(x, axis=-1) for x in zip(*self.held, strict=True))
        most = len(leaf) if most is None else most
        self.held, self.ready = [(rows[:, most:], leaf[most:], branch[most:], low[most:])], len(leaf) - most
        for i in range(0, most, STEP):
            at = slice(i, min(i + STEP, most))
            x = leaf[at]
            self.parts[0].step(rows[:, at], x // (WAYS * WAYS))
            inner = np.flatnonzero(x >= SINGLE * WAYS * WAYS)
            x = x[inner]
            if len(x):
                self.parts[1].step_nodes(branch[i + inner], x // WAYS % WAYS, x // (WAYS * WAYS), self.biases[0])
                self.parts[2].step_nodes(low[i + inner], x % WAYS, x // WAYS, self.biases[1])

    def changes(self) -> Iterator[pa.RecordBatch]:
        """row, use and the change times use of each weight row used; rows of the three parts are numbered on."""
        first = 0
        for ada, old in zip(self.parts, (self.model.class_w, self.model.branch_w, self.model.leaf_w), strict=True):
            at = np.flatnonzero(ada.use)
            change = (ada.w[at] - old[at]) * ada.use[at, None].astype(np.float32)
            cols = [pa.array(np.ascontiguousarray(change[:, i])) if i < change.shape[1] else pa.nulls(len(at), pa.float32()) for i in range(CLASSES)]
            yield pa.RecordBatch.from_arrays([pa.array(at + first), pa.array(ada.use[at]), *cols], ["row", "use", *COLUMNS])
            first += len(old)


COLUMNS = [f"c{i}" for i in range(CLASSES)]


def train(docs: DataFrame, text_col: str = "text", rounds: int = 2, rate: float = 0.3, max_head: int = 1 << 18, max_bits: int = 17, seed: int = 3) -> tuple[Model, DataFrame]:
    """The model and the table of all token counts. docs are the training rows."""
    counts = written(token_counts(docs, text_col))
    n, v = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    head_rows = counts.filter(F.col("n") >= count_floor(counts, "n", max_head)).toArrow()
    head = dict(zip(head_rows.column("token").to_pylist(), head_rows.column("n").to_pylist(), strict=True))
    top = sorted((t for t in head if t != END), key=lambda t: (-head[t], t))[: SINGLE - 1]
    single = {END: 0} | {t: i + 1 for i, t in enumerate(top)}
    mass = np.full(LEAVES, 0.1)
    for r in counts.groupBy(_leaf_column(single).alias("leaf")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).collect():  # at most LEAVES rows
        mass[r["leaf"]] = r["n"] + 0.1 * (r["v"] + 1)
    bits = min(max_bits, max(12, int(v).bit_length()))
    light = Model(n, v, single, {}, mass, *(np.zeros(x, np.float32) for x in ((ROWS, CLASSES), (BRANCH_ROWS, WAYS), (1 << bits, WAYS))))  # training needs no head
    context = docs.sparkSession.sparkContext
    texts = docs.select(F.col(text_col).alias("text"), F.pmod(F.xxhash64(F.col(text_col), F.lit(seed)), F.lit(rounds)).alias("round"))
    for k in range(rounds):
        held = context.broadcast(light)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            trainer = Trainer(held.value, rate)
            for b in batches:
                trainer.add(b.column(0))
            trainer.flush()
            yield from trainer.changes()

        changes = texts.filter(F.col("round") == k).select("text").mapInArrow(run, "row long, use double, " + ", ".join(f"{x} float" for x in COLUMNS))
        update = changes.groupBy("row").agg(F.sum("use").alias("use"), *[F.sum(x).alias(x) for x in COLUMNS])
        got = update.select("row", *[(F.col(x) / F.col("use")).cast("float").alias(x) for x in COLUMNS]).toArrow().sort_by("row")  # at most the model's rows
        at, first, new = got.column("row").to_numpy(), 0, []
        for w in (light.class_w, light.branch_w, light.leaf_w):
            lo, hi = np.searchsorted(at, (first, first + len(w)))
            w = w.copy()
            if hi > lo:
                w[at[lo:hi] - first] += np.stack([got.column(x).slice(lo, hi - lo).to_numpy() for x in COLUMNS[: w.shape[1]]], axis=1)
            new.append(w)
            first += len(w)
        light = Model(n, v, single, {}, mass, *new)
    return Model(n, v, single, head, mass, light.class_w, light.branch_w, light.leaf_w), counts


def score(docs: DataFrame, model: Model, counts: DataFrame, keep: list[Column] | None = None, text_col: str = "text") -> DataFrame:
    """The kept columns with n_tokens, n_known, train_tokens, base_score and score (log10) for every row."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    rows = small_batches(docs).select(F.col(text_col).alias("__text"), *(keep or []))
    names = rows.columns[1:]
    made = ["n_tokens", "known_head", "log_c_head", "shift", "tail"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        reader = Reader(m)
        scorer, leaf_log, bits = Scorer(m), np.log10(m.leaf_mass), len(m.leaf_w).bit_length() - 1
        for b in batches:
            if not b.num_rows:
                continue
            leaf, h, c, starts, words = reader.tokens(b.column(0))
            own = scorer.log_prob(features(leaf // (WAYS * WAYS), h, starts), leaf, *inner_rows(leaf, h, bits, starts))
            rare = np.isnan(c)
            n = np.diff(np.r_[starts, len(leaf)])
            known = n - np.add.reduceat(rare, starts, dtype=np.int64)
            log_c, shift = np.add.reduceat(np.where(rare, 0.0, c), starts), np.add.reduceat(own / LOG10 - leaf_log[leaf], starts)
            tail = [()] * b.num_rows
            at = np.flatnonzero(rare)
            of, found = np.searchsorted(starts, at, "right") - 1, words(at)
            cut = np.flatnonzero(np.diff(of, prepend=-1))
            for first, last in zip(cut, np.r_[cut, len(at)][1:], strict=True):
                tail[of[first]] = list(Counter(found[first:last]).items())
            kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64()]
            cols = [pa.array(x, t) for x, t in zip((n, known, log_c, shift), kinds, strict=True)]
            offsets = np.cumsum([0, *map(len, tail)])
            flat = [x for t in tail for x in t]
            pair = pa.StructArray.from_arrays([pa.array([x[0] for x in flat], pa.binary()), pa.array([x[1] for x in flat], pa.int64())], ["token", "k"])
            yield pa.RecordBatch.from_arrays([*b.columns[1:], *cols, pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pair)], [*names, *made])

    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema.fields[1:])
    scored = rows.mapInArrow(run, kinds + "n_tokens long, known_head long, log_c_head double, shift double, tail array<struct<token: binary, k: long>>")
    scored = written(scored.withColumn("row_no", F.monotonically_increasing_id()))
    tail = scored.select("row_no", F.explode("tail").alias("t")).select("row_no", "t.token", "t.k")
    # a token outside the head may still be in very many rows, such as one that only held-out texts have
    facts = written(tail.groupBy("token").agg(F.count(F.lit(1)).alias("rows")).join(counts, "token", "left"))
    total = facts.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    tail = join_group_facts(tail, facts, "token", "rows", total)
    tail = tail.groupBy("row_no").agg(
        F.sum(F.when(F.col("n") > 0, F.col("k")).otherwise(0)).alias("known_tail"), F.sum(F.col("k") * F.log10(F.coalesce("n", F.lit(0)) + F.lit(0.1))).alias("log_c_tail")
    )
    log_c = F.col("log_c_head") + F.coalesce("log_c_tail", F.lit(0.0))
    full = float(np.log10(model.n + 0.1 * (model.v + 1)))
    return scored.drop("tail").join(tail, "row_no", "left").select(
        *[F.col(f"`{x}`") for x in names], "n_tokens", (F.col("known_head") + F.coalesce("known_tail", F.lit(0))).alias("n_known"), F.lit(model.n).cast("long").alias("train_tokens"),
        (log_c - F.col("n_tokens") * F.lit(full)).alias("base_score"), (log_c + F.col("shift")).alias("score"),
    )
