"""Periodic run detection by recompression.

A run is a stretch of words with smallest period q, at least `least_words` words and `power` periods long, that can't be
extended keeping the period. Words are numbered, and the numbers are recompressed: in turns, blocks of equal symbols
become one symbol (its base and its count), and pairs of a left and a right symbol - a symbol's side in a round follows
from its name alone - become one. The same words get the same symbols except near their borders, so the rounds form a
run-length grammar of logarithmic depth in which the common extension of two places is found by climbing while the
symbols above agree and stepping down where they differ (Grammar.extend), many queries at once.

A run of period p with power e covers a point of the grid of step (e - 2) * p + 1 together with the 2p words from there
on. Those points number n / p for each p, n * log n in all. At each the words i and i + p are compared, in three places;
where they agree, the grammar gives the exact extensions to both sides. Of equal stretches the least period counts,
which is the smallest period of the words, since the others are its multiples there.

Documents are read whole, several short ones or one long one at a time, joined by separators that are equal to nothing.
Null and empty texts have no words and no runs. Every row gets a row of its own, repeated ids too; columns beside id and
text don't matter, and an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evspark.llm.shared import as_bytes, forget, mix64, small_batches

GROUP_WORDS = 100_000  # documents are handled together up to so many words
POINTS = 1_000_000  # grid points looked at in one step


@dataclass
class Ways:
    """What a walk to one side needs: a symbol's parent if it is that parent's first (last) child, its first (last)
    child, how many equal symbols follow, itself included, and the direction. -1: none."""

    up: np.ndarray
    down: np.ndarray
    rest: np.ndarray
    step: int


class Grammar:
    """The run-length grammar of a sequence of names, all rounds in flat arrays. The first and the last name must be
    unlike all others; extensions stop at names that occur once."""

    def __init__(self, names: np.ndarray, enough: int = 64):
        self._next, self._base = int(names.max(initial=0)) + 1, 0
        self._parts: list[tuple] = []  # sym, length, up first, up last, down first, down last, rest after, rest before
        sym, length = names.astype(np.int64), np.ones(len(names), np.int64)
        first = last = np.full(len(names), -1, np.int64)
        for turn in range(64):
            heads = np.r_[0, np.flatnonzero(sym[1:] != sym[:-1]) + 1]
            counts = np.diff(np.r_[heads, len(sym)])
            before = np.arange(len(sym)) - np.repeat(heads, counts) + 1
            after = np.repeat(counts, counts) - before + 1
            many = np.flatnonzero(counts > 1)
            if len(many):
                block = sym[heads].copy()
                block[many] = self._named(block[many], counts[many])
                sym, length, first, last = self._put(sym, length, first, last, after, before, heads, heads + counts - 1, block, length[heads] * counts)
                after = before = np.ones(len(sym), np.int64)
            if len(sym) <= enough:
                break
            side = mix64(sym.astype(np.uint64) + (np.uint64(turn + 1) << np.uint64(40))) & np.uint64(1)
            left = np.flatnonzero((side[:-1] == 0) & (side[1:] == 1))
            if not len(left):
                continue
            paired = np.zeros(len(sym), np.int64)
            paired[left] = 1
            stay = np.flatnonzero(np.r_[0, paired[:-1]] == 0)
            above = sym[stay]
            above[paired[stay] == 1] = self._named(sym[left], sym[left + 1])
            longer = length[stay] + np.where(paired[stay] == 1, length[np.minimum(stay + 1, len(sym) - 1)], 0)
            sym, length, first, last = self._put(sym, length, first, last, after, before, stay, stay + paired[stay], above, longer)
        ones = np.ones(len(sym), np.int64)
        none = np.full(len(sym), -1, np.int64)
        self._parts.append((sym, length, none, none, first, last, ones, ones))
        cols = [np.concatenate(c).astype(np.int32) for c in zip(*self._parts, strict=True)]
        self.sym, self.length = cols[0], cols[1].astype(np.int64)
        self.right, self.left = Ways(cols[2], cols[4], cols[6], 1), Ways(cols[3], cols[5], cols[7], -1)
        del self._parts

    def _named(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """A name for each distinct pair (a, b)."""
        _, name = np.unique((a << 32) | b, return_inverse=True)
        name = name + self._next
        self._next = int(name.max()) + 1
        return name

    def _put(self, sym, length, first, last, after, before, heads, tails, above, longer):
        """Close a level: link it with the level above, whose symbols begin at heads and end at tails. Returns the level
        above with its first and last children."""
        up = self._base + len(sym) + np.arange(len(heads))
        up_first, up_last = np.full(len(sym), -1, np.int64), np.full(len(sym), -1, np.int64)
        up_first[heads], up_last[tails] = up, up
        self._parts.append((sym, length, up_first, up_last, first, last, after, before))
        down_first, down_last = self._base + heads, self._base + tails
        self._base += len(sym)
        return above, longer, down_first, down_last

    def extend(self, a: np.ndarray, b: np.ndarray, way: Ways) -> np.ndarray:
        """How many words are equal from the places a and b on, both included, in the way's direction."""
        got, live = np.zeros(len(a), np.int64), np.arange(len(a))
        a, b = a.astype(np.int64), b.astype(np.int64)
        while len(live):
            same = self.sym[a] == self.sym[b]
            ua, ub = way.up[a], way.up[b]
            climb = same & (ua >= 0) & (ub >= 0)
            climb &= self.sym[ua] == self.sym[ub]
            move = same & ~climb
            jump = np.where(move, np.minimum(way.rest[a], way.rest[b]), 0).astype(np.int64)
            got[live] += jump * self.length[a]
            na = np.where(climb, ua, np.where(move, a + way.step * jump, way.down[a]))
            nb = np.where(climb, ub, np.where(move, b + way.step * jump, way.down[b]))
            on = na >= 0
            live, a, b = live[on], na[on], nb[on]
        return got


def grid(sizes: np.ndarray, power: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(document, place, period) of all grid points, some at a time; `sizes` are the documents' words."""
    most = sizes // power
    doc = np.repeat(np.arange(len(sizes)), most)
    period = 1 + np.arange(len(doc)) - np.repeat(np.cumsum(most) - most, most)
    points = (sizes[doc] - 2 * period) // ((power - 2) * period + 1) + 1
    ends = np.cumsum(points)
    start = 0
    while start < len(doc):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + POINTS)))
        d, p, k = doc[start:stop], period[start:stop], points[start:stop]
        nth = np.arange(int(k.sum())) - np.repeat(np.cumsum(k) - k, k)
        d, p = np.repeat(d, k), np.repeat(p, k)
        yield d, nth * ((power - 2) * p + 1), p
        start = stop


def runs_of(docs: list[np.ndarray], least_words: int = 6, power: int = 4) -> np.ndarray:
    """All runs of documents of numbered words: rows of (document, start, length, period) by document, start, period."""
    sizes = np.array([len(d) for d in docs], np.int64)
    starts = np.r_[0, np.cumsum(sizes)]
    flat = np.concatenate([*docs, np.zeros(0, np.int64)]).astype(np.int64)
    found = []
    for d, i, p in grid(sizes, power):
        at = starts[d] + i
        hit = np.flatnonzero(flat[at] == flat[at + p])
        d, i, p, at = d[hit], i[hit], p[hit], at[hit]
        hit = np.flatnonzero((flat[at + p - 1] == flat[at + 2 * p - 1]) & (flat[at + p // 2] == flat[at + p + p // 2]))
        found.append(np.stack((d[hit], i[hit], p[hit])))
    d, i, p = np.concatenate(found, axis=1) if found else np.zeros((3, 0), np.int64)
    if not len(d):
        return np.zeros((0, 4), np.int64)
    # the grammar of those documents that have candidates, each between separators of its own
    used, d_at = np.unique(d, return_inverse=True)
    parts, first, n, names = [], [], 0, int(flat.max()) + 1
    for k, u in enumerate(used.tolist()):
        first.append(n + 1)
        parts += [np.array([names + k]), docs[u]]
        n += 1 + len(docs[u])
    grammar = Grammar(np.concatenate([*parts, np.array([names + len(used)])]), enough=2 * len(used) + 64)
    at = np.array(first)[d_at] + i
    after = grammar.extend(at, at + p, grammar.right)
    before = grammar.extend(at - 1, at + p - 1, grammar.left)
    start, length = i - before, p + after + before
    sound = np.flatnonzero(length >= np.maximum(least_words, power * p))
    rows = np.stack((d[sound], start[sound], length[sound], p[sound]), axis=1)
    rows = rows[np.lexsort((rows[:, 3], rows[:, 2], rows[:, 1], rows[:, 0]))]
    fresh = np.r_[True, (rows[1:, :3] != rows[:-1, :3]).any(axis=1)] if len(rows) else np.zeros(0, bool)
    rows = rows[fresh]
    return rows[np.lexsort((rows[:, 3], rows[:, 1], rows[:, 0]))]


def strongest(runs: list[list[int]]) -> list[int]:
    """The run of greatest exact length / period; of equal ones the first start, then the least period."""
    best = runs[0]
    for r in runs[1:]:
        if r[1] * best[2] > best[1] * r[2]:
            best = r
    return best


def without_repeats(words: list[bytes], runs: list[list[int]]) -> list[bytes]:
    """The words that no run holds after its first period."""
    kept = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        kept[start + period] += 1
        kept[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(kept[:-1]) == 0).tolist()]


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_words: int = 6, power: int = 4, prepare: Callable[[object, list[bytes]], list[bytes]] | None = None, with_runs: bool = False) -> DataFrame:
    """doc_id, n_runs, the strongest run's start, length, period and exponent_milli (null without runs), runs_sha256,
    collapsed_sha256 for every row; with_runs adds `runs` (start, length, period) and `collapsed`, the text without
    repeats. prepare(id, words), if given, changes a document's words first."""
    if power < 3:
        raise ValueError("runs of fewer than three periods have no sparse grid")

    def judge(ids: list, texts: list[list[bytes]], coded: list[np.ndarray], out: list[tuple]) -> None:
        rows = runs_of(coded, least_words, power)
        cuts = np.searchsorted(rows[:, 0], np.arange(len(texts) + 1))
        for k, words in enumerate(texts):
            runs = rows[cuts[k] : cuts[k + 1], 1:].tolist()
            best = strongest(runs) if runs else [None] * 3
            collapsed = b" ".join(without_repeats(words, runs) if runs else words)
            listed = "".join(f"{s},{n},{p}\n" for s, n, p in runs)
            milli = 1000 * best[1] // best[2] if runs else None
            row = (ids[k], len(runs), *best, milli, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(collapsed).hexdigest())
            out.append((*row, [dict(zip(("start", "length", "period"), r, strict=True)) for r in runs], collapsed.decode()) if with_runs else row)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for b in filter(len, batches):
            out: list[tuple] = []
            ids, texts, coded, held = [], [], [], 0
            number: defaultdict[bytes, int] = defaultdict(count().__next__)
            for id_, text in zip(b.column(0).to_pylist(), as_bytes(b.column(1)), strict=True):
                words = text.split()  # at ASCII white space
                words = prepare(id_, words) if prepare else words
                if held and held + len(words) > GROUP_WORDS:
                    judge(ids, texts, coded, out)
                    ids, texts, coded, held = [], [], [], 0
                    number = defaultdict(count().__next__)
                ids.append(id_)
                texts.append(words)
                coded.append(np.fromiter(map(number.__getitem__, words), np.int64, len(words)))
                held += len(words)
            judge(ids, texts, coded, out)
            cols = list(zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [b.schema.field(0).type, *kinds], strict=True)], names)

    kinds = [*[pa.int64()] * 5, pa.string(), pa.string()]
    names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    rows = small_batches(docs).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
    if with_runs:
        kinds += [pa.list_(pa.struct([(x, pa.int64()) for x in ("start", "length", "period")])), pa.string()]
        names += ["runs", "collapsed"]
        schema += ", runs array<struct<start: long, length: long, period: long>>, collapsed string"
    return rows.mapInArrow(run, schema)
