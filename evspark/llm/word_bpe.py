"""BPE encoding and decoding of words, over one contiguous array of ranks a word.

The tokenizer file names the steps: special strings are cut out of the raw text, the rest is normalised (NFC, lower case
letter by letter) and split by a pattern; each match is a word of bytes, the last of which carries the end-of-word mark.
A word is held as its parts and, in an array beside them, the rank of the merge across each boundary. The array is
scanned for its minimum (the leftmost of equal ones), that boundary is deleted, and the ranks at its two neighbours are
looked up anew, until no boundary has a rank. The scan is cheap because words are short; beyond SHORT parts, a heap over
the same boundaries finds the minimum, so that a word of a million letters takes no square of steps.

Texts are read in parts of bounded size that end at a space, which no word, special string or normalised letter crosses.
Decoding looks ids up in the table of tokens, part by part, and joins them by one space, as a file without decoder asks.

Null texts count as empty: no tokens, an empty decoded text. Every row gets a row, whatever its id or the columns beside it.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evspark.llm.shared import IdCache, as_texts, kept, small_batches

SHORT = 100
NO_RANK = 1 << 60


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if it is visible in Latin-1, else the
    next free one from U+0100 on."""
    seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {b: chr(b) for b in seen}
    for b in range(256):
        letters.setdefault(b, chr(0x100 + len(letters) - len(seen)))
    return [letters[b] for b in range(256)]


def read_tokenizer(path: str) -> dict:
    """The parts of a tokenizer file that are needed here. Files that ask for other steps are refused."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, norm, pre = spec["model"], spec["normalizer"], spec["pre_tokenizer"]
    steps = [(n["type"], n.get("pattern"), n.get("content")) for n in norm["normalizers"]]
    # white space is all dropped by the split, so that folding it changes nothing
    sound = steps in ([("NFC", None, None), ("Replace", {"Regex": r"\s+"}, " "), ("Lowercase", None, None)], [("NFC", None, None), ("Lowercase", None, None)])
    split, level = pre["pretokenizers"]
    sound &= (split["type"], split["behavior"], split["invert"]) == ("Split", "Removed", True) and (level["type"], level["add_prefix_space"], level["use_regex"]) == ("ByteLevel", False, False)
    sound &= model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges"))
    sound &= not spec.get("decoder") and not spec.get("post_processor") and not any(t[k] for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized"))
    if not sound:
        raise ValueError(f"{path} asks for steps that this codec doesn't have")
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    return {"pattern": split["pattern"]["Regex"], "vocab": model["vocab"], "merges": merges, "end": model.get("end_of_word_suffix") or "", "special": special}


class WordCodec:
    """Encodes texts and decodes ids; short words met before are kept up to a bound."""

    KEEP = 48
    PART = 100_000

    def __init__(self, spec: dict, words: int = 160_000):
        vocab, letters = spec["vocab"], byte_letters()
        self.inner = [vocab[c] for c in letters]
        self.last = [vocab[c + spec["end"]] for c in letters]
        self.rank: dict[tuple[int, int], int] = {}
        self.made = [vocab[a + b] for a, b in spec["merges"]]
        for n, (a, b) in enumerate(spec["merges"]):
            self.rank.setdefault((vocab[a], vocab[b]), n)
        self.special = spec["special"]
        tokens = {**{i: t for t, i in vocab.items()}, **{i: t for t, i in self.special.items()}}
        self.token = [tokens.get(i, "") for i in range(max(tokens, default=-1) + 1)]
        self.digits = [str(i) for i in range(len(self.token))]
        # \s means Unicode white space, which is spelled out: engines differ on U+001C to U+001F
        self.split = regex.compile(spec["pattern"].replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}"))
        self.cut = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.words = IdCache(self._word, words)

    def _word(self, word: str) -> tuple[int, ...]:
        data = word.encode()
        parts = [self.inner[b] for b in data[:-1]] + [self.last[data[-1]]]
        return tuple(self._short(parts) if len(parts) <= SHORT else self._long(parts))

    def _short(self, parts: list[int]) -> list[int]:
        """Delete the boundary of the least rank until none has one; ranks[i] stands between parts i and i + 1."""
        rank, made = self.rank.get, self.made
        ranks = [rank(pair, NO_RANK) for pair in zip(parts, parts[1:], strict=False)]
        while ranks:
            least = min(ranks)
            if least == NO_RANK:
                break
            i = ranks.index(least)
            parts[i] = made[least]
            del parts[i + 1], ranks[i]
            if i:
                ranks[i - 1] = rank((parts[i - 1], parts[i]), NO_RANK)
            if i < len(ranks):
                ranks[i] = rank((parts[i], parts[i + 1]), NO_RANK)
        return parts

    def _long(self, parts: list[int]) -> list[int]:
        """The same for long words: boundaries stay in place, linked to the next and previous ones, in a heap by rank and
        place; one whose rank has changed since it was put there is passed over."""
        rank, made, n = self.rank.get, self.made, len(parts)
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        ranks = [rank(pair, NO_RANK) for pair in zip(parts, parts[1:], strict=False)] + [NO_RANK]
        heap = [(r, i) for i, r in enumerate(ranks) if r != NO_RANK]
        heapq.heapify(heap)
        while heap:
            least, i = heapq.heappop(heap)
            if ranks[i] != least:
                continue
            gone = after[i]
            parts[i], parts[gone], ranks[gone] = made[least], -1, NO_RANK
            after[i] = after[gone]
            if after[i] >= 0:
                before[after[i]] = i
            for at in (before[i], i):
                if at >= 0:
                    ranks[at] = rank((parts[at], parts[after[at]]), NO_RANK) if after[at] >= 0 else NO_RANK
                    if ranks[at] != NO_RANK:
                        heapq.heappush(heap, (ranks[at], at))
        return [p for p in parts if p >= 0]

    def _plain(self, text: str) -> list[int]:
        """Ids of text without special strings. Case is folded letter by letter, so a capital sigma has one small form."""
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        known, make, keep = self.words.__getitem__, self._word, self.KEEP
        return list(chain.from_iterable([known(w) if len(w) <= keep else make(w) for w in self.split.findall(text)]))

    def _ids(self, text: str) -> list[int]:
        if not self.cut or not any(s in text for s in self.special):
            return self._plain(text)
        out: list[int] = []
        for piece in self.cut.split(text):
            out += [self.special[piece]] if piece in self.special else self._plain(piece)
        return out

    def encode(self, text: str) -> Iterator[list[int]]:
        """Ids, one list for each part of the text."""
        start = 0
        while len(text) - start > self.PART:
            end = text.find(" ", start + self.PART)
            if end < 0:
                break
            yield self._ids(text[start:end])
            start = end
        yield self._ids(text[start:] if start else text)

    def decode(self, ids: list[int]) -> str:
        return " ".join(map(self.token.__getitem__, ids))


def vocabulary(spark: SparkSession, path: str) -> Broadcast:
    """Read a tokenizer file on the driver and broadcast it; its size is that of the vocabulary."""
    spec = read_tokenizer(path)
    key = hashlib.sha256(repr((path, spec["pattern"], len(spec["vocab"]), spec["merges"][:100])).encode()).hexdigest()
    return spark.sparkContext.broadcast((key, spec))


def codec(held: Broadcast) -> WordCodec:
    """The worker's codec; words it has met stay known, up to their bound, from task to task."""
    key, spec = held.value
    return kept(key, lambda: WordCodec(spec))


def encode(docs: DataFrame, vocab: Broadcast, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, decoded_chars for every row; with_ids adds the ids themselves.

    ids_sha256 is that of the decimal ids joined by one space. The decoded text comes from the ids, part by part.
    """

    def one(c: WordCodec, b: pa.RecordBatch) -> pa.RecordBatch:
        n, sha, back, chars, all_ids = [], [], [], [], []
        for text in as_texts(b.column(1)):
            coded, decoded, count, size, every = hashlib.sha256(), hashlib.sha256(), 0, 0, []
            for ids in c.encode(text or ""):
                if ids:
                    words, gap = c.decode(ids), " " if count else ""
                    coded.update((gap + " ".join(map(c.digits.__getitem__, ids))).encode())
                    decoded.update((gap + words).encode())
                    count, size = count + len(ids), size + len(gap) + len(words)
                    if with_ids:
                        every += ids
            n.append(count)
            sha.append(coded.hexdigest())
            back.append(decoded.hexdigest())
            chars.append(size)
            all_ids.append(every)
        cols = [b.column(0), pa.array(n, pa.int64()), pa.array(sha), pa.array(back), pa.array(chars, pa.int64())]
        names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "decoded_chars"]
        if with_ids:
            cols, names = [*cols, pa.array(all_ids, pa.list_(pa.int32()))], [*names, "ids"]
        return pa.RecordBatch.from_arrays(cols, names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(vocab)
        for b in batches:
            yield one(c, b)

    rows = small_batches(docs).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string, decoded_chars long" + ", ids array<int>" * with_ids)
