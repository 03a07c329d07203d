"""Byte-level BPE encoding and decoding.

The ranks are compiled into a finite-state transducer. Its nondeterministic form reads a piece byte by byte; a
configuration is the last token before some boundary and the trie node of the bytes since. When a node completes a
token that may follow the configuration's token (encoding the two together gives them back), that token is the last
one of the encoding of all bytes read so far - there is exactly one such token. States of the deterministic form are
the ordered sets of live configurations; they and their transitions are made when first needed, and forgotten beyond
a bound. Tokens are emitted once every live configuration's chain of tokens passes through the same boundary, so the
lookahead is bounded by the live bytes, however long the piece is.

Decoding joins token bytes in chunks; an incremental UTF-8 machine carries at most three bytes of an unfinished
character from chunk to chunk.

Null texts count as empty: no tokens, no bytes. There are no special tokens; their strings are ordinary text.
"""

from __future__ import annotations

import base64
import hashlib
import re
import sys
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evspark.llm.shared import IdCache, as_texts, kept, small_batches

NONE = -1
TOKEN_BITS = 24


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: one token a line, base64 and its rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Node(dict):
    """A node of the trie of tokens: byte -> node; the token that ends here, or NONE; its depth. Nodes differ by identity."""

    __slots__ = ("depth", "token")
    __hash__, __eq__, __ne__ = object.__hash__, object.__eq__, object.__ne__

    def __init__(self, depth: int):
        self.depth, self.token = depth, NONE


class State(dict):
    """A state of the deterministic form: byte -> (next state, last token), made when first met."""

    __slots__ = ("fst", "live")

    def __init__(self, fst: Transducer, live: tuple[int | Node, ...]):
        self.fst, self.live = fst, live  # live configurations, in order of their boundaries: token, node, token, node

    def __missing__(self, byte: int) -> tuple[State, int]:
        arc = self[byte] = self.fst.arc(self.live, byte)
        return arc


class Transducer:
    MAX_ARCS, MAX_FITS = 1_000_000, 100_000  # arcs exceed their bound by COMMIT at most
    COMMIT = 512

    def __init__(self, ranks: dict[bytes, int], arcs: int | None = None):
        self.ranks = ranks
        self.MAX_ARCS = arcs or self.MAX_ARCS
        self.bytes_of = {t: b for b, t in ranks.items()}
        self.length = {t: len(b) for b, t in ranks.items()}
        self.root = Node(0)
        for b, t in ranks.items():
            node = self.root
            for c in b:
                nxt = node.get(c)
                if nxt is None:
                    nxt = node[c] = Node(node.depth + 1)
                node = nxt
            node.token = t
        self.parts: dict[int, tuple[int, int]] = {}
        for b, t in sorted(ranks.items(), key=lambda x: x[1]):
            if len(b) > 1:
                self.parts[t] = self._halves(b, t)
        self.fits: dict[int, bool] = {}
        self.states: dict[tuple, State] = {}
        self._forget()

    def _forget(self) -> None:
        for state in self.states.values():  # states lead to each other, and would stay until a collection
            state.clear()
        self.n_arcs = 0
        self.start = State(self, (NONE, self.root))
        self.states = {self.start.live: self.start}

    def _halves(self, word: bytes, rank: int) -> tuple[int, int]:
        """The two tokens whose merge made this one."""
        toks = [self.ranks[word[i : i + 1]] for i in range(len(word))]
        text = self.bytes_of
        while len(toks) > 2:
            best = min((self.ranks.get(text[x] + text[y], rank), i) for i, (x, y) in enumerate(zip(toks, toks[1:], strict=False)))
            if best[0] >= rank:
                raise ValueError(f"token {rank} can't be made by merges of lower rank")
            toks[best[1] : best[1] + 2] = [best[0]]
        return toks[0], toks[1]

    def may_follow(self, a: int, b: int) -> bool:
        """Whether encoding the bytes of a and b together gives a, b: no merge across their border comes before the
        merges that made the tokens next to it. The border's neighbours are taken apart, latest merge first."""
        if a == NONE:
            return True
        known = self.fits.get(a << TOKEN_BITS | b)
        if known is not None:
            return known
        x, y, before, ok = a, b, 1 << 60, True
        while True:
            across = self.ranks.get(self.bytes_of[x] + self.bytes_of[y])
            if across is not None and across < before:
                ok = False
                break
            px, py = self.parts.get(x), self.parts.get(y)
            if px is None and py is None:
                break
            if py is None or (px is not None and x > y):
                before, x = x, px[1]  # a tie between equal ranks goes to the left merge, so the bound is strict here
            else:
                before, y = y + 1, py[0]  # and a border merge of the same rank as y's comes first, being further left
        if len(self.fits) > self.MAX_FITS:
            self.fits.clear()
        self.fits[a << TOKEN_BITS | b] = ok
        return ok

    def arc(self, configurations: tuple[int | Node, ...], byte: int) -> tuple[State, int]:
        """Determinise one transition: next state, and the last token of the encoding up to here."""
        last, live, fits = NONE, [], self.fits
        for prev, node in zip(configurations[::2], configurations[1::2], strict=True):
            nxt = node.get(byte)
            if nxt is None:
                continue
            if nxt:  # a leaf can't be read further
                live += prev, nxt
            token = nxt.token
            if last == NONE and token != NONE:
                ok = fits.get(prev << TOKEN_BITS | token) if prev != NONE else True
                if self.may_follow(prev, token) if ok is None else ok:
                    last = token
        if last == NONE:
            raise ValueError("the vocabulary lacks a byte, or its merges are out of order")
        key = (*live, last, self.root)
        to = self.states.get(key)
        if to is None:
            to = self.states[key] = State(self, key)
        self.n_arcs += 1
        return to, last

    def encode(self, piece: bytes) -> list[int]:
        out: list[int] = []
        ends = []  # last token at each byte since the boundary up to which tokens are out
        if len(piece) <= self.COMMIT:
            if self.n_arcs > self.MAX_ARCS:
                self._forget()
            state = self.start
            for byte in piece:
                state, last = state[byte]
                ends.append(last)
            return self._chain(ends, len(ends))
        state = self.start
        for i in range(0, len(piece), self.COMMIT):
            if self.n_arcs > self.MAX_ARCS:  # within a piece too: what is live goes on in a state made anew
                live = state.live
                self._forget()
                state = self.states.setdefault(live, State(self, live))
            for byte in piece[i : i + self.COMMIT]:
                state, last = state[byte]
                ends.append(last)
            if i + self.COMMIT < len(piece):
                at = self._settled(state, ends)
                if at:
                    out += self._chain(ends, at)
                    del ends[:at]
        return out + self._chain(ends, len(ends)) if out else self._chain(ends, len(ends))

    def _chain(self, ends: list[int], at: int) -> list[int]:
        back, length = [], self.length
        while at > 0:
            t = ends[at - 1]
            back.append(t)
            at -= length[t]
        back.reverse()
        return back

    def _settled(self, state: State, ends: list[int]) -> int:
        """The furthest boundary on the chains of all live configurations."""
        n, common = len(ends), None
        for node in state.live[1::2]:  # a live configuration's boundary is as many bytes back as its node is deep
            at, chain = n - node.depth, set()
            while at > 0:
                chain.add(at)
                at -= self.length[ends[at - 1]]
            common = chain if common is None else common & chain
        return max(common, default=0) if common else 0


class Utf8Stream:
    """Incremental UTF-8: feed bytes, get the text of all characters that are whole; invalid bytes become U+FFFD."""

    def __init__(self):
        self.held = b""

    @staticmethod
    def _unfinished(data: bytes) -> int:
        """How many bytes at the end (0 to 3) start a character that isn't whole yet."""
        for back in range(1, min(3, len(data)) + 1):
            c = data[-back]
            if c < 0x80:
                return 0
            if c >= 0xC0:
                need = 2 if c < 0xE0 else 3 if c < 0xF0 else 4
                return back if need > back else 0
        return 0

    def feed(self, data: bytes) -> str:
        data = self.held + data
        n = self._unfinished(data)
        self.held = data[len(data) - n :]
        return data[: len(data) - n].decode("utf-8", "replace")

    def close(self) -> str:
        rest, self.held = self.held, b""
        return rest.decode("utf-8", "replace")


class Splitter:
    """Splits texts by a pattern of Unicode classes. `re` has no such classes, but is fast with explicit sets: the classes
    are spelled out for the first plane, with the members that `regex` gives them. Texts with characters beyond it, and
    patterns with anything that the two engines may read differently, are left to `regex`."""

    SAME = re.compile(r"\\p\{\w+\}|\\[sS]|\(\?[!:=]|[^\\](?<!\()|\((?!\?)", re.DOTALL)

    def __init__(self, pattern: str):
        # \s means Unicode white space, which is spelled out: engines differ on \x1c to \x1f
        self.full = regex.compile(pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
        self.plane = self._spelled_out(pattern)

    @classmethod
    def _spelled_out(cls, pattern: str) -> re.Pattern | None:
        letters = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x10000)]))
        runs = lambda kind: "".join(rf"\u{ord(m[0]):04x}-\u{ord(m[-1]):04x}" for m in regex.findall(rf"\p{{{kind}}}+", letters))
        out, inside, read = [], False, 0
        for part in cls.SAME.findall(pattern):
            read += len(part)
            if part in ("[", "]"):
                if (part == "[") == inside:
                    return None
                inside = part == "["
            if part == r"\S" and inside:
                return None
            if len(part) > 1 and part[0] == "\\":
                members = runs("White_Space" if part in (r"\s", r"\S") else part[3:-1])
                part = members if inside else f"[^{members}]" if part == r"\S" else f"[{members}]"
            out.append(part)
        return re.compile("".join(out)) if read == len(pattern) else None

    def __call__(self, text: str) -> list[str]:
        plane = self.plane is not None and (text.isascii() or len(text.encode("utf-16-le")) == 2 * len(text))
        return (self.plane if plane else self.full).findall(text)


class Pieces(IdCache):
    """Ids of pieces met before; long pieces are encoded each time, so that the bound on pieces bounds memory."""

    KEEP = 48

    def __missing__(self, piece: str) -> bytes:
        return super().__missing__(piece) if len(piece) <= self.KEEP else self.make(piece)


class Codec:
    """Encodes texts and decodes ids; pieces met before are kept up to a bound."""

    PART = 100_000

    def __init__(self, ranks: dict[bytes, int], pattern: str, known: int = 160_000, arcs: int | None = None):
        self.fst = Transducer(ranks, arcs)
        self.split = Splitter(pattern)
        self.pieces = Pieces(self._piece, known)
        self.table = [self.fst.bytes_of.get(i, b"") for i in range(max(ranks.values(), default=0) + 1)]

    def _piece(self, piece: str) -> bytes:
        ids = array("I", self.fst.encode(piece.encode()))
        if sys.byteorder == "big":
            ids.byteswap()
        return ids.tobytes()

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.pieces.__getitem__, self.split(text)))

    def decode_chunks(self, ids: bytes) -> Iterable[bytes]:
        for i in range(0, len(ids), 4 * self.PART):
            yield b"".join(map(self.table.__getitem__, np.frombuffer(ids[i : i + 4 * self.PART], "<u4").tolist()))

    def decode(self, ids: bytes) -> Iterator[str]:
        stream = Utf8Stream()
        for chunk in self.decode_chunks(ids):
            yield stream.feed(chunk)
        yield stream.close()


def codec(held: Broadcast, known: int = 160_000, arcs: int | None = None) -> Codec:
    """The worker's codec, compiled once for a vocabulary; what it has met stays known, up to its bounds, from task to task."""
    key, ranks, pattern = held.value
    return kept((key, known, arcs), lambda: Codec(ranks, pattern, known, arcs))


def vocabulary(spark: SparkSession, path: str, pattern: str) -> Broadcast:
    """Read a rank file on the driver and broadcast it; its size is that of the vocabulary."""
    ranks = read_ranks(path)
    key = hashlib.sha256(repr((sorted(ranks.items())[:100], len(ranks), path, pattern)).encode()).hexdigest()
    return spark.sparkContext.broadcast((key, ranks, pattern))


def encode(
    docs: DataFrame, vocab: Broadcast, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, known: int = 160_000, arcs: int | None = None
) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, decoded_chars for every row; with_ids adds the ids themselves. A worker
    keeps the ids of up to twice `known` pieces that it has met and `arcs` transitions (Transducer.MAX_ARCS if none are
    given), some 350 bytes each: fewer take less memory and more time.

    The digests of the decoded bytes come from decoding the ids, chunk by chunk.
    """

    def one(c: Codec, b: pa.RecordBatch) -> pa.RecordBatch:
        n, sha, back, chars, all_ids = [], [], [], [], []
        before, ids = None, b""
        for text in as_texts(b.column(1)):
            if text != before:  # copies that a mix takes follow each other
                before, ids = text, c.encode(text) if text else b""
            digest, stream, count = hashlib.sha256(), Utf8Stream(), 0
            for chunk in c.decode_chunks(ids):
                digest.update(chunk)
                count += len(stream.feed(chunk))
            n.append(len(ids) // 4)
            sha.append(hashlib.sha256(ids).hexdigest())
            back.append(digest.hexdigest())
            chars.append(count + len(stream.close()))
            if with_ids:
                all_ids.append(ids)
        cols = [b.column(0), pa.array(n, pa.int64()), pa.array(sha), pa.array(back), pa.array(chars, pa.int64())]
        names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "decoded_chars"]
        if with_ids:
            cols, names = [*cols, pa.array(all_ids, pa.binary())], [*names, "ids"]
        return pa.RecordBatch.from_arrays(cols, names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(vocab, known, arcs)
        for b in batches:
            yield one(c, b)

    rows = small_batches(docs).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string, decoded_chars long" + ", ids binary" * with_ids)
