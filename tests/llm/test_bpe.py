import base64
import hashlib
import random

import numpy as np
import pytest

from evspark.llm import bpe

P = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")


@pytest.fixture(scope="module")
def ranks():
    return bpe.read_ranks(P.path("byte_bpe_50k.tiktoken"))


@pytest.fixture(scope="module")
def codec(ranks):
    return bpe.Codec(ranks, P.PATTERN)


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def ids(codec, text):
    return np.frombuffer(codec.encode(text), "<u4").tolist()


def test_every_token_is_its_own_encoding(codec, ranks):
    assert all(codec.fst.encode(b) == [t] for b, t in ranks.items())


def test_random_texts(codec, library):
    rng = random.Random(7)
    parts = ["a", "b", " ", "\n", "é", "ß", "1", "22", "!", "'s", "'LL", "the", "ing", "\x1c", "\x85", "中", "😀", "    ", "\t", "²", "́", "<|endoftext|>", "\x00"]
    for _ in range(4000):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 40)))
        assert ids(codec, t) == library.encode_ordinary(t), repr(t)
        t = "".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(0, 60)))
        assert ids(codec, t) == library.encode_ordinary(t), t


@pytest.mark.parametrize("text", ["a" * 50_000, " " * 20_001 + "x", "abcé" * 5000, "ab" * 9999 + "c", "".join(chr(c) for c in range(0x3000)), "ing" * 7000])
def test_long_pieces(codec, library, text):
    assert ids(codec, text) == library.encode_ordinary(text)
    assert "".join(codec.decode(codec.encode(text))) == text


def test_small_bound_on_states_changes_nothing(ranks, library):
    fst = bpe.Transducer(ranks)
    fst.MAX_ARCS, fst.COMMIT = 10, 8
    for t in ("hello", "internationalisation" * 5, "zzzz" * 30):
        assert fst.encode(t.encode()) == library.encode_ordinary(t)


def test_states_stay_within_their_bound_in_one_piece(ranks, library):
    fst = bpe.Transducer(ranks)
    fst.MAX_ARCS = 5000
    rng = random.Random(9)
    piece = bytes(rng.choice(b"abcdefghijklmnopqrstuvwxyz") for _ in range(2_000_000))
    most = 0
    forget = fst._forget

    def spy():
        nonlocal most
        most = max(most, fst.n_arcs)
        forget()

    fst._forget = spy
    ids = fst.encode(piece)
    assert b"".join(map(fst.bytes_of.__getitem__, ids)) == piece
    assert 0 < most <= fst.MAX_ARCS + fst.COMMIT and fst.n_arcs <= fst.MAX_ARCS + fst.COMMIT
    assert fst.encode(piece[:30_000]) == library.encode_ordinary(piece[:30_000].decode())


def test_forgotten_states_are_let_go(ranks, library):
    fst = bpe.Transducer(ranks, arcs=20)
    before = list(fst.states.values())
    for t in ("internationalisation", "hello", "zz" * 600):
        assert fst.encode(t.encode()) == library.encode_ordinary(t)
        before += fst.states.values()
    now = {id(s) for s in fst.states.values()}
    assert fst.MAX_ARCS == 20 and not any(s for s in before if id(s) not in now)


def test_classes_spelled_out_for_the_first_plane():
    split = bpe.Splitter(P.PATTERN)
    assert split.plane is not None
    rng = random.Random(11)
    letters = [*map(chr, range(0xD800)), *map(chr, range(0xE000, 0x10000))]
    some = [c for c in letters if c.isspace()] + list(" 'sdmtrevl" * 3) + ["\x1c", "²", "Ⅷ", "一", "́", "é", "Σ", "ſ"]
    for t in ["".join(letters), " ".join(letters), "'".join(letters), *("".join(rng.choices(some, k=30)) for _ in range(3000))]:
        assert split.plane.findall(t) == split.full.findall(t) == split(t)
    for t in ("a😀b 𝒜x 𝟙2", "𐀀"):
        assert split(t) == split.full.findall(t)
    assert split("a😀b") == ["a", "😀", "b"] and split(" 𝒜x 𝟙") == [" 𝒜x", " 𝟙"]


@pytest.mark.parametrize("pattern", [r"(?i:'s)|\p{L}+|.", r"[^\r\n]+|\p{L}", r"[\S]+|\s", r"(?<=a)b|\w"])
def test_other_patterns_are_left_to_regex(pattern):
    split = bpe.Splitter(pattern)
    assert split.plane is None and split("it'S Ab ſ") == split.full.findall("it'S Ab ſ")


def test_utf8_stream_splits_anywhere():
    data = "aé中😀́z".encode()
    for i in range(len(data) + 1):
        for j in range(i, len(data) + 1):
            s = bpe.Utf8Stream()
            assert s.feed(data[:i]) + s.feed(data[i:j]) + s.feed(data[j:]) + s.close() == data.decode()
    s = bpe.Utf8Stream()
    assert s.feed(b"\xe4\xb8") == "" and s.close() == "�"


def test_query_columns(spark, make, library):
    vocab = bpe.vocabulary(spark, P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    rows = [(1, "Hello wörld"), (2, None), (3, ""), (None, "x" * 200_000), (1, "Hello wörld")]
    got = bpe.encode(make(rows, clash=True), vocab, with_ids=True).collect()
    assert len(got) == 5
    by = {(i, t or ""): None for i, t in rows}
    for r in got:
        text = next(t for i, t in by if i == r["doc_id"] and hashlib.sha256(t.encode()).hexdigest() == r["decoded_sha256"])
        want = library.encode_ordinary(text)
        assert r["n_tokens"] == len(want) and r["ids_sha256"] == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest() and r["decoded_chars"] == len(text)
    assert bpe.encode(make([]), vocab).count() == 0


def test_rank_file(tmp_path):
    (tmp_path / "r").write_bytes(b"\n".join(base64.b64encode(bytes([i])) + b" %d" % i for i in range(256)))
    assert bpe.Codec(bpe.read_ranks(str(tmp_path / "r")), P.PATTERN).encode("hi") == np.array([104, 105], "<u4").tobytes()
