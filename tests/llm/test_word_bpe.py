import hashlib
import random
import sys

import pytest

from evspark.llm import word_bpe

P = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")
PATH = P.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    t = tokenizers.Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


@pytest.fixture(scope="module")
def codec():
    return word_bpe.WordCodec(word_bpe.read_tokenizer(PATH))


def ids(codec, text):
    return [i for part in codec.encode(text) for i in part]


def want(library, text):
    return library.encode(text, add_special_tokens=False).ids


def test_random_texts(codec, library):
    rng = random.Random(11)
    parts = ["a", "B", " ", "\n", "é", "é", "ß", "İ", "ΣΑΣ", "1", "22", "!", "'s", "'LL", "The", "ing", "\x1c", "\x85", " ", "中", "😀", "    ", "\t", "²", "́", "<|endoftext|>", "<|startoftext|>", "<|endof", "\x00", "ﬁ", "Å", "</w>"]
    for _ in range(3000):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 40)))
        assert ids(codec, t) == want(library, t), repr(t)
        t = "".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(0, 60)))
        assert ids(codec, t) == want(library, t), t


def test_every_character(codec, library):
    """All letters that the interpreter knows, each between two words."""
    import unicodedata

    wrong = [c for c in map(chr, range(sys.maxunicode + 1)) if unicodedata.category(c) not in ("Cs", "Cn") and ord(c) < 0x30000 and ids(codec, f"a{c}b") != want(library, f"a{c}b")]
    assert wrong == []


@pytest.mark.parametrize("text", ["a" * 3000, "ab" * 2000 + "c", "ing" * 3000, "é" * 2500, "!?" * 2000, "x" * 101, "word " * 50_000, "".join(random.Random(3).choice("etaoinshr") for _ in range(50_000))])
def test_long_words_and_texts(codec, library, text):
    assert ids(codec, text) == want(library, text)


def test_heap_equals_scan(codec):
    rng = random.Random(5)
    for _ in range(300):
        parts = [codec.inner[rng.choice(b"etaoin")] for _ in range(rng.randint(1, 90))]
        assert codec._long(list(parts)) == codec._short(list(parts))


def test_parts_change_nothing(library):
    small = word_bpe.WordCodec(word_bpe.read_tokenizer(PATH), words=3)
    small.PART = 7
    for t in ("one two  three <|endoftext|> fouŕ ́five", "nospacesatallinthistext", " lead and trail ", "a b c"):
        assert ids(small, t) == want(library, t)


def test_query_columns(spark, make, library):
    vocab = word_bpe.vocabulary(spark, PATH)
    rows = [(1, "Hello wörld, it's 1999"), (2, None), (3, ""), (None, "x" * 200_000), (1, "Hello wörld, it's 1999"), (4, " \n\t")]
    got = word_bpe.encode(make(rows, clash=True), vocab, with_ids=True).collect()
    assert len(got) == 6
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    expected = sorted((i or 0, len(w), sha(" ".join(map(str, w))), sha(library.decode(w, skip_special_tokens=False))) for i, w in ((i, want(library, t or "")) for i, t in rows))
    assert sorted((r["doc_id"] or 0, r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in got) == expected
    assert all(len(r["ids"]) == r["n_tokens"] for r in got)
    assert word_bpe.encode(make([]), vocab).count() == 0


def test_other_steps_are_refused(tmp_path):
    import json

    spec = json.load(open(PATH, encoding="utf-8"))
    spec["model"]["dropout"] = 0.1
    (tmp_path / "t.json").write_text(json.dumps(spec))
    with pytest.raises(ValueError, match="steps"):
        word_bpe.read_tokenizer(str(tmp_path / "t.json"))
