import random
import zlib
from collections import Counter

from evspark.llm import sharding


def test_law_rows_and_mixture(make):
    rng = random.Random(4)
    rows = [(i, "x" * rng.randint(0, 9) if i % 11 else None, None, rng.choice(["hot", "hot", "hot", "a", "b", None])) for i in range(5000)]
    got = sharding.shard(make(rows), 24).collect()
    per = Counter(r["shard"] for r in got)
    assert len(got) == 5000 and set(per) == set(range(24)) and max(per.values()) - min(per.values()) <= 1
    for s in range(24):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(per[s]))
    source = {r[0]: r[3] for r in rows}
    for name, n in Counter(source.values()).items():
        counts = [sum(source[r["doc_id"]] == name for r in got if r["shard"] == s) for s in range(24)]
        assert all(abs(c - n / 24) <= 2 for c in counts), (name, counts)
    text = {r[0]: (r[1] or "").encode() for r in rows}
    assert all(r["size"] == len(text[r["doc_id"]]) + 8 and r["text_crc32"] == zlib.crc32(text[r["doc_id"]]) and r["law"] == "rows" for r in got)
    again = {r["doc_id"]: (r["shard"], r["slot"]) for r in sharding.shard(make(rows[::-1]).repartition(5), 24).collect()}
    assert again == {r["doc_id"]: (r["shard"], r["slot"]) for r in got}


def test_few_rows_repeats_and_nulls(make):
    got = sharding.shard(make([(1, "é"), (1, "é"), (None, None), (2, "a")], clash=True), 24).collect()
    assert len(got) == 4 and len({r["shard"] for r in got}) == 4 and {r["slot"] for r in got} == {0}
    assert sharding.shard(make([]), 24).count() == 0


def test_ranks_equal_brute_force(make):
    """Rank by hash within each source, sort by fractional rank, cut equally: recomputed in plain Python."""
    import hashlib

    rng = random.Random(9)
    rows = [(i if i % 13 else None, "y" * rng.randint(0, 30) + str(i), None, rng.choice(["hot", "hot", "a", None])) for i in range(900)] + [(5000, "z" * 300_000, None, "a")]
    draw = lambda i, t: int(hashlib.md5(f"{'' if i is None else str(i) + ':'}{zlib.crc32(t.encode())}:11".encode()).hexdigest()[:13], 16)
    ranked = []
    for name in {r[3] for r in rows}:
        own = sorted((draw(r[0], r[1]), r[0] is not None, r[0] or 0, len(r[1]) + 8, zlib.crc32(r[1].encode()), r[1]) for r in rows if r[3] == name)
        ranked += [((k + 0.5) / len(own), name is None, name or "", *x) for k, x in enumerate(own)]
    want, n = {}, len(rows)
    for pos, x in enumerate(sorted(ranked)):
        shard = ((pos + 1) * 24 - 1) // n
        want[x[-1]] = (shard, pos - shard * n // 24)
    crc = {zlib.crc32(t.encode()): t for t in want}
    got = {crc[r["text_crc32"]]: (r["shard"], r["slot"]) for r in sharding.shard(make(rows), 24).collect()}
    assert got == want


def test_bins_grow_with_the_rows():
    assert [sharding.bin_bits(n) for n in (0, 10**6, 4096 * 50_000 * 4, 10**12)] == [12, 12, 15, 20]
