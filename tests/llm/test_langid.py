import random

from pyspark.sql import functions as F

from evspark.llm import langid

WORDS = {"en": "the and of to in water house street yellow think".split(), "de": "der und die das wasser haus strasse gelb denken ich".split(), "fr": "le et la les eau maison rue jaune penser je".split()}


def corpus(n=240, seed=3):
    rng = random.Random(seed)
    return [(i, " ".join(rng.choice(WORDS[k]) for _ in range(12)), k, None) for i in range(n) for k in [rng.choice(list(WORDS))]]


def predict(make, rows, model):
    return {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.predict(make(rows, clash=True), model, keep=[F.col("doc_id")]).collect()}


def test_held_out_and_edges(make):
    rows = corpus()
    model = langid.train(make(rows[:160] + [(None, "zzz", None, None), (1000, None, "en", None)]))
    got = predict(make, rows[160:], model)
    assert all(got[r[0]][0] == r[2] for r in rows[160:])
    edge = predict(make, [(1, None), (2, ""), (3, "12 34 !!"), (4, "²"), (5, "wasserhaus"), (6, "THE WATER"), (7, "中文"), (8, "the " * 200_000)], model)
    assert all(edge[i] == ("und", 0.0) for i in (1, 2, 3, 4))
    assert edge[5][0] == "de" and edge[6][0] == "en" and edge[8][0] == "en" and edge[7][0] in WORDS
    assert all(0 <= s <= 1 for _, s in edge.values())


def test_unknown_words_fall_back_to_grams(make):
    model = langid.train(make(corpus()), max_words=0)
    assert not model.words and model.grams
    assert predict(make, [(1, "strassen gelber wassers")], model)[1][0] == "de"


def test_nothing_learned(make):
    model = langid.train(make([(1, "abc", None, None)]))
    assert predict(make, [(1, "abc")], model) == {1: ("und", 0.0)}
    assert langid.predict(make([]), model, keep=[F.col("doc_id")]).count() == 0


def test_row_class_is_crc32_of_text(make):
    import zlib

    got = {r["doc_id"]: r["m"] for r in make([(i, "") for i in range(50)]).select("doc_id", langid.row_class(F.col("doc_id"), 4).alias("m")).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 4 for i in range(50)}


def test_rare_words_count_at_any_size_of_the_head(make):
    """A word keeps its own counts however few are broadcast, also where its n-grams point to another language."""
    rows = corpus() + [(2000 + i, "wasserstrasse gelbhaus", "fr", None) for i in range(3)] + [(3000, "x" * 60 + " the", "de", None)]
    docs = [(1, "wasserstrasse"), (2, "gelbhaus the eau"), (3, "strassen " * 5 + "jaunes"), (4, "x" * 60), (5, "中文"), (6, "wasserstrasse"), (7, "the and")]
    whole = predict(make, docs, langid.train(make(rows)))
    assert whole[1][0] == "fr" and whole[4][0] == "de" and whole[1] == whole[6]
    for most in (0, 5, 12):
        assert predict(make, docs, langid.train(make(rows), max_words=most)) == whole


def test_count_floor_holds_above_its_levels(spark):
    from evspark.llm.shared import count_floor

    df = spark.createDataFrame([(30_000 * (i + 1),) for i in range(50)], "n long")
    least = count_floor(df, "n", 10)
    assert 0 < df.filter(F.col("n") >= least).count() <= 10
    assert count_floor(df.filter("n < 0"), "n", 10) == 1


def test_scores_equal_brute_force(make):
    """Word log frequencies, else the mean of the longest known n-grams, in plain Python; ties and repeated rows too."""
    import math
    from collections import Counter

    train = corpus(90) + [(2000, "eau eau zug", "fr", None)]
    words, grams = {}, {}
    for _, text, lang, _ in train:
        words.setdefault(lang, Counter()).update(langid.WORDS.findall(text.lower()))
    types = len(set().union(*words.values()))
    for lang, c in words.items():
        for w, n in c.items():
            for k in langid.ORDERS:
                for g in langid.grams(w, k):
                    grams.setdefault(k, {}).setdefault(lang, Counter())[g] += n
    log = lambda n, total, v: round(math.log((n + 0.1) / (total + 0.1 * (v + 1))) * 2**24)

    def word_score(w, lang):
        if any(w in c for c in words.values()):
            return log(words[lang][w], words[lang].total(), types)
        for k in langid.ORDERS:
            seen = set().union(*grams[k].values())
            hit = [g for g in langid.grams(w, k) if g in seen]
            if hit:
                return round(sum(log(grams[k][lang][g], grams[k][lang].total(), len(seen)) for g in hit) / len(hit))
        return 0

    docs = [(1, "water strassen eaux"), (2, "unbekanntes wasser Yellowstone"), (3, "le the der"), (4, "q" * 50 + " maisons"), (5, "water strassen eaux"), (6, "zug " * 3 + "ßß")]
    got = predict(make, docs, langid.train(make(train), max_words=7))
    for i, text in docs:
        s = {lang: sum(word_score(w, lang) for w in langid.WORDS.findall(text.lower())) for lang in words}
        best = max(s, key=lambda x: (s[x], words[x].total()))
        share = 1 / sum(math.exp((v - s[best]) / 2**24) for v in s.values())
        assert got[i][0] == best and abs(got[i][1] - share) < 1e-6, (i, got[i], best, share)
    assert got[1] == got[5]
