"""Language ID: word-first backoff.

A known word scores by its log frequency in each language. A word that isn't known scores by the mean log frequency
of its character n-grams of the longest order of which any is known: 4, then 3, 2, 1. A text's language is the one
with the highest sum; the score is that language's share of the likelihood (uniform prior).

Counts cover all training texts and are summed by Spark; every word and n-gram seen in training counts, at any size.
The most frequent words (`max_words` at most) are broadcast and scored where the texts are read. All others leave the
scoring pass as (row, word) counts: each distinct one is looked up once in the table of all words, or backs off to the
table of all n-grams, and is joined back to the rows that hold it. `max_words` so decides where a word is scored, not how.
Log frequencies are whole numbers of 2^-24, so that sums are exact and don't depend on their order.

Null texts and texts without a letter give `und` with score 0; so does everything if there is nothing to learn from.
Ties go to the language with more training words, then by name. Repeated rows are predicted alike.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evspark.llm.shared import as_texts, count_floor, fresh, join_group_facts, small_batches, written

WORDS = re.compile(r"[^\W\d_]+")
ORDERS = (4, 3, 2, 1)
FLUSH = 300_000
LONGEST = 40  # characters of a word that is broadcast
UNIT = float(1 << 24)


def grams(word: str, n: int) -> list[str]:
    if n == 1:
        return list(word)
    padded = f"<{word}>"
    return [padded[i : i + n] for i in range(len(padded) - n + 1)]


@dataclass
class Model:
    """`words` are the broadcast ones with their rows in `word_logp`; all_words and grams are tables of (key, logp)."""

    langs: list[str]
    words: dict[str, int]
    word_logp: np.ndarray
    all_words: DataFrame
    grams: DataFrame


def _counted(batches: Iterator[pa.RecordBatch], keys_of) -> Iterator[pa.RecordBatch]:
    """Sums by (lang, key) within a task; handed on whenever FLUSH keys have gathered."""
    held: dict[str, Counter] = defaultdict(Counter)

    def flush() -> pa.RecordBatch:
        rows = [(lang, k, n) for lang, c in held.items() for k, n in c.items()]
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.int64())], ["lang", "key", "n"])

    for b in batches:
        for lang, text, n in zip(*(as_texts(c) for c in b.columns), strict=True):
            keys_of(held[lang], text or "", n)
            if sum(map(len, held.values())) >= FLUSH:
                yield flush()
    if held:
        yield flush()


def _add_words(c: Counter, text: str, n: int) -> None:
    c.update(WORDS.findall(text.lower()))


def _add_grams(c: Counter, word: str, n: int) -> None:
    for order in ORDERS:
        for g in grams(word, order):
            c[g] += n


def _logp(counts: DataFrame, langs: list[str], totals: list[Column], types: Column) -> DataFrame:
    """key, total, logp (one whole number of 2^-24 a language) of counts by lang and key."""
    by = counts.groupBy("key").agg(F.sum("n").alias("total"), *[F.coalesce(F.sum(F.when(F.col("lang") == x, F.col("n"))), F.lit(0)).alias(f"n{i}") for i, x in enumerate(langs)])
    share = [(F.col(f"n{i}") + 0.1) / (t + 0.1 * (types + 1)) for i, t in enumerate(totals)]
    return by.select("key", "total", F.array(*[F.round(F.log(x) * UNIT).cast("long") for x in share]).cast("array<long>").alias("logp"))


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", max_words: int = 100_000) -> Model:
    """Learn from every row with a language. Words and n-grams are counted by Spark over all of them."""
    labelled = small_batches(docs).filter(F.col(lang_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"), F.lit(1).cast("long").alias("n"))
    total = lambda df: df.groupBy("lang", "key").agg(F.sum("n").alias("n"))
    words = written(total(labelled.mapInArrow(lambda b: _counted(b, _add_words), "lang string, key string, n long")))
    pieces = written(total(words.select("lang", F.col("key").alias("text"), "n").mapInArrow(lambda b: _counted(b, _add_grams), "lang string, key string, n long")))
    sums = {r["lang"]: r["n"] for r in words.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    langs = sorted(sums, key=lambda x: (-sums[x], x))
    all_words = written(_logp(words, langs, [F.lit(float(sums[x])) for x in langs], F.lit(words.select("key").distinct().count())))
    short = all_words.filter(F.length("key") <= LONGEST)
    head = short.filter(F.col("total") >= count_floor(short, "total", max_words)).select("key", "logp").toArrow()
    logp = head.column("logp").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(head.num_rows, len(langs))
    # an order's n-grams have its length, and the lengths tell the orders apart
    order = F.length("key")
    n_of = {(r["lang"], r["k"]): r["n"] for r in pieces.groupBy("lang", order.alias("k")).agg(F.sum("n").alias("n")).collect()}
    types_of = {r["k"]: r["n"] for r in pieces.select("key").distinct().groupBy(order.alias("k")).count().withColumnRenamed("count", "n").collect()}
    per = lambda of: F.element_at(F.create_map(*[F.lit(x) for n in ORDERS for x in (n, float(of(n)))]), order)
    grams = _logp(pieces, langs, [per(lambda n, x=x: n_of.get((x, n), 0)) for x in langs], per(lambda n: types_of.get(n, 0)))
    return Model(langs, {k: i for i, k in enumerate(head.column("key").to_pylist())}, logp, all_words, grams.select("key", "logp"))


def _pieces(order: int):
    """word -> (word, gram, times) of one order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            of: list[list] = [[], [], []]
            for word in as_texts(b.column(0)):
                c = Counter(grams(word, order))
                of[0] += [word] * len(c)
                of[1] += c.keys()
                of[2] += c.values()
            yield pa.RecordBatch.from_arrays([pa.array(of[0], pa.string()), pa.array(of[1], pa.string()), pa.array(of[2], pa.int64())], ["word", "gram", "times"])

    return run


def _backed_off(words: DataFrame, model: Model) -> DataFrame:
    """word, logp of words that training hasn't seen: the mean over their known n-grams of the longest order that has
    any. Only words without one go on to the next order."""
    at = [F.col("logp")[i] for i in range(len(model.langs))]
    mean = F.array(*[F.round(F.col(f"s{i}") / F.col("n")).cast("long") for i in range(len(at))])
    left, out = written(words.select("word")), None
    for order in ORDERS:
        parts = written(left.mapInArrow(_pieces(order), "word string, gram string, times long"))
        of = model.grams.filter(F.length("key") == order).withColumnRenamed("key", "gram")
        facts = written(parts.groupBy("gram").agg(F.count(F.lit(1)).alias("rows")).join(of, "gram"))
        found = join_group_facts(parts, facts, "gram", "rows", parts.count()).filter("logp is not null")
        got = written(found.groupBy("word").agg(F.sum("times").alias("n"), *[F.sum(F.col("times") * x).alias(f"s{i}") for i, x in enumerate(at)]).select("word", mean.alias("logp")))
        out = got if out is None else out.unionByName(got)
        left = written(left.join(got, "word", "left_anti"))
        if left.isEmpty():
            break
    return out


def predict(docs: DataFrame, model: Model, text_col: str = "text", keep: list[Column] | None = None) -> DataFrame:
    """The kept columns with lang_pred and score, for every row."""
    rows = small_batches(docs).select(F.col(text_col).alias("__text"), *(keep or []))
    names = rows.columns[1:]
    said = [F.col(f"`{x}`") for x in names]
    if not model.langs:
        return rows.select(*said, F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    held = docs.sparkSession.sparkContext.broadcast((model.words, model.word_logp))
    no, sums, rest = fresh(rows, "no"), fresh(rows, "sums"), fresh(rows, "rest")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, logp = held.value
        for b in batches:
            heads, tails = [], []
            for text in as_texts(b.column(0)):
                words = WORDS.findall(text.lower()) if text else []
                if not words or not any(map(str.isalpha, text)):
                    heads.append(None)
                    tails.append([])
                    continue
                at = np.fromiter(map(known.get, words, repeat(-1)), np.int64, len(words))
                heads.append(logp[at[at >= 0]].sum(axis=0).tolist())
                tails.append(list(Counter([words[i] for i in np.flatnonzero(at < 0)]).items()))
            flat = [x for t in tails for x in t]
            pair = pa.StructArray.from_arrays([pa.array([x[0] for x in flat], pa.string()), pa.array([x[1] for x in flat], pa.int64())], ["word", "times"])
            ends = pa.array(np.cumsum([0, *map(len, tails)]), pa.int32())
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(heads, pa.list_(pa.int64())), pa.ListArray.from_arrays(ends, pair)], [*names, sums, rest])

    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema.fields[1:])
    read = rows.mapInArrow(run, f"{kinds}`{sums}` array<long>, `{rest}` array<struct<word: string, times: long>>")
    read = written(read.withColumn(no, F.monotonically_increasing_id()))
    tail = read.select(F.col(no).alias("row_no"), F.explode(rest).alias("t")).select("row_no", "t.word", "t.times")
    met = tail.groupBy("word").agg(F.count(F.lit(1)).alias("rows"))
    facts = written(met.join(model.all_words.select(F.col("key").alias("word"), "logp"), "word", "left"))
    unseen = facts.filter("logp is null").drop("logp")
    facts = facts.filter("logp is not null").unionByName(unseen.join(_backed_off(unseen, model), "word"))  # without a known n-gram a word says nothing
    n_rows = facts.agg(F.sum("rows")).first()[0] or 0
    joined = join_group_facts(tail, written(facts), "word", "rows", n_rows)
    size = range(len(model.langs))
    add = joined.groupBy(F.col("row_no").alias(no)).agg(*[F.sum(F.col("times") * F.col("logp")[i]).alias(f"__s{i}") for i in size])
    both = read.drop(rest).join(add.select(no, F.array(*[F.coalesce(f"__s{i}", F.lit(0)) for i in size]).alias("__more")), no, "left")
    all_of = F.when(F.col("__more").isNull(), F.col(sums)).otherwise(F.zip_with(sums, "__more", lambda a, b: a + b))
    scored = both.select(*said, all_of.alias(sums))
    best = F.array_max(sums)
    share = F.lit(1.0) / F.aggregate(sums, F.lit(0.0), lambda s, x: s + F.exp((x - best) / UNIT))
    lang = F.element_at(F.array(*[F.lit(x) for x in model.langs]), F.array_position(sums, best).cast("int"))
    return scored.select(*said, F.coalesce(F.when(F.col(sums).isNotNull(), lang), F.lit("und")).alias("lang_pred"), F.coalesce(share, F.lit(0.0)).alias("score"))


def row_class(id_col: Column, mod: int) -> Column:
    """crc32 of the id as text, modulo; null ids count as the empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % mod
