"""The registered queries of the training-data operators, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from fractions import Fraction
from zlib import crc32

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from evspark.llm import bpe, dedup, hardneg, langid, lm, mixing, neardup, periodic, quality, secret_scan, sharding, topk, word_bpe
from evspark.llm.shared import table


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = langid.row_class(F.col("doc_id"), 4) == 2
    model = langid.train(docs.filter(~held_out))
    return langid.predict(docs, model, keep=[F.col("doc_id"), held_out.alias("held_out")])


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").filter("quality = 1"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    vocab = bpe.vocabulary(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return bpe.encode(table(spark, sf_dir, "documents"), vocab)


def op7_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.best(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


SQL_7 = r"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id, list_inner_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(F.col("base_spans").cast("binary"), 256).alias("base_sha256"), "spans", "links")


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.find_copies(table(spark, sf_dir, "documents"))


SQL_4 = r"""
WITH k AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM k WINDOW w AS (PARTITION BY text_sha256)
"""


def op5_maxent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = langid.row_class(F.col("doc_id"), 10) == 0
    model, counts = lm.train(docs.filter(~held_out))
    return lm.score(docs, model, counts, keep=[F.col("doc_id"), held_out.alias("held_out")])


def op6_pareto_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    # texts of under 50 words count half: within a source the inclusion probabilities differ, and rank the documents
    importance = F.when(mixing.n_words(F.col("text")) < 50, 0.5).otherwise(1.0)
    mixed = mixing.mix(table(spark, sf_dir, "documents"), importance=importance)
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


SQL_6 = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':7'), 1, 13))::BIGINT AS x
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS weight FROM s
), f AS (
  SELECT *, source_size * 3.0::DOUBLE AS full_, source_size * 3.0::DOUBLE / weight AS rate_full FROM w
), r AS (
  SELECT *, row_number() OVER o AS pos,
         ((sum(source_size) OVER ())::DOUBLE - coalesce(sum(source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE * 3.0::DOUBLE)
           / (sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS rate
  FROM f WINDOW o AS (ORDER BY rate_full, source NULLS LAST)
), t AS (
  SELECT *, min(CASE WHEN rate <= rate_full THEN pos END) OVER () AS first_ FROM r
), g AS (
  SELECT source, source_size,
         CASE WHEN pos < first_ THEN full_ ELSE (max(CASE WHEN pos = first_ THEN rate END) OVER ()) * weight END AS target FROM t
), l AS (
  SELECT source, CASE WHEN size < 50 THEN 32 ELSE 64 END AS importance, sum(size)::BIGINT AS words FROM d GROUP BY ALL
), m AS (
  SELECT l.source, importance, (g.target - coalesce(sum(words) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE * 3.0::DOUBLE)
           / nullif((sum(importance * words) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE, 0) AS rate
  FROM l JOIN g ON l.source IS NOT DISTINCT FROM g.source WINDOW o AS (PARTITION BY l.source ORDER BY importance DESC)
), b AS (
  SELECT source, max_by(rate, importance) AS per_unit FROM m WHERE rate * importance <= 3.0::DOUBLE GROUP BY source
), e AS (
  SELECT d.*, g.source_size, g.target, least(3.0::DOUBLE, coalesce(b.per_unit, 3.0::DOUBLE) * CASE WHEN size < 50 THEN 32 ELSE 64 END) AS expected
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source LEFT JOIN b ON d.source IS NOT DISTINCT FROM b.source
), h AS (
  SELECT *, floor(expected)::BIGINT AS whole, expected - floor(expected) AS p, (x + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u FROM e
), q AS (
  SELECT *, CASE WHEN p > 0 THEN (u / (1 - u)) / (p / (1 - p)) END AS q FROM h
), c AS (
  SELECT *, sum(size) OVER (PARTITION BY source, q IS NULL ORDER BY q, doc_id ROWS UNBOUNDED PRECEDING) - size / 2.0::DOUBLE AS reached,
         sum(whole * size) OVER (PARTITION BY source) AS certain FROM q
)
SELECT doc_id, size, source_size, target,
       size * (whole + CASE WHEN q IS NOT NULL AND reached <= target - certain THEN 1 ELSE 0 END) AS taken
FROM c
"""


def op9_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_classes(table(spark, sf_dir, "documents"), words=3, least=Fraction(85, 100))


SQL_9 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS t FROM documents
), s AS (
  SELECT DISTINCT doc_id, sh FROM (
    SELECT doc_id, unnest(CASE WHEN len(t) = 0 THEN [] WHEN len(t) < 3 THEN [array_to_string(t, ' ')]
      ELSE list_transform(range(1, len(t) - 1), lambda i: t[i] || ' ' || t[i + 1] || ' ' || t[i + 2]) END) AS sh FROM w)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS both_ FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY ALL
), l AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * both_ >= 85 * (x.n + y.n - both_)
), r AS (
  SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a
), c AS (
  SELECT a, min(b) AS least_ FROM r GROUP BY a
)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, least(w.doc_id, coalesce(c.least_, w.doc_id)) AS component_id,
       w.doc_id = least(w.doc_id, coalesce(c.least_, w.doc_id)) AS kept
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.a = w.doc_id
"""


def op10_interleaved_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard(table(spark, sf_dir, "documents"), shards=24)
    return placed.select("doc_id", "size", "text_crc32", "law", "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op11_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    vocab = word_bpe.vocabulary(spark, public_tokenizers.path("word_bpe_49k.json"))
    return word_bpe.encode(table(spark, sf_dir, "documents"), vocab)


def planted_periods(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words of every tenth document, by the checksum of its id, repeat with a period from some word on. A null id
    has no checksum, and its words stay."""
    h = crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not words:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * (1 + (n - a) // p))[: n - a]


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.find_runs(table(spark, sf_dir, "documents"), least_words=6, power=4, prepare=planted_periods)


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings").withColumn("label", label)
    return hardneg.mine(rows, F.col("vec_id") % 50 == 0, positives=5, negatives=3, low=Fraction(50, 100), high=Fraction(95, 100))


SQL_13 = r"""
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, list_inner_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0
), p AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
), n AS (
  SELECT p.*, s.other_id AS negative_id, s.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other_id)::INTEGER AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same
    AND 50 * p.positive_score <= 100 * s.score AND 100 * s.score <= 95 * p.positive_score
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""


QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_quality_classifier": op2_quality_classifier,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_maxent_lm": op5_maxent_lm,
    "op6_pareto_mixing": op6_pareto_mixing,
    "op7_exact_topk": op7_exact_topk,
    "op8_secret_scan": op8_secret_scan,
    "op9_minhash_neardup": op9_minhash_neardup,
    "op10_interleaved_shards": op10_interleaved_shards,
    "op11_word_bpe": op11_word_bpe,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_hard_negatives": op13_hard_negatives,
    "pipeline": corpus_pipeline.run,
}
ORACLES = {"op4_exact_dedup": SQL_4, "op6_pareto_mixing": SQL_6, "op7_exact_topk": SQL_7, "op9_minhash_neardup": SQL_9, "op13_hard_negatives": SQL_13}
if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
