"""Finding words takes time in proportion to the text."""

import time

from evspark.operators import search


def test_text_after_the_last_hit_is_read_once(spark):
    text = "the " + "x " * 60_000
    df = spark.createDataFrame([(1, text)], "id long, text string")
    start = time.time()
    assert [tuple(r) for r in search.find_in_text(df, "text", "the", "word").collect()] == [(1, 1, "the", 0, 3)]
    assert time.time() - start < 20
