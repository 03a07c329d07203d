"""The rule index looks up a bounded number of rows at once."""

import inspect

from pyspark.sql import functions as F

from evspark.operators import rule_index
from evspark.operators.rules import rules_of


def test_rule_index_cuts_batches(spark):
    rows = 3 * rule_index.ROWS + 7
    index = rule_index.RuleIndex(spark, rules_of([{"rule_id": "r", "label": "x", "conditions": [{"field": "a", "operator": "equals", "value": "0"}]}]))
    got = index.tag_rows(spark.range(0, rows, 1, 1).select("id", (F.col("id") % 5).cast("string").alias("a")))
    assert all((r["rule_ids"] == ["r"]) == (r["id"] % 5 == 0) for r in got.collect())
    assert "columns.iloc[i : i + ROWS]" in inspect.getsource(rule_index.RuleIndex.tag_rows)
