"""RL-02..07, SS-05 for rules by the thousand: an index of predicates instead of one expression a condition.

The distinct predicates of all rules - an operator and a value - are looked up, not tried: `equals` and `in` in a hash
table, `contains` by one walk of an Aho-Corasick automaton over the value, comparisons as a stretch of the sorted
thresholds. What remains (patterns, inequalities, any value) are columns, one a distinct predicate. The predicates that a
value meets lead to their conditions (rule, number, field, source), of which a row meets few, whatever the rules number.
Lower case and numbers are taken by Spark, as the column form does, so that both give the same rows.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evspark.functions.predicates import condition
from evspark.operators.rules import MASK_BITS, Rule, united_masks

#: Rows of a batch that are looked up at once: what they meet is held in numbers, hundreds a row for rules by the thousand.
ROWS = 500
COMPARE = {">": ">", "greater_than": ">", ">=": ">=", "<": "<", "less_than": "<", "<=": "<="}
_BUILT: dict = {}


class Predicates:
    """The tables of a rule set: which predicates a value meets, and whose conditions they are."""

    def __init__(self, rules: Sequence[Rule]):
        ids: dict[tuple[str, str], int] = {}
        self.fields = {f: n for n, f in enumerate(sorted({c.field.lower() for r in rules for c in r.conditions}))}
        self.sources = {s: n for n, s in enumerate(sorted({c.source.lower() for r in rules for c in r.conditions if c.source}))}
        self.rule_ids = [r.rule_id for r in rules]
        self.totals = np.array([len(r.conditions) for r in rules], np.int64)
        self.needs = np.array([max(r.min_indicators, len(r.conditions) if r.logic.upper() == "AND" else 1) for r in rules], np.int64)
        self.equals: dict[str, list[int]] = defaultdict(list)
        self.contains: dict[str, int] = {}
        self.others: list[tuple[int, str, object]] = []
        bounds: dict[str, list[tuple[float, int]]] = defaultdict(list)
        rows = []
        for r, rule in enumerate(rules):
            for no, c in enumerate(rule.conditions):
                kind, value = self._kind(c.operator, c.value)
                key = (kind, repr(value))
                if key not in ids:
                    n = ids[key] = len(ids)
                    if kind == "in":
                        for v in value:
                            self.equals[v].append(n)
                    elif kind == "contains":
                        self.contains[value] = n
                    elif kind in COMPARE.values():
                        bounds[kind].append((value, n))
                    else:
                        self.others.append((n, c.operator, c.value))
                rows.append((ids[key], r, no, self.fields[c.field.lower()], self.sources[c.source.lower()] if c.source else -1))
        self.bounds = {k: (np.array([t for t, _ in sorted(v)]), np.array([n for _, n in sorted(v)], np.int64)) for k, v in bounds.items()}
        at = np.array(sorted(rows), np.int64).reshape(-1, 5)
        self.rule, self.no, self.field, self.source = at[:, 1], at[:, 2], at[:, 3], at[:, 4]
        self.first = np.searchsorted(at[:, 0], np.arange(len(ids) + 1))

    @staticmethod
    def _kind(operator: str, value) -> tuple[str, object]:
        if operator in ("equals", "=", "=="):
            return "in", (str(value).lower(),)
        if operator == "in":
            return "in", tuple(sorted({str(v).strip().lower() for v in (value if isinstance(value, (list, tuple)) else str(value).split(","))}))
        if operator == "contains" and str(value):
            return "contains", str(value).lower()
        if operator in COMPARE and not np.isnan(float(value)):
            return COMPARE[operator], float(value)
        return f"column {operator}", value

    def automaton(self):
        """Of the values of `contains`; built once a worker."""
        import ahocorasick

        made = ahocorasick.Automaton()
        for word, n in self.contains.items():
            made.add_word(word, n)
        made.make_automaton()
        return made

    def met(self, texts: Sequence[str | None], numbers: np.ndarray, known: np.ndarray, others: Sequence) -> tuple[np.ndarray, np.ndarray]:
        """(value's place, predicate) for each predicate that each value meets. Equal values are looked up once."""
        walk = self._walk if self.contains else None
        code, distinct = pd.factorize(pd.Series(texts, dtype=object))
        found = []
        for t in distinct:
            hits = list(self.equals.get(t, ()))
            if walk is not None:
                hits += {n for _, n in walk.iter(t)}
            found.append(np.array(hits, np.int64))
        sizes = np.array([len(f) for f in found] + [0], np.int64)  # the last one is for null, coded -1
        flat, starts = np.concatenate([*found, np.zeros(0, np.int64)]), np.r_[0, np.cumsum(sizes)]
        places, preds = [spread(starts[code], sizes[code], flat)], []
        preds.append(places[0][1])
        places = [places[0][0]]
        for kind, (limit, ids) in self.bounds.items():
            at = np.searchsorted(limit, numbers, "left" if kind in (">", "<=") else "right")
            lo, hi = (np.zeros(len(at), np.int64), at) if kind[0] == ">" else (at, np.full(len(at), len(limit)))
            where, what = spread(lo, np.where(known, hi - lo, 0), ids)
            places.append(where)
            preds.append(what)
        if self.others:
            n = np.array([len(o) for o in others], np.int64)
            places.append(np.repeat(np.arange(len(n)), n))
            preds.append(np.concatenate([*[np.asarray(o, np.int64) for o in others], np.zeros(0, np.int64)]))
        return np.concatenate(places), np.concatenate(preds)

    def conditions_met(self, where: np.ndarray, preds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(value's place, condition's place in the tables), fields and sources not looked at."""
        return spread(self.first[preds], self.first[preds + 1] - self.first[preds], np.arange(len(self.rule)), where)

    def ready(self) -> Predicates:
        if not hasattr(self, "_walk"):
            self._walk = self.automaton() if self.contains else None
        return self


def spread(first: np.ndarray, sizes: np.ndarray, values: np.ndarray, where: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(place, value) for the stretches of values that start at `first`."""
    nth = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    place = np.repeat(np.arange(len(sizes)) if where is None else where, sizes)
    return place, values[np.repeat(first, sizes) + nth]


class RuleIndex:
    """A rule set made ready for a session: its tables are broadcast, of the size of the configuration."""

    def __init__(self, spark: SparkSession, rules: Sequence[Rule]):
        self.tables = Predicates(rules)
        self.key, self.held = uuid.uuid4().hex, spark.sparkContext.broadcast(self.tables)

    def _tables(self):
        key, held = self.key, self.held

        def get() -> Predicates:
            if key not in _BUILT:
                _BUILT.clear()  # a worker holds the tables of one rule set at a time
                _BUILT[key] = held.value.ready()
            return _BUILT[key]

        return get

    def _others(self, value: Column, batch: int = 100) -> Column:
        """Numbers of the predicates that have no table and that hold for the value."""
        parts = [F.filter(F.array(*[F.when(condition(value, op, v), F.lit(n)) for n, op, v in self.tables.others[i : i + batch]]), lambda x: x.isNotNull()) for i in range(0, len(self.tables.others), batch)]
        return F.concat(*parts) if parts else F.array().cast("array<int>")

    def tag_rows(self, df: DataFrame, name: str = "rule_ids") -> DataFrame:
        """RL-03, RL-06, SS-05 on the columns of a row: sorted ids of the rules that hold, as rules.tag_rows gives them."""
        fields = list(self.tables.fields)
        if not fields:
            return df.withColumn(name, F.array().cast("array<string>"))
        get = self._tables()

        def tag(columns: pd.DataFrame) -> pd.Series:
            return pd.concat([some(columns.iloc[i : i + ROWS]) for i in range(0, len(columns), ROWS)] or [some(columns)], ignore_index=True)

        def some(columns: pd.DataFrame) -> pd.Series:
            p, n = get(), len(columns)
            got, width = [np.zeros(0, np.int64)], max(1, len(p.rule_ids))
            for k in range(len(fields)):
                numbers = columns[f"number{k}"]
                where, preds = p.met(columns[f"text{k}"].tolist(), numbers.to_numpy(float), columns[f"known{k}"].to_numpy(bool), columns[f"others{k}"])
                where, cond = p.conditions_met(where, preds)
                own = p.field[cond] == k
                got.append(where[own] * width + p.rule[cond[own]])
            pairs, counts = np.unique(np.concatenate(got), return_counts=True)
            pairs = pairs[counts >= p.needs[pairs % width]]
            cuts, held = np.searchsorted(pairs, np.arange(n + 1) * width), (pairs % width).tolist()
            return pd.Series([sorted({p.rule_ids[r] for r in held[cuts[i] : cuts[i + 1]]}) for i in range(n)])

        cells = []
        for k, f in enumerate(fields):
            number = F.col(f).try_cast("double")
            cells += [F.lower(F.col(f).cast("string")).alias(f"text{k}"), number.alias(f"number{k}"), number.isNotNull().alias(f"known{k}"), self._others(F.col(f)).alias(f"others{k}")]
        return df.withColumn(name, F.pandas_udf(tag, "array<string>")(F.struct(*cells)))

    def match_indicators(self, fields: DataFrame, key: list[str], any_field: bool = False) -> DataFrame:
        """RL-02, RL-04, RL-06, RL-07 in long form (key, source, field, value): key, rule_id, matched, total, as
        rules.match_indicators gives them."""
        get = self._tables()

        def hits(columns: pd.DataFrame) -> pd.Series:
            return pd.concat([some(columns.iloc[i : i + ROWS]) for i in range(0, len(columns), ROWS)] or [some(columns)], ignore_index=True)

        def some(columns: pd.DataFrame) -> pd.Series:
            p, n = get(), len(columns)
            where, preds = p.met(columns["text"].tolist(), columns["number"].to_numpy(float), columns["known"].to_numpy(bool), columns["others"])
            where, cond = p.conditions_met(where, preds)
            field = np.array([p.fields.get(f, -1) for f in columns["field"]], np.int64)
            source = np.array([p.sources.get(s, -2) for s in columns["source"]], np.int64)
            own = ((p.field[cond] == field[where]) | any_field) & ((p.source[cond] == -1) | (p.source[cond] == source[where]))
            where, cond = where[own], cond[own]
            deep = int(p.no.max(initial=0)) // MASK_BITS + 1  # words a rule has at most
            width = max(1, len(p.rule_ids)) * deep
            words, at = np.unique(where * width + p.rule[cond] * deep + p.no[cond] // MASK_BITS, return_inverse=True)
            masks = np.zeros(len(words), np.int64)
            np.bitwise_or.at(masks, at.ravel(), np.int64(1) << (p.no[cond] % MASK_BITS))
            cuts, rule = np.searchsorted(words, np.arange(n + 1) * width), words % width // deep
            made = [{"rule_id": p.rule_ids[r], "total": int(p.totals[r]), "word": w, "mask": m} for r, w, m in zip(rule.tolist(), (words % deep).tolist(), masks.tolist(), strict=True)]
            return pd.Series([made[cuts[i] : cuts[i + 1]] for i in range(n)])

        number = F.col("value").try_cast("double")
        cells = F.struct(F.lower(F.col("value").cast("string")).alias("text"), number.alias("number"), number.isNotNull().alias("known"), self._others(F.col("value")).alias("others"), F.lower("field").alias("field"), F.lower("source").alias("source"))
        met = F.pandas_udf(hits, "array<struct<rule_id: string, total: int, word: int, mask: long>>")(cells)
        return united_masks(fields.select(*key, F.explode(met).alias("p")), key)
