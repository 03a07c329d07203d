"""Semantic rules, labels and dictionaries (RL-01..18, UD-03..04, EN-01..03)."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evspark.functions.predicates import condition
from evspark.operators.joins import config_table


#: Conditions in one word of a bit mask.
MASK_BITS = 63


@dataclass(frozen=True)
class Condition:
    field: str
    operator: str = "equals"
    value: object = ""
    source: str | None = None


@dataclass(frozen=True)
class Rule:
    rule_id: str
    label: str
    conditions: tuple[Condition, ...]
    logic: str = "AND"
    confidence: float = 1.0
    scope: str = "global"
    min_indicators: int = 1
    severity: str = "info"
    tags: tuple[str, ...] = field(default_factory=tuple)


def rules_of(rows: Sequence[dict]) -> list[Rule]:
    """UD-03: rule documents, checked: an id, a label and at least one condition; bad patterns fail here."""
    out = []
    for r in rows:
        parts = tuple(Condition(**c) for c in r.get("conditions", ()))
        if not r.get("rule_id") or not r.get("label"):
            raise ValueError(f"a rule needs an id and a label: {r}")
        for c in parts:
            if c.operator == "regex":
                re.compile(str(c.value))
        if parts:  # a rule without conditions matches nothing
            out.append(Rule(**{**r, "conditions": parts, "tags": tuple(r.get("tags", ()))}))
    return out


def load_rules(spark: SparkSession, path: str) -> list[Rule]:
    """UD-03: rules from JSON lines; a configuration file's size."""
    import json

    return rules_of([json.loads(r["value"]) for r in spark.read.text(path).toLocalIterator() if r["value"].strip()])


#: RL-05: the narrower scope wins.
SCOPES = ("wing", "pipeline", "global")


def rules_for(rules: Sequence[Rule]) -> list[Rule]:
    """RL-05: one rule an id, that of the narrowest scope."""
    best: dict[str, Rule] = {}
    for r in sorted(rules, key=lambda r: SCOPES.index(r.scope)):
        best.setdefault(r.rule_id, r)
    return [best[k] for k in sorted(best)]


def rule_column(rule: Rule, field=F.col, require_all: bool | None = None) -> Column:
    """RL-02, RL-03, RL-17: a rule on one row, as one boolean column."""
    parts = [condition(field(c.field), c.operator, c.value) for c in rule.conditions]
    n = sum((p.cast("int") for p in parts[1:]), parts[0].cast("int"))
    every = require_all if require_all is not None else rule.logic.upper() == "AND"
    return n >= max(rule.min_indicators, len(parts) if every else 1)


def tag_rows(df: DataFrame, rules: Sequence[Rule], name: str = "rule_ids", batch: int = 100) -> DataFrame:
    """RL-03, RL-06 on the columns of a row: sorted ids of the rules that hold. Rules are taken in batches, so that no
    expression grows beyond what the compiler takes."""
    parts = []
    for i in range(0, len(rules), batch):
        part = f"__tags_{i}"
        df = df.withColumn(part, F.filter(F.array(*[F.when(rule_column(r), F.lit(r.rule_id)) for r in rules[i : i + batch]]), lambda x: x.isNotNull()))
        parts.append(part)
    return df.withColumn(name, F.array_sort(F.array_distinct(F.concat(*parts)))).drop(*parts) if parts else df.withColumn(name, F.array().cast("array<string>"))


def filter_by_rule(df: DataFrame, rule: Rule) -> DataFrame:
    """RL-17"""
    return df.filter(rule_column(rule))


def conditions_table(spark: SparkSession, rules: Sequence[Rule]) -> DataFrame:
    """One row a condition: rule_id, no, field, operator, value, source. Its size is that of the configuration."""
    rows = [(r.rule_id, i, c.field, c.operator, str(c.value), c.source) for r in rules for i, c in enumerate(r.conditions)]
    return spark.createDataFrame(rows, "rule_id string, no int, field string, operator string, value string, source string")


def long_fields(df: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """key, field, value: one row a filled column."""
    pairs = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in columns])
    return df.select(*key, F.explode(F.filter(pairs, lambda p: p["value"].isNotNull())).alias("p")).select(*key, "p.field", "p.value")


def united_masks(hit: DataFrame, key: list[str]) -> DataFrame:
    """key, rule_id, total, matched from rows of key and p (rule_id, total, word of the mask, mask)."""
    words = hit.groupBy(*key, "p.rule_id", "p.total", "p.word").agg(F.bit_count(F.bit_or("p.mask")).alias("__met"))
    return words.groupBy(*key, "rule_id", "total").agg(F.sum("__met").cast("int").alias("matched"))


def match_indicators(fields: DataFrame, key: list[str], rules: Sequence[Rule], any_field: bool = False) -> DataFrame:
    """RL-02, RL-04, RL-06, RL-07: key, rule_id, matched (conditions met by any record of the key), total.

    fields is long form (key, source, field, value). Each condition is a column over one row's value; whichever row of
    the key meets it counts once: bit masks of a rule, united by bit_or before and after the shuffle.
    """
    parts = []
    for r in rules:
        masks: list[Column] = []
        for i, c in enumerate(r.conditions):
            met = condition(F.col("value"), c.operator, c.value)
            met = met if any_field else met & (F.lower("field") == c.field.lower())
            met = met & (F.lower("source") == c.source.lower()) if c.source else met
            bit = F.when(met, F.lit(1 << i % MASK_BITS)).otherwise(0).cast("long")
            if i % MASK_BITS:
                masks[-1] = masks[-1].bitwiseOR(bit)
            else:
                masks.append(bit)
        parts += [F.struct(F.lit(r.rule_id).alias("rule_id"), F.lit(len(r.conditions)).alias("total"), F.lit(n).alias("word"), m.alias("mask")) for n, m in enumerate(masks)]
    hit = fields.select(*key, F.explode(F.filter(F.array(*parts), lambda p: p["mask"] != 0)).alias("p"))
    if all(len(r.conditions) <= MASK_BITS for r in rules):  # one word a rule: nothing to sum
        return hit.groupBy(*key, "p.rule_id", "p.total").agg(F.bit_count(F.bit_or("p.mask")).alias("matched"))
    return united_masks(hit, key)


def matched_rules(indicators: DataFrame, rules: Sequence[Rule], require_all: bool = False) -> DataFrame:
    """RL-06, RL-07: AND needs all conditions, OR the rule's least number; the least never exceeds the total."""
    need = F.lit(None).cast("int")
    for r in rules:
        every = require_all or r.logic.upper() == "AND"
        need = F.when(F.col("rule_id") == r.rule_id, len(r.conditions) if every else min(r.min_indicators, len(r.conditions))).otherwise(need)
    return indicators.filter(F.col("matched") >= need)


def tag_list(found: DataFrame, key: list[str]) -> DataFrame:
    """RL-10: sorted rule ids of each key, joined."""
    return found.groupBy(*key).agg(F.array_join(F.array_sort(F.collect_set("rule_id")), ",").alias("rule_ids"), F.count_distinct("rule_id").alias("n_rules"))


def semantic_data(found: DataFrame, rules: Sequence[Rule], key: list[str]) -> DataFrame:
    """RL-10: key, map of rule id to struct(label, confidence, matched)."""
    pairs = [x for r in rules for x in (F.lit(r.rule_id), F.struct(F.lit(r.label).alias("label"), F.lit(r.confidence).alias("confidence")))]
    info = F.element_at(F.create_map(*pairs), F.col("rule_id"))
    return found.groupBy(*key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("rule_id", F.struct(info["label"].alias("label"), info["confidence"].alias("confidence"), "matched").alias("data"))))).alias("semantic_data"))


def is_generic(c: Condition) -> bool:
    """RL-08: a pattern that says little: a short contains, or a regex that takes nearly anything."""
    v = str(c.value)
    return (c.operator == "contains" and len(v) < 4) or (c.operator == "regex" and (v in (".*", ".+", "^.*$", "^.+$") or len(re.sub(r"[.^$*+?()\[\]{}|\\]", "", v)) < 3)) or c.operator == "wildcard"


def broad_patterns(found: DataFrame, key: str, most: int = 100) -> DataFrame:
    """RL-08: rules that hold for more than `most` keys."""
    return found.groupBy("rule_id").agg(F.count_distinct(key).alias("n_matches")).withColumn("too_broad", F.col("n_matches") > most)


def token_filter(df: DataFrame, text: Column, terms: Sequence[str]) -> DataFrame:
    """RL-09 by whole tokens: rows with a token that is one of the terms. For rules see gram_index, which loses none."""
    tokens = F.split(F.lower(text), "[^a-z0-9_]+")
    return df.filter(F.arrays_overlap(tokens, F.array(*[F.lit(t.lower()) for t in terms])))


def same_source(a: Column, b: Column) -> Column:
    """RL-11: names equal or one inside the other, case and separators aside."""
    x, y = (F.regexp_replace(F.lower(c), "[^a-z0-9]", "") for c in (a, b))
    return F.coalesce((x != "") & (y != "") & ((x == y) | x.contains(y) | y.contains(x)), F.lit(False))


def label_values(fields: DataFrame, mappings: DataFrame) -> DataFrame:
    """RL-01, RL-13, RL-18: fields (.., field, value) with the label of the mapping (field, match_value, label,
    confidence) that equals the value without regard to case; the most confident wins."""
    m = mappings.select(F.lower("field").alias("__f"), F.lower("match_value").alias("__v"), "label", "confidence")
    w = Window.partitionBy("__f", "__v").orderBy(F.col("confidence").desc(), "label")
    m = m.withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__rn")
    return fields.join(config_table(m), (F.lower("field") == F.col("__f")) & (F.lower("value") == F.col("__v")), "left").drop("__f", "__v")


def label_by_pattern(value: Column, patterns: Sequence[tuple[str, str, float]]) -> Column:
    """RL-01 for patterns (regex, label, confidence): array of struct(label, confidence), most confident first."""
    hits = F.array(*[F.when(value.rlike(f"(?i){p}"), F.struct((-F.lit(c)).alias("order"), F.lit(label).alias("label"), F.lit(c).alias("confidence"))) for p, label, c in patterns])
    return F.transform(F.array_sort(F.filter(hits, lambda h: h.isNotNull())), lambda h: F.struct(h["label"].alias("label"), h["confidence"].alias("confidence")))


def scoped_value(wanted: DataFrame, mappings: DataFrame) -> DataFrame:
    """RL-16: (source, field, value) -> label of the narrowest scope."""
    rank = F.array_position(F.array(*[F.lit(s) for s in SCOPES]), F.col("scope"))
    w = Window.partitionBy("source", "field", "value").orderBy(rank, "label")
    return wanted.join(config_table(mappings), ["source", "field", "value"], "left").withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__rn")


def of_identity(matches: DataFrame, identity: str, pattern: str | None = None) -> DataFrame:
    """RL-12: the matches of one identity (a `%` pattern), or all."""
    return matches.filter(F.coalesce(F.col(identity).ilike(pattern), F.lit(False))) if pattern else matches


# Names of tools and words whose mention is a risk.
TOOL_WORDS = (
    "mimikatz", "hashcat", "aircrack", "cain", "abel", "wce", "pwdump", "lsass", "backdoor", "rootkit", "meterpreter", "psexec", "procdump", "comsvcs", "vcab", "vmcompute", "sdelete",
    "psloggedon", "putty", "plink", "netcat", "nc.exe", "socat", "nmap", "masscan", "hping3", "nuclei", "metasploit", "cobalt", "beacon", "empire", "powershell_empire", "evasion",
    "obfuscation", "crypter", "packer", "kali", "parrot", "pentoo", "wifite", "hashkill",
)
# Parts of paths that programs seldom start from.
PATH_WORDS = ("temp\\", "tmp\\", "%temp%", "appdata\\local\\temp", "\\windows\\", "system32", "syswow64", ".zip", ".rar", ".7z", ".vbs", ".ps1", ".cmd", ".bat")
# Names of the levels.
RISK_LEVELS = {5: "CRITICAL", 4: "HIGH", 3: "MEDIUM", 2: "LOW", 1: "INFO"}


def _names_any(value: Column, words: Sequence[str]) -> Column:
    return F.coalesce(F.lower(value).rlike("|".join(re.escape(w) for w in words)), F.lit(False))


def _finding(severity: Column, indicator: Column) -> Column:
    """struct(severity, level, indicator), null where nothing is found."""
    level = F.element_at(F.create_map(*[F.lit(x) for k, v in RISK_LEVELS.items() for x in (k, v)]), severity)
    return F.when(severity.isNotNull(), F.struct(severity.alias("severity"), level.alias("level"), indicator.alias("indicator")))


def start_risk(command: Column) -> Column:
    """RL-14: a program that starts by itself: an odd path (4) first, then a tool's name (5), then a mention of temp (4)."""
    path, tool, temp = _names_any(command, PATH_WORDS), _names_any(command, TOOL_WORDS), _names_any(command, ["temp"])
    return _finding(F.when(path, 4).when(tool, 5).when(temp, 4), F.when(path, "suspicious_path").when(tool, "tool_keyword").when(temp, "temp_execution"))


def software_risks(name: Column, publisher: Column) -> Column:
    """RL-14: installed software: no publisher (3) and a tool's name (5); an array, as both can hold."""
    absent, tool = F.coalesce(publisher == "", F.lit(True)), _names_any(name, TOOL_WORDS)
    return F.filter(F.array(_finding(F.when(absent, 3), F.lit("no_publisher")), _finding(F.when(tool, 5), F.lit("tool_keyword"))), lambda x: x.isNotNull())


def service_risk(start_type: Column, image_path: Column, name: Column, description: Column) -> Column:
    """RL-14: services that start by themselves (type 2): the last that holds of an odd path (4), a tool's name (5), and
    neither name nor description (3)."""
    unnamed = (F.coalesce(name, F.lit("")) == "") & (F.coalesce(description, F.lit("")) == "")
    path, tool = _names_any(image_path, PATH_WORDS), _names_any(name, TOOL_WORDS)
    found = _finding(F.when(unnamed, 3).when(tool, 5).when(path, 4), F.when(unnamed, "unnamed_service").when(tool, "tool_keyword").when(path, "suspicious_path"))
    return F.when(start_type == 2, found)


def update_risk(au_options: Column) -> Column:
    """RL-14: automatic updates that are off (5)."""
    return _finding(F.when(au_options.cast("int") == 2, 5), F.lit("updates_disabled"))


def find_names(parts: list[DataFrame], column: str, words: Sequence[str]) -> DataFrame:
    """RL-15: rows of several tables whose text names one of the words, each text once."""
    out = None
    for df in parts:
        hit = df.select(F.col(column).cast("string").alias("found")).filter(F.coalesce(F.col("found").rlike("(?i)" + "|".join(map(re.escape, words))), F.lit(False)))
        out = hit if out is None else out.unionByName(hit)
    return out.distinct()


# dictionaries


@dataclass(frozen=True)
class DictionaryRule:
    """EN-01, EN-02, UD-04: where (value, key) pairs come from."""

    table: str
    value: str
    key: str
    name: str = ""
    category: str = ""


# Where the default pairs come from (table, value, key, name, category).
DEFAULT_RULES = tuple(
    DictionaryRule(*r)
    for r in (
        ("UserProfiles", "user_sid", "username", "SID_to_Username", "SID"),
        ("UserProfiles", "user_sid", "profile_path", "SID_to_ProfilePath", "SID"),
        ("Network_list", "gateway_mac", "network_name", "MAC_to_NetworkName", "MAC"),
        ("network_devices", "mac_address", "device_name", "MAC_to_DeviceName", "MAC"),
        ("InventoryApplicationFile", "file_id", "original_file_name", "Hash_to_Filename", "Hash"),
        ("known_hashes", "hash", "app_name", "Hash_to_ApplicationName", "Hash"),
        ("known_guids", "guid", "app_name", "GUID_to_ApplicationName", "GUID"),
        ("known_appids", "appid", "app_name", "AppID_to_ApplicationName", "AppID"),
        ("clsid_registry", "clsid", "component_name", "CLSID_to_ComponentName", "CLSID"),
        ("process_events", "process_id", "process_name", "ProcessID_to_ProcessName", "ProcessID"),
        ("volume_info", "volume_guid", "volume_label", "VolumeGUID_to_VolumeName", "VolumeGUID"),
        ("dns_cache", "ip_address", "hostname", "IP_to_Hostname", "IP"),
        ("usb_devices", "serial_number", "device_name", "USBSerial_to_DeviceName", "USBSerial"),
        ("services", "service_name", "display_name", "ServiceName_to_DisplayName", "ServiceName"),
        ("event_logs", "event_id", "description", "EventID_to_EventDescription", "EventID"),
    )
)
# Security ids with well-known names.
WELL_KNOWN_SIDS = {
    "S-1-5-18": "NT AUTHORITY\\SYSTEM", "S-1-5-19": "NT AUTHORITY\\LOCAL SERVICE", "S-1-5-20": "NT AUTHORITY\\NETWORK SERVICE", "S-1-5-17": "IUSR", "S-1-0": "Null Authority", "S-1-1": "Everyone",
    "S-1-2": "Local", "S-1-3": "Creator Owner", "S-1-5-32-544": "Administrators", "S-1-5-32-545": "Users", "S-1-5-32-546": "Guests", "S-1-5-32-547": "Power Users", "S-1-5-32-548": "Account Operators",
    "S-1-5-32-549": "Server Operators", "S-1-5-32-550": "Print Operators", "S-1-5-32-551": "Backup Operators", "S-1-5-32-552": "Replicators", "S-1-5-11": "Authenticated Users",
    "S-1-5-12": "Restricted Code", "S-1-5-4": "Interactive", "S-1-5-6": "Service", "S-1-5-7": "Anonymous",
}


def default_pairs(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """EN-01: the pairs of all default rules whose tables are given, and of the well-known ids."""
    rows = [(v, k, "Windows_Internals", len(DEFAULT_RULES)) for v, k in WELL_KNOWN_SIDS.items()]
    known = spark.createDataFrame(rows, "value string, key string, source string, rule_no int")
    return dictionary_pairs(tables, DEFAULT_RULES).unionByName(known) if any(r.table in tables for r in DEFAULT_RULES) else known


class RuleStore:
    """UD-04: a user's dictionary rules, kept as JSON lines under a path; of a name the latest entry counts, and a deleted
    or disabled rule isn't listed. The size is that of a configuration."""

    COLUMNS = ("name", "category", "table", "value", "key")
    SCHEMA = "name string, category string, `table` string, value string, key string, enabled boolean, version long"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _append(self, rules: Sequence[DictionaryRule], enabled: bool) -> None:
        import time

        rows = [(*(getattr(r, c) for c in self.COLUMNS), enabled, time.time_ns()) for r in rules]
        self.spark.createDataFrame(rows, self.SCHEMA).coalesce(1).write.mode("append").json(self.path)

    def save(self, *rules: DictionaryRule) -> None:
        for r in rules:
            if not all((r.name, r.table, r.value, r.key)):
                raise ValueError(f"a dictionary rule needs a name, a table, a value and a key column: {r}")
        self._append(rules, True)

    def delete(self, name: str) -> None:
        self._append([DictionaryRule("", "", "", name)], False)

    def table(self) -> DataFrame:
        w = Window.partitionBy("name").orderBy(F.col("version").desc())
        latest = self.spark.read.schema(self.SCHEMA).json(self.path).withColumn("rn", F.row_number().over(w))
        return latest.filter("rn = 1 and enabled").select(*[F.col(f"`{c}`") for c in self.COLUMNS])

    def rules(self) -> list[DictionaryRule]:
        return [DictionaryRule(r["table"], r["value"], r["key"], r["name"], r["category"]) for r in self.table().orderBy("name").toLocalIterator()]

    def get(self, name: str) -> DictionaryRule | None:
        return next((r for r in self.rules() if r.name == name), None)


def dictionary_pairs(tables: dict[str, DataFrame], rules: Sequence[DictionaryRule]) -> DataFrame:
    """EN-01, EN-02: value, key, source, rule_no of every rule whose table is there; blanks don't count."""
    out = None
    for i, r in enumerate(rules):
        if r.table not in tables:
            continue
        pairs = tables[r.table].select(F.trim(F.col(r.value).cast("string")).alias("value"), F.trim(F.col(r.key).cast("string")).alias("key"), F.lit(r.table).alias("source"), F.lit(i).alias("rule_no"))
        pairs = pairs.filter((F.col("value") != "") & (F.col("key") != ""))
        out = pairs if out is None else out.unionByName(pairs)
    if out is None:
        raise ValueError("none of the rules' tables is given")
    return out


def merge_dictionary(pairs: DataFrame) -> DataFrame:
    """EN-03: value, keys (distinct, in the order of their rules, then by text, comma-joined), source of the first rule."""
    first = pairs.groupBy("value", "key").agg(F.min("rule_no").alias("rule_no"), F.min_by("source", F.struct("rule_no", "source")).alias("source"))
    return first.groupBy("value").agg(F.transform(F.array_sort(F.collect_list(F.struct("rule_no", "key"))), lambda r: r["key"]).alias("ks"), F.min_by("source", F.struct("rule_no", "key")).alias("source")).select("value", F.array_join("ks", ",").alias("keys"), "source")
