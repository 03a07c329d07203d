"""Identity, path, flag and text columns (STR-01..STR-31, JSON-01..02). Empty results are null unless said otherwise."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Suffixes that a name is cut by, first match only, in this order; case doesn't matter.
SUFFIXES = (
    r"[-_]?\d{2}\.\d{2}\.\d{4}$", r"[-_]?\d{4}-\d{2}-\d{2}$", r"[-_]?\d{2}-\d{2}-\d{4}$", r"[-_]?\d{8}$",
    r"[-_]?v?\d+\.\d+(?:\.\d+)?$", r"[-_]v\d+$", r"\s+Build\s+\d+$",
    r"[-_]\d+$", r"\s*\(\d+\)$", r"\s*-\s*Copy(?:\s*\(\d+\))?$",
    r"\s+x64$", r"\s+x86$",
)
# Endings of program files, for the two normalisers that drop them.
APP_ENDINGS = ("exe", "lnk", "dll", "msi", "bat", "cmd", "ps1", "vbs", "js", "com", "scr", "pif", "application", "gadget", "msp", "hta", "cpl", "msc", "jar", "py", "pyc", "pyw")
SCAN_ENDINGS = ("exe", "dll", "sys", "bat", "cmd", "ps1", "vbs", "js", "jar", "msi")
NOISE_WORDS = ("the", "a", "an", "and", "or", "of", "in", "on", "at", "to", "for")
BOOLEAN_WORDS = ("true", "false", "True", "False", "TRUE", "FALSE", "1", "0", "yes", "no", "Yes", "No", "YES", "NO")
# Program names and path prefixes with their display forms.
APP_NAMES = {
    "chrome.exe": "Google Chrome", "firefox.exe": "Mozilla Firefox", "msedge.exe": "Microsoft Edge", "iexplore.exe": "Internet Explorer", "explorer.exe": "Windows Explorer",
    "notepad.exe": "Notepad", "cmd.exe": "Command Prompt", "powershell.exe": "PowerShell", "python.exe": "Python", "java.exe": "Java", "code.exe": "Visual Studio Code",
    "excel.exe": "Microsoft Excel", "word.exe": "Microsoft Word", "outlook.exe": "Microsoft Outlook",
}
PATH_PREFIXES = {"c:\\program files\\": "%ProgramFiles%\\", "c:\\program files (x86)\\": "%ProgramFiles(x86)%\\", "c:\\windows\\": "%Windows%\\", "c:\\users\\": "%UserProfile%\\", "c:\\programdata\\": "%ProgramData%\\"}
# Bits of the file-system's flag words.
FILE_ATTRIBUTES = {
    0x1: "READONLY", 0x2: "HIDDEN", 0x4: "SYSTEM", 0x10: "DIRECTORY", 0x20: "ARCHIVE", 0x40: "DEVICE", 0x80: "NORMAL", 0x100: "TEMPORARY", 0x200: "SPARSE_FILE", 0x400: "REPARSE_POINT",
    0x800: "COMPRESSED", 0x1000: "OFFLINE", 0x2000: "NOT_CONTENT_INDEXED", 0x4000: "ENCRYPTED",
}
CHANGE_REASONS = {
    0x1: "DATA_OVERWRITE", 0x2: "DATA_EXTEND", 0x4: "DATA_TRUNCATION", 0x10: "NAMED_DATA_OVERWRITE", 0x20: "NAMED_DATA_EXTEND", 0x40: "NAMED_DATA_TRUNCATION", 0x100: "FILE_CREATE",
    0x200: "FILE_DELETE", 0x400: "EA_CHANGE", 0x800: "SECURITY_CHANGE", 0x1000: "RENAME_OLD_NAME", 0x2000: "RENAME_NEW_NAME", 0x4000: "INDEXABLE_CHANGE", 0x8000: "BASIC_INFO_CHANGE",
    0x10000: "HARD_LINK_CHANGE", 0x20000: "COMPRESSION_CHANGE", 0x40000: "ENCRYPTION_CHANGE", 0x80000: "OBJECT_ID_CHANGE", 0x100000: "REPARSE_POINT_CHANGE", 0x200000: "STREAM_CHANGE",
    0x80000000: "CLOSE",
}
RECORD_FLAGS = {0x1: "IN_USE", 0x2: "DIRECTORY"}
# Entity patterns and their weights.
ENTITIES = {
    "timestamp": (r"\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:\d{2})?", 0.3),
    "event_id": (r"(?i)(?:Event(?:ID)?|EventID)\s*:?\s*\d{4,5}", 0.3),
    "file_path": (r"(?:[A-Z]:\\[\w\s\\.\\-]+)|(?:/[\w/\\.\\-]+)", 0.2),
    "username": (r"(?:[A-Z][A-Z0-9_\\-]+\\[\w]+)|(?:[\w\\.\\-]+@[\w\\.\\-]+)", 0.1),
    "ip_address": (r"(?:\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})|(?:[0-9a-fA-F:]+::[0-9a-fA-F:]+)", 0.2),
    "registry_key": (r"(?i)HK(?:EY_)?(?:LOCAL_MACHINE|CURRENT_USER|CLASSES_ROOT|USERS|CURRENT_CONFIG|LM|CU)\\[\w\\\\]+", 0.2),
}


def none_if_empty(x: Column) -> Column:
    return F.when(x != "", x)


def normal_name(x: Column) -> Column:
    """STR-01"""
    return none_if_empty(F.lower(F.trim(x)))


def normal_path(x: Column) -> Column:
    """STR-02"""
    return none_if_empty(F.regexp_replace(F.translate(F.lower(F.trim(x)), "\\", "/"), "/+", "/"))


def file_name(x: Column) -> Column:
    """STR-03: what follows the last separator of either kind."""
    return none_if_empty(F.element_at(F.split(F.translate(x, "\\", "/"), "/"), -1))


def base_and_suffix(x: Column) -> Column:
    """STR-04: struct(base, suffix): one date, version, copy or architecture suffix cut off, separators to spaces."""
    suffix = F.lit(None).cast("string")
    for p in reversed(SUFFIXES):
        suffix = F.when(x.rlike(f"(?i){p}"), F.regexp_extract(x, f"(?i){p}", 0)).otherwise(suffix)
    cut = F.when(suffix.isNull(), x).otherwise(F.regexp_replace(F.substr(x, F.lit(1), F.length(x) - F.length(suffix)), r"[-_ ]+$", ""))
    base = F.trim(F.regexp_replace(F.translate(cut, "-_", "  "), r"\s+", " "))
    return F.struct(base.alias("base"), F.coalesce(F.regexp_replace(suffix, r"^[-_ ]+", ""), F.lit("")).alias("suffix"))


def composite_key(name: Column, path: Column, hash_: Column) -> Column:
    """STR-05: name|path|hash, each normalised, missing parts empty."""
    n = F.regexp_replace(F.lower(base_and_suffix(name)["base"]), "[^a-z0-9]", "")
    p = F.regexp_replace(F.trim(F.lower(F.translate(path, "\\", "/"))), "/+$", "")
    return F.concat_ws("|", *[F.coalesce(c, F.lit("")) for c in (n, p, F.trim(F.lower(hash_)))])


# Fixed values (STR-06, STR-07): what comes off an application's name, in this order: a prefetch hash, the tail of a short
# name, numbers in brackets, copy marks, versions.
PREFETCH_HASH = r"(?i)^(.+?)\s+[0-9a-f]{8}\.pf$"
SHORT_TAIL = r"(?s)~.*$"
APP_MARKS = (r"[\s_]*\(\d+\)\s*$", r"[\s_]*[-_]?\s*[Cc]opy\s*\d*\s*$", r"[\s_]*\([Cc]opy\s*\d*\)\s*$", r"[\s_]+[vV]?\d+(\.\d+)*\s*$", r"[vV]\d+(\.\d+)*\s*$")
# Fixed values (STR-08): what comes off a name in the window engine: versions, brackets, all but letters.
SCAN_MARKS = (r"\s*v?\d+[\d.]*", r"\s*\(.*?\)", r"\s*\[.*?\]", r"[^a-z\s]")


def _stripped(x: Column) -> Column:
    """Prefetch hash, ~ tail, ending, copy and version marks off, in this order."""
    x = F.regexp_replace(F.trim(x), PREFETCH_HASH, "$1")
    x = F.regexp_replace(x, SHORT_TAIL, "")
    x = F.regexp_replace(x, rf"(?i)\.({'|'.join(APP_ENDINGS)})$", "")
    for p in APP_MARKS:
        x = F.regexp_replace(x, p, "")
    return x


def app_key(x: Column) -> Column:
    """STR-06: letters only, lower case; if nothing is left, letters and digits of the plain name."""
    key = F.regexp_replace(F.lower(_stripped(x)), "[^a-z]", "")
    plain = F.regexp_replace(F.regexp_replace(F.lower(F.trim(x)), SHORT_TAIL, ""), "[^a-z0-9]", "")
    return F.when(key != "", key).otherwise(plain)


def app_display(x: Column) -> Column:
    """STR-07: the same stripping with case and inner separators kept."""
    shown = F.trim(_stripped(x))
    return F.when(shown != "", shown).otherwise(F.trim(x))


def scan_identity(x: Column) -> Column:
    """STR-08: lower case, ending, versions, brackets and non-letters off, noise words off, repeats kept."""
    x = F.regexp_replace(F.lower(x), rf"\.({'|'.join(SCAN_ENDINGS)})$", "")
    for p in SCAN_MARKS:
        x = F.regexp_replace(x, p, "")
    words = F.filter(F.split(x, r"\s+"), lambda w: (w != "") & ~w.isin(*NOISE_WORDS))
    return F.array_join(words, " ")


def is_command_line(x: Column) -> Column:
    """STR-09: quoted text, switches or several words after a program name."""
    return x.contains('"') | x.contains(" -") | x.contains(" /") | F.lower(x).contains(".exe ")


def command_program(x: Column) -> Column:
    quoted = F.regexp_extract(F.trim(x), r'^"([^"]*)"', 1)
    return none_if_empty(F.when(quoted != "", quoted).otherwise(F.get(F.split(F.trim(x), r"\s+"), F.lit(0))))


def first_filled(columns: list[Column]) -> Column:
    """STR-10"""
    return F.coalesce(*[none_if_empty(F.trim(c.cast("string"))) for c in columns])


def identity_info(names: list[Column], paths: list[Column], hashes: list[Column], commands: list[Column] | None = None) -> Column:
    """STR-11: struct(name, path, hash, type) from ordered candidates; a missing name comes from the path, then a command line."""
    name, path, hash_ = (first_filled(c) if c else F.lit(None).cast("string") for c in (names, paths, hashes))
    program = command_program(first_filled(commands)) if commands else F.lit(None).cast("string")
    name = F.coalesce(F.when(is_command_line(name), file_name(command_program(name))).otherwise(name), file_name(path), file_name(program))
    return F.struct(name.alias("name"), path.alias("path"), hash_.alias("hash"), identity_type(name, path, hash_).alias("type"))


def discover_identity(columns: list[str], terms: tuple[str, ...] = ("name", "app", "file", "path", "exec", "process", "program")) -> Column:
    """STR-12: the string column with the best score: +10 a term in its name, +20 a program ending, +5 a separator; ties to the first."""
    scored = []
    for i, c in enumerate(columns):
        v = F.trim(F.col(c).cast("string"))
        points = F.lit(10 * sum(t in c.lower() for t in terms)) + F.when(v.rlike(r"(?i)\.(exe|dll|lnk|sys|bat)\b"), 20).otherwise(0) + F.when(v.rlike(r"[\\/]"), 5).otherwise(0)
        scored.append(F.struct(F.when(F.coalesce(v, F.lit("")) == "", -1).otherwise(points).alias("score"), F.lit(-i).alias("order"), v.alias("value"), F.lit(c).alias("field")))
    best = F.array_max(F.array(*scored))
    return F.when(best["score"] > 0, F.struct(best["field"].alias("field"), best["value"].alias("value"), best["score"].alias("score")))


def identity_problem(x: Column, field_is_id: bool = False) -> Column:
    """STR-13: why a value is no identity, null if it is one. Columns that hold ids are only checked for emptiness."""
    v = F.trim(x)
    empty = F.when(x.isNull() | (x == ""), "empty_value").when(v == "", "whitespace_only")
    if field_is_id:
        return empty
    return (
        empty.when(v.isin(*BOOLEAN_WORDS), "boolean_string").when(v.rlike(r"^[+-]?\d+(\.\d+)?$"), "numeric_value")
        .when((F.length(v) < 2) & ~v.rlike("^[A-Za-z]:$"), "too_short").when(~v.rlike(r"[\p{L}\p{N}]"), "no_alphanumeric")
    )


def is_match_identity(x: Column, source: Column) -> Column:
    """STR-14: no source's name, no path, no ISO time, no table or database name."""
    v = F.trim(x)
    return F.coalesce((v != "") & (F.lower(v) != F.lower(source)) & ~v.rlike(r"[\\/]") & ~v.rlike(r"^\d{4}-\d{2}-\d{2}T") & ~F.lower(v).rlike(r"(_data|\.db)$"), F.lit(False))


def type_by_source(source: Column) -> Column:
    """STR-15"""
    s = F.lower(source)
    return F.when(s.rlike("folder|shellbag|director"), "folder").when(s.rlike("service"), "service").when(s.rlike("mft|usn|lnk|jump|recycle|file"), "file").otherwise("application")


def identity_type(name: Column, path: Column, hash_: Column) -> Column:
    """STR-16"""
    return F.when(hash_.isNotNull(), "hash").when(path.isNotNull(), "path").when(name.isNotNull(), "name").otherwise("unknown")


def path_similarity(a: Column, b: Column) -> Column:
    """STR-17: components of a that b has too, over the longer count."""
    x, y = (F.filter(F.split(normal_path(c), "/"), lambda p: p != "") for c in (a, b))
    most = F.greatest(F.size(x), F.size(y))
    return F.when(most > 0, F.size(F.filter(x, lambda p: F.array_contains(y, p))) / most).otherwise(0.0)


def edit_distance(a: Column, b: Column) -> Column:
    """STR-18"""
    return F.levenshtein(a, b)


def app_of_path(path: Column) -> Column:
    """STR-19: the stem of the file name, in lower case."""
    return F.lower(F.regexp_replace(file_name(path), r"\.[^.]*$", ""))


def parent_of_path(path: Column) -> Column:
    return none_if_empty(F.regexp_replace(normal_path(path), "/[^/]*$", ""))


def user_of_path(path: Column) -> Column:
    return none_if_empty(F.regexp_extract(normal_path(path), "/users/([^/]+)", 1))


def canonical_app(x: Column) -> Column:
    """STR-20: the display name of the first known program the value names; else the value."""
    return reduce(lambda c, k: c.when(F.lower(x).contains(k), APP_NAMES[k]), list(APP_NAMES), F.when(x.isNull(), None)).otherwise(x)


def canonical_path(x: Column) -> Column:
    return reduce(lambda c, k: c.when(F.lower(x).startswith(k), F.concat(F.lit(PATH_PREFIXES[k]), F.substr(x, F.lit(len(k) + 1)))), list(PATH_PREFIXES), F.when(x.isNull(), None)).otherwise(x)


def parse_num(x: Column) -> Column:
    """STR-21, UD-02: plain numbers, sizes to bytes, durations to seconds; anything else is 0."""
    t = F.trim(x.cast("string"))
    plain = F.regexp_replace(t, ",", "").try_cast("double")
    size_n = F.regexp_extract(t, r"(?i)(\d+\.?\d*)\s*(B|KB|MB|GB|TB)", 1).try_cast("double")
    unit = F.upper(F.regexp_extract(t, r"(?i)(\d+\.?\d*)\s*(B|KB|MB|GB|TB)", 2))
    power = F.when(unit == "B", 1.0).when(unit == "KB", 1024.0).when(unit == "MB", 1024.0**2).when(unit == "GB", 1024.0**3).when(unit == "TB", 1024.0**4)
    part = r"(?i)(\d+\.?\d*)\s*(ms|h|m|s|hrs|min|sec)"
    seconds = lambda u: F.when(u == "h", 3600.0).when(u == "hrs", 3600.0).when(u == "m", 60.0).when(u == "min", 60.0).when(u == "s", 1.0).when(u == "sec", 1.0).when(u == "ms", 0.001).otherwise(0.0)
    pairs = F.arrays_zip(F.regexp_extract_all(t, F.lit(part), F.lit(1)).alias("n"), F.regexp_extract_all(t, F.lit(part), F.lit(2)).alias("u"))
    spans = F.aggregate(pairs, F.lit(0.0), lambda a, p: a + p["n"].cast("double") * seconds(F.lower(p["u"])))
    return F.when(t.isNull() | (t == "") | (F.lower(t) == "unknown"), 0.0).otherwise(F.coalesce(plain, size_n * power, spans, F.lit(0.0)))


def flags_to_text(x: Column, bits: dict[int, str], none: str) -> Column:
    """STR-22: names of the bits that are set, joined by |."""
    v = x.try_cast("long")
    names = F.array(*[F.when(v.bitwiseAND(F.lit(k)) != 0, F.lit(name)) for k, name in bits.items()])
    text = F.array_join(F.filter(names, lambda n: n.isNotNull()), "|")
    return F.when(v.isNull(), x.cast("string")).when(text == "", none).otherwise(text)


def file_properties(name: Column, attributes: Column) -> Column:
    """STR-23"""
    ending = F.lower(F.regexp_extract(name, r"(\.[^.\\/]+)$", 1))
    bit = lambda b: F.coalesce(attributes.cast("long").bitwiseAND(F.lit(b)) != 0, F.lit(False))
    return F.struct(ending.alias("extension"), bit(0x10).alias("is_directory"), bit(0x4).alias("is_system"), bit(0x2).alias("is_hidden"), ending.isin(".exe", ".dll", ".sys", ".bat", ".cmd", ".ps1", ".vbs", ".msi", ".scr").alias("is_executable"))


def is_tool_noise(name: Column, patterns: tuple[str, ...] = (r"\.tmp$", r"^~\$", r"\.log\d*$", r"^\$", r"-journal$")) -> Column:
    """STR-24"""
    return F.coalesce(F.lower(name).rlike("|".join(patterns)), F.lit(False))


def record_of_reference(frn: Column) -> Column:
    """STR-25: the low 48 bits of a file reference."""
    return frn.cast("long").bitwiseAND(F.lit((1 << 48) - 1))


def resolved_name(name: Column, id_: Column, kind: str = "App ID", with_id: bool = False) -> Column:
    """STR-26: a looked-up name, or `App ID n`; optionally `name (id)`."""
    said = F.coalesce(name, F.concat(F.lit(f"{kind} "), id_.cast("string")))
    return F.when(name.isNotNull(), F.concat(name, F.lit(" ("), id_.cast("string"), F.lit(")"))).otherwise(said) if with_id else said


def entities(text: Column) -> Column:
    """STR-27: map from kind to the strings found in the text."""
    return F.create_map(*[x for kind, (p, _) in ENTITIES.items() for x in (F.lit(kind), F.regexp_extract_all(text, F.lit(p), F.lit(0)))])


def entity_confidence(found: Column) -> Column:
    """STR-28: weights by kind, more for repeats up to twice, at most 1."""
    n = lambda k: F.size(F.element_at(found, F.lit(k)))
    parts = [F.when(n(k) > 0, F.lit(w) * F.least(F.lit(1.0) + (n(k) - 1) * F.lit(0.1), F.lit(2.0))).otherwise(0.0) for k, (_, w) in ENTITIES.items()]
    return F.least(reduce(lambda a, b: a + b, parts), F.lit(1.0))


def payload_field(x: Column, i: int, default: str = "Unknown", sep: str = ",") -> Column:
    """STR-29: one field of a delimited payload."""
    return F.coalesce(none_if_empty(F.trim(F.get(F.split(x, sep), F.lit(i)))), F.lit(default))


def typed_identities(names: list[Column], paths: list[Column]) -> Column:
    """STR-31: distinct (type, value) pairs of every name, every path and each path's file name."""
    pair = lambda t, v: F.struct(F.lit(t).alias("type"), v.alias("value"))
    every = F.array(*[pair("name", normal_name(c)) for c in names], *[pair("path", normal_path(c)) for c in paths], *[pair("name", file_name(normal_path(c))) for c in paths])
    return F.array_distinct(F.filter(every, lambda p: p["value"].isNotNull()))


def json_equals(doc: Column, path: str, value: str) -> Column:
    """JSON-01"""
    return F.coalesce(F.get_json_object(doc, path) == F.lit(value), F.lit(False))


def without_metadata(payload: Column, mark: str = "_metadata") -> Column:
    """JSON-02: map of source -> array of record maps, records that carry the mark removed, emptied sources too."""
    kept = F.transform_values(payload, lambda k, records: F.filter(records, lambda r: ~F.coalesce(F.map_contains_key(r, mark), F.lit(False))))
    return F.map_filter(kept, lambda k, v: F.size(v) > 0)


def register(spark) -> None:
    """UD-01, UD-02 as SQL functions."""
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION regexp_ci(pattern STRING, value STRING) RETURNS BOOLEAN RETURN coalesce(value RLIKE concat('(?i)', pattern), false)")
    spark.sql(r"""CREATE OR REPLACE TEMPORARY FUNCTION parsable_num(v STRING) RETURNS DOUBLE RETURN
        CASE WHEN v IS NULL OR trim(v) = '' OR lower(trim(v)) = 'unknown' THEN 0.0D
        ELSE coalesce(try_cast(replace(trim(v), ',', '') AS DOUBLE),
          try_cast(regexp_extract(v, '(?i)(\\d+\\.?\\d*)\\s*(B|KB|MB|GB|TB)', 1) AS DOUBLE) * CASE upper(regexp_extract(v, '(?i)(\\d+\\.?\\d*)\\s*(B|KB|MB|GB|TB)', 2))
            WHEN 'B' THEN 1.0D WHEN 'KB' THEN 1024.0D WHEN 'MB' THEN 1048576.0D WHEN 'GB' THEN 1073741824.0D ELSE 1099511627776.0D END,
          aggregate(zip_with(regexp_extract_all(v, '(?i)(\\d+\\.?\\d*)\\s*(ms|h|m|s|hrs|min|sec)', 1), regexp_extract_all(v, '(?i)(\\d+\\.?\\d*)\\s*(ms|h|m|s|hrs|min|sec)', 2),
            (n, u) -> cast(n AS DOUBLE) * CASE lower(u) WHEN 'h' THEN 3600.0D WHEN 'hrs' THEN 3600.0D WHEN 'm' THEN 60.0D WHEN 'min' THEN 60.0D WHEN 's' THEN 1.0D WHEN 'sec' THEN 1.0D ELSE 0.001D END), 0.0D, (a, x) -> a + x)) END""")
