"""Secret scans by multipart credential linking.

Strong parts (assigned secrets, access keys, hex runs) are reported wherever they stand. Weak parts - account names,
unlabelled random tokens, endpoints - are reported only where complementary parts co-occur: each access identifier
opens a scope of `scope` code points to either side, and an interval join pairs it with the secrets that start in it;
endpoints are added to such a pair. A block of settings (two or more adjoining lines of names with values, comments or
brackets) is a scope too, whatever its length: there each identifier or secret that has no partner yet gets the nearest
one of the block, so a block yields at most a link a part. The interval join is a binary search over the sorted starts
of one text's parts, so its cost follows the parts found, not their pairs. Scans are per row and need no shuffle.

Null text counts as empty and gives no spans. Offsets are code points, end exclusive. Repeated rows are scanned alike.
Very long texts are scanned whole; of two partners equally far in a block the one before is taken.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evspark.llm.shared import as_texts, each_batch, small_batches

# The base patterns and their least lengths.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex", "ident", "weak", "endpoint")
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

IDENT_WORDS = ("user", "login", "account", "client_id", "access_key")
IDENT = re.compile(r"""\b(?:user(?:name)?|login|account|client_id|access_key(?:_id)?)["']?\x20*[:=]\x20*["']?([A-Za-z0-9_.@-]{3,})""", re.I | re.A)
WEAK = re.compile(r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9])[A-Za-z0-9+/_=-]{20,}(?![A-Za-z0-9+/_=-])")
ENDPOINT = re.compile(r"""https?://[A-Za-z0-9.-]+(?::\d+)?|\b(?:host|endpoint|server)["']?\x20*[:=]\x20*["']?[A-Za-z0-9.-]+(?::\d+)?""", re.I | re.A)

SETTING = re.compile(r"""[\x20\t]*(?:(?:export[\x20\t]+)?["']?[A-Za-z_][A-Za-z0-9_.-]*["']?[\x20\t]*[:=]|[#;]|//|[\[\](){}<>,]+[\x20\t]*\r?$)""")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) of the strong parts: leftmost, non-overlapping per kind; matches that are too short drop out."""
    found = []
    lower = text.lower()
    if any(w in lower for w in ASSIGN_WORDS):
        found += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        found += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    found += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]  # runs are maximal, so shorter runs never hide longer ones
    return sorted((s, e, k) for s, e, k in found) if len(found) > 1 else found


def _mixed(token: str) -> bool:
    return any(c.isupper() for c in token) and any(c.islower() for c in token) and len(set(token)) >= 10


def blocks(text: str) -> list[tuple[int, int]]:
    """(start, end) of each run of at least two lines of settings."""
    out, at, first, lines = [], 0, 0, 0
    for line in [*text.split("\n"), ""]:
        if SETTING.match(line):
            first = first if lines else at
            lines += 1
        else:
            if lines > 1:
                out.append((first, at))
            lines = 0
        at += len(line) + 1
    return out


def nearest(part: tuple[int, int, int], others: list[tuple[int, int, int]], at: list[int]) -> tuple[int, int, int] | None:
    """Of others, sorted and with starts `at`, the one with the least gap to part that doesn't overlap it."""
    p = bisect_left(at, part[0])
    before = next((others[n] for n in range(p - 1, -1, -1) if others[n][1] <= part[0]), None)
    after = next((others[n] for n in range(p, len(others)) if others[n][0] >= part[1]), None)
    if before is None or after is None:
        return before or after
    return before if part[0] - before[1] <= after[0] - part[1] else after


def block_links(text: str, idents: list, secrets: list, ends: list, linked: set) -> list[tuple]:
    """Links of the parts that have none yet with the nearest complementary part of their block of settings."""
    parts = [(x, [s for s, _, _ in x]) for x in (idents, secrets, ends)]
    out = set()
    for lo, hi in blocks(text):
        (own, own_at), (keys, keys_at), (hosts, hosts_at) = ((x[(a := bisect_left(at, lo)) : (b := bisect_left(at, hi))], at[a:b]) for x, at in parts)
        pairs = [(i, nearest(i, keys, keys_at)) for i in own if i not in linked] + [(nearest(x, own, own_at), x) for x in keys if x not in linked]
        out |= {(i, x, nearest(i, hosts, hosts_at)) for i, x in pairs if i and x}
    return sorted(out, key=lambda link: link[:2])


def linked_spans(text: str, base: list[tuple[int, int, int]], scope: int) -> tuple[list[tuple[int, int, int]], list[tuple]]:
    """The weak spans that links confirm, and the links (identifier, secret, endpoint or None)."""
    idents = [x for x in base if x[2] == 1]
    lower = text.lower()
    if any(w in lower for w in IDENT_WORDS):
        idents += [(m.start(), m.end(), 3) for m in IDENT.finditer(text)]
    if not idents:
        return [], []
    # whole texts are searched, so that each part has its own start and end; the scopes only choose among them
    starts, reach = [x[0] for x in base], list(accumulate((x[1] for x in base), max))
    free = lambda m: not (n := bisect_left(starts, m.end())) or reach[n - 1] <= m.start()
    secrets = sorted({x for x in base if x[2] != 1} | {(m.start(), m.end(), 4) for m in WEAK.finditer(text) if _mixed(m[0]) and free(m)})
    ends = [(m.start(), m.end(), 5) for m in ENDPOINT.finditer(text)]
    s_at, e_at = [x[0] for x in secrets], [x[0] for x in ends]
    links = []
    idents = sorted(set(idents))
    for i in idents:
        near = secrets[bisect_left(s_at, i[0] - scope) : bisect_right(s_at, i[1] + scope)]
        near = [x for x in near if x[0] >= i[1] or x[1] <= i[0]]
        hosts = ends[bisect_left(e_at, i[0] - scope) : bisect_right(e_at, i[1] + scope)] if near else []
        host = min(hosts, key=lambda x: (abs(x[0] - i[0]), x)) if hosts else None
        links += [(i, x, host) for x in near]
    if secrets and "\n" in text:
        links += block_links(text, idents, secrets, sorted(ends), {x for link in links for x in link[:2]})
    weak = {x for link in links for x in link if x is not None and x[2] >= 3}
    return sorted(weak), links


def _said(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, e, k in sorted(spans, key=lambda x: (x[0], x[2], x[1])))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = 200) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_spans, spans (kind:start:end, comma-joined), links (array of strings)."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        out: list[list] = [[], [], [], [], [], []]
        for text in as_texts(b.column(1)):
            base = base_spans(text) if text else []
            weak, links = linked_spans(text, base, scope) if text else ([], [])
            kinds = [k for _, _, k in base]
            row = [kinds.count(0), kinds.count(1), kinds.count(2), _said(base), _said(base + weak), [" + ".join(_said([x]) for x in link if x) for link in links]]
            for to, x in zip(out, row, strict=True):
                to.append(x)
        kinds = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.list_(pa.string())]
        return pa.RecordBatch.from_arrays([b.column(0), *[pa.array(x, t) for x, t in zip(out, kinds, strict=True)]], ["doc_id", "n_assign", "n_access", "n_hex", "base_spans", "spans", "links"])

    rows = small_batches(docs).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(each_batch(run), f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_spans string, spans string, links array<string>")

