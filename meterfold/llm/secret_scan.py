"""Secrets in texts: certain patterns, and weak parts of credentials that stand together.

A credential has several parts: an identifier (who), a secret (the proof) and often an
endpoint (where). Assignments, access keys and long hex strings are reported wherever they
stand. Weak parts (a user name, a random-looking string, an address) are everyday text on
their own; they are reported only if a secret and an identifier, or a secret and an endpoint,
lie within ``reach`` code points of each other in the same paragraph. The parts are joined as
sorted intervals, so a text with many parts costs no pairs.

A scope never leaves its document, so there is no shuffle. Null texts count as empty; the
result has a row per input row, in which ``spans`` may be empty; an empty table gives an
empty one.
"""

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from math import log2

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterfold.llm.common import small_batches

# The certain patterns, in the order in which spans of equal start are listed.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
BASE = ["assign", "access", "hex"]
# The weak parts.
USER = re.compile(r"""\b(?:user(?:name)?|login|account|client_?id|access_?key(?:_?id)?)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.@=-]{3,}""", re.I | re.A)
ENDPOINT = re.compile(r"[A-Za-z][A-Za-z0-9+.-]{1,15}://[^\s\"'<>]+|(?<![\w.])(?:\d{1,3}\.){3}\d{1,3}(?::\d{1,5})?(?![\w.])", re.A)
RANDOM = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}", re.A)
WEAK = ["weak_id", "weak_secret", "endpoint"]
KINDS = BASE + WEAK
SCHEMA = "doc_id long, spans array<struct<kind:string,start:long,end:long>>"

Span = tuple[int, int, int]  # start, end, kind


def certain(text: str) -> list[Span]:
    found: list[Span] = []
    low = text.lower()
    if any(word in low for word in ("password", "passwd", "secret", "token", "api")):
        found += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    found += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    return found


def looks_random(s: str) -> bool:
    """Letters and digits mixed, and characters spread as in a random string."""
    if not (re.search("[0-9]", s) and re.search("[A-Za-z]", s)):
        return False
    return -sum(n / len(s) * log2(n / len(s)) for n in map(s.count, set(s))) >= 3.3


class Near:
    """Whether a part of a kind lies within reach; parts sorted by start, ends kept as running maxima."""

    def __init__(self, parts: list[Span]):
        parts = sorted(parts)
        self.starts = [p[0] for p in parts]
        self.ends, most = [], -1
        for p in parts:
            most = max(most, p[1])
            self.ends.append(most)

    def within(self, low: int, high: int) -> bool:
        """A part that overlaps [low, high)."""
        k = bisect_left(self.starts, high)
        return k > 0 and self.ends[k - 1] > low


def linked(text: str, base: list[Span], reach: int) -> list[Span]:
    """Weak parts whose complement is near, and which no certain span covers."""
    users = [(m.start(), m.end(), 3) for m in USER.finditer(text)] if "=" in text or ":" in text else []
    places = [(m.start(), m.end(), 5) for m in ENDPOINT.finditer(text)]
    names = users + [s for s in base if s[2] == 1]
    if not names and not places:
        return []
    weak = [(m.start(), m.end(), 4) for m in RANDOM.finditer(text) if looks_random(m[0])]
    covered = Near(base)
    weak = [s for s in weak if not covered.within(s[0], s[1])]
    secrets = weak + [s for s in base if s[2] != 1]
    if not secrets:
        return []
    breaks = [m.start() for m in re.finditer(r"\n[ \t]*\n", text)]
    near = {"name": Near(names), "place": Near(places), "secret": Near(secrets)}

    def scope(s: Span) -> tuple[int, int]:
        k = bisect_right(breaks, s[0])
        low = breaks[k - 1] if k else 0
        high = breaks[k] if k < len(breaks) else len(text)
        return max(low, s[0] - reach), min(high, s[1] + reach)

    out = [s for s in weak if near["name"].within(*scope(s)) or near["place"].within(*scope(s))]
    out += [s for s in users + places if near["secret"].within(*scope(s)) and not covered.within(s[0], s[1])]
    return out


def spans_of(text: str, reach: int) -> list[Span]:
    base = certain(text)
    return sorted(base + linked(text, base, reach), key=lambda s: (s[0], s[2], s[1]))


def scan(docs: DataFrame, reach: int = 200) -> DataFrame:
    """doc_id and its spans (kind, start, end in code points), by start, then in the order of KINDS."""
    small_batches(docs.sparkSession)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [[{"kind": KINDS[k], "start": a, "end": b} for a, b, k in spans_of(t.as_py() or "", reach)] for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, kind)], names=["doc_id", "spans"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(find, SCHEMA)


def listed(spans):
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def summary(scanned: DataFrame) -> DataFrame:
    """Counts of the certain kinds, a digest of their spans, and all spans as text."""
    spans = F.col("spans")
    base = F.filter(spans, lambda s: s["kind"].isin(BASE))

    def count(kind: str):
        return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")

    return scanned.select(
        "doc_id", *(count(k).alias(f"n_{k}") for k in BASE),
        F.sha2(listed(base), 256).alias("base_sha256"), listed(spans).alias("spans"),
    )
