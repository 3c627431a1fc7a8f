"""Secret scan by multipart credential linking.

Three sure kinds are found by pattern alone: ``assign`` (a keyword, a sign of
assignment, a value), ``access`` (access key identifiers) and ``hex`` (long
lower-case hex runs). Everything else is *weak*: a short identifier, a mixed
string that may be a secret key, a host that may be an endpoint. A weak
candidate is reported only where complementary parts co-occur: an interval
join within a scope (one paragraph, blank line to blank line) links each part
with parts of the other roles at most ``reach`` code points away.

Roles: ``access`` spans and weak identifiers are identifiers; ``assign`` and
``hex`` spans and weak keys are secrets; URLs with a host are endpoints. A weak
identifier needs a secret, a weak key needs an identifier, an endpoint needs
both.

Defined results: null and empty texts give no spans; repeated rows each give
their own row; ties in start are ordered by kind as listed in ``KINDS``; a very
long text is scanned whole, in time that grows with its length and its parts.
Other columns of the input, null or not, are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "identifier", "key", "endpoint")
SPANS = "array<struct<kind:string,start:int,end:int>>"

# The three base patterns, with the least length of what they must hold.
ASSIGN = re.compile(
    r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    r"[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # shorter runs would be dropped anyway
LEAST_ASSIGN, LEAST_ACCESS = 6, 20

# Weak parts of a credential.
IDENTIFIER = re.compile(r"(?<![A-Za-z0-9])(?:ASIA|AROA|AIDA|GOOG|LTAI|AKID)[A-Z0-9]{8,}(?![A-Za-z0-9])")
#: A name that is assigned an identifier; with a group for what it is assigned.
NAMED = re.compile(r"(?<![A-Za-z])(?:[Cc]lient[_-]?[Ii][Dd]|CLIENT_?ID|[Uu]ser(?:_?[Nn]ame)?|USER(?:_?NAME)?|[Ll]ogin|LOGIN|[Aa]ccount(?:_?[Ii][Dd])?|ACCOUNT(?:_?ID)?)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9._@-]{3,})")
KEY = re.compile(r"(?<![A-Za-z0-9+/=_-])[A-Za-z0-9+/_-]{32,}={0,2}(?![A-Za-z0-9+/=_-])")
ENDPOINT = re.compile(r"https?://[A-Za-z0-9.-]+(?::\d+)?|(?<![A-Za-z0-9.-])[a-z0-9-]+(?:\.[a-z0-9-]+)+:\d{2,5}(?!\d)")
PARAGRAPH = re.compile(r"\n[\x20\t]*\n")

KEYWORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")
#: The least of what NAMED finds, in any case.
NAMES = "(?i)(?:client[_-]?id|user|name|login|account|account_?id)[\"']?\\x20*[:=]"
PREFIXES = ("AKIA", "ASIA", "AROA", "AIDA", "GOOG", "LTAI", "AKID")


def possible(text: Column) -> Column:
    """What a text must hold for any span to be in it (weak parts link to an identifier at last): others never leave the JVM."""
    low = F.lower(text)
    found = text.rlike("[0-9a-f]{24}")
    for word in KEYWORDS:
        found = found | low.contains(word)
    for prefix in PREFIXES:
        found = found | text.contains(prefix)
    return found | text.rlike(NAMES)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Leftmost non-overlapping matches of each base pattern, without those that are too short."""
    found = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGN]
    found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    return found + [("hex", m.start(), m.end()) for m in HEX.finditer(text)]


def weak_parts(text: str) -> list[tuple[str, int, int]]:
    def mixed(s: str) -> bool:
        return bool(re.search("[a-z]", s) and re.search("[A-Z]", s) and re.search("[0-9]", s))

    found = [("identifier", m.start(), m.end()) for m in IDENTIFIER.finditer(text)]
    found += [("identifier", m.start(), m.end()) for m in NAMED.finditer(text)]
    found += [("key", m.start(), m.end()) for m in KEY.finditer(text) if mixed(m[0])]
    return found + [("endpoint", m.start(), m.end()) for m in ENDPOINT.finditer(text)]


ROLES = {"access": "id", "identifier": "id", "assign": "secret", "hex": "secret", "key": "secret", "endpoint": "endpoint"}
NEEDS = {"identifier": ("secret",), "key": ("id",), "endpoint": ("id", "secret")}


class Sweep:
    """The spans of one role by start and by end: the nearest on either side is found without looking at others."""

    def __init__(self, spans: list[tuple[int, int]]):
        self.starts = sorted(s for s, _ in spans)
        self.ends = sorted(e for _, e in spans)

    def near(self, start: int, end: int, reach: int, low: int, high: int) -> bool:
        """Whether a span between low and high lies apart from this one, at most ``reach`` away."""
        after = bisect_left(self.starts, end)
        before = bisect_right(self.ends, start) - 1
        return (after < len(self.starts) and self.starts[after] <= min(end + reach, high - 1)) or (before >= 0 and self.ends[before] >= max(start - reach, low))


def linked(text: str, base: list[tuple[str, int, int]], weak: list[tuple[str, int, int]], reach: int) -> list[tuple[str, int, int]]:
    """The weak parts with complementary parts in reach and in their paragraph: sorted sweeps, no pairs are made.

    No span holds a line end, so that each lies in one paragraph.
    """
    breaks = [0, *(m.end() for m in PARAGRAPH.finditer(text)), len(text)]
    sure = Cover([(s, e) for _, s, e in base])
    free = [w for w in weak if w[0] == "endpoint" or not sure.meets(w[1], w[2])]
    by_role = {r: Sweep([(s, e) for kind, s, e in base + weak if ROLES[kind] == r]) for r in set(ROLES.values())}
    found = []
    for kind, start, end in free:
        at = bisect_right(breaks, start)
        low, high = breaks[at - 1], breaks[at] if at < len(breaks) else len(text)
        if all(by_role[r].near(start, end, reach, low, high) for r in NEEDS[kind]):
            found.append((kind, start, end))
    return found


class Cover:
    """What a set of spans covers, as disjoint stretches."""

    def __init__(self, spans: list[tuple[int, int]]):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for s, e in sorted(spans):
            if self.ends and s < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], e)
            else:
                self.starts.append(s)
                self.ends.append(e)

    def meets(self, start: int, end: int) -> bool:
        at = bisect_left(self.starts, end) - 1
        return at >= 0 and self.ends[at] > start


def find_spans(texts: pa.Array, reach: int) -> pa.Array:
    rows = []
    for text in texts.to_pylist():
        if not text:
            rows.append([])
            continue
        base = base_spans(text)
        weak = weak_parts(text)
        spans = base + (linked(text, base, weak, reach) if weak else [])
        spans.sort(key=lambda s: (s[1], KINDS.index(s[0])))
        rows.append([{"kind": k, "start": s, "end": e} for k, s, e in spans])
    kind = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
    return pa.array(rows, pa.list_(kind))


def secret_spans(text: Column, reach: int = 400) -> Column:
    """All spans of a text, by start and kind, as an array of (kind, start, end); code points, end exclusive."""

    @F.arrow_udf(SPANS)
    def scan(texts: pa.Array) -> pa.Array:
        return find_spans(texts, reach)

    return scan(F.when(possible(text), text))


def scan_secrets(docs: DataFrame, reach: int = 400, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, found): one row for each input row. No shuffle: scopes never cross documents."""
    return docs.select(F.col(id_column).alias("doc_id"), secret_spans(F.col(text_column), reach).alias("found"))


def redact(docs: DataFrame, mask: str = "[SECRET]", reach: int = 400) -> DataFrame:
    """The input with ``text`` masked where a span was found; overlapping spans are masked as one."""

    @F.arrow_udf("string")
    def hide(texts: pa.Array) -> pa.Array:
        out = []
        for text, spans in zip(texts.to_pylist(), find_spans(texts, reach).to_pylist(), strict=True):
            at, parts = 0, []
            for s in spans:
                if s["start"] >= at:
                    parts += [text[at : s["start"]], mask]
                at = max(at, s["end"])
            out.append(text if not spans else "".join(parts) + text[at:])
        return pa.array(out, pa.string())

    return docs.withColumn("text", F.when(possible(F.col("text")), hide("text")).otherwise(F.col("text")))


def span_text(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op4_secret_scan(docs: DataFrame) -> DataFrame:
    """The digest columns: counts of each base kind, the sum of the base spans, all spans."""
    found = F.col("found")
    count = lambda kind: F.size(F.filter(found, lambda s: s["kind"] == kind)).cast("long")
    base = F.filter(found, lambda s: s["kind"].isin("assign", "access", "hex"))
    return scan_secrets(docs).select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(span_text(base), 256).alias("base_sha256"),
        span_text(found).alias("spans"),
        F.size(F.filter(found, lambda s: ~s["kind"].isin("assign", "access", "hex"))).cast("long").alias("n_linked"),
    )
