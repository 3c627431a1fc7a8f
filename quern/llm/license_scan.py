"""License scan: winnowed template fingerprints pick candidates, banded alignment measures them.

Templates are cut into token k-grams; of every ``window`` consecutive k-gram
hashes the least is a fingerprint (winnowing), and an inverted index maps each
to its places in the templates. A document looks up all its k-grams, so a match
of ``k + window - 1`` tokens can't be missed. Hits of one template on nearby
diagonals form a candidate, which is aligned to the whole template within a band
around its middle diagonal, and again around the diagonal of every hit that no
match of the candidate covers yet, however many notices follow each other
closely. Candidates of one template whose own alignment covers too little are
chained where their diagonals differ by at most ``spread`` and aligned as one, in
a band that holds them all: a text with up to so many tokens put in or left out
in one place is still one match. What is reported is the share of the template's
tokens that match and the span they cover (code points, end exclusive).

The index holds templates, not documents, and travels with the function; a
document is scanned where it lies, so nothing is shuffled.

Defined results: null and empty texts match nothing; a template of fewer than k
tokens is one k-gram; where spans of candidates overlap, the one that covers
more tokens stays (ties: the higher coverage, the first start, the name);
repeated rows each give their own rows; a very long text is scanned whole, in one
task; a notice counts wherever its words stand, within a sentence too; other
columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Mapping

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.license_templates import TEMPLATES

MATCHES = "array<struct<license:string,coverage:double,start:int,end:int>>"
MATCH = pa.struct([("license", pa.string()), ("coverage", pa.float64()), ("start", pa.int32()), ("end", pa.int32())])
TOKEN = re.compile(r"[A-Za-z0-9]+")
BYTES_TOKEN = re.compile(rb"[a-z0-9]+")


def tokens(text: str) -> list[bytes]:
    return BYTES_TOKEN.findall(text.encode().lower())


def grams(words: list[bytes], k: int) -> list[tuple[bytes, ...]]:
    return [tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))] if words else []


def winnow(hashes: list[int], window: int) -> set[int]:
    """Places of the least hash of every window, the rightmost of equals."""
    last = max(0, len(hashes) - window)
    return {min(range(i, min(i + window, len(hashes))), key=lambda j: (hashes[j], -j)) for i in range(last + 1)} if hashes else set()


class TemplateIndex:
    """Inverted index of winnowed fingerprints: k-gram -> [(template, place)]."""

    def __init__(self, templates: Mapping[str, str], k: int = 3, window: int = 3):
        self.k = k
        self.words = {name: tokens(text) for name, text in templates.items()}
        self.places: dict[tuple[bytes, ...], list[tuple[str, int]]] = {}
        for name, words in self.words.items():
            all_grams = grams(words, k)
            for i in winnow([zlib.crc32(b" ".join(g)) for g in all_grams], window):
                self.places.setdefault(all_grams[i], []).append((name, i))
        self.sizes = sorted({len(g) for g in self.places})  # k, and fewer where a template is shorter

    def candidates(self, words: list[bytes], band: int) -> list[tuple[str, list[tuple[int, int]]]]:
        """(template, hits) of each cluster of hits: (diagonal, document token), in order."""
        found: dict[str, list[tuple[int, int]]] = {}
        places = self.places
        for k in self.sizes:
            for i, gram in enumerate(zip(*(words[j:] for j in range(k)), strict=False)):
                if gram in places:
                    for name, at in places[gram]:
                        found.setdefault(name, []).append((i - at, i))
        out = []
        for name, hits in found.items():
            hits.sort()
            start = 0
            for i in range(1, len(hits) + 1):
                if i == len(hits) or hits[i][0] - hits[i - 1][0] > band:
                    out.append((name, hits[start:i]))
                    start = i
        return out


def aligned(template: list[bytes], words: list[bytes | None], diagonal: int, band: int) -> tuple[int, int, int] | None:
    """(matched tokens, first and last matched document token) of the best alignment within the band.

    The whole template against any stretch of the document: gaps cost one,
    document tokens before and after it are free. Two rows are kept at a time.
    """
    width = 2 * band + 1
    none = (-10**9, 0, -1, -1)  # score, matches, first, last
    before = [(0, 0, -1, -1) if 0 <= diagonal - band + b <= len(words) else none for b in range(width)]
    for i, token in enumerate(template):
        now = [none] * width
        for b in range(width):
            j = diagonal + i - band + b  # cell: template[:i+1] against document up to token j
            best = none
            if 0 <= j < len(words):
                s, m, first, last = before[b]
                if words[j] == token:
                    best = (s + 2, m + 1, j if first < 0 else first, j)
                else:
                    best = (s - 1, m, first, last)
            if b + 1 < width and before[b + 1][0] - 1 > best[0]:
                s, m, first, last = before[b + 1]
                best = (s - 1, m, first, last)
            if b and now[b - 1][0] - 1 > best[0]:
                s, m, first, last = now[b - 1]
                best = (s - 1, m, first, last)
            now[b] = best
        before = now
    score, matched, first, last = max(before, key=lambda c: (c[0], c[1], -c[2]))
    return (matched, first, last) if matched and score > -10**8 else None


def chains(clusters: list[list[tuple[int, int]]], spread: int) -> list[list[tuple[int, int]]]:
    """Hits of clusters of one template, by diagonal, joined from each cluster on as far as the spread goes; single ones left out."""
    out, reached = [], -1
    for i, first in enumerate(clusters):
        last = i
        while last + 1 < len(clusters) and clusters[last + 1][-1][0] - first[0][0] <= spread:
            last += 1
        if last > i and last > reached:  # not part of the chain before
            out.append([h for c in clusters[i : last + 1] for h in c])
            reached = last
    return out


def scan_text(text: str | None, index: TemplateIndex, coverage: float, band: int, spread: int = 64) -> list[dict]:
    if not text:
        return []
    words = tokens(text)
    candidates = index.candidates(words, band)
    if not candidates:
        return []
    spans = [m.span() for m in TOKEN.finditer(text)]
    found = []
    missed: dict[str, list[list[tuple[int, int]]]] = {}
    for name, hits in candidates:
        template, left, tried = index.words[name], words, set()
        for diagonal, at in [hits[(len(hits) - 1) // 2], *hits]:
            if left[at] is None or diagonal in tried:
                continue
            tried.add(diagonal)
            # Another match at one diagonal may lie anywhere in its band: until there is none, covered tokens match nothing.
            while (got := aligned(template, left, diagonal, band)) and got[0] / len(template) >= coverage:
                found.append((got[0], got[0] / len(template), got[1], got[2], name))
                left = list(words) if left is words else left
                left[got[1] : got[2] + 1] = [None] * (got[2] + 1 - got[1])
        if left is words:
            missed.setdefault(name, []).append(hits)
    for name, clusters in missed.items():
        for hits in chains(clusters, spread):
            low, high = hits[0][0], hits[-1][0]
            got = aligned(index.words[name], words, (low + high) // 2, (high - low + 1) // 2 + band)
            if got and got[0] / len(index.words[name]) >= coverage:
                found.append((got[0], got[0] / len(index.words[name]), got[1], got[2], name))
    kept: list[tuple[int, float, int, int, str]] = []
    taken: set[int] = set()
    for f in sorted(found, key=lambda f: (-f[0], -f[1], f[2], f[4])):
        if not any(t in taken for t in range(f[2], f[3] + 1)):
            kept.append(f)
            taken.update(range(f[2], f[3] + 1))
    kept.sort(key=lambda f: f[2])
    return [{"license": name, "coverage": round(share, 4), "start": spans[first][0], "end": spans[last][1]} for _, share, first, last, name in kept]


def license_matches(text: Column | str, templates: Mapping[str, str] = TEMPLATES, coverage: float = 0.8, band: int = 6) -> Column:
    """The licenses found in a text, in order, with coverage and span."""

    @F.arrow_udf(MATCHES)
    def scan(texts: pa.Array) -> pa.Array:
        index = TemplateIndex(templates)
        return pa.array([scan_text(t, index, coverage, band) for t in texts.to_pylist()], pa.list_(MATCH))

    return scan(text)


def scan_licenses(docs: DataFrame, templates: Mapping[str, str] = TEMPLATES, coverage: float = 0.8, band: int = 6) -> DataFrame:
    """(doc_id, license, coverage, start, end): one row for each match."""
    found = docs.select("doc_id", F.explode(license_matches("text", templates, coverage, band)).alias("m"))
    return found.select("doc_id", "m.*")


def op3_license_scan(docs: DataFrame) -> DataFrame:
    return scan_licenses(docs)
