"""Cross-tokenizer alignment: which tokens of one vocabulary cover the same bytes as which of another.

Two tokenizers encode a text; where tokens of both end at one byte, the text is cut
into groups, and within a group each token of one is linked to each of the other.
Corpus-wide, a pair counts once for every document that holds it linked.

A pair is one integer, the first id in the upper and the second in the lower 32
bits. Per document pairs are made unique with how often they are linked; a group
of many tokens is multiplied out by distinct ids, never by occurrence. Tasks add up
the documents of each pair with ``np.unique`` before anything is shuffled. These
partial counts are sorted globally by range of the pair, runs of equal pairs are
summed, and every range becomes a shard: sorted pairs and their counts as flat
files in the shared folder. Documents look their pairs up by ``searchsorted`` in
the memory-mapped shards, one shard at a time, so that no list of pairs is shuffled
or held whole. What the driver takes is a row for each shard and the best count of
each first id: as many as the vocabulary has at most.

The first tokenizer is the byte-level BPE of ``byte_bpe`` on a vocabulary in JSON,
the second a sentencepiece model. Both files go to the workers as a broadcast of
their own size. A folder that isn't mounted is read and written through
``pyarrow.fs``, a shard at a time in memory.

Defined results: texts that are null or empty, or that either tokenizer doesn't give
back byte for byte, have no tokens: counts of 0, an empty digest; repeated rows are
documents of their own; strings of special tokens are plain text; very long texts
are encoded whole; without documents there are no shards; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyarrow import fs
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.byte_bpe import Encoder, read_json
from quern.llm.common import discard, stored, work_folder

FIRST, SECOND = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Links that are laid out at once, and pairs a task holds before it passes them on.
LAID_OUT = 1 << 20
#: Groups with more links than this are multiplied out by distinct ids.
LARGE_GROUP = 1 << 10
#: Shards that a task keeps open.
OPEN = 32
ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, times binary"


class Tokenizers:
    """Both tokenizers with the bytes of each id."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, model: bytes):
        self.first = Encoder(ranks, pattern)
        self.second = sentencepiece.SentencePieceProcessor(model_proto=model)
        pieces = [self.second.id_to_piece(i) for i in range(self.second.get_piece_size())]
        bytes_a = [self.first.tokens.get(i, b"") for i in range(max(self.first.tokens) + 1)]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.second.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.size_a, self.size_b = (np.array([len(b) for b in table], np.int64) for table in (bytes_a, self.bytes_b))
        # Each id followed by what may stand behind it: the next of its group, the other side, the next group.
        self.shown_a = np.array([f"{i}{end}" for end in ",|" for i in range(len(bytes_a))], object)
        self.shown_b = np.array([f"{i}{end}" for end in ",;" for i in range(len(self.bytes_b))], object)

    def encode(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of space and text by both; none where either loses a byte."""
        none = np.empty(0, np.int64)
        if not text:
            return none, none
        a = np.frombuffer(self.first.encode(" " + text), "<u4").astype(np.int64)
        b = self.second.encode(text)
        wanted = (" " + text).encode()
        # The first keeps every byte by construction: its ids stand for the text's own slices.
        if b"".join(map(self.bytes_b.__getitem__, b)) != wanted:
            return none, none
        return a, np.array(b, np.int64)


@dataclass
class Groups:
    """Two token sequences cut where both end: ids, and where each group starts in either."""

    a: np.ndarray
    b: np.ndarray
    from_a: np.ndarray  # one more entry than there are groups
    from_b: np.ndarray

    @classmethod
    def of(cls, a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> Groups:
        end_a, end_b = np.cumsum(size_a[a]), np.cumsum(size_b[b])
        common = np.intersect1d(end_a, end_b, assume_unique=True)
        return cls(a, b, np.append(0, np.searchsorted(end_a, common, "right")), np.append(0, np.searchsorted(end_b, common, "right")))

    def __len__(self) -> int:
        return len(self.from_a) - 1

    def shown(self, shown_a: np.ndarray, shown_b: np.ndarray) -> str:
        """``a1,a2|b1;a3|b2,b3``: groups in order, the ids of either side in order."""
        if not len(self):
            return ""
        many_a, many_b = np.diff(self.from_a), np.diff(self.from_b)
        last_a, last_b = np.zeros(len(self.a), np.int64), np.zeros(len(self.b), np.int64)
        last_a[self.from_a[1:] - 1] = last_b[self.from_b[1:] - 1] = 1
        out = np.empty(len(self.a) + len(self.b), object)
        out[np.arange(len(self.a)) + np.repeat(self.from_b[:-1], many_a)] = shown_a[self.a + last_a * (len(shown_a) // 2)]
        out[np.arange(len(self.b)) + np.repeat(self.from_a[1:], many_b)] = shown_b[self.b + last_b * (len(shown_b) // 2)]
        return "".join(out.tolist())[:-1]

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """(pairs, times): the distinct linked pairs in order, and how often each is linked."""
        many_a, many_b = np.diff(self.from_a), np.diff(self.from_b)
        large = many_a * many_b > LARGE_GROUP
        found = Counted()
        group = np.repeat(np.arange(len(self)), many_a)
        at = np.flatnonzero(~large[group])  # the places of first ids
        laid = np.cumsum(many_b[group[at]])
        start = 0
        while start < len(at):
            stop = max(start + 1, int(np.searchsorted(laid, (laid[start - 1] if start else 0) + LAID_OUT, "right")))
            part = at[start:stop]
            times = many_b[group[part]]
            within = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            found.add((np.repeat(self.a[part], times) << 32) | self.b[np.repeat(self.from_b[group[part]], times) + within])
            start = stop
        for g in np.flatnonzero(large):
            ids_a, times_a = np.unique(self.a[self.from_a[g] : self.from_a[g + 1]], return_counts=True)
            ids_b, times_b = np.unique(self.b[self.from_b[g] : self.from_b[g + 1]], return_counts=True)
            rows = max(1, LAID_OUT // len(ids_b))
            for i in range(0, len(ids_a), rows):
                found.add(((ids_a[i : i + rows, None] << 32) | ids_b).ravel(), np.outer(times_a[i : i + rows], times_b).ravel())
        return found.result()


class Counted:
    """Sums by key, in sorted order; what was added is summed up whenever it has doubled."""

    def __init__(self):
        self.keys: list[np.ndarray] = []
        self.times: list[np.ndarray] = []
        self.held, self.due = 0, LAID_OUT

    def add(self, keys: np.ndarray, times: np.ndarray | None = None) -> None:
        self.keys.append(keys)
        self.times.append(np.ones(len(keys), np.int64) if times is None else times)
        self.held += len(keys)
        if self.held > self.due:
            self.result()
            self.due = max(LAID_OUT, 2 * self.held)

    def result(self) -> tuple[np.ndarray, np.ndarray]:
        keys, times = (np.concatenate([np.empty(0, np.int64), *x]) for x in (self.keys, self.times))
        distinct, which = np.unique(keys, return_inverse=True)
        total = np.zeros(len(distinct), np.int64)
        np.add.at(total, which, times)
        self.keys, self.times, self.held = [distinct], [total], len(distinct)
        return distinct, total


@lru_cache(maxsize=2)
def tokenizers(files: Broadcast) -> Tokenizers:
    return Tokenizers(*files.value)


def files_of(spark: SparkSession, first: str | None = None, second: str | None = None, pattern: str | None = None) -> Broadcast:
    """Both vocabularies for all workers: as large as their files, whatever the data's size."""
    with open(second or public_tokenizers.path(SECOND), "rb") as f:
        model = f.read()
    return spark.sparkContext.broadcast((read_json(first or public_tokenizers.path(FIRST)), pattern or public_tokenizers.PATTERN, model))


def aligned(docs: DataFrame, files: Broadcast, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, groups_sha256, pairs, times), one row for each input row.

    pairs, times: the distinct linked pairs in order and how often each is linked, as packed 64-bit integers.
    """

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = tokenizers(files)
        for batch in batches:
            rows = []
            for text in batch[1].to_pylist():
                a, b = both.encode(text)
                groups = Groups.of(a, b, both.size_a, both.size_b)
                pairs, times = groups.links()
                digest = hashlib.sha256(groups.shown(both.shown_a, both.shown_b).encode()).hexdigest() if len(a) else ""
                rows.append((len(a), len(b), len(groups), int(times.sum()), digest, pairs.tobytes(), times.tobytes()))
            columns = zip(*rows) if rows else [[]] * 7
            types = [pa.int64()] * 4 + [pa.string(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([batch[0], *[pa.array(c, t) for c, t in zip(columns, types, strict=True)]], names=[c.split()[0] for c in ALIGNED.split(", ")])

    return docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text")).mapInArrow(align, ALIGNED)


def numbers(packed: bytes) -> np.ndarray:
    return np.frombuffer(packed, np.int64)


def partial_counts(pairs: DataFrame) -> DataFrame:
    """(pair, docs) as each task counts them; no pair is twice in what a task emits at once."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Counted()
        for batch in batches:
            for packed in batch[0].to_pylist():
                held.add(numbers(packed))
            if held.held > 4 * LAID_OUT:
                yield pa.RecordBatch.from_arrays(list(map(pa.array, held.result())), names=["pair", "docs"])
                held = Counted()
        yield pa.RecordBatch.from_arrays(list(map(pa.array, held.result())), names=["pair", "docs"])

    return pairs.select("pairs").mapInArrow(count, "pair long, docs long")


def place_of(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri) if ":/" in uri else (fs.LocalFileSystem(), uri)


def mapped(uri: str) -> np.ndarray:
    """A flat file of integers: memory-mapped where its folder is mounted, else read."""
    files, path = place_of(uri)
    if isinstance(files, fs.LocalFileSystem):
        return np.memmap(path, np.int64, "r")
    with files.open_input_stream(path) as f:
        return numbers(f.read())


def best_of(pairs: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first id, its highest count) of pairs in any order."""
    first, which = np.unique(pairs >> 32, return_inverse=True)
    best = np.zeros(len(first), np.int64)
    np.maximum.at(best, which, docs)
    return first, best


def write_shard(folder: str, batches: Iterable[tuple[np.ndarray, np.ndarray]]) -> dict | None:
    """Sums runs of equal pairs of a sorted stream into ``<name>.pairs`` and ``<name>.docs``; None without pairs.

    A repeated attempt writes files of its own, and only the row that Spark accepts names any.
    """
    name = f"{folder}/{uuid.uuid4().hex}"
    files, path = place_of(name)
    files.create_dir(place_of(folder)[1])
    low, total, held, best = None, 0, None, ([], [])

    def put(keys: np.ndarray, docs: np.ndarray) -> None:
        nonlocal low, total
        out_keys.write(keys.tobytes())
        out_docs.write(docs.tobytes())
        low = int(keys[0]) if low is None else low
        total += len(keys)
        for all_of, some in zip(best, best_of(keys, docs), strict=True):
            all_of.append(some)

    with files.open_output_stream(f"{path}.pairs") as out_keys, files.open_output_stream(f"{path}.docs") as out_docs:
        for keys, docs in batches:
            if held is not None:
                keys, docs = np.append(held[0], keys), np.append(held[1], docs)
            if not len(keys):
                continue
            starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
            keys, docs = keys[starts], np.add.reduceat(docs, starts)
            held = keys[-1:], docs[-1:]  # its run may go on
            if len(keys) > 1:
                put(keys[:-1], docs[:-1])
        if held is not None:
            put(*held)
    if held is None:
        return None
    first, at = np.unique(np.concatenate(best[0]), return_inverse=True)
    highest = np.zeros(len(first), np.int64)
    np.maximum.at(highest, at, np.concatenate(best[1]))
    return {"path": name, "low": low, "high": int(held[0][0]), "pairs": total, "first": first.tobytes(), "best": highest.tobytes()}


SHARD = pa.schema([("path", pa.string()), ("low", pa.int64()), ("high", pa.int64()), ("pairs", pa.int64()), ("first", pa.binary()), ("best", pa.binary())])


@dataclass
class PairCounts:
    """Sorted count shards: (path, low, high) of each in order, and the best count by first id."""

    shards: list[tuple[str, int, int]]
    best: np.ndarray

    def table(self, spark: SparkSession) -> DataFrame:
        """(a_id, b_id, docs): the counts as rows."""

        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for path in batch[0].to_pylist():
                    pairs, docs = mapped(f"{path}.pairs"), mapped(f"{path}.docs")
                    for i in range(0, len(pairs), LAID_OUT):
                        p = pairs[i : i + LAID_OUT]
                        yield pa.RecordBatch.from_arrays([pa.array(p >> 32), pa.array(p & 0xFFFFFFFF), pa.array(docs[i : i + LAID_OUT])], names=["a_id", "b_id", "docs"])

        paths = spark.createDataFrame([(s[0],) for s in self.shards], "path string").repartition(max(1, len(self.shards)))
        return paths.mapInArrow(read, "a_id long, b_id long, docs long")


def count_pairs(found: DataFrame) -> PairCounts:
    """Documents by pair over all rows of ``aligned``: partial counts, a global sort by range, one shard for each range."""
    spark = found.sparkSession
    folder = work_folder(spark, "pair-counts")
    partial = stored(partial_counts(found), "partial-counts")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = write_shard(folder, ((b[0].to_numpy(zero_copy_only=False), b[1].to_numpy(zero_copy_only=False)) for b in batches))
        yield pa.RecordBatch.from_pylist([shard] if shard else [], SHARD)

    ordered = partial.repartitionByRange("pair").sortWithinPartitions("pair")
    rows = ordered.mapInArrow(write, "path string, low long, high long, pairs long, first binary, best binary").collect()  # a row for each range, an entry for each first id
    discard(partial)
    rows.sort(key=lambda r: r["low"])
    best = np.zeros(1 + max((int(numbers(r["first"])[-1]) for r in rows), default=0), np.int64)
    for r in rows:
        np.maximum.at(best, numbers(r["first"]), numbers(r["best"]))
    return PairCounts([(r["path"], r["low"], r["high"]) for r in rows], best)


class Shards:
    """Looks counts up, shard by shard; keeps a bounded number of them open."""

    def __init__(self, shards: list[tuple[str, int, int]]):
        self.paths = [s[0] for s in shards]
        self.low, self.high = (np.array([s[i] for s in shards], np.int64) for i in (1, 2))
        self.open: Callable[[str], tuple[np.ndarray, np.ndarray]] = lru_cache(OPEN)(lambda path: (mapped(f"{path}.pairs"), mapped(f"{path}.docs")))

    def counts(self, pairs: np.ndarray) -> np.ndarray:
        """Counts of sorted pairs, all of which are in some shard."""
        out = np.zeros(len(pairs), np.int64)
        starts, stops = np.searchsorted(pairs, self.low, "left"), np.searchsorted(pairs, self.high, "right")
        for i in np.flatnonzero(stops > starts):
            keys, docs = self.open(self.paths[i])
            out[starts[i] : stops[i]] = docs[np.searchsorted(keys, pairs[starts[i] : stops[i]])]
        return out


def looked_up(found: DataFrame, counts: PairCounts) -> DataFrame:
    """The rows of ``aligned`` with ``n_best`` (links with their first id's highest count) and ``count_sum`` (over all links)."""
    known = found.sparkSession.sparkContext.broadcast((counts.shards, counts.best))  # a row for each range, a number for each first id
    names = [c for c in found.columns if c not in ("pairs", "times")]

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards, best = Shards(known.value[0]), known.value[1]
        for batch in batches:
            lists = [numbers(p) for p in batch.column("pairs").to_pylist()]
            wanted = np.unique(np.concatenate([np.empty(0, np.int64), *lists]))
            docs = shards.counts(wanted)
            n_best, count_sum = [], []
            for pairs, packed in zip(lists, batch.column("times").to_pylist(), strict=True):
                times, n = numbers(packed), docs[np.searchsorted(wanted, pairs)]
                n_best.append(int(times[n == best[pairs >> 32]].sum()))
                count_sum.append(int((times * n).sum()))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(n_best, pa.int64()), pa.array(count_sum, pa.int64())], names=[*names, "n_best", "count_sum"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in found.schema if f.name in names) + ", n_best long, count_sum long"
    return found.mapInArrow(look, schema)


def op11_token_alignment(docs: DataFrame, first: str | None = None, second: str | None = None) -> DataFrame:
    """Counts of tokens, groups and links of each document, and how its links stand in the whole corpus."""
    found = stored(aligned(docs, files_of(docs.sparkSession, first, second)), "aligned")
    return looked_up(found, count_pairs(found)).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
