"""Byte-level BPE by overlapping chunks: pre-tokenise in parallel, stitch where boundaries meet, encode the pieces.

A text is cut into chunks of ``chunk`` code points that run on for ``overlap``
more. Every chunk is split into pre-tokens on its own, from its first character,
although that may lie amid a pre-token. How the pattern goes on depends only on
where it stands and on what follows, never on what came before; so where a
boundary of one chunk is also a boundary of the next one, both go on alike. The
first such place is the seam: each piece runs from seam to seam, begins and ends
with a pre-token and is encoded alone. The last characters of a chunk are not
trusted (more text could lengthen a match), and no seam follows white space (a run
of it is cut otherwise where the text ends). A document with a pre-token that spans
an overlap has no seam there and is one piece, the whole text.

Texts of one chunk are one piece and never shuffled. Longer ones are told apart
by the digest of their text, so that copies are encoded once, and their chunks
are dealt over all tasks. Decoding looks up the bytes of each id and joins them.

Ids are held as bytes: little-endian unsigned 32-bit integers, one after the
other. Defined results: null and empty texts have no ids; strings of special
tokens are plain text; repeated rows (also with one id or none) each give their
own row; other columns are ignored; a pre-token of any length is merged in
O(n log n); a vocabulary must hold all 256 bytes.
"""

from __future__ import annotations

import base64
import heapq
import json
import struct
from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.llm.common import discard, stored

RANKS = "byte_bpe_50k.tiktoken"
CHUNK, OVERLAP = 1 << 16, 1 << 12  # code points
#: A match may look so many characters beyond its end (a sign, then the two letters of a contraction).
MARGIN = 2
#: Words remembered by a worker (twice as many at most), and how long they may be.
REMEMBERED, LONGEST = 1 << 18, 64
#: Words of more bytes are merged through a heap.
SHORT = 48


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and their ranks, one ``base64 rank`` a line."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f) if token}


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies: printable ones for themselves, others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(others)}


def read_json(path: str) -> dict[bytes, int]:
    """Token bytes and ids of a byte-level vocabulary in JSON without its added tokens; merges must rank like ids."""
    with open(path, encoding="utf-8") as f:
        found = json.load(f)
    letters = byte_letters()
    special = {t["content"] for t in found["added_tokens"]}
    vocab = found["model"]["vocab"]
    merges = ["".join(m.split(" ") if isinstance(m, str) else m) for m in found["model"]["merges"]]
    ids = [vocab[m] for m in merges]
    if ids != sorted(ids):
        raise ValueError("merges aren't in the order of their ids")
    return {bytes(letters[c] for c in token): i for token, i in vocab.items() if token not in special}


def merged(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one pre-token: always the pair of least rank, leftmost first, is joined."""
    if word in ranks:
        return [ranks[word]]
    if len(word) > SHORT:
        return merged_long(word, ranks)
    get, none = ranks.get, len(ranks) + 256
    parts = [word[i : i + 1] for i in range(len(word))]
    pairs = [get(a + b, none) for a, b in pairwise(parts)]
    while (least := min(pairs, default=none)) < none:
        i = pairs.index(least)
        joined = parts[i] + parts.pop(i + 1)
        parts[i] = joined
        del pairs[i]
        if i < len(pairs):
            pairs[i] = get(joined + parts[i + 1], none)
        if i:
            pairs[i - 1] = get(parts[i - 1] + joined, none)
    return [ranks[p] for p in parts]


def merged_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same in O(n log n)."""
    end = len(word)
    after, before = list(range(1, end + 1)), list(range(-1, end - 1))
    alive = [True] * end
    heap = [(ranks[word[i : i + 2]], i, i + 2) for i in range(end - 1) if word[i : i + 2] in ranks]
    heapq.heapify(heap)
    while heap:
        _, at, stop = heapq.heappop(heap)
        middle = after[at]
        if not alive[at] or middle >= end or after[middle] != stop:
            continue  # one of the two was joined to something else
        alive[middle] = False
        after[at] = stop
        if stop < end:
            before[stop] = at
            if (rank := ranks.get(word[at : after[stop]])) is not None:
                heapq.heappush(heap, (rank, at, after[stop]))
        if (left := before[at]) >= 0 and (rank := ranks.get(word[left:stop])) is not None:
            heapq.heappush(heap, (rank, left, stop))
    ids, at = [], 0
    while at < end:
        ids.append(ranks[word[at : after[at]]])
        at = after[at]
    return ids


class Encoder(dict):
    """Pre-tokens -> their packed ids; remembers a bounded number of words, those met again longest."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.split = ranks, regex.compile(pattern)
        self.tokens = {i: token for token, i in ranks.items()}
        self.older: dict[str, bytes] = {}

    def __missing__(self, word: str) -> bytes:
        found = self.older.get(word)
        if found is None:
            ids = merged(word.encode(), self.ranks)
            found = struct.pack(f"<{len(ids)}I", *ids)
        if len(word) <= LONGEST:
            if len(self) >= REMEMBERED:
                self.older = dict(self)
                self.clear()
            self[word] = found
        return found

    def encode(self, text: str | None) -> bytes:
        return b"".join(map(self.__getitem__, self.split.findall(text or "")))

    def decode(self, ids: bytes | None) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids or b"", "<u4").tolist()))

    def boundaries(self, text: str) -> list[int]:
        return [m.start() for m in self.split.finditer(text)]


def shared(spark: SparkSession, ranks: dict[bytes, int], pattern: str) -> Broadcast:
    """A vocabulary for all workers: as large as its file, whatever the data's size."""
    return spark.sparkContext.broadcast((ranks, pattern))


@lru_cache(maxsize=4)
def encoder(vocabulary: Broadcast) -> Encoder:
    return Encoder(*vocabulary.value)


def encoded(text: Column | str, vocabulary: Broadcast) -> Column:
    @F.arrow_udf("binary")
    def encode(texts: pa.Array) -> pa.Array:
        return pa.array([encoder(vocabulary).encode(t) for t in texts.to_pylist()], pa.binary())

    return encode(text)


def there_and_back(text: Column | str, vocabulary: Broadcast) -> Column:
    """(ids, bytes) of a text: encoded, and the ids decoded, in one visit to a worker."""

    @F.arrow_udf("struct<ids:binary,bytes:binary>")
    def both(texts: pa.Array) -> pa.Array:
        known = encoder(vocabulary)
        ids = [known.encode(t) for t in texts.to_pylist()]
        return pa.StructArray.from_arrays([pa.array(ids, pa.binary()), pa.array(map(known.decode, ids), pa.binary())], names=["ids", "bytes"])

    return both(text)


def decoded(ids: Column | str, vocabulary: Broadcast) -> Column:
    """The bytes that packed ids stand for."""

    @F.arrow_udf("binary")
    def decode(packed: pa.Array) -> pa.Array:
        return pa.array([encoder(vocabulary).decode(p) for p in packed.to_pylist()], pa.binary())

    return decode(ids)


def joined(parts: Column | str) -> Column:
    @F.arrow_udf("binary")
    def join(lists: pa.Array) -> pa.Array:
        return pa.array([b"".join(p) for p in lists.to_pylist()], pa.binary())

    return join(parts)


def chunks_of(texts: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """(digest, i, of, part): each text's chunks, once for all copies of the text."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for digest, text in zip(batch[0].to_pylist(), batch[1].to_pylist(), strict=True):
                of = -(-len(text) // chunk)
                for i in range(of):
                    part = text[i * chunk : (i + 1) * chunk + overlap]
                    yield pa.RecordBatch.from_pydict({"digest": [digest], "i": [i], "of": [of], "part": [part]})

    return texts.mapInArrow(cut, "digest string, i long, of long, part string").dropDuplicates(["digest", "i"])


def seams(chunks: DataFrame, vocabulary: Broadcast, chunk: int, overlap: int) -> DataFrame:
    """(digest, i, first, last): the piece of each chunk from seam to seam, as code points of the text; ``last`` null at the end.

    Documents that lack a seam are left out. Only the boundaries within overlaps
    are shuffled, at most ``overlap`` positions on either side of a chunk.
    """

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            head, tail = [], []
            for i, part in zip(batch[1].to_pylist(), batch[3].to_pylist(), strict=True):
                starts = encoder(vocabulary).boundaries(part)
                head.append([i * chunk + s for s in starts if s < overlap])
                tail.append([i * chunk + s for s in starts if chunk <= s <= len(part) - MARGIN and not part[s - 1].isspace()])
            yield pa.RecordBatch.from_arrays([batch[0], batch[1], batch[2], pa.array(head, pa.list_(pa.int64())), pa.array(tail, pa.list_(pa.int64()))], names=["digest", "i", "of", "head", "tail"])

    marks = chunks.mapInArrow(meet, "digest string, i long, of long, head array<long>, tail array<long>")
    along = Window.partitionBy("digest").orderBy("i")
    met = marks.withColumn("last", F.array_min(F.array_intersect("tail", F.lead("head").over(along))))
    lacking = (F.col("i") < F.col("of") - 1) & F.col("last").isNull()
    pieces = met.select(
        "digest",
        "i",
        F.coalesce(F.lag("last").over(along), F.lit(0)).alias("first"),
        "last",
        F.max(lacking).over(Window.partitionBy("digest")).alias("lacking"),
    )
    return pieces.where(~F.col("lacking")).drop("lacking")


def encode_long(texts: DataFrame, vocabulary: Broadcast, chunk: int, overlap: int) -> DataFrame:
    """(digest, ids) of distinct texts that are longer than a chunk. ``texts``: (digest, text)."""
    chunks = stored(chunks_of(texts, chunk, overlap), "chunks")
    cuts = stored(seams(chunks, vocabulary, chunk, overlap), "seams")
    start = (F.col("first") - F.col("i") * chunk + 1).cast("int")
    length = F.coalesce(F.col("last") - F.col("first"), F.lit(chunk + overlap)).cast("int")
    pieces = chunks.join(cuts, ["digest", "i"]).select("digest", "i", F.substring("part", start, length).alias("piece"))
    whole = texts.join(cuts.select("digest").distinct(), "digest", "left_anti").dropDuplicates(["digest"]).select("digest", F.lit(0).cast("long").alias("i"), F.col("text").alias("piece"))
    ids = pieces.unionByName(whole).select("digest", "i", encoded("piece", vocabulary).alias("ids"))
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("i", "ids"))), lambda p: p["ids"])  # the ids of one text
    found = stored(ids.groupBy("digest").agg(in_order.alias("parts")).select("digest", joined("parts").alias("ids")), "long-ids")
    discard(chunks, cuts)
    return found


def encode(docs: DataFrame, vocabulary: Broadcast, chunk: int = CHUNK, overlap: int = OVERLAP, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, ids, bytes), one row for each input row: packed ids and what they decode to."""
    if not MARGIN < overlap <= chunk:
        raise ValueError("an overlap is longer than the margin and no longer than a chunk")
    rows = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    is_long = F.coalesce(F.char_length("text") > chunk, F.lit(False))
    short = rows.where(~is_long).select("doc_id", there_and_back("text", vocabulary).alias("made")).select("doc_id", "made.*")
    long = rows.where(is_long).withColumn("digest", F.sha2("text", 256))
    found = encode_long(long.select("digest", "text"), vocabulary, chunk, overlap)
    ids = long.select("doc_id", "digest").join(found, "digest").select("doc_id", "ids")
    return short.unionByName(ids.withColumn("bytes", decoded("ids", vocabulary)))


def vocabulary_of(spark: SparkSession, path: str | None = None, pattern: str | None = None) -> Broadcast:
    """The ranks in a file (by default of the installed public tokenizers) and the pattern of pre-tokens."""
    return shared(spark, read_ranks(path or public_tokenizers.path(RANKS)), pattern or public_tokenizers.PATTERN)


def op13_byte_bpe(docs: DataFrame, path: str | None = None) -> DataFrame:
    """The digest columns: how many ids, their sum and that of the bytes they decode to."""
    vocabulary = vocabulary_of(docs.sparkSession, path)
    return encode(docs, vocabulary).select("doc_id", F.floor(F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256"))
