"""Sharding by size-tiered compaction.

A store is a folder: ``data/<write>/`` holds immutable Parquet shards,
``manifests/<write>/`` the lists of live shards, ``commits/<version>.json`` names
the manifest of a version. Appending writes arrivals as they are partitioned, as
small shards. Compaction puts shards into tiers by size (each ``fanout`` times
the one before); a tier of ``fanout`` or more runs is merged into files of about
``target_bytes``, until no tier is that full. Both end with a commit: a commit
file that exists already is never replaced, so of two writers one fails and can
try again; readers see one version or the next, and a job that dies leaves only
files that no manifest names. That rests on a rename that is atomic and refuses to
replace: HDFS and local file systems have it, plain object stores don't, and there
a store needs one writer at a time. ``vacuum`` spares folders younger than a stated
age, which another writer may have written and not yet committed.

Merging reads a tier's files and coalesces the readers' partitions: shards of a
tier are alike in size, so equal numbers of them make equal files, and no row is
shuffled. What reaches the driver is file names and sizes of one tier's shards.

Defined results: an empty arrival adds no shard; rows are stored as they are,
nulls in any column, empty and very long texts, repeated rows and extra columns
included (a row is never cut, so a text longer than a shard makes a larger one); shards of
``target_bytes * 3 / 4`` or more are done; fewer than ``fanout`` runs of a tier
wait for more arrivals.
"""

from __future__ import annotations

import json
import math
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import work_folder

MIB = 1 << 20
DAY = 86_400
SHARDS = "path string, bytes long, rows long, generation int"


class CommitConflict(RuntimeError):
    """Another writer has committed this version."""


class ShardStore:
    def __init__(self, spark: SparkSession, root: str, target_bytes: int = 128 * MIB, fanout: int = 4, least_bytes: int = MIB):
        self.spark, self.root = spark, root.rstrip("/")
        self.target_bytes, self.fanout, self.least_bytes = target_bytes, fanout, least_bytes

    # Files: names and sizes only, by Hadoop's file system, whatever the store's scheme.

    def _fs(self, path: str):
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        where = hadoop.Path(path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()), where

    def _names(self, path: str) -> list[tuple[str, int]]:
        fs, where = self._fs(path)
        return [(s.getPath().getName(), s.getLen()) for s in fs.listStatus(where)] if fs.exists(where) else []

    def version(self) -> int:
        """The last committed version, 0 before the first."""
        return max((int(n.split(".")[0]) for n, _ in self._names(f"{self.root}/commits") if n.endswith(".json") and not n.startswith(".")), default=0)

    def _manifest_path(self, version: int) -> str:
        return json.loads(self.spark.read.option("wholetext", True).text(f"{self.root}/commits/{version:08d}.json").first()[0])["manifest"]

    def manifest(self, version: int | None = None) -> DataFrame:
        """(path, bytes, rows, generation) of the live shards."""
        version = self.version() if version is None else version
        if not version:
            return self.spark.createDataFrame([], SHARDS)
        return self.spark.read.schema(SHARDS).parquet(self._manifest_path(version))

    def read(self, version: int | None = None) -> DataFrame:
        paths = [r["path"] for r in self.manifest(version).select("path").collect()]
        if not paths:
            raise ValueError("the store has no shard")
        return self.spark.read.parquet(*paths)

    def _commit(self, shards: DataFrame, version: int) -> int:
        """Write a manifest and make it ``version``, which must not exist."""
        path = f"{self.root}/manifests/{uuid.uuid4().hex}"
        shards.coalesce(1).write.parquet(path)
        jvm = self.spark._jvm
        fs, draft = self._fs(f"{self.root}/commits/.{uuid.uuid4().hex}")
        out = fs.create(draft, False)
        out.write(bytearray(json.dumps({"version": version, "manifest": path}).encode()))
        out.close()
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:  # atomic, and refused where the version exists
            context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark._jsc.hadoopConfiguration())
            context.rename(draft, jvm.org.apache.hadoop.fs.Path(f"{self.root}/commits/{version:08d}.json"), options)
        except Exception as e:
            fs.delete(draft, False)
            if "AlreadyExists" in str(e):
                raise CommitConflict(f"version {version} exists") from e
            raise
        return version

    def _write(self, df: DataFrame, generation: int) -> DataFrame:
        """Write shards; returns their manifest rows."""
        path = f"{self.root}/data/{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(path)
        rows = self.spark.read.schema(df.schema).parquet(path).groupBy(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("bytes")).agg(F.count("*").alias("rows"))
        return rows.where("rows > 0").select("path", "bytes", "rows", F.lit(generation).alias("generation"))

    def append(self, arrivals: DataFrame) -> int:
        """Add arrivals as small shards and commit."""
        version = self.version()
        return self._commit(self.manifest(version).union(self._write(arrivals, 0)), version + 1)

    def tier(self) -> Column:
        return F.greatest(F.lit(0), F.floor(F.log(F.col("bytes") / self.least_bytes) / math.log(self.fanout))).cast("int")

    def small(self) -> Column:
        return F.col("bytes") < self.target_bytes * 3 // 4

    def due(self, version: int) -> list[int]:
        """The tiers that hold enough runs to merge, lowest first; there are as many as powers of the fanout up to the target."""
        tiers = self.manifest(version).where(self.small()).groupBy(self.tier().alias("tier")).agg(F.count("*").alias("runs"))
        return sorted(r["tier"] for r in tiers.where(F.col("runs") >= self.fanout).collect())

    def compact(self) -> int:
        """Merge full tiers, lowest first, until none is left; each merge is one commit."""
        while due := self.due(version := self.version()):
            live = self.manifest(version)
            chosen = self.small() & (self.tier() == due[0])
            total, oldest = live.where(chosen).agg(F.sum("bytes"), F.max("generation")).first()
            paths = [r["path"] for r in live.where(chosen).select("path").orderBy("path").collect()]  # file names, as Spark lists them to read them
            merged = self._write(self.spark.read.parquet(*paths).coalesce(max(1, round(total / self.target_bytes))), oldest + 1)
            self._commit(live.where(~chosen).union(merged), version + 1)
        return self.version()

    def vacuum(self, older_than: float = DAY) -> int:
        """Delete data that the last version doesn't name and that is older than so many seconds; older versions can't be read after.

        What is younger may be another writer's, written and not yet committed.
        """
        kept = {r["write"] for r in self.manifest().select(F.element_at(F.split("path", "/"), -2).alias("write")).distinct().collect()}  # a name for each write
        fs, where = self._fs(f"{self.root}/data")
        limit = (time.time() - older_than) * 1000
        gone = [s.getPath().getName() for s in (fs.listStatus(where) if fs.exists(where) else []) if s.getModificationTime() <= limit and s.getPath().getName() not in kept]
        for name in gone:
            fs, where = self._fs(f"{self.root}/data/{name}")
            fs.delete(where, True)
        return len(gone)

    def placement(self, *columns: str, version: int | None = None) -> DataFrame:
        """``columns`` of all rows, with the shard that holds each and the version."""
        version = self.version() if version is None else version
        return self.read(version).select(*columns, F.col("_metadata.file_name").alias("shard"), F.col("_metadata.file_size").alias("shard_bytes")).withColumn("version", F.lit(version))


def sharded(docs: DataFrame, target_bytes: int = 128 * MIB, root: str | None = None) -> DataFrame:
    """Store ``docs``, compact, and say where each document is: (doc_id, source, shard, shard_bytes, version)."""
    store = ShardStore(docs.sparkSession, root or work_folder(docs.sparkSession, "shards"), target_bytes)
    version = store.append(docs)
    if store.compact() > version:
        store.vacuum(DAY if root else 0)  # a fresh folder has no other writer
    if not store.manifest().take(1):
        nothing = {"shard": F.lit(""), "shard_bytes": F.lit(0).cast("long"), "version": F.lit(store.version())}
        return docs.select("doc_id", "source").where("false").withColumns(nothing)
    return store.placement("doc_id", "source")


def op1_sharding(docs: DataFrame) -> DataFrame:
    return sharded(docs)
