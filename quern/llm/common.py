"""What several operators of this subpackage need: a shared work folder and stored intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Code points that separate words in most operators: space and \t \n \v \f \r.
BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"
BLANK_RUN = "[\\x20\\x09-\\x0D]+"
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def work_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder below ``spark.checkpoint.dir``, which every executor and the driver share.

    Only where that setting is absent in one process (``local[n]``, as in tests)
    is a checkpoint folder set here; on a cluster its absence is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-checkpoints-"))
        root = spark.sparkContext.getCheckpointDir()
    return f"{root.rstrip('/')}/quern/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again.

    Cuts the lineage (a lost executor costs no recomputation of what came
    before), gives Spark the real size to choose a join by, and lets adaptive
    execution split skewed join inputs, which it can't do behind an aggregate.
    """
    spark = df.sparkSession
    path = work_folder(spark, name)
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found.stored_at = path
    return found


def discard(*tables: DataFrame) -> None:
    """Delete stored tables that nothing reads any more: all that was made from them is stored too."""
    for table in tables:
        path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table.stored_at)
        path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def bounded_batches(spark: SparkSession, size: int = 4 << 20) -> None:
    """Send Python workers less at a time than Spark's 64 MiB; a user's own setting stays."""
    if spark.conf.get(BATCH_BYTES) in ("67108864b", "64MB", "64m"):
        spark.conf.set(BATCH_BYTES, str(size))


def row_key(*columns: str) -> Column:
    """64 bits from a row's content: with the id it tells apart rows that share or lack an id."""
    return F.xxhash64(*columns)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, all else as it was (``lower`` alone would change accented capitals too)."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words_of(text: Column, separators: str = BLANK_RUN) -> Column:
    """The words of a text in order; null and empty texts have none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), separators), "")
