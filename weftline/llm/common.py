"""Session-level helpers of the text operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side with at most this many rows may be broadcast (about 32 MB of ids and labels).
BROADCAST_ROWS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir``.

    A local session without one gets a temporary folder; on a cluster its lack is an error, as no machine's own folder is shared.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="weftline-")
        spark.sparkContext.setCheckpointDir(found)
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def local_path(path: str) -> str:
    """A shared ``file:`` folder as the POSIX path that memory maps need."""
    if path.startswith("file:"):
        return "/" + path[5:].lstrip("/")
    if "://" in path:
        raise ValueError(f"memory-mapped files need a shared POSIX folder, not {path}")
    return path


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again.

    This cuts lineage in a form that survives lost executors. Shuffle files of
    the write are dropped as soon as it ends.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    write(df, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables of ``written`` that nothing will read any more (their readers are written themselves)."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._written_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: While a table is written: shuffle files go when it ends, and Arrow batches stay small.
WRITE_CONF = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20)}


def write(df: DataFrame, path: str) -> None:
    spark = df.sparkSession
    before = {k: spark.conf.get(k) for k in WRITE_CONF}
    for k, v in WRITE_CONF.items():
        spark.conf.set(k, v)
    try:
        df.write.parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small_or_shuffled(df: DataFrame, limit: int = BROADCAST_ROWS, weight: Column | None = None) -> DataFrame:
    """``df`` with a broadcast hint if it is counted and within ``limit``, else as it is.

    A row counts as one, and by ``weight`` (the size of its lists) besides.
    """
    n = df.count() if weight is None else df.agg(F.coalesce(F.sum(F.greatest(weight, F.lit(0)) + 1), F.lit(0))).first()[0]
    return F.broadcast(df) if n <= limit else df


def free_name(docs: DataFrame, wanted: str) -> str:
    """``wanted``, with as many underscores behind it as make it a name that ``docs`` doesn't have."""
    taken = {c.lower() for c in docs.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def columns_of(docs: DataFrame) -> list[Column]:
    """The columns of ``docs``, whatever signs are in their names."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in docs.columns]


def key() -> Column:
    """``doc_id`` as a string that joins can compare; a null one is the empty string."""
    return F.coalesce(F.col("doc_id").cast("string"), F.lit(""))


def text_hash() -> Column:
    return F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))


def doc_text(docs: DataFrame) -> DataFrame:
    """Just ``doc_id`` and ``text`` (null: empty), whatever else the table has."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def fold(modulus: int, key: str = "doc_id") -> Column:
    """``crc32(key as text) mod modulus``; a null key is the empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % modulus
