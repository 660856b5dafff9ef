"""What the operators of this subpackage share."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom import ship

#: A side of a join is broadcast only if it was counted and its rows take less than this.
BROADCAST_BYTES = 48 << 20


def work_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir; a temporary one only where that is unset on a local master."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    own = tempfile.mkdtemp(prefix="barloom-")
    spark.sparkContext.setCheckpointDir(own)
    return spark.sparkContext.getCheckpointDir()


def work_table(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{work_dir(spark).rstrip('/')}/barloom-work/{uuid.uuid4().hex}-{name}"
    schema = df.schema
    df.write.option("compression", "zstd").parquet(path)
    del df
    release(spark)
    out = spark.read.schema(schema).parquet(path)
    out._barloom_path = path
    return out


def append_table(df: DataFrame, name: str, to: DataFrame | None = None) -> DataFrame:
    """df added to a work table (a new one if there is none): passes of a loop leave files, not a plan that grows."""
    if to is None:
        return work_table(df, name)
    spark, path, schema = df.sparkSession, to._barloom_path, df.schema
    df.write.mode("append").option("compression", "zstd").parquet(path)
    del df
    release(spark)
    out = spark.read.schema(schema).parquet(path)
    out._barloom_path = path
    return out


def drop_table(df: DataFrame) -> None:
    """Delete a work table that nothing will read again."""
    path = getattr(df, "_barloom_path", None)
    if path:
        spark = df.sparkSession
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def release(spark: SparkSession) -> None:
    """Let the driver notice shuffles that are no longer referenced, so that their files go."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def small(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """df with a broadcast hint if its counted rows fit the bound; else a shuffled join is left to the planner."""
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df


def partitions(spark: SparkSession, rows: int, per_partition: int) -> int:
    """Enough partitions for so many rows each, and no fewer than the session's setting."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // per_partition))


def with_text_key(df: DataFrame, text: str, keep: list[str] | None = None) -> DataFrame:
    """The kept columns with _t, the text, and _key, 128 bits of it (null as empty). Native, so that a stage has one Python worker for a task, not two."""
    return df.select(*[df[c] for c in keep or []], df[text].alias("_t"), F.unhex(F.md5(F.coalesce(df[text], F.lit("")))).alias("_key"))


def has_words(text: Column) -> Column:
    return F.coalesce(text.rlike(r"[^\x20\x09-\x0D]"), F.lit(False))


#: Rows and bytes of an Arrow batch: texts may be long, and a worker holds a batch at a time.
BATCH_ROWS, BATCH_BYTES = 512, 4 << 20


def ready(df: DataFrame) -> DataFrame:
    """df, once the executors have this package and Arrow batches are small."""
    spark = df.sparkSession
    ship(spark)
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = int(spark.conf.get(key).rstrip("b"))
        if not 0 < now <= most:
            spark.conf.set(key, str(most))
    return df


def tidy(run):
    """A function for mapInArrow that gives memory back at its end: workers stay alive between tasks."""

    def tidied(batches):
        try:
            yield from run(batches)
        finally:
            import ctypes

            import pyarrow

            gc.collect()
            pyarrow.default_memory_pool().release_unused()
            try:
                ctypes.CDLL("libc.so.6").malloc_trim(0)
            except OSError:  # another C library
                pass

    return tidied


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
