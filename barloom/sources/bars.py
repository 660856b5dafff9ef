"""Recorded and exported bars: reads and writes."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config, Phase, from_dict
from ..functions.lattice import micros
from ..schema import FEATURES_5

SIDECAR = "_barloom_config.json"


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a temporary one only where that is unset on a local master."""
    import tempfile

    named = spark.conf.get("spark.checkpoint.dir", None)
    master = spark.sparkContext.master
    if not named and (not master.startswith("local") or master.startswith("local-cluster")):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    return named or tempfile.mkdtemp(prefix="barloom-")


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def write_config(spark: SparkSession, path: str, config: Config) -> None:
    """The configuration beside the data, so that a reader can rebuild names and phases."""
    body = {"shm": {"cadence_interval": config.cadence_ns, "max_frames": config.max_frames}, "features": list(config.features), "unique_symbols": list(config.symbols), "phases": [{"id": p.id, "name": p.name, "offset_ms": p.offset_ns // 1_000_000, "symbols": list(p.symbols)} for p in config.phases]}
    p, fs = _fs(spark, f"{path.rstrip('/')}/{SIDECAR}")
    out = fs.create(p, True)
    out.write(bytearray(json.dumps(body).encode()))
    out.close()


def read_config(spark: SparkSession, path: str, sample: int = 4096) -> Config:
    """The configuration beside the data; else symbols and number of features as a sample of rows shows them."""
    p, fs = _fs(spark, f"{path.rstrip('/')}/{SIDECAR}")
    if fs.exists(p):
        stream = fs.open(p)
        try:
            return from_dict(json.loads(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")))
        finally:
            stream.close()
    rows = playback(spark, path).limit(sample)
    found = rows.groupBy("symbol").agg(F.min("ts_ns").alias("t"), F.max(F.size("features")).alias("n")).orderBy("t", "symbol").collect()
    n = max((r["n"] for r in found if r["n"]), default=0)
    names = FEATURES_5 if n in (0, 5) else [f"feature_{k}" for k in range(n)]
    symbols = tuple(r["symbol"] for r in found)
    return Config(symbols, (Phase(0, "phase_0", 0, symbols),), features=tuple(names))


def playback(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """Recorded rows of a file or of all files under a folder. Unsigned 64-bit columns come as LONG."""
    rows = spark.read.option("recursiveFileLookup", recursive).option("pathGlobFilter", "*.parquet").parquet(path)
    return rows.select(*(F.col(c).cast("long").alias(c) if t.startswith("decimal(20") else F.col(c) for c, t in rows.dtypes))


def in_order(rows: DataFrame) -> DataFrame:
    return rows.orderBy("ts_ns", "symbol")


def record(rows: DataFrame, path: str, config: Config | None = None) -> None:
    """Recorded rows by UTC date, appended: a restart loses nothing."""
    dated = rows.withColumn("date", F.to_date(F.timestamp_micros(micros(F.col("ts_ns")))))
    dated.repartition("date").write.mode("append").partitionBy("date").option("compression", "snappy").parquet(path)
    if config:
        write_config(rows.sparkSession, path, config)


def export_features(frames: DataFrame, path: str, features: list[str], max_frames: int | None = None) -> int:
    """anchor_ns, phase, symbol and features as zstd Parquet; the committer makes it appear as a whole. Returns the rows written, after a check against what is read back."""
    if max_frames is not None:
        last = frames.select("anchor_ns").distinct().orderBy("anchor_ns").limit(max_frames)
        frames = frames.join(F.broadcast(last), "anchor_ns", "left_semi")  # max_frames rows
    out = frames.select("anchor_ns", "phase", "symbol", *(F.col(c).cast("double").alias(c) for c in features))
    out.write.mode("overwrite").option("compression", "zstd").parquet(path)
    back = frames.sparkSession.read.parquet(path).count()
    want = out.count()
    if back != want:
        raise RuntimeError(f"{want} rows to export, {back} in {path}")
    return back


def spool(messages: DataFrame, path: str, column: str = "value", at: str = "received_ns") -> None:
    """Raw messages as text by UTC date, line ends trimmed, blank ones left out; none is dropped."""
    text = F.regexp_replace(F.col(column), r"[\r\n]+$", "")
    rows = messages.select(F.to_date(F.timestamp_micros(micros(F.col(at)))).alias("date"), text.alias("value")).where(F.trim("value") != "")
    rows.write.mode("append").partitionBy("date").option("compression", "gzip").text(path)


def merged_csv(ticks: DataFrame, path: str) -> None:
    """Both streams as gzip CSV in order of time, quotes first."""
    kind = F.when(F.col("tick_type") == 0, "Q").otherwise("T")
    rows = ticks.orderBy("sip_ns", "tick_type").select(kind.alias("event_type"), "symbol", F.col("sip_ns").alias("sip_timestamp_ns"), "bid_px", "bid_sz", "ask_px", "ask_sz", F.when(F.col("tick_type") == 1, F.col("price")).alias("trade_px"), F.col("size").alias("trade_sz"))
    rows.write.mode("overwrite").option("header", True).option("compression", "gzip").csv(path)


def telemetry(frames: DataFrame, path: str) -> None:
    """Frames as JSON lines."""
    frames.write.mode("overwrite").json(path)


def upsert(snapshots: DataFrame, path: str, batch: int | None = None, key: str = "symbol", order: str = "sip_ns", counters: tuple[str, ...] = ("conditions",)) -> DataFrame:
    """What is stored, with what is new field by field: a field that the new row lacks keeps its old value, the time is the greater, counters add up.

    The new table is written beside the old one, which is set aside, not deleted, until the new
    one is in its place; a crash between leaves it there for the next call. A batch that comes
    again (same number) changes nothing.
    """
    spark = snapshots.sparkSession
    p, fs = _fs(spark, path)
    aside, fresh = (_fs(spark, f"{path}.{x}")[0] for x in ("old", "new"))
    if not fs.exists(p) and fs.exists(aside):
        fs.rename(aside, p)
    if batch is not None and fs.exists(_fs(spark, f"{path}/_batch-{batch}")[0]):
        return spark.read.schema(snapshots.schema).parquet(path)
    new = snapshots
    if fs.exists(p):
        old = spark.read.schema(snapshots.schema).parquet(path).alias("o")
        both = old.join(snapshots.alias("n"), key, "full")
        value = lambda c: F.coalesce(f"n.{c}", f"o.{c}")
        total = lambda c: F.coalesce(f"o.{c}", F.lit(0)) + F.coalesce(f"n.{c}", F.lit(0))
        new = both.select(*((F.col(key) if c == key else F.greatest(f"o.{c}", f"n.{c}") if c == order else total(c) if c in counters else value(c)).cast(snapshots.schema[c].dataType).alias(c) for c in snapshots.columns))
        if {"bid_px", "ask_px", "mid_px", "spread_px"} <= set(new.columns):
            two = (F.col("bid_px") > 0) & (F.col("ask_px") > 0)
            new = new.withColumn("mid_px", F.when(two, (F.col("bid_px") + F.col("ask_px")) / 2)).withColumn("spread_px", F.when(two, F.col("ask_px") - F.col("bid_px")))
    new.write.mode("overwrite").parquet(f"{path}.new")
    if batch is not None:
        fs.create(_fs(spark, f"{path}.new/_batch-{batch}")[0]).close()
    fs.delete(aside, True)
    if fs.exists(p):
        fs.rename(p, aside)
    fs.rename(fresh, p)
    fs.delete(aside, True)
    return spark.read.schema(snapshots.schema).parquet(path)
