"""Replicas of frames: deltas, gaps, jitter, and how far two streams agree."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def changed(rows: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """Rows of which a column differs from the row before: what a delta carries."""
    w = Window.partitionBy(key).orderBy(order)
    differs = F.lag(order).over(w).isNull()
    for c in columns:
        differs = differs | ~F.col(c).eqNullSafe(F.lag(c).over(w))
    return rows.withColumn("_differs", differs).where("_differs").drop("_differs")


def gaps_and_jitter(packets: DataFrame, stream: str, seq: str, arrival_ns: str, anchor_ns: str) -> DataFrame:
    """packets with missed (sequence numbers left out before it) and jitter_ns (lateness against the anchors' step)."""
    w = Window.partitionBy(stream).orderBy(seq)
    missed = F.coalesce(F.greatest(F.col(seq) - F.lag(seq).over(w) - 1, F.lit(0)), F.lit(0))
    late = (F.col(arrival_ns) - F.lag(arrival_ns).over(w)) - (F.col(anchor_ns) - F.lag(anchor_ns).over(w))
    return packets.withColumn("missed", missed).withColumn("jitter_ns", F.coalesce(F.greatest(late, F.lit(0)), F.lit(0)))


def common_anchors(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("anchor_ns").intersect(b.select("anchor_ns"))


def missing_on(source: DataFrame, replica: DataFrame) -> DataFrame:
    """Anchors of the source within the common range that the replica lacks."""
    ends = replica.agg(F.min("anchor_ns").alias("_a"), F.max("anchor_ns").alias("_b"))
    own = source.agg(F.min("anchor_ns").alias("_c"), F.max("anchor_ns").alias("_d"))
    within = source.select("anchor_ns").distinct().crossJoin(F.broadcast(ends)).crossJoin(F.broadcast(own))  # one row each
    within = within.where((F.col("anchor_ns") >= F.greatest("_a", "_c")) & (F.col("anchor_ns") <= F.least("_b", "_d"))).select("anchor_ns")
    return within.join(replica.select("anchor_ns").distinct(), "anchor_ns", "left_anti")


def parity(a: DataFrame, b: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """For each column: rows compared, share that match, greatest difference."""
    both = a.select(*keys, *(F.col(c).alias(f"_a_{c}") for c in columns)).join(b.select(*keys, *(F.col(c).alias(f"_b_{c}") for c in columns)), keys)
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(f"_a_{c}").cast("double").alias("x"), F.col(f"_b_{c}").cast("double").alias("y")) for c in columns))).alias("e")
    rows = both.select(each).select("e.*")
    return rows.groupBy("feature").agg(F.count(F.lit(1)).alias("rows"), (F.count_if(F.col("x").eqNullSafe(F.col("y"))) * 100.0 / F.count(F.lit(1))).alias("match_pct"), F.coalesce(F.max(F.abs(F.col("x") - F.col("y"))), F.lit(0.0)).alias("max_delta"))


def element_percentile(rows: DataFrame, column: str, p: float = 0.99, by: tuple[str, ...] = ()) -> DataFrame:
    """The element at index int(p * n) of the sorted values: not interpolated, and without collecting them."""
    w = Window.partitionBy(*(by or (F.lit(0),)))
    ranked = rows.withColumn("_r", F.row_number().over(w.orderBy(column)) - 1).withColumn("_n", F.count(F.lit(1)).over(w))
    at = F.least(F.floor(F.col("_n") * F.lit(p)), F.col("_n") - 1)
    return ranked.where(F.col("_r") == at).select(*by, F.col(column).alias("value"))


def slope(rows: DataFrame, y: str, x: str) -> DataFrame:
    """Least-squares slope, as of memory over time."""
    return rows.agg(F.regr_slope(y, x).alias("slope"))
