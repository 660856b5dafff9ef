"""Sub-second buckets with quotes in ticks, lit flow by side, and trailing baselines by prefix sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lattice import dense, half_even_ticks, trading_open
from ..schema import NO_MID_TICKS
from .classify import lit_flow
from .grid import backward, earliest, forward, last_of
from .quality import quote_valid, trade_valid

BUCKET_NS, BASELINE = 250_000_000, 3600


def opened(ticks: DataFrame, open_ns: Column | int | None) -> DataFrame:
    """ticks with open_ns: as given, or the trading day's opening by each symbol's first tick."""
    if open_ns is None:
        return ticks.withColumn("open_ns", trading_open(F.min("sip_ns").over(Window.partitionBy("symbol"))))
    return ticks.withColumn("open_ns", open_ns if isinstance(open_ns, Column) else F.lit(open_ns).cast("long"))


def bucket(width: int) -> Column:
    return F.expr(f"(sip_ns - open_ns) div {width}L")


def loads(volume: str) -> Column:
    """How many of the marks 0 (exclusive), 200 and 800 a volume reaches."""
    v = F.col(volume)
    return (v > 0).cast("double") + ((v > 0) & (v >= 200)).cast("double") + ((v > 0) & (v >= 800)).cast("double")


def trailing(x: Column, rows: int) -> Column:
    """Sum over the last rows of a symbol, as a prefix sum less a lagged one: O(1) a row whatever the span. At least 1."""
    w = Window.partitionBy("symbol").orderBy("bucket_col")
    so_far = F.sum(x).over(w.rowsBetween(Window.unboundedPreceding, 0))
    gone = F.coalesce(F.sum(x).over(w.rowsBetween(Window.unboundedPreceding, -rows)), F.lit(0.0))
    return F.greatest(so_far - gone, F.lit(1.0))


def buckets(ticks: DataFrame, width: int = BUCKET_NS, open_ns: Column | int | None = None, baseline: int = BASELINE) -> DataFrame:
    """symbol, bucket_col, bid_ticks, ask_ticks, lit_buy_vol, lit_sell_vol, cnt_15m, q_15m, mid_ticks of all closed buckets from the opening on.

    A bucket is closed once a valid quote or trade of its symbol is at or after its end. Ticks before the opening aren't part of any.
    """
    valid = opened(ticks.where(quote_valid(strict_cross=True) | trade_valid(sized=True)), open_ns)
    flow = lit_flow(valid).where(F.col("sip_ns") >= F.col("open_ns")).groupBy("symbol", bucket(width).alias("bucket_col")).agg(F.sum(F.when(F.col("lit_side") > 0, F.col("size"))).alias("lit_buy_vol"), F.sum(F.when(F.col("lit_side") < 0, F.col("size"))).alias("lit_sell_vol"))
    quotes = valid.where(quote_valid(strict_cross=True)).groupBy("symbol", F.greatest(bucket(width), F.lit(0)).alias("bucket_col")).agg(last_of("bid_px").alias("_b"), last_of("ask_px").alias("_a"))
    grid = valid.groupBy("symbol").agg(F.max(bucket(width)).alias("_last")).where("_last > 0")
    grid = dense(grid.withColumnRenamed("_last", "_until"), F.lit(0).cast("long"), F.col("_until") - 1, 1, "bucket_col").select("symbol", "bucket_col")
    rows = grid.join(quotes, ["symbol", "bucket_col"], "left").join(flow, ["symbol", "bucket_col"], "left").fillna(0.0, ["lit_buy_vol", "lit_sell_vol"])
    rows = rows.withColumn("_bt", half_even_ticks(F.col("_b"))).withColumn("_at", half_even_ticks(F.col("_a")))
    keys = ("symbol",)
    rows = rows.withColumn("_fb", forward("_bt", keys, "bucket_col")).withColumn("_fa", forward("_at", keys, "bucket_col"))
    two = (F.col("_fb") > 0) & (F.col("_fa") > F.col("_fb"))
    rows = rows.withColumn("mid_ticks", F.coalesce(forward(F.when(two, (F.col("_fb") + F.col("_fa")) / 2), keys, "bucket_col"), F.lit(NO_MID_TICKS)))
    return rows.select(
        "symbol", "bucket_col",
        F.coalesce("_fb", earliest("_bt", keys, "bucket_col")).alias("bid_ticks"), F.coalesce("_fa", earliest("_at", keys, "bucket_col")).alias("ask_ticks"),
        "lit_buy_vol", "lit_sell_vol",
        trailing(loads("lit_buy_vol") + loads("lit_sell_vol"), baseline).alias("cnt_15m"),
        trailing(F.sqrt("lit_buy_vol") + F.sqrt("lit_sell_vol"), baseline).alias("q_15m"),
        "mid_ticks",
    )


def window_250ms(bars: DataFrame, symbol: str, now_col: int, n: int = 41) -> DataFrame:
    """n buckets up to the one two before now, or the last closed; buckets before the opening are the first one's quotes without volume."""
    own = bars.where(F.col("symbol") == symbol)
    end = own.agg(F.least(F.max("bucket_col"), F.lit(now_col - 2).cast("long")).alias("_end"))
    grid = end.select(F.explode(F.sequence(F.col("_end") - (n - 1), F.col("_end"))).alias("col")).withColumn("bucket_col", F.greatest("col", F.lit(0).cast("long")))
    out = grid.join(own, "bucket_col", "left").withColumn("symbol", F.lit(symbol))
    fill = lambda c: F.coalesce(F.col(c), backward(c, ("symbol",), "col"))
    volume = lambda c: F.when(F.col("col") < 0, 0.0).otherwise(F.coalesce(F.col(c), F.lit(0.0)))
    return out.select("symbol", "col", "bucket_col", fill("bid_ticks").alias("bid_ticks"), fill("ask_ticks").alias("ask_ticks"), volume("lit_buy_vol").alias("lit_buy_vol"), volume("lit_sell_vol").alias("lit_sell_vol"), "cnt_15m", "q_15m", F.coalesce("mid_ticks", F.lit(NO_MID_TICKS)).alias("mid_ticks"))
