"""Rolling point-in-time statistics, at one instant for each symbol (its last tick by default)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import TRADE
from .asof import matched_quote, point_in_time, prevailing
from .classify import trade_side
from .quality import dedup_micro, quote_valid, trade_valid

LOOKBACKS = (1, 2, 3, 5, 10, 30)


def instants(ticks: DataFrame) -> DataFrame:
    """symbol, now_ns: the last time of each symbol."""
    return ticks.groupBy("symbol").agg(F.max("sip_ns").alias("now_ns"))


def lookback_quotes(ticks: DataFrame, now: DataFrame, second_ns: int = 1_000_000_000, retention_ns: int | None = None) -> DataFrame:
    """mid_{k}s_ago for each lookback, and bid and ask five seconds ago.

    Repeated quotes don't change what is in force, so only a retention, which goes by the time
    of a quote's first arrival, needs them taken out.
    """
    if retention_ns is None:
        found = prevailing(ticks.where(quote_valid()), now, [k * second_ns for k in LOOKBACKS])
        five = F.col("found")[LOOKBACKS.index(5)]
        return found.select("symbol", "now_ns", *(F.col("found")[n]["mid_px"].alias(f"mid_{k}s_ago") for n, k in enumerate(LOOKBACKS)), five["bid_px"].alias("bid_5s_ago"), five["ask_px"].alias("ask_5s_ago"))
    at = now.select("symbol", "now_ns", F.explode(F.array(*(F.lit(k) for k in LOOKBACKS))).alias("k")).withColumn("at_ns", F.col("now_ns") - F.col("k") * F.lit(second_ns).cast("long"))
    found = point_in_time(dedup_micro(ticks), at, retention_ns=retention_ns)
    pick = lambda c, k: F.max(F.when(F.col("k") == k, F.col(c)))
    return found.groupBy("symbol").agg(F.max("now_ns").alias("now_ns"), *(pick("mid_px", k).alias(f"mid_{k}s_ago") for k in LOOKBACKS), pick("bid_px", 5).alias("bid_5s_ago"), pick("ask_px", 5).alias("ask_5s_ago"))


def quote_vol(ticks: DataFrame, now: DataFrame, steps: int = 20, step_ns: int = 250_000_000) -> DataFrame:
    """quote_vol_5s_bps: population deviation of consecutive simple mid returns; an invalid return counts as 0."""
    found = prevailing(ticks.where(quote_valid()), now, [k * step_ns for k in range(steps, -1, -1)]).select("symbol", F.col("found.mid_px").alias("_mid"))
    step = lambda before, mid: F.when((before > 0) & (mid > 0), mid / before - 1).otherwise(0.0)
    returns = F.zip_with(F.slice("_mid", 1, steps), F.slice("_mid", 2, steps), step)
    total = lambda f: F.aggregate("_r", F.lit(0.0), lambda a, x: a + f(x)) / steps
    sums = found.withColumn("_r", returns).select("symbol", total(lambda x: x).alias("_m"), total(lambda x: x * x).alias("_s"))
    return sums.select("symbol", (F.sqrt(F.greatest(F.col("_s") - F.col("_m") * F.col("_m"), F.lit(0.0))) * 1e4).alias("quote_vol_5s_bps"))


def trade_stats(ticks: DataFrame, now: DataFrame, lag_ns: int = 1_000_000, second_ns: int = 1_000_000_000) -> DataFrame:
    """trade_count_3s, trade_vol_5s, vwap_5s, trade_imbalance_5s over (now - w, now]."""
    quotes = dedup_micro(ticks)
    sided = trade_side(matched_quote(quotes.unionByName(ticks.where(trade_valid(sized=True))), lag_ns, venue_not_after=True))
    rows = now.join(sided.where(F.col("tick_type") == TRADE).select("symbol", "sip_ns", "price", "size", "is_buy"), "symbol", "left")
    age = F.col("now_ns") - F.col("sip_ns")
    recent = lambda k: (age >= 0) & (age < F.lit(k * second_ns).cast("long"))
    sums = rows.groupBy("symbol").agg(
        F.count_if(recent(3)).alias("trade_count_3s"),
        F.coalesce(F.sum(F.when(recent(5), F.col("size"))), F.lit(0.0)).alias("trade_vol_5s"),
        F.sum(F.when(recent(5), F.col("size") * F.col("price"))).alias("_n"),
        F.sum(F.when(recent(5), F.when(F.col("is_buy"), F.col("size")).otherwise(-F.col("size")))).alias("_i"),
    )
    share = lambda x: F.when(F.col("trade_vol_5s") > 0, F.col(x) / F.col("trade_vol_5s")).otherwise(0.0)
    return sums.select("symbol", "trade_count_3s", "trade_vol_5s", share("_n").alias("vwap_5s"), share("_i").alias("trade_imbalance_5s"))


def micro_snapshot(ticks: DataFrame, now: DataFrame | None = None, lag_ns: int = 1_000_000, second_ns: int = 1_000_000_000, buckets: DataFrame | None = None) -> DataFrame:
    """All statistics of each symbol; with buckets also the last closed one and its baselines as single floats."""
    now = instants(ticks) if now is None else now
    out = lookback_quotes(ticks, now, second_ns).join(quote_vol(ticks, now, step_ns=second_ns // 4), "symbol", "left").join(trade_stats(ticks, now, lag_ns, second_ns), "symbol", "left")
    if buckets is not None:
        last = buckets.groupBy("symbol").agg(F.max_by(F.struct("bucket_col", "cnt_15m", "q_15m"), "bucket_col").alias("_l"))
        out = out.join(last, "symbol", "left").select("*", F.coalesce(F.col("_l.bucket_col"), F.lit(-1)).alias("last_col_250ms"), F.col("_l.cnt_15m").cast("float").alias("trailing_15m_cnt"), F.col("_l.q_15m").cast("float").alias("trailing_15m_q")).drop("_l")
    return out
