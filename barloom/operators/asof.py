"""As-of joins as one union and running last values: a sort for each key, no range join."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..schema import QUOTE, TRADE

_QUOTE = ("bid_px", "ask_px", "bid_sz", "ask_sz", "sip_ns", "part_ns", "seq")
_STRUCT = f"CASE WHEN tick_type = {QUOTE} THEN struct({', '.join(_QUOTE)}) END"


def _lagged(lag_ns: int) -> list[str]:
    """_a: the latest quote at least lag_ns older than the tick; _f: the symbol's first quote."""
    at = f"CASE WHEN tick_type = {QUOTE} THEN sip_ns + {lag_ns}L ELSE sip_ns END"
    first = f"min(CASE WHEN tick_type = {QUOTE} THEN struct(sip_ns, seq, bid_px, ask_px, bid_sz, ask_sz, part_ns) END) {text.over('symbol')}"
    return [f"{text.running(_STRUCT, 'symbol', f'{at}, tick_type, seq')} AS _a", f"{first} AS _f"]


_FALLBACK = f"CASE WHEN tick_type = {TRADE} AND _f.sip_ns <= sip_ns THEN struct({', '.join(f'_f.{c}' for c in _QUOTE)}) END"
_VENUE = f"CASE WHEN tick_type = {QUOTE} THEN bid_exch ELSE trade_exch END"
_AT_VENUE = f"CASE WHEN {_VENUE} IS NOT NULL THEN {text.running(_STRUCT, f'symbol, {_VENUE}', text.ORDER)} END"


def lagged_quote(ticks: DataFrame, lag_ns: int = 1_000_000, name: str = "quote_a") -> DataFrame:
    """Trades and quotes with the latest quote at least lag_ns older than the tick; else the symbol's first quote, if that precedes it."""
    return ticks.selectExpr("*", *_lagged(lag_ns)).selectExpr("*", f"coalesce(_a, {_FALLBACK}) AS {name}").drop("_a", "_f")


def venue_quote(ticks: DataFrame, name: str = "quote_b") -> DataFrame:
    """Ticks with the latest quote that precedes them and whose bid is of the trade's venue. The partitioning by symbol serves here too."""
    return ticks.selectExpr("*", f"{_AT_VENUE} AS {name}")


def matched_quote(ticks: DataFrame, lag_ns: int = 1_000_000, venue_not_after: bool = False, keep_quotes: bool = False) -> DataFrame:
    """Trades with mid_px of their quote: the venue's, if its participant time is no later and it is newer than the lagged one; else the lagged one. mid_from is B or A.

    With keep_quotes the other rows stay, without these two. The lagged quote is a range of the
    order of time, so it needs no sort of its own.
    """
    trade, mid = f"tick_type = {TRADE}", "(bid_px + ask_px) / 2 AS mid"
    quote = lambda *fields: f"CASE WHEN tick_type = {QUOTE} THEN struct({', '.join((*fields, mid))}) END"
    lagged = f"max({quote('sip_ns', 'seq')}) OVER (PARTITION BY symbol ORDER BY sip_ns RANGE BETWEEN UNBOUNDED PRECEDING AND {lag_ns}L PRECEDING)"
    rows = ticks.selectExpr("*", f"{lagged} AS _a", f"min({quote('sip_ns', 'seq')}) {text.over('symbol')} AS _f", f"{_VENUE} AS _venue")
    rows = rows.selectExpr(*ticks.columns, "coalesce(_a, CASE WHEN _f.sip_ns <= sip_ns THEN _f END) AS _a", f"CASE WHEN _venue IS NOT NULL THEN {text.running(quote('sip_ns', 'part_ns'), 'symbol, _venue', text.ORDER)} END AS _b")
    rows = rows if keep_quotes else rows.where(trade)
    take = "_b IS NOT NULL AND _b.part_ns <= part_ns AND coalesce(_b.sip_ns > _a.sip_ns, true)" + (" AND _b.sip_ns <= sip_ns" if venue_not_after else "")
    take = f"coalesce({take}, false)"
    return rows.selectExpr(*ticks.columns, f"CASE WHEN {trade} THEN CASE WHEN {take} THEN _b.mid ELSE _a.mid END END AS mid_px", f"CASE WHEN {trade} THEN CASE WHEN {take} THEN 'B' WHEN _a IS NOT NULL THEN 'A' END END AS mid_from")


def point_in_time(quotes: DataFrame, instants: DataFrame, at: str = "at_ns", retention_ns: int | None = None) -> DataFrame:
    """instants (symbol, at) with the quote in force at that time (quotes at the time count); before the first quote, the first one. With retention_ns a quote older than that at the symbol's last time doesn't count."""
    q = quotes
    if retention_ns is not None:
        newest = Window.partitionBy("symbol")
        q = q.withColumn("_new", F.max("sip_ns").over(newest)).where(F.col("sip_ns") >= F.col("_new") - retention_ns).drop("_new")
    q = q.select("symbol", F.col("sip_ns").alias("_t"), F.lit(0).alias("_k"), "seq", F.struct("sip_ns", "bid_px", "ask_px").alias("_q"))
    i = instants.select("*", F.col(at).alias("_t"), F.lit(1).alias("_k"), F.lit(0).cast("long").alias("seq"))
    both = i.unionByName(q, allowMissingColumns=True)
    running = Window.partitionBy("symbol").orderBy("_t", "_k", "seq").rowsBetween(Window.unboundedPreceding, 0)
    # before the first quote the first one counts: one value for each symbol, not a look ahead from each row
    first = F.min(F.when(F.col("_k") == 0, F.struct("_t", "seq", "_q"))).over(Window.partitionBy("symbol"))
    both = both.withColumn("_found", F.coalesce(F.last("_q", ignorenulls=True).over(running), first["_q"]))
    out = both.where("_k = 1").withColumn("quote_ns", F.col("_found.sip_ns")).withColumn("bid_px", F.col("_found.bid_px")).withColumn("ask_px", F.col("_found.ask_px"))
    return out.withColumn("mid_px", (F.col("bid_px") + F.col("ask_px")) / 2).select(*instants.columns, "quote_ns", "bid_px", "ask_px", "mid_px")


def nearest(left: DataFrame, right: DataFrame, key: str, left_ts: str, right_ts: str, value: str) -> DataFrame:
    """left with the right value of least distance in time within the key; the earlier of equals."""
    r = right.select(key, F.col(right_ts).alias("_t"), F.struct(F.col(right_ts).alias("t"), F.col(value).alias("v")).alias("_r"))
    both = left.withColumn("_t", F.col(left_ts)).unionByName(r, allowMissingColumns=True).withColumn("_left", F.col("_r").isNull())
    order = Window.partitionBy(key).orderBy("_t", "_left")
    before = F.last("_r", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    # the next one is the last one in falling order: each row is looked at once
    after = F.last("_r", ignorenulls=True).over(Window.partitionBy(key).orderBy(F.desc("_t"), F.desc("_left")).rowsBetween(Window.unboundedPreceding, 0))
    both = both.withColumn("_b", before).withColumn("_a", after).where("_left")
    closer = F.col("_a").isNotNull() & (F.col("_b").isNull() | (F.col("_a.t") - F.col("_t") < F.col("_t") - F.col("_b.t")))
    pick = F.when(closer, F.col("_a")).otherwise(F.col("_b"))
    return both.select(*left.columns, pick["t"].alias("near_ts"), pick["v"].alias(value))


def prevailing(quotes: DataFrame, now: DataFrame, ages: list[int]) -> DataFrame:
    """now (symbol, now_ns) with found: an array of (bid_px, ask_px, mid_px) in force at now_ns less each age; before the first quote the first one.

    Few instants a symbol, so each is an aggregate: one pass with partial sums, no sort of the history.
    """
    q = quotes.select("symbol", "sip_ns", "seq", "bid_px", "ask_px")
    quote = F.struct("sip_ns", "seq", "bid_px", "ask_px")
    rows = now.select("symbol", "now_ns").join(q, "symbol", "left")
    at = [F.max(F.when(F.col("sip_ns") <= F.col("now_ns") - F.lit(a).cast("long"), quote)) for a in ages]
    out = rows.groupBy("symbol", "now_ns").agg(F.min(F.when(F.col("sip_ns").isNotNull(), quote)).alias("_first"), *(x.alias(f"_{k}") for k, x in enumerate(at)))
    pick = [F.coalesce(f"_{k}", "_first") for k in range(len(ages))]
    return out.select("symbol", "now_ns", F.array(*(F.struct(p["bid_px"].alias("bid_px"), p["ask_px"].alias("ask_px"), ((p["bid_px"] + p["ask_px"]) / 2).alias("mid_px")) for p in pick)).alias("found"))
