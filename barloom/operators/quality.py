"""Validity, duplicates, universe and order of ticks. One partitioning by symbol serves all windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions import text
from ..schema import QUOTE, TRADE

#: A universe up to this many symbols is broadcast.
BROADCAST_ROWS = 200_000


def positive(c: str | Column) -> Column:
    """c > 0 and a number: Spark holds NaN to be the largest."""
    c = F.col(c) if isinstance(c, str) else c
    return (c > 0) & ~F.isnan(c)


def in_order(*keys: str) -> WindowSpec:
    """A symbol's ticks in total order: time, quotes before trades, arrival."""
    return Window.partitionBy(*(keys or ("symbol",))).orderBy("sip_ns", "tick_type", "seq")


def merged(*streams: DataFrame) -> DataFrame:
    """Streams as one; order is a matter of the windows that follow."""
    out = streams[0]
    for s in streams[1:]:
        out = out.unionByName(s, allowMissingColumns=True)
    return out


def globally_ordered(ticks: DataFrame, by_symbol: bool = True) -> DataFrame:
    """Range-partitioned total order (time, type, symbol, arrival)."""
    return ticks.orderBy("sip_ns", "tick_type", *(["symbol"] if by_symbol else []), "seq")


def first_ticks(ticks: DataFrame, n: int) -> DataFrame:
    """The first n ticks in total order."""
    return globally_ordered(ticks).limit(n)


def in_universe(ticks: DataFrame, universe: DataFrame, rows: int | None = None) -> DataFrame:
    """Ticks of the universe's symbols; broadcast if its size is known to be small."""
    small = F.broadcast(universe) if rows is not None and rows <= BROADCAST_ROWS else universe
    return ticks.join(small.select("symbol"), "symbol", "left_semi")


def quote_valid(strict_cross: bool = False) -> Column:
    """Both sides over zero; with strict_cross bid over zero and not over ask (locked is allowed)."""
    if strict_cross:
        return (F.col("tick_type") == QUOTE) & positive("bid_px") & (F.col("ask_px") >= F.col("bid_px")) & ~F.isnan("ask_px")
    return (F.col("tick_type") == QUOTE) & positive("bid_px") & positive("ask_px")


def trade_valid(sized: bool = False) -> Column:
    ok = (F.col("tick_type") == TRADE) & positive("price")
    return ok & positive("size") if sized else ok


def same(column: str, before: Column) -> Column:
    """Equal numbers; NaN equals nothing."""
    return F.coalesce((F.col(column) == before) & ~F.isnan(column), F.lit(False))


def dedup_quotes(ticks: DataFrame, keys: tuple[str, ...] = ("symbol",), keep_flag: bool = False) -> DataFrame:
    """Valid quotes that differ from the valid quote before in price or size of a side.

    The quote before is as good as the last accepted one: what was dropped equals it.
    """
    w = in_order(*keys)
    columns = ("bid_px", "ask_px", "bid_sz", "ask_sz")
    quotes = ticks.where(quote_valid())
    repeat = F.lit(True)
    for c in columns:
        repeat = repeat & same(c, F.lag(c).over(w))
    out = quotes.withColumn("_repeat", repeat)
    return out if keep_flag else out.where(~F.col("_repeat")).drop("_repeat")


def dropped_quotes(ticks: DataFrame) -> DataFrame:
    """symbol, valid quotes, dropped repeats."""
    return dedup_quotes(ticks, keep_flag=True).groupBy("symbol").agg(F.count(F.lit(1)).alias("valid"), F.count_if("_repeat").alias("dropped"))


def dedup_micro(ticks: DataFrame) -> DataFrame:
    """Valid quotes whose bid, ask or bid venue differs from the one before; sizes don't matter."""
    w = in_order()
    repeat = same("bid_px", F.lag("bid_px").over(w)) & same("ask_px", F.lag("ask_px").over(w)) & F.coalesce(F.col("bid_exch") == F.lag("bid_exch").over(w), F.lit(False))
    return ticks.where(quote_valid()).withColumn("_repeat", repeat).where(~F.col("_repeat")).drop("_repeat")


def without_repeats(rows: DataFrame, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """rows (valid quotes among others) without quotes that repeat the quote before: one window over both streams, no union."""
    columns = ("bid_px", "ask_px", "bid_sz", "ask_sz")
    before = text.running(f"CASE WHEN tick_type = {QUOTE} THEN struct({', '.join(columns)}) END", ", ".join(keys), text.ORDER, text.EARLIER)
    repeat = " AND ".join(text.same(c, f"_before.{c}") for c in columns)
    return rows.selectExpr("*", f"{before} AS _before").where(f"NOT (tick_type = {QUOTE} AND {repeat})").drop("_before")


def accepted(ticks: DataFrame, sized: bool = False) -> DataFrame:
    """Deduplicated valid quotes and valid trades."""
    return without_repeats(ticks.where(quote_valid() | trade_valid(sized)))


def derived(ticks: DataFrame) -> DataFrame:
    """Mid, spread and notional; mid and spread only of two-sided quotes."""
    two = quote_valid()
    return ticks.select("*", F.when(two, (F.col("bid_px") + F.col("ask_px")) / 2).alias("mid_px"), F.when(two, F.col("ask_px") - F.col("bid_px")).alias("spread_px"), F.when(trade_valid(), F.col("price") * F.col("size")).alias("notional"))
