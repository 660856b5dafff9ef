"""Sides of trades."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..schema import AT_MID, QUOTE, TRADE
from .quality import in_order, quote_valid, trade_valid


def trade_side(rows: DataFrame, order: str = text.ORDER) -> DataFrame:
    """is_buy of trades with mid_px: over the mid buys, under it sells; else by the price before; else as the trade before; buys at first.

    mid_px must be null, not NaN, where there is none. Rows that are no trades stay, without a side.
    order: the order of a symbol's ticks, or one that begins with what rises with it.
    """
    trade = f"CASE WHEN tick_type = {TRADE} THEN {{}} END"
    before = text.running(trade.format("price"), "symbol", order, text.EARLIER)
    out = rows.selectExpr("*", f"{before} AS _p")
    sign = "CASE WHEN price > mid_px THEN true WHEN price < mid_px THEN false WHEN price > _p THEN true WHEN price < _p THEN false END"
    side = f"coalesce({text.running(trade.format(sign), 'symbol', order)}, true)"
    return out.selectExpr(*rows.columns, f"{trade.format(side)} AS is_buy")


def lit_flow(ticks: DataFrame) -> DataFrame:
    """Lit sized trades with lit_side 1 (over the mid in force), -1 (under it) or 0; those before any quote or at the mid have 0."""
    running = in_order().rowsBetween(Window.unboundedPreceding, 0)
    rows = ticks.where(quote_valid(strict_cross=True) | trade_valid(sized=True))
    mid = F.last(F.when(F.col("tick_type") == QUOTE, (F.col("bid_px") + F.col("ask_px")) / 2), ignorenulls=True).over(running)
    rows = rows.withColumn("live_mid", mid).where(F.col("tick_type") != QUOTE)
    side = F.when(F.coalesce(F.col("is_dark"), F.lit(False)), 0).when(F.col("price") < F.col("live_mid") - AT_MID, -1).when(F.col("price") > F.col("live_mid") + AT_MID, 1).otherwise(0)
    return rows.withColumn("lit_side", side)
