"""Top of book: the last row of each symbol."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import QUOTE, TRADE
from .grid import last_of
from .quality import accepted, positive


def snapshot(ticks: DataFrame, raw: bool = False) -> DataFrame:
    """One row for each symbol; a quote doesn't erase the last trade nor a trade the quote. sip_ns is the greatest time, conditions the number of trades.

    Invalid and repeated quotes don't count, unless raw: then every tick does, as it arrived.
    """
    rows = ticks if raw else accepted(ticks)
    quote, trade = F.col("tick_type") == QUOTE, F.col("tick_type") == TRADE
    out = rows.groupBy("symbol").agg(
        F.max("sip_ns").alias("sip_ns"),
        *(last_of(c, quote).alias(c) for c in ("bid_px", "ask_px", "bid_sz", "ask_sz")),
        last_of("price", trade).alias("last_trade_px"),
        last_of("size", trade).alias("last_trade_sz"),
        F.count_if(trade).alias("conditions"),
    )
    two = positive("bid_px") & positive("ask_px")
    return out.select("*", F.when(two, (F.col("bid_px") + F.col("ask_px")) / 2).alias("mid_px"), F.when(two, F.col("ask_px") - F.col("bid_px")).alias("spread_px"))
