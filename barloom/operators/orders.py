"""Resting orders against the quotes and trades of their lifetime."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import QUOTE
from .quality import accepted


def watch(orders: DataFrame, ticks: DataFrame, slice_ns: int = 3_600_000_000_000) -> DataFrame:
    """orders (order_id, symbol, limit_px, placed_ns, ended_ns) with extremes of bid, ask and mid, the first time that the bid was over the limit, and trades at or under it.

    A range join as an equi-join: an order has a row for each slice of time that it touches,
    ticks have one slice, so both are dealt by symbol and slice and a hot symbol by its time.
    """
    slots = F.sequence((F.col("placed_ns") / slice_ns).cast("long"), (F.col("ended_ns") / slice_ns).cast("long"))
    placed = orders.select("order_id", "symbol", "limit_px", "placed_ns", "ended_ns", F.explode(slots).alias("_slice"))
    # an order sees all ticks of an instant or none, so the first of equal trades stands for them in every order
    equal = Window.partitionBy("symbol", "sip_ns", "tick_type", "price", "size").orderBy("seq")
    each = accepted(ticks).withColumn("_slice", (F.col("sip_ns") / slice_ns).cast("long")).withColumn("_first", F.row_number().over(equal) == 1)
    each = each.select("symbol", "_slice", "sip_ns", "tick_type", "bid_px", "ask_px", "price", "_first")
    hit = placed.join(each, ["symbol", "_slice"]).where((F.col("sip_ns") >= F.col("placed_ns")) & (F.col("sip_ns") <= F.col("ended_ns")))
    quote = F.col("tick_type") == QUOTE
    mid = (F.col("bid_px") + F.col("ask_px")) / 2
    under = ~quote & (F.col("price") <= F.col("limit_px"))
    q = lambda c: F.when(quote, c)
    sums = hit.groupBy("order_id").agg(
        *(f(q(c)).alias(f"{n}_{name}") for name, c in (("bid", F.col("bid_px")), ("ask", F.col("ask_px")), ("mid", mid)) for n, f in (("max", F.max), ("min", F.min))),
        F.min(F.when(quote & (F.col("bid_px") > F.col("limit_px")), F.col("sip_ns"))).alias("_jump"),
        F.count_if(under).alias("trades_at_limit"),
        F.count_if(under & F.col("_first")).alias("distinct_trades_at_limit"),
    )
    out = orders.join(sums, "order_id", "left")
    return out.select("order_id", "symbol", "limit_px", *(f"{n}_{c}" for c in ("bid", "ask", "mid") for n in ("max", "min")), ((F.col("_jump") - F.col("placed_ns")) / 1e9).alias("first_jump_s"), F.coalesce("trades_at_limit", F.lit(0)).alias("trades_at_limit"), F.coalesce("distinct_trades_at_limit", F.lit(0)).alias("distinct_trades_at_limit"))
