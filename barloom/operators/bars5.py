"""The compact bar: returns over 1, 5 and 15 bars, volume and spread, on each phase's lattice.

Ticks are first reduced to one row for each symbol and bar, with partial aggregation; only
these rows are filled, so windows run over bars and not over ticks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..schema import FEATURES_5, NO_PRICE, NO_SPREAD_BPS, OPEN
from .grid import openings, spread_out

KEYS = ("phase", "symbol")


def reduced(ticks: DataFrame, phase_symbols: DataFrame, cadence: int) -> DataFrame:
    """One row for each phase, symbol and bar with ticks: last price, bid and ask, volume; and _first and _last of the grid on the row that opens it.

    Ticks may hold OPEN rows (see grid.openings); such a row opens the first bar of each phase.
    """
    rows = ticks.join(phase_symbols.select("phase", "offset_ns", "symbol"), "symbol")
    rows = rows.selectExpr("*", f"{text.anchor('sip_ns', cadence, 'offset_ns')} AS anchor_ns")
    opens = f"tick_type = {OPEN}"
    last = lambda c: F.expr(f"{text.last_of(c, f'NOT {opens} AND {text.positive(c)}')}")
    return rows.groupBy("phase", "symbol", "anchor_ns").agg(
        last("price").alias("_trade"),
        last("bid_px").alias("_bid"),
        last("ask_px").alias("_ask"),
        F.expr(f"sum(CASE WHEN NOT {opens} AND {text.positive('size')} THEN size END) AS _vol"),
        F.expr(f"max(CASE WHEN {opens} THEN anchor_ns END) AS _first"),
        F.expr(f"max(CASE WHEN {opens} THEN {text.latest_anchor('part_ns', cadence, 'offset_ns')} END) AS _last"),
    )


#: The last trade; before any the mid, or the side that there is; else a fixed price.
BAR_PRICE = f"coalesce(_trade, (_bid + _ask) / 2, _bid, _ask, {NO_PRICE}D)"


def states(ticks: DataFrame, phase_symbols: DataFrame, cadence: int, start_ns: int | None = None, end_ns: int | None = None) -> DataFrame:
    """The dense grid with bar price, volume, and bid and ask in force. Ticks before start_ns count for the state only."""
    ticks = ticks.select("symbol", "sip_ns", "part_ns", "tick_type", "seq", "bid_px", "ask_px", "price", "size")
    rows = reduced(ticks.unionAll(openings(ticks, phase_symbols, start_ns, end_ns)), phase_symbols, cadence)
    keys = ", ".join(KEYS)
    state = rows.selectExpr(*KEYS, "anchor_ns", "_vol", *(f"{text.running(c, keys, 'anchor_ns')} AS {c}" for c in ("_trade", "_bid", "_ask")), *(f"max({c}) {text.over(keys)} AS {c}" for c in ("_first", "_last")))
    rows = spread_out(state, KEYS, "anchor_ns", cadence, "_first", "_last")
    return rows.selectExpr(*KEYS, "anchor_ns", f"{BAR_PRICE} AS price", "coalesce(CASE WHEN _own THEN _vol END, 0D) AS vol_1s", "_bid AS bid_px", "_ask AS ask_px")


def log_return(bars: int) -> str:
    """Against the bar so many before; before there are so many, against the first."""
    keys = ", ".join(KEYS)
    base = f"coalesce(lag(price, {bars}) OVER (PARTITION BY {keys} ORDER BY anchor_ns), first(price) {text.over(keys, 'anchor_ns')})"
    return f"CASE WHEN price = {base} THEN 0D ELSE ln(price / {base}) END"


def bars5(ticks: DataFrame, phase_symbols: DataFrame, cadence: int, start_ns: int | None = None, end_ns: int | None = None) -> DataFrame:
    """phase, symbol, anchor_ns and the five features, in order."""
    rows = states(ticks, phase_symbols, cadence, start_ns, end_ns)
    spread = f"CASE WHEN bid_px IS NOT NULL AND ask_px IS NOT NULL THEN (ask_px - bid_px) / price * 1e4D ELSE {NO_SPREAD_BPS}D END"
    made = dict(zip(FEATURES_5, (log_return(1), log_return(5), log_return(15), "vol_1s", spread)))
    return rows.selectExpr(*KEYS, "anchor_ns", *(f"{made[c]} AS {c}" for c in FEATURES_5))
