"""The full frame of 44 features.

Slots 0 to 35 describe the whole-cadence bar [F - cadence, F), the same for all phases;
slots 36 to 43 the state at the phase's anchor F + offset, ticks at that time included. A
bar is computed once and joined to the phases by F. All of it hangs on one partitioning by
symbol.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..schema import FEATURES_44, OPEN, QUOTE, TRADE
from .asof import matched_quote
from .classify import trade_side
from .grid import openings, spread_out
from .quality import quote_valid, trade_valid, without_repeats

BAR = ("symbol", "bar_ns")
IS_QUOTE, IS_TRADE, IS_OPEN = (f"tick_type = {k}" for k in (QUOTE, TRADE, OPEN))


def by_symbol(ticks: DataFrame, symbols: DataFrame, start_ns: int | None = None, end_ns: int | None = None) -> DataFrame:
    """Accepted ticks of the symbols with OPEN rows, in one partitioning by symbol, which all that follows keeps.

    The number of partitions is given, as windows cost more than their bytes tell: Spark would
    put small shuffles into few tasks.
    """
    known = symbols.select("symbol").distinct()
    rows = ticks.where(quote_valid() | trade_valid()).join(known, "symbol", "left_semi").select(*ticks.columns)
    rows = rows.unionAll(openings(ticks, known, start_ns, end_ns))
    return without_repeats(rows.repartition(int(ticks.sparkSession.conf.get("spark.sql.shuffle.partitions")), "symbol"))


def enriched(accepted: DataFrame, lag_ns: int = 1_000_000, cadence: int = 1_000_000_000, sides: list[str] | None = None, start_ns: int | None = None) -> DataFrame:
    """Accepted quotes, and trades with mid_px and is_buy; bar_ns is the end of the bar of each. OPEN rows pass; theirs is the bar before the first.

    sides: those whose venues are counted. The last order begins with the bar, which rises with
    time, so that the sums by bar that follow need no further sort.
    """
    rows = matched_quote(accepted, lag_ns, keep_quotes=True).drop("mid_from")
    for side in sides or []:
        rows = venues_at_best(rows, side, start_ns)
    rows = rows.selectExpr("*", f"{text.anchor('sip_ns', cadence)} - CASE WHEN {IS_OPEN} THEN {cadence}L ELSE 0L END AS bar_ns")
    return trade_side(rows, f"bar_ns, {text.ORDER}")


def flow() -> list[str]:
    """Aggregates: volumes, notionals, counts and mid deltas by side, dark notional."""
    buy, sell = f"{IS_TRADE} AND is_buy", f"{IS_TRADE} AND NOT is_buy"
    total = lambda cond, x: f"coalesce(sum(CASE WHEN {cond} THEN {x} END), 0D)"
    dark = "coalesce(is_dark, false)"
    return [
        f"{total(buy, 'size')} AS buy_volume",
        f"{total(sell, 'size')} AS sell_volume",
        f"{total(buy, 'price * size')} AS buy_notional",
        f"{total(sell, 'price * size')} AS sell_notional",
        f"cast(count_if({buy}) AS double) AS buy_trade_count",
        f"cast(count_if({sell}) AS double) AS sell_trade_count",
        f"{total(f'{buy} AND mid_px > 0', 'size * (price - mid_px)')} AS buy_mid_delta_notional",
        f"{total(f'{sell} AND mid_px > 0', 'size * (mid_px - price)')} AS sell_mid_delta_notional",
        f"{total(f'{sell} AND {dark}', 'price * size')} AS dark_bid_trade_primitive",
        f"{total(f'{buy} AND {dark}', 'price * size')} AS dark_ask_trade_primitive",
    ]


def centred(rows: DataFrame) -> DataFrame:
    """rows with the weight _w of their bar's trades and their weighted mean price _m: the first pass of the moments."""
    whole = lambda x: f"sum(CASE WHEN {IS_TRADE} THEN {x} END) {text.over('symbol, bar_ns')}"
    return rows.selectExpr("*", f"{whole('size')} AS _w", f"{whole('size * price')} / nullif({whole('size')}, 0D) AS _m")


def moments() -> list[str]:
    """Aggregates of centred rows: weight, and the second and third weighted sums."""
    d = f"CASE WHEN {IS_TRADE} AND _w > 0 THEN price - _m END"
    return ["max(_w) AS _w", f"sum(size * power({d}, 2)) AS _2", f"sum(size * power({d}, 3)) AS _3"]


#: Size-weighted population deviation and skew of trade prices; null without a trade, 0 without weight.
STD = "CASE WHEN _w > 0 THEN sqrt(_2 / _w) WHEN _w IS NOT NULL THEN 0D END"
SKEW = f"CASE WHEN _w > 0 AND {STD} > 1e-9D THEN _3 / (_w * power({STD}, 3)) WHEN {STD} IS NOT NULL THEN 0D END"


def extremes(cadence: int) -> list[str]:
    """Aggregates: highs and lows, and how long into the bar the first ticks were that reached them."""
    price, quote = (lambda c: f"CASE WHEN {IS_TRADE} THEN {c} END"), (lambda c: f"CASE WHEN {IS_QUOTE} THEN {c} END")

    def first_at(column: str, cond: str, sign: str) -> str:
        # of the ticks with the extreme value the first in order
        return f"cast(min(CASE WHEN {cond} THEN struct({sign}{column} AS v, sip_ns - (bar_ns - {cadence}L) AS t, seq) END).t AS double)"

    sides = [f"{f}({quote(f'{side}_px')}) AS {name}_{side}_px" for side in ("bid", "ask") for name, f in (("high", "max"), ("low", "min"))]
    return [
        f"max({price('price')}) AS high_px", f"min({price('price')}) AS low_px", *sides,
        f"{first_at('price', IS_TRADE, '-')} AS high_px_ns", f"{first_at('price', IS_TRADE, '')} AS low_px_ns",
        f"{first_at('ask_px', IS_QUOTE, '-')} AS high_ask_px_ns", f"{first_at('ask_px', IS_QUOTE, '')} AS low_ask_px_ns",
    ]


QUOTE_STATE = ("sip_ns", "seq", "bid_px", "ask_px", "bid_sz", "ask_sz")


def last_values(*more: str) -> list[str]:
    """Aggregates: what of the state a bar's ticks change, how many there are, and the end of the grid if one begins here. The last quote is one aggregate, so that its fields are of one tick."""
    return [
        f"max(CASE WHEN {IS_QUOTE} THEN struct({', '.join((*QUOTE_STATE, *more))}) END) AS _quote",
        f"{text.last_of('price', IS_TRADE)} AS _trade_px",
        f"count_if({IS_QUOTE}) AS _quotes",
        f"count_if({IS_TRADE}) AS _trades",
        f"max(CASE WHEN {IS_OPEN} THEN part_ns END) AS _last",
    ]


def aggregates(texts: list[str]) -> list[Column]:
    return [F.expr(t) for t in texts]


def gathered(rows: DataFrame, cadence: int, more: tuple[str, ...] = ()) -> DataFrame:
    """One row for each bar with ticks, of all aggregates, in one pass over the rows."""
    out = centred(rows).groupBy(*BAR).agg(*aggregates([*flow(), *moments(), *extremes(cadence), *last_values(*more)]))
    return out.selectExpr(*(c for c in out.columns if c not in ("_w", "_2", "_3")), f"{STD} AS trade_vol_std_px", f"{SKEW} AS trade_vol_skew")


def filled(rows: DataFrame, at: str, keys: str = "symbol", more: tuple[str, ...] = ()) -> DataFrame:
    """The state in force and running counts at each row, and _first and _last of the grid."""
    out = rows.selectExpr(
        *(c for c in rows.columns if c not in ("_quote", "_trade_px", "_last")),
        *(f"{text.running(c, keys, at)} AS {c}" for c in ("_quote", "_trade_px")),
        *(f"cast(sum({c}) {text.over(keys, at)} AS double) AS {b}" for c, b in (("_quotes", "quote_idx"), ("_trades", "trade_idx"))),
        f"max(CASE WHEN _last IS NOT NULL THEN {at} END) {text.over(keys)} AS _first", f"max(_last) {text.over(keys)} AS _last",
    )
    return out.selectExpr(*(c for c in out.columns if c != "_quote"), *(f"_quote.{c} AS _{c}" for c in (*QUOTE_STATE, *more)))


def venues_at_best(rows: DataFrame, side: str, start_ns: int | None = None) -> DataFrame:
    """rows with bid_venues (or ask_venues): how many venues' latest price of the side equals this quote's.

    Each quote opens its price at its venue and ends the venue's price before; the running sum
    of these at one price is the number of venues that hold it. So no venue meets a bar, and a
    row costs the same whatever the number of venues. Venues count from start_ns on.
    """
    own = f"{IS_QUOTE} AND {side}_exch BETWEEN 0 AND 255" + (f" AND sip_ns >= {start_ns}L" if start_ns is not None else "")
    out = rows.selectExpr("*", f"CASE WHEN {own} THEN {side}_exch END AS _v")
    out = out.selectExpr("*", f"CASE WHEN _v IS NOT NULL THEN {text.running(f'{side}_px', 'symbol, _v', text.ORDER, text.EARLIER)} END AS _was")
    opened = f"struct(CASE WHEN {IS_QUOTE} THEN {side}_px END AS px, CASE WHEN _v IS NOT NULL THEN 1 ELSE 0 END AS d)"
    ended = "struct(_was AS px, -1 AS d)"
    # a price that stays neither opens nor ends
    events = f"CASE WHEN _was IS NULL THEN array({opened}) WHEN _was = {side}_px THEN array(struct({side}_px AS px, 0 AS d)) ELSE array({ended}, {opened}) END"
    out = out.selectExpr(*rows.columns, f"inline({events}) AS (_px, _d)")
    held = f"cast(sum(_d) {text.over('symbol, _px', f'{text.ORDER}, _d')} AS double)"
    return out.selectExpr(*rows.columns, "_d", f"{held} AS {side}_venues").where("_d >= 0").drop("_d")


ZERO = FEATURES_44[:8] + FEATURES_44[10:12]
VENUES = dict(zip(FEATURES_44[14:16], ("bid", "ask")))


def whole_bars(ticks: DataFrame, symbols: DataFrame, cadence: int, lag_ns: int = 1_000_000, start_ns: int | None = None, end_ns: int | None = None, features: list[str] = FEATURES_44[:36]) -> DataFrame:
    """Slots 0 to 35 (or some of them) of the dense grid of whole-cadence bars. The grid begins one bar early, for anchors before the first whole one."""
    return bars_of(by_symbol(ticks, symbols, start_ns, end_ns), cadence, lag_ns, start_ns, features)


def bars_of(accepted: DataFrame, cadence: int, lag_ns: int, start_ns: int | None, features: list[str]) -> DataFrame:
    sides = [side for name, side in VENUES.items() if name in features]
    rows = enriched(accepted, lag_ns, cadence, sides, start_ns)
    more = tuple(f"{side}_venues" for side in sides)
    state = filled(gathered(rows, cadence, more), "bar_ns", more=more)
    out = spread_out(state, ("symbol",), "bar_ns", cadence, "_first", text.latest_anchor("_last", cadence))
    slots = {c: f"CASE WHEN _own THEN {c} END" for c in (*FEATURES_44[:8], *FEATURES_44[10:12], *FEATURES_44[16:22], *FEATURES_44[28:34])}
    slots |= dict.fromkeys(("bid_quote_count", "ask_quote_count", "nbbo_quote_rate_primitive"), "CASE WHEN _own THEN cast(_quotes AS double) ELSE 0D END")
    slots |= {"nbbo_staleness_ms_primitive": "coalesce((bar_ns - _sip_ns) / 1e6D, 0D)"} | {name: f"_{side}_venues" for name, side in VENUES.items()}
    slots |= {f"last_{c}": f"_{c}" for c in QUOTE_STATE[2:]} | {"last_trade_px": "_trade_px", "sip_timestamp": "cast(_sip_ns AS double)", "quote_idx": "quote_idx", "trade_idx": "trade_idx"}
    slots |= {c: f"coalesce({slots[c]}, 0D)" for c in ZERO} | {c: f"coalesce({slots[c]}, -1D)" for c in FEATURES_44[30:34]}
    return out.selectExpr("symbol", "bar_ns", *(f"{slots[c]} AS {c}" for c in features))


def terminal(ticks: DataFrame, phase_symbols: DataFrame, cadence: int, start_ns: int | None = None, end_ns: int | None = None) -> DataFrame:
    """Slots 36 to 43 at each phase's anchors, ticks at the anchor included."""
    return terminal_of(by_symbol(ticks, phase_symbols, start_ns, end_ns), phase_symbols, cadence)


def terminal_of(accepted: DataFrame, phase_symbols: DataFrame, cadence: int) -> DataFrame:
    keys = ("phase", "symbol", "offset_ns")
    each = accepted.join(phase_symbols.select(*keys), "symbol")
    at = f"CASE WHEN {IS_OPEN} THEN {text.anchor('sip_ns', cadence, 'offset_ns')} ELSE {text.anchor_inclusive('sip_ns', cadence, 'offset_ns')} END"
    state = filled(each.selectExpr("*", f"{at} AS anchor_ns").groupBy(*keys, "anchor_ns").agg(*aggregates(last_values())), "anchor_ns", ", ".join(keys))
    state = spread_out(state, keys, "anchor_ns", cadence, "_first", text.latest_anchor("_last", cadence, "offset_ns"))
    slots = dict(zip(FEATURES_44[36:], (*(f"_{c}" for c in QUOTE_STATE[2:]), "_trade_px", "cast(_sip_ns AS double)", "quote_idx", "trade_idx")))
    return state.selectExpr(*keys, "anchor_ns", *(f"{x} AS {c}" for c, x in slots.items()))


def frame44(ticks: DataFrame, phase_symbols: DataFrame, cadence: int, lag_ns: int = 1_000_000, start_ns: int | None = None, end_ns: int | None = None) -> DataFrame:
    """phase, symbol, anchor_ns and the 44 features. Null stands for what isn't known yet; as_nan() makes it NaN."""
    rows = by_symbol(ticks, phase_symbols, start_ns, end_ns)
    state = terminal_of(rows, phase_symbols, cadence).selectExpr("*", "anchor_ns - offset_ns AS bar_ns")
    bars = bars_of(rows, cadence, lag_ns, start_ns, FEATURES_44[:36])
    return state.join(bars, list(BAR), "left").select("phase", "symbol", "anchor_ns", *FEATURES_44)


def as_nan(frames: DataFrame) -> DataFrame:
    """Null features as NaN, for readers that expect it."""
    return frames.select(*(F.coalesce(F.col(c), F.lit(float("nan"))).alias(c) if c in FEATURES_44 else F.col(c) for c in frames.columns))
