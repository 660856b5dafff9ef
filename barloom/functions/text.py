"""SQL text of windows, anchors and order, for plans of many columns: one expression string is one call to the JVM."""

from __future__ import annotations

#: A symbol's ticks in total order: time, quotes before trades, arrival.
ORDER = "sip_ns, tick_type, seq"
SO_FAR, EARLIER = "CURRENT ROW", "1 PRECEDING"


def over(keys: str, order: str | None = None, upto: str = SO_FAR) -> str:
    """A window: of the whole partition, or with an order of the rows up to this one or up to the one before."""
    return f"OVER (PARTITION BY {keys}" + (f" ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND {upto})" if order else ")")


def running(value: str, keys: str, order: str, upto: str = SO_FAR) -> str:
    """The last value that isn't null."""
    return f"last({value}, true) {over(keys, order, upto)}"


def anchor(ts: str, cadence: int, offset: str = "0L") -> str:
    """The end of the bar that holds ts: the first lattice point after it."""
    return f"{ts} - pmod({ts} - {offset}, {cadence}L) + {cadence}L"


def anchor_inclusive(ts: str, cadence: int, offset: str = "0L") -> str:
    return f"{ts} + pmod({offset} - {ts}, {cadence}L)"


def latest_anchor(ts: str, cadence: int, offset: str = "0L") -> str:
    return f"{ts} - pmod({ts} - {offset}, {cadence}L)"


def last_of(value: str, when: str = "true") -> str:
    """Aggregate: the value of the last tick in total order for which the condition holds."""
    return f"max_by({value}, CASE WHEN {when} THEN struct({ORDER}) END)"


def positive(c: str) -> str:
    """c > 0 and a number: Spark holds NaN to be the largest."""
    return f"({c} > 0 AND NOT isnan({c}))"


def same(a: str, b: str) -> str:
    """Equal numbers; NaN equals nothing."""
    return f"coalesce({a} = {b} AND NOT isnan({a}), false)"
