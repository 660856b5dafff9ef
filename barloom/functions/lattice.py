"""Anchor arithmetic: bars end at k * cadence + offset. All times are epoch nanoseconds, as LONG."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _col(x: Column | int) -> Column:
    return x if isinstance(x, Column) else F.lit(x).cast("long")


def micros(ts: Column) -> Column:
    """Whole microseconds of nanoseconds. The division is exact: the remainder goes first."""
    return ((ts - F.pmod(ts, _col(1000))) / 1000).cast("long")


def anchor(ts: Column, cadence: int, offset: Column | int = 0) -> Column:
    """The end of the bar that holds ts: the first lattice point after it."""
    return ts - F.pmod(ts - _col(offset), _col(cadence)) + _col(cadence)


def anchor_inclusive(ts: Column, cadence: int, offset: Column | int = 0) -> Column:
    """The first lattice point at or after ts."""
    return ts + F.pmod(_col(offset) - ts, _col(cadence))


def latest_anchor(last: Column, cadence: int, offset: Column | int = 0) -> Column:
    """The last lattice point at or before a time."""
    return last - F.pmod(last - _col(offset), _col(cadence))


def points(first: Column, last: Column, cadence: int, chunk: int = 4096) -> tuple[Column, Column]:
    """Two columns to explode one after the other for the lattice points from first to last: starts of runs, then a run (as a function of the start, named _run). Neither array grows with the product."""
    runs = F.when(first <= last, F.sequence(first, last, _col(cadence * chunk)))
    run = F.sequence(F.col("_run"), F.least(last, F.col("_run") + _col(cadence * (chunk - 1))), _col(cadence))
    return runs, run


def dense(keys: DataFrame, first: Column, last: Column, cadence: int, name: str = "anchor_ns") -> DataFrame:
    """keys with one row for each lattice point from first to last."""
    runs, run = points(F.col("_first"), F.col("_last"), cadence)
    return keys.withColumn("_first", first).withColumn("_last", last).withColumn("_run", F.explode(runs)).withColumn(name, F.explode(run)).drop("_first", "_last", "_run")


def half_even_ticks(px: Column, per_unit: float = 10000.0) -> Column:
    return F.rint(px * F.lit(per_unit)).cast("int")


def trading_open(ts: Column, tz: str = "America/New_York", open_: str = "09:30:00", seconds: int = 23400) -> Column:
    """Nanoseconds of a session's opening: that of the local day if ts is no later than its close, else ts cut to the second; 0 for small test times."""
    local = F.from_utc_timestamp(F.timestamp_micros(micros(ts)), tz)
    opened = F.unix_micros(F.to_utc_timestamp(F.to_timestamp(F.concat(F.date_format(local, "yyyy-MM-dd"), F.lit(" " + open_))), tz)) * 1000
    cut = ts - F.pmod(ts, F.lit(1_000_000_000).cast("long"))
    return F.when(ts < 10**18, F.lit(0).cast("long")).when(ts <= opened + F.lit(seconds).cast("long") * 1_000_000_000, opened).otherwise(cut)


def clock_seconds(text: str) -> int:
    """Seconds of the day of HH:MM or HH:MM:SS."""
    m = re.fullmatch(r"(\d{1,2}):(\d{1,2})(?::(\d{1,2}))?", text.strip())
    if not m:
        raise ValueError(f"not a time of day: {text!r}")
    h, mi, s = (int(x or 0) for x in m.groups())
    if h > 23 or mi > 59 or s > 59:
        raise ValueError(f"not a time of day: {text!r}")
    return h * 3600 + mi * 60 + s


def in_session(ts: Column, start: str = "09:30:00", end: str = "16:00:00", tz: str = "America/New_York") -> Column:
    """Monday to Friday between two local times of day, both included."""
    local = F.from_utc_timestamp(F.timestamp_micros(micros(ts)), tz)
    second = F.hour(local) * 3600 + F.minute(local) * 60 + F.second(local)
    whole = F.pmod(ts, F.lit(1_000_000_000).cast("long")) == 0
    last = clock_seconds(end)
    return F.dayofweek(local).between(2, 6) & (second >= clock_seconds(start)) & ((second < last) | ((second == last) & whole))


_UNITS = {"ns": 1, "us": 10**3, "µs": 10**3, "ms": 10**6, "s": 10**9, "m": 60 * 10**9, "h": 3600 * 10**9}


def duration_ns(text: str) -> int:
    """Nanoseconds of `1h30m`, `100ms` or a plain number: of magnitude under 1e11 it means seconds, else nanoseconds."""
    t = text.strip()
    if re.fullmatch(r"[+-]?\d+", t):
        n = int(t)
        return n * 10**9 if abs(n) < 10**11 else n
    m = re.fullmatch(r"([+-]?)((?:\d+(?:\.\d+)?(?:ns|us|µs|ms|s|m|h))+)", t)
    if not m:
        raise ValueError(f"not a duration: {text!r}")
    total = sum(float(n) * _UNITS[u] for n, u in re.findall(r"(\d+(?:\.\d+)?)(ns|us|µs|ms|s|m|h)", m.group(2)))
    return int(-total if m.group(1) == "-" else total)


def day_of(number: Column) -> Column:
    """Date of an integer yyyymmdd."""
    return F.to_date(number.cast("string"), "yyyyMMdd")
