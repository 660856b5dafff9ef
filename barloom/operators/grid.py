"""Dense grids: every symbol of a phase has a row at every lattice point from the first tick of any stream to the last point no later than the last one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lattice import anchor, dense, latest_anchor
from ..schema import OPEN


def span(ticks: DataFrame) -> DataFrame:
    """One row: first and last time of all ticks."""
    return ticks.agg(F.min("sip_ns").alias("_t0"), F.max("sip_ns").alias("_t1"))


def frame_grid(ticks: DataFrame, phase_symbols: DataFrame, cadence: int, start_ns: int | None = None, end_ns: int | None = None) -> DataFrame:
    """phase_symbols with a row for each anchor. start_ns counts as the first time, end_ns as the last one.

    The times are one row from an aggregate over all ticks, so its join is a broadcast of a row.
    """
    first = F.lit(start_ns).cast("long") if start_ns is not None else F.col("_t0")
    last = F.lit(end_ns).cast("long") if end_ns is not None else F.col("_t1")
    keys = phase_symbols.crossJoin(F.broadcast(span(ticks)))  # one row on the right
    keys = dense(keys, anchor(first, cadence, F.col("offset_ns")), latest_anchor(last, cadence, F.col("offset_ns")), cadence)
    return keys.drop("_t0", "_t1")


def forward(column: str | Column, keys: tuple[str, ...], order: str = "anchor_ns") -> Column:
    """The last value so far that isn't null."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return F.last(column, ignorenulls=True).over(w)


def backward(column: str | Column, keys: tuple[str, ...], order: str = "anchor_ns") -> Column:
    """The first value from here on that isn't null: the last one in falling order, so that each row is looked at once."""
    w = Window.partitionBy(*keys).orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, 0)
    return F.last(column, ignorenulls=True).over(w)


def earliest(column: str, keys: tuple[str, ...], order: str = "anchor_ns") -> Column:
    """The first value of all that isn't null; what a forward fill lacks at its start."""
    return F.min(F.when(F.col(column).isNotNull(), F.struct(F.col(order).alias("o"), F.col(column).alias("v")))).over(Window.partitionBy(*keys))["v"]


def openings(ticks: DataFrame, symbols: DataFrame, start_ns: int | None = None, end_ns: int | None = None) -> DataFrame:
    """A control row for each symbol, of the columns of ticks: the grid begins at the first time of all ticks (or start_ns) and ends at the last (or end_ns)."""
    rows = symbols.select("symbol").distinct().crossJoin(F.broadcast(span(ticks)))  # one row on the right
    known = {"symbol": "symbol", "sip_ns": "_t0" if start_ns is None else f"{start_ns}L", "part_ns": "_t1" if end_ns is None else f"{end_ns}L", "tick_type": str(OPEN), "seq": "-1L"}
    return rows.where("_t0 IS NOT NULL" if start_ns is None else "true").selectExpr(*(f"cast({known.get(f.name, 'null')} AS {f.dataType.simpleString()}) AS {f.name}" for f in ticks.schema))


def spread_out(sparse: DataFrame, keys: tuple[str, ...], at: str, cadence: int, begin: str, end: str) -> DataFrame:
    """sparse (one row for each point where something happened) with a row for every point from begin to end; _own tells rows that were there.

    A row stands for the points up to the next one of its key. So a dense grid needs neither
    a join nor a shuffle: state is filled on few rows and then spread, by two explodes whose
    arrays don't grow with the gap.
    """
    following = f"lead({at}) OVER (PARTITION BY {', '.join(keys)} ORDER BY {at})"
    rows = sparse.selectExpr("*", f"greatest({at}, {begin}) AS _from", f"least(coalesce({following} - {cadence}L, {end}), {end}) AS _until").where("_from <= _until")
    chunk = 4096
    rows = rows.selectExpr("*", f"explode(sequence(_from, _until, {cadence * chunk}L)) AS _run")
    rows = rows.selectExpr(*(c for c in sparse.columns if c != at), f"{at} AS _was", f"explode(sequence(_run, least(_until, _run + {cadence * (chunk - 1)}L), {cadence}L)) AS {at}")
    return rows.selectExpr(*sparse.columns, f"_was = {at} AS _own")


def last_of(column: str, when: Column | None = None) -> Column:
    """Aggregate: the value of the last tick in total order for which the condition holds."""
    order = F.struct("sip_ns", "tick_type", "seq")
    value = F.col(column)
    return F.max_by(value, F.when(F.lit(True) if when is None else when, order))


def cold_start(frames: DataFrame, n: int = 15, keys: tuple[str, ...] = ("phase", "symbol")) -> DataFrame:
    """frames with cold_start: true for the first n of each phase."""
    return frames.withColumn("cold_start", F.row_number().over(Window.partitionBy(*keys).orderBy("anchor_ns")) <= n)
