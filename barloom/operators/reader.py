"""Reads of frames: cursors, one anchor, histories, windows with their backfill, and chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lattice import anchor, latest_anchor
from ..schema import FEATURES_44
from .bars5 import bars5
from .bars44 import frame44
from .grid import backward, cold_start


class LaggedAnchorError(ValueError):
    """The frame asked for is older than what is retained."""


def begin_all(frames: DataFrame, live: bool = False) -> DataFrame:
    """phase, symbol, cursor_ns: where reading starts: the first anchor, or the phase's latest if live."""
    ends = frames.groupBy("phase").agg((F.max if live else F.min)("anchor_ns").alias("cursor_ns"))
    return frames.select("phase", "symbol").distinct().join(F.broadcast(ends), "phase")


def latest_phase_anchor(last_ns: Column, cadence: int, offset: int) -> Column:
    return latest_anchor(last_ns, cadence, offset)


def load(frames: DataFrame, cursors: DataFrame) -> DataFrame:
    """The rows at each cursor, and cursors without a row (found is false)."""
    at = cursors.withColumnRenamed("cursor_ns", "anchor_ns")
    return at.join(frames.withColumn("found", F.lit(True)), ["phase", "symbol", "anchor_ns"], "left").withColumn("found", F.coalesce("found", F.lit(False)))


def advance(cursors: DataFrame, cadence: int) -> DataFrame:
    return cursors.withColumn("cursor_ns", F.col("cursor_ns") + cadence)


def progress(cursors: DataFrame) -> DataFrame:
    """What a consumer has read: the least cursor."""
    return cursors.agg(F.min("cursor_ns").alias("last_read_anchor_ns"))


def retained(frames: DataFrame, cadence: int, max_frames: int) -> DataFrame:
    """Frames that a ring of so many would still hold."""
    newest = frames.groupBy("phase").agg(F.max("anchor_ns").alias("_new"))
    return frames.join(F.broadcast(newest), "phase").where(F.col("anchor_ns") > F.col("_new") - F.lit(cadence * max_frames).cast("long")).drop("_new")


def realigned(cursors: DataFrame, frames: DataFrame, cadence: int, max_frames: int) -> DataFrame:
    """Cursors with lagged, true if older than what is retained, and those moved to the latest anchor."""
    newest = frames.groupBy("phase").agg(F.max("anchor_ns").alias("_new"))
    late = F.col("cursor_ns") < F.col("_new") - F.lit(cadence * (max_frames - 1)).cast("long")
    return cursors.join(F.broadcast(newest), "phase").withColumn("lagged", late).withColumn("cursor_ns", F.when(late, F.col("_new")).otherwise(F.col("cursor_ns"))).drop("_new")


def check_lag(cursors: DataFrame, frames: DataFrame, cadence: int, max_frames: int) -> None:
    if not realigned(cursors, frames, cadence, max_frames).where("lagged").isEmpty():
        raise LaggedAnchorError("a cursor is older than the frames that are kept")


def history(frames: DataFrame, n: int, cadence: int, stop_at_gap: bool = True) -> DataFrame:
    """The last n frames of each phase and symbol, in order; up to the first gap going back, or over gaps."""
    w = Window.partitionBy("phase", "symbol").orderBy(F.desc("anchor_ns"))
    rows = frames.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= n)
    if stop_at_gap:
        rows = rows.withColumn("_first", F.max("anchor_ns").over(Window.partitionBy("phase", "symbol"))).where(F.col("anchor_ns") == F.col("_first") - (F.col("_k") - 1) * F.lit(cadence).cast("long")).drop("_first")
    return rows.drop("_k")


def choose_phase(phases: list[tuple[str, int]], anchor_ns: int, cadence: int) -> str:
    """The phase whose lattice holds the anchor; else that of the largest offset no later in the period; else the first."""
    at = anchor_ns % cadence
    exact = [p for p, o in phases if o == at]
    if exact:
        return exact[0]
    before = [(o, p) for p, o in phases if o <= at]
    return max(before)[1] if before else phases[0][0]


QUOTE_STATE = ["last_bid_px", "last_ask_px", "last_bid_sz", "last_ask_sz", "sip_timestamp"]
TERMINAL = dict(zip(["last_bid_px", "last_ask_px", "last_bid_sz", "last_ask_sz", "last_trade_px", "sip_timestamp", "quote_idx", "trade_idx"], FEATURES_44[36:]))


def window_1hz(frames: DataFrame, symbol: str, anchor_ns: int, cadence: int, span: int = 360, phase: str | None = None) -> DataFrame:
    """The span + 1 rows of one symbol up to an anchor, backfilled; no row if a frame is missing.

    The row after the last whole bar comes from slots 36 to 43 of the last frame. Offsets of
    extremes become times, 0 where there is none. Quote state before the first quote is that
    of the first, with no venue at best; the trade price likewise. Deviation and skew are
    carried forward, from 0.
    """
    offset = anchor_ns % cadence
    first = anchor_ns - span * cadence
    rows = frames.where((F.col("symbol") == symbol) & (F.col("anchor_ns") > first) & (F.col("anchor_ns") <= anchor_ns))
    if phase is not None:
        rows = rows.where(F.col("phase") == phase)
    whole = Window.partitionBy("symbol")
    rows = rows.withColumn("_n", F.count(F.lit(1)).over(whole)).where(F.col("_n") == span).drop("_n")
    bar = F.col("anchor_ns") - F.lit(offset).cast("long")
    body = rows.select("symbol", bar.alias("row_ns"), *FEATURES_44[:36])
    for c in FEATURES_44[30:34]:
        body = body.withColumn(c, F.when(F.col(c) < 0, 0.0).otherwise(F.col("row_ns") - F.lit(cadence) + F.col(c)))
    plain = {c: F.lit(0.0) for c in FEATURES_44[:14] + FEATURES_44[30:34]} | {c: F.lit(None).cast("double") for c in FEATURES_44[14:30]} | {k: F.col(v) for k, v in TERMINAL.items()}
    last = rows.where(F.col("anchor_ns") == anchor_ns).select("symbol", F.col("anchor_ns").alias("row_ns"), *(plain[c].alias(c) for c in FEATURES_44[:36]))
    out = body.unionByName(last.withColumn("row_ns", F.col("row_ns") + (1 if offset == 0 else 0)))
    w = Window.partitionBy("symbol").orderBy("row_ns")
    behind = w.rowsBetween(Window.unboundedPreceding, 0)
    early = F.col("last_bid_px").isNull()
    out = out.withColumn("_early", early)
    for c in [*QUOTE_STATE, "last_trade_px"]:
        out = out.withColumn(c, F.coalesce(F.col(c), backward(c, ("symbol",), "row_ns")))
    for c in FEATURES_44[14:16]:
        out = out.withColumn(c, F.when(F.col("_early"), 0.0).otherwise(F.coalesce(F.col(c), F.last(c, ignorenulls=True).over(behind))))
    for c in FEATURES_44[28:30]:
        out = out.withColumn(c, F.coalesce(F.last(c, ignorenulls=True).over(behind), F.lit(0.0)))
    return out.drop("_early")


def request_chunk(ticks: DataFrame, phase_symbols: DataFrame, symbol: str, start_ns: int, end_ns: int, cadence: int, full: bool = False, lag_ns: int = 1_000_000) -> DataFrame:
    """Frames of one symbol with anchors in (start, end], and cold_start.

    Ticks before start give the state only. Of ticks at the end, the full frame counts those
    at it, the compact bar those before it. The full frame's trades meet quotes lag_ns old.
    """
    own = ticks.where(F.col("symbol") == symbol)
    own = own.where((F.col("sip_ns") <= end_ns) if full else (F.col("sip_ns") < end_ns))
    phases = phase_symbols.where(F.col("symbol") == symbol)
    out = frame44(own, phases, cadence, lag_ns, start_ns, end_ns) if full else bars5(own, phases, cadence, start_ns=start_ns, end_ns=end_ns)
    return cold_start(out.where((F.col("anchor_ns") > start_ns) & (F.col("anchor_ns") <= end_ns)))


def chunk_frames(start_ns: int, end_ns: int, cadence: int, offset: int = 0) -> int:
    """How many anchors lie in (start, end]."""
    return (end_ns - offset) // cadence - (start_ns - offset) // cadence


def missing_anchors(frames: DataFrame, cadence: int) -> DataFrame:
    """Steps of a phase's anchors that aren't one cadence."""
    anchors = frames.select("phase", "anchor_ns").distinct()
    step = F.col("anchor_ns") - F.lag("anchor_ns").over(Window.partitionBy("phase").orderBy("anchor_ns"))
    return anchors.withColumn("step_ns", step).where(F.col("step_ns") != cadence)


def first_anchor(ts: Column, cadence: int, offset: int = 0) -> Column:
    return anchor(ts, cadence, offset)
