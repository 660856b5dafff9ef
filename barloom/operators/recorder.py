"""Rows that a recording holds: frames joined with the state of their symbols at the anchor, within trading hours."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lattice import anchor, in_session
from ..schema import FEATURES_5, QUOTE, TRADE
from .grid import forward, frame_grid, last_of
from .quality import accepted, positive


def snapshots_at(ticks: DataFrame, phase_symbols: DataFrame, cadence: int) -> DataFrame:
    """The top of book of each symbol at each anchor of its last phase, as far as ticks before it tell."""
    last_phase = phase_symbols.groupBy("symbol").agg(F.max_by(F.struct("phase", "phase_id", "offset_ns"), "phase_id").alias("_p")).select("symbol", "_p.*")
    rows = accepted(ticks).join(F.broadcast(last_phase), "symbol").withColumn("anchor_ns", anchor(F.col("sip_ns"), cadence, F.col("offset_ns")))
    quote, trade = F.col("tick_type") == QUOTE, F.col("tick_type") == TRADE
    columns = ("bid_px", "ask_px", "bid_sz", "ask_sz")
    seen = rows.groupBy("symbol", "anchor_ns").agg(*(last_of(c, quote).alias(c) for c in columns), last_of("price", trade).alias("last_trade_px"), last_of("size", trade).alias("last_trade_sz"), F.count_if(trade).alias("_t"), F.max("sip_ns").alias("_m"))
    grid = frame_grid(ticks, last_phase, cadence)
    out = grid.join(seen, ["symbol", "anchor_ns"], "left")
    for c in (*columns, "last_trade_px", "last_trade_sz"):
        out = out.withColumn(c, forward(c, ("symbol",)))
    w = Window.partitionBy("symbol").orderBy("anchor_ns").rowsBetween(Window.unboundedPreceding, 0)
    return out.withColumn("conditions", F.coalesce(F.sum("_t").over(w), F.lit(0)).cast("long")).withColumn("recv_ts_ns", F.max("_m").over(w)).drop("_t", "_m")


def recorded(ticks: DataFrame, phase_symbols: DataFrame, frames: DataFrame, cadence: int, features: list[str], symbols: list[str] | None = None, hours: tuple[str, str, str] | None = None) -> DataFrame:
    """One row for each anchor and symbol. Imbalance and microprice are 0; the named returns, volume and spread are null if frames don't have them.

    hours: start, end and time zone; rows outside them go.
    """
    snap = snapshots_at(ticks, phase_symbols, cadence)
    if symbols:
        snap = snap.where(F.col("symbol").isin(symbols))
    have = set(frames.columns)
    packed = frames.select("phase", "symbol", "anchor_ns", F.array(*(F.col(c).cast("double") for c in features)).alias("features"), *((F.col(c) if c in have else F.lit(None).cast("double")).alias(c) for c in FEATURES_5))
    rows = snap.join(packed, ["phase", "symbol", "anchor_ns"], "left")
    two = positive("bid_px") & positive("ask_px")
    slot = Window.partitionBy("phase").orderBy("anchor_ns")
    out = rows.select(
        F.col("anchor_ns").alias("ts_ns"), "recv_ts_ns", "symbol", "phase_id", (F.dense_rank().over(slot) - 1).alias("phase_slot"),
        "bid_px", "ask_px", "bid_sz", "ask_sz",
        F.when(two, (F.col("bid_px") + F.col("ask_px")) / 2).alias("mid_px"), F.when(two, F.col("ask_px") - F.col("bid_px")).alias("spread_px"),
        "spread_bps", "last_trade_px", "last_trade_sz", "conditions",
        F.lit(0.0).alias("imbalance"), F.lit(0.0).alias("microprice"), "vol_1s", "log_ret_1s", "log_ret_5s", "log_ret_15s", "features",
    )
    return out.where(in_session(F.col("ts_ns"), *hours)) if hours else out


def skipped(rows: DataFrame, cadence: int, ts: str = "ts_ns") -> DataFrame:
    """How many rows gaps between recorded anchors stand for."""
    anchors = rows.groupBy(ts).agg(F.count(F.lit(1)).alias("_n"))
    step = F.col(ts) - F.lag(ts).over(Window.partitionBy(F.lit(0)).orderBy(ts))
    return anchors.select(((step / cadence) - 1).cast("long").alias("_gap"), "_n").where("_gap > 0").agg(F.coalesce(F.sum(F.col("_gap") * F.col("_n")), F.lit(0)).alias("skipped"), F.count(F.lit(1)).alias("gaps"))


def symbol_list(text: str) -> list[str]:
    """Symbols of a comma list or of lines, `#` starting a comment; none means all."""
    out: list[str] = []
    for line in text.splitlines():
        out += [s.strip() for s in line.partition("#")[0].split(",") if s.strip()]
    return out
