"""Bars as a Structured Streaming query: one keyed state for each symbol.

A stream is ticks and control rows of the same columns: OPEN (the grid begins at this time)
and FLUSH (nothing before this time is to come). A replay has one of each for a symbol; a
live stream gets flushes from a clock (heartbeats()), less a buffer for reordering, so that
symbols without ticks close their bars too. Late ticks reach the state, which Spark's own
watermark would drop. Recovery is the checkpoint's; the state needs no warm start.
"""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .. import ship
from ..schema import FEATURES_5, FEATURES_44, OPEN
from ..sources.ticks import as_ticks
from .model import FIELDS, FLUSH, Compact, Full

STATE = T.StructType([T.StructField("state", T.BinaryType())])


def frame_schema(features: list[str]) -> T.StructType:
    return T.StructType([T.StructField("phase", T.StringType()), T.StructField("symbol", T.StringType()), T.StructField("anchor_ns", T.LongType()), *(T.StructField(c, T.DoubleType()) for c in features)])


def as_tuples(pdf: pd.DataFrame) -> list[tuple]:
    """Rows as ticks, missing values as None; whole numbers may have come as floats beside missing ones."""
    whole = {"sip_ns", "tick_type", "seq", "part_ns", "bid_exch", "ask_exch", "trade_exch"}
    columns = []
    for c in FIELDS:
        values = pdf[c].astype(object).where(pdf[c].notna(), None).tolist()
        columns.append([None if v is None else int(v) for v in values] if c in whole else values)
    return list(zip(*columns))


class Waiting:
    """Compact bars of a symbol's phases, fed in order of time at each flush."""

    def __init__(self, cadence: int, phases: list[tuple[str, int]]):
        self.bars = {name: Compact(cadence, offset) for name, offset in phases}
        self.ticks: list[tuple] = []

    def open(self, ts: int) -> None:
        for bars in self.bars.values():
            bars.open(ts)

    def add(self, t: tuple) -> None:
        self.ticks.append(t)

    def flush(self, until: int) -> list[tuple]:
        self.ticks.sort(key=lambda t: (t[0], t[1], t[2]))
        ready, self.ticks = [t for t in self.ticks if t[0] <= until], [t for t in self.ticks if t[0] > until]
        out: list[tuple] = []
        for name, bars in self.bars.items():
            rows = [r for t in ready for r in bars.add(t)] + bars.flush(until)
            out += [(name, r[0], r[1:]) for r in rows]
        return out


def run_symbol(own: Full | Waiting, ticks: list[tuple]) -> list[tuple]:
    """Frames (phase, anchor, values) of some rows: ticks first, then what the latest flush closes."""
    until = None
    for t in ticks:
        if t[1] == OPEN:
            own.open(t[0])
    for t in ticks:
        if t[1] == FLUSH:
            until = max(until or t[0], t[0])
        elif t[1] != OPEN:
            own.add(t)
    return own.flush(until) if until is not None else []


def keyed_bars(rows: DataFrame, phases: dict[str, list[tuple[str, int]]], cadence: int, full: bool, lag_ns: int = 1_000_000) -> DataFrame:
    """Frames of a stream of ticks and control rows. phases: (name, offset) of each symbol; other symbols are left out."""
    ship(rows.sparkSession)
    features = FEATURES_44 if full else FEATURES_5
    schema = frame_schema(features)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        symbol = key[0]
        ticks = [t for pdf in batches for t in as_tuples(pdf)]
        mine = phases.get(symbol)
        if mine is None:
            return
        if state.exists:
            own = pickle.loads(state.get[0])
        else:
            own = Full(cadence, mine, lag_ns) if full else Waiting(cadence, mine)
        found = run_symbol(own, ticks)
        state.update((pickle.dumps(own),))
        if found:
            yield pd.DataFrame([(name, symbol, at, *values) for name, at, values in found], columns=schema.names).astype({c: "float64" for c in features})

    return rows.groupBy("symbol").applyInPandasWithState(step, schema, STATE, "append", GroupStateTimeout.NoTimeout)


def control(symbols: DataFrame, kind: int, at) -> DataFrame:
    return as_ticks(symbols.select("symbol", at.alias("sip_ns"), F.lit(kind).alias("tick_type"), F.lit(0).cast("long").alias("seq")))


def heartbeats(spark: SparkSession, symbols: DataFrame, buffer_ns: int = 100_000_000, offset_ns: int = 0, per_second: int = 1) -> DataFrame:
    """A stream of flushes at the clock's time plus an offset less a buffer, for each symbol."""
    clock = spark.readStream.format("rate").option("rowsPerSecond", per_second).load()
    now = F.unix_micros("timestamp") * 1000 + F.lit(offset_ns - buffer_ns).cast("long")
    return as_ticks(clock.join(F.broadcast(symbols.select("symbol")), how="cross").select("symbol", now.alias("sip_ns"), F.lit(FLUSH).alias("tick_type"), F.lit(0).cast("long").alias("seq")))


def phases_of(phase_symbols: DataFrame) -> dict[str, list[tuple[str, int]]]:
    """A universe is a bounded table, like the phases it is made of."""
    out: dict[str, list[tuple[str, int]]] = {}
    for r in phase_symbols.select("phase", "phase_id", "offset_ns", "symbol").orderBy("phase_id").collect():
        out.setdefault(r["symbol"], []).append((r["phase"], r["offset_ns"]))
    return out


def folder(spark: SparkSession) -> str:
    from ..sources.bars import shared_folder

    base = shared_folder(spark)
    return f"{base.rstrip('/')}/stream-{uuid.uuid4().hex}"


def replay(ticks: DataFrame, phase_symbols: DataFrame, cadence: int, full: bool, lag_ns: int = 1_000_000, pieces: int = 3) -> DataFrame:
    """The frames that a stream of these ticks gives. They come in pieces of time, each with its flush; after each the query ends and goes on from its checkpoint, as after a restart."""
    spark = ticks.sparkSession
    base = folder(spark)
    ends = ticks.agg(F.min("sip_ns").alias("t0"), F.max("sip_ns").alias("t1")).first()
    if ends["t0"] is None:
        return spark.createDataFrame([], frame_schema(FEATURES_44 if full else FEATURES_5))
    symbols = phase_symbols.select("symbol").distinct()
    cuts = [ends["t0"] + (ends["t1"] - ends["t0"]) * k // pieces for k in range(pieces)] + [ends["t1"] + 1]
    control(symbols, OPEN, F.lit(ends["t0"]).cast("long")).write.parquet(f"{base}/in")
    stream = spark.readStream.schema(ticks.schema).parquet(f"{base}/in")
    frames = keyed_bars(stream, phases_of(phase_symbols), cadence, full, lag_ns)
    for a, b in zip(cuts, cuts[1:]):
        part = as_ticks(ticks.where((F.col("sip_ns") >= a) & (F.col("sip_ns") < b)))
        part.unionByName(control(symbols, FLUSH, F.lit(b - 1).cast("long"))).write.mode("append").parquet(f"{base}/in")
        q = frames.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/checkpoint").outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
    return spark.read.schema(frames.schema).parquet(f"{base}/out")


def replayed_bars5(ticks: DataFrame, phase_symbols: DataFrame, cadence: int) -> DataFrame:
    return replay(ticks, phase_symbols, cadence, full=False)


def replayed_frames44(ticks: DataFrame, phase_symbols: DataFrame, cadence: int, lag_ns: int) -> DataFrame:
    return replay(ticks, phase_symbols, cadence, full=True, lag_ns=lag_ns)
