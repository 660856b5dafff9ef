"""Queries of sources, sinks, published tables and readers; what is written goes to the shared folder and is read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import Config, Phase
from ..functions.lattice import trading_open
from ..operators import bars5, bars250, micro, quality, reader, recorder, replicate, snapshot
from ..operators import asof as asof_
from ..operators.grid import frame_grid
from ..schema import FEATURES_5, FEATURES_44, QUOTE, TRADE
from ..sources import bars as store
from ..sources import ticks as source
from ..streaming import control
from .queries import PHASES, ROUNDED, SYMBOLS, bucketed, compact, load, phase_symbols, rnd, rounded
from .sql import HALF, HOUR, MINUTE

QUERIES = {}
DAY = 24 * HOUR
FIELDS = ["bid_px", "ask_px", "last_trade_px"]


def query(f):
    QUERIES[f.__name__] = f
    return f


def folder(spark: SparkSession, name: str) -> str:
    return f"{store.shared_folder(spark).rstrip('/')}/barloom-{name}-{uuid.uuid4().hex}"


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame_grid(load(spark, sf_dir), phase_symbols(spark), HOUR).select("phase", "symbol", "anchor_ns")


def recording(spark: SparkSession, sf_dir: str, **only) -> DataFrame:
    ticks, phases = load(spark, sf_dir), phase_symbols(spark)
    return recorder.recorded(ticks, phases, bars5.bars5(ticks, phases, HOUR), HOUR, FEATURES_5, **only)


def recorded_fields(rows: DataFrame) -> DataFrame:
    return rows.select("ts_ns", "symbol", *FIELDS, "conditions", "vol_1s", rnd("spread_bps"))


# --- sources


@query
def lake_scan(spark, sf_dir):
    """A day's files of every symbol, and of one that has none."""
    ticks, root = load(spark, sf_dir), folder(spark, "lake")
    first = ticks.agg(F.min("sip_ns")).first()[0]
    start = first - first % DAY + 3 * DAY
    day = ticks.where((F.col("sip_ns") >= start) & (F.col("sip_ns") < start + DAY))
    for kind, symbol, path in source.lake_paths(root, "day", SYMBOLS):
        own = day.where((F.col("symbol") == symbol) & (F.col("tick_type") == (TRADE if kind == "trades" else QUOTE)))
        own.select(*(trade_file() if kind == "trades" else quote_file())).coalesce(1).write.parquet(path)
    found, _ = source.lake(spark, root, "day", [*SYMBOLS, "ZZ"])
    return found.select("symbol", "sip_ns", "part_ns", "tick_type", "bid_px", "ask_px", "size", "is_dark")


def trade_file() -> list:
    return [F.col("symbol").alias("ticker"), F.col("sip_ns").alias("sip_timestamp"), F.col("part_ns").alias("participant_timestamp"), "price", "size", F.col("trade_exch").alias("exchange"), F.when(F.col("is_dark"), 4.0).alias("trf_id")]


def quote_file() -> list:
    return [F.col("symbol").alias("ticker"), F.col("sip_ns").alias("sip_timestamp"), F.col("part_ns").alias("participant_timestamp"), *(F.col(f"{side}_{short}").alias(f"{side}_{long}") for short, long in (("px", "price"), ("sz", "size"), ("exch", "exchange")) for side in ("bid", "ask"))]


@query
def flat_file_scan(spark, sf_dir):
    """Gzip CSV with a header; quotes with a price that isn't a number are left out."""
    ticks, base = load(spark, sf_dir), folder(spark, "flat")
    kinds = {"trades": (TRADE, trade_file()), "quotes": (QUOTE, quote_file())}
    for kind, (number, columns) in kinds.items():
        rows = ticks.where(F.col("tick_type") == number).select(*columns)
        if kind == "quotes":
            rows = rows.withColumn("bid_price", F.when(F.col("bid_price") == 0, "none").otherwise(F.col("bid_price").cast("string")))
        rows.write.option("header", True).option("compression", "gzip").csv(f"{base}/{kind}")
    both = source.flat_file(spark, f"{base}/trades", "trades", ["s1", "S3", "S6"]).unionByName(source.flat_file(spark, f"{base}/quotes", "quotes", ["s1", "S3", "S6"]))
    return both.select("symbol", "sip_ns", "tick_type", "bid_px", "ask_px", "size")


@query
def recorded_playback(spark, sf_dir):
    path = folder(spark, "recording")
    store.record(recording(spark, sf_dir), path)
    rows = store.playback(spark, path)
    return recorded_fields(rows).withColumn("place", F.row_number().over(Window.partitionBy("symbol").orderBy("ts_ns")))


@query
def recorded_config(spark, sf_dir):
    """Phases and symbols as they stand beside a recording."""
    path = folder(spark, "config")
    store.record(recording(spark, sf_dir), path, Config(tuple(SYMBOLS), tuple(Phase(i, p, o, tuple(SYMBOLS)) for p, i, o in PHASES), cadence_ns=HOUR))
    found = store.read_config(spark, path)
    return spark.createDataFrame([(p.name, p.id, p.offset_ns, s, found.cadence_ns) for p in found.phases for s in p.symbols], "phase string, phase_id int, offset_ns long, symbol string, cadence_ns long")


@query
def playback_from(spark, sf_dir):
    ticks = load(spark, sf_dir)
    first = ticks.agg(F.min("sip_ns")).first()[0]
    return source.from_time(ticks, first - first % DAY + 10 * DAY).select("symbol", "seq", "sip_ns")


@query
def subscription(spark, sf_dir):
    return spark.createDataFrame([(source.subscription([*SYMBOLS, " ", " S9 "]),)], "request string")


# --- sinks


@query
def feature_export(spark, sf_dir):
    path = folder(spark, "export")
    store.export_features(compact(spark, sf_dir), path, FEATURES_5)
    return spark.read.parquet(path)


@query
def merged_csv(spark, sf_dir):
    path = folder(spark, "csv")
    store.merged_csv(load(spark, sf_dir), path)
    return spark.read.option("header", True).schema("event_type string, symbol string, sip_timestamp_ns long, bid_px double, bid_sz double, ask_px double, ask_sz double, trade_px double, trade_sz double").csv(path)


@query
def raw_spool(spark, sf_dir):
    """One message for each tick, with a line end; those of symbol S7 are blank."""
    path = folder(spark, "spool")
    text = F.when(F.col("symbol") == "S7", " \n").otherwise(F.concat("symbol", F.lit(","), "seq", F.lit("\r\n")))
    store.spool(load(spark, sf_dir).select(text.alias("value"), F.col("sip_ns").alias("received_ns")), path)
    return spark.read.text(path).select("value", F.to_date("date").alias("date"))


@query
def telemetry(spark, sf_dir):
    frames, path = compact(spark, sf_dir), folder(spark, "telemetry")
    store.telemetry(frames, path)
    return spark.read.schema(frames.schema).json(path)


@query
def snapshot_upsert(spark, sf_dir):
    """Three batches by time, the last one sent twice: fields merge, trades add up once."""
    ticks, path = load(spark, sf_dir), folder(spark, "snapshot")
    first = ticks.agg(F.min("sip_ns")).first()[0]
    cuts = [first, first + 4 * HOUR, first + 9 * DAY, first + 1000 * DAY]
    for n, (a, b) in enumerate(zip(cuts, cuts[1:])):
        batch = snapshot.snapshot(ticks.where((F.col("sip_ns") >= a) & (F.col("sip_ns") < b)), raw=True)
        store.upsert(batch, path, n)
    return store.upsert(batch, path, n)


def published(spark: SparkSession, sf_dir: str, symbol: str | None) -> DataFrame:
    frames, base = compact(spark, sf_dir), folder(spark, "published")
    frames.write.parquet(f"{base}/in")
    control.publish(spark.readStream.schema(frames.schema).parquet(f"{base}/in"), f"{base}/out", f"{base}/checkpoint", symbol, availableNow=True).awaitTermination()
    return spark.read.schema(frames.schema).parquet(f"{base}/out")


@query
def published_frames(spark, sf_dir):
    return published(spark, sf_dir, None)


@query
def published_symbol(spark, sf_dir):
    return published(spark, sf_dir, "S3")


@query
def relay_delta(spark, sf_dir):
    """Recorded rows in which the state of a symbol isn't that of its row before."""
    return replicate.changed(recording(spark, sf_dir), "symbol", "ts_ns", FIELDS).select("symbol", "ts_ns", *FIELDS)


@query
def recorder_hours(spark, sf_dir):
    """Rows of listed symbols within trading hours."""
    hours = ("09:30", "16:00:00", "America/New_York")
    return recorded_fields(recording(spark, sf_dir, symbols=recorder.symbol_list("S1, S2 # two\nS5\n\n# none"), hours=hours))


@query
def recorder_skipped(spark, sf_dir):
    rows = grid(spark, sf_dir).where(F.expr(f"(anchor_ns div {HOUR}L) % 7") != 3).where("phase = 'p0'")
    return recorder.skipped(rows, HOUR, "anchor_ns")


@query
def status_rows(spark, sf_dir):
    return control.status(compact(spark, sf_dir), 10)


# --- readers


@query
def cursors_begin(spark, sf_dir):
    frames = grid(spark, sf_dir)
    live = reader.begin_all(frames, live=True).withColumnRenamed("cursor_ns", "live_ns")
    return reader.begin_all(frames).join(live, ["phase", "symbol"])


@query
def latest_phase_anchor(spark, sf_dir):
    return load(spark, sf_dir).select("seq", reader.latest_phase_anchor(F.col("sip_ns"), HOUR, HALF).alias("anchor_ns"))


def cursors(spark: SparkSession, frames: DataFrame) -> DataFrame:
    """Phase p0 stands at its second anchor, p30 one after its last, where there is no frame yet."""
    ends = reader.begin_all(frames).where("phase = 'p0'").unionByName(reader.begin_all(frames, live=True).where("phase = 'p30'"))
    return reader.advance(ends, HOUR)


@query
def cursor_load(spark, sf_dir):
    frames = compact(spark, sf_dir)
    return reader.load(frames, cursors(spark, frames)).select("phase", "symbol", "anchor_ns", "found", "vol_1s", "spread_bps")


@query
def cursor_progress(spark, sf_dir):
    return reader.progress(cursors(spark, grid(spark, sf_dir)))


@query
def cursor_realign(spark, sf_dir):
    frames = grid(spark, sf_dir)
    return reader.realigned(cursors(spark, frames), frames, HOUR, 100).select("phase", "symbol", "cursor_ns", "lagged")


@query
def history_over_gaps(spark, sf_dir):
    frames = compact(spark, sf_dir).where(F.expr(f"(anchor_ns div {HOUR}L) % 7") != 3)
    return reader.history(frames, 50, HOUR, stop_at_gap=False).select("phase", "symbol", "anchor_ns", "vol_1s")


@query
def chunk_full(spark, sf_dir):
    """Whole frames of one symbol over 60 hours; ticks before them give the state."""
    ticks = load(spark, sf_dir)
    first = ticks.agg(F.min("sip_ns")).first()[0]
    start = first - first % HOUR + 240 * HOUR
    rows = reader.request_chunk(ticks, phase_symbols(spark, "p0"), "S3", start, start + 60 * HOUR, HOUR, full=True, lag_ns=MINUTE)
    return rounded(rows, ("anchor_ns", "cold_start"), [c for c in FEATURES_44 if c in {"buy_volume", "last_bid_px", "last_trade_px", *ROUNDED, *FEATURES_44[36:41]}])


@query
def window_buckets(spark, sf_dir):
    """41 buckets up to the 19th, so that the first ones lie before the opening, and the last 41."""
    rows = bucketed(spark, sf_dir)
    early, late = (bars250.window_250ms(rows, "S3", now).select(F.lit(now).cast("long").alias("now_col"), "col", "bid_ticks", "ask_ticks", "lit_buy_vol", "lit_sell_vol", "mid_ticks") for now in (20, 10**9))
    return early.unionByName(late)


@query
def snapshot_full(spark, sf_dir):
    """Top of book and all rolling statistics of a symbol as one row."""
    ticks = load(spark, sf_dir)
    stats = micro.micro_snapshot(ticks, lag_ns=MINUTE, second_ns=HOUR, buckets=bucketed(spark, sf_dir))
    for c in ("quote_vol_5s_bps", "vwap_5s", "trade_imbalance_5s"):
        stats = stats.withColumn(c, rnd(c))
    stats = stats.withColumn("trailing_15m_q", F.round(F.col("trailing_15m_q").cast("double"), 2)).withColumn("trailing_15m_cnt", F.col("trailing_15m_cnt").cast("double"))
    return snapshot.snapshot(ticks).join(stats, "symbol")


@query
def session_open(spark, sf_dir):
    return load(spark, sf_dir).select("seq", trading_open(F.col("sip_ns")).alias("open_ns"))


# --- replicas


@query
def replica_missing(spark, sf_dir):
    """Anchors of phase p0 that a replica lacks within the range that both have."""
    own = grid(spark, sf_dir).where("phase = 'p0'")
    return replicate.missing_on(own, own.where(F.expr(f"(anchor_ns div {HOUR}L) % 7") != 3))


@query
def replica_common(spark, sf_dir):
    own = grid(spark, sf_dir).where("phase = 'p0'")
    return replicate.common_anchors(own, own.where(F.expr(f"(anchor_ns div {HOUR}L) % 7") != 3))


@query
def lag_percentile(spark, sf_dir):
    """Of each symbol the 99th percentile, not interpolated, of how far a trade is from its nearest quote."""
    rows = quality.accepted(load(spark, sf_dir))
    trades, quotes = rows.where(F.col("tick_type") == TRADE).select("symbol", "seq", "sip_ns"), rows.where(F.col("tick_type") == QUOTE).select("symbol", "sip_ns", "bid_px")
    near = asof_.nearest(trades, quotes, "symbol", "sip_ns", "sip_ns", "bid_px").withColumn("lag_ns", F.abs(F.col("near_ts") - F.col("sip_ns")))
    return replicate.element_percentile(near.where("lag_ns IS NOT NULL"), "lag_ns", 0.99, ("symbol",))


@query
def stream_bars44_disordered(spark, sf_dir):
    """Ticks reach the keyed state out of order within each piece of the stream."""
    from ..streaming.bars import replayed_frames44

    ticks = load(spark, sf_dir).orderBy(F.xxhash64("seq"))
    return rounded(replayed_frames44(ticks, phase_symbols(spark), HOUR, MINUTE), ("phase", "symbol", "anchor_ns"), FEATURES_44)
