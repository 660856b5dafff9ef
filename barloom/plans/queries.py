"""One query for each operator, over the driver's tables as ticks (see sources.ticks.event_ticks).

The events span a month, so times scale: bars of an hour on phases of 0 and 30 minutes, an
as-of lag of a minute, buckets of 15 minutes, lookbacks in hours.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lattice import anchor, in_session
from ..operators import bars5, bars44, bars250, classify, micro, orders, quality, reader, recorder, replicate, snapshot
from ..operators import asof as asof_
from ..operators.grid import cold_start, frame_grid
from ..schema import FEATURES_5, FEATURES_44, QUOTE, TRADE
from ..sources import ticks as source
from ..sources.bars import shared_folder
from .sql import HALF, HOUR, MINUTE, QUARTER

SYMBOLS = [f"S{k}" for k in range(8)]
PHASES = (("p0", 0, 0), ("p30", 1, HALF))
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def rnd(c: str, digits: int = 6):
    return F.expr(f"round({c}, {digits}) + 0D AS {c}")


def rounded(frame: DataFrame, keys: tuple[str, ...], features: list[str], digits: int = 6) -> DataFrame:
    return frame.selectExpr(*keys, *(f"round({c}, {digits}) + 0D AS {c}" if c in ROUNDED else c for c in features))


def phase_symbols(spark: SparkSession, only: str | None = None) -> DataFrame:
    rows = ", ".join(f"('{p}', {i}, {o}L, '{s}')" for p, i, o in PHASES if only in (None, p) for s in SYMBOLS)
    return spark.sql(f"SELECT * FROM VALUES {rows} AS v(phase, phase_id, offset_ns, symbol)")


def load(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source.event_ticks(spark, sf_dir)


def compact(spark: SparkSession, sf_dir: str, only: str | None = None) -> DataFrame:
    frames = bars5.bars5(load(spark, sf_dir), phase_symbols(spark, only), HOUR)
    return frames.select("phase", "symbol", "anchor_ns", *(rnd(c, 9) for c in FEATURES_5[:3]), "vol_1s", rnd("spread_bps"))


def whole(spark: SparkSession, sf_dir: str, features: list[str]) -> DataFrame:
    bars = bars44.whole_bars(load(spark, sf_dir), phase_symbols(spark), HOUR, MINUTE, features=features)
    return rounded(bars, ("symbol", "bar_ns"), features)


ROUNDED = {"nbbo_staleness_ms_primitive", "trade_vol_std_px", "trade_vol_skew"}


@query
def ticks_normalized(spark, sf_dir):
    return load(spark, sf_dir)


@query
def universe_filter(spark, sf_dir):
    universe = spark.createDataFrame([("S1",), ("S3",), ("S5",)], "symbol string")
    return quality.in_universe(load(spark, sf_dir), universe, rows=3).groupBy("symbol", "tick_type").agg(F.count(F.lit(1)).alias("n"))


@query
def quote_valid(spark, sf_dir):
    rules = (("two_sided", quality.quote_valid()), ("not_crossed", quality.quote_valid(strict_cross=True)), ("sized_trades", quality.trade_valid(sized=True)))
    return load(spark, sf_dir).groupBy("symbol").agg(*(F.count_if(F.coalesce(c, F.lit(False))).alias(n) for n, c in rules))


@query
def quote_dedup(spark, sf_dir):
    return quality.dedup_quotes(load(spark, sf_dir)).select("symbol", "seq", "bid_px", "ask_px")


@query
def quote_dedup_drop_count(spark, sf_dir):
    return quality.dropped_quotes(load(spark, sf_dir))


@query
def micro_dedup(spark, sf_dir):
    return quality.dedup_micro(load(spark, sf_dir)).select("symbol", "seq", "bid_px", "ask_px", "bid_exch")


@query
def tick_merge_order(spark, sf_dir):
    t = load(spark, sf_dir)
    both = quality.merged(t.where(F.col("tick_type") == QUOTE), t.where(F.col("tick_type") == TRADE))
    return both.select("symbol", "seq", F.row_number().over(quality.in_order()).alias("place"))


@query
def max_ticks_limit(spark, sf_dir):
    return quality.first_ticks(load(spark, sf_dir), 1000).select("symbol", "seq", "sip_ns")


@query
def mid_spread(spark, sf_dir):
    return quality.derived(load(spark, sf_dir)).select("seq", "mid_px", "spread_px", "notional")


@query
def bars5_phase0(spark, sf_dir):
    return compact(spark, sf_dir, "p0")


@query
def bars5_phase30m(spark, sf_dir):
    return compact(spark, sf_dir, "p30")


@query
def log_returns(spark, sf_dir):
    return compact(spark, sf_dir).select("phase", "symbol", "anchor_ns", *FEATURES_5[:3])


@query
def bar_price_fallback(spark, sf_dir):
    return bars5.states(load(spark, sf_dir), phase_symbols(spark), HOUR).select("phase", "symbol", "anchor_ns", "price")


@query
def vol_bar(spark, sf_dir):
    return bars5.states(load(spark, sf_dir), phase_symbols(spark), HOUR).select("phase", "symbol", "anchor_ns", "vol_1s")


@query
def spread_bps_ffill(spark, sf_dir):
    return compact(spark, sf_dir).select("phase", "symbol", "anchor_ns", "spread_bps")


@query
def dense_grid(spark, sf_dir):
    return frame_grid(load(spark, sf_dir), phase_symbols(spark), HOUR).select("phase", "symbol", "anchor_ns")


@query
def asof_lagged_quote(spark, sf_dir):
    rows = asof_.lagged_quote(quality.accepted(load(spark, sf_dir)), MINUTE).where(F.col("tick_type") == TRADE)
    return rows.select("symbol", "seq", F.col("quote_a.sip_ns").alias("a_ns"), F.col("quote_a.bid_px").alias("a_bid"), F.col("quote_a.ask_px").alias("a_ask"))


@query
def asof_venue_quote(spark, sf_dir):
    return asof_.matched_quote(quality.accepted(load(spark, sf_dir)), MINUTE).select("symbol", "seq", "mid_px", "mid_from")


@query
def asof_point_in_time(spark, sf_dir):
    ticks = load(spark, sf_dir)
    at = frame_grid(ticks, phase_symbols(spark, "p30"), HOUR).select("symbol", F.col("anchor_ns").alias("at_ns"))
    return asof_.point_in_time(quality.dedup_quotes(ticks), at).drop("mid_px")


@query
def trade_side(spark, sf_dir):
    return classify.trade_side(asof_.matched_quote(quality.accepted(load(spark, sf_dir)), MINUTE)).select("symbol", "seq", "mid_px", "is_buy")


def bar_query(name: str, columns: list[str]) -> None:
    QUERIES[name] = lambda spark, sf_dir: whole(spark, sf_dir, columns)


bar_query("bar_flow", FEATURES_44[:6])
bar_query("bar_mid_delta", FEATURES_44[6:8])
bar_query("bar_dark_notional", FEATURES_44[10:12])
bar_query("bar_quote_counts", ["bid_quote_count", "ask_quote_count", "nbbo_quote_rate_primitive"])
bar_query("bar_hilo", FEATURES_44[16:22])
bar_query("bar_hilo_first_ts", FEATURES_44[30:34])
bar_query("bar_prevailing", FEATURES_44[22:28])
bar_query("bar_staleness", ["nbbo_staleness_ms_primitive"])
bar_query("bar_venues_at_best", FEATURES_44[14:16])
bar_query("bar_weighted_std", ["trade_vol_std_px"])
bar_query("bar_weighted_skew", ["trade_vol_skew"])
bar_query("bar_cum_index", ["quote_idx", "trade_idx"])


def full_frames(spark: SparkSession, sf_dir: str, only: str | None = None) -> DataFrame:
    frames = bars44.frame44(load(spark, sf_dir), phase_symbols(spark, only), HOUR, MINUTE)
    return rounded(frames, ("phase", "symbol", "anchor_ns"), FEATURES_44)


@query
def frame44(spark, sf_dir):
    return full_frames(spark, sf_dir)


@query
def terminal_asof(spark, sf_dir):
    return bars44.terminal(load(spark, sf_dir), phase_symbols(spark), HOUR).select("phase", "symbol", "anchor_ns", *FEATURES_44[36:])


def bucketed(spark: SparkSession, sf_dir: str) -> DataFrame:
    ticks = load(spark, sf_dir)
    first = ticks.agg(F.min("sip_ns").alias("t"))
    day = F.col("t") - F.pmod(F.col("t"), F.lit(86_400_000_000_000).cast("long"))
    with_open = ticks.crossJoin(F.broadcast(first.select(day.alias("_open"))))  # one row
    return bars250.buckets(with_open, QUARTER, F.col("_open"), baseline=96)


@query
def bucket_flow(spark, sf_dir):
    return bucketed(spark, sf_dir).select("symbol", "bucket_col", "lit_buy_vol", "lit_sell_vol")


@query
def bucket_ticks_ffill(spark, sf_dir):
    return bucketed(spark, sf_dir).select("symbol", "bucket_col", "bid_ticks", "ask_ticks", "mid_ticks")


@query
def bucket_trailing_baseline(spark, sf_dir):
    return bucketed(spark, sf_dir).select("symbol", "bucket_col", "cnt_15m", F.round("q_15m", 4).alias("q_15m"))


@query
def micro_lookback_mids(spark, sf_dir):
    ticks = load(spark, sf_dir)
    return micro.lookback_quotes(ticks, micro.instants(ticks), HOUR)


@query
def micro_quote_vol(spark, sf_dir):
    ticks = load(spark, sf_dir)
    return micro.quote_vol(ticks, micro.instants(ticks), step_ns=QUARTER).select("symbol", rnd("quote_vol_5s_bps"))


@query
def micro_trade_5s(spark, sf_dir):
    ticks = load(spark, sf_dir)
    return micro.trade_stats(ticks, micro.instants(ticks), MINUTE, HOUR).select("symbol", "trade_count_3s", "trade_vol_5s", rnd("vwap_5s"), rnd("trade_imbalance_5s"))


@query
def snapshot_latest(spark, sf_dir):
    return snapshot.snapshot(load(spark, sf_dir))


@query
def rth_filter(spark, sf_dir):
    return load(spark, sf_dir).where(in_session(F.col("sip_ns"))).select("symbol", "seq")


@query
def window_read(spark, sf_dir):
    frames = full_frames(spark, sf_dir, "p0").where("symbol = 'S3'").select("phase", "symbol", "anchor_ns", "buy_volume", "last_bid_px", "last_trade_px")
    return reader.retained(frames, HOUR, 100)


@query
def window_backfill(spark, sf_dir):
    ticks = load(spark, sf_dir)
    first = ticks.agg(F.min("sip_ns")).first()[0]
    start = first - (first - HALF) % HOUR + HOUR
    rows = reader.window_1hz(full_frames(spark, sf_dir, "p30"), "S3", start + 59 * HOUR, HOUR, span=60)
    return rows.select("row_ns", "last_bid_px", "last_trade_px", "trade_vol_std_px", "exchanges_at_bb_primitive", "high_px_ns", "quote_idx")


@query
def history_run(spark, sf_dir):
    return reader.history(compact(spark, sf_dir), 50, HOUR).select("phase", "symbol", "anchor_ns", "vol_1s")


@query
def chunk_request(spark, sf_dir):
    ticks = load(spark, sf_dir)
    first = ticks.agg(F.min("sip_ns")).first()[0]
    start = first - first % HOUR + 240 * HOUR
    rows = reader.request_chunk(ticks, phase_symbols(spark, "p0"), "S3", start, start + 60 * HOUR, HOUR)
    return rows.select("anchor_ns", rnd("log_ret_1s", 9), "vol_1s", "cold_start")


@query
def cold_start_flag(spark, sf_dir):
    return cold_start(frame_grid(load(spark, sf_dir), phase_symbols(spark), HOUR)).select("phase", "symbol", "anchor_ns", "cold_start")


@query
def late_ticks(spark, sf_dir):
    ticks = load(spark, sf_dir).withColumn("arrival_ns", F.col("sip_ns") + F.when(F.col("seq") % 11 == 0, F.lit(5 * HOUR)).otherwise(F.lit(0).cast("long")))
    late = anchor(F.col("sip_ns"), HOUR) + F.lit(MINUTE) <= F.col("arrival_ns")
    return ticks.groupBy("symbol").agg(F.count(F.lit(1)).alias("ticks"), F.count_if(late).alias("late"))


@query
def replica_parity(spark, sf_dir):
    a = compact(spark, sf_dir, "p0")
    hit = F.expr(f"(anchor_ns div {HOUR}L) % 50") == 0
    b = a.withColumn("vol_1s", F.col("vol_1s") + F.when(hit, 1.0).otherwise(0.0))
    return replicate.parity(a, b, ["phase", "symbol", "anchor_ns"], ["vol_1s"]).withColumn("match_pct", F.round("match_pct", 6))


@query
def anchor_gaps(spark, sf_dir):
    frames = frame_grid(load(spark, sf_dir), phase_symbols(spark), HOUR).where(F.expr(f"(anchor_ns div {HOUR}L) % 7") != 3)
    return reader.missing_anchors(frames, HOUR)


@query
def nearest_asof(spark, sf_dir):
    rows = quality.accepted(load(spark, sf_dir))
    trades, quotes = rows.where(F.col("tick_type") == TRADE).select("symbol", "seq", "sip_ns"), rows.where(F.col("tick_type") == QUOTE).select("symbol", "sip_ns", "bid_px")
    return asof_.nearest(trades, quotes, "symbol", "sip_ns", "sip_ns", "bid_px").drop("sip_ns")


@query
def recorder_rows(spark, sf_dir):
    ticks, phases = load(spark, sf_dir), phase_symbols(spark)
    rows = recorder.recorded(ticks, phases, bars5.bars5(ticks, phases, HOUR), HOUR, FEATURES_5)
    return rows.select("ts_ns", "symbol", "bid_px", "ask_px", "last_trade_px", "conditions", "vol_1s", rnd("spread_bps"))


@query
def seq_gap_jitter(spark, sf_dir):
    packets = load(spark, sf_dir).where("seq % 3 <> 0").select("symbol", "seq", "sip_ns", "part_ns")
    return replicate.gaps_and_jitter(packets, "symbol", "seq", "sip_ns", "part_ns").select("symbol", "seq", "missed", "jitter_ns")


def quote_orders(quotes):
    return quotes.select(F.col("seq").alias("order_id"), "symbol", (F.col("bid_px") + 20).alias("limit_px"), F.col("sip_ns").alias("placed_ns"), (F.col("sip_ns") + F.lit(6 * HOUR)).alias("ended_ns"))


@query
def order_watch(spark, sf_dir):
    ticks = load(spark, sf_dir)
    return orders.watch(quote_orders(quality.dedup_quotes(ticks)), ticks).withColumn("first_jump_s", F.round("first_jump_s", 6))


@query
def json_decode(spark, sf_dir):
    t = load(spark, sf_dir)
    event = F.struct(F.when(F.col("tick_type") == QUOTE, "Q").otherwise("T").alias("ev"), F.col("symbol").alias("sym"), F.col("bid_px").alias("bp"), F.col("ask_px").alias("ap"), F.col("price").alias("p"), F.col("size").cast("string").alias("ds"), F.expr("sip_ns div 1000000").alias("t"))
    return source.decode_events(t.select(F.to_json(event).alias("value"))).select("symbol", "sip_ns", "tick_type", "bid_px", "ask_px", "price", "size")


@query
def stream_bars5(spark, sf_dir):
    from ..streaming.bars import replayed_bars5

    frames = replayed_bars5(load(spark, sf_dir), phase_symbols(spark), HOUR)
    return frames.select("phase", "symbol", "anchor_ns", *(rnd(c, 9) for c in FEATURES_5[:3]), "vol_1s", rnd("spread_bps"))


@query
def stream_bars44(spark, sf_dir):
    from ..streaming.bars import replayed_frames44

    frames = replayed_frames44(load(spark, sf_dir), phase_symbols(spark), HOUR, MINUTE)
    return rounded(frames, ("phase", "symbol", "anchor_ns"), FEATURES_44)


@query
def parquet_roundtrip(spark, sf_dir):
    t = load(spark, sf_dir)
    folder = shared_folder(spark)
    base = f"{folder.rstrip('/')}/barloom-ticks-{abs(hash((sf_dir, spark.sparkContext.applicationId)))}"
    both = {"trades": t.where(F.col("tick_type") == TRADE).select(F.col("symbol").alias("ticker"), F.col("sip_ns").alias("sip_timestamp"), F.col("part_ns").alias("participant_timestamp"), "price", "size", F.col("trade_exch").alias("exchange"), F.when(F.col("is_dark"), 4.0).alias("trf_id"))}
    both["quotes"] = t.where(F.col("tick_type") == QUOTE).select(F.col("symbol").alias("ticker"), F.col("sip_ns").alias("sip_timestamp"), F.col("part_ns").alias("participant_timestamp"), F.col("bid_px").alias("bid_price"), F.col("bid_sz").alias("bid_size"), F.col("ask_px").alias("ask_price"), F.col("ask_sz").alias("ask_size"), F.col("bid_exch").alias("bid_exchange"), F.col("ask_exch").alias("ask_exchange"))
    for kind, rows in both.items():
        rows.write.mode("overwrite").parquet(f"{base}/{kind}")
    back = source.trades(spark, f"{base}/trades").unionByName(source.quotes(spark, f"{base}/quotes"))
    return back.select("symbol", "sip_ns", "part_ns", "tick_type", "bid_px", "ask_px", "bid_sz", "ask_sz", "price", "size", "is_dark")


@query
def lineitem_volume(spark, sf_dir):
    """Volume by symbol and day of a large table of trades; one partial aggregation and one shuffle."""
    trades = source.lineitem_trades(spark, sf_dir)
    day = F.to_date(F.timestamp_seconds((F.col("sip_ns") / 1_000_000_000).cast("long")))
    return trades.groupBy("symbol", day.alias("day")).agg(F.sum("size").alias("volume"), F.count(F.lit(1)).alias("trades"))
