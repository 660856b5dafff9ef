"""Tick and bar schemas, feature names and constants."""

from __future__ import annotations

from pyspark.sql import types as T

QUOTE, TRADE = 0, 1
#: A row that is no tick: a grid begins at its time (and ends at its participant time, where that is set).
OPEN = -1
SECOND_NS = 1_000_000_000

# The columns of ticks and of tick files.
#: One row for each event; the fields of the other side are null. seq is the order of arrival.
TICKS = T.StructType(
    [
        T.StructField("symbol", T.StringType()),
        T.StructField("sip_ns", T.LongType()),
        T.StructField("part_ns", T.LongType()),
        T.StructField("tick_type", T.IntegerType()),
        T.StructField("seq", T.LongType()),
        T.StructField("bid_px", T.DoubleType()),
        T.StructField("ask_px", T.DoubleType()),
        T.StructField("bid_sz", T.DoubleType()),
        T.StructField("ask_sz", T.DoubleType()),
        T.StructField("bid_exch", T.IntegerType()),
        T.StructField("ask_exch", T.IntegerType()),
        T.StructField("price", T.DoubleType()),
        T.StructField("size", T.DoubleType()),
        T.StructField("trade_exch", T.IntegerType()),
        T.StructField("is_dark", T.BooleanType()),
    ]
)

TRADE_FILE = T.StructType(
    [
        T.StructField("ticker", T.StringType()),
        T.StructField("sip_timestamp", T.LongType()),
        T.StructField("participant_timestamp", T.LongType()),
        T.StructField("price", T.DoubleType()),
        T.StructField("size", T.DoubleType()),
        T.StructField("exchange", T.IntegerType()),
        T.StructField("trf_id", T.DoubleType()),
    ]
)

QUOTE_FILE = T.StructType(
    [
        T.StructField("ticker", T.StringType()),
        T.StructField("sip_timestamp", T.LongType()),
        T.StructField("participant_timestamp", T.LongType()),
        *(T.StructField(c, T.DoubleType()) for c in ("bid_price", "bid_size", "ask_price", "ask_size")),
        *(T.StructField(c, T.IntegerType()) for c in ("bid_exchange", "ask_exchange")),
    ]
)

# The names of the compact bar's features, in order.
FEATURES_5 = ["log_ret_1s", "log_ret_5s", "log_ret_15s", "vol_1s", "spread_bps"]

# The names of the full frame's features, in order.
FEATURES_44 = [
    "buy_volume", "sell_volume", "buy_notional", "sell_notional", "buy_trade_count", "sell_trade_count",
    "buy_mid_delta_notional", "sell_mid_delta_notional", "bid_quote_count", "ask_quote_count",
    "dark_bid_trade_primitive", "dark_ask_trade_primitive", "nbbo_quote_rate_primitive", "nbbo_staleness_ms_primitive",
    "exchanges_at_bb_primitive", "exchanges_at_bo_primitive", "high_px", "low_px", "high_bid_px", "low_bid_px",
    "high_ask_px", "low_ask_px", "last_bid_px", "last_ask_px", "last_bid_sz", "last_ask_sz", "last_trade_px",
    "sip_timestamp", "trade_vol_std_px", "trade_vol_skew", "high_px_ns", "low_px_ns", "high_ask_px_ns", "low_ask_px_ns",
    "quote_idx", "trade_idx", "asof_bid_px", "asof_ask_px", "asof_bid_sz", "asof_ask_sz", "asof_trade_px",
    "asof_sip_timestamp", "asof_quote_idx", "asof_trade_idx",
]

#: Price of a bar without any trade or quote, and spread of one without both sides.
NO_PRICE, NO_SPREAD_BPS = 100.0, 1.0
#: Mid of a sub-second bucket before any two-sided quote, in ticks of 1/10,000.
NO_MID_TICKS, PRICE_TICKS = 10000.0, 10000.0
AT_MID = 1e-6
#: Frames after a cold or gap start that are flagged.
COLD_FRAMES = 15
