"""Ticks from files, JSON events and flat files. Schemas are given, never inferred; times stay LONG nanoseconds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import QUOTE, QUOTE_FILE, TICKS, TRADE, TRADE_FILE


def as_ticks(rows: DataFrame) -> DataFrame:
    """rows with exactly the tick columns, missing ones null."""
    return rows.select(*((F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in TICKS.fields))


def arrival(rows: DataFrame, order: tuple[str, ...] = ("symbol", "sip_ns")) -> Column:
    """An ordinal for sources without one: position within the file's partition order. Files are read in order, so equal times keep theirs."""
    return F.monotonically_increasing_id()


def _symbol(override: str | None) -> Column:
    return F.lit(override) if override else F.upper(F.col("ticker"))


def trades(spark: SparkSession, *paths: str, symbol: str | None = None) -> DataFrame:
    """Trade files: participant time of 0 or none is the SIP time; off-exchange if trf_id is over 0."""
    return trade_ticks(spark.read.schema(TRADE_FILE).parquet(*paths), symbol)


def trade_ticks(rows: DataFrame, symbol: str | None = None) -> DataFrame:
    part = F.when(F.col("participant_timestamp") > 0, F.col("participant_timestamp")).otherwise(F.col("sip_timestamp"))
    out = rows.select(
        _symbol(symbol).alias("symbol"), F.col("sip_timestamp").alias("sip_ns"), part.alias("part_ns"), F.lit(TRADE).alias("tick_type"), arrival(rows).alias("seq"),
        "price", "size", F.col("exchange").alias("trade_exch"), F.coalesce((F.col("trf_id") > 0) & ~F.isnan("trf_id"), F.lit(False)).alias("is_dark"),
    )
    return as_ticks(out)


def quotes(spark: SparkSession, *paths: str, symbol: str | None = None) -> DataFrame:
    return quote_ticks(spark.read.schema(QUOTE_FILE).parquet(*paths), symbol)


def quote_ticks(rows: DataFrame, symbol: str | None = None) -> DataFrame:
    """Quote files; price is the mid, or the side that there is."""
    part = F.when(F.col("participant_timestamp") > 0, F.col("participant_timestamp")).otherwise(F.col("sip_timestamp"))
    bid, ask = F.col("bid_price"), F.col("ask_price")
    price = F.when((bid > 0) & (ask > 0), (bid + ask) / 2).when(bid > 0, bid).when(ask > 0, ask)
    out = rows.select(
        _symbol(symbol).alias("symbol"), F.col("sip_timestamp").alias("sip_ns"), part.alias("part_ns"), F.lit(QUOTE).alias("tick_type"), arrival(rows).alias("seq"),
        bid.alias("bid_px"), ask.alias("ask_px"), F.col("bid_size").alias("bid_sz"), F.col("ask_size").alias("ask_sz"), F.col("bid_exchange").alias("bid_exch"), F.col("ask_exchange").alias("ask_exch"), price.alias("price"),
    )
    return as_ticks(out)


def lake_paths(root: str, date: str, symbols: list[str], kinds: tuple[str, ...] = ("trades", "quotes")) -> list[tuple[str, str, str]]:
    """(kind, symbol, path) of a day's files: root/date/first letter in upper case/symbol.kind.parquet."""
    return [(kind, s, f"{root.rstrip('/')}/{date}/{s[:1].upper()}/{s}.{kind}.parquet") for s in symbols for kind in kinds]


def lake(spark: SparkSession, root: str, date: str, symbols: list[str]) -> tuple[DataFrame, list[str]]:
    """(ticks of the files that exist, paths that don't); an error if there are none. The path is the partition, so other symbols and days aren't read."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    have: dict[str, list[str]] = {"trades": [], "quotes": []}
    missing = []
    for kind, _, path in lake_paths(root, date, symbols):
        p = jvm.org.apache.hadoop.fs.Path(path)
        (have[kind] if p.getFileSystem(conf).exists(p) else missing).append(path)
    if not any(have.values()):
        raise FileNotFoundError(f"no tick files of {date} under {root}")
    parts = [read(spark, *have[kind]) for kind, read in (("trades", trades), ("quotes", quotes)) if have[kind]]
    return (parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])), missing


# --- JSON events

EVENT = T.StructType([T.StructField(c, T.StringType()) for c in ("ev", "sym", "status", "message", "ds")] + [T.StructField(c, T.DoubleType()) for c in ("bp", "ap", "bs", "as", "p", "s", "trfi")] + [T.StructField(c, T.IntegerType()) for c in ("bx", "ax", "x")] + [T.StructField(c, T.LongType()) for c in ("t", "pt")])


def flexible_number(text: Column) -> Column:
    """A number, quoted or not; null and empty are 0; anything else is an error."""
    t = F.trim(text)
    return F.when(text.isNull() | (t == "") | (F.lower(t) == "null"), F.lit(0.0)).otherwise(t.cast("double"))


def decode_events(messages: DataFrame, column: str = "value", keep: tuple[str, ...] = (), order: str | None = None) -> DataFrame:
    """Ticks of JSON messages, numbered by the order column (a stream needs one for ticks of equal times). Each is an array of events or one event. Status events, and trades without price, size or time, give none; a message that starts otherwise is an error."""
    v = F.trim(F.col(column))
    array = F.when(F.startswith(v, F.lit("[")), v).when(F.startswith(v, F.lit("{")), F.concat(F.lit("["), v, F.lit("]"))).otherwise(F.raise_error(F.concat(F.lit("not a JSON event: "), F.substring(v, 1, 40))))
    _m = F.col(order).cast("long") if order else F.lit(0).cast("long") if messages.isStreaming else F.monotonically_increasing_id()
    events = messages.select(*keep, _m.alias("_m"), F.posexplode(F.from_json(array, T.ArrayType(EVENT))).alias("_p", "e")).select(*keep, "_m", "_p", "e.*")
    ns = lambda c: F.col(c) * F.lit(1_000_000).cast("long")
    size = F.when(flexible_number(F.col("ds")) > 0, flexible_number(F.col("ds"))).otherwise(F.col("s"))
    rows = events.where(F.col("ev").isin("Q", "T")).withColumn("_size", F.when(F.col("ev") == "T", size))
    rows = rows.where((F.col("ev") == "Q") | ((F.col("p") > 0) & (F.col("_size") > 0) & (F.col("t") > 0)))
    quote = F.col("ev") == "Q"
    q = lambda c: F.when(quote, F.col(c))
    t = lambda c: F.when(~quote, F.col(c))
    out = rows.select(
        *keep, F.col("sym").alias("symbol"), ns("t").alias("sip_ns"), F.when(F.col("pt") > 0, ns("pt")).otherwise(ns("t")).alias("part_ns"), F.when(quote, QUOTE).otherwise(TRADE).alias("tick_type"),
        (F.col("_m") * (1 if order else 1024) + F.col("_p")).alias("seq"), q("bp").alias("bid_px"), q("ap").alias("ask_px"), q("bs").alias("bid_sz"), q("as").alias("ask_sz"), q("bx").alias("bid_exch"), q("ax").alias("ask_exch"),
        t("p").alias("price"), F.col("_size").alias("size"), t("x").alias("trade_exch"), t("trfi").alias("_trfi"),
    )
    out = out.withColumn("is_dark", F.when(F.col("tick_type") == TRADE, F.coalesce(F.col("_trfi") > 0, F.lit(False))))
    return as_ticks(out) if not keep else out.drop("_trfi")


def subscription(symbols: list[str]) -> str:
    """Q.S,T.S,... of the symbols, trimmed, blanks left out."""
    return ",".join(f"{kind}.{s.strip()}" for s in symbols if s.strip() for kind in ("Q", "T"))


# --- flat files

FLAT_TRADES = T.StructType([T.StructField(c, T.StringType()) for c in ("ticker", "conditions", "correction", "exchange", "id", "participant_timestamp", "price", "sequence_number", "sip_timestamp", "size", "tape", "trf_id", "trf_timestamp")])


def flat_file(spark: SparkSession, path: str, kind: str, symbols: list[str] | None = None, max_rows: int | None = None) -> DataFrame:
    """Ticks of a CSV(.gz) with a header; columns are found by name, rows that can't be read are left out. max_rows counts rows of the universe."""
    rows = spark.read.option("header", True).csv(path)
    if symbols:
        rows = rows.where(F.upper("ticker").isin([s.upper() for s in symbols]))
    number = lambda c, t="double": (F.expr(f"try_cast(`{c}` AS {t})") if c in rows.columns else F.lit(None).cast(t)).alias(c)
    if kind == "trades":
        rows = rows.select("ticker", number("sip_timestamp", "bigint"), number("participant_timestamp", "bigint"), number("price"), number("size"), number("exchange", "int"), number("trf_id")).where("sip_timestamp is not null and price is not null and size is not null")
        out = trade_ticks(rows)
    else:
        rows = rows.select("ticker", number("sip_timestamp", "bigint"), number("participant_timestamp", "bigint"), *(number(c) for c in ("bid_price", "bid_size", "ask_price", "ask_size")), *(number(c, "int") for c in ("bid_exchange", "ask_exchange"))).where("sip_timestamp is not null and bid_price is not null and ask_price is not null")
        out = quote_ticks(rows)
    return out.limit(max_rows) if max_rows else out


def from_time(ticks: DataFrame, start_ns: int) -> DataFrame:
    """What a replay that starts at a time sends."""
    return ticks.where(F.col("sip_ns") >= start_ns)


# --- the driver's events table as ticks


def event_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events.parquet as ticks: views, clicks and signups are quotes, the others trades; prices and sizes follow from value and props."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("event_id", "unix_micros(cast(ts AS timestamp)) * 1000L AS sip_ns", "user_id", "value", "event_type IN ('view', 'click', 'signup') AS quote", "cast(regexp_extract(props, '[0-9]+', 0) AS int) AS k")
    bid = "CASE WHEN k % 10 = 0 THEN 0D ELSE 50D * (1 + floor(value / 50)) END"
    quote = {"bid_px": bid, "ask_px": f"{bid} + 10D * (1 + k % 2)", "bid_sz": "1D", "ask_sz": "1D", "bid_exch": "k % 6", "ask_exch": "(k + 1) % 6"}
    trade = {"price": "5D * (1 + floor(value / 5))", "size": "cast(1 + k AS double)", "trade_exch": "k % 6", "is_dark": "k % 10 = 0"}
    known = {"symbol": "concat('S', cast(user_id % 8 AS string))", "sip_ns": "sip_ns", "part_ns": "sip_ns - k * 1000", "tick_type": f"CASE WHEN quote THEN {QUOTE} ELSE {TRADE} END", "seq": "event_id"}
    known |= {c: f"CASE WHEN quote THEN {x} END" for c, x in quote.items()} | {c: f"CASE WHEN NOT quote THEN {x} END" for c, x in trade.items()}
    return e.selectExpr(*(f"cast({known[f.name]} AS {f.dataType.simpleString()}) AS {f.name}" for f in TICKS.fields))


def lineitem_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem.parquet as trades at the ship date, for aggregates of many rows that don't depend on order."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate")
    sip = F.unix_seconds(F.col("l_shipdate").cast("timestamp")) * 1_000_000_000
    out = rows.select(F.concat(F.lit("P"), F.col("l_suppkey").cast("string")).alias("symbol"), sip.alias("sip_ns"), sip.alias("part_ns"), F.lit(TRADE).alias("tick_type"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("seq"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), F.col("l_quantity").cast("double").alias("size"), F.lit(False).alias("is_dark"))
    return as_ticks(out)
