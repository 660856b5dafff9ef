"""Live and replayed messages as streams, through the Python data source API."""

from __future__ import annotations

import json
import random
import time
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

from .ticks import subscription

#: Transports by name: a function from options to an iterator of text messages. A websocket client is one.
TRANSPORTS: dict[str, Callable[[dict], Iterator[str]]] = {}


def backoff(attempt: int, first_s: float = 0.5, most_s: float = 10.0, jitter_s: float = 0.2) -> float:
    """Seconds before another try: doubling up to a limit, and a little at random."""
    return min(first_s * 2**attempt, most_s) + random.random() * jitter_s


def connected(open_: Callable[[], Iterator[str]], tries: int = 10, sleep: Callable[[float], None] = time.sleep) -> Iterator[str]:
    """Messages of a transport that is opened again when it breaks; a message resets the count of tries."""
    attempt = 0
    while True:
        try:
            for message in open_():
                attempt = 0
                yield message
            return
        except (ConnectionError, TimeoutError, OSError):
            attempt += 1
            if attempt >= tries:
                raise
            sleep(backoff(attempt - 1))


def handshake(key: str, symbols: list[str]) -> list[str]:
    """What a client sends first: its key, then what it wants."""
    return [json.dumps({"action": "auth", "params": key}), json.dumps({"action": "subscribe", "params": subscription(symbols)})]


class MessageReader(SimpleDataSourceStreamReader):
    """Reads on the driver; a batch of messages is kept until it is committed, so that it can be read again."""

    def __init__(self, options: dict):
        self.options, self.kept, self.next = options, {}, 0
        self.messages: Iterator[str] | None = None

    def initialOffset(self) -> dict:
        return {"n": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        if self.messages is None:
            self.messages = connected(lambda: TRANSPORTS[self.options.get("transport", "lines")](self.options))
        rows, most = [], int(self.options.get("batch", 1000))
        while len(rows) < most:
            message = next(self.messages, None)
            if message is None:
                break
            rows.append((time.time_ns(), message))
        end = {"n": start["n"] + len(rows)}
        self.kept[start["n"]] = (rows, end["n"])
        return iter(rows), end

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter([r for a, (rows, b) in sorted(self.kept.items()) if a >= start["n"] and b <= end["n"] for r in rows])

    def commit(self, end: dict) -> None:
        self.kept = {a: x for a, x in self.kept.items() if x[1] > end["n"]}


class MessageSource(DataSource):
    """Messages of a transport: received_ns, value."""

    @classmethod
    def name(cls) -> str:
        return "barloom_messages"

    def schema(self) -> str:
        return "received_ns long, value string"

    def simpleStreamReader(self, schema) -> MessageReader:
        return MessageReader(dict(self.options))


def lines(options: dict) -> Iterator[str]:
    """The transport of a text file, a message a line; blank ones are left out."""
    with open(options["path"], encoding="utf-8") as f:
        yield from (line.rstrip("\r\n") for line in f if line.strip())


TRANSPORTS["lines"] = lines


def message_stream(spark: SparkSession, **options: str) -> DataFrame:
    spark.dataSource.register(MessageSource)
    return spark.readStream.format("barloom_messages").options(**options).load()


def as_messages(ticks: DataFrame, batch: int = 50, start_ns: int | None = None, symbols: list[str] | None = None) -> DataFrame:
    """What a playback server sends: JSON arrays of up to so many events in order, from a time on, of some symbols or all. send_ns is the time of the last event."""
    rows = ticks if start_ns is None else ticks.where(F.col("sip_ns") >= start_ns)
    if symbols and "*" not in symbols:
        rows = rows.where(F.col("symbol").isin(symbols))
    quote = F.col("tick_type") == 0
    event = F.struct(F.when(quote, "Q").otherwise("T").alias("ev"), F.col("symbol").alias("sym"), F.col("bid_px").alias("bp"), F.col("ask_px").alias("ap"), F.col("bid_sz").alias("bs"), F.col("ask_sz").alias("as"), F.col("bid_exch").alias("bx"), F.col("ask_exch").alias("ax"), F.when(~quote, F.col("price")).alias("p"), F.col("size").alias("s"), F.col("trade_exch").alias("x"), F.when(F.col("is_dark"), 1).alias("trfi"), F.expr("sip_ns div 1000000").alias("t"), F.expr("part_ns div 1000000").alias("pt"))
    # events of one second and symbol go together, in groups of the batch size
    from pyspark.sql import Window

    second = F.expr("sip_ns div 1000000000")
    place = F.row_number().over(Window.partitionBy("symbol", second).orderBy("sip_ns", "tick_type", "seq")) - 1
    packed = rows.withColumn("_g", F.floor(place / batch)).groupBy("symbol", second.alias("_s"), "_g").agg(F.sort_array(F.collect_list(F.struct("sip_ns", "tick_type", "seq", event.alias("e")))).alias("_e"), F.max("sip_ns").alias("send_ns"))
    return packed.select("symbol", "send_ns", F.to_json(F.transform("_e", lambda x: x["e"])).alias("value"))


def pauses(messages: DataFrame, speed: float) -> DataFrame:
    """messages with pause_ns before each, by the step of time over the speed; speed 0 doesn't pause."""
    from pyspark.sql import Window

    step = F.col("send_ns") - F.lag("send_ns").over(Window.partitionBy("symbol").orderBy("send_ns"))
    return messages.withColumn("pause_ns", F.lit(0).cast("long") if speed <= 0 else F.coalesce((step / speed).cast("long"), F.lit(0).cast("long")))
