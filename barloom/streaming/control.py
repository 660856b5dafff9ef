"""Running queries: publication of frames and snapshots, feeds that stop and start, readiness and metrics."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.bars import upsert

STALE_S = 3.0


def publish(frames: DataFrame, path: str, checkpoint: str, symbol: str | None = None, **trigger) -> StreamingQuery:
    """Frames to a table; a micro-batch appears as a whole or not at all."""
    rows = frames.where(F.col("symbol") == symbol) if symbol else frames
    return rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(**(trigger or {"processingTime": "1 second"})).start()


def publish_snapshots(ticks: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """The state of each symbol, brought up to date with each micro-batch: a trade leaves the quote, a quote the trade."""
    from ..operators.snapshot import snapshot

    def put(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            upsert(snapshot(batch, raw=True), path, number)

    return ticks.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "1 second"})).start()


class Feed:
    """A query that can be disabled and enabled again; it goes on from its checkpoint."""

    def __init__(self, start: Callable[[], StreamingQuery]):
        self.start, self.query = start, None

    def enable(self) -> None:
        if self.query is None or not self.query.isActive:
            self.query = self.start()

    def disable(self) -> None:
        if self.query is not None and self.query.isActive:
            self.query.stop()

    @property
    def enabled(self) -> bool:
        return self.query is not None and self.query.isActive


def ready(query: StreamingQuery | None, last_seen_s: float, now_s: float | None = None) -> tuple[int, str]:
    """(HTTP status, reason): 503 if the query doesn't run or its heartbeat is older than three seconds."""
    now = time.time() if now_s is None else now_s
    if query is None or not query.isActive:
        return 503, "not running"
    return (503, "stale heartbeat") if now - last_seen_s > STALE_S else (200, "ok")


def metrics_text(values: dict[str, float], prefix: str = "barloom") -> str:
    """Gauges in the text form that scrapers read."""
    return "".join(f"# TYPE {prefix}_{k} gauge\n{prefix}_{k} {v:g}\n" for k, v in sorted(values.items()))


def progress_metrics(query: StreamingQuery) -> dict[str, float]:
    p = query.lastProgress
    if not p:
        return {"batches": 0.0}
    state = (p["stateOperators"] or [{}])[0]
    return {"batches": float(p["batchId"]) + 1, "input_rows": float(p["numInputRows"]), "rows_per_second": float(p["processedRowsPerSecond"] or 0), "state_rows": float(state.get("numRowsTotal", 0))}


def status(frames: DataFrame, n: int = 10) -> DataFrame:
    """The last frame of the first n symbols."""
    last = frames.groupBy("phase").agg(F.max("anchor_ns").alias("anchor_ns"))
    return frames.join(F.broadcast(last), ["phase", "anchor_ns"]).orderBy("phase", "symbol").limit(n)
