import datetime
import json

import pytest
from pyspark.sql import functions as F

from barloom import config
from barloom.functions import lattice
from barloom.operators import orders, quality, recorder, replicate
from barloom.operators import asof
from barloom.operators.bars5 import bars5
from barloom.schema import FEATURES_5
from barloom.sources import bars, live, ticks

from .helpers import BASE, MS, S, frame, phases, quote, random_ticks, trade


def decode(spark, *texts):
    return ticks.decode_events(spark.createDataFrame([(t,) for t in texts], "value string")).orderBy("seq").collect()


def test_json_events(spark):
    rows = decode(spark, '[{"ev":"Q","sym":"A","bp":1.0,"ap":1.1,"bs":2,"as":3,"bx":4,"ax":5,"t":10,"pt":9},{"ev":"T","sym":"A","p":1.05,"s":7,"ds":"40.5","x":3,"trfi":2,"t":11}]', '{"ev":"T","sym":"B","p":2.0,"s":7,"t":12}', '[{"ev":"status","status":"ok","message":"m"}]', '{"ev":"T","sym":"B","p":0,"s":7,"t":12}', '{"ev":"T","sym":"B","p":1,"s":0,"t":12}', '{"ev":"T","sym":"B","p":1,"s":1,"t":0}')
    assert [(r.symbol, r.tick_type, r.sip_ns, r.price, r.size) for r in rows] == [("A", 0, 10 * MS, None, None), ("A", 1, 11 * MS, 1.05, 40.5), ("B", 1, 12 * MS, 2.0, 7.0)]
    assert rows[0].part_ns == 9 * MS and rows[1].is_dark and not rows[2].is_dark and rows[1].part_ns == 11 * MS
    for bad in ('{"ev":"T","sym":"B","p":1,"ds":"x1","t":12}', "oops"):
        with pytest.raises(Exception):
            decode(spark, bad)


def test_lake_and_files(spark, tmp_path):
    root = str(tmp_path)
    t = spark.createDataFrame([("AB", 10, 0, 1.5, 2.0, 3, 4.0), ("AB", 11, 9, 1.6, 0.5, 3, None)], "ticker string, sip_timestamp long, participant_timestamp long, price double, size double, exchange int, trf_id double")
    t.write.parquet(f"{root}/2024-01-02/A/AB.trades.parquet")
    got, missing = ticks.lake(spark, root, "2024-01-02", ["AB", "CD"])
    assert [(r.symbol, r.part_ns, r.is_dark) for r in got.orderBy("sip_ns").collect()] == [("AB", 10, True), ("AB", 9, False)] and len(missing) == 3
    with pytest.raises(FileNotFoundError):
        ticks.lake(spark, root, "2024-01-03", ["AB"])


def test_flat_files_and_merged_csv(spark, tmp_path):
    (tmp_path / "q.csv").write_text("ticker,ask_exchange,ask_price,ask_size,bid_exchange,bid_price,bid_size,sip_timestamp\nA,1,1.2,1,2,1.1,1,100\nZ,1,1.2,1,2,1.1,1,100\nA,1,bad,1,2,1.1,1,90\n")
    (tmp_path / "t.csv").write_text("ticker,price,size,sip_timestamp,exchange\nA,1.15,5,100,1\nA,1.16,5,101,1\n")
    q, t = (ticks.flat_file(spark, str(tmp_path / f"{n[0]}.csv"), n, ["A"]) for n in ("quotes", "trades"))
    assert q.count() == 1 and ticks.flat_file(spark, str(tmp_path / "t.csv"), "trades", ["A"], max_rows=1).count() == 1
    bars.merged_csv(quality.merged(q, t), str(tmp_path / "out"))
    lines = [x for f in sorted((tmp_path / "out").glob("*.csv.gz")) for x in __import__("gzip").open(f, "rt").read().splitlines()]
    assert [x.split(",")[:3] for x in lines if not x.startswith("event")] == [["Q", "A", "100"], ["T", "A", "100"], ["T", "A", "101"]]


def test_record_and_play_back(spark, tmp_path):
    path = str(tmp_path / "rec")
    t, p = frame(spark, random_ticks(200, 4, symbols=("A",))), phases(spark)
    frames = bars5(t, p, S)
    rows = recorder.recorded(t, p, frames, S, FEATURES_5)
    cfg = config.Config(("A",), (config.Phase(0, "p0", 0, ("A",)),))
    bars.record(rows, path, cfg)
    bars.record(rows.limit(1), path)
    back = bars.playback(spark, path)
    assert back.count() == frames.count() + 1 and bars.read_config(spark, path) == cfg
    assert bars.export_features(frames, str(tmp_path / "exp"), FEATURES_5, max_frames=5) == 5
    assert recorder.skipped(rows.where(F.col("ts_ns") % (3 * S) != 0), S).first().gaps > 5
    assert recorder.symbol_list("A, B # x\n#no\nC") == ["A", "B", "C"]


def test_inferred_config(spark, tmp_path):
    spark.createDataFrame([(2, "B", [1.0] * 44), (1, "A", [1.0] * 44)], "ts_ns long, symbol string, features array<double>").write.parquet(str(tmp_path / "x"))
    c = bars.read_config(spark, str(tmp_path / "x"))
    assert c.symbols == ("A", "B") and c.full


def test_session_edges(spark):
    day = int(datetime.datetime(2024, 1, 5, 14, 30, tzinfo=datetime.timezone.utc).timestamp()) * S  # Friday 09:30
    cases = [(day, True), (day - S, False), (day - 1, False), (day + 23400 * S, True), (day + 23400 * S + 1, False), (day + 86400 * S, False), (day + 2 * 86400 * S, False), (day + 9000 * S, True)]
    got = spark.createDataFrame(cases, "ts long, want boolean").select("ts", "want", lattice.in_session(F.col("ts")).alias("got"), lattice.trading_open(F.col("ts")).alias("o")).collect()
    assert all(r.want == r.got for r in got) and got[0].o == day and got[4].o == day + 23400 * S


def test_small_functions(spark):
    assert lattice.duration_ns("100ms") == 100 * MS and lattice.duration_ns("1h30m") == 5400 * S and lattice.duration_ns("5") == 5 * S and lattice.duration_ns("200000000000") == 200 * S and lattice.duration_ns("7ns") == 7
    assert lattice.clock_seconds("09:30") == 34200 and ticks.subscription([" A ", "", "B"]) == "Q.A,T.A,Q.B,T.B"
    for bad in ("25:00", "9", "1:2:3:4"):
        with pytest.raises(ValueError):
            lattice.clock_seconds(bad)
    r = spark.range(1).select(lattice.anchor(F.lit(10), 10, 0).alias("a"), lattice.anchor_inclusive(F.lit(10), 10, 0).alias("b"), lattice.anchor_inclusive(F.lit(11), 10, 5).alias("c"), lattice.half_even_ticks(F.lit(0.00025)).alias("d"), lattice.day_of(F.lit(20240102)).alias("e")).first()
    assert (r.a, r.b, r.c, r.d, str(r.e)) == (20, 10, 15, 2, "2024-01-02")
    with pytest.raises(ValueError):
        config.from_dict({"shm": {"max_frames": 3}})


def test_as_of_against_a_loop(spark):
    rows = random_ticks(500, 11)
    t = frame(spark, rows)
    got = {r.seq: r for r in asof.lagged_quote(quality.accepted(t), 5 * MS).where("tick_type = 1").collect()}
    quotes = [r for r in quality.dedup_quotes(t).collect()]
    for seq, r in got.items():
        own = sorted((q for q in quotes if q.symbol == r.symbol), key=lambda q: (q.sip_ns, q.seq))
        old = [q for q in own if q.sip_ns <= r.sip_ns - 5 * MS]
        want = old[-1] if old else (own[0] if own and own[0].sip_ns <= r.sip_ns else None)
        assert (r.quote_a.seq if r.quote_a else None) == (want.seq if want else None)


def test_point_in_time_and_nearest(spark):
    q = frame(spark, [quote(10, 1.0, 2.0), quote(20, 1.1, 2.1, seq=1)])
    at = spark.createDataFrame([("A", 5), ("A", 10), ("A", 19), ("A", 99)], "symbol string, at_ns long")
    assert [r.bid_px for r in asof.point_in_time(q, at).orderBy("at_ns").collect()] == [1.0, 1.0, 1.0, 1.1]
    near = asof.nearest(at, q.select("symbol", "sip_ns", "bid_px"), "symbol", "at_ns", "sip_ns", "bid_px").orderBy("at_ns").collect()
    assert [r.bid_px for r in near] == [1.0, 1.0, 1.1, 1.1]


def test_order_watch(spark):
    t = frame(spark, [quote(10, 1.0, 2.0), trade(15, 0.9, 5.0, seq=1), trade(15, 0.9, 5.0, seq=2), quote(20 * S, 3.0, 4.0, seq=3), quote(99 * S, 9.0, 9.5, seq=4)])
    o = spark.createDataFrame([(1, "A", 1.5, 0, 30 * S), (2, "Z", 1.5, 0, 30 * S)], "order_id long, symbol string, limit_px double, placed_ns long, ended_ns long")
    a, b = orders.watch(o, t, slice_ns=7 * S).orderBy("order_id").collect()
    assert (a.max_bid, a.min_bid, a.first_jump_s, a.trades_at_limit, a.distinct_trades_at_limit) == (3.0, 1.0, 20.0, 2, 1) and b.max_bid is None and b.trades_at_limit == 0


def test_replicas(spark):
    a = spark.createDataFrame([("p", k * S, float(k)) for k in range(1, 6)], "phase string, anchor_ns long, x double")
    b = a.where(F.col("anchor_ns") != 3 * S)
    assert [r.anchor_ns for r in replicate.missing_on(a, b).collect()] == [3 * S] and replicate.common_anchors(a, b).count() == 4
    assert replicate.parity(a, b, ["phase", "anchor_ns"], ["x"]).first().match_pct == 100.0
    assert replicate.element_percentile(a, "x", 0.5).first().value == 3.0 and abs(replicate.slope(a, "x", "anchor_ns").first().slope - 1 / S) < 1e-15
    assert replicate.changed(a.withColumn("x", F.lit(1.0)), "phase", "anchor_ns", ["x"]).count() == 1


def test_messages_as_a_stream(spark, tmp_path):
    import random

    t = frame(spark, [quote(BASE + k * MS, 1.0, 2.0 + k, seq=k) for k in range(120)])
    rows = live.pauses(live.as_messages(t, batch=50), 2.0).orderBy("send_ns").collect()
    assert [len(json.loads(r.value)) for r in rows] == [50, 50, 20] and rows[1].pause_ns == 25 * MS
    broken = iter([["a"], ["b"]])

    def open_():
        yield from next(broken, [])
        if random.random() < 2:
            raise ConnectionError

    seen, waits = [], []
    with pytest.raises(ConnectionError):
        for m in live.connected(open_, tries=3, sleep=waits.append):
            seen.append(m)
    assert seen == ["a", "b"] and len(waits) == 3 and live.backoff(9) < 10.3
    (tmp_path / "m.txt").write_text("".join(r.value + "\n" for r in rows))
    stream = live.message_stream(spark, path=str(tmp_path / "m.txt"), batch="2")
    q = ticks.decode_events(stream).writeStream.format("memory").queryName("decoded").start()
    try:
        q.processAllAvailable()
        assert spark.table("decoded").count() == 120
    finally:
        q.stop()


def test_snapshots_keep_both_sides_over_batches(spark, tmp_path):
    from barloom.operators.snapshot import snapshot
    from barloom.sources.bars import upsert

    from .helpers import frame, quote, trade

    path = str(tmp_path / "snap")
    first = snapshot(frame(spark, [quote(10, 1.0, 2.0, seq=1), trade(11, 1.5, 5.0, seq=2), quote(12, 3.0, 4.0, "B", seq=3)]), raw=True)
    later = snapshot(frame(spark, [trade(20, 1.7, 6.0, seq=4)]), raw=True)
    upsert(first, path, 0)
    for _ in range(2):  # a batch that comes again changes nothing
        got = {r.symbol: r for r in upsert(later, path, 1).collect()}
    a, b = got["A"], got["B"]
    assert (a.bid_px, a.ask_px, a.mid_px, a.last_trade_px, a.last_trade_sz, a.conditions, a.sip_ns) == (1.0, 2.0, 1.5, 1.7, 6.0, 2, 20)
    assert (b.bid_px, b.spread_px, b.conditions) == (3.0, 1.0, 0)


def test_linear_as_of_windows(spark):
    """100,000 quotes of one symbol: what grew with the square took minutes."""
    import time

    from pyspark.sql import functions as F

    from barloom.operators.asof import nearest, point_in_time

    q = spark.range(100_000).select(F.lit("A").alias("symbol"), F.col("id").alias("sip_ns"), F.col("id").alias("seq"), F.col("id").cast("double").alias("bid_px"), (F.col("id") + 1.0).alias("ask_px"))
    start = time.time()
    assert point_in_time(q, spark.createDataFrame([("A", -5), ("A", 70_000)], "symbol string, at_ns long")).agg(F.sum("bid_px")).first()[0] == 70_000.0
    assert nearest(q.select("symbol", "seq", "sip_ns"), q.select("symbol", "sip_ns", "bid_px"), "symbol", "sip_ns", "sip_ns", "bid_px").where("near_ts <> seq").count() == 0
    assert time.time() - start < 60
