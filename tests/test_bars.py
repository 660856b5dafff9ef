import random

import pytest
from pyspark.sql import functions as F

from barloom.operators import bars5, bars44, bars250, micro, quality, reader, snapshot
from barloom.schema import FEATURES_5, FEATURES_44
from barloom.streaming.model import Compact, Full

from .helpers import BASE, MS, S, close, frame, model_tick, phases, quote, random_ticks, trade


def ordered(rows):
    return sorted((model_tick(r) for r in rows), key=lambda t: (t[0], t[1], t[2]))


def test_phase_volume(spark):
    rows = [quote(BASE - 500 * MS, 10.0, 10.1), trade(BASE - 100 * MS, 10.0, 50.0, seq=1), trade(BASE + 600 * MS, 10.0, 100.0, seq=2), trade(BASE + 2 * S, 10.0, 1.0, seq=3)]
    got = {r.anchor_ns: r.vol_1s for r in bars5.bars5(frame(spark, rows), phases(spark), S).collect()}
    assert got == {BASE: 50.0, BASE + S: 100.0, BASE + 2 * S: 0.0}


@pytest.mark.parametrize("offset", [0, S // 2])
def test_compact_bars_equal_the_model(spark, offset):
    rows = random_ticks(seed=offset % 7)
    got = bars5.bars5(frame(spark, rows), phases(spark, [("p", 0, offset, s) for s in ("A", "B", "C")]), S).collect()
    first, last = min(r[1] for r in rows), max(r[1] for r in rows)
    want = {}
    for s in ("A", "B", "C"):
        m = Compact(S, offset)
        m.open(first)
        out = [x for t in ordered(r for r in rows if r[0] == s) for x in m.add(t)] + m.flush(last)
        want |= {(s, r[0]): r[1:] for r in out}
    assert {(r.symbol, r.anchor_ns) for r in got} == set(want)
    for r in got:
        assert all(close(r[c], w, 1e-12) for c, w in zip(FEATURES_5, want[r.symbol, r.anchor_ns])), r


@pytest.mark.parametrize("seed", [1, 2])
def test_full_frames_equal_the_model(spark, seed):
    rows = random_ticks(600, seed)
    setup = [(n, k, o, s) for k, (n, o) in enumerate((("p0", 0), ("p500", S // 2))) for s in ("A", "B")]
    got = bars44.frame44(frame(spark, rows), phases(spark, setup), S, 20 * MS).collect()
    first, last = min(r[1] for r in rows), max(r[1] for r in rows)
    want = {}
    for s in ("A", "B"):
        m = Full(S, [("p0", 0), ("p500", S // 2)], 20 * MS)
        m.open(first)
        for t in ordered(r for r in rows if r[0] == s):
            m.add(t)
        want |= {(p, s, at): v for p, at, v in m.flush(last)}
    assert {(r.phase, r.symbol, r.anchor_ns) for r in got} == set(want)
    for r in got:
        for c, w in zip(FEATURES_44, want[r.phase, r.symbol, r.anchor_ns]):
            assert close(r[c], w), (c, r[c], w, r.phase, r.symbol, r.anchor_ns - BASE)


def test_order_of_rows_does_not_matter(spark):
    rows = random_ticks(200, 5)
    mixed = rows[:]
    random.Random(1).shuffle(mixed)
    a, b = (sorted(map(tuple, bars44.frame44(frame(spark, x), phases(spark), S).collect()), key=lambda r: r[:3]) for x in (rows, mixed))
    assert len(a) == len(b) and all(close(x, y) if isinstance(x, float) or x is None else x == y for p, q in zip(a, b) for x, y in zip(p, q))


def test_phases_do_not_change_each_other(spark):
    rows = random_ticks(200, 6)
    two = bars5.bars5(frame(spark, rows), phases(spark, [("p0", 0, 0, "A"), ("p1", 1, 250 * MS, "A")]), S).where("phase = 'p0'").collect()
    one = bars5.bars5(frame(spark, rows), phases(spark, [("p0", 0, 0, "A")]), S).collect()
    assert sorted(two) == sorted(one)


def test_late_tick_counts_but_stays_out_of_bars():
    m = Full(S, [("p", 0)], MS)
    m.open(BASE + 500 * MS)
    m.add(model_tick(quote(BASE + 500 * MS, 10.0, 10.2)))
    m.flush(BASE + 2 * S)
    m.add(model_tick(trade(BASE + 1950 * MS, 10.2, 70.0, seq=2)))
    out = m.flush(BASE + 3 * S)
    slots = dict(zip(FEATURES_44, out[-1][2]))
    assert m.late == 1 and slots["buy_volume"] == 0 and slots["last_trade_px"] == 10.2 and slots["trade_idx"] == 1


def test_stream_order_and_batches_do_not_matter():
    rows = [model_tick(r) for r in random_ticks(300, 9, symbols=("A",))]
    first, last = min(t[0] for t in rows), max(t[0] for t in rows)
    one = Full(S, [("p", 0)], MS)
    one.open(first)
    for t in rows:
        one.add(t)
    want = one.flush(last)
    two, got = Full(S, [("p", 0)], MS), []
    two.open(first)
    rng = random.Random(3)
    for t in sorted(rows, key=lambda t: t[0] + rng.randrange(100) * MS):  # up to 100 ms out of order
        got += two.flush(t[0] - 101 * MS)
        two.add(t)
    assert got + two.flush(last) == want and two.late == 0


def test_dedup(spark):
    nan = float("nan")
    rows = [quote(1, 0.0, 1.0, seq=0), quote(2, 1.0, 2.0, seq=1), quote(3, 1.0, 2.0, seq=2), quote(4, 0.0, 0.0, seq=3), quote(5, 1.0, 2.0, seq=4), quote(6, 1.0, 2.1, seq=5), quote(7, 1.0, 2.1, seq=6, bid_sz=2.0), quote(8, 1.0, 2.1, seq=7, bid_sz=nan), quote(9, 1.0, 2.1, seq=8, bid_sz=nan)]
    assert [r.seq for r in quality.dedup_quotes(frame(spark, rows)).orderBy("seq").collect()] == [1, 5, 6, 7, 8]


def test_crossed_and_nan_quotes(spark):
    rows = [quote(1, 2.0, 1.0, seq=0), quote(2, 1.0, 1.0, seq=1), quote(3, float("nan"), 1.0, seq=2)]
    t = frame(spark, rows)
    assert [r.seq for r in t.where(quality.quote_valid(strict_cross=True)).collect()] == [1]
    assert [r.seq for r in t.where(quality.quote_valid()).orderBy("seq").collect()] == [0, 1]


def test_snapshot_keeps_both_sides(spark):
    rows = [quote(1, 10.0, 10.2), trade(2, 10.1, 5.0, seq=1), quote(3, 10.1, 10.3, seq=2)]
    r = snapshot.snapshot(frame(spark, rows)).first()
    assert (r.bid_px, r.ask_px, r.last_trade_px, r.conditions, r.sip_ns) == (10.1, 10.3, 10.1, 1, 3) and close(r.mid_px, 10.2)


def test_micro_lookbacks(spark):
    rows = [quote(BASE + k * S, 100.0 + 0.1 * k, 100.1 + 0.1 * k, seq=k) for k in range(31)]
    rows += [trade(BASE + 26 * S, 102.7, 100.0, seq=100), trade(BASE + 29 * S, 102.8, 50.0, seq=101)]
    r = micro.micro_snapshot(frame(spark, rows)).first()
    assert close(r.mid_1s_ago, 102.95) and close(r.mid_5s_ago, 102.55) and close(r.mid_30s_ago, 100.05)
    assert r.trade_count_3s == 1 and r.trade_vol_5s == 150 and close(r.trade_imbalance_5s, 1 / 3)


def test_buckets(spark):
    q = 250 * MS
    rows = [quote(q + 1, 10.0, 10.2, seq=0), trade(q + 2, 10.2, 250.0, seq=1), trade(q + 3, 10.0, 900.0, seq=2, dark=True), trade(2 * q, 10.0, 100.0, seq=3), trade(2 * q + 1, 10.1, 7.0, seq=4), quote(5 * q, 10.1, 10.1, seq=5)]
    got = {r.bucket_col: r for r in bars250.buckets(frame(spark, rows), open_ns=0, baseline=2).collect()}
    assert sorted(got) == [0, 1, 2, 3, 4]
    assert [got[k].lit_buy_vol for k in range(5)] == [0, 250, 0, 0, 0] and [got[k].lit_sell_vol for k in range(5)] == [0, 0, 100, 0, 0]
    assert got[0].bid_ticks == 100000 and got[4].ask_ticks == 102000 and got[0].mid_ticks == 10000.0 and got[1].mid_ticks == 101000.0
    assert [got[k].cnt_15m for k in range(5)] == [1, 2, 3, 1, 1]


def test_chunk_and_cold_start(spark):
    rows = [quote(BASE - 5 * S, 10.0, 10.2), trade(BASE + 500 * MS, 10.1, 3.0, seq=1), quote(BASE + 59 * S + 1, 10.0, 10.4, seq=2)]
    for full in (False, True):
        got = reader.request_chunk(frame(spark, rows), phases(spark), "A", BASE, BASE + 60 * S, S, full=full).orderBy("anchor_ns").collect()
        assert len(got) == 60 == reader.chunk_frames(BASE, BASE + 60 * S, S) and [r.cold_start for r in got] == [True] * 15 + [False] * 45
    replayed = bars5.bars5(frame(spark, [r for r in rows if r[1] > BASE]), phases(spark), S)
    assert replayed.count() == 59


def test_window_and_history(spark):
    rows = [quote(BASE + 3500 * MS, 10.0, 10.2), trade(BASE + 5500 * MS, 10.1, 3.0, seq=1), trade(BASE + 5600 * MS, 10.3, 3.0, seq=2), trade(BASE + 1, 5.0, 1.0, "B", 9), trade(BASE + 10 * S, 5.0, 1.0, "B", 10)]
    frames = bars44.frame44(frame(spark, rows), phases(spark, [("p0", 0, 0, "A")]), S).cache()
    got = reader.window_1hz(frames, "A", BASE + 8 * S, S, span=8).orderBy("row_ns").collect()
    assert len(got) == 9 and all(r.last_bid_px == 10.0 for r in got) and got[0].exchanges_at_bb_primitive == 0.0
    assert close(got[-1].trade_vol_std_px, 0.1) and got[0].trade_vol_std_px == 0.0 and got[5].high_px_ns == BASE + 5600 * MS
    assert reader.window_1hz(frames, "A", BASE + 8 * S, S, span=20).count() == 0
    gap = frames.where(F.col("anchor_ns") != BASE + 6 * S)
    assert reader.history(gap, 10, S).count() == 4 and reader.history(gap, 10, S, stop_at_gap=False).count() == 9
    cursors = reader.begin_all(frames)
    assert cursors.first().cursor_ns == BASE + S and reader.load(gap, reader.advance(cursors, 5 * S)).first().found is False
    with pytest.raises(reader.LaggedAnchorError):
        reader.check_lag(cursors, frames, S, 4)
    assert reader.choose_phase([("a", 0), ("b", 500)], 1700, 1000) == "b" and reader.choose_phase([("b", 500), ("c", 700)], 1100, 1000) == "b"


def test_nothing_at_all(spark):
    t = frame(spark, [])
    assert bars5.bars5(t, phases(spark), S).count() == 0 and bars44.frame44(t, phases(spark), S).count() == 0
    assert snapshot.snapshot(t).count() == 0 and bars250.buckets(t).count() == 0


def test_nan_at_the_edge(spark):
    rows = [trade(BASE + 1, 5.0, 1.0), trade(BASE + 2 * S, 5.0, 1.0, seq=1)]
    r = bars44.as_nan(bars44.frame44(frame(spark, rows), phases(spark), S)).orderBy("anchor_ns").first()
    assert r.last_bid_px != r.last_bid_px and r.high_px == 5.0 and r.low_ask_px_ns == -1.0
