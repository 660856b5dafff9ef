"""Equivalent SQL of the queries, for DuckDB, over the driver's tables."""

from __future__ import annotations

from ..schema import FEATURES_44

HOUR = 3_600_000_000_000
HALF = HOUR // 2
MINUTE = 60_000_000_000
QUARTER = 15 * MINUTE
SECOND = 24 * 1_000_000_000  # lookbacks in units of 24 s: 5 units are two minutes


def anchor(ts: str, offset: str) -> str:
    return f"({ts} - (({ts} - {offset}) % {HOUR}) + {HOUR})"


def inclusive(ts: str, offset: str) -> str:
    return f"({ts} + ((({offset} - {ts}) % {HOUR}) + {HOUR}) % {HOUR})"


def rnd(x: str, digits: int = 6) -> str:
    return f"(round({x}, {digits}) + 0.0)"


def ffill(x: str, keys: str, order: str = "anchor_ns") -> str:
    return f"last_value({x} IGNORE NULLS) OVER (PARTITION BY {keys} ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


BASE = f"""
WITH raw AS (SELECT *, regexp_extract(props, '[0-9]+')::INT AS k, epoch_us(ts) * 1000 AS sip_ns, event_type IN ('view', 'click', 'signup') AS quote FROM events),
ticks AS (
  SELECT 'S' || (user_id % 8)::VARCHAR AS symbol, sip_ns, sip_ns - k * 1000 AS part_ns, CASE WHEN quote THEN 0 ELSE 1 END::INT AS tick_type, event_id AS seq,
    CASE WHEN quote THEN CASE WHEN k % 10 = 0 THEN 0.0 ELSE 50.0 * (1 + floor(value / 50)) END END::DOUBLE AS bid_px,
    CASE WHEN quote THEN CASE WHEN k % 10 = 0 THEN 0.0 ELSE 50.0 * (1 + floor(value / 50)) END + 10.0 * (1 + k % 2) END::DOUBLE AS ask_px,
    CASE WHEN quote THEN 1.0 END::DOUBLE AS bid_sz, CASE WHEN quote THEN 1.0 END::DOUBLE AS ask_sz, CASE WHEN quote THEN k % 6 END::INT AS bid_exch, CASE WHEN quote THEN (k + 1) % 6 END::INT AS ask_exch,
    CASE WHEN NOT quote THEN 5.0 * (1 + floor(value / 5)) END::DOUBLE AS price, CASE WHEN NOT quote THEN 1 + k END::DOUBLE AS size, CASE WHEN NOT quote THEN k % 6 END::INT AS trade_exch, CASE WHEN NOT quote THEN k % 10 = 0 END AS is_dark
  FROM raw),
span AS (SELECT min(sip_ns) AS t0, max(sip_ns) AS t1 FROM ticks),
ph AS (SELECT * FROM (VALUES ('p0', 0, 0::BIGINT), ('p30', 1, {HALF}::BIGINT)) v(phase, phase_id, offset_ns)),
syms AS (SELECT 'S' || i::VARCHAR AS symbol FROM range(8) r(i)),
grid AS (SELECT phase, phase_id, offset_ns, symbol, unnest(generate_series({anchor('t0', 'offset_ns')}, t1 - ((t1 - offset_ns) % {HOUR}), {HOUR})) AS anchor_ns FROM ph, syms, span),
vq AS (SELECT * FROM ticks WHERE tick_type = 0 AND bid_px > 0 AND ask_px > 0),
flagged AS (SELECT *, coalesce(bid_px = lag(bid_px) OVER w AND ask_px = lag(ask_px) OVER w AND bid_sz = lag(bid_sz) OVER w AND ask_sz = lag(ask_sz) OVER w, false) AS repeat FROM vq WINDOW w AS (PARTITION BY symbol ORDER BY sip_ns, seq)),
q AS (SELECT * EXCLUDE repeat FROM flagged WHERE NOT repeat),
mq AS (SELECT * EXCLUDE r FROM (SELECT *, coalesce(bid_px = lag(bid_px) OVER w AND ask_px = lag(ask_px) OVER w AND bid_exch = lag(bid_exch) OVER w, false) AS r FROM vq WINDOW w AS (PARTITION BY symbol ORDER BY sip_ns, seq)) WHERE NOT r),
t AS (SELECT * FROM ticks WHERE tick_type = 1 AND price > 0),
fq AS (SELECT symbol, min(sip_ns) AS f_ns, arg_min(bid_px, sip_ns) AS f_bid, arg_min(ask_px, sip_ns) AS f_ask FROM q GROUP BY symbol),
ta AS (SELECT t.*, a.sip_ns AS la_ns, a.bid_px AS la_bid, a.ask_px AS la_ask FROM t ASOF LEFT JOIN (SELECT symbol, sip_ns + {MINUTE} AS at_, sip_ns, bid_px, ask_px FROM q) a ON t.symbol = a.symbol AND t.sip_ns >= a.at_),
tf AS (SELECT ta.*, CASE WHEN la_ns IS NULL AND f_ns <= sip_ns THEN f_ns ELSE la_ns END AS a_ns, CASE WHEN la_ns IS NULL AND f_ns <= sip_ns THEN f_bid ELSE la_bid END AS a_bid, CASE WHEN la_ns IS NULL AND f_ns <= sip_ns THEN f_ask ELSE la_ask END AS a_ask FROM ta LEFT JOIN fq USING (symbol)),
tb AS (SELECT tf.*, b.sip_ns AS b_ns, b.part_ns AS b_part, b.bid_px AS b_bid, b.ask_px AS b_ask FROM tf ASOF LEFT JOIN q b ON tf.symbol = b.symbol AND tf.trade_exch = b.bid_exch AND tf.sip_ns >= b.sip_ns),
matched AS (SELECT *, b_ns IS NOT NULL AND b_part <= part_ns AND (a_ns IS NULL OR b_ns > a_ns) AS use_b FROM tb),
mids AS (SELECT *, CASE WHEN use_b THEN (b_bid + b_ask) / 2 ELSE (a_bid + a_ask) / 2 END AS mid_px, CASE WHEN use_b THEN 'B' WHEN a_ns IS NOT NULL THEN 'A' END AS mid_from FROM matched),
signed AS (SELECT *, CASE WHEN price > mid_px THEN true WHEN price < mid_px THEN false WHEN price > lag(price) OVER w THEN true WHEN price < lag(price) OVER w THEN false END AS sign FROM mids WINDOW w AS (PARTITION BY symbol ORDER BY sip_ns, seq)),
sided AS (SELECT *, coalesce({ffill('sign', 'symbol', 'sip_ns, seq')}, true) AS is_buy, {anchor('sip_ns', '0')} AS bar_ns FROM signed),
red AS (
  SELECT phase, symbol, {anchor('sip_ns', 'offset_ns')} AS anchor_ns, arg_max(price, sip_ns) FILTER (WHERE price > 0) AS tr, arg_max(bid_px, sip_ns) FILTER (WHERE bid_px > 0) AS b, arg_max(ask_px, sip_ns) FILTER (WHERE ask_px > 0) AS a, sum(size) FILTER (WHERE size > 0) AS vol
  FROM ticks, ph GROUP BY ALL),
st AS (SELECT g.phase, g.symbol, g.anchor_ns, coalesce(r.vol, 0.0) AS vol_1s, {ffill('r.tr', 'g.phase, g.symbol', 'g.anchor_ns')} AS tr, {ffill('r.b', 'g.phase, g.symbol', 'g.anchor_ns')} AS bid_px, {ffill('r.a', 'g.phase, g.symbol', 'g.anchor_ns')} AS ask_px FROM grid g LEFT JOIN red r USING (phase, symbol, anchor_ns)),
pr AS (SELECT *, coalesce(tr, (bid_px + ask_px) / 2, bid_px, ask_px, 100.0) AS price FROM st),
b5 AS (
  SELECT phase, symbol, anchor_ns, {rnd('ln(price / coalesce(lag(price, 1) OVER w, first_value(price) OVER w))', 9)} AS log_ret_1s, {rnd('ln(price / coalesce(lag(price, 5) OVER w, first_value(price) OVER w))', 9)} AS log_ret_5s, {rnd('ln(price / coalesce(lag(price, 15) OVER w, first_value(price) OVER w))', 9)} AS log_ret_15s,
    vol_1s, {rnd('CASE WHEN bid_px IS NOT NULL AND ask_px IS NOT NULL THEN (ask_px - bid_px) / price * 1e4 ELSE 1.0 END')} AS spread_bps
  FROM pr WINDOW w AS (PARTITION BY phase, symbol ORDER BY anchor_ns)),
g0 AS (SELECT symbol, unnest(generate_series({anchor('t0', '0')} - {HOUR}, t1 - (t1 % {HOUR}), {HOUR})) AS bar_ns FROM syms, span),
qb AS (SELECT *, {anchor('sip_ns', '0')} AS bar_ns FROM q),
qbar AS (SELECT symbol, bar_ns, count(*) AS nq, max(bid_px) AS high_bid_px, min(bid_px) AS low_bid_px, max(ask_px) AS high_ask_px, min(ask_px) AS low_ask_px, max(sip_ns) AS qns, arg_max(bid_px, sip_ns) AS lb, arg_max(ask_px, sip_ns) AS la, arg_max(bid_sz, sip_ns) AS lbs, arg_max(ask_sz, sip_ns) AS las FROM qb GROUP BY ALL),
qx AS (SELECT qb.symbol, qb.bar_ns, min(sip_ns) FILTER (WHERE ask_px = high_ask_px) AS ha, min(sip_ns) FILTER (WHERE ask_px = low_ask_px) AS lo FROM qb JOIN qbar USING (symbol, bar_ns) GROUP BY ALL),
tbar AS (
  SELECT symbol, bar_ns, count(*) AS nt, sum(CASE WHEN is_buy THEN size ELSE 0 END) AS buy_volume, sum(CASE WHEN NOT is_buy THEN size ELSE 0 END) AS sell_volume, sum(CASE WHEN is_buy THEN size * price ELSE 0 END) AS buy_notional, sum(CASE WHEN NOT is_buy THEN size * price ELSE 0 END) AS sell_notional,
    (count(*) FILTER (WHERE is_buy))::DOUBLE AS buy_trade_count, (count(*) FILTER (WHERE NOT is_buy))::DOUBLE AS sell_trade_count,
    sum(CASE WHEN is_buy AND mid_px > 0 THEN size * (price - mid_px) ELSE 0 END) AS buy_mid_delta_notional, sum(CASE WHEN NOT is_buy AND mid_px > 0 THEN size * (mid_px - price) ELSE 0 END) AS sell_mid_delta_notional,
    sum(CASE WHEN NOT is_buy AND is_dark THEN size * price ELSE 0 END) AS dark_bid_trade_primitive, sum(CASE WHEN is_buy AND is_dark THEN size * price ELSE 0 END) AS dark_ask_trade_primitive,
    max(price) AS high_px, min(price) AS low_px, arg_max(price, sip_ns) AS lt, sum(size) AS sw, sum(size * price) / sum(size) AS m
  FROM sided GROUP BY ALL),
tx AS (SELECT s.symbol, s.bar_ns, min(sip_ns) FILTER (WHERE price = high_px) AS hp, min(sip_ns) FILTER (WHERE price = low_px) AS lp, sum(size * (price - m) * (price - m)) AS m2, sum(size * (price - m) * (price - m) * (price - m)) AS m3 FROM sided s JOIN tbar USING (symbol, bar_ns) GROUP BY ALL),
vb AS (SELECT symbol, bid_exch AS v, bar_ns, arg_max(bid_px, sip_ns) AS x FROM qb GROUP BY ALL),
va AS (SELECT symbol, ask_exch AS v, bar_ns, arg_max(ask_px, sip_ns) AS x FROM qb GROUP BY ALL),
b0 AS (
  SELECT g.symbol, g.bar_ns, coalesce(nq, 0)::DOUBLE AS nq, {ffill('lb', 'g.symbol', 'g.bar_ns')} AS last_bid_px, {ffill('la', 'g.symbol', 'g.bar_ns')} AS last_ask_px, {ffill('lbs', 'g.symbol', 'g.bar_ns')} AS last_bid_sz, {ffill('las', 'g.symbol', 'g.bar_ns')} AS last_ask_sz, {ffill('qns', 'g.symbol', 'g.bar_ns')} AS qns, {ffill('lt', 'g.symbol', 'g.bar_ns')} AS last_trade_px,
    sum(coalesce(nq, 0)) OVER w AS quote_idx, sum(coalesce(nt, 0)) OVER w AS trade_idx
  FROM g0 g LEFT JOIN qbar USING (symbol, bar_ns) LEFT JOIN tbar USING (symbol, bar_ns) WINDOW w AS (PARTITION BY g.symbol ORDER BY g.bar_ns ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
dvb AS (SELECT b.symbol, b.bar_ns, last_bid_px AS best, {ffill('x', 'b.symbol, s.v', 'b.bar_ns')} AS x FROM b0 b JOIN (SELECT DISTINCT symbol, v FROM vb) s ON s.symbol = b.symbol LEFT JOIN vb ON vb.symbol = b.symbol AND vb.v = s.v AND vb.bar_ns = b.bar_ns),
dva AS (SELECT b.symbol, b.bar_ns, last_ask_px AS best, {ffill('x', 'b.symbol, s.v', 'b.bar_ns')} AS x FROM b0 b JOIN (SELECT DISTINCT symbol, v FROM va) s ON s.symbol = b.symbol LEFT JOIN va ON va.symbol = b.symbol AND va.v = s.v AND va.bar_ns = b.bar_ns),
nb AS (SELECT symbol, bar_ns, (count(*) FILTER (WHERE x = best))::DOUBLE AS n FROM dvb GROUP BY ALL),
na AS (SELECT symbol, bar_ns, (count(*) FILTER (WHERE x = best))::DOUBLE AS n FROM dva GROUP BY ALL),
bars AS (
  SELECT b0.symbol, b0.bar_ns, {', '.join(f'coalesce({c}, 0.0) AS {c}' for c in FEATURES_44[:8])}, b0.nq AS bid_quote_count, b0.nq AS ask_quote_count, coalesce(dark_bid_trade_primitive, 0.0) AS dark_bid_trade_primitive, coalesce(dark_ask_trade_primitive, 0.0) AS dark_ask_trade_primitive, b0.nq AS nbbo_quote_rate_primitive,
    {rnd('coalesce((b0.bar_ns - b0.qns) / 1e6, 0.0)')} AS nbbo_staleness_ms_primitive, CASE WHEN last_bid_px IS NOT NULL THEN coalesce(nb.n, 0.0) END AS exchanges_at_bb_primitive, CASE WHEN last_ask_px IS NOT NULL THEN coalesce(na.n, 0.0) END AS exchanges_at_bo_primitive,
    high_px, low_px, high_bid_px, low_bid_px, high_ask_px, low_ask_px, last_bid_px, last_ask_px, last_bid_sz, last_ask_sz, last_trade_px, b0.qns::DOUBLE AS sip_timestamp,
    {rnd('sqrt(m2 / sw)')} AS trade_vol_std_px, {rnd('CASE WHEN sqrt(m2 / sw) > 1e-9 THEN m3 / (sw * sqrt(m2 / sw) * sqrt(m2 / sw) * sqrt(m2 / sw)) WHEN sw IS NOT NULL THEN 0.0 END')} AS trade_vol_skew,
    coalesce((hp - (b0.bar_ns - {HOUR}))::DOUBLE, -1.0) AS high_px_ns, coalesce((lp - (b0.bar_ns - {HOUR}))::DOUBLE, -1.0) AS low_px_ns, coalesce((ha - (b0.bar_ns - {HOUR}))::DOUBLE, -1.0) AS high_ask_px_ns, coalesce((lo - (b0.bar_ns - {HOUR}))::DOUBLE, -1.0) AS low_ask_px_ns, quote_idx::DOUBLE AS quote_idx, trade_idx::DOUBLE AS trade_idx
  FROM b0 LEFT JOIN tbar USING (symbol, bar_ns) LEFT JOIN tx USING (symbol, bar_ns) LEFT JOIN qbar USING (symbol, bar_ns) LEFT JOIN qx USING (symbol, bar_ns) LEFT JOIN nb USING (symbol, bar_ns) LEFT JOIN na USING (symbol, bar_ns)),
qi AS (SELECT phase, symbol, {inclusive('sip_ns', 'offset_ns')} AS anchor_ns, count(*) AS n, max(sip_ns) AS qns, arg_max(bid_px, sip_ns) AS lb, arg_max(ask_px, sip_ns) AS la, arg_max(bid_sz, sip_ns) AS lbs, arg_max(ask_sz, sip_ns) AS las FROM q, ph GROUP BY ALL),
ti AS (SELECT phase, symbol, {inclusive('sip_ns', 'offset_ns')} AS anchor_ns, count(*) AS n, arg_max(price, sip_ns) AS lt FROM t, ph GROUP BY ALL),
term AS (
  SELECT g.phase, g.symbol, g.offset_ns, g.anchor_ns, {ffill('lb', 'g.phase, g.symbol', 'g.anchor_ns')} AS asof_bid_px, {ffill('la', 'g.phase, g.symbol', 'g.anchor_ns')} AS asof_ask_px, {ffill('lbs', 'g.phase, g.symbol', 'g.anchor_ns')} AS asof_bid_sz, {ffill('las', 'g.phase, g.symbol', 'g.anchor_ns')} AS asof_ask_sz, {ffill('lt', 'g.phase, g.symbol', 'g.anchor_ns')} AS asof_trade_px,
    ({ffill('qi.qns', 'g.phase, g.symbol', 'g.anchor_ns')})::DOUBLE AS asof_sip_timestamp, (sum(coalesce(qi.n, 0)) OVER w)::DOUBLE AS asof_quote_idx, (sum(coalesce(ti.n, 0)) OVER w)::DOUBLE AS asof_trade_idx
  FROM grid g LEFT JOIN qi USING (phase, symbol, anchor_ns) LEFT JOIN ti USING (phase, symbol, anchor_ns) WINDOW w AS (PARTITION BY g.phase, g.symbol ORDER BY g.anchor_ns ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
frames AS (SELECT term.phase, term.symbol, term.anchor_ns, {', '.join('term.' + c if c.startswith('asof') else 'bars.' + c for c in FEATURES_44)} FROM term LEFT JOIN bars ON bars.symbol = term.symbol AND bars.bar_ns = term.anchor_ns - term.offset_ns),
v250 AS (SELECT *, sip_ns - (SELECT min(t0) - min(t0) % 86400000000000 FROM span) AS rel FROM ticks WHERE (tick_type = 0 AND bid_px > 0 AND ask_px >= bid_px) OR (tick_type = 1 AND price > 0 AND size > 0)),
lit AS (SELECT v.symbol, v.rel // {QUARTER} AS bucket_col, v.size, v.is_dark, v.price, (m.bid_px + m.ask_px) / 2 AS mid FROM (SELECT * FROM v250 WHERE tick_type = 1) v ASOF LEFT JOIN (SELECT * FROM v250 WHERE tick_type = 0) m ON v.symbol = m.symbol AND v.sip_ns >= m.sip_ns),
lf AS (SELECT symbol, bucket_col, sum(CASE WHEN NOT is_dark AND price > mid + 1e-6 THEN size END) AS vb, sum(CASE WHEN NOT is_dark AND price < mid - 1e-6 THEN size END) AS vs FROM lit GROUP BY ALL),
bq AS (SELECT symbol, rel // {QUARTER} AS bucket_col, (arg_max(bid_px, sip_ns) * 10000)::INT AS bt, (arg_max(ask_px, sip_ns) * 10000)::INT AS at_ FROM v250 WHERE tick_type = 0 GROUP BY ALL),
bg AS (SELECT symbol, unnest(range(0, max(rel // {QUARTER}))) AS bucket_col FROM v250 GROUP BY symbol),
bk AS (SELECT bg.symbol, bg.bucket_col, coalesce(vb, 0.0) AS vb, coalesce(vs, 0.0) AS vs, bt, at_, {ffill('bt', 'bg.symbol', 'bg.bucket_col')} AS fb, {ffill('at_', 'bg.symbol', 'bg.bucket_col')} AS fa FROM bg LEFT JOIN bq USING (symbol, bucket_col) LEFT JOIN lf USING (symbol, bucket_col)),
bk2 AS (SELECT *, coalesce({ffill('CASE WHEN fb > 0 AND fa > fb THEN (fb + fa) / 2 END', 'symbol', 'bucket_col')}, 10000.0) AS mid_ticks, coalesce(fb, first_value(bt IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY bucket_col ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS bid_ticks, coalesce(fa, first_value(at_ IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY bucket_col ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS ask_ticks,
  (vb > 0)::INT + (vb >= 200)::INT + (vb >= 800)::INT + (vs > 0)::INT + (vs >= 200)::INT + (vs >= 800)::INT AS ld, sqrt(vb) + sqrt(vs) AS rt FROM bk),
nowt AS (SELECT symbol, max(sip_ns) AS now_ns FROM ticks GROUP BY symbol),
fm AS (SELECT symbol, arg_min(bid_px, sip_ns) AS fb, arg_min(ask_px, sip_ns) AS fa, min(sip_ns) AS ft FROM mq GROUP BY symbol),
snap AS (SELECT s.symbol, s.sip_ns, qs.bid_px, qs.ask_px, qs.bid_sz, qs.ask_sz, ts.last_trade_px, ts.last_trade_sz, coalesce(ts.n, 0) AS conditions FROM (SELECT symbol, max(sip_ns) AS sip_ns FROM (SELECT symbol, sip_ns FROM q UNION ALL SELECT symbol, sip_ns FROM t) GROUP BY symbol) s
  LEFT JOIN (SELECT symbol, arg_max(bid_px, sip_ns) AS bid_px, arg_max(ask_px, sip_ns) AS ask_px, arg_max(bid_sz, sip_ns) AS bid_sz, arg_max(ask_sz, sip_ns) AS ask_sz FROM q GROUP BY symbol) qs USING (symbol)
  LEFT JOIN (SELECT symbol, arg_max(price, sip_ns) AS last_trade_px, arg_max(size, sip_ns) AS last_trade_sz, count(*) AS n FROM t GROUP BY symbol) ts USING (symbol))
"""


def at_offsets(offsets: str, unit: int) -> str:
    """Micro quotes in force at now less each offset times unit; the first quote before there is one."""
    return f"""at_ AS (SELECT symbol, now_ns, k, now_ns - k * {unit} AS at_ns FROM nowt, (SELECT unnest({offsets}) AS k)),
found AS (SELECT a.symbol, a.k, a.now_ns, coalesce(m.bid_px, fb) AS bid_px, coalesce(m.ask_px, fa) AS ask_px, coalesce((m.bid_px + m.ask_px) / 2, (fb + fa) / 2) AS mid FROM at_ a ASOF LEFT JOIN mq m ON a.symbol = m.symbol AND a.at_ns >= m.sip_ns LEFT JOIN fm ON fm.symbol = a.symbol)"""


def frame(columns: list[str]) -> str:
    return f"{BASE} SELECT symbol, bar_ns, {', '.join(columns)} FROM bars"


SQL: dict[str, str] = {
    "ticks_normalized": f"{BASE} SELECT * FROM ticks",
    "universe_filter": f"{BASE} SELECT symbol, tick_type, count(*) AS n FROM ticks WHERE symbol IN ('S1', 'S3', 'S5') GROUP BY ALL",
    "quote_valid": f"{BASE} SELECT symbol, count(*) FILTER (WHERE tick_type = 0 AND bid_px > 0 AND ask_px > 0) AS two_sided, count(*) FILTER (WHERE tick_type = 0 AND bid_px > 0 AND ask_px >= bid_px) AS not_crossed, count(*) FILTER (WHERE tick_type = 1 AND price > 0 AND size > 0) AS sized_trades FROM ticks GROUP BY symbol",
    "quote_dedup": f"{BASE} SELECT symbol, seq, bid_px, ask_px FROM q",
    "quote_dedup_drop_count": f"{BASE} SELECT symbol, count(*) AS valid, count(*) FILTER (WHERE repeat) AS dropped FROM flagged GROUP BY symbol",
    "micro_dedup": f"{BASE} SELECT symbol, seq, bid_px, ask_px, bid_exch FROM mq",
    "tick_merge_order": f"{BASE} SELECT symbol, seq, row_number() OVER (PARTITION BY symbol ORDER BY sip_ns, tick_type, seq)::INT AS place FROM ticks",
    "max_ticks_limit": f"{BASE} SELECT symbol, seq, sip_ns FROM ticks ORDER BY sip_ns, tick_type, symbol, seq LIMIT 1000",
    "mid_spread": f"{BASE} SELECT seq, CASE WHEN bid_px > 0 AND ask_px > 0 THEN (bid_px + ask_px) / 2 END AS mid_px, CASE WHEN bid_px > 0 AND ask_px > 0 THEN ask_px - bid_px END AS spread_px, CASE WHEN price > 0 THEN price * size END AS notional FROM ticks",
    "bars5_phase0": f"{BASE} SELECT * FROM b5 WHERE phase = 'p0'",
    "bars5_phase30m": f"{BASE} SELECT * FROM b5 WHERE phase = 'p30'",
    "log_returns": f"{BASE} SELECT phase, symbol, anchor_ns, log_ret_1s, log_ret_5s, log_ret_15s FROM b5",
    "bar_price_fallback": f"{BASE} SELECT phase, symbol, anchor_ns, price FROM pr",
    "vol_bar": f"{BASE} SELECT phase, symbol, anchor_ns, vol_1s FROM st",
    "spread_bps_ffill": f"{BASE} SELECT phase, symbol, anchor_ns, spread_bps FROM b5",
    "dense_grid": f"{BASE} SELECT phase, symbol, anchor_ns FROM grid",
    "asof_lagged_quote": f"{BASE} SELECT symbol, seq, a_ns, a_bid, a_ask FROM tf",
    "asof_venue_quote": f"{BASE} SELECT symbol, seq, mid_px, mid_from FROM mids",
    "asof_point_in_time": f"{BASE} SELECT g.symbol, g.anchor_ns AS at_ns, coalesce(q.sip_ns, f_ns) AS quote_ns, coalesce(q.bid_px, f_bid) AS bid_px, coalesce(q.ask_px, f_ask) AS ask_px FROM (SELECT * FROM grid WHERE phase = 'p30') g ASOF LEFT JOIN q ON g.symbol = q.symbol AND g.anchor_ns >= q.sip_ns LEFT JOIN fq ON fq.symbol = g.symbol",
    "trade_side": f"{BASE} SELECT symbol, seq, mid_px, is_buy FROM sided",
    "bar_flow": frame(FEATURES_44[:6]),
    "bar_mid_delta": frame(FEATURES_44[6:8]),
    "bar_dark_notional": frame(FEATURES_44[10:12]),
    "bar_quote_counts": frame(["bid_quote_count", "ask_quote_count", "nbbo_quote_rate_primitive"]),
    "bar_hilo": frame(FEATURES_44[16:22]),
    "bar_hilo_first_ts": frame(FEATURES_44[30:34]),
    "bar_prevailing": frame(FEATURES_44[22:28]),
    "bar_staleness": frame(["nbbo_staleness_ms_primitive"]),
    "bar_venues_at_best": frame(FEATURES_44[14:16]),
    "bar_weighted_std": frame(["trade_vol_std_px"]),
    "bar_weighted_skew": frame(["trade_vol_skew"]),
    "bar_cum_index": frame(["quote_idx", "trade_idx"]),
    "frame44": f"{BASE} SELECT * FROM frames",
    "terminal_asof": f"{BASE} SELECT phase, symbol, anchor_ns, {', '.join(FEATURES_44[36:])} FROM term",
    "bucket_flow": f"{BASE} SELECT symbol, bucket_col, vb AS lit_buy_vol, vs AS lit_sell_vol FROM bk",
    "bucket_ticks_ffill": f"{BASE} SELECT symbol, bucket_col, bid_ticks, ask_ticks, mid_ticks FROM bk2",
    "bucket_trailing_baseline": f"{BASE} SELECT symbol, bucket_col, greatest(sum(ld) OVER w, 1)::DOUBLE AS cnt_15m, round(greatest(sum(rt) OVER w, 1.0), 4) AS q_15m FROM bk2 WINDOW w AS (PARTITION BY symbol ORDER BY bucket_col ROWS BETWEEN 95 PRECEDING AND CURRENT ROW)",
    "micro_lookback_mids": f"{BASE}, {at_offsets('[1, 2, 3, 5, 10, 30]', HOUR)} SELECT symbol, max(now_ns) AS now_ns, {', '.join(f'max(mid) FILTER (WHERE k = {k}) AS mid_{k}s_ago' for k in (1, 2, 3, 5, 10, 30))}, max(bid_px) FILTER (WHERE k = 5) AS bid_5s_ago, max(ask_px) FILTER (WHERE k = 5) AS ask_5s_ago FROM found GROUP BY symbol",
    "micro_quote_vol": f"{BASE}, {at_offsets('range(0, 21)', QUARTER)}, r AS (SELECT symbol, k, CASE WHEN k < 20 THEN coalesce(mid / lead(mid) OVER (PARTITION BY symbol ORDER BY k) - 1, 0) END AS r FROM found) SELECT symbol, {rnd('sqrt(greatest(sum(r * r) / 20 - (sum(r) / 20) * (sum(r) / 20), 0)) * 1e4')} AS quote_vol_5s_bps FROM r GROUP BY symbol",
    "micro_trade_5s": f"""{BASE},
ma AS (SELECT t.*, a.sip_ns AS la_ns, a.bid_px AS la_bid, a.ask_px AS la_ask FROM t ASOF LEFT JOIN (SELECT symbol, sip_ns + {MINUTE} AS at_, sip_ns, bid_px, ask_px FROM mq) a ON t.symbol = a.symbol AND t.sip_ns >= a.at_),
mf AS (SELECT ma.*, coalesce(la_ns, CASE WHEN ft <= sip_ns THEN ft END) AS a_ns, CASE WHEN la_ns IS NOT NULL THEN (la_bid + la_ask) / 2 WHEN ft <= sip_ns THEN (fb + fa) / 2 END AS a_mid FROM ma LEFT JOIN fm USING (symbol)),
mb AS (SELECT mf.*, b.sip_ns AS b_ns, b.part_ns AS b_part, (b.bid_px + b.ask_px) / 2 AS b_mid FROM mf ASOF LEFT JOIN mq b ON mf.symbol = b.symbol AND mf.trade_exch = b.bid_exch AND mf.sip_ns >= b.sip_ns),
mm AS (SELECT *, CASE WHEN b_ns IS NOT NULL AND b_part <= part_ns AND (a_ns IS NULL OR b_ns > a_ns) THEN b_mid ELSE a_mid END AS mid FROM mb),
ms AS (SELECT *, CASE WHEN price > mid THEN true WHEN price < mid THEN false WHEN price > lag(price) OVER w THEN true WHEN price < lag(price) OVER w THEN false END AS sign FROM mm WINDOW w AS (PARTITION BY symbol ORDER BY sip_ns, seq)),
md AS (SELECT *, coalesce({ffill('sign', 'symbol', 'sip_ns, seq')}, true) AS buy FROM ms),
mw AS (SELECT n.symbol, now_ns - sip_ns AS age, price, size, buy FROM nowt n LEFT JOIN md USING (symbol))
SELECT symbol, count(*) FILTER (WHERE age < 3 * {HOUR}) AS trade_count_3s, coalesce(sum(size) FILTER (WHERE age < 5 * {HOUR}), 0.0) AS trade_vol_5s,
  {rnd(f'CASE WHEN sum(size) FILTER (WHERE age < 5 * {HOUR}) > 0 THEN sum(size * price) FILTER (WHERE age < 5 * {HOUR}) / sum(size) FILTER (WHERE age < 5 * {HOUR}) ELSE 0.0 END')} AS vwap_5s,
  {rnd(f'CASE WHEN sum(size) FILTER (WHERE age < 5 * {HOUR}) > 0 THEN sum(CASE WHEN buy THEN size ELSE -size END) FILTER (WHERE age < 5 * {HOUR}) / sum(size) FILTER (WHERE age < 5 * {HOUR}) ELSE 0.0 END')} AS trade_imbalance_5s FROM mw GROUP BY symbol""",
    "snapshot_latest": f"{BASE} SELECT *, (bid_px + ask_px) / 2 AS mid_px, ask_px - bid_px AS spread_px FROM snap",
    "rth_filter": f"{BASE} SELECT symbol, seq FROM (SELECT *, make_timestamp(sip_ns // 1000) - INTERVAL 5 HOUR AS l FROM ticks) WHERE isodow(l) < 6 AND l::TIME >= TIME '09:30:00' AND l::TIME <= TIME '16:00:00'",
    "window_read": f"{BASE} SELECT phase, symbol, anchor_ns, buy_volume, last_bid_px, last_trade_px FROM frames, span WHERE phase = 'p0' AND symbol = 'S3' AND anchor_ns > t1 - (t1 % {HOUR}) - 100 * {HOUR}",
    "window_backfill": f"""{BASE}, r AS (SELECT * FROM frames, span WHERE phase = 'p30' AND symbol = 'S3' AND anchor_ns <= {anchor('t0', str(HALF))} + 59 * {HOUR}),
body AS (SELECT anchor_ns - {HALF} AS row_ns, last_bid_px, last_trade_px, trade_vol_std_px, exchanges_at_bb_primitive, high_px_ns, quote_idx FROM r UNION ALL SELECT anchor_ns, asof_bid_px, asof_trade_px, NULL, NULL, NULL, asof_quote_idx FROM r WHERE anchor_ns = {anchor('t0', str(HALF))} + 59 * {HOUR})
SELECT row_ns, coalesce(last_bid_px, first_value(last_bid_px IGNORE NULLS) OVER a) AS last_bid_px, coalesce(last_trade_px, first_value(last_trade_px IGNORE NULLS) OVER a) AS last_trade_px, coalesce(last_value(trade_vol_std_px IGNORE NULLS) OVER b, 0.0) AS trade_vol_std_px,
  CASE WHEN last_bid_px IS NULL THEN 0.0 ELSE coalesce(exchanges_at_bb_primitive, last_value(exchanges_at_bb_primitive IGNORE NULLS) OVER b) END AS exchanges_at_bb_primitive, CASE WHEN high_px_ns >= 0 THEN row_ns - {HOUR} + high_px_ns ELSE 0.0 END AS high_px_ns, quote_idx
FROM body, span WINDOW a AS (ORDER BY row_ns ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), b AS (ORDER BY row_ns ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
    "history_run": f"{BASE} SELECT phase, symbol, anchor_ns, vol_1s FROM (SELECT *, row_number() OVER (PARTITION BY phase, symbol ORDER BY anchor_ns DESC) AS k FROM b5) WHERE k <= 50",
    "chunk_request": f"""{BASE}, w AS (SELECT t0 - t0 % {HOUR} + 240 * {HOUR} AS s, t0 - t0 % {HOUR} + 300 * {HOUR} AS e FROM span), one AS (SELECT pr.* FROM pr, w WHERE phase = 'p0' AND symbol = 'S3' AND anchor_ns > s AND anchor_ns <= e)
SELECT anchor_ns, {rnd('ln(price / coalesce(lag(price, 1) OVER o, first_value(price) OVER o))', 9)} AS log_ret_1s, vol_1s, row_number() OVER o <= 15 AS cold_start FROM one WINDOW o AS (ORDER BY anchor_ns)""",
    "cold_start_flag": f"{BASE} SELECT phase, symbol, anchor_ns, row_number() OVER (PARTITION BY phase, symbol ORDER BY anchor_ns) <= 15 AS cold_start FROM grid",
    "late_ticks": f"{BASE}, ar AS (SELECT *, sip_ns + CASE WHEN seq % 11 = 0 THEN 5 * {HOUR} ELSE 0 END AS arrival_ns FROM ticks) SELECT symbol, count(*) AS ticks, count(*) FILTER (WHERE {anchor('sip_ns', '0')} + {MINUTE} <= arrival_ns) AS late FROM ar GROUP BY symbol",
    "replica_parity": f"{BASE}, bb AS (SELECT *, CASE WHEN (anchor_ns // {HOUR}) % 50 = 0 THEN vol_1s + 1 ELSE vol_1s END AS v FROM b5 WHERE phase = 'p0') SELECT 'vol_1s' AS feature, count(*) AS rows, round(100.0 * count(*) FILTER (WHERE v = vol_1s) / count(*), 6) AS match_pct, max(abs(v - vol_1s)) AS max_delta FROM bb",
    "anchor_gaps": f"{BASE}, k AS (SELECT DISTINCT phase, anchor_ns FROM grid WHERE (anchor_ns // {HOUR}) % 7 <> 3) SELECT * FROM (SELECT phase, anchor_ns, anchor_ns - lag(anchor_ns) OVER (PARTITION BY phase ORDER BY anchor_ns) AS step_ns FROM k) WHERE step_ns <> {HOUR}",
    "nearest_asof": f"{BASE}, x AS (SELECT t.symbol, t.seq, q.sip_ns AS near_ts, q.bid_px, row_number() OVER (PARTITION BY t.seq ORDER BY abs(q.sip_ns - t.sip_ns), q.sip_ns) AS k FROM t JOIN q USING (symbol)) SELECT symbol, seq, near_ts, bid_px FROM x WHERE k = 1 UNION ALL SELECT symbol, seq, NULL, NULL FROM t WHERE symbol NOT IN (SELECT symbol FROM q)",
    "recorder_rows": f"""{BASE}, s AS (SELECT symbol, anchor_ns, arg_max(bid_px, sip_ns) AS b, arg_max(ask_px, sip_ns) AS a FROM (SELECT *, {anchor('sip_ns', str(HALF))} AS anchor_ns FROM q) GROUP BY ALL), tt AS (SELECT symbol, anchor_ns, arg_max(price, sip_ns) AS p, count(*) AS n FROM (SELECT *, {anchor('sip_ns', str(HALF))} AS anchor_ns FROM t) GROUP BY ALL)
SELECT anchor_ns AS ts_ns, g.symbol, {ffill('b', 'g.symbol', 'g.anchor_ns')} AS bid_px, {ffill('a', 'g.symbol', 'g.anchor_ns')} AS ask_px, {ffill('p', 'g.symbol', 'g.anchor_ns')} AS last_trade_px, (sum(coalesce(n, 0)) OVER (PARTITION BY g.symbol ORDER BY g.anchor_ns ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))::BIGINT AS conditions, b5.vol_1s, b5.spread_bps
FROM (SELECT * FROM grid WHERE phase = 'p30') g LEFT JOIN s USING (symbol, anchor_ns) LEFT JOIN tt USING (symbol, anchor_ns) LEFT JOIN b5 USING (phase, symbol, anchor_ns)""",
    "seq_gap_jitter": f"{BASE}, p AS (SELECT symbol, seq, sip_ns, part_ns FROM ticks WHERE seq % 3 <> 0) SELECT symbol, seq, coalesce(greatest(seq - lag(seq) OVER w - 1, 0), 0) AS missed, coalesce(greatest((sip_ns - lag(sip_ns) OVER w) - (part_ns - lag(part_ns) OVER w), 0), 0) AS jitter_ns FROM p WINDOW w AS (PARTITION BY symbol ORDER BY seq)",
    "order_watch": f"""{BASE}, o AS (SELECT seq AS order_id, symbol, bid_px + 20 AS limit_px, sip_ns AS placed_ns, sip_ns + 6 * {HOUR} AS ended_ns FROM q),
e AS (SELECT symbol, sip_ns, 0 AS k, bid_px, ask_px, NULL::DOUBLE AS price, NULL::DOUBLE AS size FROM q UNION ALL SELECT symbol, sip_ns, 1, NULL, NULL, price, size FROM t),
j AS (SELECT o.*, e.* EXCLUDE symbol FROM o LEFT JOIN e ON o.symbol = e.symbol AND e.sip_ns BETWEEN placed_ns AND ended_ns)
SELECT order_id, symbol, limit_px, max(bid_px) AS max_bid, min(bid_px) AS min_bid, max(ask_px) AS max_ask, min(ask_px) AS min_ask, max((bid_px + ask_px) / 2) AS max_mid, min((bid_px + ask_px) / 2) AS min_mid, {rnd('(min(sip_ns) FILTER (WHERE bid_px > limit_px) - min(placed_ns)) / 1e9')} AS first_jump_s, count(*) FILTER (WHERE price <= limit_px) AS trades_at_limit, count(DISTINCT CASE WHEN price <= limit_px THEN (sip_ns, price, size) END) AS distinct_trades_at_limit FROM j GROUP BY order_id, symbol, limit_px""",
    "json_decode": f"{BASE} SELECT symbol, sip_ns // 1000000 * 1000000 AS sip_ns, tick_type, bid_px, ask_px, price, size FROM ticks",
    "stream_bars44": f"{BASE} SELECT * FROM frames",
    "stream_bars5": f"{BASE} SELECT * FROM b5",
    "parquet_roundtrip": f"{BASE} SELECT symbol, sip_ns, part_ns, tick_type, bid_px, ask_px, bid_sz, ask_sz, CASE WHEN tick_type = 0 THEN CASE WHEN bid_px > 0 AND ask_px > 0 THEN (bid_px + ask_px) / 2 WHEN ask_px > 0 THEN ask_px END ELSE price END AS price, size, is_dark FROM ticks",
    "lineitem_volume": "SELECT 'P' || l_suppkey::VARCHAR AS symbol, date_trunc('day', l_shipdate::TIMESTAMP)::DATE AS day, sum(l_quantity)::DOUBLE AS volume, count(*) AS trades FROM lineitem GROUP BY ALL",
}
