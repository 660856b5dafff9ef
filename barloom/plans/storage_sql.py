"""Equivalent SQL of the queries in storage, for DuckDB."""

from __future__ import annotations

from ..schema import FEATURES_5, FEATURES_44
from .sql import BASE, HALF, HOUR, SQL

DAY = 24 * HOUR
GAP = f"(anchor_ns // {HOUR}) % 7 <> 3"
ENDS = "e AS (SELECT phase, min(anchor_ns) AS a, max(anchor_ns) AS b FROM grid GROUP BY phase)"
CURSORS = f"{ENDS}, cu AS (SELECT DISTINCT g.phase, symbol, b, CASE WHEN g.phase = 'p0' THEN a ELSE b END + {HOUR} AS cursor_ns FROM grid g JOIN e USING (phase))"
REC = f"rec AS ({SQL['recorder_rows']})"
RECORDED = "ts_ns, symbol, bid_px, ask_px, last_trade_px, conditions, vol_1s, spread_bps"
STATS = ("micro_lookback_mids", "micro_quote_vol", "micro_trade_5s")
CHUNK = [c for c in FEATURES_44 if c in {"buy_volume", "last_bid_px", "last_trade_px", "nbbo_staleness_ms_primitive", "trade_vol_std_px", "trade_vol_skew", *FEATURES_44[36:41]}]


def changes(columns: list[str], keys: str, order: str) -> str:
    return " OR ".join([f"lag({order}) OVER w IS NULL", *(f"{c} IS DISTINCT FROM lag({c}) OVER w" for c in columns)]) + f" FROM rec WINDOW w AS (PARTITION BY {keys} ORDER BY {order})"


SQL_STORED: dict[str, str] = {
    "lake_scan": f"{BASE} SELECT symbol, sip_ns, part_ns, tick_type, bid_px, ask_px, size, is_dark FROM ticks, span WHERE sip_ns >= t0 - t0 % {DAY} + 3 * {DAY} AND sip_ns < t0 - t0 % {DAY} + 4 * {DAY}",
    "flat_file_scan": f"{BASE} SELECT symbol, sip_ns, tick_type, bid_px, ask_px, size FROM ticks WHERE symbol IN ('S1', 'S3', 'S6') AND (tick_type = 1 OR bid_px <> 0)",
    "recorded_playback": f"WITH {REC} SELECT {RECORDED}, row_number() OVER (PARTITION BY symbol ORDER BY ts_ns)::INT AS place FROM rec",
    "recorded_config": f"{BASE} SELECT phase, phase_id, offset_ns, symbol, {HOUR} AS cadence_ns FROM ph, syms",
    "playback_from": f"{BASE} SELECT symbol, seq, sip_ns FROM ticks, span WHERE sip_ns >= t0 - t0 % {DAY} + 10 * {DAY}",
    "subscription": "SELECT string_agg('Q.S' || i || ',T.S' || i, ',' ORDER BY i) AS request FROM (SELECT unnest([0, 1, 2, 3, 4, 5, 6, 7, 9]) AS i)",
    "feature_export": f"{BASE} SELECT anchor_ns, phase, symbol, {', '.join(FEATURES_5)} FROM b5",
    "merged_csv": f"{BASE} SELECT CASE WHEN tick_type = 0 THEN 'Q' ELSE 'T' END AS event_type, symbol, sip_ns AS sip_timestamp_ns, bid_px, bid_sz, ask_px, ask_sz, price AS trade_px, size AS trade_sz FROM ticks",
    "raw_spool": f"{BASE} SELECT symbol || ',' || seq AS value, make_timestamp(sip_ns // 1000)::DATE AS date FROM ticks WHERE symbol <> 'S7'",
    "telemetry": f"{BASE} SELECT * FROM b5",
    "snapshot_upsert": f"""{BASE}, r AS (SELECT symbol, max(sip_ns) AS sip_ns, {', '.join(f'arg_max({c}, sip_ns) FILTER (WHERE tick_type = 0) AS {c}' for c in ('bid_px', 'ask_px', 'bid_sz', 'ask_sz'))}, arg_max(price, sip_ns) FILTER (WHERE tick_type = 1) AS last_trade_px, arg_max(size, sip_ns) FILTER (WHERE tick_type = 1) AS last_trade_sz, count(*) FILTER (WHERE tick_type = 1) AS conditions FROM ticks GROUP BY symbol)
SELECT *, CASE WHEN bid_px > 0 AND ask_px > 0 THEN (bid_px + ask_px) / 2 END AS mid_px, CASE WHEN bid_px > 0 AND ask_px > 0 THEN ask_px - bid_px END AS spread_px FROM r""",
    "published_frames": f"{BASE} SELECT * FROM b5",
    "published_symbol": f"{BASE} SELECT * FROM b5 WHERE symbol = 'S3'",
    "relay_delta": f"WITH {REC} SELECT symbol, ts_ns, bid_px, ask_px, last_trade_px FROM (SELECT *, {changes(['bid_px', 'ask_px', 'last_trade_px'], 'symbol', 'ts_ns').replace(' FROM rec', ' AS differs FROM rec')}) WHERE differs",
    "recorder_hours": f"WITH {REC}, h AS (SELECT *, make_timestamp(ts_ns // 1000) - INTERVAL 5 HOUR AS l FROM rec WHERE symbol IN ('S1', 'S2', 'S5')) SELECT {RECORDED} FROM h WHERE isodow(l) < 6 AND l::TIME >= TIME '09:30:00' AND l::TIME <= TIME '16:00:00'",
    "recorder_skipped": f"{BASE}, k AS (SELECT anchor_ns, count(*) AS n, (anchor_ns - lag(anchor_ns) OVER (ORDER BY anchor_ns)) // {HOUR} - 1 AS gap FROM grid WHERE phase = 'p0' AND {GAP} GROUP BY anchor_ns) SELECT coalesce(sum(gap * n) FILTER (WHERE gap > 0), 0)::BIGINT AS skipped, count(*) FILTER (WHERE gap > 0) AS gaps FROM k",
    "status_rows": f"{BASE} SELECT * FROM b5 WHERE (phase, anchor_ns) IN (SELECT (phase, max(anchor_ns)) FROM b5 GROUP BY phase) ORDER BY phase, symbol LIMIT 10",
    "cursors_begin": f"{BASE}, {ENDS} SELECT DISTINCT phase, symbol, a AS cursor_ns, b AS live_ns FROM grid JOIN e USING (phase)",
    "latest_phase_anchor": f"{BASE} SELECT seq, sip_ns - (sip_ns - {HALF}) % {HOUR} AS anchor_ns FROM ticks",
    "cursor_load": f"{BASE}, {CURSORS} SELECT cu.phase, cu.symbol, cursor_ns AS anchor_ns, b5.symbol IS NOT NULL AS found, vol_1s, spread_bps FROM cu LEFT JOIN b5 ON b5.phase = cu.phase AND b5.symbol = cu.symbol AND b5.anchor_ns = cu.cursor_ns",
    "cursor_progress": f"{BASE}, {CURSORS} SELECT min(cursor_ns) AS last_read_anchor_ns FROM cu",
    "cursor_realign": f"{BASE}, {CURSORS} SELECT phase, symbol, CASE WHEN cursor_ns < b - 99 * {HOUR} THEN b ELSE cursor_ns END AS cursor_ns, cursor_ns < b - 99 * {HOUR} AS lagged FROM cu",
    "history_over_gaps": f"{BASE} SELECT phase, symbol, anchor_ns, vol_1s FROM (SELECT *, row_number() OVER (PARTITION BY phase, symbol ORDER BY anchor_ns DESC) AS k FROM b5 WHERE {GAP}) WHERE k <= 50",
    "chunk_full": f"{BASE} SELECT anchor_ns, row_number() OVER (ORDER BY anchor_ns) <= 15 AS cold_start, {', '.join(CHUNK)} FROM frames, span WHERE phase = 'p0' AND symbol = 'S3' AND anchor_ns > t0 - t0 % {HOUR} + 240 * {HOUR} AND anchor_ns <= t0 - t0 % {HOUR} + 300 * {HOUR}",
    "window_buckets": f"""{BASE}, w AS (SELECT now_col, least(now_col - 2, (SELECT max(bucket_col) FROM bk2 WHERE symbol = 'S3')) AS e FROM (SELECT unnest([20, 1000000000])::BIGINT AS now_col)), c AS (SELECT now_col, unnest(generate_series(e - 40, e)) AS col FROM w)
SELECT now_col, col, bid_ticks, ask_ticks, CASE WHEN col < 0 THEN 0.0 ELSE vb END AS lit_buy_vol, CASE WHEN col < 0 THEN 0.0 ELSE vs END AS lit_sell_vol, mid_ticks FROM c JOIN bk2 ON symbol = 'S3' AND bucket_col = greatest(col, 0)""",
    "snapshot_full": f"""SELECT s.*, a.* EXCLUDE symbol, b.* EXCLUDE symbol, c.* EXCLUDE symbol, d.* EXCLUDE symbol FROM ({SQL['snapshot_latest']}) s JOIN {' JOIN '.join(f'({SQL[n]}) {x} USING (symbol)' for n, x in zip(STATS, 'abc'))}
JOIN (SELECT symbol, max(bucket_col) AS last_col_250ms, arg_max(cnt_15m, bucket_col) AS trailing_15m_cnt, round(arg_max(q_15m, bucket_col), 2) AS trailing_15m_q FROM ({SQL['bucket_trailing_baseline']}) GROUP BY symbol) d USING (symbol)""",
    "session_open": f"{BASE}, o AS (SELECT seq, sip_ns, epoch_us(date_trunc('day', make_timestamp(sip_ns // 1000) - INTERVAL 5 HOUR)) * 1000 + 52200000000000 AS open_ns FROM ticks) SELECT seq, CASE WHEN sip_ns <= open_ns + 23400000000000 THEN open_ns ELSE sip_ns - sip_ns % 1000000000 END AS open_ns FROM o",
    "replica_missing": f"{BASE}, own AS (SELECT DISTINCT anchor_ns FROM grid WHERE phase = 'p0'), rep AS (SELECT anchor_ns FROM own WHERE {GAP}) SELECT anchor_ns FROM own WHERE anchor_ns BETWEEN (SELECT min(anchor_ns) FROM rep) AND (SELECT max(anchor_ns) FROM rep) AND anchor_ns NOT IN (SELECT anchor_ns FROM rep)",
    "replica_common": f"{BASE} SELECT DISTINCT anchor_ns FROM grid WHERE phase = 'p0' AND {GAP}",
    "lag_percentile": f"WITH n AS ({SQL['nearest_asof']}), k AS (SELECT n.symbol, abs(near_ts - epoch_us(ts) * 1000) AS lag_ns FROM n JOIN events ON event_id = seq WHERE near_ts IS NOT NULL), r AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY lag_ns) - 1 AS i, count(*) OVER (PARTITION BY symbol) AS c FROM k) SELECT symbol, lag_ns AS value FROM r WHERE i = least(floor(c * 0.99::DOUBLE), c - 1)",
    "stream_bars44_disordered": f"{BASE} SELECT * FROM frames",
}
