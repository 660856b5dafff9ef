"""Bars from ticks one at a time: the state that a stream keeps for each symbol.

Ticks are plain tuples in the order of FIELDS. The same state gives the same frames as the
batch operators, whatever the micro-batches; beyond them it has the rules for late ticks.
"""

from __future__ import annotations

import math
from bisect import bisect_right

from ..schema import FEATURES_44, NO_PRICE, NO_SPREAD_BPS, OPEN, QUOTE, TRADE

FIELDS = ("sip_ns", "tick_type", "seq", "part_ns", "bid_px", "ask_px", "bid_sz", "ask_sz", "bid_exch", "ask_exch", "price", "size", "trade_exch", "is_dark")
#: Beside OPEN (the stream begins at a time) a kind of row that is no tick: the stream is known to be complete up to a time.
FLUSH = 9

Tick = tuple


def over_zero(x: float | None) -> bool:
    return x is not None and x > 0  # NaN is not


def next_anchor(ts: int, cadence: int, offset: int) -> int:
    return ts - (ts - offset) % cadence + cadence


class Compact:
    """The five features of one phase. There is no late tick: one that comes late counts for the open bar."""

    def __init__(self, cadence: int, offset: int):
        self.cadence, self.offset, self.at = cadence, offset, None
        self.bid = self.ask = self.trade = None
        self.volume, self.prices = 0.0, []

    def open(self, ts: int) -> None:
        if self.at is None:
            self.at = next_anchor(ts, self.cadence, self.offset)

    def flush(self, ts: int) -> list[tuple]:
        out = []
        while self.at is not None and self.at <= ts:
            out.append(self.close())
        return out

    def add(self, t: Tick) -> list[tuple]:
        self.open(t[0])
        out = self.flush(t[0])
        bid, ask, price, size = t[4], t[5], t[10], t[11]
        self.bid = bid if over_zero(bid) else self.bid
        self.ask = ask if over_zero(ask) else self.ask
        if t[1] == TRADE:
            self.trade = price if over_zero(price) else self.trade
            self.volume += size if over_zero(size) else 0.0
        return out

    def close(self) -> tuple:
        if self.trade is not None:
            price = self.trade
        elif self.bid is not None and self.ask is not None:
            price = (self.bid + self.ask) / 2
        else:
            price = next((x for x in (self.bid, self.ask) if x is not None), NO_PRICE)
        self.prices.append(price)
        logs = []
        for back in (1, 5, 15):
            base = self.prices[-1 - back] if len(self.prices) > back else self.prices[0]
            logs.append(0.0 if base == price else math.log(price / base))
        if len(self.prices) > 15:  # the oldest price is the first one until there are sixteen
            del self.prices[:-15]
        spread = NO_SPREAD_BPS if self.bid is None or self.ask is None else (self.ask - self.bid) / price * 1e4
        row = (self.at, *logs, self.volume, spread)
        self.volume, self.at = 0.0, self.at + self.cadence
        return row


class Bar:
    """What one whole-cadence bar gathers."""

    def __init__(self) -> None:
        self.trades: list[tuple] = []  # price, size, buy, mid, dark, time
        self.quotes: list[tuple] = []  # bid, ask, time


class Full:
    """The 44 features of one symbol, for all phases.

    Ticks wait in a buffer until a flush says that nothing earlier is to come; then they are
    taken in order. A tick whose bar is closed by then is late: it is counted and left out of
    bars, but changes the state (last prices, sides, counts, duplicates).
    """

    def __init__(self, cadence: int, phases: list[tuple[str, int]], lag: int):
        self.cadence, self.phases, self.lag = cadence, phases, lag
        self.second: int | None = None  # end of the open bar
        self.anchors: dict[str, int] = {}
        self.waiting: list[Tick] = []
        self.late = self.dropped = self.n_quotes = self.n_trades = 0
        self.last_valid = self.quote = self.trade_px = self.before = None
        self.buy = True
        self.recent: list[tuple] = []  # accepted quotes: time, bid, ask, participant time
        self.by_venue: dict[int, tuple] = {}
        self.venue_bid: dict[int, float] = {}
        self.venue_ask: dict[int, float] = {}
        self.bar = Bar()
        self.closed: dict[int, list] = {}

    def open(self, ts: int) -> None:
        if self.second is None:
            self.second = next_anchor(ts, self.cadence, 0)
            self.anchors = {name: next_anchor(ts, self.cadence, offset) for name, offset in self.phases}
            self.closed[self.second - self.cadence] = self.slots(self.second - self.cadence)

    def add(self, t: Tick) -> None:
        self.open(t[0])
        if t[0] < self.second - self.cadence:
            self.late += 1
            self.take(t, False)
        else:
            self.waiting.append(t)

    def flush(self, until: int) -> list[tuple]:
        """Frames (phase, anchor, slots) of everything up to a time."""
        out: list[tuple] = []
        self.waiting.sort(key=lambda t: (t[0], t[1], t[2]))
        n = bisect_right(self.waiting, until, key=lambda t: t[0])
        ready, self.waiting = self.waiting[:n], self.waiting[n:]
        for t in ready:
            self.advance(t[0], False, out)
            self.take(t, True)
        if self.second is not None:
            self.advance(until, True, out)
        return out

    def advance(self, ts: int, inclusive: bool, out: list[tuple]) -> None:
        """Close bars that end by ts, and frames whose anchor is before ts (or at it)."""
        while True:
            name, at = min(self.anchors.items(), key=lambda x: x[1], default=(None, None))
            frame = at is not None and (at < ts or inclusive and at == ts)
            if self.second <= ts and (not frame or self.second <= at):
                self.closed[self.second] = self.slots(self.second)
                for old in [f for f in self.closed if f < self.second - 2 * self.cadence]:
                    del self.closed[old]
                self.bar, self.second = Bar(), self.second + self.cadence
            elif frame:
                offset = dict(self.phases)[name]
                out.append((name, at, [*self.closed[at - offset], *self.state()]))
                self.anchors[name] = at + self.cadence
            else:
                return

    def take(self, t: Tick, in_bar: bool) -> None:
        ts, kind, _, part = t[:4]
        if kind == QUOTE:
            now = t[4:8]
            if not (over_zero(now[0]) and over_zero(now[1])):
                return
            if now == self.last_valid and not any(x is None or x != x for x in now):
                self.dropped += 1
                return
            self.last_valid = now
            self.quote = (*now, ts)
            self.n_quotes += 1
            self.recent.append((ts, now[0], now[1], part))
            while len(self.recent) > 1 and self.recent[1][0] + self.lag <= ts:
                self.recent.pop(0)
            if t[8] is not None:
                self.by_venue[t[8]] = self.recent[-1]
                if 0 <= t[8] <= 255:
                    self.venue_bid[t[8]] = now[0]
            if t[9] is not None and 0 <= t[9] <= 255:
                self.venue_ask[t[9]] = now[1]
            if in_bar:
                self.bar.quotes.append((now[0], now[1], ts))
        elif kind == TRADE and over_zero(t[10]):
            price, size = t[10], t[11] or 0.0
            mid = self.mid(ts, part, t[12])
            sign = (price > mid) - (price < mid) if mid is not None else 0
            if not sign and self.before is not None:
                sign = (price > self.before) - (price < self.before)
            self.buy = sign > 0 if sign else self.buy
            self.before = self.trade_px = price
            self.n_trades += 1
            if in_bar:
                self.bar.trades.append((price, size, self.buy, mid, bool(t[13]), ts))

    def mid(self, ts: int, part: int, venue: int | None) -> float | None:
        if not self.recent:
            return None
        # the last quote old enough; the list begins with it, or with the symbol's first one
        lagged = self.recent[max(bisect_right(self.recent, ts - self.lag, key=lambda q: q[0]) - 1, 0)]
        own = self.by_venue.get(venue)
        chosen = own if own is not None and own[3] <= part and own[0] > lagged[0] else lagged
        return (chosen[1] + chosen[2]) / 2

    def state(self) -> list:
        bid, ask, bid_sz, ask_sz, ts = self.quote or (None,) * 5
        return [bid, ask, bid_sz, ask_sz, self.trade_px, None if ts is None else float(ts), float(self.n_quotes), float(self.n_trades)]

    def slots(self, end: int) -> list:
        trades, quotes, start = self.bar.trades, self.bar.quotes, end - self.cadence
        buys, sells = [x for x in trades if x[2]], [x for x in trades if not x[2]]
        out: dict[str, float | None] = {}
        for side, some, sign in (("buy", buys, 1), ("sell", sells, -1)):
            out[f"{side}_volume"] = float(sum(x[1] for x in some))
            out[f"{side}_notional"] = float(sum(x[0] * x[1] for x in some))
            out[f"{side}_trade_count"] = float(len(some))
            out[f"{side}_mid_delta_notional"] = float(sum(sign * x[1] * (x[0] - x[3]) for x in some if x[3] is not None and x[3] > 0))
        out["dark_bid_trade_primitive"] = float(sum(x[0] * x[1] for x in sells if x[4]))
        out["dark_ask_trade_primitive"] = float(sum(x[0] * x[1] for x in buys if x[4]))
        out["bid_quote_count"] = out["ask_quote_count"] = out["nbbo_quote_rate_primitive"] = float(len(quotes))
        bid, ask, bid_sz, ask_sz, ts = self.quote or (None,) * 5
        out["nbbo_staleness_ms_primitive"] = 0.0 if ts is None else (end - ts) / 1e6
        out["exchanges_at_bb_primitive"] = None if ts is None else float(sum(v == bid for v in self.venue_bid.values()))
        out["exchanges_at_bo_primitive"] = None if ts is None else float(sum(v == ask for v in self.venue_ask.values()))
        out |= dict(zip(FEATURES_44[22:28], (bid, ask, bid_sz, ask_sz, self.trade_px, None if ts is None else float(ts))))
        for name, some, k in (("px", trades, 0), ("bid_px", quotes, 0), ("ask_px", quotes, 1)):
            for word, f in (("high", max), ("low", min)):
                best = f((x[k] for x in some), default=None)
                out[f"{word}_{name}"] = best
                out[f"{word}_{name}_ns"] = -1.0 if best is None else float(next(x[-1] for x in some if x[k] == best) - start)
        weight = sum(x[1] for x in trades)
        out["trade_vol_std_px"] = out["trade_vol_skew"] = 0.0 if trades else None
        if weight > 0:
            mean = sum(x[0] * x[1] for x in trades) / weight
            std = math.sqrt(sum(x[1] * (x[0] - mean) ** 2 for x in trades) / weight)
            out["trade_vol_std_px"] = std
            if std > 1e-9:
                out["trade_vol_skew"] = sum(x[1] * (x[0] - mean) ** 3 for x in trades) / (weight * std**3)
        out["quote_idx"], out["trade_idx"] = float(self.n_quotes), float(self.n_trades)
        return [out[c] for c in FEATURES_44[:36]]
