"""Ticks by hand and at random."""

from __future__ import annotations

import random

from barloom.schema import QUOTE, TICKS, TRADE

S = 1_000_000_000
MS = 1_000_000
BASE = 1_704_207_600 * S  # a Tuesday, 10:00 in New York


def quote(ts, bid, ask, symbol="A", seq=0, exch=1, ask_exch=2, bid_sz=1.0, ask_sz=1.0, part=None):
    return (symbol, ts, ts if part is None else part, QUOTE, seq, bid, ask, bid_sz, ask_sz, exch, ask_exch, None, None, None, None)


def trade(ts, price, size, symbol="A", seq=0, exch=1, dark=False, part=None):
    return (symbol, ts, ts if part is None else part, TRADE, seq, None, None, None, None, None, None, price, size, exch, dark)


def frame(spark, rows):
    return spark.createDataFrame(rows, TICKS)


def phases(spark, rows=(("p0", 0, 0, "A"),)):
    return spark.createDataFrame(list(rows), "phase string, phase_id int, offset_ns long, symbol string")


def random_ticks(n=400, seed=0, symbols=("A", "B"), span=40 * S, base=BASE, on_lattice=0.1):
    """Quotes and trades with repeated times, ties, invalid quotes, ticks on whole and half seconds."""
    rng = random.Random(seed)
    out = []
    for k in range(n):
        ts = base + (rng.randrange(span // (S // 2)) * (S // 2) if rng.random() < on_lattice else rng.randrange(span // MS) * MS)
        s = rng.choice(symbols)
        if rng.random() < 0.6:
            bid = rng.choice([0.0, 10.0, 10.1, 10.2, 10.3])
            out.append(quote(ts, bid, rng.choice([0.0, 10.2, 10.3, 10.4]), s, k, rng.randrange(4), rng.randrange(4), float(rng.randrange(1, 3)), 1.0, ts - rng.randrange(5) * MS))
        else:
            out.append(trade(ts, rng.choice([10.0, 10.1, 10.15, 10.2, 10.25, 10.3]), float(rng.randrange(1, 5) * 50), s, k, rng.randrange(4), rng.random() < 0.2, ts - rng.randrange(5) * MS))
    return out


def model_tick(row):
    """A row of TICKS as the streaming model takes it."""
    s, sip, part, kind, seq, bid, ask, bsz, asz, bx, ax, px, sz, tx, dark = row
    return (sip, kind, seq, part, bid, ask, bsz, asz, bx, ax, px, sz, tx, dark)


def close(a, b, tol=1e-7):
    if a is None or b is None:
        return a is None and b is None
    return abs(a - b) <= tol * max(1.0, abs(a), abs(b))
