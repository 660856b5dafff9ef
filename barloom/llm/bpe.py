"""Byte-level BPE encoding and decoding without a regular-expression engine.

Text becomes an array of code points, each mapped to a class. What a class means for the
next boundary depends on what came before, so every class (with one or two code points of
lookahead folded in) is a transition function on eight states. Functions compose
associatively: their closure under composition is a small monoid, and a blocked prefix scan
over its multiplication table gives the state before each code point. The boundaries
between pieces follow from state and class.

Pieces then go through a cache of their merged ids. Pieces that are not cached are merged
together, as one flat array: each round merges the leftmost pair of lowest rank of every
piece. Ids keep the byte offsets of their tokens, and decoding joins the tokens' bytes.

Null texts count as empty; empty texts give no ids, and the digest of no bytes.
Repeated rows are encoded each for itself; further columns pass through, but for those
named like a column made here (or _bpe_text), whatever their case: those are left out.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common

# The code points of the Unicode property White_Space.
WHITE_SPACE = [9, 10, 11, 12, 13, 32, 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288]
# The letters of the contractions that the split pattern names.
ONE_LETTER, TWO_LETTERS = "stmd", ("re", "ve", "ll")

END, LETTER, NUMBER, OTHER, SHORT, LONG, SPACES, LAST_BLANK, LAST_OTHER = range(9)
FRESH, IN_LETTERS, IN_NUMBERS, IN_OTHERS, IN_SPACES, PREFIX, ONE_MORE, TWO_MORE = range(8)

#: Code points that are handled at a time; longer texts are cut where a word ends before white space.
BLOCK = 1 << 18
#: Pieces that a worker's cache holds.
CACHE = 100_000
#: Rows that are encoded at a time.
STEP = 128
#: Pieces of more bytes are merged with a heap, one at a time.
LONG_PIECE = 160


def transitions() -> tuple[np.ndarray, np.ndarray]:
    """step[class, state] and starts[class, state]: the next state, and whether a piece starts here."""
    step, starts = np.zeros((9, 8), np.uint8), np.ones((9, 8), bool)
    step[END] = FRESH
    for symbol, inside in ((LETTER, IN_LETTERS), (NUMBER, IN_NUMBERS), (OTHER, IN_OTHERS), (SHORT, IN_OTHERS), (LONG, IN_OTHERS)):
        step[symbol] = inside
        starts[symbol, [inside, PREFIX]] = False
    fresh = [s for s in range(8) if s not in (IN_OTHERS, PREFIX)]
    step[SHORT, fresh], step[LONG, fresh] = ONE_MORE, TWO_MORE
    step[LETTER, ONE_MORE], step[LETTER, TWO_MORE] = FRESH, ONE_MORE
    starts[LETTER, [ONE_MORE, TWO_MORE]] = False
    step[SPACES] = IN_SPACES
    starts[SPACES, IN_SPACES] = False
    step[LAST_BLANK], step[LAST_OTHER] = PREFIX, FRESH
    return step, starts


@lru_cache(1)
def monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(functions, product, step, starts): product[f, g] is f followed by g; the first nine are the classes, the tenth the identity."""
    step, starts = transitions()
    found = [tuple(map(int, row)) for row in step] + [tuple(range(8))]
    index: dict[tuple[int, ...], int] = {}
    for k, f in enumerate(found):
        index.setdefault(f, k)
    k = 0
    while k < len(found):
        for g in range(9):
            f = tuple(found[g][s] for s in found[k])
            if f not in index:
                index[f] = len(found)
                found.append(f)
        k += 1
    product = np.array([[index[tuple(g[s] for s in f)] for g in found] for f in found], np.uint8)
    return np.array(found, np.uint8), product, step, starts


@lru_cache(1)
def classes() -> np.ndarray:
    """Class of each code point; surrogates, which no text holds, mark the ends of texts."""
    out = np.full(0x110000, OTHER, np.uint8)
    for point in range(0x110000):
        kind = unicodedata.category(chr(point))[0]
        if kind in "LN":
            out[point] = LETTER if kind == "L" else NUMBER
    out[WHITE_SPACE] = SPACES
    out[0xD800:0xE000] = END
    return out


def symbols(points: np.ndarray) -> np.ndarray:
    """Classes with the lookahead folded in: the last white space before a piece, and apostrophes that may start a contraction."""
    kind = classes()[points]
    after = np.append(kind[1:], END)
    blank = kind == SPACES
    last = blank & (after != SPACES) & (after != END)
    out = kind.copy()
    out[last] = np.where(points[last] == 32, LAST_BLANK, LAST_OTHER)
    quotes = np.flatnonzero(points == 39)
    if len(quotes):
        more = np.concatenate([points, np.zeros(2, points.dtype)])
        one, two = more[quotes + 1], more[quotes + 2]
        short = np.isin(one, [ord(c) for c in ONE_LETTER])
        long = np.zeros(len(quotes), bool)
        for a, b in TWO_LETTERS:
            long |= (one == ord(a)) & (two == ord(b))
        out[quotes[short]] = SHORT
        out[quotes[long]] = LONG
    return out


def piece_starts(points: np.ndarray) -> np.ndarray:
    """Indices of the code points at which pieces start."""
    _, product, step, starts = monoid()
    n = len(points)
    if not n:
        return np.empty(0, np.int64)
    wide = 256
    rows = -(-n // wide)
    grid = np.full(rows * wide, END, np.uint8)
    grid[:n] = symbols(points)
    grid = np.ascontiguousarray(grid.reshape(rows, wide).T)
    width = product.shape[0]
    flat, identity = product.ravel(), 9
    whole = grid[0].copy()
    for j in range(1, wide):  # each row's composed function
        whole = flat[whole.astype(np.int32) * width + grid[j]]
    reach = 1
    while reach < rows:  # prefix scan of the rows' functions
        whole[reach:] = flat[whole[:-reach].astype(np.int32) * width + whole[reach:]]
        reach *= 2
    functions = monoid()[0]
    state = functions[np.concatenate([[identity], whole[:-1]]).astype(np.intp), FRESH]
    out = np.empty((wide, rows), bool)
    flat_step, flat_starts = step.ravel(), starts.ravel()
    for j in range(wide):
        at = grid[j] * np.uint8(8) + state
        out[j] = flat_starts[at]
        state = flat_step[at]
    return np.flatnonzero(out.T.ravel()[:n])


def parts(text: str, limit: int = BLOCK) -> list[str]:
    """A text cut into parts of about limit code points. A cut has white space after it and none before, where a piece always ends, whatever came before."""
    out, start = [], 0
    while len(text) - start > limit:
        cut = start + limit
        while cut < len(text) and not (text[cut] in " \n" and not text[cut - 1].isspace()):
            cut += 1
        out.append(text[start:cut])
        start = cut
    return [*out, text[start:]]


class Codec:
    """Encoder and decoder for one table of ranks."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {v: k for k, v in ranks.items()}
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        self.cache: dict[bytes, bytes] = {}
        top = max(ranks.values()) + 1
        self.top = top
        keys, ids = [], []
        for token, rank in ranks.items():
            for k in range(1, len(token)):
                a, b = ranks.get(token[:k]), ranks.get(token[k:])
                if a is not None and b is not None:
                    keys.append(a * top + b)
                    ids.append(rank)
        self.bits = max(4, int(np.ceil(np.log2(len(keys) + 1))) + 2)
        size = 1 << self.bits
        table, value = np.full(size, -1, np.int64), np.full(size, top, np.int64)
        key, rank = np.array(keys, np.int64), np.array(ids, np.int64)
        slot, left, self.probes = self._slot(key), np.arange(len(key)), 0
        while len(left):  # open addressing, all keys at a time
            free = table[slot[left]] < 0
            first = np.unique(slot[left][free], return_index=True)[1]
            won = left[free][first]
            table[slot[won]], value[slot[won]] = key[won], rank[won]
            left = np.setdiff1d(left, won, assume_unique=True)
            slot[left] = np.where(table[slot[left]] >= 0, (slot[left] + 1) & (size - 1), slot[left])
            self.probes += 1
        self.table, self.value, self.size = table, value, size

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def pair_ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair's merge; the number of ranks where there is none."""
        key = a * self.top + b
        slot = self._slot(key)
        out = np.where(self.table[slot] == key, self.value[slot], self.top)
        open_ = np.flatnonzero((self.table[slot] != key) & (self.table[slot] >= 0))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & (self.size - 1)
            held = self.table[slot[open_]]
            hit = held == key[open_]
            out[open_[hit]] = self.value[slot[open_[hit]]]
            open_ = open_[~hit & (held >= 0)]
        return out

    def merge(self, pieces: list[bytes]) -> None:
        """Put the ids of these pieces into the cache."""
        short = []
        for p in pieces:
            whole = self.ranks.get(p)
            if whole is not None:
                self.cache[p] = whole.to_bytes(4, "little")
            elif len(p) > LONG_PIECE:
                self.cache[p] = np.array(self.merge_long(p), "<u4").tobytes()
            else:
                short.append(p)
        for k in range(0, len(short), 20_000):
            self._merge_flat(short[k : k + 20_000])

    def _merge_flat(self, pieces: list[bytes]) -> None:
        sizes = np.array([len(p) for p in pieces], np.int64)
        ids = self.single[np.frombuffer(b"".join(pieces), np.uint8)]
        owner = np.repeat(np.arange(len(pieces)), sizes)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(ids):
            rank = np.full(len(ids), self.top, np.int64)
            inner = owner[1:] == owner[:-1]
            rank[:-1][inner] = self.pair_ranks(ids[:-1][inner], ids[1:][inner])
            first = np.flatnonzero(np.concatenate([[True], ~inner]))
            best = np.minimum.reduceat(rank, first)
            span = np.diff(np.append(first, len(ids)))
            live = best < self.top
            keep = np.repeat(live, span)
            done.append((owner[~keep], ids[~keep]))
            at = np.flatnonzero(keep & (rank == np.repeat(best, span)))
            at = at[np.unique(owner[at], return_index=True)[1]]  # the leftmost of each piece
            ids[at] = rank[at]
            keep[at + 1] = False
            ids, owner = ids[keep], owner[keep]
        owner, ids = np.concatenate([d[0] for d in done]), np.concatenate([d[1] for d in done])
        order = np.argsort(owner, kind="stable")
        packed = ids[order].astype("<u4").tobytes()
        ends = np.cumsum(np.bincount(owner, minlength=len(pieces))) * 4
        start = 0
        for p, end in zip(pieces, ends.tolist()):
            self.cache[p] = packed[start:end]
            start = end

    def merge_long(self, piece: bytes) -> list[int]:
        """One long piece: a heap of pairs over a linked list."""
        ids = self.single[np.frombuffer(piece, np.uint8)].tolist()
        after, before = [*range(1, len(ids)), -1], [-1, *range(len(ids) - 1)]
        ranks = self.pair_ranks(np.array(ids[:-1], np.int64), np.array(ids[1:], np.int64)).tolist()
        heap = [(r, k, ids[k], ids[k + 1]) for k, r in enumerate(ranks) if r < self.top]
        heapq.heapify(heap)

        def offer(k: int) -> None:
            if k >= 0 and after[k] >= 0:
                r = self.ranks.get(self.tokens[ids[k]] + self.tokens[ids[after[k]]])
                if r is not None:
                    heapq.heappush(heap, (r, k, ids[k], ids[after[k]]))

        while heap:
            r, k, a, b = heapq.heappop(heap)
            n = after[k]
            if ids[k] != a or n < 0 or ids[n] != b:
                continue
            ids[k], ids[n], after[k] = r, -1, after[n]
            if after[k] >= 0:
                before[after[k]] = k
            offer(before[k])
            offer(k)
        return [x for x in ids if x >= 0]

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers."""
        joined = "\ud800".join(texts) + "\ud800"
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")
        starts = piece_starts(points)
        width = np.ones(len(points), np.int64)
        for least in (0x80, 0x800, 0x10000):
            width += points >= least
        offset = np.concatenate([[0], np.cumsum(width)])
        buffer = joined.encode("utf-8", "surrogatepass")
        cuts = offset[starts].tolist()
        pieces = [buffer[a:b] for a, b in zip(cuts, [*cuts[1:], len(buffer)])]
        ends = np.flatnonzero(points[starts] == 0xD800).tolist()
        mark = pieces[ends[0]]
        missing = set(pieces).difference(self.cache)
        missing.discard(mark)
        if len(self.cache) + len(missing) > CACHE:
            self.cache.clear()
            missing = set(pieces)
            missing.discard(mark)
        if missing:
            self.merge(list(missing))
        out, start, get = [], 0, self.cache.__getitem__
        for end in ends:
            out.append(b"".join(map(get, pieces[start:end])))
            start = end + 1
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """As encode_batch, for texts of any length."""
        out, group, size = [], [], 0
        for text in texts:
            if len(text) > BLOCK:
                out += self.encode_batch(group) if group else []
                group, size = [], 0
                out.append(b"".join(self.encode_batch([p])[0] for p in parts(text)))
                continue
            group.append(text)
            size += len(text)
            if size > BLOCK:
                out += self.encode_batch(group)
                group, size = [], 0
        return out + (self.encode_batch(group) if group else [])

    def offsets(self, ids: bytes) -> np.ndarray:
        """Byte offset of each token in its text."""
        sizes = [len(self.tokens[i]) for i in np.frombuffer(ids, "<u4").tolist()]
        return np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])[:-1].astype(np.int64)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def read_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line)}


_codecs: dict[str, Codec] = {}


def codec(data: bytes) -> Codec:
    """The process's codec for the content of a rank file."""
    key = hashlib.sha256(data).hexdigest()
    if key not in _codecs:
        _codecs[key] = Codec(read_ranks(data))
    return _codecs[key]


def encode(df: DataFrame, rank_file: str, text: str = "text", keep: list[str] | None = None, ids: bool = False) -> DataFrame:
    """The kept columns (all by default) with n_tokens, ids_sha256 and decoded_sha256; with ids also token ids and their byte offsets.

    rank_file is read on the driver; its content (fixed size) is broadcast. One pass, no shuffle.
    """
    from pyspark.sql import types as T

    with open(rank_file, "rb") as f:
        shared = df.sparkSession.sparkContext.broadcast(f.read())
    keep = [c for c in (df.columns if keep is None else keep)]
    made = [("n_tokens", T.LongType()), ("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType())]
    if ids:
        made += [("token_ids", T.ArrayType(T.LongType())), ("token_offsets", T.ArrayType(T.LongType()))]
    clash = {c.lower() for c, _ in made} | {"_bpe_text"}
    keep = [c for c in keep if c.lower() not in clash]
    schema = T.StructType([*(df.schema[c] for c in keep), *(T.StructField(c, t) for c, t in made)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(shared.value)
        for batch in batches:
            for k in range(0, batch.num_rows, STEP):
                part = batch.slice(k, STEP)
                some = own.encode([t or "" for t in part.column(part.num_columns - 1).to_pylist()])
                back = [own.decode(e) for e in some]
                out = [*part.columns[:-1], pa.array([len(e) // 4 for e in some], pa.int64()), pa.array([hashlib.sha256(e).hexdigest() for e in some], pa.string()), pa.array([hashlib.sha256(b).hexdigest() for b in back], pa.string())]
                if ids:
                    out += [pa.array([np.frombuffer(e, "<u4").astype(np.int64) for e in some], pa.list_(pa.int64())), pa.array([own.offsets(e) for e in some], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(out, names=[f.name for f in schema.fields])

    return common.ready(df).select(*[df[c] for c in keep], df[text].alias("_bpe_text")).mapInArrow(common.tidy(run), schema)
