"""Words of a text and hashes of their windows, in numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

MULTIPLIER = 0x9E3779B97F4A7C15 | 1
MIX = np.uint64(0xBF58476D1CE4E5B9)


def words(text: str | None) -> list[bytes]:
    """The runs of [^\\x20\\x09-\\x0D]+ as bytes: bytes.split cuts at exactly these."""
    return text.encode().split() if text else []


def word_hashes(found: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))


class Words:
    """The words of all texts of an Arrow column (null: none), at once: what words() and word_hashes() do text by text, without an object for each word.

    start, end: of each word in the bytes of all texts. first: for each text the index of its first word, and the number of words at the end.
    """

    #: Words of more bytes are hashed one by one.
    LONG = 64

    def __init__(self, column: pa.Array) -> None:
        if column.null_count:
            column = column.fill_null("")
        wide = pa.types.is_large_string(column.type)
        _, ends, data = column.buffers()
        n, at = len(column), column.offset
        offsets = np.frombuffer(ends, np.int64 if wide else np.int32)[at : at + n + 1].astype(np.int64) if n else np.zeros(1, np.int64)
        size = int(offsets[-1] - offsets[0])
        self.bytes = np.zeros(size // 8 * 8 + 16, np.uint8)  # whole words of 8 bytes and one more
        if size:
            self.bytes[:size] = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]
        self.offsets = offsets - offsets[0]
        b = self.bytes[:size]
        self.solid = (b != 32) & (b - np.uint8(9) > 4)
        edges = self.offsets[1:][np.diff(self.offsets) > 0]  # ends of texts that aren't empty
        begins, stops = self.solid.copy(), self.solid.copy()
        begins[1:] &= ~self.solid[:-1]
        stops[:-1] &= ~self.solid[1:]
        begins[edges[:-1]] = self.solid[edges[:-1]]
        stops[edges - 1] = self.solid[edges - 1]
        self.start, self.end = np.flatnonzero(begins), np.flatnonzero(stops) + 1
        self.first = np.searchsorted(self.start, self.offsets)

    def hashes(self) -> np.ndarray:
        """A hash of each word, of its bytes by eights. Not those of word_hashes()."""
        length = self.end - self.start
        out = mixed(self.eight(self.start, length) + length.astype(np.uint64) * np.uint64(MULTIPLIER))
        left, done = np.flatnonzero(length > 8), 8
        while len(left) and done < self.LONG:
            out[left] = mixed(out[left] ^ self.eight(self.start[left] + done, length[left] - done))
            done += 8
            left = left[length[left] > done]
        for k in left.tolist():
            out[k] = xxhash.xxh3_64_intdigest(self.bytes[self.start[k] : self.end[k]])
        return out

    def eight(self, at: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Up to eight bytes from there as a number, zeros after these."""
        whole = self.bytes.view("<u8")
        place, shift = at >> 3, ((at & 7) << 3).astype(np.uint64)
        x = (whole[place] >> shift) | ((whole[place + 1] << np.uint64(1)) << (np.uint64(63) - shift))
        return x & MASKS[np.minimum(length, 8)]

    def texts(self) -> np.ndarray:
        """For each word the number of its text."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def spaced(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(the words of each text with one space between them, starts and ends of the words there)."""
        keep = self.solid.copy()
        length = self.end - self.start
        more = np.ones(len(length), np.int64)
        more[self.first[1:][np.diff(self.first) > 0] - 1] = 0  # nothing follows the last word of a text
        keep[self.end[more > 0]] = True
        start = np.cumsum(length + more) - length - more
        return np.where(self.solid, self.bytes[: len(keep)], np.uint8(32))[keep], start, start + length


#: The low bytes of a number, by how many.
MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * MIX
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def windows(h: np.ndarray, size: int) -> np.ndarray:
    """A hash of each window of size consecutive words: a polynomial in an odd number, mixed."""
    n = len(h) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    # by doubling: the hash of 2k words from two hashes of k
    power, have, out = pow(MULTIPLIER, 1, 1 << 64), 1, h
    rest: np.ndarray | None = None
    rest_size = 0
    need = size
    while need:
        if need & 1:
            if rest is None:
                rest, rest_size = out, have
            else:
                m = len(h) - rest_size - have + 1
                rest = rest[:m] * np.uint64(power) + out[rest_size : rest_size + m]
                rest_size += have
        need >>= 1
        if need:
            m = len(h) - 2 * have + 1
            out = out[:m] * np.uint64(power) + out[have : have + m]
            have, power = 2 * have, power * power % (1 << 64)
    return mixed(rest)


def minima(values: np.ndarray, span: int) -> np.ndarray:
    """For each run of span values the index of the least, the leftmost of equals."""
    n = len(values) - span + 1
    if n <= 0:
        return np.empty(0, np.int64)
    least, best, have = values, np.arange(len(values)), 1
    while have < span:
        step = min(have, span - have)
        left = least[:-step] <= least[step:]
        least, best = np.where(left, least[:-step], least[step:]), np.where(left, best[:-step], best[step:])
        have += step
    return best[:n]
