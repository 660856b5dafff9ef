"""Substring dedup by level-wise doubling.

A window is min_words consecutive words. A word goes if a window that covers it has a word
sequence that also starts anywhere else, in the same or another document; windows are
judged on the input.

Level by level the length doubles (9, 18, 35 words for 35), and only windows whose inner
window was repeated at one level are taken to the next, until the last level judges whole
windows or no candidate survives. Below the last level a window is stood for by its
minimiser, the inner window of least hash: two equal windows choose equal minimisers, so
none is lost, and about 2 / (min_words - length + 2) of all positions are counted instead
of all.

Rows of equal texts form a class first. A class of two or more is repeated as a whole; one
of its rows takes part, counted twice, so groups of copies cost one member's windows. Counting is by hash with partial sums before each shuffle; a hot passage
is one counted key. The candidates of a document are packed into one row, and they meet
their texts in a join that broadcasts them only below a checked size. Hashes of the last
level have 128 bits, made of 64-bit hashes of words.

The texts of a batch are cut into words and hashed at once (wordhash.Words), and windows and
minimisers run over all of them; starts are those of windows within a text, so none that
reaches into the next text counts.

Null and empty texts have no words. Documents under min_words words lose nothing. Rows
are told apart by their words alone, so null and repeated doc_ids do no harm.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .common import with_text_key
from .wordhash import Words, minima, mixed, windows, words

MIN_WORDS = 35
KEY = T.StructField("_key", T.BinaryType())


def levels(min_words: int) -> list[int]:
    """Lengths that double up to min_words: 9, 18, 35."""
    out = [min_words]
    while out[0] > 12:
        out.insert(0, -(-out[0] // 2))
    return out


def inner(h: np.ndarray, min_words: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the windows of this length, for each whole window the index of its minimiser)."""
    values = windows(h, length)
    return values, minima(values, min_words - length + 1)


def spans(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true."""
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def covered(starts: np.ndarray, min_words: int, n: int) -> np.ndarray:
    """Which of n words lie in a window that starts at one of these."""
    mark = np.zeros(n + 1, np.int64)
    np.add.at(mark, starts, 1)
    np.add.at(mark, np.minimum(starts + min_words, n), -1)
    return np.cumsum(mark)[:n] > 0


def whole_windows(found: Words, c: pa.Array, min_words: int) -> np.ndarray:
    """Which words start a whole window of their text that is a candidate. c: for each text its packed runs of starts, null for all."""
    n = len(found.start)
    edge = np.zeros(n + 1, np.int64)
    every = np.flatnonzero(np.asarray(c.is_null()) & (np.diff(found.first) >= min_words))
    edge[found.first[every]] += 1
    edge[found.first[every + 1] - min_words + 1] -= 1
    packed = [x or b"" for x in c.to_pylist()] if c.null_count < len(c) else []
    if packed:
        runs = np.frombuffer(b"".join(packed), "<i4").reshape(-1, 2) + found.first[np.repeat(np.arange(len(packed)), [len(x) // 8 for x in packed])][:, None]
        edge[runs[:, 0]] += 1
        edge[runs[:, 1]] -= 1
    return np.cumsum(edge[:-1]) > 0


def emitted(source: DataFrame, min_words: int, length: int, last: bool) -> DataFrame:
    """(_key, _w, _h, _g, _at): the windows of one level that are still candidates.

    source: _t, _key, _w (2 if the words occur in several rows, else 1), _c (packed pairs of
    a start and an end: runs of starts of whole windows that are candidates; null for all).
    Below the last level _at is -1 and a hash occurs once in a row, unless it is repeated
    within the document; then _w is 2.
    """
    schema = T.StructType([KEY, T.StructField("_w", T.IntegerType()), T.StructField("_h", T.LongType()), T.StructField("_g", T.LongType()), T.StructField("_at", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t, keys, w, c = batch.columns
            found = Words(t)
            h, row, w = found.hashes(), found.texts(), w.to_numpy()
            starts = np.flatnonzero(whole_windows(found, c, min_words))
            if not len(starts):
                continue
            if last:
                own, other = windows(h, min_words)[starts], windows(mixed(h + np.uint64(0x632BE59BD9B4E019)), min_words)[starts]
                of = row[starts]
                pos, times = starts - found.first[of], w[of]
            else:
                values, least = inner(h, min_words, length)
                chosen = np.unique(least[starts])
                order = np.lexsort((values[chosen], row[chosen]))
                own, of = values[chosen][order], row[chosen][order]
                new = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (of[1:] != of[:-1])]))
                n = np.diff(np.append(new, len(own)))
                own, of = own[new], of[new]
                pos, times, other = np.full(len(own), -1), np.where(n > 1, 2, w[of]), np.zeros(len(own), np.uint64)
            for k in range(0, len(own), 200_000):
                cut = slice(k, k + 200_000)
                columns = [keys.take(pa.array(of[cut])), times[cut].astype(np.int32), own[cut].view(np.int64), other[cut].view(np.int64), pos[cut].astype(np.int32)]
                yield pa.RecordBatch.from_arrays([columns[0], *map(pa.array, columns[1:])], names=schema.names)

    return source.select("_t", "_key", "_w", "_c").mapInArrow(common.tidy(run), schema)


def survivors(source: DataFrame, packed: DataFrame, min_words: int, length: int) -> DataFrame:
    """(_key, _w, _c): the whole windows whose minimiser of this length is repeated."""
    schema = T.StructType([KEY, T.StructField("_w", T.IntegerType()), T.StructField("_c", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t, keys, w, c, hit = batch.columns
            found = Words(t)
            row = found.texts()
            values, least = inner(found.hashes(), min_words, length)
            starts = np.flatnonzero(whole_windows(found, c, min_words))
            chosen = np.unique(least[starts])
            # a text's own hits: the numbers of both texts go into what is compared
            hits = hit.flatten().to_numpy().view(np.uint64) ^ mixed(np.repeat(np.arange(len(hit)), hit.value_lengths().to_numpy()).astype(np.uint64))
            again = np.zeros(len(row), bool)
            again[chosen] = np.isin(values[chosen] ^ mixed(row[chosen].astype(np.uint64)), hits)
            good = np.zeros(len(row), bool)
            good[starts] = again[least[starts]]
            a, b = spans(good)  # a text's last words start no whole window, so that no run goes from one text to the next
            of, where = np.unique(row[a], return_index=True)
            if not len(of):
                continue
            packed_runs = np.stack([a - found.first[row[a]], b - found.first[row[a]]], 1).astype("<i4")
            runs = [x.tobytes() for x in np.split(packed_runs, where[1:])]
            of = pa.array(of)
            yield pa.RecordBatch.from_arrays([keys.take(of), w.take(of), pa.array(runs, pa.binary())], names=schema.names)

    return source.join(packed, "_key").select("_t", "_key", "_w", "_c", "_hit").mapInArrow(common.tidy(run), schema)


def distinct_texts(df: DataFrame, text: str) -> tuple[DataFrame, DataFrame]:
    """(source, copied). source: _t, _key, _w, one row for each text with words, _w 2 if several rows have it, else 1. copied: the _key of those."""
    every = with_text_key(df.where(common.has_words(F.col(text))), text)
    copied = every.groupBy("_key").agg(F.count(F.lit(1)).alias("_rows")).where("_rows > 1").select("_key")
    copied = common.work_table(copied, "text-copied")
    n = copied.count()
    if not n:
        return common.work_table(every.select("_t", "_key", F.lit(1).alias("_w")), "texts"), copied
    among = common.small(copied, n, 64)
    one = every.join(among, "_key", "left_semi").groupBy("_key").agg(F.min("_t").alias("_t"))
    alone = every.join(among, "_key", "left_anti").select("_t", "_key", F.lit(1).alias("_w"))
    return common.work_table(alone.unionByName(one.select("_t", "_key", F.lit(2).alias("_w"))), "texts"), copied


def repeated_words(df: DataFrame, text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """(_key, _runs): for a text, by its key, the packed runs [start, end) of words that go. Texts that lose nothing have no row."""
    spark = common.ready(df).sparkSession
    source, copied = distinct_texts(df, text)
    candidates = None
    *below, _ = levels(min_words)
    for length in below:
        rows = source.withColumn("_c", F.lit(None).cast("binary")) if candidates is None else joined(source, candidates)
        found = emitted(rows, min_words, length, last=False)
        # written before it is joined, so that the join has shuffles of its own, whose hot partitions Spark can split
        twice = common.work_table(found.groupBy("_h").agg(F.sum("_w").alias("_times")).where("_times > 1").select("_h"), f"substring-twice-{length}")
        hits = common.work_table(found.join(twice, "_h").groupBy("_key").agg(F.collect_list("_h").alias("_hit")), f"substring-hits-{length}")
        n = hits.count()
        if not n:
            return spark.createDataFrame([], T.StructType([KEY, T.StructField("_runs", T.BinaryType())])).unionByName(whole(copied))
        size = hits.agg(F.sum(F.size("_hit"))).first()[0] * 8 + 64 * n
        before, candidates = candidates, common.work_table(survivors(rows, common.small(hits, size, 1), min_words, length), f"substring-level-{length}")
        common.drop_table(hits)
        common.drop_table(twice)
        if before is not None:
            common.drop_table(before)
    rows = source.withColumn("_c", F.lit(None).cast("binary")) if candidates is None else joined(source, candidates)
    found = emitted(rows, min_words, min_words, last=True)
    # each distinct window with its rows' weights; partial sums come before the shuffle
    twice = common.work_table(found.groupBy("_h", "_g").agg(F.sum("_w").alias("_times")).where("_times > 1").select("_h", "_g"), "substring-twice")
    starts = found.where("_w = 1").join(twice, ["_h", "_g"]).groupBy("_key").agg(F.collect_list("_at").alias("_starts"))
    schema = T.StructType([KEY, T.StructField("_runs", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for hit in batch.column(1).to_pylist():
                at = np.array(hit, np.int64)
                out.append(np.stack(spans(covered(at, min_words, int(at.max()) + min_words)), 1).astype("<i4").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=schema.names)

    out = common.work_table(starts.mapInArrow(common.tidy(run), schema).unionByName(whole(copied)), "substring-runs")
    for used in (source, twice, candidates):
        if used is not None:
            common.drop_table(used)
    return out


#: In place of runs: every word, if there is a window at all.
ALL = b"*"


def whole(copied: DataFrame) -> DataFrame:
    """The mark for the texts that occur in several rows."""
    return copied.select("_key", F.lit(ALL).alias("_runs"))


def joined(source: DataFrame, candidates: DataFrame) -> DataFrame:
    n = candidates.count()
    size = candidates.agg(F.coalesce(F.sum(F.length("_c")), F.lit(0))).first()[0] + 64 * n
    return source.join(common.small(candidates.select("_key", "_c"), size, 1), "_key")


def with_runs(df: DataFrame, text: str, min_words: int, keep: list[str]) -> DataFrame:
    """The kept columns (by position, under other names, as theirs may clash), _t and _runs."""
    runs = repeated_words(df, text, min_words)
    n = runs.count()
    size = runs.agg(F.coalesce(F.sum(F.length("_runs")), F.lit(0))).first()[0] + 64 * n
    names = [f"__{k}" for k in range(len(keep))]
    plain = df.select(*(df[c].alias(n) for c, n in zip(keep, names)), df[text].alias("__text"))
    return with_text_key(plain, "__text", names).join(common.small(runs, size, 1), "_key", "left").select(*names, "_t", "_runs")


def kept_spans(n: int, runs: bytes | None, min_words: int) -> list[tuple[int, int]]:
    """Starts and ends of what stays of n words."""
    if runs == ALL:
        gone = [[0, n]] if n >= min_words else []
    else:
        gone = np.frombuffer(runs or b"", "<i4").reshape(-1, 2).tolist()
    edges = [0, *(x for run in gone for x in run), n]
    return [(a, b) for a, b in zip(edges[::2], edges[1::2]) if a < b]


def kept_words(found: list[bytes], runs: bytes | None, min_words: int) -> list[bytes]:
    return [x for a, b in kept_spans(len(found), runs, min_words) for x in found[a:b]]


def digest(df: DataFrame, text: str = "text", min_words: int = MIN_WORDS, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns with n_words, n_removed and kept_sha256, for each row."""
    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = Words(batch.column(batch.num_columns - 2))
            n, gone, sha = np.diff(found.first), [], []
            plain, start, end = found.spaced()
            plain = memoryview(plain)
            for k, r, size in zip(found.first.tolist(), batch.column(batch.num_columns - 1).to_pylist(), n.tolist()):
                parts = [(k + a, k + b) for a, b in kept_spans(size, r, min_words)]
                gone.append(size - sum(b - a for a, b in parts))
                sha.append(hashlib.sha256(b" ".join([plain[start[a] : end[b - 1]] for a, b in parts])).hexdigest())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string())], names=schema.names)

    return with_runs(df, text, min_words, list(keep)).mapInArrow(common.tidy(run), schema)


def remove(df: DataFrame, text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """df with the repeated words taken out of its texts. A text that loses none stays as it is; the kept words of others are joined by one space."""
    keep = [c for c in df.columns if c != text]
    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField(text, T.StringType())])

    def removed(t: str | None, runs: bytes | None) -> str | None:
        if not runs:
            return t
        found = words(t)
        left = kept_words(found, runs, min_words)
        return t if len(left) == len(found) else b" ".join(left).decode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [removed(t, r) for t, r in zip(batch.column(batch.num_columns - 2).to_pylist(), batch.column(batch.num_columns - 1).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(out, pa.string())], names=schema.names)

    return with_runs(df, text, min_words, keep).mapInArrow(common.tidy(run), schema).select(*df.columns)
