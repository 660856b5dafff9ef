"""Exact top-k by inner product of integers, with pivot-table elimination.

Every row's distances to a number of pivots, and to the origin, are computed once. Together
they fix a row's place in the pivots' span and its distance from that span, so the table
holds these: coordinates and height. Of all lower bounds of a distance that the pivots
allow, the greatest is that of two rows whose heights point the same way; with both norms it
is an upper bound of their inner product: the product of the coordinates plus the product
of the heights. (The plain bound, the largest difference of distances to one pivot, leaves
98 % of rows of 64 even dimensions.) Rows are evaluated in the order of their bounds until
the next bound is under the k-th best score; so nothing that could count is left out, and
ties are evaluated. A first k-th best comes from a bounded sample.

Queries go in blocks of bounded bytes: a block is broadcast, and every part of the table
answers with its own k best for each query. Answers of all blocks go into one table.

Components become floor(scale * x), x as double. Null vectors and those with null or
non-finite components take no part, nor do rows without vec_id; an empty table, or one
without such rows, gives an empty result. Shorter vectors count as padded with zeros. A
query is one vec_id, with the least of its vectors if there are several; rows repeated as a
whole are one candidate, and of several vectors under one vec_id the best counts. Scores
beyond 64 bits stop at the ends of their range. Further columns, whatever their names, are
left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .ann import usable

PIVOTS, SAMPLE = 48, 2048
#: Bytes of a block of queries; rows whose bounds are sorted together; queries bounded at once; rows evaluated between looks at the k-th best.
BLOCK_BYTES, CHUNK, TOGETHER, STEP = 8 << 20, 8192, 256, 64
ENDS = (-(1 << 63), (1 << 63) - 1)


def whole_numbers(vectors: list, dims: int, scale: float) -> np.ndarray:
    """floor(scale * x) as float64, which holds these exactly: x times a power of two, cut to an integer."""
    x = np.zeros((len(vectors), dims))
    for k, v in enumerate(vectors):
        x[k, : len(v)] = v
    return np.floor(x * scale)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of rows, as int64."""
    most = max(1.0, float(np.abs(a).max(initial=0))) * max(1.0, float(np.abs(b).max(initial=0))) * max(1, a.shape[1])
    if most < 2.0**53:
        return (a @ b.T).astype(np.int64)  # every partial sum is exact
    if most < 2.0**62:
        return a.astype(np.int64) @ b.astype(np.int64).T
    out = np.array([[int(x) for x in r] for r in a], object) @ np.array([[int(x) for x in r] for r in b], object).T
    return np.clip(out, *ENDS).astype(np.int64)


def spread_pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """Rows far from each other, each the farthest from those before."""
    chosen = [int(np.argmax((sample**2).sum(1)))] if len(sample) else []
    if not chosen:
        return sample
    gap = ((sample - sample[chosen[0]]) ** 2).sum(1)
    while len(chosen) < min(n, len(sample)) and gap.max() > 0:
        chosen.append(int(gap.argmax()))
        gap = np.minimum(gap, ((sample - sample[chosen[-1]]) ** 2).sum(1))
    return sample[chosen]


def span_of(pivots: np.ndarray) -> np.ndarray:
    """Orthonormal columns that span the pivots."""
    if not len(pivots):
        return np.zeros((pivots.shape[1], 0))
    u, size, _ = np.linalg.svd(pivots.T, full_matrices=False)
    return u[:, size > 1e-9 * max(size[0], 1e-300)]


def places(x: np.ndarray, span: np.ndarray) -> np.ndarray:
    """For each row the coordinates in the span, the height over it and the squared norm."""
    with np.errstate(invalid="ignore", over="ignore"):
        at, square = x @ span, (x**2).sum(1)
        return np.column_stack([at, np.sqrt(np.maximum(0, square - (at**2).sum(1))), square])


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of distinct ids, ties to the smaller."""
    order = np.lexsort((ids, ~scores))  # ~ turns the order round without overflow
    once = np.sort(np.unique(ids[order], return_index=True)[1])[:k]
    return ids[order][once], scores[order][once]


def bounds(q: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Upper bounds of the inner products of places, queries by rows, with what rounding could matter; infinite where squares leave the range."""
    with np.errstate(invalid="ignore", over="ignore"):
        out = q[:, :-1] @ rows[:, :-1].T + 1e-9 * (q[:, -1:] + rows[None, :, -1]) + 1
    return np.where(np.isnan(out), np.inf, out)


def answer(q: np.ndarray, own: int, bound: np.ndarray, ids: np.ndarray, x: np.ndarray, floor: int, k: int, held: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, int]:
    """The k best of held and these rows, and how many rows were evaluated. floor: a score that k rows are known to reach."""
    least = max(int(held[1][-1]), floor) if len(held[0]) >= k else floor
    rows = np.flatnonzero(bound >= least)
    rows = rows[ids[rows] != own]
    rows = rows[np.argsort(-bound[rows], kind="stable")]
    seen, step = 0, max(STEP, 2 * k)
    for a in range(0, len(rows), step):
        least = max(int(held[1][-1]), floor) if len(held[0]) >= k else floor
        some = rows[a : a + step]
        if bound[some[0]] < least:
            break
        some = some[bound[some] >= least]
        seen += len(some)
        score = products(q[None, :], x[some])[0]
        held = best(np.concatenate([held[0], ids[some]]), np.concatenate([held[1], score]), k)
    return held[0], held[1], seen


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, vectors, places) of up to CHUNK rows, from batches that may be much smaller."""

    def made(held: list[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        t = pa.Table.from_batches(held)
        n = t.num_rows
        x, place = (np.frombuffer(b"".join(t.column(c).to_pylist()), np.float64).reshape(n, -1) for c in (1, 2))
        return t.column(0).to_numpy(), x, place

    held, n = [], 0
    for batch in batches:
        while batch.num_rows:
            some = batch.slice(0, CHUNK - n)
            batch = batch.slice(some.num_rows)
            held.append(some)
            n += some.num_rows
            if n == CHUNK:
                yield made(held)
                held, n = [], 0
    if n:
        yield made(held)


def top(vectors: DataFrame, k: int = 10, every: int = 100, scale: float = 1024.0, vec_id: str = "vec_id", embedding: str = "embedding", counts: tuple | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: for each id divisible by every its k highest scores. counts: two accumulators, of pairs evaluated and of all pairs."""
    spark = vectors.sparkSession
    out = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("vec_id", T.LongType()), T.StructField("score", T.LongType())])
    nothing = spark.createDataFrame([], T.StructType([out[0], T.StructField("rank", T.IntegerType()), out[1], out[2]]))
    good = common.ready(vectors).where(F.col(vec_id).isNotNull() & usable(F.col(embedding))).select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("vec"))
    dims = good.agg(F.max(F.size("vec"))).first()[0]
    if dims is None:
        return nothing
    sample = good.orderBy(F.xxhash64("vec_id", F.lit(3)), "vec_id").limit(SAMPLE).collect()
    sample_ids, sample_x = np.array([r[0] for r in sample], np.int64), whole_numbers([r[1] for r in sample], dims, scale)
    span = span_of(spread_pivots(sample_x, PIVOTS))
    index = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("x", T.BinaryType()), T.StructField("place", T.BinaryType())])

    def tabulate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = whole_numbers(batch.column(1).to_pylist(), dims, scale)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in x], pa.binary()), pa.array([r.tobytes() for r in places(x, span)], pa.binary())], names=index.names)

    pivot_table = common.work_table(good.mapInArrow(common.tidy(tabulate), index), "pivot-table")
    asked = common.work_table(pivot_table.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min(F.struct("x", "place")).alias("q")).select("vec_id", "q.x", "q.place"), "pivot-queries")
    most = max(TOGETHER, BLOCK_BYTES // (8 * (dims + span.shape[1] + 3)))
    blocks = -(-2 * asked.count() // most)  # half full on average, as rows are dealt by hash
    answers = None
    for block in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == block).collect()
        if not rows:
            continue
        own = np.array([r[0] for r in rows], np.int64)
        q, q_place = (np.frombuffer(b"".join(r[c] for r in rows), np.float64).reshape(len(rows), -1) for c in (1, 2))
        floors = []
        for a in range(0, len(own), TOGETHER):
            for id_, scores in zip(own[a : a + TOGETHER], products(q[a : a + TOGETHER], sample_x)):
                other = sample_ids != id_
                got = best(sample_ids[other], scores[other], k)[1]
                floors.append(int(got[-1]) if len(got) >= k else ENDS[0])
        shared = spark.sparkContext.broadcast((own, q, q_place, floors))

        def evaluate(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            own, q, q_place, floors = shared.value
            held = [(np.empty(0, np.int64), np.empty(0, np.int64))] * len(own)
            seen = rows = 0
            for ids, x, place in chunks(batches):
                rows += len(ids)
                for a in range(0, len(own), TOGETHER):
                    for n, bound in enumerate(bounds(q_place[a : a + TOGETHER], place), a):
                        found, score, some = answer(q[n], own[n], bound, ids, x, floors[n], k, held[n])
                        held[n], seen = (found, score), seen + some
            if counts:
                counts[0].add(seen)
                counts[1].add(rows * len(own))
            n = [len(h[0]) for h in held]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(own, n)), pa.array(np.concatenate([h[0] for h in held])), pa.array(np.concatenate([h[1] for h in held]))], names=out.names)

        answers = common.append_table(pivot_table.mapInArrow(common.tidy(evaluate), out), "pivot-answers", answers)
        shared.destroy()
    common.drop_table(pivot_table)
    common.drop_table(asked)
    if answers is None:
        return nothing
    once = answers.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return once.withColumn("rank", place.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
