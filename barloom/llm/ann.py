"""Approximate nearest neighbours by largest inner product: NN-descent and greedy beam search.

Rows of equal vectors form one node; a node keeps the least ids of its rows, a few more
than an answer has, as none can need more. So a vector that a third of all rows share is one
node, and its ties come out exactly. Nodes are told apart by their vectors, not by a hash.

Nodes are dealt to shards by a hash of their number, and vectors travel once, to their shard:
no round of the graph or of the search shuffles. There are SHARDS of them, more where a shard
would pass SHARD_BYTES, so that the work of a query grows far less than the table.

Graph of a shard: a component is added to each vector that makes all norms equal, so that
inner product orders neighbours as distance does. Trees of random hyperplanes halve the nodes
down to leaves, and each leaf gives first neighbours. Then rounds of NN-descent: a node's
list is joined on node ids with the lists of the nodes that it lists and of a sample of those
that list it, and the best stay. Rounds end when few lists change. Lists are arrays of numbers
that hold a score and an id, so one sort ranks them and finds the ids that come twice.

Search: every query meets every shard. It starts at entry nodes drawn from the shard (all
nodes, if there are few), so that it finds enough also where the graph falls apart, as between
opposite clusters. It keeps a beam of the best nodes found and expands the best unexpanded
ones until none is left. Beam and entries grow with the shard and with k. As nodes are dealt
at random, a shard holds more than some of the answer (see share) only by a chance of 1e-9; so
many come back. The best of all shards are scored again on the original vectors in double
precision, and their rows ranked, ties to the smaller id.

Null vectors, zero vectors, and those with null or non-finite components take no part, nor
do rows without vec_id; an empty table, or one without two such vectors, gives an empty
result. Shorter vectors count as padded with zeros. Rows repeated as a whole are one
candidate and one query. If there are fewer than k candidates, all are returned. Further
columns, whatever their names, are left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: Shards at least (if that leaves each LEAST nodes), and bytes of a shard's vectors at most.
SHARDS, LEAST, SHARD_BYTES = 16, 64, 48 << 20
#: Trees, nodes of a leaf at most, neighbours listed, listing nodes sampled, rounds at most, share of changed entries that ends them.
TREES, LEAF, NEIGHBOURS, LISTED_BY, ROUNDS, SETTLED = 12, 256, 24, 8, 6, 0.05
#: Of a list, how many a round reads, and of how many of the nodes listed.
READ, VIA = 16, 8
#: Nodes kept in a beam in a shard of BEAM_NODES (see beam_of), expanded at once, share and number of entry nodes.
BEAM, BEAM_NODES, EXPAND, ENTRY_SHARE, ENTRIES = 64, 3200, 4, 6, 4096
#: Floats gathered at once; queries of a block.
UNIT, BLOCK = 1 << 21, 512
NONE = np.int64(-(2**62))
DEALT = T.StructType([T.StructField("shard", T.IntegerType()), T.StructField("block", T.LongType()), T.StructField("ids", T.BinaryType()), T.StructField("x", T.BinaryType())])
FOUND = T.StructType([T.StructField("node", T.LongType()), T.StructField("ids", T.BinaryType()), T.StructField("scores", T.BinaryType())])


def usable(v: Column) -> Column:
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & finite


def nodes_of(vectors: DataFrame, vec_id: str, embedding: str, most: int) -> tuple[DataFrame, DataFrame]:
    """(nodes: node, vec, members (the most least ids); rows: vec_id and vec of each). Nodes are written, as their numbers depend on the task that gave them."""
    good = vectors.where(F.col(vec_id).isNotNull() & usable(F.col(embedding)) & F.exists(embedding, lambda x: x != 0))
    # adding 0 turns -0 into 0, which are one value
    rows = good.select(F.col(vec_id).cast("long").alias("vec_id"), F.transform(embedding, lambda x: x + F.lit(0).cast("float")).alias("vec")).distinct()
    few = rows.withColumn("_n", F.row_number().over(Window.partitionBy("vec").orderBy("vec_id"))).where(F.col("_n") <= most)
    nodes = few.groupBy("vec").agg(F.sort_array(F.collect_list("vec_id")).alias("members"))
    return common.work_table(nodes.select(F.monotonically_increasing_id().alias("node"), "vec", "members"), "ann-nodes"), rows


# --- lists: rows of numbers that hold a score and an id


def packed(scores: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Numbers that order as the scores do (their last bits aside, which depend on how a product was summed) and hold the id; the last bit is free for a mark."""
    bits = np.ascontiguousarray(scores, np.float32).view(np.int32)
    rising = np.where(bits < 0, bits ^ 0x7FFFFFFF, bits) & ~7
    return (rising.astype(np.int64) << 32 >> 1) | (ids.astype(np.int64) << 1)


def id_of(keys: np.ndarray) -> np.ndarray:
    return (keys >> 1 & 0x3FFFFFFF).astype(np.int32)


def score_of(keys: np.ndarray) -> np.ndarray:
    bits = (keys >> 31).astype(np.int32)
    return np.where(bits < 0, bits ^ 0x7FFFFFFF, bits).astype(np.int32).view(np.float32)


def best(keys: np.ndarray, most: int) -> np.ndarray:
    """The largest of each row in falling order, an id once, of equal ones that with the mark. Copies of an id have almost equal scores, so they lie side by side."""
    keys = -np.sort(-keys, axis=1)
    ident, there = keys >> 1 & 0x3FFFFFFF, keys != NONE
    one, two = (ident[:, 1:] == ident[:, :-1]) & there[:, 1:], (ident[:, 2:] == ident[:, :-2]) & there[:, 2:]
    again = np.zeros(keys.shape, bool)
    again[:, 1:] = one
    again[:, 2:] |= two
    if again.any():
        # a mark must survive, whichever copy came first
        marked = keys & 1
        keys[:, :-1] |= one * marked[:, 1:]
        keys[:, :-2] |= two * marked[:, 2:]
        keys[again] = NONE
        keys = -np.sort(-keys, axis=1)
    return keys[:, :most]


def products(x: np.ndarray, rows: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Inner products of each row with the vectors of its ids."""
    return np.matmul(x[ids], rows[:, :, None])[:, :, 0]


# --- the graph of a shard


def trees(x: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """First lists, from the leaves of trees that halve the nodes by random hyperplanes."""
    n = len(x)
    levels = max(0, math.ceil(math.log2(n / LEAF)))
    size = -(-n // (1 << levels))
    keys = np.empty((n, 0), np.int64)
    for _ in range(TREES if levels else 1):
        blocks = np.concatenate([rng.permutation(n), rng.integers(0, n, (size << levels) - n)]).astype(np.int32)[None]
        for _ in range(levels):
            side = x @ rng.normal(size=x.shape[1]).astype(np.float32)
            at = np.argpartition(side[blocks], blocks.shape[1] // 2, axis=1)
            blocks = np.take_along_axis(blocks, at, 1).reshape(len(blocks) * 2, -1)
        found = np.full((n, min(NEIGHBOURS, size)), NONE)
        step = max(1, UNIT // (size * max(size, x.shape[1])))
        for a in range(0, len(blocks), step):
            some = blocks[a : a + step]
            v = x[some]
            score = np.matmul(v, v.transpose(0, 2, 1))
            key = packed(score, np.broadcast_to(some[:, None, :], score.shape))
            key[some[:, :, None] == some[:, None, :]] = NONE
            if size > NEIGHBOURS:
                key = -np.partition(-key, NEIGHBOURS - 1, axis=2)[:, :, :NEIGHBOURS]
            found[some.ravel()] = key.reshape(-1, key.shape[2])
        keys = np.concatenate([best(np.concatenate([keys[a : a + 16_384], found[a : a + 16_384]], 1), NEIGHBOURS) for a in range(0, n, 16_384)])
    return keys


def listed_by(ids: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """For each node a sample of the nodes that list it; -1: none."""
    n, k = ids.shape
    by, to = np.repeat(np.arange(n, dtype=np.int32), k), ids.ravel()
    draw = rng.permutation(len(to))[: len(to)]
    draw = draw[to[draw] >= 0]
    by, to = by[draw], to[draw]
    order = np.argsort(to, kind="stable")
    by, to = by[order], to[order]
    place = np.arange(len(to)) - np.searchsorted(to, np.arange(n))[to]
    out = np.full((n, LISTED_BY), -1, np.int32)
    take = place < LISTED_BY
    out[to[take], place[take]] = by[take]
    return out


def descend(x: np.ndarray, seed: int = 5) -> np.ndarray:
    """For each node the nodes that it lists, best first, and a sample of those that list it; -1: none."""
    rng = np.random.default_rng(seed)
    keys = trees(x, rng)
    for _ in range(ROUNDS):
        ids = np.where(keys != NONE, id_of(keys), -1)
        by, near, after = listed_by(ids, rng), ids[:, :READ], np.empty_like(keys)
        via = np.concatenate([near[:, :VIA], by], 1)
        step = max(1, UNIT // (via.shape[1] * READ * x.shape[1]))
        for a in range(0, len(x), step):
            some = via[a : a + step]
            ids_of_theirs = np.where(some[:, :, None] >= 0, near[some], -1).reshape(len(some), -1)
            other = np.concatenate([ids_of_theirs, by[a : a + step]], 1)
            bad = (other < 0) | (other == np.arange(a, a + len(some))[:, None])
            other[bad] = 0
            key = packed(products(x, x[a : a + step], other), other)
            key[bad] = NONE
            after[a : a + step] = best(np.concatenate([keys[a : a + step], key], 1), keys.shape[1])
        changed = np.mean(id_of(after) != id_of(keys))
        keys = after
        if changed <= SETTLED:
            break
    ids = np.where(keys != NONE, id_of(keys), -1)
    return np.concatenate([ids, listed_by(ids, rng)], 1)


# --- the search of a shard


def beam_of(n: int, k: int) -> int:
    return max(2 * k + 8, round(BEAM * max(1.0, n / BEAM_NODES) ** 0.4))


def entries_of(n: int, k: int) -> int:
    """Entry nodes of a shard of n."""
    return min(n, max(2 * k + 64, min(ENTRIES, n // ENTRY_SHARE)))


def greedy(x: np.ndarray, graph: np.ndarray, queries: np.ndarray, entries: np.ndarray, beam: int) -> np.ndarray:
    """Beams of the queries as lists."""
    score = queries @ x[entries].T
    keys = best(packed(score, np.broadcast_to(entries, score.shape)), beam)
    if keys.shape[1] < beam:
        keys = np.concatenate([keys, np.full((len(keys), beam - keys.shape[1]), NONE)], 1)
    live = np.arange(len(queries))
    while True:
        now = keys[live]
        unseen = (now & 1 == 0) & (now != NONE)
        pick = unseen & (np.cumsum(unseen, 1) <= EXPAND)
        some = pick.any(1)
        live, now, pick = live[some], now[some], pick[some]
        if not len(live):
            return keys
        at = np.argsort(~pick, axis=1, kind="stable")[:, :EXPAND]
        real = np.take_along_axis(pick, at, 1)
        other = np.where(real[:, :, None], graph[id_of(np.take_along_axis(now, at, 1))], -1).reshape(len(live), -1)
        now[pick] |= 1
        bad = other < 0
        other[bad] = 0
        key = packed(products(x, queries[live], other), other)
        key[bad] = NONE
        keys[live] = best(np.concatenate([now, key], 1), beam)


class Shard:
    """The nodes of one shard, with their graph."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, k: int):
        self.ids, self.beam = ids, beam_of(len(ids), k)
        square = (x.astype(np.float64) ** 2).sum(1)
        self.norm = math.sqrt(square.max())
        self.x = (x / self.norm).astype(np.float32)
        even = np.sqrt(np.maximum(0, 1 - square / self.norm**2)).astype(np.float32)
        self.graph = descend(np.concatenate([self.x, even[:, None]], 1))
        self.entries = np.random.default_rng(17).permutation(len(ids))[: entries_of(len(ids), k)].astype(np.int32)

    def found(self, queries: np.ndarray, most: int) -> list[tuple[bytes, bytes]]:
        """(ids, scores) of each query's best."""
        out = []
        step = max(1, UNIT // (max(EXPAND * self.graph.shape[1], len(self.entries) // 32) * self.x.shape[1]))
        for a in range(0, len(queries), step):
            keys = greedy(self.x, self.graph, queries[a : a + step], self.entries, self.beam)[:, :most]
            ids, scores, real = self.ids[id_of(keys)], score_of(keys).astype(np.float64) * self.norm, (keys != NONE).sum(1).tolist()
            out += [(i[:n].tobytes(), s[:n].tobytes()) for i, s, n in zip(ids, scores, real)]
        return out


# --- in Spark


def dense(batch: pa.RecordBatch, dims: int) -> np.ndarray:
    """The vectors in a batch's column vec, padded."""
    column = batch.column("vec")
    flat, size = column.flatten().to_numpy(zero_copy_only=False), np.diff(column.offsets.to_numpy())
    if (size == dims).all():
        return flat.reshape(len(size), dims).astype(np.float64)
    x = np.zeros((len(size), dims))
    x[np.repeat(np.arange(len(size)), size), np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return x


def dealt_nodes(nodes: DataFrame, shards: int, dims: int) -> DataFrame:
    """DEALT: nodes of a shard, many in a row; block is -1."""
    most = max(256, BLOCK * 1024 // dims)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            if batch.num_rows:
                held.append((batch.column("shard").to_numpy(), batch.column("node").to_numpy(), dense(batch, dims).astype(np.float32)))
            if sum(len(h[0]) for h in held) >= most:
                yield rows(held)
                held = []
        if held:
            yield rows(held)

    def rows(held: list[tuple]) -> pa.RecordBatch:
        shard, node, x = (np.concatenate(c) for c in zip(*held))
        there = np.unique(shard)
        own = [shard == s for s in there]
        return pa.RecordBatch.from_arrays([pa.array(there, pa.int32()), pa.array([-1] * len(own), pa.int64()), pa.array([node[o].tobytes() for o in own], pa.binary()), pa.array([x[o].tobytes() for o in own], pa.binary())], names=DEALT.names)

    shard = F.pmod(F.xxhash64("node", F.lit(17)), F.lit(shards)).cast("int").alias("shard")
    return nodes.select(shard, "node", "vec").mapInArrow(common.tidy(run), DEALT)


def dealt_queries(nodes: DataFrame, shards: int, dims: int) -> DataFrame:
    """DEALT: blocks of queries, of unit norm and in half precision, for every shard; block tells them apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            if batch.num_rows:
                x = dense(batch, dims)
                x /= np.abs(x).max(1)[:, None]
                held.append((batch.column("node").to_numpy(), (x / np.sqrt((x**2).sum(1))[:, None]).astype(np.float16)))
            if sum(len(h[0]) for h in held) >= BLOCK:
                yield row(held)
                held = []
        if held:
            yield row(held)

    def row(held: list[tuple]) -> pa.RecordBatch:
        node, x = (np.concatenate(c) for c in zip(*held))
        return pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array(node[:1], pa.int64()), pa.array([node.tobytes()], pa.binary()), pa.array([x.tobytes()], pa.binary())], names=DEALT.names)

    blocks = nodes.select("node", "vec").mapInArrow(common.tidy(run), DEALT)
    return blocks.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))


def share(k: int, shards: int) -> int:
    """How many of the k best a shard holds at most, but for a chance of 1e-9, if nodes are dealt at random."""
    if shards == 1:
        return k
    p, left = 1 / shards, 1.0
    for r in range(k):
        left -= math.comb(k, r) * p**r * (1 - p) ** (k - r)
        if left < 1e-9 / shards:
            return r
    return k


def searched(nodes: DataFrame, asked: DataFrame, shards: int, dims: int, k: int) -> DataFrame:
    """FOUND: what each shard found for each query."""
    most = share(k, shards)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, shard = None, [], None
        for batch in batches:
            for row in batch.to_pylist():
                if row["shard"] != at:
                    at, held, shard = row["shard"], [], None
                if row["block"] < 0:
                    held.append((np.frombuffer(row["ids"], np.int64), np.frombuffer(row["x"], np.float32).reshape(-1, dims)))
                elif held or shard:
                    if shard is None:
                        shard, held = Shard(*(np.concatenate(c) for c in zip(*held)), k), []
                    found = shard.found(np.frombuffer(row["x"], np.float16).reshape(-1, dims).astype(np.float32), most)
                    yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(row["ids"], np.int64)), *(pa.array(list(c), pa.binary()) for c in zip(*found))], names=FOUND.names)

    both = dealt_nodes(nodes, shards, dims).unionAll(dealt_queries(asked, shards, dims))
    parts = common.partitions(nodes.sparkSession, 4 * shards, 1)
    return both.repartition(parts, "shard").sortWithinPartitions("shard", "block").mapInArrow(common.tidy(run), FOUND)


def chosen(found: DataFrame, parts: int, most: int) -> DataFrame:
    """node, other: the best that all shards found for each query."""
    schema = T.StructType([T.StructField("node", T.LongType()), T.StructField("other", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        t = pa.Table.from_batches(got)
        ids = t.column("ids").to_pylist()
        owner = np.repeat(t.column("node").to_numpy(), [len(i) // 8 for i in ids])
        other, score = np.frombuffer(b"".join(ids), np.int64), np.frombuffer(b"".join(t.column("scores").to_pylist()), np.float64)
        order = np.lexsort((other, -score, owner))
        owner, other = owner[order], other[order]
        place = np.arange(len(owner)) - np.searchsorted(owner, owner)
        take = place < most
        yield pa.RecordBatch.from_arrays([pa.array(owner[take]), pa.array(other[take])], names=schema.names)

    return found.repartition(parts, "node").mapInArrow(common.tidy(run), schema)


def nearest(vectors: DataFrame, k: int = 20, every: int = 20, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose id is divisible by every, its k nearest found."""
    spark = vectors.sparkSession
    out = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("rank", T.IntegerType()), T.StructField("vec_id", T.LongType()), T.StructField("score", T.DoubleType())])
    nodes, rows = nodes_of(common.ready(vectors), vec_id, embedding, k + 4)
    n, dims = nodes.agg(F.count(F.lit(1)), F.max(F.size("vec"))).first()
    if not n or n == 1 and nodes.where(F.size("members") > 1).isEmpty():
        return spark.createDataFrame([], out)
    asked = rows.where(F.col("vec_id") % every == 0).join(nodes.select("vec", "node"), "vec").select("vec_id", "node")
    asked = common.work_table(asked, "ann-queries")
    queries = asked.select("node").distinct()
    n_queries = queries.count()
    # two more than asked for: the query's own node, and one for a row of several vectors
    shards = max(min(SHARDS, n // LEAST) if n > 2 * (k + 4) else 1, -(-4 * n * (dims + 1) // SHARD_BYTES), 1)
    wanted = nodes.join(common.small(queries, n_queries, 16), "node", "left_semi")
    found = common.work_table(searched(nodes, wanted, shards, dims, k + 2), "ann-found")
    pairs = common.work_table(chosen(found, common.partitions(spark, n_queries * shards, 50_000), 2 * k + 2), "ann-pairs")
    common.drop_table(found)
    other = nodes.select(F.col("node").alias("other"), F.col("vec").alias("_v"), "members")
    both = pairs.join(nodes.select("node", "vec"), "node").join(other, "other")
    dot = F.aggregate(F.zip_with("vec", "_v", lambda a, b: F.coalesce(a.cast("double") * b.cast("double"), F.lit(0.0))), F.lit(0.0), lambda a, x: a + x)
    ranked = both.withColumn("score", dot).select("node", "score", F.explode("members").alias("vec_id")).groupBy("node", "vec_id").agg(F.max("score").alias("score"))
    best = Window.partitionBy("node").orderBy(F.desc("score"), "vec_id")
    ranked = common.work_table(ranked.withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= k + 4).select("node", "vec_id", "score"), "ann-ranked")
    common.drop_table(pairs)
    common.drop_table(nodes)
    answer = asked.select(F.col("vec_id").alias("query_id"), "node").join(ranked, "node").where("vec_id <> query_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return answer.withColumn("rank", place.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
