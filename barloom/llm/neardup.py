"""Near-duplicate documents: improved consistent weighted sampling over TF-IDF shingles, banded and verified.

Rows of equal texts form a class at once; one of each goes on. A shingle is five
consecutive words (fewer if the text is shorter), its weight tf * idf. idf falls with the
logarithm of the number of distinct texts that have the shingle, from 1 for one text to
IDF_LEAST for all. It is no lower, as the shingles of a text of thousands of copies are
frequent by that alone, and the copies should still be alike.

Document frequencies are exact and of all texts: texts go into blocks of bounded bytes, a
block sends each distinct hash once, with its count, to the task of the hash's range, and
gets back a byte for each, its level of frequency. So a shingle that every text has arrives once
for each block, not once for each text, and nothing is broadcast or collected.

Each text draws 30 samples: for its shingle s of weight w, with r and c from Gamma(2, 1) and
b uniform, all fixed by s, t = floor(ln w / r + b), ln a = ln c - r (t - b + 1); the pair
(s, t) of least a is the sample. Two texts draw the same one with the probability of their
weighted Jaccard similarity. Ten bands of three samples make keys; a band's rows meet at a
hub, so a bucket of n rows gives n - 1 pairs. Buckets of three or more are split again by
three further samples, and once more, each part with its own hub, so that close texts meet
also within a bucket of loosely alike ones. Hubs are drawn by hash and differ by bucket.
What hubs leave in different components of one bucket is then compared row by row: a bucket
over BLOCK rows first tries its most central row, the one with the most company in all
bands, as a hub for as long as that links; then all rows of different components meet in
blocks of bounded size. So each pair of a bucket is in one component or was verified.

A pair is a link if its weighted Jaccard similarity is 0.8 or more. First each text's
likeliest pair is verified, then all pairs that the links found so far leave in different
components. Components give the classes.

Null texts and texts without words are alone. class_id is the least doc_id of a class (a
null doc_id counts as least). Repeated rows share a class. Ties of a keeper go to the least
doc_id, then to any one of equal rows. An empty table gives an empty result. keep_one
returns exactly the input's columns, whatever their names; classes returns its own two.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .common import with_text_key
from .substrings import KEY, distinct_texts
from .wordhash import mixed, windows, word_hashes, words

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS, DEPTH = 10, 3, 4
SAMPLES = BANDS * ROWS
#: idf of a shingle that all texts have; that of one text has 1.
IDF_LEAST = 0.75
#: Bytes of text of a block, and of hashes of a task that counts.
BLOCK_BYTES, COUNT_BYTES = 4 << 20, 48 << 20
#: Levels of document frequency: quarters of a power of two, in a byte.
PER_DOUBLING = 4
#: Rows of a bucket that meet in one group at most, twice.
BLOCK = 256
TABLE_BITS = 16
NO_ID = -(1 << 63)
#: What rounding of sums may lack.
SLACK = 1e-9


def shingles(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, term frequencies), sorted by hash."""
    found = words(text)
    return np.unique(windows(word_hashes(found), min(SHINGLE, max(1, len(found)))), return_counts=True)


TEXTS = pa.schema([("_key", pa.binary()), ("_t", pa.string())])


def packed(keys: list[bytes], texts: list[str]) -> bytes:
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, TEXTS, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_batch(pa.record_batch([pa.array(keys, pa.binary()), pa.array(texts, pa.string())], schema=TEXTS))
    return out.getvalue().to_pybytes()


def unpacked(block: bytes) -> pa.Table:
    return pa.ipc.open_stream(block).read_all()


def in_blocks(source: DataFrame) -> DataFrame:
    """_b, _z: the texts in blocks of BLOCK_BYTES, or of one longer text, compressed, as they are shuffled once. Written, as numbers depend on the task that gave them."""
    schema = T.StructType([T.StructField("_b", T.LongType()), T.StructField("_z", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, size, keys, texts = TaskContext.get().partitionId() << 36, 0, [], []
        for batch in batches:
            for key, t, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), pc.binary_length(batch.column(1)).to_pylist()):
                if keys and size + n > BLOCK_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([packed(keys, texts)], pa.binary())], names=schema.names)
                    number, size, keys, texts = number + 1, 0, [], []
                size += n
                keys.append(key)
                texts.append(t)
        if keys:
            yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([packed(keys, texts)], pa.binary())], names=schema.names)

    return common.work_table(source.select("_key", "_t").mapInArrow(common.tidy(run), schema), "neardup-blocks")


def block_hashes(blocks: DataFrame, ranges: int) -> DataFrame:
    """_p, _b, _h, _c: for each range of hashes the distinct ones of a block and how many of its texts have each."""
    schema = T.StructType([T.StructField("_p", T.IntegerType()), T.StructField("_b", T.LongType()), T.StructField("_h", T.BinaryType()), T.StructField("_c", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b, block in zip(batch.column(0).to_pylist(), batch.column(1)):
                yield sent(b, [shingles(t)[0] for t in unpacked(block.as_buffer()).column("_t").to_pylist()])

    def sent(block: int, held: list[np.ndarray]) -> pa.RecordBatch:
        h, n = np.unique(np.concatenate(held), return_counts=True)
        n = n.astype(np.int32)
        cuts = range_cuts(h, ranges)
        some = [(p, a, b) for p, (a, b) in enumerate(zip(cuts, cuts[1:])) if b > a]
        small = np.uint8 if n.max() < 256 else np.int32
        return pa.RecordBatch.from_arrays([pa.array([p for p, _, _ in some], pa.int32()), pa.array([block] * len(some), pa.int64()), pa.array([thin(h[a:b]) for _, a, b in some], pa.binary()), pa.array([n[a:b].astype(small).tobytes() for _, a, b in some], pa.binary())], names=schema.names)

    return blocks.select("_b", "_z").mapInArrow(common.tidy(run), schema)


def thin(h: np.ndarray) -> bytes:
    """Rising hashes as steps, byte by byte: the high bytes of steps are mostly zero, which a shuffle's compression takes out."""
    return np.diff(h, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T.tobytes()


def thick(b: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(8, -1).T).view(np.uint64).ravel(), dtype=np.uint64)


def range_cuts(h: np.ndarray, ranges: int) -> list[int]:
    """Where the ranges of rising hashes begin and end."""
    return [0, *np.searchsorted(h, np.array([(k << 64) // ranges for k in range(1, ranges)], np.uint64)).tolist(), len(h)]


SHARED = T.StructType([T.StructField("_b", T.LongType()), T.StructField("_p", T.IntegerType()), T.StructField("_l", T.BinaryType())])


def shared_hashes(hashes: DataFrame, parts: int) -> DataFrame:
    """SHARED: back to each block, for a range of its hashes in their order, the levels of their document frequencies; no row where all are 0. Partitions are sized by counted bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        t = pa.Table.from_batches(got)
        del got
        each = [thick(b) for b in t.column(2).to_pylist()]
        ends = np.cumsum([0, *map(len, each)])
        n = np.concatenate([np.frombuffer(b, np.uint8 if len(b) == len(h) else np.int32) for b, h in zip(t.column(3).to_pylist(), each)])
        h = np.concatenate(each)
        del each
        _, at = np.unique(h, return_inverse=True)
        level = levels(np.bincount(at, n)[at])
        out = [(b, p, level[i:j].tobytes()) for p, b, i, j in zip(t.column(0).to_pylist(), t.column(1).to_pylist(), ends[:-1].tolist(), ends[1:].tolist()) if level[i:j].any()]
        for k in range(0, len(out), 500):
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f) for c, f in zip(zip(*out[k : k + 500]), (pa.int64(), pa.int32(), pa.binary()))], names=SHARED.names)

    return hashes.repartition(parts, "_p").select(*hashes.columns).mapInArrow(common.tidy(run), SHARED)


def levels(df: np.ndarray) -> np.ndarray:
    return np.floor(PER_DOUBLING * np.log2(np.maximum(df, 1)) + 1e-9).astype(np.uint8)


def weights(tf: np.ndarray, level: np.ndarray, n: int) -> np.ndarray:
    """tf * idf, where n texts would be the highest frequency."""
    return tf * (1 - (1 - IDF_LEAST) * np.minimum(level / (PER_DOUBLING * np.log2(max(n, 2))), 1))


def weighed(text: str, level: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of a text's shingles, their weights)."""
    h, tf = shingles(text)
    return h, weights(tf, np.frombuffer(level, np.uint8), n)


class Sampler:
    """The random numbers of the samples: tables that a shingle's hash points into, another way for each sample."""

    def __init__(self, seed: int = 11):
        rng, n = np.random.default_rng(seed), 1 << TABLE_BITS
        self.r = rng.gamma(2, 1, n).astype(np.float32)
        self.log_c = np.log(rng.gamma(2, 1, n)).astype(np.float32)
        self.b = rng.random(n, np.float32)
        self.unit = self.log_c - self.r * (1 - self.b)  # ln a for weight 1, where t is 0
        self.turn = (rng.integers(1, 1 << 62, SAMPLES).astype(np.uint64) * np.uint64(2) + np.uint64(1))[:, None]

    def __call__(self, hashes: np.ndarray, w: np.ndarray) -> np.ndarray:
        """The samples of one text, each hashed to 64 bits."""
        best = np.full(SAMPLES, np.inf, np.float32)
        shingle, level = np.zeros(SAMPLES, np.uint64), np.zeros(SAMPLES, np.int64)
        pick = np.arange(SAMPLES)
        for k in range(0, len(hashes), 4096):
            h, weight = hashes[k : k + 4096], w[k : k + 4096]
            at = ((h[None, :] * self.turn) >> np.uint64(64 - TABLE_BITS)).astype(np.int32)
            log_a = self.unit[at]
            t = np.zeros((SAMPLES, 1), np.int64)
            other = np.flatnonzero(weight != 1)
            if len(other):
                i = at[:, other]
                r, b = self.r[i], self.b[i]
                steps = np.floor(np.log(weight[other]).astype(np.float32) / r + b)
                log_a[:, other] = self.log_c[i] - r * (steps - b + 1)
                t = np.zeros(at.shape, np.int64)
                t[:, other] = steps
            least = log_a.argmin(1)
            value = log_a[pick, least]
            less = value < best
            best[less], shingle[less] = value[less], h[least[less]]
            level[less] = t[pick, least][less] if t.shape[1] > 1 else t[less, 0]
        return mixed(shingle ^ mixed(level.view(np.uint64) + np.uint64(1)) ^ (pick.astype(np.uint64) << np.uint64(40)))


@functools.cache
def sampler() -> Sampler:
    return Sampler()


def band_keys(samples: np.ndarray) -> list[np.ndarray]:
    """For each depth the keys of all bands: by 3, 6, 9 and all samples."""
    s = samples.reshape(BANDS, ROWS)
    part = mixed(s[:, 0] + mixed(s[:, 1] + mixed(s[:, 2])))
    band = np.arange(BANDS)
    k, out = mixed(part + band.astype(np.uint64)), []
    for d in range(DEPTH - 1):
        out.append(k.view(np.int64).copy())
        k = mixed(k + part[(band + d + 1) % BANDS])
    for d in range(DEPTH - 1, BANDS - 1):
        k = mixed(k + part[(band + d + 1) % BANDS])
    return [*out, k.view(np.int64).copy()]


def sampled(blocks: DataFrame, shared: DataFrame, n: int, ranges: int) -> DataFrame:
    """_key, _t, _l, _k0 to _k3: each text with the levels of its shingles, in the order of their hashes, and the keys of its bands (an array for each depth)."""
    schema = T.StructType([KEY, T.StructField("_t", T.StringType()), T.StructField("_l", T.BinaryType()), *(T.StructField(f"_k{d}", T.ArrayType(T.LongType())) for d in range(DEPTH))])

    def run(blocks: pa.Table, back: pa.Table) -> pa.Table:
        if not blocks.num_rows:  # no reply is without its block
            return pa.table([pa.array([], pa.binary())] + [pa.array([], pa.string())] + [pa.array([], pa.binary())] + [pa.array([], pa.list_(pa.int64()))] * DEPTH, names=schema.names)
        texts = unpacked(blocks.column("_z")[0].as_buffer())
        each, sample, out = [shingles(t) for t in texts.column("_t").to_pylist()], sampler(), []
        h, at = np.unique(np.concatenate([own for own, _ in each]), return_inverse=True)
        ends = np.cumsum([0, *(len(own) for own, _ in each)]).tolist()
        level, cuts = np.zeros(len(h), np.uint8), range_cuts(h, ranges)
        for p, some in zip(back.column("_p").to_pylist(), back.column("_l").to_pylist()):
            level[cuts[p] : cuts[p + 1]] = np.frombuffer(some, np.uint8)
        level = level[at]
        for (own, tf), a, b in zip(each, ends, ends[1:]):
            mine = level[a:b]
            out.append((mine.tobytes(), *band_keys(sample(own, weights(tf, mine, n)))))
        columns = list(zip(*out)) or [()] * (1 + DEPTH)
        return pa.table([texts.column("_key"), texts.column("_t"), pa.array(columns[0], pa.binary()), *(pa.array([list(k) for k in c], pa.list_(pa.int64())) for c in columns[1:])], names=schema.names)

    return blocks.groupBy("_b").cogroup(shared.groupBy("_b")).applyInArrow(run, schema)


def candidate_pairs(bands: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(_a, _b, _n): texts and hubs, and in how many buckets they met; (_key, _k0, _size): the rows of buckets by 3 samples."""
    pairs, rows, first = None, bands, None
    for d in range(DEPTH):
        k = f"_k{d}"
        bucket = rows.groupBy(k).agg(F.count(F.lit(1)).alias("_size"), F.min(F.struct(F.xxhash64("_key", k).alias("o"), F.col("_key").alias("key"))).alias("_hub")).where("_size > 1")
        # written before it is joined, so that the join has shuffles of its own, whose hot partitions Spark can split
        bucket = common.work_table(bucket, f"neardup-buckets-{d}")
        met = rows.join(bucket.select(k, "_size", F.col("_hub.key").alias("_b")), k)
        met = common.work_table(met.select("_key", *(f"_k{j}" for j in range(d + (d > 0), DEPTH)), "_size", "_b"), f"neardup-bands-{d}")
        common.drop_table(bucket)
        first = first or met
        some = met.where("_key <> _b").select(F.col("_key").alias("_a"), "_b")
        pairs = some if pairs is None else pairs.unionAll(some)
        rows = met.where("_size > 2").drop("_size", "_b", "_k0")
    return pairs.groupBy("_a", "_b").agg(F.count(F.lit(1)).alias("_n")), first.select("_key", "_k0", "_size")


def alike(pairs: DataFrame, texts: DataFrame, n: int) -> DataFrame:
    """The pairs (_a, _b) that are links."""
    schema = T.StructType([T.StructField("_a", T.BinaryType()), T.StructField("_b", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple = (None, None)
        for batch in batches:
            good = []
            for a, b, ta, tb, la, lb in zip(*(c.to_pylist() for c in batch.columns)):
                if last[0] != b:
                    last = (b, weighed(tb, lb, n))
                (ha, wa), (hb, wb) = weighed(ta, la, n), last[1]
                _, ia, ib = np.intersect1d(ha, hb, assume_unique=True, return_indices=True)
                low = np.minimum(wa[ia], wb[ib]).sum()
                if low >= SIMILARITY * (wa.sum() + wb.sum() - low) - SLACK:
                    good.append((a, b))
            if good:
                yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.binary()) for x in zip(*good)], names=schema.names)

    side = lambda x: texts.select(F.col("_key").alias(f"_{x}"), F.col("_t").alias(f"_t{x}"), F.col("_l").alias(f"_l{x}"))
    return pairs.select("_a", "_b").join(side("a"), "_a").join(side("b"), "_b").select("_a", "_b", "_ta", "_tb", "_la", "_lb").mapInArrow(common.tidy(run), schema)


def open_rows(members_: DataFrame, roots: DataFrame) -> DataFrame:
    """(_key, _k0, _root, _c, _n, _few): rows of the buckets that hold several components; rows of the same component in the bucket, of all, and of components of BLOCK rows at most."""
    own = members_.where("_size > 2").select("_key", "_k0").join(roots, "_key", "left").select("_key", "_k0", F.coalesce("_root", "_key").alias("_root"))
    own = common.work_table(own, "neardup-own")
    per = common.work_table(own.groupBy("_k0", "_root").agg(F.count(F.lit(1)).alias("_c")), "neardup-per")
    some = per.groupBy("_k0").agg(F.count(F.lit(1)).alias("_roots"), F.sum("_c").alias("_n"), F.sum(F.when(F.col("_c") <= BLOCK, F.col("_c"))).alias("_few")).where("_roots > 1").drop("_roots")
    some = common.work_table(some, "neardup-some")
    out = common.work_table(own.join(per.join(some, "_k0"), ["_k0", "_root"]), "neardup-left")
    for used in (own, per, some):
        common.drop_table(used)
    return out


def central_pairs(left: DataFrame) -> DataFrame:
    """(_a, _b): the rows of buckets over BLOCK and the row of another component there that has the most company in all its buckets."""
    company = left.groupBy("_key").agg(F.sum("_n").alias("_s"))
    large = left.where(F.col("_n") > BLOCK)
    hub = large.join(company, "_key").groupBy("_k0").agg(F.max(F.struct("_s", "_key", "_root")).alias("_hub"))
    hub = common.work_table(hub.select("_k0", F.col("_hub._key").alias("_b"), F.col("_hub._root").alias("_rb")), "neardup-central")
    return large.join(hub, "_k0").where("_root <> _rb").select(F.col("_key").alias("_a"), "_b").distinct()


def block_links(left: DataFrame, texts: DataFrame, n: int) -> DataFrame:
    """The links (_a, _b) among all pairs of rows of different components of a bucket.

    A component of over BLOCK rows of the bucket has blocks of its own, the others share
    some; each two blocks meet in a group, but for those of one component. A pair that
    meets in several buckets is judged in the one of least key.
    """
    own = F.col("_c") > BLOCK
    part = F.pmod(F.xxhash64("_key", "_k0"), F.ceil(F.when(own, F.col("_c")).otherwise(F.col("_few")) / BLOCK))
    placed = left.withColumn("_g", F.when(own, F.col("_root")).otherwise(F.lit(b""))).withColumn("_l", F.xxhash64("_g", part))
    placed = common.work_table(placed.select("_key", "_k0", "_root", "_g", "_l"), "neardup-placed")
    at = common.work_table(placed.select("_k0", "_g", "_l").distinct(), "neardup-blocks")
    two = at.join(at.select("_k0", F.col("_g").alias("_h"), F.col("_l").alias("_m")), "_k0").where((F.col("_l") <= F.col("_m")) & ((F.col("_g") != F.col("_h")) | (F.length("_g") == 0)))
    two = common.work_table(two.select("_k0", F.col("_l").alias("_i"), F.col("_m").alias("_j")), "neardup-two")
    to = two.select("_k0", F.col("_i").alias("_l"), "_i", "_j").unionAll(two.where("_i <> _j").select("_k0", F.col("_j").alias("_l"), "_i", "_j"))
    buckets = left.groupBy("_key").agg(F.sort_array(F.collect_list("_k0")).alias("_all"))
    rows = placed.join(to, ["_k0", "_l"]).join(buckets, "_key").join(texts.select("_key", "_t", F.col("_l").alias("_df")), "_key").select("_key", "_k0", "_root", "_l", "_i", "_j", "_all", "_t", "_df")
    schema = T.StructType([T.StructField("_a", T.BinaryType()), T.StructField("_b", T.BinaryType())])

    def run(group: pa.Table) -> pa.Table:
        c = group.to_pydict()
        good = linked_pairs([weighed(t, d, n) for t, d in zip(c["_t"], c["_df"])], c["_root"], c["_l"] if c["_i"][0] != c["_j"][0] else None, c["_all"], c["_k0"][0])
        return pa.table([pa.array([c["_key"][a] for a, _ in good], pa.binary()), pa.array([c["_key"][b] for _, b in good], pa.binary())], names=schema.names)

    return rows.groupBy("_k0", "_i", "_j").applyInArrow(run, schema)


def linked_pairs(sets: list[tuple[np.ndarray, np.ndarray]], roots: list, sides: list | None, buckets: list[list[int]], bucket: int) -> list[tuple[int, int]]:
    """Links of texts (hashes and weights) of different components (and of different sides, if there are any), without those that earlier ones imply."""
    n = len(sets)
    size = np.array([len(h) for h, _ in sets])
    starts = np.concatenate([[0], np.cumsum(size)])
    w = np.concatenate([x for _, x in sets])
    total = np.add.reduceat(w, starts[:-1])
    vocabulary, ids = np.unique(np.concatenate([h for h, _ in sets]), return_inverse=True)
    component = np.unique(np.array([bytes(r).hex() for r in roots]), return_inverse=True)[1]
    side = np.arange(n) if sides is None else np.array(sides)
    earlier = [{k for k in x if k < bucket} for x in buckets]
    dense, good = np.zeros(len(vocabulary)), []
    for a in range(n - 1):
        # a similarity of 0.8 needs totals within 0.8 of each other
        near = np.minimum(total, total[a]) >= SIMILARITY * np.maximum(total, total[a]) - SLACK
        some = np.flatnonzero(near & (component != component[a]) & (side != side[a]))
        some = np.array([b for b in some[some > a] if earlier[a].isdisjoint(earlier[b])], np.int64)
        if not len(some):
            continue
        own = slice(starts[a], starts[a + 1])
        dense[ids[own]] = w[own]
        first = np.concatenate([[0], np.cumsum(size[some])])[:-1]
        at = np.arange(size[some].sum()) + np.repeat(starts[some] - first, size[some])
        low = np.add.reduceat(np.minimum(dense[ids[at]], w[at]), first)
        dense[ids[own]] = 0
        for b in some[low >= SIMILARITY * (total[a] + total[some] - low) - SLACK].tolist():
            if component[b] != component[a]:
                good.append((a, b))
                component[component == component[b]] = component[a]
    return good


def components(links: DataFrame) -> DataFrame:
    """(_key, _root) of every text in a link: each round hooks a component to its least neighbour and contracts the graph."""
    edges = common.work_table(links.select(F.least("_a", "_b").alias("_a"), F.greatest("_a", "_b").alias("_b")).distinct(), "links")
    roots = None
    while True:
        both = edges.select("_a", "_b").unionAll(edges.select(F.col("_b").alias("_a"), F.col("_a").alias("_b")))
        near = common.work_table(both.groupBy("_a").agg(F.min("_b").alias("_m")).select(F.col("_a").alias("_node"), F.least("_a", "_m").alias("_to")), "hooks")
        # one more hop, as a neighbour may itself be hooked
        far = near.select(F.col("_node").alias("_to"), F.col("_to").alias("_next"))
        step = common.work_table(near.join(far, "_to", "left").select("_node", F.coalesce("_next", "_to").alias("_to")), "hooks")
        before = [near, edges, step] + ([roots] if roots is not None else [])
        if roots is None:
            new = step.select(F.col("_node").alias("_key"), F.col("_to").alias("_root"))
        else:
            new = roots.join(step, roots["_root"] == step["_node"], "left").select("_key", F.coalesce("_to", "_root").alias("_root"))
        roots = common.work_table(new, "roots")
        a, b = step.select(F.col("_node").alias("_a"), F.col("_to").alias("_ra")), step.select(F.col("_node").alias("_b"), F.col("_to").alias("_rb"))
        edges = common.work_table(edges.join(a, "_a").join(b, "_b").where("_ra <> _rb").select(F.least("_ra", "_rb").alias("_a"), F.greatest("_ra", "_rb").alias("_b")).distinct(), "links")
        for used in before:
            common.drop_table(used)
        if edges.isEmpty():
            common.drop_table(edges)
            return roots


def text_classes(df: DataFrame, text: str = "text") -> DataFrame:
    """(_key, _root) of the texts that are like others; texts that aren't have no row."""
    spark = common.ready(df).sparkSession
    empty = T.StructType([KEY, T.StructField("_root", T.BinaryType())])
    source, copied = distinct_texts(df, text)
    n, size = source.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("_t")), F.lit(0))).first()
    blocks = in_blocks(source)
    common.drop_table(source)
    common.drop_table(copied)
    if not n:
        return spark.createDataFrame([], empty)
    parts = common.partitions(spark, size + size // 2, COUNT_BYTES)  # a hash and a count of 12 bytes for each word of some 8
    shared = common.work_table(shared_hashes(block_hashes(blocks, parts), parts), "neardup-shared")
    keyed = common.work_table(sampled(blocks, shared, n, parts), "neardup-samples")
    common.drop_table(shared)
    common.drop_table(blocks)
    bands = keyed.select("_key", F.inline(F.arrays_zip(*(f"_k{d}" for d in range(DEPTH)))))
    pairs, met = candidate_pairs(bands)
    pairs = common.work_table(pairs, "neardup-pairs")
    if pairs.isEmpty():
        return spark.createDataFrame([], empty)
    nodes = common.work_table(pairs.select(F.col("_a").alias("_key")).unionAll(pairs.select(F.col("_b").alias("_key"))).distinct(), "neardup-nodes")
    wanted = common.small(nodes, nodes.count(), 64)
    texts = common.work_table(keyed.select("_key", "_t", "_l").join(wanted, "_key", "left_semi"), "neardup-texts")
    for used in (keyed, nodes):
        common.drop_table(used)
    first = pairs.groupBy("_a").agg(F.max(F.struct("_n", F.col("_b").alias("b"))).alias("_x")).select("_a", F.col("_x.b").alias("_b"))
    links = common.work_table(alike(first, texts, n), "neardup-links")
    roots = components(links)
    at = lambda c: roots.select(F.col("_key").alias(c), F.col("_root").alias(f"{c}r"))
    open_ = pairs.join(first.withColumn("_done", F.lit(True)), ["_a", "_b"], "left_anti").join(at("_a"), "_a", "left").join(at("_b"), "_b", "left")
    open_ = open_.where(F.coalesce("_ar", "_a") != F.coalesce("_br", "_b")).select(F.least("_a", "_b").alias("_a"), F.greatest("_a", "_b").alias("_b")).distinct()
    more = common.work_table(alike(common.work_table(open_, "neardup-open"), texts, n), "neardup-links")
    if not more.isEmpty():
        links = links.unionAll(more)
        roots = components(links)
    left = open_rows(met, roots)
    while not left.where(F.col("_n") > BLOCK).isEmpty():
        tried = common.work_table(central_pairs(left), "neardup-tried")
        more = common.work_table(alike(tried, texts, n), "neardup-links")
        found = more.count()
        if found:
            links = links.unionAll(more)
            roots = components(links)
            left = open_rows(met, roots)
        if 4 * found < tried.count():
            break
    more = common.work_table(block_links(left, texts, n), "neardup-links")
    common.drop_table(texts)
    return roots if more.isEmpty() else components(links.unionAll(more))


def members(df: DataFrame, text: str = "text", doc_id: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(rows, texts). rows: _id and _key of each row, _some if it has words. texts: _key, _class (the least id of the class), _least (of this text), _winner (whether the class keeps this text), _same (rows with the least id), _rows."""
    base = df.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)).alias("_id"), F.col(text).alias("_x"))
    rows = common.work_table(with_text_key(base, "_x", ["_id"]).select("_id", "_key", common.has_words(F.col("_t")).alias("_some")), "neardup-rows")
    by_id = rows.where("_some").groupBy("_key", "_id").agg(F.count(F.lit(1)).alias("_c"))
    texts = by_id.groupBy("_key").agg(F.min(F.struct("_id", "_c")).alias("_x"), F.sum("_c").alias("_rows")).select("_key", F.col("_x._id").alias("_least"), F.col("_x._c").alias("_same"), "_rows")
    roots = text_classes(df, text)
    # only texts that are like others need their class's least id
    linked = common.work_table(texts.join(roots, "_key"), "neardup-linked")
    best = linked.groupBy("_root").agg(F.min(F.struct("_least", "_key")).alias("_w")).select("_root", F.col("_w._least").alias("_class"), F.col("_w._key").alias("_best"))
    linked = common.work_table(linked.join(best, "_root").select("_key", "_class", "_least", (F.col("_key") == F.col("_best")).alias("_winner"), "_same", "_rows"), "neardup-classes")
    alone = texts.where("_rows > 1").join(linked.select("_key"), "_key", "left_anti").select("_key", F.col("_least").alias("_class"), "_least", F.lit(True).alias("_winner"), "_same", "_rows")
    return rows, common.work_table(linked.unionByName(alone), "neardup-members")


def classes(df: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id and class_id of each row."""
    rows, texts = members(df, text, doc_id)
    n = texts.count()
    out = rows.join(common.small(texts.select("_key", "_class"), n, 64), "_key", "left")
    back = lambda c: F.when(c == NO_ID, F.lit(None)).otherwise(c)
    return out.select(back(F.col("_id")).alias("doc_id"), back(F.when(F.col("_some"), F.coalesce("_class", "_id")).otherwise(F.col("_id"))).alias("class_id"))


def keep_one(df: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """df with one row of each class: that of the least doc_id."""
    _, texts = members(df, text, doc_id)
    n = texts.count()
    names = [f"__{k}" for k in range(len(df.columns))]  # theirs may clash
    plain = df.select(*(df[c].alias(x) for c, x in zip(df.columns, names)), df[text].alias("__text"), F.coalesce(df[doc_id].cast("long"), F.lit(NO_ID)).alias("__id"))
    every = with_text_key(plain, "__text", [x for c, x in zip(df.columns, names) if c != text] + ["__id"]).join(common.small(texts, n, 96), "_key", "left")
    kept = every.where(F.col("_least").isNull() | (F.col("_winner") & (F.col("__id") == F.col("_least"))))
    cols = [F.col("_t" if c == text else x).alias(c) for c, x in zip(df.columns, names)]
    single = kept.where(F.coalesce(F.col("_same"), F.lit(1)) == 1)
    if texts.where("_winner and _same > 1").isEmpty():
        return single.select(*cols)
    return single.select(*cols).unionByName(kept.where("_same > 1").dropDuplicates(["_key"]).select(*cols))
