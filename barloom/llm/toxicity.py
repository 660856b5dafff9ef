"""Toxicity scores: a bag of subword embeddings under a linear softmax, trained jointly in numpy.

A word is the mean of the vectors of its character n-grams and of itself, each hashed to a
row of one table; a text is the mean of its words; a softmax over two classes follows.
Unseen misspellings share most n-grams with words that were seen. Table and softmax are
trained together by Adam on a bounded sample of the labelled rows. As every step up to the
softmax is a mean, a trained model reduces to one number per table row, and a score to the
mean over words of the mean over their n-grams: that table, of fixed size, is broadcast.

Null and empty texts have no words; their score is the softmax of the bias alone. Without
a row of either class every score is the share of class 1 (0 without any label). Labels
other than 0 and 1 are no labels; a doc_id labelled twice is toxic if either label is.
Repeated rows are scored each for itself; further columns pass through, but for one named
like the score, which takes its place.
"""

from __future__ import annotations

import pickle
import tempfile
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

BUCKETS = 1 << 18
LEAST, MOST = 3, 5
#: Labelled rows of class 0 and of class 1 that the model is fitted on at most, the first in an order by hash.
SAMPLE_ROWS = (4000, 1400)
#: Texts of the sample in which a table row must occur to be trained.
LEAST_TEXTS = 2
#: Texts of a training step. A sample of a few hundred rows needs small ones, or the passes over it are too few steps to learn anything.
BATCH_TEXTS = 64
#: Steps of a pass over the sample at least; one of under LEAST_STEPS * BATCH_TEXTS texts has smaller steps for that.
LEAST_STEPS = 4
DIMS, EPOCHS, RATE, DECAY = 4, 24, 0.1, 0.05
#: Added to the root of the second moment of a table row: rows of small gradients move less.
FLOOR = 1e-6
#: Words whose score a worker keeps.
CACHE = 150_000
STRIP = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "«»“”‘’„¿¡…–—"


@dataclass
class Model:
    weight: np.ndarray  # a logit for each row of the table
    bias: float


def subwords(word: str) -> list[int]:
    """Table rows of a word: itself and its n-grams, with marks for its ends."""
    w = f"<{word}>".encode()
    if len(w) > 4 and not w.isascii():  # n-grams of characters, not of bytes
        s = f"<{word}>"
        grams = [s[k : k + n].encode() for n in range(LEAST, MOST + 1) for k in range(len(s) - n + 1)]
    else:
        grams = [w[k : k + n] for n in range(LEAST, MOST + 1) for k in range(len(w) - n + 1)]
    return [zlib.crc32(g) % BUCKETS for g in (w, *grams)]


def words(text: str) -> list[str]:
    return text.lower().split()


def bare(word: str) -> str:
    return word.strip(STRIP) or word


def segments(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, starts, axis=0)


def features(texts: list[str], least_texts: int) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]], np.ndarray, np.ndarray, np.ndarray]:
    """(table rows in use, each text's words and their shares, words' rows one after another, where each word's rows start, words' numbers of n-grams)."""
    index: dict[str, int] = {}
    flat, ends, docs = array("i"), array("q", [0]), []
    used_by = np.zeros(BUCKETS, np.int32)
    for text in texts:
        found = []
        for w in words(text):
            w = bare(w)
            k = index.get(w)
            if k is None:
                k = index[w] = len(index)
                flat.extend(subwords(w))
                ends.append(len(flat))
            found.append(k)
        kind, n = np.unique(np.array(found, np.int32), return_counts=True)
        docs.append((kind, (n / max(1, n.sum())).astype(np.float32)))
        seen = np.zeros(BUCKETS, bool)
        seen[[r for k in kind.tolist() for r in flat[ends[k] : ends[k + 1]]]] = True
        used_by += seen
    del index
    rows, bounds = np.frombuffer(flat, np.int32) if flat else np.empty(0, np.int32), np.frombuffer(ends, np.int64)
    known = used_by >= least_texts
    used = np.flatnonzero(known)
    row_of = np.full(BUCKETS, -1, np.int32)
    row_of[used] = np.arange(len(used))
    mapped = row_of[rows]
    kept = np.concatenate([[0], np.cumsum(mapped >= 0)])
    return used, docs, mapped[mapped >= 0], kept[bounds], np.diff(bounds).astype(np.float32)


def batch(docs: list[tuple[np.ndarray, np.ndarray]], rows: np.ndarray, bounds: np.ndarray, size: np.ndarray) -> dict[str, np.ndarray] | None:
    """The index arrays of some texts, for passes forward and back. Words without a known row are zero vectors, which count in the means all the same."""
    word = np.concatenate([d for d, _ in docs])
    share = np.concatenate([s for _, s in docs])
    doc = np.repeat(np.arange(len(docs)), [len(d) for d, _ in docs])
    live = bounds[word + 1] > bounds[word]
    word, share, doc = word[live], share[live], doc[live]
    if not len(word):
        return None
    own, local = np.unique(word, return_inverse=True)
    local = local.astype(np.int32)
    length = bounds[own + 1] - bounds[own]
    start = np.concatenate([[0], np.cumsum(length)])[:-1]
    at = np.arange(length.sum()) - np.repeat(start, length) + np.repeat(bounds[own], length)
    row, of = rows[at], np.repeat(np.arange(len(own), dtype=np.int32), length)
    by_word, by_row = np.argsort(local, kind="stable"), np.argsort(row, kind="stable")
    hit, hit_start = np.unique(row[by_row], return_index=True)
    some, some_start = np.unique(doc, return_index=True)
    return {"row": row, "start": start, "size": size[own][:, None], "word": local, "share": share[:, None], "some": some, "some_start": some_start, "doc_by_word": doc[by_word].astype(np.int32), "share_by_word": share[by_word][:, None], "word_start": np.searchsorted(local[by_word], np.arange(len(own))), "word_by_row": of[by_row], "hit": hit, "hit_start": hit_start}


def train(texts: list[str], labels: list[int], dims: int = DIMS, epochs: int = EPOCHS, rate: float = RATE, decay: float = DECAY, least_texts: int = LEAST_TEXTS, batch_rows: int = BATCH_TEXTS, seed: int = 7) -> Model:
    """Adam with decoupled weight decay on the cross entropy, in batches.

    Table rows that the words of fewer than least_texts texts hash to stay at zero.
    """
    y = np.array(labels, np.int64)
    if not len(y) or y.min() == y.max():
        return Model(np.zeros(BUCKETS, np.float32), np.inf if len(y) and y[0] == 1 else -np.inf)
    used, docs, rows, bounds, size = features(texts, min(least_texts, max(1, len(texts) // 20)))
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(y))
    # built one at a time and kept in a file: the index arrays of all batches would take several times the memory of the texts' words
    held, places = tempfile.TemporaryFile(), []
    batch_rows = min(batch_rows, -(-len(y) // LEAST_STEPS))
    for k in range(0, len(y), batch_rows):
        g = order[k : k + batch_rows]
        places.append(held.tell())
        pickle.dump((y[g], batch([docs[i] for i in g], rows, bounds, size)), held, 5)
    del docs, rows, bounds, size
    params = [rng.normal(0, 0.1, (len(used), dims)).astype(np.float32), rng.normal(0, 1, (dims, 2)).astype(np.float32), np.zeros(2, np.float32)]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    step, steps = 0, epochs * len(places)
    for _ in range(epochs):
        for k in rng.permutation(len(places)):
            held.seek(places[k])
            (want, b), step = pickle.load(held), step + 1
            table, soft, bias = params
            doc = np.zeros((len(want), dims), np.float32)
            if b:
                word = segments(table[b["row"]], b["start"]) / b["size"]
                doc[b["some"]] = segments(word[b["word"]] * b["share"], b["some_start"])
            logit = doc @ soft + bias
            p = np.exp(logit - logit.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(want)), want] -= 1
            g = p / len(want)
            grads = [np.zeros_like(table), doc.T @ g, g.sum(0)]
            if b:
                g_word = segments((g @ soft.T)[b["doc_by_word"]] * b["share_by_word"], b["word_start"]) / b["size"]
                grads[0][b["hit"]] = segments(g_word[b["word_by_row"]], b["hit_start"])
            now = rate * (1 - step / (steps + 1))
            for i, grad in enumerate(grads):
                first[i] += 0.1 * (grad - first[i])
                second[i] += 0.01 * (grad * grad - second[i])
                move = (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.99**step)) + (FLOOR if i == 0 else 1e-8))
                params[i] = params[i] * (1 - now * decay * (i == 0)) - now * move
    held.close()
    table, soft, bias = params
    weight = np.zeros(BUCKETS, np.float32)
    weight[used] = table @ (soft[:, 1] - soft[:, 0])
    return Model(weight, float(bias[1] - bias[0]))


def scorer(model: Model):
    """A function from texts to scores, with a cache of words."""
    cache: dict[str, float] = {}
    weight = model.weight.tolist()

    def look(word: str) -> float:
        if len(cache) > CACHE:
            cache.clear()
        rows = subwords(bare(word))
        cache[word] = out = sum(map(weight.__getitem__, rows)) / len(rows)
        return out

    def score(text: str) -> float:
        found = words(text)
        total = 0.0
        for w in found:
            x = cache.get(w)
            total += look(w) if x is None else x
        z = model.bias + (total / len(found) if found else 0.0)
        return float(1 / (1 + np.exp(-min(max(z, -500.0), 500.0))))

    return score


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", sample_rows: tuple[int, int] = SAMPLE_ROWS) -> Model:
    """A model of the labelled rows whose crc32(doc_id as text) mod 5 isn't 0.

    Of each class the sample_rows first by a hash of doc_id and text are collected; this
    bound is all that the driver holds.
    """
    marks = labels.where(F.col("toxic").isin(0, 1)).groupBy(F.col("doc_id").alias("_id")).agg(F.max("toxic").alias("_y"))
    learn = docs.where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0).select(F.col("doc_id").alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("_t"))
    # the hash of the id comes first, so that only the texts of the sample are sorted and moved
    ids = learn.select("_id").join(marks, "_id").withColumn("_o", F.xxhash64("_id"))
    chosen = None
    for y, n in enumerate(sample_rows):
        some = ids.where(F.col("_y") == y).orderBy("_o", "_id").limit(n)
        chosen = some if chosen is None else chosen.unionAll(some)
    chosen = F.broadcast(chosen.groupBy("_id").agg(F.first("_y").alias("_y")))  # of at most sum(sample_rows) rows
    got = learn.join(chosen, "_id").orderBy(F.xxhash64("_id"), "_t").limit(sum(sample_rows)).select("_t", "_y").collect()
    shares = {int(r[0]): r[1] for r in ids.groupBy("_y").count().collect()}
    return for_share(train([r[0] for r in got], [int(r[1]) for r in got]), [int(r[1]) for r in got], shares.get(1, 0), shares.get(0, 0))


def for_share(model: Model, labels: list[int], ones: int, zeros: int) -> Model:
    """The model's bias moved from the classes' odds in the sample to those of all labelled rows."""
    y = sum(labels)
    if 0 < y < len(labels) and ones and zeros:
        return Model(model.weight, model.bias + float(np.log(ones / zeros) - np.log(y / (len(labels) - y))))
    return model


def add_scores(df: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None, column: str = "score") -> DataFrame:
    """The kept columns (all by default) and the score, 0 to 1. One pass, no shuffle."""
    shared = df.sparkSession.sparkContext.broadcast((model.weight.tobytes(), model.bias))
    keep = [c for c in (df.columns if keep is None else keep) if c.lower() != column.lower()]
    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField(column, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, bias = shared.value
        score = scorer(Model(np.frombuffer(weight, np.float32), bias))
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                some = batch.slice(k, 512)
                yield pa.RecordBatch.from_arrays([*some.columns[:-1], pa.array([score(t or "") for t in some.column(some.num_columns - 1).to_pylist()], pa.float64())], names=schema.names)

    return common.ready(df).select(*[df[c] for c in keep], df[text].alias("_text")).mapInArrow(common.tidy(run), schema)
