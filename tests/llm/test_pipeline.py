"""run() of the pipeline against a plain version of its five stages, on whole tables with odd rows."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

import corpus_pipeline as pipeline
from barloom.llm import toxicity
from barloom.llm.bpe import read_ranks

from .test_text import DIR, RANKS, odd_rows, plain_classes

#: Of names that stages use themselves.
EXTRA = ["_toxic", "n_tokens", "token_ids", "score", "_key", "_t", "__id", "__mix_size"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in EXTRA)


def plain_score(weight, bias, text):
    means = []
    for w in (w.strip(toxicity.STRIP) or w for w in text.lower().split()):
        marked = f"<{w}>"
        grams = [marked, *(marked[k : k + n] for n in (3, 4, 5) for k in range(len(marked) - n + 1))]
        means.append(np.mean([weight[hash_of(g)] for g in grams]))
    return 1 / (1 + math.exp(-(bias + (float(np.mean(means)) if means else 0.0))))


def hash_of(gram):
    return zlib.crc32(gram.encode()) % toxicity.BUCKETS


def plain_one_of_each(rows):
    """Rows are dicts. Texts without words are no copies of each other."""
    worded = [r for r in rows if (r["text"] or "").split()]
    texts = sorted({r["text"] for r in worded})
    # a class by the number of its least text; its ids decide who stays
    of = plain_classes(list(enumerate(texts)))
    number = {t: of[k] for k, t in enumerate(texts)}
    groups = collections.defaultdict(list)
    for r in worded:
        groups[number[r["text"]]].append(r)
    stays = [min(g, key=lambda r: (r["doc_id"] is not None, r["doc_id"])) for g in groups.values()]
    return [r for r in rows if not (r["text"] or "").split()] + stays


def plain_passages(rows, k=35):
    found = [re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "") for r in rows]
    seen = collections.Counter(tuple(w[j : j + k]) for w in found for j in range(len(w) - k + 1))
    out = []
    for r, w in zip(rows, found):
        gone = {i for j in range(len(w) - k + 1) if seen[tuple(w[j : j + k])] > 1 for i in range(j, j + k)}
        out.append({**r, "text": " ".join(x for i, x in enumerate(w) if i not in gone)} if gone else r)
    return out


def plain_targets(size, total):
    """Sources that would pass twice their size stop there; what they leave goes to the others by weight."""
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    goal, free = {}, set(order)
    while free:
        level = (total - sum(goal.values())) / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * level >= 2 * size[s]}
        if not over:
            return goal | {s: weight[s] * level for s in free}
        goal |= {s: 2 * size[s] for s in over}
        free -= over
    return goal


def plain_mix(rows):
    def size(r):
        return len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))

    def key(r):
        md5 = lambda s: hashlib.md5(s.encode()).hexdigest()
        t = r["text"] or ""
        draw = md5("|".join(["mix", *([str(r["doc_id"])] if r["doc_id"] is not None else []), md5(t)]))
        length = len(re.sub(r"[ \t\n\x0b\x0c\r]", "", t)) / size(r)
        return -math.log((int(draw[:13], 16) + 0.5) / 2**52) / (5 / (5 + abs(length - 5)))

    of = collections.defaultdict(list)
    for r in rows:
        of[r["source"]].append(r)
    sizes = {s: sum(map(size, x)) for s, x in of.items()}
    goal = plain_targets(sizes, 1.5 * sum(sizes.values()))
    for s, x in of.items():
        if not sizes[s]:
            continue
        epochs, rest = divmod(math.floor(goal[s] + 0.5), sizes[s])
        for r in sorted((r for r in x if size(r)), key=key):
            part = min(rest, size(r))
            rest -= part
            for _ in range(epochs + (part > 0 and 2 * part >= size(r))):
                yield r


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Documents of the driver with odd rows, labels with null and repeated ones."""
    path = str(tmp_path_factory.mktemp("tables"))
    docs = spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    odd = [(None if r[0] is None else r[0] + 10_000, r[1], r[2], r[3], r[4]) for r in odd_rows()[:10] + odd_rows()[-1:]]
    odd += [(20_000, "one two three four", "en", "src0", 3), (20_001, None, None, None, None)]
    rows = [(*r, *("x" for _ in EXTRA)) for r in [*map(tuple, docs.collect()), *odd]]
    spark.createDataFrame(rows, SCHEMA).repartition(5).write.parquet(f"{path}/documents.parquet")
    labels = spark.read.parquet(f"{DIR}/labels.parquet")
    more = spark.createDataFrame([(None, 1, 1), (1, 1, 0), (2, None, None), (10_003, 0, 7)], labels.schema)
    labels.unionByName(more).write.parquet(f"{path}/labels.parquet")
    return path


def test_run_equals_a_plain_version(spark, folder):
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels)
    weight = model.weight.astype(float)
    rows = [r.asDict() for r in docs.collect()]
    clean = [r for r in rows if plain_score(weight, model.bias, r["text"] or "") < 0.5]
    one = plain_one_of_each(clean)
    assert len(one) < len(clean) <= len(rows)
    want = list(plain_mix(plain_passages(one)))
    with open(RANKS, "rb") as f:
        library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=read_ranks(f.read()), special_tokens={})
    wanted = collections.Counter((r["doc_id"], r["lang"], r["source"], tuple(library.encode_ordinary(r["text"] or ""))) for r in want)
    got = collections.Counter((r.doc_id, r.lang, r.source, tuple(r.token_ids)) for r in pipeline.run(spark, folder).collect())
    assert len(wanted) > 100 and got == wanted


def test_stages_keep_columns_and_their_values(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("doc_id < 40 OR doc_id >= 10000 OR doc_id IS NULL")
    for name, stage in pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns == [c.strip().split()[0] for c in SCHEMA.split(",")]
        rows = docs.collect()
        assert rows and not [(name, c) for c in EXTRA if {r[c] for r in rows} != {"x"}]
        docs = spark.createDataFrame(rows, SCHEMA)


def test_run_on_empty_tables(spark, tmp_path):
    for name in ("documents", "labels"):
        spark.read.parquet(f"{DIR}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    out = pipeline.run(spark, str(tmp_path))
    assert out.count() == 0 and {"doc_id", "token_ids"} <= set(out.columns)
