"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

A document's key is an exponential number, drawn from a hash of its doc_id and text, over
its quality weight; a source's documents in the order of their keys are a weighted sample
without replacement, however many are taken. A source whose target is e times its size
and a rest gives every document e times (complete epochs), then documents in key order
until the rest is used up; the one at the boundary gives only the words that are left.

Keys fall into buckets by value. Sizes summed by source and bucket give the sources'
sizes, and their prefix sums the one bucket of each source in which the rest runs out.
Only the rows of that bucket are sorted. What then decides for every document fits one row
for each source, so the texts are never shuffled.

Targets: the sources share the total by weight; a target stops at a limit of times its
source's size, and what is over goes to the others by weight until none is above its
limit. In closed form: order sources by limit over weight; those that a common level
would lift above their limits stop there, the others get weight times level.

Null and empty texts have size 0 and are taken 0 times; a null source is a source, the
last. Rows that are repeated as a whole have one key; they share what is left evenly.
mix returns exactly the columns of docs, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

BUCKETS = 4096
WORD = r"[^\x20\x09-\x0D]+"


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def quality(text: Column, size: Column) -> Column:
    """A weight over 0 and up to 1: 5 / (5 + |mean word length - 5|)."""
    letters = F.length(F.translate(text, " \t\n\x0b\x0c\r", ""))
    return F.when(size > 0, 5.0 / (5.0 + F.abs(letters / F.greatest(size, F.lit(1)) - 5.0))).otherwise(1.0)


def keyed(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", seed: str = "mix") -> DataFrame:
    """docs with size, key and bucket, under names that start with __mix_ as all that this module adds."""
    t = F.coalesce(F.col(text), F.lit(""))
    draw = F.md5(F.concat_ws("|", F.lit(seed), F.col(doc_id).cast("string"), F.md5(t)))
    uniform = (F.conv(F.substring(draw, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
    out = docs.withColumn("__mix_size", size_of(F.col(text)))
    out = out.withColumn("__mix_key", -F.log(uniform) / quality(F.col(text), F.col("__mix_size")))
    return out.withColumn("__mix_bucket", F.floor(F.col("__mix_key") / (1.0 + F.col("__mix_key")) * BUCKETS).cast("int"))


def targets(sizes: DataFrame, weights: tuple[float, ...], share: float, limit: float) -> DataFrame:
    """source, _s with _target. Windows over the table of sources only."""
    order = Window.orderBy(F.col("source").isNull(), "source")
    place = (F.row_number().over(order) - 1) % len(weights)
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), place + 1)
    s = sizes.withColumn("__mix_w", weight).withColumn("__mix_cap", F.col("__mix_s") * F.lit(float(limit)))
    s = s.withColumn("__mix_ratio", F.col("__mix_cap") / F.col("__mix_w"))
    by = Window.orderBy("__mix_ratio", F.col("source").isNull(), "source")
    s = s.withColumn("__mix_before", F.coalesce(F.sum("__mix_cap").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    s = s.withColumn("__mix_left", F.sum("__mix_w").over(by.rowsBetween(0, Window.unboundedFollowing)))
    s = s.withColumn("__mix_total", F.sum("__mix_s").over(Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) * F.lit(float(share)))
    s = s.withColumn("__mix_over", F.col("__mix_total") - F.col("__mix_before"))
    # the first source in this order that the level leaves under its limit sets the level
    free = F.col("__mix_cap") * F.col("__mix_left") > F.col("__mix_w") * F.col("__mix_over")
    s = s.withColumn("__mix_level", F.min(F.when(free, F.struct(F.col("__mix_ratio"), F.col("source").isNull().alias("n"), F.col("source").alias("s"), F.col("__mix_over"), F.col("__mix_left")))).over(Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    level = F.col("__mix_w") * F.col("__mix_level.__mix_over") / F.col("__mix_level.__mix_left")
    return s.select("source", "__mix_s", F.coalesce(F.least("__mix_cap", level), F.col("__mix_cap")).alias("__mix_target"))


def plan(rows: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, limit: float = 2.0, doc_id: str = "doc_id") -> DataFrame:
    """One row for each source: _s, _target, _epochs, and where its fractional epoch ends: key _bk, id _bi, _br words left for _bm rows."""
    hist = common.work_table(rows.groupBy("source", "__mix_bucket").agg(F.sum("__mix_size").alias("__mix_size")), "mix-sizes")
    goal = targets(hist.groupBy("source").agg(F.sum("__mix_size").alias("__mix_s")), weights, share, limit)
    goal = goal.withColumn("__mix_budget", F.floor(F.col("__mix_target") + 0.5).cast("long"))
    epochs = F.when(F.col("__mix_s") > 0, F.floor(F.col("__mix_budget") / F.greatest(F.col("__mix_s"), F.lit(1)))).otherwise(0).cast("long")
    goal = common.work_table(goal.withColumn("__mix_epochs", epochs).withColumn("__mix_rest", F.col("__mix_budget") - F.col("__mix_epochs") * F.col("__mix_s")), "mix-targets")
    n = goal.count()
    to = common.small(goal.select(F.col("source").alias("__mix_src"), "__mix_rest"), n, 256)
    before = F.coalesce(F.sum("__mix_size").over(Window.partitionBy("source").orderBy("__mix_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cut = hist.withColumn("__mix_before", before).join(to, F.col("source").eqNullSafe(F.col("__mix_src")))
    cut = cut.where((F.col("__mix_before") <= F.col("__mix_rest")) & (F.col("__mix_rest") < F.col("__mix_before") + F.col("__mix_size"))).select("__mix_src", F.col("__mix_bucket").alias("__mix_cut"), (F.col("__mix_rest") - F.col("__mix_before")).alias("__mix_over"))
    cut = common.work_table(cut, "mix-cuts")
    near = rows.select("source", "__mix_bucket", "__mix_key", F.coalesce(F.col(doc_id).cast("long"), F.lit(-(1 << 63))).alias("__mix_id"), "__mix_size")
    near = near.join(common.small(cut, n, 256), F.col("source").eqNullSafe(F.col("__mix_src")) & (F.col("__mix_bucket") == F.col("__mix_cut")))
    near = near.groupBy("__mix_src", "__mix_key", "__mix_id", "__mix_over").agg(F.sum("__mix_size").alias("__mix_size"), F.count(F.lit(1)).alias("__mix_bm"))
    before = F.coalesce(F.sum("__mix_size").over(Window.partitionBy("__mix_src").orderBy("__mix_key", "__mix_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    edge = near.withColumn("__mix_b", before).where((F.col("__mix_b") <= F.col("__mix_over")) & (F.col("__mix_over") < F.col("__mix_b") + F.col("__mix_size")))
    edge = edge.select(F.col("__mix_src").alias("__mix_src2"), F.col("__mix_key").alias("__mix_bk"), F.col("__mix_id").alias("__mix_bi"), (F.col("__mix_over") - F.col("__mix_b")).alias("__mix_br"), "__mix_bm")
    return common.work_table(goal.join(edge, F.col("source").eqNullSafe(F.col("__mix_src2")), "left").select(F.col("source").alias("__mix_src"), "__mix_s", "__mix_target", "__mix_epochs", "__mix_bk", "__mix_bi", "__mix_br", "__mix_bm"), "mix-plan")


def mixed(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, limit: float = 2.0, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """docs with _size, _s, _target, _epochs (complete ones) and _part (words of the fractional one)."""
    light = keyed(docs, text, doc_id).select(doc_id, "source", "__mix_size", "__mix_key", "__mix_bucket")
    goal = plan(common.work_table(light, "mix-keys"), weights, share, limit, doc_id)
    n = goal.count()
    rows = keyed(docs, text, doc_id).join(common.small(goal, n, 256), F.col("source").eqNullSafe(F.col("__mix_src")), "left")
    own = F.coalesce(F.col(doc_id).cast("long"), F.lit(-(1 << 63)))
    first = (F.col("__mix_key") < F.col("__mix_bk")) | ((F.col("__mix_key") == F.col("__mix_bk")) & (own < F.col("__mix_bi")))
    edge = (F.col("__mix_key") == F.col("__mix_bk")) & (own == F.col("__mix_bi"))
    part = F.when(first, F.col("__mix_size")).when(edge, F.expr("__mix_br div __mix_bm")).otherwise(0)
    return rows.withColumn("__mix_part", F.coalesce(part, F.lit(0)).cast("long"))


def amounts(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target and taken words of each row."""
    m = mixed(docs, **options)
    return m.select("doc_id", F.col("__mix_size").alias("size"), F.col("__mix_s").alias("source_size"), F.round("__mix_target", 6).alias("target"), (F.col("__mix_epochs") * F.col("__mix_size") + F.col("__mix_part")).alias("taken"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mix as documents, one row for each time that one is taken. The document at a source's boundary is taken whole if at least half of it is."""
    own = {c: f"__mix_own_{k}" for k, c in enumerate(docs.columns) if c.lower().startswith("__mix_")}
    m = mixed(docs.select(*(docs[c].alias(own.get(c, c)) for c in docs.columns)), **options)
    times = F.col("__mix_epochs") + F.when((F.col("__mix_size") > 0) & (2 * F.col("__mix_part") >= F.col("__mix_size")), 1).otherwise(0)
    times = F.when(F.col("__mix_size") > 0, times).otherwise(0).cast("int")
    # array_repeat rather than sequence: of 0 times it has no element
    return m.withColumn("__mix_copy", F.explode(F.array_repeat(F.lit(1), times))).select(*(F.col(own.get(c, c)).alias(c) for c in docs.columns))
