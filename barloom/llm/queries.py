"""The queries of this subpackage's operators, over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, boilerplate, bpe, mixing, neardup, pivots, substrings, tokencount, toxicity, urlfilter
from .common import table

RANK_FILE = public_tokenizers.path("byte_bpe_50k.tiktoken")
TOKENIZER_FILE = public_tokenizers.path("byte_bpe_50k.json")


#: Rules of the URL filter by (host and path, verdict).
RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]
#: Listed sites: the front page of each stands for all of it and its subdomains.
LISTED = [f"http://{name}.example.{top}/" for name in ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm") for top in ("com", "net", "org")]


def op1_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(table(spark, sf_dir, "pages"), RULES, spark.createDataFrame([(u,) for u in LISTED], "url string"))


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.amounts(table(spark, sf_dir, "documents"))


def op4_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boilerplate.extract(table(spark, sf_dir, "pages"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count_tokens(table(spark, sf_dir, "documents"), TOKENIZER_FILE, keep=["doc_id"])


def op6_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivots.top(table(spark, sf_dir, "embeddings"))


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classes(table(spark, sf_dir, "documents"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.digest(table(spark, sf_dir, "documents"))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"), RANK_FILE, keep=["doc_id"])


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.add_scores(docs, model, keep=["doc_id"])
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 == 0
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP2_SQL = rf"""
WITH rest AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages),
split AS (
  SELECT page_id, coalesce(translate(regexp_extract(r, '^[^/?#]*'), '{urlfilter.UPPER}', '{urlfilter.LOWER}'), '') AS host,
         coalesce(regexp_extract(substr(r, length(regexp_extract(r, '^[^/?#]*')) + 1), '^[^?#]*'), '') AS path
  FROM rest),
ruled AS (
  SELECT *, CASE
    WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/en/1') THEN 'example.org/en/1'
    WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/es/') THEN 'example.org/es/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/fr/') THEN 'com/fr/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/de/') THEN 'com/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/') THEN 'org/' END AS rule
  FROM split),
listed AS (SELECT unnest({[u.removeprefix("http://").rstrip("/") for u in LISTED]}) AS site)
SELECT page_id, host, path, rule, CASE
    WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
    WHEN EXISTS (SELECT 1 FROM listed WHERE host = site OR ends_with(host, '.' || site)) THEN 'block' ELSE 'allow' END AS verdict
FROM ruled
"""

OP4_SQL = r"""
WITH main AS (SELECT page_id, url, coalesce(regexp_extract(html, '(?s)<article[^>]*>(.*?)</article>', 1), '') AS a FROM pages),
plain AS (SELECT page_id, url, regexp_replace(regexp_replace(a, '</?(?:b|i|a|em|strong|span)(?:\s[^>]*)?>', '', 'g'), '<[^>]*>', ' ', 'g') AS t FROM main),
decoded AS (SELECT page_id, url, regexp_replace(replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', chr(39)), '&amp;?', '&', 'g') AS t FROM plain),
done AS (SELECT page_id, url, trim(regexp_replace(t, '\s+', ' ', 'g')) AS text FROM decoded)
SELECT page_id, url, text, length(text)::BIGINT AS n_chars FROM done
"""

OP6_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS x FROM embeddings WHERE embedding IS NOT NULL),
pair AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.x, c.x)::BIGINT AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM pair)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""

OP3_SQL = rf"""
WITH sized AS (
  SELECT doc_id, source, len({WORDS}) AS size, coalesce(text, '') AS t,
         md5(concat_ws('|', 'mix', doc_id::VARCHAR, md5(coalesce(text, '')))) AS draw
  FROM documents),
keyed AS (
  SELECT doc_id, source, size,
         -ln((('0x' || substr(draw, 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0)
         / CASE WHEN size > 0 THEN 5.0::DOUBLE / (5.0::DOUBLE + abs(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::DOUBLE / size - 5.0::DOUBLE)) ELSE 1.0::DOUBLE END AS k
  FROM sized),
sizes AS (SELECT source, sum(size)::DOUBLE AS s FROM keyed GROUP BY source),
weighed AS (SELECT source, s, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][1 + ((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3)::INT] AS w, 2 * s AS cap FROM sizes),
ordered AS (
  SELECT *, cap / w AS ratio, sum(s) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER (b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS over_,
         sum(w) OVER (b ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS left_
  FROM weighed WINDOW b AS (ORDER BY cap / w, source IS NULL, source)),
level AS (SELECT over_, left_ FROM ordered WHERE cap * left_ > w * over_ ORDER BY ratio, source IS NULL, source LIMIT 1),
goal AS (
  SELECT source, s, coalesce(least(cap, w * (SELECT over_ FROM level) / (SELECT left_ FROM level)), cap) AS target FROM ordered),
budget AS (
  SELECT *, floor(target + 0.5)::BIGINT AS b, CASE WHEN s > 0 THEN floor(floor(target + 0.5) / s)::BIGINT ELSE 0 END AS e FROM goal),
grouped AS (SELECT source, k, doc_id, size, count(*) AS m FROM keyed GROUP BY ALL),
summed AS (
  SELECT *, coalesce(sum(size * m) OVER (PARTITION BY source ORDER BY k, coalesce(doc_id, -9223372036854775808) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM grouped),
part AS (
  SELECT g.*, c.s, c.target, c.e,
         CASE WHEN before + size * m <= c.b - c.e * c.s THEN size WHEN before < c.b - c.e * c.s THEN ((c.b - c.e * c.s)::BIGINT - before) // m ELSE 0 END AS part
  FROM summed g JOIN budget c ON g.source IS NOT DISTINCT FROM c.source)
SELECT k.doc_id, k.size::BIGINT AS size, p.s::BIGINT AS source_size, round(p.target, 6) AS target, (p.e * k.size + p.part)::BIGINT AS taken
FROM keyed k JOIN part p ON k.source IS NOT DISTINCT FROM p.source AND k.k = p.k AND k.doc_id IS NOT DISTINCT FROM p.doc_id
"""

OP8_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {WORDS} AS w FROM documents),
starts AS (SELECT r, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35),
win AS (SELECT s.r, s.i, md5(array_to_string(d.w[s.i : s.i + 34], ' ')) AS h FROM starts s JOIN d USING (r)),
again AS (SELECT h FROM win GROUP BY h HAVING count(*) > 1),
gone AS (SELECT DISTINCT r, unnest(range(i, i + 35)) AS p FROM win JOIN again USING (h)),
lost AS (SELECT r, count(*) AS n FROM gone GROUP BY r),
each AS (SELECT d.r, unnest(range(1, len(w) + 1)) AS p FROM d WHERE r IN (SELECT r FROM lost)),
kept AS (SELECT e.r, string_agg(d.w[e.p], ' ' ORDER BY e.p) AS t FROM each e JOIN d USING (r) LEFT JOIN gone g ON g.r = e.r AND g.p = e.p WHERE g.r IS NULL GROUP BY e.r)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(l.n, 0)::BIGINT AS n_removed,
       sha256(CASE WHEN l.n IS NULL THEN array_to_string(d.w, ' ') ELSE coalesce(k.t, '') END) AS kept_sha256
FROM d LEFT JOIN lost l USING (r) LEFT JOIN kept k USING (r)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}
    return {**found, "pipeline": pipeline}


def oracle_sql() -> dict[str, str]:
    import corpus_pipeline

    found = {"op2_url_filter": OP2_SQL, "op4_main_text": OP4_SQL, "op6_exact_top_k": OP6_SQL, "op3_source_mixing": OP3_SQL, "op8_substring_dedup": OP8_SQL}
    return found | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
