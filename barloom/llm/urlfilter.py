"""URL filter: rules by host and path, then a list of canonical URLs behind a blocked Bloom filter.

A rule is host and path in one, `example.org/es/`: it fits its host and all subdomains if
the url's path starts with its path; the longest that fits decides. URLs without a rule go
to the method: a url is listed if the list holds its host or a parent of it, with its path
or with `/`. These expressions of each distinct url are tested against a Bloom filter of
256-bit blocks, in which an expression touches one block; possible hits alone go on to an
exact hash join with the list, which removes false positives.

All steps are native. The filter's blocks, two bytes for each listed URL, are a table that
is broadcast only below a checked size and else joined by block.

Null urls and urls without `://` have empty host and path, no rule, and are allowed.
Repeated rows are judged each for itself. An empty list blocks nothing.
Further columns, whatever their names, are left out unless they are asked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Listed URLs for each block of 256 bits: 16 bits a URL.
PER_BLOCK = 16
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parts(url: Column) -> tuple[Column, Column]:
    """(host, path) of a url."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest.substr(F.length(host) + 1, F.length(rest) + 1), r"^[^?#]*", 0)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest (rule, verdict) that fits, else null."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, decision in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        name, _, start = text.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit("/" + start))
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, decision).otherwise(verdict)
    return rule, verdict


def canonical(url: Column) -> Column:
    """Host and path, without a slash at the end unless the path is `/`; a url without scheme is taken as it is."""
    full = F.when(F.instr(url, "://") > 0, url).otherwise(F.concat(F.lit("http://"), url))
    host, path = parts(full)
    return F.concat(host, plain(path))


def plain(path: Column) -> Column:
    return F.when(F.length(path) <= 1, "/").otherwise(F.regexp_replace(path, "/$", ""))


def expressions(host: Column, path: Column) -> Column:
    """What of a url may be listed: its host and each parent of two labels or more, with its path and with `/`."""
    labels = F.split(host, r"\.")
    hosts = F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    return F.array_distinct(F.concat(F.transform(hosts, lambda h: F.concat(h, plain(path))), F.transform(hosts, lambda h: F.concat(h, F.lit("/")))))


def bits(value: Column, blocks: int) -> tuple[Column, list[Column]]:
    """(block, masks of its four words): two bits of each word."""
    second = F.xxhash64(value, F.lit(1))
    at = lambda k: F.pmod(F.shiftrightunsigned(second, 6 * k), F.lit(64)).cast("int")
    one = F.lit(1).cast("long")
    masks = [F.call_function("shiftleft", one, at(2 * w)).bitwiseOR(F.call_function("shiftleft", one, at(2 * w + 1))) for w in range(4)]
    return F.pmod(F.xxhash64(value), F.lit(blocks).cast("long")), masks


def bloom(listed: DataFrame, column: str, n: int) -> tuple[DataFrame, int]:
    """(the filter: _block and its words, number of blocks) of n listed values."""
    blocks = max(1, -(-n // PER_BLOCK))
    block, masks = bits(F.col(column), blocks)
    table = listed.select(block.alias("_block"), *(m.alias(f"_w{k}") for k, m in enumerate(masks)))
    return table.groupBy("_block").agg(*(F.bit_or(f"_w{k}").alias(f"_w{k}") for k in range(4))), blocks


def possible(values: DataFrame, column: str, filter_: DataFrame, blocks: int) -> DataFrame:
    """The rows whose value the filter may hold; no listed one is missing."""
    block, masks = bits(F.col(column), blocks)
    rows = values.withColumn("_block", block).join(common.small(filter_, blocks, 64), "_block")
    for k, m in enumerate(masks):
        rows = rows.where(F.col(f"_w{k}").bitwiseAND(m) == m)
    return rows.select(*values.columns)


def listed_urls(places: DataFrame, listed: DataFrame) -> DataFrame:
    """The distinct (host, path) of places that the list (column url) holds."""
    entries = common.work_table(listed.where("url is not null").select(canonical(F.col("url")).alias("_listed")).distinct(), "url-list")
    n = entries.count()
    filter_, blocks = bloom(entries, "_listed", n)
    filter_ = common.work_table(filter_, "url-filter")
    asked = places.distinct().withColumn("_listed", F.explode(expressions(F.col("host"), F.col("path"))))
    hits = possible(asked, "_listed", filter_, blocks)
    return hits.join(common.small(entries, n, 256), "_listed", "left_semi").select("host", "path").distinct()


def judge(pages: DataFrame, rules: list[tuple[str, str]], listed: DataFrame, url: str = "url", keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """The kept columns with host, path, rule and verdict of each row."""
    host, path = parts(F.col(url))
    rows = pages.select(*keep, host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.select(*keep, "host", "path", rule.alias("rule"), verdict.alias("_verdict"))
    bad = common.work_table(listed_urls(rows.where("rule is null and host <> ''").select("host", "path"), listed), "url-hits")
    flagged = common.small(bad, bad.count(), 256).withColumn("_listed", F.lit(True))
    out = rows.join(flagged, ["host", "path"], "left")
    verdict = F.coalesce("_verdict", F.when(F.col("_listed"), "block").otherwise("allow"))
    return out.select(*keep, "host", "path", "rule", verdict.alias("verdict"))
