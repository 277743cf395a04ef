"""URL filters: listed host and path rules, and a list of canonical URLs behind a blocked Bloom filter.

The filter is a table of 256-bit blocks (four longs). A canonical URL sets and looks up one bit in each long of the one
block that its hash names, so a lookup is one join on the block's number. Only URLs that pass go on to the exact hash
join with the list, which removes false positives.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import written

#: Fixed values of the query's contract: (verdict, rule).
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
#: Host names (without what stands before and after) whose pages make up the list of the query.
LISTED_HOSTS = ("casino-win", "free-bets", "cheap-pills", "ads-track", "spam-farm", "adult-x")
#: The filter is broadcast up to this many blocks (40 bytes each); beyond it, it is joined by shuffle.
BROADCAST_BLOCKS = 200_000
_A, _Z = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """What lies between the first ``://`` and the next ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _A, _Z)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """Host without a leading ``www.``, the path without ``/`` at its end, and the query's parts in order without
    ``utm_`` parts and ``ref``; empty where there is no ``://``. Scheme and fragment don't count."""
    query = F.regexp_extract(url, r"(?s)^.*?://[^?#]*\?([^#]*)", 1)
    parts = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike("^(utm_|ref=)")))
    text = F.concat(F.regexp_replace(host_of(url), r"^www\.", ""), F.regexp_replace(path_of(url), "/+$", ""), F.when(F.size(parts) > 0, F.concat(F.lit("?"), F.array_join(parts, "&"))).otherwise(""))
    return F.when(F.coalesce(url.contains("://"), F.lit(False)), text).otherwise("")


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, as a struct (verdict, rule), else null; of rules of one length, the first listed."""
    out = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, rule in reversed(sorted(rules, key=lambda r: -len(r[1]))):
        name, _, start = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + start)
        out = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))).otherwise(out)
    return out


def _bits(key: Column, blocks: int) -> list[Column]:
    """Number of the block and, for each of its longs, the bit."""
    other = F.xxhash64(key, F.lit(1))
    return [F.pmod(F.xxhash64(key), F.lit(blocks)).alias("block"), *(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.shiftright(other, 6 * k).bitwiseAND(63).cast("int")).alias(f"m{k}") for k in range(4))]


def bloom_blocks(listed: DataFrame, blocks: int) -> DataFrame:
    """The filter's blocks that have a bit set: (block, b0..b3), from ``listed(url)``."""
    return listed.select(*_bits(F.col("url"), blocks)).groupBy("block").agg(*(F.bit_or(f"m{k}").alias(f"b{k}") for k in range(4)))


def judge(pages: DataFrame, listed: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url", bits_per_url: int = 16) -> DataFrame:
    """(id, host, path, rule, verdict, in_list) of every page.

    ``listed(url)`` has canonical URLs. A page's verdict is its rule's, else block if its canonical URL is listed and
    allow if not. A null url or one without ``://`` has an empty host and path, no rule and is allowed. Null ids and
    repeated rows are kept. Other columns are left out. Nulls, empty strings and repeats in the list don't count.
    """
    listed = written(listed.select("url").where("url <> ''").distinct(), "url-list")
    blocks = max(1, listed.count() * bits_per_url // 256)
    table = bloom_blocks(listed, blocks)
    if blocks <= BROADCAST_BLOCKS:
        table = F.broadcast(table)
    url = F.col(url_col)
    rows = pages.select(F.col(id_col).alias("id"), url.alias("raw")).select("id", host_of(F.col("raw")).alias("host"), path_of(F.col("raw")).alias("path"), canonical(F.col("raw")).alias("url"))
    rows = rows.select("*", rule_of(F.col("host"), F.col("path"), rules).alias("fit"), *_bits(F.col("url"), blocks))
    passes = F.col("b0").isNotNull()
    for k in range(4):
        passes = passes & (F.col(f"b{k}").bitwiseAND(F.col(f"m{k}")) != 0)
    # pages without a canonical URL pass nothing, and look a block up that their id names, so that no task gets them all
    rows = rows.withColumn("block", F.when(F.col("url") != "", F.col("block")).otherwise(F.pmod(F.xxhash64("id"), F.lit(blocks))))
    rows = rows.join(table, "block", "left").withColumn("asks", F.coalesce(passes & (F.col("url") != ""), F.lit(False)))
    rows = rows.select("id", "host", "path", "fit", "url", "asks")
    if blocks > BROADCAST_BLOCKS:
        rows = written(rows, "url-passed")
    # only pages that pass the filter meet the list
    found = rows.where("asks").join(listed.withColumn("hit", F.lit(True)), "url", "left").withColumn("in_list", F.coalesce("hit", F.lit(False)))
    columns = ["id", "host", "path", "fit", "in_list"]
    rows = found.select(columns).union(rows.where(~F.col("asks")).withColumn("in_list", F.lit(False)).select(columns))
    verdict = F.coalesce("fit.verdict", F.when(F.col("in_list"), "block").otherwise("allow"))
    return rows.select(F.col("id").alias(id_col), "host", "path", F.col("fit.rule").alias("rule"), verdict.alias("verdict"), "in_list")


def listed_urls(pages: DataFrame) -> DataFrame:
    """The query's list: canonical URLs of the pages whose host has one of LISTED_HOSTS among its names."""
    names = F.split(host_of(F.col("url")), r"\.")
    return pages.where(F.arrays_overlap(names, F.array(*map(F.lit, LISTED_HOSTS)))).select(canonical(F.col("url")).alias("url"))


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge(pages, listed_urls(pages))


_FITS = " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '/{p}') THEN '{v}:{r}'" for v, r in sorted(RULES, key=lambda r: -len(r[1])) for h, _, p in [r.partition("/")])
OP1_SQL = f"""
WITH parts AS (
  SELECT page_id, coalesce(url, '') AS url,
    translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's'), '{_A}', '{_Z}') AS host,
    regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path,
    list_sort(list_filter(string_split(regexp_extract(coalesce(url, ''), '^.*?://[^?#]*\\?([^#]*)', 1, 's'), '&'),
      lambda p: p <> '' AND NOT starts_with(p, 'utm_') AND NOT starts_with(p, 'ref='))) AS query
  FROM pages),
canon AS (
  SELECT *, CASE WHEN contains(url, '://') THEN regexp_replace(host, '^www\\.', '') || regexp_replace(path, '/+$', '')
    || CASE WHEN len(query) > 0 THEN '?' || array_to_string(query, '&') ELSE '' END ELSE '' END AS canonical,
    CASE {_FITS} END AS fit
  FROM parts),
listed AS (
  SELECT DISTINCT canonical FROM canon
  WHERE canonical <> '' AND list_has_any(string_split(host, '.'), [{", ".join(f"'{h}'" for h in LISTED_HOSTS)}]))
SELECT page_id, host, path, split_part(fit, ':', 2) AS rule,
  coalesce(split_part(fit, ':', 1), CASE WHEN l.canonical IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict,
  l.canonical IS NOT NULL AS in_list
FROM canon LEFT JOIN listed AS l USING (canonical)
"""
