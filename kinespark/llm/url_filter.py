"""URL verdicts: domain rules first, then membership in a list of canonical URLs.

The list is held as a blocked Bloom filter: one row per 512-bit block, eight 64-bit words,
one bit of each word set per listed URL. A page probes the single block its URL hashes to;
pages that miss any bit are not listed. The rest are joined with the list itself by exact
canonical URL, which removes the filter's false positives, so the verdict is exact.
The filter is broadcast only while its counted blocks stay under ``BROADCAST_BLOCKS``;
a longer list is probed through a shuffle on the block number. The join is by hash while a
partition of the list stays under ``BUILD_ROWS``, beyond that by sorting, which can spill.

Defined results: a null url, or one without ``://``, has empty host and path, fits no rule,
is never listed and is allowed; of rules of equal length that fit, the last given counts;
the same rows of the list may repeat; repeated pages get equal verdicts; urls of any length
are read whole; an empty list blocks nothing and an empty table gives an empty table; ids
may be of any type, null or shared; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .workspace import clear_of, named, stored

#: (verdict, host, path prefix)
RULES: tuple[tuple[str, str, str], ...] = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
BITS_A_URL = 16
BROADCAST_BLOCKS = 200_000  # of 72 bytes: 14 MB
BUILD_ROWS = 500_000
_WORDS = 8
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SHAPE = r"(?s)^.*?://([^/?#]*)([^?#]*)(?:\?([^#]*))?"


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, _SHAPE, 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _SHAPE, 2), F.lit(""))


def canonical(url: Column) -> Column:
    """Host without ``www.``, path without trailing slashes, parameters sorted without ``utm_*`` and ``ref``; no scheme, no fragment."""
    host = F.regexp_replace(host_of(url), r"^www\.", "")
    path = F.regexp_replace(path_of(url), "/+$", "")
    asked = F.filter(F.split(F.regexp_extract(url, _SHAPE, 3), "&"), lambda x: (x != "") & ~x.rlike("^(utm_|ref=)"))
    query = F.array_join(F.array_sort(asked), "&")
    whole = F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit("")))
    return F.when(F.coalesce(F.instr(url, "://"), F.lit(0)) > 0, whole)


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, null where none fits. ``rules`` is a short, given list."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, domain, prefix in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith(prefix)
        rule, verdict = F.when(fits, domain + prefix).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


def _bit(key: Column, i: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64(key, F.lit(17)), 6 * i).bitwiseAND(F.lit(63).cast("long")).cast("int")


def bloom(listed: DataFrame, blocks: int) -> DataFrame:
    """The filter of column ``key``: block, w0 to w7."""
    one = F.lit(1).cast("long")
    return listed.groupBy(F.pmod(F.xxhash64("key"), F.lit(blocks)).alias("block")).agg(
        *(F.bit_or(F.call_function("shiftleft", one, _bit(F.col("key"), i))).alias(f"w{i}") for i in range(_WORDS))
    )


def judge(pages: DataFrame, listed: DataFrame, *, id_col: str = "page_id", url_col: str = "url", listed_col: str = "url", rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """Per page: id, host, path, rule, verdict, and whether its canonical URL is listed."""
    clear_of(pages, id_col, url_col)
    clear_of(listed, listed_col)
    keys = stored(listed.select(canonical(named(listed_col)).alias("key")).where("key is not null").distinct())
    many = keys.count()
    blocks = max(1, -(-many * BITS_A_URL // (64 * _WORDS)))
    probe = bloom(keys, blocks)
    if blocks <= BROADCAST_BLOCKS:
        probe = F.broadcast(probe)
    rule, says = rule_for(F.col("host"), F.col("path"), rules)
    url = named(url_col)
    seen = (
        pages.select(named(id_col).alias("id"), host_of(url).alias("host"), path_of(url).alias("path"), canonical(url).alias("key"), F.xxhash64(url, named(id_col)).alias("spread"))
        # a url without a key is in no block: it goes anywhere
        .withColumns({"rule": rule, "says": says, "at": F.pmod(F.when(F.col("key").isNull(), F.col("spread")).otherwise(F.xxhash64("key")), F.lit(blocks))})
    )
    bits = [F.coalesce(F.col("key").isNotNull() & (F.call_function("shiftright", F.col(f"w{i}"), _bit(F.col("key"), i)).bitwiseAND(F.lit(1).cast("long")) == 1), F.lit(False)) for i in range(_WORDS)]
    hit = bits[0]
    for b in bits[1:]:
        hit = hit & b
    names = ["id", "host", "path", "rule", "says"]
    marked = stored(seen.join(probe, F.col("at") == F.col("block"), "left").select(*names, F.when(hit, F.col("key")).alias("key")))
    exact = keys.withColumn("found", F.lit(True))
    if many <= BUILD_ROWS * int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        exact = exact.hint("shuffle_hash")
    found = marked.where("key is not null").join(exact, "key", "left")
    both = found.select(*names, F.coalesce("found", F.lit(False)).alias("listed")).unionByName(marked.where("key is null").select(*names, F.lit(False).alias("listed")))
    method = F.when(F.col("listed"), "block").otherwise("allow")
    return both.select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("says", method).alias("verdict"), "listed")


#: DuckDB, for ``judge`` with the pages whose id is divisible by 20 as the list.
ORACLE = r"""
WITH p AS (
  SELECT page_id, url,
         coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path,
         regexp_extract(url, '(?s)^.*?://[^/?#]*[^?#]*\?([^#]*)', 1) AS asked
  FROM pages),
q AS (
  SELECT *, array_to_string(list_sort(list_filter(string_split(asked, '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_|ref=)'))), '&') AS query FROM p),
c AS (
  SELECT page_id, host, path,
         CASE WHEN url LIKE '%://%' THEN regexp_replace(host, '^www\.', '') || regexp_replace(path, '/+$', '') || CASE WHEN query <> '' THEN '?' || query ELSE '' END END AS key
  FROM q),
l AS (SELECT DISTINCT key FROM c WHERE page_id % 20 = 0 AND key IS NOT NULL),
r AS (
  SELECT c.page_id, c.host, c.path, l.key IS NOT NULL AS listed,
         CASE WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/en/1') THEN 'example.org/en/1'
              WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/es/') THEN 'example.org/es/'
              WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/fr/') THEN 'com/fr/'
              WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/de/') THEN 'com/de/'
              WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/') THEN 'org/' END AS rule
  FROM c LEFT JOIN l ON c.key = l.key)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('example.org/en/1', 'example.org/es/', 'com/de/') THEN 'block'
            WHEN rule IN ('org/', 'com/fr/') THEN 'allow'
            WHEN listed THEN 'block' ELSE 'allow' END AS verdict, listed
FROM r
"""
