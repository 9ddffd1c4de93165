"""URL filter: host and path rules, then a blocked Bloom filter with an exact hash join behind it.

Only DataFrame functions run here. A url is cut into host (after the first ``://`` up to ``/``,
``?``, ``#`` or the end, A-Z lower-cased) and path (then up to ``?``, ``#`` or the end); the
longest rule that fits decides. Where none fits, the url is blocked if its canonical form is
listed: host without a leading ``www.`` or ``m.``, path without ``.html`` and closing slashes.

The blocked Bloom filter is a table of at most ``BLOCKS`` 64-bit words: a url's hash names one
word and four bits in it, so a probe touches one word. Its size is fixed by the parameter,
whatever the length of the list (16 bytes a row, 2 MB as built here), so the broadcast is
bounded; a fuller filter only lets more urls on to the exact join, never changes a verdict.
Only possible hits are shuffled to the join with the distinct listed urls.

Defined cases: a null url or one without ``://`` has an empty host and path, fits no rule and is
never listed, so it is allowed; repeated rows and ids get equal verdicts, one row each; very
long urls are read whole; null or empty listed urls are left out; an empty list blocks nothing;
an empty table gives no row. Only ``page_id`` and ``url`` are read, so extra columns cannot clash.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.session import read_table

BLOCKS = 1 << 17
PROBES = 4
#: (verdict, host, path prefix)
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: Host words whose pages make up the query's list of known bad urls.
LISTED_HOST_WORDS = ("spam-farm", "cheap-pills", "casino", "torrent", "free-bets", "ads-track", "adult-x")

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_REST = r"(?s)^.*?://(.*)$"


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), _REST, 1)
    return F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), _REST, 1)
    return F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def canonical(host: Column, path: Column) -> Column:
    """Canonical form, null where there is no host."""
    bare = F.rtrim(path, F.lit("/"))
    bare = F.when(bare.endswith(".html"), F.left(bare, F.length(bare) - 5)).otherwise(bare)
    return F.when(host != "", F.concat(F.regexp_replace(host, r"^(?:www|m)\.", ""), bare))


def _fits(host: Column, path: Column, rule: tuple[str, str, str]) -> Column:
    return ((host == rule[1]) | host.endswith(f".{rule[1]}")) & path.startswith(rule[2])


def longest_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits (among equals, block before allow); null if none."""
    name = verdict = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r[0] == "block")):
        fits = _fits(host, path, rule)
        name, verdict = F.when(fits, rule[1] + rule[2]).otherwise(name), F.when(fits, rule[0]).otherwise(verdict)
    return name, verdict


def _block(url: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(url), F.lit(blocks)).cast("int")


def _mask(url: Column) -> Column:
    """``PROBES`` bits of a 64-bit word, from a second hash."""
    bits = F.xxhash64(F.lit("bits"), url)
    out = F.lit(0).cast("long")
    for k in range(PROBES):
        out = out.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(bits, 6 * k).bitwiseAND(F.lit(63)).cast("int")))
    return out


def bloom(listed: DataFrame, blocks: int = BLOCKS) -> DataFrame:
    """(block, word) of the filter of a column ``canonical``: at most ``blocks`` rows."""
    return (listed.select(_block(F.col("canonical"), blocks).alias("block"), _mask(F.col("canonical")).alias("mask"))
            .groupBy("block").agg(F.bit_or("mask").alias("word")))


def judge(pages: DataFrame, listed: DataFrame, rules=RULES, blocks: int = BLOCKS) -> DataFrame:
    """(page_id, host, path, rule, verdict, listed) of every page; ``listed`` has a column ``url``."""
    keys = (listed.select(canonical(host_of(F.col("url")), path_of(F.col("url"))).alias("canonical"))
            .where(F.col("canonical").isNotNull()).distinct())
    cut = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    name, verdict = longest_rule(F.col("host"), F.col("path"), rules)
    ruled = cut.withColumns({"rule": name, "ruled": verdict, "canonical": canonical(F.col("host"), F.col("path"))})
    probed = (ruled.withColumn("block", _block(F.col("canonical"), blocks))
              .join(F.broadcast(bloom(keys, blocks)), "block", "left"))
    mask = _mask(F.col("canonical"))
    possible = F.coalesce(F.col("word").bitwiseAND(mask) == mask, F.lit(False))
    probed = probed.withColumn("possible", F.col("canonical").isNotNull() & possible)
    hit = (probed.where("possible").join(keys.withColumn("listed", F.lit(True)), "canonical", "left")
           .select("page_id", "host", "path", "rule", "ruled", F.coalesce("listed", F.lit(False)).alias("listed")))
    clear = probed.where("NOT possible").select("page_id", "host", "path", "rule", "ruled", F.lit(False).alias("listed"))
    return hit.unionByName(clear).select(
        "page_id", "host", "path", "rule",
        F.coalesce("ruled", F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"), "listed")


def known_bad(pages: DataFrame, words=LISTED_HOST_WORDS) -> DataFrame:
    """Urls of the pages on hosts that hold one of the words: the query's list."""
    host = host_of(F.col("url"))
    found = F.lit(False)
    for word in words:
        found = found | host.contains(word)
    return pages.where(found).select("url")


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url")
    return judge(pages, known_bad(pages))


OP5_SQL = r"""
WITH rest AS (
  SELECT page_id, CASE WHEN url IS NULL OR position('://' IN url) = 0 THEN '' ELSE substr(url, position('://' IN url) + 3) END AS rest
  FROM pages
), cut AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM rest
), ruled AS (
  SELECT *, CASE
    WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND path LIKE '/en/%' THEN 'www.example.com/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/en/%' THEN 'example.com/en/'
    WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/es/%' THEN 'net/es/'
    WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/fr/%' THEN 'net/fr/'
    WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/%' THEN 'com/' END AS rule,
    CASE WHEN host <> '' THEN regexp_replace(host, '^(www|m)\.', '') ||
      CASE WHEN rtrim(path, '/') LIKE '%.html' THEN left(rtrim(path, '/'), -5) ELSE rtrim(path, '/') END END AS canonical
  FROM cut
), listed AS (
  SELECT DISTINCT canonical FROM ruled
  WHERE host LIKE '%spam-farm%' OR host LIKE '%cheap-pills%' OR host LIKE '%casino%' OR host LIKE '%torrent%'
     OR host LIKE '%free-bets%' OR host LIKE '%ads-track%' OR host LIKE '%adult-x%'
)
SELECT r.page_id, r.host, r.path, r.rule,
       CASE WHEN r.rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN r.rule IS NOT NULL THEN 'block'
            WHEN l.canonical IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict,
       l.canonical IS NOT NULL AS listed
FROM ruled r LEFT JOIN listed l ON r.canonical = l.canonical
"""
