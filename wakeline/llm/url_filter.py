"""URL filter: rules by host and path, then a listing behind a blocked Bloom filter.

The listing's canonical URLs set eight bits each in one 512-bit block.  The blocks are a
table of at most ``MAX_BLOCKS`` rows, so broadcasting it is safe at any listing size.  URLs
whose eight bits are set are possible hits; only they are shuffled to an exact join with
the listing, which removes the false positives.

Defined cases: a null URL or one without ``://`` has empty host, path and canonical form,
matches no rule and no listing entry and is allowed; repeated rows stay, each judged alike;
an empty listing blocks nothing; other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS_PER_KEY = 20
BLOCK_BITS = 512
#: 2^18 blocks of eight longs, 19 MB: the bound of the broadcast.
MAX_BLOCKS = 1 << 18
LANES = range(8)

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty without ``://``."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), "^[^?#]*", 0)
    return F.coalesce(F.translate(host, _UPPER, _LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def canonical(host: Column, path: Column) -> Column:
    """Host without a leading ``www.`` and path without closing slashes; empty without a host."""
    return F.when(host == "", F.lit("")).otherwise(
        F.concat(F.regexp_replace(host, "^www\\.", ""), F.regexp_replace(path, "/+$", "")))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict; null where none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: len(r[0])):
        domain, tail = text.split("/", 1)
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith("/" + tail)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")


def _bits(key: Column) -> list[Column]:
    """One bit in each lane, from a second hash of the key."""
    second = F.xxhash64(key, F.lit("lane"))
    return [F.call_function("shiftleft", F.lit(1).cast("bigint"),
                            F.shiftrightunsigned(second, 6 * i).bitwiseAND(F.lit(63)).cast("int")) for i in LANES]


def bloom_blocks(listing: DataFrame, key: str, blocks: int) -> DataFrame:
    """The filter's non-empty blocks: ``block`` and eight 64-bit lanes, merged map-side."""
    rows = listing.select(_block(F.col(key), blocks).alias("block"), *(b.alias(f"lane{i}") for i, b in enumerate(_bits(F.col(key)))))
    return rows.groupBy("block").agg(*(F.bit_or(f"lane{i}").alias(f"lane{i}") for i in LANES))


def possible(df: DataFrame, key: str, bloom: DataFrame, blocks: int) -> DataFrame:
    """``df`` with ``maybe``: whether all eight bits of the key are set."""
    bits = _bits(F.col(key))
    joined = df.withColumn("_block", _block(F.col(key), blocks)).join(
        F.broadcast(bloom), F.col("_block") == F.col("block"), "left")
    hit = F.lit(True)
    for i in LANES:
        hit = hit & (F.col(f"lane{i}").bitwiseAND(bits[i]) == bits[i])
    return joined.withColumn("maybe", F.coalesce(hit, F.lit(False)) & (F.col(key) != "")).drop(
        "_block", "block", *(f"lane{i}" for i in LANES))


def judge(pages: DataFrame, listing: DataFrame, rules: Sequence[tuple[str, str]],
          id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Verdict of every URL: the longest rule's, else block for listed canonical URLs.

    ``listing`` has a column ``canonical``.
    """
    host, path = host_and_path(F.col(url_col))
    urls = pages.select(F.col(id_col), host.alias("host"), path.alias("path"))
    rule, says = rule_of(F.col("host"), F.col("path"), rules)
    urls = urls.withColumns({"rule": rule, "_says": says, "canonical": canonical(F.col("host"), F.col("path"))})

    listing = listing.filter("canonical <> ''").select("canonical").distinct()
    blocks = max(1, min(MAX_BLOCKS, -(-listing.count() * BITS_PER_KEY // BLOCK_BITS)))
    marked = possible(urls, "canonical", bloom_blocks(listing, "canonical", blocks), blocks)
    sure = marked.filter(~F.col("maybe")).withColumn("listed", F.lit(False))
    exact = marked.filter("maybe").join(listing.withColumn("listed", F.lit(True)), "canonical", "left").withColumn(
        "listed", F.coalesce("listed", F.lit(False)))
    return sure.unionByName(exact).select(
        id_col, "host", "path", "rule",
        F.coalesce("_says", F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"),
        "canonical", "maybe", "listed")
