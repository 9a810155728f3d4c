"""URL filter: path rules by host suffix, then a block list behind a blocked Bloom filter.

Rules are few and become one expression. The block list may be large: its canonical URLs fill a Bloom filter of blocks of 256 bits,
whose size has a fixed bound, so it can be broadcast whatever the list's length. Only URLs that it lets pass go to the exact hash
join with the list, which removes the filter's false positives; all others are done without a shuffle.

Null URLs, URLs without ``://`` and empty ones have an empty host and path and no canonical URL: no rule and no list entry fits them,
so they are allowed. Repeated rows are judged each for itself. Other columns of the table are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from decisionlog.llm.shared import stored

BITS_PER_KEY = 12
MAX_BLOCKS = 1 << 17  # 4 MB of bits; longer lists raise the rate of false positives, not the size
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"

Rule = tuple[str, str, str]


def host(url: Column) -> Column:
    """Between the first ``://`` and ``/ ? #``, ASCII lower case; empty if there is none."""
    return F.coalesce(F.translate(F.regexp_extract(url, _PARTS, 1), _UPPER, _LOWER), F.lit(""))


def path(url: Column) -> Column:
    """What follows the host, up to ``?`` or ``#``."""
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def canonical(host: Column, path: Column) -> Column:
    """One spelling of a URL: no scheme, query or fragment, no ``/`` at the end; null without a host."""
    return F.when(host != "", F.concat(host, F.regexp_replace(path, "/+$", "")))


def longest_rule(rules: Sequence[Rule], host: Column, path: Column, give: int | None) -> Column:
    """The rule that wins: its verdict (``give=0``) or its text. Rules are (verdict, host, path prefix); a host stands for all below it."""
    found = []
    for rule in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == rule[1]) | host.endswith("." + rule[1])) & path.startswith(rule[2])
        found.append(F.when(fits, F.lit(rule[1] + rule[2] if give is None else rule[give])))
    return F.coalesce(*found) if found else F.lit(None).cast("string")


def _bits(key: Column, word: int) -> Column:
    """Two bits of the block's word that the key sets."""
    spread = F.xxhash64(key, F.lit(1))
    bit = lambda i: F.call_function("shiftleft", F.lit(1).cast("bigint"), F.shiftrightunsigned(spread, 6 * i).bitwiseAND(F.lit(63)).cast("int"))
    return bit(2 * word).bitwiseOR(bit(2 * word + 1))


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks))


def bloom_blocks(keys: DataFrame, key: str, blocks: int) -> DataFrame:
    """The filter as rows (block, four words of 64 bits)."""
    return keys.groupBy(_block(F.col(key), blocks).alias("block")).agg(*(F.bit_or(_bits(F.col(key), w)).alias(f"word{w}") for w in range(4)))


def filter_urls(pages: DataFrame, listed: DataFrame, rules: Sequence[Rule], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Each page's id, host, path, rule and verdict; ``listed`` holds canonical URLs to block in its first column.

    More columns: ``possible`` (the Bloom filter let it pass) and ``listed`` (the exact join confirmed it).
    """
    keys = stored(listed.toDF("canonical").filter("canonical is not null").distinct())
    blocks = 1
    bits = keys.count() * BITS_PER_KEY
    while blocks < MAX_BLOCKS and blocks * 256 < bits:
        blocks *= 2
    parts = pages.select(F.col(id_col).alias("page_id"), host(F.col(url_col)).alias("host"), path(F.col(url_col)).alias("path"))
    parts = parts.withColumn("canonical", canonical(F.col("host"), F.col("path")))
    probed = parts.withColumn("block", _block(F.col("canonical"), blocks)).join(F.broadcast(bloom_blocks(keys, "canonical", blocks)), "block", "left")
    passes = F.lit(True)
    for w in range(4):
        passes = passes & (F.col(f"word{w}").bitwiseAND(_bits(F.col("canonical"), w)) == _bits(F.col("canonical"), w))
    probed = probed.withColumn("possible", F.col("canonical").isNotNull() & F.coalesce(passes, F.lit(False))).select("page_id", "host", "path", "canonical", "possible")
    hits = probed.filter("possible").join(keys.withColumn("listed", F.lit(True)).hint("shuffle_hash"), "canonical", "left")
    clear = probed.filter("not possible").withColumn("listed", F.lit(False)).select(hits.columns)
    h, p = F.col("host"), F.col("path")
    known = F.coalesce("listed", F.lit(False))
    return hits.unionAll(clear).select(
        "page_id", "host", "path", longest_rule(rules, h, p, None).alias("rule"),
        F.coalesce(longest_rule(rules, h, p, 0), F.when(known, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"),
        "possible", known.alias("listed"),
    )
