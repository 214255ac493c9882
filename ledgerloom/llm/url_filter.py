"""URL filter: rules by host and path, and a list of URLs behind a blocked Bloom filter.

Only DataFrame functions. The listed canonical URLs are hashed into a blocked Bloom
filter: one hash picks a block of 256 bits, further ones set 8 bits in it, so that a
probe touches one block. The filter is a table of blocks, joined to the URLs on the
block number. Only possible hits go on to an exact join on the canonical URL, which
removes the false ones; all other rows never leave their partition.

The number of blocks follows the list (``BITS_PER_URL``). Up to ``BROADCAST_BLOCKS``
blocks (about 50 MB) the filter is broadcast; a larger one is joined by shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORDS, WORD_BITS, PROBES = 8, 32, 8
BITS_PER_URL = 16
BROADCAST_BLOCKS = 1 << 19

#: (host and path, verdict) of the contract.
RULES: tuple[tuple[str, str], ...] = (
    ("com/en/", "block"),
    ("example.com/en/7", "allow"),
    ("net/de/", "allow"),
    ("example.net/de/8", "block"),
    ("org/es/", "block"),
)


def _rest(url: Column) -> Column:
    """What follows the first ``://``; null without one."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def _before(text: Column, stops: str) -> Column:
    return F.regexp_extract(text, f"^[^{stops}]*", 0)


def _ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    return F.coalesce(_ascii_lower(_before(_rest(url), "/?#")), F.lit(""))


def path_of(url: Column) -> Column:
    rest = _rest(url)
    return F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """Host without ``www.``, path without ``/`` at its end, sorted query without ``ref`` and ``utm_*``; null where no ``://``."""
    rest = _rest(url)
    host = F.regexp_replace(host_of(url), "^www\\.", "")
    path = F.regexp_replace(path_of(url), "/+$", "")
    query = F.regexp_extract(rest, "^[^?#]*\\?([^#]*)", 1)
    parts = F.array_sort(F.filter(F.split(query, "&"), lambda x: (x != "") & ~x.rlike("^(ref|utm_[a-z]+)(=|$)")))
    tail = F.array_join(parts, "&")
    return F.when(rest.isNotNull(), F.concat(host, path, F.when(tail != "", F.concat(F.lit("?"), tail)).otherwise("")))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The longest rule that fits, as struct(rule, verdict); null if none does."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule, verdict in sorted(rules, key=lambda r: len(r[0])):
        rule_host, _, rule_path = rule.partition("/")
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith("/" + rule_path)
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _block(url: Column, n_blocks: int) -> Column:
    return F.pmod(F.xxhash64(url, F.lit(1)), F.lit(n_blocks))


def _masks(url: Column) -> list[Column]:
    """A mask of one bit for each word of a block."""
    h = F.xxhash64(url, F.lit(2))
    return [F.call_function("shiftleft", F.lit(1).cast("bigint"), F.shiftrightunsigned(h, 5 * i).bitwiseAND(F.lit(31)).cast("int")) for i in range(WORDS)]


def bloom(listed: DataFrame, n_blocks: int) -> DataFrame:
    """The filter's blocks ``(block, w0 .. w7)`` of the distinct URLs in ``listed.url``."""
    masks = _masks(F.col("url"))
    return listed.groupBy(_block(F.col("url"), n_blocks).alias("block")).agg(*[F.bit_or(m).alias(f"w{i}") for i, m in enumerate(masks)])


def filter_urls(pages: DataFrame, listed: DataFrame, rules: Sequence[tuple[str, str]] = RULES, key: str = "page_id") -> DataFrame:
    """Judge every URL: the longest fitting rule's verdict, else ``block`` if its canonical URL is listed, else ``allow``.

    ``listed`` has a column ``url`` of canonical URLs (nulls and repeats are ignored).
    Returns ``key, host, path, canonical, rule, verdict, maybe`` (``maybe``: passed the
    Bloom filter), one row for each input row. A null URL or one without ``://`` has an
    empty host and path and is allowed; repeated rows stay repeated; other columns are
    ignored; empty tables give empty results or an empty list.
    """
    known = listed.select(F.col("url").cast("string").alias("url")).where(F.col("url").isNotNull()).distinct()
    n_blocks = max(1, -(-known.count() * BITS_PER_URL // (WORDS * WORD_BITS)))
    blocks = bloom(known, n_blocks)
    if n_blocks <= BROADCAST_BLOCKS:
        blocks = F.broadcast(blocks)
    url = F.col("url")
    judged = pages.select(F.col(key).alias(key), F.col("url").cast("string").alias("url"))
    judged = judged.select(key, host_of(url).alias("host"), path_of(url).alias("path"), canonical(url).alias("canonical"))
    judged = judged.withColumn("fit", rule_of(F.col("host"), F.col("path"), rules))
    asked = F.col("fit").isNull() & F.col("canonical").isNotNull()  # the others need no look at the list
    probe = judged.where(asked).withColumn("block", _block(F.col("canonical"), n_blocks))
    bits = F.lit(True)
    for i, m in enumerate(_masks(F.col("canonical"))):
        bits = bits & (F.col(f"w{i}").bitwiseAND(m) != 0)
    maybe = F.coalesce(bits, F.lit(False))
    probe = probe.join(blocks, "block", "left").select(key, "host", "path", "canonical", "fit", maybe.alias("maybe"))
    hits = probe.where("maybe").join(known.withColumnRenamed("url", "canonical").withColumn("listed", F.lit(True)), "canonical", "left")
    rest = probe.where(~F.col("maybe")).unionByName(judged.where(~asked).withColumn("maybe", F.lit(False))).withColumn("listed", F.lit(None).cast("boolean"))
    verdict = F.coalesce(F.col("fit.verdict"), F.when(F.col("listed"), "block"), F.lit("allow"))
    return hits.unionByName(rest).select(key, "host", "path", "canonical", F.col("fit.rule").alias("rule"), verdict.alias("verdict"), "maybe")


def repeated_urls(pages: DataFrame, least: int = 2) -> DataFrame:
    """A list to block where no other is given: canonical URLs that ``least`` or more pages share (crawler traps)."""
    return (
        pages.select(canonical(F.col("url").cast("string")).alias("url"))
        .where(F.col("url").isNotNull())
        .groupBy("url")
        .agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") >= least)
        .select("url")
    )
