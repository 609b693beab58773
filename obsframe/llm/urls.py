"""Operator 9: URL rules through a blocked Bloom filter and an exact hash join. DataFrame functions only.

A rule is a host and a path; it fits its host and all subdomains, if the url's path starts with the rule's. For each
url the keys that could be listed are its host suffixes, of no more labels than rules have, with its path prefixes of
the lengths that rules have, so a very long host or path makes no more keys than any other. A blocked Bloom filter of the listed canonical keys (one 64-bit word a block) passes possible hits, and an exact hash
join with the rules removes false positives; the longest rule wins.

Nulls: a null url, or one without `://`, has an empty host and path, and no rule fits; a null id is kept. Repeated rows
are judged one by one; a rule that is listed twice counts once, by the lesser verdict, and no two rules that fit a url
are equally long unless they are the same. Empty tables: no rows, or no rules. Other columns are never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .work import lower_ascii

#: Bits set for a key, and keys for each 64-bit block on average.
BLOOM_BITS, KEYS_A_BLOCK = 4, 6
#: Filters of up to so many blocks (8 MB), and lists of rules of so many bytes, are broadcast; beyond, they are joined by
#: shuffle (where Spark splits keys that many urls share).
BROADCAST_BLOCKS, BROADCAST_BYTES = 1 << 20, 16_000_000


def host_and_path(url: Column) -> tuple[Column, Column]:
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    part = lambda n: F.coalesce(F.regexp_extract(url, pattern, n), F.lit(""))
    return lower_ascii(part(1)), part(2)


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks))


def _mask(key: Column) -> Column:
    """The bits of a key within its block."""
    h, one = F.xxhash64(F.concat(key, F.lit("#"))), F.lit(1).cast("long")
    bits = [F.call_function("shiftleft", one, F.pmod(F.shiftrightunsigned(h, 6 * i), F.lit(64)).cast("int")) for i in range(BLOOM_BITS)]
    out = bits[0]
    for b in bits[1:]:
        out = out.bitwiseOR(b)
    return out


def bloom_filter(rules: DataFrame, blocks: int) -> DataFrame:
    """block, bits of the keys in column rule."""
    return rules.groupBy(_block(F.col("rule"), blocks).alias("block")).agg(F.bit_or(_mask(F.col("rule"))).alias("bits"))


def judge_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """id_col, host, path, rule, verdict. rules: host, path, verdict. default: the verdict of urls that are not listed."""
    rules = rules.select(F.concat(lower_ascii(F.col("host")), F.coalesce("path", F.lit(""))).alias("rule"), F.length(F.coalesce("path", F.lit(""))).alias("path_length"), "verdict").where("rule is not null")
    rules = rules.groupBy("rule", "path_length").agg(F.min("verdict").alias("verdict"))
    labels = F.size(F.split(F.expr("left(rule, length(rule) - path_length)"), r"\."))
    size = F.sum(F.length("rule") + F.length(F.coalesce("verdict", F.lit(""))) + 40)
    facts = rules.agg(F.count("*").alias("n"), F.collect_set("path_length").alias("lengths"), F.max(labels).alias("labels"), size.alias("bytes")).first()
    n, lengths = facts["n"], sorted(facts["lengths"])  # lengths: a few thousand at most, as urls are
    host, path = host_and_path(F.col(url_col))
    rows = pages.select(F.col(id_col), host.alias("host"), path.alias("path"))
    if not n:
        return rows.select(id_col, "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.greatest(F.lit(1), F.size(labels) - (facts["labels"] - 1)), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    prefixes = F.transform(F.filter(F.array(*map(F.lit, lengths)), lambda k: k <= F.length("path")), lambda k: F.substring("path", F.lit(1), k))
    keys = F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, p))))
    blocks = max(1, -(-n // KEYS_A_BLOCK))
    bloom = bloom_filter(rules, blocks)
    rows = rows.withColumn("row", F.monotonically_increasing_id()).withColumn("key", F.explode_outer(keys))
    rows = rows.withColumn("block", _block(F.col("key"), blocks))
    rows = rows.join(F.broadcast(bloom) if blocks <= BROADCAST_BLOCKS else bloom, "block", "left")
    mask = _mask(F.col("key"))
    rows = rows.withColumn("key", F.when(F.col("bits").bitwiseAND(mask) == mask, F.col("key"))).drop("block", "bits")
    listed = rules.select(F.col("rule").alias("key"), F.col("verdict"))
    rows = rows.join(F.broadcast(listed) if facts["bytes"] <= BROADCAST_BYTES else listed, "key", "left")
    best = F.max(F.when(F.col("verdict").isNotNull(), F.struct(F.length("key").alias("n"), F.col("key").alias("rule"), F.col("verdict").alias("v"))))
    # Rows of one url stand together in one task, so the partial aggregate leaves one row for each url to shuffle.
    out = rows.groupBy("row").agg(F.first(id_col).alias(id_col), F.first("host").alias("host"), F.first("path").alias("path"), best.alias("best"))
    return out.select(id_col, "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.v", F.lit(default)).alias("verdict"))
