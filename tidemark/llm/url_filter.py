"""URL rules by a blocked Bloom filter and an exact hash join (operator 2, native)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.text import ascii_lower, whole

#: Bits a block, as eight words of 64; bits of the filter for each listed entry; bits set for each entry.
BLOCK_WORDS, BITS_PER_ENTRY, HASHES = 8, 16, 6
#: Largest filter, in blocks of 64 bytes, that is copied to every task (16 MB). A larger one is joined by its block number.
BROADCAST_BLOCKS = 1 << 18


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    return ascii_lower(F.regexp_extract(whole(url), "^(?s:.*?)://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.regexp_extract(whole(url), "^(?s:.*?)://[^/?#]*([^?#]*)", 1)


def _place(key: Column, blocks: int) -> dict[str, Column]:
    """Block number of a key, and the masks of its bits in the words of the block."""
    a, b = F.xxhash64(key), F.xxhash64(key, F.lit(1))
    words = {f"w{i}": F.lit(0).cast("bigint") for i in range(BLOCK_WORDS)}
    for j in range(HASHES):
        nine = F.shiftright(b, 9 * j).bitwiseAND(F.lit(511))
        word = F.shiftright(nine, 6)
        mask = F.call_function("shiftleft", F.lit(1).cast("bigint"), nine.bitwiseAND(F.lit(63)).cast("int"))
        for i in range(BLOCK_WORDS):
            words[f"w{i}"] = words[f"w{i}"].bitwiseOR(F.when(word == i, mask).otherwise(F.lit(0).cast("bigint")))
    return {"block": F.pmod(a, F.lit(blocks).cast("bigint")), **words}


def url_filter(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """pages plus (host, path, rule, verdict); rules(host, path, verdict) name a host with its subdomains and a path prefix.

    Listed entries, written ``host`` + ``path``, go into a blocked Bloom filter: an entry sets ``HASHES`` bits in one block
    of 512. A url asks for each of its own entries: host and parent domains, times the path prefixes of the lengths that
    occur in the list. What passes the filter meets the list in an exact hash join, which removes false positives. The
    longest rule that fits wins (a block at equal length); a url without one gets ``default``. A null url, or one without
    ``://``, has an empty host and path and fits no rule. Repeated pages are judged alike; clashing columns are replaced.
    """
    listed = (rules.where(F.col("host").isNotNull() & F.col("path").isNotNull())
              .groupBy(F.concat("host", "path").alias("_entry"), F.length("path").alias("_length"))
              .agg(F.max("verdict").alias("_rule_verdict")))
    size = listed.agg(F.count("*").alias("n"), F.collect_set("_length").alias("lengths")).first()
    lengths, blocks = sorted(size["lengths"]), 1
    while blocks * BLOCK_WORDS * 64 < BITS_PER_ENTRY * size["n"]:
        blocks *= 2
    words = [f"w{i}" for i in range(BLOCK_WORDS)]
    bloom = (listed.select(*(c.alias(k) for k, c in _place(F.col("_entry"), blocks).items()))
             .groupBy("block").agg(*(F.bit_or(w).alias(f"has_{w}") for w in words)))
    if blocks <= BROADCAST_BLOCKS:
        bloom = F.broadcast(bloom)

    out = pages.drop("host", "path", "rule", "verdict").withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))})
    labels = F.split("host", "\\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)),
                          lambda i: F.array_join(F.slice(labels, i, F.size(labels) - i + 1), "."))
    prefixes = F.filter(F.array(*(F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in lengths)),
                        lambda p: p.isNotNull()) if lengths else F.array().cast("array<string>")
    # One row for each distinct host and path, however many pages share them.
    places = out.select("host", "path").where("host <> ''").distinct()
    asked = (places.withColumn("_domain", F.explode(domains)).withColumn("_prefix", F.explode(prefixes))
             .select("host", "path", F.concat("_domain", "_prefix").alias("_entry"), F.length("_prefix").alias("_length")))
    at = _place(F.col("_entry"), blocks)
    held = F.lit(True)
    for w in words:
        held = held & (F.col(f"has_{w}").bitwiseAND(F.col(w)) == F.col(w))
    possible = asked.withColumns(at).join(bloom, "block").where(held).select("host", "path", "_entry", "_length")
    best = (possible.join(listed, ["_entry", "_length"]).groupBy("host", "path")
            .agg(F.max_by(F.struct("_entry", "_rule_verdict"), F.struct(F.length("_entry"), "_rule_verdict")).alias("_best")))
    judged = out.join(best, ["host", "path"], "left")
    return judged.select(*(c for c in out.columns), F.col("_best._entry").alias("rule"),
                         F.coalesce("_best._rule_verdict", F.lit(default)).alias("verdict"))
