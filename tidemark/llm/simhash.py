"""SimHash near-duplicates by multi-index hashing (operator 3)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.text import as_before, as_text, partitions
from tidemark.operators.spatial import components

SHINGLE, SEED, DISTANCE = 3, 42, 2


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Majority bits of the XXH64 hashes of word shingles, as a signed 64-bit number."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        parts = [b" ".join(words)]
    else:
        parts = map(b" ".join, zip(*(words[i:] for i in range(shingle))))
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(p, SEED) for p in parts], dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(h), 4096):
        ones += np.unpackbits(h[at:at + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp) for docs(doc_id, text); ASCII letters are lower-cased, a null text has no words."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "fp": np.array([fingerprint(t, shingle) for t in pdf["text"]], dtype=np.int64)})
    return as_before(as_text(docs.select("doc_id", "text")).mapInPandas(run, "doc_id string, fp long"), docs)


def links(prints: DataFrame) -> DataFrame:
    """(a, b), a < b: the pairs of distinct fingerprints in prints(fp) that differ in one or two bits.

    Two segments of 32 bits. Of two differing bits either at most one falls into the first segment, or none into the second.
    So a fingerprint asks for the 33 values within one bit of its first segment, and for its own second segment. Matches are
    verified over all 64 bits inside the join.
    """
    p = prints.select("fp").distinct()
    high, low = F.shiftright("fp", 32), F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))
    stored = p.select(F.explode(F.array(F.struct(F.lit(0).alias("seg"), high.alias("key")), F.struct(F.lit(1).alias("seg"), low.alias("key")))).alias("s"),
                      F.col("fp").alias("b")).select("s.seg", "s.key", "b")
    ball = F.array(high, *(high.bitwiseXOR(F.lit((1 << i) - (1 << 32) * (i == 31)).cast("bigint")) for i in range(32)))
    asked = p.select(F.lit(0).alias("seg"), F.explode(ball).alias("key"), F.col("fp").alias("a")).unionByName(
        p.select(F.lit(1).alias("seg"), low.alias("key"), F.col("fp").alias("a")))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= DISTANCE
    found = asked.alias("q").join(stored.alias("t"), (F.col("q.seg") == F.col("t.seg")) & (F.col("q.key") == F.col("t.key"))
                                  & (F.col("a") < F.col("b")) & near)
    return found.select("a", "b").distinct()


def simhash_groups(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp, component_id): documents linked by fingerprints at two or fewer differing bits.

    Copies share a fingerprint and are one node, so their number adds no link. The component is the smallest doc_id reachable.
    Empty and null texts share fingerprint zero. A null doc_id takes part and is never the smallest.
    """
    from tidemark.session import cut_lineage
    marked = cut_lineage(fingerprints(docs, shingle))
    nodes = marked.groupBy("fp").agg(F.min("doc_id").alias("first"))
    label = components(nodes.select(F.col("fp").alias("unit_id")), links(nodes).select(F.col("a").alias("src"), F.col("b").alias("dst")),
                       salts=max(8, partitions(docs) // 8))
    label = nodes.join(label.withColumnRenamed("unit_id", "fp"), "fp")
    lowest = label.groupBy("component").agg(F.min("first").alias("component_id"))
    of_print = label.join(lowest, "component").select("fp", "component_id")
    return marked.join(of_print, "fp").select("doc_id", "fp", "component_id")


def hex_print(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
