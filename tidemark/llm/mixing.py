"""Mixing sources to target weights in blocks (operator 8)."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.batches import give_back
from tidemark.llm.text import WORD, word_count
from tidemark.session import cut_lineage, shared_folder

#: Words in a block; slots in an output shard; documents counted by one task; most passes over a source.
BLOCK, SHARD_SLOTS, CHUNK_ROWS, PASSES = 64, 4096, 1 << 9, 3
#: Output shards are drawn in at most so many groups; the driver draws the groups, tasks draw the shards.
GROUPS = 1024
WORDS = re.compile(WORD)
WEIGHTS = (1, 2, 3)


def targets(sizes: list[int], weights: list[float], passes: float = PASSES) -> list[float]:
    """Shares of all words by weight; what lies above ``passes`` times a source goes to the others by weight."""
    total, out = float(sum(sizes)), [0.0] * len(sizes)
    free = list(range(len(sizes)))
    while free:
        share = (total - sum(out[i] for i in range(len(sizes)) if i not in set(free))) / sum(weights[i] for i in free)
        over = [i for i in free if share * weights[i] > passes * sizes[i]]
        if not over:
            for i in free:
                out[i] = share * weights[i]
            break
        for i in over:
            out[i] = float(passes * sizes[i])
        free = [i for i in free if i not in set(over)]
    return out


def _scramble(x: np.ndarray, key: int) -> np.ndarray:
    """Mixes 64-bit words; constants of the splitmix64 generator, fixed values."""
    x = x + np.uint64(key & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def permuted(k: np.ndarray, n: int, key: int) -> np.ndarray:
    """Pseudorandom permutation of 0..n-1: a Feistel network on the next even number of bits, walked back into range."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask, x = np.uint64((1 << half) - 1), k.astype(np.uint64)
    todo = np.ones(len(x), dtype=bool)
    while todo.any():
        left, right = x[todo] >> np.uint64(half), x[todo] & mask
        for r in range(4):
            left, right = right, left ^ (_scramble(right, (key * 4 + r + 1) * 0x9E3779B97F4A7C15) & mask)
        x[todo] = (left << np.uint64(half)) | right
        todo = x >= n
    return x.astype(np.int64)


def _draw(rng: np.random.Generator, left: np.ndarray, n: int) -> np.ndarray:
    """Multinomial counts of n slots against what each source has left; what a source lacks is drawn again."""
    out = np.zeros_like(left)
    while n > 0:
        room = left - out
        got = np.minimum(rng.multinomial(n, room / room.sum()), room)
        out += got
        n -= int(got.sum())
    return out


def plan_slots(spark, slots: np.ndarray, blocks: np.ndarray, seed: int) -> DataFrame:
    """(shard, slot, sid, block, pass): which block of which source each slot of each output shard takes."""
    total = int(slots.sum())
    shards = -(-total // SHARD_SLOTS)
    groups = max(1, min(shards, GROUPS))
    rng, done, rows = np.random.default_rng(seed), np.zeros_like(slots), []
    for g in range(groups):
        first, last = shards * g // groups, shards * (g + 1) // groups
        n = min(last * SHARD_SLOTS, total) - min(first * SHARD_SLOTS, total)
        got = _draw(rng, slots - done, n)
        rows.append((g, first, last, got.tolist(), done.tolist()))
        done = done + got
    frame = spark.createDataFrame(rows, "g long, first long, last long, counts array<long>, done array<long>")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples():
                left, at = np.array(r.counts, dtype=np.int64), np.array(r.done, dtype=np.int64)
                for shard in range(r.first, r.last):
                    rng = np.random.default_rng([seed, 1, shard])
                    got = _draw(rng, left, min(SHARD_SLOTS, int(left.sum())))
                    sid = np.repeat(np.arange(len(got)), got)
                    k = np.concatenate([np.arange(a, a + c) for a, c in zip(at, got)] or [np.zeros(0, dtype=np.int64)])
                    block = np.concatenate([permuted(np.arange(a, a + c) % blocks[s], int(blocks[s]), seed * 1000003 + s)
                                            for s, (a, c) in enumerate(zip(at, got)) if c] or [np.zeros(0, dtype=np.int64)])
                    order = rng.permutation(len(sid))
                    yield pd.DataFrame({"shard": shard, "slot": np.arange(len(sid)), "sid": sid[order], "block": block[order],
                                        "pass": (k // np.maximum(blocks[sid], 1))[order]})
                    left, at = left - got, at + got

    return frame.repartition(groups, "g").mapInPandas(run, "shard long, slot long, sid long, block long, pass long")


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, block: int = BLOCK, seed: int = 42,
        number: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(sizes, spans) of a mix of docs(doc_id, text, source). ``number`` names a column that numbers the rows, if there is one.

    sizes(uid, doc_id, size, source_size, target): one row for each row of docs. spans(shard, slot, pass, uid, doc_id, start,
    n_words): the words that a slot of the mix takes from a document.

    A source's documents, in the order of a hash, doc_id and the text's hash, are one run of words, cut into blocks. Sources weigh ``weights``
    by turns, by code point, null last, and share all words; none is taken more than PASSES times. A source gets as many
    slots as its target holds mean blocks, so its words come within a block of the target, and no block is taken more than
    PASSES times. Slots of an output shard are multinomial counts against what each source has left. The k-th slot of a
    source takes the block at place k of a pseudorandom permutation, again from the start on the next pass.

    Nothing depends on the number of tasks, so reruns agree. A null text has no words; documents without words take no slot.
    Texts of any length count whole; further columns, whatever their names, are not looked at.
    One row for each source reaches the driver, none for a document.
    """
    spark = docs.sparkSession
    numbered = [F.col(f"`{number}`").alias("uid")] if number else []
    sized = cut_lineage(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("_h"), *numbered))
    if not numbered:
        sized = sized.withColumn("uid", F.monotonically_increasing_id())
    sources = sized.groupBy("source").agg(F.sum("size").alias("words"), F.count("*").alias("n")).collect()
    sources = sorted(sources, key=lambda r: (r["source"] is None, (r["source"] or "").encode()))
    words = [r["words"] for r in sources]
    goal = targets(words, [weights[i % len(weights)] for i in range(len(sources))]) if sum(words) else [0.0] * len(words)
    blocks = np.array([-(-w // block) for w in words], dtype=np.int64)
    slots = np.array([min(PASSES * b, round(t * b / w)) if w else 0 for t, b, w in zip(goal, blocks.tolist(), words)], dtype=np.int64)
    listed = spark.createDataFrame([(i, r["source"], w, t, 1 + r["n"] // CHUNK_ROWS) for i, (r, w, t) in enumerate(zip(sources, words, goal))],
                                   "sid long, _source string, source_size long, target double, _chunks long")
    known = sized.join(listed, sized["source"].eqNullSafe(listed["_source"])).select(
        "uid", "doc_id", "size", "_h", "sid", "source_size", "target", "_chunks")
    sizes = known.select("uid", "doc_id", "size", "source_size", "target")

    # Chunks of all sources hold about as many rows; those with one doc_id, which may be many, go to chunks by their text.
    rows = (known.where("size > 0").select("uid", "doc_id", "size", "_h", "sid", "_chunks")
            .withColumn("_chunk", F.pmod(F.xxhash64("doc_id", "_h"), F.col("_chunks"))))
    before = Window.partitionBy("sid").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    base = (rows.groupBy("sid", "_chunk").agg(F.sum("size").alias("_words"))
            .select("sid", "_chunk", F.coalesce(F.sum("_words").over(before), F.lit(0)).alias("_base")))
    inside = Window.partitionBy("sid", "_chunk").orderBy("doc_id", "size", "_h").rowsBetween(Window.unboundedPreceding, -1)
    begins = (rows.withColumn("_in", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(base, ["sid", "_chunk"])
              .withColumn("begin", F.col("_base") + F.col("_in")))
    begin, size, b = F.col("begin"), F.col("size"), F.lit(block)
    parts = begins.select("uid", "doc_id", "sid", "begin", "size", F.explode(F.sequence(
        F.expr(f"begin div {block}"), F.expr(f"(begin + size - 1) div {block}"))).alias("block"))
    lo = F.greatest(begin, F.col("block") * b)
    hi = F.least(begin + size, F.col("block") * b + b)
    parts = parts.select("uid", "doc_id", "sid", "block", (lo - begin).alias("start"), (hi - lo).alias("n_words"))
    # Spark takes the slots for as small as the table of counts that they are made from, and would copy them to every task.
    spans = plan_slots(spark, slots, blocks, seed).hint("merge").join(parts, ["sid", "block"])
    return sizes, spans.select("shard", "slot", "pass", "uid", "doc_id", "start", "n_words")


def taken(sizes: DataFrame, spans: DataFrame) -> DataFrame:
    """(doc_id, size, source_size, target, taken): the words that the mix takes of each row."""
    got = spans.groupBy("uid").agg(F.sum("n_words").alias("taken"))
    return (sizes.join(got, "uid", "left")
            .select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("bigint").alias("taken")))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """docs with the text that the mix takes of each document, and its n_chars; documents of which it takes nothing go.

    A pass that takes a whole document gives its text unchanged; taken parts keep the blanks between their words. Parts and
    passes follow each other, a line feed between them. Each row gets its own spans, also with a null doc_id or one that it
    shares. For that the rows are numbered once, in the shared folder, under a name of its own, so columns of any name pass.
    """
    spark, run = docs.sparkSession, uuid.uuid4().hex
    at, row, own_spans = f"{shared_folder(spark)}/mixing-{run}", f"row_{run}", f"spans_{run}"
    docs.withColumn(row, F.monotonically_increasing_id()).write.parquet(at)
    numbered = spark.read.parquet(at)
    spans = mix(numbered, number=row, **options)[1]
    of_row = spans.groupBy(F.col("uid").alias(row)).agg(F.sort_array(F.collect_list(F.array("pass", "start", "n_words"))).alias(own_spans))

    @F.pandas_udf("string")
    def cut(text: pd.Series, spans: pd.Series) -> pd.Series:
        out = []
        for t, own in zip(text, spans):
            words = [m.span() for m in WORDS.finditer(t)]
            parts, last = [], None
            for turn, start, n in own:
                if last and last[0] == turn and last[2] == start:
                    last[2] = start + n
                else:
                    last = [turn, start, start + n]
                    parts.append(last)
            out.append("\n".join(t if b - a == len(words) else t[words[a][0]:words[b - 1][1]] for _, a, b in parts))
        give_back()
        return pd.Series(out, dtype=object)

    out = numbered.join(of_row, row).withColumn("text", cut("text", own_spans))
    return out.withColumn("n_chars", F.length("text").cast("bigint")).select(*(f"`{c}`" for c in docs.columns))
