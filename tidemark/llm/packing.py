"""Packing token pieces into windows by best-fit decreasing (operator 7)."""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.batches import give_back
from tidemark.llm.text import as_before, as_text
from tidemark.session import cut_lineage

LENGTH, END_ID = 1024, 0
#: The vocabulary of byte_bpe_50k.json as ranks: same ids, several times faster to apply.
RANKS, SPECIAL = "byte_bpe_50k.tiktoken", {"<|endoftext|>": 50256}
#: Pieces in a shard; ordinals are counted within shards.
SHARD_ROWS = 1 << 13


@lru_cache(maxsize=2)
def encoder(path: str) -> tiktoken.Encoding:
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=SPECIAL)


def pieces(docs: DataFrame, path: str | None = None, length: int = LENGTH, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens[, ids]): each document's ids and END_ID, cut into windows of ``length``.

    All pieces of a document but the last are full windows. A null text is empty, so its only id is END_ID. Texts of any
    length are read whole; a null or repeated doc_id is kept as it is, and further columns are not looked at.
    """
    path = path or public_tokenizers.path(RANKS)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(path)
        for pdf in batches:
            out: dict[str, list] = {k: [] for k in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids")}
            for doc, text in zip(pdf["doc_id"], pdf["text"]):
                ids = np.array(enc.encode(text or "", allowed_special="all") + [END_ID], dtype="<u4")
                for at in range(0, len(ids), length):
                    part = ids[at:at + length]
                    for k, v in zip(out, (doc, at, len(part), zlib.crc32(part.tobytes()), len(ids), part.astype("<i4"))):
                        out[k].append(v)
            if not with_ids:
                del out["ids"]
            yield pd.DataFrame(out)
            give_back()

    schema = "doc_id string, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * with_ids
    return as_before(as_text(docs.select("doc_id", "text")).mapInPandas(run, schema), docs)


class OpenWindows:
    """Open windows by remaining capacity, with a segment tree over the capacities that have any.

    Windows with the same room are interchangeable, so they are kept as ranges of ids (first, count). The state is bounded
    by the window length and the number of distinct sizes, however many windows there are.
    """

    def __init__(self, length: int):
        self.leaves = 1 << length.bit_length()
        self.held = [False] * (2 * self.leaves)
        self.ranges: list[list[tuple[int, int]]] = [[] for _ in range(length + 1)]

    def _mark(self, room: int) -> None:
        node = room + self.leaves
        self.held[node] = bool(self.ranges[room])
        while node > 1:
            node //= 2
            self.held[node] = self.held[2 * node] or self.held[2 * node + 1]

    def put(self, room: int, first: int, count: int) -> None:
        if room and count:
            self.ranges[room].append((first, count))
            self._mark(room)

    def tightest(self, size: int) -> int | None:
        """Least room of at least ``size`` that some window has."""
        node = size + self.leaves
        while not self.held[node]:
            while node & 1:  # a right child: nothing further right below this parent
                node //= 2
            if not node:
                return None
            node += 1
        while node < self.leaves:
            node = 2 * node if self.held[2 * node] else 2 * node + 1
        return node - self.leaves

    def take(self, room: int, most: int) -> tuple[int, int]:
        first, count = self.ranges[room].pop()
        if count > most:
            self.ranges[room].append((first + most, count - most))
        self._mark(room)
        return first, min(count, most)


def best_fit_decreasing(counts: dict[int, int], length: int = LENGTH) -> list[tuple[int, int, int, int, int, int]]:
    """counts: pieces by size. Rows (size, first ordinal, pieces, first window, offset, pieces a window).

    Sizes go from large to small; each piece goes to the open window with the least room that holds it, else to a new one.
    Pieces of one size are placed in ranges, which gives the windows that placing them one by one gives.
    """
    windows, rows, opened = OpenWindows(length), [], 0
    for size in sorted(counts, reverse=True):
        at, n = 0, counts[size]
        while n:
            room = windows.tightest(size)
            # No window has less room that would do, so one that got a piece is the tightest for the next, while it holds one.
            per = (room or length) // size
            wanted = -(-n // per)
            if room is None:
                room, first, count, opened = length, opened, wanted, opened + wanted
            else:
                first, count = windows.take(room, wanted)
            placed = min(n, count * per)
            rows.append((size, at, placed, first, length - room, per))
            full, rest = divmod(placed, per)
            windows.put(room - per * size, first, full)
            windows.put(room - rest * size, first + full, int(rest > 0))
            at, n = at + placed, n - placed
    return rows


def pack(cut: DataFrame, length: int = LENGTH) -> DataFrame:
    """cut, the output of pieces(), plus (sequence_id, offset).

    Best-fit decreasing needs only how many pieces there are of each size: at most ``length`` counts leave Spark, and at most
    some thousands of placement ranges come back, whatever the size of the corpus. A piece finds its range by size and
    ordinal. Ordinals are counted in shards of about SHARD_ROWS pieces, so a size that a third of all pieces share is
    numbered by many tasks. Repeated rows are separate pieces; an empty table gives no rows.
    """
    cut = cut_lineage(cut)
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    shards = 1 + sum(counts.values()) // SHARD_ROWS
    rows = cut.withColumn("_shard", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", "doc_tokens"), F.lit(shards)))
    per = rows.groupBy("length", "_shard").agg(F.count("*").alias("_n"))
    over = Window.partitionBy("length").orderBy("_shard").rowsBetween(Window.unboundedPreceding, -1)
    base = per.select("length", "_shard", F.coalesce(F.sum("_n").over(over), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("length", "_shard").orderBy("doc_id", "start", "ids_crc32", "doc_tokens")
    numbered = rows.withColumn("_at", F.row_number().over(inside)).join(base, ["length", "_shard"])
    placed = cut.sparkSession.createDataFrame(best_fit_decreasing(counts, length),
                                              "length long, _lo long, _count long, _window long, _offset long, _per long")
    at = F.col("_base") + F.col("_at") - 1
    k = at - F.col("_lo")
    # Bounded by the window length, not by the corpus: a few thousand rows.
    out = numbered.join(F.broadcast(placed), (numbered["length"] == placed["length"]) & (k >= 0) & (k < F.col("_count")))
    step = (k - F.pmod(k, F.col("_per"))) / F.col("_per")
    return out.select(*(numbered[c] for c in cut.columns), (F.col("_window") + step.cast("bigint")).alias("sequence_id"),
                      (F.col("_offset") + F.pmod(k, F.col("_per")) * numbered["length"]).alias("offset"))


def sequences(packed: DataFrame, length: int = LENGTH, pad_id: int = END_ID) -> DataFrame:
    """(sequence_id, ids, used): windows of pieces(with_ids=True), padded to ``length`` unless they fill a power of two."""
    ordered = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    ids = F.flatten(F.transform(ordered, lambda p: p["ids"]))
    rows = packed.groupBy("sequence_id").agg(ids.alias("ids"), F.sum("length").alias("used"))
    padding = F.when(F.bit_count("used") == 1, F.lit(0)).otherwise(F.lit(length) - F.col("used")).cast("int")
    return rows.withColumn("ids", F.concat("ids", F.array_repeat(F.lit(pad_id), padding)))
