"""Documents dealt into batches that ask for counts: numbers move once for each batch, not for each token."""

from __future__ import annotations

import ctypes
import zlib
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text in a batch, about: what one task holds.
BATCH_BYTES = 12_000_000
#: Whole texts that go to Python at a time. The JVM's Arrow buffers keep the size of the largest batch they held.
TEXTS = 1_000


def give_back() -> None:
    """Frees what the allocators of this Python worker keep for later; an idle worker else holds on to its peak."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def frugal(fn: Callable) -> Callable:
    """A function of a group, or of a key and two groups, that gives its memory back when it is done."""
    def of_group(pdf):
        try:
            return fn(pdf)
        finally:
            give_back()

    def of_groups(key, left, right):
        try:
            return fn(key, left, right)
        finally:
            give_back()
    return of_group if fn.__code__.co_argcount == 1 else of_groups


@contextmanager
def arrow_rows(spark: SparkSession, n: int):
    """Rows that a job started inside sends to Python at a time: long texts and packed rows would else make large batches."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(n))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def text_bytes(docs: DataFrame) -> int:
    return docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0


def dealt(docs: DataFrame, part: Column, number: Column) -> DataFrame:
    """(batch, part, doc_id, packed) of docs(doc_id, text): batch is the part's bits above the number, packed the compressed text.

    The id is text from here on.
    """
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text", part.alias("part"), (part * (1 << 40) + number).alias("batch"))

    def squeeze(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        press = zstandard.ZstdCompressor(level=3)
        for pdf in batches:
            yield pd.DataFrame({"batch": pdf["batch"], "part": pdf["part"], "doc_id": pdf["doc_id"],
                                "packed": [press.compress((t or "").encode("utf-8", "surrogatepass")) for t in pdf["text"]]})
    return rows.select("batch", "part", "doc_id", "text").mapInPandas(squeeze, "batch long, part int, doc_id string, packed binary")


def unpacked(pdf: pd.DataFrame) -> list[bytes]:
    return [zstandard.decompress(b) for b in pdf["packed"]]


def pack_sorted(x: np.ndarray) -> bytes:
    """Ascending 64-bit numbers as differences, in as many bytes as the largest needs."""
    step = np.diff(x, prepend=np.uint64(0)).astype("<u8")
    step[:1] = 0
    width = max(1, (int(step.max(initial=0)).bit_length() + 7) // 8)
    first = int(x[0]) if len(x) else 0
    return first.to_bytes(8, "little") + bytes([width]) + step.view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpack_sorted(data: bytes) -> np.ndarray:
    width, body = data[8], np.frombuffer(data, dtype=np.uint8, offset=9)
    step = np.zeros((len(body) // width, 8), dtype=np.uint8)
    step[:, :width] = body.reshape(-1, width)
    return np.cumsum(step.view("<u8").ravel(), dtype=np.uint64) + np.uint64(int.from_bytes(data[:8], "little"))


def press(x: np.ndarray) -> bytes:
    return zlib.compress(x.tobytes(), 1)


def unpress(data: bytes, dtype: str) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data), dtype=dtype)


def press_counts(x: np.ndarray) -> bytes:
    """Counts in four bytes each, or in eight where one needs them."""
    width = 4 if int(x.max(initial=0)) < 1 << 32 else 8
    return bytes([width]) + press(x.astype(f"<u{width}"))


def unpress_counts(data: bytes) -> np.ndarray:
    return unpress(data[1:], f"<u{data[0]}")


def by_bucket(u: np.ndarray, bits: int) -> list[tuple[int, int, int]]:
    """(bucket, from, to) of ascending hashes, by their top bits."""
    cuts = np.searchsorted(u >> np.uint64(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64))
    return [(int(b), int(cuts[b]), int(cuts[b + 1])) for b in np.flatnonzero(np.diff(cuts))]
