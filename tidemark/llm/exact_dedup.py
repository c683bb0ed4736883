"""Exact dedup by a content sort (operator 10)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.text import BLANKS, as_before, as_text, partitions, whole
from tidemark.session import cut_lineage

#: Characters of the text in the keys from which the splitters are sampled: the sample that the driver sees has short rows.
PREFIX = 32


def normalised(text: Column) -> Column:
    """Each run of ASCII blanks becomes one space; null is empty."""
    return F.regexp_replace(whole(text), BLANKS, " ")


def _runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Numbers the runs of equal neighbours in a sorted partition; the first and the last run carry their text."""
    base, run, last, held = TaskContext.get().partitionId() << 33, -1, None, None

    def out(pdf, runs, heads, edges):
        return pd.DataFrame({"doc_id": pdf["doc_id"], "text_sha256": pdf["text_sha256"], "run": base + runs, "head": heads,
                             "edge_text": edges})

    for pdf in batches:
        if not len(pdf):
            continue
        text = pdf["norm"].to_numpy(dtype=object)
        head = np.ones(len(text), dtype=bool)
        head[0] = last is None or text[0] != last
        head[1:] = text[1:] != text[:-1]
        runs = run + np.cumsum(head)
        edges = np.full(len(text), None, dtype=object)
        if held is None:
            edges[0] = text[0]
        else:
            yield held
        held = out(pdf, runs, head, edges)
        run, last = runs[-1], text[-1]
    if held is not None:
        held.loc[held.index[-1], "edge_text"] = last
        yield held


def exact_dedup(docs: DataFrame) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), one row for each row of docs(doc_id, text, ...).

    Rows are range-partitioned by sampled splitters over (start of the text, its hash, doc_id), so a group of copies, however
    large, spreads over partitions; each partition is sorted outside memory, which places equal texts side by side, and
    neighbours are compared in full. Only the first and last run of a partition can go on in another one: these meet by
    their full texts, two for each partition at most.

    Null texts are empty texts. Of equal texts the smallest doc_id stays, a null doc_id only if no other is there; of rows
    that repeat text and doc_id one stays. Other columns are not read.
    """
    norm = F.col("norm")
    rows = (docs.select("doc_id", normalised(F.col("text")).alias("norm"))
            .withColumns({"start": F.substring(norm, 1, PREFIX), "h": F.xxhash64(norm)}))
    order = ["start", "h", F.col("doc_id").asc_nulls_last()]
    ranged = rows.repartitionByRange(partitions(docs), *order)
    laid = ranged.sortWithinPartitions("start", "h", "norm", F.col("doc_id").asc_nulls_last())
    found = as_text(laid.select("doc_id", "norm", F.sha2(norm, 256).alias("text_sha256"))).mapInPandas(
        _runs, "doc_id string, text_sha256 string, run long, head boolean, edge_text string")
    found = cut_lineage(as_before(found, docs))

    runs = found.groupBy("run").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"), F.max("edge_text").alias("edge_text"))
    edge = runs.where("edge_text is not null")
    joined = edge.groupBy("edge_text").agg(F.min("keep_id").alias("_keep"), F.sum("group_size").alias("_size"))
    widened = edge.join(joined, "edge_text").select("run", "_keep", "_size")
    runs = (runs.select("run", "keep_id", "group_size").withColumnRenamed("keep_id", "run_keep").join(widened, "run", "left")
            .withColumn("keep_id", F.coalesce("_keep", "run_keep")).withColumn("group_size", F.coalesce("_size", "group_size")))
    kept = F.col("head") & F.col("run_keep").eqNullSafe(F.col("keep_id"))
    return (found.select("doc_id", "text_sha256", "run", "head").join(runs, "run")
            .select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256"))
