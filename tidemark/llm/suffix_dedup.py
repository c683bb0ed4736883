"""Repeated byte strings by sorted suffixes (operator 12)."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.batches import arrow_rows, by_bucket, frugal, give_back, pack_sorted, press, text_bytes, unpack_sorted, unpress
from tidemark.llm.suffix_sort import sorted_suffixes
from tidemark.llm.text import as_before
from tidemark.session import cut_lineage, shared_folder

#: Bytes of a string that counts; bytes of an anchor.
WINDOW, ANCHOR = 100, 32
#: An anchor in more places than this is split by window; anchors of a count bucket and bytes of a shard, about.
HOT, BUCKET_ANCHORS, SHARD_BYTES = 1000, 1 << 20, 16_000_000
#: Bytes of text in a bundle, about; bytes hashed at a time, a power of two.
BUNDLE_BYTES, SLICE = 12_000_000, 1 << 19
#: Odd multipliers.
MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F)]


def _hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the ANCHOR bytes from each place."""
    n = len(data) - 7
    words = np.empty(n, dtype=np.uint64)
    for k in range(8):
        own = words[k::8]
        own[:] = data[k:k + 8 * len(own)].view("<u8")
    m = n - ANCHOR + 8
    h = words[:m] * MIX[0]
    for j in range(1, ANCHOR // 8):
        h += words[8 * j:8 * j + m] * MIX[j]
    h ^= h >> np.uint64(32)
    h *= MIX[4]
    return h


def _remixed(h: np.ndarray) -> np.ndarray:
    """Least hashes are small; mixed once more they spread over buckets and shards."""
    h = (h ^ (h >> np.uint64(29))) * MIX[1]
    h = (h ^ (h >> np.uint64(31))) * MIX[2]
    return h ^ (h >> np.uint64(32))


def anchors(data: bytes, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, place, start, windows): runs of windows inside one of the documents that share the place of their anchor.

    A window's anchor is the least hash of ANCHOR bytes in it, the first one of equals. Equal windows have equal anchors at
    equal distances, in two places, so an anchor that stands in one place only has no windows that recur. Runs also end
    after SLICE bytes.
    """
    raw, out = np.frombuffer(data, dtype=np.uint8), []
    ends = np.cumsum(sizes)
    mask, span = np.uint64(2 * SLICE - 1), WINDOW - ANCHOR + 1
    for lo in range(0, len(raw) - WINDOW + 1, SLICE):
        part = raw[lo:lo + SLICE + WINDOW - 1]
        h = _hashes(part)
        least, have = (h & ~mask) | np.arange(len(h), dtype=np.uint64), 1
        while have < span:
            step = min(have, span - have)
            least = np.minimum(least[:-step], least[step:])
            have += step
        cut = np.zeros(len(least) + 1, dtype=np.int32)
        near = ends[(ends > lo) & (ends - WINDOW + 1 < lo + len(least))] - lo
        np.add.at(cut, np.maximum(near - WINDOW + 1, 0), 1)
        np.add.at(cut, np.minimum(near, len(least)), -1)
        at = np.flatnonzero(np.cumsum(cut)[:-1] == 0)
        if not len(at):
            continue
        place = (least[at] & mask).astype(np.int64)
        new = np.ones(len(at), dtype=bool)
        new[1:] = (place[1:] != place[:-1]) | (at[1:] != at[:-1] + 1)
        heads = np.flatnonzero(new)
        out.append((_remixed(h[place[heads]]), place[heads] + lo, at[heads] + lo, np.diff(np.append(heads, len(at)))))
    if not out:
        return np.zeros(0, dtype=np.uint64), *(np.zeros(0, dtype=np.int64) for _ in range(3))
    return tuple(np.concatenate(x) for x in zip(*out))


def bundles(docs: DataFrame) -> DataFrame:
    """(batch, ids, known, sizes, packed): the documents of each task in bundles, one row each, in the shared folder.

    They are packed once; whatever reads them later, also after the loss of an executor, finds the same bundles.
    """
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"), F.col("doc_id").isNotNull().alias("known"), "text")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task, number, press_text = TaskContext.get().partitionId(), 0, zstandard.ZstdCompressor(level=3)
        ids, known, texts, held = [], [], [], 0

        def row() -> pd.DataFrame:
            order = sorted(range(len(ids)), key=lambda i: (ids[i], texts[i]))
            return pd.DataFrame({"batch": [(task << 32) + number], "ids": [np.array([ids[i] for i in order], dtype="<i8").tobytes()],
                                 "known": [bytes(known[i] for i in order)],
                                 "sizes": [np.array([len(texts[i]) for i in order], dtype="<i8").tobytes()],
                                 "packed": [press_text.compress(b"".join(texts[i] for i in order))]})
        for pdf in batches:
            for i, k, t in zip(pdf["id"].tolist(), pdf["known"].tolist(), pdf["text"]):
                ids.append(i)
                known.append(k)
                texts.append((t or "").encode("utf-8", "surrogatepass"))
                held += len(texts[-1])
                if held >= BUNDLE_BYTES:
                    yield row()
                    number, held = number + 1, 0
                    ids, known, texts = [], [], []
                    give_back()
        if ids:
            yield row()

    at = f"{shared_folder(spark)}/suffix-dedup-{uuid.uuid4().hex}"
    with arrow_rows(spark, 500):
        rows.mapInPandas(run, "batch long, ids binary, known binary, sizes binary, packed binary").write.parquet(at)
    return spark.read.parquet(at)


class Bundle:
    """The documents of a bundle, by id. Those without an id take no part: their bytes lie apart, after the others."""

    def __init__(self, row):
        ids, known = np.frombuffer(row.ids, dtype="<i8"), np.frombuffer(row.known, dtype=np.uint8).astype(bool)
        sizes, data = np.frombuffer(row.sizes, dtype="<i8"), zstandard.decompress(row.packed)
        self.ids, self.sizes = ids[known], sizes[known]
        ends = np.cumsum(sizes)
        whole = [data[e - n:e] for e, n in zip(ends.tolist(), sizes.tolist())]
        self.apart = [t for t, k in zip(whole, known) if not k]
        self.data = b"".join(t for t, k in zip(whole, known) if k) if self.apart else data
        self.begins = np.cumsum(self.sizes) - self.sizes


def _flags(answers: pd.DataFrame) -> np.ndarray:
    own = answers.sort_values("bucket")
    return np.concatenate([unpress(b, "u1") for b in own["flags"]]) if len(own) else np.zeros(0, dtype=np.uint8)


class Segments:
    """Runs of windows of a bundle that may recur, and their distinct texts, by shard and text.

    A run under an anchor in more than HOT places gives one segment for each window, whose shard follows from its text.
    """

    def __init__(self, bundle: Bundle, answers: pd.DataFrame, shards: int):
        anchor, place, start, n = anchors(bundle.data, bundle.sizes)
        u, of = np.unique(anchor, return_inverse=True)
        flag = _flags(answers)[of] if len(u) else np.zeros(0, dtype=np.uint8)
        times = np.where(flag == 2, n, 1)[flag > 0]
        at = np.repeat(np.flatnonzero(flag > 0), times)
        shift = np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times)
        self.start, self.n = start[at] + shift, np.where(flag[at] == 2, 1, n[at])
        doc = np.searchsorted(np.cumsum(bundle.sizes), self.start, side="right")
        self.doc, self.start_in = bundle.ids[doc], self.start - bundle.begins[doc]
        data, first, number = bundle.data, {}, []
        # Runs come by document and start, so the first one of equal texts is the least.
        for k, (a, m) in enumerate(zip(self.start.tolist(), self.n.tolist())):
            number.append(first.setdefault(data[a:a + m + WINDOW - 1], k))
        texts, least = list(first), np.array(list(first.values()), dtype=np.int64)
        shard = (anchor[at[least]] % np.uint64(shards)).astype(np.int64)
        for k in np.flatnonzero(flag[at[least]] == 2).tolist():
            shard[k] = xxhash.xxh64_intdigest(texts[k]) % shards
        order = np.array(sorted(range(len(texts)), key=lambda k: (shard[k], texts[k])), dtype=np.int64)
        rank = np.zeros(len(self.start), dtype=np.int64)
        rank[least[order]] = np.arange(len(order))
        #: Number of each run's text, in order; of each text: itself, its shard, anchor, the anchor's place in it, first owner.
        self.number = rank[np.array(number, dtype=np.int64)]
        self.texts, self.shard, least = [texts[k] for k in order.tolist()], shard[order], least[order]
        self.anchor = (anchor[at[least]] >> np.uint64(32)).astype("<u4")
        self.offset = (place[at[least]] - self.start[least]).astype(np.uint8)
        self.owner = self.doc[least], self.start_in[least]


def first_owners(texts: list[bytes], anchor: np.ndarray, offset: np.ndarray, doc: np.ndarray, start: np.ndarray):
    """(windows, doc, start): of each window of each text the least (doc, start) at which it stands in any of the texts.

    Texts are distinct; doc and start say where each stands first. Windows can only be equal under one anchor at one distance, so
    suffixes are sorted within those buckets; a text that is alone under its anchor needs no sorting.
    """
    size = np.array([len(t) for t in texts], dtype=np.int64)
    n, begin = size - WINDOW + 1, np.cumsum(size) - size
    text = np.repeat(np.arange(len(texts)), n)
    j = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
    least_doc, least_start = doc[text], start[text] + j
    _, kind, rows = np.unique(anchor, return_inverse=True, return_counts=True)
    among = np.flatnonzero(rows[kind][text] > 1)
    if len(among):
        at, back = begin[text[among]] + j[among], offset.astype(np.int64)[text[among]] - j[among]
        order, head = sorted_suffixes(b"".join(texts), at, kind[text[among]] * 128 + back, WINDOW)
        sorted_doc, sorted_start = least_doc[among][order], least_start[among][order]
        first, run = np.flatnonzero(head), np.cumsum(head) - 1
        low = np.minimum.reduceat(sorted_doc, first)
        early = np.minimum.reduceat(np.where(sorted_doc == low[run], sorted_start, np.iinfo(np.int64).max), first)
        least_doc[among[order]], least_start[among[order]] = low[run], early[run]
    return n, least_doc, least_start


def repeated_strings(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, removed[, kept]), one row for each row of docs(doc_id, text).

    A byte goes if a string of WINDOW bytes covers it that also starts earlier: in a document with a smaller doc_id, or earlier
    in the same one. ``removed`` lists the runs of such bytes (start, n).

    Strings are dealt to shards by their anchor, so each meets all its equals. Bundles of documents first ask in how many
    places each of their anchors stands. Those under an anchor of one place cannot recur; the others go to the shards as
    segments, runs of windows with one anchor, each distinct one once a bundle. Anchors in more than HOT places are dealt
    window by window. A shard sorts the suffixes of its distinct segments (multikey quicksort, then blind tries) up to
    WINDOW bytes and tells each bundle the least document and start of each of its windows, by which it removes bytes.

    Null and empty texts have no bytes. A null doc_id is neither a source nor loses bytes. Rows that share a doc_id count as one
    document: the smaller start is the earlier. Texts of any length are read whole; further columns are not looked at.
    """
    total = text_bytes(docs.select("text"))
    packed = bundles(docs)
    bits = max(1, (total // 32 // BUCKET_ANCHORS).bit_length())

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples():
                own = Bundle(row)
                u, n = np.unique(anchors(own.data, own.sizes)[0], return_counts=True)
                yield pd.DataFrame([(row.batch, b, pack_sorted(u[lo:hi]), press(n[lo:hi].astype("<u4"))) for b, lo, hi in by_bucket(u, bits)],
                                   columns=["batch", "bucket", "hashes", "n"])
                give_back()

    @frugal
    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        asked = [unpack_sorted(b) for b in pdf["hashes"]]
        u, place = np.unique(np.concatenate(asked), return_inverse=True)
        n = np.concatenate([unpress(b, "<u4") for b in pdf["n"]]).astype(np.int64)
        held = np.bincount(place, weights=n, minlength=len(u))
        flag = ((held > 1).astype(np.uint8) + (held > HOT))[place]
        carried = n * np.array([0, 2 * WINDOW, WINDOW * WINDOW // 2])[flag]
        cuts = np.cumsum([0] + [len(a) for a in asked])
        return pd.DataFrame({"batch": pdf["batch"], "bucket": pdf["bucket"],
                             "flags": [press(flag[a:b]) for a, b in zip(cuts, cuts[1:])],
                             "carried": [int(carried[a:b].sum()) for a, b in zip(cuts, cuts[1:])]})

    with arrow_rows(docs.sparkSession, 1):
        answers = cut_lineage(packed.mapInPandas(ask, "batch long, bucket long, hashes binary, n binary")
                              .groupBy("bucket").applyInPandas(count, "batch long, bucket long, flags binary, carried long"))
    shards = 1 + (answers.agg(F.sum("carried").alias("n")).first()["n"] or 0) // SHARD_BYTES

    @frugal
    def cut(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        own = Segments(Bundle(left.iloc[0]), right, shards)
        pack, rows = zstandard.ZstdCompressor(level=3).compress, []
        heads = np.flatnonzero(np.diff(own.shard, prepend=-1))
        for lo, hi in zip(heads.tolist(), np.append(heads[1:], len(own.shard)).tolist()):
            size = np.array([len(t) for t in own.texts[lo:hi]], dtype=np.uint8)
            rows.append((key[0], int(own.shard[lo]), pack(b"".join(own.texts[lo:hi])), press(size), press(own.anchor[lo:hi]),
                         press(own.offset[lo:hi]), press(own.owner[0][lo:hi]), press(own.owner[1][lo:hi])))
        return pd.DataFrame(rows, columns=["batch", "shard", "texts", "size", "anchor", "offset", "doc", "start"])

    @frugal
    def sort(pdf: pd.DataFrame) -> pd.DataFrame:
        merged, number, cuts = {}, [], [0]
        for texts, size in zip(pdf["texts"], pdf["size"]):
            data, at = zstandard.decompress(texts), 0
            for n in unpress(size, "u1").tolist():
                number.append(merged.setdefault(data[at:at + n], len(merged)))
                at += n
            cuts.append(len(number))
        number = np.array(number, dtype=np.int64)
        read = lambda c, kind: np.concatenate([unpress(b, kind) for b in pdf[c]])
        doc, start = read("doc", "<i8"), read("start", "<i8")
        order = np.lexsort((start, doc, number))
        first = order[np.flatnonzero(np.diff(number[order], prepend=-1))]
        n, least_doc, least_start = first_owners(list(merged), read("anchor", "<u4")[first], read("offset", "u1")[first], doc[first], start[first])
        # Windows of a text whose first owners follow each other are told as one run.
        text = np.repeat(np.arange(len(n)), n)
        new = np.ones(len(text), dtype=bool)
        new[1:] = (text[1:] != text[:-1]) | (least_doc[1:] != least_doc[:-1]) | (least_start[1:] != least_start[:-1] + 1)
        head = np.flatnonzero(new)
        runs = np.bincount(text[head], minlength=len(n))
        base, begin = np.cumsum(runs) - runs, np.cumsum(n) - n
        out = []
        for lo, hi in zip(cuts, cuts[1:]):
            mine = number[lo:hi]
            k = runs[mine]
            at = head[np.repeat(base[mine] - (np.cumsum(k) - k), k) + np.arange(k.sum())]
            out.append((press(k.astype(np.uint8)), press((at - np.repeat(begin[mine], k)).astype(np.uint8)), press(least_doc[at]), press(least_start[at])))
        return pd.DataFrame({"batch": pdf["batch"], "shard": pdf["shard"]} | {c: [o[i] for o in out] for i, c in enumerate(["runs", "skip", "doc", "start"])})

    found = (packed.groupBy("batch").cogroup(answers.groupBy("batch"))
             .applyInPandas(cut, "batch long, shard long, texts binary, size binary, anchor binary, offset binary, doc binary, start binary")
             .groupBy("shard").applyInPandas(sort, "batch long, shard long, runs binary, skip binary, doc binary, start binary"))
    none = [F.lit(None).cast("binary").alias(c) for c in ("runs", "skip", "doc", "start")]
    replies = answers.select("batch", "bucket", "flags", *none).unionByName(
        found.select("batch", F.col("shard").alias("bucket"), F.lit(None).cast("binary").alias("flags"), "runs", "skip", "doc", "start"))

    @frugal
    def remove(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        asked = right["flags"].notna()
        bundle = Bundle(left.iloc[0])
        own, told = Segments(bundle, right[asked], shards), right[~asked].sort_values("bucket")
        gone = np.zeros(len(bundle.data) + 1, dtype=np.int32)
        if len(told):
            read = lambda c, kind: np.concatenate([unpress(b, kind) for b in told[c]])
            runs, skip, doc, start = read("runs", "u1").astype(np.int64), read("skip", "u1").astype(np.int64), read("doc", "<i8"), read("start", "<i8")
            base = np.cumsum(runs) - runs
            k = runs[own.number]
            row = np.repeat(np.arange(len(k)), k)
            at = np.repeat(base[own.number] - (np.cumsum(k) - k), k) + np.arange(k.sum())
            # A run of windows reaches to the next one of its segment.
            last = np.ones(len(row), dtype=bool)
            last[:-1] = row[1:] != row[:-1]
            until = np.where(last, own.n[row], skip[np.minimum(at + 1, len(skip) - 1)])
            earlier = (doc[at] < own.doc[row]) | ((doc[at] == own.doc[row]) & (start[at] < own.start_in[row] + skip[at]))
            np.add.at(gone, (own.start[row] + skip[at])[earlier], 1)
            np.add.at(gone, (own.start[row] + until + WINDOW - 1)[earlier], -1)
        gone = np.cumsum(gone)[:-1] > 0
        rows = []
        for d, lo, n in zip(bundle.ids.tolist(), bundle.begins.tolist(), bundle.sizes.tolist()):
            edge = np.flatnonzero(np.diff(gone[lo:lo + n], prepend=False, append=False)).reshape(-1, 2)
            stay = np.concatenate([[0], edge.ravel(), [n]]).reshape(-1, 2)
            kept = b"".join(bundle.data[lo + a:lo + b] for a, b in stay.tolist())
            rows.append((str(d), n, n - len(kept), len(edge), kept, [{"start": a, "n": b - a} for a, b in edge.tolist()]))
        rows += [(None, len(t), 0, 0, t, []) for t in bundle.apart]
        return pd.DataFrame([(d, n, lost, spans, hashlib.sha256(kept).hexdigest(), runs, *[kept] * with_text) for d, n, lost, spans, kept, runs in rows],
                            columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed"] + ["kept"] * with_text)

    schema = ("doc_id string, n_bytes long, n_removed long, n_spans long, kept_sha256 string, removed array<struct<start:long,n:long>>"
              + ", kept binary" * with_text)
    return as_before(packed.groupBy("batch").cogroup(replies.groupBy("batch")).applyInPandas(remove, schema), docs)
