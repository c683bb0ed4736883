"""Repeated passages by FM-indexes (operator 1)."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.batches import by_bucket, dealt, pack_sorted, press, text_bytes, unpack_sorted, unpacked, unpress
from tidemark.llm.fm_index import FMIndex
from tidemark.llm.text import as_before
from tidemark.session import cut_lineage

#: Words of a passage; words of an anchor; most windows in a segment.
WINDOW, ANCHOR, SEGMENT = 13, 3, 64
#: An anchor in more documents than this is split by window; anchors of a count bucket and words of an index, about.
HOT, BUCKET_ANCHORS, SHARD_WORDS = 1000, 1 << 20, 500_000
#: Bytes of text in a batch, about, and bytes that are hashed at a time.
BATCH_BYTES, HASH_BYTES = 6_000_000, 1 << 19
ODD = np.uint64(0x9E3779B97F4A7C15)


class Words:
    """The words of some texts, joined by single spaces in one buffer."""

    def __init__(self, texts: list[bytes]):
        lines = [b" ".join(t.split()) for t in texts]
        self.n = np.array([t.count(b" ") + (len(t) > 0) for t in lines], dtype=np.int64)
        self.data = b" ".join(t for t in lines if t)
        self.bytes = np.frombuffer(self.data, dtype=np.uint8)
        gaps = np.flatnonzero(self.bytes == 32)
        some = [0] if len(self.bytes) else []
        self.begin = np.concatenate([some, gaps + 1]).astype(np.int64)
        self.end = np.concatenate([gaps, [len(self.bytes)] if some else []]).astype(np.int64)
        self.doc = np.repeat(np.arange(len(texts)), self.n)
        self.first = np.cumsum(self.n) - self.n

    def slice(self, start: int, words: int) -> bytes:
        return self.data[self.begin[start]:self.end[start + words - 1]]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(words: Words) -> np.ndarray:
    """Rolling sums of byte * odd**place modulo 2**64, divided by the power of the word's begin; some words at a time."""
    back, n, out = np.uint64(pow(int(ODD), -1, 1 << 64)), len(words.begin), np.zeros(len(words.begin), dtype=np.uint64)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(words.end, words.begin[i] + HASH_BYTES, side="right")))
        lo, hi = words.begin[i], words.end[j - 1]
        power = np.full(hi - lo + 1, ODD)
        power[0] = 1
        np.cumprod(power, out=power)
        sums = np.zeros(hi - lo + 1, dtype=np.uint64)
        np.cumsum((words.bytes[lo:hi] + np.uint64(1)) * power[:-1], out=sums[1:])
        power[1:] = back
        np.cumprod(power, out=power)
        begin, end = words.begin[i:j] - lo, words.end[i:j] - lo
        out[i:j] = _mixed((sums[end] - sums[begin]) * power[begin])
        i = j
    return out


def anchors(words: Words, own: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, document, first window, windows): runs of windows with one anchor, the least hash of ANCHOR words in a window.

    ``own`` are the hashes of the words. Equal windows have equal anchors. A run spans at most SEGMENT windows.
    """
    n = len(words.begin)
    none = np.zeros(0, dtype=np.int64)
    if n < window:
        return none.astype(np.uint64), none, none, none
    h = own[:n - ANCHOR + 1].copy()
    for k in range(1, ANCHOR):
        h = h * ODD + own[k:n - ANCHOR + 1 + k]
    h = _mixed(h)
    least, have, most = h, 1, window - ANCHOR + 1
    while have < most:
        step = min(have, most - have)
        least = np.minimum(least[:-step], least[step:])
        have += step
    doc = words.doc[:len(least)]
    inside = words.doc[window - 1:] == doc
    at = np.flatnonzero(inside)
    if not len(at):
        return none.astype(np.uint64), none, none, none
    anchor, doc = least[at], doc[at]
    new = np.ones(len(at), dtype=bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])
    heads = np.flatnonzero(new)
    since = np.arange(len(at)) - np.repeat(heads, np.diff(np.append(heads, len(at))))
    heads = np.flatnonzero(since % SEGMENT == 0)
    # Least hashes are small; mixed once more they spread over the buckets.
    return _mixed(anchor[heads] * ODD), doc[heads], at[heads], np.diff(np.append(heads, len(at)))


def _ordered(pdf: pd.DataFrame) -> pd.DataFrame:
    return pdf.sort_values(["doc_id", "packed"], ignore_index=True)


def _flags(answers: pd.DataFrame) -> np.ndarray:
    own = answers.sort_values("bucket")
    return np.concatenate([unpress(b, "u1") for b in own["flags"]]) if len(own) else np.zeros(0, dtype=np.uint8)


def _segments(words: Words, answers: pd.DataFrame, shards: int):
    """Segments of a batch that may recur: (document, first window, windows, number), and of each number (shard, occurrence).

    Hot anchors give one segment for each window. Numbers follow (shard, hash of the segment), so they depend only on the
    batch's texts; within a batch segments are known by 64-bit hashes.
    """
    own = word_hashes(words)
    anchor, doc, start, n = anchors(words, own)
    u, place = np.unique(anchor, return_inverse=True)
    flag = _flags(answers)[place] if len(u) else np.zeros(0, dtype=np.uint8)
    hot = flag == 2
    times = np.where(hot, n, 1)[flag > 0]
    at = np.repeat(np.flatnonzero(flag > 0), times)
    shift = np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times)
    start, n = start[at] + np.where(hot[at], shift, 0), np.where(hot[at], 1, n[at])
    # Hash of a segment from those of its words, by rolling sums.
    power = np.full(len(own) + 1, ODD)
    power[:1] = 1
    np.cumprod(power, out=power)
    sums = np.zeros(len(own) + 1, dtype=np.uint64)
    np.cumsum(own * power[:-1], out=sums[1:])
    power[1:] = np.uint64(pow(int(ODD), -1, 1 << 64))
    np.cumprod(power, out=power)
    text = _mixed((sums[start + n + WINDOW - 1] - sums[start]) * power[start] + n.astype(np.uint64))
    shard = (np.where(hot[at], text, anchor[at]) % np.uint64(shards)).astype(np.int64)
    order = np.lexsort((text, shard))
    new = np.ones(len(order), dtype=bool)
    new[1:] = (text[order][1:] != text[order][:-1]) | (shard[order][1:] != shard[order][:-1])
    number = np.zeros(len(order), dtype=np.int64)
    number[order] = np.cumsum(new) - 1
    first = order[new]
    return doc[at], start, n, number, shard[first], first


def repeated_passages(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, removed[, kept_text]), one row for each row of docs(doc_id, text).

    A word goes if a window of WINDOW words covers it whose words also begin in a document with a smaller doc_id. ``removed``
    lists the runs of such words (start, n).

    Windows are dealt to shards by their anchor, so each meets all its equals in one index. Batches of documents first ask in
    how many documents each of their anchors occurs; windows whose anchor occurs in one document only cannot recur. The rest
    go to the shards as segments, runs of windows with one anchor, each distinct one once a batch. Anchors in more than HOT
    documents are dealt window by window, by a hash of the whole window. A shard builds an FM-index (suffix order, wavelet
    matrix) of its distinct segments and streams them through it: matching statistics by backward search give each window's
    range of occurrences and the smallest document in it. The batch gets these back and removes words.

    Null and empty texts have no words. A null doc_id is neither a source nor loses words; rows that repeat a doc_id do not
    count against each other.
    """
    total = text_bytes(docs.select("text"))
    batched = dealt(docs, F.lit(0), F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 + total // BATCH_BYTES)))
    bits = max(1, (total // 32 // BUCKET_ANCHORS).bit_length())

    def ask(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf[pdf["doc_id"].notna()]
        words = Words(unpacked(pdf))
        anchor, doc, _, _ = anchors(words, word_hashes(words))
        order = np.lexsort((doc, anchor))
        anchor, doc = anchor[order], doc[order]
        own = np.ones(len(anchor), dtype=bool)
        own[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])
        u, n = np.unique(anchor[own], return_counts=True)
        return pd.DataFrame([(pdf["batch"].iloc[0], b, pack_sorted(u[lo:hi]), press(n[lo:hi].astype("<u4"))) for b, lo, hi in by_bucket(u, bits)],
                            columns=["batch", "bucket", "hashes", "n"])

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        asked = [unpack_sorted(b) for b in pdf["hashes"]]
        u, place = np.unique(np.concatenate(asked), return_inverse=True)
        n = np.concatenate([unpress(b, "<u4") for b in pdf["n"]])
        held = np.bincount(place, weights=n, minlength=len(u))
        flag = ((held > 1).astype(np.uint8) + (held > HOT))[place]
        ends = np.cumsum([len(a) for a in asked])
        cuts = [flag[e - len(a):e] for a, e in zip(asked, ends)]
        return pd.DataFrame({"batch": pdf["batch"], "bucket": pdf["bucket"], "flags": [press(c) for c in cuts],
                             "open": [int((c > 0).sum()) for c in cuts]})

    answers = cut_lineage(batched.groupBy("batch").applyInPandas(ask, "batch long, bucket long, hashes binary, n binary")
                          .groupBy("bucket").applyInPandas(count, "batch long, bucket long, flags binary, open long"))
    shards = 1 + (answers.agg(F.sum("open").alias("n")).first()["n"] or 0) * (WINDOW + 5) // SHARD_WORDS

    def cut(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        left = _ordered(left[left["doc_id"].notna()])
        words = Words(unpacked(left))
        doc, start, n, number, shard, at = _segments(words, right, shards)
        first = np.full(len(shard), np.iinfo(np.int64).max)
        np.minimum.at(first, number, left["doc_id"].astype("int64").to_numpy()[doc])
        begin, end = words.begin[start[at]].tolist(), words.end[start[at] + n[at] + WINDOW - 2].tolist()
        heads = np.flatnonzero(np.diff(shard, prepend=-1))
        pack = zstandard.ZstdCompressor(level=3).compress
        out = [(key[0], int(shard[lo]), pack(b"\n".join(words.data[x:y] for x, y in zip(begin[lo:hi], end[lo:hi]))), press(first[lo:hi]))
               for lo, hi in zip(heads, np.append(heads[1:], len(shard)))]
        return pd.DataFrame(out, columns=["batch", "shard", "segments", "first"])

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        lists = [zstandard.decompress(b).split(b"\n") for b in pdf["segments"]]
        number, texts = pd.factorize(np.array([t for own in lists for t in own] + [None], dtype=object)[:-1])
        first = np.full(len(texts), np.iinfo(np.int64).max)
        np.minimum.at(first, number, np.concatenate([unpress(b, "<i8") for b in pdf["first"]]))
        words = Words(list(texts))
        lengths = words.n
        ids = np.unique(word_hashes(words), return_inverse=True)[1] + 1
        # A 0 follows each passage, so a word lies as many places further on as passages come before it.
        begins = np.cumsum(lengths + 1) - lengths - 1
        stream = np.zeros(len(ids) + len(texts), dtype=np.int64)
        stream[np.arange(len(ids)) + np.repeat(np.arange(len(texts)), lengths)] = ids
        index = FMIndex(stream, np.repeat(first, lengths + 1), WINDOW)
        least = index.matching_statistics(stream, begins, lengths)[1]
        windows = lengths - WINDOW + 1
        out, at = [], 0
        for own in lists:
            mine = number[at:at + len(own)]
            at += len(own)
            n = windows[mine]
            place = np.repeat(begins[mine] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            out.append(press(least[place]))
        return pd.DataFrame({"batch": pdf["batch"], "shard": pdf["shard"], "least": out})

    found = (batched.groupBy("batch").cogroup(answers.groupBy("batch"))
             .applyInPandas(cut, "batch long, shard long, segments binary, first binary")
             .groupBy("shard").applyInPandas(search, "batch long, shard long, least binary"))
    replies = cut_lineage(answers.select("batch", F.lit(0).alias("kind"), F.col("bucket"), F.col("flags"))
                          .unionByName(found.select("batch", F.lit(1).alias("kind"), F.col("shard").alias("bucket"), F.col("least").alias("flags"))))

    def remove(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        left = _ordered(left)
        texts = unpacked(left)
        known = left["doc_id"].notna().to_numpy()
        words = Words([t if k else b"" for t, k in zip(texts, known)])
        doc, start, n, number, _, at = _segments(words, right[right["kind"] == 0], shards)
        gone = np.zeros(len(words.begin) + 1, dtype=np.int64)
        if len(doc):
            own = right[right["kind"] == 1].sort_values("bucket")
            least = np.concatenate([unpress(b, "<i8") for b in own["flags"]])
            windows = n[at]
            base = (np.cumsum(windows) - windows)[number]
            place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            earlier = least[np.repeat(base, n) + place] < np.repeat(left["doc_id"].fillna("0").astype("int64").to_numpy()[doc], n)
            hit = (np.repeat(start, n) + place)[earlier]
            np.add.at(gone, hit, 1)
            np.add.at(gone, np.minimum(hit + WINDOW, len(words.begin)), -1)
        gone = np.cumsum(gone)[:-1] > 0
        rows = []
        for i, d in enumerate(left["doc_id"].array):
            if not known[i]:
                kept = texts[i].split()
                count, runs, lost = len(kept), [], 0
                kept = b" ".join(kept)
            else:
                lo, count = int(words.first[i]), int(words.n[i])
                mine = gone[lo:lo + count]
                lost = int(mine.sum())
                edge = np.flatnonzero(np.diff(mine.astype(np.int8), prepend=0, append=0))
                runs = [{"start": int(a), "n": int(b - a)} for a, b in zip(edge[::2], edge[1::2])]
                stay = np.flatnonzero(np.diff(~mine, prepend=False, append=False)) if lost else np.array([0, count])[:2 * (count > 0)]
                kept = b" ".join(words.slice(lo + int(a), int(b - a)) for a, b in zip(stay[::2], stay[1::2]))
            row = [d, count, lost, hashlib.sha256(kept).hexdigest(), runs]
            rows.append(row + [kept.decode("utf-8", "surrogatepass")] * with_text)
        return pd.DataFrame(rows, columns=["doc_id", "n_words", "n_removed", "kept_sha256", "removed"] + ["kept_text"] * with_text)

    schema = ("doc_id string, n_words long, n_removed long, kept_sha256 string, removed array<struct<start:long,n:long>>"
              + ", kept_text string" * with_text)
    return as_before(batched.groupBy("batch").cogroup(replies.groupBy("batch")).applyInPandas(remove, schema), docs)
