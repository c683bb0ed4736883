"""Language-model scores by deleted interpolation (operator 4)."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.batches import BATCH_BYTES, by_bucket, dealt, pack_sorted, press, press_counts, text_bytes, unpack_sorted, unpacked, unpress, unpress_counts
from tidemark.llm.text import as_before
from tidemark.session import cut_lineage

#: N-grams in a count bucket, about: what one task holds.
BUCKET_NGRAMS = 1 << 20
#: Remainders of crc32(doc_id) mod 10: held out of all learning; kept from the first counts to learn the weights on.
HELD_OUT, TUNING = 0, 1
#: Contexts are bucketed by the bit length of their frequency; likelihoods are binned to a quarter of a bit for the weights.
CONTEXT_BUCKETS, BIN, ROUNDS = 32, 4.0, 40


def remainder(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")), F.lit(0)) % 10


def tokens(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hashes, tokens a text): ASCII-lower-cased words, and after each text its end, the hash of the empty word."""
    words = pc.ascii_split_whitespace(pc.ascii_lower(pa.array([t or "" for t in texts], pa.large_string())))
    flat = words.values.dictionary_encode()
    hashes = np.array([xxhash.xxh3_64_intdigest(w) for w in flat.dictionary.cast(pa.large_binary()).to_pylist()], dtype=np.uint64)
    ids = flat.indices.to_numpy(zero_copy_only=False)
    end, empty = np.uint64(xxhash.xxh3_64_intdigest(b"")), flat.dictionary.index("").as_py()
    doc = np.repeat(np.arange(len(texts)), np.diff(words.offsets.to_numpy()))
    if empty >= 0:
        doc, ids = doc[ids != empty], ids[ids != empty]
    n = np.bincount(doc, minlength=len(texts)) + 1
    out = np.full(len(ids) + len(texts), end, dtype=np.uint64)
    out[np.arange(len(ids)) + doc] = hashes[ids] if len(ids) else out[:0]
    return out, n


def bigrams(h: np.ndarray) -> np.ndarray:
    """Hash of each token with the one before it; a text follows the end of another."""
    before = np.roll(h, 1)
    before[:1] = np.uint64(xxhash.xxh3_64_intdigest(b""))
    x = before * np.uint64(0x9E3779B97F4A7C15) + (h ^ (h >> np.uint64(31)))
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _ask(h: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Distinct words and pairs of a batch, ascending: (hashes, place of each token, counts)."""
    return [np.unique(x, return_inverse=True, return_counts=True) for x in (h, bigrams(h))]


def _texts(pdf: pd.DataFrame) -> list[str]:
    return [b.decode("utf-8", "surrogatepass") for b in unpacked(pdf)]


def _batched(docs: DataFrame) -> tuple[DataFrame, int]:
    """(batch, part, doc_id, packed) and the bytes of all texts. Batches are dealt by hash, apart for each part."""
    total = text_bytes(docs)
    left = remainder(F.col("doc_id"))
    part = F.when(left == HELD_OUT, 0).when(left == TUNING, 1).otherwise(2)
    one, rest = 1 + total // 10 // BATCH_BYTES, 1 + total * 8 // 10 // BATCH_BYTES
    return dealt(docs, part, F.pmod(F.xxhash64("doc_id", "text"), F.when(part == 2, rest).otherwise(one))), total


def _answers(batched: DataFrame, total: int) -> DataFrame:
    """(batch, kind, bucket, train, rest): for each batch the training counts of its distinct words (kind 0) and pairs (1).

    A batch asks for its distinct n-grams by bucket of their hash, with its own counts, so an n-gram that a third of all
    documents share is asked for once a batch. ``rest`` leaves the tuning documents out. Rows of batch -1 hold sums.
    """
    bits = max(1, (total // 5 // BUCKET_NGRAMS).bit_length())

    def ask(pdf: pd.DataFrame) -> pd.DataFrame:
        out, part = [], int(pdf["part"].iloc[0])
        for kind, (u, _, n) in enumerate(_ask(tokens(_texts(pdf))[0])):
            for bucket, lo, hi in by_bucket(u, bits):
                out.append((pdf["batch"].iloc[0], part, kind, bucket, pack_sorted(u[lo:hi]), press(n[lo:hi].astype("<u4"))))
        return pd.DataFrame(out, columns=["batch", "part", "kind", "bucket", "hashes", "n"])

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        asked = [unpack_sorted(b) for b in pdf["hashes"]]
        u, place = np.unique(np.concatenate(asked), return_inverse=True)
        n = np.concatenate([unpress(b, "<u4") for b in pdf["n"]])
        part = np.repeat(pdf["part"].to_numpy(), [len(a) for a in asked])
        rest = np.bincount(place[part == 2], weights=n[part == 2], minlength=len(u)).astype(np.int64)
        train = rest + np.bincount(place[part == 1], weights=n[part == 1], minlength=len(u)).astype(np.int64)
        ends = np.cumsum([len(a) for a in asked])
        out = []
        for batch, p, k, b, lo, hi in zip(pdf["batch"], pdf["part"], pdf["kind"], pdf["bucket"], ends - [len(a) for a in asked], ends):
            own = [press_counts(c[place[lo:hi]]) for c in (train, rest)]
            out.append((batch, k, b, own[0], own[1] if p == 1 else None, None))
        sums = [int((train > 0).sum()), int(train.sum()), int((rest > 0).sum()), int(rest.sum())]
        out.append((-1, pdf["kind"].iloc[0], pdf["bucket"].iloc[0], None, None, sums))
        return pd.DataFrame(out, columns=["batch", "kind", "bucket", "train", "rest", "sums"])

    asked = batched.groupBy("batch").applyInPandas(ask, "batch long, part int, kind int, bucket long, hashes binary, n binary")
    return asked.groupBy("kind", "bucket").applyInPandas(
        count, "batch long, kind int, bucket long, train binary, rest binary, sums array<long>")


def _looked_up(docs: pd.DataFrame, answers: pd.DataFrame, column: str):
    """Token by token: counts of the word, of the word before it, of the pair; and tokens a text."""
    h, n = tokens(_texts(docs))
    found = []
    for kind, (_, place, _) in enumerate(_ask(h)):
        own = answers[answers["kind"] == kind].sort_values("bucket")
        found.append(np.concatenate([unpress_counts(b) for b in own[column]]).astype(np.float64)[place])
    word, pair = found
    end = h == np.uint64(xxhash.xxh3_64_intdigest(b""))
    before = np.roll(word, 1)
    before[:1] = word[end][:1]
    return word, before, pair, n


def _mle(word, before, pair, tokens_in_all: int):
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(before > 0, pair / before, 0.0), word / max(tokens_in_all, 1)


def _bucket(before: np.ndarray) -> np.ndarray:
    return np.minimum(np.frexp(before)[1], CONTEXT_BUCKETS - 1)


def _binned(p: np.ndarray) -> np.ndarray:
    """Quarter-bits of a likelihood; 1 stands for likelihood zero."""
    with np.errstate(divide="ignore"):
        return np.where(p > 0, np.rint(BIN * np.log2(np.where(p > 0, p, 1.0))), 1).astype(np.int64)


def learn_weights(bins: pd.DataFrame, vocabulary: int) -> np.ndarray:
    """Expectation-maximisation on binned held-out counts (bucket, pair, word, n): weights of pair, word and uniform."""
    w = np.full((CONTEXT_BUCKETS, 3), 1 / 3)
    for b, own in bins.groupby("bucket"):
        p = np.stack([np.where(own[c] == 1, 0.0, np.exp2(own[c] / BIN)) for c in ("pair", "word")] + [np.full(len(own), 1 / (vocabulary + 1))], axis=1)
        n = own["n"].to_numpy(dtype=float)
        for _ in range(ROUNDS):
            share = p * w[b]
            share /= share.sum(axis=1, keepdims=True)
            w[b] = (n[:, None] * share).sum(axis=0) / n.sum()
        # A little of each stays, so that no token has probability zero.
        w[b] = (w[b] + 1e-6) / (w[b] + 1e-6).sum()
    return w


def lm_score(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for docs(doc_id, text).

    Tokens are ASCII-lower-cased words and one end for each text, a null text being empty. The model mixes the maximum-
    likelihood estimates of pairs and of words with the uniform one over the vocabulary and one unknown word. The three
    weights depend on how often the context was seen; they are learned by expectation-maximisation on documents that were
    deleted from the first counts (remainder TUNING). The last counts hold all training documents. A document's first
    context is an end. A null doc_id counts as empty text in the checksum, so it is held out; repeated rows are learned and
    scored as often as they occur.

    Documents are dealt into batches. A batch asks for the counts of its distinct n-grams and gets them back in the same
    order, so counts move once for each batch, not for each token. N-grams are known by 64-bit hashes. Of the corpus only
    sums and the binned held-out counts reach the driver, at most CONTEXT_BUCKETS times the square of some hundred bins.
    """
    batched, total = _batched(docs.select("doc_id", "text"))
    answers = cut_lineage(_answers(batched, total))
    sums = answers.where("batch = -1 AND kind = 0").select(*(F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(4))).first()
    known, seen, known_rest, seen_rest = (sums[f"s{i}"] or 0 for i in range(4))
    answers = answers.where("batch >= 0").select("batch", "kind", "bucket", "train", "rest")

    def held_out_bins(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        word, before, pair, _ = _looked_up(left, right, "rest")
        p2, p1 = _mle(word, before, pair, seen_rest)
        rows = pd.DataFrame({"bucket": _bucket(before), "pair": _binned(p2), "word": _binned(p1)})
        return rows.groupby(["bucket", "pair", "word"]).size().reset_index(name="n").astype("int64")

    tuning = (F.col("batch") >= (1 << 40)) & (F.col("batch") < (2 << 40))
    bins = (batched.where("part = 1").groupBy("batch").cogroup(answers.where(tuning).groupBy("batch"))
            .applyInPandas(held_out_bins, "bucket long, pair long, word long, n long")
            .groupBy("bucket", "pair", "word").agg(F.sum("n").alias("n")).orderBy("bucket", "pair", "word").toPandas())
    weights = learn_weights(bins, known_rest)

    def score(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        word, before, pair, n = _looked_up(left, right, "train")
        p2, p1 = _mle(word, before, pair, seen)
        w = weights[_bucket(before)]
        logs = np.log10(w[:, 0] * p2 + w[:, 1] * p1 + w[:, 2] / (known + 1))
        base = np.log10((word + 0.1) / (seen + 0.1 * (known + 1)))
        at = np.cumsum(n) - n
        return pd.DataFrame({"doc_id": left["doc_id"], "held_out": left["part"] == 0, "n_tokens": n, "n_known": np.add.reduceat(word > 0, at, dtype=np.int64),
                             "train_tokens": seen, "base_score": np.add.reduceat(base, at), "score": np.add.reduceat(logs, at)})

    out = batched.groupBy("batch").cogroup(answers.groupBy("batch")).applyInPandas(
        score, "doc_id string, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return as_before(out, docs)
