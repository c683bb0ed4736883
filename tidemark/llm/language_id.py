"""Language identification by Bayesian evidence fusion (operator 5)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.batches import TEXTS, arrow_rows, give_back
from tidemark.llm.text import as_before, as_text, ascii_lower, whole
from tidemark.llm.url_filter import host_of
from tidemark.session import cut_lineage

#: Cells that byte trigrams are hashed to; labelled documents that the text model is fitted on, for each language, about.
CELLS, PER_LANGUAGE = 1 << 14, 2000
#: Trigrams overlap, so their evidence counts by a third. Prior of no known language. Weight of a parent in host counts.
TEMPER, UNKNOWN, PARENT = 1 / 3, 1e-3, 20.0
#: Trigrams looked up at a time.
SLICE = 1 << 16
#: Up to so many labels with a share of their own are copied to every executor; more are joined.
BROADCAST_LABELS = 1 << 16
LEVELS = ("domain", "host", "declared", "suffix")
#: ASCII other than letters becomes a space.
LETTERS = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


@dataclass
class TextModel:
    languages: list[str]
    logs: np.ndarray  # cells x (languages + 1); the last column is the unknown language, uniform over the cells


def trigrams(text: str | None) -> np.ndarray:
    """Cells of the byte trigrams of lower-cased text; those without two letter bytes in a row say nothing and are left out."""
    b = np.frombuffer(b" " + (text or "").encode("utf-8", "surrogatepass").lower().translate(LETTERS) + b" ", dtype=np.uint8)
    blank = b == 32
    keep = ~(blank[:-2] & blank[1:-1] | blank[1:-1] & blank[2:] | blank[1:-1] & ~blank[:-2] & ~blank[2:])
    b = b.astype(np.uint32)
    code = ((b[:-2] << 16) | (b[1:-1] << 8) | b[2:])[keep]
    return ((code * np.uint32(2654435761)) >> np.uint32(32 - CELLS.bit_length() + 1)).astype(np.int64)


def train(docs: DataFrame, per_language: int = PER_LANGUAGE) -> TextModel:
    """Text model from docs(doc_id, text, lang): trigram counts of a bounded sample of labelled rows, by hash of doc_id and text.

    Languages are all labels whose texts have trigrams, however few. Each cell starts at half an occurrence; in a language
    of fewer trigrams than cells at less, so that all starts weigh half its trigrams and it stays apart from the unknown
    language. Without labels every text is of unknown language.
    """
    sizes = docs.where("lang is not null").groupBy("lang").agg(F.count("*").alias("n"))
    shares = cut_lineage(sizes.where(F.col("n") > per_language).select("lang", (per_language / F.col("n")).alias("share")))
    if shares.count() <= BROADCAST_LABELS:
        shares = F.broadcast(shares)
    labelled = docs.where("lang is not null").join(shares, "lang", "left")
    share = F.coalesce("share", F.lit(1.0))
    draw = F.pmod(F.xxhash64("doc_id", "text", F.lit(5)), F.lit(1_000_000)) / 1e6

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for lang, own in pdf.groupby("lang"):
                n = np.bincount(np.concatenate([trigrams(t) for t in own["text"]]), minlength=CELLS)
                yield pd.DataFrame({"lang": lang, "cell": np.flatnonzero(n), "n": n[n > 0]})
            give_back()

    with arrow_rows(docs.sparkSession, TEXTS):
        counts = (labelled.where(draw < share).select("lang", "text").mapInPandas(count, "lang string, cell long, n long")
                  .groupBy("lang", "cell").agg(F.sum("n").alias("n")).toPandas())
    by_lang = dict(list(counts.groupby("lang")))
    languages = sorted(by_lang)
    logs = np.full((CELLS, len(languages) + 1), -np.log(CELLS))
    for i, lang in enumerate(languages):
        own = by_lang[lang]
        n = np.full(CELLS, 0.5 * min(1.0, own["n"].sum() / CELLS))
        n[own["cell"]] += own["n"]
        logs[:, i] = np.log(n / n.sum())
    return TextModel(languages, logs.astype(np.float32))


def _frequencies(decided: DataFrame, level: str) -> DataFrame:
    """(level, languages, counts): for each value of the level the rows that their text gives to each language."""
    own = decided.where(F.col(level).isNotNull()).groupBy(level, "_best").agg(F.count("*").alias("n"))
    listed = own.groupBy(level).agg(F.sort_array(F.collect_list(F.struct("_best", "n"))).alias("_of"))
    return listed.select(level, F.col("_of._best").alias(f"_{level}_langs"), F.col("_of.n").alias(f"_{level}_n"))


def identify(rows: DataFrame, model: TextModel) -> DataFrame:
    """(id, lang, posterior, declared, suffix, host, text_lang, rejected) for rows(id, text, declared, suffix, host, domain).

    Log evidence of a language: text likelihood, tempered; the declared language and the address suffix, each by its smoothed
    frequency among texts of that language; the host's prior, smoothed towards its domain's and that towards the prior of all
    rows. The frequencies are counted over all rows by what their text says alone, as rows (value, language, n), so a further
    language costs no further column. Missing evidence says nothing. A row whose best hypothesis is no known language is
    rejected, with a null ``lang``; so is one without any letters, unless its other evidence outweighs UNKNOWN. Repeated rows are
    judged alike. Texts of any length are read whole; further columns are not looked at.
    """
    logs, languages, known = model.logs, model.languages, len(model.languages)

    def likelihood(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out, n, ll = pdf.drop(columns="text"), [], []
            for text in pdf["text"]:  # the trigrams of one text at a time
                cells = trigrams(text)
                n.append(len(cells))
                ll.append(sum(logs[cells[at:at + SLICE]].sum(axis=0, dtype=np.float64) for at in range(0, max(1, len(cells)), SLICE)))
            yield out.assign(_n=n, _ll=ll)
            give_back()

    scored = as_text(rows.select("id", "declared", "suffix", "host", "domain", "text"), "id").mapInPandas(
        likelihood, "id string, declared string, suffix string, host string, domain string, _n long, _ll array<double>")
    with arrow_rows(rows.sparkSession, TEXTS):
        scored = cut_lineage(as_before(scored, rows, "id"))
    best = F.array_position("_ll", F.array_max("_ll")) - 1
    scored = scored.withColumn("_best", F.when((F.col("_n") > 0) & (best < known), best))
    decided = scored.where("_best is not null")
    n = np.zeros(known)
    for r in decided.groupBy("_best").agg(F.count("*").alias("n")).collect():
        n[r["_best"]] = r["n"]
    kinds = decided.agg(*(F.count_distinct(c).alias(c) for c in ("declared", "suffix"))).first()
    overall = (n + 1) / (n.sum() + max(known, 1))
    out = scored
    for level in LEVELS:
        out = out.join(_frequencies(decided, level), level, "left")

    def fuse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def counted(langs, counts) -> np.ndarray:
            x = np.zeros(known)
            if langs is not None:
                x[np.asarray(langs, dtype=np.int64)] = counts
            return x

        def smoothed(x: np.ndarray, parent: np.ndarray) -> np.ndarray:
            return (x + PARENT * parent) / (x.sum() + PARENT)

        for pdf in batches:
            told = {c: pdf[c].tolist() for c in pdf}
            judged = []
            for i in range(len(pdf)):
                of = {c: counted(told[f"_{c}_langs"][i], told[f"_{c}_n"][i]) for c in LEVELS}
                prior = smoothed(of["host"], smoothed(of["domain"], overall))
                log = np.asarray(told["_ll"][i]) * TEMPER + np.log(np.append((1 - UNKNOWN) * prior, UNKNOWN))
                for c in ("declared", "suffix"):
                    if told[c][i] is not None:  # of no known language all values are alike
                        log += np.log(np.append((of[c] + 1) / (n + kinds[c] + 1), 1 / (kinds[c] + 1)))
                top = int(log.argmax())
                judged.append((languages[top] if top < known else None, 1 / np.exp(log - log[top]).sum(), top == known))
            text_best = [None if b is None or b != b else languages[int(b)] for b in told["_best"]]
            yield pd.DataFrame({"id": pdf["id"], "lang": [j[0] for j in judged], "posterior": [j[1] for j in judged], "declared": pdf["declared"],
                                "suffix": pdf["suffix"], "host": pdf["host"], "text_lang": text_best, "rejected": [j[2] for j in judged]})

    judged = as_text(out, "id").mapInPandas(fuse, "id string, lang string, posterior double, declared string, suffix string, host string, "
                                                  "text_lang string, rejected boolean")
    return as_before(judged, rows, "id")


def page_rows(pages: DataFrame) -> DataFrame:
    """Rows for identify() of pages(page_id, url, html): visible text, declared language, host, its domain and suffix."""
    html = whole(F.col("html"))
    visible = F.regexp_replace(html, "(?is)<(script|style)\\b.*?</\\1\\s*>|<!--.*?-->|<[^>]*>", " ")
    declared = F.regexp_extract(html, "(?i)<html\\b[^>]*?\\blang\\s*=\\s*[\"']?([a-z]+)", 1)
    host = F.regexp_replace(host_of(F.col("url")), "^.*@|:\\d*$|\\.$", "")
    labels = F.split(host, "\\.")
    none = lambda c: F.when(c != "", c)
    return pages.select(F.col("page_id").alias("id"), visible.alias("text"), ascii_lower(none(declared)).alias("declared"),
                        none(F.element_at(labels, -1)).alias("suffix"), none(host).alias("host"),
                        none(F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2), ".")).alias("domain"))


def document_rows(docs: DataFrame) -> DataFrame:
    """Rows for identify() of docs(doc_id, text, lang, source): the source stands for the host, there is no address."""
    none = F.lit(None).cast("string")
    return docs.select(F.col("doc_id").alias("id"), "text", F.col("lang").alias("declared"), none.alias("suffix"),
                       F.col("source").alias("host"), none.alias("domain"))
