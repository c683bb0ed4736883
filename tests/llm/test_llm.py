"""The training-data operators against brute force, SQL, and cases that break careless code."""

import glob
import hashlib
import math
import os
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import xxhash

import corpus_pipeline
from tidemark.llm import (batches, chat, embedding_dedup, exact_dedup, fm_index, language_id, lm_score, mixing, packing, queries,
                          shingle_dedup, simhash, substring_dedup, url_filter)

SF = os.environ.get("TIDEMARK_TEST_SF", "/root/testdata/sf0.001")
tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
WORD = re.compile("[^\x20\x09-\x0d]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: Names that operators use inside stand as extra columns.
DOC = ("doc_id long, text string, lang string, source string, n_chars long, host string, run long, batch long, kept boolean, norm string, "
       "key string, _key string, _uid long, uid long, _spans string, size long, `a.b` string")


def prose(rng, n):
    return " ".join(rng.choice(["the", "of", "and", "to", "storm", "water", "level", "falls", "rises", "in", "Été", "straße"]) for _ in range(n))


def rows(texts, first=0):
    langs, sources = ["en", "fr", None], ["src0", "src1", None, "b"]
    return [(first + i, t, langs[i % 3], sources[i % 4], len(t or ""), "h", 1, 2, True, "n", "k", "k", i % 3, 7, "s", 5, "dot") for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def odd():
    """Nulls, empty and blank texts, copies that differ in blanks, a very long text, shared passages, control strings."""
    rng = random.Random(3)
    passage = " ".join(f"p{i}" for i in range(40))
    long_text = prose(rng, 30_000)
    texts = [None, "", " \t\n", "a", "A b", "a  b", "a\tb", passage, prose(rng, 30) + " " + passage + " " + prose(rng, 30), passage + " tail",
             long_text, long_text + " end", "x " * 50, "x " * 49, "Über naïve </s> <|endoftext|> end", "\x1c\x1d a\u00a0b \u2003c"]
    texts += [prose(rng, rng.randrange(5, 200)) for _ in range(30)]
    return texts + [texts[20], texts[20].replace(" ", "  "), texts[21], texts[21] + "!"]


@pytest.fixture(scope="module")
def docs(spark, odd):
    return spark.createDataFrame(rows(odd), DOC).repartition(5).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOC)


def collected(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def components(ids, linked):
    label = {i: i for i in ids}
    pairs = [(a, b) for n, a in enumerate(ids) for b in ids[n + 1:] if linked(a, b)]
    while True:
        before = dict(label)
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
        if before == label:
            return label


# --- queries against their SQL ----------------------------------------------------------------

@tables
@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_and_sql(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    df = queries.QUERIES[name](spark, SF)
    cur = con.execute(queries.ORACLE[name])
    names = [d[0] for d in cur.description]
    want = sorted(cur.fetchall(), key=repr)
    assert sorted(names) == sorted(df.columns)
    assert sorted((tuple(r[c] for c in names) for r in df.collect()), key=repr) == want and want


def test_one_query_each():
    assert sorted(int(n.split("_")[0][2:]) for n in queries.QUERIES) == list(range(1, 14))


# --- 1 substring dedup ------------------------------------------------------------------------

def test_fm_index_matching_statistics():
    rng = np.random.default_rng(1)
    for depth in (1, 3, 6):
        words = rng.integers(1, 4, 200)
        words[rng.integers(0, 200, 15)] = 0
        words[-1] = 0
        owner, text = rng.integers(0, 99, 200), words.tolist()
        index = fm_index.FMIndex(words, owner, depth)
        stream, starts, lengths = rng.integers(1, 5, 90), np.array([0, 20, 50]), np.array([20, 30, 40])
        stream[stream == 4] = -1
        have, least = index.matching_statistics(stream, starts, lengths)
        for s, n in zip(starts, lengths):
            for p in range(s, s + n):
                best, first = 0, -1
                for k in range(1, min(depth, s + n - p) + 1):
                    at = [i for i in range(len(text) - k + 1) if text[i:i + k] == stream[p:p + k].tolist()]
                    if at:
                        best, first = k, min(owner[i] for i in at) if k == depth else -1
                assert (have[p], least[p]) == (best, first)


def test_packed_numbers_come_back():
    rng = np.random.default_rng(2)
    for n in (1, 2, 1000):
        x = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        assert (batches.unpack_sorted(batches.pack_sorted(x)) == x).all()
    assert len(batches.unpack_sorted(batches.pack_sorted(x[:0]))) == 0


def passages(texts):
    first, out = {}, {}
    for i, t in texts:
        w, n = WORD.findall(t or ""), 13
        gone, grams = [False] * len(w), [tuple(w[j:j + n]) for j in range(len(w) - n + 1)]
        for j, g in enumerate(grams):
            if first.get(g, i) < i:
                gone[j:j + n] = [True] * n
        for g in grams:
            first.setdefault(g, i)
        kept = " ".join(a for a, b in zip(w, gone) if not b)
        out[i] = (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest(), kept)
    return out


@pytest.mark.parametrize("hot", [1000, 1])
def test_repeated_passages(docs, odd, hot, monkeypatch):
    monkeypatch.setattr(substring_dedup, "HOT", hot)
    monkeypatch.setattr(substring_dedup, "BATCH_BYTES", 100_000)
    monkeypatch.setattr(substring_dedup, "SHARD_WORDS", 20_000)
    got = collected(substring_dedup.repeated_passages(docs, with_text=True))
    want = passages(enumerate(odd))
    assert {k: (r["n_words"], r["n_removed"], r["kept_sha256"], r["kept_text"]) for k, r in got.items()} == want
    assert sum(r["n_removed"] for r in got.values()) > 30_000
    assert all(sum(s["n"] for s in r["removed"]) == r["n_removed"] for r in got.values())


def test_repeated_passages_of_null_and_equal_ids(spark, empty):
    t = " ".join(f"w{i}" for i in range(20))
    got = substring_dedup.repeated_passages(spark.createDataFrame([(None, t), (5, t), (5, t), (7, t)], "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] or -1, r["n_words"], r["n_removed"]) for r in got) == [(-1, 20, 0), (5, 20, 0), (5, 20, 0), (7, 20, 20)]
    assert substring_dedup.repeated_passages(empty).collect() == []


# --- 2 URL filter -----------------------------------------------------------------------------

def test_url_filter_cases(spark):
    urls = [None, "", "no scheme", "http://", "http://ORG", "http://Org/", "https://a.b.org/x?q#f", "http://borg/", "http://example.org/es/1",
            "http://www.example.org/en/19", "http://example.org/en/2", "x://example.org#/es/", "http://u.com/fr/://org/", "http://com/de/",
            "http://a.com/DE/", "a\nb://org/", "http://org/\n", "http://örg/"]
    frame = spark.createDataFrame([(i, u, "h", "p") for i, u in enumerate(urls)] * 2, "page_id long, url string, host string, path string")
    rules = [*queries.RULES, (None, "/", "block")]
    got = url_filter.url_filter(frame, spark.createDataFrame(rules, "host string, path string, verdict string")).collect()
    assert len(got) == 2 * len(urls)
    for r in got:
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", r["url"] or "")
        host, path = (m.group(1).translate(LOWER), m.group(2)) if m else ("", "")
        fit = [(h + p, v) for h, p, v in queries.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule, verdict = max(fit, key=lambda x: len(x[0]), default=(None, "allow"))
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == (host, path, rule, verdict), r["url"]
    none = spark.createDataFrame([], "host string, path string, verdict string")
    assert {r["verdict"] for r in url_filter.url_filter(frame, none).collect()} == {"allow"}
    assert url_filter.url_filter(frame.limit(0), none).collect() == []


def test_bloom_filter_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "BROADCAST_BLOCKS", 0)
    listed = spark.range(3000).selectExpr("concat('h', id) AS host", "concat('/', id) AS path", "'block' AS verdict")
    pages = spark.range(6000).selectExpr("id AS page_id", "concat('http://h', id, '/', id, 'x') AS url")
    out = url_filter.url_filter(pages, listed).groupBy("verdict").count().collect()
    assert {r["verdict"]: r["count"] for r in out} == {"block": 3000, "allow": 3000}


# --- 3 SimHash --------------------------------------------------------------------------------

def fingerprint(text):
    w = (text or "").translate(LOWER)
    w = WORD.findall(w)
    parts = [" ".join(w[i:i + 3]) for i in range(len(w) - 2)] if len(w) > 2 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum((2 * sum(x >> b & 1 for x in h) > len(h)) << b for b in range(64))


def test_simhash_groups(spark, docs, odd, empty):
    got = collected(simhash.simhash_groups(docs).withColumn("hex", simhash.hex_print(simhash.F.col("fp"))))
    fp = {i: fingerprint(t) for i, t in enumerate(odd)}
    assert {i: r["hex"] for i, r in got.items()} == {i: f"{f:016x}" for i, f in fp.items()}
    want = components(list(fp), lambda a, b: (fp[a] ^ fp[b]).bit_count() <= 2)
    assert {i: r["component_id"] for i, r in got.items()} == want and len(set(want.values())) < len(want)
    assert simhash.simhash_groups(empty).collect() == []
    null = spark.createDataFrame([(None, "a b c"), (4, "a b c")], "doc_id long, text string")
    assert {r["component_id"] for r in simhash.simhash_groups(null).collect()} == {4}


def test_links_lose_no_pair(spark):
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(40)]
    prints = sorted({b ^ sum(1 << i for i in rng.sample(range(64), k)) for b in base for k in (0, 1, 1, 2, 2, 3)} | {0, 1 << 63, 1 << 31, 3 << 31})
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    got = {(r["a"], r["b"]) for r in simhash.links(spark.createDataFrame([(p,) for p in signed], "fp long")).collect()}
    signed.sort()
    assert got == {(a, b) for i, a in enumerate(signed) for b in signed[i + 1:] if ((a ^ b) & (2**64 - 1)).bit_count() <= 2}


# --- 4 language model -------------------------------------------------------------------------

def word_tokens(t):
    return WORD.findall((t or "").translate(LOWER)) + [None]


def test_lm_score(spark, docs, odd, empty, monkeypatch):
    monkeypatch.setattr(lm_score, "BATCH_BYTES", 50_000)
    texts = [*odd, *[prose(random.Random(i), 80) for i in range(60)]]
    df = spark.createDataFrame(rows(texts), DOC)
    got = collected(lm_score.lm_score(df))
    part = {i: zlib.crc32(str(i).encode()) % 10 for i in range(len(texts))}
    learned = [texts[i] for i in part if part[i]]
    c, pairs = Counter(), Counter()
    for t in learned:
        w = word_tokens(t)
        c.update(w)
        pairs.update(zip([None, *w], w))
    n, v = sum(c.values()), len(c)
    for i, t in enumerate(texts):
        w, r = word_tokens(t), got[i]
        base = sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (part[i] == 0, len(w), sum(c[x] > 0 for x in w), n)
        assert abs(r["base_score"] - base) < 1e-9 * abs(base) + 1e-9 and r["score"] < 0
    assert lm_score.lm_score(empty).collect() == []


@tables
def test_model_beats_the_base_on_held_out_documents(spark):
    held = [r for r in queries.QUERIES["op4_lm_score"](spark, SF).collect() if r["held_out"]]
    assert sum(r["score"] for r in held) > 0.9 * sum(r["base_score"] for r in held)


def test_interpolation_is_what_the_counts_say(spark):
    """One bucket of weights: scores must equal the mixture computed by hand with the weights that EM gives by hand."""
    texts = [prose(random.Random(i), 30) for i in range(120)]
    got = collected(lm_score.lm_score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))
    part = {i: zlib.crc32(str(i).encode()) % 10 for i in range(len(texts))}

    def counts(keep):
        c, p = Counter(), Counter()
        for i, t in enumerate(texts):
            if keep(part[i]):
                w = word_tokens(t)
                c.update(w)
                p.update(zip([None, *w], w))
        return c, p, sum(c.values()), len(c)

    c, p, n, v = counts(lambda k: k > 1)
    hist = defaultdict(Counter)
    for i, t in enumerate(texts):
        if part[i] == 1:
            w = word_tokens(t)
            for a, b in zip([None, *w], w):
                q = [0 if not x else 2 ** (round(4 * math.log2(x)) / 4) for x in (p[a, b] / c[a] if c[a] else 0, c[b] / n)]
                hist[min(int(c[a]).bit_length(), 31)][*q] += 1
    weights = defaultdict(lambda: [1 / 3] * 3)
    for b, own in hist.items():
        w = [1 / 3] * 3
        for _ in range(lm_score.ROUNDS):
            new = [0, 0, 0]
            for q, k in own.items():
                parts = [w[j] * x for j, x in enumerate((*q, 1 / (v + 1)))]
                for j in range(3):
                    new[j] += k * parts[j] / sum(parts)
            w = [x / sum(new) for x in new]
        weights[b] = [(x + 1e-6) / (1 + 3e-6) for x in w]
    c, p, n, v = counts(lambda k: k > 0)
    for i, t in enumerate(texts):
        w, s = word_tokens(t), 0
        for a, b in zip([None, *w], w):
            k = weights[min(int(c[a]).bit_length(), 31)]
            s += math.log10(k[0] * (p[a, b] / c[a] if c[a] else 0) + k[1] * c[b] / n + k[2] / (v + 1))
        assert abs(s - got[i]["score"]) < 1e-6 * abs(s)


# --- 5 language id ----------------------------------------------------------------------------

@tables
def test_language_on_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language_id.train(docs.where("doc_id % 2 = 0"))
    held = language_id.document_rows(docs.where("doc_id % 2 = 1")).withColumn("declared", language_id.F.lit(None).cast("string"))
    truth = {r["doc_id"]: r["lang"] for r in docs.select("doc_id", "lang").collect()}
    got = language_id.identify(held, model).collect()
    assert sum(r["lang"] == truth[r["id"]] for r in got) >= 0.97 * len(got) and not any(r["rejected"] for r in got)
    pages = queries.QUERIES["op5_language_id"](spark, SF).collect()
    assert sum(r["lang"] == r["declared"] for r in pages) >= 0.97 * len(pages)


def test_language_evidence(spark, empty):
    rng = random.Random(1)
    train = [(i, "the of and to in with that for water level " * 20, "en") for i in range(30)]
    train += [(100 + i, "le la des une et dans pour avec niveau eau " * 20, "fr") for i in range(30)]
    model = language_id.train(spark.createDataFrame(train, "doc_id long, text string, lang string"))
    assert model.languages == ["en", "fr"]
    schema = "id long, text string, declared string, suffix string, host string, domain string"
    body = [(i, "the water level of the", "en", "org", "h1", "d1") for i in range(40)] + [(50 + i, "le niveau des eau et", "fr", "fr", "h2", "d2") for i in range(40)]
    junk = "".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(200))
    asked = [(200, "", "fr", "fr", "h2", "d2"), (201, None, None, None, "h1", "d1"), (202, "12 ... 34", None, None, None, None),
             (203, junk, "en", "org", "h1", "d1"), (204, "the water of that level", None, None, None, None), (204, "the water of that level", None, None, None, None)]
    got = collected(language_id.identify(spark.createDataFrame(body + asked, schema), model), "id")
    assert [got[i]["lang"] for i in (200, 201, 204)] == ["fr", "en", "en"]
    assert got[203]["rejected"] and got[203]["lang"] is None and not got[0]["rejected"]
    assert 0 < got[202]["posterior"] <= 1
    none = language_id.train(empty.select("doc_id", "text", "lang"))
    assert none.languages == [] and language_id.identify(language_id.document_rows(empty), none).collect() == []
    assert all(r["rejected"] for r in language_id.identify(spark.createDataFrame(body, schema), none).collect())


def fused(rows, model):
    """Posterior of each row in plain Python: (language or None, posterior), by index."""
    known = len(model.languages)
    lls = [sum((model.logs[c].astype(float) for c in language_id.trigrams(r[1])), np.zeros(known + 1)) for r in rows]
    best = [int(np.argmax(ll)) if len(language_id.trigrams(r[1])) and np.argmax(ll) < known else None for r, ll in zip(rows, lls)]
    n = [best.count(k) for k in range(known)]
    def tally(at, value, k):
        return sum(b == k and r[at] == value for r, b in zip(rows, best) if value is not None)
    kinds = {at: len({r[at] for r, b in zip(rows, best) if b is not None and r[at] is not None}) + 1 for at in (2, 3)}
    out = []
    for r, ll in zip(rows, lls):
        base = [(x + 1) / (sum(n) + known) for x in n]
        for at in (5, 4):
            own = [tally(at, r[at], k) for k in range(known)]
            base = [(x + 20 * p) / (sum(own) + 20) for x, p in zip(own, base)]
        logs = [ll[k] / 3 + math.log(0.999 * base[k]) for k in range(known)] + [ll[known] / 3 + math.log(0.001)]
        for at in (2, 3):
            if r[at] is not None:
                logs = [x + math.log((tally(at, r[at], k) + 1) / (n[k] + kinds[at]) if k < known else 1 / kinds[at]) for k, x in enumerate(logs)]
        top = int(np.argmax(logs))
        out.append((model.languages[top] if top < known else None, 1 / sum(math.exp(x - logs[top]) for x in logs)))
    return out


EVIDENCE = "id long, text string, declared string, suffix string, host string, domain string, lang string, _best long, rejected boolean"


def test_fusion_against_plain_python(spark):
    rng = random.Random(12)
    vocabulary = {"en": "the of and to storm water level", "fr": "le la des une eau dans niveau", "el": "το νερό και η στάθμη της θύελλα"}
    text = lambda k, n: " ".join(rng.choice(vocabulary[k].split()) for _ in range(n))
    train = [(i, text(k, 30), k) for i, k in enumerate(rng.choice(sorted(vocabulary)) for _ in range(60))]
    model = language_id.train(spark.createDataFrame(train, "doc_id long, text string, lang string"))
    junk = "".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(60))
    data = [(i % 90 if i % 7 else None, rng.choice([text(rng.choice(sorted(vocabulary)), rng.randrange(1, 6)), "", None, "12", junk]),
             rng.choice(["en", "fr", "xx", None]), rng.choice(["fr", "org", None]), rng.choice(["h1", "h2", None]), rng.choice(["d1", None])) for i in range(150)]
    data += [data[3], (999, text("fr", 60_000), "en", "org", "h1", "d1")]
    df = spark.createDataFrame([(*r, "x", 1, True) for r in data], EVIDENCE).repartition(4)
    got = Counter((r["id"], r["lang"], round(r["posterior"], 6), r["rejected"]) for r in language_id.identify(df, model).collect())
    want = Counter((r[0], lang, round(p, 6), lang is None) for r, (lang, p) in zip(data, fused(data, model)))
    assert got == want and {x[1] for x in want} == {"en", "fr", "el", None}


def test_a_thousand_labels(spark):
    rng = random.Random(13)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(1000)]
    df = spark.createDataFrame([(i, words[i % 1000] + " " + words[(7 * i) % 1000], f"l{i % 1000}", f"s{i % 3}") for i in range(10_000)],
                               "doc_id long, text string, lang string, source string")
    began = time.time()
    model = language_id.train(df)
    got = language_id.identify(language_id.document_rows(df), model).collect()
    assert len(model.languages) == 1000 and len(got) == 10_000 and time.time() - began < 60
    assert sum(r["lang"] == r["declared"] for r in got) > 9000


# --- 6 embeddings -----------------------------------------------------------------------------

def test_near_vectors(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "CELL", 16)
    monkeypatch.setattr(embedding_dedup, "TILE", 40)
    monkeypatch.setattr(embedding_dedup, "SAMPLE", 100)
    rng = np.random.default_rng(4)
    base = rng.normal(size=(25, 20))
    x = [*(b + rng.normal(size=20) * s for b in base for s in (0, 0.1, 0.2, 0.3)), *rng.normal(size=(100, 20))]
    x += [x[0], x[0] * 3, x[5]]
    odd = [None, [0.0] * 20, [float("nan")] * 20, [None] + [1.0] * 19, [float("inf")] * 20, [1.0] * 7, []]
    data = [(i, [float(np.float32(y)) for y in v], 0) for i, v in enumerate(x)] + [(1000 + i, v, 1) for i, v in enumerate(odd)]
    got = collected(embedding_dedup.near_vectors(spark.createDataFrame(data, "vec_id long, embedding array<float>, label int")), "vec_id")
    u = np.array([v for _, v, k in data if k == 0])
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    near = u @ u.T >= 0.95
    want = components(list(range(len(x))), lambda a, b: near[a, b])
    assert {i: got[i]["component_id"] for i in want} == want
    assert [got[i]["n_links"] for i in want] == (near.sum(axis=1) - 1).tolist() and near.sum() > 200
    assert all(got[1000 + i]["n_links"] == 0 and got[1000 + i]["kept"] for i in range(len(odd)))
    nothing = spark.createDataFrame([(1, None)], "vec_id long, embedding array<float>")
    assert embedding_dedup.near_vectors(nothing).collect()[0]["component_id"] == 1
    assert embedding_dedup.near_vectors(nothing.limit(0)).collect() == []


# --- 7 packing --------------------------------------------------------------------------------

def one_by_one(sizes, length):
    """Best fit of pieces in falling order: remaining room of each window."""
    room = []
    for s in sorted(sizes, reverse=True):
        fit = [(r, i) for i, r in enumerate(room) if r >= s]
        if fit:
            room[min(fit)[1]] -= s
        else:
            room.append(length - s)
    return sorted(room)


def test_best_fit_decreasing_places_as_one_by_one():
    rng = random.Random(8)
    for length in (1, 7, 64, 100):
        for _ in range(20):
            sizes = [rng.randint(1, length) for _ in range(rng.randint(0, 120))]
            used = defaultdict(list)
            for size, lo, count, first, offset, per in packing.best_fit_decreasing(Counter(sizes), length):
                for k in range(count):
                    used[first + k // per].append((offset + k % per * size, size))
            for own in used.values():
                assert [a for a, _ in sorted(own)] == np.cumsum([0, *(s for _, s in sorted(own))])[:-1].tolist()
            assert sorted(length - sum(s for _, s in own) for own in used.values()) == one_by_one(sizes, length)
            assert sorted(used) == list(range(len(used)))


def test_pack(docs, odd, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    cut = packing.pieces(docs, with_ids=True)
    packed = packing.pack(cut)
    got = packed.collect()
    for i, t in enumerate(odd):
        ids = slow.encode(t or "", add_special_tokens=False).ids + [0]
        own = sorted((r for r in got if r["doc_id"] == i), key=lambda r: r["start"])
        assert [x for r in own for x in r["ids"]] == ids and {r["doc_tokens"] for r in own} == {len(ids)}
        assert all(r["ids_crc32"] == zlib.crc32(np.array(r["ids"], dtype="<u4").tobytes()) and r["length"] == len(r["ids"]) for r in own)
    windows = defaultdict(list)
    for r in got:
        windows[r["sequence_id"]].append((r["offset"], r["ids"]))
    for own in windows.values():
        own.sort()
        assert [a for a, _ in own] == np.cumsum([0, *(len(x) for _, x in own)])[:-1].tolist()
    assert sorted(sum(len(x) for _, x in own) for own in windows.values())[:1] and max(sum(len(x) for _, x in own) for own in windows.values()) <= 1024
    full = collected(packing.sequences(packed), "sequence_id")
    for k, own in windows.items():
        ids = [x for _, part in own for x in part]
        size = len(ids) if len(ids).bit_count() == 1 else 1024
        assert full[k]["ids"] == ids + [0] * (size - len(ids))
    assert packing.pack(packing.pieces(empty)).collect() == []


# --- 8 mixing ---------------------------------------------------------------------------------

def test_targets():
    assert mixing.targets([10, 10, 10], [1, 2, 3]) == [5, 10, 15]
    out = mixing.targets([1, 100, 100], [1, 1, 1])
    assert out[0] == 3 and out[1] == out[2] == 99
    assert sum(mixing.targets([5, 0, 7, 90], [1, 2, 3, 1])) == pytest.approx(102)


def test_permutations():
    for n in (1, 2, 3, 5, 64, 1000, 4097):
        assert sorted(mixing.permuted(np.arange(n), n, 11).tolist()) == list(range(n))


def test_mix(spark, docs, odd, empty):
    rng = random.Random(6)
    texts = [*odd, *[prose(rng, rng.randrange(1, 400)) for _ in range(300)]]
    df = spark.createDataFrame(rows(texts), DOC)
    sizes, spans = mixing.mix(df, block=16)
    got = collected(mixing.taken(sizes, spans))
    again = collected(mixing.taken(*mixing.mix(df.repartition(3), block=16)))
    assert {i: r["taken"] for i, r in got.items()} == {i: r["taken"] for i, r in again.items()}
    source = {r[0]: r[3] for r in rows(texts)}
    order = sorted(set(source.values()), key=lambda s: (s is None, (s or "").encode()))
    n = {i: len(WORD.findall(t or "")) for i, t in enumerate(texts)}
    total = [sum(n[i] for i in n if source[i] == s) for s in order]
    want = dict(zip(order, mixing.targets(total, [1, 2, 3, 1])))
    for i, r in got.items():
        assert r["size"] == n[i] and r["source_size"] == total[order.index(source[i])] and r["target"] == pytest.approx(want[source[i]])
        assert r["taken"] <= 3 * n[i]
    for s in order:
        mine = sum(r["taken"] for i, r in got.items() if source[i] == s)
        assert abs(mine - want[s]) <= 32
    for r in spans.collect():
        assert 0 <= r["start"] and r["n_words"] > 0 and r["start"] + r["n_words"] <= n[r["doc_id"]]
    assert mixing.taken(*mixing.mix(empty)).collect() == []
    blank = spark.createDataFrame([(1, None, None), (1, None, None)], "doc_id long, text string, source string")
    assert [r["taken"] for r in mixing.taken(*mixing.mix(blank)).collect()] == [0, 0]


def test_mixed_documents(docs, odd):
    out = mixing.mixed_documents(docs, block=16)
    got = collected(out)
    taken = collected(mixing.taken(*mixing.mix(docs, block=16)))
    assert out.columns == docs.columns
    assert {i: len(WORD.findall(r["text"])) for i, r in got.items()} == {i: r["taken"] for i, r in taken.items() if r["taken"]}
    for i, r in got.items():
        assert set(WORD.findall(r["text"])) <= set(WORD.findall(odd[i])) and r["n_chars"] == len(r["text"])


# --- 9 chat -----------------------------------------------------------------------------------

def test_chat_round_trip(spark):
    texts = ["hi", "", None, "</s>", "<s>", "a</s><s>[INST] b", "\\", "\\l\\b", "</s", "s>", "\n</s>\n", "[INST]\\ x", "</s></s>", "<" * 5 + "\\</s>",
             "[/INST]", "say [INST] now [/INST] and <s>[SYS] x", "[ROLE=x]", "[ROLE=", "[[INST]]", "[INST", "\\o[", "x " * 40_000 + "[SYS]"]
    roles = ["user", "assistant", "system", None, "tool]</s>\\r", "", "[INST]", "<s>", "[ROLE=x]"]
    rng = random.Random(9)
    convs = {c: [(t, rng.choice(roles), rng.choice(texts)) for t in range(rng.randrange(1, 7))] for c in range(150)}
    data = [(c, t, r, x, "z") for c, own in convs.items() for t, r, x in own] + [(None, None, None, None, "z"), (777, 1, "user", "b", "z"), (777, 1, "user", "a", "z"), (777, None, "user", "n", "z"), (777, 1, "user", "a", "z")]
    out = chat.format_chat(spark.createDataFrame(data, "conv_id long, turn long, role string, text string, turns string")).collect()
    got = {r["conv_id"]: r for r in out}
    assert len(got) == 152
    for c, own in convs.items():
        assert [(t["role"], t["text"]) for t in got[c]["turns"]] == [(r or "", x or "") for _, r, x in own]
        assert [t["shown"] in got[c]["formatted"] for t in got[c]["turns"]]
    assert [t["text"] for t in got[777]["turns"]] == ["n", "a", "a", "b"] and len(got[None]["turns"]) == 1
    control = ["<s>", "</s>", "[INST]", "[/INST]", "[SYS]", "[ROLE="]
    code = lambda x: x.replace("\\", "\\b").replace("<", "\\l").replace("[", "\\o")
    mark = lambda r: {"user": "[INST]", "assistant": "[/INST]", "system": "[SYS]"}.get(r, "[ROLE=" + code(r).replace("]", "\\r") + "]")
    for c, own in convs.items():
        want = ""
        for _, r, x in own:
            x = x or ""
            want += "<s>" + mark(r or "") + ("\\" + code(x) if any(k in x for k in control) else " " + x) + "</s>"
        assert got[c]["formatted"] == want


def test_chat_empty_table(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.format_chat(none).collect() == []


# --- 10 exact dedup ---------------------------------------------------------------------------

def test_exact_dedup(spark, docs, odd, empty):
    got = collected(exact_dedup.exact_dedup(docs))
    norm = {i: re.sub("[\x20\x09-\x0d]+", " ", t or "") for i, t in enumerate(odd)}
    for i, t in norm.items():
        same = [k for k in norm if norm[k] == t]
        assert tuple(got[i]) == (i, min(same), len(same), i == min(same), hashlib.sha256(t.encode()).hexdigest())
    assert exact_dedup.exact_dedup(empty).collect() == []


def test_exact_dedup_spreads_a_hot_text(spark):
    hot = spark.range(3000).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN 'same  text' WHEN id % 3 = 1 THEN 'same text' ELSE concat('t', id) END AS text")
    found = exact_dedup.exact_dedup(hot).collect()
    assert {(r["keep_id"], r["group_size"]) for r in found if r["doc_id"] % 3 < 2} == {(0, 2000)}
    assert sum(r["kept"] for r in found) == 1001
    odd = spark.createDataFrame([(None, "a"), (None, "a"), (3, "a"), (3, "a"), (None, "b"), (None, "b")], "doc_id long, text string")
    kept = [(r["doc_id"], r["keep_id"], r["group_size"]) for r in exact_dedup.exact_dedup(odd).collect() if r["kept"]]
    assert sorted(kept, key=repr) == [(3, 3, 4), (None, None, 2)]


def test_large_ids_beside_nulls_stay_whole(spark):
    big = (1 << 62) + 1
    t = " ".join(f"w{i}" for i in range(20))
    df = spark.createDataFrame([(None, t), (big, t), (big + 2, t)], "doc_id long, text string").coalesce(1)
    for out in (substring_dedup.repeated_passages(df), simhash.simhash_groups(df), exact_dedup.exact_dedup(df), packing.pieces(df), lm_score.lm_score(df)):
        assert {r["doc_id"] for r in out.collect()} == {None, big, big + 2}
    assert [r["n_removed"] for r in substring_dedup.repeated_passages(df).orderBy("doc_id").collect()] == [0, 0, 20]


# --- pipeline ---------------------------------------------------------------------------------

def test_pipeline_stages(spark, docs, odd, empty, tmp_path):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "simhash_dedup", "mixing", "packing"]
    frame, kept = docs, []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, frame, SF)
        if k < 4:
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / str(k)))
        frame = spark.read.parquet(str(tmp_path / str(k)))
        kept.append({r["doc_id"] for r in frame.select("doc_id").collect()})
    norm = {}
    for i in sorted(kept[0]):
        norm.setdefault(re.sub("[\x20\x09-\x0d]+", " ", odd[i] or ""), i)
    assert kept[1] == set(norm.values())
    fp = {i: fingerprint(odd[i]) for i in kept[1]}
    want = components(sorted(fp), lambda a, b: (fp[a] ^ fp[b]).bit_count() <= 2)
    assert kept[2] == set(want.values())
    assert kept[3] == kept[4] == {r["doc_id"] for r in spark.read.parquet(str(tmp_path / "3")).collect()} and kept[3] <= kept[2]
    frame = empty
    for _, stage in corpus_pipeline.STAGES:
        frame = stage(spark, frame, SF)
    assert frame.collect() == []


@tables
def test_pipeline_runs(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] and out.count() > 100


def five_words(t):
    w = (t or "").encode().lower().split()
    return {b" ".join(w[i:i + 5]) for i in range(max(1, len(w) - 4))}


def test_near_groups_are_those_of_brute_force(spark, monkeypatch):
    """Pairs around a similarity of 0.8, nulls and repeated ids; most of the near pairs lie beyond two bits."""
    monkeypatch.setattr(shingle_dedup, "SAMPLED", 1)
    rng = random.Random(11)
    base = [prose(rng, 1).join(["", " "]) + " ".join(f"w{rng.randrange(500)}" for _ in range(rng.randrange(3, 150))) for _ in range(40)]
    line = " ".join(f"line{i}" for i in range(25))
    texts = [None, "", "a b", "A b", *base]
    for t in base:
        for _ in range(6):
            w = t.split()
            for _ in range(rng.randrange(0, 2 + len(w) // 40)):
                w[rng.randrange(len(w))] = f"x{rng.randrange(9)}"
            texts.append(" ".join(w) + (" " + line if rng.random() < 0.3 else ""))
    ids = [None if rng.random() < 0.1 else rng.randrange(250) for _ in texts]
    df = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string").repartition(4)
    own = [five_words(t) for t in texts]
    linked = lambda a, b: 5 * len(own[a] & own[b]) >= 4 * len(own[a] | own[b])
    group = components(list(range(len(texts))), linked)
    low = {}
    for i, g in group.items():
        low[g] = min([x for x in (low.get(g), ids[i]) if x is not None], default=None)
    got = shingle_dedup.near_groups(df).collect()
    digest = [hashlib.sha256((t or "").encode()).hexdigest()[:32] for t in texts]
    assert Counter((r["doc_id"], r["digest"], r["component_id"]) for r in got) == Counter((ids[i], digest[i], low[group[i]]) for i in group)
    assert sum(r["kept"] for r in got) == len(low)
    assert Counter(r["doc_id"] for r in got if r["kept"]) == Counter(low.values())
    near = [(a, b) for a in range(len(texts)) for b in range(a) if linked(a, b)]
    assert sum((fingerprint(texts[a]) ^ fingerprint(texts[b])).bit_count() > 2 for a, b in near) > len(near) / 10
    out = corpus_pipeline.near(spark, df.selectExpr("doc_id", "text", "'en' AS lang", "'s' AS source", "1L AS n_chars"), SF).collect()
    assert Counter((r["doc_id"]) for r in out) == Counter(low.values())


def test_rare_languages_are_known_beside_any_number_of_others(spark):
    """Five labelled documents count beside 6,000 as beside 60; junk is still of no language."""
    rng = random.Random(8)
    greek = ["το νερό και η στάθμη της θάλασσας ", "η θύελλα και το κύμα στο λιμάνι ", "ο άνεμος και η στάθμη του νερού "]
    rare = [(i, rng.choice(greek) * 5, "el", "s") for i in range(5)]
    junk = [(-1, "".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(200)), None, "s")]
    for n in (60, 6000):
        common = [(10 + i, prose(rng, 30), "en", "s") for i in range(n)]
        df = spark.createDataFrame(rare + common + junk, "doc_id long, text string, lang string, source string")
        model = language_id.train(df)
        assert model.languages == ["el", "en"]
        got = collected(language_id.identify(language_id.document_rows(df), model), "id")
        assert [got[i]["lang"] for i in range(5)] == ["el"] * 5 and got[-1]["rejected"]
        assert sum(got[10 + i]["lang"] == "en" for i in range(n)) == n
        assert {r["doc_id"] for r in corpus_pipeline.languages(spark, df, SF).collect()} == set(got) - {-1}
    blank = spark.createDataFrame([(1, "12", "xx", "s"), (2, "water level", "en", "s")], df.schema)
    assert language_id.train(blank).languages == ["en"]


def odd_ids():
    """Rows (doc_id, text, lang, source): null, repeated and clashing doc_ids, null texts."""
    rng = random.Random(21)
    out = [(i, prose(rng, rng.randrange(30, 90)), "en", f"s{i % 2}") for i in range(40)]
    out += [(None, prose(rng, 40 + i), "en", f"s{i % 2}") for i in range(20)]
    out += [out[0], out[1], out[1], out[45], out[45]]  # rows that repeat, two of them without an id
    out += [(7, out[3][1], "en", "s0"), (8, None, "en", "s1"), (9, "a short one", "en", "s1"), (None, None, "en", "s0"), (None, out[5][1], "en", "s0")]
    return out


def test_mixed_rows_have_their_own_words(spark):
    data = odd_ids()
    df = spark.createDataFrame([(*r, len(r[1] or "")) for r in data], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    got = mixing.mixed_documents(df, block=8).collect()
    count = lambda t: len(WORD.findall(t or ""))
    owned = defaultdict(list)
    for i, t, _, s in data:
        owned[i, s].append(t or "")
    for r in got:
        words, lines = WORD.findall(r["text"]), r["text"].split("\n")
        fits = [t for t in owned[r["doc_id"], r["source"]] if all(x in t for x in lines) and len(words) <= 3 * count(t)]
        assert fits and r["n_chars"] == len(r["text"])
    sources = ["s0", "s1"]
    total = [sum(count(t) for _, t, _, s in data if s == x) for x in sources]
    for x, want in zip(sources, mixing.targets(total, [1, 2])):
        assert abs(sum(count(r["text"]) for r in got if r["source"] == x) - want) <= 16
    assert any(r["doc_id"] is None for r in got)
    again = mixing.mixed_documents(df.repartition(7), block=8).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))


def test_rows_are_decided_on_one_by_one(spark):
    """Each filtering stage against a plain version that numbers the rows."""
    data = odd_ids() + [(11, "\u4e2d\u6587\u5b57\u5178" * 40, None, "s0"), (None, "\u7535\u8111\u6c34\u706b" * 40, None, "s0")]
    df = spark.createDataFrame([(*r, 1) for r in data], "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    plain = lambda frame: Counter((r["doc_id"], r["text"], r["lang"], r["source"]) for r in frame.collect())
    known = corpus_pipeline.languages(spark, df, SF)
    assert plain(known) == Counter(r for r in data if not (r[1] or "").startswith(("\u4e2d", "\u7535")))
    order = lambda r: (r[0] is None, r[0] or 0)
    first = {}
    for r in sorted(data, key=order):
        first.setdefault(re.sub("[\x20\x09-\x0d]+", " ", r[1] or ""), r)
    got = plain(corpus_pipeline.exact(spark, df, SF))
    assert Counter((i, t) for i, t, _, _ in got.elements()) == Counter((i, t) for i, t, _, _ in first.values())
    own = [five_words(r[1]) for r in data]
    group = components(list(range(len(data))), lambda a, b: 5 * len(own[a] & own[b]) >= 4 * len(own[a] | own[b]))
    kept = {}
    for k in sorted(range(len(data)), key=lambda k: order(data[k])):
        kept.setdefault(group[k], data[k])
    got = plain(corpus_pipeline.near(spark, df, SF))
    assert Counter(i for i, *_ in got.elements()) == Counter(r[0] for r in kept.values())
    assert Counter(t or "" for _, t, *_ in got.elements()) == Counter(r[1] or "" for r in kept.values())
