"""Suffix sorting, whitening and conversation repair against brute force."""

import hashlib
import heapq
import random
import zlib

import numpy as np
import pytest

from tidemark.llm import conversation_repair, suffix_dedup, suffix_sort, whitening

#: Names that operators use inside stand as extra columns.
DOC = "doc_id long, text string, batch long, bucket long, known boolean, id long, packed string, shard long"
EXTRA = (1, 2, True, 3, "p", 4)


# --- 11 embedding whitening -------------------------------------------------------------------

def test_minres_and_jacobi_davidson():
    rng = np.random.default_rng(3)
    for dims, wanted in ((1, 3), (6, 6), (40, 5), (200, 12)):
        q = np.linalg.qr(rng.standard_normal((dims, dims)))[0]
        for e in (np.sort(rng.random(dims))[::-1], 0.7 ** np.arange(dims), np.r_[np.ones((dims + 1) // 2), np.zeros(dims // 2)], np.full(dims, 1e8)):
            a, calls = (q * e) @ q.T, []

            def product(w):
                calls.append(w.shape[1])
                return a @ w
            values, vectors, residuals = whitening.jacobi_davidson(product, dims, wanted)
            k = min(dims, wanted)
            assert np.allclose(values, e[:k], rtol=0, atol=1e-12 * e[0]) and len(values) == k
            assert np.abs(vectors.T @ vectors - np.eye(k)).max() < 1e-12
            assert np.linalg.norm(a @ vectors - vectors * values, axis=0).max() < 1e-11 * e[0] and len(calls) < 60 * k
        shifted = a - 0.3 * np.eye(dims)
        rhs = rng.standard_normal((dims, 2))
        x = whitening.minres(lambda t: shifted @ t, rhs, 5 * dims, 1e-13)
        assert np.allclose(shifted @ x, rhs, atol=1e-6)


VECTOR = "vec_id long, embedding array<float>, id long, x binary, dims int, component int, n long"


def vectors(rng, n, dims):
    scale = 1.5 ** -np.arange(dims)
    return [(i, (rng.standard_normal(dims) * scale * 3 + 40).astype(np.float32).tolist()) for i in range(n)]


def test_whitening(spark):
    rng = np.random.default_rng(4)
    good = vectors(rng, 700, 12)
    good += [good[3], (None, good[5][1]), (3, good[9][1])]
    bad = [(900, None), (901, []), (902, [1.0, None] * 6), (903, [float("nan")] * 12), (904, [float("inf")] + [0.0] * 11), (905, [1.0] * 5), (906, [1e30] * 12)]
    df = spark.createDataFrame([(*r, 1, b"x", 2, 3, 4) for r in good + bad], VECTOR).repartition(6)
    for k in (5, 32):
        got = whitening.whiten(df, components=k).collect()
        k = min(k, 12)
        x = np.array([[int(np.floor(64 * float(np.float32(c)))) + 1_000_000 for c in v] for _, v in good], dtype=object)
        n, total = len(x), x.sum(axis=0)
        far = [int(v) for v in ((n * x - total) ** 2).sum(axis=1)]
        d = (n * x - total).astype(float) / n
        e, u = np.linalg.eigh(d.T @ d / n)
        e, u = e[::-1][:k], u[:, ::-1][:, :k]
        z = d @ u / np.sqrt(e)
        assert len(got) == n * k and {r.n for r in got} == {n}
        assert sorted((r.vec_id is None, r.vec_id or 0, r.deviation, r.component) for r in got) == sorted(
            (i is None, i or 0, f, c + 1) for (i, _), f in zip(good, far) for c in range(k))
        assert max(abs(r.explained - e[r.component - 1] / (d ** 2).sum() * n) for r in got) < 1e-10
        for c in range(k):
            own = sorted(abs(r.whitened) for r in got if r.component == c + 1)
            assert np.allclose(own, np.sort(np.abs(z[:, c])), atol=1e-7)
        assert {r.identity_error for r in got} == {got[0].identity_error} and got[0].identity_error < 1e-9


def test_whitening_edges(spark):
    frame = lambda rows: spark.createDataFrame([(*r, 1, b"x", 2, 3, 4) for r in rows], VECTOR)
    assert whitening.whiten(frame([])).count() == 0 and whitening.whiten(frame([(1, None)])).count() == 0
    assert whitening.whiten(frame([(i, [1.5, 2.0]) for i in range(9)])).count() == 0
    flat = whitening.whiten(frame([(i, [float(i), 2.0 * i, 7.0]) for i in range(9)])).collect()  # one direction
    assert {r.component for r in flat} == {1} and len(flat) == 9 and abs(flat[0].explained - 1) < 1e-12
    far = whitening.whiten(frame([(i, [1e12 * i, 1.0 * i * i]) for i in range(3)])).collect()
    assert len(far) == 3 and all(r.deviation is None for r in far if r.vec_id != 1) and all(abs(r.whitened) < 3 for r in far)
    two = whitening.whiten(frame([(1, [1.0, 2.0]), (2, [1.0, 2.0, 3.0]), (3, [2.0, 2.0, 9.0]), (4, [0.0, 1.0])])).collect()
    assert {r.vec_id for r in two} == {2, 3}


# --- 12 suffix-array dedup --------------------------------------------------------------------

def test_deep_shallow_order():
    rng = np.random.default_rng(0)
    letters = lambda n: bytes(rng.integers(97, 99, n, dtype=np.uint8))
    data = letters(3000) + b"a" * 500 + letters(300) * 3 + bytes(range(256))
    for length in (1, 7, 33, 100):
        start = np.arange(len(data) - length + 1)
        bucket = rng.integers(0, 3, len(start))
        order, head = suffix_sort.sorted_suffixes(data, start, bucket, length)
        keys = [(bucket[i], data[i:i + length]) for i in order]
        assert sorted(order.tolist()) == start.tolist() and keys == sorted(keys)
        assert head.tolist() == [i == 0 or keys[i] != keys[i - 1] for i in range(len(keys))]


def test_blind_trie_leaves():
    rng = random.Random(4)
    texts = [bytes(rng.choice(b"\x00a\xff") for _ in range(12)) for _ in range(300)] + [b"\x00" * 12, b"\xff" * 12] * 2
    leaves = list(suffix_sort.BlindTrie(texts).leaves())
    assert [[texts[k] for k in leaf] for leaf in leaves] == [[t] * texts.count(t) for t in sorted(set(texts))]


def repeated(texts, width=100):
    """First places of all strings, one after the other."""
    first, out = {}, []
    for _, t in texts:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - width + 1):
            w = b[s:s + width]
            if w in first:
                gone[s:s + width] = b"\1" * width
            first.setdefault(w, s)
        spans = sum(1 for k in range(len(gone)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return out


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(1)
    prose = lambda n: " ".join(rng.choice(["the", "of", "storm", "water", "Été", "straße", "in"]) for _ in range(n))
    passage, long_text = prose(60), prose(9000)
    out = [None, "", " ", "a" * 99, "a" * 100, "a" * 300, passage, prose(20) + passage + prose(20), passage + passage, long_text, long_text + "x",
           "y" + long_text[:5000] + "z" + long_text[5000:], "\U0001f600" * 60]
    out += [prose(rng.randrange(5, 300)) for _ in range(40)] + ["head " + prose(3) + passage[:150] + prose(rng.randrange(9)) for _ in range(30)]
    return out + [out[20], out[21] + "!"]


@pytest.mark.parametrize("hot", [1000, 1])
def test_repeated_strings(spark, texts, hot, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    monkeypatch.setattr(suffix_dedup, "BUNDLE_BYTES", 20_000)
    monkeypatch.setattr(suffix_dedup, "SHARD_BYTES", 100_000)
    docs = spark.createDataFrame([(i, t, *EXTRA) for i, t in enumerate(texts)], DOC).repartition(5)
    got = {r.doc_id: r for r in suffix_dedup.repeated_strings(docs, with_text=True).collect()}
    want = repeated(enumerate(texts))
    assert [(got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) for i in range(len(texts))] == want
    assert sum(w[1] for w in want) > 60_000
    for i, t in enumerate(texts):
        data, at, kept = (t or "").encode(), 0, b""
        for run in got[i].removed:
            kept, at = kept + data[at:run.start], run.start + run.n
        assert kept + data[at:] == bytes(got[i].kept) and len(got[i].removed) == got[i].n_spans


def test_repeated_strings_ids(spark):
    """Null ids stay out; rows that share an id are one document; no rows give no rows."""
    text = "".join(chr(97 + i % 26) + str(i) for i in range(60))
    rows = [(None, text, *EXTRA), (None, text, *EXTRA), (5, text, *EXTRA), (5, text, *EXTRA), (5, "ab" + text, *EXTRA), (9, text, *EXTRA)]
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed) for r in suffix_dedup.repeated_strings(spark.createDataFrame(rows, DOC)).collect()), key=repr)
    n = len(text)
    assert got == sorted([(None, n, 0), (None, n, 0), (5, n, 0), (5, n, 0), (5, n + 2, n), (9, n, n)], key=repr)
    none = suffix_dedup.repeated_strings(spark.createDataFrame([], DOC))
    assert none.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed"] and none.count() == 0


def test_hash_slices(monkeypatch):
    """Runs that a slice cuts still hold every window once, under the anchor that a scan of the window gives."""
    rng = np.random.default_rng(5)
    sizes = np.array([0, 50, 400, 99, 100, 700, 3])
    data = bytes(rng.integers(97, 100, sizes.sum(), dtype=np.uint8))
    ends = np.cumsum(sizes)
    windows = [s for n, e in zip(sizes, ends) for s in range(e - n, e - 99)]
    for width in (1 << 19, 128):
        monkeypatch.setattr(suffix_dedup, "SLICE", width)
        anchor, place, start, n = suffix_dedup.anchors(data, sizes)
        assert [s + k for s, m in zip(start, n) for k in range(m)] == windows
        assert all(a <= p and p + 32 <= a + m + 99 for a, p, m in zip(start, place, n))
        assert len({(int(a), data[p:p + 32]) for a, p in zip(anchor, place)}) == len(set(anchor.tolist()))


# --- 13 conversation repair -------------------------------------------------------------------

def cheapest(rows):
    """(cost, audit, repaired lines, faults) of ordered (role, text): best-first search over whole edit lists."""
    seen, faults = set(), []
    for row in rows:
        body = row[1].strip(" \t\n\x0b\x0c\r")
        faults.append(1 if not body else 2 if row in seen else 0 if body[-1] in ".!?" else 3)
        seen.add(row)
    heap, best = [(0, "", 0, 0, ())], {}
    while heap:
        cost, audit, i, state, out = heapq.heappop(heap)
        if (i, state) in best and best[i, state] <= (cost, audit):
            continue
        best[i, state] = cost, audit, out
        to, name = (3, "assistant") if state == 2 else (2, "user")
        heapq.heappush(heap, (cost + 2, audit + "I", i, to, (*out, name + ":")))
        if i == len(rows):
            continue
        heapq.heappush(heap, (cost + 3, audit + "D", i + 1, state, out))
        role, text = rows[i]
        if faults[i] in (0, 3):
            cost += faults[i] == 3
            heapq.heappush(heap, (cost + 2, audit + "R", i + 1, to, (*out, f"{name}:{text}")))
            kept = 1 if role[:1] == "s" and state == 0 else to if role[:1] == name[0] else None
            if kept:
                heapq.heappush(heap, (cost, audit + "K", i + 1, kept, (*out, f"{role}:{text}")))
    return *min(best[len(rows), s] for s in (0, 3) if (len(rows), s) in best), faults


@pytest.mark.parametrize("modulus, nodes", [(conversation_repair.MODULUS, 1 << 14), (3, 1 << 14), (conversation_repair.MODULUS, 10), (7, 20)])
def test_repair_is_cheapest(modulus, nodes):
    """Also with hashes that meet, and with shared prefixes written out early."""
    rng = random.Random(2)
    for _ in range(250):
        rows = [(rng.choice(["user", "assistant", "system", "tool", "u2", ""]), rng.choice(["a.", "b", "", "c!", "d"])) for _ in range(rng.randrange(14))]
        cost, audit, lines, faults = cheapest(rows)
        work = conversation_repair.Repair(modulus, nodes)
        for (role, text), fault in zip(rows, faults):
            work.row(role, text, fault)
        assert work.result() == (cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


CHAT = "conv_id long, turn long, role string, text string, conv string, number long, fault int, n long"


def test_repair_rows(spark):
    """Nulls, ties, repeated rows, a long conversation, a very long text, clashing columns; and what the audits make of the rows."""
    rng = random.Random(6)
    rows = []
    for c in [*range(60), None]:
        for i in range(rng.randrange(1, 9)):
            rows.append((c, rng.choice([i, i, i, i + 3, None]), rng.choice(["user", "assistant", "user", "system", None, "tool"]),
                         rng.choice(["Yes.", "no", " ", None, "", "Ok!\n", "Été? \u00a0", "a.\x0b"])))
        rows += rows[-1:] * rng.randrange(2)
    rows += [(100, i, rng.choice(["user", "assistant"]), f"line {i}.") for i in range(3000)] + [(101, 0, "user", "x. " * 300_000)]
    df = spark.createDataFrame([(*r, "c", 1, 9, 2) for r in rows], CHAT).repartition(7)
    got = {r.conv_id: r for r in conversation_repair.repair(df).collect()}
    made = {}
    judged = conversation_repair.repair(df)
    for r in conversation_repair.repaired_rows(df, judged).collect():
        made.setdefault(r.conv_id, {})[r.turn] = f"{r.role}:{r.text}"
    assert set(got) == {r[0] for r in rows}
    for c in got:
        own = sorted(((t is not None, t or 0, r or "", x or "") for k, t, r, x in rows if k == c), key=lambda v: (v[0], v[1], v[2].encode(), v[3].encode()))
        cost, audit, lines, faults = cheapest([v[2:] for v in own])
        turns = [v[1] for v in own if v[0]]
        initials = [v[2][:1] for v in own]
        assert (got[c].cost, got[c].audit) == (cost, audit)
        assert got[c].repaired_sha256 == hashlib.sha256("\n".join(lines).encode()).hexdigest()
        assert [got[c].blank, got[c].duplicate, got[c].truncated] == [faults.count(k) for k in (1, 2, 3)]
        assert got[c].gaps == (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0)
        assert got[c].illegal == sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        assert [made.get(c, {})[k] for k in range(len(made.get(c, {})))] == list(lines)
    none = conversation_repair.repair(spark.createDataFrame([], CHAT))
    assert none.columns[:2] == ["conv_id", "gaps"] and none.count() == 0


def test_damage(spark):
    rows = [(c, t, "assistant", "A. b! c?") for c in (None, 1, 2, 3) for t in (None, *range(25))] + [(7, 0, None, None)]
    want = []
    for c, t, role, text in rows:
        role, text = role or " ", text or " "
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        row = (c, t, "user" if kind == 4 else role, {1: "", 2: "A b c" if text != " " else " "}.get(kind, text))
        want += [row] * (0 if kind == 0 else 2 if kind == 3 else 1)
    got = [tuple(r) for r in conversation_repair.damaged(spark.createDataFrame([(*r, "c", 1, 9, 2) for r in rows], CHAT)).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr) and len(set(got)) < len(got)
