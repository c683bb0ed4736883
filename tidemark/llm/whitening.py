"""Whitening by principal components from a matrix-free Jacobi-Davidson solver (operator 11)."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import shared_folder

#: An entry c becomes floor(SCALE * c) + SHIFT; entries whose number would not fit a long are out of RANGE.
SCALE, SHIFT, RANGE = 64, 1_000_000, 1 << 62
COMPONENTS = 32
#: Entries in a stored block; partial products that are added by the driver at most, else by tasks first.
ENTRIES, PARTS = 1 << 20, 64
#: Ritz pairs corrected at a time; Krylov steps of a correction; passes without progress before a residual counts as rounding.
TARGETS, STEPS, STALLED = 16, 6, 3
EPS = float(np.finfo(np.float64).eps)


def _orthonormal(x: np.ndarray, *against: np.ndarray) -> np.ndarray:
    """Columns of x orthonormal and orthogonal to the others; what lies in their span goes."""
    for _ in range(3):
        for q in against:
            x = x - q @ (q.T @ x)
        size = np.linalg.norm(x, axis=0)
        x = x[:, size > 0] / size[size > 0]
        u, s, _ = np.linalg.svd(x, full_matrices=False)
        x = u[:, s > 1e-10]
    return x


def minres(apply: Callable[[np.ndarray], np.ndarray], rhs: np.ndarray, steps: int, tolerance: float) -> np.ndarray:
    """Minimum residual solutions of a symmetric system, which may be indefinite, for each column of rhs; a step is one apply."""
    def over(a, b):
        return np.divide(a, b, out=np.zeros(np.broadcast_shapes(np.shape(a), np.shape(b))), where=b != 0)

    beta = np.linalg.norm(rhs, axis=0)
    x, v, v_old = np.zeros_like(rhs), over(rhs, beta), np.zeros_like(rhs)
    w, w_old, eta, first = np.zeros_like(rhs), np.zeros_like(rhs), beta.copy(), beta.copy()
    c = c_old = np.ones(rhs.shape[1])
    s = s_old = np.zeros(rhs.shape[1])
    for _ in range(steps):
        z = apply(v)
        alpha = (v * z).sum(axis=0)
        z = z - alpha * v - beta * v_old
        nextb = np.linalg.norm(z, axis=0)
        here = c * alpha - c_old * s * beta
        length = np.hypot(here, nextb)
        w, w_old = over(v - s_old * beta * w_old - (s * alpha + c_old * c * beta) * w, length), w
        c, c_old, s, s_old = over(here, length), c, over(nextb, length), s
        x = x + c * eta * w
        eta = -s * eta
        v, v_old, beta = over(z, nextb), v, nextb
        if (np.abs(eta) <= tolerance * first).all():
            break
    return x


def jacobi_davidson(product: Callable[[np.ndarray], np.ndarray], dims: int, wanted: int, seed: int = 11) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(values, vectors, residuals): the largest eigenvalues of a symmetric positive semidefinite operator, falling.

    The operator is known by ``product`` alone. Rayleigh-Ritz in a subspace gives Ritz pairs; the leading ones are locked once
    their residuals reach double precision. The correction equations of the next ones, projected off all locked and wanted
    Ritz vectors, are solved by some steps of MINRES together, and their solutions extend the subspace. A subspace that
    grows too large starts again from its leading Ritz vectors.
    """
    rng, wanted = np.random.default_rng(seed), min(wanted, dims)
    locked, values, residuals = np.zeros((dims, 0)), [], []
    basis = _orthonormal(rng.standard_normal((dims, min(dims, wanted + 8))))
    image = product(basis)
    best, stalled, turn = np.inf, 0, 0
    while True:
        h = basis.T @ image
        theta, s = np.linalg.eigh((h + h.T) / 2)
        theta, s = theta[::-1], s[:, ::-1]
        basis, image = basis @ s, image @ s
        missing = wanted - len(values)
        residual = image[:, :missing] - basis[:, :missing] * theta[:missing]
        size = np.linalg.norm(residual, axis=0)
        scale = max([theta[0], *values[:1], np.finfo(np.float64).tiny])
        # Rounding of the products bounds what residuals can reach; no progress near that bound means it is reached.
        stalled = 0 if size[0] < best / 2 else stalled + 1
        best = min(best, size[0])
        bound = dims * EPS * scale * (1 if stalled < STALLED else 1000)
        done = int(np.argmax(np.append(size > bound, True)))
        if done:
            locked, values, residuals = np.hstack([locked, basis[:, :done]]), values + theta[:done].tolist(), residuals + size[:done].tolist()
            basis, image, residual, theta = basis[:, done:], image[:, done:], residual[:, done:], theta[done:]
            best, stalled = np.inf, 0
        missing = wanted - len(values)
        if not missing:
            return np.array(values), locked, np.array(residuals)
        if turn > 50 * wanted:
            raise ArithmeticError(f"{missing} residuals stay above double precision: {size[done:done + 3]}")
        turn += 1
        n = min(missing, TARGETS)
        fixed = np.hstack([locked, basis[:, :missing]])
        shift = theta[:n]

        def projected(t: np.ndarray) -> np.ndarray:
            t = product(t) - t * shift
            return t - fixed @ (fixed.T @ t)
        found = minres(projected, -(residual[:, :n] - fixed @ (fixed.T @ residual[:, :n])), STEPS, 0.5 ** turn)
        if basis.shape[1] + n > 3 * wanted:
            basis, image = basis[:, :missing + 8], image[:, :missing + 8]
        new = _orthonormal(found, locked, basis)
        if not new.shape[1]:  # the corrections lie in the subspace already: go on in a direction of its complement, if it has any
            new = _orthonormal(rng.standard_normal((dims, 1)), locked, basis)
        if locked.shape[1] + basis.shape[1] + new.shape[1] <= dims and new.shape[1]:
            basis, image = np.hstack([basis, new]), np.hstack([image, product(new)])
        else:
            stalled = STALLED


@dataclass
class Whitening:
    """n vectors of integers with sums S; components (dims x k), their variances, and the variance of all dimensions."""
    n: int
    sums: list[int]
    components: np.ndarray
    variances: np.ndarray
    total: float = 0.0
    identity_error: float = 0.0


def _exact(x: np.ndarray) -> list[int]:
    """Sums of the columns of 64-bit numbers, as Python's."""
    high, low = x >> 32, x & 0xFFFFFFFF
    return [(int(a) << 32) + int(b) for a, b in zip(high.sum(axis=0), low.sum(axis=0))]


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S, exact: 64-bit numbers where all fit, else Python's."""
    top = n * int(np.abs(x).max(initial=0)) + max((abs(s) for s in sums), default=0)
    if top < 1 << 62:
        return x * n - np.array(sums, dtype=np.int64)
    return x.astype(object) * n - np.array(sums, dtype=object)


def _squares(d: np.ndarray) -> list[int]:
    if d.dtype == object or d.shape[1] * int(np.abs(d).max(initial=0)) ** 2 >= 1 << 63:
        d = d.astype(object)
    return [int(v) for v in (d * d).sum(axis=1)]


def _numbers(block) -> np.ndarray:
    return np.frombuffer(block["x"], dtype=f"<i{block['width']}").reshape(-1, block["dims"]).astype(np.int64)


def integer_blocks(vectors: DataFrame, column: str, name: str) -> DataFrame:
    """(ids, dims, width, x): the vectors that count as rows of integers, many in one row, in the shared folder.

    Null vectors and those with null, non-finite or out-of-range entries do not count, nor those of another length than most
    (of two lengths, the greater).
    """
    spark = vectors.sparkSession
    v = F.col("_v")
    fine = F.forall(v, lambda x: x.isNotNull() & (F.abs(x) < RANGE / SCALE))  # NaN is greater than all
    rows = vectors.select(F.col(name).cast("string").alias("_id"), F.col(column).cast("array<double>").alias("_v"))
    rows = rows.where(v.isNotNull() & fine & (F.size(v) > 0))
    sizes = rows.groupBy(F.size(v).alias("dims")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("dims")).first()
    dims = sizes["dims"] if sizes else 0
    at = f"{shared_folder(spark)}/whitening-{uuid.uuid4().hex}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("_id").to_pylist()
            x = np.floor(batch.column("_v").flatten().to_numpy(zero_copy_only=False) * SCALE).reshape(-1, dims).astype(np.int64) + SHIFT
            step = max(1, ENTRIES // dims)
            for lo in range(0, len(ids), step):
                own = x[lo:lo + step]
                width = next(w for w in (4, 8) if w == 8 or np.abs(own).max() < 1 << 31)
                yield pa.RecordBatch.from_pydict({"ids": [ids[lo:lo + step]], "dims": [dims], "width": [width], "x": [own.astype(f"<i{width}").tobytes()]},
                                                 schema=pa.schema([("ids", pa.list_(pa.string())), ("dims", pa.int32()), ("width", pa.int32()), ("x", pa.binary())]))

    rows.where(F.size(v) == dims).mapInArrow(run, "ids array<string>, dims int, width int, x binary").write.parquet(at)
    return spark.read.parquet(at)


def _summed(blocks: DataFrame, part: Callable[[np.ndarray], np.ndarray], shape: tuple[int, ...]) -> np.ndarray:
    """Sum of part(integers) over all blocks: by task, then in the order of tasks, so that reruns agree."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for batch in batches:
            for block in batch.to_pylist():
                total += part(_numbers(block))
        yield pa.RecordBatch.from_pydict({"task": [TaskContext.get().partitionId()], "y": [total.tobytes()]},
                                         schema=pa.schema([("task", pa.int64()), ("y", pa.binary())]))

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("task")
        y = np.sum([np.frombuffer(b) for b in pdf["y"]], axis=0)
        return pd.DataFrame({"task": pdf["task"].iloc[:1], "y": [y.tobytes()]})

    read = blocks.select("dims", "width", "x")
    rows = read.mapInArrow(run, "task long, y binary")
    if len(read.inputFiles()) > PARTS:
        rows = rows.groupBy(F.pmod("task", F.lit(PARTS))).applyInPandas(add, "task long, y binary")
    got = sorted((r["task"], r["y"]) for r in rows.collect())
    return np.sum([np.frombuffer(y).reshape(shape) for _, y in got], axis=0) if got else np.zeros(shape)


def fit(blocks: DataFrame, components: int = COMPONENTS) -> Whitening:
    """Components of all vectors of the blocks. Directions without variance (to rounding) are no components."""
    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in batch.to_pylist():
                x = _numbers(block)
                yield pa.RecordBatch.from_pydict({"dim": list(range(x.shape[1])), "s": [str(v) for v in _exact(x)], "n": [len(x)] * x.shape[1]})

    rows = (blocks.select("dims", "width", "x").mapInArrow(sums, "dim long, s string, n long").groupBy("dim")
            .agg(F.sum(F.col("s").cast("decimal(38,0)")).cast("string").alias("s"), F.sum("n").alias("n")).orderBy("dim").collect())
    total, n, dims = [int(r["s"]) for r in rows], rows[0]["n"] if rows else 0, len(rows)
    if not n:
        return Whitening(0, [], np.zeros((0, 0)), np.zeros(0))

    def product(w: np.ndarray) -> np.ndarray:
        def part(x: np.ndarray) -> np.ndarray:
            d = _deviations(x, n, total).astype(np.float64) / n
            return d.T @ (d @ w)
        return _summed(blocks, part, w.shape) / n

    values, vectors, _ = jacobi_davidson(product, dims, components)
    some = values > 4 * dims * EPS * max(values[0], 0)
    values, vectors = values[some], vectors[:, some]
    vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])])
    model = Whitening(n, total, vectors, values)
    model.total = float(_summed(blocks, lambda x: np.array([float(sum(_squares(_deviations(x, n, total))))]), (1,))[0]) / n ** 3
    k = len(values)
    if k:
        mean = _summed(blocks, lambda x: project(model, x).sum(axis=0), (k,)) / n

        def outer(x: np.ndarray) -> np.ndarray:
            z = project(model, x) - mean
            return z.T @ z
        model.identity_error = float(np.abs(_summed(blocks, outer, (k, k)) / n - np.eye(k)).max())
    return model


def project(model: Whitening, x: np.ndarray) -> np.ndarray:
    d = _deviations(x, model.n, model.sums).astype(np.float64) / model.n
    return d @ model.components / np.sqrt(model.variances)


def whitened(blocks: DataFrame, model: Whitening) -> DataFrame:
    """(id, deviation, whitened): one row for each vector; whitened holds its components. A deviation that no long holds is null."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in batch.to_pylist():
                x = _numbers(block)
                far = _squares(_deviations(x, model.n, model.sums))
                yield pa.RecordBatch.from_pydict({"id": pa.array(block["ids"], pa.string()), "deviation": pa.array([v if v < 1 << 63 else None for v in far], pa.int64()),
                                                  "whitened": pa.array(list(project(model, x)), pa.list_(pa.float64()))})
    return blocks.mapInArrow(run, "id string, deviation long, whitened array<double>")


def whiten(vectors: DataFrame, column: str = "embedding", name: str = "vec_id", components: int = COMPONENTS) -> DataFrame:
    """(name, component, n, deviation, whitened, explained, identity_error), a row for each vector that counts and component.

    Entries become integers, and everything is centred exactly before it is multiplied: n * x - S in whole numbers. The
    covariance is never formed: each product with a few columns is one pass over the stored vectors, which adds up by task.
    What reaches the driver are sums by dimension and products of dims x TARGETS entries, however many vectors there are.

    Null, empty, non-finite or out-of-range vectors, and those of another length than most, give no rows. A null or repeated id
    is kept as it is. Without vectors, or with equal ones only, there are no components and no rows. Further columns are not
    looked at.
    """
    blocks = integer_blocks(vectors, column, name)
    model = fit(blocks, components)
    share = F.array(*[F.lit(float(e / model.total)) for e in model.variances]) if len(model.variances) else F.lit(None).cast("array<double>")
    out = whitened(blocks, model).select("id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return out.select(F.col("id").cast(vectors.schema[name].dataType).alias(name), (F.col("at") + 1).cast("int").alias("component"),
                      F.lit(model.n).cast("bigint").alias("n"), "deviation", "whitened", share[F.col("at")].alias("explained"),
                      F.lit(model.identity_error).alias("identity_error"))
