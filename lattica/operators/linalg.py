"""Small dense algebra around distributed rows."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.plans.tables import discard, written

BLOCK = 1 << 16


def column(batch: pa.RecordBatch, name: str) -> np.ndarray:
    """An array<double> column of equal lengths as a matrix."""
    x = batch.column(name)
    if not len(x):
        return np.zeros((0, 0))
    return x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1)


def vectors(x: np.ndarray) -> pa.Array:
    """A matrix as an array<double> column."""
    n, k = x.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * k, pa.int32()), pa.array(np.ascontiguousarray(x, np.float64).ravel()))


def summed(df: DataFrame, kernel: Callable[[pa.RecordBatch], np.ndarray], size: int) -> np.ndarray:
    """The sum over df's batches of kernel(batch), flat arrays of `size` doubles. Each task adds up its own; the
    tasks' sums meet in blocks, so no task and no message holds more than one task's sum."""
    blocks = -(-size // BLOCK)

    def local(batches):
        total = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                total += kernel(batch)
        for j in range(blocks):
            yield pa.RecordBatch.from_arrays([pa.array([j], pa.int32()), pa.array([total[j * BLOCK : (j + 1) * BLOCK].tobytes()], pa.binary())], names=["j", "data"])

    def add(batches):
        total: dict = {}
        for batch in batches:
            for j, data in zip(batch.column("j").to_pylist(), batch.column("data").to_pylist(), strict=True):
                own = np.frombuffer(data, np.float64)
                total[j] = total[j] + own if j in total else own
        for j, x in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([j], pa.int32()), pa.array([x.tobytes()], pa.binary())], names=["j", "data"])

    out = np.zeros(size)
    for r in df.mapInArrow(local, "j int, data binary").repartitionById(blocks, F.col("j")).mapInArrow(add, "j int, data binary").toLocalIterator():
        out[r.j * BLOCK : (r.j + 1) * BLOCK] = np.frombuffer(bytes(r.data), np.float64)
    return out


def summed_by(df: DataFrame, key: str, vec: str) -> dict:
    """key -> the sum of its rows' array<double> columns, all of one length; rows are few and long. Each task adds up its own;
    the tasks' sums meet in pieces."""

    def local(batches):
        total: dict = {}
        for batch in batches:
            for k, x in zip(batch.column(key).to_pylist(), batch.column(vec), strict=True):
                x = x.values.to_numpy()
                total[k] = total[k] + x if k in total else x.copy()
        for k, x in total.items():
            cut = range(0, len(x), BLOCK)
            yield pa.RecordBatch.from_arrays([pa.array([k] * len(cut)), pa.array(cut, pa.int32()), pa.array([x[a : a + BLOCK].tobytes() for a in cut], pa.binary())], names=[key, "at", "data"])

    def add(batches):
        total: dict = {}
        for batch in batches:
            for k, at, data in zip(batch.column(key).to_pylist(), batch.column("at").to_pylist(), batch.column("data").to_pylist(), strict=True):
                own = np.frombuffer(data, np.float64)
                total[k, at] = total[k, at] + own if (k, at) in total else own
        for (k, at), x in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([at], pa.int32()), pa.array([x.tobytes()], pa.binary())], names=[key, "at", "data"])

    schema = f"{key} {df.schema[key].dataType.simpleString()}, at int, data binary"
    pieces: dict = {}
    for r in df.select(key, vec).mapInArrow(local, schema).repartition(key, "at").mapInArrow(add, schema).toLocalIterator():
        pieces.setdefault(r[key], {})[r["at"]] = np.frombuffer(bytes(r["data"]), np.float64)
    return {k: np.concatenate([x[a] for a in sorted(x)]) for k, x in pieces.items()}


def triangles(r: np.ndarray | None, rows: np.ndarray) -> np.ndarray:
    """The triangle of a tall matrix: r, that of the rows before, joined with more rows."""
    return np.linalg.qr(rows if r is None else np.concatenate([r, rows]), mode="r")


def gram(df: DataFrame, a: str, b: str | None = None, shape: tuple[int, int] | None = None) -> np.ndarray:
    """A^T B over the rows of df (array<double> columns)."""
    b = b or a
    if shape is None:
        first = df.select(F.size(a), F.size(b)).first()
        if first is None:
            return np.zeros((0, 0))
        shape = (first[0], first[1])
    return summed(df.select(*{a, b}), lambda batch: (column(batch, a).T @ column(batch, b)).ravel(), shape[0] * shape[1]).reshape(shape)


def solve_spd(a: np.ndarray, b: np.ndarray, jitter: float = 1e-8, growth: float = 10.0, tries: int = 6) -> np.ndarray:
    """a^-1 b for a symmetric positive a: Cholesky with a growing jitter, then a general solve, then least squares."""
    a = (a + a.T) / 2
    eye = np.eye(len(a))
    for i in range(tries):
        try:
            c = np.linalg.cholesky(a + jitter * growth**i * eye)
            return np.linalg.solve(c.T, np.linalg.solve(c, b))
        except np.linalg.LinAlgError:
            continue
    try:
        return np.linalg.solve(a, b)
    except np.linalg.LinAlgError:
        return np.linalg.lstsq(a, b, rcond=None)[0]


def polar_factors(df: DataFrame, name: str, by: str, rank: int) -> dict:
    """by -> the R x R matrix t such that rows m of df give the nearest orthonormal columns as m @ t.

    Tall-skinny QR: each task factors its rows of each group, the small triangles meet on the driver (R x R for each
    task and group). A nearly singular group gets the pseudo-inverse of its triangle."""

    def run(batches):
        held: dict = {}
        for batch in batches:
            keys = np.array(batch.column(by).to_pylist(), object)
            m = column(batch, name)
            for k in dict.fromkeys(keys.tolist()):
                held[k] = triangles(held.get(k), m[keys == k])
        for k, r in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([r.tobytes()], pa.binary())], names=[by, "r"])

    kind = df.schema[by].dataType.simpleString()
    stacks: dict = {}
    for row in df.select(by, name).mapInArrow(run, f"{by} {kind}, r binary").toLocalIterator():
        r = np.frombuffer(bytes(row["r"]), np.float64).reshape(-1, rank)
        stacks[row[by]] = triangles(stacks.get(row[by]), r)
    out = {}
    for k, r in stacks.items():
        u, _, vh = np.linalg.svd(r, full_matrices=False)
        d = np.abs(np.diag(r))
        inverse = np.linalg.inv(r) if r.shape[0] == r.shape[1] and d.min() > 1e-12 * max(d.max(), 1e-300) else np.linalg.pinv(r)
        out[k] = inverse @ (u @ vh)
    return out


def fixed_signs(v: np.ndarray) -> np.ndarray:
    """Columns turned so that the entry of greatest size is positive."""
    at = np.abs(v).argmax(0)
    s = np.sign(v[at, np.arange(v.shape[1])])
    return v * np.where(s == 0, 1, s)


#: Vectors of more features than this have their components found without a G x G matrix.
GRAM_FEATURES = 8192


def leading(rows: DataFrame, vec: str, mean: np.ndarray, n: int, tol: float = 1e-9, most: int = 60, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The n greatest eigenvalues and their vectors (G x n) of (X - mean)^T (X - mean), by block Krylov spaces.

    A pass over the rows applies the matrix to a block of n + 8 columns, random ones at first; the next block is what a pass
    brings beyond all blocks before. Eigenpairs of the matrix on the space of all blocks are taken once their residuals are under tol
    times the greatest value. The driver holds G x (n + 8) doubles twice for each pass; a task holds one block and its sum."""
    g = len(mean)
    n = min(n, g)
    width = min(g, n + 8)
    spark = rows.sparkSession
    rows = written(rows.select(vec), "krylov-rows")  # read in each pass
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((g, width)))[0]
    basis, images = np.zeros((g, 0)), np.zeros((g, 0))
    for _ in range(most):
        held = spark.sparkContext.broadcast((q, mean))

        def apply(batch, held=held):
            block, center = held.value
            x = column(batch, vec) - center
            return (x.T @ (x @ block)).ravel()

        z = summed(rows, apply, q.size).reshape(q.shape)
        held.unpersist()
        basis, images = np.concatenate([basis, q], 1), np.concatenate([images, z], 1)
        h = basis.T @ images
        values, s = np.linalg.eigh((h + h.T) / 2)
        values, s = values[::-1][:n], s[:, ::-1][:, :n]
        gap = np.linalg.norm(images @ s - (basis @ s) * values, axis=0).max()
        if gap <= tol * max(values[0], 0) or not values[0] > 0:
            discard(rows)
            return values, basis @ s
        size = np.linalg.norm(z, axis=0).max()
        for _ in range(2):
            z = z - basis @ (basis.T @ z)
        u, d, _ = np.linalg.svd(z, full_matrices=False)
        q = u[:, d > 1e-12 * size]
        if not q.shape[1]:  # the space is closed: what it holds is exact
            discard(rows)
            return values, basis @ s
    raise ValueError(f"components did not settle in {most} passes: residual {gap:.3g}")


def principal_components(rows: DataFrame, n: int, centered: bool = True, vec: str = "x", out: str = "vec", gram_features: int = GRAM_FEATURES) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """(rows with `out`, loadings, explained variances). Up to gram_features features the G x G Gram matrix is added up in blocks and
    its eigenvectors are found on the driver; of more features the n leading vectors are found in passes over the rows (`leading`),
    equal to within rounding. Not centred: a truncated singular decomposition."""
    g = rows.select(F.size(vec)).first()
    if g is None:
        raise ValueError("there are no rows")
    g = g[0]
    m = rows.count()
    mean = summed(rows.select(vec), lambda b: column(b, vec).sum(0), g) / m if centered else np.zeros(g)
    n = min(n, g)
    if g > gram_features:
        values, v = leading(rows, vec, mean, n)
    else:
        cov = gram(rows, vec, shape=(g, g)) - m * np.outer(mean, mean)
        values, v = (x[..., ::-1][..., :n] for x in np.linalg.eigh((cov + cov.T) / 2))
    load = fixed_signs(v)
    held = rows.sparkSession.sparkContext.broadcast((load, mean))
    names = [c for c in rows.columns if c != out]

    def project(batches):
        w, c = held.value
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in names), vectors((column(batch, vec) - c) @ w if batch.num_rows else np.zeros((0, w.shape[1])))], names=[*names, out])

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != out)
    return rows.mapInArrow(project, f"{types}, {out} array<double>"), load, values / max(1, m - 1)
