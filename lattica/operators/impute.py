"""Imputation of features that only the reference has."""

from __future__ import annotations

import zlib
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.operators.graphs import cosine_graph, nearest_pseudo, row_normalize
from lattica.operators.linalg import column, gram, solve_spd, vectors

#: Edges of a feature graph at most (they go to every task, 24 bytes each).
MAX_EDGES = 20_000_000


def ridge_factors(s: DataFrame, x: DataFrame, lam: float = 1.0) -> np.ndarray:
    """B_u = ((S^T S + lam I)^-1 S^T X)^T. s: obs_id, vec (embedding); x: obs_id, x (dense rows of the unshared features)."""
    both = s.select("obs_id", F.col("vec").cast("array<double>").alias("s")).join(x.select("obs_id", F.col("x").cast("array<double>").alias("x")), "obs_id").select("s", "x")
    g = gram(both, "s")
    return solve_spd(g + lam * np.eye(len(g)), gram(both, "s", "x"), jitter=1e-12).T


def gene_graph(spark, b_shared: np.ndarray, b_unshared: np.ndarray, k: int = 20) -> DataFrame:
    """Cosine graph over [shared; unshared] feature factors: (src, dst, w) by position."""
    b = np.concatenate([b_shared, b_unshared]) if len(b_unshared) else b_shared
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(b)], "obs_id long, vec array<double>")
    return cosine_graph(rows, k)


def neighbor_expression(neighbors: DataFrame, expr: DataFrame) -> DataFrame:
    """(obs_id, rank, gene, value): the pseudo-spots' expression at each spot's neighbours; absent stays absent."""
    return neighbors.select(F.col("src").alias("obs_id"), "rank", F.col("dst").alias("pseudo")).join(expr.select(F.col("obs_id").alias("pseudo"), "gene", "value"), "pseudo").select("obs_id", "rank", "gene", "value")


def knn_mean(neighbors: DataFrame, expr: DataFrame, k: int) -> DataFrame:
    """(obs_id, gene, value): the mean over k neighbours, absent ones counting as 0."""
    return neighbor_expression(neighbors, expr).groupBy("obs_id", "gene").agg((F.sum("value") / F.lit(float(k))).alias("value"))


def blend(model: DataFrame, mean: DataFrame, alpha: float = 0.9) -> DataFrame:
    """alpha model + (1 - alpha) mean, absent cells being 0."""
    m = model.select("obs_id", "gene", F.col("value").alias("a"))
    n = mean.select("obs_id", "gene", F.col("value").alias("b"))
    v = F.lit(alpha) * F.coalesce("a", F.lit(0.0)) + F.lit(1 - alpha) * F.coalesce("b", F.lit(0.0))
    return m.join(n, ["obs_id", "gene"], "full").select("obs_id", "gene", v.alias("value"))


def neighbor_tensor(neighbors: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """(obs_id, f array<double>): for each spot the k neighbours' dense rows side by side, k x G. rows: obs_id, x."""
    r = neighbors.select(F.col("src").alias("obs_id"), "rank", F.col("dst").alias("pseudo")).join(rows.select(F.col("obs_id").alias("pseudo"), "x"), "pseudo")
    g = r.groupBy("obs_id").agg(F.array_sort(F.collect_list(F.struct("rank", "x"))).alias("n")).where(F.size("n") == k)
    return g.select("obs_id", F.flatten(F.col("n.x")).alias("f"))


class SparseGraph:
    """A row-normalised feature graph as edges in order of src, which goes to every task: some tens of edges for each feature."""

    #: Doubles gathered at once.
    ROOM = 1 << 22

    def __init__(self, src: np.ndarray, dst: np.ndarray, w: np.ndarray, n: int):
        order = np.lexsort((dst, src))
        self.src, self.dst, self.w, self.n = src[order], dst[order], w[order], n

    def __len__(self) -> int:
        return self.n

    @cached_property
    def T(self) -> SparseGraph:
        return SparseGraph(self.dst, self.src, self.w, self.n)

    def single(self) -> SparseGraph:
        return SparseGraph(self.src, self.dst, self.w.astype(np.float32), self.n)

    def times(self, h: np.ndarray) -> np.ndarray:
        """The graph times h (features first): gathered and summed in runs of one src, as many edges at once as fit ROOM."""
        flat = h.reshape(self.n, -1)
        out = np.zeros(flat.shape, np.result_type(flat, self.w))
        step = max(1, self.ROOM // max(1, flat.shape[1]))
        for a in range(0, len(self.src), step):
            src = self.src[a : a + step]
            heads = np.flatnonzero(np.concatenate([[True], src[1:] != src[:-1]]))
            out[src[heads]] += np.add.reduceat(flat[self.dst[a : a + step]] * self.w[a : a + step, None], heads, axis=0)
        return out.reshape(h.shape)


def mixed(adj: np.ndarray | SparseGraph, h: np.ndarray) -> np.ndarray:
    """The feature graph times h: features, spots, values."""
    return adj.times(h) if isinstance(adj, SparseGraph) else np.einsum("ij,jbk->ibk", adj, h, optimize=True)


class GraphImputer:
    """Layers that mix each (spot, feature) vector of k neighbour values with those of neighbouring features and
    spots, then a small network to one value. Forward and backward passes over a block of spots."""

    def __init__(self, k: int, layers: int = 1, hidden: int = 128, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.k, self.layers = k, layers

        def uniform(rows: int, cols: int) -> np.ndarray:
            return rng.uniform(-1, 1, (rows, cols)) / np.sqrt(rows)

        self.p: dict[str, np.ndarray] = {}
        for i in range(layers):
            self.p |= {f"w{i}": uniform(3 * k, k), f"s{i}": np.ones(k), f"t{i}": np.zeros(k)}
        for n, (a, b) in (("1", (k, 2 * hidden)), ("2", (2 * hidden, hidden)), ("3", (hidden, 1))):
            self.p |= {f"m{n}": uniform(a, b), f"b{n}": rng.uniform(-1, 1, b) / np.sqrt(a)}

    def single(self) -> GraphImputer:
        """The same in single precision."""
        own = object.__new__(GraphImputer)
        own.k, own.layers, own.p = self.k, self.layers, {n: v.astype(np.float32) for n, v in self.p.items()}
        return own

    def forward(self, x: np.ndarray, adj: np.ndarray | SparseGraph, spatial: np.ndarray | None = None, keep: list | None = None, dropout: tuple[float, np.random.Generator] | None = None) -> np.ndarray:
        """x: spots x k x G; adj: row-normalised feature graph, G x G; spatial: the neighbouring spots' mean of x (for one
        layer). Returns spots x G; keep collects what backward needs. dropout: the share of a layer's inputs that is left
        out (the rest is scaled up), in training only."""
        h = x.transpose(2, 0, 1)  # G, B, k
        ns = np.zeros_like(h) if spatial is None else spatial.transpose(2, 0, 1)
        p = self.p
        for i in range(self.layers):
            ng = mixed(adj, h)
            cat = np.concatenate([h, ng, ns], axis=2)
            mask = None if dropout is None else ((dropout[1].random(cat.shape) >= dropout[0]) / (1 - dropout[0])).astype(cat.dtype)
            cat = cat if mask is None else cat * mask
            z = cat @ p[f"w{i}"]
            r = h + np.maximum(z, 0)
            mean, var = r.mean(2, keepdims=True), r.var(2, keepdims=True)
            inv = 1 / np.sqrt(var + 1e-5)
            unit = (r - mean) * inv
            if keep is not None:
                keep.append((cat, z, unit, inv, mask))
            h = unit * p[f"s{i}"] + p[f"t{i}"]
        a1 = h @ p["m1"] + p["b1"]
        h1 = np.maximum(a1, 0)
        a2 = h1 @ p["m2"] + p["b2"]
        h2 = np.maximum(a2, 0)
        if keep is not None:
            keep.append((h, a1, h1, a2, h2))
        return (h2 @ p["m3"] + p["b3"])[..., 0].T

    def gradient(self, x: np.ndarray, adj: np.ndarray | SparseGraph, y: np.ndarray, shared: np.ndarray, weight: float, spatial: np.ndarray | None = None, dropout: tuple[float, np.random.Generator] | None = None) -> tuple[float, dict]:
        keep: list = []
        out = self.forward(x, adj, spatial, keep, dropout)
        loss, d_shared = shared_loss(out[:, shared], y, weight)
        d = np.zeros_like(out)
        d[:, shared] = d_shared
        d = d.T[..., None]  # G, B, 1
        g: dict[str, np.ndarray] = {}
        p = self.p
        h, a1, h1, a2, h2 = keep.pop()

        def outer(a, b):
            return np.tensordot(a, b, axes=([0, 1], [0, 1]))

        g["m3"], g["b3"] = outer(h2, d), d.sum((0, 1))
        d = (d @ p["m3"].T) * (a2 > 0)
        g["m2"], g["b2"] = outer(h1, d), d.sum((0, 1))
        d = (d @ p["m2"].T) * (a1 > 0)
        g["m1"], g["b1"] = outer(h, d), d.sum((0, 1))
        d = d @ p["m1"].T
        for i in reversed(range(self.layers)):
            cat, z, unit, inv, mask = keep.pop()
            g[f"s{i}"], g[f"t{i}"] = (d * unit).sum((0, 1)), d.sum((0, 1))
            d = d * p[f"s{i}"]
            d = inv * (d - d.mean(2, keepdims=True) - unit * (d * unit).mean(2, keepdims=True))
            dz = d * (z > 0)
            g[f"w{i}"] = outer(cat, dz)
            back = dz @ p[f"w{i}"].T
            back = back if mask is None else back * mask
            k = self.k
            d = d + back[..., :k] + mixed(adj.T, back[..., k : 2 * k])
        return loss, g


def shared_loss(a: np.ndarray, y: np.ndarray, weight: float) -> tuple[float, np.ndarray]:
    """weight ((1 - mean row cosine) + (1 - mean column cosine)) + mean squared error, the cosines of matrices that are
    centred by their overall mean; and the gradient by a."""
    ac, yc = a - a.mean(), y - y.mean()
    loss, d = float(((a - y) ** 2).mean()), 2 * (a - y) / a.size
    dc = np.zeros_like(a)
    for axis in (1, 0):
        na, ny = (np.maximum(np.sqrt((m * m).sum(axis, keepdims=True)), 1e-8) for m in (ac, yc))
        c = (ac * yc).sum(axis, keepdims=True) / (na * ny)
        loss += weight * float(1 - c.mean())
        dc -= weight / c.size * (yc / (na * ny) - c * ac / na**2)
    return loss, d + dc - dc.mean()


def spatial_mean(tensor: DataFrame, edges: DataFrame) -> DataFrame:
    """(obs_id, s): the neighbouring spots' mean of f over a row-normalised graph; spots without neighbours get zeros."""
    width = tensor.select(F.size("f")).first()[0]
    e = row_normalize(edges).join(tensor.select(F.col("obs_id").alias("dst"), "f"), "dst").select("src", F.posexplode(F.transform("f", lambda v: v * F.col("w"))).alias("i", "v"))
    m = e.groupBy("src", "i").agg(F.sum("v").alias("v")).groupBy("src").agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("a"))
    s = m.select(F.col("src").alias("obs_id"), F.col("a.v").alias("s"))
    return tensor.select("obs_id").join(s, "obs_id", "left").select("obs_id", F.coalesce("s", F.array_repeat(F.lit(0.0), width)).alias("s"))


def dense_adjacency(edges: DataFrame, g: int) -> np.ndarray:
    """Row-normalised feature graph as a matrix; features are a few thousand at most."""
    if g > 8192:
        raise ValueError(f"{g} features are too many for a dense feature graph")
    adj = np.zeros((g, g))
    for r in row_normalize(edges).toLocalIterator():
        adj[r["src"], r["dst"]] = r["w"]
    return adj


def feature_adjacency(edges: DataFrame, g: int, dense_features: int = 1024) -> np.ndarray | SparseGraph:
    """The row-normalised graph (src, dst, w; by position) of g features: as a matrix up to dense_features of them, else as edges.
    Both give equal results. It passes the driver: k edges or so for each feature, and MAX_EDGES at most."""
    if g <= dense_features:
        return dense_adjacency(edges, g)
    t = row_normalize(edges).select(F.col("src").cast("long"), F.col("dst").cast("long"), F.col("w").cast("double")).limit(MAX_EDGES + 1).toArrow()
    if t.num_rows > MAX_EDGES:
        raise ValueError(f"a feature graph of more than {MAX_EDGES} edges")
    return SparseGraph(*(t.column(c).to_numpy() for c in ("src", "dst", "w")), g)


def feature_means(rows: DataFrame, adj: np.ndarray | SparseGraph) -> DataFrame:
    """(obs_id, x): each row's mean over neighbouring features. rows: obs_id, x array<double>."""
    held = rows.sparkSession.sparkContext.broadcast(adj)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x = mixed(held.value, np.ascontiguousarray(column(batch, "x").T)[..., None])
                yield pa.RecordBatch.from_arrays([batch.column("obs_id"), vectors(x[..., 0].T)], names=["obs_id", "x"])

    return rows.select("obs_id", "x").mapInArrow(run, f"obs_id {rows.schema['obs_id'].dataType.simpleString()}, x array<double>")


def fit_imputer(tensor: DataFrame, truth: DataFrame, adj: np.ndarray | SparseGraph, shared: list[int], k: int, epochs: int = 50, lr: float = 1e-3, decay: float = 1e-2, layers: int = 1, hidden: int = 128, sim_weight: float = 0.5, batch_rows: int = 64, spatial: DataFrame | None = None, seed: int = 0, mini_batches: int = 1, dropout: float = 0.0) -> tuple[GraphImputer, list[float]]:
    """Train on the shared features. tensor: obs_id, f (k x G); truth: obs_id, y (dense over shared); spatial: obs_id, s.
    Returns the model and the mean loss of each epoch.

    Data-parallel: in each step every task finds the gradients of its blocks of batch_rows spots in single precision and adds
    them up in double; the driver averages them over blocks and takes an AdamW step in double. An epoch deals the spots anew, by a hash, into mini_batches steps.
    Neighbouring spots enter through their mean, joined beforehand, which serves one layer and takes whole epochs."""
    if spatial is not None and mini_batches != 1:
        raise ValueError("a graph of spots takes whole epochs")
    if spatial is not None and layers != 1:
        raise ValueError("a graph of spots works with one layer")
    from lattica.operators.linalg import summed
    from lattica.plans.tables import written

    rows = tensor.join(truth, "obs_id")
    rows = rows.join(spatial, "obs_id") if spatial is not None else rows
    rows = written(rows.select("obs_id", "f", "y", *(["s"] if spatial is not None else [])), "imputer-rows")
    model = GraphImputer(k, layers, hidden, seed)
    names = sorted(model.p)
    shapes = {n: model.p[n].shape for n in names}
    size = sum(int(np.prod(s)) for s in shapes.values())
    g = len(adj)
    index = np.array(shared)
    held = tensor.sparkSession.sparkContext.broadcast(adj.single() if isinstance(adj, SparseGraph) else adj.astype(np.float32))
    m, v, losses = np.zeros(size), np.zeros(size), []

    def flat(d):
        return np.concatenate([d[n].ravel() for n in names])

    for step in range(1, epochs * mini_batches + 1):
        epoch, turn = divmod(step - 1, mini_batches)
        part = rows if mini_batches == 1 else rows.where(F.pmod(F.xxhash64("obs_id", F.lit(seed), F.lit(epoch)), F.lit(mini_batches)) == turn)

        def kernel(batch, model=model.single(), step=step):
            total = np.zeros(size + 2)
            for a in range(0, batch.num_rows, batch_rows):
                own = batch.slice(a, batch_rows)
                x = column(own, "f").reshape(own.num_rows, k, g).astype(np.float32)
                s = column(own, "s").reshape(own.num_rows, k, g).astype(np.float32) if "s" in own.schema.names else None
                drop = (dropout, np.random.default_rng([seed, step, zlib.crc32(str(own.column("obs_id")[0]).encode())])) if dropout else None
                loss, d = model.gradient(x, held.value, column(own, "y"), index, sim_weight, s, drop)
                total += np.concatenate([flat(d), [loss, 1.0]])
            return total

        total = summed(part, kernel, size + 2)
        if not total[-1]:
            continue
        n = total[-1]
        losses.append((epoch, total[-2], n))
        d = total[:-2] / n
        m, v = 0.9 * m + 0.1 * d, 0.999 * v + 0.001 * d * d
        w = flat(model.p)
        w = w - lr * decay * w - lr * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        fresh = GraphImputer(k, layers, hidden, seed)
        at = 0
        for name in names:
            c = int(np.prod(shapes[name]))
            fresh.p[name] = w[at : at + c].reshape(shapes[name])
            at += c
        model = fresh
    means = [[(x, n) for e, x, n in losses if e == epoch] for epoch in range(epochs)]
    return model, [sum(x for x, _ in m) / sum(n for _, n in m) for m in means if m]


def predict_imputer(tensor: DataFrame, model: GraphImputer, adj: np.ndarray | SparseGraph, genes: list[str], spatial: DataFrame | None = None, batch_rows: int = 128) -> DataFrame:
    """(obs_id, gene, value) for all features."""
    held = tensor.sparkSession.sparkContext.broadcast((model, adj))
    rows = tensor.join(spatial, "obs_id") if spatial is not None else tensor
    g, k = len(adj), model.k

    def run(batches):
        net, a_ = held.value
        for batch in batches:
            for a in range(0, batch.num_rows, batch_rows):
                own = batch.slice(a, batch_rows)
                s = column(own, "s").reshape(own.num_rows, k, g) if "s" in own.schema.names else None
                y = net.forward(column(own, "f").reshape(own.num_rows, k, g), a_, s)
                yield pa.RecordBatch.from_arrays([own.column("obs_id"), vectors(y)], names=["obs_id", "y"])

    kind = tensor.schema["obs_id"].dataType.simpleString()
    out = rows.mapInArrow(run, f"obs_id {kind}, y array<double>")
    named = F.explode(F.arrays_zip(F.array(*(F.lit(x) for x in genes)).alias("gene"), F.col("y").alias("value")))
    return out.select("obs_id", named.alias("z")).select("obs_id", "z.gene", "z.value")


def imputation_graph(st: DataFrame, ps: DataFrame, b_shared: np.ndarray, unshared: DataFrame, lam: float = 1.0, knn_k: int = 20, k_gnn: int = 50) -> tuple[DataFrame, DataFrame, np.ndarray]:
    """(feature graph, spots' nearest pseudo-spots, unshared factors). st, ps: obs_id, vec, unit; unshared: dense rows of the
    pseudo-spots over the unshared features."""
    b_u = ridge_factors(ps, unshared, lam)
    near = nearest_pseudo(st.select("obs_id", F.col("unit").alias("vec")), ps.select("obs_id", F.col("unit").alias("vec")), k_gnn)
    return gene_graph(st.sparkSession, b_shared, b_u, knn_k), near, b_u
