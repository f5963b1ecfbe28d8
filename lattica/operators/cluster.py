"""Clustering of embeddings."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.functions.columns import scrub
from lattica.operators.communities import communities
from lattica.operators.graphs import knn
from lattica.operators.linalg import column, summed
from lattica.plans.tables import written

#: Rows that seed the mixture.
SEED_ROWS = 5_000
#: Rows whose weights are found at once.
TOGETHER = 1024


def _seeded_means(x: np.ndarray, k: int, seed: int) -> np.ndarray:
    """k-means++ and a few rounds of k-means on the seeding rows."""
    rng = np.random.default_rng(seed)
    c = [x[rng.integers(len(x))]]
    while len(c) < k:
        d = np.min([((x - m) ** 2).sum(1) for m in c], axis=0)
        c.append(x[rng.choice(len(x), p=d / d.sum())] if d.sum() > 0 else x[rng.integers(len(x))])
    m = np.stack(c)
    for _ in range(20):
        to = ((x[:, None, :] - m[None]) ** 2).sum(2).argmin(1)
        m = np.stack([x[to == j].mean(0) if (to == j).any() else m[j] for j in range(k)])
    return m


def tied_mixture(emb: DataFrame, k: int, seed: int = 42, iters: int = 100, tol: float = 1e-6) -> DataFrame:
    """(obs_id, cluster 1..k): a Gaussian mixture with one full covariance for all components, by expectation
    maximisation. Rows are written once and read in each iteration. A row's responsibilities are computed where it lies; an iteration moves k (d + 1) + d^2 sums. Means
    are seeded on up to 5,000 rows, the first by a hash. Components that aren't finite count as 0."""
    rows = written(emb.select("obs_id", F.transform("vec", scrub).alias("vec")), "mixture-rows")
    seeds = rows.orderBy(F.xxhash64("obs_id"), "obs_id").limit(SEED_ROWS).toArrow()
    x = np.array(seeds.column("vec").to_pylist(), float)
    if len(x) < k:
        raise ValueError(f"{len(x)} rows can't make {k} clusters")
    d = x.shape[1]
    mean, cov, weight = _seeded_means(x, k, seed), np.cov(x.T).reshape(d, d) + 1e-6 * np.eye(d), np.full(k, 1 / k)

    def respond(v, mean, cov, weight):
        c = np.linalg.cholesky(cov + 1e-9 * np.trace(cov) / len(cov) * np.eye(len(cov)))
        z, m = np.linalg.solve(c, v.T).T, np.linalg.solve(c, mean.T).T
        logp = np.log(np.maximum(weight, 1e-300)) - 0.5 * ((z * z).sum(1)[:, None] - 2 * z @ m.T + (m * m).sum(1)) - np.log(np.diag(c)).sum() - len(cov) / 2 * np.log(2 * np.pi)
        top = logp.max(1, keepdims=True)
        norm = top[:, 0] + np.log(np.exp(logp - top).sum(1))
        return np.exp(logp - norm[:, None]), norm

    def moments(batch, mean, cov, weight):
        v = column(batch, "vec")
        r, norm = respond(v, mean, cov, weight)
        return np.concatenate([r.sum(0), (r.T @ v).ravel(), (v.T @ v).ravel(), [norm.sum()]])

    last = -np.inf
    for _ in range(iters):
        s = summed(rows, lambda b, m=mean, c=cov, w=weight: moments(b, m, c, w), k + k * d + d * d + 1)
        n, first, second, like = s[:k], s[k : k + k * d].reshape(k, d), s[k + k * d : -1].reshape(d, d), s[-1]
        mean = first / np.maximum(n, 1e-12)[:, None]
        cov = (second - (mean.T * n) @ mean) / n.sum() + 1e-9 * np.eye(d)
        weight = n / n.sum()
        if like - last <= tol * abs(like):
            break
        last = like
    held = emb.sparkSession.sparkContext.broadcast((mean, cov, weight))

    def assign(batches):
        for batch in batches:
            if batch.num_rows:
                r, _ = respond(column(batch, "vec"), *held.value)
                yield pa.RecordBatch.from_arrays([batch.column("obs_id"), pa.array(r.argmax(1) + 1, pa.int32())], names=["obs_id", "cluster"])

    return rows.mapInArrow(assign, f"obs_id {emb.schema['obs_id'].dataType.simpleString()}, cluster int")


def cluster_graph(edges: DataFrame, nodes: DataFrame, resolution: float = 1.0, seed: int = 0) -> DataFrame:
    """(slice, obs_id, cluster): communities of each slice's graph, slices side by side; see communities. edges: slice, src,
    dst, w in both directions; nodes: slice, obs_id."""
    return communities(edges.select("slice", F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), F.col("w").cast("double").alias("w")), nodes.select("slice", F.col("obs_id").cast("long").alias("obs_id")), resolution, seed)


def fuzzy_weights(d: np.ndarray, n_neighbors: int) -> np.ndarray:
    """exp(-(d - nearest) / scale) of rows of distances, where each row's scale is searched by halving."""
    rho = np.where(d > 0, d, np.inf).min(1)
    over = np.maximum(d - np.where(np.isfinite(rho), rho, 0.0)[:, None], 0)
    goal = np.log2(max(2, n_neighbors))
    lo, hi, sigma = np.zeros(len(d)), np.full(len(d), np.inf), np.ones(len(d))
    left = np.arange(len(d))
    for _ in range(64):
        total = np.exp(-over[left] / sigma[left, None]).sum(1)
        on = np.abs(total - goal) >= 1e-5
        left, high = left[on], total[on] > goal
        if not len(left):
            break
        hi[left[high]], lo[left[~high]] = sigma[left[high]], sigma[left[~high]]
        sigma[left] = np.where(np.isinf(hi[left]), sigma[left] * 2, (lo[left] + hi[left]) / 2)
    sigma = np.maximum(sigma, 1e-3 * np.maximum(d.mean(1), 1e-12))
    return np.exp(-over / sigma[:, None])


def neighbor_graph(emb: DataFrame, n_neighbors: int = 10) -> DataFrame:
    """(src, dst, w): k-nearest-neighbour graph with fuzzy weights exp(-(d - nearest) / scale), the scale chosen so that a
    node's weights add up to log2(k), united by a + b - a b. Both directions."""
    near = knn(emb, emb, n_neighbors, "euclidean", exclude_self=True)
    lists = near.groupBy("src").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("d"), "dst"))).alias("n"))

    def weigh(batches):
        for batch in batches:
            near = batch.column("n")
            counts, flat = pc.list_value_length(near).to_numpy(), near.flatten()
            far, to = flat.field("d").to_numpy(), flat.field("dst")
            first = np.cumsum(counts) - counts
            for k in np.unique(counts).tolist():
                rows = np.flatnonzero(counts == k)
                for at in range(0, len(rows), TOGETHER):
                    own = rows[at : at + TOGETHER]
                    places = first[own][:, None] + np.arange(k)
                    w = fuzzy_weights(far[places], n_neighbors)
                    yield pa.RecordBatch.from_arrays([batch.column("src").take(pa.array(np.repeat(own, k))), to.take(pa.array(places.ravel())), pa.array(w.ravel())], names=["src", "dst", "w"])

    one = lists.select(F.col("src").cast("long").alias("src"), F.transform("n", lambda x: F.struct(x["d"].alias("d"), x["dst"].cast("long").alias("dst"))).alias("n")).mapInArrow(weigh, "src long, dst long, w double")
    both = one.select("src", "dst", "w").unionAll(one.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))
    s, q = F.sum("w"), F.product("w")
    return both.groupBy("src", "dst").agg(F.when(F.count("*") > 1, s - q).otherwise(s).alias("w"))


def cluster_leiden(emb: DataFrame, n_neighbors: int = 10, resolution: float = 1.0, per_slice: bool = True, seed: int = 0) -> DataFrame:
    """(slice, obs_id, cluster). emb: slice, obs_id (long, unique over slices), vec. per_slice: each slice by itself;
    otherwise all as one graph."""
    if per_slice:
        names = [r[0] for r in emb.select("slice").distinct().orderBy("slice").collect()]
        if not names:
            raise ValueError("there is no slice")
        edges = None
        for s in names:
            e = neighbor_graph(emb.where(F.col("slice") == s).select("obs_id", "vec"), n_neighbors).select(F.lit(s).alias("slice"), "src", "dst", "w")
            edges = e if edges is None else edges.unionAll(e)
        return cluster_graph(edges, emb.select("slice", "obs_id"), resolution, seed)
    edges = neighbor_graph(emb.select("obs_id", "vec"), n_neighbors).select(F.lit("all").alias("slice"), "src", "dst", "w")
    found = cluster_graph(edges, emb.select(F.lit("all").alias("slice"), "obs_id"), resolution, seed).drop("slice")
    return emb.select("slice", "obs_id").join(found, "obs_id").select("slice", "obs_id", "cluster")


def cluster_mixture(emb: DataFrame, k: int, per_slice: bool = True, seed: int = 42) -> DataFrame:
    """(slice, obs_id, cluster) by tied_mixture, for each slice or for all rows together."""
    if not per_slice:
        return emb.select("slice", "obs_id").join(tied_mixture(emb.select("obs_id", "vec"), k, seed), "obs_id").select("slice", "obs_id", "cluster")
    out = None
    for r in emb.select("slice").distinct().orderBy("slice").collect():
        own = emb.where(F.col("slice") == r[0])
        c = tied_mixture(own.select("obs_id", "vec"), k, seed).select(F.lit(r[0]).alias("slice"), "obs_id", "cluster")
        out = c if out is None else out.unionAll(c)
    if out is None:
        raise ValueError("there is no slice")
    return out
