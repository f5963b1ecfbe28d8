"""Approximate nearest neighbours by descent: a neighbour's neighbours are likely neighbours.

A graph starts from the best within small random blocks of rows, dealt twice. In each round every node introduces its neighbours, and
a sample of the nodes that have it as a neighbour, to each other; pairs of two links that were introduced before are
left out. Each row keeps the best it has met. Rounds end when few links change. A round's work is bounded for each
node, whatever the data, and rounds are few (MAX_ROUNDS at most); where exact search can
exclude little (unclustered vectors of many dimensions) it would be rows times rows."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.operators.nearest import best, matrix, scaled, scores
from lattica.plans.tables import discard, written

#: Rows of a block at the start; rounds at most.
START_ROWS, MAX_ROUNDS = 256, 30


def _top(links: DataFrame, k: int) -> DataFrame:
    """Of (src, dst, score, fresh) the k best of each src; a link met again counts once, and isn't fresh if it was known."""
    once = links.groupBy("src", "dst").agg(F.max("score").alias("score"), F.min("fresh").alias("fresh"))
    order = Window.partitionBy("src").orderBy(F.desc("score"), "dst")
    return once.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k).drop("n")


def _start(rows: DataFrame, n: int, k: int, metric: str, seed: Column, kind: str) -> DataFrame:
    blocks = max(1, n // max(START_ROWS, 2 * k))
    parts = min(blocks, 1 << 14, max(4 * rows.sparkSession.sparkContext.defaultParallelism, n >> 15))  # a task has many blocks
    block = F.pmod(F.xxhash64("obs_id", seed), F.lit(blocks)).cast("int")
    dealt = rows.select("obs_id", "vec", block.alias("block")).repartitionById(parts, F.pmod("block", F.lit(parts))).sortWithinPartitions("block", "obs_id")

    def links(ids: pa.Array, x: np.ndarray) -> pa.RecordBatch:
        s = scores(x, x, (x * x).sum(1), metric)
        np.fill_diagonal(s, -np.inf)
        i, j = best(s, k, np.full(len(x), -np.inf))
        return pa.RecordBatch.from_arrays([ids.take(pa.array(i)), ids.take(pa.array(j)), pa.array(s[i, j], pa.float64()), pa.array(np.ones(len(i), bool))], names=["src", "dst", "score", "fresh"])

    def run(batches):
        now, ids, held = None, [], []
        for batch in batches:
            where = batch.column("block").to_numpy()
            for a, b in zip(*(lambda e: (e[:-1], e[1:]))(np.flatnonzero(np.concatenate([[True], where[1:] != where[:-1], [True]]))), strict=True) if len(where) else ():
                if where[a] != now and held:
                    yield links(pa.concat_arrays(ids), np.concatenate(held))
                    ids, held = [], []
                now = where[a]
                ids.append(batch.column("obs_id").slice(a, b - a))
                held.append(scaled(matrix(batch.slice(a, b - a)), metric))
        if held:
            yield links(pa.concat_arrays(ids), np.concatenate(held))

    return dealt.mapInArrow(run, f"src {kind}, dst {kind}, score double, fresh boolean")


def _meet(metric: str):
    """For each node (m: members with id, kth, fresh, vec) the pairs of a fresh member and another that beat one's k-th score."""

    def run(batches):
        for batch in batches:
            lists = batch.column("m")
            flat = lists.flatten()
            ids, kth, fresh = (flat.field(c) for c in ("id", "kth", "fresh"))
            kth, fresh = kth.to_numpy(), fresh.to_numpy(zero_copy_only=False)
            vec = flat.field("vec")
            x = scaled(vec.flatten().to_numpy().reshape(len(flat), -1).astype(np.float64, copy=False), metric) if len(flat) else np.zeros((0, 1))
            at = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
            out = []
            for a, b in zip(at[:-1], at[1:], strict=True):
                own, new = x[a:b], np.flatnonzero(fresh[a:b])
                s = scores(own[new], own, (own * own).sum(1) if metric == "euclidean" else None, metric)
                s[np.arange(len(new)), new] = -np.inf
                i, j = np.nonzero(s > kth[a + new, None])
                out.append((new[i] + a, j + a, s[i, j]))
                s[:, new] = -np.inf  # pairs of two fresh ones were met from both ends
                i, j = np.nonzero(s > kth[None, a:b])
                out.append((j + a, new[i] + a, s[i, j]))
            if out:
                i, j, s = (np.concatenate(c) for c in zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(i)), ids.take(pa.array(j)), pa.array(s), pa.array(np.ones(len(i), bool))], names=["src", "dst", "score", "fresh"])

    return run


def descend(rows: DataFrame, k: int, metric: str = "cosine", width: int | None = None, still: float = 0.001, seed: int = 0) -> DataFrame:
    """(src, dst, rank, score): about the k nearest other rows of each row; scores are as in `graphs.knn`.

    rows: obs_id (unique), vec array<double>, all of one length, without nulls. metric: `cosine` or `euclidean`. While
    searching, each row holds `width` neighbours (k + 16 and 32 at least unless given) and meets at most that many of those that
    hold it, picked by a hash in each round: more width, more recall. Rounds end when less than a share `still` of links changed."""
    if metric not in ("cosine", "euclidean"):
        raise ValueError(f"descent takes cosine or euclidean, not {metric!r}")
    width = max(k + 16, 32) if width is None else max(width, k)
    kind = rows.schema["obs_id"].dataType.simpleString()
    rows = written(rows.select("obs_id", F.col("vec").cast("array<double>").alias("vec")), "descent-rows")
    # vectors of single precision are shipped as such
    single = F.forall("vec", lambda v: v.cast("float").cast("double").eqNullSafe(v))
    n, exact = rows.agg(F.count("*"), F.coalesce(F.min(single), F.lit(True))).first()
    shipped = rows.select("obs_id", F.col("vec").cast("array<float>").alias("vec")) if exact else rows
    # two deals: the blocks of one alone would be islands, where no neighbour knows of another block
    first, second = (_start(rows, n, width, metric, F.lit(2 * seed + i), kind) for i in (0, 1))
    graph = written(_top(first.unionAll(second), width), "descent-graph")
    for turn in range(1, MAX_ROUNDS + 1):
        pick = Window.partitionBy("v").orderBy(F.xxhash64("id", F.lit(seed), F.lit(turn)), "id")
        back = graph.select(F.col("dst").alias("v"), F.col("src").alias("id"), "fresh").withColumn("n", F.row_number().over(pick)).where(F.col("n") <= width).drop("n")
        own = rows.select(F.col("obs_id").alias("v"), F.col("obs_id").alias("id"), F.lit(False).alias("fresh"))
        members = graph.select(F.col("src").alias("v"), F.col("dst").alias("id"), "fresh").unionAll(back).unionAll(own).repartition("v").groupBy("v", "id").agg(F.max("fresh").alias("fresh"))
        # who has no fresh member would introduce nobody
        members = members.withColumn("any", F.max("fresh").over(Window.partitionBy("v"))).where("any").drop("any")
        kth = graph.groupBy(F.col("src").alias("id")).agg(F.when(F.count("*") >= width, F.min("score")).alias("kth"))
        known = shipped.withColumnRenamed("obs_id", "id").join(kth, "id", "left").select("id", F.coalesce("kth", F.lit(-math.inf)).alias("kth"), "vec")
        met = members.join(known, "id").groupBy("v").agg(F.collect_list(F.struct("id", "kth", "fresh", "vec")).alias("m"))  # 2 width + 1 members at most
        found = met.select("m").mapInArrow(_meet(metric), f"src {kind}, dst {kind}, score double, fresh boolean")
        after = written(_top(graph.withColumn("fresh", F.lit(False)).unionAll(found), width), "descent-graph")
        discard(graph)
        graph = after
        if graph.where("fresh").count() <= still * n * min(width, max(n - 1, 0)):
            break
    order = Window.partitionBy("src").orderBy(F.desc("score"), "dst")
    out = graph.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("src", "dst", "rank", "score")
    discard(rows)
    return out
