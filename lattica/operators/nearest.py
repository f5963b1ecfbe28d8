"""Exact nearest neighbours of many rows: pivots and bounds exclude what can't be near.

Every right row belongs to its nearest pivot (a right row, picked by a hash); a pivot's rows have a radius. A left
row first meets the rows of its nearest pivot. Its k-th score bounds the distance of better rows, and it goes on
only to the pivots that this bound and the radii don't exclude. For products (`dot`, and `cosine` of unit vectors) right
vectors are lifted by one component to equal length, which turns the greatest product into the least distance."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.plans.tables import written

#: Pivots at most (they pass the driver and go to every task), Spark partitions at most, left rows compared at once at most,
#: right rows that a task holds where pivots have fewer, scores held at once.
MAX_PIVOTS, MAX_PARTS, TOGETHER, SHELF_ROWS, MAX_SCORES = 4096, 1 << 14, 512, 1 << 15, 1 << 21


def together(n: int) -> int:
    """Rows compared at once with n others, so that their scores stay few."""
    return max(1, min(TOGETHER, MAX_SCORES // max(1, n)))


def matrix(batch: pa.RecordBatch, name: str = "vec") -> np.ndarray:
    vec = batch.column(name)
    return vec.flatten().to_numpy(zero_copy_only=False).reshape(len(vec), -1) if len(vec) else np.zeros((0, 0))


def scaled(x: np.ndarray, metric: str) -> np.ndarray:
    return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-12) if metric == "cosine" else x


def scores(q: np.ndarray, table: np.ndarray, square: np.ndarray | None, metric: str) -> np.ndarray:
    """Greater is nearer: products, or minus the distances, which take the squares of the table's rows."""
    s = q @ table.T
    return -np.sqrt(np.maximum((q * q).sum(1)[:, None] + square[None] - 2 * s, 0)) if metric == "euclidean" else s


def best(s: np.ndarray, k: int, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the k greatest scores of each row that are not under its floor; of ties at the edge the first ones."""
    rows, n = s.shape
    edge = floor
    if n // 64 >= max(k, 4):  # the k-th of the maxima of 64 and more columns each is no greater than the k-th score
        tops = s[:, : n - n % 64].reshape(rows, 64, -1).max(1)
        edge = np.maximum(np.partition(tops, tops.shape[1] - k, axis=1)[:, tops.shape[1] - k], floor)
    elif n > k:
        edge = np.maximum(np.partition(s, n - k, axis=1)[:, n - k], floor)
    i, j = np.nonzero((s >= edge[:, None]) & (s > -np.inf))
    order = np.lexsort((j, -s[i, j], i))
    i, j = i[order], j[order]
    first = np.arange(len(i)) - np.searchsorted(i, i) < k
    return i[first], j[first]


class Table:
    """Rows that a task holds, for exact searches. Products in single precision, with a bound on their error, leave out what can't be
    among the best; the scores of what is left are found in double precision. Where that leaves much, all scores are."""

    #: Components of left pairs gathered at once.
    ROOM = 1 << 21

    def __init__(self, rows: np.ndarray, metric: str, most: int = 0):
        """most: rows of one id, where a search leaves out its own id."""
        self.rows, self.metric, self.most = rows, metric, most
        self.square = (rows * rows).sum(1)
        self.longest = math.sqrt(self.square.max(initial=0.0))
        low = np.concatenate([rows, -self.square[:, None] / 2], 1) if metric == "euclidean" else rows
        with np.errstate(over="ignore"):
            self.low = low.astype(np.float32)

    def take(self, places: np.ndarray) -> Table:
        own = object.__new__(Table)
        own.rows, own.metric, own.most, own.square, own.longest, own.low = self.rows[places], self.metric, self.most, self.square[places], self.longest, self.low[places]
        return own

    def picked(self, q: np.ndarray, k: int, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        """Places that hold the k best of each row that are not under its floor; None where that may be many more."""
        n = len(self.rows)
        square = (q * q).sum(1)
        euclid = self.metric == "euclidean"
        scale = np.sqrt(square) * self.longest + (self.longest**2 / 2 if euclid else 0)
        if not n or not len(q) or not (scale.min() > 1e-25 and scale.max() < 1e30 and square.max() < 1e30):
            return None
        error = (q.shape[1] + 10) * 2.0**-23 * scale + 1e-15 * square
        s = (np.concatenate([q, np.ones((len(q), 1))], 1) if euclid else q).astype(np.float32) @ self.low.T
        edge = ((square - floor**2) / 2 if euclid else floor) - error
        low = lambda e: np.nextafter(e.astype(np.float32), np.float32(-np.inf))[:, None]
        hit = s >= low(edge) if (edge > -np.inf).all() else None
        if hit is None or np.count_nonzero(hit) * q.shape[1] > self.ROOM:
            if n // 64 >= max(k, 4):  # as in best
                tops = s[:, : n - n % 64].reshape(len(s), 64, -1).max(1)
                edge = np.maximum(edge, np.partition(tops, tops.shape[1] - k, axis=1)[:, tops.shape[1] - k] - 2 * error)
            elif n > k:
                edge = np.maximum(edge, np.partition(s, n - k, axis=1)[:, n - k] - 2 * error)
            hit = s >= low(edge)
        found = np.flatnonzero(hit)
        return None if len(found) * q.shape[1] > self.ROOM else np.divmod(found, n)

    def nearest(self, q: np.ndarray, k: int, floor: np.ndarray, allowed) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(i, j, score): of each row of q the k best that are not under its floor, best first, among places for which
        allowed(i, j) holds. Among any best `most` may be forbidden as a row's own id; others are known to be found elsewhere."""
        found = self.picked(q, k + self.most, floor)
        if found is None:
            s = scores(q, self.rows, self.square, self.metric)
            i, j = np.divmod(np.arange(s.size), s.shape[1])
            s[~allowed(i, j).reshape(s.shape)] = -np.inf
            i, j = best(s, k, floor)
            return i, j, s[i, j]
        i, j = found
        on = allowed(i, j)
        i, j = i[on], j[on]
        if self.metric == "euclidean":
            gap = q[i] - self.rows[j]
            s = -np.sqrt(np.einsum("ij,ij->i", gap, gap))
        else:
            s = np.einsum("ij,ij->i", q[i], self.rows[j])
        on = s >= floor[i]
        i, j, s = i[on], j[on], s[on]
        order = np.lexsort((j, -s, i))
        i, j, s = i[order], j[order], s[order]
        first = np.arange(len(i)) - np.searchsorted(i, i) < k
        return i[first], j[first], s[first]


def repeats(ids: np.ndarray) -> int:
    """The most rows of one id."""
    return int(np.unique(ids, return_counts=True)[1].max(initial=0))


def by_pivots(left: DataFrame, right: DataFrame, n_left: int, n_right: int, k: int, metric: str, exclude_self: bool, block_rows: int) -> DataFrame:
    """(src, dst, score), the k best of each left row among others. left, right: obs_id, vec array<double>."""
    spark = right.sparkSession
    pick = right.orderBy(F.xxhash64("obs_id"), "obs_id").limit(min(MAX_PIVOTS, 4 * math.ceil(n_right / block_rows))).select("vec").toArrow().combine_chunks()
    pivots = np.unique(scaled(matrix(pick.to_batches()[0]), metric), axis=0)
    square = F.aggregate("vec", F.lit(0.0), lambda a, v: a + v * v)
    top = 0.0 if metric == "euclidean" else 1.0 if metric == "cosine" else right.agg(F.max(square)).first()[0]
    largest = max(top, 1.0) if metric != "euclidean" else max(1.0, *(d.agg(F.max(square)).first()[0] or 0.0 for d in (left, right)))
    slack = 1e-6 * (1 + math.sqrt(largest))
    lift = lambda x: x if metric == "euclidean" else np.concatenate([x, np.sqrt(np.maximum(top - (x * x).sum(1), 0))[:, None]], 1)
    held = spark.sparkContext.broadcast((pivots, lift(pivots)))

    def from_pivots(x: np.ndarray, side: int) -> np.ndarray:
        """Distances of scaled rows (side 0: left, 1: right) to the pivots."""
        flat, high = held.value
        own, routes = (lift(x), high) if side else (x, flat)
        more = (routes * routes).sum(1) if side or metric == "euclidean" else top
        return np.sqrt(np.maximum((own * own).sum(1)[:, None] + more - 2 * own @ routes.T, 0))

    def near(side: int):
        def run(batches):
            for batch in batches:
                for at in range(0, batch.num_rows, TOGETHER):
                    part = batch.slice(at, TOGETHER)
                    d = from_pivots(scaled(matrix(part), metric), side)
                    home = d.argmin(1)
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(home, pa.int32()), pa.array(d[np.arange(len(d)), home])], names=["obs_id", "vec", "home", "far"])

        return run

    kinds = [d.schema["obs_id"].dataType.simpleString() for d in (left, right)]
    lo, ro = (written(d.select("obs_id", "vec").mapInArrow(near(i), f"obs_id {kinds[i]}, vec array<double>, home int, far double"), "nearest-rows") for i, d in enumerate((left, right)))
    sizes = {r.home: (r.n, r.far) for r in ro.groupBy("home").agg(F.count("*").alias("n"), F.max("far").alias("far")).collect()}  # MAX_PIVOTS rows at most
    subs = np.array([-(-sizes[b][0] // block_rows) if b in sizes else 0 for b in range(len(pivots))])
    first = np.concatenate([[0], np.cumsum(subs)])
    radius = np.array([sizes[b][1] if b in sizes else 0.0 for b in range(len(pivots))])
    owner = np.repeat(np.arange(len(subs)), subs)
    # units side by side fill shelves, the right rows that a task of the second phase holds
    heights = np.array([sizes[b][0] / subs[b] for b in owner])
    shelf_of = np.unique((np.cumsum(heights) - heights) // SHELF_ROWS, return_inverse=True)[1]
    shelf_first = np.append(np.searchsorted(shelf_of, np.arange(shelf_of[-1] + 1)), len(shelf_of))
    table = F.broadcast(spark.createDataFrame([(b, int(first[b]), int(subs[b])) for b in sizes], "home int, first int, subs int"))
    unit = (F.col("first") + F.pmod(F.xxhash64("obs_id"), F.col("subs"))).cast("int").alias("unit")
    data = ro.join(table, "home").select("obs_id", "vec", unit)
    # a left row's nearest pivot always has rows: the pivots are right rows
    asked = lo.join(table, "home").select("obs_id", "vec", unit)
    cores = spark.sparkContext.defaultParallelism

    def phase(rows: DataFrame, asks: DataFrame, parts: int, slices: int, name: str) -> DataFrame:
        """rows: obs_id, vec, unit, group; asks: obs_id, vec, group, floor, units (bits of the group's units; null: all). A task
        holds a group's rows, which meet a slice of its asks."""
        parts = min(MAX_PARTS, parts)
        held_side = rows.select("group", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"), F.lit(0).alias("side"), F.col("obs_id").alias("dst"), F.lit(None).cast(kinds[0]).alias("src"), "vec", "unit", F.lit(None).cast("double").alias("floor"), F.lit(None).cast("binary").alias("units"))
        asked_side = asks.select("group", F.pmod(F.xxhash64("obs_id"), F.lit(slices)).cast("int").alias("slice"), F.lit(1).alias("side"), F.lit(None).cast(kinds[1]).alias("dst"), F.col("obs_id").alias("src"), "vec", F.lit(0).alias("unit"), "floor", "units")
        dealt = held_side.union(asked_side).repartitionById(parts, F.pmod(F.col("group") * slices + F.col("slice"), F.lit(parts))).sortWithinPartitions("group", "slice", "side", "dst", "units")

        def run(batches):
            now, held_rows, known = None, [], None
            for batch in batches:
                where = batch.column("group").to_numpy().astype(np.int64) * slices + batch.column("slice").to_numpy()
                side = batch.column("side").to_numpy()
                edge = np.flatnonzero(np.append(True, (where[1:] != where[:-1]) | (side[1:] != side[:-1]))) if len(where) else []
                for a, b in zip(edge, [*edge[1:], len(where)], strict=True):
                    part = batch.slice(a, b - a)
                    x = scaled(matrix(part), metric)
                    if where[a] != now:
                        now, held_rows, known = where[a], [], None
                    if not side[a]:
                        held_rows.append((x, part.column("dst"), part.column("unit").to_numpy()))
                        continue
                    if not held_rows:
                        continue
                    if known is None:
                        rows_ = np.concatenate([h[0] for h in held_rows])
                        units_ = np.concatenate([h[2] for h in held_rows])
                        ids = pa.chunked_array([h[1] for h in held_rows]).combine_chunks()
                        names = ids.to_numpy(zero_copy_only=False)
                        known = Table(rows_, metric, repeats(names) if exclude_self else 0), ids, names, units_
                        held_rows = [None]
                    table_, ids, names, units_ = known
                    own_ids, bits = part.column("src"), part.column("units")
                    own_names, floor = own_ids.to_numpy(zero_copy_only=False), part.column("floor").to_numpy(zero_copy_only=False)
                    step = together(len(names))
                    for at in range(0, len(x), step):
                        here, places, go, of = table_, None, None, None
                        if bits.null_count == 0:
                            go = np.unpackbits(np.stack([np.frombuffer(v, np.uint8) for v in bits.slice(at, step).to_pylist()]), axis=1)
                            of = units_ - shelf_first[now // slices]
                            some = go.any(0)[of]
                            if 2 * some.sum() < len(some):  # most rows are excluded for all of these
                                places = np.flatnonzero(some)
                                here, of = table_.take(places), of[places]

                        def allowed(i, j, at=at, go=go, of=of, places=places):
                            # a unit that is excluded for a row holds none of its best, or was met before
                            on = np.ones(len(i), bool) if go is None else go[i, of[j]] > 0
                            return on & (own_names[at + i] != names[j if places is None else places[j]]) if exclude_self else on

                        i, j, s = here.nearest(x[at : at + step], k, floor[at : at + step] - slack, allowed)
                        yield pa.RecordBatch.from_arrays([own_ids.take(pa.array(at + i)), ids.take(pa.array(j if places is None else places[j])), pa.array(s, pa.float64())], names=["src", "dst", "score"])

        return written(dealt.mapInArrow(run, f"src {kinds[0]}, dst {kinds[1]}, score double"), name)

    # first, each unit's rows meet the left rows whose home it is; a task has several units
    n_units, n_shelves = len(owner), len(shelf_first) - 1
    unmet = asked.select("obs_id", "vec", F.col("unit").alias("group"), F.lit(float("-inf")).alias("floor"), F.lit(None).cast("binary").alias("units"))
    one = phase(data.withColumn("group", F.col("unit")), unmet, min(n_units, max(n_shelves, 4 * cores)), 1, "nearest-first")
    kth = one.groupBy("src").agg(F.when(F.count("*") >= k, F.min("score")).alias("kth"))
    bounded = asked.join(kth, F.col("obs_id") == F.col("src"), "left").select("obs_id", "vec", "unit", F.coalesce("kth", F.lit(float("-inf"))).alias("floor"))

    def route(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, TOGETHER):
                part = batch.slice(at, TOGETHER)
                x, floor = scaled(matrix(part), metric), part.column("floor").to_numpy()
                reach = (-floor if metric == "euclidean" else np.sqrt(np.maximum((x * x).sum(1) + top - 2 * floor, 0))) + slack
                go = (from_pivots(x, 0) - radius[None] <= reach[:, None] + slack)[:, owner]
                go[np.arange(len(x)), part.column("unit").to_numpy()] = False
                for shelf in range(n_shelves):
                    own = go[:, shelf_first[shelf] : shelf_first[shelf + 1]]
                    some = np.flatnonzero(own.any(1))
                    if len(some):
                        out = part.take(pa.array(some))
                        bits = [v.tobytes() for v in np.packbits(own[some], axis=1)]
                        yield pa.RecordBatch.from_arrays([out.column("obs_id"), out.column("vec"), pa.array(np.full(len(some), shelf, np.int32)), out.column("floor"), pa.array(bits, pa.binary())], names=["obs_id", "vec", "group", "floor", "units"])

    # then each shelf's rows meet the left rows that bounds and radii don't exclude from one of its units or more: a left row goes
    # to a shelf once, whatever the number of units
    routed = bounded.mapInArrow(route, f"obs_id {kinds[0]}, vec array<double>, group int, floor double, units binary")
    shelves = F.broadcast(spark.createDataFrame([(u, int(v)) for u, v in enumerate(shelf_of)], "unit int, group int"))
    slices = max(1, n_left >> 20, min(-(-3 * cores // n_shelves), n_left >> 12))
    return one.union(phase(data.join(shelves, "unit"), routed, n_shelves * slices, slices, "nearest-rest"))
