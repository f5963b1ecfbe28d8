"""Exact top-k search by inner product in an M-tree.

Vectors are lifted by one component to equal length, which turns the greatest inner product into the least
Euclidean distance. The tree's root page holds routing vectors with their covering radii; every row belongs to the
nearest one, and the rows of one (a block) form a subtree of pages: routing vectors, covering radii, and the distance
of each entry to its page's routing vector. Queries go best-first through the pages; stored distances and the triangle
inequality exclude entries before their own distance is computed.

A query first searches the block it lies in. The score of its k-th hit then bounds the distance of better ones, and
it goes on only to the blocks that this bound doesn't exclude at the root."""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.llm.common import written

#: Queries that go through a tree together; each has its own bound.
TOGETHER = 256
#: Spark partitions at most; beyond that a partition holds several subtrees, one after the other.
MOST_PARTS = 1 << 14


class Page:
    """A node. entries: rows of the tree's arrays, for a leaf its vectors, else the children's routing vectors."""

    __slots__ = ("radius", "entries", "to_center", "radii", "children")

    def __init__(self, radius, entries, to_center, radii=None, children=None):
        self.radius, self.entries, self.to_center, self.radii, self.children = radius, entries, to_center, radii, children


class MTree:
    """Over vectors of whole numbers. top: the greatest squared length of all vectors searched, here or elsewhere."""

    def __init__(self, vec_id: np.ndarray, row: np.ndarray, vectors: np.ndarray, top: float, page: int = 32, fan: int = 16):
        self.vec_id, self.row, self.vectors, self.top, self.page, self.fan = vec_id, row, vectors, top, page, fan
        # sums of products of up to 2**22 each side are exact in doubles, larger ones are added up as integers
        self.exact = float(np.abs(vectors).max(initial=0)) < 2**22
        self.lifted = lifted(vectors, top)
        self.slack = slack(top)
        self.computed = self.avoided = 0
        self.root = self.center = None
        if len(row):
            self.center, self.root = self.build(np.arange(len(row)))

    def build(self, rows: np.ndarray) -> tuple[int, Page]:
        """(the routing vector's row, page) of a subtree over rows."""
        x = self.lifted[rows]
        at = int(((x - x.mean(0)) ** 2).sum(1).argmin())
        center, far = int(rows[at]), np.sqrt(((x - x[at]) ** 2).sum(1))
        if len(rows) <= self.page:
            return center, Page(float(far.max()), rows, far)
        picks = x[np.unique(np.linspace(0, len(rows) - 1, min(self.fan, -(-len(rows) // self.page))).astype(int))]
        to = ((picks**2).sum(1)[None] - 2 * x @ picks.T).argmin(1)
        groups = [g for k in range(len(picks)) if len(g := rows[to == k])]
        if max(map(len, groups)) > 0.9 * len(rows):  # equal or hardly separable vectors: cut evenly
            groups = np.array_split(rows[np.argsort(far, kind="stable")], min(self.fan, -(-len(rows) // self.page)))
        children = [self.build(g) for g in groups]
        entries = np.array([c for c, _ in children])
        to_center = np.sqrt(((self.lifted[entries] - self.lifted[center]) ** 2).sum(1))
        return center, Page(float(far.max()), entries, to_center, np.array([p.radius for _, p in children]), [p for _, p in children])

    def pages(self) -> int:
        todo, n = [self.root] if self.root else [], 0
        while todo:
            todo += todo.pop().children or []
            n += 1
        return n

    def scores(self, entries: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Inner products, queries by entries."""
        self.computed += len(entries) * len(q)
        if self.exact and float(np.abs(q).max(initial=0)) < 2**22:
            return (q @ self.vectors[entries].T).astype(np.int64)
        return q.astype(np.int64) @ self.vectors[entries].astype(np.int64).T

    def search(self, q: np.ndarray, own: np.ndarray, floor: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query number, row number, score): for each query the k greatest scores of at least its floor (-inf: no
        floor), ties to the smaller vec_id, without the row `own`."""
        n = len(q)
        length = (q.astype(np.float64) ** 2).sum(1)
        best = np.full((n, k), -np.inf)
        kth = floor.astype(np.float64).copy()
        found: list[tuple] = []
        size = 0

        def reach(of: np.ndarray) -> np.ndarray:
            return np.sqrt(np.maximum(0, length[of] + self.top - 2 * kth[of])) + self.slack

        def distance(entries: np.ndarray, of: np.ndarray) -> np.ndarray:
            self.computed += len(entries) * len(of)
            return np.sqrt(np.maximum(0, length[of][:, None] + self.top - 2 * q[of] @ self.vectors[entries].T))

        everyone = np.arange(n)
        d = distance(np.array([self.center]), everyone)[:, 0]
        todo = [(0.0, 0, d, everyone, self.root)]
        number = 0
        while todo:
            _, _, d, of, page = heapq.heappop(todo)
            limit = reach(of)
            still = d - page.radius <= limit
            d, of, limit = d[still], of[still], limit[still]
            # the distances to the page's routing vector bound those to its entries
            gap = np.abs(d[:, None] - page.to_center[None])
            near = gap <= limit[:, None] if page.children is None else gap - page.radii[None] <= limit[:, None]
            some = near.any(0)
            self.avoided += near.size - len(of) * int(some.sum())
            if not some.any():
                continue
            entries = page.entries[some]
            if page.children is None:
                s = self.scores(entries, q[of])
                fits = near[:, some] & (s >= kth[of][:, None]) & (self.row[entries][None] != own[of][:, None])
                i, j = np.nonzero(fits)
                if len(i):
                    found.append((of[i], entries[j], s[i, j]))
                    size += len(i)
                    best[of] = np.partition(np.concatenate([best[of], np.where(fits, s, -np.inf)], 1), -k, axis=1)[:, -k:]
                    kth[of] = np.maximum(kth[of], best[of].min(1))
                    if size > 64 * n * k:
                        found = [self.first(found, k)]
                        size = len(found[0][0])
            else:
                to = distance(entries, of)
                for at, c in enumerate(np.flatnonzero(some).tolist()):
                    low = to[:, at] - page.radii[c]
                    go = near[:, c] & (low <= limit)
                    if go.any():
                        number += 1
                        heapq.heappush(todo, (max(0.0, float(low[go].min())), number, to[go, at], of[go], page.children[c]))
        return self.first(found, k)

    def first(self, found: list[tuple], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not found:
            return (np.zeros(0, np.int64),) * 3
        who, at, s = (np.concatenate(x) for x in zip(*found, strict=True))
        by = np.lexsort((self.row[at], self.vec_id[at], -s, who))
        who, at, s = who[by], at[by], s[by]
        start = np.flatnonzero(np.append(True, who[1:] != who[:-1]))
        keep = np.arange(len(who)) - np.repeat(start, np.diff(np.append(start, len(who)))) < k
        return who[keep], at[keep], s[keep]


def lifted(x: np.ndarray, top: float) -> np.ndarray:
    return np.concatenate([x, np.sqrt(np.maximum(top - (x**2).sum(1), 0))[:, None]], axis=1)


def slack(top: float) -> float:
    """More than rounding can add to a distance."""
    return 4e-6 * (1 + math.sqrt(top))


def matrix(lists: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column, padded with zeros."""
    size = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    if (size == width).all():
        return flat.reshape(len(size), width)
    out = np.zeros((len(size), width))
    out[np.arange(width)[None] < size[:, None]] = flat
    return out


def whole_numbers(vectors: DataFrame, scale: int = 64) -> DataFrame:
    """(vec_id, v array<double>): floor(scale * component), a row for each row. Vectors that are null, or hold a null or
    a component that isn't finite, and rows with a null vec_id, are left out."""
    v = F.transform(F.col("embedding").cast("array<double>"), lambda x: F.floor(F.lit(float(scale)) * x).cast("double"))
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & fine)
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, block_rows: int = 4096, max_blocks: int = 16_384, slice_queries: int = 1 << 18, page: int = 32) -> DataFrame:
    """vectors (vec_id, v array<double> of whole numbers) -> query_id, rank, vec_id, score: for each row where
    is_query holds, the k other rows with the greatest inner product, ties to the smaller vec_id.

    Rows that repeat, also in vec_id, are candidates of their own; each repeated query row has its own ranks. Shorter
    vectors count as padded with zeros, vec_id is taken as long, other columns are left out. No rows give none. Scores
    that a long can't hold are an error.

    The root page has one routing vector for about block_rows rows, max_blocks at most (they are rows, taken by a hash,
    and go to the driver and every task). A block of many rows (equal vectors lie in one) is dealt into several subtrees
    by a hash. A query visits its own subtree, then all that its bound doesn't exclude; more than slice_queries queries
    are dealt into slices, each of which meets a copy of the subtrees."""
    spark = vectors.sparkSession
    base = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "v", is_query.alias("asks"))
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    n, n_asks, width, top = base.agg(F.count("*"), F.count_if("asks"), F.max(F.size("v")), F.max(square)).first()
    result = "query_id long, rank int, vec_id long, score long"
    if not n or not n_asks:
        return spark.createDataFrame([], result)
    width = max(1, width)
    if top >= 2.0**62:
        raise ValueError("the vectors are too long for scores of 64 bits")
    blocks = min(max_blocks, max(4, -(-n // block_rows)))
    picked = base.select("v", F.xxhash64("vec_id", "v").alias("h")).orderBy("h").limit(blocks).toArrow().column("v").combine_chunks()
    routing = np.unique(matrix(picked, width), axis=0)
    shared = spark.sparkContext.broadcast((routing, lifted(routing, top)))

    def assign(batches):
        routes = shared.value[1]
        for batch in batches:
            x = lifted(matrix(batch.column("v"), width), top)
            near = (routes**2).sum(1)[None] - 2 * x @ routes.T
            home = near.argmin(1)
            far = np.sqrt(((x - routes[home]) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(home, pa.int32()), pa.array(far)], names=[*batch.schema.names, "home", "far"])

    placed = base.mapInArrow(assign, "vec_id long, v array<double>, asks boolean, home int, far double")
    placed = written(placed.withColumn("row", F.monotonically_increasing_id()), "mtree-rows")
    sizes = {x.home: (x.n, x.far) for x in placed.groupBy("home").agg(F.count("*").alias("n"), F.max("far").alias("far")).collect()}  # max_blocks rows at most
    room = 2 * max(block_rows, -(-n // blocks))
    subs = np.array([-(-sizes[b][0] // room) if b in sizes else 0 for b in range(len(routing))])
    first = np.concatenate([[0], np.cumsum(subs)])
    radius = np.array([sizes[b][1] if b in sizes else 0.0 for b in range(len(routing))])
    units = spark.createDataFrame([(b, int(first[b]), int(subs[b])) for b in sizes], "home int, first int, subs int")
    unit = F.col("first") + F.pmod(F.xxhash64("row"), F.col("subs")).cast("int")
    dealt = placed.join(F.broadcast(units), "home").withColumn("unit", unit)

    def phase(queries: DataFrame, slices: int, name: str) -> DataFrame:
        """queries (row, vec_id, v, home, unit, floor) -> hits (asker, query_id, vec_id, score, row)."""
        parts = min(MOST_PARTS, int(first[-1]) * slices)
        every = F.sequence(F.lit(0), F.lit(slices - 1))
        data = dealt.select("unit", F.explode(every).alias("slice"), F.lit(0).alias("kind"), "home", "row", "vec_id", "v", F.lit(None).cast("double").alias("floor"))
        asks = queries.select("unit", F.pmod(F.xxhash64("row", F.lit(1)), F.lit(slices)).cast("int").alias("slice"), F.lit(1).alias("kind"), "home", "row", "vec_id", "v", "floor")
        both = data.union(asks).repartitionById(parts, F.pmod(F.col("unit") * slices + F.col("slice"), F.lit(parts)))

        def run(batches):
            held, tree, now = [], None, None
            for batch in batches:
                where = batch.column("unit").to_numpy().astype(np.int64) * slices + batch.column("slice").to_numpy()
                kind = batch.column("kind").to_numpy()
                edge = np.flatnonzero(np.append(True, (where[1:] != where[:-1]) | (kind[1:] != kind[:-1])))
                for a, b in zip(edge, np.append(edge[1:], len(where)), strict=True):
                    part = batch.slice(a, b - a)
                    if where[a] != now:
                        held, tree, now = [], None, where[a]
                    ids, row, x = part.column("vec_id").to_numpy(), part.column("row").to_numpy(), matrix(part.column("v"), width)
                    if not kind[a]:
                        held.append((ids, row, x))
                        continue
                    if tree is None:
                        if not held:
                            continue
                        tree = MTree(*(np.concatenate(c) for c in zip(*held, strict=True)), top, page)
                    floor = part.column("floor").to_numpy(zero_copy_only=False)
                    for at in range(0, len(ids), TOGETHER):
                        some = slice(at, at + TOGETHER)
                        who, hit, s = tree.search(x[some], row[some], floor[some], k)
                        columns = (row[some][who], ids[some][who], tree.vec_id[hit], s, tree.row[hit])
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["asker", "query_id", "vec_id", "score", "row"])

        ordered = both.sortWithinPartitions("unit", "slice", "kind", "home")
        return written(ordered.mapInArrow(run, "asker long, query_id long, vec_id long, score long, row long"), name)

    asking = dealt.where("asks")
    near = phase(asking.withColumn("floor", F.lit(float("-inf"))), 1, "mtree-near")
    floors = near.groupBy("asker").agg(F.when(F.count("*") >= k, F.min("score").cast("double")).alias("floor"))
    bounded = asking.select("row", "vec_id", "v", "home", "unit").join(floors, F.col("row") == F.col("asker"), "left").select("row", "vec_id", "v", "home", "unit", F.coalesce("floor", F.lit(float("-inf"))).alias("floor"))

    def route(batches):
        """Each query once for every subtree, but the one it has seen, that its bound doesn't exclude."""
        routes = shared.value[0]
        owner = np.repeat(np.arange(len(subs)), subs)
        for batch in batches:
            for at in range(0, batch.num_rows, TOGETHER):
                part = batch.slice(at, TOGETHER)
                x, floor = matrix(part.column("v"), width), part.column("floor").to_numpy()
                length = (x**2).sum(1)
                d = np.sqrt(np.maximum(0, length[:, None] + top - 2 * x @ routes.T))
                reach = np.sqrt(np.maximum(0, length + top - 2 * floor)) + slack(top)
                go = (d - radius[None] <= reach[:, None])[:, owner]
                go[np.arange(len(x)), part.column("unit").to_numpy()] = False
                i, to = np.nonzero(go)
                out = part.take(pa.array(i))
                yield out.set_column(out.schema.get_field_index("unit"), "unit", pa.array(to, pa.int32()))

    routed = bounded.mapInArrow(route, "row long, vec_id long, v array<double>, home int, unit int, floor double")
    rest = phase(routed, max(1, -(-n_asks // slice_queries)), "mtree-rest")
    order = Window.partitionBy("asker").orderBy(F.desc("score"), "vec_id", "row")
    return near.union(rest).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
