"""Graphs as edge lists (src, dst, w), both directions stored, and their Laplacians."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattica.functions.columns import small
from lattica.operators import descent, nearest
from lattica.operators.nearest import by_pivots
from lattica.operators.row_solve import Disks
from lattica.plans.tables import written


def _both(edges: DataFrame) -> DataFrame:
    return edges.union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))


def interaction_graph(ppi: DataFrame, genes: DataFrame, threshold: int = 650, case: str = "upper") -> DataFrame:
    """(src, dst, w=1) over gene_id: scored pairs of two listed features, case folded (`upper`, `lower`, `keep`), without
    self loops, symmetric and distinct. Names that fold together map to all their ids. genes: gene_id, gene."""
    fold = {"upper": F.upper, "lower": F.lower, "keep": lambda c: c}.get(case)
    if fold is None:
        raise ValueError(f"unknown case {case!r}")
    g = small(genes.select("gene_id", fold(F.col("gene")).alias("g")))
    p = ppi.where(F.col("combined_score") >= threshold).select(fold(F.col("gene1")).alias("a"), fold(F.col("gene2")).alias("b"))
    p = p.join(g.select(F.col("gene_id").alias("src"), F.col("g").alias("a")), "a").join(g.select(F.col("gene_id").alias("dst"), F.col("g").alias("b")), "b")
    p = p.where("src <> dst").select("src", "dst", F.lit(1.0).alias("w"))
    return _both(p).distinct()


def _bucketed(points: DataFrame, radius: float, x: str, y: str, carry: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    r = radius if radius > 0 else 1.0
    base = points.select("slice", "obs_id", F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), *carry)
    base = base.withColumns({"gx": F.floor(F.col("x") / r), "gy": F.floor(F.col("y") / r)})
    near = F.explode(F.array(*(F.struct((F.col("gx") + i).alias("gx"), (F.col("gy") + j).alias("gy")) for i in (-1, 0, 1) for j in (-1, 0, 1))))
    spread = base.select(F.col("slice").alias("slice_b"), F.col("obs_id").alias("dst"), F.col("x").alias("xb"), F.col("y").alias("yb"), *(F.col(c).alias(f"{c}_b") for c in carry), near.alias("g"))
    return base.withColumnRenamed("obs_id", "src"), spread.select("slice_b", "dst", "xb", "yb", *(f"{c}_b" for c in carry), "g.gx", "g.gy")


def _near(radius: float):
    return (F.col("x") - F.col("xb")) ** 2 + (F.col("y") - F.col("yb")) ** 2 <= F.lit(float(radius) ** 2)


def near_pairs(points: DataFrame, radius: float, x: str = "x", y: str = "y", carry: tuple[str, ...] = ()) -> DataFrame:
    """(src, dst, and of each column of carry its value c at src and c_b at dst) within slices: pairs at a distance <= radius, no self
    loops. A grid of the radius's width turns the range join into an equi-join over 3 x 3 cells, so that points are shuffled and
    pairs are not; dense cells are split by the adaptive skew join. What is needed of both ends is carried here, as a join by
    src or dst would shuffle all pairs."""
    a, b = _bucketed(points, radius, x, y, carry)
    return a.join(b.withColumnRenamed("slice_b", "slice"), ["slice", "gx", "gy"]).where(_near(radius) & (F.col("src") != F.col("dst"))).select("src", "dst", *carry, *(f"{c}_b" for c in carry))


def radius_graph(points: DataFrame, radius: float, x: str = "x", y: str = "y") -> DataFrame:
    """(src, dst, w=1) within slices: pairs at a distance <= radius, no self loops."""
    return near_pairs(points, radius, x, y).select("src", "dst", F.lit(1.0).alias("w"))


def cross_slice_graph(points: DataFrame, radius: float, x: str = "x", y: str = "y") -> DataFrame:
    """(src, dst, w=1) between slices, in common coordinates, both directions. obs_id must be unique over slices."""
    a, b = _bucketed(points, radius, x, y)
    return a.join(b, ["gx", "gy"]).where(_near(radius) & (F.col("slice") != F.col("slice_b"))).select("src", "dst", F.lit(1.0).alias("w"))


def _unique(points: DataFrame) -> bool:
    """Whether no obs_id repeats, so that pairs of points are pairs of ids."""
    return not points.groupBy("obs_id").agg(F.count("*").alias("n")).where("n > 1").take(1)


def _degrees(edges: DataFrame) -> DataFrame:
    """(obs_id, degree) of distinct edges of weight 1, written: a row for each node that has edges."""
    return written(edges.groupBy(F.col("src").alias("obs_id")).agg(F.count("*").cast("double").alias("degree")), "degrees")


def radius_laplacian(points: DataFrame, radius: float, radius_inter: float | None = None, aligned: tuple[str, str] = ("px", "py"), normalized: bool = False) -> DataFrame:
    """laplacian(radius_graph(points, radius)), or of the spatial_graph if radius_inter is given; normalized: normalize_laplacian of
    that of one radius. Pairs of points are distinct where ids are, so nothing is summed: degrees are counted beside the pairs, and no
    edge is shuffled."""
    if normalized and radius_inter is not None:
        raise ValueError("the normalised Laplacian is made of one radius")
    edges = radius_graph(points, radius) if radius_inter is None else spatial_graph(points, radius, radius_inter, aligned)
    if not _unique(points):
        lap = laplacian(edges)
        return normalize_laplacian(lap) if normalized else lap
    degree = _degrees(edges)
    if not normalized:
        return edges.select("src", "dst", F.lit(-1.0).alias("w")).unionAll(degree.select(F.col("obs_id").alias("src"), F.col("obs_id").alias("dst"), F.col("degree").alias("w")))
    pairs = near_pairs(points.join(degree, "obs_id"), radius, carry=("degree",))
    own = degree.select(F.col("obs_id").alias("src"), F.col("obs_id").alias("dst"), (F.col("degree") / F.sqrt(F.col("degree") * F.col("degree"))).alias("w"))
    return pairs.select("src", "dst", (F.lit(-1.0) / F.sqrt(F.col("degree") * F.col("degree_b"))).alias("w")).unionAll(own)


def row_graph(points: DataFrame, radius: float, radius_inter: float, aligned: tuple[str, str] = ("px", "py")) -> DataFrame | Disks:
    """What `factorize.fit` takes as radius_laplacian(points, radius, radius_inter): the disks around the points where each point has one
    place, x and y, and ids are unique, so that no edge is listed; else the edges. points: with x, y and the aligned columns."""
    same = points.where(~(F.col("x").eqNullSafe(F.col(aligned[0])) & F.col("y").eqNullSafe(F.col(aligned[1]))))
    if same.take(1) or not _unique(points):
        return radius_laplacian(points, radius, radius_inter, aligned)
    return Disks(points.select("slice", "obs_id", "x", "y"), radius, radius_inter)


def radius_adjacency(points: DataFrame, radius: float, eps: float = 1e-12) -> DataFrame:
    """row_normalize(radius_graph(points, radius)), the degrees carried on the points instead of summed over sorted edges."""
    if not _unique(points):
        return row_normalize(radius_graph(points, radius), eps=eps)
    degree = _degrees(radius_graph(points, radius))
    return near_pairs(points.join(degree, "obs_id"), radius, carry=("degree",)).select("src", "dst", (F.lit(1.0) / (F.col("degree") + F.lit(eps))).alias("w"))


def spatial_graph(points: DataFrame, radius_intra: float, radius_inter: float, aligned: tuple[str, str] = ("px", "py")) -> DataFrame:
    """Edges within slices in their own coordinates and between slices in the aligned ones."""
    return radius_graph(points, radius_intra).unionAll(cross_slice_graph(points, radius_inter, *aligned))


def laplacian(edges: DataFrame) -> DataFrame:
    """(src, dst, w): degree on the diagonal, minus the summed weight elsewhere. Isolated nodes have no row."""
    w = edges.where("src <> dst").groupBy("src", "dst").agg(F.sum("w").alias("w"))
    degree = w.groupBy("src").agg(F.sum("w").alias("w"))
    return w.select("src", "dst", (-F.col("w")).alias("w")).unionAll(degree.select("src", F.col("src").alias("dst"), "w"))


def normalize_laplacian(lap: DataFrame) -> DataFrame:
    """D^-1/2 L D^-1/2; rows and columns of degree 0 vanish."""
    d = lap.where("src = dst").where("w > 0")
    a = d.select("src", F.col("w").alias("da"))
    b = d.select("dst", F.col("w").alias("db"))
    return lap.join(a, "src").join(b, "dst").select("src", "dst", (F.col("w") / F.sqrt(F.col("da") * F.col("db"))).alias("w"))


def knn(left: DataFrame, right: DataFrame, k: int, metric: str = "cosine", exclude_self: bool = False, block_rows: int = 65_536) -> DataFrame:
    """(src, dst, rank, score): for each row of left (obs_id, vec) its k best rows of right. metric: `cosine`, `dot`
    (score: greater is nearer) or `euclidean` (score: minus the distance). Ties go to the smaller id; exclude_self leaves
    out the row of the same id. Null vectors and vectors with a non-finite component take no part.

    Exact. Up to block_rows rows of right are held by each task, which streams a block of left past them; more are searched
    by pivots (see nearest.by_pivots), where bounds exclude most of what is far."""
    if metric not in ("cosine", "dot", "euclidean"):
        raise ValueError(f"unknown metric {metric!r}")
    lo, ro = _complete(left), _complete(right)
    n_left, n_right = lo.count(), ro.count()
    found = by_pivots(lo, ro, n_left, n_right, k, metric, exclude_self, block_rows) if n_right > block_rows else _one_block(lo, ro, n_left, k, metric, exclude_self, block_rows)
    order = Window.partitionBy("src").orderBy(F.desc("score"), "dst")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("src", "dst", "rank", "score")


def _complete(rows: DataFrame) -> DataFrame:
    """obs_id, vec array<double> of the rows whose vector is there and finite."""
    fine = F.col("vec").isNotNull() & F.forall("vec", lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < float("inf")))
    return rows.where(fine).select("obs_id", F.col("vec").cast("array<double>").alias("vec"))


def knn_by_descent(rows: DataFrame, k: int, metric: str = "cosine", **options) -> DataFrame:
    """(src, dst, rank, score): about the k nearest other rows of each row, for tables where exact search can't exclude
    enough. metric: `cosine` or `euclidean`; options: see descent.descend. Ids are unique; scores are exact."""
    return descent.descend(_complete(rows), k, metric, **options)


def _one_block(lo: DataFrame, ro: DataFrame, n_left: int, k: int, metric: str, exclude_self: bool, block_rows: int) -> DataFrame:
    """(src, dst, score), a superset of the k best: each task holds all of right (block_rows rows at most)."""
    lb = max(1, math.ceil(n_left / block_rows), min(8, math.ceil(n_left / 256)))
    id_type, left_type = (d.schema["obs_id"].dataType.simpleString() for d in (ro, lo))
    held = ro.select(F.lit(0).alias("side"), F.explode(F.sequence(F.lit(0), F.lit(lb - 1))).alias("l"), "obs_id", "vec")
    asked = lo.select(F.lit(1).alias("side"), F.pmod(F.xxhash64("obs_id"), F.lit(lb)).cast("int").alias("l"), "obs_id", "vec")
    dealt = held.union(asked).repartitionById(lb, F.col("l")).sortWithinPartitions("side", "obs_id")

    def run(batches):
        ids, rows, table = [], [], None
        for batch in batches:
            cut = int(np.searchsorted(batch.column("side").to_numpy(), 1))
            if cut:
                ids.append(batch.column("obs_id").slice(0, cut).to_numpy(zero_copy_only=False))
                rows.append(nearest.matrix(batch.slice(0, cut)))
            if cut == batch.num_rows or not rows:
                continue
            if table is None:
                table_ids = np.concatenate(ids)
                table = nearest.Table(nearest.scaled(np.concatenate(rows), metric), metric, nearest.repeats(table_ids) if exclude_self else 0)
                rows, step = [None], nearest.together(len(table_ids))
            q_ids = batch.column("obs_id").slice(cut).to_numpy(zero_copy_only=False)
            q = nearest.scaled(nearest.matrix(batch.slice(cut)), metric)
            for a in range(0, len(q), step):
                own = q_ids[a : a + step]
                allowed = lambda i, j, own=own: own[i] != table_ids[j] if exclude_self else np.ones(len(i), bool)
                i, j, s = table.nearest(q[a : a + step], k, np.full(len(own), -np.inf), allowed)
                yield pa.RecordBatch.from_arrays([pa.array(own[i]), pa.array(table_ids[j]), pa.array(s, pa.float64())], names=["src", "dst", "score"])

    return dealt.select("side", "obs_id", "vec").mapInArrow(run, f"src {left_type}, dst {id_type}, score double")


def mutual_knn(emb: DataFrame, k: int = 20, metric: str = "cosine", approximate: bool = False) -> DataFrame:
    """(src, dst, w=1): pairs that are among each other's k nearest, self excluded by id; approximate: found by descent."""
    near = (knn_by_descent(emb, k, metric) if approximate else knn(emb, emb, k, metric, exclude_self=True)).select("src", "dst")
    back = near.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return near.join(back, ["src", "dst"], "left_semi").select("src", "dst", F.lit(1.0).alias("w"))


def reference_graph(points: DataFrame, emb: DataFrame, radius: float, k: int = 20, metric: str = "cosine") -> DataFrame:
    """Normalised Laplacian of spots and pseudo-spots: spots of `points` are joined by distance, all others by mutual
    nearness in the embedding (pairs of two spots excepted). emb: obs_id, vec, domain (`st` or else)."""
    mutual = mutual_knn(emb, k, metric)
    st = emb.where("domain = 'st'").select("obs_id")
    is_a = st.select(F.col("obs_id").alias("src"), F.lit(True).alias("a"))
    is_b = st.select(F.col("obs_id").alias("dst"), F.lit(True).alias("b"))
    other = written(mutual.join(is_a, "src", "left").join(is_b, "dst", "left").where("a IS NULL OR b IS NULL").select("src", "dst", "w"), "reference-links")
    if not _unique(points) or not _unique(emb) or points.join(st, "obs_id", "left_anti").take(1):
        return normalize_laplacian(laplacian(radius_graph(points, radius).unionAll(other)))
    # no pair is of both kinds: degrees are carried on the points, and no edge of the plane is shuffled
    both = radius_graph(points, radius).unionAll(other)
    degree = _degrees(both)
    near = near_pairs(points.join(degree, "obs_id"), radius, carry=("degree",))
    at = lambda c, d: degree.select(F.col("obs_id").alias(c), F.col("degree").alias(d))
    far = other.join(at("src", "degree"), "src").join(at("dst", "degree_b"), "dst").select("src", "dst", "degree", "degree_b")
    pairs = near.select("src", "dst", "degree", "degree_b").unionAll(far).select("src", "dst", (F.lit(-1.0) / F.sqrt(F.col("degree") * F.col("degree_b"))).alias("w"))
    return pairs.unionAll(degree.select(F.col("obs_id").alias("src"), F.col("obs_id").alias("dst"), (F.col("degree") / F.sqrt(F.col("degree") * F.col("degree"))).alias("w")))


def coalesce_max(edges: DataFrame) -> DataFrame:
    return edges.groupBy("src", "dst").agg(F.max("w").alias("w"))


def cosine_graph(factors: DataFrame, k: int = 20, symmetric: bool = True, approximate: bool = False) -> DataFrame:
    """(src, dst, w): the k most similar rows of factors (obs_id, vec) to each by cosine, without self loops; symmetric:
    both directions with the larger weight. One row or none: no edges. approximate: found by descent."""
    near = knn_by_descent(factors, k) if approximate else knn(factors, factors, k, "cosine", exclude_self=True)
    e = near.select("src", "dst", F.col("score").alias("w")).where(~F.isnan("w"))
    return coalesce_max(_both(e)) if symmetric else e


def nearest_pseudo(st: DataFrame, ps: DataFrame, k: int = 20) -> DataFrame:
    """(src, dst, rank, score): the k pseudo-spots with the greatest dot product with each spot's unit vector."""
    return knn(st, ps, k, "dot")


def spatial_neighbors(points: DataFrame, k: int = 6) -> DataFrame:
    """(src, dst, w=1): the k nearest points of the same slice in the plane, by distance, then id.

    Each point's search is widened in rings of grid cells of about k points until its k-th distance lies within the
    searched square; points whose slice has fewer than k others get them all. What a round finds, and what it leaves, is
    written, so that no round repeats those before."""
    own = points.select("slice", "obs_id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    stats = own.groupBy("slice").agg(F.count("*").alias("n"), F.max("x").alias("x1"), F.min("x").alias("x0"), F.max("y").alias("y1"), F.min("y").alias("y0"))
    span = F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
    area = F.greatest((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")), F.lit(1e-9))
    stats = stats.select("slice", "n", F.greatest(F.sqrt(area * k / F.col("n")), span * k / F.col("n"), F.lit(1e-9)).alias("cell"), span.alias("span"))
    base = own.join(small(stats), "slice")
    todo, done, rings = base, None, 1
    grid = base.withColumns({"gx": F.floor(F.col("x") / F.col("cell")), "gy": F.floor(F.col("y") / F.col("cell"))})
    targets = grid.select("slice", "gx", "gy", F.col("obs_id").alias("dst"), F.col("x").alias("xb"), F.col("y").alias("yb"))
    while True:
        step = F.sequence(F.lit(-rings), F.lit(rings))
        src = todo.select("slice", F.col("obs_id").alias("src"), "x", "y", "n", "cell", "span", F.explode(step).alias("i")).withColumn("j", F.explode(step))
        src = src.withColumns({"gx": F.floor(F.col("x") / F.col("cell")) + F.col("i"), "gy": F.floor(F.col("y") / F.col("cell")) + F.col("j")})
        d = F.sqrt((F.col("x") - F.col("xb")) ** 2 + (F.col("y") - F.col("yb")) ** 2)
        near = src.join(targets, ["slice", "gx", "gy"]).where("src <> dst").withColumn("d", d)
        near = near.withColumn("r", F.row_number().over(Window.partitionBy("slice", "src").orderBy("d", "dst"))).where(F.col("r") <= k)
        sure = near.withColumns({"worst": F.max("d").over(Window.partitionBy("slice", "src")), "got": F.count("*").over(Window.partitionBy("slice", "src"))})
        whole = F.lit(rings) * F.col("cell") >= F.col("span")
        ok = whole | ((F.col("got") == F.least(F.lit(k), F.col("n") - 1)) & (F.col("worst") <= F.lit(rings) * F.col("cell")))
        found = written(sure.where(ok).select("slice", "src", "dst"), "grid-found")
        done = found if done is None else done.unionAll(found)
        left = todo.join(found.select("slice", F.col("src").alias("obs_id")).distinct(), ["slice", "obs_id"], "left_anti").where((F.col("n") > 1) & (F.lit(rings) * F.col("cell") < F.col("span")))
        left = written(left, "grid-left")
        if not left.take(1):
            return done.select("src", "dst", F.lit(1.0).alias("w"))
        todo, rings = left, rings * 2


def row_normalize(edges: DataFrame, remove_self_loops: bool = True, eps: float = 1e-12) -> DataFrame:
    e = edges.where("src <> dst") if remove_self_loops else edges
    return e.withColumn("w", F.col("w") / (F.sum("w").over(Window.partitionBy("src")) + F.lit(eps)))


def multiply(edges: DataFrame, values: DataFrame) -> DataFrame:
    """(obs_id, key, value): the sparse matrix times a long matrix (obs_id, key, value)."""
    v = values.select(F.col("obs_id").alias("dst"), "key", "value")
    return edges.join(v, "dst").groupBy(F.col("src").alias("obs_id"), "key").agg(F.sum(F.col("w") * F.col("value")).alias("value"))


def smooth(edges: DataFrame, values: DataFrame, include_self: bool = True) -> DataFrame:
    """(obs_id, key, value): each value averaged with its neighbours', (A + I) y / row sums. Nodes without edges keep
    their value."""
    nodes = values.select("obs_id").distinct()
    loops = nodes.select(F.col("obs_id").alias("src"), F.col("obs_id").alias("dst"), F.lit(1.0).alias("w"))
    e = edges.unionAll(loops) if include_self else edges
    v = values.select(F.col("obs_id").alias("dst"), "key", "value")
    total = F.greatest(F.sum("w"), F.lit(1e-12))
    return e.join(v, "dst").groupBy(F.col("src").alias("obs_id"), "key").agg((F.sum(F.col("w") * F.col("value")) / total).alias("value"))


#: Points of a tile, with those around it, that a task aims to hold; entries of a dense piece of a product.
TILE_ROWS, PIECE = 10_000, 1 << 21


def _radius_sums(points: DataFrame, radius: float, values: DataFrame) -> DataFrame:
    """(obs_id, key, value, n): of each point and key the sum of the key's finite values at the neighbours within the radius, and
    their number. obs_id is unique in points. Tiles of the plane go to tasks with the points around them, each with its values in
    arrays; products of small dense pieces take the place of edges, which are not made."""
    r, bound = (radius if radius > 0 else 1.0), float(radius) ** 2
    keys = values.select("key").distinct().withColumn("code", (F.row_number().over(Window.orderBy("key")) - 1).cast("int"))
    keys = written(keys, "radius-keys")  # the vocabulary of keys
    of = keys.select(F.col("key").alias("of"), "code")
    coded = values.join(small(of), F.col("key").eqNullSafe(F.col("of"))).select("obs_id", "code", F.col("value").cast("double").alias("v"))
    packed = coded.groupBy("obs_id").agg(F.collect_list(F.struct("code", "v")).alias("p")).select("obs_id", F.col("p.code").alias("codes"), F.col("p.v").alias("vals"))
    at = points.select("slice", "obs_id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).where("slice IS NOT NULL AND obs_id IS NOT NULL AND x IS NOT NULL AND y IS NOT NULL")
    at = at.withColumns({"gx": F.floor(F.col("x") / r), "gy": F.floor(F.col("y") / r)})
    sizes = at.groupBy("slice", "gx", "gy").agg(F.count("*").alias("n")).agg(F.avg("n")).first()[0] or 1.0
    across = max(1, min(16, int(math.sqrt(TILE_ROWS / sizes))))
    tile = lambda c, i: F.floor((F.col(c) + i) / across)
    tiles = F.explode(F.array_distinct(F.array(*(F.struct(tile("gx", i).alias("tx"), tile("gy", j).alias("ty")) for i in (-1, 0, 1) for j in (-1, 0, 1)))))
    dealt = at.join(packed, "obs_id", "left").withColumn("t", tiles).select("slice", "t.tx", "t.ty", "obs_id", "x", "y", "gx", "gy", "codes", "vals")
    kind = points.schema["obs_id"].dataType.simpleString()

    def run(key: tuple, rows: pa.Table):
        tx, ty = key[1].as_py(), key[2].as_py()
        x, y, gx, gy = (rows.column(c).to_numpy() for c in ("x", "y", "gx", "gy"))
        ids = rows.column("obs_id").combine_chunks()
        codes, vals = (rows.column(c).combine_chunks() for c in ("codes", "vals"))
        size = np.nan_to_num(codes.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
        ends = np.cumsum(size)
        codes, vals = codes.flatten().to_numpy(), vals.flatten().to_numpy()
        cells: dict = {}
        for i, c in enumerate(zip(gx.tolist(), gy.tolist(), strict=True)):
            cells.setdefault(c, []).append(i)
        for (cx, cy), src in cells.items():
            if cx // across != tx or cy // across != ty:
                continue
            dst = np.array([i for a in (-1, 0, 1) for b in (-1, 0, 1) for i in cells.get((cx + a, cy + b), ())])
            dst = dst[size[dst] > 0]
            if not len(dst):
                continue
            src = np.array(src)
            own = np.repeat(np.arange(len(dst)), size[dst])
            take = np.arange(len(own)) + np.repeat(ends[dst] - size[dst] - (np.cumsum(size[dst]) - size[dst]), size[dst])
            found, col = np.unique(codes[take], return_inverse=True)
            v = vals[take]
            wide = max(1, PIECE // len(dst))
            for k in range(0, len(found), wide):
                n = min(wide, len(found) - k)
                on = (col >= k) & (col < k + n)
                place = own[on] * n + col[on] - k
                sums = np.bincount(place, v[on], len(dst) * n).reshape(len(dst), n)
                counts = np.bincount(place, minlength=len(dst) * n).reshape(len(dst), n).astype(np.float64)
                step = max(1, PIECE // max(len(dst), n))
                for a in range(0, len(src), step):
                    s = src[a : a + step]
                    near = ((x[s, None] - x[None, dst]) ** 2 + (y[s, None] - y[None, dst]) ** 2 <= bound) & (s[:, None] != dst[None])
                    near = near.astype(np.float64)
                    c = near @ counts
                    i, j = np.nonzero(c)
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(s[i])), pa.array(found[k + j], pa.int32()), pa.array((near @ sums)[i, j]), pa.array(c[i, j].astype(np.int64))], names=["obs_id", "code", "value", "n"])

    def table(key: tuple, rows: pa.Table) -> pa.Table:
        none = pa.schema([("obs_id", rows.schema.field("obs_id").type), ("code", pa.int32()), ("value", pa.float64()), ("n", pa.int64())])
        return pa.Table.from_batches(list(run(key, rows)), none)

    sums = dealt.groupBy("slice", "tx", "ty").applyInArrow(table, f"obs_id {kind}, code int, value double, n long")
    return sums.join(small(keys), "code").select("obs_id", "key", "value", "n")


def _plain(points: DataFrame, values: DataFrame) -> bool:
    """Whether ids of points are unique and values all finite."""
    v = F.col("value").cast("double")
    return _unique(points) and not values.where(v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))).take(1)


def radius_multiply(points: DataFrame, radius: float, values: DataFrame) -> DataFrame:
    """multiply(radius_graph(points, radius), values), without edges."""
    values = written(values.select("obs_id", "key", "value"), "radius-values")
    if not _plain(points, values):
        return multiply(radius_graph(points, radius), values)
    return _radius_sums(points, radius, values).select("obs_id", "key", "value")


def radius_smooth(points: DataFrame, radius: float, values: DataFrame) -> DataFrame:
    """smooth(radius_graph(points, radius), values), without edges."""
    values = written(values.select("obs_id", "key", "value"), "radius-values")
    if not _plain(points, values):
        return smooth(radius_graph(points, radius), values)
    both = _radius_sums(points, radius, values).unionAll(values.select("obs_id", "key", F.col("value").cast("double"), F.lit(1).cast("long").alias("n")))
    return both.groupBy("obs_id", "key").agg((F.sum("value") / F.greatest(F.sum("n").cast("double"), F.lit(1e-12))).alias("value"))
