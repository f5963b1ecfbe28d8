"""Alignment of neighbouring slices by fused optimal transport, and rigid stacking."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.plans.tables import written

#: Spots of a slice that one pair's task may hold (its plan is dense).
MAX_SPOTS = 6_000


def sinkhorn(cost: np.ndarray, p: np.ndarray, q: np.ndarray, reg: float, steps: int = 200) -> np.ndarray:
    """The entropic transport plan, in logarithms."""
    f, g = np.zeros(len(p)), np.zeros(len(q))
    lp, lq = np.log(p), np.log(q)

    def soft(x, axis):
        m = x.max(axis=axis, keepdims=True)
        return np.squeeze(m, axis) + np.log(np.exp(x - m).sum(axis=axis))

    for _ in range(steps):
        f = reg * (lp - soft((g[None, :] - cost) / reg, 1))
        g = reg * (lq - soft((f[:, None] - cost) / reg, 0))
    return np.exp((f[:, None] + g[None, :] - cost) / reg)


def fused_transport(xa: np.ndarray, xb: np.ndarray, a: np.ndarray, b: np.ndarray, alpha: float = 0.1, steps: int = 30) -> np.ndarray:
    """A plan between two slices that trades expression cost (1 - alpha) against distortion of distances (alpha), by
    mirror descent with entropic projections. xa, xb: expression rows; a, b: coordinates."""

    def shares(x):
        y = np.maximum(x, 0) + 0.01
        return y / y.sum(1, keepdims=True)

    pa_, pb_ = shares(xa), shares(xb)
    cost = (pa_ * np.log(pa_)).sum(1)[:, None] - pa_ @ np.log(pb_).T
    ca, cb = (np.sqrt(np.maximum(((x[:, None] - x[None]) ** 2).sum(2), 0)) for x in (a, b))
    scale = max(ca.max(), cb.max(), 1e-12)
    ca, cb = ca / scale, cb / scale
    cost = cost / max(cost.max(), 1e-12)
    p, q = np.full(len(a), 1 / len(a)), np.full(len(b), 1 / len(b))
    plan = np.outer(p, q)
    for _ in range(steps):
        distortion = (ca**2 @ p)[:, None] + (cb**2 @ q)[None, :] - 2 * ca @ plan @ cb.T
        plan = sinkhorn((1 - alpha) * cost + 2 * alpha * distortion, p, q, 0.01, 50)
    return plan


def align_pairs(rows: DataFrame, alpha: float = 0.1) -> DataFrame:
    """(pair, i, j, p): the transport plans of neighbouring slices (natural order), one task a pair. rows: slice, obs_id, x,
    y, vec (expression over common features). Entries under 1e-12 are left out."""
    names = slice_names(rows)
    most = rows.groupBy("slice").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
    if most > MAX_SPOTS:
        raise ValueError(f"a slice of {most} spots is too large for a dense plan; thin it or bin it first")
    number = F.create_map(*(F.lit(v) for i, s in enumerate(names) for v in (s, i)))[F.col("slice")]
    both = F.explode(F.array_distinct(F.array(F.greatest(number - 1, F.lit(0)), F.least(number, F.lit(len(names) - 2)))))
    dealt = rows.select(number.alias("number"), both.alias("pair"), F.col("obs_id").cast("long").alias("obs_id"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), F.col("vec").cast("array<double>").alias("vec"))

    def run(t: pa.Table) -> pa.Table:
        pair = t.column("pair")[0].as_py()
        t = t.sort_by("obs_id")
        n = t.column("number").to_numpy()
        side = [t.filter(pa.array(n == pair + k)) for k in (0, 1)]
        x = [np.array(s.column("vec").to_pylist(), float) for s in side]
        c = [np.stack([s.column("x").to_numpy(), s.column("y").to_numpy()], 1) for s in side]
        plan = fused_transport(x[0], x[1], c[0], c[1], alpha)
        i, j = np.nonzero(plan > 1e-12)
        ids = [s.column("obs_id").to_numpy() for s in side]
        return pa.table({"pair": pa.array(np.full(len(i), pair), pa.int32()), "i": ids[0][i], "j": ids[1][j], "p": plan[i, j]})

    return dealt.groupBy("pair").applyInArrow(run, "pair int, i long, j long, p double")


def binned(rows: DataFrame, most: int) -> DataFrame:
    """rows (slice, obs_id, x, y, vec), where a slice of more than `most` spots is replaced by the means of about so many square
    cells; their obs_id is a number of their own."""
    box = rows.groupBy("slice").agg(F.count("*").alias("n"), *(f(c).alias(f"{n}{c}") for c in "xy" for n, f in (("low", F.min), ("high", F.max))))
    width = F.sqrt(F.greatest((F.col("highx") - F.col("lowx")) * (F.col("highy") - F.col("lowy")), F.lit(1e-12)) / most)
    sized = rows.join(F.broadcast(box.select("slice", "n", "lowx", "lowy", width.alias("width"))), "slice")  # a row a slice
    few = sized.where(F.col("n") <= most).select("slice", F.col("obs_id").cast("long").alias("obs_id"), "x", "y", "vec")
    at = [F.floor((F.col(c) - F.col(f"low{c}")) / F.col("width")).alias(f"c{c}") for c in "xy"]
    cells = sized.where(F.col("n") > most).select("slice", *at, "x", "y", "vec")
    means = cells.groupBy("slice", "cx", "cy").agg(F.avg("x").alias("x"), F.avg("y").alias("y"))
    each = cells.select("slice", "cx", "cy", F.posexplode("vec").alias("i", "v")).groupBy("slice", "cx", "cy", "i").agg(F.avg("v").alias("v"))
    vec = each.groupBy("slice", "cx", "cy").agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("v")).select("slice", "cx", "cy", F.col("v.v").alias("vec"))
    named = means.join(vec, ["slice", "cx", "cy"]).select("slice", (F.col("cx") * 1_000_003 + F.col("cy")).cast("long").alias("cell"), "x", "y", "vec")
    return few.union(named.select("slice", "cell", "x", "y", "vec"))


def pair_moves(points: DataFrame, plans: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """pair -> (turn, shift) that lay slice pair + 1 onto slice pair: the weighted centroids and the 2 x 2 cross-covariance of its
    plan are plain aggregates. points: number (of the slice), obs_id, x, y."""
    at = points.select("number", "obs_id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    a = at.select(F.col("number").alias("pair"), F.col("obs_id").alias("i"), F.col("x").alias("ax"), F.col("y").alias("ay"))
    b = at.select((F.col("number") - 1).alias("pair"), F.col("obs_id").alias("j"), F.col("x").alias("bx"), F.col("y").alias("by"))
    t = plans.join(a, ["pair", "i"]).join(b, ["pair", "j"])
    sums = [F.sum("p").alias("n")] + [F.sum(F.col("p") * F.col(c)).alias(c) for c in ("ax", "ay", "bx", "by")] + [F.sum(F.col("p") * F.col(u) * F.col(v)).alias(u + v) for u in ("ax", "ay") for v in ("bx", "by")]
    out = {}
    for r in t.groupBy("pair").agg(*sums).collect():
        ma, mb = np.array([r["ax"], r["ay"]]) / r["n"], np.array([r["bx"], r["by"]]) / r["n"]
        cross = np.array([[r[u + v] for v in ("bx", "by")] for u in ("ax", "ay")]) / r["n"] - np.outer(ma, mb)
        u, _, vh = np.linalg.svd(cross)
        own = u @ np.diag([1, np.sign(np.linalg.det(u @ vh)) or 1]) @ vh
        out[r["pair"]] = own, ma - own @ mb
    return out


def numbered(rows: DataFrame, names: list) -> DataFrame:
    return rows.withColumn("number", F.create_map(*(F.lit(v) for i, s in enumerate(names) for v in (s, i)))[F.col("slice")])


def moved(points: DataFrame, names: list, moves: dict) -> DataFrame:
    """points with px, py: each slice is laid onto the one before, one after another."""
    turn, shift = [np.eye(2)], [np.zeros(2)]
    for k in range(len(names) - 1):
        own, by = moves[k]
        turn.append(turn[k] @ own)
        shift.append(turn[k] @ by + shift[k])
    spark = points.sparkSession
    table = spark.createDataFrame([(s, *map(float, turn[k].ravel()), *map(float, shift[k])) for k, s in enumerate(names)], f"slice {points.schema['slice'].dataType.simpleString()}, a double, b double, c double, d double, e double, f double")
    out = points.drop("px", "py").join(F.broadcast(table) if len(names) <= 10_000 else table, "slice")
    return out.withColumns({"px": F.col("a") * F.col("x") + F.col("b") * F.col("y") + F.col("e"), "py": F.col("c") * F.col("x") + F.col("d") * F.col("y") + F.col("f")}).drop("a", "b", "c", "d", "e", "f")


def slice_names(rows: DataFrame) -> list:
    names = [r[0] for r in rows.select("slice").distinct().orderBy("slice").collect()]
    if len(names) < 2:
        raise ValueError("alignment needs two slices at least")
    return names


def stack_slices(points: DataFrame, plans: DataFrame) -> DataFrame:
    """points (slice, obs_id, x, y) with aligned px, py, by the plans of neighbouring slices."""
    names = slice_names(points)
    return moved(points, names, pair_moves(numbered(points, names), plans))


def best_matches(placed: DataFrame, radius: float, alpha: float, sample: int, sizes: dict) -> DataFrame:
    """(pair, i, j, p = 1): spots of neighbouring slices that are each other's best within the radius, by expression (1 - alpha)
    and distance (alpha), both relative to their means. placed: number, obs_id, px, py, vec. Of the later slice `sample` spots or
    so take part, picked by a hash; three numbers are to be found. A grid of the radius's width makes the search a join."""
    cell = [F.floor(F.col(c) / radius).alias(f"g{c}") for c in ("px", "py")]
    share = (F.lit(float(sample)) / F.create_map(*(F.lit(v) for kv in sizes.items() for v in kv))[F.col("number")]) * 2.0**63
    b = placed.where((F.col("number") > 0) & (F.abs(F.xxhash64("obs_id", F.lit(17)).cast("double")) <= share))
    b = b.select((F.col("number") - 1).alias("pair"), F.col("obs_id").alias("j"), F.col("px").alias("bx"), F.col("py").alias("by"), F.col("vec").alias("bv"), *cell)
    near = F.explode(F.array(*(F.struct((F.floor(F.col("px") / radius) + i).alias("gpx"), (F.floor(F.col("py") / radius) + j).alias("gpy")) for i in (-1, 0, 1) for j in (-1, 0, 1))))
    a = placed.select(F.col("number").alias("pair"), F.col("obs_id").alias("i"), F.col("px").alias("ax"), F.col("py").alias("ay"), F.col("vec").alias("av"), near.alias("g")).select("pair", "i", "ax", "ay", "av", "g.gpx", "g.gpy")
    square = (F.col("ax") - F.col("bx")) ** 2 + (F.col("ay") - F.col("by")) ** 2
    other = F.aggregate(F.zip_with("av", "bv", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda t, v: t + v)
    met = a.join(b, ["pair", "gpx", "gpy"]).where(square <= radius**2).select("pair", "i", "j", square.alias("far"), other.alias("other"))
    mean = met.groupBy("pair").agg(F.greatest(F.avg("far"), F.lit(1e-300)).alias("mf"), F.greatest(F.avg("other"), F.lit(1e-300)).alias("mo"))
    scored = met.join(F.broadcast(mean), "pair").select("pair", "i", "j", ((1 - alpha) * F.col("other") / F.col("mo") + alpha * F.col("far") / F.col("mf")).alias("cost"))  # a row a pair
    for_a = scored.groupBy("pair", "i").agg(F.min(F.struct("cost", "j")).alias("m")).select("pair", "i", F.col("m.j").alias("j"))
    for_b = scored.groupBy("pair", "j").agg(F.min(F.struct("cost", "i")).alias("m")).select("pair", F.col("m.i").alias("i"), "j")
    return for_a.join(for_b, ["pair", "i", "j"]).select("pair", "i", "j", F.lit(1.0).alias("p"))


def register(rows: DataFrame, alpha: float = 0.1, cells: int = 1000, rounds: int = 6, sample: int = 5000) -> DataFrame:
    """rows (slice, obs_id, x, y, vec) without vec, with px, py: neighbouring slices laid onto each other by a turn and a shift.

    First fused transport between at most `cells` cell means of each slice (a pair's task holds two of them and their plan), then
    rounds in which single spots are matched near where they lie and the turn is found anew; the radius falls from three cells to
    one and a half times the spots' spacing. Slices of any size; every spot is returned."""
    rows = written(rows.select("slice", "obs_id", *(F.col(c).cast("double").alias(c) for c in "xy"), F.col("vec").cast("array<double>").alias("vec")), "registration-rows")
    names = slice_names(rows)
    coarse = written(binned(rows, cells), "registration-cells")
    moves = pair_moves(numbered(coarse, names), align_pairs(coarse, alpha))
    box = numbered(rows.groupBy("slice").agg(F.count("*").alias("n"), ((F.max("x") - F.min("x")) * (F.max("y") - F.min("y"))).alias("area")), names).collect()  # a row a slice
    sizes = {r["number"]: r["n"] for r in box}
    start = 3 * max(np.sqrt(max(r["area"], 1e-12) / min(cells, r["n"])) for r in box)
    least = 1.5 * max(np.sqrt(max(r["area"], 1e-12) / r["n"]) for r in box)
    for k in range(rounds):
        placed = numbered(moved(rows, names, moves), names)
        found = pair_moves(numbered(rows, names), best_matches(placed, max(start * 0.6**k, least), alpha, sample, sizes))
        moves = {**moves, **found}
    return moved(rows.drop("vec"), names, moves)
