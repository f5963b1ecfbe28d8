"""Communities of a weighted graph by modularity, by rounds of joins: no task holds a graph.

Local moving: in a round every node weighs its neighbouring communities against its own, by the sums of weights to them and the
communities' total degrees; a random half of those that would gain move. It ends when no node would gain. Refinement: within
each community single nodes join parts that stay put in that round, so parts are connected. The parts become the nodes
of the next level, which starts from the communities. When a level changes nothing, nodes are moved once more one by one.

Weights are whole multiples of 2^-20, so sums don't depend on their order, and halves are drawn by hashes of nodes and
rounds: the result is the same for any number of partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.plans.tables import discard, written

UNIT = 1 << 20
#: Rounds of one local moving, rounds of one refinement, levels. Far more than are needed; each moves half of what would gain.
MOVES, MERGES, LEVELS = 60, 6, 20
#: A level is left when no more than this share of its nodes would still gain; the last moving ends when none would.
ENOUGH = 0.2
#: Stands for an id that is null, so that joins keep its node: the least long, which sorts first as null does.
NO_ID = -(1 << 63)


def _known(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(NO_ID))


def _given(c: str) -> Column:
    return F.when(F.col(c) != NO_ID, F.col(c))


class Graph:
    """Nodes are the ids of a slice, whose number is sl. edges: sl, u, v, w (long), d (long), both directions, without loops; d is
    u's degree, loops included; scale: sl, slice, m2, the sum of all degrees."""

    def __init__(self, edges: DataFrame, scale: DataFrame, resolution: float, seed: int):
        self.edges, self.scale, self.resolution, self.seed = edges, scale, resolution, seed

    def gain(self, k: Column, d: Column, total: Column) -> Column:
        return k.cast("double") - F.lit(self.resolution) * d.cast("double") * total.cast("double") / F.greatest(F.col("m2"), F.lit(1)).cast("double")

    def with_scale(self, df: DataFrame) -> DataFrame:
        return df.join(F.broadcast(self.scale), "sl")  # a row a slice

    def drawn(self, salt: int) -> Column:
        return F.pmod(F.xxhash64("slice", "u", F.lit(self.seed * 1_000_003 + salt)), F.lit(2)) == 0


def best_moves(g: Graph, labels: DataFrame) -> DataFrame:
    """(sl, u, to): nodes whose best community isn't theirs. labels: sl, u, d, c. Edges are shuffled twice: to the label of one end,
    which brings its community's total, and to the other end, where all of a node is added up and compared."""
    totals = labels.groupBy("c", "sl").agg(F.sum("d").alias("total"))
    known = labels.join(totals, ["c", "sl"])
    around = g.edges.join(known.select(F.col("u").alias("v"), "sl", "c", "total"), ["v", "sl"]).select("u", "sl", "c", F.col("w").alias("k"), "d", "total", F.lit(False).alias("own"))
    own = known.select("u", "sl", "c", F.lit(0).cast("long").alias("k"), "d", "total", F.lit(True).alias("own"))
    sums = around.union(own).repartition("u", "sl").groupBy("u", "sl", "c").agg(F.sum("k").alias("k"), F.max("d").alias("d"), F.max("total").alias("total"), F.max("own").alias("own"))
    gain = g.gain(F.col("k"), F.col("d"), F.col("total") - F.when(F.col("own"), F.col("d")).otherwise(0))
    scored = g.with_scale(sums).select("u", "sl", "c", "own", gain.alias("gain"))
    ranked = scored.groupBy("u", "sl").agg(F.min(F.struct((-F.col("gain")).alias("loss"), (~F.col("own")).alias("other"), F.col("c").alias("to"))).alias("best"), F.max(F.when(F.col("own"), F.col("gain"))).alias("now"))
    # a gain of a billionth of the weights is none
    return ranked.where(F.col("best.other") & (-F.col("best.loss") > F.col("now") + 1e-9 * F.abs("now") + 1e-9)).select("sl", "u", "best.to")


def move(g: Graph, labels: DataFrame, salt: int, left: float = 0.0) -> DataFrame:
    """Labels (sl, u, d, c) after local moving; it ends when at most the share `left` of the nodes would gain."""
    for i in range(MOVES):
        wanted = g.with_scale(labels.join(best_moves(g, labels), ["u", "sl"], "left")).withColumn("go", F.col("to").isNotNull() & g.drawn(salt + i))
        new = written(wanted.select("sl", "u", "d", F.when(F.col("go"), F.col("to")).otherwise(F.col("c")).alias("c"), F.col("to").isNotNull().alias("wants")), "community-labels")
        n, wants = new.agg(F.count("*"), F.count_if("wants")).first()
        discard(labels)
        labels = of_file(new, "sl", "u", "d", "c")
        if wants <= left * n:
            break
    return labels


def of_file(df: DataFrame, *columns: str) -> DataFrame:
    """Some columns of a written table, which can still be discarded."""
    out = df.select(*columns)
    out.written_to = df.written_to
    return out


def refine(g: Graph, labels: DataFrame, salt: int) -> DataFrame:
    """(sl, u, d, c, s): s is the part of its community that a node belongs to; parts are connected."""
    at = lambda node, c: labels.select("sl", F.col("u").alias(node), F.col("c").alias(c))
    inside = written(g.edges.join(at("v", "cv"), ["v", "sl"]).join(at("u", "cu"), ["u", "sl"]).where("cu = cv").select("sl", "u", "v", "w"), "community-inside")
    parts = written(labels.select("sl", "u", "d", "c", F.col("u").alias("s")), "community-parts")
    for i in range(MERGES):
        sizes = parts.groupBy("s", "sl").agg(F.sum("d").alias("total"), F.count("*").alias("n"))
        state = g.with_scale(parts.join(sizes, ["s", "sl"])).withColumn("goes", (F.col("n") == 1) & g.drawn(salt + i))
        movers = state.where("goes").select("u", "sl", "d", "m2")
        rest = state.where(~F.col("goes")).select(F.col("u").alias("v"), "sl", "s", "total")
        # joined on u last, the sums stay where they are
        around = inside.join(rest, ["v", "sl"]).join(movers, ["u", "sl"]).groupBy("u", "sl", "s").agg(F.sum("w").alias("k"), *(F.max(c).alias(c) for c in ("d", "total", "m2")))
        scored = around.withColumn("gain", g.gain(F.col("k"), F.col("d"), F.col("total"))).where("gain > 0")
        joins = scored.groupBy("u", "sl").agg(F.min(F.struct((-F.col("gain")).alias("loss"), "s")).alias("best")).select("u", "sl", F.col("best.s").alias("to"))
        new = written(parts.join(joins, ["u", "sl"], "left").select("sl", "u", "d", "c", F.coalesce("to", "s").alias("s"), F.col("to").isNotNull().alias("moved")), "community-parts")
        n, moved = new.agg(F.count("*"), F.count_if("moved")).first()
        discard(parts)
        parts = of_file(new, "sl", "u", "d", "c", "s")
        if i % 2 and moved <= n // 50:
            break
    discard(inside)
    return parts


def _numbered(edges: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(edges sl, u, v, w with loops; nodes sl, u, d; scale sl, slice, m2) of edges slice, src, dst, w and nodes slice, obs_id."""
    slices = written(nodes.select("slice").distinct().select("slice", F.row_number().over(Window.orderBy("slice")).alias("sl")), "community-slices")  # a row a slice
    of = lambda df: df.join(F.broadcast(slices.withColumnRenamed("slice", "name")), F.col("slice").eqNullSafe(F.col("name")))
    every = written(of(edges).select("sl", _known("src").alias("u"), _known("dst").alias("v"), F.round(F.col("w") * UNIT).cast("long").alias("w")).groupBy("u", "sl", "v").agg(F.sum("w").alias("w")).where("w > 0"), "community-edges")
    degree = every.groupBy("u", "sl").agg(F.sum("w").alias("d"))
    base = written(of(nodes).select("sl", _known("obs_id").alias("u")).distinct().join(degree, ["u", "sl"], "left").select("sl", "u", F.coalesce("d", F.lit(0)).alias("d")), "community-nodes")
    scale = written(base.groupBy("sl").agg(F.sum("d").alias("m2")).join(F.broadcast(slices), "sl").select("sl", "slice", "m2"), "community-scale")
    return every, base, scale


def _with_degrees(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    return written(edges.where("u <> v").join(nodes.select("u", "sl", "d"), ["u", "sl"]).select("sl", "u", "v", "w", "d"), "community-edges")


def communities(edges: DataFrame, nodes: DataFrame, resolution: float = 1.0, seed: int = 0) -> DataFrame:
    """(slice, obs_id, cluster): communities of each slice's graph, 0.. by falling size. edges: slice, src, dst, w >= 0, in both
    directions; nodes: slice, obs_id. A node without edges is a community of its own; edges of unknown nodes are an error of
    the caller. Loops count as weight of their node."""
    every, base, scale = _numbered(edges, nodes)
    whole = Graph(_with_degrees(every, base), scale, resolution, seed)
    discard(every)
    member = written(base.select("sl", F.col("u").alias("node"), "u"), "community-members")
    labels = written(base.select("sl", "u", "d", F.col("u").alias("c")), "community-labels")
    g = whole
    for level in range(LEVELS):
        labels = move(g, labels, 1000 * level, ENOUGH)
        n, k = labels.agg(F.count("*"), F.count_distinct("sl", "c")).first()
        if n == k:
            break
        parts = refine(g, labels, 1000 * level + 500)
        fewer = parts.select("sl", "s").distinct().count()
        # where no part has two nodes, the communities become nodes
        up = written(parts.select("sl", "u", "c", F.col("s" if fewer < n else "c").alias("s"), "d"), "community-parts")
        first = up.groupBy("s", "sl").agg(F.sum("d").alias("d"), F.first("c").alias("c"))
        new = written(first.select("sl", F.col("s").alias("u"), "d", "c"), "community-labels")
        to = lambda node, s, up=up: up.select("sl", F.col("u").alias(node), F.col("s").alias(s))
        e = g.edges.join(to("v", "b"), ["v", "sl"]).join(to("u", "a"), ["u", "sl"]).where("a <> b").groupBy("a", "sl", "b").agg(F.sum("w").alias("w"))
        above = Graph(_with_degrees(e.select("sl", F.col("a").alias("u"), F.col("b").alias("v"), "w"), new), scale, resolution, seed)
        grown = written(member.join(to("u", "s"), ["u", "sl"]).select("sl", "node", F.col("s").alias("u")), "community-members")
        if g is not whole:
            discard(g.edges)
        discard(member, labels, parts, up)
        g, member, labels = above, grown, new
    found = member.join(labels.select("sl", "u", "c"), ["u", "sl"]).select("sl", F.col("node").alias("u"), "c")
    found = move(whole, written(found.join(base, ["u", "sl"]).select("sl", "u", "d", "c"), "community-labels"), 1000 * LEVELS)
    sizes = found.groupBy("c", "sl").agg(F.count("*").alias("n"), F.min("u").alias("first"))
    rank = F.row_number().over(Window.partitionBy("sl").orderBy(F.desc("n"), "first")) - 1
    return whole.with_scale(found.join(sizes.select("c", "sl", rank.cast("int").alias("cluster")), ["c", "sl"])).select("slice", _given("u").alias("obs_id"), "cluster")


def improving_moves(edges: DataFrame, found: DataFrame, resolution: float = 1.0) -> DataFrame:
    """(slice, obs_id): nodes of a partition (slice, obs_id, cluster) that would gain by moving to a neighbour's community."""
    every, base, scale = _numbered(edges, found.select("slice", "obs_id"))
    own = found.join(F.broadcast(scale.select("sl", F.col("slice").alias("name"))), F.col("slice").eqNullSafe(F.col("name"))).select("sl", _known("obs_id").alias("u"), F.col("cluster").cast("long").alias("c"))
    g = Graph(_with_degrees(every, base), scale, resolution, 0)
    return g.with_scale(best_moves(g, base.join(own, ["u", "sl"]))).select("slice", _given("u").alias("obs_id"))


def modularity(edges: DataFrame, found: DataFrame, resolution: float = 1.0) -> DataFrame:
    """(slice, modularity) of a partition (slice, obs_id, cluster)."""
    of = lambda a, b: found.select("slice", F.col("obs_id").alias(a), F.col("cluster").alias(b))
    e = edges.join(of("src", "a"), ["slice", "src"]).join(of("dst", "b"), ["slice", "dst"])
    inner = e.groupBy("slice").agg(F.sum(F.when(F.col("a") == F.col("b"), F.col("w")).otherwise(0.0)).alias("inner"), F.sum("w").alias("m2"))
    totals = e.groupBy("slice", "a").agg(F.sum("w").alias("t")).groupBy("slice").agg(F.sum(F.col("t") * F.col("t")).alias("t2"))
    return inner.join(totals, "slice").select("slice", (F.col("inner") / F.col("m2") - F.lit(resolution) * F.col("t2") / (F.col("m2") * F.col("m2"))).alias("modularity"))
