"""Evaluation metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattica.functions.columns import finite
from lattica.operators.graphs import knn
from lattica.plans.tables import discard, written


def adjusted_rand_index(obs: DataFrame, truth: str, pred: str) -> DataFrame:
    """One row (ari). Rows with a null truth are left out. One group on both sides, or singletons on both: 1."""
    table = obs.where(F.col(truth).isNotNull()).groupBy(F.col(truth).alias("a"), F.col(pred).alias("b")).agg(F.count("*").cast("double").alias("n"))

    def pairs(n):
        return n * (n - 1) / 2

    one = table.agg(F.sum(pairs(F.col("n"))).alias("s"), F.sum("n").alias("n"))
    a = table.groupBy("a").agg(F.sum("n").alias("n")).agg(F.sum(pairs(F.col("n"))).alias("sa"))
    b = table.groupBy("b").agg(F.sum("n").alias("n")).agg(F.sum(pairs(F.col("n"))).alias("sb"))
    x = one.crossJoin(F.broadcast(a)).crossJoin(F.broadcast(b))  # one row each
    expected = F.col("sa") * F.col("sb") / F.nullif(pairs(F.col("n")), F.lit(0.0))
    most = (F.col("sa") + F.col("sb")) / 2
    return x.select(F.when(most == expected, 1.0).otherwise((F.col("s") - expected) / (most - expected)).alias("ari"))


def inverse_simpson(neighbors: DataFrame, labels: DataFrame) -> DataFrame:
    """(obs_id, lisi): effective number of labels among each node's neighbours. neighbors: src, dst; labels: obs_id, label."""
    n = neighbors.join(labels.select(F.col("obs_id").alias("dst"), "label"), "dst").groupBy("src", "label").agg(F.count("*").cast("double").alias("n"))
    s = n.groupBy("src").agg((F.sum("n") ** 2 / F.sum(F.col("n") * F.col("n"))).alias("lisi"))
    return s.withColumnRenamed("src", "obs_id")


def scale_lisi(lisi: DataFrame, labels: DataFrame) -> DataFrame:
    """(obs_id, lisi) to [0, 1] by the number of labels; one label only: 1."""
    b = labels.agg(F.count_distinct("label").cast("double").alias("b"))
    return lisi.crossJoin(F.broadcast(b)).select("obs_id", F.when(F.col("b") <= 1, 1.0).otherwise((F.col("lisi") - 1) / (F.col("b") - 1)).alias("lisi"))


def graph_neighbors(emb: DataFrame, n_neighbors: int = 15, k0: int = 90, include_self: bool = False, standardize: bool = False) -> DataFrame:
    """(src, dst): the k0 nodes nearest to each by path length in the undirected k-nearest-neighbour graph of emb
    (obs_id, vec), ties by id; fewer if fewer are reachable."""
    if standardize:
        size = emb.select(F.size("vec")).first()[0]
        stats = emb.agg(*(f(F.get("vec", i)).alias(f"{n}{i}") for i in range(size) for n, f in (("m", F.avg), ("s", F.stddev_pop)))).first()
        emb = emb.withColumn("vec", F.array(*((F.get("vec", i) - F.lit(stats[f"m{i}"])) / F.lit(max(stats[f"s{i}"] or 0.0, 1e-12)) for i in range(size))))
    near = knn(emb, emb, n_neighbors, "euclidean", exclude_self=True)
    e = near.select("src", "dst", (-F.col("score")).alias("d"))
    e = e.union(e.select("dst", "src", "d")).groupBy("src", "dst").agg(F.min("d").alias("d"))
    found = nearest_by_path(e, k0 + (not include_self))
    return found.select("src", "dst") if include_self else found.where("src <> dst").select("src", "dst")


def nearest_by_path(edges: DataFrame, k: int) -> DataFrame:
    """(src, dst, d): for each node that has an edge the k nodes nearest by path length, itself included with 0, ties by id.
    edges: src, dst, d >= 0, in both directions, each pair once.

    All sources go on together, edge by edge. A source keeps its k nearest nodes so far; in a round those that are new or nearer than
    before pass on to their neighbours, unless the k-th of the source is nearer still. A path to one of the k nearest goes only
    over others of them, so nothing is lost, and no more than a node's k nearest neighbours can matter. A round is a join of
    the sources' new nodes with their neighbours and a grouped minimum; rounds end when nothing is new."""
    order = lambda a, b: F.when(a["d"] < b["d"], -1).when(a["d"] > b["d"], 1).when(a["node"] < b["node"], -1).when(a["node"] > b["node"], 1).otherwise(0)
    first = lambda c: F.slice(F.array_sort(c, order), 1, k)
    lists = written(edges.groupBy("src").agg(first(F.collect_list(F.struct("d", F.col("dst").alias("node")))).alias("near")).withColumnRenamed("src", "u"), "path-neighbours")
    start = F.array(F.struct(F.lit(0.0).alias("d"), F.col("u").alias("node"), F.lit(True).alias("new")))
    now = written(lists.select(F.col("u").alias("src"), start.alias("best")), "path-nearest")
    while True:
        bound = F.when(F.size("best") >= k, F.element_at("best", k)["d"]).otherwise(float("inf"))
        one = now.select("src", bound.alias("bound"), F.explode("best").alias("x"))
        ahead = one.where("x.new").select("src", "bound", F.col("x.d").alias("d0"), F.col("x.node").alias("u"))
        steps = ahead.join(lists, "u").select("src", "bound", F.explode(F.transform("near", lambda y: F.struct((F.col("d0") + y["d"]).alias("d"), y["node"].alias("node")))).alias("y"))
        steps = steps.where("y.d <= bound").select("src", "y.node", "y.d", F.lit(None).cast("double").alias("was"))
        both = one.select("src", "x.node", "x.d", F.col("x.d").alias("was")).union(steps).repartition("src")
        least = both.groupBy("src", "node").agg(F.min("d").alias("d"), F.min("was").alias("was"))
        item = F.struct("d", "node", (F.col("was").isNull() | (F.col("d") < F.col("was"))).alias("new"))
        new = written(least.groupBy("src").agg(first(F.collect_list(item)).alias("best")), "path-nearest")
        discard(now)
        now = new
        if not now.where(F.exists("best", lambda x: x["new"])).take(1):
            return now.select("src", F.explode("best").alias("x")).select("src", F.col("x.node").alias("dst"), "x.d")


def graph_lisi(emb: DataFrame, labels: DataFrame, n_neighbors: int = 15, k0: int = 90, scale: bool = True, neighbors: DataFrame | None = None, **options) -> DataFrame:
    """(obs_id, lisi) for every row of emb; a node that reaches none has 1 before scaling."""
    near = graph_neighbors(emb, n_neighbors, k0, **options) if neighbors is None else neighbors
    v = emb.select("obs_id").join(inverse_simpson(near, labels), "obs_id", "left").select("obs_id", F.coalesce("lisi", F.lit(1.0)).alias("lisi"))
    return scale_lisi(v, labels) if scale else v


def f1_from_lisi(batch: DataFrame, label: DataFrame) -> DataFrame:
    """(obs_id, f1): the harmonic mean of scaled batch mixing and 1 - scaled label mixing; 0 where both vanish."""
    x = batch.select("obs_id", F.col("lisi").alias("i")).join(label.select("obs_id", (1 - F.col("lisi")).alias("c")), "obs_id")
    return x.select("obs_id", F.when(F.col("i") + F.col("c") > 0, 2 * F.col("i") * F.col("c") / (F.col("i") + F.col("c"))).otherwise(0.0).alias("f1"))


def f1_lisi(emb: DataFrame, batches: DataFrame, labels: DataFrame, n_neighbors: int = 15, k0: int = 90, **options) -> DataFrame:
    near = graph_neighbors(emb, n_neighbors, k0, **options)
    return f1_from_lisi(graph_lisi(emb, batches, neighbors=near), graph_lisi(emb, labels, neighbors=near))


def row_normalize(comp: DataFrame, eps: float = 1e-12) -> DataFrame:
    """Composition rows clipped at 0 and divided by (their sum + eps)."""
    v = F.greatest(F.col("value"), F.lit(0.0))
    return comp.withColumn("value", v / (F.sum(v).over(Window.partitionBy("obs_id")) + F.lit(eps)))


def paired(truth: DataFrame, pred: DataFrame) -> DataFrame:
    """(obs_id, cell_type, p, q) over all pairs of an observation that both have and a type that both have; absent is 0.
    Observations with a value that isn't finite are left out; repeated cells are added up."""
    value, none = F.col("value").cast("double"), F.lit(None).cast("double")
    bad = F.col("value").isNotNull() & finite(F.col("value")).isNull()
    sides = [d.select("obs_id", "cell_type", p.alias("p"), q.alias("q"), F.lit(a).alias("a"), F.lit(not a).alias("b"), bad.alias("bad")) for d, p, q, a in ((truth, value, none, True), (pred, none, value, False))]
    has = [F.bool_or(c).alias(c) for c in ("a", "b")]
    cells = sides[0].union(sides[1]).where("cell_type IS NOT NULL").groupBy("obs_id", "cell_type").agg(F.sum("p").alias("p"), F.sum("q").alias("q"), *has, F.bool_or("bad").alias("bad"))
    # types are few, and so are the cells of an observation
    every = cells.groupBy("cell_type").agg(*has).where("a AND b").agg(F.array_sort(F.collect_set("cell_type")).alias("t"))
    rows = cells.groupBy("obs_id").agg(*has, F.bool_or("bad").alias("bad"), F.map_from_entries(F.collect_list(F.struct("cell_type", F.struct("p", "q")))).alias("m")).where("a AND b AND NOT bad")
    grid = rows.crossJoin(F.broadcast(every)).select("obs_id", F.explode("t").alias("cell_type"), "m")
    return grid.select("obs_id", "cell_type", *(F.coalesce(F.col("m")[F.col("cell_type")][c], F.lit(0.0)).alias(c) for c in ("p", "q")))


def normalized_pair(pair: DataFrame, eps: float = 1e-12) -> DataFrame:
    w = Window.partitionBy("obs_id")
    p, q = (F.greatest(F.col(c), F.lit(0.0)) for c in ("p", "q"))
    return pair.withColumns({"p": p / (F.sum(p).over(w) + eps), "q": q / (F.sum(q).over(w) + eps)})


def jsd_per_spot(pair: DataFrame, eps: float = 1e-12) -> DataFrame:
    """(obs_id, jsd): Jensen-Shannon divergence, natural logarithm, of row-normalised compositions clipped to [eps, 1]."""
    n = normalized_pair(pair, eps)
    p, q = (F.least(F.greatest(F.col(c), F.lit(eps)), F.lit(1.0)) for c in ("p", "q"))
    m = (p + q) / 2
    return n.groupBy("obs_id").agg((F.sum(p * F.log(p / m)) / 2 + F.sum(q * F.log(q / m)) / 2).alias("jsd"))


def jsd_binary_per_type(pair: DataFrame, eps: float = 1e-12) -> DataFrame:
    """(cell_type, jsd): mean over observations of the divergence of (share, rest), shares clipped to [eps, 1 - eps]."""
    n = normalized_pair(pair, eps)

    p, q = (F.least(F.greatest(F.col(c), F.lit(eps)), F.lit(1 - eps)) for c in ("p", "q"))
    total = F.lit(0.0)
    for a, b in ((p, q), (1 - p, 1 - q)):
        m = (a + b) / 2
        total = total + (a * F.log(a / m) + b * F.log(b / m)) / 2
    return n.groupBy("cell_type").agg(F.avg(total).alias("jsd"))


def spearman(pair: DataFrame, by: str) -> DataFrame:
    """(by, rho): rank correlation of p and q within a type or an observation, average ranks for ties (values equal to 9
    digits, so that rounding breaks none); null where one side is constant."""

    def rank(c: str):
        return F.rank().over(Window.partitionBy(by).orderBy(c)) + (F.count("*").over(Window.partitionBy(by, c)) - 1) / F.lit(2.0)

    pair = pair.withColumns({c: F.round(c, 9) for c in ("p", "q")})
    r = pair.select(by, rank("p").alias("rp"), rank("q").alias("rq"))
    varied = (F.max("rp") > F.min("rp")) & (F.max("rq") > F.min("rq"))
    return r.groupBy(by).agg(F.when(varied, F.corr("rp", "rq")).alias("rho"))


def evaluate_composition(truth: DataFrame, pred: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(overall, per spot, per type). overall: rmse on raw values, then means and medians of the rest, which are on
    row-normalised values; undefined correlations are ignored."""
    pair = paired(truth, pred)
    n = normalized_pair(pair)
    e, d = (F.col("p") - F.col("q")) ** 2, F.sqrt(F.avg((F.col("p") - F.col("q")) ** 2))
    spot = n.groupBy("obs_id").agg(d.alias("rmse")).join(jsd_per_spot(pair), "obs_id").join(spearman(n, "obs_id"), "obs_id")
    kind = n.groupBy("cell_type").agg(d.alias("rmse")).join(jsd_binary_per_type(pair), "cell_type").join(spearman(n, "cell_type"), "cell_type")
    overall = pair.agg(F.sqrt(F.avg(e)).alias("rmse"))
    for name, t in (("spot", spot), ("type", kind)):
        stats = [f(c).alias(f"{name}_{c}_{s}") for c in ("rmse", "jsd", "rho") for s, f in (("mean", F.avg), ("median", lambda c: F.percentile(c, 0.5)))]
        overall = overall.crossJoin(F.broadcast(t.agg(*stats)))  # one row
    return overall, spot, kind


def type_means(per_type: DataFrame) -> DataFrame:
    """Unweighted means over types, one row."""
    return per_type.agg(*(F.avg(c).alias(c) for c in ("rmse", "jsd", "rho")))


def cosine_mse(truth: DataFrame, pred: DataFrame, by: str) -> DataFrame:
    """(by, cosine, mse) of two long matrices (obs_id, gene, value) by `gene` or `obs_id`; absent is 0 in a matrix, the
    mean is over the pairs that either has; cosine 0 where a side vanishes."""
    a = truth.select("obs_id", "gene", F.col("value").alias("p"))
    b = pred.select("obs_id", "gene", F.col("value").alias("q"))
    x = a.join(b, ["obs_id", "gene"], "full").fillna(0.0, ["p", "q"])
    size = F.sqrt(F.sum(F.col("p") ** 2)) * F.sqrt(F.sum(F.col("q") ** 2))
    return x.groupBy(by).agg(F.when(size > 0, F.sum(F.col("p") * F.col("q")) / size).otherwise(0.0).alias("cosine"), F.avg((F.col("p") - F.col("q")) ** 2).alias("mse"))


def imputation_metrics(truth: DataFrame, pred: DataFrame) -> DataFrame:
    """One row: medians of gene-wise and cell-wise cosine and mse."""
    g, c = (cosine_mse(truth, pred, by).agg(F.percentile("cosine", 0.5).alias(f"{n}_cosine"), F.percentile("mse", 0.5).alias(f"{n}_mse")) for n, by in (("gene", "gene"), ("cell", "obs_id")))
    return g.crossJoin(F.broadcast(c))


def cross_validation_summary(folds: DataFrame) -> DataFrame:
    """The folds' rows and a row fold = -1 with the means of all but n_genes, which is summed."""
    values = [c for c in folds.columns if c not in ("fold", "n_genes")]
    total = folds.agg(F.lit(-1).cast(folds.schema["fold"].dataType).alias("fold"), F.sum("n_genes").cast(folds.schema["n_genes"].dataType).alias("n_genes"), *(F.avg(c).alias(c) for c in values))
    return folds.select("fold", "n_genes", *values).unionByName(total)
