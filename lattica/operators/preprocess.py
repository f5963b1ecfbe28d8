"""Quality control, normalisation, feature selection, alignment of features over slices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattica.functions.columns import small
from lattica.operators.linalg import vectors

ROW = ("slice", "obs_id")
#: Values of dense rows made at once.
DENSE_VALUES = 1 << 20


def filter_cells(expr: DataFrame, min_counts: float = 1.0) -> DataFrame:
    """Rows of observations whose counts add up to min_counts at least."""
    keep = expr.groupBy(*ROW).agg(F.sum("value").alias("total")).where(F.col("total") >= min_counts)
    return expr.join(keep.select(*ROW), list(ROW), "left_semi")


def filter_genes(expr: DataFrame, min_cells: int = 3) -> DataFrame:
    """Rows of features that are positive in min_cells observations of their slice at least."""
    keep = expr.groupBy("slice", "gene").agg(F.count_if(F.col("value") > 0).alias("cells")).where(F.col("cells") >= min_cells)
    return expr.join(keep.select("slice", "gene"), ["slice", "gene"], "left_semi")


def quality_control(expr: DataFrame, min_counts: float = 1.0, min_cells: int = 3) -> DataFrame:
    return filter_genes(filter_cells(expr, min_counts), min_cells)


def normalize_total(expr: DataFrame, target: float = 1e4) -> DataFrame:
    """Counts scaled so that each observation adds up to target; an observation that adds up to 0 is left as it is."""
    total = F.sum("value").over(Window.partitionBy(*ROW))
    return expr.withColumn("value", F.when(total != 0, F.col("value") * target / total).otherwise(F.col("value")))


def log1p(expr: DataFrame) -> DataFrame:
    return expr.withColumn("value", F.log1p("value"))


def gene_moments(expr: DataFrame, obs: DataFrame) -> DataFrame:
    """(slice, gene, n, mean, variance) over all observations of a slice: absent cells are zeros."""
    n = small(obs.groupBy("slice").agg(F.count("*").cast("double").alias("n")))
    s = expr.groupBy("slice", "gene").agg(F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("q"))
    mean = F.col("s") / F.col("n")
    return s.join(n, "slice").select("slice", "gene", "n", mean.alias("mean"), ((F.col("q") - F.col("n") * mean * mean) / (F.col("n") - 1)).alias("variance"))


def loess(x: np.ndarray, y: np.ndarray, span: float = 0.3, anchors: int = 256) -> np.ndarray:
    """Local quadratic regression with tricube weights over the nearest span of points, evaluated at anchors spread
    over the points (at all of so many) and joined by straight lines. Points as far as the last of the span take part as well, so ties
    don't depend on the order of points."""
    xs = np.sort(x)
    n = len(xs)
    k = min(n, max(3, int(np.ceil(span * n))))
    at = np.unique(xs[np.unique(np.linspace(0, n - 1, min(n, anchors)).astype(int))])
    fit = np.empty(len(at))
    for i, c in enumerate(at):
        d = np.abs(x - c)
        h = max(np.partition(d, k - 1)[k - 1], 1e-12)
        near = d <= h
        w = np.sqrt((1 - (d[near] / h) ** 3) ** 3 + 1e-12)
        t = (x[near] - c) / h
        a = np.stack([np.ones(len(t)), t, t * t], 1) * w[:, None]
        fit[i] = np.linalg.lstsq(a, y[near] * w, rcond=None)[0][0]
    return np.interp(x, at, fit)


def clipped_variance(expr: DataFrame, fitted: DataFrame) -> DataFrame:
    """Variance of the standardised counts, clipped at mean + sqrt(n) sd. fitted: (slice, gene, n, mean, sd)."""
    bound = F.col("mean") + F.sqrt("n") * F.col("sd")
    c = F.least(F.col("value"), bound)
    s = expr.join(small(fitted), ["slice", "gene"]).groupBy("slice", "gene", "n", "mean", "sd").agg(F.sum(c).alias("s"), F.sum(c * c).alias("q"))
    up = F.col("n") * F.col("mean") ** 2 + F.col("q") - 2 * F.col("s") * F.col("mean")
    return s.select("slice", "gene", (up / ((F.col("n") - 1) * F.col("sd") ** 2)).alias("variance_norm"))


def hvg_counts(expr: DataFrame, obs: DataFrame, n_top: int, span: float = 0.3) -> DataFrame:
    """Feature selection on raw counts (flavour seurat_v3): per slice, a quadratic local regression of log10 variance
    on log10 mean gives each feature's expected spread; the clipped variance ranks. With several slices features are
    ordered by their median rank among the top ones, then by the number of slices that have them on top.
    Returns (gene, rank, n_slices, variance_norm, highly_variable). A slice's regression is a task over a row for each of its
    features; a feature of the greatest means or the least ones is fitted from one side."""
    m = gene_moments(expr, obs).where("variance > 0").select("slice", "gene", "n", "mean", "variance")

    def fit(t: pa.Table) -> pa.Table:
        mean, variance = (t.column(c).to_numpy() for c in ("mean", "variance"))
        sd = np.sqrt(10 ** loess(np.log10(mean), np.log10(variance), span)) if len(mean) > 3 else np.sqrt(variance)
        return t.drop_columns(["variance"]).append_column("sd", pa.array(sd))

    kind = {f.name: f.dataType.simpleString() for f in m.schema.fields}
    fitted = m.groupBy("slice").applyInArrow(fit, f"slice {kind['slice']}, gene {kind['gene']}, n double, mean double, sd double")
    return rank_genes(clipped_variance(expr, fitted), n_top)


def rank_genes(variance: DataFrame, n_top: int) -> DataFrame:
    """(slice, gene, variance_norm) -> (gene, rank, n_slices, variance_norm, highly_variable); ties by name."""
    r = F.row_number().over(Window.partitionBy("slice").orderBy(F.desc("variance_norm"), "gene")) - 1
    ranked = variance.withColumn("r", r)
    top = F.col("r") < n_top
    genes = ranked.groupBy("gene").agg(F.percentile(F.when(top, F.col("r")), 0.5).alias("rank"), F.count_if(top).alias("n_slices"), F.avg("variance_norm").alias("variance_norm"))
    order = Window.orderBy(F.col("rank").asc_nulls_last(), F.desc("n_slices"), F.desc("variance_norm"), "gene")
    return genes.withColumn("highly_variable", (F.row_number().over(order) <= n_top) & F.col("rank").isNotNull())


def hvg_dispersion(expr: DataFrame, obs: DataFrame, n_top: int, bins: int = 20) -> DataFrame:
    """Feature selection on log-normalised values (flavour seurat): the log of variance over mean of the values before
    the logarithm, standardised within equal-width bins of the log mean; a bin's only feature gets 1."""
    m = gene_moments(expr.withColumn("value", F.expm1("value")), obs)
    m = m.groupBy("gene").agg(F.avg("mean").alias("mean"), F.avg("variance").alias("variance"))
    m = m.select("gene", F.log1p("mean").alias("x"), F.when(F.col("variance") > 0, F.log(F.col("variance") / F.col("mean"))).alias("d"))
    edge = m.agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    m = m.crossJoin(F.broadcast(edge))  # one row
    b = F.greatest(F.lit(1), F.ceil((F.col("x") - F.col("lo")) / F.greatest(F.col("hi") - F.col("lo"), F.lit(1e-12)) * bins))
    m = m.withColumn("bin", b)
    w = Window.partitionBy("bin")
    mean, sd = F.avg("d").over(w), F.stddev_samp("d").over(w)
    m = m.withColumn("dispersion_norm", F.when(sd.isNull(), F.when(F.col("d").isNotNull(), 1.0)).when(sd == 0, 0.0).otherwise((F.col("d") - mean) / sd))
    order = Window.orderBy(F.col("dispersion_norm").desc_nulls_last(), "gene")
    return m.withColumn("highly_variable", (F.row_number().over(order) <= n_top) & F.col("dispersion_norm").isNotNull()).select("gene", "x", "d", "dispersion_norm", "highly_variable")


#: Edges of the bins of hvg_percentiles (fixed values), and the scale of a median absolute deviation.
MEAN_PERCENTILES, MAD_SCALE = tuple(x / 100 for x in range(10, 105, 5)), 0.6744897501960817


def hvg_percentiles(expr: DataFrame, obs: DataFrame, n_top: int) -> DataFrame:
    """Feature selection on log-normalised values (flavour cell_ranger): variance over mean, less its median within bins
    between percentiles of the means, over its median absolute deviation there. A bin without spread gives an infinite
    value to what lies off its median and none to the rest."""
    m = gene_moments(expr, obs).groupBy("gene").agg(F.avg("mean").alias("mean"), F.avg("variance").alias("variance"))
    m = m.select("gene", F.col("mean").alias("x"), (F.col("variance") / F.greatest("mean", F.lit(1e-12))).alias("d"))
    edges = m.agg(F.percentile("x", F.array(*(F.lit(p) for p in MEAN_PERCENTILES))).alias("edges"))
    m = m.crossJoin(F.broadcast(edges)).withColumn("bin", F.size(F.filter("edges", lambda e: e < F.col("x")))).drop("edges")  # one row
    m = m.join(F.broadcast(m.groupBy("bin").agg(F.percentile("d", 0.5).alias("median"))), "bin").withColumn("off", F.col("d") - F.col("median"))  # 20 bins
    m = m.join(F.broadcast(m.groupBy("bin").agg((F.percentile(F.abs("off"), 0.5) / MAD_SCALE).alias("mad"))), "bin")
    flat = F.when(F.col("off") != 0, F.sign("off") * F.lit(float("inf")))
    m = m.withColumn("dispersion_norm", F.when(F.col("mad") == 0, flat).otherwise(F.col("off") / F.col("mad")))
    order = Window.orderBy(F.col("dispersion_norm").desc_nulls_last(), "gene")
    return m.withColumn("highly_variable", (F.row_number().over(order) <= n_top) & F.col("dispersion_norm").isNotNull()).select("gene", "x", "d", "dispersion_norm", "highly_variable")


def concat_observations(parts: dict[str, DataFrame], label: str = "batch", suffix: bool = True) -> DataFrame:
    """Rows of several observation tables under a `label` column; suffix: obs_name gets -<key>, so names stay unique.
    Columns that only some tables have are null elsewhere."""
    out = None
    for name, o in parts.items():
        o = o.withColumn(label, F.lit(name))
        o = o.withColumn("obs_name", F.concat_ws("-", F.col("obs_name").cast("string"), F.lit(name))) if suffix else o
        out = o if out is None else out.unionByName(o, allowMissingColumns=True)
    return out


def merge_same(parts: list[DataFrame], key: str = "gene") -> DataFrame:
    """Feature tables joined on the features that all have, with those columns that all tables have and in which they agree
    for every such feature."""
    columns = [c for c in parts[0].columns if c != key and all(c in p.columns for p in parts)]
    every = parts[0].select(key, *columns)
    for p in parts[1:]:
        every = every.unionByName(p.select(key, *columns))
    joined = every.groupBy(key).agg(F.count("*").alias("_n"), *(F.min(F.struct(F.col(c).isNull(), F.col(c))).alias(c) for c in columns), *((F.count_distinct(c) + F.max(F.col(c).isNull().cast("int")) <= 1).alias(f"_{c}") for c in columns))
    joined = joined.where(F.col("_n") == len(parts))
    agree = joined.agg(F.lit(True).alias("_"), *(F.bool_and(f"_{c}").alias(c) for c in columns)).first()
    return joined.select(key, *(F.col(c)[c].alias(c) for c in columns if agree[c] is not False))


def align_genes(var: DataFrame, use_hvg: bool = True, reference: str | None = None) -> DataFrame:
    """(gene_id, gene): features that every slice has (with use_hvg: has as highly variable), in the order of the
    reference slice (the first in natural order if none is named). var: slice, gene, position, highly_variable. An
    empty intersection is an error."""
    own = var.where("highly_variable") if use_hvg else var
    n = var.select("slice").distinct().count()
    common = own.groupBy("gene").agg(F.count_distinct("slice").alias("k")).where(F.col("k") == n)
    first = reference if reference is not None else var.agg(F.min("slice")).first()[0]
    placed = var.where(F.col("slice") == first).select("gene", "position").join(common, "gene", "left_semi")
    out = placed.select((F.row_number().over(Window.orderBy("position", "gene")) - 1).cast("int").alias("gene_id"), "gene")
    if not out.take(1):
        raise ValueError("the slices have no feature in common")
    return out


def common_genes(a: DataFrame, b: DataFrame) -> DataFrame:
    """Features of both expression tables."""
    return a.select("gene").intersect(b.select("gene"))


def concat_domains(parts: dict[str, DataFrame], inner: bool = True) -> DataFrame:
    """Rows of several expression tables under a `domain` column; inner: only features that all have."""
    out = None
    for name, e in parts.items():
        e = e.withColumn("domain", F.lit(name))
        out = e if out is None else out.unionByName(e, allowMissingColumns=True)
    if inner:
        keep = out.groupBy("gene").agg(F.count_distinct("domain").alias("k")).where(F.col("k") == len(parts))
        out = out.join(keep, "gene", "left_semi")
    return out


def dense_rows(expr: DataFrame, genes: DataFrame) -> DataFrame:
    """(slice, obs_id, x array<double>): one dense row for each observation over the features of genes (gene_id, gene);
    repeated cells are added up."""
    g = genes.count()
    cells = expr.join(small(genes), "gene").groupBy(*ROW, "gene_id").agg(F.sum("value").cast("double").alias("value"))
    own = cells.groupBy(*ROW).agg(F.collect_list(F.struct(F.col("gene_id").cast("int").alias("gene_id"), F.coalesce("value", F.lit(0.0)).alias("value"))).alias("c")).select(*ROW, "c.gene_id", "c.value")

    def run(batches):
        step = max(1, DENSE_VALUES // max(1, g))
        for batch in batches:
            for a in range(0, batch.num_rows, step):
                part = batch.slice(a, step)
                ids, values = part.column("gene_id"), part.column("value")
                x = np.zeros((part.num_rows, g))
                at = ids.flatten().to_numpy()
                on = (at >= 0) & (at < g)
                x[np.repeat(np.arange(part.num_rows), ids.value_lengths().to_numpy())[on], at[on]] = values.flatten().to_numpy()[on]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ROW), vectors(x)], names=[*ROW, "x"])

    kinds = ", ".join(f"{c} {expr.schema[c].dataType.simpleString()}" for c in ROW)
    return own.mapInArrow(run, f"{kinds}, x array<double>")


def row_offsets(rows: DataFrame) -> DataFrame:
    """(slice, n, offset): slices in natural order, each with the number of rows before it."""
    n = rows.groupBy("slice").agg(F.count("*").alias("n"))
    return n.withColumn("offset", F.coalesce(F.sum("n").over(Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))


def rare_labels(obs: DataFrame, label: str = "label", min_frac: float = 0.03) -> tuple[DataFrame, DataFrame]:
    """(observations whose label holds min_frac of all at least, the kept labels with their shares)."""
    counts = obs.groupBy(label).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    share = counts.crossJoin(F.broadcast(total)).select(label, (F.col("n") / F.col("total")).alias("share"))
    kept = share.where((F.col("share") >= min_frac) & F.col(label).isNotNull())
    return obs.join(small(kept.select(label)), label, "left_semi"), kept


def remap_labels(obs: DataFrame, mapping: dict[str, str], label: str = "label") -> DataFrame:
    """Labels replaced by the mapping; others stay."""
    if not mapping:
        return obs
    pairs = [F.lit(x) for kv in mapping.items() for x in kv]
    return obs.withColumn(label, F.coalesce(F.create_map(*pairs)[F.col(label)], F.col(label)))


def hold_out(expr: DataFrame, genes: DataFrame) -> DataFrame:
    """Rows of the features that are not in genes (gene)."""
    return expr.join(small(genes.select("gene").distinct()), "gene", "left_anti")


def clean_names(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.trim(F.col(n).cast("string")) for n in names})


def median_library_size(expr: DataFrame, fallback: float = 1e4) -> DataFrame:
    """One row: the median of the observations' positive totals, or the fallback."""
    totals = expr.groupBy(*ROW).agg(F.sum("value").alias("s")).where("s > 0")
    return totals.agg(F.coalesce(F.percentile("s", 0.5), F.lit(fallback)).alias("target"))


def normalize_by_observed(observed: DataFrame, held: DataFrame, target: float) -> DataFrame:
    """Held-out counts scaled by the observations' totals over the observed features, then log1p."""
    s = observed.groupBy(*ROW).agg(F.sum("value").alias("s"))
    size = F.greatest(F.coalesce(F.col("s"), F.lit(0.0)), F.lit(1e-8))
    return held.join(s, list(ROW), "left").select(*ROW, "gene", F.log1p(F.col("value") * F.lit(float(target)) / size).alias("value"))


def gene_folds(genes: DataFrame, folds: int = 5, seed: int = 0) -> DataFrame:
    """(gene, fold): features dealt into folds of equal size in the order of a seeded hash."""
    order = Window.orderBy(F.xxhash64("gene", F.lit(seed)), "gene")
    return genes.select("gene", (F.ntile(folds).over(order) - 1).alias("fold"))
