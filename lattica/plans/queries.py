"""One query for each operator over derived tables, and the same in SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lattica.operators import cluster, communities, deconvolve, factorize, graphs, impute, linalg, metrics, mixture, preprocess, register
from lattica.plans import fixtures as fx
from lattica.plans import tables
from lattica.sources import readers

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def r(c: str | Column, digits: int = 6) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, digits)


def genes_of(expr: DataFrame) -> DataFrame:
    """(gene_id, gene) in natural order: some hundred names."""
    return expr.select("gene").distinct().select((F.row_number().over(Window.orderBy("gene")) - 1).cast("int").alias("gene_id"), "gene")


# --- sources, quality control, normalisation


@query(f"""WITH {fx.CELLS} SELECT CAST(dense_rank() OVER (ORDER BY word) - 1 AS INTEGER) AS code, word FROM (SELECT DISTINCT label AS word FROM cells)""")
def label_codes(s, d):
    return readers.label_dictionary(fx.cells(s, d))


@query("""WITH n AS (SELECT p_partkey, p_brand, row_number() OVER (PARTITION BY p_type, p_brand ORDER BY p_partkey) - 1 AS n, p_type FROM part)
SELECT p_partkey, p_type AS slice, CASE WHEN n = 0 THEN p_brand ELSE p_brand || '-' || n END AS name FROM n""")
def unique_names(s, d):
    p = fx.table(s, d, "part").select("p_partkey", F.col("p_type").alias("slice"), F.col("p_brand").alias("name"))
    return readers.unique_names(p, "name", "p_partkey")


def _bundle(s, d, where: str = "true") -> str:
    """A bundle's files, in the shared folder."""
    path = tables.new_path(s, "bundle")
    readers.write_table(fx.expr(s, d).where(where), f"{path}/expr", by="slice")
    readers.write_table(fx.cells(s, d).where(where), f"{path}/obs", by="slice")
    return path


@query(f"WITH {fx.EXPR} SELECT slice, obs_id, gene, value FROM expr WHERE slice IN ('s1', 's3')")
def bundle_slices(s, d):
    """A written bundle, of which two slices are read; the others are pruned."""
    return readers.read_bundle(s, _bundle(s, d), ["s1", "s3"]).expr.select("slice", "obs_id", "gene", "value")


@query(f"WITH {fx.EXPR}, e AS (SELECT obs_id, count(*) AS n_genes, sum(value) AS total FROM expr GROUP BY 1) SELECT CASE slice WHEN 's0' THEN 'left' ELSE 'right' END AS slice, obs_id, label, x, y, coalesce(n_genes, 0) AS n_genes, coalesce(total, 0) AS total FROM cells LEFT JOIN e USING (obs_id) WHERE slice IN ('s0', 's2')")
def load_slices(s, d):
    """Two bundles under slice names of their own, also observations without counts."""
    b = readers.load_slices(s, {"left": _bundle(s, d, "slice = 's0'"), "right": _bundle(s, d, "slice = 's2'")})
    n = b.expr.groupBy("slice", "obs_id").agg(F.count("*").alias("n_genes"), F.sum("value").alias("total"))
    return b.obs.join(n, ["slice", "obs_id"], "left").select("slice", "obs_id", "label", "x", "y", F.coalesce("n_genes", F.lit(0)).alias("n_genes"), F.coalesce("total", F.lit(0.0)).alias("total"))


@query(f"WITH {fx.PPI} SELECT gene1, gene2, CAST(combined_score AS INTEGER) AS combined_score FROM ppi")
def interactions_csv(s, d):
    """The interaction table from CSV files with a header."""
    path = tables.new_path(s, "interactions")
    fx.interactions(s, d).write.csv(path, header=True)
    return readers.read_interactions(s, path)


QC = """t AS (SELECT slice, obs_id FROM expr GROUP BY 1, 2 HAVING sum(value) >= 200),
c AS (SELECT expr.* FROM expr JOIN t USING (slice, obs_id)),
k AS (SELECT slice, gene FROM c WHERE value > 0 GROUP BY 1, 2 HAVING count(*) >= 3),
qc AS (SELECT c.* FROM c JOIN k USING (slice, gene))"""


@query(f"WITH {fx.EXPR}, {QC} SELECT slice, obs_id, gene, value FROM qc")
def qc_filter_genes(s, d):
    return preprocess.quality_control(fx.expr(s, d), 200, 3)


@query(f"WITH {fx.EXPR} SELECT slice, obs_id, gene, round(ln(1 + value * 1e4 / sum(value) OVER (PARTITION BY slice, obs_id)), 6) AS value FROM expr")
def norm_log1p(s, d):
    return preprocess.log1p(preprocess.normalize_total(fx.expr(s, d))).withColumn("value", r("value"))


@query(f"""WITH {fx.EXPR}, {QC} SELECT slice, obs_id, gene, round(ln(1 + value * 1e4 / sum(value) OVER (PARTITION BY slice, obs_id)), 6) AS value FROM qc""")
def qc_norm_log1p(s, d):
    return preprocess.log1p(preprocess.normalize_total(preprocess.quality_control(fx.expr(s, d), 200, 3))).withColumn("value", r("value"))


MOMENTS = """n AS (SELECT slice, CAST(count(*) AS DOUBLE) AS n FROM cells GROUP BY 1),
m AS (SELECT slice, gene, n, sum(value) / n AS mean, (sum(value * value) - n * (sum(value) / n) ** 2) / (n - 1) AS variance FROM expr JOIN n USING (slice) GROUP BY slice, gene, n)"""


@query(f"WITH {fx.EXPR}, {MOMENTS} SELECT slice, gene, n, round(mean, 6) AS mean, round(variance, 5) AS variance FROM m")
def gene_moments_with_zeros(s, d):
    return preprocess.gene_moments(fx.expr(s, d), fx.cells(s, d)).withColumns({"mean": r("mean"), "variance": r("variance", 5)})


CLIPPED = """f AS (SELECT slice, gene, n, mean, sqrt(variance) AS sd FROM m WHERE variance > 0),
s AS (SELECT slice, gene, n, mean, sd, sum(least(value, mean + sqrt(n) * sd)) AS s, sum(least(value, mean + sqrt(n) * sd) ** 2) AS q FROM expr JOIN f USING (slice, gene) GROUP BY ALL),
v AS (SELECT slice, gene, (n * mean ** 2 + q - 2 * s * mean) / ((n - 1) * sd ** 2) AS variance_norm FROM s)"""


def _clipped(s, d):
    e = fx.expr(s, d)
    m = preprocess.gene_moments(e, fx.cells(s, d)).where("variance > 0")
    return preprocess.clipped_variance(e, m.select("slice", "gene", "n", "mean", F.sqrt("variance").alias("sd")))


@query(f"WITH {fx.EXPR}, {MOMENTS}, {CLIPPED} SELECT slice, gene, round(variance_norm, 6) AS variance_norm FROM v")
def gene_clipped_variance(s, d):
    """With the regression replaced by the observed spread."""
    return _clipped(s, d).withColumn("variance_norm", r("variance_norm"))


@query(f"""WITH {fx.EXPR}, {MOMENTS}, {CLIPPED}, rv AS (SELECT slice, gene, round(variance_norm, 6) AS variance_norm FROM v),
k AS (SELECT *, row_number() OVER (PARTITION BY slice ORDER BY variance_norm DESC, gene) - 1 AS r FROM rv),
g AS (SELECT gene, quantile_cont(CASE WHEN r < 40 THEN r END, 0.5) AS rank, count(*) FILTER (WHERE r < 40) AS n_slices, avg(variance_norm) AS variance_norm FROM k GROUP BY 1),
o AS (SELECT *, row_number() OVER (ORDER BY rank NULLS LAST, n_slices DESC, round(variance_norm, 5) DESC, gene) AS place FROM g)
SELECT gene, CAST(rank AS DOUBLE) AS rank, n_slices, place <= 40 AND rank IS NOT NULL AS highly_variable FROM o""")
def gene_rank_topn_by_batch(s, d):
    return preprocess.rank_genes(_clipped(s, d).withColumn("variance_norm", r("variance_norm")), 40).drop("variance_norm")


LOESS = """f0 AS (SELECT slice, gene, n, mean, log10(mean) AS x, log10(variance) AS y FROM m WHERE variance > 0),
kk AS (SELECT slice, greatest(3, ceil(0.3 * count(*))) AS k FROM f0 GROUP BY 1),
p AS MATERIALIZED (SELECT a.slice, a.gene, a.n, a.mean, b.x - a.x AS t, b.y, abs(b.x - a.x) AS d, row_number() OVER (PARTITION BY a.slice, a.gene ORDER BY abs(b.x - a.x)) AS rn FROM f0 a JOIN f0 b USING (slice)),
h AS (SELECT slice, gene, greatest(max(d), 1e-12) AS h FROM p JOIN kk USING (slice) WHERE rn <= k GROUP BY 1, 2),
w AS (SELECT slice, gene, n, mean, t / h AS t, y, (1 - (d / h) ** 3) ** 3 + 1e-12 AS w FROM p JOIN h USING (slice, gene) WHERE d <= h),
q AS (SELECT slice, gene, any_value(n) AS n, any_value(mean) AS mean, sum(w) AS s0, sum(w * t) AS s1, sum(w * t ** 2) AS s2, sum(w * t ** 3) AS s3, sum(w * t ** 4) AS s4, sum(w * y) AS b0, sum(w * t * y) AS b1, sum(w * t * t * y) AS b2 FROM w GROUP BY 1, 2),
f AS (SELECT slice, gene, n, mean, sqrt(10 ** ((b0 * (s2 * s4 - s3 * s3) - s1 * (b1 * s4 - b2 * s3) + s2 * (b1 * s3 - b2 * s2)) / (s0 * (s2 * s4 - s3 * s3) - s1 * (s1 * s4 - s2 * s3) + s2 * (s1 * s3 - s2 * s2)))) AS sd FROM q)"""


@query(f"""WITH {fx.EXPR}, {MOMENTS}, {LOESS}, {CLIPPED[CLIPPED.index("s AS (") :]},
k AS (SELECT *, row_number() OVER (PARTITION BY slice ORDER BY variance_norm DESC, gene) - 1 AS r FROM v),
g AS (SELECT gene, quantile_cont(CASE WHEN r < 60 THEN r END, 0.5) AS rank, count(*) FILTER (WHERE r < 60) AS n_slices, avg(variance_norm) AS variance_norm FROM k GROUP BY 1),
o AS (SELECT *, row_number() OVER (ORDER BY rank NULLS LAST, n_slices DESC, variance_norm DESC, gene) AS place FROM g)
SELECT gene, CAST(rank AS DOUBLE) AS rank, n_slices, round(variance_norm, 5) AS variance_norm, place <= 60 AND rank IS NOT NULL AS highly_variable FROM o""")
def hvg_seurat_v3(s, d):
    """A slice here has fewer features than the regression has anchors, so SQL can say it."""
    return preprocess.hvg_counts(fx.expr(s, d), fx.cells(s, d), 60).withColumn("variance_norm", r("variance_norm", 5))


@query(f"""WITH {fx.EXPR}, t AS (SELECT slice, obs_id, gene, value * 1e4 / sum(value) OVER (PARTITION BY slice, obs_id) AS value FROM expr), n AS (SELECT slice, CAST(count(*) AS DOUBLE) AS n FROM cells GROUP BY 1),
m AS (SELECT slice, gene, sum(value) / n AS mean, (sum(value * value) - n * (sum(value) / n) ** 2) / (n - 1) AS variance FROM t JOIN n USING (slice) GROUP BY slice, gene, n),
g AS (SELECT gene, ln(1 + avg(mean)) AS x, CASE WHEN avg(variance) > 0 THEN ln(avg(variance) / avg(mean)) END AS d FROM m GROUP BY 1),
b AS (SELECT *, greatest(1, ceil((x - min(x) OVER ()) / greatest(max(x) OVER () - min(x) OVER (), 1e-12) * 20)) AS bin FROM g)
SELECT gene, round(CASE WHEN stddev_samp(d) OVER w IS NULL THEN CASE WHEN d IS NOT NULL THEN 1.0 END WHEN stddev_samp(d) OVER w = 0 THEN 0 ELSE (d - avg(d) OVER w) / stddev_samp(d) OVER w END, 4) AS dispersion_norm
FROM b WINDOW w AS (PARTITION BY bin)""")
def hvg_seurat(s, d):
    e = preprocess.log1p(preprocess.normalize_total(fx.expr(s, d)))
    return preprocess.hvg_dispersion(e, fx.cells(s, d), 60).select("gene", r("dispersion_norm", 4).alias("dispersion_norm"))


@query(f"""WITH {fx.EXPR}, t AS (SELECT slice, obs_id, gene, ln(1 + value * 1e4 / sum(value) OVER (PARTITION BY slice, obs_id)) AS value FROM expr), n AS (SELECT slice, CAST(count(*) AS DOUBLE) AS n FROM cells GROUP BY 1),
m AS (SELECT slice, gene, sum(value) / n AS mean, (sum(value * value) - n * (sum(value) / n) ** 2) / (n - 1) AS variance FROM t JOIN n USING (slice) GROUP BY slice, gene, n),
g AS (SELECT gene, avg(mean) AS x, avg(variance) / greatest(avg(mean), 1e-12) AS d FROM m GROUP BY 1),
e AS (SELECT quantile_cont(x, [{", ".join(str(p) for p in preprocess.MEAN_PERCENTILES)}]) AS edges FROM g),
b AS (SELECT gene, d, len(list_filter(edges, lambda v: v < x)) AS bin FROM g, e), o AS (SELECT gene, bin, d - median(d) OVER (PARTITION BY bin) AS off FROM b),
s AS (SELECT gene, off, median(abs(off)) OVER (PARTITION BY bin) / {preprocess.MAD_SCALE} AS mad FROM o)
SELECT gene, round(off / mad, 4) AS dispersion_norm FROM s""")
def hvg_cell_ranger(s, d):
    e = preprocess.log1p(preprocess.normalize_total(fx.expr(s, d)))
    return preprocess.hvg_percentiles(e, fx.cells(s, d), 60).select("gene", r("dispersion_norm", 4).alias("dispersion_norm"))


@query(f"""WITH {fx.CELLS} SELECT obs_id, 'c' || (obs_id % 10) || '-' || slice AS obs_name, slice AS batch, CASE WHEN slice = 's0' THEN label END AS label, CASE WHEN slice = 's1' THEN x END AS x FROM cells WHERE slice IN ('s0', 's1')""")
def concat_with_suffix(s, d):
    """Two observation tables with different columns; names get the batch as a suffix."""
    c = fx.cells(s, d).withColumn("obs_name", F.concat(F.lit("c"), (F.col("obs_id") % 10).cast("string")))
    parts = {"s0": c.where("slice = 's0'").select("obs_id", "obs_name", "label"), "s1": c.where("slice = 's1'").select("obs_id", "obs_name", "x")}
    return preprocess.concat_observations(parts)


@query("SELECT p_partkey AS gene, p_brand AS brand FROM part WHERE p_partkey % 3 = 0")
def merge_same_columns(s, d):
    """Feature tables that agree in one column and differ in another."""
    p = fx.table(s, d, "part").select(F.col("p_partkey").alias("gene"), F.col("p_brand").alias("brand"), F.col("p_size").alias("size"))
    return preprocess.merge_same([p, p.where("gene % 3 = 0").withColumn("size", F.col("size") + F.col("gene") % 2).withColumn("own", F.lit(1))])


VAR = """var AS (SELECT slice, gene, row_number() OVER (PARTITION BY slice ORDER BY gene) AS position, count(*) >= 60 AS highly_variable FROM expr GROUP BY slice, gene)"""


@query(f"""WITH {fx.EXPR}, {VAR}, c AS (SELECT gene FROM var WHERE highly_variable GROUP BY 1 HAVING count(DISTINCT slice) = (SELECT count(DISTINCT slice) FROM var))
SELECT CAST(row_number() OVER (ORDER BY position, gene) - 1 AS INTEGER) AS gene_id, gene FROM var WHERE slice = (SELECT min(slice) FROM var) AND gene IN (SELECT gene FROM c)""")
def align_genes(s, d):
    n = fx.expr(s, d).groupBy("slice", "gene").agg((F.count("*") >= 60).alias("highly_variable"))
    return preprocess.align_genes(n.withColumn("position", F.row_number().over(Window.partitionBy("slice").orderBy("gene"))))


@query(f"""WITH {fx.EXPR}, a AS (SELECT * FROM expr WHERE slice = 's0' AND gene < 'Brand#4'), b AS (SELECT * FROM expr WHERE slice = 's1' AND gene > 'Brand#2'),
c AS (SELECT gene FROM a INTERSECT SELECT gene FROM b)
SELECT slice, obs_id, gene, value, 'st' AS domain FROM a WHERE gene IN (SELECT gene FROM c) UNION ALL SELECT slice, obs_id, gene, value, 'pseudo' FROM b WHERE gene IN (SELECT gene FROM c)""")
def concat_domains(s, d):
    e = fx.expr(s, d)
    return preprocess.concat_domains({"st": e.where("slice = 's0' AND gene < 'Brand#4'"), "pseudo": e.where("slice = 's1' AND gene > 'Brand#2'")})


@query(f"""WITH {fx.EXPR} SELECT gene FROM expr WHERE slice = 's0' INTERSECT SELECT gene FROM expr WHERE slice = 's1' AND value > 60""")
def common_genes(s, d):
    e = fx.expr(s, d)
    return preprocess.common_genes(e.where("slice = 's0'"), e.where("slice = 's1' AND value > 60"))


@query(f"""WITH {fx.EXPR}, g AS (SELECT gene, CAST(row_number() OVER (ORDER BY gene) - 1 AS INTEGER) AS gene_id FROM (SELECT DISTINCT gene FROM expr)), o AS (SELECT DISTINCT slice, obs_id FROM expr)
SELECT o.slice, o.obs_id, g.gene_id, coalesce(value, 0) AS value FROM o CROSS JOIN g LEFT JOIN expr ON expr.obs_id = o.obs_id AND expr.slice = o.slice AND expr.gene = g.gene""")
def densify_slices(s, d):
    e = tables.written(fx.expr(s, d), "dense-counts")
    return preprocess.dense_rows(e, genes_of(e)).select("slice", "obs_id", F.posexplode("x").alias("gene_id", "value"))


@query(f"""WITH {fx.CELLS}, n AS (SELECT slice, count(*) AS n FROM cells GROUP BY 1)
SELECT slice, n, CAST(coalesce(sum(n) OVER (ORDER BY slice ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset" FROM n""")
def slice_offsets(s, d):
    return preprocess.row_offsets(fx.cells(s, d))


FOLD = "(SELECT gene FROM (SELECT gene, row_number() OVER (ORDER BY gene) % 5 AS fold FROM (SELECT DISTINCT gene FROM expr)) WHERE fold = 2)"


def _held(e: DataFrame) -> DataFrame:
    return genes_of(e).where((F.col("gene_id") + 1) % 5 == 2)


@query(f"WITH {fx.EXPR} SELECT slice, obs_id, gene, value FROM expr WHERE gene NOT IN {FOLD}")
def holdout_genes(s, d):
    e = fx.expr(s, d)
    return preprocess.hold_out(e, _held(e))


@query(f"""WITH {fx.EXPR} SELECT fold, count(*) AS n FROM (SELECT ntile(5) OVER (ORDER BY gene) - 1 AS fold FROM (SELECT DISTINCT gene FROM expr)) GROUP BY 1""")
def gene_folds(s, d):
    """Sizes of the folds; which feature falls where depends on a hash."""
    return preprocess.gene_folds(genes_of(fx.expr(s, d))).groupBy(F.col("fold").cast("long").alias("fold")).agg(F.count("*").alias("n"))


@query(f"WITH {fx.EXPR} SELECT coalesce(quantile_cont(t, 0.5), 1e4) AS target FROM (SELECT sum(value) AS t FROM expr GROUP BY slice, obs_id) WHERE t > 0")
def median_library_size(s, d):
    return preprocess.median_library_size(fx.expr(s, d))


@query(f"""WITH {fx.EXPR}, s AS (SELECT slice, obs_id, sum(value) AS s FROM expr WHERE gene NOT IN {FOLD} GROUP BY 1, 2)
SELECT slice, obs_id, gene, round(ln(1 + value * 1000 / greatest(coalesce(s, 0), 1e-8)), 6) AS value FROM expr LEFT JOIN s USING (slice, obs_id) WHERE gene IN {FOLD}""")
def obs_size_factor_norm(s, d):
    e = fx.expr(s, d)
    held = _held(e)
    return preprocess.normalize_by_observed(preprocess.hold_out(e, held), e.join(held, "gene", "left_semi"), 1000.0).withColumn("value", r("value"))


@query(f"""WITH {fx.CELLS} SELECT label, round(n / t, 6) AS share FROM (SELECT label, CAST(count(*) AS DOUBLE) AS n, sum(count(*)) OVER () AS t FROM (SELECT CASE WHEN label = 'BUILDING' AND obs_id % 9 > 0 THEN 'MACHINERY' ELSE label END AS label FROM cells) GROUP BY 1) WHERE n / t >= 0.03""")
def rare_labels(s, d):
    """One label is made rare: most of its cells get another one."""
    c = fx.cells(s, d).withColumn("label", F.expr("CASE WHEN label = 'BUILDING' AND obs_id % 9 > 0 THEN 'MACHINERY' ELSE label END"))
    return preprocess.rare_labels(c)[1].withColumn("share", r("share"))


@query(f"""WITH {fx.CELLS} SELECT slice, obs_id, CASE label WHEN 'BUILDING' THEN 'B' WHEN 'MACHINERY' THEN 'M' ELSE label END AS label FROM cells WHERE slice IN ('s1', 's3') AND x >= 500""")
def remap_and_select(s, d):
    c = fx.cells(s, d).where(F.col("slice").isin("s1", "s3") & (F.col("x") >= 500)).select("slice", "obs_id", "label")
    return preprocess.remap_labels(c, {"BUILDING": "B", "MACHINERY": "M"}).select("slice", "obs_id", "label")


@query("SELECT CAST(s_suppkey AS VARCHAR) AS s_suppkey, trim(s_name) AS s_name FROM supplier")
def clean_names(s, d):
    return preprocess.clean_names(fx.table(s, d, "supplier").select("s_suppkey", "s_name"), "s_suppkey", "s_name")


# --- mixtures


@query(f"WITH {fx.CELLS}, {fx.BINS}, {fx.TRUTH} SELECT obs_id AS spot, cell_type, round(value, 6) AS value FROM truth")
def grid_bin_composition(s, d):
    return mixture.bin_composition(fx.binned(s, d)).withColumn("value", r("value"))


@query(f"""WITH {fx.EXPR}, {fx.BINS} SELECT spot, gene, sum(value) AS value FROM bins JOIN expr USING (slice, obs_id) GROUP BY 1, 2""")
def grid_bin_expression(s, d):
    return mixture.bin_expression(fx.binned(s, d), fx.expr(s, d))


@query(f"""WITH {fx.CELLS}, {fx.BINS} SELECT spot, round(avg(x), 6) AS x, round(avg(y), 6) AS y, count(*) AS n_cells FROM bins GROUP BY 1""")
def grid_bin_spots(s, d):
    return mixture.bin_spots(fx.binned(s, d)).withColumns({"x": r("x"), "y": r("y")})


DRAWN = """sizes AS (SELECT label, count(*) AS size, row_number() OVER (ORDER BY label) - 1 AS k FROM cells GROUP BY 1),
spots AS (SELECT range AS spot, 2 + (7919 * range) % 14 AS n FROM range(500)),
draws AS (SELECT spot, unnest(range(1, n + 1)) AS draw FROM spots),
t AS (SELECT spot, least((SELECT count(*) FROM sizes), 1 + (7919 * spot + 104729 * 2) % 3) AS t FROM spots),
chosen AS (SELECT spot, label, size, row_number() OVER (PARTITION BY spot ORDER BY 7919 * spot + 104729 * k + 1299709 * 3, k) - 1 AS j FROM spots, sizes),
drawn AS (SELECT d.spot, d.draw, c.label, (7919 * d.spot + 104729 * d.draw + 1299709 * 5) % c.size AS pick, c.size FROM draws d JOIN t ON t.spot = d.spot
  JOIN chosen c ON c.spot = d.spot AND c.j = (7919 * d.spot + 104729 * d.draw + 1299709 * 4) % t.t)"""


def _draws(s, d):
    return mixture.draw_cells(fx.cells(s, d), 500, mix=mixture.arithmetic)


@query(f"""WITH {fx.CELLS}, {DRAWN} SELECT spot, label AS cell_type, round(CAST(count(*) AS DOUBLE) / sum(count(*)) OVER (PARTITION BY spot), 6) AS value, CAST(sum(count(*)) OVER (PARTITION BY spot) AS BIGINT) AS cell_num FROM drawn GROUP BY spot, label""")
def pseudo_spot_fractions(s, d):
    """Draws by shared integer arithmetic, so that labels and numbers of cells can be compared."""
    return mixture.pseudo_fractions(_draws(s, d)).withColumn("value", r("value"))


PICKED = """numbered AS (SELECT obs_id, label, row_number() OVER (PARTITION BY label ORDER BY (7919 * obs_id) % 64, obs_id) - 1 AS place FROM cells)"""


@query(f"""WITH {fx.EXPR}, {DRAWN}, {PICKED}, picked AS (SELECT spot, obs_id FROM drawn JOIN numbered ON numbered.label = drawn.label AND place = pick)
SELECT spot, gene, sum(value) AS value FROM picked JOIN expr USING (obs_id) GROUP BY 1, 2""")
def pseudo_spot_counts(s, d):
    return mixture.pseudo_counts(_draws(s, d), fx.expr(s, d))


@query(f"""WITH {fx.CELLS}, {DRAWN}, {PICKED}, placed AS (SELECT obs_id, numbered.label, place + before AS place FROM numbered JOIN
  (SELECT label, coalesce(sum(size) OVER (ORDER BY label ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM sizes) b ON b.label = numbered.label)
SELECT spot, draw, obs_id, label FROM draws JOIN placed ON place = (7919 * spot + 104729 * draw + 1299709) % (SELECT count(*) FROM cells)""")
def pseudo_spot_cells(s, d):
    return mixture.draw_cells(fx.cells(s, d), 500, method="cell", mix=mixture.arithmetic)


# --- graphs


LAP = """deg AS (SELECT src, sum(w) AS w FROM e GROUP BY 1),
lap AS (SELECT src, dst, -w AS w FROM e UNION ALL SELECT src, src, w FROM deg)"""


@query(f"""WITH {fx.PPI}, e0 AS (SELECT a.gene_id AS src, b.gene_id AS dst FROM ppi JOIN genes a ON upper(gene1) = upper(a.gene) JOIN genes b ON upper(gene2) = upper(b.gene) WHERE combined_score >= 5 AND a.gene_id <> b.gene_id)
SELECT src, dst, CAST(1 AS DOUBLE) AS w FROM (SELECT src, dst FROM e0 UNION SELECT dst, src FROM e0)""")
def ppi_edges(s, d):
    p = fx.interactions(s, d)
    g = p.select(F.explode(F.array("gene1", "gene2")).alias("gene")).union(fx.expr(s, d).select("gene"))
    return graphs.interaction_graph(p, genes_of(g), 5)


@query(f"""WITH {fx.PPI}, e0 AS (SELECT a.gene_id AS src, b.gene_id AS dst FROM ppi JOIN genes a ON gene1 = a.gene JOIN genes b ON gene2 = b.gene WHERE combined_score >= 5),
e AS (SELECT src, dst, CAST(1 AS DOUBLE) AS w FROM (SELECT src, dst FROM e0 UNION SELECT dst, src FROM e0)), {LAP} SELECT src, dst, w FROM lap""")
def ppi_laplacian(s, d):
    return graphs.laplacian(ppi_edges(s, d))


INTRA = """(SELECT a.obs_id AS src, b.obs_id AS dst FROM cells a JOIN cells b ON a.slice = b.slice AND a.obs_id <> b.obs_id AND (a.x - b.x) ** 2 + (a.y - b.y) ** 2 <= 900)"""
CROSS = """(SELECT a.obs_id AS src, b.obs_id AS dst FROM cells a JOIN cells b ON a.slice <> b.slice AND (a.x - b.x) ** 2 + (a.y - b.y) ** 2 <= 100)"""


def _points(s, d):
    return fx.cells(s, d).withColumns({"px": F.col("x"), "py": F.col("y")})


@query(f"WITH {fx.CELLS}, e AS (SELECT *, CAST(1 AS DOUBLE) AS w FROM {INTRA}), {LAP} SELECT src, dst, w FROM lap")
def radius_laplacian(s, d):
    return graphs.radius_laplacian(_points(s, d), 30.0)


@query(f"WITH {fx.CELLS} SELECT src, dst, CAST(1 AS DOUBLE) AS w FROM {CROSS}")
def cross_slice_radius(s, d):
    return graphs.cross_slice_graph(_points(s, d), 10.0)


@query(f"WITH {fx.CELLS}, e AS (SELECT *, CAST(1 AS DOUBLE) AS w FROM (SELECT * FROM {INTRA} UNION ALL SELECT * FROM {CROSS})), {LAP} SELECT src, dst, w FROM lap")
def spatial_laplacian(s, d):
    return graphs.radius_laplacian(_points(s, d), 30.0, 10.0)


@query(f"""WITH {fx.CELLS}, e AS (SELECT *, CAST(1 AS DOUBLE) AS w FROM {INTRA}), {LAP}
SELECT lap.src, lap.dst, round(lap.w / sqrt(a.w * b.w), 6) AS w FROM lap JOIN deg a ON a.src = lap.src JOIN deg b ON b.src = lap.dst""")
def laplacian_sym_norm(s, d):
    return graphs.radius_laplacian(_points(s, d), 30.0, normalized=True).withColumn("w", r("w"))


def _near(k: int, score: str, where: str = "a.obs_id <> b.obs_id") -> str:
    return f"""near AS MATERIALIZED (SELECT * FROM (SELECT a.obs_id AS src, b.obs_id AS dst, {score} AS s, row_number() OVER (PARTITION BY a.obs_id ORDER BY {score} DESC, b.obs_id) AS rank FROM emb a JOIN emb b ON {where}) WHERE rank <= {k})"""


COS = "list_cosine_similarity(a.vec, b.vec)"


@query(f"WITH {fx.EMB}, {_near(10, COS)} SELECT src, dst, CAST(rank AS INTEGER) AS rank, round(s, 6) AS score FROM near")
def knn_by_pivots(s, d):
    """With blocks of 100 rows, so that pivots and bounds decide which of them a row meets."""
    e = fx.emb(s, d).select("obs_id", "vec")
    return graphs.knn(e, e, 10, exclude_self=True, block_rows=100).select("src", "dst", F.col("rank").cast("int").alias("rank"), r("score").alias("score"))


@query(f"""WITH {fx.EMB}, {_near(10, COS)} SELECT src, count(*) AS n_links, round(sum(s), 6) AS nearest_total, TRUE AS recall_95 FROM near GROUP BY 1""")
def knn_by_descent(s, d):
    """Of each row the number of links found and the sum of its 10 best scores by exact search; and whether descent found
    95 of 100 of all those links, with equal scores."""
    e = fx.emb(s, d).select("obs_id", "vec")
    found = tables.written(graphs.knn_by_descent(e, 10).select("src", "dst", "score"), "descent-links")
    exact = graphs.knn(e, e, 10, exclude_self=True).select("src", "dst", F.col("score").alias("exact"))
    both = exact.join(found, ["src", "dst"], "full")
    hit = F.coalesce(F.abs(F.col("score") - F.col("exact")) < 1e-9, F.lit(False))
    share = both.agg((F.sum(F.when(hit, 1).otherwise(0)) / F.count("exact")).alias("share")).select((F.col("share") >= 0.95).alias("recall_95"))
    out = both.groupBy("src").agg(F.count("score").alias("n_links"), F.sum("exact").alias("t"))
    return out.crossJoin(F.broadcast(share)).select("src", "n_links", r("t").alias("nearest_total"), "recall_95")  # one row


@query(f"WITH {fx.EMB}, {_near(10, COS)}, b AS (SELECT least(src, dst) AS u, greatest(src, dst) AS v FROM near GROUP BY 1, 2 HAVING count(*) = 2) SELECT unnest([u, v]) AS src, unnest([v, u]) AS dst, CAST(1 AS DOUBLE) AS w FROM b")
def mutual_knn(s, d):
    return graphs.mutual_knn(fx.emb(s, d).select("obs_id", "vec"), 10)


@query(f"""WITH {fx.EMB}, {_near(20, "list_dot_product(a.vec, b.vec)", "a.dom = 1 AND b.dom = 0")} SELECT src, dst, CAST(rank AS INTEGER) AS rank, round(s, 6) AS score FROM near""")
def cross_knn(s, d):
    e = fx.emb(s, d)
    return graphs.nearest_pseudo(e.where("dom = 1"), e.where("dom = 0"), 20).withColumn("score", r("score"))


ST = "p AS (SELECT obs_id, CAST((obs_id * 7919) % 100 AS DOUBLE) AS x, CAST((obs_id * 104729) % 101 AS DOUBLE) AS y FROM emb WHERE dom = 0)"


@query(f"""WITH {fx.EMB}, {ST}, {_near(10, COS)}, e AS (SELECT src, dst, CAST(1 AS DOUBLE) AS w FROM
  (SELECT a.obs_id AS src, b.obs_id AS dst FROM p a JOIN p b ON a.obs_id <> b.obs_id AND (a.x - b.x) ** 2 + (a.y - b.y) ** 2 <= 64
   UNION ALL SELECT n.src, n.dst FROM near n JOIN near m ON n.src = m.dst AND n.dst = m.src WHERE n.src % 2 = 1 OR n.dst % 2 = 1)), {LAP}
SELECT lap.src, lap.dst, round(lap.w / sqrt(a.w * b.w), 6) AS w FROM lap JOIN deg a ON a.src = lap.src JOIN deg b ON b.src = lap.dst""")
def st_pseudo_graph(s, d):
    e = fx.emb(s, d)
    at = e.where("dom = 0").select(F.lit("st").alias("slice"), "obs_id", (F.col("obs_id") * 7919 % 100).cast("double").alias("x"), (F.col("obs_id") * 104729 % 101).cast("double").alias("y"))
    emb = e.select("obs_id", "vec", F.when(F.col("dom") == 0, "st").otherwise("ps").alias("domain"))
    return graphs.reference_graph(at, emb, 8.0, 10).withColumn("w", r("w"))


@query(f"""WITH {fx.EMB}, {_near(8, COS)} SELECT src, dst, round(max(s), 6) AS w FROM (SELECT src, dst, s FROM near UNION ALL SELECT dst, src, s FROM near) GROUP BY 1, 2""")
def gene_cosine_graph(s, d):
    return graphs.cosine_graph(fx.emb(s, d).select("obs_id", "vec"), 8).withColumn("w", r("w"))


@query(f"""WITH {fx.CELLS} SELECT src, dst, CAST(1 AS DOUBLE) AS w FROM (SELECT a.obs_id AS src, b.obs_id AS dst,
  row_number() OVER (PARTITION BY a.obs_id ORDER BY sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2), b.obs_id) AS n FROM cells a JOIN cells b ON a.slice = b.slice AND a.obs_id <> b.obs_id) WHERE n <= 6""")
def grid_neighbors(s, d):
    return graphs.spatial_neighbors(fx.cells(s, d), 6)


@query(f"WITH {fx.CELLS}, e AS (SELECT * FROM {INTRA}) SELECT src, dst, round(1 / (count(*) OVER (PARTITION BY src) + 1e-12), 6) AS w FROM e")
def row_normalized_adjacency(s, d):
    return graphs.radius_adjacency(_points(s, d), 30.0).withColumn("w", r("w"))


@query(f"""WITH {fx.EXPR}, e AS (SELECT * FROM {INTRA}), v AS (SELECT obs_id, gene AS key, value FROM expr) SELECT src AS obs_id, key, round(sum(value), 6) AS value FROM e JOIN v ON dst = obs_id GROUP BY 1, 2""")
def sparse_multiply(s, d):
    v = fx.expr(s, d).select("obs_id", F.col("gene").alias("key"), "value")
    return graphs.radius_multiply(_points(s, d), 30.0, v).withColumn("value", r("value"))


TOTAL = "y AS (SELECT obs_id, sum(value) AS value FROM expr GROUP BY 1)"


@query(f"""WITH {fx.EXPR}, {TOTAL}, e AS (SELECT src, dst FROM {INTRA} UNION ALL SELECT obs_id, obs_id FROM y) SELECT src AS obs_id, 't' AS key, round(avg(value), 6) AS value FROM e JOIN y ON dst = obs_id WHERE true GROUP BY 1""")
def spmm_smooth(s, d):
    y = fx.expr(s, d).groupBy("obs_id").agg(F.sum("value").alias("value")).select("obs_id", F.lit("t").alias("key"), "value")
    return graphs.radius_smooth(_points(s, d), 30.0, y).withColumn("value", r("value"))


@query(f"WITH {fx.EXPR} SELECT src, dst, max(w) AS w FROM (SELECT obs_id % 50 AS src, CAST(value AS BIGINT) % 20 AS dst, value AS w FROM expr) GROUP BY 1, 2")
def coalesce_max(s, d):
    return graphs.coalesce_max(fx.expr(s, d).select((F.col("obs_id") % 50).alias("src"), (F.col("value").cast("long") % 20).alias("dst"), F.col("value").alias("w")))


# --- algebra, factorization


@query(f"""WITH {fx.EMB}, l AS (SELECT obs_id, unnest(range(0, 64)) AS i, unnest(vec) AS v FROM emb) SELECT CAST(a.i AS INTEGER) AS i, CAST(b.i AS INTEGER) AS j, round(sum(a.v * b.v), 5) AS v FROM l a JOIN l b USING (obs_id) GROUP BY 1, 2""")
def gram_matrix(s, d):
    g = linalg.gram(fx.emb(s, d), "vec")
    return s.createDataFrame([(i, j, float(g[i, j])) for i in range(len(g)) for j in range(len(g))], "i int, j int, v double").withColumn("v", r("v", 5))


@query(f"""WITH {fx.EMB}, l AS (SELECT obs_id, unnest(range(0, 64)) AS i, unnest(vec) AS v FROM emb), n AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM emb) SELECT CAST(i AS INTEGER) AS i, round(sum(v * (obs_id % 7)), 5) AS v FROM l GROUP BY 1""")
def ridge_normal_equations(s, d):
    """The right side S^T x of a ridge regression on one made-up feature."""
    g = linalg.gram(fx.emb(s, d).select("vec", F.array((F.col("obs_id") % 7).cast("double")).alias("x")), "vec", "x")
    return s.createDataFrame([(i, float(v)) for i, v in enumerate(g[:, 0])], "i int, v double").withColumn("v", r("v", 5))


@query()
def ridge_factors(s, d):
    e = fx.emb(s, d)
    x = e.select("obs_id", F.array(*((F.col("obs_id") % k).cast("double") for k in (3, 5, 7))).alias("x"))
    b = impute.ridge_factors(e.select("obs_id", "vec"), x)
    return s.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(b)], "feature int, factors array<double>")


@query()
def joint_pca(s, d):
    return linalg.principal_components(fx.emb(s, d).select("obs_id", "vec"), 10, vec="vec", out="pc")[0].select("obs_id", "pc")


@query(f"WITH {fx.EMB} SELECT f AS feature, i, CAST(0 AS DOUBLE) AS residual FROM range(3) t(f), range(64) u(i)")
def ridge_residual(s, d):
    """S^T (S b - x) + b of the ridge factors b, which vanishes at the solution."""
    e = fx.emb(s, d).select("obs_id", "vec", F.array(*((F.col("obs_id") % k).cast("double") for k in (3, 5, 7))).alias("x"))
    b = impute.ridge_factors(e.select("obs_id", "vec"), e.select("obs_id", "x"))
    table = s.createDataFrame([(f, i, float(v)) for f, row in enumerate(b) for i, v in enumerate(row)], "f long, i long, b double")
    long = e.select("obs_id", "x", F.posexplode("vec").alias("i", "v"))
    fitted = long.join(F.broadcast(table), "i").groupBy("obs_id", "f").agg(F.sum(F.col("v") * F.col("b")).alias("y"))  # 192 rows
    gap = e.join(fitted, "obs_id").select("obs_id", "f", (F.col("y") - F.get("x", F.col("f").cast("int"))).alias("gap"))
    total = long.select("obs_id", "i", "v").join(gap, "obs_id").groupBy("f", "i").agg(F.sum(F.col("v") * F.col("gap")).alias("g"))
    zero = lambda c: F.round(c, 6) + F.lit(0.0)
    return total.withColumn("i", F.col("i").cast("long")).join(F.broadcast(table), ["f", "i"]).select(F.col("f").alias("feature"), "i", zero(F.col("g") + F.col("b")).alias("residual"))


@query(f"""WITH {fx.EMB}, n AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM emb), l AS (SELECT obs_id, unnest(range(0, 64)) AS i, unnest(vec) AS v FROM emb), m AS (SELECT i, avg(v) AS m FROM l GROUP BY 1),
c AS MATERIALIZED (SELECT a.i, b.i AS j, sum(a.v * b.v) / (n - 1) - ma.m * mb.m * n / (n - 1) AS c FROM l a JOIN l b USING (obs_id) JOIN m ma ON ma.i = a.i JOIN m mb ON mb.i = b.i, n GROUP BY a.i, b.i, ma.m, mb.m, n),
c2 AS MATERIALIZED (SELECT a.i, b.j, sum(a.c * b.c) AS c FROM c a JOIN c b ON a.j = b.i GROUP BY 1, 2)
SELECT 1 AS power, round(sum(c), 7) AS moment FROM c WHERE i = j UNION ALL SELECT 2, round(sum(c * c), 7) FROM c
UNION ALL SELECT 3, round(sum(c2.c * c.c), 8) FROM c2 JOIN c ON c2.i = c.i AND c2.j = c.j UNION ALL SELECT 4, round(sum(c * c), 9) FROM c2 UNION ALL SELECT 0, CAST(0 AS DOUBLE)""")
def joint_pca_moments(s, d):
    """Sums of powers of the components' variances, all 64 of them, which fix the spectrum's moments; power 0: the greatest
    covariance of two different components, which vanishes."""
    pc, _, variance = linalg.principal_components(fx.emb(s, d).select("obs_id", "vec"), 64, vec="vec", out="pc")
    g = linalg.gram(pc, "pc") / max(1, pc.count() - 1)
    own = [float(x) for x in g.diagonal()]
    off = max(abs(float(g[i, j])) for i in range(len(g)) for j in range(len(g)) if i != j)
    digits = {1: 7, 2: 7, 3: 8, 4: 9}
    rows = [(0, round(off, 9) + max(abs(a - float(b)) for a, b in zip(own, variance, strict=True)).__round__(9))] + [(p, round(sum(x**p for x in own), k)) for p, k in digits.items()]
    return s.createDataFrame(rows, "power int, moment double")


@query(f"""WITH {fx.EXPR}, wide AS (SELECT gene, dense_rank() OVER (ORDER BY gene) - 1 AS i, obs_id, value FROM expr), g AS (SELECT DISTINCT i FROM wide)
SELECT CAST(k AS INTEGER) AS component, CAST(i AS INTEGER) AS i, CAST(0 AS DOUBLE) AS residual, round((SELECT sum(value * value) FROM expr), 4) AS squares, TRUE AS ordered FROM range(5) c(k), g""")
def wide_components(s, d):
    """Truncated singular decomposition of all observations' counts without a G x G matrix: X^T (X v) - value v, relative to the greatest
    value, from the long table by joins; the sum of squares; and whether values descend, the first is at least the greatest
    squared length of a single feature, and loadings are orthonormal: residuals alone hold for any eigenvectors."""
    e = tables.written(fx.expr(s, d), "wide-expr")
    genes = genes_of(e)
    rows = tables.written(preprocess.dense_rows(e, genes).select("obs_id", "x"), "wide-rows")
    _, load, variance = linalg.principal_components(rows, 5, centered=False, out="pc", gram_features=0)
    values = [float(v) * max(1, rows.count() - 1) for v in variance]
    table = F.broadcast(s.createDataFrame([(k, i, float(v)) for i, row in enumerate(load) for k, v in enumerate(row)], "component int, i int, v double"))  # five for each feature
    long = e.join(F.broadcast(genes), "gene").select("obs_id", F.col("gene_id").alias("i"), "value")
    each = range(load.shape[1])
    beside = F.broadcast(s.createDataFrame([(i, *map(float, row)) for i, row in enumerate(load)], ", ".join(["i int", *(f"v{k} double" for k in each)])))
    scores = long.join(beside, "i").groupBy("obs_id").agg(*(F.sum(F.col("value") * F.col(f"v{k}")).alias(f"y{k}") for k in each))
    sums = long.join(scores, "obs_id").groupBy("i").agg(*(F.sum(F.col("value") * F.col(f"y{k}")).alias(f"b{k}") for k in each))
    back = sums.select("i", F.posexplode(F.array(*(f"b{k}" for k in each))).alias("component", "back"))
    own = table.join(back, ["component", "i"]).withColumn("value", F.element_at(F.array(*(F.lit(v) for v in values)), F.col("component") + 1))
    longest = long.groupBy("i").agg(F.sum(F.col("value") ** 2).alias("l")).agg(F.max("l")).first()[0]
    squares = long.agg(F.sum(F.col("value") ** 2)).first()[0]
    gap = max(abs(float(load[:, a] @ load[:, b]) - (a == b)) for a in range(5) for b in range(5))
    ordered = values == sorted(values, reverse=True) and longest <= values[0] * (1 + 1e-9) and sum(values) <= squares * (1 + 1e-9) and gap < 1e-9
    residual = F.round((F.col("back") - F.col("value") * F.col("v")) / F.lit(values[0]), 7) + F.lit(0.0)
    return own.select("component", "i", residual.alias("residual"), F.round(F.lit(float(squares)), 4).alias("squares"), F.lit(ordered).alias("ordered"))


def _study(s, d):
    """All slices over all genes that every slice has; rows carry their place."""
    e = tables.written(preprocess.log1p(preprocess.normalize_total(tables.written(fx.expr(s, d), "study-counts"))), "study")
    var = e.select("slice", "gene").distinct().withColumn("position", F.row_number().over(Window.partitionBy("slice").orderBy("gene")))
    table = preprocess.align_genes(var, use_hvg=False)
    rows = preprocess.dense_rows(e.join(F.broadcast(table.select("gene")), "gene", "left_semi"), table).join(_points(s, d).select("obs_id", "px", "py"), "obs_id")
    lap = graphs.row_graph(_points(s, d), 30.0, 10.0)
    gene = graphs.laplacian(graphs.interaction_graph(fx.interactions(s, d), table, 5))
    return rows, lap, tables.written(gene, "study-genes")


@query()
def factorize_embedding(s, d):
    return factorize.embeddings(factorize.fit(*_study(s, d)))


@query(f"""WITH {fx.EXPR}, n AS (SELECT count(DISTINCT slice) AS n FROM expr), g AS (SELECT gene FROM expr, n GROUP BY gene, n HAVING count(DISTINCT slice) = n),
p AS (SELECT gene, row_number() OVER (ORDER BY gene) - 1 AS i FROM g)
SELECT part, CAST(i AS VARCHAR) AS of, CAST(0 AS DOUBLE) AS residual FROM p, (VALUES ('features'), ('smooth')) t(part)
UNION ALL SELECT part, slice, CAST(0 AS DOUBLE) FROM (SELECT DISTINCT slice FROM expr), (VALUES ('orthonormal'), ('nearest')) t(part)""")
def factorize_optimality(s, d):
    """After 3 sweeps at the default rank: the row factors are orthonormal and the nearest to their targets, the feature factors
    are the best for the rest, and the smoothing step solves its equation, all to 6 digits; a wrong step doesn't."""
    rows, lap, gene = _study(s, d)
    return factorize.optimality(factorize.fit(rows, lap, gene, iters=3), gene)


# --- clustering, registration


@query()
def gmm_tied(s, d):
    return cluster.tied_mixture(fx.emb(s, d).select("obs_id", "vec"), 10)


def _leiden(s, d):
    e = fx.emb(s, d).select("obs_id", "vec")
    edges = tables.written(cluster.neighbor_graph(e, 10).select(F.lit("all").alias("slice"), "src", "dst", "w"), "neighbour-graph")
    return edges, cluster.cluster_graph(edges, e.select(F.lit("all").alias("slice"), "obs_id"))


@query()
def leiden_clusters(s, d):
    return _leiden(s, d)[1].drop("slice")


@query(f"WITH {fx.EMB} SELECT count(*) AS n, CAST(0 AS BIGINT) AS improving, true AS fewer, CAST(0 AS BIGINT) AS empty FROM emb")
def leiden_local_optimum(s, d):
    """No node would gain by a move to a neighbour's community; there are fewer communities than a tenth of the nodes, numbered
    without gaps. Single nodes, one community for all, or random ones fail this."""
    edges, found = _leiden(s, d)
    found = tables.written(found, "clusters")
    improving = communities.improving_moves(edges, found).count()
    better = communities.modularity(edges, found).first().modularity > 0.2
    k = F.count_distinct("cluster")
    return found.agg(F.count("*").alias("n"), F.lit(improving).cast("long").alias("improving"), ((k * 10 < F.count("*")) & F.lit(better)).alias("fewer"), (F.max("cluster") + 1 - k).cast("long").alias("empty"))


@query()
def register_slices(s, d):
    e = fx.emb(s, d).select(F.concat(F.lit("b"), F.col("batch").cast("string")).alias("slice"), "obs_id", "vec", (F.col("obs_id") * 7919 % 100).cast("double").alias("x"), (F.col("obs_id") * 104729 % 101).cast("double").alias("y"))
    return register.register(e)


@query("""WITH p AS (SELECT vec_id AS obs_id, CAST((vec_id * 7919) % 100 AS DOUBLE) AS x, CAST((vec_id * 104729) % 101 AS DOUBLE) AS y FROM embeddings)
SELECT 'a' AS slice, obs_id, x AS px, y AS py FROM p UNION ALL SELECT 'b', obs_id + 1000000, x, y FROM p""")
def register_turned_copy(s, d):
    """A slice and its copy, turned by 30 degrees and shifted, with the same expression: registration lays each copied spot
    onto its original."""
    x, y = (F.col("obs_id") * 7919 % 100).cast("double"), (F.col("obs_id") * 104729 % 101).cast("double")
    smooth = [1 + F.sin(F.col("x") / 20), 1 + F.cos(F.col("y") / 25), 1 + F.sin((F.col("x") + 2 * F.col("y")) / 40), F.col("x") / 50, F.col("y") / 50, F.col("x") * F.col("y") / 5000]
    own = [F.abs(F.get("vec", i)) / 10 for i in range(4)]
    a = fx.emb(s, d).withColumns({"x": x, "y": y}).select(F.lit("a").alias("slice"), "obs_id", "x", "y", F.array(*smooth, *own).alias("vec"))
    cos, sin = 3**0.5 / 2, 0.5
    b = a.select(F.lit("b").alias("slice"), (F.col("obs_id") + 1_000_000).alias("obs_id"), (cos * F.col("x") - sin * F.col("y") + 40).alias("x"), (sin * F.col("x") + cos * F.col("y") - 15).alias("y"), "vec")
    out = register.register(a.union(b))
    return out.select("slice", "obs_id", *((F.round(c, 3) + F.lit(0.0)).alias(c) for c in ("px", "py")))


@query(f"""WITH {fx.EMB}, p AS (SELECT 'b' || batch AS slice, CAST((obs_id * 7919) % 100 AS DOUBLE) AS x, CAST((obs_id * 104729) % 101 AS DOUBLE) AS y FROM emb)
SELECT slice, count(*) AS n, round(var_pop(x) + var_pop(y), 5) AS spread FROM p GROUP BY 1""")
def register_rigid(s, d):
    """Registration turns and shifts slices, so the spread of each one's spots stays."""
    p = register_slices(s, d)
    return p.groupBy("slice").agg(F.count("*").alias("n"), F.round(F.var_pop("px") + F.var_pop("py"), 5).alias("spread"))


# --- compositions


def _full(s, d) -> DataFrame:
    """True compositions over every pair of bin and type."""
    return metrics.paired(fx.truth(s, d), fx.estimate(s, d)).select("obs_id", "cell_type", F.col("p").alias("value"))


CLR = "z0 AS (SELECT obs_id, cell_type, ln(p / (sum(p) OVER w + 1e-8) + 1e-4) AS z FROM pair WINDOW w AS (PARTITION BY obs_id)), z AS (SELECT obs_id, cell_type, z - avg(z) OVER (PARTITION BY obs_id) AS value FROM z0)"


@query(f"WITH {fx.PAIR}, {CLR} SELECT obs_id, cell_type, round(value, 6) AS value FROM z")
def clr_transform(s, d):
    return deconvolve.clr_transform(_full(s, d)).withColumn("value", r("value"))


@query(f"""WITH {fx.PAIR}, {CLR}, x AS (SELECT obs_id, cell_type, exp(value - max(value) OVER (PARTITION BY obs_id)) AS e FROM z) SELECT obs_id, cell_type, round(e / (sum(e) OVER (PARTITION BY obs_id) + 1e-8), 6) AS value FROM x""")
def softmax_rows(s, d):
    return deconvolve.softmax(deconvolve.clr_transform(_full(s, d))).withColumn("value", r("value"))


def _sharp(expression: str) -> str:
    return f"""WITH {fx.PAIR}, c AS (SELECT cell_type, quantile_cont(p, 0.05) AS lo, quantile_cont(p, 0.95) AS hi FROM pair GROUP BY 1)
SELECT obs_id, cell_type, round({expression}, 6) AS value FROM pair JOIN c USING (cell_type)"""


@query(_sharp("CASE WHEN p >= lo AND p <= hi THEN p ELSE 0 END ** 2"))
def sharpen_keep(s, d):
    return deconvolve.sharpen(_full(s, d), 5, 95).select("obs_id", "cell_type", r("value").alias("value"))


@query(_sharp("least(greatest(p, lo), hi) ** 2"))
def sharpen_winsor(s, d):
    return deconvolve.sharpen(_full(s, d), 5, 95, "winsor").select("obs_id", "cell_type", r("value").alias("value"))


@query(f"""WITH {fx.PAIR}, c AS (SELECT cell_type, quantile_cont(p, 0.05) AS lo, quantile_cont(p, 0.95) AS hi FROM pair GROUP BY 1),
x AS (SELECT obs_id, cell_type, CASE WHEN p >= lo AND p <= hi THEN p ELSE 0 END ** 2 AS sharp FROM pair JOIN c USING (cell_type)),
o AS (SELECT DISTINCT obs_id, CAST(split_part(obs_id, '_', 2) AS BIGINT) AS bx, CAST(split_part(obs_id, '_', 3) AS BIGINT) AS by_ FROM x),
e AS (SELECT a.obs_id AS src, b.obs_id AS dst FROM o a JOIN o b ON abs(a.bx - b.bx) + abs(a.by_ - b.by_) <= 1)
SELECT src AS obs_id, n.cell_type, round(any_value(m.sharp), 6) AS sharp, round(avg(n.sharp), 6) AS smooth FROM e JOIN x n ON n.obs_id = dst JOIN x m ON m.obs_id = src AND m.cell_type = n.cell_type GROUP BY 1, 2""")
def sharpened_and_smoothed(s, d):
    """All types at once, smoothed over the bins that share a side."""
    full = _full(s, d)
    at = full.select("obs_id").distinct().select("obs_id", *(F.split("obs_id", "_")[i].cast("long").alias(c) for i, c in ((1, "bx"), (2, "by"))))
    sides = F.explode(F.array(*(F.struct((F.col("bx") + i).alias("bx"), (F.col("by") + j).alias("by")) for i, j in ((1, 0), (-1, 0), (0, 1), (0, -1)))))
    edges = at.select(F.col("obs_id").alias("src"), sides.alias("n")).select("src", "n.bx", "n.by").join(at.withColumnRenamed("obs_id", "dst"), ["bx", "by"]).select("src", "dst", F.lit(1.0).alias("w"))
    both, _ = deconvolve.sharpen_and_smooth(full, edges, p_lo=5, p_hi=95)
    return both.select("obs_id", "cell_type", r("sharp").alias("sharp"), r("smooth").alias("smooth"))


@query(f"""WITH {fx.EXPR}, {fx.BINS}, {fx.TRUTH} SELECT obs_id, {", ".join(f"max(CASE WHEN cell_type = '{t}' THEN round(value, 6) END) AS {t}" for t in ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"))} FROM truth GROUP BY 1""")
def pivot_composition(s, d):
    return deconvolve.pivoted(fx.truth(s, d).withColumn("value", r("value")), ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"])


def _mixture_tables(s, d):
    """Half of the embeddings as spots, half as pseudo-spots with made-up compositions by label."""
    e = fx.emb(s, d)
    ps = e.where("dom = 0")
    comp = ps.select("obs_id", F.explode(F.array(F.struct(F.concat(F.lit("t"), (F.col("label") % 3).cast("string")).alias("t"), F.lit(0.75).alias("v")), F.struct(F.lit("t3").alias("t"), F.lit(0.25).alias("v")))).alias("z"))
    return e.where("dom = 1").select("obs_id", "vec"), ps.select("obs_id", "vec"), comp.select("obs_id", F.col("z.t").alias("cell_type"), F.col("z.v").alias("value"))


@query()
def lle_deconvolve(s, d):
    return deconvolve.deconvolve(*_mixture_tables(s, d), method="lle", k=10)


@query(f"WITH {fx.EMB} SELECT obs_id, CAST(4 AS BIGINT) AS n, CAST(1 AS DOUBLE) AS total, false AS negative FROM emb WHERE dom = 1")
def lle_simplex(s, d):
    """Estimated compositions have all types, no negative share, and shares that add up to 1."""
    return lle_deconvolve(s, d).groupBy("obs_id").agg(F.count("*").alias("n"), F.round(F.sum("value"), 5).alias("total"), (F.min("value") < 0).alias("negative"))


_LLE2 = f"""WITH {fx.EMB}, {_near(2, COS, "a.dom = 1 AND b.dom = 0")},
z AS (SELECT src, rank, dst, list_transform(range(1, 65), lambda i: b.vec[i] - a.vec[i]) AS z FROM near JOIN emb a ON a.obs_id = src JOIN emb b ON b.obs_id = dst),
g AS (SELECT p.src, p.dst AS d1, q.dst AS d2, list_dot_product(p.z, p.z) AS a, list_dot_product(q.z, q.z) AS b, list_dot_product(p.z, q.z) AS c FROM z p JOIN z q ON p.src = q.src AND p.rank = 1 AND q.rank = 2),
h AS (SELECT src, d1, d2, a + (1e-3 * (a + b) / 2 + 1e-8) AS a, b + (1e-3 * (a + b) / 2 + 1e-8) AS b, c FROM g),
r AS (SELECT src, d1, d2, (b - c) / (a * b - c * c) AS u, (a - c) / (a * b - c * c) AS v FROM h),
s AS (SELECT src, d1, d2, greatest(u / (u + v + 1e-8), 0) AS u, greatest(v / (u + v + 1e-8), 0) AS v FROM r),
w AS (SELECT src, unnest([d1, d2]) AS dst, unnest([u / (u + v + 1e-8), v / (u + v + 1e-8)]) AS w FROM s),
y AS (SELECT obs_id, 't' || (label % 3) AS cell_type, 0.75 AS y FROM emb WHERE dom = 0 UNION ALL SELECT obs_id, 't3', 0.25 FROM emb WHERE dom = 0),
o AS (SELECT src, cell_type, sum(w * y) AS v FROM w JOIN y ON y.obs_id = dst GROUP BY 1, 2),
t AS (SELECT DISTINCT cell_type FROM y)
SELECT src AS obs_id, t.cell_type, round(coalesce(v, 0) / (sum(coalesce(v, 0)) OVER (PARTITION BY src) + 1e-8), 5) AS value FROM (SELECT DISTINCT src FROM o) CROSS JOIN t LEFT JOIN o USING (src, cell_type)"""


@query(_LLE2)
def lle_two_neighbors(s, d):
    """Local linear weights over the two nearest pseudo-spots, where SQL has the solution of the 2 x 2 system."""
    return deconvolve.deconvolve(*_mixture_tables(s, d), method="lle", k=2).withColumn("value", F.round("value", 5) + F.lit(0.0))


@query()
def gbdt_deconvolve(s, d):
    return deconvolve.deconvolve(*_mixture_tables(s, d), method="gbdt")


# --- metrics


@query(f"""WITH {fx.CELLS}, t AS (SELECT label AS a, floor(x / 200) AS b, CAST(count(*) AS DOUBLE) AS n FROM cells GROUP BY 1, 2),
x AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM t) AS s, (SELECT sum(n) FROM t) AS n, (SELECT sum(n * (n - 1) / 2) FROM (SELECT sum(n) AS n FROM t GROUP BY a)) AS sa, (SELECT sum(n * (n - 1) / 2) FROM (SELECT sum(n) AS n FROM t GROUP BY b)) AS sb)
SELECT round((s - sa * sb / (n * (n - 1) / 2)) / ((sa + sb) / 2 - sa * sb / (n * (n - 1) / 2)), 6) AS ari FROM x""")
def adjusted_rand_index(s, d):
    return metrics.adjusted_rand_index(fx.cells(s, d).withColumn("pred", F.floor(F.col("x") / 200)), "label", "pred").withColumn("ari", r("ari"))


def _lisi(column: str, name: str) -> str:
    return f"""{name}0 AS (SELECT src, b.{column} AS c, CAST(count(*) AS DOUBLE) AS n FROM near JOIN emb b ON b.obs_id = dst GROUP BY 1, 2),
{name} AS (SELECT src AS obs_id, (sum(n) ** 2 / sum(n * n) - 1) / ((SELECT count(DISTINCT {column}) FROM emb) - 1) AS lisi FROM {name}0 GROUP BY 1)"""


def _nearest_20(s, d) -> DataFrame:
    e = fx.emb(s, d).select("obs_id", "vec")
    return graphs.knn(e, e, 20, exclude_self=True)


def _direct(s, d, near: DataFrame, column: str) -> DataFrame:
    labels = fx.emb(s, d).select("obs_id", F.col(column).alias("label"))
    return metrics.scale_lisi(metrics.inverse_simpson(near, labels), labels)


@query(f"WITH {fx.EMB}, {_near(20, COS)}, {_lisi('batch', 'l')} SELECT obs_id, round(lisi, 6) AS lisi FROM l")
def lisi_direct_knn(s, d):
    return _direct(s, d, _nearest_20(s, d), "batch").withColumn("lisi", r("lisi"))


@query(f"""WITH {fx.EMB}, {_near(20, COS)}, {_lisi('batch', 'l')}, {_lisi('label', 'm')} SELECT obs_id, round(CASE WHEN l.lisi + 1 - m.lisi > 0 THEN 2 * l.lisi * (1 - m.lisi) / (l.lisi + 1 - m.lisi) ELSE 0 END, 6) AS f1 FROM l JOIN m USING (obs_id)""")
def f1_lisi(s, d):
    near = tables.written(_nearest_20(s, d).select("src", "dst"), "lisi-links")  # one search serves both
    return metrics.f1_from_lisi(_direct(s, d, near, "batch"), _direct(s, d, near, "label")).withColumn("f1", r("f1"))


def _longer(a: str, b: str) -> str:
    return f"{b} AS MATERIALIZED (SELECT a.src, b.dst, min(a.d + b.d) AS d FROM {a} a JOIN {a} b ON a.dst = b.src GROUP BY 1, 2)"


@query(f"""WITH {fx.EMB}, {_near(15, "-list_distance(a.vec, b.vec)")}, e AS (SELECT src, dst, -s AS d FROM near UNION ALL SELECT dst, src, -s FROM near UNION ALL SELECT obs_id, obs_id, 0 FROM emb),
d1 AS MATERIALIZED (SELECT src, dst, min(d) AS d FROM e GROUP BY 1, 2), {_longer("d1", "d2")}, {_longer("d2", "d4")}, {_longer("d4", "d8")},
n AS (SELECT src, dst FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY d, dst) AS n FROM d8 WHERE src <> dst) WHERE n <= 90),
l AS (SELECT src, batch, CAST(count(*) AS DOUBLE) AS n FROM n JOIN emb ON obs_id = dst GROUP BY 1, 2)
SELECT src AS obs_id, round((sum(n) ** 2 / sum(n * n) - 1) / ((SELECT count(DISTINCT batch) FROM emb) - 1), 6) AS lisi FROM l GROUP BY 1""")
def dijkstra_lisi(s, d):
    """In the SQL paths have 8 edges at most; those to the 90 nearest have fewer."""
    e = fx.emb(s, d)
    return metrics.graph_lisi(e.select("obs_id", "vec"), e.select("obs_id", F.col("batch").alias("label")), 15, 90).withColumn("lisi", r("lisi"))


CLIP = "SELECT obs_id, cell_type, least(greatest(p, 1e-12), 1) AS p, least(greatest(q, 1e-12), 1) AS q FROM norm"


@query(f"WITH {fx.PAIR}, c AS ({CLIP}) SELECT obs_id, round(sum(p * ln(p / ((p + q) / 2))) / 2 + sum(q * ln(q / ((p + q) / 2))) / 2, 6) AS jsd FROM c GROUP BY 1")
def jsd_per_spot(s, d):
    return metrics.jsd_per_spot(metrics.paired(fx.truth(s, d), fx.estimate(s, d))).withColumn("jsd", r("jsd"))


@query(f"""WITH {fx.PAIR}, b AS (SELECT cell_type, p AS p1, q AS q1, 1 - p AS p2, 1 - q AS q2 FROM (SELECT cell_type, least(greatest(p, 1e-12), 1 - 1e-12) AS p, least(greatest(q, 1e-12), 1 - 1e-12) AS q FROM norm))
SELECT cell_type, round(avg((p1 * ln(p1 / ((p1 + q1) / 2)) + q1 * ln(q1 / ((p1 + q1) / 2)) + p2 * ln(p2 / ((p2 + q2) / 2)) + q2 * ln(q2 / ((p2 + q2) / 2))) / 2), 6) AS jsd FROM b GROUP BY 1""")
def jsd_binary_per_type(s, d):
    return metrics.jsd_binary_per_type(metrics.paired(fx.truth(s, d), fx.estimate(s, d))).withColumn("jsd", r("jsd"))


@query(f"""WITH {fx.PAIR}, n9 AS (SELECT obs_id, cell_type, round(p, 9) AS p, round(q, 9) AS q FROM norm), k AS (SELECT cell_type, rank() OVER (PARTITION BY cell_type ORDER BY p) + (count(*) OVER (PARTITION BY cell_type, p) - 1) / 2.0 AS rp, rank() OVER (PARTITION BY cell_type ORDER BY q) + (count(*) OVER (PARTITION BY cell_type, q) - 1) / 2.0 AS rq FROM n9)
SELECT cell_type, round(corr(CAST(rp AS DOUBLE), CAST(rq AS DOUBLE)), 6) AS rho FROM k GROUP BY 1""")
def spearman_per_type(s, d):
    n = metrics.normalized_pair(metrics.paired(fx.truth(s, d), fx.estimate(s, d))).withColumns({"p": r("p", 9), "q": r("q", 9)})
    return metrics.spearman(n, "cell_type").withColumn("rho", r("rho"))


@query(f"""WITH {fx.PAIR} SELECT round((SELECT sqrt(avg((p - q) ** 2)) FROM pair), 6) AS rmse, round((SELECT avg(e) FROM (SELECT sqrt(avg((p - q) ** 2)) AS e FROM norm GROUP BY obs_id)), 6) AS spot_rmse_mean, round((SELECT quantile_cont(e, 0.5) FROM (SELECT sqrt(avg((p - q) ** 2)) AS e FROM norm GROUP BY cell_type)), 6) AS type_rmse_median""")
def rmse_global_and_normalized(s, d):
    return metrics.evaluate_composition(fx.truth(s, d), fx.estimate(s, d))[0].select(*(r(c).alias(c) for c in ("rmse", "spot_rmse_mean", "type_rmse_median")))


_JS = "({0} * ln({0} / (({0} + {1}) / 2)) + {1} * ln({1} / (({0} + {1}) / 2))) / 2"


def _ranks(by: str) -> str:
    side = "rank() OVER (PARTITION BY {by} ORDER BY round({c}, 9)) + (count(*) OVER (PARTITION BY {by}, round({c}, 9)) - 1) / 2.0"
    rows = ", ".join(f"{side.format(by=by, c=c)} AS r{c}" for c in "pq")
    return f"SELECT {by}, CASE WHEN max(rp) > min(rp) AND max(rq) > min(rq) THEN corr(CAST(rp AS DOUBLE), CAST(rq AS DOUBLE)) END AS rho FROM (SELECT {by}, {rows} FROM norm) GROUP BY 1"


EVALUATED = f"""{fx.PAIR}, cl AS (SELECT obs_id, cell_type, least(greatest(p, 1e-12), 1) AS p, least(greatest(q, 1e-12), 1) AS q, least(greatest(p, 1e-12), 1 - 1e-12) AS bp, least(greatest(q, 1e-12), 1 - 1e-12) AS bq FROM norm),
spot AS (SELECT * FROM (SELECT obs_id, sqrt(avg((p - q) ** 2)) AS rmse FROM norm GROUP BY 1) JOIN (SELECT obs_id, sum({_JS.format("p", "q")}) AS jsd FROM cl GROUP BY 1) USING (obs_id) JOIN ({_ranks("obs_id")}) USING (obs_id)),
kind AS (SELECT * FROM (SELECT cell_type, sqrt(avg((p - q) ** 2)) AS rmse FROM norm GROUP BY 1) JOIN (SELECT cell_type, avg({_JS.format("bp", "bq")} + {_JS.format("(1 - bp)", "(1 - bq)")}) AS jsd FROM cl GROUP BY 1) USING (cell_type) JOIN ({_ranks("cell_type")}) USING (cell_type))"""


@query(f"WITH {EVALUATED} SELECT (SELECT round(sqrt(avg((p - q) ** 2)), 6) FROM pair) AS rmse, " + ", ".join(f"(SELECT round({f}, 5) FROM {t}) AS {n}_{c}_{m}" for n, t in (("spot", "spot"), ("type", "kind")) for c in ("rmse", "jsd", "rho") for m, f in (("mean", f"avg({c})"), ("median", f"quantile_cont({c}, 0.5)"))))
def evaluation_figures(s, d):
    """All figures of the evaluation of a composition."""
    out = metrics.evaluate_composition(fx.truth(s, d), fx.estimate(s, d))[0]
    return out.select(*(r(c, 6 if c == "rmse" else 5).alias(c) for c in out.columns))


@query(f"WITH {EVALUATED} SELECT round(avg(rmse), 6) AS rmse, round(avg(jsd), 6) AS jsd, round(avg(rho), 5) AS rho FROM kind")
def type_means(s, d):
    means = metrics.type_means(metrics.evaluate_composition(fx.truth(s, d), fx.estimate(s, d))[2])
    return means.select(r("rmse").alias("rmse"), r("jsd").alias("jsd"), r("rho", 5).alias("rho"))


PRED = "pred AS (SELECT obs_id, gene, value * (1 + obs_id % 3) / 2 AS value FROM expr WHERE obs_id % 4 <> 1)"


@query(f"""WITH {fx.EXPR}, {PRED}, x AS (SELECT coalesce(expr.obs_id, pred.obs_id) AS obs_id, coalesce(expr.gene, pred.gene) AS gene, coalesce(expr.value, 0) AS p, coalesce(pred.value, 0) AS q FROM expr FULL JOIN pred ON expr.obs_id = pred.obs_id AND expr.gene = pred.gene),
g AS (SELECT gene, CASE WHEN sqrt(sum(p * p)) * sqrt(sum(q * q)) > 0 THEN sum(p * q) / (sqrt(sum(p * p)) * sqrt(sum(q * q))) ELSE 0 END AS c, avg((p - q) ** 2) AS m FROM x GROUP BY 1),
o AS (SELECT obs_id, CASE WHEN sqrt(sum(p * p)) * sqrt(sum(q * q)) > 0 THEN sum(p * q) / (sqrt(sum(p * p)) * sqrt(sum(q * q))) ELSE 0 END AS c, avg((p - q) ** 2) AS m FROM x GROUP BY 1)
SELECT round((SELECT quantile_cont(c, 0.5) FROM g), 6) AS gene_cosine, round((SELECT quantile_cont(m, 0.5) FROM g), 4) AS gene_mse, round((SELECT quantile_cont(c, 0.5) FROM o), 6) AS cell_cosine, round((SELECT quantile_cont(m, 0.5) FROM o), 4) AS cell_mse""")
def gene_and_cell_cosine_mse(s, d):
    e = fx.expr(s, d).select("obs_id", "gene", "value")
    p = e.where("obs_id % 4 <> 1").withColumn("value", F.col("value") * (1 + F.col("obs_id") % 3) / 2)
    return metrics.imputation_metrics(e, p).select(r("gene_cosine").alias("gene_cosine"), r("gene_mse", 4).alias("gene_mse"), r("cell_cosine").alias("cell_cosine"), r("cell_mse", 4).alias("cell_mse"))


@query("""WITH f AS (SELECT o_orderkey % 5 AS fold, count(*) AS n_genes, round(avg(o_totalprice), 4) AS mse FROM orders GROUP BY 1)
SELECT fold, n_genes, mse FROM f UNION ALL SELECT -1, CAST(sum(n_genes) AS BIGINT), round(avg(mse), 3) FROM f""")
def cross_validation_summary(s, d):
    f = fx.table(s, d, "orders").groupBy((F.col("o_orderkey") % 5).alias("fold")).agg(F.count("*").alias("n_genes"), r(F.avg("o_totalprice"), 4).alias("mse"))
    out = metrics.cross_validation_summary(f)
    return out.withColumn("mse", F.when(F.col("fold") == -1, r("mse", 3)).otherwise(F.col("mse")))


# --- imputation


PSEUDO_EXPR = "pe AS (SELECT obs_id * 2 AS obs_id, gene, value FROM expr)"
DOT_NEAR = _near(10, "list_dot_product(a.vec, b.vec)", "a.dom = 1 AND b.dom = 0")


def _near_and_expr(s, d):
    e = fx.emb(s, d)
    near = graphs.nearest_pseudo(e.where("dom = 1"), e.where("dom = 0"), 10)
    return near, fx.expr(s, d).select((F.col("obs_id") * 2).alias("obs_id"), "gene", "value")


@query(f"WITH {fx.EXPR}, {fx.EMB}, {PSEUDO_EXPR}, {DOT_NEAR} SELECT src AS obs_id, gene, round(sum(value) / 10, 6) AS value FROM near JOIN pe ON pe.obs_id = dst GROUP BY 1, 2")
def knn_mean_impute(s, d):
    return impute.knn_mean(*_near_and_expr(s, d), 10).withColumn("value", r("value"))


@query(f"""WITH {fx.EXPR}, {fx.EMB}, {PSEUDO_EXPR}, {DOT_NEAR}, m AS (SELECT src AS obs_id, gene, sum(value) / 10 AS b FROM near JOIN pe ON pe.obs_id = dst GROUP BY 1, 2), n AS (SELECT obs_id, gene, value AS a FROM expr WHERE obs_id % 2 = 1)
SELECT coalesce(m.obs_id, n.obs_id) AS obs_id, coalesce(m.gene, n.gene) AS gene, round(0.9 * coalesce(a, 0) + (1 - 0.9) * coalesce(b, 0), 6) AS value FROM m FULL JOIN n ON m.obs_id = n.obs_id AND m.gene = n.gene""")
def blend_with_knn_mean(s, d):
    near, e = _near_and_expr(s, d)
    model = fx.expr(s, d).where("obs_id % 2 = 1")
    return impute.blend(model, impute.knn_mean(near, e, 10), 0.9).withColumn("value", r("value"))


@query(f"""WITH {fx.EXPR}, v AS (SELECT gene, label, sum(value) AS s FROM expr JOIN cells USING (slice, obs_id) GROUP BY 1, 2),
emb AS MATERIALIZED (SELECT gene AS obs_id, list(coalesce(s, 0) ORDER BY label) AS vec FROM (SELECT DISTINCT gene FROM expr) CROSS JOIN (SELECT DISTINCT label FROM cells) LEFT JOIN v USING (gene, label) GROUP BY 1), {_near(5, COS)},
sym AS (SELECT src, dst, max(s) AS w FROM (SELECT src, dst, s FROM near UNION ALL SELECT dst, src, s FROM near) GROUP BY 1, 2),
n AS MATERIALIZED (SELECT src, dst, w / (sum(w) OVER (PARTITION BY src) + 1e-12) AS w FROM sym)
SELECT expr.obs_id, n.src AS gene, round(sum(n.w * value), 6) AS value FROM expr JOIN n ON expr.gene = n.dst GROUP BY 1, 2""")
def feature_neighbor_means(s, d):
    """Each observation's counts averaged over neighbouring features, the graph held as edges; features are near by their totals by label."""
    e = tables.written(fx.expr(s, d), "feature-counts")
    genes = genes_of(e)
    names = [x.gene for x in genes.orderBy("gene_id").collect()]  # the vocabulary of features
    totals = e.join(fx.cells(s, d).select("slice", "obs_id", "label"), ["slice", "obs_id"]).groupBy("gene", "label").agg(F.sum("value").alias("v"))
    labels = fx.cells(s, d).select("label").distinct()
    factors = genes.crossJoin(F.broadcast(labels)).join(totals, ["gene", "label"], "left").groupBy(F.col("gene_id").alias("obs_id"))  # a few labels
    factors = factors.agg(F.array_sort(F.collect_list(F.struct("label", F.coalesce("v", F.lit(0.0)).cast("double").alias("v")))).alias("a")).select("obs_id", F.col("a.v").alias("vec"))
    adj = impute.feature_adjacency(graphs.cosine_graph(factors, 5), len(names), dense_features=0)
    out = impute.feature_means(preprocess.dense_rows(e, genes).select("obs_id", "x"), adj)
    named = F.explode(F.arrays_zip(F.array(*(F.lit(x) for x in names)).alias("gene"), F.col("x").alias("value")))
    return out.select("obs_id", named.alias("z")).where("z.value <> 0").select("obs_id", "z.gene", r("z.value").alias("value"))


@query()
def graph_imputer(s, d):
    """Features are all components of the embeddings; their graph is that of their ridge factors on joint principal components."""
    e = fx.emb(s, d)
    near = graphs.nearest_pseudo(e.where("dom = 1"), e.where("dom = 0"), 8)
    rows = e.where("dom = 0").select("obs_id", F.col("vec").alias("x"))
    tensor = impute.neighbor_tensor(near, rows, 8)
    truth = e.where("dom = 1").select("obs_id", F.col("vec").alias("y"))
    pc = linalg.principal_components(e.select("obs_id", "vec"), 10, vec="vec", out="pc")[0].select("obs_id", F.col("pc").alias("vec"))
    b = impute.ridge_factors(pc, rows)
    adj = impute.dense_adjacency(impute.gene_graph(s, b, b[:0]), len(b))
    model, _ = impute.fit_imputer(tensor, truth, adj, list(range(len(b))), 8)
    return impute.predict_imputer(tensor, model, adj, [f"g{i}" for i in range(len(b))])


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-normalised counts after quality control, with each feature's share of observations that have it."""
    e = preprocess.log1p(preprocess.normalize_total(preprocess.quality_control(fx.expr(spark, sf_dir))))
    n = Window.partitionBy("slice", "gene")
    return e.withColumn("n_obs", F.count("*").over(n))
