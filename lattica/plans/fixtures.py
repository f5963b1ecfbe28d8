"""Matrices, points, embeddings and compositions derived from the star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.operators import mixture


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def cells(spark: SparkSession, d: str) -> DataFrame:
    """Observations: slice, obs_id, label, x, y."""
    key = F.col("c_custkey")
    c = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return c.select(F.concat(F.lit("s"), F.col("n_regionkey").cast("string")).alias("slice"), key.alias("obs_id"), F.col("c_mktsegment").alias("label"), (key * 7919 % 1000).cast("double").alias("x"), (key * 104729 % 1009).cast("double").alias("y"))


def expr(spark: SparkSession, d: str) -> DataFrame:
    """Counts: slice, obs_id, gene, value."""
    t = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_quantity").join(table(spark, d, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    t = t.join(table(spark, d, "part").select("p_partkey", F.concat_ws("|", "p_brand", "p_type").alias("gene")), F.col("l_partkey") == F.col("p_partkey"))
    s = t.groupBy(F.col("o_custkey").alias("obs_id"), "gene").agg(F.sum("l_quantity").alias("value"))
    return s.join(cells(spark, d).select("slice", "obs_id"), "obs_id").select("slice", "obs_id", "gene", "value")


def emb(spark: SparkSession, d: str) -> DataFrame:
    """Embeddings: obs_id, vec, label, batch (0..2), dom (0, 1)."""
    e = table(spark, d, "embeddings")
    return e.select(F.col("vec_id").alias("obs_id"), F.col("embedding").cast("array<double>").alias("vec"), "label", (F.col("vec_id") % 3).alias("batch"), (F.col("vec_id") % 2).alias("dom"))


def binned(spark: SparkSession, d: str, size: float = 100.0, min_cells: int = 2) -> DataFrame:
    return mixture.bin_cells(cells(spark, d), size, min_cells)


def truth(spark: SparkSession, d: str) -> DataFrame:
    """Compositions of 100 x 100 bins: obs_id (the bin's name), cell_type, value."""
    return mixture.bin_composition(binned(spark, d)).withColumnRenamed("spot", "obs_id")


def estimate(spark: SparkSession, d: str) -> DataFrame:
    """Compositions of the same bins, weighted by counts instead of heads."""
    b = binned(spark, d).select("slice", "obs_id", "spot", "label").join(expr(spark, d), ["slice", "obs_id"])
    s = b.groupBy(F.col("spot").alias("obs_id"), F.col("label").alias("cell_type")).agg(F.sum("value").alias("v"))
    total = s.groupBy("obs_id").agg(F.sum("v").alias("t"))
    return s.join(total, "obs_id").select("obs_id", "cell_type", (F.col("v") / F.col("t")).alias("value"))


def interactions(spark: SparkSession, d: str) -> DataFrame:
    """Feature pairs bought in one order: gene1 < gene2, combined_score = number of orders."""
    t = table(spark, d, "lineitem").select("l_orderkey", "l_partkey").join(table(spark, d, "part").select("p_partkey", F.concat_ws("|", "p_brand", "p_type").alias("gene")), F.col("l_partkey") == F.col("p_partkey"))
    g = t.select("l_orderkey", "gene").distinct()
    a, b = g.withColumnRenamed("gene", "gene1"), g.withColumnRenamed("gene", "gene2")
    return a.join(b, "l_orderkey").where("gene1 < gene2").groupBy("gene1", "gene2").agg(F.count("*").cast("int").alias("combined_score"))


#: The same tables in SQL.
CELLS = """cells AS (SELECT 's' || n_regionkey AS slice, c_custkey AS obs_id, c_mktsegment AS label,
  CAST((c_custkey * 7919) % 1000 AS DOUBLE) AS x, CAST((c_custkey * 104729) % 1009 AS DOUBLE) AS y
  FROM customer JOIN nation ON c_nationkey = n_nationkey)"""
EXPR = CELLS + """,
expr AS (SELECT slice, o_custkey AS obs_id, p_brand || '|' || p_type AS gene, sum(l_quantity) AS value
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey JOIN cells ON o_custkey = obs_id GROUP BY 1, 2, 3)"""
EMB = """emb AS (SELECT vec_id AS obs_id, CAST(embedding AS DOUBLE[]) AS vec, label, vec_id % 3 AS batch, vec_id % 2 AS dom FROM embeddings)"""
BINS = """low AS (SELECT min(x) AS x0, min(y) AS y0 FROM cells),
b0 AS (SELECT cells.*, CAST(floor((x - x0) / 100) AS BIGINT) AS bx, CAST(floor((y - y0) / 100) AS BIGINT) AS by_ FROM cells, low),
bins AS (SELECT *, 'spot_' || bx || '_' || by_ AS spot FROM (SELECT *, count(*) OVER (PARTITION BY bx, by_) AS n_cells FROM b0) WHERE n_cells >= 2)"""
TRUTH = """truth AS (SELECT spot AS obs_id, label AS cell_type, CAST(count(*) AS DOUBLE) / any_value(n_cells) AS value FROM bins GROUP BY 1, 2)"""
ESTIMATE = """e0 AS (SELECT spot AS obs_id, label AS cell_type, sum(value) AS v FROM bins JOIN expr USING (slice, obs_id) GROUP BY 1, 2),
estimate AS (SELECT obs_id, cell_type, v / sum(v) OVER (PARTITION BY obs_id) AS value FROM e0)"""
PAIR = f"""{EXPR}, {BINS}, {TRUTH}, {ESTIMATE},
grid AS (SELECT o.obs_id, t.cell_type FROM (SELECT obs_id FROM truth INTERSECT SELECT obs_id FROM estimate) o,
  (SELECT cell_type FROM truth INTERSECT SELECT cell_type FROM estimate) t),
pair AS (SELECT grid.obs_id, grid.cell_type, coalesce(truth.value, 0) AS p, coalesce(estimate.value, 0) AS q FROM grid
  LEFT JOIN truth ON truth.obs_id = grid.obs_id AND truth.cell_type = grid.cell_type
  LEFT JOIN estimate ON estimate.obs_id = grid.obs_id AND estimate.cell_type = grid.cell_type),
norm AS (SELECT obs_id, cell_type, p / (sum(p) OVER w + 1e-12) AS p, q / (sum(q) OVER w + 1e-12) AS q FROM pair WINDOW w AS (PARTITION BY obs_id))"""
PPI = """g AS (SELECT DISTINCT l_orderkey, p_brand || '|' || p_type AS gene FROM lineitem JOIN part ON l_partkey = p_partkey),
ppi AS (SELECT a.gene AS gene1, b.gene AS gene2, count(*) AS combined_score FROM g a JOIN g b ON a.l_orderkey = b.l_orderkey AND a.gene < b.gene GROUP BY 1, 2),
genes AS (SELECT gene, CAST(row_number() OVER (ORDER BY gene) - 1 AS INTEGER) AS gene_id FROM (SELECT DISTINCT gene FROM g))"""
