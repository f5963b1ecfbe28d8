"""Readers and writers of the long-format bundle.

A bundle's folder holds expr, obs and optionally var as Parquet; expr is partitioned by slice, so a scan of
some slices prunes the others."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lattica.model import Bundle, require

PPI_SCHEMA = "gene1 STRING, gene2 STRING, combined_score INT"


def unique_names(df: DataFrame, name: str, position: str, by: tuple[str, ...] = ("slice",)) -> DataFrame:
    """Repeated names get the suffixes -1, -2, ... in order of position; the first keeps its name."""
    n = F.row_number().over(Window.partitionBy(*by, name).orderBy(position)) - 1
    return df.withColumn(name, F.when(n == 0, F.col(name)).otherwise(F.concat_ws("-", name, n.cast("string"))))


def read_bundle(spark: SparkSession, path: str, slices: list[str] | None = None) -> Bundle:
    expr, obs = spark.read.parquet(f"{path}/expr"), spark.read.parquet(f"{path}/obs")
    if slices:
        expr, obs = expr.where(F.col("slice").isin(slices)), obs.where(F.col("slice").isin(slices))
    return Bundle(require(expr, "expr"), require(obs, "obs"))


def load_slices(spark: SparkSession, paths: dict[str, str]) -> Bundle:
    """Several bundles, each under its own slice name."""
    parts = [(name, read_bundle(spark, p)) for name, p in paths.items()]
    if not parts:
        raise ValueError("no slice is given")
    expr, obs = None, None
    for name, b in parts:
        e, o = b.expr.withColumn("slice", F.lit(name)), b.obs.withColumn("slice", F.lit(name))
        expr = e if expr is None else expr.unionByName(e)
        obs = o if obs is None else obs.unionByName(o, allowMissingColumns=True)
    return Bundle(expr, obs)


def drop_unlabelled(bundle: Bundle, domain: str) -> Bundle:
    """Without the observations whose domain is null; to be applied after feature selection."""
    keep = bundle.obs.where(F.col(domain).isNotNull())
    ids = keep.select("slice", "obs_id")
    return Bundle(bundle.expr.join(ids, ["slice", "obs_id"], "left_semi"), keep, bundle.var)


def label_dictionary(obs: DataFrame, label: str = "label") -> DataFrame:
    """(code, word): the labels in natural order from code 0; null is no label. Labels are few: distinct comes first."""
    words = obs.where(F.col(label).isNotNull()).select(F.col(label).alias("word")).distinct()
    return words.select((F.dense_rank().over(Window.orderBy("word")) - 1).cast("int").alias("code"), "word")


def read_interactions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PPI_SCHEMA).csv(path, header=True)


def write_table(df: DataFrame, path: str, by: str | None = None) -> None:
    w = df.write.mode("errorifexists")
    (w.partitionBy(by) if by else w).parquet(path)
