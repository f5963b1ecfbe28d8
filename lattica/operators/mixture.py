"""Synthetic observations: grid binning of single cells and drawn pseudo-spots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.functions.columns import small


def bin_cells(obs: DataFrame, bin_size: float = 200.0, min_cells: int = 2, label: str = "label") -> DataFrame:
    """obs with bin columns (bx, by) and spot (`spot_bx_by`), only in bins of min_cells labelled cells at least. The
    grid starts at the least coordinates; a null label is no cell."""
    cells = obs.where(F.col(label).isNotNull())
    low = cells.agg(F.min("x").alias("x0"), F.min("y").alias("y0"))
    b = cells.crossJoin(F.broadcast(low))  # one row
    b = b.withColumns({"bx": F.floor((F.col("x") - F.col("x0")) / bin_size).cast("long"), "by": F.floor((F.col("y") - F.col("y0")) / bin_size).cast("long")}).drop("x0", "y0")
    keep = b.groupBy("bx", "by").agg(F.count("*").alias("n_cells")).where(F.col("n_cells") >= min_cells)
    return b.join(keep, ["bx", "by"]).withColumn("spot", F.concat_ws("_", F.lit("spot"), F.col("bx").cast("string"), F.col("by").cast("string")))


def bin_composition(binned: DataFrame, label: str = "label") -> DataFrame:
    """(spot, cell_type, value): shares of the labels that a bin has."""
    n = binned.groupBy("spot", F.col(label).alias("cell_type")).agg(F.count("*").alias("n"), F.first("n_cells").alias("n_cells"))
    return n.select("spot", "cell_type", (F.col("n") / F.col("n_cells")).alias("value"))


def bin_spots(binned: DataFrame) -> DataFrame:
    """(spot, x, y, n_cells): mean coordinates."""
    return binned.groupBy("spot").agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.count("*").alias("n_cells"))


def bin_expression(binned: DataFrame, expr: DataFrame) -> DataFrame:
    """(spot, gene, value): summed counts of a bin's cells."""
    return binned.select("slice", "obs_id", "spot").join(expr, ["slice", "obs_id"]).groupBy("spot", "gene").agg(F.sum("value").alias("value"))


def mixed(*parts: Column | int) -> Column:
    """A non-negative pseudo-random integer that depends on the parts alone, so draws don't depend on partitioning."""
    return F.pmod(F.xxhash64(*(p if isinstance(p, Column) else F.lit(p) for p in parts)), F.lit(1 << 40))


def arithmetic(*parts: Column | int) -> Column:
    """A weak draw that SQL engines share: for checked queries."""
    primes = (7919, 104729, 1299709, 15485863)
    out = F.lit(0).cast("long")
    for p, x in zip(primes, parts, strict=False):
        out = out + F.lit(p).cast("long") * (x.cast("long") if isinstance(x, Column) else F.lit(x).cast("long"))
    return out


def draw_cells(cells: DataFrame, spots: int, low: int = 2, high: int = 15, max_types: int = 3, method: str = "celltype", seed: int = 0, label: str = "label", mix=mixed) -> DataFrame:
    """(spot, draw, obs_id, label): the cells of each pseudo-spot. Each has low..high draws with replacement.

    method `cell`: any labelled cell. `celltype`: 1..max_types different labels (all, if there are fewer), a label
    for each draw, then a cell within the label. cells: obs_id and the label; null labels are left out."""
    if method not in ("cell", "celltype"):
        raise ValueError(f"unknown method {method!r}")
    own = cells.where(F.col(label).isNotNull()).select("obs_id", F.col(label).alias("label"))
    spark = cells.sparkSession
    n = F.lit(low) + F.pmod(mix(F.col("spot"), F.lit(seed)), F.lit(high - low + 1))
    draws = spark.range(spots).withColumnRenamed("id", "spot").withColumn("draw", F.explode(F.sequence(F.lit(1).cast("long"), n.cast("long"))))
    # a cell's number within its label: numbered by label and drawn bucket, so that no task numbers a whole label
    bucket = F.pmod(mix(F.col("obs_id")), F.lit(64)).cast("int")
    own = own.withColumn("bucket", bucket)
    group = ["label", "bucket"]
    sizes = own.groupBy(*group).agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("label").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.withColumn("before", before).drop("n")
    numbered = own.join(small(starts), group).withColumn("rn", F.row_number().over(Window.partitionBy(*group).orderBy("obs_id")) + F.col("before"))
    labels = own.groupBy("label").agg(F.count("*").alias("size"))
    labels = labels.withColumn("k", F.row_number().over(Window.orderBy("label")) - 1)
    if method == "cell":
        upto = F.coalesce(F.sum("size").over(Window.orderBy("k").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        offset = labels.withColumn("offset", upto)
        total = labels.agg(F.sum("size").alias("total"))
        pick = draws.crossJoin(F.broadcast(total)).withColumn("pick", F.pmod(mix(F.col("spot"), F.col("draw"), F.lit(seed + 1)), F.col("total")) + 1)
        placed = numbered.join(small(offset), "label").withColumn("pick", F.col("rn") + F.col("offset"))
        return pick.join(placed, "pick").select("spot", "draw", "obs_id", "label")
    every = labels.agg(F.array_sort(F.collect_list(F.struct("k", "label", "size"))).alias("labels"))  # labels are few
    d = draws.crossJoin(F.broadcast(every))
    t = F.least(F.size("labels"), F.lit(1) + F.pmod(mix(F.col("spot"), F.lit(seed + 2)), F.lit(max_types))).cast("int")
    order = F.transform(F.col("labels"), lambda s: F.struct(mix(F.col("spot"), s["k"], F.lit(seed + 3)).alias("h"), s["k"].alias("k"), s["label"].alias("label"), s["size"].alias("size")))
    chosen = F.slice(F.array_sort(order), 1, t)
    d = d.select("spot", "draw", F.get(chosen, F.pmod(mix(F.col("spot"), F.col("draw"), F.lit(seed + 4)), t).cast("int")).alias("s"))
    d = d.select("spot", "draw", F.col("s.label").alias("label"), (F.pmod(mix(F.col("spot"), F.col("draw"), F.lit(seed + 5)), F.col("s.size")) + 1).alias("rn"))
    return d.join(numbered.select("label", "rn", "obs_id"), ["label", "rn"]).select("spot", "draw", "obs_id", "label")


def pseudo_counts(draws: DataFrame, expr: DataFrame) -> DataFrame:
    """(spot, gene, value): summed raw counts of the drawn cells."""
    return draws.select("spot", "obs_id").join(expr.select("obs_id", "gene", "value"), "obs_id").groupBy("spot", "gene").agg(F.sum("value").alias("value"))


def pseudo_fractions(draws: DataFrame) -> DataFrame:
    """(spot, cell_type, value, cell_num): the share of each label among a spot's draws."""
    n = draws.groupBy("spot", F.col("label").alias("cell_type")).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy("spot"))
    return n.select("spot", "cell_type", (F.col("n") / total).alias("value"), total.alias("cell_num"))
