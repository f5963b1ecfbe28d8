"""Tables written to the cluster's shared folder, to end a lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def new_path(spark: SparkSession, name: str) -> str:
    """A path for new files in the folder named by spark.checkpoint.dir. Where that is unset, as in tests, a local folder
    serves a local master; on a cluster executors couldn't read each other's files there, so that is an error."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.lattica.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="lattica-")
        spark.conf.set("spark.lattica.dir", at)
    return f"{at.rstrip('/')}/lattica/{name}-{uuid.uuid4().hex}"


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df into the shared folder and read it: lineage ends there. Spark drops the shuffle files of the plan when it is written."""
    spark = df.sparkSession
    path = new_path(spark, name)
    was = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, was)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete the files of tables that `written` made and that no later plan reads."""
    for t in tables:
        jvm = t.sparkSession._jvm
        at = jvm.org.apache.hadoop.fs.Path(t.written_to)
        at.getFileSystem(t.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(at, True)
