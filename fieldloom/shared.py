"""Written tables, in a folder that the driver and all executors see."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """Where tables may be written for later reads.

    The folder that the cluster names in spark.checkpoint.dir; else the one that the application gave to
    setCheckpointDir(); else a folder in the warehouse, where that is no local disk. Only a session whose master is
    local, as in tests, gets a folder of its own. A cluster that shares none of these is an error.
    """
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if named:
        return named.rstrip("/")
    warehouse = spark.conf.get("spark.sql.warehouse.dir", "") or ""
    if ":" in warehouse and not warehouse.startswith("file:"):
        return warehouse.rstrip("/") + "/_fieldloom"
    if not context._jsc.sc().isLocal():
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share; written tables go there")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="fieldloom-"))
    return context.getCheckpointDir().rstrip("/")


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.saved_path = path
    return out


def again(df: DataFrame) -> DataFrame:
    """Another read of a table made by saved(): the two sides of a cogroup need distinct ones."""
    return df.sparkSession.read.schema(df.schema).parquet(df.saved_path)


def forget(df: DataFrame) -> None:
    """Delete a table made by saved() that no plan will read again."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.saved_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
