"""Session helpers shared by every operator."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, read as declared so that filters and columns reach the scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or one of our own where it is unset and all run on this machine."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        path = spark.sparkContext.getCheckpointDir()
    return path


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: later plans start from files in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder, deleted when the session's JVM ends.

    For results that several branches read: columnar and compressed, so a smaller
    footprint than checkpoint(), and column pruning applies to each reader.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/mapfold-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    return spark.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Deletes a table of written() that no later plan reads."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/mapfold-" not in folder:
            raise ValueError(f"not a table of this session: {folder}")
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let go of shuffle files that no plan refers to any more.

    Spark deletes them when the driver's garbage collector finds their owners gone, which
    on a roomy driver may be long after the stage tables that replace them are written.
    """
    gc.collect()
    spark._jvm.System.gc()
