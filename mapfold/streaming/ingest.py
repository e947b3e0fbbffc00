"""Patch predictions as they arrive: the batch functions over a file stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mapfold.functions import geometry as G


def patch_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    """A folder of Parquet files as a stream."""
    return spark.readStream.schema(schema).parquet(path)


def stitched(patches: DataFrame) -> DataFrame:
    """GEO1 is stateless, so it takes streams too. patches: map_id, patch_row, patch_col (offsets), x, y."""
    x, y = G.shift(F.col("x"), F.col("y"), F.col("patch_col"), F.col("patch_row"))
    return patches.withColumns({"x": x, "y": y})


def completeness(patches: DataFrame) -> DataFrame:
    """Running number of patches of each map, which is that of one sheet at most (TIL6)."""
    return patches.groupBy("map_id").agg(F.size(F.collect_set(F.struct("patch_row", "patch_col"))).cast("long").alias("patches"), F.count("*").alias("detections"))


def drain(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Everything there is now, then stop; what was read is remembered at the checkpoint."""
    q = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).format("parquet").start(path)
    q.awaitTermination()


def count_patches(stream: DataFrame, path: str, checkpoint: str) -> None:
    """The patches of each map so far, kept across triggers and restarts (TIL6).

    The state of a map is the set of its patches, one sheet's at most, so late and repeated
    patches count once. Every batch writes the maps that it changed under its own number: a
    batch that is replayed after a loss writes the same rows to the same place.
    """

    def write(changed: DataFrame, batch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    q = completeness(stream).writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()
    q.awaitTermination()


def complete_maps(spark: SparkSession, path: str, expected: DataFrame) -> DataFrame:
    """(map_id, patches, expected, complete): the last count of every map of expected (map_id, expected), 0 before its first patch."""
    seen = spark.read.option("basePath", path).parquet(f"{path}/batch=*").groupBy("map_id").agg(F.max_by("patches", "batch").alias("patches"))
    out = expected.join(seen, "map_id", "left").withColumn("patches", F.coalesce("patches", F.lit(0).cast("long")))
    return out.select("map_id", "patches", "expected", (F.col("patches") == F.col("expected")).alias("complete"))
