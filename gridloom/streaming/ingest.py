"""Checking raster files as they arrive in a folder (an extension; a stream of file headers)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from gridloom.operators import headers, validate


def validate_arrivals(spark: SparkSession, folder: str, target: str, checkpoint: str, strict: bool = False) -> StreamingQuery:
    """Append the verdict on every new file of a folder to a Parquet table; stops when none is left."""
    schema = spark.read.format("binaryFile").load(folder).schema
    arrivals = spark.readStream.format("binaryFile").schema(schema).load(folder).select("path")

    def check(batch: DataFrame, _: int) -> None:
        paths = [r["path"] for r in batch.collect()]  # the names of one micro-batch
        if paths:
            validate.validate_files(headers.read_headers(spark, paths), strict).write.mode("append").parquet(target)

    return arrivals.writeStream.foreachBatch(check).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
