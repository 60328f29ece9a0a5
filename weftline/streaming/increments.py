"""Incremental loads and counts with Structured Streaming; each runs over what is there and stops."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.sources import graph_xml


def drain(stream: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None]) -> None:
    """Hand every micro-batch of what is available to ``each``, then stop; a restart goes on after the last batch."""
    q = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def append_files(spark: SparkSession, inbox: str, schema: str, key: str, target: str, checkpoint: str) -> None:
    """Append new files' rows to the store ``target``, without keys that it has; a batch given twice adds nothing."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(inbox)

    def add(batch: DataFrame, _: int) -> None:
        new = batch.where(F.col(key).isNotNull()).dropDuplicates([key])
        try:
            new = new.join(spark.read.parquet(target).select(key), key, "left_anti")
        except Exception as e:  # noqa: BLE001 - the first batch finds no store
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER" not in str(e):
                raise
        new.write.mode("append").parquet(target)

    drain(stream, checkpoint, add)


def running_counts(stream: DataFrame, keys: list[str], weight: str) -> DataFrame:
    """Sums of ``weight`` per key, kept over all batches; negative weights take counts back."""
    return stream.groupBy(*keys).agg(F.sum(weight).alias("c"))


def windowed_counts(stream: DataFrame, at: str, width: str, late: str, *keys: str) -> DataFrame:
    """Rows per tumbling window and key; in update mode windows that end ``late`` behind the newest row are closed, and rows for them left out."""
    return stream.withWatermark(at, late).groupBy(F.window(at, width), *keys).agg(F.count(F.lit(1)).alias("n"))


def collect_updates(stream: DataFrame, keys: list[str], folder: str) -> DataFrame:
    """Run an aggregation over what is available and give the latest row of every key.

    Each micro-batch writes the rows that it changed to Parquet below ``folder``, under its number: a batch given again
    after a failure replaces itself. Nothing is collected, and the state holds no more than the watermark allows.
    """
    target = f"{folder}/updates"

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={number}")

    q = stream.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    schema = T.StructType([*stream.schema.fields, T.StructField("batch", T.LongType())])
    rows = stream.sparkSession.read.schema(schema).parquet(target)
    values = [c for c in stream.columns if c not in keys]
    latest = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("x"))
    return latest.select(*keys, "x.*")


def stream_documents(spark: SparkSession, inbox: str, schema: str, key: str, text: str, where: Column | None = None) -> DataFrame:
    """A stream of the flat rows of XML graph documents as they arrive, of those files that ``where`` accepts."""
    files = spark.readStream.schema(schema).parquet(inbox)
    return graph_xml.rows(files if where is None else files.where(where), key, text)
