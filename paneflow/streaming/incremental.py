"""Captures as a stream: each batch runs the batch operators, and replays change nothing.

An extension: files of captures are the stream. Results are written under the batch's own folder, so a batch that runs
again overwrites itself; sealed ids depend on content alone, so late copies are known by their id.
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def stream_tables(spark: SparkSession, path: str, schema: str, files_per_batch: int = 100) -> DataFrame:
    """A stream of Parquet rows, in bounded batches of files."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def run_batches(stream: DataFrame, out: str, checkpoint: str, work: Callable[[DataFrame], DataFrame], once: bool = True) -> StreamingQuery:
    """``work`` on each micro-batch, written to <out>/batch=<id>."""

    def each(batch: DataFrame, number: int) -> None:
        work(batch).write.mode("overwrite").parquet(os.path.join(out, f"batch={number}"))

    writer = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def distinct_deliveries(stream: DataFrame, keys: list[str], at: str, late: str = "7 days") -> DataFrame:
    """Deliveries of a key count once within the watermark; later repeats are left to the batch operators."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def delivery_counts(stream: DataFrame, at: str = "received_at", window: str = "1 day", late: str | None = "7 days") -> DataFrame:
    """Rows per window of delivery time, with late rows up to the watermark (None: the stream has one already)."""
    marked = stream if late is None else stream.withWatermark(at, late)
    return marked.groupBy(F.window(at, window).alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "n")
