"""Points as a stream: deliveries once, windowed counts, and scheduled incremental runs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from orebody.functions.columns import source_category
from orebody.sources.settings import interval_seconds


def point_stream(spark: SparkSession, folder: str, schema: StructType, files_per_batch: int = 64) -> DataFrame:
    """New Parquet files of a folder as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def deliveries(stream: DataFrame, late: str = "7 days") -> DataFrame:
    """Each (id, seq) once. Repeats that come later than ``late`` behind the watermark pass; state is bounded by it."""
    return stream.where("arrived_at is not null").withWatermark("arrived_at", late).dropDuplicatesWithinWatermark(["id", "seq"])


def arrivals(stream: DataFrame, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """``(start, source, n)``: deliveries per window of arrival; windows close ``late`` behind the newest row."""
    counted = stream.withWatermark("arrived_at", late).groupBy(F.window("arrived_at", width), source_category().alias("source")).agg(F.count("*").alias("n"))
    return counted.select(F.col("window.start").alias("start"), "source", "n")


def run_on(stream: DataFrame, work: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, every: str = "") -> StreamingQuery:
    """Output of ``work`` for each micro-batch, each in a folder of its own, so that a batch that is run again replaces itself.

    Without ``every`` all that is there is taken and the query ends.
    """

    def write(batch: DataFrame, number: int) -> None:
        work(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    trigger = {"processingTime": f"{interval_seconds(every)} seconds"} if every else {"availableNow": True}
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**trigger).start()
