"""Extracted vectors of a run, kept between the steps of a job."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orebody.operators.sampling import random_sample
from orebody.workspace import remove, shared_dir


class RunBatches:
    """Batches of one run as Parquet below the shared folder; a batch stored again replaces itself."""

    def __init__(self, spark: SparkSession, run_id: str, root: str | None = None):
        self.spark, self.path = spark, f"{root or shared_dir(spark)}/batches/{run_id}"

    def store(self, batch: int, df: DataFrame) -> None:
        df.write.mode("overwrite").parquet(f"{self.path}/batch={batch}")

    def load(self) -> DataFrame:
        return self.spark.read.parquet(self.path)

    def sample(self, size: int, seed: int = 42) -> DataFrame:
        """The rows with the smallest hashes; all if there aren't more."""
        return random_sample(self.load(), size, seed)

    def total(self) -> int:
        return self.load().agg(F.count("*")).first()[0]

    def delete(self) -> None:
        remove(self.spark, self.path)
