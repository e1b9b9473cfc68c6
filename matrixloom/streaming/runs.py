"""Benchmark logs as a stream: new files of a folder are parsed and averaged as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matrixloom.plans.report import KEYS
from matrixloom.sources import benchlog


def stream_runs(spark: SparkSession, folder: str, prefix: str = "", recode: dict[str, str] | None = None, files_a_batch: int = 100) -> DataFrame:
    lines = spark.readStream.option("maxFilesPerTrigger", files_a_batch).text(folder)
    return benchlog.parse(lines, prefix, recode)


def stream_averages(runs: DataFrame) -> DataFrame:
    """Means by KEYS; the state is a row for each key. Write it in update or complete mode."""
    return runs.groupBy(*KEYS).agg(F.avg("gflops").alias("gflops"), F.count(F.lit(1)).alias("repeats"))
