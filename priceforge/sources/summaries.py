"""Run summaries as CSV and nested JSON."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from priceforge.operators.runs import nested_report, run_distincts

MAPS = ("params", "tags", "metrics")


def write_summary(summary: DataFrame, path: str) -> None:
    """CSV of the flat summary columns."""
    summary.drop(*MAPS).write.mode("overwrite").csv(path, header=True, escape='"')


def write_report(summary: DataFrame, path: str, metric: str = "test_score") -> None:
    """Nested JSON: one record per best run under ``runs``, overall counts under ``overview``."""
    nested_report(summary).write.mode("overwrite").json(f"{path}/runs")
    overview = run_distincts(summary).withColumn("optimization_metric", F.lit(metric))
    overview.coalesce(1).write.mode("overwrite").json(f"{path}/overview")


def read_summaries(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """All rows of several summary CSV files, matched by column name.

    A path may be a folder. Files may differ in order and choice of columns, so each is read by its own
    header; only their names reach the driver.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    files = spark.read.format("binaryFile").load(paths).where("length > 0").select("path").orderBy("path")
    parts = [spark.read.csv(p, header=True, escape='"') for p in [r.path for r in files.collect()] or paths]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
