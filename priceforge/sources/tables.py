"""Parquet tables between the stages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).parquet(path)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_split(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One table for features, target and images of both parts, partitioned by ``split``."""
    df.write.mode(mode).partitionBy("split").parquet(path)


def read_split(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """The split table, or one part of it; the other part's files are not read."""
    df = spark.read.parquet(path)
    return df if split is None else df.where(F.col("split") == split)


def export_columns(df: DataFrame, columns: Sequence[str], path: str, mode: str = "errorifexists") -> None:
    """CSV of chosen columns."""
    df.select(*columns).write.mode(mode).csv(path, header=True, escape='"')
