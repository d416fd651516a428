"""Overlap and composition of feature sets (set_name, selected_features)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from priceforge.functions.columns import feature_category
from priceforge.operators.joins import with_row


def members(feature_sets: DataFrame) -> DataFrame:
    """One row per set and feature."""
    return feature_sets.select("set_name", F.explode("selected_features").alias("feature"))


def feature_matrix(members: DataFrame, sets: Sequence[str]) -> DataFrame:
    """Feature by set, 1 if the set has the feature. ``sets`` fixes the columns."""
    wide = members.groupBy("feature").pivot("set_name", list(sets)).agg(F.max(F.lit(1)))
    return wide.fillna(0, subset=list(sets))


def _usage(members: DataFrame) -> DataFrame:
    return members.groupBy("feature").agg(F.count_distinct("set_name").alias("n_sets"))


def feature_usage(members: DataFrame) -> DataFrame:
    """One row: features in all sets, in one, and in two or three."""
    total = members.agg(F.count_distinct("set_name").alias("n"))
    usage = with_row(_usage(members), total, "_all").withColumn("_total", F.col("_all.n"))
    return usage.agg(
        F.count(F.lit(1)).alias("n_features"),
        F.count_if(F.col("n_sets") == F.col("_total")).alias("in_all"),
        F.count_if(F.col("n_sets") == 1).alias("in_one"),
        F.count_if(F.col("n_sets").between(2, 3)).alias("in_two_or_three"),
    )


def feature_unique(members: DataFrame) -> DataFrame:
    """(set_name, feature) of the features found in one set only."""
    only = members.groupBy("feature").agg(F.min("set_name").alias("set_name"), F.max("set_name").alias("_last"))
    return only.where(F.col("set_name") == F.col("_last")).select("set_name", "feature")


def feature_union(members: DataFrame) -> DataFrame:
    return members.select("feature").distinct().orderBy("feature")


def feature_set_diff(members: DataFrame, left: str, right: str) -> DataFrame:
    """(feature, side) over two sets: left, right or both."""
    pair = members.where(F.col("set_name").isin(left, right))
    sides = pair.groupBy("feature").agg(
        F.max(F.col("set_name") == left).alias("_l"), F.max(F.col("set_name") == right).alias("_r")
    )
    side = F.when(F.col("_l") & F.col("_r"), "both").when(F.col("_l"), "left").otherwise("right")
    return sides.select("feature", side.alias("side"))


def category_usage(members: DataFrame, sets: Sequence[str]) -> DataFrame:
    """Features per category and set, one column per set."""
    tagged = members.withColumn("category", feature_category(F.col("feature")))
    wide = tagged.groupBy("category").pivot("set_name", list(sets)).agg(F.count(F.lit(1)))
    return wide.fillna(0, subset=list(sets))


def category_usage_norm(usage: DataFrame, sets: Sequence[str]) -> DataFrame:
    """Every row divided by its largest count; rows of zeros become null."""
    top = F.greatest(*[F.col(f"`{s}`") for s in sets])
    return usage.select(
        "category", *[F.try_divide(F.col(f"`{s}`").cast("double"), top).alias(s) for s in sets]
    )
