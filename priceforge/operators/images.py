"""Image embeddings: means, one column per category, presence flags."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from priceforge.functions.columns import IMAGE_TYPES
from priceforge.operators.joins import first_by


def vector_width(df: DataFrame, vector: str = "features") -> int:
    """Longest vector of the column (one number reaches the driver)."""
    return df.agg(F.max(F.size(vector))).first()[0] or 0


def image_mean(
    df: DataFrame,
    keys: Sequence[str] = ("id", "category"),
    vector: str = "features",
    width: int | None = None,
) -> DataFrame:
    """Element-wise mean vector per key, skipping null elements.

    One average per element in a single aggregate: images are combined before the shuffle and
    no vector is exploded into rows.
    """
    width = width or vector_width(df, vector)
    means = df.groupBy(*keys).agg(*[F.avg(F.get(vector, F.lit(i))).alias(f"_m{i}") for i in range(width)])
    return means.select(*keys, F.array(*[f"_m{i}" for i in range(width)]).alias(vector))


def image_wide(
    df: DataFrame,
    categories: Sequence[str] = tuple(IMAGE_TYPES),
    key: str = "id",
    category: str = "category",
    vector: str = "features",
    width: int | None = None,
) -> DataFrame:
    """One row per key, one mean vector per category; null where a key has no such image."""
    means = image_mean(df, (key, category), vector, width)
    return means.groupBy(key).pivot(category, list(categories)).agg(F.first(vector, ignorenulls=True))


def join_images(
    listings: DataFrame,
    wide: DataFrame | None,
    dummies: DataFrame,
    key: str = "id",
    dummy_order: Sequence[str] = (),
) -> DataFrame:
    """Listings with image vectors, image-category dummies and ``has_img``.

    Of several dummy rows with one key the first under ``dummy_order`` counts (default: by value).
    """
    dummy_cols = [c for c in dummies.columns if c != key and c not in dummy_order]
    unique = first_by(dummies, [key], list(dummy_order) or dummy_cols, keep=dummy_cols)
    joined = listings if wide is None else listings.join(wide, key, "left")
    joined = joined.join(unique, key, "left")
    return joined.withColumn("has_img", F.coalesce(F.col("img_cat_kitchen") == 1, F.lit(False)))


def train_population(df: DataFrame) -> DataFrame:
    """Rows with images that are not outliers."""
    return df.where(~F.col("outlier") & F.col("has_img"))
