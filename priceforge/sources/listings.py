"""Readers of listings, districts, images and id lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from priceforge.operators.clean import RENAMES

# Name and type of the known columns of the listings file.
LISTING_COLUMNS = {
    "id": "bigint",
    "price": "double",
    "area_m2": "double",
    "transaction_type": "string",
    "estate": "string",
    "date_created": "string",
    "date_created_first": "string",
    "pushed_up_at": "string",
    "location.district": "string",
    "location.neighborhood": "string",
    "location.name": "string",
    "location.number": "string",
    "location.latitude": "double",
    "location.longitude": "double",
    "floor_number": "string",
    "building_floors_num": "double",
    "building_year": "double",
    "rooms_number": "string",
    "heating": "string",
    "building_type": "string",
    "building_material": "string",
    "is_private_owner": "boolean",
    "advertiser_type": "string",
    "windows_type": "string",
    "construction_status": "string",
    "building_ownership": "string",
}
STRAY_INDEX = "Unnamed: 0"

# Starts of column names and their type.
TYPED_STARTS = {"dist_": "double", "count_": "int", "has_": "int", "pano_": "double", "park_areas_": "double", "play_areas_": "double", "vector_": "double"}


def _type_of(name: str) -> str:
    if name in LISTING_COLUMNS:
        return LISTING_COLUMNS[name]
    return next((kind for start, kind in TYPED_STARTS.items() if name.startswith(start)), "string")


def _header(spark: SparkSession, path: str) -> list[str]:
    """Column names from the first line; no value is read to guess types."""
    return spark.read.option("header", True).csv(path, enforceSchema=False, escape='"').columns


def _ddl(kinds: dict[str, str]) -> str:
    return ", ".join(f"`{name}` {kind}" for name, kind in kinds.items())


def _clean_nan(df: DataFrame) -> DataFrame:
    """NaN to null, the only missing value from here on."""
    real = [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.when(~F.isnan(F.col(f"`{c}`")), F.col(f"`{c}`")) for c in real})


def read_listings(spark: SparkSession, path: str, types: dict[str, str] | None = None) -> DataFrame:
    """Listings CSV with an explicit schema and dotted location names shortened.

    ``types`` adds or overrides column types. The stray index column is dropped. ``src_seq`` orders the rows by
    file name and place in the file, for keep-first deduplication. A file whose header differs from that of the
    first one is an error.
    """
    types = types or {}
    kinds = {name: types.get(name, _type_of(name)) for name in _header(spark, path)}
    kinds = {name: "string" if kind == "boolean" else kind for name, kind in kinds.items()}
    df = spark.read.schema(_ddl(kinds)).csv(path, header=True, enforceSchema=False, nanValue="NaN", escape='"')
    # Numbers of rows rise within a split; splits of a file begin one behind the other.
    order = F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("row"),
    )
    df = df.select(*[F.col(f"`{c}`").alias(RENAMES.get(c, c)) for c in df.columns], order.alias("src_seq"))
    flags = [RENAMES.get(c, c) for c, k in (LISTING_COLUMNS | types).items() if k == "boolean"]
    df = df.withColumns({c: F.lower(F.col(c)).isin("true", "1") for c in flags if c in df.columns})
    return _clean_nan(df.drop(STRAY_INDEX))


def read_districts(spark: SparkSession, path: str) -> DataFrame:
    """District CSV: ``district`` and numeric ``pano_*`` columns."""
    kinds = {name: "string" if name == "district" else "double" for name in _header(spark, path)}
    return _clean_nan(spark.read.schema(_ddl(kinds)).csv(path, header=True, escape='"'))


def read_image_means(spark: SparkSession, path: str, kind: str = "category") -> DataFrame:
    """Image vectors as (id, category, features) from Parquet.

    ``kind`` is 'all' (class column ``classification``) or 'category' (``category_name``). The
    ``feature_<n>`` columns become one array.
    """
    column = {"all": "classification", "category": "category_name"}[kind]
    df = spark.read.parquet(path)
    cells = sorted((c for c in df.columns if c.startswith("feature_")), key=lambda c: int(c.split("_")[1]))
    if not cells:
        raise ValueError(f"no feature columns in {path}")
    return df.select("id", F.col(column).alias("category"), F.array(*[F.col(c).cast("double") for c in cells]).alias("features"))


def read_image_dummies(spark: SparkSession, path: str) -> DataFrame:
    """Image-category dummies: ``id`` and int ``img_cat_*`` columns."""
    names = _header(spark, path)
    df = spark.read.schema(_ddl({name: "bigint" if name == "id" else "double" for name in names})).csv(path, header=True, escape='"')
    kept: Sequence[str] = [c for c in names if c.startswith("img_cat_")]
    return df.select("id", *[F.col(c).cast("int").alias(c) for c in kept])


def read_exclusions(spark: SparkSession, path: str) -> DataFrame:
    """One integer id per line; blank lines are skipped, other text fails."""
    lines = spark.read.text(path).select(F.trim("value").alias("id")).where(F.col("id") != "")
    return lines.select(F.col("id").cast("bigint").alias("id"))
