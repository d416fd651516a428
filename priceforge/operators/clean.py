"""Cleaning and feature engineering of listings."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from priceforge.functions.columns import normalise_names, select_columns
from priceforge.functions.text import clean_text_columns
from priceforge.operators.joins import first_by, lookup_join, with_row
from priceforge.operators.quality import constant_names
from priceforge.operators.quantiles import exact_quantiles, name_of
from priceforge.session import materialize

# Ordinal of each floor label.
FLOORS = {
    "CELLAR": -1,
    "GROUND": 0,
    "FIRST": 1,
    "SECOND": 2,
    "THIRD": 3,
    "FOURTH": 4,
    "FIFTH": 5,
    "SIXTH": 6,
    "SEVENTH": 7,
    "EIGHTH": 8,
    "NINTH": 9,
    "TENTH": 10,
    "ABOVE_TENTH": 11,
    "GARRET": 12,
}

# Source names and their short forms.
RENAMES = {
    "location.district": "district",
    "location.latitude": "latitude",
    "location.longitude": "longitude",
    "location.neighborhood": "neighborhood",
    "location.name": "street_name",
    "location.number": "street_number",
}

# Limits, city centre, kilometres per degree, room count of "MORE".
MIN_PRICE_PER_M2 = 2000
MIN_AREA_M2 = 10
BUILDING_YEARS = (1800, 2028)
CITY_CENTER = (52.2318543, 21.0028622)
KM_PER_DEGREE = 111
MORE_ROOMS = 11

# Frequent values kept per category, fence width, fenced columns (True: log scale).
TOP_VALUES = {"heating": 4, "building_type": 3, "building_material": 6}
OTHER = "OTHER"
FENCE = 1.5
FENCED = {
    "area_m2": False,
    "price": True,
    "building_floors_num": False,
    "price_per_m2": True,
    "room_size_m2": False,
}

# Columns removed on the way.
FILTER_COLUMNS = ["estate", "transaction_type", "date_created", "date_created_first", "pushed_up_at", "count", "geometry"]
REDUNDANT = ["park_areas_2000_m2", "park_areas_1000_m2"]
FINAL_DROPS = ["street_name", "street_number", "building_year", "price_per_m2", "latitude", "longitude"]


def price_per_m2(df: DataFrame) -> DataFrame:
    return df.withColumn("price_per_m2", F.try_divide("price", "area_m2"))


def parse_dates(df: DataFrame, strict: Sequence[str] = (), lenient: Sequence[str] = ()) -> DataFrame:
    """Parse timestamps: ``strict`` columns fail on bad text, ``lenient`` ones become null."""
    parsed = {c: F.to_timestamp_ntz(F.col(f"`{c}`")) for c in strict}
    parsed |= {c: F.col(f"`{c}`").try_cast("timestamp_ntz") for c in lenient}
    return df.withColumns(parsed)


def market_filter(
    df: DataFrame,
    transaction: str = "SELL",
    estate: str = "FLAT",
    min_price_per_m2: float = MIN_PRICE_PER_M2,
    min_area_m2: float = MIN_AREA_M2,
) -> DataFrame:
    """Listings of one market above the price and area floors; unknown values are dropped."""
    return df.where(
        (F.col("transaction_type") == transaction)
        & (F.col("estate") == estate)
        & (F.col("price_per_m2") > min_price_per_m2)
        & (F.col("area_m2") >= min_area_m2)
    )


def district_table(panorama: DataFrame) -> DataFrame:
    """District features with nulls as 0 and the share of women; no people, no share."""
    numeric = [c for c in panorama.columns if c != "district"]
    filled = panorama.fillna(0, subset=numeric)
    return filled.withColumn(
        "pano_share_pop_females", F.try_divide(F.col("pano_pop_females").cast("double"), "pano_pop_total")
    )


def enrich_districts(df: DataFrame, panorama: DataFrame, key: str = "id") -> DataFrame:
    """Left join of listings to their district's features."""
    return lookup_join(df, district_table(panorama), ["district"], salt_by=[key])


def floor_ordinal(label: Column) -> Column:
    """Ordinal of a floor label, null if unknown."""
    table = F.create_map(*[F.lit(x) for pair in FLOORS.items() for x in pair])
    return F.try_element_at(table, label)


def within(value: Column, low: float, high: float) -> Column:
    """The value, or null outside [low, high]."""
    return F.when(value.between(low, high), value)


def distance_km(lat: Column, lon: Column, center: tuple[float, float] = CITY_CENTER) -> Column:
    """Planar distance to a centre in degrees times a fixed length."""
    return F.sqrt(F.pow(lat - center[0], 2) + F.pow(lon - center[1], 2)) * KM_PER_DEGREE


def derive_features(df: DataFrame, as_of_year: int, center: tuple[float, float] = CITY_CENTER) -> DataFrame:
    """Numeric features of a listing. A zero divisor gives null."""
    rooms = F.when(F.col("rooms_number") == "MORE", str(MORE_ROOMS)).otherwise(F.col("rooms_number"))
    year = within(F.col("building_year"), *BUILDING_YEARS)
    floor = floor_ordinal(F.col("floor_number"))
    return df.withColumns(
        {
            "floor_number": floor,
            "building_year": year,
            "building_age": F.lit(as_of_year) - year,
            "distance_to_center_km": distance_km(F.col("latitude"), F.col("longitude"), center),
            "rooms_number": rooms.try_cast("int"),
            "room_size_m2": F.try_divide("area_m2", rooms.try_cast("double")),
            "floor_ratio": F.try_divide(floor.cast("double"), F.col("building_floors_num").cast("double")),
            "building_material": F.when(F.col("building_material") == "[]", "MISSING").otherwise(
                F.col("building_material")
            ),
            "is_private_owner": F.col("is_private_owner").cast("int"),
        }
    )


def value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, value, n) for all columns in one pass; nulls are not counted."""
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("value")) for c in columns])
    return (
        df.select(F.inline(cells))
        .where(F.col("value").isNotNull())
        .groupBy("column", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def top_values(df: DataFrame, sizes: Mapping[str, int]) -> DataFrame:
    """The most frequent values of each column; equal counts rank by value.

    At most ``sum(sizes)`` rows.
    """
    limit = F.create_map(*[F.lit(x) for pair in sizes.items() for x in pair])[F.col("column")]
    order = Window.partitionBy("column").orderBy(F.desc("n"), F.asc("value"))
    ranked = value_counts(df, list(sizes)).withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= max(sizes.values())).where(F.col("rank") <= limit)


def bucket_top_k(df: DataFrame, sizes: Mapping[str, int] = TOP_VALUES, other: str = OTHER) -> DataFrame:
    """Replace every value outside a column's most frequent ones, and null, by ``other``."""
    kept = top_values(df, sizes).agg(
        *[F.collect_list(F.when(F.col("column") == c, F.col("value"))).alias(c) for c in sizes]
    )
    row = with_row(df, kept, "_kept")
    bucketed = {
        c: F.when(F.array_contains(F.col("_kept").getField(c), F.col(c)), F.col(c)).otherwise(other)
        for c in sizes
    }
    return row.withColumns(bucketed).drop("_kept")


def excluded_values(df: DataFrame, sizes: Mapping[str, int] = TOP_VALUES) -> DataFrame:
    """(column, value, n) of the values that ``bucket_top_k`` replaces."""
    kept = F.broadcast(top_values(df, sizes).select("column", "value"))
    return value_counts(df, list(sizes)).join(kept, ["column", "value"], "left_anti")


def fences(df: DataFrame, columns: Mapping[str, bool] = FENCED, width: float = FENCE) -> DataFrame:
    """One row with ``<column>_low`` and ``<column>_high``: quartiles plus/minus ``width`` ranges."""
    scaled = {c: F.log(F.col(c)) if logged else F.col(c) for c, logged in columns.items()}
    quartiles = exact_quantiles(df, scaled, [0.25, 0.75])
    limits = []
    for c in columns:
        q1, q3 = F.col(name_of(c, 0.25)), F.col(name_of(c, 0.75))
        limits += [(q1 - width * (q3 - q1)).alias(f"{c}_low"), (q3 + width * (q3 - q1)).alias(f"{c}_high")]
    return quartiles.select(*limits)


def flag_outliers(df: DataFrame, columns: Mapping[str, bool] = FENCED, width: float = FENCE) -> DataFrame:
    """``outlier``: any column beyond its fence. Unknown values breach no fence."""
    breach = F.lit(False)
    for c, logged in columns.items():
        value = F.log(F.col(c)) if logged else F.col(c)
        low, high = F.col("_fence").getField(f"{c}_low"), F.col("_fence").getField(f"{c}_high")
        breach = breach | F.coalesce((value < low) | (value > high), F.lit(False))
    return with_row(df, fences(df, columns, width), "_fence").withColumn("outlier", breach).drop("_fence")


def drop_excluded(df: DataFrame, ids: DataFrame, strict: bool = False, key: str = "id") -> DataFrame:
    """Rows whose key is not in ``ids``; ``strict`` fails if an id does not occur in ``df``."""
    if strict:
        missing = ids.join(df.select(key), key, "left_anti")
        if not missing.isEmpty():
            raise ValueError(f"ids to exclude are not in the table, e.g. {missing.first()[key]}")
    return df.join(ids, key, "left_anti")


def clean_listings(
    raw: DataFrame,
    panorama: DataFrame,
    excluded: DataFrame,
    as_of_year: int,
    strict_excluded: DataFrame | None = None,
    order: Sequence[str] = ("src_seq",),
    drop_constants: bool = True,
) -> DataFrame:
    """The full cleaning pass, from raw listings to the modelling table.

    The filtered and enriched rows are stored once; value counts, fences and constant columns
    are then computed from the stored table.
    """
    df = first_by(price_per_m2(raw), ["id"], list(order))
    df = market_filter(df.withColumnsRenamed(RENAMES)).drop(*FILTER_COLUMNS, *order)
    df = materialize(derive_features(enrich_districts(df, panorama), as_of_year))
    kept = set(df.columns) - {"id"}
    df = flag_outliers(bucket_top_k(df))
    dropped = set(REDUNDANT) | set(FINAL_DROPS)
    if drop_constants:
        df = materialize(df)
        dropped |= set(constant_names(df.select(*[c for c in df.columns if c in kept])))
    df = df.drop(*dropped)
    df = clean_text_columns(df)
    if strict_excluded is not None:
        df = drop_excluded(df, strict_excluded, strict=True)
    df = drop_excluded(df, excluded)
    return select_columns(normalise_names(df))
