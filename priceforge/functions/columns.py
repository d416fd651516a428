"""Rules over column and feature names."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Name parts that mark image, count and vector columns.
IMAGE_PATTERN = (
    "img_|feature_|vector_|interior_|exterior_|unfurnished_space_|other_interior_|"
    "bathroom_|bedroom_|kitchen_|living_room_"
)
COUNT_PATTERN = "count_"
VECTOR_PREFIX = "vector_"

# Name parts of the feature families.
FAMILY_PARTS = {
    "img": ["img_", "interior_", "exterior_", "vector_", "feature_", "pca_"],
    "poi": ["play_areas_", "park_areas_", "dist_", "count_"],
    "pano": ["pano_"],
}

# Named unions of families. The subsets with images select on their twin without.
SUBSETS = {
    "base": ["base"],
    "pano": ["pano"],
    "poi": ["poi"],
    "base_pano": ["base", "pano"],
    "base_poi": ["base", "poi"],
    "poi_pano": ["poi", "pano"],
    "base_poi_pano": ["base", "poi", "pano"],
    "img_cols": ["img"],
    "base_img": ["base", "img"],
    "base_poi_img": ["base", "poi", "img"],
    "base_pano_img": ["base", "pano", "img"],
    "base_poi_pano_img": ["base", "poi", "pano", "img"],
    "poi_pano_img": ["poi", "pano", "img"],
    "all": ["base", "poi", "pano"],
}
IMAGE_SUBSETS = [
    "all_features",
    "img_cols",
    "base_img",
    "base_poi_img",
    "base_pano_img",
    "base_poi_pano_img",
    "poi_pano_img",
]

# Image categories.
IMAGE_TYPES = [
    "interior",
    "other_interior",
    "unfurnished_space",
    "exterior",
    "bathroom",
    "bedroom",
    "kitchen",
    "living_room",
]

# Feature categories, first matching rule wins. A rule is (category, kind, words).
CATEGORY_RULES = [
    ("Coordinates", "is", ["latitude", "longitude"]),
    ("PCA Components", "starts", ["pca"]),
    ("Image Features", "starts", ["interior_"]),
    ("Distance Features", "starts", ["dist_"]),
    ("Count Features", "starts", ["count_"]),
    ("POI Green Features", "contains", ["_areas_", "green"]),
    ("Panorama Features", "starts", ["pano_"]),
    ("Boolean Features", "starts", ["has_", "is_"]),
    ("District/Neighborhood Areas", "contains", ["district_", "neighborhood_"]),
    ("Building Type", "starts", ["building_type_"]),
    ("Building Features", "starts", ["building_"]),
    (
        "Property Attributes",
        "is",
        ["area_m2", "room_size_m2", "floor_number", "building_floors_num", "building_age"],
    ),
    ("Advertiser Type", "starts", ["advertiser_type"]),
    ("Construction Status", "starts", ["construction_status_"]),
    ("Rooms Number", "starts", ["rooms_number_"]),
    ("Windows Type", "starts", ["windows_type_"]),
    ("Heating", "starts", ["heating_"]),
]
OTHER_CATEGORY = "Other"


def _any(tests: Iterable[Column]) -> Column:
    joined = F.lit(False)
    for test in tests:
        joined = joined | test
    return joined


def feature_category(name: Column) -> Column:
    """Category of a feature name."""
    lowered = F.lower(name)
    test = {
        "is": lambda words: lowered.isin(words),
        "starts": lambda words: _any(lowered.startswith(w) for w in words),
        "contains": lambda words: _any(lowered.contains(w) for w in words),
    }
    label = F.when(F.lit(False), F.lit(None).cast("string"))
    for category, kind, words in CATEGORY_RULES:
        label = label.when(test[kind](words), category)
    return label.otherwise(OTHER_CATEGORY)


def in_family(name: Column, family: str) -> Column:
    """Whether a feature name belongs to a family; ``base`` is what no other family claims."""
    if family == "base":
        return ~_any(in_family(name, other) for other in FAMILY_PARTS)
    return _any(name.contains(part) for part in FAMILY_PARTS[family])


def subset_columns(columns: Sequence[str], subset: str) -> list[str]:
    """Column names of a named subset, family by family."""
    if subset == "all_features":
        return list(columns)
    if subset not in SUBSETS:
        raise ValueError(f"unknown feature subset {subset!r}")
    claimed = {f: [c for c in columns if any(p in c for p in parts)] for f, parts in FAMILY_PARTS.items()}
    taken = {c for cols in claimed.values() for c in cols}
    claimed["base"] = [c for c in columns if c not in taken]
    return [c for family in SUBSETS[subset] for c in claimed[family]]


def selection_subset(subset: str) -> str:
    """The subset without images that selection runs on."""
    if subset == "all_features":
        return "all"
    twin = subset.removesuffix("_img")
    if twin not in SUBSETS or "img" in SUBSETS[twin]:
        raise ValueError(f"subset {subset!r} has no counterpart without images")
    return twin


def image_columns(columns: Sequence[str]) -> list[str]:
    return [c for c in columns if re.search(IMAGE_PATTERN, c)]


def select_columns(
    df: DataFrame, images: bool = True, counts: bool = True, vectors: bool = False
) -> DataFrame:
    """Keep or drop the image, count and ``vector_`` columns by name."""
    drop = set()
    if not images:
        drop.update(image_columns(df.columns))
    if not counts:
        drop.update(c for c in df.columns if re.search(COUNT_PATTERN, c))
    if not vectors:
        drop.update(c for c in df.columns if c.startswith(VECTOR_PREFIX))
    return df.drop(*drop)


def normalise_names(df: DataFrame) -> DataFrame:
    """Em dashes in column names become hyphens."""
    return df.toDF(*[c.replace("—", "-") for c in df.columns])


def classify_columns(
    df: DataFrame,
    target: str = "price",
    key: str = "id",
    outlier: str = "outlier",
    location: Sequence[str] = ("district", "neighborhood"),
    include_location: bool = True,
) -> dict[str, list[str]]:
    """Numeric, categorical and image columns by type and name; booleans are in no group."""
    images = image_columns(df.columns)
    skipped = {target, key, outlier, *images}
    fields = [f for f in df.schema if f.name not in skipped]
    text = [f.name for f in fields if isinstance(f.dataType, T.StringType)]
    if not include_location:
        text = [c for c in text if c not in location]
    return {
        "numeric": [f.name for f in fields if isinstance(f.dataType, T.NumericType)],
        "categorical": text,
        "image": images,
    }


def keep_selected(available: Sequence[str], selected: Sequence[str], strict: bool = False) -> list[str]:
    """Selected features that exist, in selected order; ``strict`` fails on a missing one."""
    missing = [c for c in selected if c not in set(available)]
    if strict and missing:
        raise ValueError(f"features not available: {missing}")
    return [c for c in selected if c in set(available)]


def image_groups(categories: Sequence[str], exclude: Sequence[str] = ()) -> list[str]:
    """Known image categories present, without the excluded ones."""
    return [c for c in IMAGE_TYPES if c in categories and c not in exclude]
