import pytest
from pyspark.sql import functions as F

from priceforge.functions.columns import (
    classify_columns, image_groups, keep_selected, select_columns, selection_subset, subset_columns,
)
from priceforge.functions.names import readable_set_name, selection_name, study_short_name, typed_param
from priceforge.functions.text import clean_text
from priceforge.operators import clean, quality


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(
    "raw,want",
    [
        (None, "missing_value"), ("", "empty_value"), ("***", "empty_value"), ("  Żółć & Straße ", "zolc_strasse"),
        ("[BRICK]", "brick"), ("Œuvre_", "oeuvre"), ("a--b__c", "a_b__c"), ("Ångström 5", "angstrom_5"),
        ("50 m²", "50_m2"), ("①–Ｗide ⁷", "1_wide_7"), ("x⁄y ½", "x_y"),
    ],
)
def test_clean_text(spark, raw, want):
    assert one(spark, clean_text, raw) == want


@pytest.mark.parametrize(
    "raw,kind,value",
    [
        ("12", "int", 12), ("-3", "int", -3), ("1.5", "double", 1.5), ("1e-05", "double", 1e-5), ("True", "bool", True),
        ("n/a", "text", "n/a"), ("1.5d", "text", "1.5d"), ("1.2.3", "text", "1.2.3"), ("9" * 25, "double", 1e25),
    ],
)
def test_typed_param(spark, raw, kind, value):
    got = one(spark, typed_param, raw)
    assert got["kind"] == kind and got[f"{kind}_value"] == pytest.approx(value)


def test_typed_param_of_null(spark):
    assert one(spark, typed_param, None)["kind"] is None


def test_names(spark):
    full = "LightGBM_rfecv_all_nfeat_60_pca_count_mape_v1_study"
    assert one(spark, study_short_name, full) == "LightGBM all 60 pca v1"
    assert one(spark, study_short_name, "LightGBM_rfecv_all_v1_study") is None
    assert one(spark, study_short_name, "LightGBM_rfecv_all_nfeat_60") is None
    assert one(spark, readable_set_name, "rfecv_base_poi_nfeat_56_pca.json") == "BASE POI 56 PCA"
    assert selection_name("rf", "base", 5, 0.5, scaled=True, location=True) == "rf_base_nfeat_5_thresh_0p5_noimgtrans_scaled_count_loc.json"
    assert selection_name("elasticnet", "all", pca=True, count=False) == "elasticnet_all_cv_pca.json"


def test_derived_features_of_edge_rows(spark):
    rows = [
        (50.0, "MORE", "FIRST", 0.0, 1799.0, "[]", True), (40.0, "2", "ATTIC", 4.0, 2028.0, "x", False),
        (None, "?", None, None, None, None, None),
    ]
    df = spark.createDataFrame(
        rows,
        "area_m2 double, rooms_number string, floor_number string, building_floors_num double, building_year double, "
        "building_material string, is_private_owner boolean",
    ).withColumns({"latitude": F.lit(52.2318543), "longitude": F.lit(21.0028622)})
    a, b, c = clean.derive_features(df, 2030).collect()
    assert (a["floor_number"], a["floor_ratio"], a["building_age"], a["rooms_number"]) == (1, None, None, 11)
    assert a["room_size_m2"] == pytest.approx(50 / 11) and a["building_material"] == "MISSING"
    assert (b["floor_number"], b["building_age"], b["room_size_m2"], b["is_private_owner"]) == (None, 2.0, 20.0, 0)
    assert c["room_size_m2"] is None and c["rooms_number"] is None and c["distance_to_center_km"] == 0


def test_market_filter_drops_unknowns(spark):
    rows = [(1, "SELL", "FLAT", 2000.5, 10.0), (2, "SELL", "FLAT", 2000.0, 10.0), (3, "SELL", "FLAT", None, 10.0), (4, "RENT", "FLAT", 9e3, 50.0)]
    df = spark.createDataFrame(rows, "id int, transaction_type string, estate string, price_per_m2 double, area_m2 double")
    assert [r["id"] for r in clean.market_filter(df).collect()] == [1]


def test_top_values_break_ties_by_value(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(["b", "a", "c", "c", None, "d"])], "id int, k string")
    kept = clean.bucket_top_k(df, {"k": 2}).orderBy("id").collect()
    assert [r["k"] for r in kept] == ["OTHER", "a", "c", "c", "OTHER", "OTHER"]
    assert {r["value"] for r in clean.excluded_values(df, {"k": 2}).collect()} == {"b", "d"}


def test_outlier_flag(spark):
    df = spark.createDataFrame([(float(v),) for v in [1, 2, 3, 4, 100]] + [(None,)], "x double")
    flags = {r["x"]: r["outlier"] for r in clean.flag_outliers(df, {"x": False}).collect()}
    assert flags == {1.0: False, 2.0: False, 3.0: False, 4.0: False, 100.0: True, None: False}


def test_constant_columns_count_null_as_a_value(spark):
    df = spark.createDataFrame([(1, None, 1, "a"), (1, None, None, "b")], "same int, nulls int, half int, two string")
    assert sorted(quality.constant_names(df)) == ["nulls", "same"]


def test_strict_exclusion(spark):
    df, ids = spark.range(5), spark.createDataFrame([(3,), (9,)], "id long")
    assert {r["id"] for r in clean.drop_excluded(df, ids).collect()} == {0, 1, 2, 4}
    with pytest.raises(ValueError, match="9"):
        clean.drop_excluded(df, ids, strict=True)


def test_validation(spark):
    df = spark.createDataFrame([(1, 2.0, None)], "id long, x double, n double")
    assert quality.validate_table(df, "t") is df
    with pytest.raises(ValueError, match="only nulls"):
        quality.validate_table(df, "t", fatal_null=["n"])
    with pytest.raises(ValueError, match="missing"):
        quality.validate_table(df.drop("id"), "t")
    with pytest.raises(ValueError, match="no rows"):
        quality.validate_table(df.limit(0), "t")
    with pytest.raises(ValueError, match="twice"):
        quality.validate_table(df.select("id", "x", "x"), "t")
    with pytest.warns(UserWarning, match="only nulls"):
        quality.validate_table(spark.range(501).withColumn("n", F.lit(None).cast("int")), "t")


def test_column_rules(spark):
    names = ["area", "img_cat_a", "dist_x", "pano_y", "count_z", "kitchen_pca_1", "pano_dist_q"]
    assert subset_columns(names, "base") == ["area"]
    assert subset_columns(names, "poi_pano") == ["dist_x", "count_z", "pano_dist_q", "pano_y", "pano_dist_q"]
    assert selection_subset("base_poi_img") == "base_poi" and selection_subset("all_features") == "all"
    with pytest.raises(ValueError):
        selection_subset("img_cols")
    df = spark.createDataFrame([(1, 2.0, "a", True, 1.0, 5)], "id long, price double, district string, b boolean, img_cat_k double, x int")
    assert classify_columns(df, include_location=False) == {"numeric": ["x"], "categorical": [], "image": ["img_cat_k"]}
    assert classify_columns(df)["categorical"] == ["district"]
    assert select_columns(df, images=False).columns == ["id", "price", "district", "b", "x"]
    assert keep_selected(["a", "b"], ["b", "z", "a"]) == ["b", "a"]
    with pytest.raises(ValueError, match="z"):
        keep_selected(["a", "b"], ["b", "z"], strict=True)
    assert image_groups(["kitchen", "interior", "attic"], exclude=["interior"]) == ["kitchen"]
