"""The library's input tables as projections of the shared test tables (see FIXTURES.md)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from priceforge.operators.clean import FLOORS
from priceforge.operators.ordinal import kfold, positions

SEED = 42

# Image category of each embedding label.
CATEGORIES = [
    "bathroom",
    "bedroom",
    "kitchen",
    "living_room",
    "interior",
    "other_interior",
    "exterior",
    "unfurnished_space",
    "kitchen",
    "kitchen",
]

# Model of each event type.
MODELS = {"click": "LightGBM", "view": "XGBoost", "purchase": "XGBoostQuantile", "signup": "RandomForest"}

# Starts of feature names. Those that end in "_" get a suffix.
NAME_STARTS = [
    "latitude",
    "longitude",
    "pca_",
    "interior_",
    "dist_",
    "count_",
    "park_areas_",
    "green_",
    "pano_",
    "has_",
    "is_",
    "district_",
    "neighborhood_",
    "building_type_",
    "building_material_",
    "area_m2",
    "room_size_m2",
    "floor_number",
    "building_age",
    "advertiser_type_",
    "construction_status_",
    "rooms_number_",
    "windows_type_",
    "heating_",
    "kitchen_pca_",
    "img_cat_",
    "vector_",
    "distance_to_center_km",
    "PANO_",
]

SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(words: list[str], index: Column) -> Column:
    return F.get(F.array(*[F.lit(w) for w in words]), index.cast("int"))


def listings_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    lines = (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_orderkey").alias("o_orderkey"))
        .agg(F.sum("l_quantity").alias("qty"), F.count(F.lit(1)).alias("n"), F.min("l_partkey").alias("p_partkey"))
    )
    part = table(spark, sf_dir, "part").select("p_partkey", "p_type")
    place = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    people = customer.join(place, F.col("c_nationkey") == F.col("n_nationkey"))
    joined = (
        orders.join(people, F.col("o_custkey") == F.col("c_custkey"))
        .join(lines, "o_orderkey", "left")
        .join(part, "p_partkey", "left")
    )
    i = F.col("o_orderkey")
    date = F.date_format("o_orderdate", "yyyy-MM-dd")
    one = joined.select(
        i.alias("id"),
        F.lit(0).alias("src_seq"),
        (F.col("o_totalprice") * 8).alias("price"),
        F.col("qty").alias("area_m2"),
        F.when(F.col("o_orderstatus") == "P", "RENT").otherwise("SELL").alias("transaction_type"),
        F.when(i % 10 == 0, "HOUSE").otherwise("FLAT").alias("estate"),
        F.col("n_name").alias("district"),
        F.col("r_name").alias("neighborhood"),
        (F.lit(52.0) + (F.col("c_custkey") % 500).cast("double") / 1000).alias("latitude"),
        (F.lit(20.8) + ((F.col("c_custkey") * 7) % 500).cast("double") / 1000).alias("longitude"),
        F.when(F.col("n") >= 7, "MORE").otherwise(F.col("n").cast("string")).alias("rooms_number"),
        _pick([*FLOORS, "ATTIC"], i % 15).alias("floor_number"),
        F.when(i % 23 != 0, (F.col("c_custkey") % 20).cast("double")).alias("building_floors_num"),
        (F.lit(1780) + F.col("o_custkey") % 260).cast("double").alias("building_year"),
        F.when(i % 11 != 0, F.col("o_orderpriority")).alias("heating"),
        F.col("c_mktsegment").alias("building_type"),
        F.when(i % 13 == 0, "[]").otherwise(F.concat(F.lit("["), F.col("p_type"), F.lit("]"))).alias("building_material"),
        (F.col("o_custkey") % 2 == 0).alias("is_private_owner"),
        date.alias("date_created"),
        F.when(i % 17 == 0, "not a date").otherwise(date).alias("pushed_up_at"),
        F.lit(1).alias("const_col"),
        F.lit(None).cast("double").alias("all_null_col"),
    )
    # Both copies come from one scan: a row with a second copy is expanded in place.
    copies = F.when(F.col("id") % 49 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return (
        one.withColumn("src_seq", F.explode(copies))
        .withColumn("price", F.col("price") + F.col("src_seq"))
    )


def panorama(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation").where(F.col("n_nationkey") != 7)
    counts = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("c_custkey") % 2 == 0).alias("females")
    )
    known = F.col("n_nationkey") != 3
    return nation.join(counts, F.col("n_nationkey") == F.col("c_nationkey"), "left").select(
        F.col("n_name").alias("district"),
        F.when(known, F.col("total")).alias("pano_pop_total"),
        F.when(known, F.col("females")).alias("pano_pop_females"),
    )


def exclude_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    ids = orders.where(F.col("o_orderkey") % 97 == 0).select(F.col("o_orderkey").alias("id"))
    beyond = orders.agg((F.max("o_orderkey") + 1).alias("id"))
    return ids.unionByName(beyond)


def image_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        (F.floor(F.col("vec_id") / 4) * 3 + 1).alias("id"),
        _pick(CATEGORIES, F.col("label")).alias("category"),
        F.col("embedding").alias("features"),
    )


def img_cat(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("id")
    times = F.when(i % 31 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return (
        table(spark, sf_dir, "orders")
        .select(F.col("o_orderkey").alias("id"))
        .where(i % 29 != 0)
        .select(
            "id",
            F.when(i % 3 != 0, 1).otherwise(0).alias("img_cat_kitchen"),
            F.when(i % 5 != 0, 1).otherwise(0).alias("img_cat_bathroom"),
            F.explode(times).alias("_copy"),
        )
        .drop("_copy")
    )


def text_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    text = F.when(i % 19 == 0, F.lit(None)).when(i % 23 == 0, "***").otherwise(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", text.alias("text"))


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, u = F.col("event_id"), F.col("user_id")
    text = lambda c: c.cast("string")
    model = F.coalesce(
        *[F.when(F.col("event_type") == kind, name) for kind, name in MODELS.items()], F.lit("Other")
    )
    sets = F.when(
        u % 12 == 11, F.concat(F.lit("fs_nfeat_"), text(u % 12), F.lit("_umap_count"))
    ).otherwise(F.concat(F.lit("fs_nfeat_"), text(u % 12), F.lit("_count")))
    millis = F.expr("timestampdiff(MILLISECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)")
    metric = F.when(e % 10 < 7, "mape").otherwise("rmse")
    name = F.concat_ws(
        "_", model, F.lit("rfecv_base_nfeat"), text(u % 12), F.lit("pca_mape"),
        F.concat(F.lit("v"), text(u % 3 + 6)), F.lit("BEST"),
    )
    params = {
        "model_name": F.when(e % 3 != 0, model),
        "feature_set": F.when(e % 4 != 1, sets),
        "feature_set_file": F.when(e % 8 == 1, sets),
        "n_trials_optuna": F.when(F.floor(e / 4) % 2 == 0, "50").otherwise("100"),
        "tuning_scoring_metric": metric,
        "cv_folds": F.when(e % 6 != 0, "5"),
        "learning_rate": text(F.col("value")),
        "tolerance": F.when(e % 2 == 0, "1e-05").otherwise("true"),
        "num_selected_features": F.when(e % 11 != 0, text(u % 12 + 20)),
        "n_features_selected": F.when(e % 7 == 0, "n/a").otherwise(
            text(u % 12 + 20 + F.when(e % 3 == 0, 1).otherwise(0))
        ),
        "fs_meta_images_handled_separately": F.when(u % 2 == 0, "True").otherwise("False"),
        "fs_meta_should_include_images": F.when(u % 3 == 0, "True").otherwise("False"),
        "fs_meta_apply_umap_img_transform": F.when(u % 9 == 0, "True").otherwise("False"),
        "fs_meta_apply_pca_img_transform": F.when(u % 6 == 0, "True").otherwise("False"),
    }
    tags = {
        "run_type": F.when(e % 4 == 0, "best_run").otherwise("trial"),
        "feature_set": sets,
    }
    metrics = {
        "test_final_mape": F.when(e % 5 != 0, F.col("value") / 1000),
        "best_optuna_cv_mape": F.col("value") / 900,
        "train_final_mape": F.when(e % 13 != 0, F.col("value") / 1100),
        "test_final_rmse": F.col("value") * 10,
        "test_final_r2": F.lit(1.0) - F.col("value") / 500,
        "tuning_duration_sec": F.col("value"),
    }

    def entries(values: dict[str, Column]) -> Column:
        full = F.create_map(*[x for k, v in values.items() for x in (F.lit(k), v)])
        return F.map_filter(full, lambda _, v: v.isNotNull())

    return table(spark, sf_dir, "events").select(
        e.alias("run_id"),
        (u % 10).alias("experiment_id"),
        F.when(u % 10 != 9, F.concat(F.lit("exp_"), text(u % 10))).alias("experiment_name"),
        name.alias("run_name"),
        F.when(e % 9 == 0, "FAILED").otherwise("FINISHED").alias("status"),
        millis.alias("start_time"),
        F.when(e % 50 != 0, millis + F.floor(F.col("value") * 1000)).alias("end_time"),
        entries(params).alias("params"),
        entries(tags).alias("tags"),
        entries(metrics).alias("metrics"),
    )


def study_name() -> Column:
    """Study name of a user's events; every eleventh user has a name without feature count."""
    u = F.col("user_id")
    text = lambda c: c.cast("string")
    model = _pick(list(MODELS.values()), u % 4)
    version = F.concat(F.lit("v"), text(u % 3 + 6))
    tail = F.concat_ws("_", F.concat(F.lit("u"), text(u)), F.lit("mape"), version, F.lit("study"))
    middle = F.when(u % 11 == 0, "rfecv_base_pca").otherwise(
        F.concat_ws("_", F.lit("rfecv_base_poi_nfeat"), text(u % 12), F.lit("pca"))
    )
    return F.concat_ws("_", model, middle, tail)


def trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    # Numbered per user by day and time, so a busy user is numbered by many tasks.
    numbered = positions(events, ["user_id"], F.to_date("ts"), ["ts", "event_id"], "number")
    u = F.col("user_id")
    value = F.when(u % 7 == 0, F.col("value") - 50).otherwise(F.col("value"))
    missing = (F.col("event_id") % 8 == 0) | ((u % 10 == 0) & (F.col("number") >= 9))
    k = F.get_json_object("props", "$.k")
    return numbered.select(
        u.alias("study"),
        "number",
        F.when(~missing, value).alias("value"),
        F.map_filter(
            F.create_map(F.lit("k"), k, F.lit("booster"), F.col("event_type")), lambda _, v: v.isNotNull()
        ).alias("params"),
    )


def named_trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, study) with readable study names."""
    return table(spark, sf_dir, "events").select("user_id", study_name().alias("study"))


def part_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(p_partkey, feature): a feature name per part."""
    start = _pick(NAME_STARTS, F.col("p_partkey") % len(NAME_STARTS))
    tail = F.concat_ws("_", F.lower("p_type"), F.col("p_size").cast("string"))
    name = F.when(start.endswith("_"), F.concat(start, tail)).otherwise(start)
    return table(spark, sf_dir, "part").select("p_partkey", name.alias("feature"))


def feature_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return part_names(spark, sf_dir).select("feature").distinct()


def feature_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(set_name, feature): a set holds the features bought in above-average quantity."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    return (
        lines.join(part_names(spark, sf_dir), F.col("l_partkey") == F.col("p_partkey"))
        .join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .groupBy(F.col("c_mktsegment").alias("set_name"), "feature")
        .agg(F.avg("l_quantity").alias("_q"))
        .where(F.col("_q") > 25.5)
        .select("set_name", "feature")
    )


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("o_orderkey")
    wobble = F.lit(1.0) + ((i * 37) % 41 - 20).cast("double") / 100
    return table(spark, sf_dir, "orders").select(
        i.alias("id"),
        F.col("o_totalprice").alias("true_price"),
        (F.col("o_totalprice") * wobble).alias("predicted_price"),
    )


def folded_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kfold(predictions(spark, sf_dir), "id", 5, SEED)
