"""Queries through the file readers and writers: write a projection, read it back."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from priceforge.functions.columns import keep_selected, normalise_names as normalise, select_columns
from priceforge.operators import clean, runs as ops, split
from priceforge.operators.joins import first_by
from priceforge.plans import fixtures as fx
from priceforge.plans.listings import SPLIT_SQL, derived, population
from priceforge.plans.registry import query, rounded
from priceforge.session import checkpoint_root
from priceforge.sources import featuresets, listings, runs, summaries, tables


def scratch(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_root(spark).rstrip('/')}/priceforge/{name}-{uuid.uuid4().hex}"


@query(
    "listings_csv_scan",
    """SELECT id, price, area_m2, district, latitude, rooms_number, building_floors_num, is_private_owner, heating,
      row_number() OVER (PARTITION BY id ORDER BY src_seq) AS place
    FROM listings_raw""",
    ("listings_raw",),
)
def listings_csv_scan(spark, sf_dir):
    """Raw listings, second copies included, as several CSV files with their own column names, scanned in file order."""
    dotted = {short: long for long, short in clean.RENAMES.items()}
    raw = fx.listings_raw(spark, sf_dir).orderBy("src_seq", "id").drop("src_seq", "const_col", "all_null_col")
    raw = raw.withColumnsRenamed({k: v for k, v in dotted.items() if k in raw.columns})
    path = scratch(spark, "listings")
    raw.withColumn("Unnamed: 0", F.col("id")).write.csv(path, header=True)
    read = listings.read_listings(spark, path)
    place = F.row_number().over(Window.partitionBy("id").orderBy("src_seq")).cast("long").alias("place")
    return read.select(
        "id", "price", "area_m2", "district", "latitude", "rooms_number", "building_floors_num", "is_private_owner", "heating", place
    )


@query(
    "district_csv_scan",
    """SELECT district, pano_pop_total, pano_pop_females, round(pano_share_pop_females, 6) AS pano_share_pop_females
    FROM (SELECT district, CAST(pano_pop_total AS DOUBLE) AS pano_pop_total, CAST(pano_pop_females AS DOUBLE) AS pano_pop_females,
      pano_share_pop_females FROM districts)""",
    ("districts",),
)
def district_csv_scan(spark, sf_dir):
    path = scratch(spark, "districts")
    fx.panorama(spark, sf_dir).write.csv(path, header=True)
    return rounded(clean.district_table(listings.read_districts(spark, path)), 6, "pano_share_pop_females")


@query("img_cat_csv_scan", "SELECT id, img_cat_kitchen, img_cat_bathroom FROM img_cat", ("img_cat",))
def img_cat_csv_scan(spark, sf_dir):
    path = scratch(spark, "img_cat")
    fx.img_cat(spark, sf_dir).write.csv(path, header=True)
    dummies = listings.read_image_dummies(spark, path)
    return first_by(dummies, ["id"], ["img_cat_kitchen", "img_cat_bathroom"])


@query("exclusion_text_scan", "SELECT id FROM exclude_list", ("exclude_list",))
def exclusion_text_scan(spark, sf_dir):
    path = scratch(spark, "exclude")
    fx.exclude_ids(spark, sf_dir).select(F.col("id").cast("string")).write.text(path)
    return listings.read_exclusions(spark, path)


@query(
    "image_parquet_scan",
    """SELECT id, category, len(features) AS width, round(list_sum(CAST(features AS DOUBLE[])), 4) AS total FROM image_features""",
    ("image_features",),
)
def image_parquet_scan(spark, sf_dir):
    path = scratch(spark, "images")
    cells = [F.expr(f"get(features, {i}) as feature_{i}") for i in range(64)]
    fx.image_features(spark, sf_dir).select("id", F.col("category").alias("category_name"), *cells).write.parquet(path)
    read = listings.read_image_means(spark, path, "category")
    total = F.aggregate("features", F.lit(0.0), lambda a, x: a + x)
    return read.select("id", "category", F.size("features").cast("bigint").alias("width"), F.round(total, 4).alias("total"))


@query("split_table_scan", f"SELECT id, stratum FROM ({SPLIT_SQL}) WHERE split = 'test'", ("strata",))
def split_table_scan(spark, sf_dir):
    """The split written as one partitioned table; the test part read back."""
    df = population(spark, sf_dir).where(~F.col("outlier")).select("id", "price", "has_img")
    path = scratch(spark, "split")
    tables.write_split(split.stratified_split(df, seed=fx.SEED), path)
    return tables.read_split(spark, path, "test").select("id", "stratum")


@query("table_roundtrip", "SELECT id, round(room_size_m2, 6) AS room_size_m2, heating FROM derived", ("derived",))
def table_roundtrip(spark, sf_dir):
    path = scratch(spark, "processed")
    tables.write_table(derived(spark, sf_dir), path)
    return rounded(tables.read_table(spark, path).select("id", "room_size_m2", "heating"), 6, "room_size_m2")


@query(
    "feature_export",
    "SELECT CAST(id AS VARCHAR) AS id, CAST(building_age AS VARCHAR) AS building_age FROM derived",
    ("derived",),
)
def feature_export(spark, sf_dir):
    path = scratch(spark, "export")
    tables.export_columns(derived(spark, sf_dir), ["id", "building_age"], path)
    return spark.read.csv(path, header=True)


@query("featureset_roundtrip", "SELECT set_name, feature FROM members", ("members",))
def featureset_roundtrip(spark, sf_dir):
    """One JSON record per feature set, written and read."""
    path = scratch(spark, "feature_sets")
    sets = fx.feature_members(spark, sf_dir).groupBy("set_name").agg(
        F.array_sort(F.collect_set("feature")).alias("selected_features")
    )
    record = F.struct("selected_features", F.create_map(F.lit("subset_type"), "set_name").alias("metadata"))
    sets.select(record.alias("r")).select("r.*").repartition(5, F.col("metadata.subset_type")).write.option(
        "maxRecordsPerFile", 1
    ).json(path)
    read = featuresets.read_feature_sets(spark, path)
    return read.select(
        F.try_element_at("metadata", F.lit("subset_type")).alias("set_name"), F.explode("selected_features").alias("feature")
    )


@query("runs_table_scan", "SELECT CAST(run_id AS VARCHAR) AS run_id, run_name, status FROM runs WHERE run_type = 'best_run'", ("runs",))
def runs_table_scan(spark, sf_dir):
    """Runs appended as a table partitioned by type; only the best runs' files are read."""
    path = scratch(spark, "runs")
    stored = fx.runs(spark, sf_dir).withColumns(
        {
            "run_id": F.col("run_id").cast("string"),
            "experiment_id": F.col("experiment_id").cast("string"),
            "run_type": F.try_element_at("tags", F.lit("run_type")),
        }
    )
    stored.write.mode("append").partitionBy("run_type").parquet(path)
    return runs.read_runs(spark, path, "best_run").select("run_id", "run_name", "status")


@query(
    "summary_csv_scan",
    """SELECT CAST(run_id AS VARCHAR) AS run_id, model_name, feature_set, CAST(feature_mismatch AS VARCHAR) AS feature_mismatch FROM summary""",
    ("summary",),
)
def summary_csv_scan(spark, sf_dir):
    path = scratch(spark, "summary")
    summaries.write_summary(ops.run_summary(fx.runs(spark, sf_dir)), path)
    return summaries.read_summaries(spark, [path]).select("run_id", "model_name", "feature_set", "feature_mismatch")


@query("report_json_scan", "SELECT model_feature_combination, run_id, test_mape FROM summary", ("summary",))
def report_json_scan(spark, sf_dir):
    path = scratch(spark, "report")
    summaries.write_report(ops.run_summary(fx.runs(spark, sf_dir)), path)
    report = spark.read.json(f"{path}/runs")
    return report.select("model_feature_combination", "basic_info.run_id", "performance_metrics.test_mape")


@query("normalise_names", 'SELECT id, district AS "location-district" FROM derived', ("derived",))
def normalise_names(spark, sf_dir):
    df = derived(spark, sf_dir).select("id", "district").withColumnRenamed("district", "location—district")
    return normalise(df)


@query("select_features", "SELECT price, area_m2 FROM derived", ("derived",))
def select_features(spark, sf_dir):
    """Image, count and vector columns removed by name; selected features kept in order."""
    df = derived(spark, sf_dir).withColumnsRenamed(
        {"heating": "kitchen_0", "building_type": "count_shops_1km", "district": "vector_1", "neighborhood": "img_cat_x"}
    )
    df = select_columns(df, images=False, counts=False)
    return df.select(*keep_selected(df.columns, ["price", "vector_1", "kitchen_0", "area_m2", "count_shops_1km"]))
