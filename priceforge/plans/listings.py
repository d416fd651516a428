"""Queries over listings: cleaning, joins, image features, splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from priceforge.functions.columns import IMAGE_TYPES
from priceforge.functions.text import clean_text as clean_text_column
from priceforge.operators import clean, images, quality, split
from priceforge.operators.joins import first_by, with_row
from priceforge.operators.ordinal import kfold, sample_exact
from priceforge.operators.quantiles import exact_quantiles, name_of
from priceforge.plans import fixtures as fx
from priceforge.plans.registry import query, rounded
from priceforge.plans.views import clean as clean_sql
from priceforge.session import materialize

AS_OF_YEAR = 2025
SAMPLE_ROWS = 500


def unique_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return first_by(fx.listings_raw(spark, sf_dir), ["id"], ["src_seq"]).drop("src_seq")


def market(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.market_filter(clean.price_per_m2(unique_listings(spark, sf_dir)))


def derived(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.derive_features(market(spark, sf_dir), AS_OF_YEAR)


def population(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagged listings with image dummies, stored once."""
    flagged = clean.flag_outliers(materialize(derived(spark, sf_dir)))
    return materialize(images.join_images(flagged, None, fx.img_cat(spark, sf_dir)))


@query(
    "dedup_first",
    """SELECT id, price, area_m2, district FROM listings""",
    ("listings",),
)
def dedup_first(spark, sf_dir):
    raw = fx.listings_raw(spark, sf_dir).select("id", "src_seq", "price", "area_m2", "district")
    return first_by(raw, ["id"], ["src_seq"]).drop("src_seq")


@query(
    "district_price_median",
    """SELECT district, round(quantile_cont(price_per_m2, 0.5), 6) AS median_price_per_m2, count(*) AS n
    FROM outliers WHERE NOT outlier GROUP BY district""",
    ("outliers",),
)
def district_price_median(spark, sf_dir):
    """Median price per square metre and number of listings per district, outliers left out."""
    # Stored once; the fences are constants, so filtering the stored rows again is a plain scan.
    base = materialize(derived(spark, sf_dir).select("id", "district", *clean.FENCED))
    flagged = clean.flag_outliers(base).where(~F.col("outlier")).select("id", "district", "price_per_m2")
    medians = exact_quantiles(flagged, ["price_per_m2"], [0.5], by=["district"], salt_by=["id"])
    counts = flagged.groupBy("district").agg(F.count(F.lit(1)).alias("n"))
    median = F.round(F.col(name_of("price_per_m2", 0.5)), 6).alias("median_price_per_m2")
    return medians.join(counts, "district").select("district", median, "n")


@query(
    "derived_features",
    """SELECT id, round(price_per_m2, 6) AS price_per_m2, building_age, building_year,
      round(distance_to_center_km, 6) AS distance_to_center_km, round(room_size_m2, 6) AS room_size_m2,
      round(floor_ratio, 6) AS floor_ratio, rooms_number, building_material, is_private_owner
    FROM derived""",
    ("derived",),
)
def derived_features(spark, sf_dir):
    df = derived(spark, sf_dir).select(
        "id", "price_per_m2", "building_age", "building_year", "distance_to_center_km", "room_size_m2",
        "floor_ratio", "rooms_number", "building_material", "is_private_owner",
    )
    return rounded(df, 6, "price_per_m2", "distance_to_center_km", "room_size_m2", "floor_ratio")


@query("floor_ordinal", "SELECT id, floor_number FROM derived", ("derived",))
def floor_ordinal(spark, sf_dir):
    return derived(spark, sf_dir).select("id", "floor_number")


@query(
    "parse_dates",
    """SELECT id, src_seq, CAST(date_created AS TIMESTAMP) AS date_created,
      TRY_CAST(pushed_up_at AS TIMESTAMP) AS pushed_up_at FROM listings_raw""",
    ("listings_raw",),
)
def parse_dates(spark, sf_dir):
    raw = fx.listings_raw(spark, sf_dir).select("id", "src_seq", "date_created", "pushed_up_at")
    return clean.parse_dates(raw, strict=["date_created"], lenient=["pushed_up_at"])


@query("clean_text", f"SELECT doc_id, {clean_sql('text')} AS text FROM text_values", ("text_values",))
def clean_text(spark, sf_dir):
    return fx.text_values(spark, sf_dir).withColumn("text", clean_text_column(F.col("text")))


@query(
    "pano_enrich",
    """SELECT id, m.district, pano_pop_total, pano_pop_females,
      round(pano_share_pop_females, 6) AS pano_share_pop_females
    FROM market m LEFT JOIN districts d ON m.district = d.district""",
    ("market", "districts"),
)
def pano_enrich(spark, sf_dir):
    df = market(spark, sf_dir).select("id", "district")
    return rounded(clean.enrich_districts(df, fx.panorama(spark, sf_dir)), 6, "pano_share_pop_females")


@query("topk_bucket", "SELECT id, heating, building_type, building_material FROM bucketed", ("bucketed",))
def topk_bucket(spark, sf_dir):
    df = derived(spark, sf_dir).select("id", "heating", "building_type", "building_material")
    return clean.bucket_top_k(materialize(df))


@query(
    "topk_excluded",
    """SELECT "column", value, n FROM value_counts v
    WHERE NOT EXISTS (SELECT 1 FROM tops t WHERE t."column" = v."column" AND t.value = v.value)""",
    ("value_counts", "tops"),
)
def topk_excluded(spark, sf_dir):
    df = derived(spark, sf_dir).select("id", "heating", "building_type", "building_material")
    return clean.excluded_values(materialize(df))


@query("iqr_outliers", "SELECT id, outlier FROM outliers", ("outliers",))
def iqr_outliers(spark, sf_dir):
    base = materialize(derived(spark, sf_dir).select("id", *clean.FENCED))
    return clean.flag_outliers(base).select("id", "outlier")


@query(
    "constant_columns",
    "SELECT * FROM ("
    + " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count(DISTINCT {c}) + max(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) = 1 AS is_constant
        FROM market"""
        for c in ["id", "price", "estate", "transaction_type", "district", "heating", "const_col", "all_null_col"]
    )
    + ")",
    ("market",),
)
def constant_columns(spark, sf_dir):
    columns = ["id", "price", "estate", "transaction_type", "district", "heating", "const_col", "all_null_col"]
    return quality.constant_columns(market(spark, sf_dir), columns)


@query(
    "quality_profile",
    "SELECT * FROM ("
    + " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count(*) AS n_rows, count({c}) AS n_values, count({c}) = 0 AS all_null,
        (SELECT count(*) FROM (SELECT id FROM listings_raw GROUP BY id HAVING count(*) > 1)) AS duplicate_keys,
        (SELECT coalesce(sum(n), 0)::BIGINT FROM (SELECT count(*) AS n FROM listings_raw GROUP BY id HAVING count(*) > 1)) AS duplicate_rows
        FROM listings_raw"""
        for c in ["id", "area_m2", "heating", "building_floors_num", "all_null_col"]
    )
    + ")",
    ("listings_raw",),
)
def quality_profile(spark, sf_dir):
    columns = ["id", "area_m2", "heating", "building_floors_num", "all_null_col"]
    raw = fx.listings_raw(spark, sf_dir).select(*columns)
    twice = quality.duplicate_keys(raw)
    profile = with_row(quality.quality_profile(raw, columns), twice, "_d")
    return profile.select("column", "n_rows", "n_values", "all_null", "_d.*")


@query(
    "exclude_ids",
    "SELECT id, price FROM market WHERE id NOT IN (SELECT id FROM exclude_list)",
    ("market", "exclude_list"),
)
def exclude_ids(spark, sf_dir):
    df = market(spark, sf_dir).select("id", "price")
    return clean.drop_excluded(df, fx.exclude_ids(spark, sf_dir))


CLEAN_SQL = f"""SELECT id, price, area_m2, {clean_sql('b.district')} AS district, {clean_sql('neighborhood')} AS neighborhood,
  rooms_number, floor_number, building_floors_num, {clean_sql('heating')} AS heating,
  {clean_sql('building_type')} AS building_type, {clean_sql('building_material')} AS building_material,
  is_private_owner, pano_pop_total, pano_pop_females, round(pano_share_pop_females, 6) AS pano_share_pop_females,
  building_age, round(distance_to_center_km, 6) AS distance_to_center_km, round(room_size_m2, 6) AS room_size_m2,
  round(floor_ratio, 6) AS floor_ratio, outlier
FROM bucketed b LEFT JOIN districts d ON b.district = d.district
WHERE id NOT IN (SELECT id FROM exclude_list)"""


@query("clean_listings", CLEAN_SQL, ("bucketed", "districts", "exclude_list"))
def clean_listings(spark, sf_dir):
    cleaned = clean.clean_listings(
        fx.listings_raw(spark, sf_dir), fx.panorama(spark, sf_dir), fx.exclude_ids(spark, sf_dir), AS_OF_YEAR
    )
    return rounded(cleaned, 6, "pano_share_pop_females", "distance_to_center_km", "room_size_m2", "floor_ratio")


@query(
    "image_mean",
    "SELECT id, category, CAST(pos AS INTEGER) - 1 AS pos, round(value, 6) AS value FROM image_elements",
    ("image_elements",),
)
def image_mean(spark, sf_dir):
    means = images.image_mean(fx.image_features(spark, sf_dir))
    return means.select("id", "category", F.posexplode("features").alias("pos", "value")).withColumn(
        "value", F.round("value", 6)
    )


@query(
    "image_wide",
    "SELECT CAST(pos AS INTEGER) - 1 AS pos, id, "
    + ", ".join(f"round(max(CASE WHEN category = '{c}' THEN value END), 6) AS {c}" for c in IMAGE_TYPES)
    + " FROM image_elements GROUP BY id, pos",
    ("image_elements",),
)
def image_wide(spark, sf_dir):
    """One row per id and element, one column per category."""
    wide = images.image_wide(fx.image_features(spark, sf_dir))
    empty = F.array().cast("array<double>")
    zipped = F.arrays_zip(*[F.coalesce(c, empty).alias(c) for c in IMAGE_TYPES])
    rows = wide.select("id", F.posexplode(zipped).alias("pos", "cell")).select("pos", "id", "cell.*")
    return rounded(rows, 6, *IMAGE_TYPES)


@query("image_flag", "SELECT id, img_cat_kitchen, img_cat_bathroom, has_img FROM population", ("population",))
def image_flag(spark, sf_dir):
    joined = images.join_images(market(spark, sf_dir).select("id"), None, fx.img_cat(spark, sf_dir))
    return joined.select("id", "img_cat_kitchen", "img_cat_bathroom", "has_img")


@query(
    "train_population",
    "SELECT id, price FROM population WHERE NOT outlier AND has_img",
    ("population",),
)
def train_population(spark, sf_dir):
    return images.train_population(population(spark, sf_dir)).select("id", "price")


@query(
    "quality_counts",
    """SELECT count(*) AS n_rows, count(CASE WHEN outlier THEN 1 END) AS outliers,
      count(CASE WHEN has_img THEN 1 END) AS with_image,
      count(CASE WHEN NOT has_img THEN 1 END) AS without_image FROM population""",
    ("population",),
)
def quality_counts(spark, sf_dir):
    return quality.flag_counts(
        population(spark, sf_dir), outliers=F.col("outlier"), with_image=F.col("has_img"), without_image=~F.col("has_img")
    )


@query(
    "price_bands",
    """SELECT id, price, split_part(stratum, '_', 1) AS price_band FROM strata""",
    ("strata",),
)
def price_bands(spark, sf_dir):
    df = population(spark, sf_dir).where(~F.col("outlier"))
    return df.select("id", "price", split.price_band(F.col("price")).alias("price_band"))


@query(
    "valid_strata",
    """SELECT stratum, n FROM (SELECT stratum, count(*) AS n FROM strata GROUP BY stratum) WHERE n >= 2""",
    ("strata",),
)
def valid_strata(spark, sf_dir):
    df = split.with_stratum(population(spark, sf_dir).where(~F.col("outlier")).select("id", "price", "has_img"))
    return split.strata_sizes(split.valid_strata(df))


SPLIT_SQL = """SELECT id, stratum, CASE WHEN rn <= quota THEN 'test' ELSE 'train' END AS split
FROM (SELECT id, v.stratum, quota,
    row_number() OVER (PARTITION BY v.stratum ORDER BY md5(CAST(id AS VARCHAR) || '|42'), id) AS rn
  FROM (SELECT * FROM strata WHERE stratum IN (SELECT stratum FROM strata GROUP BY stratum HAVING count(*) >= 2)) v
  JOIN (SELECT stratum, n - whole - CASE WHEN row_number() OVER (ORDER BY rest DESC, stratum) <= train - sum(whole) OVER ()
      THEN 1 ELSE 0 END AS quota
    FROM (SELECT *, n * train // total AS whole, n * train % total AS rest
      FROM (SELECT *, total - CAST(ceil(total * 0.2) AS BIGINT) AS train
        FROM (SELECT stratum, n, CAST(sum(n) OVER () AS BIGINT) AS total
          FROM (SELECT stratum, count(*) AS n FROM strata GROUP BY stratum HAVING count(*) >= 2))))) q
  ON v.stratum = q.stratum)"""


@query("stratified_split", SPLIT_SQL, ("strata",))
def stratified_split(spark, sf_dir):
    df = population(spark, sf_dir).where(~F.col("outlier")).select("id", "price", "has_img")
    return split.stratified_split(df, seed=fx.SEED).select("id", "stratum", "split")


@query(
    "sample_n",
    f"SELECT id, price FROM market ORDER BY md5(CAST(id AS VARCHAR) || '|42'), id LIMIT {SAMPLE_ROWS}",
    ("market",),
)
def sample_n(spark, sf_dir):
    df = materialize(market(spark, sf_dir).select("id", "price"))
    return sample_exact(df, "id", SAMPLE_ROWS, fx.SEED)


@query("kfold_assign", "SELECT id, fold FROM folded", ("folded",))
def kfold_assign(spark, sf_dir):
    return kfold(fx.predictions(spark, sf_dir).select("id"), "id", 5, fx.SEED)
