"""Queries that fit models. Their results are checked by invariants in the tests."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from priceforge.operators import attribute, images, select, tune
from priceforge.operators.image_pca import ImageReducer
from priceforge.operators.models import DEFAULTS, SEARCH_SPACES, configure
from priceforge.operators.prepare import Prepared, prepare_feature_set
from priceforge.operators.split import stratified_split
from priceforge.plans import fixtures as fx
from priceforge.plans.files import scratch
from priceforge.plans.listings import population
from priceforge.plans.registry import query, rounded
from priceforge.session import materialize

SELECTED = [
    "area_m2", "room_size_m2", "building_age", "distance_to_center_km", "floor_ratio", "floor_number",
    "rooms_number", "building_floors_num", "building_type_BUILDING", "heating_5-LOW", "neighborhood_ASIA", "not_there",
]
METADATA = {"images_handled_separately": True, "include_location_features": True}
TRIALS, FOLDS = 100, 5
DROPPED = [
    "transaction_type", "estate", "date_created", "pushed_up_at", "const_col", "all_null_col", "price_per_m2",
    "latitude", "longitude", "building_year",
]


def split_table(spark: SparkSession, sf_dir: str, with_images: bool = False) -> DataFrame:
    """Modelling rows with their split, stored once."""
    df = images.train_population(population(spark, sf_dir)).drop(*DROPPED)
    if with_images:
        df = df.join(images.image_wide(fx.image_features(spark, sf_dir)), "id", "left")
    # The population is stored already; only the image join is worth storing again.
    return materialize(stratified_split(materialize(df) if with_images else df, seed=fx.SEED))


def prepared(spark: SparkSession, sf_dir: str, with_images: bool = False, **metadata) -> Prepared:
    table = split_table(spark, sf_dir, with_images)
    ready = prepare_feature_set(table, SELECTED, METADATA | metadata)
    return Prepared(materialize(ready.rows), ready.names, ready.info, ready.model)


@query("prepared_features")
def prepared_features(spark, sf_dir):
    """Scaled tabular features and image components of every modelling row."""
    ready = prepared(
        spark, sf_dir, True, apply_scale_transform=True, should_include_images=True, apply_pca_img_transform=True,
        n_pca_components=3,
    )
    return ready.rows.select("id", "split", "label", vector_to_array("features").alias("features"))


@query("image_pca")
def image_pca(spark, sf_dir):
    wide = materialize(images.image_wide(fx.image_features(spark, sf_dir)))
    return ImageReducer(0.8).fit(wide).transform(wide)


def _selected(spark: SparkSession, sf_dir: str, method: str, **settings) -> DataFrame:
    train = split_table(spark, sf_dir).where(F.col("split") == "train").drop("split", "stratum")
    name, result, _ = select.run_selection(train, method, include_location=True, seed=fx.SEED, **settings)
    rows = [(name, f, int(result.ranking.get(f, 1))) for f in result.features]
    return spark.createDataFrame(rows, "run string, feature string, ranking int")


@query("select_forest")
def select_forest(spark, sf_dir):
    return _selected(spark, sf_dir, "rf")


@query("select_rfe")
def select_rfe(spark, sf_dir):
    return _selected(spark, sf_dir, "rfe", n_features=6)


@query("select_rfecv")
def select_rfecv(spark, sf_dir):
    return _selected(spark, sf_dir, "rfecv")


@query("select_elastic_net")
def select_elastic_net(spark, sf_dir):
    return _selected(spark, sf_dir, "elasticnet", scale=True)


@query("select_lasso")
def select_lasso(spark, sf_dir):
    return _selected(spark, sf_dir, "lasso", scale=True, alpha=0.01)


@query("model_catalogue")
def model_catalogue(spark, sf_dir):
    """Metrics of each regressor with the hyperparameters of an untuned run."""
    ready = prepared(spark, sf_dir)
    first, *others = (configure(name, DEFAULTS[name]) for name in SEARCH_SPACES)
    fits = tune.fit_final(ready, first, beside=others, keep_trees=False)
    rows = [(name, m, float(v)) for name, (_, metrics) in zip(SEARCH_SPACES, fits) for m, v in metrics.items()]
    return spark.createDataFrame(rows, "model string, metric string, value double")


@query("random_search")
def random_search(spark, sf_dir):
    """Trials of a search, read back from the trials table."""
    folded = tune.fold_table(prepared(spark, sf_dir), FOLDS, fx.SEED)
    path = scratch(spark, "trials")
    tune.random_search(folded, "RandomForest", TRIALS, "RandomForest_demo_study", folds=FOLDS, trials_path=path)
    return tune.read_trials(spark, path)


@query("final_fit")
def final_fit(spark, sf_dir):
    """Metrics of a single-model run with metrics per fold."""
    params = DEFAULTS["RandomForest"]
    _, row, _ = tune.train_single(prepared(spark, sf_dir), "RandomForest", params, "demo", folds=FOLDS)
    return spark.createDataFrame(list(row["metrics"].items()), "metric string, value double")


@query("attribution_global")
def attribution_global(spark, sf_dir):
    """Mean absolute attribution of every feature over all test rows."""
    ready = prepared(spark, sf_dir)
    model, _ = tune.fit_final(ready, configure("RandomForest", DEFAULTS["RandomForest"]))
    test = ready.rows.where(F.col("split") == "test")
    return attribute.attribution_global(attribute.attributions(model, test, ready.names))


@query(
    "attribution_ranking",
    """SELECT feature, round(avg(abs(phi)), 4) AS mean_abs_phi FROM (
      SELECT l_returnflag || l_linestatus || CAST(l_linenumber AS VARCHAR) AS feature, l_extendedprice * (l_discount - l_tax) AS phi
      FROM lineitem) WHERE feature NOT IN ('NO1', 'RF2') GROUP BY feature ORDER BY avg(abs(phi)) DESC, feature LIMIT 5""",
)
def attribution_ranking(spark, sf_dir):
    """The strongest features of a long table of attributions, two of them left out."""
    feature = F.concat("l_returnflag", "l_linestatus", F.col("l_linenumber").cast("string")).alias("feature")
    phi = (F.col("l_extendedprice") * (F.col("l_discount") - F.col("l_tax"))).alias("phi")
    long = fx.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), feature, F.col("l_quantity").alias("value"), phi)
    return rounded(attribute.attribution_global(long, 5, without=["NO1", "RF2"]), 4, "mean_abs_phi")


@query("sweep")
def sweep(spark, sf_dir):
    """Runs of a sweep over all models; the second feature set fails and is logged as such."""
    path = scratch(spark, "sweep")
    sets = {
        "good": lambda: prepared(spark, sf_dir),
        "bad": lambda: prepare_feature_set(split_table(spark, sf_dir), ["missing"], {}),
    }
    rows = tune.sweep(spark, sets, list(SEARCH_SPACES), path, folds=FOLDS, n_trials=TRIALS)
    cells = [(r["run_name"], r["status"], r["metrics"].get("test_final_mape")) for r in rows]
    return spark.createDataFrame(cells, "run_name string, status string, test_final_mape double")


@query("param_importance")
def param_importance(spark, sf_dir):
    return attribute.param_importance(fx.trials(spark, sf_dir), ["k", "booster"])
