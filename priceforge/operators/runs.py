"""Questions over the table of training runs.

A run: ids, name, status, start and end in epoch milliseconds, string parameters, string tags
and double metrics as maps.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from priceforge.functions.names import run_version, short_feature_set
from priceforge.operators.joins import first_by, with_row

UNKNOWN = "Unknown"
BEST_RUN = "best_run"

# Output metric and the metric keys to try in order.
METRIC_KEYS = {
    "train_score": ["train_final_mape", "cv_mape"],
    "test_score": ["test_final_mape", "best_optuna_cv_mape"],
    "train_mape": ["train_final_mape"],
    "test_mape": ["test_final_mape", "best_optuna_cv_mape"],
    "train_rmse": ["train_final_rmse"],
    "test_rmse": ["test_final_rmse"],
    "train_r2": ["train_final_r2"],
    "test_r2": ["test_final_r2"],
    "cv_mape": ["cv_mape", "best_optuna_cv_mape"],
    "tuning_duration": ["tuning_duration_sec"],
    "total_duration": ["total_pipeline_duration_sec"],
}

# Parameters that may name the model, and model names looked for in run names.
MODEL_PARAMS = ["model_name", "model", "algorithm"]
KNOWN_MODELS = ["LightGBM", "XGBoost", "RandomForest", "SVM", "LinearRegression"]

# Parameters copied to columns when present, else "Unknown".
COPIED_PARAMS = ["cv_folds", "random_state", "n_trials_optuna", "tuning_scoring_metric"]

# Parameters tried in order for the two feature counts.
SELECTED_KEYS = ["num_selected_features", "selected_tabular_features"]
EXPECTED_KEYS = ["n_features_selected", "fs_meta_n_features_selected"]


def with_tag(runs: DataFrame, tag: str, value: str) -> DataFrame:
    return runs.where(F.try_element_at("tags", F.lit(tag)) == value)


def lookup_by_name(runs: DataFrame, name: str, metric: str, ascending: bool = True) -> DataFrame:
    """The run of a name with the best metric; runs without the metric come last."""
    value = F.try_element_at("metrics", F.lit(metric))
    order = value.asc_nulls_last() if ascending else value.desc_nulls_last()
    return runs.where(F.col("run_name") == name).orderBy(order, "run_id").limit(1)


def first_key(entries: str, keys: Sequence[str]) -> Column:
    """The value of the first listed key that a map column has."""
    return F.coalesce(*[F.try_element_at(entries, F.lit(k)) for k in keys])


def first_key_name(entries: str, keys: Sequence[str]) -> Column:
    """Which of the listed keys ``first_key`` took."""
    return F.coalesce(*[F.when(F.try_element_at(entries, F.lit(k)).isNotNull(), k) for k in keys])


def model_name() -> Column:
    """Model of a run: a parameter, else a known model inside the run name, else a tag."""
    lowered = F.lower(F.coalesce("run_name", F.lit("")))
    by_name = F.coalesce(*[F.when(lowered.contains(m.lower()), m) for m in KNOWN_MODELS])
    tag = F.try_element_at("tags", F.lit("model_name"))
    return F.coalesce(first_key("params", MODEL_PARAMS), by_name, tag, F.lit(UNKNOWN))


def _time(millis: str) -> Column:
    return F.expr(f"timestampadd(MILLISECOND, {millis}, TIMESTAMP_NTZ'1970-01-01 00:00:00')")


def flatten_runs(runs: DataFrame) -> DataFrame:
    """One flat row per run: times, labels, parameters, and metrics with their fallbacks."""
    tag = lambda k: F.coalesce(F.try_element_at("tags", F.lit(k)), F.lit(UNKNOWN))
    feature_set = F.coalesce(first_key("params", ["feature_set", "feature_set_file"]), tag("feature_set"))
    return runs.select(
        "run_id",
        "experiment_id",
        "run_name",
        "status",
        F.coalesce("experiment_name", F.lit(UNKNOWN)).alias("experiment_name"),
        _time("start_time").alias("start_time"),
        _time("end_time").alias("end_time"),
        tag("run_type").alias("run_type"),
        tag("feature_set").alias("feature_set_tag"),
        model_name().alias("model_name"),
        feature_set.alias("feature_set"),
        *[F.coalesce(F.try_element_at("params", F.lit(p)), F.lit(UNKNOWN)).alias(p) for p in COPIED_PARAMS],
        first_key("params", SELECTED_KEYS).alias("num_selected_features"),
        first_key("params", EXPECTED_KEYS).alias("n_features_selected"),
        *[first_key("metrics", keys).alias(name) for name, keys in METRIC_KEYS.items()],
        first_key_name("metrics", METRIC_KEYS["test_mape"]).alias("test_mape_source"),
        "params",
        "tags",
        "metrics",
    )


def finished_best(runs: DataFrame) -> DataFrame:
    """Flat rows of the finished runs tagged as best. The filters apply before flattening."""
    return flatten_runs(with_tag(runs, "run_type", BEST_RUN).where(F.col("status") == "FINISHED"))


def feature_mismatch(flat: DataFrame) -> DataFrame:
    """Selected minus expected feature count, and whether they agree; null if either is no number."""
    gap = F.col("num_selected_features").try_cast("int") - F.col("n_features_selected").try_cast("int")
    return flat.withColumns({"feature_mismatch": gap, "feature_count_match": gap == 0})


def best_per_group(
    flat: DataFrame, metric: str, maximize: bool = False, group: Sequence[str] = ("model_name", "feature_set")
) -> DataFrame:
    """The run with the best metric of every group; equal metrics go to the lower run id."""
    scored = flat.where(F.col(metric).isNotNull())
    order = -F.col(metric) if maximize else F.col(metric)
    return first_by(scored, list(group), [order, "run_id"])


def latest_per_group(flat: DataFrame, group: Sequence[str] = ("model_name", "feature_set")) -> DataFrame:
    """The most recently started run of every group; equal starts go to the lower run id.

    A run without start time comes after all that have one.
    """
    age = F.expr("-timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', start_time)")
    return first_by(flat, list(group), [age.isNull(), age, "run_id"])


SUMMARY_GROUP = ["model_name", "feature_set", "n_trials_optuna", "tuning_scoring_metric"]


def run_summary(runs: DataFrame) -> DataFrame:
    """Latest best run per model, feature set, trial count and metric, with feature-count check."""
    latest = latest_per_group(finished_best(runs), SUMMARY_GROUP)
    combination = F.concat_ws("_", *SUMMARY_GROUP)
    return feature_mismatch(latest).withColumn("model_feature_combination", combination)


def summary_order(summary: DataFrame, n: int | None = None, best_first: bool = True) -> DataFrame:
    """Sort by test score, or by train score if no row has a test score; unscored rows last.

    The scores are errors, so the best come first in ascending order; ``best_first=False`` gives
    the descending order.
    """
    known = summary.agg(F.count("test_score").alias("n"))
    score = F.when(F.col("_k.n") > 0, F.col("test_score")).otherwise(F.col("train_score"))
    order = score.asc_nulls_last() if best_first else score.desc_nulls_last()
    ordered = with_row(summary, known, "_k").orderBy(order, "run_id").drop("_k")
    return ordered if n is None else ordered.limit(n)


def round_half_even(value: Column, digits: int) -> Column:
    """Round the scaled value to the nearest whole, ties to even."""
    return F.rint(value * 10.0**digits) / 10.0**digits


def score_stats(summary: DataFrame, by: str) -> DataFrame:
    """Count, mean, sample deviation, best and worst of the scores per ``by``, to 4 places."""
    r = lambda c: round_half_even(c, 4)
    return summary.groupBy(by).agg(
        F.count("test_score").alias("test_score_count"),
        r(F.avg("test_score")).alias("test_score_mean"),
        r(F.stddev_samp("test_score")).alias("test_score_std"),
        r(F.max("test_score")).alias("test_score_max"),
        r(F.min("test_score")).alias("test_score_min"),
        r(F.avg("test_mape")).alias("test_mape_mean"),
        r(F.stddev_samp("test_mape")).alias("test_mape_std"),
        r(F.min("test_mape")).alias("test_mape_min"),
    )


def run_distincts(summary: DataFrame) -> DataFrame:
    return summary.agg(
        F.count_distinct("model_name").alias("unique_models"),
        F.count_distinct("feature_set").alias("unique_feature_sets"),
        F.count_distinct("experiment_name").alias("unique_experiments"),
    )


def metric_availability(runs: DataFrame) -> DataFrame:
    """Number of runs per metric key."""
    return (
        runs.select(F.explode(F.map_keys("metrics")).alias("metric"))
        .groupBy("metric")
        .agg(F.count(F.lit(1)).alias("runs"))
    )


def with_version(summary: DataFrame) -> DataFrame:
    """Version from the run name and the short feature-set label."""
    return summary.withColumns(
        {
            "version": run_version(F.col("run_name")),
            "feature_set_short": short_feature_set(F.col("feature_set")),
            "feature_count_match": F.coalesce("feature_count_match", F.lit(False)),
        }
    )


def filter_summary(
    summary: DataFrame,
    trials: Sequence[str] | None = None,
    metric: str | None = None,
    version: int | None = None,
    without: str | None = None,
    without_pattern: str | None = None,
    ended_since: str | None = None,
) -> DataFrame:
    """Rows that meet every given condition; an unknown value meets none."""
    tests = []
    if trials is not None:
        tests.append(F.col("n_trials_optuna").isin(list(trials)))
    if metric is not None:
        tests.append(F.col("tuning_scoring_metric") == metric)
    if version is not None:
        tests.append(F.col("version") == version)
    if without is not None:
        tests.append(~F.col("feature_set_short").contains(without))
    if without_pattern is not None:
        tests.append(~F.col("feature_set_short").rlike(without_pattern))
    if ended_since is not None:
        tests.append(F.col("end_time") >= F.lit(ended_since).cast("timestamp_ntz"))
    for test in tests:
        summary = summary.where(F.coalesce(test, F.lit(False)))
    return summary


def dedup_last(summary: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The row of every key that comes last in descending ``order`` with nulls last.

    That is the smallest one with nulls first. Equal rows go to the lower run id.
    """
    return first_by(summary, list(keys), [*order, "run_id"])


def pivot_min(
    summary: DataFrame, index: Sequence[str], columns: str, values: Sequence[str], metric: str, digits: int, scale: float = 1.0
) -> DataFrame:
    """Smallest metric per index and column value, in the given column order."""
    wide = summary.groupBy(*index).pivot(columns, list(values)).agg(F.min(metric))
    return wide.select(*index, *[(round_half_even(F.col(f"`{v}`"), digits) * scale).alias(v) for v in values])


def top_by_metric(summary: DataFrame, metric: str, n: int = 10) -> DataFrame:
    return summary.orderBy(F.col(metric).asc_nulls_last(), "run_id").limit(n)


def nested_report(summary: DataFrame) -> DataFrame:
    """One nested record per summary row."""
    pick = lambda *cols: F.struct(*cols)
    return summary.select(
        "model_feature_combination",
        pick(
            "run_id", "run_name", "experiment_name", "model_name", "feature_set", "run_type", "start_time", "end_time", "status"
        ).alias("basic_info"),
        pick(*METRIC_KEYS).alias("performance_metrics"),
        F.col("params").alias("hyperparameters"),
        "tags",
        F.col("metrics").alias("all_metrics"),
        pick(*COPIED_PARAMS).alias("training_config"),
        pick("num_selected_features", "n_features_selected", "feature_mismatch").alias("feature_selection_info"),
    )


def run_labels(runs: DataFrame) -> DataFrame:
    """Approach, image use, image method and direction of a run from its feature-set parameters."""
    flag = lambda k: F.coalesce(F.lower(F.try_element_at("params", F.lit(f"fs_meta_{k}"))) == "true", F.lit(False))
    images = flag("should_include_images")
    method = (
        F.when(flag("apply_umap_img_transform"), "umap")
        .when(flag("apply_pca_img_transform"), "pca")
        .otherwise("none")
    )
    metric = F.try_element_at("params", F.lit("tuning_scoring_metric"))
    return runs.select(
        "run_id",
        F.when(flag("images_handled_separately"), "new").otherwise("legacy").alias("approach_type"),
        images.alias("includes_images"),
        F.when(images, method).alias("image_method"),
        F.when(metric.isin("mape", "rmse"), "minimize").otherwise("maximize").alias("direction"),
    )
