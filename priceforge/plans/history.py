"""Queries over runs, trials and feature sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from priceforge.functions.columns import FAMILY_PARTS, CATEGORY_RULES, OTHER_CATEGORY, feature_category as category_of, in_family
from priceforge.functions.names import run_version as version_of, study_short_name as short_name, typed_param
from priceforge.operators import featuresets as fs
from priceforge.operators import runs as ops
from priceforge.operators import trials as tr
from priceforge.plans import fixtures as fx
from priceforge.plans.registry import query, rounded

LOOKUP_NAME = "LightGBM_rfecv_base_nfeat_8_pca_mape_v8_BEST"
SHORT_SETS = [f"fs_{k}" for k in range(11)] + ["fs_11_umap"]
CUTOFF = "2024-01-10 00:00:00"


@query("runs_best_tag", "SELECT run_id, run_name, status FROM runs WHERE run_type = 'best_run'", ("runs",))
def runs_best_tag(spark, sf_dir):
    return ops.with_tag(fx.runs(spark, sf_dir), "run_type", "best_run").select("run_id", "run_name", "status")


@query(
    "run_lookup_by_name",
    f"""SELECT run_id, run_name, m_test_final_mape AS test_final_mape FROM runs WHERE run_name = '{LOOKUP_NAME}'
    ORDER BY m_test_final_mape ASC NULLS LAST, run_id LIMIT 1""",
    ("runs",),
)
def run_lookup_by_name(spark, sf_dir):
    run = ops.lookup_by_name(fx.runs(spark, sf_dir), LOOKUP_NAME, "test_final_mape")
    return run.select("run_id", "run_name", F.try_element_at("metrics", F.lit("test_final_mape")).alias("test_final_mape"))


@query("run_version", "SELECT run_id, CAST(nullif(regexp_extract(run_name, 'v(\\d+)', 1), '') AS INTEGER) AS version FROM runs", ("runs",))
def run_version(spark, sf_dir):
    return fx.runs(spark, sf_dir).select("run_id", version_of(F.col("run_name")).alias("version"))


@query(
    "run_metrics_flat",
    """SELECT run_id, train_mape AS train_score, test_mape AS test_score, train_mape, test_mape,
      CAST(NULL AS DOUBLE) AS train_rmse, test_rmse, CAST(NULL AS DOUBLE) AS train_r2, round(test_r2, 6) AS test_r2,
      m_best_optuna_cv_mape AS cv_mape, tuning_duration, CAST(NULL AS DOUBLE) AS total_duration, test_mape_source
    FROM runs""",
    ("runs",),
)
def run_metrics_flat(spark, sf_dir):
    flat = ops.flatten_runs(fx.runs(spark, sf_dir))
    return rounded(flat.select("run_id", *ops.METRIC_KEYS, "test_mape_source"), 6, "test_r2")


@query("run_model_name", "SELECT run_id, model_name FROM runs", ("runs",))
def run_model_name(spark, sf_dir):
    return fx.runs(spark, sf_dir).select("run_id", ops.model_name().alias("model_name"))


@query(
    "runs_flat",
    """SELECT run_id, experiment_name, run_name, status, start_time, end_time, run_type, model_name, feature_set,
      coalesce(p_cv_folds, 'Unknown') AS cv_folds, 'Unknown' AS random_state, n_trials_optuna, tuning_scoring_metric
    FROM runs WHERE status = 'FINISHED'""",
    ("runs",),
)
def runs_flat(spark, sf_dir):
    flat = ops.flatten_runs(fx.runs(spark, sf_dir).where(F.col("status") == "FINISHED"))
    return flat.select(
        "run_id", "experiment_name", "run_name", "status", "start_time", "end_time", "run_type", "model_name",
        "feature_set", "cv_folds", "random_state", "n_trials_optuna", "tuning_scoring_metric",
    )


@query(
    "feature_mismatch",
    """SELECT run_id, num_selected_features, n_features_selected,
      TRY_CAST(num_selected_features AS INTEGER) - TRY_CAST(n_features_selected AS INTEGER) AS feature_mismatch,
      TRY_CAST(num_selected_features AS INTEGER) = TRY_CAST(n_features_selected AS INTEGER) AS feature_count_match
    FROM runs""",
    ("runs",),
)
def feature_mismatch(spark, sf_dir):
    flat = ops.flatten_runs(fx.runs(spark, sf_dir))
    return ops.feature_mismatch(flat).select(
        "run_id", "num_selected_features", "n_features_selected", "feature_mismatch", "feature_count_match"
    )


@query(
    "mismatch_runs",
    """SELECT run_id, feature_set, feature_mismatch FROM summary WHERE feature_mismatch IS DISTINCT FROM 0""",
    ("summary",),
)
def mismatch_runs(spark, sf_dir):
    summary = ops.run_summary(fx.runs(spark, sf_dir))
    return summary.where(~F.col("feature_mismatch").eqNullSafe(0)).select("run_id", "feature_set", "feature_mismatch")


@query(
    "run_labels",
    """SELECT run_id, CASE WHEN user_id % 2 = 0 THEN 'new' ELSE 'legacy' END AS approach_type,
      user_id % 3 = 0 AS includes_images,
      CASE WHEN user_id % 3 = 0 THEN CASE WHEN user_id % 9 = 0 THEN 'umap' WHEN user_id % 6 = 0 THEN 'pca' ELSE 'none' END END AS image_method,
      'minimize' AS direction FROM runs""",
    ("runs",),
)
def run_labels(spark, sf_dir):
    return ops.run_labels(fx.runs(spark, sf_dir))


@query(
    "param_types",
    """SELECT run_id, param, kind, int_value, double_value, bool_value, text_value FROM (
      SELECT run_id, 'learning_rate' AS param, 'double' AS kind, CAST(NULL AS BIGINT) AS int_value,
        value AS double_value, CAST(NULL AS BOOLEAN) AS bool_value, CAST(NULL AS VARCHAR) AS text_value FROM runs
      UNION ALL SELECT run_id, 'tolerance', CASE WHEN p_tolerance = 'true' THEN 'bool' ELSE 'double' END, NULL,
        TRY_CAST(p_tolerance AS DOUBLE), CASE WHEN p_tolerance = 'true' THEN true END, NULL FROM runs
      UNION ALL SELECT run_id, 'n_trials_optuna', 'int', CAST(n_trials_optuna AS BIGINT), NULL, NULL, NULL FROM runs
      UNION ALL SELECT run_id, 'n_features_selected', CASE WHEN n_features_selected = 'n/a' THEN 'text' ELSE 'int' END,
        TRY_CAST(n_features_selected AS BIGINT), NULL, NULL, CASE WHEN n_features_selected = 'n/a' THEN 'n/a' END FROM runs
      UNION ALL SELECT run_id, 'fs_meta_should_include_images', 'bool', NULL, NULL, user_id % 3 = 0, NULL FROM runs
      UNION ALL SELECT run_id, 'tuning_scoring_metric', 'text', NULL, NULL, NULL, tuning_scoring_metric FROM runs)""",
    ("runs",),
)
def param_types(spark, sf_dir):
    typed = [
        "learning_rate", "tolerance", "n_trials_optuna", "n_features_selected", "fs_meta_should_include_images",
        "tuning_scoring_metric",
    ]
    cells = fx.runs(spark, sf_dir).select("run_id", F.explode("params").alias("param", "raw"))
    return cells.where(F.col("param").isin(typed)).select("run_id", "param", F.inline(F.array(typed_param(F.col("raw")))))


@query(
    "best_run_per_group",
    """SELECT model_name, feature_set, run_id, test_mape FROM (SELECT *, row_number() OVER (
        PARTITION BY model_name, feature_set ORDER BY test_mape, run_id) AS rn FROM runs
      WHERE status = 'FINISHED' AND test_mape IS NOT NULL) WHERE rn = 1""",
    ("runs",),
)
def best_run_per_group(spark, sf_dir):
    flat = ops.flatten_runs(fx.runs(spark, sf_dir).where(F.col("status") == "FINISHED"))
    return ops.best_per_group(flat, "test_mape").select("model_name", "feature_set", "run_id", "test_mape")


@query(
    "latest_run_per_group",
    """SELECT model_name, feature_set, run_id, start_time FROM (SELECT *, row_number() OVER (
        PARTITION BY model_name, feature_set ORDER BY start_time DESC, run_id) AS rn FROM finished) WHERE rn = 1""",
    ("finished",),
)
def latest_run_per_group(spark, sf_dir):
    flat = ops.finished_best(fx.runs(spark, sf_dir))
    return ops.latest_per_group(flat).select("model_name", "feature_set", "run_id", "start_time")


@query(
    "latest_run_per_group4",
    "SELECT model_name, feature_set, n_trials_optuna, tuning_scoring_metric, run_id, test_mape FROM summary",
    ("summary",),
)
def latest_run_per_group4(spark, sf_dir):
    flat = ops.finished_best(fx.runs(spark, sf_dir))
    return ops.latest_per_group(flat, ops.SUMMARY_GROUP).select(*ops.SUMMARY_GROUP, "run_id", "test_mape")


@query(
    "summary_top_n",
    """SELECT run_id, model_name, feature_set, test_mape AS test_score FROM summary
    ORDER BY test_mape ASC NULLS LAST, run_id LIMIT 15""",
    ("summary",),
)
def summary_top_n(spark, sf_dir):
    top = ops.summary_order(ops.run_summary(fx.runs(spark, sf_dir)), 15)
    return top.select("run_id", "model_name", "feature_set", "test_score")


def _stats_sql(by: str) -> str:
    score = "round_even({}(test_mape) * 10000::DOUBLE, 0) / 10000::DOUBLE AS {}"
    parts = [("avg", "mean"), ("stddev_samp", "std"), ("max", "max"), ("min", "min")]
    cells = [score.format(f, f"test_score_{n}") for f, n in parts]
    cells += [score.format(f, f"test_mape_{n}") for f, n in parts if n != "max"]
    return f"SELECT {by}, count(test_mape) AS test_score_count, {', '.join(cells)} FROM summary GROUP BY {by}"


@query("model_stats", _stats_sql("model_name"), ("summary",))
def model_stats(spark, sf_dir):
    return ops.score_stats(ops.run_summary(fx.runs(spark, sf_dir)), "model_name")


@query("feature_set_stats", _stats_sql("feature_set"), ("summary",))
def feature_set_stats(spark, sf_dir):
    return ops.score_stats(ops.run_summary(fx.runs(spark, sf_dir)), "feature_set")


@query(
    "run_distincts",
    """SELECT count(DISTINCT model_name) AS unique_models, count(DISTINCT feature_set) AS unique_feature_sets,
      count(DISTINCT experiment_name) AS unique_experiments FROM summary""",
    ("summary",),
)
def run_distincts(spark, sf_dir):
    return ops.run_distincts(ops.run_summary(fx.runs(spark, sf_dir)))


@query(
    "metric_availability",
    " UNION ALL ".join(
        f"SELECT '{name}' AS metric, count({column}) AS runs FROM runs"
        for name, column in [
            ("test_final_mape", "m_test_final_mape"),
            ("best_optuna_cv_mape", "m_best_optuna_cv_mape"),
            ("train_final_mape", "train_mape"),
            ("test_final_rmse", "test_rmse"),
            ("test_final_r2", "test_r2"),
            ("tuning_duration_sec", "tuning_duration"),
        ]
    ),
    ("runs",),
)
def metric_availability(spark, sf_dir):
    return ops.metric_availability(fx.runs(spark, sf_dir))


@query(
    "run_report_nested",
    """SELECT model_feature_combination, run_id, start_time, test_mape, test_rmse, n_trials_optuna, tuning_scoring_metric,
      feature_mismatch, p_learning_rate AS learning_rate, run_type FROM summary""",
    ("summary",),
)
def run_report_nested(spark, sf_dir):
    report = ops.nested_report(ops.run_summary(fx.runs(spark, sf_dir)))
    return report.select(
        "model_feature_combination",
        "basic_info.run_id",
        "basic_info.start_time",
        "performance_metrics.test_mape",
        "performance_metrics.test_rmse",
        "training_config.n_trials_optuna",
        "training_config.tuning_scoring_metric",
        "feature_selection_info.feature_mismatch",
        F.try_element_at("hyperparameters", F.lit("learning_rate")).alias("learning_rate"),
        F.try_element_at("tags", F.lit("run_type")).alias("run_type"),
    )


@query(
    "union_summaries",
    """SELECT run_id, model_feature_combination, train_mape, CAST(NULL AS DOUBLE) AS test_rmse FROM summary
      WHERE tuning_scoring_metric = 'mape'
    UNION ALL SELECT run_id, model_feature_combination, NULL, test_rmse FROM summary WHERE tuning_scoring_metric = 'rmse'""",
    ("summary",),
)
def union_summaries(spark, sf_dir):
    summary = ops.run_summary(fx.runs(spark, sf_dir))
    by_mape = summary.where("tuning_scoring_metric = 'mape'").select("run_id", "model_feature_combination", "train_mape")
    by_rmse = summary.where("tuning_scoring_metric = 'rmse'").select("run_id", "model_feature_combination", "test_rmse")
    return by_mape.unionByName(by_rmse, allowMissingColumns=True)


@query(
    "run_filters",
    f"""SELECT run_id, feature_set_short, version, feature_count_match FROM (
      SELECT run_id, feature_set_short, version, coalesce(feature_count_match, false) AS feature_count_match FROM summary
      WHERE n_trials_optuna IN ('100') AND tuning_scoring_metric = 'mape' AND version = 8
        AND feature_set_short NOT LIKE '%umap%' AND NOT regexp_matches(feature_set_short, 'fs_2|fs_5')
        AND end_time >= TIMESTAMP '{CUTOFF}')""",
    ("summary",),
)
def run_filters(spark, sf_dir):
    summary = ops.with_version(ops.run_summary(fx.runs(spark, sf_dir)))
    kept = ops.filter_summary(
        summary, trials=["100"], metric="mape", version=8, without="umap", without_pattern="fs_2|fs_5", ended_since=CUTOFF
    )
    return kept.select("run_id", "feature_set_short", "version", "feature_count_match")


@query(
    "dedup_last",
    """SELECT run_id, model_feature_combination, version, run_name, test_mape FROM (
      SELECT *, row_number() OVER (PARTITION BY combo, version, run_name, tuning_scoring_metric
        ORDER BY feature_set ASC NULLS FIRST, combo ASC NULLS FIRST, tuning_scoring_metric ASC NULLS FIRST,
          test_mape ASC NULLS FIRST, run_id) AS rn
      FROM (SELECT *, model_name || '_' || feature_set AS combo, model_name || '_' || feature_set AS model_feature_combination,
        CAST(nullif(regexp_extract(run_name, 'v(\\d+)', 1), '') AS INTEGER) AS version FROM finished)) WHERE rn = 1""",
    ("finished",),
)
def dedup_last(spark, sf_dir):
    flat = ops.finished_best(fx.runs(spark, sf_dir)).withColumns(
        {
            "model_feature_combination": F.concat_ws("_", "model_name", "feature_set"),
            "version": version_of(F.col("run_name")),
        }
    )
    flat = flat.drop("params", "tags", "metrics")
    last = ops.dedup_last(
        flat,
        ["model_feature_combination", "version", "run_name", "tuning_scoring_metric"],
        ["feature_set", "model_feature_combination", "tuning_scoring_metric", "test_mape"],
    )
    return last.select("run_id", "model_feature_combination", "version", "run_name", "test_mape")


@query(
    "top10_by_metric",
    """SELECT run_id, model_name, test_mape, test_rmse, ranking FROM (
      SELECT *, 'mape' AS ranking, row_number() OVER (ORDER BY test_mape ASC NULLS LAST, run_id) AS place FROM summary
      UNION ALL SELECT *, 'rmse', row_number() OVER (ORDER BY test_rmse ASC NULLS LAST, run_id) FROM summary) WHERE place <= 10""",
    ("summary",),
)
def top10_by_metric(spark, sf_dir):
    summary = ops.run_summary(fx.runs(spark, sf_dir)).select("run_id", "model_name", "test_mape", "test_rmse")
    tops = [ops.top_by_metric(summary, f"test_{m}").withColumn("ranking", F.lit(m)) for m in ("mape", "rmse")]
    return tops[0].unionByName(tops[1])


def _pivot_sql(index: str, metric: str, digits: int) -> str:
    cells = ", ".join(f"round_even(min(CASE WHEN feature_set_short = '{s}' THEN {metric} END) * {10**digits}::DOUBLE, 0) / {10**digits}::DOUBLE AS {s}" for s in SHORT_SETS)
    return f"SELECT {index}, {cells} FROM summary GROUP BY {index}"


@query("pivot_min_metric", _pivot_sql("model_name", "test_rmse", 1), ("summary",))
def pivot_min_metric(spark, sf_dir):
    summary = ops.with_version(ops.run_summary(fx.runs(spark, sf_dir)))
    return ops.pivot_min(summary, ["model_name"], "feature_set_short", SHORT_SETS, "test_rmse", 1)


@query("pivot_min_multi", _pivot_sql("n_trials_optuna, model_name, version", "test_mape", 4), ("summary",))
def pivot_min_multi(spark, sf_dir):
    summary = ops.with_version(ops.run_summary(fx.runs(spark, sf_dir)))
    index = ["n_trials_optuna", "model_name", "version"]
    return ops.pivot_min(summary, index, "feature_set_short", SHORT_SETS, "test_mape", 4)


@query(
    "study_filter",
    """SELECT DISTINCT study FROM studies WHERE contains(study, 'LightGBM') AND contains(study, 'v8') ORDER BY study DESC LIMIT 8""",
    ("studies",),
)
def study_filter(spark, sf_dir):
    return tr.study_filter(fx.named_trials(spark, sf_dir), "LightGBM", "v8")


@query(
    "study_short_name",
    """SELECT DISTINCT study, CASE WHEN user_id % 11 <> 0 THEN split_part(study, '_', 1) || ' base_poi ' || (user_id % 12)
      || ' pca v' || (user_id % 3 + 6) END AS short_name FROM studies""",
    ("studies",),
)
def study_short_name(spark, sf_dir):
    studies = fx.named_trials(spark, sf_dir).select("study").distinct()
    return studies.select("study", short_name(F.col("study")).alias("short_name"))


@query(
    "running_best",
    """SELECT study, number, value, min(value) OVER (PARTITION BY study ORDER BY number
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS best_value FROM trials WHERE value IS NOT NULL""",
    ("trials",),
)
def running_best(spark, sf_dir):
    return tr.running_best(fx.trials(spark, sf_dir)).select("study", "number", "value", "best_value")


@query(
    "convergence_trial",
    """SELECT study, round(min(best), 6) AS best_value, round(min(best) * 1.025::DOUBLE, 6) AS threshold, count(*) AS n_values,
      min(CASE WHEN value <= best * 1.025::DOUBLE THEN pos END) AS convergence_trial
    FROM (SELECT study, value, min(value) OVER (PARTITION BY study) AS best,
        row_number() OVER (PARTITION BY study ORDER BY number) - 1 AS pos FROM trials WHERE value IS NOT NULL)
    GROUP BY study HAVING count(*) >= 10 AND min(best) BETWEEN 0 AND 100""",
    ("trials",),
)
def convergence_trial(spark, sf_dir):
    found = tr.convergence(fx.trials(spark, sf_dir))
    found = found.select("study", "best_value", "threshold", "n_values", "convergence_trial")
    return rounded(found, 6, "best_value", "threshold")


@query("best_trial", "SELECT study, number, value, k, booster FROM trial_best", ("trial_best",))
def best_trial(spark, sf_dir):
    params = lambda p: F.try_element_at("params", F.lit(p)).alias(p)
    return tr.best_trial(fx.trials(spark, sf_dir)).select("study", "number", "value", params("k"), params("booster"))


@query(
    "trial_slices",
    """SELECT study, number, 'k' AS param, k AS param_value, value FROM trials WHERE value IS NOT NULL AND k IS NOT NULL
    UNION ALL SELECT study, number, 'booster', booster, value FROM trials WHERE value IS NOT NULL""",
    ("trials",),
)
def trial_slices(spark, sf_dir):
    return tr.trial_slices(fx.trials(spark, sf_dir))


@query(
    "param_range",
    """SELECT study, 'k' AS param, 'numeric' AS kind, min(CAST(k AS DOUBLE)) AS min_value, max(CAST(k AS DOUBLE)) AS max_value,
      count(DISTINCT k) AS n_values FROM trials WHERE k IS NOT NULL GROUP BY study
    UNION ALL SELECT study, 'booster', 'categorical', NULL, NULL, count(DISTINCT booster) FROM trials GROUP BY study""",
    ("trials",),
)
def param_range(spark, sf_dir):
    return tr.param_range(fx.trials(spark, sf_dir))


@query(
    "param_near_bound",
    """SELECT study, 'k' AS param, lo AS min_value, hi AS max_value, best AS best_value,
      CASE WHEN abs(best - lo) < 0.05::DOUBLE * (hi - lo) THEN 'lower' ELSE 'upper' END AS bound
    FROM (SELECT study, min(CAST(k AS DOUBLE)) AS lo, max(CAST(k AS DOUBLE)) AS hi FROM trials GROUP BY study)
    JOIN (SELECT study, CAST(k AS DOUBLE) AS best FROM trial_best) USING (study)
    WHERE hi > lo AND (abs(best - lo) < 0.05::DOUBLE * (hi - lo) OR abs(best - hi) < 0.05::DOUBLE * (hi - lo))""",
    ("trials", "trial_best"),
)
def param_near_bound(spark, sf_dir):
    return tr.param_near_bound(fx.trials(spark, sf_dir))


def _family_sql(family: str) -> str:
    tests = [f"contains(feature, '{p}')" for f, parts in FAMILY_PARTS.items() for p in parts if family in (f, "base")]
    joined = " OR ".join(tests)
    return f"NOT ({joined})" if family == "base" else joined


@query(
    "feature_family",
    "SELECT feature, " + ", ".join(f"({_family_sql(f)}) AS in_{f}" for f in ("base", "img", "poi", "pano")) + " FROM feature_names",
    ("feature_names",),
)
def feature_family(spark, sf_dir):
    name = F.col("feature")
    return fx.feature_names(spark, sf_dir).select(
        "feature", *[in_family(name, f).alias(f"in_{f}") for f in ("base", "img", "poi", "pano")]
    )


def category_sql(column: str) -> str:
    lowered = f"lower({column})"
    test = {
        "is": lambda w: f"{lowered} = '{w}'",
        "starts": lambda w: f"starts_with({lowered}, '{w}')",
        "contains": lambda w: f"contains({lowered}, '{w}')",
    }
    whens = [f"WHEN {' OR '.join(test[kind](w) for w in words)} THEN '{label}'" for label, kind, words in CATEGORY_RULES]
    return f"CASE {' '.join(whens)} ELSE '{OTHER_CATEGORY}' END"


@query("feature_category", f"SELECT feature, {category_sql('feature')} AS category FROM feature_names", ("feature_names",))
def feature_category(spark, sf_dir):
    return fx.feature_names(spark, sf_dir).withColumn("category", category_of(F.col("feature")))


@query(
    "feature_matrix",
    "SELECT feature, "
    + ", ".join(f"CAST(max(CASE WHEN set_name = '{s}' THEN 1 ELSE 0 END) AS INTEGER) AS {s}" for s in fx.SEGMENTS)
    + " FROM members GROUP BY feature",
    ("members",),
)
def feature_matrix(spark, sf_dir):
    return fs.feature_matrix(fx.feature_members(spark, sf_dir), fx.SEGMENTS)


_USED = "(SELECT feature, count(DISTINCT set_name) AS n_sets, min(set_name) AS set_name FROM members GROUP BY feature)"


@query(
    "feature_usage",
    f"""SELECT count(*) AS n_features,
      count(CASE WHEN n_sets = (SELECT count(DISTINCT set_name) FROM members) THEN 1 END) AS in_all,
      count(CASE WHEN n_sets = 1 THEN 1 END) AS in_one,
      count(CASE WHEN n_sets BETWEEN 2 AND 3 THEN 1 END) AS in_two_or_three FROM {_USED}""",
    ("members",),
)
def feature_usage(spark, sf_dir):
    return fs.feature_usage(fx.feature_members(spark, sf_dir))


@query("feature_unique", f"SELECT set_name, feature FROM {_USED} WHERE n_sets = 1", ("members",))
def feature_unique(spark, sf_dir):
    return fs.feature_unique(fx.feature_members(spark, sf_dir))


@query("feature_union", "SELECT DISTINCT feature FROM members", ("members",))
def feature_union(spark, sf_dir):
    return fs.feature_union(fx.feature_members(spark, sf_dir))


@query(
    "feature_set_diff",
    """SELECT feature, CASE WHEN bool_or(set_name = 'BUILDING') AND bool_or(set_name = 'MACHINERY') THEN 'both'
      WHEN bool_or(set_name = 'BUILDING') THEN 'left' ELSE 'right' END AS side
    FROM members WHERE set_name IN ('BUILDING', 'MACHINERY') GROUP BY feature""",
    ("members",),
)
def feature_set_diff(spark, sf_dir):
    return fs.feature_set_diff(fx.feature_members(spark, sf_dir), "BUILDING", "MACHINERY")


_USAGE = (
    f"SELECT {category_sql('feature')} AS category, "
    + ", ".join(f"count(CASE WHEN set_name = '{s}' THEN 1 END) AS {s}" for s in fx.SEGMENTS)
    + " FROM members GROUP BY 1"
)


@query("category_usage", _USAGE, ("members",))
def category_usage(spark, sf_dir):
    return fs.category_usage(fx.feature_members(spark, sf_dir), fx.SEGMENTS)


@query(
    "category_usage_norm",
    "SELECT category, "
    + ", ".join(f"round(CAST({s} AS DOUBLE) / nullif(greatest({', '.join(fx.SEGMENTS)}), 0), 6) AS {s}" for s in fx.SEGMENTS)
    + f" FROM ({_USAGE})",
    ("members",),
)
def category_usage_norm(spark, sf_dir):
    usage = fs.category_usage(fx.feature_members(spark, sf_dir), fx.SEGMENTS)
    return rounded(fs.category_usage_norm(usage, fx.SEGMENTS), 6, *fx.SEGMENTS)
