"""Queries over fitted preparation steps and evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from priceforge.operators import evaluate as ev
from priceforge.operators import images, impute, scale
from priceforge.operators.encode import MIN_SHARE, RARE, RareOneHot
from priceforge.operators.gram import gram_stats as gram
from priceforge.operators.joins import first_by
from priceforge.operators.ordinal import kfold
from priceforge.operators.prepare import combine_features
from priceforge.plans import fixtures as fx
from priceforge.plans.listings import derived
from priceforge.plans.registry import query, rounded
from priceforge.session import materialize

IMPUTED = ["building_floors_num", "building_age", "floor_ratio", "floor_number"]
SCALED = ["area_m2", "price_per_m2", "room_size_m2"]
ENCODED = ["heating", "building_type", "neighborhood", "district"]
GRAM = ["area_m2", "distance_to_center_km", "room_size_m2"]
IMAGE_WIDTH = 64
COMBINED = ["kitchen", "bedroom"]


def _table(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return materialize(derived(spark, sf_dir).select("id", *columns))


_MEDIANS = "SELECT district, " + ", ".join(f"quantile_cont({c}, 0.5) AS {c}" for c in IMPUTED) + " FROM derived GROUP BY district"


@query(
    "group_medians",
    "SELECT district, " + ", ".join(f"round({c}, 6) AS {c}" for c in IMPUTED) + f" FROM ({_MEDIANS})",
    ("derived",),
)
def group_medians(spark, sf_dir):
    df = _table(spark, sf_dir, "district", *IMPUTED)
    return rounded(impute.group_medians(df, "district", IMPUTED), 6, *IMPUTED)


@query(
    "grouped_median_impute",
    "SELECT id, d.district, "
    + ", ".join(f"round(coalesce(d.{c}, m.{c}, o.{c}), 6) AS {c}" for c in IMPUTED)
    + f" FROM derived d LEFT JOIN ({_MEDIANS}) m ON d.district = m.district, (SELECT "
    + ", ".join(f"quantile_cont({c}, 0.5) AS {c}" for c in IMPUTED)
    + f" FROM ({_MEDIANS})) o",
    ("derived",),
)
def grouped_median_impute(spark, sf_dir):
    df = _table(spark, sf_dir, "district", *IMPUTED)
    model = impute.GroupedMedianImputer("district", IMPUTED).fit(df)
    return rounded(model.transform(df), 6, *IMPUTED)


@query(
    "median_impute",
    "SELECT id, "
    + ", ".join(f"round(coalesce(d.{c}, o.{c}), 6) AS {c}" for c in IMPUTED)
    + " FROM derived d, (SELECT "
    + ", ".join(f"quantile_cont({c}, 0.5) AS {c}" for c in IMPUTED)
    + " FROM derived) o",
    ("derived",),
)
def median_impute(spark, sf_dir):
    return rounded(impute.median_impute(_table(spark, sf_dir, *IMPUTED), IMPUTED), 6, *IMPUTED)


@query(
    "robust_scale",
    "SELECT id, "
    + ", ".join(f"round((d.{c} - {c}_2) / CASE WHEN {c}_3 = {c}_1 THEN 1 ELSE {c}_3 - {c}_1 END, 6) AS {c}" for c in SCALED)
    + " FROM derived d, (SELECT "
    + ", ".join(f"quantile_cont({c}, {k / 4}) AS {c}_{k}" for c in SCALED for k in (1, 2, 3))
    + " FROM derived)",
    ("derived",),
)
def robust_scale(spark, sf_dir):
    return rounded(scale.robust_scale(_table(spark, sf_dir, *SCALED), SCALED), 6, *SCALED)


@query(
    "standard_scale",
    "SELECT id, "
    + ", ".join(f"round((d.{c} - {c}_m) / {c}_s, 6) AS {c}" for c in SCALED)
    + " FROM derived d, (SELECT "
    + ", ".join(f"avg({c}) AS {c}_m, stddev_pop({c}) AS {c}_s" for c in SCALED)
    + " FROM derived)",
    ("derived",),
)
def standard_scale(spark, sf_dir):
    return rounded(scale.standard_scale(_table(spark, sf_dir, *SCALED), SCALED), 6, *SCALED)


def _yj_sql(x: str, lam: float) -> str:
    up = f"ln(1 + {x})" if lam == 0 else f"(pow({x} + 1, {lam}::DOUBLE) - 1) / {lam}::DOUBLE"
    down = f"-ln(1 - {x})" if lam == 2 else f"-(pow(1 - {x}, {2 - lam}::DOUBLE) - 1) / {2 - lam}::DOUBLE"
    return f"CASE WHEN {x} >= 0 THEN {up} WHEN {x} < 0 THEN {down} END"


_SHIFTED = {"half": 0.5, "zero": 0.0, "two": 2.0, "minus": -0.7}


@query(
    "yeo_johnson",
    "SELECT id, "
    + ", ".join(f"round({_yj_sql('x', lam)}, 6) AS {name}" for name, lam in _SHIFTED.items())
    + " FROM (SELECT id, (room_size_m2 - 25) / 10 AS x FROM derived)",
    ("derived",),
)
def yeo_johnson(spark, sf_dir):
    x = (F.col("room_size_m2") - 25) / 10
    df = derived(spark, sf_dir).select("id", x.alias("x"))
    moved = df.select("id", *[scale.yeo_johnson(F.col("x"), lam).alias(n) for n, lam in _SHIFTED.items()])
    return rounded(moved, 6, *_SHIFTED)


@query("yeo_johnson_fit")
def yeo_johnson_fit(spark, sf_dir):
    """Rows after fitting the exponents and standardising."""
    df = scale.robust_scale(_table(spark, sf_dir, *SCALED), SCALED)
    return scale.PowerScaler(SCALED).fit(df).transform(df)


_SEEN = "(SELECT * FROM derived WHERE id % 5 <> 0)"


@query(
    "one_hot_rare",
    f"""SELECT id, c."column" AS "column", CASE WHEN v.value IS NULL THEN 'unseen'
        WHEN v.n < {MIN_SHARE}::DOUBLE * (SELECT count(*) FROM {_SEEN}) THEN '{RARE}' ELSE v.value END AS level
      FROM (SELECT id, unnest([{', '.join(f"'{c}'" for c in ENCODED)}]) AS "column",
          unnest([{', '.join(f"coalesce({c}, 'missing_value')" for c in ENCODED)}]) AS value FROM derived) c
      LEFT JOIN ("""
    + " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", coalesce({c}, 'missing_value') AS value, count(*) AS n FROM {_SEEN} GROUP BY 2"""
        for c in ENCODED
    )
    + """) v ON v."column" = c."column" AND v.value = c.value""",
    ("derived",),
)
def one_hot_rare(spark, sf_dir):
    """Fitted on four fifths of the rows; the one level set per row and column."""
    df = _table(spark, sf_dir, *ENCODED)
    model = RareOneHot(ENCODED).fit(df.where(F.col("id") % 5 != 0))
    wide = model.transform(df)
    levels = []
    for c in ENCODED:
        names = [n for n in model.feature_names() if n.startswith(f"{c}_")]
        hit = F.coalesce(*[F.when(F.col(f"`{n}`") == 1, n.removeprefix(f"{c}_")) for n in names], F.lit("unseen"))
        levels.append(F.struct(F.lit(c).alias("column"), hit.alias("level")))
    return wide.select("id", F.inline(F.array(*levels)))


def _image_cell(category: str, i: int) -> str:
    return f"round(coalesce(max(CASE WHEN category = '{category}' AND pos = {i + 1} THEN value END), 0), 6) AS {category}_{i}"


@query(
    "combined_features",
    "SELECT l.id, area_m2, distance_to_center_km, "
    + ", ".join(f"coalesce({c}_{i}, 0) AS {c}_{i}" for c in COMBINED for i in range(IMAGE_WIDTH))
    + """, coalesce(img_cat_kitchen, 0) AS img_cat_kitchen, coalesce(img_cat_bathroom, 0) AS img_cat_bathroom
    FROM (SELECT id, area_m2, round(distance_to_center_km, 6) AS distance_to_center_km FROM derived) l
    LEFT JOIN (SELECT id, """
    + ", ".join(_image_cell(c, i) for c in COMBINED for i in range(IMAGE_WIDTH))
    + " FROM image_elements GROUP BY id) w ON l.id = w.id LEFT JOIN img_cat d ON l.id = d.id",
    ("derived", "image_elements", "img_cat"),
)
def combined_features(spark, sf_dir):
    tabular = rounded(derived(spark, sf_dir).select("id", *GRAM), 6, "distance_to_center_km")
    wide = images.image_wide(fx.image_features(spark, sf_dir), COMBINED)
    dummies = first_by(fx.img_cat(spark, sf_dir), ["id"], ["img_cat_kitchen", "img_cat_bathroom"])
    names = {c: [f"{c}_{i}" for i in range(IMAGE_WIDTH)] for c in COMBINED}
    combined = combine_features(tabular, wide, dummies, ["area_m2", "distance_to_center_km", "not_there"], names)
    return combined.select(
        "id", "area_m2", "distance_to_center_km",
        *[F.expr(f"round({n}, 6) as {n}") for c in COMBINED for n in names[c]],
        "img_cat_kitchen", "img_cat_bathroom",
    )


_GRAM_COLUMNS = ["1", *GRAM, "label"]


@query(
    "gram_stats",
    "SELECT * FROM ("
    + " UNION ALL ".join(
        f"SELECT fold, {i} AS i, {j} AS j, round(sum(CAST({a} AS DOUBLE) * {b}) / count(*), 6) AS mean_product FROM g GROUP BY fold"
        for i, a in enumerate(_GRAM_COLUMNS)
        for j, b in enumerate(_GRAM_COLUMNS)
    ).replace(
        "FROM g",
        """FROM (SELECT *, ln(price) AS label, CAST((row_number() OVER (ORDER BY md5(CAST(id AS VARCHAR) || '|42'), id) - 1) % 5 AS INTEGER) AS fold FROM derived)""",
    )
    + ")",
    ("derived",),
)
def gram_stats(spark, sf_dir):
    """Mean product of every pair of columns (constant, features, label) per fold."""
    df = _table(spark, sf_dir, "price", *GRAM)
    folded = kfold(df, "id", 5, fx.SEED).withColumn("label", F.log("price"))
    long = gram(folded, GRAM, "label", "fold")
    size = F.first(F.when((F.col("i") == 0) & (F.col("j") == 0), F.col("value")), ignorenulls=True)
    sizes = F.broadcast(long.groupBy("fold").agg(size.alias("_n")))
    return long.join(sizes, "fold").select("fold", "i", "j", F.round(F.col("value") / F.col("_n"), 6).alias("mean_product"))


@query(
    "regression_metrics",
    """SELECT round(sqrt(avg((true_price - predicted_price) ** 2)), 4) AS test_rmse,
      round(avg(abs(true_price - predicted_price) / greatest(abs(true_price), 2.220446049250313e-16)), 6) AS test_mape,
      round(1 - sum((true_price - predicted_price) ** 2) / (var_pop(true_price) * count(*)), 6) AS test_r2 FROM predictions""",
    ("predictions",),
)
def regression_metrics(spark, sf_dir):
    metrics = ev.regression_metrics(fx.predictions(spark, sf_dir), prefix="test")
    return rounded(rounded(metrics, 6, "test_mape", "test_r2"), 4, "test_rmse")


@query(
    "cv_fold_summary",
    """SELECT metric, round(avg(value), 4) AS mean, round(stddev_pop(value), 4) AS std FROM (
      SELECT fold, unnest(['rmse', 'mape', 'r2']) AS metric, unnest([sqrt(avg((true_price - predicted_price) ** 2)),
        avg(abs(true_price - predicted_price) / greatest(abs(true_price), 2.220446049250313e-16)),
        1 - sum((true_price - predicted_price) ** 2) / (var_pop(true_price) * count(*))]) AS value
      FROM folded GROUP BY fold) GROUP BY metric""",
    ("folded",),
)
def cv_fold_summary(spark, sf_dir):
    return rounded(ev.cv_fold_summary(fx.folded_predictions(spark, sf_dir)), 4, "mean", "std")


@query(
    "residual_table",
    """SELECT id, true_price, round(predicted_price, 4) AS predicted_price, round(residual, 4) AS residual,
      round(abs_residual, 4) AS abs_residual, round(pct_error, 4) AS pct_error FROM residuals""",
    ("residuals",),
)
def residual_table(spark, sf_dir):
    table = ev.residual_table(fx.predictions(spark, sf_dir))
    return rounded(table, 4, "predicted_price", "residual", "abs_residual", "pct_error")


@query(
    "error_classes",
    """SELECT error_category, error_category_pct, count(*) AS n FROM (
      SELECT CASE WHEN abs_residual <= q98 THEN 'low_error' WHEN abs_residual >= q99 THEN 'high_error' ELSE 'medium_error' END AS error_category,
        CASE WHEN pct_error >= 10 THEN 'high_error' WHEN pct_error < 5 THEN 'low_error' ELSE 'medium_error' END AS error_category_pct
      FROM residuals, (SELECT quantile_cont(abs_residual, 0.98) AS q98, quantile_cont(abs_residual, 0.99) AS q99 FROM residuals))
    GROUP BY ALL""",
    ("residuals",),
)
def error_classes(spark, sf_dir):
    classed = ev.error_classes(ev.residual_table(fx.predictions(spark, sf_dir)))
    return classed.groupBy("error_category", "error_category_pct").agg(F.count(F.lit(1)).alias("n"))


@query(
    "worst_residuals",
    "SELECT id, round(abs_residual, 4) AS abs_residual FROM residuals ORDER BY residuals.abs_residual DESC, id LIMIT 5",
    ("residuals",),
)
def worst_residuals(spark, sf_dir):
    worst = ev.worst_residuals(ev.residual_table(fx.predictions(spark, sf_dir)))
    return rounded(worst.select("id", "abs_residual"), 4, "abs_residual")
