import numpy as np
import pytest
from pyspark.sql import functions as F

from priceforge.operators import quantiles
from priceforge.operators.quantiles import exact_quantiles, name_of

PROBS = [0.0, 0.02, 0.25, 0.5, 0.75, 0.98, 1.0]


def expected(values):
    return [float(np.quantile(values, p)) for p in PROBS]


@pytest.mark.parametrize("size", [1, 2, 3, 10, 11, 35_000, 60_001])
def test_matches_linear_interpolation(spark, size):
    values = np.random.default_rng(size).lognormal(size=size)
    df = spark.createDataFrame([(float(v),) for v in values], "x double").repartition(5)
    row = exact_quantiles(df, ["x"], PROBS).first()
    assert [row[name_of("x", p)] for p in PROBS] == pytest.approx(expected(values), rel=1e-12)


def test_bracket_path_on_small_groups(spark, monkeypatch):
    """The sketch bracket is used from the smallest size at which its margin covers the rank."""
    monkeypatch.setattr(quantiles, "WHOLE_GROUP", 20_000)
    values = np.arange(20_001) % 7
    df = spark.createDataFrame([(float(v),) for v in values], "x double")
    row = exact_quantiles(df, ["x"], PROBS).first()
    assert [row[name_of("x", p)] for p in PROBS] == pytest.approx(expected(values))


def test_hot_group_ties_nulls_and_nan(spark):
    """Group 'hot' holds most rows, half of them one value; 'none' has no value at all."""
    hot = spark.range(80_000).select(
        F.lit("hot").alias("g"), F.col("id"), F.when(F.col("id") % 2 == 0, 5.0).otherwise(F.col("id") / 1000).alias("x")
    )
    rest = spark.createDataFrame(
        [("a", 1, 1.0), ("a", 2, None), ("a", 3, 4.0), ("a", 4, float("nan")), ("none", 5, None), (None, 6, 9.0)],
        "g string, id long, x double",
    )
    rows = exact_quantiles(hot.unionByName(rest), ["x"], [0.25, 0.5], by=["g"], salt_by=["id"]).collect()
    got = {r["g"]: (r["x__q25"], r["x__q50"]) for r in rows}
    values = [5.0 if i % 2 == 0 else i / 1000 for i in range(80_000)]
    assert got["hot"] == pytest.approx((np.quantile(values, 0.25), np.quantile(values, 0.5)))
    assert got["a"] == pytest.approx((1.75, 2.5))
    assert None not in got and got.get("none", (None, None)) == (None, None)


def test_missed_bracket_fails(spark, monkeypatch):
    """A wrong bracket raises instead of returning a value."""
    monkeypatch.setattr(quantiles, "_number", lambda v: "0.5D" if v is not None and v < 1 else "cast(2.5 as double)")
    df = spark.createDataFrame([(float(v),) for v in range(10)], "x double")
    with pytest.raises(Exception, match="bracket missed"):
        exact_quantiles(df, ["x"], [0.9]).collect()


def test_empty(spark):
    df = spark.createDataFrame([], "x double")
    assert exact_quantiles(df, ["x"], [0.5]).collect()[0]["x__q50"] is None
