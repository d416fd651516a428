import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from priceforge.operators.joins import first_by, lookup_join
from priceforge.operators.ordinal import kfold, positions, sample_exact
from priceforge.operators.split import allocate, price_band, stratified_split, valid_strata, with_stratum


def md5(i, seed):
    return hashlib.md5(f"{i}|{seed}".encode()).hexdigest()


def test_kfold_is_balanced_and_independent_of_partitions(spark):
    ids = spark.range(1003)
    one = {r["id"]: r["fold"] for r in kfold(ids.repartition(1), "id", 5, 7).collect()}
    many = {r["id"]: r["fold"] for r in kfold(ids.repartition(8), "id", 5, 7).collect()}
    assert one == many
    assert sorted(Counter(one.values()).values()) == [200, 200, 201, 201, 201]
    order = sorted(range(1003), key=lambda i: (md5(i, 7), i))
    assert one == {i: n % 5 for n, i in enumerate(order)}
    assert one != {r["id"]: r["fold"] for r in kfold(ids, "id", 5, 8).collect()}


def test_positions_of_a_hot_group(spark):
    df = spark.range(5000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 50)).alias("g"), "id"
    )
    rows = positions(df, ["g"], F.floor(F.col("id") / 100), ["id"], "n").collect()
    groups = {}
    for r in sorted(rows, key=lambda r: r["id"]):
        assert r["n"] == groups.setdefault(r["g"], 0)
        groups[r["g"]] += 1


def test_positions_keep_rows_without_group_or_bucket(spark):
    df = spark.createDataFrame([(None, 1, 1), (None, None, 2), ("a", None, 3), ("a", 1, 4)], "g string, b int, id int")
    rows = {r["id"]: r["n"] for r in positions(df, ["g"], F.col("b"), ["id"], "n").collect()}
    assert rows == {2: 0, 1: 1, 3: 0, 4: 1}


@pytest.mark.parametrize("n", [0, 1, 17, 999, 1000, 5000])
def test_sample_is_exact(spark, n):
    ids = {r["id"] for r in sample_exact(spark.range(1000).repartition(4), "id", n, 3).collect()}
    assert ids == set(sorted(range(1000), key=lambda i: (md5(i, 3), i))[:n])


def test_split_sizes_and_single_row_stratum(spark):
    rows = [(i, 100_000.0 + (i % 3) * 300_000, i % 4 == 0) for i in range(503)] + [(999, 9e6, True)]
    df = spark.createDataFrame(rows, "id long, price double, has_img boolean")
    out = stratified_split(df.repartition(6), seed=1)
    got = out.collect()
    assert 999 not in {r["id"] for r in got}
    assert sum(r["split"] == "test" for r in got) == -(-503 * 2 // 10)
    sizes, tests = Counter(r["stratum"] for r in got), Counter(r["stratum"] for r in got if r["split"] == "test")
    assert all(abs(tests[s] - n * 0.2) <= 1 for s, n in sizes.items())
    again = {r["id"]: r["split"] for r in stratified_split(df.repartition(2), seed=1).collect()}
    assert again == {r["id"]: r["split"] for r in got}


def test_allocation_of_large_counts(spark):
    sizes = spark.createDataFrame([("a", 70_000_000_001), ("b", 29_999_999_999), ("c", 3)], "stratum string, n long")
    quota = {r["stratum"]: r["quota"] for r in allocate(sizes).collect()}
    total = 100_000_000_003
    assert sum(quota.values()) == -(-total // 5)
    assert quota["c"] in (0, 1)


def test_price_bands_are_left_closed(spark):
    prices = [0.0, 249_999.99, 250_000.0, 3_000_000.0, -1.0, None, float("nan"), float("inf")]
    df = spark.createDataFrame([(p,) for p in prices], "p double").select(price_band(F.col("p")).alias("b"))
    assert [r["b"] for r in df.collect()] == ["0-250k", "0-250k", "250-500k", "3M+", None, None, None, None]


def test_unknown_price_forms_a_stratum(spark):
    df = spark.createDataFrame([(1, None, None), (2, None, None), (3, 1.0, True)], "id long, price double, has_img boolean")
    df = df.withColumn("has_img", F.coalesce("has_img", F.lit(False)))
    assert [r["stratum"] for r in valid_strata(with_stratum(df)).collect()] == ["nan_False", "nan_False"]


def test_lookup_join_keeps_every_row(spark):
    left = spark.range(1000).select("id", F.when(F.col("id") < 700, "hot").when(F.col("id") < 900, "b").alias("k"))
    right = spark.createDataFrame([("hot", 1), ("c", 2)], "k string, v int")
    joined = lookup_join(left, right, ["k"], salt_by=["id"])
    assert joined.count() == 1000 and joined.where("v = 1").count() == 700
    assert lookup_join(left, right, ["k"], salt_by=["id"], how="inner").count() == 700


def test_first_by_breaks_ties_and_limits_before_the_shuffle(spark, capsys):
    df = spark.createDataFrame([(1, 2, "b"), (1, 1, "z"), (1, 1, "a"), (2, None, "n"), (2, 5, "m")], "k int, o int, v string")
    picked = first_by(df, ["k"], ["o", "v"])
    assert {r["k"]: r["v"] for r in picked.collect()} == {1: "a", 2: "n"}
    picked.explain()
    assert "WindowGroupLimit" in capsys.readouterr().out
