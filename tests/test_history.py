import json

import pytest
from pyspark.sql import functions as F

from priceforge.operators.joins import first_by
from priceforge.operators import featuresets as fs
from priceforge.operators import runs as ops
from priceforge.operators import trials as tr
from priceforge.sources import featuresets, listings, summaries, tables
from priceforge.sources.runs import RUN_SCHEMA, append_run, read_runs, read_trials


def run(run_id, name="XGBoostQuantile_x_v3_BEST", params=None, tags=None, metrics=None, start=0, end=None, status="FINISHED"):
    return (run_id, "1", None, name, status, start, end, params or {}, tags or {}, metrics or {})


def test_flat_run_fallbacks(spark):
    df = spark.createDataFrame(
        [
            run("a"),
            run("b", None, {"model": "m"}, {"feature_set": "t", "run_type": "best_run"}, {"cv_mape": 0.3, "best_optuna_cv_mape": 0.2}),
            run("c", "plain", {"feature_set_file": "f"}, {"model_name": "tagged"}, {"test_final_mape": 0.1, "best_optuna_cv_mape": 0.2}, 1000, 2500),
        ],
        RUN_SCHEMA,
    )
    rows = {r["run_id"]: r for r in ops.flatten_runs(df).collect()}
    assert (rows["a"]["model_name"], rows["a"]["feature_set"], rows["a"]["test_mape"], rows["a"]["end_time"]) == ("XGBoost", "Unknown", None, None)
    assert (rows["b"]["model_name"], rows["b"]["feature_set"], rows["b"]["train_score"], rows["b"]["test_mape"]) == ("m", "t", 0.3, 0.2)
    assert rows["b"]["test_mape_source"] == "best_optuna_cv_mape"
    assert (rows["c"]["model_name"], rows["c"]["feature_set"], rows["c"]["test_mape"]) == ("tagged", "f", 0.1)
    assert str(rows["c"]["end_time"]) == "1970-01-01 00:00:02.500000"


def test_best_and_latest_with_ties(spark):
    df = spark.createDataFrame(
        [("r2", "m", "f", 0.5, 1), ("r1", "m", "f", 0.5, 1), ("r3", "m", "f", None, 0), ("r4", "n", "f", None, 5)],
        "run_id string, model_name string, feature_set string, test_mape double, s int",
    ).withColumn("start_time", F.expr("timestampadd(SECOND, s, TIMESTAMP_NTZ'2024-01-01 00:00:00')"))
    assert [r["run_id"] for r in ops.best_per_group(df, "test_mape").collect()] == ["r1"]
    assert [r["run_id"] for r in ops.best_per_group(df, "test_mape", maximize=True).collect()] == ["r1"]
    assert {r["run_id"] for r in ops.latest_per_group(df).collect()} == {"r1", "r4"}


def test_summary_order_falls_back(spark):
    df = spark.createDataFrame([("a", None, 2.0), ("b", None, 1.0), ("c", None, None)], "run_id string, test_score double, train_score double")
    assert [r["run_id"] for r in ops.summary_order(df).collect()] == ["b", "a", "c"]
    assert [r["run_id"] for r in ops.summary_order(df, 1, best_first=False).collect()] == ["a"]


def test_lookup_and_filters(spark):
    df = spark.createDataFrame([run("a", "n", metrics={}), run("b", "n", metrics={"m": 2.0}), run("c", "n", metrics={"m": 1.0})], RUN_SCHEMA)
    assert ops.lookup_by_name(df, "n", "m").first()["run_id"] == "c"
    assert ops.lookup_by_name(df, "n", "m", ascending=False).first()["run_id"] == "b"
    s = spark.createDataFrame([("x", "100", None), ("y_umap", "100", 8), (None, "50", 8)], "feature_set_short string, n_trials_optuna string, version int")
    assert ops.filter_summary(s, without="umap").count() == 1
    assert ops.filter_summary(s, trials=["100"], version=8).count() == 1


def test_dedup_last_prefers_unknown_then_smallest(spark):
    df = spark.createDataFrame([("a", "k", 2.0), ("b", "k", 1.0), ("c", "l", None), ("d", "l", 1.0)], "run_id string, key string, mape double")
    assert {r["run_id"] for r in ops.dedup_last(df, ["key"], ["mape"]).collect()} == {"b", "c"}


def trials(spark, rows):
    return spark.createDataFrame([(s, n, v, p) for s, n, v, p in rows], "study string, number long, value double, params map<string,string>")


@pytest.mark.parametrize("chunk", [1, 3, 100])
def test_running_best_over_chunks(spark, chunk):
    values = [5.0, None, 7.0, 3.0, 3.0, 9.0, 2.0, None, 1.0]
    df = trials(spark, [("s", i, v, {}) for i, v in enumerate(values)])
    got = [(r["number"], r["best_value"]) for r in tr.running_best(df, chunk).orderBy("number").collect()]
    assert got == [(0, 5.0), (2, 5.0), (3, 3.0), (4, 3.0), (5, 3.0), (6, 2.0), (8, 1.0)]


def test_convergence_rules(spark):
    rows = [("ok", i, v, {}) for i, v in enumerate([None, 9.0, 1.02, 8.0, 1.0] + [5.0] * 6)]
    rows += [("few", i, 1.0, {}) for i in range(9)] + [("low", i, -1.0, {}) for i in range(12)] + [("high", i, 101.0, {}) for i in range(12)]
    got = tr.convergence(trials(spark, rows)).collect()
    assert [(r["study"], r["convergence_trial"], r["n_values"]) for r in got] == [("ok", 1, 10)]


def test_param_ranges(spark):
    rows = [("s", i, float(v), {"x": str(v), "b": "gbt" if i else "dart"}) for i, v in enumerate([10, 0, 5, 100])]
    rows += [("flat", 0, 1.0, {"x": "3"}), ("flat", 1, 2.0, {"x": "3"})]
    df = trials(spark, rows)
    ranges = {(r["study"], r["param"]): (r["kind"], r["min_value"], r["n_values"]) for r in tr.param_range(df).collect()}
    assert ranges == {("s", "x"): ("numeric", 0.0, 4), ("s", "b"): ("categorical", None, 2), ("flat", "x"): ("numeric", 3.0, 1)}
    assert [(r["study"], r["param"], r["bound"]) for r in tr.param_near_bound(df).collect()] == [("s", "x", "lower")]


def test_feature_set_overlap(spark):
    df = spark.createDataFrame([("A", "x"), ("B", "x"), ("A", "y"), ("B", "dist_z")], "set_name string, feature string")
    usage = fs.feature_usage(df).first()
    assert (usage["n_features"], usage["in_all"], usage["in_one"], usage["in_two_or_three"]) == (3, 1, 2, 1)
    matrix = {r["feature"]: (r["A"], r["B"], r["C"]) for r in fs.feature_matrix(df, ["A", "B", "C"]).collect()}
    assert matrix == {"x": (1, 1, 0), "y": (1, 0, 0), "dist_z": (0, 1, 0)}
    norm = fs.category_usage_norm(fs.category_usage(df, ["A", "C"]), ["A", "C"]).collect()
    assert {r["category"]: (r["A"], r["C"]) for r in norm} == {"Other": (1.0, 0.0), "Distance Features": (None, None)}


def test_feature_set_files(spark, tmp_path):
    (tmp_path / "rfecv_base_nfeat_2_pca.json").write_text(json.dumps({"selected_features": ["a", "b"], "metadata": {"k": 2, "on": True, "m": "rf"}}, indent=1))
    (tmp_path / "empty_all.json").write_text("{}")
    rows = {r["file_name"]: r for r in featuresets.read_feature_sets(spark, str(tmp_path)).collect()}
    assert rows["rfecv_base_nfeat_2_pca.json"]["set_name"] == "BASE 2 PCA"
    assert rows["empty_all.json"]["selected_features"] == [] and rows["empty_all.json"]["metadata"] == {}
    assert featuresets.load_feature_set(spark, str(tmp_path / "rfecv_base_nfeat_2_pca.json")) == (["a", "b"], {"k": 2, "on": True, "m": "rf"})
    names = featuresets.write_subsets(spark, ["area", "dist_x", "img_y"], str(tmp_path / "out"))
    assert len(names) == 15
    assert featuresets.load_feature_set(spark, str(tmp_path / "out" / "base_poi_cols.json"))[0] == ["area", "dist_x"]
    featuresets.write_cv_results(spark, str(tmp_path / "cv"), [(3, 0, -0.5)])
    assert spark.read.json(str(tmp_path / "cv")).first()["score"] == -0.5


def test_listing_file(spark, tmp_path):
    (tmp_path / "l.csv").write_text(
        "Unnamed: 0,id,price,location.district,location.latitude,is_private_owner,dist_a—b,extra\n"
        "0,7,1.5,Wola,52.1,True,3,\n1,7,2.5,Wola,NaN,False,,q\n"
    )
    df = listings.read_listings(spark, str(tmp_path / "l.csv"))
    assert df.columns == ["id", "price", "district", "latitude", "is_private_owner", "dist_a—b", "extra", "src_seq"]
    first, second = df.orderBy("src_seq").collect()
    assert first["is_private_owner"] is True and second["latitude"] is None and second["is_private_owner"] is False
    assert dict(df.dtypes)["dist_a—b"] == "double"
    (tmp_path / "x.txt").write_text(" 12 \n\n-3\n")
    assert {r["id"] for r in listings.read_exclusions(spark, str(tmp_path / "x.txt")).collect()} == {12, -3}
    with pytest.raises(ValueError, match="no feature columns"):
        spark.range(1).write.parquet(str(tmp_path / "img"))
        listings.read_image_means(spark, str(tmp_path / "img"), "all")


def test_first_copy_is_the_first_by_file_order(spark, tmp_path):
    """Files of unequal size, quotes and second copies; the bigger file has several splits."""
    header = "id,price,location.district\n"
    (tmp_path / "l").mkdir()
    (tmp_path / "l" / "b.csv").write_text(header + "".join(f'{i},{i}.5,"B, ""{i}"""\n' for i in range(3000)))
    (tmp_path / "l" / "a.csv").write_text(header + '2999,1.0,"A, 1"\n5,2.0,A\n5,3.0,A\n')
    (tmp_path / "l" / "c.csv").write_text(header + "7,0.0,C\n9000,4.0,C\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        df = listings.read_listings(spark, str(tmp_path / "l"))
        assert df.rdd.getNumPartitions() > 10
        kept = {r["id"]: (r["price"], r["district"]) for r in first_by(df, ["id"], ["src_seq"]).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len(kept) == 3001
    assert kept[2999] == (1.0, "A, 1") and kept[5] == (2.0, "A") and kept[7] == (7.5, 'B, "7"') and kept[9000] == (4.0, "C")
    in_file = df.where("src_seq.file like '%b.csv'").orderBy("src_seq").select("id").collect()
    assert [r["id"] for r in in_file] == list(range(3000))


def test_a_file_with_another_header_is_an_error(spark, tmp_path):
    (tmp_path / "l").mkdir()
    (tmp_path / "l" / "a.csv").write_text("id,price\n1,2.0\n")
    (tmp_path / "l" / "b.csv").write_text("price,id\n2.0,1\n")
    with pytest.raises(Exception, match="(?i)header"):
        listings.read_listings(spark, str(tmp_path / "l")).collect()


def test_a_folder_of_summaries_in_a_list(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.csv").write_text("x,y\n1,2\n")
    (tmp_path / "d" / "b.csv").write_text("y,x\n3,4\n")
    (tmp_path / "c.csv").write_text("z\n5\n")
    rows = summaries.read_summaries(spark, [str(tmp_path / "d"), str(tmp_path / "c.csv")]).select("x", "y", "z").orderBy("z", "x").collect()
    assert [tuple(r) for r in rows] == [("1", "2", None), ("4", "3", None), (None, None, "5")]


def test_range_of_numbers_beside_texts(spark):
    rows = [("s", i, 1.0 + i, {"x": v}) for i, v in enumerate(["0.1", "auto", "9.5", "2"])]
    df = spark.createDataFrame(rows, "study string, number long, value double, params map<string,string>")
    assert [tuple(r) for r in tr.param_range(df).collect()] == [("s", "x", "numeric", 0.1, 9.5, 4)]
    assert [r["bound"] for r in tr.param_near_bound(df).collect()] == ["lower"]


def test_summary_files_with_different_columns(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n1,2\n")
    (tmp_path / "b.csv").write_text("y,z\n3,4\n")
    rows = summaries.read_summaries(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")]).orderBy("y").collect()
    assert [tuple(r) for r in rows] == [("1", "2", None), (None, "3", "4")]


def test_split_part_is_pruned(spark, tmp_path, capsys):
    path = str(tmp_path / "s")
    tables.write_split(spark.range(10).withColumn("split", F.when(F.col("id") < 3, "test").otherwise("train")), path)
    part = tables.read_split(spark, path, "test")
    assert part.count() == 3
    part.explain()
    assert "PartitionFilters: [isnotnull(split" in capsys.readouterr().out


def test_append_run(spark, tmp_path):
    path = str(tmp_path / "runs")
    row = dict(zip([c.split()[0] for c in RUN_SCHEMA.split(", ")], run("a", tags={"run_type": "best_run"})))
    append_run(spark, path, row)
    append_run(spark, path, row | {"run_id": "b", "tags": {}})
    assert {(r["run_id"], r["run_type"]) for r in read_runs(spark, path).collect()} == {("a", "best_run"), ("b", "Unknown")}
    assert read_runs(spark, path, "best_run").count() == 1
    assert read_trials(spark, str(tmp_path / "none"), "s") == []
