"""Every stage of the pipeline against brute force, each judged on its own input."""

import re
import sys
from pathlib import Path

from pyspark.sql import functions as F

import corpus_pipeline
from priceforge.llm import quality
from priceforge.llm.corpus import documents
from priceforge.session import materialize

sys.path.insert(0, str(Path(__file__).resolve().parent))

from test_operators import brute_simhash, components, sequences_are_sound  # noqa: E402
from test_repeats import brute  # noqa: E402

SMALL = "/root/testdata/sf0.001"


def texts(df):
    return {r.doc_id: r.text or "" for r in df.collect()}


def awkward(spark, sf):
    docs = documents(spark, sf)
    extra = docs.limit(1).select(
        *[F.lit(None).cast(f.dataType).alias(f.name) for f in docs.schema if f.name not in ("doc_id", "text")]
    )
    rows = [(10**9 + i, t) for i, t in enumerate([None, "", "  ", "x", "x"])]
    more = spark.createDataFrame(rows, "doc_id long, text string").crossJoin(extra).select(docs.columns)
    return docs.unionByName(more)


def test_stages(spark):
    docs = materialize(awkward(spark, SMALL))
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == [
        "quality_classifier", "exact_dedup", "simhash_near_dedup", "suffix_array_dedup", "best_fit_packing"
    ]

    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    scores = {r.doc_id: r.predicted for r in quality.quality_scores(docs, labels).collect()}
    first = materialize(stages["quality_classifier"](spark, docs, SMALL))
    assert first.columns == columns
    assert texts(first) == {i: t for i, t in texts(docs).items() if scores[i]}

    second = materialize(stages["exact_dedup"](spark, first, SMALL))
    smallest = {}
    for i, t in sorted(texts(first).items()):
        smallest.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t), i)
    assert second.columns == columns
    assert texts(second) == {i: texts(first)[i] for i in smallest.values()}

    third = materialize(stages["simhash_near_dedup"](spark, second, SMALL))
    before = sorted(texts(second).items())
    roots = components([brute_simhash(t) for _, t in before])
    assert third.columns == columns
    assert texts(third) == {before[r][0]: before[r][1] for r in set(roots)}

    fourth = materialize(stages["suffix_array_dedup"](spark, third, SMALL))
    before = sorted(texts(third).items())
    raw = [t.encode() for _, t in before]
    kept = {
        i: bytes(b for b, g in zip(u, gone, strict=True) if not g).decode("utf-8", "ignore")
        for (i, _), u, gone in zip(before, raw, brute(raw, 200), strict=True)
    }
    assert fourth.columns == columns
    assert texts(fourth) == kept

    packed = stages["best_fit_packing"](spark, fourth, SMALL).collect()
    assert {r.doc_id for r in packed} == set(kept)
    sequences_are_sound(packed)


def test_run_is_registered(spark):
    rows = corpus_pipeline.run(spark, SMALL)
    assert {"doc_id", "piece", "sequence_id", "offset"} <= set(rows.columns)
    assert rows.count() > 0


def test_no_text_is_moved_for_the_rejected(spark):
    """The ids that the classifier rejects are stored first, so Spark sees how few they are and sends them to the texts."""
    docs = materialize(awkward(spark, SMALL))
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", str(1 << 16))
    try:
        plan = quality.accepted(docs, labels)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "BroadcastHashJoin" in plan
    assert "SortMergeJoin" not in plan
