"""No task of the pipeline may hold more than one Python worker: on small executors workers take most of the memory."""

import sys
from pathlib import Path

import corpus_pipeline
from priceforge.llm import suffix_dedup

sys.path.insert(0, str(Path(__file__).resolve().parent))

from test_repeats import brute  # noqa: E402


def workers(node) -> int:
    """The most Python steps that run in one stage of a plan."""

    def walk(node) -> tuple[int, int]:
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            return walk(node.executedPlan())
        children = node.children()
        below = [walk(children.apply(i)) for i in range(children.size())]
        here, most = sum(b[0] for b in below), max((b[1] for b in below), default=0)
        if "Exchange" in name:
            here = 0
        elif name in ("MapInArrow", "MapInPandas", "ArrowEvalPython", "BatchEvalPython"):
            here += 1
        return here, max(most, here)

    return walk(node)[1]


def test_one_worker_for_each_task(spark, tmp_path):
    rows = [(i, f"document {i} " + "of the same passage " * 12) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES:
        plan = stage(spark, docs, str(tmp_path))._jdf.queryExecution().executedPlan()
        assert workers(plan) <= 1, name


def test_cut_characters_go(spark):
    same = "é" * 100
    texts = {1: "a" + same + "x", 2: "bb" + same + "y" * 300, 3: "é中" * 3, 4: "z" + "é" * 99 + "ß" + "w" * 250}
    docs = spark.createDataFrame([(i, t, len(t)) for i, t in texts.items()], "doc_id long, text string, n_chars long")
    raw = [t.encode() for t in texts.values()]
    gone = brute(raw, 199)
    left = [bytes(b for b, g in zip(u, own, strict=True) if not g) for u, own in zip(raw, gone, strict=True)]
    # A window of 199 bytes ends within a character.
    assert any(k != k.decode("utf-8", "ignore").encode() for k in left)
    cut = suffix_dedup.without_repeated_strings(docs, 199)
    want = {i: k.decode("utf-8", "ignore") for i, k in zip(texts, left, strict=True)}
    assert {r.doc_id: (r.text, r.n_chars) for r in cut.collect()} == {i: (t, len(t)) for i, t in want.items()}
    rows = {r.doc_id: r for r in suffix_dedup.removed(docs, 199).collect()}
    assert {i: bytes(r.kept) for i, r in rows.items()} == dict(zip(texts, left, strict=True))
