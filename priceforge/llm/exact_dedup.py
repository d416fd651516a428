"""Exact duplicates by skew-safe combining: locally, then by salted digest, then globally.

Texts are equal when they are identical after every run of white space is one space.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from priceforge.llm.corpus import id_and_text
from priceforge.session import materialize

#: A digest's copies are spread over so many tasks; the salts of a digest are kept as bits of a long.
SALTS = 63


def normalised(text: str | Column) -> Column:
    return F.regexp_replace(F.col(text) if isinstance(text, str) else text, r"[\x20\x09-\x0D]+", " ")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    The rows of a group share ``keep_id``, its smallest id. Null and empty texts are equal. Repeated
    rows of one id are counted in ``group_size`` and returned as often as they come. An empty table
    gives an empty result; other columns are not looked at.

    Three stages, each of which compares the whole texts because the text is a grouping key:
    Spark's partial aggregation combines the copies within a task, the salted grouping combines
    what the tasks found for one (digest, salt), and at most ``SALTS`` winners of a digest meet in
    the last one. Two texts under one digest would stop the query instead of being merged.
    """
    rows = id_and_text(docs, id_col, text_col).select("doc_id", normalised("text").alias("norm"))
    keyed = rows.select(
        "doc_id",
        "norm",
        F.sha2("norm", 256).alias("sha"),
        F.pmod(F.xxhash64("doc_id"), F.lit(SALTS).cast("long")).cast("int").alias("salt"),
    )
    salted = keyed.groupBy("sha", "salt", "norm").agg(
        F.min("doc_id").alias("winner"), F.count(F.lit(1)).alias("copies")
    )
    whole = salted.groupBy("sha", "norm").agg(
        F.min("winner").alias("keep_id"),
        F.sum("copies").alias("group_size"),
        F.bit_or(F.expr("shiftleft(1L, salt)")).alias("salts"),
    )
    groups = (
        whole.groupBy("sha")
        .agg(
            F.min("keep_id").alias("keep_id"),
            F.sum("group_size").alias("group_size"),
            F.bit_or("salts").alias("salts"),
            F.count(F.lit(1)).alias("texts"),
        )
        .withColumn(
            "keep_id",
            F.when(F.col("texts") > 1, F.raise_error(F.lit("two texts share a digest")).cast("long")).otherwise(
                F.col("keep_id")
            ),
        )
    )
    used = F.filter(F.sequence(F.lit(0), F.lit(SALTS - 1)), lambda s: F.getbit("salts", s) == 1)
    per_salt = groups.select("sha", F.explode(used).alias("salt"), "keep_id", "group_size")
    return (
        keyed.select("doc_id", "sha", "salt")
        .join(per_salt, ["sha", "salt"])
        .select(
            "doc_id",
            "keep_id",
            "group_size",
            (F.col("doc_id") == F.col("keep_id")).alias("kept"),
            F.col("sha").alias("text_sha256"),
        )
    )


def without_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, one for each text, with all their columns.

    A row is named by its id and its text, so of an id with several texts each text is judged by itself. Rows
    without id are outside every group and stay.
    """
    taken = {c.lower() for c in docs.columns}
    key = [next(n for k in range(len(taken) + 1) if (n := f"_{name}{k}") not in taken) for name in ("id", "sha")]
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    marked = docs.withColumns({key[0]: F.col(f"`{id_col}`").cast("long"), key[1]: F.sha2(normalised(text), 256)})
    found = materialize(
        exact_duplicates(docs, id_col, text_col).select(
            F.col("doc_id").alias(key[0]), F.col("text_sha256").alias(key[1]), "kept", "group_size"
        )
    )
    columns = [F.col(f"`{c}`") for c in docs.columns]
    gone = found.where(~F.col("kept")).select(*key).distinct()
    twice = found.where("kept and group_size > 1").groupBy(*key).count().where("count > 1").select(*key)
    if twice.isEmpty():
        # A row without id equals nothing that goes.
        return marked.join(gone, key, "left_anti").select(*columns)
    named = marked.where(F.col(key[0]).isNotNull())
    kept = named.join(gone, key, "left_anti")
    single = kept.join(twice, key, "left_anti")
    repeated = kept.join(twice, key, "left_semi").dropDuplicates(key)
    parts = [part.select(*columns) for part in (single, repeated, marked.where(F.col(key[0]).isNull()))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
