"""What the corpus operators share: reading documents, one name space, gapless numbering."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns an operator works on, so other columns cannot clash with its own.

    A null text counts as empty. A row without id cannot be named in a result and is left out.
    """
    return docs.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"),
        F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"),
    ).where(F.col("doc_id").isNotNull())


def few_rows(batches: Iterator[pa.RecordBatch], most: int = 1024) -> Iterator[pa.RecordBatch]:
    """The batches in slices, so that a Python worker has few texts out of Arrow at a time."""
    for batch in batches:
        for start in range(0, batch.num_rows, most):
            yield batch.slice(start, most)


def bucket_of(column: str | Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(buckets).cast("long")).cast("int")


def numbered(df: DataFrame, group: str, order: list[str], name: str, buckets: int = 256) -> DataFrame:
    """Rows of each ``group`` numbered from 0 without a gap, a hot group by many tasks.

    Rows are dealt over ``buckets`` by a hash of ``order``; the sizes of the buckets, at most
    ``buckets`` rows for each group, give the number that each bucket starts with.
    """
    dealt = df.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets).cast("long")).cast("int"))
    sizes = dealt.groupBy(group, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(
        group, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).cast("long").alias("_start")
    )
    within = Window.partitionBy(group, "_bucket").orderBy(*order)
    ranked = dealt.withColumn("_rank", F.row_number().over(within) - 1)
    return (
        ranked.join(starts, [group, "_bucket"])
        .withColumn(name, F.col("_start") + F.col("_rank"))
        .drop("_bucket", "_start", "_rank")
    )


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
