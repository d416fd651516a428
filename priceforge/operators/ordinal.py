"""Exact positions, samples and folds over a seeded hash order, without a global sort in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Length of the hexadecimal prefix that forms a hash bucket: 16^4 = 65,536 buckets.
PREFIX = 4


def hash_order(key: str, seed: int) -> Column:
    """Repeatable pseudo-random order of a key: the md5 of key and seed."""
    return F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(str(seed))))


def positions(
    df: DataFrame, by: Sequence[str], bucket: Column, order: Sequence[str], name: str
) -> DataFrame:
    """0-based position of every row within ``by`` under (``bucket``, ``order``).

    ``bucket`` must grow with the order. Rows are numbered inside (by, bucket) and shifted by the
    number of rows in earlier buckets, so a large group is numbered by as many tasks as it has
    buckets.
    """
    by = list(by)
    tagged = df.withColumn("_bucket", bucket)
    sizes = tagged.groupBy(*by, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*(by or [F.lit(0)])).orderBy("_bucket")
    keys = [*by, "_bucket"]
    starts = sizes.select(
        *[F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)],
        F.coalesce(F.sum("_n").over(earlier.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"),
    )
    inside = Window.partitionBy(*by, "_bucket").orderBy(*order)
    numbered = tagged.withColumn("_rn", F.row_number().over(inside))
    same = [F.col(k).eqNullSafe(F.col(f"_key{i}")) for i, k in enumerate(keys)]
    return (
        numbered.join(starts, same)
        .withColumn(name, F.col("_start") + F.col("_rn") - 1)
        .drop("_start", "_rn", "_bucket", *[f"_key{i}" for i in range(len(keys))])
    )


def kfold(df: DataFrame, key: str, k: int, seed: int, name: str = "fold") -> DataFrame:
    """Shuffled k-fold labels 0..k-1; fold sizes differ by at most one row."""
    hashed = df.withColumn("_hash", hash_order(key, seed))
    placed = positions(hashed, [], F.substring("_hash", 1, PREFIX), ["_hash", key], "_place")
    return placed.withColumn(name, F.pmod("_place", F.lit(k)).cast("int")).drop("_hash", "_place")


def pick_smallest(df: DataFrame, stratum: str, quotas: DataFrame, hashed: str, key: str, name: str) -> DataFrame:
    """Flag the ``quota`` rows of each stratum that come first by (``hashed``, ``key``).

    ``quotas`` (stratum, quota) must be a bounded table: it is broadcast. Only the one hash bucket
    per stratum that the quota cuts through is ranked; every other row is decided by comparison.
    """
    bucket = F.substring(hashed, 1, PREFIX)
    sizes = df.groupBy(stratum, bucket.alias("_bucket")).agg(F.count(F.lit(1)).alias("_n"))
    upto = Window.partitionBy(stratum).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(stratum)
    edges = (
        sizes.withColumn("_upto", F.sum("_n").over(upto))
        .withColumn("_all", F.sum("_n").over(whole))
        .join(F.broadcast(quotas), stratum)
        .withColumn("_quota", F.least("quota", "_all"))
        .where((F.col("_upto") >= F.col("_quota")) & (F.col("_upto") - F.col("_n") < F.col("_quota")))
        .select(
            F.col(stratum),
            F.col("_bucket"),
            (F.col("_quota") - F.col("_upto") + F.col("_n")).alias("_take"),
        )
    )
    rank = F.row_number().over(Window.partitionBy(stratum).orderBy(hashed, key))
    cuts = (
        df.select(stratum, hashed, key, bucket.alias("_bucket"))
        .join(F.broadcast(edges), [stratum, "_bucket"])
        .withColumn("_rn", rank)
        .where(F.col("_rn") == F.col("_take"))
        .select(F.col(stratum), F.col(hashed).alias("_cut"), F.col(key).alias("_cut_key"))
    )
    taken = (F.col(hashed) < F.col("_cut")) | (
        (F.col(hashed) == F.col("_cut")) & (F.col(key) <= F.col("_cut_key"))
    )
    return (
        df.join(F.broadcast(cuts), stratum, "left")
        .withColumn(name, F.coalesce(taken, F.lit(False)))
        .drop("_cut", "_cut_key")
    )


def sample_exact(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """Exactly ``n`` rows (all, if fewer), repeatable for a seed, at any ``n``."""
    hashed = df.withColumn("_hash", hash_order(key, seed)).withColumn("_all_rows", F.lit(0))
    quota = df.sparkSession.range(1).select(
        F.lit(0).alias("_all_rows"), F.lit(n).cast("long").alias("quota")
    )
    picked = pick_smallest(hashed, "_all_rows", quota, "_hash", key, "_picked")
    return picked.where(F.col("_picked")).drop("_hash", "_all_rows", "_picked")
