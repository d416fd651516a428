"""Joins whose left side may be dominated by one key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

SALT = "_salt"


def lookup_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    salt_by: Sequence[str | Column],
    how: str = "left",
    salts: int = 16,
) -> DataFrame:
    """Join rows to a per-key table when one key may hold a large share of ``left``.

    ``right`` holds one row per key. Each of its rows is repeated ``salts`` times and each left
    row takes one salt from a hash of ``salt_by``, so a hot key spreads over ``salts`` tasks.
    No broadcast is forced: Spark broadcasts ``right`` only if its measured size allows.
    """
    spread = left.withColumn(SALT, F.pmod(F.xxhash64(*salt_by), F.lit(salts).cast("long")))
    copies = right.withColumn(
        SALT, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long")))
    )
    return spread.join(copies, [*on, SALT], how).drop(SALT)


def literal(value, data_type: T.DataType) -> Column:
    """A constant column from a collected value."""
    if isinstance(data_type, T.ArrayType) and value is not None:
        return F.array(*[literal(v, data_type.elementType) for v in value]).cast(data_type)
    if isinstance(data_type, T.StructType) and value is not None:
        return F.struct(*[literal(value[f.name], f.dataType).alias(f.name) for f in data_type])
    return F.lit(value).cast(data_type)


def with_row(df: DataFrame, single: DataFrame, name: str = "_row") -> DataFrame:
    """Attach the only row of ``single``, a global aggregate, to every row as struct ``name``.

    The row is computed first and enters the plan as constants, so the scan of ``df`` needs no
    join and its expressions compile to plain comparisons.
    """
    return df.withColumn(name, literal(single.first(), single.schema))


def first_by(
    df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], keep: Sequence[str] | None = None
) -> DataFrame:
    """The first row of every key under ``order`` (ascending, nulls first).

    Spark plans ``row_number = 1`` with a group limit ahead of the shuffle: every input task sends
    at most one row per key, so a key with a third of all rows is not sorted in a single task.
    """
    keep = list(keep) if keep is not None else [c for c in df.columns if c not in keys]
    by = [(c if isinstance(c, Column) else F.col(c)).asc_nulls_first() for c in order]
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(*by))
    return df.withColumn("_rn", first).where(F.col("_rn") == 1).select(*keys, *[F.col(f"`{c}`") for c in keep])
