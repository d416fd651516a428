"""Exact, linearly interpolated quantiles without holding a group in one task."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from priceforge.operators.joins import lookup_join

ACCURACY = 10_000
# Twice the sketch error must span at least one rank on each side of the wanted one.
WHOLE_GROUP = 30_000


def name_of(column: str, prob: float) -> str:
    """Output column holding quantile ``prob`` of ``column``: ``area__q25``, ``area__q50``."""
    return f"{column}__q{prob * 100:g}".replace(".", "_")


def exact_quantiles(
    df: DataFrame,
    columns: Sequence[str] | Mapping[str, Column],
    probs: Sequence[float],
    by: Sequence[str] = (),
    salt_by: Sequence[str | Column] = (),
) -> DataFrame:
    """One row per group (one row in all without ``by``), one column per column and probability.

    Spark's ``percentile`` keeps every distinct value of a group in one task. Here a sketch
    (``percentile_approx``, merged before the shuffle) only brackets each wanted rank. A second
    pass counts the values below the bracket and keeps those inside, a few per ten thousand of
    the group, from which the exact order statistics are read. Groups of up to
    ``WHOLE_GROUP`` values use the whole group as bracket. If a bracket ever misses its rank the
    query fails rather than return a wrong value.

    Nulls and NaN are skipped; rows with a null group key are left out. The input is read twice:
    pass a stored table when computing it is expensive.
    """
    if not isinstance(columns, Mapping):
        columns = {c: F.col(f"`{c}`") for c in columns}
    names = list(columns)
    by = list(by)
    cells = df
    for key in by:
        cells = cells.where(F.col(key).isNotNull())
    values = [columns[c].cast("double") for c in names]
    cells = cells.select(
        *by,
        F.xxhash64(*salt_by).alias("_spread") if by and salt_by else F.lit(0).cast("long").alias("_spread"),
        *[F.when(~F.isnan(v), v).alias(f"_v{i}") for i, v in enumerate(values)],
    )

    # Written as SQL text: one string per step is far cheaper to build than its column objects.
    margin = 2.0 / ACCURACY
    edges = [p for prob in probs for p in (max(prob - margin, 0.0), min(prob + margin, 1.0))]
    sketch_at = "array(" + ", ".join(f"{e!r}D" for e in edges) + ")"
    grid = [(i, j) for i in range(len(names)) for j in range(len(probs))]

    def bracket(i: int, j: int) -> str:
        v, prob = f"_v{i}", probs[j]
        sketch = f"percentile_approx({v}, {sketch_at}, {ACCURACY})"
        whole = f"count({v}) <= {WHOLE_GROUP}"
        low = f"if({whole} or {prob - margin <= 0}, min({v}), {sketch}[{2 * j}])"
        high = f"if({whole} or {prob + margin >= 1}, max({v}), {sketch}[{2 * j + 1}])"
        return f"struct({low} as low, {high} as high, {float(prob)!r}D * (count({v}) - 1) as pos) as _b{i}_{j}"

    bounds = cells.groupBy(*by).agg(*[F.expr(bracket(i, j)) for i, j in grid])
    if by:
        joined = lookup_join(cells, bounds, by, salt_by=["_spread"], how="inner")
        edge = lambda i, j, side: f"_b{i}_{j}.{side}"
    else:
        joined, row = cells, bounds.first()
        edge = lambda i, j, side: _number(row[f"_b{i}_{j}"][side])

    marks = [
        f"if(_v{i} <= {edge(i, j, 'high')}, named_struct('_c', {i}, '_p', {j}, '_pos', {edge(i, j, 'pos')}, "
        f"'_value', if(_v{i} >= {edge(i, j, 'low')}, _v{i}, null)), null)"
        for i, j in grid
    ]
    counted = (
        joined.select(*by, F.expr(f"inline(array_compact(array({', '.join(marks)})))"))
        .groupBy(*by, "_c", "_p", "_pos", "_value")
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    running = Window.partitionBy(*by, "_c", "_p").orderBy(F.col("_value").asc_nulls_first())
    ranked = counted.withColumn("_upto", F.sum("_n").over(running.rowsBetween(Window.unboundedPreceding, 0)))

    parts, out = [], []
    covers = "{0}(_pos) >= _upto - _n and {0}(_pos) < _upto"
    for i, j in grid:
        mine = f"_c = {i} and _p = {j}"
        parts += [
            F.expr(f"max(if({mine} and {covers.format('floor')}, _value, null)) as _l{i}_{j}"),
            F.expr(f"max(if({mine} and {covers.format('ceil')}, _value, null)) as _h{i}_{j}"),
            F.expr(f"max(if({mine}, _pos, null)) as _a{i}_{j}"),
        ]
        value = f"_l{i}_{j} + (_h{i}_{j} - _l{i}_{j}) * (_a{i}_{j} - floor(_a{i}_{j}))"
        missed = "cast(raise_error('quantile bracket missed its rank') as double)"
        out.append(
            F.expr(f"if(_a{i}_{j} is null, null, coalesce({value}, {missed}))").alias(name_of(names[i], probs[j]))
        )
    return ranked.groupBy(*by).agg(*parts).select(*by, *out)


def _number(value: float | None) -> str:
    return "cast(null as double)" if value is None else f"cast('{value!r}' as double)"
