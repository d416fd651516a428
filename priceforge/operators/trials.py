"""Questions over the table of tuning trials: study, number, value (nullable), params map."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from priceforge.operators.joins import first_by, lookup_join

# Studies with fewer values are skipped, accepted best values, tolerances.
MIN_TRIALS = 10
BEST_RANGE = (0, 100)
CONVERGED_WITHIN = 1.025
EDGE_SHARE = 0.05

# Trials of one study handled by one task of the running minimum.
CHUNK = 100_000


def study_filter(trials: DataFrame, model: str, version: str, n: int = 8) -> DataFrame:
    """The last ``n`` studies, by name, whose name contains model and version."""
    names = trials.select("study").distinct()
    hits = names.where(F.col("study").contains(model) & F.col("study").contains(version))
    return hits.orderBy(F.desc("study")).limit(n)


def running_best(trials: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Trials with a value and the smallest value of the study so far.

    A study is cut into chunks of consecutive trial numbers. Each chunk is scanned by its own
    task and combined with the minimum of the chunks before it, so a study with most of the
    trials does not run in one task.
    """
    valued = trials.where(F.col("value").isNotNull()).withColumn("_chunk", F.floor(F.col("number") / chunk))
    chunks = valued.groupBy("study", "_chunk").agg(F.min("value").alias("_m"))
    before = Window.partitionBy("study").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    earlier = chunks.select("study", "_chunk", F.min("_m").over(before).alias("_before"))
    inside = Window.partitionBy("study", "_chunk").orderBy("number").rowsBetween(Window.unboundedPreceding, 0)
    scanned = valued.withColumn("_inside", F.min("value").over(inside))
    return (
        scanned.join(earlier, ["study", "_chunk"])
        .withColumn("best_value", F.least("_inside", "_before"))
        .drop("_chunk", "_inside", "_before")
    )


def convergence(trials: DataFrame, within: float = CONVERGED_WITHIN, min_trials: int = MIN_TRIALS) -> DataFrame:
    """Per study: best value, threshold, number of values, and how many values came before the
    first one within the threshold. Studies with few values or a best value out of range are left out.

    Three passes of pre-aggregated counts; no study is sorted.
    """
    valued = trials.where(F.col("value").isNotNull())
    best = (
        valued.groupBy("study")
        .agg(F.min("value").alias("best_value"), F.count("value").alias("n_values"))
        .where(F.col("best_value").between(*BEST_RANGE) & (F.col("n_values") >= min_trials))
        .withColumn("threshold", F.col("best_value") * within)
    )
    near = lookup_join(valued, best, ["study"], salt_by=["number"], how="inner")
    reached = near.where(F.col("value") <= F.col("threshold")).groupBy("study").agg(F.min("number").alias("_first"))
    earlier = (
        lookup_join(valued, reached, ["study"], salt_by=["number"], how="inner")
        .groupBy("study")
        .agg(F.count_if(F.col("number") < F.col("_first")).alias("convergence_trial"))
    )
    return best.join(earlier, "study")


def best_trial(trials: DataFrame) -> DataFrame:
    """The trial with the smallest value of every study; equal values go to the earlier trial."""
    return first_by(trials.where(F.col("value").isNotNull()), ["study"], ["value", "number"])


def trial_slices(trials: DataFrame) -> DataFrame:
    """(study, number, param, param_value, value) of every trial with a value."""
    return trials.where(F.col("value").isNotNull()).select(
        "study", "number", F.explode("params").alias("param", "param_value"), "value"
    )


def param_range(trials: DataFrame) -> DataFrame:
    """Per study and parameter: range of its numbers, or number of different values if none is a number.

    Texts beside numbers do not count for the range.
    """
    cells = trials.select("study", F.explode("params").alias("param", "raw"))
    number = F.col("raw").try_cast("double")
    by_value = cells.groupBy("study", "param", "raw").agg(F.count(F.lit(1)).alias("_n"))
    stats = by_value.groupBy("study", "param").agg(
        F.min(number).alias("min_value"),
        F.max(number).alias("max_value"),
        F.count(F.lit(1)).alias("n_values"),
    )
    numeric = F.col("min_value").isNotNull()
    return stats.select(
        "study",
        "param",
        F.when(numeric, "numeric").otherwise("categorical").alias("kind"),
        F.when(numeric, F.col("min_value")).alias("min_value"),
        F.when(numeric, F.col("max_value")).alias("max_value"),
        "n_values",
    )


def param_near_bound(trials: DataFrame, share: float = EDGE_SHARE) -> DataFrame:
    """Numeric parameters whose best value lies within ``share`` of the range from an edge."""
    best = best_trial(trials).select("study", F.explode("params").alias("param", "raw"))
    best = best.select("study", "param", F.col("raw").try_cast("double").alias("best_value"))
    joined = param_range(trials).where(F.col("kind") == "numeric").join(best, ["study", "param"])
    width = F.col("max_value") - F.col("min_value")
    near = lambda edge: F.abs(F.col("best_value") - F.col(edge)) < share * width
    side: Column = F.when(near("min_value"), "lower").when(near("max_value"), "upper")
    return (
        joined.where(width > 0)
        .withColumn("bound", side)
        .where(F.col("bound").isNotNull())
        .select("study", "param", "min_value", "max_value", "best_value", "bound")
    )
