"""Coding-vector instability of recorded regions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import attach, reuse, sent
from .groups import quantile_group


def coding_vector_instability(activity: DataFrame, trials: DataFrame, *, window: tuple[int, int] = (15, 35),
                              min_trials: int = 5, min_vectors: int = 3, region: str = "region",
                              evidence: str | None = None) -> DataFrame:
    """1 - mean pairwise cosine of the choice-coding vectors across evidence quartiles.

    ``activity(region, trial, neuron, t, x)``, ``trials(region, trial, y)`` with the
    lowest two y values as the classes. Quartiles are those of ``evidence``, by default
    of |y - mean y|. All in long form: vectors are never collected, the pair sum follows from the per-neuron
    sums of the unit vectors. ``corrected`` is raw / sqrt(n_neurons), all neurons recorded in the
    region, in the window and kept quartiles or not.
    """
    mean_y = trials.groupBy(region).agg(F.avg("y").alias("_my"), F.min("y").alias("_y0"))
    t = trials.join(sent(mean_y), region).withColumn(
        "_dev",
        F.col(evidence) if evidence else F.round(F.abs(F.col("y") - F.col("_my")), 12))
    second = t.filter(F.col("y") > F.col("_y0")).groupBy(region).agg(F.min("y").alias("_y1"))
    t = quantile_group(t.join(sent(second), region), [region], "_dev", 4, "q")
    kept = t.groupBy(region, "q").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= min_trials)
    t = t.join(sent(kept.select(region, "q")), [region, "q"], "left_semi").select(
        region, "trial", "q", F.when(F.col("y") == F.col("_y0"), 0).when(F.col("y") == F.col("_y1"), 1).alias("_c"))
    lo, hi = window
    seen = activity.filter((F.col("t") >= lo) & (F.col("t") < hi)).groupBy(region, "trial", "neuron").agg(
        F.avg("x").alias("_x"))
    j = seen.join(t, [region, "trial"])
    diff = reuse(j.groupBy(region, "q", "neuron").agg(
        (F.avg(F.when(F.col("_c") == 1, F.col("_x"))) - F.avg(F.when(F.col("_c") == 0, F.col("_x")))).alias("_d")))
    norms = diff.groupBy(region, "q").agg(F.sqrt(F.sum(F.col("_d") ** 2)).alias("_n")).filter(F.col("_n") > 1e-10)
    unit = diff.join(norms, [region, "q"]).withColumn("_u", F.col("_d") / F.col("_n"))
    sums = unit.groupBy(region, "neuron").agg(F.sum("_u").alias("_t"), F.sum(F.col("_u") ** 2).alias("_s"))
    vectors = norms.groupBy(region).agg(F.count(F.lit(1)).alias("n_vectors"))
    neurons = activity.select(region, "neuron").distinct().groupBy(region).agg(F.count("neuron").alias("n_neurons"))
    g = sums.groupBy(region).agg(F.sum(F.col("_t") ** 2).alias("_t2"), F.sum("_s").alias("_s")).join(vectors, region).join(neurons, region)
    g = g.filter(F.col("n_vectors") >= min_vectors)
    k = F.col("n_vectors")
    raw = 1.0 - (F.col("_t2") - F.col("_s")) / (k * (k - 1))
    return g.select(region, "n_neurons", "n_vectors", raw.alias("raw"),
                    size_corrected(raw, F.col("n_neurons")).alias("corrected"))


def size_corrected(x, n):
    """x / sqrt(n)."""
    return x / F.sqrt(n)


def with_effects(scores: DataFrame, effects: DataFrame, region: str = "region") -> DataFrame:
    """Regions measured on both sides."""
    return scores.join(effects, region)


def population_flags(df: DataFrame, x: str, out: str = "below_median") -> DataFrame:
    """Flag rows below the population median of ``x``."""
    from .ladder import quantiles
    med = quantiles(df, [], x, {"population_median": 0.5})
    return attach(df, med, []).withColumn(out, F.col(x) < F.col("population_median"))
