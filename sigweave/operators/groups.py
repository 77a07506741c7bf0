"""Group comparisons: effect sizes, summaries, bins, matched comparisons."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import attach, join_groups, reuse, sent
from .ladder import quantiles, row_index


def cohens_d(df: DataFrame, by: Sequence[str], value: str, group: str, *, ddof: int = 1) -> DataFrame:
    """Effect size of rows with ``group`` = 1 against 0, pooled SD; 0 when the SD is below 1e-10.

    ``ddof`` = 0 puts population variances in the pooled formula.
    """
    one = F.col(group).cast("int") == 1
    zero = F.col(group).cast("int") == 0
    var = F.var_samp if ddof == 1 else F.var_pop
    a, b = F.when(one, F.col(value)), F.when(zero, F.col(value))
    g = df.groupBy(*by).agg(F.count(a).alias("n1"), F.count(b).alias("n2"), F.avg(a).alias("mean1"),
                            F.avg(b).alias("mean2"), var(a).alias("_v1"), var(b).alias("_v2"))
    return g.select(*by, "n1", "n2", "mean1", "mean2",
                    effect_size("n1", "n2", "mean1", "mean2", "_v1", "_v2").alias("cohens_d"))


def effect_size(n1, n2, m1, m2, v1, v2) -> Column:
    n1, n2, m1, m2, v1, v2 = [F.col(c) if isinstance(c, str) else c for c in (n1, n2, m1, m2, v1, v2)]
    dof = n1 + n2 - 2
    sd = F.sqrt(F.try_divide((n1 - 1) * v1 + (n2 - 1) * v2, dof.cast("double")))
    ok = (n1 > 0) & (n2 > 0) & (dof > 0)
    return F.when(ok, F.when(sd >= 1e-10, F.try_divide(m1 - m2, sd)).otherwise(0.0))


def group_summary(df: DataFrame, by: Sequence[str], value: str,
                  probs: dict[str, float] | None = None) -> DataFrame:
    """n, mean, population SD, and exact quantiles (the median unless told otherwise)."""
    probs = probs or {"median": 0.5}
    base = df.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"),
                               F.stddev_pop(value).alias("std"))
    return attach(base, quantiles(df, by, value, probs), by)


def fractions(df: DataFrame, by: Sequence[str], tests: dict[str, Column]) -> DataFrame:
    """Share of rows that satisfy each predicate, and n."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"),
                               *[F.avg(p.cast("double")).alias(k) for k, p in tests.items()])


def class_counts(df: DataFrame, cls: str) -> DataFrame:
    return df.groupBy(cls).agg(F.count(F.lit(1)).alias("n"))


def ratio_bin(ratio: Column, edges: Sequence[float], labels: Sequence[str],
              other: str = "unbinned") -> Column:
    """Half-open bins [edge_i, edge_i+1); everything else lands in ``other``."""
    out = F.lit(other)
    for lo, hi, name in reversed(list(zip(edges, edges[1:], labels))):
        out = F.when((ratio >= float(lo)) & (ratio < float(hi)), name).otherwise(out)
    return out


def digitize(x: Column, edges: Sequence[Column]) -> Column:
    """How many edges are <= x."""
    total = F.lit(0)
    for e in edges:
        total = total + (e <= x).cast("int")
    return total


def quantile_group(df: DataFrame, by: Sequence[str], x: str, n: int, out: str = "bin") -> DataFrame:
    """Assign 0..n-1 by the group's interior quantiles, lower edge inclusive."""
    probs = {f"_e{i}": i / n for i in range(1, n)}
    edges = quantiles(df, by, x, probs)
    j = attach(df, sent(edges) if by else edges, by)
    return j.withColumn(out, digitize(F.col(x), [F.col(c) for c in probs])).drop(*probs)


def two_level_mean(df: DataFrame, inner: Sequence[str], outer: Sequence[str], value: str) -> DataFrame:
    """Mean of the inner-group means per outer group."""
    first = df.groupBy(*inner).agg(F.avg(value).alias("_m"))
    return first.groupBy(*outer).agg(F.count(F.lit(1)).alias("n_groups"), F.avg("_m").alias("mean_value"))


def lowest(df: DataFrame, order: str, tie: str, n: int) -> DataFrame:
    """Top-n report in ascending order."""
    return df.orderBy(F.asc(order), F.asc(tie)).limit(n)


def stratified_effect(df: DataFrame, strata: Sequence[str], value: str, group: str) -> DataFrame:
    """Effect size in every stratum; flat effects across strata speak against a size artefact."""
    return cohens_d(df, strata, value, group)


def flatness(effects: DataFrame, tolerance: float = 0.5) -> DataFrame:
    """Range of the per-stratum effects against a tolerance."""
    g = effects.agg(F.count("cohens_d").alias("n_strata"), F.min("cohens_d").alias("d_min"),
                    F.max("cohens_d").alias("d_max"))
    spread = F.col("d_max") - F.col("d_min")
    return g.withColumn("d_range", spread).withColumn("flat", spread <= tolerance)


def match_report(df: DataFrame, strata: Sequence[str], group: str) -> DataFrame:
    """Per stratum: rows of either group, how many of each can be matched, and how many cannot.

    NULL is a stratum like any other; rows of neither group do not count.
    """
    one, zero = [F.count_if(F.col(group).cast("int") == g) for g in (1, 0)]
    g = df.groupBy(*strata).agg(one.alias("n1"), zero.alias("n2"))
    matched = F.least("n1", "n2")
    return g.select(*strata, "n1", "n2", matched.alias("n_matched"), (F.col("n1") - matched).alias("unmatched1"),
                    (F.col("n2") - matched).alias("unmatched2"))


def matched_rows(df: DataFrame, strata: Sequence[str], group: str, key: str, *, seed: int = 0) -> DataFrame:
    """Equally many rows of both groups per stratum (NULL is one), the choice fixed by a hash of the key."""
    order = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.col(key).cast("string"))), 1, 12),
                   16, 10).cast("long")
    both = reuse(df.filter(F.col(group).cast("int").isin(0, 1)))
    by = [*strata, group]
    placed = row_index(both.withColumn("_h", order), by, ["_h", key], "_pos").drop("_h", "n")
    sizes = match_report(both, strata, group).select(*strata, F.col("n_matched").alias("_k"))
    return attach(placed, sizes, strata).filter(F.col("_pos") < F.col("_k")).drop("_pos", "_k")


def size_matched_effect(df: DataFrame, key: str, value: str, group: str, size: str, bins: int, *, seed: int = 0) -> DataFrame:
    """Effect size between the groups after coarsened matching on a size column.

    The size is cut at its quantiles over both groups, each bin keeps equally many rows of
    either, and what is left without a partner is counted. Rows without a size form a bin of their own.
    """
    rows = df.filter(F.col(group).cast("int").isin(0, 1)).select(key, value, group, size)
    binned = reuse(quantile_group(rows, [], size, bins, "_bin"))
    effect = cohens_d(matched_rows(binned, ["_bin"], group, key, seed=seed), [], value, group)
    left = match_report(binned, ["_bin"], group).agg(F.sum("unmatched1").alias("unmatched1"), F.sum("unmatched2").alias("unmatched2"))
    return attach(effect, left, []).select("n1", "n2", "unmatched1", "unmatched2", "mean1", "mean2", "cohens_d")


def normalized_spread(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """SD / |mean| of a scalar per entity."""
    g = df.groupBy(*by).agg(F.stddev_pop(value).alias("_sd"), F.avg(value).alias("_m"))
    return g.select(*by, F.when(F.abs("_m") > 0, F.try_divide(F.col("_sd"), F.abs("_m"))).alias("spread"))


def odds_ratio(df: DataFrame, by: Sequence[str], in_set: Column, hit: Column) -> DataFrame:
    """2x2 table of set membership against a hit flag, odds ratio and Fisher's two-sided p."""
    from ..functions.pvalues import fisher_two_sided_p
    cell = lambda p: F.sum(p.cast("long"))
    g = df.groupBy(*by).agg(cell(in_set & hit).alias("a"), cell(in_set & ~hit).alias("b"),
                            cell(~in_set & hit).alias("c"), cell(~in_set & ~hit).alias("d"))
    ratio = F.when((F.col("b") > 0) & (F.col("c") > 0),
                   F.try_divide(F.col("a").cast("double") * F.col("d"),
                                F.col("b").cast("double") * F.col("c")))
    return g.withColumn("odds_ratio", ratio).withColumn(
        "fisher_p", fisher_two_sided_p(*[F.col(x) for x in "abcd"]))


def detection_limit(df: DataFrame, k: str, sigma: str, score: str, *, power: float = 0.95) -> DataFrame:
    """Per k: 95th percentile at the smallest sigma as threshold, and the smallest sigma whose
    scores exceed it with at least ``power``.

    Returns every (k, sigma) with its share above, plus the limit of its k.
    """
    start = df.groupBy(k).agg(F.min(sigma).alias("_s0"))
    null = join_groups(df, start, [k]).filter(F.col(sigma) == F.col("_s0"))
    cut = quantiles(null, [k], score, {"null_threshold": 0.95})
    above = join_groups(df, cut, [k]).groupBy(k, sigma).agg(
        F.max("null_threshold").alias("null_threshold"),
        F.avg((F.col(score) > F.col("null_threshold")).cast("double")).alias("frac_above"))
    limit = above.groupBy(k).agg(
        F.min(F.when(F.col("frac_above") >= power, F.col(sigma))).alias("limit_sigma"))
    return join_groups(above, limit, [k])


def best_match(df: DataFrame, setting: str, score: str, target_mean: Column, target_std: Column) -> DataFrame:
    """The setting whose score distribution is closest to a target mean and SD.

    distance = |mean - target| + 0.1 |ratio of SDs - 1|; ties go to the smallest setting.
    """
    g = df.groupBy(setting).agg(F.avg(score).alias("mean"), F.stddev_pop(score).alias("std"))
    g = g.withColumn("mean_err", F.abs(F.col("mean") - target_mean)).withColumn(
        "std_ratio", F.when((F.col("std") > 0) & (target_std > 0),
                            F.greatest(F.try_divide(F.col("std"), target_std),
                                       F.try_divide(target_std, F.col("std")))))
    g = g.withColumn("distance", F.col("mean_err") + 0.1 * F.abs(F.col("std_ratio") - 1.0))
    return g.orderBy(F.asc_nulls_last("distance"), F.asc(setting)).limit(1).withColumn(
        "match_ok", (F.col("mean_err") < 0.05) & (F.col("std_ratio") < 2.0))


def first_per_key(df: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One whole row per key, the smallest by ``order``; an aggregate, so hot keys combine early."""
    rest = [c for c in df.columns if c not in by and c not in order]
    g = df.groupBy(*by).agg(F.min(F.struct(*order, *rest)).alias("_row"))
    return g.select(*by, *[F.col(f"_row.{c}").alias(c) for c in [*order, *rest]])
