"""Thresholded outcomes and classifier metrics: AUROC, average precision, macro averages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import attach, join_groups, without_nan
from .ladder import ladder, quantiles, running


def at_least(x: Column | str, cut: Column | float) -> Column:
    """1 when x >= cut."""
    return (_c(x) >= cut).cast("int")


def above(x: Column | str, cut: Column | float) -> Column:
    """1 when x > cut."""
    return (_c(x) > cut).cast("int")


def _c(x):
    return F.col(x) if isinstance(x, str) else x


def orient(x: Column | str, higher_is_worse: Column | bool) -> Column:
    """Negate scores whose high values are bad, so that higher predicts the positive class."""
    if isinstance(higher_is_worse, bool):
        return -_c(x) if higher_is_worse else _c(x)
    return F.when(higher_is_worse, -_c(x)).otherwise(_c(x))


def label_by_median(df: DataFrame, by: Sequence[str], x: str, out: str = "label") -> DataFrame:
    """Positive when x is at or above the group's median."""
    cut = quantiles(df, by, x, {"_cut": 0.5})
    return attach(df, cut, by).withColumn(out, at_least(x, F.col("_cut"))).drop("_cut")


def _rows(df: DataFrame, by: Sequence[str], score: str, label: str, weight: str | None) -> DataFrame:
    """Score with its positive weight ``p`` and negative weight ``q``."""
    w = F.col(weight) if weight else F.lit(1).cast("long")
    pos = F.when(F.col(label) == 1, w).otherwise(0)
    number = without_nan(F.col(score).cast("double"), "double")
    return df.filter(number.isNotNull() & F.col(label).isNotNull()).select(
        *by, number.alias("_score"), pos.alias("p"), (w - pos).alias("q"))


def auroc(df: DataFrame, by: Sequence[str], score: str, label: str, *,
          weight: str | None = None, out: str = "auroc") -> DataFrame:
    """Area under the ROC curve per group, ties counted half; NULL with one class only."""
    cells = _rows(df, by, score, label, weight).groupBy(*by, "_score").agg(
        F.sum("p").alias("p"), F.sum("q").alias("q"))
    lad = running(cells.withColumn("w", F.col("p") + F.col("q")), by, ["_score"], ["w"])
    rank = F.col("w_before") + (F.col("w") + 1) / 2.0
    g = lad.groupBy(*by).agg(F.sum("p").alias("n_pos"), F.sum("q").alias("n_neg"),
                             F.sum(F.col("p") * rank).alias("_r"))
    both = (F.col("n_pos") > 0) & (F.col("n_neg") > 0)
    u = F.col("_r") - F.col("n_pos") * (F.col("n_pos") + 1) / 2.0
    value = F.when(both, F.try_divide(u, F.col("n_pos").cast("double") * F.col("n_neg")))
    return g.select(*by, "n_pos", "n_neg", value.alias(out))


def average_precision(df: DataFrame, by: Sequence[str], score: str, label: str, *,
                      weight: str | None = None, out: str = "auprc") -> DataFrame:
    """Step-wise average precision per group; NULL without positives."""
    lad = ladder(_rows(df, by, score, label, weight), by, "_score", ["p", "q"], descending=True)
    tp = F.col("p_before") + F.col("p")
    seen = tp + F.col("q_before") + F.col("q")
    g = lad.groupBy(*by).agg(
        F.sum("p").alias("n_pos"), F.sum("q").alias("n_neg"),
        F.sum(F.try_divide(F.col("p") * tp, seen)).alias("_a"))
    value = F.when(F.col("n_pos") > 0, F.try_divide(F.col("_a"), F.col("n_pos")))
    return g.select(*by, "n_pos", "n_neg", value.alias(out))


def roc_and_pr(df: DataFrame, by: Sequence[str], score: str, label: str, *,
               weight: str | None = None) -> DataFrame:
    """Both metrics from one descending ladder."""
    lad = ladder(_rows(df, by, score, label, weight), by, "_score", ["p", "q"], descending=True)
    tp = F.col("p_before") + F.col("p")
    seen = tp + F.col("q_before") + F.col("q")
    below = F.col("q_total") - F.col("q_before") - F.col("q") / 2.0
    g = lad.groupBy(*by).agg(
        F.sum("p").alias("n_pos"), F.sum("q").alias("n_neg"),
        F.sum(F.col("p") * below).alias("_u"),
        F.sum(F.try_divide(F.col("p") * tp, seen)).alias("_a"))
    both = (F.col("n_pos") > 0) & (F.col("n_neg") > 0)
    return g.select(
        *by, "n_pos", "n_neg",
        F.when(both, F.try_divide(F.col("_u"), F.col("n_pos").cast("double") * F.col("n_neg"))).alias("auroc"),
        F.when(both, F.try_divide(F.col("_a"), F.col("n_pos"))).alias("auprc"))


def one_vs_rest_auroc(df: DataFrame, by: Sequence[str], score: str, cls: str, *,
                      min_class: int = 10, classes: DataFrame | None = None,
                      weight: str | None = None) -> DataFrame:
    """AUROC of each eligible class against all other rows of the group.

    The negatives of a class are "everything else", so one ladder over all rows
    plus the rows of each class give every class without copying the table per
    class: below_others = below_all - below_own_class.
    ``classes`` (by, cls) fixes the eligible classes; by default those with
    ``min_class`` rows. A class with fewer than 2 rows, or all of them, is skipped.
    """
    by = list(by)
    w = F.col(weight) if weight else F.lit(1).cast("long")
    rows = df.filter(F.col(score).isNotNull()).select(
        *by, cls, F.col(score).cast("double").alias("_score"), w.alias("a"), w.alias("c"))
    all_ladder = ladder(rows, by, "_score", ["a"])
    own = ladder(rows.filter(F.col(cls).isNotNull()), [*by, cls], "_score", ["c"])
    j = join_groups(own, all_ladder, [*by, "_score"])
    rest_before = F.col("a_before") - F.col("c_before")
    rest_here = F.col("a") - F.col("c")
    g = j.groupBy(*by, cls).agg(
        F.max("c_total").alias("n_pos"), F.max(F.col("a_total") - F.col("c_total")).alias("n_neg"),
        F.sum(F.col("c") * (rest_before + rest_here / 2.0)).alias("_u"))
    if classes is not None:
        shared = [c for c in [*by, cls] if c in classes.columns]
        g = g.join(classes, shared, "left_semi")
    else:
        g = g.filter(F.col("n_pos") >= min_class)
    g = g.filter((F.col("n_pos") >= 2) & (F.col("n_neg") > 0))
    return g.select(*by, cls, "n_pos", "n_neg",
                    F.try_divide(F.col("_u"), F.col("n_pos").cast("double") * F.col("n_neg")).alias("auroc"))


def macro_auroc(df: DataFrame, by: Sequence[str], score: str, cls: str, *, min_class: int = 10,
                classes: DataFrame | None = None, weight: str | None = None) -> DataFrame:
    """Unweighted mean over classes of the one-vs-rest AUROC."""
    per = one_vs_rest_auroc(df, by, score, cls, min_class=min_class, classes=classes, weight=weight)
    return per.groupBy(*by).agg(F.count(F.lit(1)).alias("n_classes"), F.avg("auroc").alias("macro_auroc"))


def residualize(df: DataFrame, by: Sequence[str], x: str, covariate: str, out: str) -> DataFrame:
    """x minus its least-squares fit on the covariate and an intercept.

    A constant covariate leaves x minus its mean. Slope and means rest on the same rows,
    those with both values; other rows get NULL.
    """
    slope = F.coalesce(F.regr_slope(x, covariate), F.lit(0.0))
    fit = df.groupBy(*by).agg(slope.alias("_b"), F.regr_avgy(x, covariate).alias("_mx"), F.regr_avgx(x, covariate).alias("_mc"))
    resid = F.col(x) - F.col("_mx") - F.col("_b") * (F.col(covariate) - F.col("_mc"))
    return attach(df, fit, by).withColumn(out, resid).drop("_b", "_mx", "_mc")


def base_rate(df: DataFrame, by: Sequence[str], label: str) -> DataFrame:
    return df.groupBy(*by).agg(F.count(label).alias("n"), F.sum(F.col(label).cast("long")).alias("n_pos"),
                               F.avg(F.col(label).cast("double")).alias("base_rate"))
