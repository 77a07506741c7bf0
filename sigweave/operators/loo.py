"""Leave-one-context-out evaluation without materializing the splits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import vectors as V
from . import blocks
from .common import attach, join_groups, reuse
from .geometry import vector_sums
from .rankstats import spearman_columns, wilcoxon_signed_rank


def holdout_rows(df: DataFrame, by: Sequence[str], context: str, *, vec: str = "vec",
                 min_train: int = 4, eps: float = 1e-10, dim: int | None = None) -> DataFrame:
    """Train-side DI and hold-out cosine of every (entity, held-out context).

    With T and M the unit and raw sums of an entity, holding h out leaves T - u_h
    and M - s_h, so each row needs two dot products and no other row.
    """
    by = list(by)
    sums = vector_sums(df, by, vec, eps=eps, dim=dim).filter(F.col("k") > min_train).select(
        "*", V.sumsq("sum_unit").alias("_t2"), V.sumsq("sum_raw").alias("_m2"))
    rows = df.select(*by, context, F.col(vec).alias("_s"), V.norm(vec).alias("_n"))
    rows = join_groups(rows, sums, by)
    inv = V.inverse_norm(F.col("_n"), eps)
    rows = rows.select(
        *by, context, "k", "sum_u2", "_t2", "_m2", "_n", "_s", inv.alias("_inv"),
        (V.dot("_s", "sum_unit") * inv).alias("g"), V.dot("_s", "sum_raw").alias("_r"))
    k = F.col("k")
    u2 = (F.col("_n") * F.col("_inv")) ** 2
    t2 = F.greatest(F.lit(0.0), F.col("_t2") - 2.0 * F.col("g") + u2)
    m2 = F.greatest(F.lit(0.0), F.col("_m2") - 2.0 * F.col("_r") + F.col("_n") ** 2)
    cos = V.cosine((F.col("_r") - F.col("_n") ** 2) / (k - 1), F.col("_n"),
                   F.sqrt(m2) / (k - 1), eps=1e-10)
    di = 1.0 - (t2 - (F.col("sum_u2") - u2)) / ((k - 1) * (k - 2))
    return rows.select(
        *by, context, (k - 1).alias("n_train"), di.alias("train_di"), cos.alias("holdout_cosine"),
        V.scale("_s", F.col("_inv")).alias("u"), "g",
        (F.sqrt(t2) + 1e-10 * (k - 1)).alias("t"))


def leave_one_out(df: DataFrame, by: Sequence[str], context: str, *, vec: str = "vec",
                  min_train: int = 4, penalty: float = 1.0,
                  block_size: int = blocks.BLOCK_SIZE, dim: int | None = None) -> DataFrame:
    """``holdout_rows`` plus the train-side Fréchet variance and transport-stable score."""
    by = list(by)
    rows = holdout_rows(df, by, context, vec=vec, min_train=min_train, dim=dim)
    payload = ["u", "g", "t", "n_train", "train_di", "holdout_cosine"]
    pairs = blocks.block_pairs(rows, by, context, payload, block_size, F.col("n_train") + 1)
    out = [T.StructField("member", df.schema[context].dataType), T.StructField("n_train", T.LongType()),
           T.StructField("train_di", T.DoubleType()), T.StructField("holdout_cosine", T.DoubleType()),
           T.StructField("partial", T.DoubleType())]
    partial = blocks.map_blocks(pairs, by, blocks.angular_spread_kernel, out)
    whole = partial.groupBy(*by, F.col("member").alias(context)).agg(
        F.max("n_train").alias("n_train"), F.max("train_di").alias("train_di"),
        F.max("holdout_cosine").alias("holdout_cosine"), F.sum("partial").alias("_angles"))
    fv = F.col("_angles") / F.col("n_train")
    return whole.withColumn("train_frechet", fv).withColumn(
        "train_ts", F.col("train_di") - float(penalty) * fv).drop("_angles")


def sweep_penalty(loo: DataFrame, penalties: Sequence[float], name: str = "penalty") -> DataFrame:
    """One copy of each hold-out row per penalty, with its transport-stable score."""
    lams = F.array(*[F.lit(float(p)) for p in penalties])
    out = loo.withColumn(name, F.explode(lams))
    return out.withColumn("train_ts", F.col("train_di") - F.col(name) * F.col("train_frechet"))


def fold_table(loo: DataFrame, context: str, *, by: Sequence[str] = (), min_n: int = 20,
               digits: int = 12) -> DataFrame:
    """Per held-out context: Spearman of DI and of TS against the hold-out cosine, strict win.

    Scores are rounded to ``digits`` so that equal scores tie in every evaluation.
    """
    keys = [*by, context]
    scores = loo.select(
        *keys, F.round("train_di", digits).alias("raw_spearman"), F.round("train_ts", digits).alias("ts_spearman"),
        F.round("holdout_cosine", digits).alias("_held"))
    folds = spearman_columns(scores, keys, ["raw_spearman", "ts_spearman"], "_held").filter(F.col("n") >= min_n)
    return folds.withColumn("delta", F.round(F.col("ts_spearman") - F.col("raw_spearman"), digits)).withColumn(
        "ts_wins", F.col("delta") > 0)


def fold_summary(folds: DataFrame, *, by: Sequence[str] = (), win_fraction: float = 0.8) -> DataFrame:
    """Wins, mean/std of the gain, median fold size, adjusted threshold, Wilcoxon on the gains.

    Fold counts are bounded by the number of contexts, so the medians are built in.
    """
    by = list(by)
    folds = reuse(folds)
    g = folds.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_folds"),
        F.sum(F.col("ts_wins").cast("int")).alias("wins"),
        F.avg("delta").alias("mean_delta"), F.stddev_pop("delta").alias("std_delta"),
        F.avg("raw_spearman").alias("mean_raw"), F.avg("ts_spearman").alias("mean_ts"),
        F.percentile("n", F.lit(0.5)).alias("median_n"))
    needed = F.ceil(win_fraction * F.col("n_folds"))
    g = g.withColumn("win_fraction", F.col("wins") / F.col("n_folds")).withColumn(
        "needed_wins", needed).withColumn("confirmed", F.col("wins") >= needed)
    w = wilcoxon_signed_rank(folds, by, "delta", alternative="greater", bounded=True)
    if by:
        return join_groups(g, w, by, "left")
    return attach(g, w, [])


def holdout_summary(loo: DataFrame, by: Sequence[str], *, cut: float = 0.5) -> DataFrame:
    """Per entity: mean hold-out cosine, share of hold-outs above ``cut``, mean train DI."""
    return loo.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_folds"), F.avg("holdout_cosine").alias("mean_heldout_cosine"),
        F.avg((F.col("holdout_cosine") > cut).cast("int")).alias("frac_consistent"),
        F.avg("train_di").alias("mean_loo_di"))


def first_contexts(df: DataFrame, context: str, n: int = 5) -> DataFrame:
    """The ``n`` contexts that come first in name order, used as folds."""
    return df.select(context).distinct().orderBy(context).limit(n)
