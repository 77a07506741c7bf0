"""Replicate collapse, consensus vectors and perturbed-minus-control differences."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from .common import attach, join_groups, reuse

#: Salted parts of the feature panel when it meets the perturbations.
GRID_PARTS = 32


def collapse(df: DataFrame, by: Sequence[str], *, vec: str = "vec", count: str = "n_rep",
             min_count: int = 1, dim: int | None = None) -> DataFrame:
    """Mean vector per group and the number of rows behind it.

    Keyed by (entity, context) this collapses replicates, with a dose added it keeps
    dose levels apart, keyed by target or class it builds consensus vectors
    (``min_count`` rows at least). ``dim``, the number of features where known, lets
    short vectors do with one shuffle.
    """
    by = list(by)
    df = V.with_whole_vectors(df, vec, dim)
    if V.is_wide(dim):
        g = df.groupBy(*by).agg(F.count(F.lit(1)).alias(count), V.feature_array(vec, dim, F.avg).alias(vec))
        return g.filter(F.col(count) >= min_count)
    width = V.CHUNK
    chunks = V.explode_chunks(df, by, {"v": vec})
    means = chunks.groupBy(*by, "_chunk").agg(
        F.max("_dim").alias("_dim"), F.count(F.lit(1)).alias("_n"),
        *[F.avg(f"v_{k}").alias(f"v_{k}") for k in range(width)],
    )
    if min_count > 1:
        means = means.filter(F.col("_n") >= min_count)
    out = V.assemble(means, by, ["v"], extra=[F.max("_n").alias(count)])
    return out.select(*by, count, F.col("v").alias(vec))


def long_to_vectors(df: DataFrame, by: Sequence[str], idx: Column, x: Column, dim: int, *,
                    vec: str = "vec", centred: bool = False) -> DataFrame:
    """Long (idx, x) rows to one dense vector per group, absent features as 0; ``centred`` takes off its mean.

    ``dim`` conditional sums in one aggregate: one shuffled row per group. An index outside
    [0, dim) is an error, not a feature to leave out.
    """
    sound = F.when(idx.isNull() | ((idx >= 0) & (idx < dim)), idx)
    idx = F.coalesce(sound, F.when(idx.isNotNull(), F.raise_error(F.lit(f"a feature index lies outside [0, {dim})")).cast("int")))
    sums = [F.sum(F.when(F.col("_idx") == i, F.col("_x"))) for i in range(dim)]
    cells = [F.coalesce(s.cast("double"), F.lit(0.0)) for s in sums]
    # The mean is an aggregate too: taken from the vector, the optimizer would put it into every feature and every filter.
    total = F.coalesce(F.sum(F.when(F.col("_idx").isNotNull(), F.col("_x"))).cast("double"), F.lit(0.0))
    return df.select(*by, idx.alias("_idx"), x.alias("_x")).groupBy(*by).agg(
        F.array(*[c - total / dim if centred else c for c in cells]).alias(vec)
    )


def with_min_contexts(df: DataFrame, entity: Sequence[str], context: str, k: int) -> DataFrame:
    """Keep entities observed in at least ``k`` distinct contexts."""
    seen = df.select(*entity, context).distinct().groupBy(*entity).count()
    return df.join(seen.filter(F.col("count") >= k).select(*entity), list(entity), "left_semi")


def pick_control_label(cells: DataFrame, label: str,
                       priority: Sequence[str] = ("non-targeting", "control", "")) -> DataFrame:
    """The first control label, in order of priority, that any cell carries (one row).

    Without any such cell the query fails: there is nothing to compare with.
    """
    rank = F.coalesce(*[F.when(F.col(label) == p, F.lit(i)) for i, p in enumerate(priority)])
    hits = cells.filter(F.col(label).isin(*priority))
    found = hits.agg(F.min_by(label, rank).alias("control_label"))
    return found.select(F.coalesce("control_label", F.raise_error(F.lit("no cell carries a control label"))).alias("control_label"))


def difference_signature(expr: DataFrame, cells: DataFrame, features: DataFrame | None = None, *,
                         cell: str = "cell_id", label: str = "perturbation",
                         feature: str = "feature", x: str = "x", min_cells: int = 10,
                         controls: Sequence[str] = ("non-targeting", "control", "")) -> DataFrame:
    """Mean expression of each perturbation minus the control mean, on the feature panel (all features of ``expr`` unless given).

    ``expr`` is sparse and long: a missing (cell, feature) is a zero, so sums are
    divided by the number of cells of the label and not by the number of rows.
    Returns label, n_cells, feature, diff, without perturbations of zero norm.
    """
    control = pick_control_label(cells, label, controls)
    sizes = reuse(cells.groupBy(label).agg(F.count(F.lit(1)).alias("n_cells")))
    if features is not None:
        expr = expr.join(features.select(feature).distinct(), feature, "left_semi")
    labelled = expr.join(cells.select(cell, label), cell)
    sums = reuse(labelled.groupBy(label, feature).agg(F.sum(x).alias("sum_x")))
    ctl = attach(sums.join(sizes, label), control, [])
    ctl_mean = ctl.filter(F.col(label) == F.col("control_label")).select(
        feature, (F.col("sum_x") / F.col("n_cells")).alias("control_mean"))
    perturbed = sizes.filter(~F.col(label).isin(*controls) & (F.col("n_cells") >= min_cells))
    # Every perturbation meets every measured feature (that grid is the result); what it
    # does not express is zero. The join is on a constant key so that the planner may
    # broadcast the narrower side by its size, and shuffles it in salted parts otherwise.
    own = join_groups(sums, perturbed, [label]).select(
        label, "n_cells", feature, (F.col("sum_x") / F.col("n_cells")).alias("own"))
    panel = sums.select(feature).distinct().join(ctl_mean, feature, "left").select(
        feature, F.coalesce("control_mean", F.lit(0.0)).alias("control_mean"),
        F.explode(F.sequence(F.lit(0), F.lit(GRID_PARTS - 1))).alias("_part"))
    parts = perturbed.withColumn("_part", F.pmod(F.xxhash64(label), F.lit(GRID_PARTS)).cast("int"))
    grid = parts.join(panel, "_part").drop("_part")
    diff = join_groups(grid, own.drop("n_cells"), [label, feature], "left").select(
        label, "n_cells", feature,
        (F.coalesce("own", F.lit(0.0)) - F.col("control_mean")).alias("diff"))
    norms = diff.groupBy(label).agg(F.sqrt(F.sum(F.col("diff") * F.col("diff"))).alias("_norm"))
    return diff.join(norms.filter(F.col("_norm") > 1e-10).select(label), label, "left_semi")


def zero_fill(panel: DataFrame, values: DataFrame, on: Sequence[str], x: str = "x") -> DataFrame:
    """Panel rows with their value, absent ones as 0."""
    return panel.join(values, list(on), "left").withColumn(x, F.coalesce(F.col(x), F.lit(0.0)))
