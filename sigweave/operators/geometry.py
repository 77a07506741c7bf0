"""Vector geometry per entity: direction instability and its relatives.

Notation: s_i the vector of context i, u_i = s_i / max(|s_i|, eps), T = sum u_i,
K contexts. No operator here forms pairs: sums over pairs follow from T.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from .common import attach, join_groups


def _with_norms(df: DataFrame, by: Sequence[str], vecs: dict[str, str], eps: float) -> DataFrame:
    """Vectors with their norm ``_n_*`` and its inverse ``_inv_*``."""
    rows = df.select(*by, *vecs.values(), *[V.norm(c).alias(f"_n_{o}") for o, c in vecs.items()])
    return rows.select("*", *[V.inverse_norm(F.col(f"_n_{o}"), eps).alias(f"_inv_{o}") for o in vecs])


def _unit_chunks(df: DataFrame, by: Sequence[str], vecs: dict[str, str], eps: float) -> DataFrame:
    prepared = _with_norms(df, by, vecs, eps)
    keep = [*by, *[f"_inv_{o}" for o in vecs], *[f"_n_{o}" for o in vecs]]
    return V.explode_chunks(prepared, keep, vecs)


def direction_instability(df: DataFrame, by: Sequence[str], vecs: dict[str, str], *,
                          eps: float = V.EPS_UNIT, count: str = "n_contexts",
                          dim: int | None = None) -> DataFrame:
    """1 - mean pairwise cosine of an entity's vectors, for one or more vector columns.

    ``vecs`` maps output names to vector columns. sum_{i<j} u_i.u_j equals
    (|T|^2 - sum |u_i|^2) / 2, so only per-feature sums are shuffled. NULL below
    two vectors. A NULL or empty vector is no context; with ``dim``, a vector of another
    length is an error.
    """
    by = list(by)
    names = list(vecs)
    for c in vecs.values():
        df = V.with_whole_vectors(df, c, dim)
    if V.is_wide(dim):
        rows = _with_norms(df, by, vecs, eps)
        total = rows.groupBy(*by).agg(
            F.count(F.lit(1)).alias(count),
            *[F.sum((F.col(f"_n_{o}") * F.col(f"_inv_{o}")) ** 2).alias(f"_s_{o}") for o in names],
            *[V.feature_array(c, dim, lambda x, o=o: F.sum(x * F.col(f"_inv_{o}"))).alias(f"_v_{o}")
              for o, c in vecs.items()])
        return _instability(total.select("*", *[V.sumsq(f"_v_{o}").alias(f"_t_{o}") for o in names]),
                            by, names, count)
    chunks = _unit_chunks(df, by, vecs, eps)
    sums = chunks.groupBy(*by, "_chunk").agg(
        F.count(F.lit(1)).alias("_k"), F.min("_dim").alias("_least"), F.max("_dim").alias("_most"),
        *[F.sum((F.col(f"_n_{o}") * F.col(f"_inv_{o}")) ** 2).alias(f"_s_{o}") for o in names],
        *[F.sum(F.col(f"{o}_{j}") * F.col(f"_inv_{o}")).alias(f"{o}_{j}")
          for o in names for j in range(V.CHUNK)],
    )
    total = sums.groupBy(*by).agg(
        V.one_length(F.max("_k")).alias(count),
        *[F.max(f"_s_{o}").alias(f"_s_{o}") for o in names],
        *[F.sum(_square_sum(o)).alias(f"_t_{o}") for o in names],
    )
    return _instability(total, by, names, count)


def _instability(total: DataFrame, by: list[str], names: list[str], count: str) -> DataFrame:
    k = F.col(count)
    scores = [
        F.when(k > 1, 1.0 - (F.col(f"_t_{o}") - F.col(f"_s_{o}")) / (k * (k - 1)))
        .alias(o) for o in names
    ]
    return total.select(*by, count, *scores)


def _square_sum(name: str) -> Column:
    total = F.lit(0.0)
    for j in range(V.CHUNK):
        x = F.coalesce(F.col(f"{name}_{j}"), F.lit(0.0))
        total = total + x * x
    return total


def vector_sums(df: DataFrame, by: Sequence[str], vec: str, *, eps: float = V.EPS_UNIT,
                dim: int | None = None) -> DataFrame:
    """Per entity: raw sum ``sum_raw``, unit sum ``sum_unit``, ``k``, and sum of |u|^2."""
    by = list(by)
    df = V.with_whole_vectors(df, vec, dim)
    if V.is_wide(dim):
        rows = _with_norms(df, by, {"v": vec}, eps)
        return rows.groupBy(*by).agg(
            F.count(F.lit(1)).alias("k"), F.sum((F.col("_n_v") * F.col("_inv_v")) ** 2).alias("sum_u2"),
            V.feature_array(vec, dim, F.sum).alias("sum_raw"),
            V.feature_array(vec, dim, lambda x: F.sum(x * F.col("_inv_v"))).alias("sum_unit"))
    chunks = _unit_chunks(df, by, {"v": vec}, eps)
    sums = chunks.groupBy(*by, "_chunk").agg(
        F.max("_dim").alias("_dim"), F.min("_dim").alias("_least"), F.max("_dim").alias("_most"), F.count(F.lit(1)).alias("_k"),
        F.sum((F.col("_n_v") * F.col("_inv_v")) ** 2).alias("_s"),
        *[F.sum(f"v_{j}").alias(f"m_{j}") for j in range(V.CHUNK)],
        *[F.sum(F.col(f"v_{j}") * F.col("_inv_v")).alias(f"t_{j}") for j in range(V.CHUNK)],
    )
    out = V.assemble(sums, by, ["m", "t"],
                     extra=[V.one_length(F.max("_k")).alias("k"), F.max("_s").alias("sum_u2")])
    return out.select(*by, "k", "sum_u2", F.col("m").alias("sum_raw"), F.col("t").alias("sum_unit"))


def entity_geometry(df: DataFrame, by: Sequence[str], *, vec: str = "vec",
                    penalty: float = 1.0, ddof: int = 0, eps: float = V.EPS_UNIT,
                    mean_eps: float = 1e-10, dim: int | None = None) -> DataFrame:
    """Direction instability, Fréchet variance, transport-stable score, norm statistics.

    Fréchet variance is the mean squared angle to the normalized mean unit vector.
    ``transport_stable`` = DI - penalty * Fréchet variance. ``magnitude_cv`` is the
    coefficient of variation of the norms with the given ``ddof``.
    """
    by = list(by)
    df = V.with_whole_vectors(df, vec, dim)
    t = vector_sums(df, by, vec, eps=eps, dim=dim)
    stats = t.select(*by, "k", "sum_u2", "sum_unit", V.sumsq("sum_unit").alias("_t2"))
    rows = attach(df.select(*by, F.col(vec).alias("_v"), V.norm(vec).alias("_n")), stats, by)
    cos = (V.dot("_v", "sum_unit") * V.inverse_norm(F.col("_n"), eps) / F.col("k")
           / (F.sqrt("_t2") / F.col("k") + mean_eps))
    spread = F.stddev_pop if ddof == 0 else F.stddev_samp
    g = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_contexts"),
        F.max("_t2").alias("_t2"), F.max("sum_u2").alias("_s"),
        F.avg(F.acos(V.clip_unit(cos)) ** 2).alias("frechet_variance"),
        F.avg("_n").alias("mean_norm"), spread("_n").alias("_sd"),
    )
    k = F.col("n_contexts")
    di = F.when(k > 1, 1.0 - (F.col("_t2") - F.col("_s")) / (k * (k - 1)))
    return g.select(
        *by, "n_contexts", di.alias("direction_instability"), "frechet_variance",
        (di - float(penalty) * F.col("frechet_variance")).alias("transport_stable"),
        "mean_norm",
        F.when(F.col("mean_norm") > 0, F.try_divide(F.col("_sd"), F.col("mean_norm")))
        .alias("magnitude_cv"),
    )


def masked(df: DataFrame, drop_idx: Column, *, vec: str = "vec", out: str = "vec_masked") -> DataFrame:
    """Add the vector with the features listed in ``drop_idx`` zeroed."""
    return df.withColumn(out, V.zero_out(vec, drop_idx))


def feature_positions(features: DataFrame, names: DataFrame, *, name: str = "symbol",
                      idx: str = "idx") -> DataFrame:
    """One row: the sorted positions ``mask`` of the features whose name is in ``names``."""
    hit = features.join(names.select(name).distinct(), name, "left_semi")
    return hit.agg(F.array_sort(F.collect_set(idx)).alias("mask"))


def top_variance_features(df: DataFrame, by: Sequence[str], n: int, *, vec: str = "vec") -> DataFrame:
    """Per group the positions ``mask`` of the ``n`` features of largest sample variance."""
    by = list(by)
    chunks = V.explode_chunks(df, by, {"v": vec})
    var = chunks.groupBy(*by, "_chunk").agg(
        F.max("_dim").alias("_dim"),
        *[F.var_samp(f"v_{j}").alias(f"v_{j}") for j in range(V.CHUNK)])
    vectors = V.assemble(var, by, ["v"])
    rounded = F.transform("v", lambda x: F.round(x, 9))
    return vectors.select(*by, V.top_features(rounded, n).alias("mask"))


def phenotype_projection(df: DataFrame, directions: DataFrame, by: Sequence[str], on: Sequence[str],
                         *, vec: str = "vec", direction: str = "direction",
                         agg: str = "std", dim: int | None = None) -> DataFrame:
    """How an entity's vectors spread along its target direction.

    Each vector is projected on the unit direction; ``agg`` is std (population),
    mean, or mean_abs. Also returns the squared cosine between the mean vector and
    the direction (0 when either is shorter than 1e-10).
    """
    by, on = list(by), list(on)
    d = directions.select(*on, F.col(direction).alias("_d"), V.norm(direction).alias("_dn"))
    rows = join_groups(df, d, on)
    p = V.dot(vec, "_d") * V.inverse_norm(F.col("_dn"), 1e-10)
    proj = rows.select(*by, "_dn", p.alias("_p"))
    how = {"std": F.stddev_pop("_p"), "mean": F.avg("_p"), "mean_abs": F.avg(F.abs("_p"))}[agg]
    spread = proj.groupBy(*by).agg(how.alias("projected"), F.avg("_p").alias("_mean_p"), F.max("_dn").alias("_dn"))
    sums = vector_sums(df, by, vec, dim=dim).select(
        *by, F.col("k").alias("n_contexts"), (V.norm("sum_raw") / F.col("k")).alias("_mn"))
    ok = (F.col("_mn") >= 1e-10) & (F.col("_dn") >= 1e-10)
    enrich = F.when(ok, F.pow(F.try_divide(F.col("_mean_p"), F.col("_mn")), 2)).otherwise(0.0)
    return join_groups(spread, sums, by).select(
        *by, "n_contexts", "projected", enrich.alias("on_target_enrichment"))


def localization(df: DataFrame, masks: DataFrame, by: Sequence[str], on: Sequence[str], *,
                 vec: str = "vec", mask: str = "mask") -> DataFrame:
    """DI over the masked-in features divided by DI over all; NULL when the latter is 0.

    The features outside the mask are zeroed, which leaves the angles of those inside, so
    both scores come from one pass over the rows. NULL keys are keys.
    """
    rows = join_groups(df, masks.select(*on, F.col(mask).alias("_mask")), on)
    inside = F.transform(vec, lambda x, i: F.when(F.array_contains("_mask", i), x).otherwise(0.0))
    di = direction_instability(rows.withColumn("_in", inside), by, {"di_region": "_in", "di_all": vec})
    ratio = F.when(F.abs("di_all") > 1e-12, F.try_divide(F.col("di_region"), F.col("di_all")))
    return di.withColumn("localization", ratio)


def two_context_cosine(a: DataFrame, b: DataFrame, on: Sequence[str], *, vec: str = "vec") -> DataFrame:
    """1 - |cos| for keys present in both contexts; NULL when either vector is zero."""
    right = b.select(*on, F.col(vec).alias("_b"))
    j = a.select(*on, F.col(vec).alias("_a")).join(right, list(on))
    cos = V.cosine(V.dot("_a", "_b"), V.norm("_a"), V.norm("_b"), zero_vector="null", eps=1e-12)
    return j.select(*on, (1.0 - F.abs(cos)).alias("abs_cosine_instability"))


def consistency_of_sensitivity(df: DataFrame, by: Sequence[str], x: str) -> DataFrame:
    """1 - coefficient of variation of a scalar response across contexts."""
    g = df.groupBy(*by).agg(F.count(x).alias("n_contexts"), F.avg(x).alias("_m"),
                            F.stddev_pop(x).alias("_sd"))
    cv = F.when(F.abs("_m") > 0, F.try_divide(F.col("_sd"), F.abs("_m")))
    return g.select(*by, "n_contexts", (1.0 - cv).alias("sensitivity_consistency"))
