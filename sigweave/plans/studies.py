"""The studies end to end: signatures or score tables in, one result table out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import checks, classify, geometry, groups, loo, matching, rankstats, region, resample
from ..operators.collapse import collapse, with_min_contexts
from ..operators.common import attach, reuse, unpivot
from ..operators.labels import class_variants, in_list
from ..operators.ladder import quantiles
from ..sources import lookups


def entity_contexts(signatures: DataFrame, entity: str, context: str, *, min_contexts: int = 5,
                    dim: int | None = None) -> DataFrame:
    """Replicates collapsed to (entity, context), entities with enough contexts."""
    ec = collapse(signatures.filter(F.col(entity).isNotNull()), [entity, context], dim=dim)
    return with_min_contexts(ec, [entity], context, min_contexts)


def consistency_report(ec: DataFrame, entity: str, context: str, *, penalty: float = 1.0, cut: float = 0.5,
                       dim: int | None = None) -> DataFrame:
    """Score table per entity: geometry plus the leave-one-context-out summary."""
    geo = geometry.entity_geometry(ec, [entity], penalty=penalty, dim=dim)
    held = loo.holdout_summary(loo.leave_one_out(ec, [entity], context, penalty=penalty, dim=dim), [entity], cut=cut)
    return geo.join(held.drop("n_folds"), entity)


def transport_study(ec: DataFrame, entity: str, context: str, penalties: Sequence[float], *,
                    dim: int | None = None) -> DataFrame:
    """Fold summary for every penalty from a single pass over the vectors.

    At penalty 0 both scores are the same, so a win there is a fault and fails the query.
    """
    rows = loo.sweep_penalty(loo.leave_one_out(ec, [entity], context, dim=dim), penalties)
    s = loo.fold_summary(loo.fold_table(rows, context, by=["penalty"]), by=["penalty"])
    return checks.ensure(s, (F.col("penalty") != 0) | (F.col("wins") == 0), "wins at penalty 0")


def masking_study(ec: DataFrame, entity: str, mask: DataFrame, toxic: DataFrame, *,
                  dim: int | None = None) -> DataFrame:
    """Do listed entities leave the top fifth of raw scores once the masked features are gone?

    One row: how many are listed, how many lie above the raw P80, below the corrected
    median, both, and whether 60% of the listed drop.
    """
    rows = geometry.masked(attach(ec, mask.select("mask"), []), F.col("mask"))
    di = reuse(geometry.direction_instability(rows, [entity], {"raw": "vec", "corrected": "vec_masked"}, dim=dim))
    listed = in_list(di, entity, toxic)
    cuts = attach(quantiles(di, [], "raw", {"p80": 0.8}), quantiles(di, [], "corrected", {"med": 0.5}), [])
    high, low = F.col("raw") > F.col("p80"), F.col("corrected") < F.col("med")
    g = attach(listed, cuts, []).agg(
        F.count(F.lit(1)).alias("n_listed"), F.count_if(high).alias("n_top_raw"),
        F.count_if(low).alias("n_below_corrected"), F.count_if(high & low).alias("n_both"))
    share = F.try_divide(F.col("n_below_corrected").cast("double"), F.col("n_listed").cast("double"))
    return g.withColumn("fraction", share).withColumn("confirmed", share >= 0.6)


def list_study(scores: DataFrame, name: str, score: str, names: DataFrame) -> DataFrame:
    """A curated list against the population median: found, below, share below."""
    flagged = region.population_flags(scores, score)
    f = matching.found_in(names, flagged, name)
    return f.agg(F.count(F.lit(1)).alias("n_listed"), F.count_if("found").alias("n_found"),
                 F.count_if(F.coalesce("below_median", F.lit(False))).alias("n_below"))


def projection_study(ec: DataFrame, targets: DataFrame, consensus: DataFrame, entity: str, *,
                     dim: int | None = None) -> DataFrame:
    """Raw and projected instability and on-target enrichment of entities with a target direction."""
    rows = ec.join(targets, entity)
    proj = geometry.phenotype_projection(rows, consensus, [entity], ["target"], dim=dim)
    raw = geometry.direction_instability(ec, [entity], {"raw": "vec"}, dim=dim).drop("n_contexts")
    return proj.join(raw, entity)


def projection_verdict(scores: DataFrame, minimum: float = 0.3) -> DataFrame:
    """Spearman of raw and projected scores with the enrichment, and the gate on the latter."""
    long = unpivot(scores, ["on_target_enrichment"], ["raw", "projected"], "score", "x")
    s = rankstats.spearman(long, ["score"], "x", "on_target_enrichment")
    return checks.gates(s, {"passes": F.col("rho") > minimum})


def metric_benchmark(scores: DataFrame, predictors: dict[str, bool], outcomes: dict[str, Column], base: str,
                     covariate: str, *, margin: float = 0.02) -> DataFrame:
    """Every predictor on every outcome: AUROC, the same after removing the covariate, distance to
    ``base``, and Spearman with the covariate.

    ``predictors`` maps names to "higher is worse", ``outcomes`` to 0/1 labels.
    """
    df = scores.select(*predictors, F.col(covariate).cast("double").alias("_cov"),
                       *[c.alias(f"_o_{o}") for o, c in outcomes.items()])
    long = unpivot(df, ["_cov", *[f"_o_{o}" for o in outcomes]], list(predictors), "metric", "x")
    long = reuse(classify.residualize(long, ["metric"], "x", "_cov", "_resid"))
    worse = F.col("metric").isin([m for m, w in predictors.items() if w])
    both = long.select("metric", *[f"_o_{o}" for o in outcomes], classify.orient("x", worse).alias("plain"),
                       classify.orient(F.round("_resid", 9), worse).alias("corrected"))
    flat = unpivot(both, ["metric", "plain", "corrected"], [f"_o_{o}" for o in outcomes], "outcome", "label")
    flat = unpivot(flat, ["metric", "outcome", "label"], ["plain", "corrected"], "form", "score")
    a = classify.auroc(flat, ["metric", "outcome", "form"], "score", "label")
    pick = lambda f: F.max(F.when(F.col("form") == f, F.col("auroc")))
    wide = reuse(a.groupBy(F.regexp_replace("outcome", "^_o_", "").alias("outcome"), "metric").agg(
        pick("plain").alias("auroc"), pick("corrected").alias("auroc_corrected")))
    b = wide.filter(F.col("metric") == base).select("outcome", F.col("auroc").alias("_b"))
    rho = rankstats.spearman(long, ["metric"], "x", "_cov", rho="rho_covariate").drop("n")
    j = wide.join(b, "outcome").join(rho, "metric").withColumn("gap", F.col("_b") - F.col("auroc")).drop("_b")
    return checks.gates(j, {"base_wins": F.col("gap") >= margin})


def class_study(scores: DataFrame, key: str, moa: str, predictors: Sequence[str], *, reps: int = 10_000,
                seed: int = 42) -> DataFrame:
    """Machinery against receptor in the primary reading and with nuclear receptors folded either way.

    Low scores predict machinery; AUROC and AUPRC with intervals per predictor and variant.
    """
    cls = X.keyword_class(moa, lookups.BROAD_CLASSES, absent="no_annotation", other="excluded")
    rows = scores.withColumn("cls", cls)
    v = class_variants(rows, "cls", X.any_keyword(moa, lookups.NUCLEAR_RECEPTOR),
                       {"primary": None, "nuclear_as_machinery": "machinery", "nuclear_as_receptor": "receptor"})
    two = v.filter(F.col("cls").isin("machinery", "receptor")).withColumn(
        "label", (F.col("cls") == "machinery").cast("int"))
    two = two.withColumns({p: -F.col(p) for p in predictors})
    return resample.bootstrap_classifier(two, key, list(predictors), "label", reps=reps, seed=seed, by=["variant"])


def positive_control(scores: DataFrame, key: str, moa: str, score: str, *, reps: int = 10_000,
                     seed: int = 42) -> DataFrame:
    """Nuclear receptors against constitutive machinery: mean difference with interval, U test, AUROC."""
    nuclear = X.any_keyword(moa, lookups.NUCLEAR_RECEPTOR)
    machinery = X.without(X.any_keyword(moa, lookups.CONSTITUTIVE_MACHINERY), nuclear)
    two = reuse(scores.withColumn("g", F.when(nuclear, 1).when(machinery, 0)).filter(F.col("g").isNotNull()))
    diff = resample.bootstrap_mean_diff(two, key, score, "g", reps=reps, seed=seed)
    u = rankstats.mann_whitney(two, [], score, "g").select("u", F.col("p_value").alias("u_p"), "rank_biserial")
    a = classify.auroc(two, [], score, "g").select("auroc")
    out = attach(attach(diff, u, []), a, [])
    return checks.gates(out, {"passes": F.col("ci_lo") > 0})


def group_separation(scores: DataFrame, moa: str, score: str) -> DataFrame:
    """Narrow classes summarized, for stratified comparisons of a second modality."""
    rows = scores.withColumn("cls", F.coalesce(X.keyword_class(moa, lookups.NARROW_CLASSES, absent=None), F.lit("other")))
    return groups.group_summary(rows, ["cls"], score)
