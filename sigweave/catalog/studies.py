"""Whole studies on the provided tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import vectors as V
from ..operators import labels
from ..operators.resample import OVERDRAW
from ..plans import studies
from ..sources import lookups as W
from . import adapters as A
from .entities import GEO, PAIR_DI, PROJ, PROJ_SELECT
from .evaluation import LOO, folds_sql, summary_sql
from .ranking import ap_sql, auroc_sql, mid_rank, normal_upper_sql
from .registry import query, table
from .resampling import REPS, boot_sql, ci


@query("consistency_report", A.ctes(A.SALES, A.UNIT, GEO, LOO) + f"""
SELECT g.entity, n_contexts, round(di, 6) + 0 AS direction_instability, round(fv, 6) + 0 AS frechet_variance,
 round(di - fv, 6) + 0 AS transport_stable, round(mean_norm, 6) + 0 AS mean_norm, round(sd / mean_norm, 6) + 0 AS magnitude_cv,
 round(mh, 6) + 0 AS mean_heldout_cosine, round(fc, 6) AS frac_consistent, round(ml, 6) + 0 AS mean_loo_di
 FROM geo g JOIN ({PAIR_DI}) p ON g.entity = p.entity JOIN (SELECT entity, avg(holdout_cosine) AS mh,
  avg((holdout_cosine > 0.5)::INT) AS fc, avg(train_di) AS ml FROM loo GROUP BY 1) l ON l.entity = g.entity""")
def consistency_report(spark, sf):
    return studies.consistency_report(A.sales(spark, sf), "entity", "context", dim=A.MONTHS)


MASK = """masked AS (SELECT entity, context, list_transform(range(0, 12), lambda i: CASE WHEN i IN (5, 6) THEN 0.0 ELSE vec[i + 1] END) AS v FROM sig),
mu AS (SELECT entity, context, list_transform(v, lambda y: y / greatest(sqrt(list_dot_product(v, v)), 1e-12)) AS u FROM masked)"""


@query("masking_study", A.ctes(A.SALES, A.UNIT, MASK, f"""d AS (SELECT r.entity, r.di AS raw, m.di AS corrected FROM ({PAIR_DI}) r
  JOIN ({PAIR_DI.replace('unit', 'mu')}) m ON r.entity = m.entity)""", """c AS (SELECT d.*, p80, med FROM d,
  (SELECT quantile_cont(raw, 0.8) AS p80, quantile_cont(corrected, 0.5) AS med FROM d)
  WHERE entity IN (SELECT p_brand FROM part WHERE p_type = 'PROMO' GROUP BY 1 HAVING min(p_size) = 1))""") + """
SELECT count(*) AS n_listed, count(*) FILTER (raw > p80) AS n_top_raw, count(*) FILTER (corrected < med) AS n_below_corrected,
 count(*) FILTER (raw > p80 AND corrected < med) AS n_both, round(count(*) FILTER (corrected < med) / count(*), 6) AS fraction,
 count(*) FILTER (corrected < med) / count(*) >= 0.6 AS confirmed FROM c""")
def masking_study(spark, sf):
    from .registry import table
    listed = table(spark, sf, "part").filter("p_type = 'PROMO'").groupBy("p_brand").agg(
        F.min("p_size").alias("m")).filter("m = 1").select("p_brand")
    mask = A.sales_lines(spark, sf).filter("idx in (5, 6)").agg(F.array_sort(F.collect_set("idx")).alias("mask"))
    return studies.masking_study(A.sales(spark, sf), "entity", mask, listed, dim=A.MONTHS)


@query("projection_study", A.ctes(A.SALES, A.UNIT, A.CONSENSUS, A.TARGETS, PROJ) + f"""
SELECT q.*, round(p.di, 6) + 0 AS raw FROM ({PROJ_SELECT}) q JOIN ({PAIR_DI}) p ON p.entity = q.entity""")
def projection_study(spark, sf):
    return studies.projection_study(A.sales(spark, sf), A.targets(spark, sf), A.consensus_by_type(spark, sf), "entity", dim=A.MONTHS)


FULL = A.ctes(A.DOCS, """f AS (SELECT metric, covar_pop(x, n_chars) / var_pop(n_chars) AS b, avg(x) AS my, avg(n_chars) AS mx FROM (
   SELECT n_chars, n_words, digit_share FROM docs) UNPIVOT (x FOR metric IN (n_words, digit_share)) GROUP BY 1)""",
 """l AS (SELECT metric, x, n_chars, quality, toxic FROM docs UNPIVOT (x FOR metric IN (n_words, digit_share)))""",
 """s AS (SELECT l.metric, x, n_chars, quality, toxic, CASE WHEN l.metric = 'digit_share' THEN -x ELSE x END AS plain,
   (CASE WHEN l.metric = 'digit_share' THEN -1 ELSE 1 END) * round(x - my - b * (n_chars - mx), 9) AS corrected FROM l JOIN f ON l.metric = f.metric)""",
 "k AS (SELECT metric || ':' || outcome || ':' || form AS k, y, score FROM (SELECT * FROM (SELECT metric, quality, toxic, plain, corrected FROM s) UNPIVOT (y FOR outcome IN (quality, toxic))) UNPIVOT (score FOR form IN (plain, corrected)))",
 f"a AS (SELECT split_part(k, ':', 1) AS metric, split_part(k, ':', 2) AS outcome, split_part(k, ':', 3) AS form, auroc FROM ({auroc_sql('k', 'k', 'score', 'y')}))",
 "w AS (SELECT metric, outcome, max(auroc) FILTER (form = 'plain') AS p, max(auroc) FILTER (form = 'corrected') AS c FROM a GROUP BY 1, 2)",
 f"r AS (SELECT metric, corr(a, b) AS rho FROM (SELECT metric, {mid_rank('x', 'metric')} AS a, {mid_rank('n_chars', 'metric')} AS b FROM s) GROUP BY 1)")


@query("benchmark_study", FULL + """
SELECT w.outcome, w.metric, round(p, 6) + 0 AS auroc, round(c, 6) + 0 AS auroc_corrected, round(rho, 6) + 0 AS rho_covariate,
 round(b.bp - p, 6) + 0 AS gap, b.bp - p >= 0.02 AS base_wins FROM w JOIN r ON r.metric = w.metric
 JOIN (SELECT outcome, p AS bp FROM w WHERE metric = 'n_words') b ON b.outcome = w.outcome""")
def benchmark_study(spark, sf):
    d = A.document_scores(spark, sf)
    return studies.metric_benchmark(d, {"n_words": False, "digit_share": True},
                                    {"quality": F.col("quality"), "toxic": F.col("toxic")}, "n_words", "n_chars")


@query("transport_study", A.ctes(A.SALES, A.UNIT, LOO,
       f"sweep AS (SELECT loo.*, lam AS penalty FROM loo, (SELECT unnest({W.PENALTY_SWEEP[1:]})::DOUBLE AS lam))",
       folds_sql("sweep", "penalty", "penalty, ")) + ", " + summary_sql("penalty", "LEFT"))
def transport_study(spark, sf):
    """Fold summary of every positive penalty of the published sweep."""
    return studies.transport_study(A.sales(spark, sf), "entity", "context", W.PENALTY_SWEEP[1:], dim=A.MONTHS)


@query("projection_verdict", A.ctes(A.SALES, A.UNIT, A.CONSENSUS, A.TARGETS, PROJ) + f""", q AS (
 SELECT q.*, p.di AS raw FROM ({PROJ_SELECT}) q JOIN ({PAIR_DI}) p ON p.entity = q.entity),
l AS (SELECT score, round(x, 6) AS x, on_target_enrichment AS y FROM (SELECT on_target_enrichment, raw, projected FROM q) UNPIVOT (x FOR score IN (raw, projected))),
k AS (SELECT score, {mid_rank('x', 'score')} AS a, {mid_rank('y', 'score')} AS b FROM l)
SELECT score, count(*) AS n, round(corr(a, b), 6) + 0 AS rho, corr(a, b) > 0.3 AS passes FROM k GROUP BY 1""")
def projection_verdict(spark, sf):
    rows = studies.projection_study(A.sales(spark, sf), A.targets(spark, sf), A.consensus_by_type(spark, sf), "entity", dim=A.MONTHS)
    names = ("raw", "projected", "on_target_enrichment")
    return studies.projection_verdict(rows.select(*[(F.round(c, 6) + 0.0).alias(c) for c in names]))


# Suppliers with a mechanism and a compound name from the published lists, dealt by key.
MECHANISMS = [w for three in zip(W.NUCLEAR_RECEPTOR, W.CONSTITUTIVE_MACHINERY, W.BROAD_RECEPTOR, strict=False) for w in three] + W.BROAD_KINASE + ["unknown"]
COMPOUNDS = W.CONTEXT_SPECIFIC_DRUGS + W.BROAD_MECHANISM_DRUGS + W.KNOWN_CYTOTOXIC


def _dealt(words: list[str], key: str) -> str:
    return f"[{', '.join(repr(w) for w in words)}][{key} % {len(words)} + 1]"


def _has(words: list[str]) -> str:
    return f"len(list_filter([{', '.join(repr(w.lower()) for w in words)}], lambda k: contains(lower(moa), k))) > 0"


SUPPLIERS = f"sup AS (SELECT s_suppkey, s_acctbal, s_nationkey::DOUBLE AS s_nationkey, {_dealt(MECHANISMS, 's_suppkey')} AS moa, {_dealt(COMPOUNDS, 's_suppkey')} AS compound FROM supplier)"


def _suppliers(spark, sf):
    pick = lambda words: F.element_at(F.array(*[F.lit(w) for w in words]), (F.col("s_suppkey") % len(words) + 1).cast("int"))
    return table(spark, sf, "supplier").select("s_suppkey", "s_acctbal", F.col("s_nationkey").cast("double").alias("s_nationkey"),
                                               pick(MECHANISMS).alias("moa"), pick(COMPOUNDS).alias("compound"))


CLASSED = f"""cl AS (SELECT *, CASE WHEN {_has(W.NUCLEAR_RECEPTOR)} THEN 'excluded' WHEN {_has(W.BROAD_MACHINERY)} THEN 'machinery'
   WHEN {_has(W.BROAD_KINASE)} THEN 'kinase' WHEN {_has(W.BROAD_RECEPTOR)} THEN 'receptor' ELSE 'excluded' END AS cls, {_has(W.NUCLEAR_RECEPTOR)} AS nuc FROM sup),
va AS (SELECT variant, s_suppkey, -s_acctbal AS s_acctbal, -s_nationkey AS s_nationkey, CASE WHEN nuc AND moved IS NOT NULL THEN moved ELSE cls END AS cls
   FROM cl, (VALUES ('primary', NULL), ('nuclear_as_machinery', 'machinery'), ('nuclear_as_receptor', 'receptor')) v(variant, moved)),
tw AS (SELECT variant, s_suppkey, s_acctbal, s_nationkey, (cls = 'machinery')::INT AS label FROM va WHERE cls IN ('machinery', 'receptor'))"""
_LONG = "(SELECT * FROM {} UNPIVOT (score FOR metric IN (s_acctbal, s_nationkey)))"


@query("class_study", A.ctes(SUPPLIERS, CLASSED, boot_sql("tw", "s_suppkey", by="variant", reps=OVERDRAW * REPS), f"bl AS {_LONG.format('bt')}", f"pl AS {_LONG.format('tw')}",
       f"ba AS ({auroc_sql('bl', 'rep, variant, metric', 'score', 'label')})", f"bp AS ({ap_sql('bl', 'rep, variant, metric', 'score', 'label')})",
       f"pa AS ({auroc_sql('pl', 'variant, metric', 'score', 'label')})", f"pp AS ({ap_sql('pl', 'variant, metric', 'score', 'label')})",
       f"""v AS (SELECT variant, metric, auroc, auprc FROM ba JOIN bp USING (rep, variant, metric) WHERE auroc IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY variant, metric ORDER BY rep) <= {REPS})""",
       f"c AS (SELECT variant, metric, count(*) AS n_boot, {ci('auroc', 'auroc_')}, {ci('auprc', 'auprc_')} FROM v GROUP BY 1, 2)") + """
SELECT pa.variant, pa.metric, pa.n_pos, pa.n_neg, round(pa.auroc, 6) + 0 AS auroc, round(pp.auprc, 6) + 0 AS auprc, n_boot,
 auroc_ci_lo, auroc_ci_hi, auroc_se, auprc_ci_lo, auprc_ci_hi, auprc_se
FROM pa JOIN pp USING (variant, metric) JOIN c USING (variant, metric)""")
def class_study(spark, sf):
    return studies.class_study(_suppliers(spark, sf), "s_suppkey", "moa", ["s_acctbal", "s_nationkey"], reps=REPS)


@query("positive_control", A.ctes(SUPPLIERS, f"""o AS (SELECT s_suppkey, s_acctbal AS v, CASE WHEN {_has(W.NUCLEAR_RECEPTOR)} THEN 1
   WHEN {_has(W.CONSTITUTIVE_MACHINERY)} THEN 0 END AS g FROM sup)""", "tw AS (SELECT * FROM o WHERE g IS NOT NULL)", boot_sql("tw", "s_suppkey", by="g"),
       "s AS (SELECT rep, avg(v) FILTER (g = 1) - avg(v) FILTER (g = 0) AS d FROM bt GROUP BY 1)",
       "p AS (SELECT count(*) FILTER (g = 1) AS n1, count(*) FILTER (g = 0) AS n2, avg(v) FILTER (g = 1) - avg(v) FILTER (g = 0) AS pd FROM tw)",
       f"r AS (SELECT g, v, {mid_rank('v')} AS rk, count(*) OVER (PARTITION BY v) AS t FROM tw)",
       "u AS (SELECT sum(rk) FILTER (g = 1) - count(*) FILTER (g = 1) * (count(*) FILTER (g = 1) + 1) / 2.0 AS u, sum(t * t - 1.0) AS ties FROM r)",
       "z AS (SELECT *, greatest(u, n1 * n2 - u) AS big, n1 + n2 AS n FROM u, p)",
       "y AS (SELECT *, (big - n1 * n2 / 2.0 - 0.5) / sqrt(n1 * n2 / 12.0 * ((n + 1) - ties / (n * (n - 1.0)))) AS z FROM z)") + f"""
SELECT n1, n2, round(pd, 6) + 0 AS point_diff, count(*) AS n_boot, {ci('s.d')},
 round(avg((CASE WHEN pd > 0 THEN s.d <= 0 ELSE s.d >= 0 END)::INT), 6) AS p_value, u::DOUBLE AS u,
 round(least(1, 2 * {normal_upper_sql('z')}), 6) + 0 AS u_p, round(1 - 2 * u / (n1 * n2), 6) + 0 AS rank_biserial, round(u / (n1 * n2), 6) + 0 AS auroc,
 quantile_cont(s.d, 0.025) > 0 AS passes FROM s, y GROUP BY n1, n2, pd, u, z""")
def positive_control(spark, sf):
    return studies.positive_control(_suppliers(spark, sf), "s_suppkey", "moa", "s_acctbal", reps=REPS)


@query("group_separation", A.ctes(SUPPLIERS) + f"""
SELECT CASE WHEN {_has(W.NARROW_MACHINERY)} THEN 'machinery' WHEN {_has(W.NARROW_KINASE)} THEN 'kinase' WHEN {_has(W.NARROW_RECEPTOR)} THEN 'receptor'
  ELSE 'other' END AS cls, count(*) AS n, round(avg(s_acctbal), 6) + 0 AS mean, round(stddev_pop(s_acctbal), 6) + 0 AS std,
 round(quantile_cont(s_acctbal, 0.5), 6) + 0 AS median FROM sup GROUP BY 1""")
def group_separation(spark, sf):
    return studies.group_separation(_suppliers(spark, sf), "moa", "s_acctbal")


@query("list_study", A.ctes(SUPPLIERS, "sc AS (SELECT compound, avg(s_acctbal) AS x FROM sup GROUP BY 1)",
       f"nm AS (SELECT unnest([{', '.join(repr(w) for w in W.BROAD_MECHANISM_DRUGS)}]) AS compound)") + """
SELECT count(*) AS n_listed, count(x) AS n_found, count(*) FILTER (x < (SELECT quantile_cont(x, 0.5) FROM sc)) AS n_below
FROM nm LEFT JOIN sc USING (compound)""")
def list_study(spark, sf):
    scores = _suppliers(spark, sf).groupBy("compound").agg(F.avg("s_acctbal").alias("x"))
    return studies.list_study(scores, "compound", "x", W.name_table(spark, W.BROAD_MECHANISM_DRUGS, "compound"))


@query("published_lists", A.ctes(SUPPLIERS, f"""li AS (SELECT compound, list_contains([{', '.join(repr(w) for w in W.KNOWN_CYTOTOXIC)}], compound) AS cyt,
  list_contains([{', '.join(repr(w) for w in W.CONTEXT_SPECIFIC_DRUGS)}], compound) AS spec, s_acctbal FROM sup)""") + """
SELECT 'cytotoxic' AS list, count(*) AS n, round(avg(s_acctbal), 6) + 0 AS mean FROM li WHERE cyt UNION ALL
SELECT 'context_specific' AS list, count(*) AS n, round(avg(s_acctbal), 6) + 0 AS mean FROM li WHERE spec""")
def published_lists(spark, sf):
    """Suppliers whose compound is on a published list."""
    s = _suppliers(spark, sf).withColumn("compound", F.upper("compound"))
    parts = [labels.in_list(s, "compound", W.name_table(spark, words)).agg(
        F.lit(name).alias("list"), F.count(F.lit(1)).alias("n"), F.avg("s_acctbal").alias("mean"))
        for name, words in (("cytotoxic", W.KNOWN_CYTOTOXIC), ("context_specific", W.CONTEXT_SPECIFIC_DRUGS))]
    return parts[0].unionByName(parts[1])


@query("named_signatures", """
SELECT count(*) AS n_named, count(DISTINCT e) AS n_entities FROM (SELECT CASE WHEN p_size <= 45 THEN CASE WHEN p_size > 5 THEN p_name ELSE '' END END AS e
 FROM lineitem JOIN part ON p_partkey = l_partkey) WHERE e <> ''""")
def named_signatures(spark, sf):
    """Signatures with a named entity, the empty name read as missing."""
    sig = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("sig_id"), "l_quantity")
    name = F.when(F.col("p_size") <= 45, F.when(F.col("p_size") > 5, F.col("p_name")).otherwise(""))
    info = table(spark, sf, "part").select(F.col("p_partkey").alias("sig_id"), name.alias("pert_iname"))
    return labels.known_signatures(sig, info, empty_is_missing=True).agg(
        F.count(F.lit(1)).alias("n_named"), F.countDistinct("pert_iname").alias("n_entities"))


@query("digit_ids", """
SELECT count(*) AS n, count(i) AS n_ids, sum(i)::BIGINT AS total FROM (SELECT CASE WHEN regexp_matches(t, '^[0-9]+$') THEN t::BIGINT END AS i
 FROM (SELECT CASE WHEN p_partkey % 3 = 0 THEN p_name ELSE split_part(p_brand, '#', 2) END AS t FROM part))""")
def digit_ids(spark, sf):
    t = F.when(F.col("p_partkey") % 3 == 0, F.col("p_name")).otherwise(F.split_part("p_brand", F.lit("#"), F.lit(2)))
    return table(spark, sf, "part").select(X.integer_id(t).alias("i")).agg(
        F.count(F.lit(1)).alias("n"), F.count("i").alias("n_ids"), F.sum("i").alias("total"))


@query("target_angles", A.ctes(A.SALES, A.UNIT, A.CONSENSUS, A.TARGETS) + """
SELECT s.entity, count(*) AS n, round(avg(degrees(acos(greatest(-1, least(1, list_cosine_similarity(s.vec, c.direction)))))), 6) AS mean_degrees
FROM sig s JOIN tgt t ON t.entity = s.entity JOIN cons c ON c.target = t.target GROUP BY 1""")
def target_angles(spark, sf):
    """Mean angle, in degrees, between an entity's signatures and the consensus of its target."""
    j = A.sales(spark, sf).join(A.targets(spark, sf), "entity").join(A.consensus_by_type(spark, sf), "target")
    angle = F.degrees(F.acos(V.clip_unit(V.cosine(V.dot("vec", "direction"), V.norm("vec"), V.norm("direction")))))
    return j.groupBy("entity").agg(F.count(F.lit(1)).alias("n"), F.avg(angle).alias("mean_degrees"))
