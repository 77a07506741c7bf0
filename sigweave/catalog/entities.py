"""Queries on vectors per entity."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import collapse as C
from ..operators import geometry as G
from ..operators import groups, pairstats
from ..operators.common import attach, reuse
from ..operators.matching import pair_set_overlap, sampled_pairs
from ..operators.rankstats import spearman
from ..operators.region import coding_vector_instability
from ..sources.lookups import DOSE_RATIO_EDGES, DOSE_RATIO_LABELS
from ..functions import vectors as V
from . import adapters as A
from .registry import query, table

PAIR_DI = """SELECT a.entity, count(*) AS n, 1 - avg(list_dot_product(a.u, b.u)) AS di
 FROM unit a JOIN unit b ON a.entity = b.entity AND a.context < b.context GROUP BY 1"""


def _long(df, keys, vec="vec"):
    return df.select(*keys, F.posexplode(vec).alias("idx", "x"))


@query("replicate_collapse", A.ctes(A.EMB) + """
SELECT entity, context, n_rep, (unnest(range(0, len(vec))))::BIGINT AS idx, round(unnest(vec), 6) + 0 AS x FROM sig""")
def replicate_collapse(spark, sf):
    return _long(A.embedding_means(spark, sf), ["entity", "context", "n_rep"])


@query("dose_collapse", A.ctes(A.SALES_DOSE) + """
SELECT entity, dose, n_rep, idx, round(x, 6) + 0 AS x FROM (
 SELECT entity, dose, (i - 1)::BIGINT AS idx, count(*) AS n_rep, avg(y) AS x FROM (
  SELECT entity, dose, unnest(vec) AS y, generate_subscripts(vec, 1) AS i FROM sig) GROUP BY 1, 2, 3)""")
def dose_collapse(spark, sf):
    c = C.collapse(A.sales(spark, sf, extra=("dose",)), ["entity", "dose"], dim=A.MONTHS)
    return _long(c, ["entity", "dose", "n_rep"])


@query("target_consensus", A.ctes(A.CONSENSUS) + """
SELECT target, n_sig, unnest(range(0, 12))::BIGINT AS idx, round(unnest(direction), 6) + 0 AS x FROM cons""")
def target_consensus(spark, sf):
    return _long(A.consensus_by_type(spark, sf), ["target", "n_sig"], "direction")


@query("class_mean_vectors", A.ctes(A.SALES) + """
SELECT region, n_members, idx, round(x, 6) + 0 AS x FROM (
 SELECT n_regionkey::BIGINT AS region, (i - 1)::BIGINT AS idx, count(*) AS n_members, avg(y) AS x FROM (
  SELECT context, unnest(vec) AS y, generate_subscripts(vec, 1) AS i FROM sig)
 JOIN nation ON n_nationkey = context GROUP BY 1, 2) WHERE n_members >= 10""")
def class_mean_vectors(spark, sf):
    nat = table(spark, sf, "nation").select(F.col("n_nationkey").alias("context"),
                                            F.col("n_regionkey").cast("long").alias("region"))
    c = C.collapse(A.sales(spark, sf).join(nat, "context"), ["region"], count="n_members", min_count=10)
    return _long(c, ["region", "n_members"])


@query("direction_instability", A.ctes(A.EMB, A.UNIT) + f"""
SELECT entity, (SELECT count(*) FROM sig s WHERE s.entity = p.entity) AS n_contexts,
 round(di, 6) + 0 AS direction_instability FROM ({PAIR_DI}) p""")
def direction_instability(spark, sf):
    return G.direction_instability(A.embedding_means(spark, sf), ["entity"], {"direction_instability": "vec"})


@query("direction_instability_parts", A.ctes(A.SALES_PART, A.UNIT) + f"""
SELECT p.entity, k AS n_contexts, round(di, 6) + 0 AS direction_instability FROM ({PAIR_DI}) p
 JOIN (SELECT entity, count(*) AS k FROM sig GROUP BY 1) q ON p.entity = q.entity""")
def direction_instability_parts(spark, sf):
    di = G.direction_instability(A.sales(spark, sf, "l_partkey"), ["entity"], {"direction_instability": "vec"},
                                 dim=A.MONTHS)
    return di.filter("n_contexts >= 2")


@query("masked_instability", A.ctes(A.SALES, A.UNIT, """masked AS (
  SELECT entity, context, list_transform(range(0, 12), lambda i: CASE WHEN i IN (5, 6) THEN 0.0 ELSE vec[i + 1] END) AS v
  FROM sig)""", """mu AS (SELECT entity, context,
  list_transform(v, lambda y: y / greatest(sqrt(list_dot_product(v, v)), 1e-12)) AS u FROM masked)""") + f"""
SELECT r.entity, round(r.di, 6) + 0 AS raw, round(m.di, 6) + 0 AS corrected FROM ({PAIR_DI}) r
 JOIN ({PAIR_DI.replace('unit', 'mu')}) m ON r.entity = m.entity""")
def masked_instability(spark, sf):
    features = table(spark, sf, "lineitem").select(
        (F.month("l_shipdate") - 1).alias("idx")).distinct().withColumn("symbol", F.concat(F.lit("M"), "idx"))
    excluded = spark.createDataFrame([("M5",), ("M6",)], "symbol string")
    mask = G.feature_positions(features, excluded)
    rows = G.masked(attach(A.sales(spark, sf), mask, []), F.col("mask"))
    return G.direction_instability(rows, ["entity"], {"raw": "vec", "corrected": "vec_masked"},
                                   dim=A.MONTHS).filter("n_contexts > 1").drop("n_contexts")


GEO = """geo AS (SELECT t.entity, count(*) AS n_contexts, avg(nrm) AS mean_norm, stddev_pop(nrm) AS sd,
   avg(pow(acos(greatest(-1, least(1, list_dot_product(u, mu)))), 2)) AS fv FROM unit
   JOIN (SELECT entity, list_transform(tm, lambda y: y / (sqrt(list_dot_product(tm, tm)) + 1e-10)) AS mu FROM (
      SELECT entity, list(m ORDER BY i) AS tm FROM (SELECT entity, i, avg(x) AS m FROM (
         SELECT entity, unnest(u) AS x, generate_subscripts(u, 1) AS i FROM unit) GROUP BY 1, 2) GROUP BY 1)) t
   ON unit.entity = t.entity GROUP BY 1)"""
GEO_SELECT = f"""SELECT g.entity, n_contexts, round(di, 6) + 0 AS direction_instability,
 round(fv, 6) + 0 AS frechet_variance, round(di - fv, 6) + 0 AS transport_stable,
 round(mean_norm, 6) + 0 AS mean_norm, round(sd / mean_norm, 6) + 0 AS magnitude_cv
 FROM geo g JOIN ({PAIR_DI}) p ON g.entity = p.entity"""


@query("entity_geometry", A.ctes(A.SALES, A.UNIT, GEO) + GEO_SELECT)
def entity_geometry(spark, sf):
    return G.entity_geometry(A.sales(spark, sf), ["entity"], dim=A.MONTHS)


@query("entity_geometry_embeddings", A.ctes(A.EMB, A.UNIT, GEO) + GEO_SELECT)
def entity_geometry_embeddings(spark, sf):
    return G.entity_geometry(A.embedding_means(spark, sf), ["entity"])


PROJ = """proj AS (SELECT s.entity, t.target, c.direction,
   list_dot_product(vec, direction) / sqrt(list_dot_product(direction, direction)) AS p, vec
   FROM sig s JOIN tgt t ON s.entity = t.entity JOIN cons c ON c.target = t.target),
mvec AS (SELECT entity, list(m ORDER BY i) AS mv FROM (SELECT entity, i, avg(x) AS m FROM (
   SELECT entity, unnest(vec) AS x, generate_subscripts(vec, 1) AS i FROM sig) GROUP BY 1, 2) GROUP BY 1)"""
PROJ_SELECT = """SELECT proj.entity, count(*) AS n_contexts, round(stddev_pop(p), 6) + 0 AS projected,
 round(pow(any_value(list_dot_product(mv, direction) / (sqrt(list_dot_product(mv, mv)) *
   sqrt(list_dot_product(direction, direction)))), 2), 6) + 0 AS on_target_enrichment
 FROM proj JOIN mvec ON mvec.entity = proj.entity GROUP BY 1"""


@query("phenotype_projection", A.ctes(A.SALES, A.CONSENSUS, A.TARGETS, PROJ) + PROJ_SELECT)
def phenotype_projection(spark, sf):
    rows = A.sales(spark, sf).join(A.targets(spark, sf), "entity")
    return G.phenotype_projection(rows, A.consensus_by_type(spark, sf), ["entity"], ["target"], dim=A.MONTHS)


TOPMASK = """mask AS (SELECT target, list(i ORDER BY i) AS idx FROM (
   SELECT target, i, row_number() OVER (PARTITION BY target ORDER BY abs(x) DESC, i) AS rn FROM (
     SELECT target, unnest(direction) AS x, generate_subscripts(direction, 1) AS i FROM cons)) WHERE rn <= 4
   GROUP BY 1)"""


@query("region_mask", A.ctes(A.CONSENSUS, TOPMASK) + """
SELECT target, (unnest(idx) - 1)::BIGINT AS idx FROM mask""")
def region_mask(spark, sf):
    c = A.consensus_by_type(spark, sf)
    return c.select("target", F.explode(V.top_features("direction", 4)).alias("idx"))


@query("localization", A.ctes(A.SALES, A.UNIT, A.CONSENSUS, A.TARGETS, TOPMASK, """inside AS (
  SELECT s.entity, context, list_transform(m.idx, lambda i: vec[i]) AS v
  FROM sig s JOIN tgt t ON s.entity = t.entity JOIN mask m ON m.target = t.target),
iu AS (SELECT entity, context, list_transform(v, lambda y: y / greatest(sqrt(list_dot_product(v, v)), 1e-12)) AS u
  FROM inside)""") + f"""
SELECT r.entity, round(m.di, 6) + 0 AS di_region, round(r.di, 6) + 0 AS di_all,
 round(m.di / r.di, 6) + 0 AS localization
 FROM ({PAIR_DI}) r JOIN ({PAIR_DI.replace('unit', 'iu')}) m ON r.entity = m.entity""")
def localization(spark, sf):
    c = A.consensus_by_type(spark, sf).select("target", V.top_features("direction", 4).alias("mask"))
    rows = A.sales(spark, sf).join(A.targets(spark, sf), "entity")
    return G.localization(rows, c, ["entity"], ["target"]).filter("n_contexts > 1").drop("n_contexts")


TOP4 = """top4 AS (SELECT entity, context, list(i) AS items FROM (
  SELECT entity, context, i, row_number() OVER (PARTITION BY entity, context ORDER BY abs(round(x, 9)) DESC, i) AS rn
  FROM (SELECT entity, context, unnest(vec) AS x, generate_subscripts(vec, 1) AS i FROM sig)) WHERE rn <= 4
  GROUP BY 1, 2)"""
TOP4_SELECT = """SELECT entity, n AS n_pairs, round(j, 6) + 0 AS mean_top_jaccard FROM (
 SELECT a.entity, count(*) AS n,
  avg(len(list_intersect(a.items, b.items)) / len(list_distinct(list_concat(a.items, b.items)))) AS j
 FROM top4 a JOIN top4 b ON a.entity = b.entity AND a.context < b.context GROUP BY 1)"""


@query("top_feature_jaccard", A.ctes(A.SALES, TOP4) + TOP4_SELECT)
def top_feature_jaccard(spark, sf):
    return pairstats.top_feature_jaccard(A.sales(spark, sf), ["entity"], "context", 4, block_size=10)


@query("abs_cosine_two_contexts", A.ctes(A.TWO) + """
SELECT a.user_id, round(1 - abs(list_cosine_similarity(a.vec, b.vec)), 6) + 0 AS abs_cosine_instability
FROM two a JOIN two b ON a.user_id = b.user_id AND a.half = 0 AND b.half = 1""")
def abs_cosine_two_contexts(spark, sf):
    t = A.two_contexts(spark, sf)
    return G.two_context_cosine(t.filter("half = 0"), t.filter("half = 1"), ["user_id"])


COS = """cos AS (SELECT a.entity, a.context, a.dose AS level_lo, b.dose AS level_hi, b.dose / a.dose AS ratio,
  list_dot_product(a.u, b.u) AS cosine FROM unit a JOIN unit b ON a.entity = b.entity
  AND a.context = b.context AND a.dose < b.dose WHERE a.nrm >= 1e-10 AND b.nrm >= 1e-10)"""


def _dose_cosines(spark, sf):
    df = A.sales(spark, sf, extra=("dose",))
    return pairstats.level_cosines(df, ["entity", "context"], "dose").withColumn("cosine", F.round("cosine", 9))


@query("dose_cosines", A.ctes(A.SALES_DOSE, A.UNIT, COS) + """
SELECT entity, context, count(*) AS n_comparisons, round(avg(cosine), 6) + 0 AS mean_cosine,
 round(min(cosine), 6) + 0 AS min_cosine, min(level_lo)::DOUBLE AS level_min, max(level_hi)::DOUBLE AS level_max
FROM cos GROUP BY 1, 2""")
def dose_cosines(spark, sf):
    return pairstats.level_summary(_dose_cosines(spark, sf), ["entity", "context"])


_P = ", ".join(f"round(quantile_cont(cosine, {p / 100}), 6) + 0 AS p{p}" for p in (5, 10, 25, 50, 75, 90, 95))


@query("dose_overall", A.ctes(A.SALES_DOSE, A.UNIT, COS) + f"""
SELECT count(*) AS n, round(avg(cosine), 6) + 0 AS mean, round(stddev_pop(cosine), 6) + 0 AS std, {_P},
 round(avg((cosine > 0.9)::INT), 6) AS frac_above_09, round(avg((cosine > 0.7)::INT), 6) AS frac_above_07,
 round(avg((cosine < 0.5)::INT), 6) AS frac_below_05, round(avg((cosine < 0.3)::INT), 6) AS frac_below_03,
 quantile_cont(cosine, 0.5) > 0.7 AS passes_median, avg((cosine < 0.5)::INT) < 0.2 AS passes_fraction FROM cos""")
def dose_overall(spark, sf):
    return pairstats.level_overall(A.sales(spark, sf, extra=("dose",)), ["entity", "context"], "dose")


@query("dose_ratio_bins", A.ctes(A.SALES_DOSE, A.UNIT, COS) + """
SELECT CASE WHEN ratio >= 1 AND ratio < 2 THEN '1-2x' WHEN ratio >= 2 AND ratio < 5 THEN '2-5x'
 WHEN ratio >= 5 AND ratio < 20 THEN '5-20x' WHEN ratio >= 20 AND ratio < 100 THEN '20-100x'
 WHEN ratio >= 100 AND ratio < 10000 THEN '100x+' ELSE 'unbinned' END AS bin, count(*) AS n,
 round(avg(cosine), 6) + 0 AS mean, round(stddev_pop(cosine), 6) + 0 AS std,
 round(quantile_cont(cosine, 0.5), 6) + 0 AS median, round(avg((cosine < 0.5)::INT), 6) AS frac_below_05,
 round(avg((cosine > 0.9)::INT), 6) AS frac_above_09 FROM cos GROUP BY 1""")
def dose_ratio_bins(spark, sf):
    return pairstats.level_strata(A.sales(spark, sf, extra=("dose",)), ["entity", "context"], "dose", DOSE_RATIO_EDGES, DOSE_RATIO_LABELS)


@query("worst_entities", A.ctes(A.SALES_DOSE, A.UNIT, COS) + """
SELECT entity, count(*) AS n_groups, round(avg(m), 6) + 0 AS mean_value FROM (
 SELECT entity, context, avg(cosine) AS m FROM cos GROUP BY 1, 2) GROUP BY 1 ORDER BY avg(m), entity LIMIT 15""")
def worst_entities(spark, sf):
    m = groups.two_level_mean(_dose_cosines(spark, sf), ["entity", "context"], ["entity"], "cosine")
    return groups.lowest(m, "mean_value", "entity", 15)


@query("dose_as_context", A.ctes(A.SALES_DOSE, A.UNIT) + f"""
SELECT entity, context, round(di, 6) + 0 AS direction_instability FROM (
 {PAIR_DI.replace('SELECT a.entity', 'SELECT a.entity, a.context').replace('a.context < b.context', 'a.context = b.context AND a.dose < b.dose').replace('GROUP BY 1', 'GROUP BY 1, 2')})""")
def dose_as_context(spark, sf):
    df = A.sales(spark, sf, extra=("dose",))
    di = G.direction_instability(df, ["entity", "context"], {"direction_instability": "vec"}, dim=A.MONTHS)
    return di.filter("n_contexts > 1").drop("n_contexts")


@query("sensitivity_consistency", """
SELECT entity, count(*) AS n_contexts, round(1 - stddev_pop(x) / abs(avg(x)), 6) + 0 AS sensitivity_consistency
FROM (SELECT p_brand AS entity, s_nationkey AS context, avg(l_extendedprice) AS x FROM lineitem
 JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2) GROUP BY 1""")
def sensitivity_consistency(spark, sf):
    x = A.sales_lines(spark, sf).groupBy(F.col("p_brand").alias("entity"), "s_nationkey").agg(
        F.avg("l_extendedprice").alias("x"))
    return G.consistency_of_sensitivity(x, ["entity"], "x")


@query("rank_correlation_per_entity", """
WITH x AS (SELECT p_brand AS entity, s_nationkey AS context, sum(l_quantity) AS q, round(avg(l_extendedprice), 6) AS p
 FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2),
r AS (SELECT entity, rank() OVER wq + (count(*) OVER tq - 1) / 2 AS rq, rank() OVER wp + (count(*) OVER tp - 1) / 2 AS rp
 FROM x WINDOW wq AS (PARTITION BY entity ORDER BY q), tq AS (PARTITION BY entity, q),
 wp AS (PARTITION BY entity ORDER BY p), tp AS (PARTITION BY entity, p))
SELECT entity, count(*) AS n, round(corr(rq, rp), 6) + 0 AS rho FROM r GROUP BY 1""")
def rank_correlation_per_entity(spark, sf):
    x = A.sales_lines(spark, sf).groupBy(F.col("p_brand").alias("entity"), "s_nationkey").agg(
        F.sum("l_quantity").alias("q"), F.round(F.avg("l_extendedprice"), 6).alias("p"))
    return spearman(x, ["entity"], "q", "p", bounded=True)


REGIONED = """reg AS (SELECT n_regionkey::BIGINT AS region, sig.* FROM sig JOIN nation ON n_nationkey = context)"""


def _regioned(spark, sf):
    nat = table(spark, sf, "nation").select(F.col("n_nationkey").alias("context"),
                                            F.col("n_regionkey").cast("long").alias("region"))
    return A.sales(spark, sf).join(nat, "context")


@query("group_restricted_instability", A.ctes(A.SALES, REGIONED) + """
SELECT region, entity, k AS n_contexts, round(di, 6) + 0 AS direction_instability FROM (
 SELECT a.region, a.entity, 1 - avg(list_cosine_similarity(a.vec, b.vec)) AS di FROM reg a JOIN reg b
 ON a.region = b.region AND a.entity = b.entity AND a.context < b.context GROUP BY 1, 2)
JOIN (SELECT region, entity, count(*) AS k FROM reg GROUP BY 1, 2 HAVING count(*) >= 5) USING (region, entity)""")
def group_restricted_instability(spark, sf):
    df = C.with_min_contexts(_regioned(spark, sf), ["region", "entity"], "context", 5)
    return G.direction_instability(df, ["region", "entity"], {"direction_instability": "vec"}, dim=A.MONTHS)


@query("variance_masked_instability", A.ctes(A.SALES, REGIONED, """vm AS (
 SELECT region, list(i) AS drop_idx FROM (
  SELECT region, i, row_number() OVER (PARTITION BY region ORDER BY round(var_samp(x), 9) DESC, i) AS rn FROM (
   SELECT region, unnest(vec) AS x, generate_subscripts(vec, 1) AS i FROM reg) GROUP BY region, i) WHERE rn <= 3
 GROUP BY 1)""", """mv AS (SELECT reg.region, entity, context,
  list_transform(range(1, 13), lambda i: CASE WHEN list_contains(drop_idx, i) THEN 0.0 ELSE vec[i] END) AS vec
  FROM reg JOIN vm ON reg.region = vm.region)""") + """
SELECT region, entity, round(r.di, 6) + 0 AS raw, round(m.di, 6) + 0 AS corrected FROM (
 SELECT a.region, a.entity, 1 - avg(list_cosine_similarity(a.vec, b.vec)) AS di FROM reg a JOIN reg b
 ON a.region = b.region AND a.entity = b.entity AND a.context < b.context GROUP BY 1, 2) r JOIN (
 SELECT a.region, a.entity, 1 - avg(list_cosine_similarity(a.vec, b.vec)) AS di FROM mv a JOIN mv b
 ON a.region = b.region AND a.entity = b.entity AND a.context < b.context GROUP BY 1, 2) m USING (region, entity)""")
def variance_masked_instability(spark, sf):
    df = _regioned(spark, sf)
    masks = G.top_variance_features(df, ["region"], 3)
    rows = G.masked(df.join(masks, "region"), F.col("mask"))
    return G.direction_instability(rows, ["region", "entity"],
                                   {"raw": "vec", "corrected": "vec_masked"},
                                   dim=A.MONTHS).filter("n_contexts > 1").drop("n_contexts")


@query("coding_vector_instability", """
WITH every AS (SELECT r_name AS region, l_orderkey AS trial, ceil(l_quantity / 5)::BIGINT AS neuron, l_linenumber AS t,
  l_extendedprice AS x FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey),
act AS (SELECT * FROM every WHERE t >= 1 AND t < 6),
tr AS (SELECT DISTINCT region, trial, CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END AS y, o_totalprice AS e
  FROM act JOIN orders ON trial = o_orderkey),
ed AS (SELECT region, quantile_cont(e, 0.25) AS e1, quantile_cont(e, 0.5) AS e2, quantile_cont(e, 0.75) AS e3
  FROM tr GROUP BY 1),
q AS (SELECT tr.region, trial, y, (e1 <= e)::INT + (e2 <= e)::INT + (e3 <= e)::INT AS q
  FROM tr JOIN ed ON tr.region = ed.region),
x AS (SELECT region, trial, neuron, avg(x) AS x FROM act GROUP BY 1, 2, 3),
d AS (SELECT q.region, q, neuron, avg(x) FILTER (y = 1) - avg(x) FILTER (y = 0) AS d FROM x
  JOIN q ON x.region = q.region AND x.trial = q.trial GROUP BY 1, 2, 3),
nn AS (SELECT region, q, sqrt(sum(d * d)) AS n FROM d GROUP BY 1, 2 HAVING sqrt(sum(d * d)) > 1e-10),
u AS (SELECT d.region, d.q, neuron, d / n AS u FROM d JOIN nn ON d.region = nn.region AND d.q = nn.q),
k AS (SELECT region, count(*) AS k FROM nn GROUP BY 1 HAVING count(*) >= 3),
p AS (SELECT a.region, sum(a.u * b.u) AS s FROM u a JOIN u b ON a.region = b.region AND a.neuron = b.neuron AND a.q < b.q GROUP BY 1),
c AS (SELECT region, count(DISTINCT neuron) AS nn FROM every GROUP BY 1)
SELECT k.region, c.nn AS n_neurons, k AS n_vectors, round(1 - 2 * s / (k * (k - 1)), 6) AS raw,
  round((1 - 2 * s / (k * (k - 1))) / sqrt(c.nn), 6) AS corrected FROM k JOIN p ON p.region = k.region JOIN c ON c.region = k.region""")
def coding_vectors(spark, sf):
    nat = table(spark, sf, "nation").join(
        table(spark, sf, "region").withColumnRenamed("r_regionkey", "n_regionkey"), "n_regionkey").select(
        F.col("n_nationkey").alias("s_nationkey"), F.col("r_name").alias("region"))
    supp = table(spark, sf, "supplier").join(nat, "s_nationkey").select(
        F.col("s_suppkey").alias("l_suppkey"), "region")
    act = table(spark, sf, "lineitem").join(supp, "l_suppkey").select(
        "region", F.col("l_orderkey").alias("trial"), F.ceil(F.col("l_quantity") / 5).alias("neuron"),
        F.col("l_linenumber").alias("t"), F.col("l_extendedprice").alias("x"))
    orders = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("trial"), (F.col("o_orderstatus") == "O").cast("double").alias("y"),
        F.col("o_totalprice").alias("evidence"))
    trials = act.filter("t >= 1 and t < 6").select("region", "trial").distinct().join(orders, "trial")
    return coding_vector_instability(act, trials, window=(1, 6), evidence="evidence")


@query("difference_signature", """
WITH cells AS (SELECT o_orderkey AS cell_id, o_orderpriority AS perturbation FROM orders),
ctl AS (SELECT '1-URGENT' AS label),
sz AS (SELECT perturbation, count(*) AS n FROM cells GROUP BY 1),
ex AS (SELECT l_orderkey AS cell_id, 'L' || l_linenumber AS feature, l_quantity AS x FROM lineitem),
s AS (SELECT perturbation, feature, sum(x) AS s FROM ex JOIN cells USING (cell_id) GROUP BY 1, 2),
m AS (SELECT perturbation, feature, s / n AS m FROM s JOIN sz USING (perturbation))
SELECT a.perturbation, sz.n AS n_cells, a.feature, round(a.m - c.m, 6) + 0 AS diff FROM m a JOIN m c
 ON a.feature = c.feature AND c.perturbation = (SELECT label FROM ctl) JOIN sz ON sz.perturbation = a.perturbation
WHERE a.perturbation <> (SELECT label FROM ctl)""")
def difference_signature(spark, sf):
    cells = table(spark, sf, "orders").select(F.col("o_orderkey").alias("cell_id"),
                                              F.col("o_orderpriority").alias("perturbation"))
    expr = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("cell_id"), F.concat(F.lit("L"), "l_linenumber").alias("feature"),
        F.col("l_quantity").alias("x"))
    return C.difference_signature(expr, cells, controls=("0-NONE", "1-URGENT", ""))


@query("replicate_depth", """
SELECT count(*) AS n_groups, round(avg((n = 1)::INT), 6) AS frac_single FROM (
 SELECT l_partkey, s_nationkey, ceil(l_quantity / 5) AS d, count(*) AS n FROM lineitem
 JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2, 3)""")
def replicate_depth(spark, sf):
    rows = A.sales_lines(spark, sf).withColumn("dose", F.ceil(F.col("l_quantity") / 5))
    return pairstats.replicate_depth(rows, ["l_partkey", "s_nationkey", "dose"])


@query("near_equal_dose_cosines", A.ctes(A.SALES_DOSE, A.UNIT, COS) + """
SELECT level_hi::DOUBLE AS level_hi, count(*) AS n, round(quantile_cont(cosine, 0.5), 6) + 0 AS median_cosine
FROM cos WHERE ratio < 1.3 GROUP BY 1""")
def near_equal_dose_cosines(spark, sf):
    c = _dose_cosines(spark, sf).filter("ratio < 1.3")
    g = groups.group_summary(c, ["level_hi"], "cosine", {"median_cosine": 0.5})
    return g.select("level_hi", "n", "median_cosine")


@query("context_overlap_vs_instability", A.ctes(A.SALES_PART, A.UNIT, f"di AS (SELECT entity, round(di, 9) AS di FROM ({PAIR_DI}))", """
m AS (SELECT DISTINCT entity, context FROM sig)""", "c AS (SELECT entity, count(*) AS n FROM m GROUP BY 1)", """
h AS (SELECT entity, di, rep, count(*) OVER (PARTITION BY rep) AS n, row_number() OVER (PARTITION BY rep
   ORDER BY ('0x' || substr(md5('7:' || rep || ':' || entity), 1, 15))::BIGINT, entity) - 1 AS pos
  FROM di, (SELECT unnest([1, 2]) AS rep))""", """
pr AS (SELECT a.rep, a.entity AS ea, b.entity AS eb, a.di AS da, b.di AS db FROM h a
  JOIN h b ON a.rep = b.rep AND b.pos = (a.pos + 1) % a.n WHERE a.entity <> b.entity)""", """
s AS (SELECT rep, ea, eb, count(*) AS k FROM pr JOIN m x ON x.entity = ea JOIN m y ON y.entity = eb AND y.context = x.context
  GROUP BY 1, 2, 3)""", """
o AS (SELECT coalesce(k, 0)::DOUBLE / (ca.n + cb.n - coalesce(k, 0)) AS j, round(abs(da - db), 9) AS g
  FROM pr LEFT JOIN s ON pr.rep = s.rep AND pr.ea = s.ea AND pr.eb = s.eb JOIN c ca ON ca.entity = pr.ea JOIN c cb ON cb.entity = pr.eb)""", """
r AS (SELECT rank() OVER (ORDER BY j) + (count(*) OVER (PARTITION BY j) - 1) / 2.0 AS rj,
  rank() OVER (ORDER BY g) + (count(*) OVER (PARTITION BY g) - 1) / 2.0 AS rg FROM o)""") + """
SELECT count(*) AS n, round(corr(rj, rg), 6) + 0 AS rho FROM r""")
def context_overlap(spark, sf):
    """Do parts sold in similar sets of nations differ less in instability? A hashed pair sample."""
    sig = A.sales(spark, sf, "l_partkey")
    di = G.direction_instability(sig, ["entity"], {"di": "vec"}, dim=A.MONTHS).filter("n_contexts >= 2")
    pairs = reuse(sampled_pairs(reuse(di.select("entity", F.round("di", 9).alias("di"))), "entity", ["di"], 2, 7))
    o = pair_set_overlap(pairs, reuse(sig.select("entity", "context")), "entity", "context")
    o = reuse(o.withColumn("gap", F.round(F.abs(F.col("di_a") - F.col("di_b")), 9)).select("jaccard", "gap"))
    return spearman(o, [], "jaccard", "gap")
