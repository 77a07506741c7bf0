"""Queries on leave-one-context-out evaluation and similar-entity search."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import geometry as G
from ..operators import loo, matching, resample
from ..operators.collapse import with_min_contexts
from ..operators.common import half_away, reuse
from ..operators.geometry import vector_sums
from ..operators.rankstats import spearman
from ..sources.lookups import PENALTY_SWEEP
from . import adapters as A
from .ranking import mid_rank, normal_upper_sql
from .registry import query, table
from .resampling import boot_sql, mixed_sql, numbers_sql

# Brute force: the train set of every (entity, held-out context) is built and scored.
LOO = """train AS (SELECT h.entity, h.context AS held, h.vec AS hv, t.context, t.vec, t.u FROM unit h
   JOIN unit t ON h.entity = t.entity AND h.context <> t.context
   JOIN (SELECT entity FROM sig GROUP BY 1 HAVING count(*) >= 5) e ON e.entity = h.entity),
ldi AS (SELECT a.entity, a.held, 1 - avg(list_dot_product(a.u, b.u)) AS di FROM train a JOIN train b
   ON a.entity = b.entity AND a.held = b.held AND a.context < b.context GROUP BY 1, 2),
lmean AS (SELECT entity, held, list(m ORDER BY i) AS mv, list(w ORDER BY i) AS uv FROM (
   SELECT entity, held, i, avg(x) AS m, avg(y) AS w FROM (
     SELECT entity, held, unnest(vec) AS x, unnest(u) AS y, generate_subscripts(vec, 1) AS i FROM train)
   GROUP BY 1, 2, 3) GROUP BY 1, 2),
lfv AS (SELECT t.entity, t.held, count(*) AS n_train, any_value(hv) AS hv, any_value(mv) AS mv,
   avg(pow(acos(greatest(-1, least(1, list_dot_product(u, uv) / (sqrt(list_dot_product(uv, uv)) + 1e-10)))), 2)) AS fv
   FROM train t JOIN lmean m ON t.entity = m.entity AND t.held = m.held GROUP BY 1, 2),
loo AS (SELECT f.entity, f.held AS context, n_train, di AS train_di, fv AS train_frechet, di - fv AS train_ts,
   list_dot_product(hv, mv) / (sqrt(list_dot_product(hv, hv)) * sqrt(list_dot_product(mv, mv))) AS holdout_cosine, hv, mv
   FROM lfv f JOIN ldi d ON f.entity = d.entity AND f.held = d.held)"""
LOO_ROWS = """SELECT entity, context, n_train, round(train_di, 6) + 0 AS train_di, round(train_frechet, 6) + 0 AS train_frechet,
 round(train_ts, 6) + 0 AS train_ts, round(holdout_cosine, 6) + 0 AS holdout_cosine FROM loo"""


def folds_sql(src: str = "loo", lam: str = "1", extra: str = "") -> str:
    """Fold table CTE: Spearman per held-out context."""
    by = f"{extra}context"
    return f"""fr AS (SELECT {by}, round(train_di, 12) AS raw, round(train_di - {lam} * train_frechet, 12) AS ts,
   round(holdout_cosine, 12) AS hc FROM {src}),
rk AS (SELECT {by}, {mid_rank('raw', by)} AS a, {mid_rank('ts', by)} AS b, {mid_rank('hc', by)} AS c FROM fr),
folds AS (SELECT *, round(ts_spearman - raw_spearman, 12) AS delta, round(ts_spearman - raw_spearman, 12) > 0 AS ts_wins FROM (
   SELECT {by}, count(*) AS n, corr(a, c) AS raw_spearman, corr(b, c) AS ts_spearman FROM rk GROUP BY {by} HAVING count(*) >= 20))"""


def _loo(spark, sf, entity="p_brand"):
    return loo.leave_one_out(A.sales(spark, sf, entity), ["entity"], "context", dim=A.MONTHS)


@query("loo_scores", A.ctes(A.SALES, A.UNIT, LOO) + LOO_ROWS)
def loo_scores(spark, sf):
    return _loo(spark, sf)


@query("loo_scores_embeddings", A.ctes(A.EMB, A.UNIT, LOO) + LOO_ROWS)
def loo_scores_embeddings(spark, sf):
    return loo.leave_one_out(A.embedding_means(spark, sf), ["entity"], "context", block_size=4)


@query("loo_scores_parts", A.ctes(A.SALES_PART, A.UNIT, LOO) + LOO_ROWS)
def loo_scores_parts(spark, sf):
    return _loo(spark, sf, "l_partkey")


@query("loo_folds", A.ctes(A.SALES, A.UNIT, LOO, folds_sql()) + """
SELECT context, n, round(raw_spearman, 6) + 0 AS raw_spearman, round(ts_spearman, 6) + 0 AS ts_spearman,
 round(delta, 6) + 0 AS delta, ts_wins FROM folds""")
def loo_folds(spark, sf):
    return loo.fold_table(_loo(spark, sf), "context")


@query("loo_folds_parts", A.ctes(A.SALES_PART, A.UNIT, LOO, folds_sql()) + """
SELECT context, n, round(raw_spearman, 6) + 0 AS raw_spearman, round(ts_spearman, 6) + 0 AS ts_spearman,
 round(delta, 6) + 0 AS delta, ts_wins FROM folds""")
def loo_folds_parts(spark, sf):
    return loo.fold_table(_loo(spark, sf, "l_partkey"), "context")


@query("first_context_folds", A.ctes(A.SALES, A.UNIT, LOO, folds_sql()) + """
SELECT context, n, round(delta, 6) + 0 AS delta FROM folds WHERE context IN (
 SELECT context FROM (SELECT DISTINCT context FROM sig ORDER BY 1 LIMIT 5))""")
def first_context_folds(spark, sf):
    chosen = loo.first_contexts(A.sales(spark, sf), "context", 5)
    rows = _loo(spark, sf).join(chosen, "context", "left_semi")
    return loo.fold_table(rows, "context").select("context", "n", "delta")


def summary_sql(by: str = "", join: str = "") -> str:
    g = f"{by}, " if by else ""
    tail = f"GROUP BY {by}" if by else ""
    on = f"s.{by} = w.{by}" if by else "true"
    p = f"PARTITION BY {by} " if by else ""
    part = f"PARTITION BY {by}, abs(delta)" if by else "PARTITION BY abs(delta)"
    head = f"s.{by}, " if by else ""
    return f"""ws AS (SELECT {g}count(*) AS nz, sum(rk) FILTER (delta > 0) AS wp, sum(t * t - 1) AS ties FROM (
   SELECT {g}delta, rank() OVER ({p}ORDER BY abs(delta)) + (count(*) OVER ({part}) - 1) / 2.0 AS rk,
    count(*) OVER ({part}) AS t FROM folds WHERE delta <> 0) {tail}),
w AS (SELECT *, (coalesce(wp, 0) - nz * (nz + 1) / 4.0) / sqrt((nz * (nz + 1) * (2 * nz + 1) - ties / 2) / 24.0) AS z FROM ws),
s AS (SELECT {g}count(*) AS n_folds, sum(ts_wins::INT)::BIGINT AS wins, avg(delta) AS md, stddev_pop(delta) AS sd,
   avg(raw_spearman) AS mr, avg(ts_spearman) AS mt, quantile_cont(n, 0.5)::DOUBLE AS med FROM folds {tail})
SELECT {head}n_folds, wins, round(md, 6) + 0 AS mean_delta, round(sd, 6) + 0 AS std_delta, round(mr, 6) + 0 AS mean_raw,
 round(mt, 6) + 0 AS mean_ts, med AS median_n, round(wins / n_folds, 6) AS win_fraction,
 ceil(0.8 * n_folds)::BIGINT AS needed_wins, wins >= ceil(0.8 * n_folds) AS confirmed,
 coalesce(nz, 0) AS n_nonzero, coalesce(wp, 0)::DOUBLE AS w_plus, round(z, 6) + 0 AS wilcoxon_z,
 round({normal_upper_sql('z')}, 6) + 0 AS wilcoxon_p FROM s {join} JOIN w ON {on}"""


@query("loo_summary", A.ctes(A.SALES, A.UNIT, LOO, folds_sql()) + ", " + summary_sql())
def loo_summary(spark, sf):
    return loo.fold_summary(loo.fold_table(_loo(spark, sf), "context"))


@query("penalty_sweep", A.ctes(A.SALES, A.UNIT, LOO,
       f"sweep AS (SELECT loo.*, lam AS penalty FROM loo, (SELECT unnest({PENALTY_SWEEP})::DOUBLE AS lam))",
       folds_sql("sweep", "penalty", "penalty, ")) + ", " + summary_sql("penalty", "LEFT"))
def penalty_sweep(spark, sf):
    """Every penalty; at 0 the two scores coincide, so nothing wins and the test is NULL."""
    rows = loo.sweep_penalty(_loo(spark, sf), PENALTY_SWEEP)
    s = loo.fold_summary(loo.fold_table(rows, "context", by=["penalty"]), by=["penalty"])
    return s.na.fill(0, ["n_nonzero", "w_plus"])


@query("holdout_summary", A.ctes(A.SALES, A.UNIT, LOO) + """
SELECT entity, count(*) AS n_folds, round(avg(holdout_cosine), 6) + 0 AS mean_heldout_cosine,
 round(avg((holdout_cosine > 0.1)::INT), 6) AS frac_consistent, round(avg(train_di), 6) + 0 AS mean_loo_di FROM loo GROUP BY 1""")
def holdout_summary(spark, sf):
    return loo.holdout_summary(_loo(spark, sf), ["entity"], cut=0.1)


@query("frequency_gain_correlation", A.ctes(A.SALES_PART, A.UNIT, LOO, folds_sql()) + f"""
SELECT count(*) AS n, round(corr(a, b), 6) + 0 AS rho FROM (SELECT {mid_rank('n')} AS a, {mid_rank('round(delta, 9)')} AS b FROM folds)""")
def frequency_gain(spark, sf):
    f = loo.fold_table(_loo(spark, sf, "l_partkey"), "context").select(
        F.col("n").alias("size"), F.round("delta", 9).alias("delta"))
    return spearman(f, [], "size", "delta", bounded=True)


GAIN_REPS = 10_000


@query("bootstrap_fold_gain", A.ctes(A.SALES, A.UNIT, LOO, folds_sql(), boot_sql("folds", "context", reps=GAIN_REPS),
       "g AS (SELECT rep, avg(delta) AS m FROM bt GROUP BY 1)") + """
SELECT round((SELECT avg(delta) FROM folds), 6) + 0 AS point, count(*) AS n_boot, round(quantile_cont(m, 0.025), 6) + 0 AS ci_lo,
 round(quantile_cont(m, 0.975), 6) + 0 AS ci_hi, round(stddev_pop(m), 6) + 0 AS se FROM g""")
def bootstrap_fold_gain(spark, sf):
    return resample.bootstrap_mean(loo.fold_table(_loo(spark, sf), "context"), "context", "delta", reps=GAIN_REPS, bounded=True)


PERM_REPS = 1_000


def train_means(sig, k_min=5):
    """Held-out vector and the mean of the other contexts, per (entity, context)."""
    sums = vector_sums(sig, ["entity"], "vec", dim=A.MONTHS).filter(F.col("k") >= k_min)
    j = sig.join(sums.select("entity", "k", "sum_raw"), "entity")
    return j.select("entity", "context", "vec", V.scale(V.subtract("sum_raw", "vec"), 1.0 / (F.col("k") - 1)).alias("train_mean"))


SIGPERM = f"""pp AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY context ORDER BY ('0x' || substr(md5(entity), 1, 15))::BIGINT, entity) - 1 AS pos,
   count(*) OVER (PARTITION BY context) AS n FROM loo),
pn AS MATERIALIZED ({numbers_sql(7, PERM_REPS, "(SELECT DISTINCT context AS g FROM pp WHERE n >= 20)", "g")}),
ph AS (SELECT *, row_number() OVER (PARTITION BY context, rep ORDER BY h, pos) - 1 AS k
   FROM ({mixed_sql("(SELECT pp.*, rep, num FROM pp JOIN pn ON pn.g = pp.context)", "pos", "num")})),
pc AS (SELECT h.rep, h.context, round(h.train_di, 12) AS raw, round(h.train_ts, 12) AS ts,
   round(list_cosine_similarity(d.hv, h.mv), 12) AS hc FROM ph h JOIN pp d ON d.context = h.context AND d.pos = h.k),
prk AS (SELECT rep, context, {mid_rank('raw', 'rep, context')} AS a, {mid_rank('ts', 'rep, context')} AS b,
   {mid_rank('hc', 'rep, context')} AS c FROM pc),
pf AS (SELECT rep, context, round(corr(b, c) - corr(a, c), 12) AS gain FROM prk GROUP BY 1, 2),
pw AS (SELECT rep, sum((gain > 0)::INT)::BIGINT AS wins, avg(gain) AS mean_delta FROM pf GROUP BY 1)"""


def _signature_null(spark, sf):
    sig = A.sales(spark, sf)
    rows = reuse(_loo(spark, sf))
    folds = resample.signature_permutations(rows, train_means(sig), "entity", "context", reps=PERM_REPS, seed=7)
    return rows, resample.permutation_wins(folds)


@query("signature_permutations", A.ctes(A.SALES, A.UNIT, LOO, SIGPERM) + """
SELECT rep, wins, round(mean_delta, 6) + 0 AS mean_delta FROM pw""")
def signature_permutations(spark, sf):
    return _signature_null(spark, sf)[1]


@query("signature_permutation_null", A.ctes(A.SALES, A.UNIT, LOO, SIGPERM, folds_sql()) + """
SELECT round(o, 6) + 0 AS observed, count(*) AS n_reps, round(avg(mean_delta), 6) + 0 AS null_mean,
 round(stddev_pop(mean_delta), 6) + 0 AS null_std, round(quantile_cont(mean_delta, 0.025), 6) + 0 AS q025,
 round(quantile_cont(mean_delta, 0.975), 6) + 0 AS q975, round(avg((mean_delta >= o)::INT), 6) AS p_value,
 round((sum((mean_delta >= o)::INT) + 1) / (count(*) + 1), 6) AS p_plus_one
FROM pw, (SELECT avg(delta) AS o FROM folds) GROUP BY o""")
def signature_permutation_null(spark, sf):
    rows, null = _signature_null(spark, sf)
    obs = loo.fold_table(rows, "context").agg(F.avg("delta").alias("observed"))
    return resample.null_summary(null, obs, "mean_delta", alternative="greater")


# Similar entities: orders of equal price level, parts of equal raw score.
GATES = A.ctes(A.SALES_PART, A.UNIT, """di AS (SELECT a.entity, 1 - avg(list_dot_product(a.u, b.u)) AS d FROM unit a
  JOIN unit b ON a.entity = b.entity AND a.context < b.context GROUP BY 1)""", """sc AS (SELECT entity, round(d, 9) AS raw,
  p_retailprice AS price, p_size::DOUBLE AS size FROM di JOIN part ON p_partkey = entity)""", """gt AS (SELECT sc.*, CASE
  WHEN price >= p75 AND size >= s75 THEN 'high' WHEN price <= p25 AND size <= s25 THEN 'low' END AS gate FROM sc,
  (SELECT quantile_cont(price, 0.25) AS p25, quantile_cont(price, 0.75) AS p75, quantile_cont(size, 0.25) AS s25,
   quantile_cont(size, 0.75) AS s75 FROM sc))""")


def _gated(spark, sf):
    di = G.direction_instability(A.sales(spark, sf, "l_partkey"), ["entity"], {"raw": "vec"}, dim=A.MONTHS).filter("n_contexts > 1")
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("entity"), F.col("p_retailprice").alias("price"),
                                        F.col("p_size").cast("double").alias("size"))
    sc = di.select("entity", F.round("raw", 9).alias("raw")).join(p, "entity")
    return matching.quartile_gates(sc, "price", "size")


@query("quartile_gates", GATES + "SELECT coalesce(gate, 'none') AS gate, count(*) AS n, round(avg(raw), 6) AS mean_raw FROM gt GROUP BY 1")
def quartile_gates(spark, sf):
    g = _gated(spark, sf).withColumn("gate", F.coalesce("gate", F.lit("none")))
    return g.groupBy("gate").agg(F.count(F.lit(1)).alias("n"), F.avg("raw").alias("mean_raw"))


@query("band_join_pairs", GATES + """
SELECT h.entity AS high_entity, l.entity AS low_entity, round(abs(h.raw - l.raw), 6) AS raw_gap, h.price - l.price AS price_gap
FROM gt h JOIN gt l ON h.gate = 'high' AND l.gate = 'low' AND round(abs(h.raw - l.raw), 9) <= 0.002
ORDER BY round(h.price - l.price, 6) DESC, h.entity, l.entity LIMIT 200""")
def band_join_pairs(spark, sf):
    """The 200 pairs furthest apart in price, found without the other pairs."""
    g = _gated(spark, sf)
    top = matching.top_band_pairs(g.filter("gate = 'high'"), g.filter("gate = 'low'"), "raw", 0.002, ["entity"], "price", 200, salts=2)
    return top.select("high_entity", "low_entity", half_away(F.col("raw_gap"), 6).alias("raw_gap"), "price_gap")


@query("band_join_table", GATES + """
SELECT h.entity AS high_entity, l.entity AS low_entity, round(abs(h.raw - l.raw), 6) AS raw_gap, round(h.price - l.price, 6) AS price_gap
FROM gt h JOIN gt l ON h.gate = 'high' AND l.gate = 'low' AND round(abs(h.raw - l.raw), 9) <= 0.0005""")
def band_join_table(spark, sf):
    """All pairs within a narrower band."""
    g = _gated(spark, sf)
    pairs = matching.band_join(g.filter("gate = 'high'"), g.filter("gate = 'low'"), "raw", 0.0005, ["entity", "raw", "price"], salts=2)
    return pairs.select("high_entity", "low_entity", half_away(F.col("raw_gap"), 6).alias("raw_gap"),
                        F.round(F.col("high_price") - F.col("low_price"), 6).alias("price_gap"))


@query("band_join_count", GATES + """
SELECT count(*) AS n_pairs FROM gt h JOIN gt l ON h.gate = 'high' AND l.gate = 'low' AND round(abs(h.raw - l.raw), 9) <= 0.002""")
def band_join_count(spark, sf):
    g = _gated(spark, sf)
    return matching.band_pair_count(g.filter("gate = 'high'"), g.filter("gate = 'low'"), "raw", 0.002).agg(
        F.sum("n_partners").alias("n_pairs"))


@query("coverage_reasons", A.ctes(A.SALES_PART, A.TARGETS) + """
SELECT reason, count(*) AS n FROM (SELECT entity, CASE WHEN t.p_type = 'PROMO' THEN 'no target' WHEN t.p_size > 40 THEN 'no consensus'
 WHEN k < 16 THEN 'few contexts' ELSE 'scored' END AS reason FROM (SELECT entity, count(*) AS k FROM sig GROUP BY 1)
 JOIN part t ON p_partkey = entity) GROUP BY 1""")
def coverage_reasons(spark, sf):
    k = A.sales(spark, sf, "l_partkey").groupBy("entity").agg(F.count(F.lit(1)).alias("k"))
    part = table(spark, sf, "part").select(F.col("p_partkey").alias("entity"), "p_type", "p_size")
    tgt = part.filter("p_type <> 'PROMO'").select("entity", F.col("p_type").alias("target"))
    cons = part.filter("p_size <= 40").select("entity", F.lit(True).alias("has_consensus"))
    j = k.join(tgt, "entity", "left").join(cons, "entity", "left")
    reason = matching.first_reason([("no target", F.col("target").isNull()),
                                    ("no consensus", F.col("has_consensus").isNull()), ("few contexts", F.col("k") < 16)])
    return j.groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("minimum_contexts", A.ctes(A.SALES_PART) + """
SELECT entity, count(*) AS n_contexts FROM sig GROUP BY 1 HAVING count(*) >= 18""")
def minimum_contexts(spark, sf):
    s = with_min_contexts(A.sales(spark, sf, "l_partkey").drop("vec"), ["entity"], "context", 18)
    return s.groupBy("entity").agg(F.count(F.lit(1)).alias("n_contexts"))


@query("either_ground_truth", """
WITH a AS (SELECT c_custkey AS k, c_acctbal AS a FROM customer WHERE c_acctbal > 5000),
b AS (SELECT o_custkey AS k, max(o_totalprice) AS b FROM orders WHERE o_orderstatus = 'P' GROUP BY 1)
SELECT c_custkey AS k, coalesce(a.a, -1) AS a, coalesce(b.b, -1) AS b FROM customer LEFT JOIN a ON a.k = c_custkey
LEFT JOIN b ON b.k = c_custkey WHERE a.k IS NOT NULL OR b.k IS NOT NULL""")
def either_ground_truth(spark, sf):
    c = table(spark, sf, "customer")
    a = c.filter("c_acctbal > 5000").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("a"))
    b = table(spark, sf, "orders").filter("o_orderstatus = 'P'").groupBy(F.col("o_custkey").alias("k")).agg(
        F.max("o_totalprice").alias("b"))
    return matching.either_of(c.select(F.col("c_custkey").alias("k")), a, b, ["k"]).na.fill(-1.0, ["a", "b"])


@query("matched_subset", """
SELECT c_mktsegment, count(*) AS n, round(avg(c_acctbal), 6) AS mean_balance FROM customer
JOIN (SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'P') ON o_custkey = c_custkey WHERE c_acctbal > 0 GROUP BY 1""")
def matched_subset(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_mktsegment", F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("a"))
    o = table(spark, sf, "orders").filter("o_orderstatus = 'P'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.max("o_totalprice").alias("b"))
    m = matching.matched(c.join(o, "c_custkey", "left"), ["a", "b"])
    return m.groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"), F.avg("a").alias("mean_balance"))


@query("matched_cohort", """
SELECT count(*) AS n_matched, count(*) >= 50 AS enough FROM (SELECT DISTINCT user_id FROM events WHERE event_type = 'error')
JOIN customer ON c_custkey = user_id""")
def matched_cohort(spark, sf):
    e = table(spark, sf, "events").filter("event_type = 'error'").select(F.col("user_id").alias("c_custkey")).distinct()
    return matching.matched_cohort(e, table(spark, sf, "customer").select("c_custkey"), "c_custkey", 50)


@query("fallback_lookup", """
WITH a AS (SELECT p_name, min(p_brand) AS x FROM part WHERE p_size < 3 GROUP BY 1),
b AS (SELECT p_name, min(p_type) AS x FROM part GROUP BY 1)
SELECT p.p_partkey, coalesce(a.x, b.x) AS x FROM part p LEFT JOIN a ON a.p_name = p.p_name LEFT JOIN b ON b.p_name = p.p_name""")
def fallback_lookup(spark, sf):
    p = table(spark, sf, "part")
    a = p.filter("p_size < 3").groupBy("p_name").agg(F.min("p_brand").alias("x"))
    b = p.groupBy("p_name").agg(F.min("p_type").alias("x"))
    return matching.with_fallback(p.select("p_partkey", "p_name"), a, b, ["p_name"], "x").select("p_partkey", "x")


@query("key_prefix_join", """
WITH s AS (SELECT s_suppkey, substr(s_name, 1, 17) AS k FROM supplier), n AS (SELECT k, min(s_suppkey) AS first_supplier FROM s GROUP BY 1)
SELECT k, count(*) AS n, any_value(first_supplier) AS first_supplier FROM s JOIN n USING (k) GROUP BY 1""")
def key_prefix_join(spark, sf):
    from ..functions.text import key_prefix
    from ..operators.groups import first_per_key
    s = table(spark, sf, "supplier").select("s_suppkey", key_prefix("s_name", 17).alias("k"))
    first = first_per_key(s, ["k"], ["s_suppkey"]).withColumnRenamed("s_suppkey", "first_supplier")
    return s.join(first, "k").groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max("first_supplier").alias("first_supplier"))


PAIR_REPS = 1_000


@query("random_pair_null", A.ctes(A.TWO, """ab AS MATERIALIZED (SELECT a.user_id, a.vec AS a, b.vec AS b,
  row_number() OVER (ORDER BY a.user_id) - 1 AS pos FROM two a JOIN two b ON a.user_id = b.user_id AND a.half = 0 AND b.half = 1)""",
  f"pn AS MATERIALIZED ({numbers_sql(5, PAIR_REPS)})",
  f"pm AS (SELECT rep, a, row_number() OVER (PARTITION BY rep ORDER BY h, pos) - 1 AS k FROM ({mixed_sql('ab, pn', 'pos', 'num')}))") + """
SELECT rep, count(*) AS n, round(avg(d), 6) + 0 AS mean, round(stddev_pop(d), 6) + 0 AS std FROM (
 SELECT pm.rep, 1 - abs(list_cosine_similarity(pm.a, ab.b)) AS d FROM pm JOIN ab ON ab.pos = pm.k) GROUP BY 1""")
def random_pair_null(spark, sf):
    t = A.two_contexts(spark, sf)
    w = t.groupBy("user_id").agg(F.max(F.when(F.col("half") == 0, F.col("vec"))).alias("a"),
                                 F.max(F.when(F.col("half") == 1, F.col("vec"))).alias("b")).dropna()
    null = resample.random_pair_null(w, "user_id", "a", "b", reps=PAIR_REPS, seed=5)
    return null.groupBy("rep").agg(F.count("instability").alias("n"), F.avg("instability").alias("mean"),
                                   F.stddev_pop("instability").alias("std"))
