"""Queries on bootstrap and permutation replicates, at the published replicate counts.

Draws are made of md5 and 32-bit mixing, so SQL repeats them.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.draws import MIX_STEP, SLOT_STEP
from ..operators import resample as R
from ..operators.groups import cohens_d
from . import adapters as A
from .ranking import LONG, METRICS, ap_sql, auroc_sql, mid_rank
from .registry import query, table

#: Replicates of intervals and label permutations, of the difference of two rank correlations, and of the macro gap.
REPS, DIFFERENCE_REPS, MACRO_REPS = 10_000, 5_000, 2_000


def mixed_sql(src: str, slot: str, number: str) -> str:
    """SELECT adding ``h``, the 32-bit draw of a slot in the replicate with this number."""
    step = lambda i: f"xor(x{i}, x{i} >> 16) * {MIX_STEP} & 4294967295 AS x{i + 1}"
    return (f"SELECT *, ({slot} * {SLOT_STEP} + ({number} & 4294967295)) & 4294967295 AS x0, {step(0)}, {step(1)}, "
            f"xor(xor(x2, x2 >> 16), {number} >> 32) AS x3, {step(3)}, {step(4)}, xor(x5, x5 >> 16) AS h FROM {src}")


def numbers_sql(seed: int, reps: int, groups: str = "", prefix: str = "") -> str:
    """(rep, number) of every replicate, for each row of ``groups`` with ``prefix`` before the replicate."""
    tag = f"{prefix} || ':' || " if prefix else ""
    keys = f"{groups}, " if groups else ""
    return f"SELECT *, ('0x' || substr(md5('{seed}:' || {tag}rep), 1, 15))::BIGINT AS num FROM {keys}(SELECT unnest(range(1, {reps + 1})) AS rep)"


def boot_sql(src: str, key: str, name: str = "bt", seed: int = 42, by: str = "", reps: int = REPS) -> str:
    """CTEs: the rows of ``src`` resampled per replicate, one row per draw."""
    part = f"PARTITION BY {by} " if by else ""
    groups = f"(SELECT DISTINCT {by} AS g FROM {src})" if by else ""
    on = f"ON r.g = x.{by}" if by else "ON true"
    same = f"AND d.{by} = x.{by}" if by else ""
    keep = f", x.{by}" if by else ""
    return f"""{name}_ix AS MATERIALIZED (SELECT *, row_number() OVER ({part}ORDER BY {key}) - 1 AS i0,
   count(*) OVER ({'PARTITION BY ' + by if by else ''}) AS n0 FROM {src}),
{name}_r AS MATERIALIZED ({numbers_sql(seed, reps, groups, "g" if by else "")}),
{name}_d AS (SELECT rep, h * n0 >> 32 AS j{', ' + by if by else ''} FROM ({mixed_sql(f"(SELECT r.rep, r.num, x.i0, x.n0{keep} FROM {name}_ix x JOIN {name}_r r {on})", "i0", "num")})),
{name} AS (SELECT d.rep, x.* FROM {name}_d d JOIN {name}_ix x ON x.i0 = d.j {same})"""


def ci(stat: str, prefix: str = "") -> str:
    return (f"round(quantile_cont({stat}, 0.025), 6) + 0 AS {prefix}ci_lo, round(quantile_cont({stat}, 0.975), 6) + 0 AS {prefix}ci_hi, "
            f"round(stddev_pop({stat}), 6) + 0 AS {prefix}se")


UNPIVOTED = "UNPIVOT (score FOR metric IN (n_chars, n_words, digit_share))"
BOOT = A.ctes(A.DOCS, LONG, boot_sql("docs", "doc_id"), f"bl AS (SELECT * FROM bt {UNPIVOTED})",
              f"ba AS ({auroc_sql('bl', 'rep, metric', 'score', 'quality')})",
              f"bp AS ({ap_sql('bl', 'rep, metric', 'score', 'quality')})",
              f"pa AS ({auroc_sql('m', 'metric', 'score', 'quality')})",
              f"pp AS ({ap_sql('m', 'metric', 'score', 'quality')})",
              "b AS (SELECT ba.rep, ba.metric, auroc, auprc FROM ba JOIN bp ON ba.rep = bp.rep AND ba.metric = bp.metric WHERE auroc IS NOT NULL)")


@query("bootstrap_classifier", BOOT + f"""
SELECT pa.metric, pa.n_pos, pa.n_neg, round(pa.auroc, 6) + 0 AS auroc, round(pp.auprc, 6) + 0 AS auprc, n_boot,
 auroc_ci_lo, auroc_ci_hi, auroc_se, auprc_ci_lo, auprc_ci_hi, auprc_se FROM pa JOIN pp ON pa.metric = pp.metric
 JOIN (SELECT metric, count(*) AS n_boot, {ci('auroc', 'auroc_')}, {ci('auprc', 'auprc_')} FROM b GROUP BY 1) c ON c.metric = pa.metric""")
def bootstrap_classifier(spark, sf):
    return R.bootstrap_classifier(A.document_scores(spark, sf), "doc_id", METRICS, "quality", reps=REPS)


def diff_sql(stat: str, point: str) -> str:
    return BOOT + f""", d AS (SELECT b.rep, b.metric, base.{stat} - b.{stat} AS diff FROM b JOIN b base
   ON base.rep = b.rep AND base.metric = 'n_chars' WHERE b.metric <> 'n_chars'),
p AS (SELECT x.metric, base.{stat} - x.{stat} AS point_diff FROM {point} x, {point} base WHERE base.metric = 'n_chars' AND x.metric <> 'n_chars')
SELECT p.metric, round(point_diff, 6) + 0 AS point_diff, round(avg((CASE WHEN point_diff > 0 THEN diff <= 0 ELSE diff >= 0 END)::INT), 6) AS p_value,
 count(*) AS n_boot, {ci('diff')} FROM d JOIN p ON d.metric = p.metric GROUP BY p.metric, point_diff"""


@query("bootstrap_auroc_difference", diff_sql("auroc", "pa"))
def bootstrap_auroc_difference(spark, sf):
    return R.bootstrap_classifier_difference(A.document_scores(spark, sf), "doc_id", "n_chars", METRICS[1:],
                                             "quality", reps=REPS)


@query("bootstrap_auprc_difference", diff_sql("auprc", "pp"))
def bootstrap_auprc_difference(spark, sf):
    return R.bootstrap_classifier_difference(A.document_scores(spark, sf), "doc_id", "n_chars", METRICS[1:],
                                             "quality", stat="auprc", reps=REPS)


def macro_sql(src: str, name: str, by: str = "") -> str:
    """CTEs: mean over the classes of ``ok`` of the one-vs-rest AUROC, per metric (and ``by``), from rank sums."""
    g = f"{by}, " if by else ""
    return f"""{name}_u AS (SELECT {g}cls, metric, score FROM (SELECT * FROM {src} UNPIVOT (score FOR metric IN (p_retailprice, p_size)))),
{name}_k AS (SELECT *, {mid_rank('score', g + 'metric')} AS rk, count(*) OVER (PARTITION BY {g}metric) AS n FROM {name}_u),
{name}_c AS (SELECT {g}metric, cls, count(*) AS n1, any_value(n) AS n, sum(rk) AS s FROM {name}_k WHERE cls IN (SELECT k FROM ok) GROUP BY ALL),
{name} AS (SELECT {g}metric, avg((s - n1 * (n1 + 1) / 2) / (n1 * (n - n1))) AS m FROM {name}_c WHERE n1 >= 2 AND n1 < n GROUP BY ALL)"""


@query("bootstrap_macro_gap", A.ctes("c AS (SELECT p_partkey, p_type AS cls, p_retailprice, p_size::DOUBLE AS p_size FROM part)",
       "ok AS (SELECT cls AS k FROM c GROUP BY 1 HAVING count(*) >= 10)", boot_sql("c", "p_partkey", reps=MACRO_REPS),
       macro_sql("bt", "bm", "rep"), macro_sql("c", "pm"),
       "bg AS (SELECT rep, max(m) FILTER (metric = 'p_size') - max(m) FILTER (metric = 'p_retailprice') AS gap FROM bm GROUP BY 1)",
       "pg AS (SELECT max(m) FILTER (metric = 'p_retailprice') AS mb, max(m) FILTER (metric = 'p_size') AS mo FROM pm)") + f"""
SELECT round(mb, 6) AS macro_base, round(mo, 6) AS macro_other, round(mo - mb, 6) + 0 AS gap, count(*) AS n_boot, {ci('bg.gap')} FROM bg, pg GROUP BY mb, mo""")
def bootstrap_macro_gap(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", F.col("p_type").alias("cls"), "p_retailprice", F.col("p_size").cast("double").alias("p_size"))
    return R.bootstrap_macro_gap(p, "p_partkey", "p_retailprice", "p_size", "cls", reps=MACRO_REPS)


def rho_sql(reps: int) -> str:
    return A.ctes(A.CUST, boot_sql("cust", "c_custkey", reps=reps),
                  f"r AS (SELECT rep, {mid_rank('c_acctbal', 'rep')} AS a, {mid_rank('mean_price', 'rep')} AS b, {mid_rank('max_price', 'rep')} AS y FROM bt)",
                  "rho AS (SELECT rep, corr(a, y) AS a, corr(b, y) AS b FROM r GROUP BY 1)",
                  f"pr AS (SELECT {mid_rank('c_acctbal')} AS a, {mid_rank('mean_price')} AS b, {mid_rank('max_price')} AS y FROM cust)",
                  "p AS (SELECT count(*) AS n, corr(a, y) AS a, corr(b, y) AS b FROM pr)")


@query("bootstrap_spearman", rho_sql(REPS) + " UNION ALL ".join(f"""
SELECT '{m}' AS metric, p.n, round(p.{c}, 6) + 0 AS rho, count(*) AS n_boot, {ci(f'rho.{c}')} FROM p, rho GROUP BY p.n, p.{c}"""
       for m, c in (("c_acctbal", "a"), ("mean_price", "b"))))
def bootstrap_spearman(spark, sf):
    return R.bootstrap_spearman(A.customer_scores(spark, sf), "c_custkey", ["c_acctbal", "mean_price"], "max_price", reps=REPS)


@query("bootstrap_spearman_difference", rho_sql(DIFFERENCE_REPS) + f"""
SELECT round(p.b - p.a, 6) + 0 AS diff, count(*) AS n_boot, {ci('rho.b - rho.a')} FROM p, rho GROUP BY p.a, p.b""")
def bootstrap_spearman_difference(spark, sf):
    return R.bootstrap_spearman_difference(A.customer_scores(spark, sf), "c_custkey", "c_acctbal", "mean_price", "max_price", reps=DIFFERENCE_REPS)


GROUPS = A.ctes("o AS (SELECT c_custkey, (c_mktsegment = 'BUILDING')::INT AS g, c_acctbal AS v FROM customer)",
                boot_sql("o", "c_custkey", by="g"),
                """s AS (SELECT rep, count(*) FILTER (g = 1) AS n1, count(*) FILTER (g = 0) AS n2, avg(v) FILTER (g = 1) AS m1,
   avg(v) FILTER (g = 0) AS m2, var_samp(v) FILTER (g = 1) AS v1, var_samp(v) FILTER (g = 0) AS v2 FROM bt GROUP BY 1)""",
                "st AS (SELECT m1 - m2 AS md, (m1 - m2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2)) AS d FROM s)",
                """ps AS (SELECT count(*) FILTER (g = 1) AS n1, count(*) FILTER (g = 0) AS n2, avg(v) FILTER (g = 1) AS m1,
   avg(v) FILTER (g = 0) AS m2, var_samp(v) FILTER (g = 1) AS v1, var_samp(v) FILTER (g = 0) AS v2 FROM o)""",
                "p AS (SELECT n1, n2, m1 - m2 AS md, (m1 - m2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2)) AS d FROM ps)")


def _groups(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", (F.col("c_mktsegment") == "BUILDING").cast("int").alias("g"),
                                               F.col("c_acctbal").alias("v"))


@query("bootstrap_cohens_d", GROUPS + f"""
SELECT n1, n2, round(p.d, 6) + 0 AS cohens_d, count(*) AS n_boot, {ci('st.d')} FROM st, p GROUP BY n1, n2, p.d""")
def bootstrap_cohens_d(spark, sf):
    return R.bootstrap_cohens_d(_groups(spark, sf), "c_custkey", "v", "g", reps=REPS)


@query("bootstrap_mean_diff", GROUPS + f"""
SELECT n1, n2, round(p.md, 6) + 0 AS point_diff, count(*) AS n_boot, {ci('st.md')},
 round(avg((CASE WHEN p.md > 0 THEN st.md <= 0 ELSE st.md >= 0 END)::INT), 6) AS p_value FROM st, p GROUP BY n1, n2, p.md""")
def bootstrap_mean_diff(spark, sf):
    return R.bootstrap_mean_diff(_groups(spark, sf), "c_custkey", "v", "g", reps=REPS)


NULLED = GROUPS.replace("o AS (SELECT c_custkey, (c_mktsegment = 'BUILDING')::INT AS g, c_acctbal AS v FROM customer)",
    """o AS (SELECT c_custkey, 1 AS g, c_acctbal AS v FROM customer WHERE c_mktsegment = 'BUILDING' UNION ALL
   SELECT s_suppkey AS c_custkey, 0 AS g, s_acctbal AS v FROM supplier)""")


@query("bootstrap_effect_vs_null_table", NULLED + f"""
SELECT n1, n2, round(p.d, 6) + 0 AS cohens_d, count(*) AS n_boot, {ci('st.d')} FROM st, p GROUP BY n1, n2, p.d""")
def bootstrap_effect_vs_null_table(spark, sf):
    own = _groups(spark, sf).filter("g = 1")
    null = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("c_custkey"), F.lit(0).alias("g"), F.col("s_acctbal").alias("v"))
    return R.bootstrap_cohens_d(own.unionByName(null), "c_custkey", "v", "g", reps=REPS)


PERM = A.ctes("o AS (SELECT c_custkey, (c_mktsegment = 'BUILDING')::INT AS g, c_acctbal AS v FROM customer)",
              "ix AS MATERIALIZED (SELECT v, row_number() OVER (ORDER BY c_custkey) - 1 AS i FROM o)",
              f"pr AS MATERIALIZED ({numbers_sql(42, REPS)})",
              f"ph AS (SELECT rep, v, row_number() OVER (PARTITION BY rep ORDER BY h, i) - 1 AS pos FROM ({mixed_sql('ix, pr', 'i', 'num')}))",
              "nd AS (SELECT rep, avg(v) FILTER (pos < n1) - avg(v) FILTER (pos >= n1) AS stat FROM ph, (SELECT sum(g) AS n1 FROM o) GROUP BY 1)",
              "ob AS (SELECT avg(v) FILTER (g = 1) - avg(v) FILTER (g = 0) AS o FROM o)")


@query("label_permutations", PERM + "SELECT rep, round(stat, 6) + 0 AS stat FROM nd")
def label_permutations(spark, sf):
    return R.label_permutations(_groups(spark, sf), "c_custkey", "v", "g", reps=REPS)


@query("label_permutation_null", PERM + """
SELECT round(o, 6) + 0 AS observed, count(*) AS n_reps, round(avg(stat), 6) + 0 AS null_mean, round(stddev_pop(stat), 6) + 0 AS null_std,
 round(quantile_cont(stat, 0.025), 6) + 0 AS q025, round(quantile_cont(stat, 0.975), 6) + 0 AS q975,
 round(avg((abs(stat) >= abs(o))::INT), 6) AS p_value, round((sum((abs(stat) >= abs(o))::INT) + 1) / (count(*) + 1), 6) AS p_plus_one
FROM nd, ob GROUP BY o""")
def label_permutation_null(spark, sf):
    g = _groups(spark, sf)
    obs = cohens_d(g, [], "v", "g").select((F.col("mean1") - F.col("mean2")).alias("observed"))
    return R.null_summary(R.label_permutations(g, "c_custkey", "v", "g", reps=REPS), obs, "stat")
