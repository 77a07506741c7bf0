"""Queries on scores: rank statistics, classifier metrics, group comparisons."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import checks, classify, groups, rankstats
from ..operators.common import attach, unpivot
from ..operators.labels import ordinal
from ..operators.ladder import quantiles
from . import adapters as A
from .registry import query, table


def mid_rank(col: str, by: str = "") -> str:
    """SQL text of the mid-rank of a column."""
    p = f"PARTITION BY {by} " if by else ""
    t = f"PARTITION BY {by + ', ' if by else ''}{col}"
    return f"(rank() OVER ({p}ORDER BY {col}) + (count(*) OVER ({t}) - 1) / 2.0)"


# Upper normal tail and two-sided Student p as convergent series of positive terms.
def normal_upper_sql(z: str) -> str:
    series = (f"list_sum(list_transform(range(0, 200), lambda k: exp((2 * k + 1) * ln(greatest(abs({z}), 1e-300))"
              f" - (lgamma(2 * k + 2) - k * ln(2) - lgamma(k + 1)))))")
    return (f"(0.5 - sign({z}) * CASE WHEN abs({z}) > 9 THEN 0.5 ELSE "
            f"exp(-({z}) * ({z}) / 2) / sqrt(2 * pi()) * {series} END)")


def student_sql(t: str, df: str) -> str:
    y = f"(({t}) * ({t}) / ({df} + ({t}) * ({t})))"
    a, b = "0.5", f"({df} / 2.0)"
    front = (f"exp({a} * ln({y}) + {b} * ln(1 - {y}) + lgamma({a} + {b}) - lgamma({a}) - lgamma({b})) / {a}")
    terms = (f"list_sum(list_transform(range(0, 2000), lambda k: exp(lgamma({a} + 1) + lgamma({a} + {b} + k + 1)"
             f" - lgamma({a} + {b}) - lgamma({a} + k + 2) + (k + 1) * ln({y})) * 1.0))")
    return f"(1 - {front} * (1 + {terms} / 1.0))"


@query("spearman_by_segment", A.ctes(A.CUST, f"""r AS (SELECT c_mktsegment, {mid_rank('c_acctbal', 'c_mktsegment')} AS a,
  {mid_rank('mean_price', 'c_mktsegment')} AS b FROM cust)""", """s AS (
  SELECT c_mktsegment, count(*) AS n, corr(a, b) AS rho FROM r GROUP BY 1)""") + f"""
SELECT c_mktsegment, n, round(rho, 6) + 0 AS rho, round(rho * sqrt((n - 2) / (1 - rho * rho)), 6) + 0 AS t_stat,
 round({student_sql('rho * sqrt((n - 2) / (1 - rho * rho))', '(n - 2)')}, 6) + 0 AS p_value FROM s""")
def spearman_by_segment(spark, sf):
    return rankstats.spearman_test(A.customer_scores(spark, sf), ["c_mktsegment"], "c_acctbal", "mean_price")


@query("spearman_global_lines", f"""
WITH r AS (SELECT {mid_rank('l_quantity')} AS a, {mid_rank('l_extendedprice')} AS b FROM lineitem)
SELECT count(*) AS n, round(corr(a, b), 6) + 0 AS rho FROM r""")
def spearman_global_lines(spark, sf):
    return rankstats.spearman(table(spark, sf, "lineitem"), [], "l_quantity", "l_extendedprice")


MW = f"""
WITH o AS (SELECT o_orderstatus, o_totalprice AS v, (o_orderpriority = '1-URGENT')::INT AS g FROM orders),
r AS (SELECT *, {mid_rank('v', 'o_orderstatus')} AS rk FROM o),
ties AS (SELECT o_orderstatus, sum(w * w * w - w) AS ties FROM (
  SELECT o_orderstatus, v, count(*)::DOUBLE AS w FROM o GROUP BY 1, 2) GROUP BY 1),
s AS (SELECT o_orderstatus, sum(g)::BIGINT AS n1, (count(*) - sum(g))::BIGINT AS n2,
  sum(rk) FILTER (g = 1) - sum(g) * (sum(g) + 1) / 2 AS u FROM r GROUP BY 1),
z AS (SELECT s.*, (greatest(u, n1 * n2 - u) - n1 * n2 / 2.0 - 0.5) / sqrt(n1 * n2 / 12.0 * ((n1 + n2 + 1)
  - ties / ((n1 + n2) * (n1 + n2 - 1.0)))) AS z FROM s JOIN ties ON s.o_orderstatus = ties.o_orderstatus)
SELECT o_orderstatus, n1, n2, u, round(z, 6) + 0 AS z, round(least(1, 2 * {normal_upper_sql('z')}), 6) + 0 AS p_value,
 round(1 - 2 * u / (n1 * n2), 6) + 0 AS rank_biserial FROM z"""


@query("mann_whitney", MW)
def mann_whitney(spark, sf):
    o = table(spark, sf, "orders").select("o_orderstatus", F.col("o_totalprice").alias("v"),
                                          (F.col("o_orderpriority") == "1-URGENT").alias("g"))
    return rankstats.mann_whitney(o, ["o_orderstatus"], "v", "g")


WILC = f"""
WITH h AS (SELECT user_id, event_type, round(coalesce(sum(value) FILTER (day(ts) > 15), 0)
   - coalesce(sum(value) FILTER (day(ts) <= 15), 0), 6) AS d FROM events GROUP BY 1, 2),
k AS (SELECT event_type, abs(d) AS a, (d > 0)::INT AS up FROM h WHERE d <> 0),
r AS (SELECT *, {mid_rank('a', 'event_type')} AS rk FROM k),
ties AS (SELECT event_type, sum(w * w * w - w) AS ties FROM (
  SELECT event_type, a, count(*)::DOUBLE AS w FROM k GROUP BY 1, 2) GROUP BY 1),
s AS (SELECT event_type, count(*) AS n, sum(up * rk) AS wp FROM r GROUP BY 1),
z AS (SELECT s.*, (wp - n * (n + 1) / 4.0) / sqrt((n * (n + 1) * (2 * n + 1) - ties / 2) / 24.0) AS z
  FROM s JOIN ties ON s.event_type = ties.event_type)
SELECT event_type, n AS n_nonzero, wp AS w_plus, round(z, 6) + 0 AS wilcoxon_z,
 round({normal_upper_sql('z')}, 6) + 0 AS wilcoxon_p FROM z"""


@query("wilcoxon_signed_rank", WILC)
def wilcoxon(spark, sf):
    e = table(spark, sf, "events")
    late = F.dayofmonth("ts") > 15
    d = e.groupBy("user_id", "event_type").agg(F.round(
        F.coalesce(F.sum(F.when(late, F.col("value"))), F.lit(0.0))
        - F.coalesce(F.sum(F.when(~late, F.col("value"))), F.lit(0.0)), 6).alias("d"))
    return rankstats.wilcoxon_signed_rank(d, ["event_type"], "d")


def d_sql(kind: str) -> str:
    return f"""
SELECT l_linestatus, n1, n2, round(m1, 6) + 0 AS mean1, round(m2, 6) + 0 AS mean2,
 round((m1 - m2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2)), 6) + 0 AS cohens_d FROM (
 SELECT l_linestatus, count(*) FILTER (l_returnflag = 'R') AS n1, count(*) FILTER (l_returnflag <> 'R') AS n2,
  avg(l_extendedprice) FILTER (l_returnflag = 'R') AS m1, avg(l_extendedprice) FILTER (l_returnflag <> 'R') AS m2,
  var_{kind}(l_extendedprice) FILTER (l_returnflag = 'R') AS v1,
  var_{kind}(l_extendedprice) FILTER (l_returnflag <> 'R') AS v2 FROM lineitem GROUP BY 1)"""


def _returned(spark, sf):
    return table(spark, sf, "lineitem").select("l_linestatus", "l_linenumber", "l_orderkey", "l_quantity",
                                               "l_extendedprice", (F.col("l_returnflag") == "R").alias("g"))


@query("cohens_d", d_sql("samp"))
def cohens_d(spark, sf):
    return groups.cohens_d(_returned(spark, sf), ["l_linestatus"], "l_extendedprice", "g")


@query("cohens_d_population", d_sql("pop"))
def cohens_d_population(spark, sf):
    return groups.cohens_d(_returned(spark, sf), ["l_linestatus"], "l_extendedprice", "g", ddof=0)


LONG = """m AS (SELECT doc_id, quality, toxic, metric, score FROM docs UNPIVOT (score FOR metric IN (n_chars, n_words, digit_share)))"""
METRICS = ["n_chars", "n_words", "digit_share"]


def auroc_sql(src: str, by: str, score: str, label: str) -> str:
    """AUROC per group from mid-ranks."""
    return f"""SELECT {by}, sum({label})::BIGINT AS n_pos, (count(*) - sum({label}))::BIGINT AS n_neg,
  (sum(rk) FILTER ({label} = 1) - sum({label}) * (sum({label}) + 1) / 2.0)
   / nullif(sum({label}) * (count(*) - sum({label})), 0) AS auroc FROM (
   SELECT *, {mid_rank(score, by)} AS rk FROM {src}) GROUP BY {by}"""


def ap_sql(src: str, by: str, score: str, label: str) -> str:
    return f"""SELECT {by}, sum(p * tp / (tp + fp)) / nullif(sum(p), 0) AS auprc FROM (
   SELECT {by}, p, sum(p) OVER w AS tp, sum(q) OVER w AS fp FROM (
     SELECT {by}, {score} AS s, sum({label}) AS p, count(*) - sum({label}) AS q FROM {src} GROUP BY {by}, {score})
   WINDOW w AS (PARTITION BY {by} ORDER BY s DESC)) GROUP BY {by}"""


@query("auroc", A.ctes(A.DOCS, LONG) + f"""
SELECT metric, n_pos, n_neg, round(auroc, 6) + 0 AS auroc FROM ({auroc_sql('m', 'metric', 'score', 'quality')})""")
def auroc(spark, sf):
    long = unpivot(A.document_scores(spark, sf), ["quality"], METRICS, "metric", "score")
    return classify.auroc(long, ["metric"], "score", "quality")


@query("average_precision", A.ctes(A.DOCS, LONG) + f"""
SELECT a.metric, n_pos, n_neg, round(auprc, 6) + 0 AS auprc FROM ({ap_sql('m', 'metric', 'score', 'quality')}) a
JOIN (SELECT metric, sum(quality)::BIGINT AS n_pos, sum(1 - quality)::BIGINT AS n_neg FROM m GROUP BY 1) b ON a.metric = b.metric""")
def average_precision(spark, sf):
    long = unpivot(A.document_scores(spark, sf), ["quality"], METRICS, "metric", "score")
    return classify.average_precision(long, ["metric"], "score", "quality")


@query("auroc_returned_lines", f"""
WITH m AS (SELECT l_linestatus, l_extendedprice, (l_returnflag = 'R')::INT AS g FROM lineitem)
SELECT l_linestatus, n_pos, n_neg, round(auroc, 6) + 0 AS auroc
FROM ({auroc_sql('m', 'l_linestatus', 'l_extendedprice', 'g')})""")
def auroc_returned_lines(spark, sf):
    rows = _returned(spark, sf).withColumn("g", F.col("g").cast("int"))
    return classify.auroc(rows, ["l_linestatus"], "l_extendedprice", "g")


MACRO = """
WITH c AS (SELECT p_brand AS cls, p_retailprice, p_size::DOUBLE AS p_size FROM part),
ok AS (SELECT cls FROM c GROUP BY 1 HAVING count(*) >= 10)"""
OVR = MACRO + f""", m AS (SELECT ok.cls AS k, p_retailprice AS score, (c.cls = ok.cls)::INT AS y FROM c, ok)
SELECT k AS cls, n_pos, n_neg, round(auroc, 6) + 0 AS auroc FROM ({auroc_sql('m', 'k', 'score', 'y')})"""


@query("one_vs_rest_auroc", OVR)
def one_vs_rest(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_brand").alias("cls"), "p_retailprice")
    return classify.one_vs_rest_auroc(p, [], "p_retailprice", "cls")


@query("macro_auroc", MACRO + f""", u AS (SELECT * FROM c UNPIVOT (score FOR metric IN (p_retailprice, p_size))),
m AS (SELECT metric || ':' || ok.cls AS k, score, (u.cls = ok.cls)::INT AS y FROM u, ok)
SELECT split_part(k, ':', 1) AS metric, count(*) AS n_classes, round(avg(auroc), 6) + 0 AS macro_auroc
FROM ({auroc_sql('m', 'k', 'score', 'y')}) GROUP BY 1""")
def macro_auroc(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_brand").alias("cls"), "p_retailprice", "p_size")
    long = unpivot(p, ["cls"], ["p_retailprice", "p_size"], "metric", "score")
    return classify.macro_auroc(long, ["metric"], "score", "cls")


@query("residualized_auroc", A.ctes(A.DOCS, """fit AS (SELECT covar_pop(digit_share, n_chars) / var_pop(n_chars) AS b,
  avg(digit_share) AS my, avg(n_chars) AS mx FROM docs)""", """m AS (SELECT 'digit_share' AS metric, quality,
  round(digit_share - my - b * (n_chars - mx), 9) AS score FROM docs, fit)""") + f"""
SELECT n_pos, n_neg, round(auroc, 6) + 0 AS auroc FROM ({auroc_sql('m', 'metric', 'score', 'quality')})""")
def residualized_auroc(spark, sf):
    d = classify.residualize(A.document_scores(spark, sf), [], "digit_share", "n_chars", "resid")
    return classify.auroc(d.withColumn("resid", F.round("resid", 9)), [], "resid", "quality")


BENCH = A.ctes(A.DOCS, """lab AS (SELECT *, (n_words >= (SELECT quantile_cont(n_words, 0.5) FROM docs))::INT AS longdoc FROM docs)""",
               """m AS (SELECT outcome || ':' || metric AS k, y, CASE WHEN metric = 'digit_share' THEN -score ELSE score END AS score
  FROM (SELECT * FROM (SELECT doc_id, n_chars, digit_share, n_words, quality::INT AS quality, longdoc FROM lab)
    UNPIVOT (y FOR outcome IN (quality, longdoc)))
    UNPIVOT (score FOR metric IN (n_chars, digit_share, n_words)))""")


@query("metric_benchmark", BENCH + f""", a AS ({auroc_sql('m', 'k', 'score', 'y')}),
b AS (SELECT *, split_part(k, ':', 1) AS outcome, split_part(k, ':', 2) AS metric FROM a)
SELECT outcome, metric, n_pos, n_neg, round(auroc, 6) + 0 AS auroc, round(base - auroc, 6) + 0 AS gap,
 base - auroc >= 0.02 AS base_wins FROM b JOIN (SELECT outcome, auroc AS base FROM b WHERE metric = 'n_chars') c USING (outcome)""")
def metric_benchmark(spark, sf):
    """Every predictor on every outcome, oriented, with its distance to the base predictor."""
    d = classify.label_by_median(A.document_scores(spark, sf), [], "n_words", "longdoc")
    d = d.withColumn("digit_share", classify.orient("digit_share", True))
    long = unpivot(d, ["doc_id", *METRICS], ["quality", "longdoc"], "outcome", "y")
    long = unpivot(long, ["outcome", "y"], METRICS, "metric", "score")
    a = classify.auroc(long, ["outcome", "metric"], "score", "y")
    base = a.filter("metric = 'n_chars'").select("outcome", F.col("auroc").alias("base"))
    j = a.join(base, "outcome").withColumn("gap", F.col("base") - F.col("auroc")).drop("base")
    return checks.gates(j, {"base_wins": F.col("gap") >= 0.02})


@query("group_summary", """
SELECT l_returnflag, count(*) AS n, round(avg(l_extendedprice), 6) AS mean, round(stddev_pop(l_extendedprice), 6) AS std,
 round(quantile_cont(l_extendedprice, 0.25), 6) AS p25, round(quantile_cont(l_extendedprice, 0.5), 6) AS median,
 round(quantile_cont(l_extendedprice, 0.75), 6) AS p75 FROM lineitem GROUP BY 1""")
def group_summary(spark, sf):
    return groups.group_summary(table(spark, sf, "lineitem"), ["l_returnflag"], "l_extendedprice",
                                {"p25": 0.25, "median": 0.5, "p75": 0.75})


@query("global_percentiles", "SELECT " + ", ".join(
    f"round(quantile_cont(l_extendedprice, {p / 100}), 6) AS p{p}" for p in (5, 10, 25, 50, 75, 90, 95)) + " FROM lineitem")
def global_percentiles(spark, sf):
    return quantiles(table(spark, sf, "lineitem"), [], "l_extendedprice",
                     {f"p{p}": p / 100 for p in (5, 10, 25, 50, 75, 90, 95)})


@query("threshold_fractions", """
SELECT o_orderpriority, count(*) AS n, round(avg((o_totalprice >= 100000)::INT), 6) AS at_least,
 round(avg((o_totalprice > 300000)::INT), 6) AS above FROM orders GROUP BY 1""")
def threshold_fractions(spark, sf):
    return groups.fractions(table(spark, sf, "orders"), ["o_orderpriority"], {
        "at_least": F.col("o_totalprice") >= 100000, "above": F.col("o_totalprice") > 300000})


@query("base_rates", A.ctes(A.DOCS) + """
SELECT lang, count(*) AS n, sum(quality)::BIGINT AS n_pos, round(avg(quality), 6) AS base_rate FROM docs GROUP BY 1""")
def base_rates(spark, sf):
    return classify.base_rate(A.document_scores(spark, sf), ["lang"], "quality")


@query("class_counts", "SELECT p_type, count(*) AS n FROM part GROUP BY 1")
def class_counts(spark, sf):
    return groups.class_counts(table(spark, sf, "part"), "p_type")


@query("distinct_counts", """SELECT p_brand, count(DISTINCT s_nationkey) AS n_contexts, count(DISTINCT l_partkey) AS n_members
FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1""")
def distinct_counts(spark, sf):
    return A.sales_lines(spark, sf).groupBy("p_brand").agg(
        F.countDistinct("s_nationkey").alias("n_contexts"), F.countDistinct("l_partkey").alias("n_members"))


SEG = ["BUILDING", "AUTOMOBILE", "MACHINERY", "HOUSEHOLD", "FURNITURE"]


@query("ordinal_spearman", A.ctes(A.CUST, """o AS (SELECT CASE c_mktsegment WHEN 'BUILDING' THEN 0 WHEN 'AUTOMOBILE' THEN 1
  WHEN 'MACHINERY' THEN 2 WHEN 'HOUSEHOLD' THEN 3 WHEN 'FURNITURE' THEN 4 END AS k, mean_price FROM cust)""") + f"""
SELECT count(*) AS n, round(corr(a, b), 6) + 0 AS rho FROM (SELECT {mid_rank('k')} AS a, {mid_rank('mean_price')} AS b FROM o)""")
def ordinal_spearman(spark, sf):
    c = A.customer_scores(spark, sf).withColumn("k", ordinal("c_mktsegment", SEG))
    return rankstats.spearman(c, [], "k", "mean_price")


@query("removal_sensitivity", A.ctes(A.CUST) + f"""
SELECT count(*) AS n, round(corr(a, b), 6) + 0 AS rho FROM (
 SELECT {mid_rank('c_acctbal')} AS a, {mid_rank('max_price')} AS b FROM (
  SELECT * FROM cust QUALIFY row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) > 20))""")
def removal_sensitivity(spark, sf):
    return rankstats.removal_sensitivity(A.customer_scores(spark, sf), "c_custkey", "c_acctbal", 20,
                                         "c_acctbal", "max_price", descending=True)


@query("decision_gates", A.ctes(A.CUST) + f"""
SELECT c_mktsegment, round(rho, 6) + 0 AS rho, rho > 0 AS positive, rho > 0.1 AS strong, rho > 0 AND rho > 0.1 AS passed,
 CASE WHEN rho >= 0.05 THEN 'a' WHEN rho > 0 THEN 'b' ELSE 'c' END AS outcome,
 CASE WHEN rho > 0.1 THEN 'all' WHEN rho > 0 THEN 'some' ELSE 'none' END AS combined FROM (
 SELECT c_mktsegment, corr(a, b) AS rho FROM (SELECT c_mktsegment, {mid_rank('n_orders', 'c_mktsegment')} AS a,
  {mid_rank('max_price', 'c_mktsegment')} AS b FROM cust) GROUP BY 1)""")
def decision_gates(spark, sf):
    s = rankstats.spearman(A.customer_scores(spark, sf), ["c_mktsegment"], "n_orders", "max_price").drop("n")
    g = checks.gates(s, {"positive": F.col("rho") > 0, "strong": F.col("rho") > 0.1}, overall="passed")
    return g.withColumn("outcome", checks.three_way(F.col("rho"), 0.05)).withColumn(
        "combined", checks.combined_gate([F.col("positive"), F.col("strong")]))


@query("detection_limit", """
WITH s AS (SELECT l_linenumber::BIGINT AS k, floor(l_quantity / 10)::DOUBLE AS sigma, l_extendedprice AS x FROM lineitem),
t AS (SELECT k, quantile_cont(x, 0.95) AS cut FROM s WHERE sigma = (SELECT min(sigma) FROM s) GROUP BY 1),
f AS (SELECT s.k, sigma, max(cut) AS cut, avg((x > cut)::INT) AS fa FROM s JOIN t ON s.k = t.k GROUP BY 1, 2)
SELECT k, sigma, round(cut, 6) AS null_threshold, round(fa, 6) AS frac_above,
 min(sigma) FILTER (fa >= 0.5) OVER (PARTITION BY k) AS limit_sigma FROM f""")
def detection_limit(spark, sf):
    s = table(spark, sf, "lineitem").select(F.col("l_linenumber").cast("long").alias("k"),
                                            F.floor(F.col("l_quantity") / 10).cast("double").alias("sigma"),
                                            F.col("l_extendedprice").alias("x"))
    return groups.detection_limit(s, "k", "sigma", "x", power=0.5)


@query("best_setting_match", """
WITH g AS (SELECT l_tax AS setting, avg(l_quantity) AS m, stddev_pop(l_quantity) AS s FROM lineitem GROUP BY 1),
t AS (SELECT avg(l_quantity) AS tm, stddev_pop(l_quantity) AS ts FROM lineitem WHERE l_returnflag = 'R'),
d AS (SELECT setting, m, s, abs(m - tm) AS me, greatest(s / ts, ts / s) AS sr FROM g, t)
SELECT setting, round(m, 6) AS mean, round(s, 6) AS std, round(me, 6) AS mean_err, round(sr, 6) AS std_ratio,
 round(me + 0.1 * abs(sr - 1), 6) AS distance, me < 0.05 AND sr < 2 AS match_ok
FROM d ORDER BY me + 0.1 * abs(sr - 1), setting LIMIT 1""")
def best_setting_match(spark, sf):
    li = table(spark, sf, "lineitem")
    target = li.filter("l_returnflag = 'R'").agg(F.avg("l_quantity").alias("tm"), F.stddev_pop("l_quantity").alias("ts"))
    rows = li.select(F.col("l_tax").alias("setting"), "l_quantity")
    return groups.best_match(rows, "setting", "l_quantity", target.select("tm").scalar(), target.select("ts").scalar())


HOLM = """p AS (SELECT c_nationkey::BIGINT AS family, c_mktsegment AS test, round(least(1, (avg(mean_price) - floor(avg(mean_price))) / 5), 9) AS p
  FROM cust GROUP BY 1, 2),
k AS (SELECT *, count(*) OVER (PARTITION BY family) AS m, row_number() OVER (PARTITION BY family ORDER BY p, test) AS r FROM p)"""


@query("holm_adjustment", A.ctes(A.CUST, HOLM) + """
SELECT family, test, round(p, 6) AS p, round(least(1, max(p * (m - r + 1)) OVER (PARTITION BY family ORDER BY r)), 6) AS p_adjusted FROM k""")
def holm_adjustment(spark, sf):
    return rankstats.holm(_family_tests(spark, sf), ["family"], "p", "test")


def _family_tests(spark, sf):
    c = A.customer_scores(spark, sf).groupBy(F.col("c_nationkey").cast("long").alias("family"),
                                             F.col("c_mktsegment").alias("test")).agg(F.avg("mean_price").alias("a"))
    return c.select("family", "test", F.round(F.least(F.lit(1.0), (F.col("a") - F.floor("a")) / 5), 9).alias("p"))


@query("bonferroni_adjustment", A.ctes(A.CUST, HOLM) + """
SELECT family, test, round(p, 6) AS p, round(least(1, p * m), 6) AS p_adjusted FROM k""")
def bonferroni_adjustment(spark, sf):
    return rankstats.holm(_family_tests(spark, sf), ["family"], "p", "test", bonferroni=True)


@query("holm_one_family", """
WITH p AS (SELECT l_orderkey * 8 + l_linenumber AS test, round(l_extendedprice / 1e6, 9) AS p FROM lineitem),
k AS (SELECT *, count(*) OVER () AS m, row_number() OVER (ORDER BY p, test) AS r FROM p)
SELECT count(*) AS n_tests, count(*) FILTER (a < 0.05) AS n_below, round(min(a), 6) AS least, round(avg(a), 6) AS mean FROM (
 SELECT least(1, max(p * (m - r + 1)) OVER (ORDER BY r)) AS a FROM k)""")
def holm_one_family(spark, sf):
    """Every line is a test of one family, so the running maximum goes over the whole table."""
    t = table(spark, sf, "lineitem").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("test"),
                                            F.round(F.col("l_extendedprice") / 1e6, 9).alias("p"))
    a = F.col("p_adjusted")
    return rankstats.holm(t, [], "p", "test").agg(F.count(F.lit(1)).alias("n_tests"), F.count_if(a < 0.05).alias("n_below"),
                                                  F.min(a).alias("least"), F.avg(a).alias("mean"))


@query("steiger_test", A.ctes(A.CUST, """g AS (SELECT c_mktsegment, count(*) AS n, corr(max_price, mean_price) AS ra,
  corr(max_price, n_orders) AS rb, corr(mean_price, n_orders) AS rab FROM cust GROUP BY 1)""", """c AS (SELECT *, pow((ra + rb) / 2, 2) AS q FROM g)""",
 """z AS (SELECT *, (atanh(ra) - atanh(rb)) * sqrt(n - 3) / sqrt(2 - 2 * (rab * (1 - 2 * q) - 0.5 * q * (1 - 2 * q - rab * rab)) / pow(1 - q, 2)) AS z FROM c)""") + f"""
SELECT c_mktsegment, n, round(ra, 6) + 0 AS r_a, round(rb, 6) + 0 AS r_b, round(rab, 6) + 0 AS r_ab, round(z, 6) + 0 AS z_stat,
 round(2 * {normal_upper_sql('abs(z)')}, 6) + 0 AS p_value FROM z""")
def steiger_test(spark, sf):
    return rankstats.steiger(A.customer_scores(spark, sf), ["c_mktsegment"], "max_price", "mean_price", "n_orders")


@query("binomial_tail", """
WITH g AS (SELECT user_id, count(*) AS n, sum((event_type = 'purchase')::INT)::BIGINT AS k FROM events GROUP BY 1),
t AS (SELECT g.user_id, any_value(n) AS n, any_value(k) AS k,
  coalesce(sum(exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln(0.2) + (n - j) * ln(0.8))) FILTER (j >= k), 0) AS up,
  sum(exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln(0.2) + (n - j) * ln(0.8))) FILTER (j <= k) AS lo
  FROM g, LATERAL (SELECT unnest(range(0, n + 1)) AS j) GROUP BY 1)
SELECT user_id, n, k, round(up, 6) AS p_upper, round(least(1, 2 * least(up, lo)), 6) AS p_two_sided FROM t""")
def binomial_tail(spark, sf):
    return rankstats.binomial_tail(table(spark, sf, "events"), ["user_id"], F.col("event_type") == "purchase", 0.2)


@query("rank_shift_top_movers", A.ctes(A.CUST) + f"""
SELECT c_custkey, c_acctbal, max_price, ra AS rank_raw, rb AS rank_corrected, abs(ra - rb) AS shift FROM (
 SELECT c_custkey, c_acctbal, max_price, {mid_rank('c_acctbal')} AS ra, {mid_rank('max_price')} AS rb FROM cust)
ORDER BY shift DESC, c_custkey LIMIT 25""")
def rank_shift_top_movers(spark, sf):
    s = rankstats.rank_shift(A.customer_scores(spark, sf), [], "c_custkey", "c_acctbal", "max_price")
    return s.orderBy(F.desc("shift"), "c_custkey").limit(25)


@query("set_enrichment", """
WITH t AS (SELECT c_mktsegment, count(*) FILTER (s AND h) AS a, count(*) FILTER (s AND NOT h) AS b,
  count(*) FILTER (NOT s AND h) AS c, count(*) FILTER (NOT s AND NOT h) AS d FROM (
  SELECT c_mktsegment, c_nationkey < 8 AS s, c_acctbal < 0 AS h FROM customer) GROUP BY 1),
x AS (SELECT c_mktsegment, any_value(a) AS a0, sum(p) FILTER (p <= pa * (1 + 1e-7)) AS fp FROM (
  SELECT c_mktsegment, a, exp(lg + lgamma(a + b + 1) - lgamma(x + 1) - lgamma(a + b - x + 1) + lgamma(c + d + 1)
     - lgamma(a + c - x + 1) - lgamma(d - a + x + 1)) AS p,
   exp(lg + lgamma(a + b + 1) - lgamma(a + 1) - lgamma(b + 1) + lgamma(c + d + 1) - lgamma(c + 1) - lgamma(d + 1)) AS pa
  FROM (SELECT *, lgamma(a + c + 1) + lgamma(b + d + 1) - lgamma(a + b + c + d + 1) AS lg FROM t),
   LATERAL (SELECT unnest(range(greatest(0, a - d), least(a + b, a + c) + 1)) AS x)) GROUP BY 1)
SELECT t.c_mktsegment, a, b, c, d, round(a * d / (b * c), 6) AS odds_ratio, round(least(1, fp), 6) AS fisher_p
FROM t JOIN x ON t.c_mktsegment = x.c_mktsegment""")
def set_enrichment(spark, sf):
    return groups.odds_ratio(table(spark, sf, "customer"), ["c_mktsegment"], F.col("c_nationkey") < 8, F.col("c_acctbal") < 0)


STRATA = """SELECT bin, n1, n2, round(m1, 6) + 0 AS mean1, round(m2, 6) + 0 AS mean2,
 round((m1 - m2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2)), 6) + 0 AS cohens_d FROM (
 SELECT bin, count(*) FILTER (g) AS n1, count(*) FILTER (NOT g) AS n2, avg(x) FILTER (g) AS m1, avg(x) FILTER (NOT g) AS m2,
  var_samp(x) FILTER (g) AS v1, var_samp(x) FILTER (NOT g) AS v2 FROM (
  SELECT l_extendedprice AS x, l_returnflag = 'R' AS g, ((e1 <= l_quantity)::INT + (e2 <= l_quantity)::INT
   + (e3 <= l_quantity)::INT + (e4 <= l_quantity)::INT)::BIGINT AS bin FROM lineitem, (SELECT quantile_cont(l_quantity, 0.2) AS e1,
   quantile_cont(l_quantity, 0.4) AS e2, quantile_cont(l_quantity, 0.6) AS e3, quantile_cont(l_quantity, 0.8) AS e4 FROM lineitem))
 GROUP BY 1)"""


@query("stratified_effect", STRATA)
def stratified_effect(spark, sf):
    rows = groups.quantile_group(_returned(spark, sf), [], "l_quantity", 5)
    return groups.stratified_effect(rows, ["bin"], "l_extendedprice", "g")


@query("effect_flatness", f"""
SELECT count(cohens_d) AS n_strata, min(cohens_d) AS d_min, max(cohens_d) AS d_max,
 round(max(cohens_d) - min(cohens_d), 6) + 0 AS d_range, max(cohens_d) - min(cohens_d) <= 0.05 AS flat FROM ({STRATA})""")
def effect_flatness(spark, sf):
    return groups.flatness(stratified_effect(spark, sf), 0.05)


MATCH = """WITH o AS (SELECT o_orderstatus AS s, (o_orderpriority = '1-URGENT')::INT AS g, o_orderkey, o_totalprice,
  ('0x' || substr(md5('0:' || o_orderkey), 1, 12))::BIGINT AS h FROM orders),
r AS (SELECT *, row_number() OVER (PARTITION BY s, g ORDER BY h, o_orderkey) AS rn FROM o),
k AS (SELECT s, least(sum(g), sum(1 - g)) AS k FROM o GROUP BY 1),
m AS (SELECT r.* FROM r JOIN k ON r.s = k.s WHERE rn <= k)"""


@query("matched_effect", MATCH + """
SELECT s, n1, n2, round(m1, 6) + 0 AS mean1, round(m2, 6) + 0 AS mean2,
 round((m1 - m2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2)), 6) + 0 AS cohens_d FROM (
 SELECT s, count(*) FILTER (g = 1) AS n1, count(*) FILTER (g = 0) AS n2, avg(o_totalprice) FILTER (g = 1) AS m1,
  avg(o_totalprice) FILTER (g = 0) AS m2, var_samp(o_totalprice) FILTER (g = 1) AS v1,
  var_samp(o_totalprice) FILTER (g = 0) AS v2 FROM m GROUP BY 1)""")
def matched_effect(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderstatus").alias("s"), "o_orderkey", "o_totalprice",
                                          (F.col("o_orderpriority") == "1-URGENT").cast("int").alias("g"))
    return groups.cohens_d(groups.matched_rows(o, ["s"], "g", "o_orderkey"), ["s"], "o_totalprice", "g")


SIZED = A.ctes(A.CUST, "z AS (SELECT c_custkey, c_acctbal, mean_price, (n_orders >= 10)::INT AS g FROM cust)",
               "e AS (SELECT " + ", ".join(f"quantile_cont(mean_price, {i} / 10.0) AS e{i}" for i in range(1, 10)) + " FROM z)",
               "b AS (SELECT z.*, (" + " + ".join(f"(e{i} <= mean_price)::INT" for i in range(1, 10)) + ")::BIGINT AS bin FROM z, e)",
               """r AS (SELECT *, row_number() OVER (PARTITION BY bin, g ORDER BY ('0x' || substr(md5('0:' || c_custkey), 1, 12))::BIGINT, c_custkey) AS rn FROM b)""",
               "k AS (SELECT bin, sum(g)::BIGINT AS n1, sum(1 - g)::BIGINT AS n2, least(sum(g), sum(1 - g))::BIGINT AS n_matched FROM b GROUP BY 1)",
               "m AS (SELECT r.* FROM r JOIN k ON r.bin = k.bin WHERE rn <= n_matched)")


def _sized(spark, sf):
    return A.customer_scores(spark, sf).select("c_custkey", "c_acctbal", "mean_price", (F.col("n_orders") >= 10).cast("int").alias("g"))


@query("size_matched_effect", SIZED + """
SELECT n1, n2, n1_all - n1 AS unmatched1, n2_all - n2 AS unmatched2, round(m1, 6) + 0 AS mean1, round(m2, 6) + 0 AS mean2,
 round((m1 - m2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2)), 6) + 0 AS cohens_d FROM (
 SELECT count(*) FILTER (g = 1) AS n1, count(*) FILTER (g = 0) AS n2, avg(c_acctbal) FILTER (g = 1) AS m1, avg(c_acctbal) FILTER (g = 0) AS m2,
  var_samp(c_acctbal) FILTER (g = 1) AS v1, var_samp(c_acctbal) FILTER (g = 0) AS v2 FROM m),
 (SELECT sum(n1)::BIGINT AS n1_all, sum(n2)::BIGINT AS n2_all FROM k)""")
def size_matched_effect(spark, sf):
    """Balances of frequent against other customers, matched within deciles of the mean order price."""
    return groups.size_matched_effect(_sized(spark, sf), "c_custkey", "c_acctbal", "g", "mean_price", 10)


@query("size_match_report", SIZED + """
SELECT bin, n1, n2, n_matched, n1 - n_matched AS unmatched1, n2 - n_matched AS unmatched2 FROM k""")
def size_match_report(spark, sf):
    return groups.match_report(groups.quantile_group(_sized(spark, sf), [], "mean_price", 10), ["bin"], "g")


@query("metric_outcome_correlations", A.ctes(A.CUST, "q AS (SELECT " + ", ".join(
    f"{mid_rank(c)} AS {c}" for c in ("c_acctbal", "mean_price", "max_price", "n_orders")) + " FROM cust)") + " UNION ALL ".join(
    f"SELECT '{m}' AS metric, '{o}' AS outcome, count(*) AS n, round(corr({m}, {o}), 6) + 0 AS rho FROM q"
    for m in ("c_acctbal", "mean_price") for o in ("max_price", "n_orders")))
def metric_outcome_correlations(spark, sf):
    return rankstats.rank_correlations(A.customer_scores(spark, sf), "c_custkey", ["c_acctbal", "mean_price"], ["max_price", "n_orders"])


@query("normalized_spread", """
SELECT g, n1, n2, round((m1 - m2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2)), 6) + 0 AS cohens_d FROM (
 SELECT 1::BIGINT AS g, count(sp) FILTER (k = 1) AS n1, count(sp) FILTER (k = 0) AS n2, avg(sp) FILTER (k = 1) AS m1,
 avg(sp) FILTER (k = 0) AS m2, var_samp(sp) FILTER (k = 1) AS v1, var_samp(sp) FILTER (k = 0) AS v2 FROM (
 SELECT o_custkey, (max(o_orderpriority) = '5-LOW')::INT AS k, stddev_pop(o_totalprice) / nullif(abs(avg(o_totalprice)), 0) AS sp
 FROM orders GROUP BY 1))""")
def normalized_spread(spark, sf):
    o = table(spark, sf, "orders")
    k = o.groupBy("o_custkey").agg((F.max("o_orderpriority") == "5-LOW").cast("int").alias("k"))
    s = groups.normalized_spread(o, ["o_custkey"], "o_totalprice").join(k, "o_custkey")
    return groups.cohens_d(s, [], "spread", "k").select(F.lit(1).alias("g"), "n1", "n2", "cohens_d")


@query("rank_correlation_by_count_bin", A.ctes(A.CUST, """b AS (SELECT CASE WHEN n_orders >= 1 AND n_orders < 7 THEN '1-6'
  WHEN n_orders >= 7 AND n_orders < 10 THEN '7-9' WHEN n_orders >= 10 AND n_orders < 13 THEN '10-12' ELSE 'unbinned' END AS bin,
  c_acctbal, mean_price FROM cust)""") + f"""
SELECT bin, count(*) AS n, round(corr(a, b), 6) + 0 AS rho FROM (SELECT bin, {mid_rank('c_acctbal', 'bin')} AS a,
 {mid_rank('mean_price', 'bin')} AS b FROM b) GROUP BY 1""")
def rank_correlation_by_count_bin(spark, sf):
    c = A.customer_scores(spark, sf).withColumn(
        "bin", groups.ratio_bin(F.col("n_orders"), [1, 7, 10, 13], ["1-6", "7-9", "10-12"]))
    return rankstats.spearman(c, ["bin"], "c_acctbal", "mean_price")


@query("fisher_z_interval", A.ctes(A.CUST, "g AS (SELECT c_mktsegment, corr(n_orders, max_price) AS r, count(*) AS n FROM cust GROUP BY 1)") + """
SELECT c_mktsegment, round(r, 6) + 0 AS r, n, round(atanh(r), 6) + 0 AS fisher_z,
 round(tanh(atanh(r) - 1.959964 / sqrt(n - 3)), 6) + 0 AS ci_lo, round(tanh(atanh(r) + 1.959964 / sqrt(n - 3)), 6) + 0 AS ci_hi FROM g""")
def fisher_z_interval(spark, sf):
    return rankstats.pearson_interval(A.customer_scores(spark, sf), ["c_mktsegment"], "n_orders", "max_price")


@query("compare_correlations", A.ctes(A.CUST, """g AS (SELECT c_mktsegment, corr(n_orders, max_price) AS r, count(*) AS n FROM cust GROUP BY 1)""",
 "a AS (SELECT * FROM g WHERE c_mktsegment = 'BUILDING')", """z AS (SELECT g.c_mktsegment, g.r, g.n, (atanh(g.r) - atanh(a.r)) / sqrt(1 / (g.n - 3.0) + 1 / (a.n - 3.0)) AS z
  FROM g, a WHERE g.c_mktsegment <> 'BUILDING')""") + f"""
SELECT c_mktsegment, round(z, 6) + 0 AS z_diff, round(2 * {normal_upper_sql('abs(z)')}, 6) + 0 AS p_value FROM z""")
def compare_correlations(spark, sf):
    g = rankstats.pearson_interval(A.customer_scores(spark, sf), ["c_mktsegment"], "n_orders", "max_price")
    ref = g.filter("c_mktsegment = 'BUILDING'").select(F.col("r").alias("r0"), F.col("n").alias("n0"))
    j = attach(g.filter("c_mktsegment <> 'BUILDING'"), ref, [])
    return rankstats.compare_correlations(j, "r", "n", "r0", "n0").select("c_mktsegment", "z_diff", "p_value")


@query("correction_verdict", A.ctes(A.CUST) + f"""
SELECT c_mktsegment, n, round(rho, 6) + 0 AS rho, CASE WHEN rho < 0.7 THEN 'reorders' WHEN rho < 0.83 THEN 'intermediate' ELSE 'preserves' END AS verdict
FROM (SELECT c_mktsegment, count(*) AS n, corr(a, b) AS rho FROM (SELECT c_mktsegment, {mid_rank('mean_price', 'c_mktsegment')} AS a,
 {mid_rank('max_price', 'c_mktsegment')} AS b FROM cust) GROUP BY 1)""")
def correction_verdict(spark, sf):
    return rankstats.correction_verdict(A.customer_scores(spark, sf), ["c_mktsegment"], "mean_price", "max_price")
