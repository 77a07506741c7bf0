"""Queries on text labels, filters, sets and data checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import checks, classify, groups, labels, matching, region
from ..operators.ladder import quantiles
from . import adapters as A
from .registry import query, table

# A keyword table over the words that the part names use.
CLASSES = [("machinery", ["gear", "bolt"]), ("kinase", ["ring", "red"]), ("receptor", ["widget", "hot"])]
BROAD = [("excluded", ["blue"]), *CLASSES]
ROWS = [(c, i, k) for i, (c, ks) in enumerate(BROAD) for k in ks]


def case_sql(classes, text: str, absent: str, other: str = "other") -> str:
    arms = " ".join("WHEN " + " OR ".join(f"contains(lower({text}), '{k}')" for k in ks) + f" THEN '{c}'" for c, ks in classes)
    return f"CASE WHEN {text} IS NULL OR {text} = '' THEN {absent} {arms} ELSE '{other}' END"


def _part(spark, sf):
    return table(spark, sf, "part").select("p_partkey", "p_size", "p_type", "p_brand", "p_retailprice",
                                           F.when(F.col("p_size") <= 45, F.col("p_name")).alias("name"))


PART = "pn AS (SELECT *, CASE WHEN p_size <= 45 THEN p_name END AS name FROM part)"
WITH = f"WITH {PART} "


@query("keyword_classes", WITH + f"SELECT p_partkey, coalesce({case_sql(CLASSES, 'name', 'NULL')}, 'null') AS cls FROM pn")
def keyword_classes(spark, sf):
    c = X.keyword_class("name", CLASSES, absent=None)
    return _part(spark, sf).select("p_partkey", F.coalesce(c, F.lit("null")).alias("cls"))


@query("keyword_classes_from_table", WITH + f"SELECT p_partkey, {case_sql(BROAD, 'name', chr(39) + 'no_annotation' + chr(39), 'excluded')} AS cls FROM pn")
def keyword_classes_from_table(spark, sf):
    """The broad rule, exclusions first, with the keywords in a table."""
    kw = spark.createDataFrame(ROWS, "class string, priority int, keyword string")
    return X.classify_by_table(_part(spark, sf), "name", kw, absent="no_annotation", other="excluded").select("p_partkey", "cls")


@query("document_topic_classes", """
SELECT cls, count(*) AS n FROM (SELECT CASE WHEN text IS NULL OR text = '' THEN 'no_annotation'
 WHEN contains(lower(text), 'license') THEN 'excluded' WHEN contains(lower(text), 'data') THEN 'machinery'
 WHEN contains(lower(text), 'time') OR contains(lower(text), 'year') THEN 'kinase' ELSE 'excluded' END AS cls FROM documents) GROUP BY 1""")
def document_topic_classes(spark, sf):
    c = X.keyword_class("text", [("excluded", ["license"]), ("machinery", ["data"]), ("kinase", ["time", "year"])],
                        absent="no_annotation", other="excluded")
    return groups.class_counts(table(spark, sf, "documents").select(c.alias("cls")), "cls")


@query("keyword_predicates", WITH + """SELECT count(*) AS n, count(*) FILTER (coalesce(contains(name, 'bolt') OR contains(name, 'gear'), false)) AS n_any,
 count(*) FILTER (coalesce((contains(name, 'bolt') OR contains(name, 'gear')) AND NOT contains(name, 'red'), false)) AS n_without FROM pn""")
def keyword_predicates(spark, sf):
    hit, off = X.any_keyword("name", ["BOLT", "Gear"]), X.any_keyword("name", ["red"])
    return _part(spark, sf).agg(F.count(F.lit(1)).alias("n"), F.count_if(hit).alias("n_any"),
                                F.count_if(X.without(hit, off)).alias("n_without"))


@query("class_removal", "SELECT p_partkey, p_type FROM part WHERE NOT contains(upper(p_type), 'PROMO')")
def class_removal(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", "p_type")
    return labels.remove_class(p, "p_type", "promo", low=1)


@query("missed_synonyms", "SELECT p_partkey, p_name FROM part WHERE (contains(lower(p_name), 'ring') OR contains(lower(p_name), 'gizmo')) AND NOT contains(upper(p_name), 'SMALL')")
def missed_synonyms(spark, sf):
    return labels.missed_synonyms(table(spark, sf, "part").select("p_partkey", "p_name"), "p_name", "small", ["ring", "gizmo"])


@query("class_variants", WITH + f""", c AS (SELECT {case_sql(BROAD, 'name', chr(39) + 'no_annotation' + chr(39), 'excluded')} AS cls, coalesce(contains(name, 'blue'), false) AS mv FROM pn)
SELECT v AS variant, CASE WHEN mv AND k IS NOT NULL THEN k ELSE cls END AS cls, count(*) AS n FROM c,
 (VALUES ('primary', NULL), ('to_machinery', 'machinery'), ('to_receptor', 'receptor')) t(v, k) GROUP BY 1, 2""")
def class_variants(spark, sf):
    p = _part(spark, sf).withColumn("cls", X.keyword_class("name", BROAD, absent="no_annotation", other="excluded"))
    v = labels.class_variants(p, "cls", X.any_keyword("name", ["blue"]),
                              {"primary": None, "to_machinery": "machinery", "to_receptor": "receptor"})
    return v.groupBy("variant", "cls").agg(F.count(F.lit(1)).alias("n"))


@query("partition_audit", WITH + """SELECT count(*) AS n_rows, count(*) FILTER (contains(name, 'bolt')) AS n_bolt, count(*) FILTER (contains(name, 'gear')) AS n_gear,
 count(*) FILTER (contains(name, 'bolt') AND contains(name, 'gear')) AS n_bolt_and_gear FROM pn""")
def partition_audit(spark, sf):
    a = checks.partition_audit(_part(spark, sf), {"bolt": X.any_keyword("name", ["bolt"]), "gear": X.any_keyword("name", ["gear"])},
                               disjoint=[("bolt", "gear")])
    return checks.ensure(a, F.col("n_bolt_and_gear") == 0, "classes overlap")


@query("threshold_labels", """SELECT o_orderkey, (o_totalprice >= 100000)::BIGINT AS at_least, (o_totalprice > 100000)::BIGINT AS above,
 (o_totalprice >= m)::BIGINT AS at_median, -o_totalprice AS oriented FROM orders, (SELECT quantile_cont(o_totalprice, 0.5) AS m FROM orders)""")
def threshold_labels(spark, sf):
    o = classify.label_by_median(table(spark, sf, "orders"), [], "o_totalprice", "at_median")
    return o.select("o_orderkey", classify.at_least("o_totalprice", 100000).alias("at_least"),
                    classify.above("o_totalprice", 100000).alias("above"), "at_median",
                    classify.orient("o_totalprice", True).alias("oriented"))


@query("joint_label", """SELECT c_custkey, c_acctbal < 0 AND coalesce(m, 0) < 150000 AS both_low FROM customer
 LEFT JOIN (SELECT o_custkey, avg(o_totalprice) AS m FROM orders GROUP BY 1) ON o_custkey = c_custkey""")
def joint_label(spark, sf):
    o = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.avg("o_totalprice").alias("m"))
    c = table(spark, sf, "customer").join(o, "c_custkey", "left")
    c = c.withColumn("a", F.col("c_acctbal")).withColumn("b", F.coalesce("m", F.lit(0.0)) - 150000)
    return c.select("c_custkey", labels.both_below("a", "b", 0.0).alias("both_low"))


@query("quartile_digitize", """SELECT bin, count(*) AS n, round(avg(x), 6) AS mean FROM (SELECT o_totalprice AS x,
 ((e1 <= o_totalprice)::INT + (e2 <= o_totalprice)::INT + (e3 <= o_totalprice)::INT)::BIGINT AS bin FROM orders,
 (SELECT quantile_cont(o_totalprice, 0.25) AS e1, quantile_cont(o_totalprice, 0.5) AS e2, quantile_cont(o_totalprice, 0.75) AS e3 FROM orders)) GROUP BY 1""")
def quartile_digitize(spark, sf):
    o = groups.quantile_group(table(spark, sf, "orders").select("o_totalprice"), [], "o_totalprice", 4)
    return o.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg("o_totalprice").alias("mean"))


@query("size_corrected_scores", "SELECT user_id, round(avg(value) / sqrt(count(*)), 6) AS corrected FROM events GROUP BY 1")
def size_corrected_scores(spark, sf):
    e = table(spark, sf, "events").groupBy("user_id").agg(F.avg("value").alias("x"), F.count(F.lit(1)).alias("n"))
    return e.select("user_id", region.size_corrected(F.col("x"), F.col("n")).alias("corrected"))


@query("population_median_flags", """SELECT c_mktsegment, count(*) AS n, count(*) FILTER (c_acctbal < m) AS n_below, round(any_value(m), 6) AS population_median
 FROM customer, (SELECT quantile_cont(c_acctbal, 0.5) AS m FROM customer) GROUP BY 1""")
def population_median_flags(spark, sf):
    f = region.population_flags(table(spark, sf, "customer"), "c_acctbal")
    return f.groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"), F.count_if("below_median").alias("n_below"),
                                         F.max("population_median").alias("population_median"))


@query("dose_filter", """SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, TRY_CAST(replace(d, 'x', 'bad') AS DOUBLE) AS dose FROM (
 SELECT *, CASE WHEN l_linenumber = 3 THEN 'x' ELSE (l_quantity - 5)::VARCHAR END AS d FROM lineitem)
 WHERE l_returnflag = 'R' AND TRY_CAST(replace(d, 'x', 'bad') AS DOUBLE) > 0""")
def dose_filter(spark, sf):
    d = F.when(F.col("l_linenumber") == 3, "bad").otherwise((F.col("l_quantity") - 5).cast("string"))
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_returnflag").alias("pert_type"), d.alias("pert_dose"))
    return labels.dosed(li, wanted="R").select("l_orderkey", "l_linenumber", "dose")


@query("known_entities", """SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, p_brand FROM lineitem JOIN part ON l_partkey = p_partkey
 WHERE p_size <= 45 AND p_type = 'PROMO'""")
def known_entities(spark, sf):
    info = _part(spark, sf).filter("p_type = 'PROMO'").select(F.col("p_partkey").alias("sig_id"), "p_brand", F.col("name").alias("pert_iname"))
    sig = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("sig_id"), "l_orderkey", "l_linenumber")
    return labels.known_signatures(sig, info).select("l_orderkey", "l_linenumber", "p_brand")


CURATED = ["BRAND#1", "brand#7", "Brand#25", "Brand#99"]


@query("curated_members", "SELECT p_partkey FROM part WHERE lower(p_brand) IN ('brand#1', 'brand#7', 'brand#25', 'brand#99')")
def curated_members(spark, sf):
    names = spark.createDataFrame([(c,) for c in CURATED], "name string")
    return labels.in_list(table(spark, sf, "part"), "p_brand", names).select("p_partkey")


@query("curated_found", """SELECT n.p_brand, s.n IS NOT NULL AS found, coalesce(s.n, 0) AS n FROM (VALUES ('BRAND#1'), ('brand#7'), ('Brand#25'), ('Brand#99')) n(p_brand)
 LEFT JOIN (SELECT p_brand, count(*) AS n FROM part GROUP BY 1) s ON s.p_brand = n.p_brand""")
def curated_found(spark, sf):
    names = spark.createDataFrame([(c,) for c in CURATED], "p_brand string")
    counts = groups.class_counts(table(spark, sf, "part"), "p_brand")
    return matching.found_in(names, counts, "p_brand").na.fill(0, ["n"])


@query("first_token", "SELECT p_name, trim(split_part(p_name, ' ', 1)) AS token, count(*) AS n FROM part GROUP BY 1, 2")
def first_token(spark, sf):
    p = table(spark, sf, "part").select("p_name", X.first_token("p_name", " ").alias("token"))
    return p.groupBy("p_name", "token").agg(F.count(F.lit(1)).alias("n"))


@query("duplicate_keys", "SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_keys(spark, sf):
    return checks.duplicates(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("axis_mismatches", """SELECT a.p_partkey AS idx, a.p_type AS name_a, b.p_type AS name_b FROM part a
 FULL JOIN part b ON a.p_partkey + 1 = b.p_partkey WHERE a.p_partkey IS NOT NULL AND a.p_type IS DISTINCT FROM b.p_type""")
def axis_mismatches(spark, sf):
    p = table(spark, sf, "part")
    a = p.select(F.col("p_partkey").alias("idx"), F.col("p_type").alias("feature_id"))
    b = p.select((F.col("p_partkey") - 1).alias("idx"), F.col("p_type").alias("feature_id")).filter("idx >= 0")
    return checks.axis_mismatches(a, b)


@query("context_union", "SELECT DISTINCT s_nationkey FROM lineitem JOIN supplier ON l_suppkey = s_suppkey UNION SELECT DISTINCT c_nationkey FROM customer")
def context_union(spark, sf):
    a = A.sales_lines(spark, sf).select("s_nationkey").distinct()
    return a.union(table(spark, sf, "customer").select("c_nationkey").distinct()).distinct()


@query("key_intersection", "SELECT count(*) AS n FROM (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def key_intersection(spark, sf):
    o = table(spark, sf, "orders").withColumnRenamed("o_custkey", "k")
    return checks.overlap(o.filter("o_orderstatus = 'F'"), o.filter("o_orderstatus = 'P'"), ["k"]).agg(F.count(F.lit(1)).alias("n"))


@query("missing_keys", "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'")
def missing_keys(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"))
    o = table(spark, sf, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("k"))
    return checks.not_contained(c, o, ["k"])


@query("first_row_per_key", """SELECT o_custkey, o_totalprice, o_orderkey FROM orders
 QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) = 1""")
def first_row_per_key(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", "o_totalprice", "o_orderkey")
    return groups.first_per_key(o, ["o_custkey"], ["o_totalprice", "o_orderkey"])


@query("distinct_metadata_join", """SELECT d.p_brand, d.p_type, count(*) AS n FROM (SELECT DISTINCT p_brand, p_type FROM part WHERE p_size < 10) d
 JOIN part p ON p.p_brand = d.p_brand AND p.p_type = d.p_type GROUP BY 1, 2""")
def distinct_metadata_join(spark, sf):
    p = table(spark, sf, "part")
    d = p.filter("p_size < 10").select("p_brand", "p_type").dropDuplicates()
    return p.join(d, ["p_brand", "p_type"]).groupBy("p_brand", "p_type").agg(F.count(F.lit(1)).alias("n"))


@query("class_subsets_concatenated", """SELECT p_partkey, 'small' AS part_of FROM part WHERE p_size <= 10 UNION ALL SELECT p_partkey, 'large' FROM part WHERE p_size >= 5""")
def class_subsets_concatenated(spark, sf):
    p = table(spark, sf, "part")
    a = p.filter("p_size <= 10").select("p_partkey", F.lit("small").alias("part_of"))
    return a.unionByName(p.filter("p_size >= 5").select("p_partkey", F.lit("large").alias("part_of")))


@query("calibration_overlay", """SELECT p_type, round(avg(p_retailprice), 6) AS mean, round(quantile_cont(p_retailprice, 0.25), 6) AS p25,
 round(quantile_cont(p_retailprice, 0.5), 6) AS median, round(quantile_cont(p_retailprice, 0.75), 6) AS p75 FROM part GROUP BY 1""")
def calibration_overlay(spark, sf):
    p = table(spark, sf, "part")
    q = quantiles(p, ["p_type"], "p_retailprice", {"p25": 0.25, "median": 0.5, "p75": 0.75})
    return p.groupBy("p_type").agg(F.avg("p_retailprice").alias("mean")).join(q, "p_type")
