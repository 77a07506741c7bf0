"""The provided tables in the roles of the data model, in DataFrame form and as SQL text.

Sales play the signatures: the 12 monthly quantities of an entity (brand, part or
part type) in a context (supplier nation), centred on their mean.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.collapse import collapse, long_to_vectors
from .registry import table

MONTHS = 12


def sales_lines(spark: SparkSession, sf: str) -> DataFrame:
    """One row per order line: brand, type, part, nation, month, quantity, price."""
    li = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate")
    part = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand", "p_type")
    supp = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    return li.join(part, "l_partkey").join(supp, "l_suppkey").withColumn("idx", F.month("l_shipdate") - 1)


def sales(spark: SparkSession, sf: str, entity: str = "p_brand", extra: tuple[str, ...] = ()) -> DataFrame:
    """(entity, context[, extra], vec)."""
    lines = sales_lines(spark, sf)
    if "dose" in extra:
        lines = lines.withColumn("dose", F.ceil(F.col("l_quantity") / 5).cast("long"))
    lines = lines.withColumnsRenamed({entity: "entity", "s_nationkey": "context"})
    return long_to_vectors(lines, ["entity", "context", *extra], F.col("idx"), F.col("l_quantity"), MONTHS, centred=True)


_MONTH_SUMS = ", ".join(
    f"coalesce(sum(l_quantity) FILTER (month(l_shipdate) = {i + 1}), 0)" for i in range(MONTHS))


def sales_sql(name: str, entity: str = "p_brand", extra: str = "", group: str = "1, 2") -> str:
    """CTE of the same content."""
    return f"""{name} AS (
  SELECT * EXCLUDE (v), list_transform(v, lambda y: y - list_avg(v)) AS vec FROM (
    SELECT {entity} AS entity, s_nationkey AS context{extra}, [{_MONTH_SUMS}]::DOUBLE[] AS v
    FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
    GROUP BY {group}))"""


SALES = sales_sql("sig")
SALES_PART = sales_sql("sig", "l_partkey")
SALES_TYPE = sales_sql("typ", "p_type")
SALES_DOSE = sales_sql("sig", extra=", ceil(l_quantity / 5)::BIGINT AS dose", group="1, 2, 3")

# unit vectors and norms on top of a sig CTE
UNIT = """unit AS (
  SELECT *, sqrt(list_dot_product(vec, vec)) AS nrm,
         list_transform(vec, lambda y: y / greatest(sqrt(list_dot_product(vec, vec)), 1e-12)) AS u
  FROM sig)"""


def embeddings(spark: SparkSession, sf: str) -> DataFrame:
    """Single embeddings as replicate signatures: (entity, context, rep, vec)."""
    e = table(spark, sf, "embeddings")
    return e.select(F.col("label").cast("long").alias("entity"), (F.col("vec_id") % 8).alias("context"),
                    F.col("vec_id").alias("rep"), F.col("embedding").cast("array<double>").alias("vec"))


def embedding_means(spark: SparkSession, sf: str) -> DataFrame:
    return collapse(embeddings(spark, sf), ["entity", "context"])


EMB = """emb_long AS (
  SELECT label::BIGINT AS entity, vec_id % 8 AS context, unnest(embedding)::DOUBLE AS x,
         generate_subscripts(embedding, 1) AS i FROM embeddings),
emb_mean AS (SELECT entity, context, i, avg(x) AS m, count(*) AS n FROM emb_long GROUP BY ALL),
sig AS (SELECT entity, context, max(n) AS n_rep, list(m ORDER BY i) AS vec
        FROM emb_mean GROUP BY entity, context)"""


def consensus_by_type(spark: SparkSession, sf: str) -> DataFrame:
    """Target direction per part type: mean over its nations."""
    types = sales(spark, sf, "p_type")
    c = collapse(types, ["entity"], count="n_sig", min_count=3, dim=MONTHS)
    return c.select(F.col("entity").alias("target"), "n_sig", F.col("vec").alias("direction"))


CONSENSUS = SALES_TYPE + """,
cons AS (SELECT target, list(m ORDER BY i) AS direction, max(n) AS n_sig FROM (
   SELECT entity AS target, i, avg(x) AS m, count(*) AS n FROM (
     SELECT entity, unnest(vec) AS x, generate_subscripts(vec, 1) AS i FROM typ) GROUP BY ALL)
   GROUP BY target HAVING max(n) >= 3)"""


def targets(spark: SparkSession, sf: str) -> DataFrame:
    """Brand to its most frequent part type, ties by name."""
    c = table(spark, sf, "part").groupBy("p_brand", "p_type").agg(F.count(F.lit(1)).alias("n"))
    return c.groupBy(F.col("p_brand").alias("entity")).agg(
        F.min(F.struct((-F.col("n")).alias("n"), F.col("p_type").alias("t"))).alias("s")).select(
        "entity", F.col("s.t").alias("target"))


TARGETS = """tgt AS (SELECT p_brand AS entity, p_type AS target FROM (
   SELECT p_brand, p_type, row_number() OVER (PARTITION BY p_brand ORDER BY count(*) DESC, p_type) AS rn
   FROM part GROUP BY 1, 2) WHERE rn = 1)"""


def two_contexts(spark: SparkSession, sf: str) -> DataFrame:
    """Per user: event values by type, first and second half of the month, 5 features each.

    An event of a type that is not on the axis is an error.
    """
    e = table(spark, sf, "events").select(
        "user_id", "value", F.when(F.dayofmonth("ts") <= 15, 0).otherwise(1).alias("half"),
        F.coalesce(*[F.when(F.col("event_type") == t, F.lit(i)) for i, t in enumerate(EVENT_TYPES)],
                   F.raise_error(F.concat(F.lit("unknown event type "), "event_type")).cast("int")).alias("idx"))
    return long_to_vectors(e, ["user_id", "half"], F.col("idx"), F.col("value"), len(EVENT_TYPES))


EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]
_EVENT_SUMS = ", ".join(f"coalesce(sum(value) FILTER (event_type = '{t}'), 0)" for t in EVENT_TYPES)
TWO = f"""two AS (SELECT user_id, CASE WHEN day(ts) <= 15 THEN 0 ELSE 1 END AS half,
   [{_EVENT_SUMS}]::DOUBLE[] AS vec FROM events GROUP BY 1, 2)"""


def document_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled documents with three predictors."""
    d = table(spark, sf, "documents").select(
        "doc_id", "source", "lang", F.col("n_chars").cast("double").alias("n_chars"),
        F.size(F.split("text", " ")).cast("double").alias("n_words"),
        F.try_divide(F.length(F.regexp_replace("text", "[^0-9]", "")).cast("double"),
                     F.col("n_chars").cast("double")).alias("digit_share"))
    lab = table(spark, sf, "labels").select("doc_id", F.col("quality").cast("long").alias("quality"),
                                            F.col("toxic").cast("long").alias("toxic"))
    return d.join(lab, "doc_id")


DOCS = """docs AS (SELECT d.doc_id, source, lang, n_chars::DOUBLE AS n_chars,
   len(string_split(text, ' '))::DOUBLE AS n_words,
   length(regexp_replace(text, '[^0-9]', '', 'g'))::DOUBLE / nullif(n_chars, 0)::DOUBLE AS digit_share,
   quality::BIGINT AS quality, toxic::BIGINT AS toxic
   FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""


def customer_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Per customer: balance, segment, order count, mean and maximum order price."""
    o = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.count(F.lit(1)).alias("n_orders"), F.round(F.avg("o_totalprice"), 6).alias("mean_price"),
        F.max("o_totalprice").alias("max_price"))
    c = table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment")
    return c.join(o, "c_custkey")


CUST = """cust AS (SELECT c_custkey, c_nationkey, c_acctbal, c_mktsegment, n_orders, mean_price, max_price
   FROM customer JOIN (SELECT o_custkey, count(*) AS n_orders, round(avg(o_totalprice), 6) AS mean_price,
      max(o_totalprice) AS max_price FROM orders GROUP BY 1) ON c_custkey = o_custkey)"""


def ctes(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"
