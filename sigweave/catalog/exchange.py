"""Readers, sinks and hand-off on files that are written from the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.collapse import with_min_contexts
from ..operators.common import checkpoint_folder
from ..operators.region import with_effects
from ..sources import readers, sinks
from . import adapters as A
from .registry import query, table


def fresh_path(spark: SparkSession) -> str:
    """A new path in the folder that all executors share."""
    return f"{checkpoint_folder(spark)}/exchange-{uuid.uuid4().hex}"


def _schema(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in columns.items()])


@query("read_signatures", A.ctes(A.SALES) + """
SELECT entity || ':' || context AS sig_id, len(vec) AS n_features, round(sqrt(list_dot_product(vec, vec)), 6) + 0 AS norm FROM sig""")
def read_signatures(spark, sf):
    path = fresh_path(spark)
    sig = A.sales(spark, sf).select(F.concat_ws(":", "entity", "context").alias("sig_id"), "vec")
    sinks.write_parquet(sig, path)
    return readers.signatures(spark, path).select(
        "sig_id", F.size("vec").alias("n_features"), F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x)).alias("norm"))


@query("read_gzip_tsv", """SELECT o_orderpriority AS cell_id, count(*) AS n, round(sum(o_totalprice), 2) AS total,
 count(*) FILTER (o_orderstatus <> 'O') AS n_known FROM orders GROUP BY 1""")
def read_gzip_tsv(spark, sf):
    path = fresh_path(spark)
    rows = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("sig_id"), F.col("o_orderpriority").alias("cell_id"),
        F.when(F.col("o_orderstatus") == "O", "NaN").otherwise(F.col("o_orderstatus")).alias("pert_dose"), F.col("o_totalprice").alias("x"))
    rows.write.option("sep", "\t").option("header", True).option("compression", "gzip").csv(path)
    read = readers.delimited(spark, path, _schema(sig_id=T.StringType(), cell_id=T.StringType(), pert_dose=T.StringType(), x=T.DoubleType()),
                             partitions=8)
    return read.groupBy("cell_id").agg(F.count("*").alias("n"), F.round(F.sum("x"), 2).alias("total"), F.count("pert_dose").alias("n_known"))


@query("read_csv_sink", "SELECT c_mktsegment AS segment, count(*) AS n, round(sum(c_acctbal), 2) AS balance FROM customer GROUP BY 1")
def read_csv_sink(spark, sf):
    path = fresh_path(spark)
    sinks.write_csv(table(spark, sf, "customer").select("c_mktsegment", "c_acctbal"), path, {"c_mktsegment": "segment"})
    read = readers.csv(spark, path, _schema(segment=T.StringType(), c_acctbal=T.DoubleType()))
    return read.groupBy("segment").agg(F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


@query("read_nested_labels", """SELECT p_brand AS pert_iname, count(DISTINCT p_type) AS n_targets, min(p_type) AS first_target
 FROM part GROUP BY 1""")
def read_nested_labels(spark, sf):
    """One document with all brands: there are 25, however large the table is."""
    path = fresh_path(spark)
    drugs = table(spark, sf, "part").groupBy(F.col("p_brand").alias("pert_iname")).agg(
        F.array_join(F.array_sort(F.collect_set("p_type")), "|").alias("target"), F.lit("none").alias("moa"))
    drugs.groupBy().agg(F.to_json(F.struct(F.collect_list(F.struct("pert_iname", "target", "moa")).alias("drugs")))).write.text(path)
    return readers.nested_labels(spark, path).select(
        "pert_iname", F.size(F.split("target", r"\|")).alias("n_targets"), "first_target")


@query("read_json_records", "SELECT n_name AS name, n_regionkey AS region FROM nation")
def read_json_records(spark, sf):
    path = fresh_path(spark)
    one = table(spark, sf, "nation").groupBy().agg(
        F.to_json(F.collect_list(F.struct(F.col("n_name").alias("name"), F.col("n_regionkey").alias("region")))))
    one.write.text(path)
    return readers.json_records(spark, path, _schema(name=T.StringType(), region=T.LongType()))


@query("read_json_sink", "SELECT s_nationkey AS nation, count(*) AS n, round(sum(s_acctbal), 2) AS balance FROM supplier GROUP BY 1")
def read_json_sink(spark, sf):
    path = fresh_path(spark)
    sinks.write_json(table(spark, sf, "supplier").select("s_nationkey", "s_acctbal"), path)
    read = spark.read.schema(_schema(s_nationkey=T.LongType(), s_acctbal=T.DoubleType())).json(path)
    return read.groupBy(F.col("s_nationkey").alias("nation")).agg(F.count("*").alias("n"), F.round(F.sum("s_acctbal"), 2).alias("balance"))


@query("read_json_keyed", "SELECT p_brand AS gene, count(*) AS n, round(avg(p_retailprice), 6) + 0 AS mean FROM part GROUP BY 1")
def read_json_keyed(spark, sf):
    """Keyed by the 25 brands, inside a wrapper object."""
    path = fresh_path(spark)
    per = table(spark, sf, "part").groupBy("p_brand").agg(F.count("*").alias("n"), F.avg("p_retailprice").alias("mean"))
    entries = F.map_from_entries(F.collect_list(F.struct("p_brand", F.struct("n", "mean"))))
    per.groupBy().agg(F.to_json(F.struct(entries.alias("genes")))).write.text(path)
    return readers.json_keyed(spark, path, _schema(n=T.LongType(), mean=T.DoubleType()), wrapper="genes")


@query("read_region_scores", """SELECT r_name AS region, round(avg(c_acctbal), 6) + 0 AS raw, count(*) AS n_neurons, round(avg(c_acctbal) / sqrt(count(*)), 6) + 0 AS corrected
 FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1""")
def read_region_scores(spark, sf):
    """Both spellings of the keys, and regions measured on both sides (C16)."""
    path = fresh_path(spark)
    per = (table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
           .join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
           .groupBy("r_name").agg(F.avg("c_acctbal").alias("m"), F.count("*").alias("n")))
    new = F.struct(F.when(F.col("r_name") < "B", F.col("m")).alias("raw_bn"), F.when(F.col("r_name") >= "B", F.col("m")).alias("bracket_norm"),
                   F.when(F.col("r_name") < "B", F.col("n")).alias("n_neurons"), F.when(F.col("r_name") >= "B", F.col("n")).alias("neuron_count"))
    entries = F.map_from_entries(F.collect_list(F.struct("r_name", new)))
    per.groupBy().agg(F.to_json(F.struct(entries.alias("per_region")))).write.text(path)
    read = readers.region_scores(spark, path)
    effects = read.select("region", (F.col("raw") / F.sqrt("n_neurons")).alias("corrected"))
    return with_effects(read, effects)


@query("read_single_cells", """SELECT l_linestatus AS perturbation, count(DISTINCT l_orderkey) AS n_cells, round(sum(l_quantity), 6) + 0 AS x
 FROM lineitem GROUP BY 1""")
def read_single_cells(spark, sf):
    cells_path, expression_path = fresh_path(spark), fresh_path(spark)
    lines = table(spark, sf, "lineitem")
    cell = F.concat_ws(":", "l_orderkey", "l_linestatus").alias("cell_id")
    sinks.write_parquet(lines.select(cell, F.col("l_linestatus").alias("perturbation")).distinct(), cells_path)
    sinks.write_parquet(lines.select(cell, F.col("l_linenumber").cast("string").alias("feature"), F.col("l_quantity").cast("double").alias("x")),
                        expression_path)
    cells, expression = readers.single_cells(spark, cells_path, expression_path)
    return expression.join(cells, "cell_id").groupBy("perturbation").agg(
        F.countDistinct("cell_id").alias("n_cells"), F.sum("x").alias("x"))


@query("hand_off", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def hand_off(spark, sf):
    return sinks.hand_off(table(spark, sf, "events").select("event_type")).groupBy("event_type").agg(F.count("*").alias("n"))


@query("without_nan", """SELECT l_returnflag, count(*) FILTER (l_discount <> 0) AS n, round(avg(l_tax / l_discount) FILTER (l_discount <> 0), 6) + 0 AS mean
 FROM lineitem GROUP BY 1""")
def without_nan(spark, sf):
    rows = table(spark, sf, "lineitem").select(
        "l_returnflag", F.when(F.col("l_discount") == 0, float("nan")).otherwise(F.try_divide("l_tax", "l_discount")).alias("x"))
    return readers.without_nan(rows, ["x"]).groupBy("l_returnflag").agg(F.count("x").alias("n"), F.avg("x").alias("mean"))


@query("scores_with_holdout", """SELECT c_custkey, n, mean_price, last_price FROM
 (SELECT o_custkey AS c_custkey, count(DISTINCT o_orderpriority) AS n, round(avg(o_totalprice), 6) + 0 AS mean_price FROM orders GROUP BY 1)
 JOIN (SELECT o_custkey, round(max(o_totalprice), 6) + 0 AS last_price FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) ON c_custkey = o_custkey
 WHERE n >= 3""")
def scores_with_holdout(spark, sf):
    """Minimum contexts on the score table, then the join with the held-out side (B4, C3)."""
    orders = table(spark, sf, "orders").withColumnRenamed("o_custkey", "c_custkey")
    kept = with_min_contexts(orders, ["c_custkey"], "o_orderpriority", 3)
    scores = kept.groupBy("c_custkey").agg(F.countDistinct("o_orderpriority").alias("n"), F.avg("o_totalprice").alias("mean_price"))
    held = orders.filter("o_orderstatus = 'F'").groupBy("c_custkey").agg(F.max("o_totalprice").alias("last_price"))
    return scores.join(held, "c_custkey")
