"""Readers for the exchange formats."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import schemas


def signatures(spark: SparkSession, path: str) -> DataFrame:
    """Signature table: id and dense vector."""
    return spark.read.schema(schemas.SIGNATURES).parquet(path)


def delimited(spark: SparkSession, path: str, schema: T.StructType, *, sep: str = "\t",
              partitions: int | None = None) -> DataFrame:
    """TSV/CSV with a header, plain or gzipped, NaN read as NULL.

    One gzip file is one task; ``partitions`` spreads its rows for the work after it.
    """
    df = (spark.read.schema(schema).option("sep", sep).option("header", True)
          .option("nullValue", "NaN").csv(path))
    return df.repartition(partitions) if partitions else df


def csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return delimited(spark, path, schema, sep=",")


def nested_labels(spark: SparkSession, path: str) -> DataFrame:
    """{"drugs": [{pert_iname, target, moa}, ...]} flattened, with the first target of the list."""
    doc = spark.read.schema(schemas.LABELS).option("multiLine", True).json(path)
    flat = doc.select(F.explode("drugs").alias("d")).select("d.*")
    return flat.withColumn("first_target", F.trim(F.split_part("target", F.lit("|"), F.lit(1))))


def json_records(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A JSON array of objects, one row each."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def json_keyed(spark: SparkSession, path: str, value: T.StructType, *, key: str = "gene",
               wrapper: str | None = None) -> DataFrame:
    """{key: {...}, ...}, optionally inside a wrapper object, as one row per key."""
    entries = T.MapType(T.StringType(), value)
    shape = T.StructType([T.StructField(wrapper, entries)]) if wrapper else entries
    text = spark.read.option("wholetext", True).text(path)
    parsed = F.from_json("value", shape)
    m = parsed.getField(wrapper) if wrapper else parsed
    return text.select(F.explode(m).alias(key, "_v")).select(key, "_v.*")


def region_scores(spark: SparkSession, path: str) -> DataFrame:
    """Region scores with either spelling of their keys and an optional wrapper; a missing key fails."""
    value = T.StructType([T.StructField(c, T.DoubleType())
                          for c in ("raw_bn", "bracket_norm", "n_neurons", "neuron_count")])
    entries = T.MapType(T.StringType(), value)
    text = spark.read.option("wholetext", True).text(path)
    inner = F.get_json_object("value", "$.per_region")
    rows = text.select(F.explode(F.from_json(F.coalesce(inner, "value"), entries)).alias("region", "v"))

    def need(*names: str) -> Column:
        lost = F.raise_error(F.concat(F.lit(f"region without {' or '.join(names)}: "), F.col("region")))
        return F.coalesce(*[F.col(f"v.{n}") for n in names], lost.cast("double"))

    return rows.select("region", need("raw_bn", "bracket_norm").alias("raw"),
                       need("n_neurons", "neuron_count").cast("long").alias("n_neurons"))


def single_cells(spark: SparkSession, cells: str, expression: str) -> tuple[DataFrame, DataFrame]:
    """Cells with their perturbation, and sparse long expression."""
    return (spark.read.schema(schemas.CELLS).parquet(cells),
            spark.read.schema(schemas.CELL_EXPRESSION).parquet(expression))


def without_nan(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """NaN to NULL, so ranks and aggregates skip it."""
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in columns})
