"""Result sinks and stage hand-off."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.common import reuse


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str, rename: dict[str, str] | None = None) -> None:
    df.withColumnsRenamed(rename or {}).write.mode("overwrite").option("header", True).csv(path)


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def hand_off(df: DataFrame) -> DataFrame:
    """Cut the lineage between stages with a reliable checkpoint in ``spark.checkpoint.dir``."""
    return reuse(df)
