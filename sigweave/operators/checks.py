"""Data assertions that run inside the query, and decision gates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def duplicates(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keys that occur more than once; must be empty."""
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)


def axis_mismatches(a: DataFrame, b: DataFrame, idx: str = "idx", name: str = "feature_id") -> DataFrame:
    """Positions where two feature axes differ in name or presence; must be empty."""
    j = a.select(idx, F.col(name).alias("name_a")).join(b.select(idx, F.col(name).alias("name_b")), idx, "full")
    return j.filter(~F.col("name_a").eqNullSafe(F.col("name_b")))


def partition_audit(df: DataFrame, tests: dict[str, Column], *, disjoint: Sequence[tuple[str, str]] = ()) -> DataFrame:
    """One row: how many rows satisfy each predicate, and how many satisfy both of each pair."""
    counts = [F.count_if(p).alias(f"n_{k}") for k, p in tests.items()]
    both = [F.count_if(tests[a] & tests[b]).alias(f"n_{a}_and_{b}") for a, b in disjoint]
    return df.agg(F.count(F.lit(1)).alias("n_rows"), *counts, *both)


def ensure(df: DataFrame, ok: Column, message: str) -> DataFrame:
    """Fail the query on the first row that breaks the condition (NULL counts as broken)."""
    good = F.coalesce(ok, F.lit(False))
    return df.filter(F.when(good, F.lit(True)).otherwise(F.raise_error(F.lit(message)).cast("boolean")))


def overlap(a: DataFrame, b: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows common to both; must be empty for disjoint sets."""
    return a.select(*columns).intersect(b.select(*columns))


def not_contained(a: DataFrame, b: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows of a that b lacks; must be empty when a is a subset."""
    return a.select(*columns).distinct().exceptAll(b.select(*columns).distinct())


def gates(df: DataFrame, criteria: dict[str, Column], *, overall: str | None = None) -> DataFrame:
    """Decision criteria as boolean columns, and their conjunction."""
    out = df.withColumns(criteria)
    if overall:
        every = F.lit(True)
        for k in criteria:
            every = every & F.col(k)
        out = out.withColumn(overall, every)
    return out


def three_way(x: Column, reference: float) -> Column:
    """a: at or above the reference; b: positive; c: not positive."""
    return F.when(x >= reference, "a").when(x > 0, "b").when(x.isNotNull(), "c")


def combined_gate(passed: Sequence[Column], names: tuple[str, str, str] = ("all", "some", "none")) -> Column:
    """all, some or none of several gates passed."""
    n = F.lit(0)
    for p in passed:
        n = n + F.coalesce(p, F.lit(False)).cast("int")
    return F.when(n == len(passed), names[0]).when(n > 0, names[1]).otherwise(names[2])
