"""Small relational helpers shared by the operators."""

from __future__ import annotations

import atexit
import shutil
import tempfile
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

def join_groups(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join on grouping columns in which NULL is a group like any other.

    The keys travel as one struct: its equality takes NULL fields for equal, and unlike a
    null-safe comparison of each column it keeps one hash partitioning.
    """
    keys = list(keys)
    pack = F.struct(*[F.col(f"`{k}`") for k in keys])
    own = right.select(pack.alias("_group"), *[F.col(f"`{c}`") for c in right.columns if c not in keys])
    return left.withColumn("_group", pack).join(own, "_group", how).drop("_group")


def without_nan(x: Column, kind: str) -> Column:
    """NaN as NULL, for floating columns: rank statistics leave both out."""
    return F.nanvl(x, F.lit(None).cast(kind)) if kind in ("double", "float") else x


def attach(df: DataFrame, stats: DataFrame, by: Sequence[str]) -> DataFrame:
    """Add the columns of ``stats`` (one row per ``by``) to ``df``.

    Without keys the single row arrives as a scalar subquery, not as a cross join.
    """
    if by:
        return join_groups(df, stats, by)
    cols = stats.columns
    row = stats.select(F.struct(*cols).alias("_row")).scalar()
    return df.withColumn("_row", row).select(*df.columns, *[F.col("_row")[c].alias(c) for c in cols])


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder for checkpoints: the context's, else what ``spark.checkpoint.dir`` names.

    A session on a single machine that names none gets a folder of its own, deleted at
    exit. A cluster must name one: a folder of one machine would be lost with it.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            named = tempfile.mkdtemp(prefix="sigweave-checkpoints-")
            atexit.register(shutil.rmtree, named, ignore_errors=True)
        sc.setCheckpointDir(named)
    return sc.getCheckpointDir()


def reuse(df: DataFrame) -> DataFrame:
    """Fix a narrow intermediate that several branches of one plan read.

    It is checkpointed: computed once, safe against lost executors, and the plans above it
    stay small. Its files go with the context's cleaner, where that is told to
    (``spark.cleaner.referenceTracking.cleanCheckpoints``).
    """
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


#: Rows of a table of groups up to which every task gets all of it.
SENT_ROWS = 100_000


def sent(stats: DataFrame) -> DataFrame:
    """A table of groups, fixed and counted, and hinted broadcast where it is small: joined to it, the rows of a large group stay spread."""
    fixed = reuse(stats)
    return F.broadcast(fixed) if fixed.count() <= SENT_ROWS else fixed


def unpivot(df: DataFrame, keep: Sequence[str], columns: Sequence[str], name: str,
            value: str) -> DataFrame:
    """Wide score columns to (name, value) rows."""
    ids = [F.col(c) for c in keep]
    return df.unpivot(ids, [F.col(c).cast("double").alias(c) for c in columns], name, value)


def half_away(x: Column, digits: int) -> Column:
    """Rounded to ``digits`` as SQL engines do it on doubles: the scaled number to the nearest integer, halves away from zero.

    ``F.round`` rounds the shortest decimal of the double, which differs from that near halves.
    """
    scale = float(10 ** digits)
    scaled = F.abs(x) * scale
    whole = F.floor(scaled)
    return F.signum(x) * (whole + (scaled - whole >= 0.5).cast("long")) / scale


def r6(name: str, alias: str | None = None) -> Column:
    return F.round(F.col(name), 6).alias(alias or name)
