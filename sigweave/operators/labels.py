"""Row labelling: filters, class variants and their audits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import any_keyword, numeric_or_null, present


def known_signatures(signatures: DataFrame, info: DataFrame, *, sig_id: str = "sig_id",
                     entity: str = "pert_iname", empty_is_missing: bool = False) -> DataFrame:
    """Signatures with metadata and a named entity."""
    named = info.filter(present(entity) if empty_is_missing else F.col(entity).isNotNull())
    return signatures.join(named, sig_id)


def dosed(info: DataFrame, *, pert_type: str = "pert_type", wanted: str = "trt_cp",
          dose: str = "pert_dose") -> DataFrame:
    """Rows of the wanted type with a positive numeric dose; bad numbers drop out."""
    d = numeric_or_null(dose)
    return info.filter(F.col(pert_type) == wanted).withColumn("dose", d).filter(F.col("dose") > 0)


def in_list(df: DataFrame, name: str, names: DataFrame, *, ignore_case: bool = True) -> DataFrame:
    """Rows whose name is on a curated list."""
    k = F.lower if ignore_case else (lambda c: c)
    right = names.select(k(F.col(names.columns[0])).alias("_k")).distinct()
    return df.withColumn("_k", k(F.col(name))).join(right, "_k", "left_semi").drop("_k")


def both_below(a: str, b: str, cut: float = -0.5) -> Column:
    """Conjunctive label: both effects under the cut."""
    return (F.col(a) < cut) & (F.col(b) < cut)


def remove_class(df: DataFrame, text: str, word: str, *, low: int | None = None,
                 high: int | None = None) -> DataFrame:
    """Drop rows whose text contains ``word``; with bounds, fail unless the number dropped lies between.

    The count is a scalar subquery next to the filter, so the guard runs with the query.
    """
    hit = F.coalesce(F.upper(F.col(text)).contains(word.upper()), F.lit(False))
    kept = df.filter(~hit)
    if low is None and high is None:
        return kept
    count = df.filter(hit).agg(F.count(F.lit(1)).alias("n")).scalar()
    fine = (count >= (low or 0)) & (count <= (high if high is not None else 2**62))
    message = F.concat(F.lit(f"removal of '{word}' outside its expected range: "), count.cast("string"))
    return kept.filter(F.when(fine, F.lit(True)).otherwise(F.raise_error(message).cast("boolean")))


def missed_synonyms(df: DataFrame, text: str, word: str, synonyms: Sequence[str]) -> DataFrame:
    """Rows that match a synonym but that the main word does not catch."""
    hit = F.coalesce(F.upper(F.col(text)).contains(word.upper()), F.lit(False))
    return df.filter(any_keyword(text, synonyms) & ~hit)


def class_variants(df: DataFrame, cls: str, move: Column, variants: dict[str, str | None], *,
                   out: str = "variant") -> DataFrame:
    """One copy per variant; rows with ``move`` take the variant's class, or stay when it is NULL."""
    spec = F.array(*[F.struct(F.lit(k).alias("v"), F.lit(v).cast("string").alias("c")) for k, v in variants.items()])
    rows = df.withColumn("_v", F.explode(spec))
    new = F.when(move & F.col("_v.c").isNotNull(), F.col("_v.c")).otherwise(F.col(cls))
    return rows.withColumn(cls, new).withColumn(out, F.col("_v.v")).drop("_v")


def ordinal(cls: str, order: Sequence[str]) -> Column:
    """Class name to 0, 1, 2, ... in the stated order, else NULL."""
    return F.coalesce(*[F.when(F.col(cls) == c, F.lit(i)) for i, c in enumerate(order)])
