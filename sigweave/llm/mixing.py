"""Mixing sources to target weights: repetition rates per source, whole copies per document.

DataFrame functions only. One pass sizes the documents; everything after it works on the
narrow table (keys, source, size). Sources are far fewer than documents; their table decides
the rates and is broadcast only when counted to be small.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, broadcast_if_small, free_name, settle, whole_text

#: Draws are 31-bit numbers; draw k of a document is (first * MULTIPLIERS[k] + k) mod 2**31.
#: Fixed odd multipliers: 2 * k-th multiple of the golden ratio's 31 bits, plus 1.
DRAW_SPACE = 2**31
MULTIPLIERS = [(2 * (k + 1) * 663_608_941 + 1) % DRAW_SPACE for k in range(16)]


def n_words(text: Column | str = "text") -> Column:
    """Words of the whole text, null as empty."""
    return F.regexp_count(whole_text(text), F.lit(WORD)).cast("long")


def first_draw(key: Column, seed: int) -> Column:
    """31-bit number from md5 of the seed and the key (a null key counts as empty)."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % DRAW_SPACE


def draws(first: Column) -> list[Column]:
    """Uniform numbers in [0, 1), one per multiplier."""
    return [(first * m + k) % DRAW_SPACE / float(DRAW_SPACE) for k, m in enumerate(MULTIPLIERS)]


def source_targets(sizes: DataFrame, source: str, size: str, weights: Sequence[float], share: float,
                   most: float) -> DataFrame:
    """Per source: source_size and target, the words that the mix takes of it.

    Sources in code point order, null last, weigh ``weights`` in turn and share
    ``share`` times all words. A target stops at ``most`` times its source's size, and the
    excess goes to the others by weight until none is above. That ends where each target is
    the smaller of its stop and its weight times one level, so sources are taken in order of
    stop / weight: those before the level keep their stop, the rest share what is left.
    """
    per = sizes.groupBy(source).agg(F.sum(size).alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col(source).asc_nulls_last())) - 1
    given = F.get(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights)).cast("int"))
    every = Window.partitionBy()
    ordered = Window.orderBy("_ratio", F.col(source).asc_nulls_last())
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    weighed = per.withColumn("_w", given).withColumn("_stop", F.col("source_size") * float(most))
    weighed = weighed.withColumn("_ratio", F.col("_stop") / F.col("_w")).withColumns({
        "_left": F.sum("source_size").over(every) * float(share) - F.coalesce(F.sum("_stop").over(before), F.lit(0.0)),
        "_weights": F.sum("_w").over(every) - F.coalesce(F.sum("_w").over(before), F.lit(0.0))})
    # The level if all sources before this one are at their stops and this one is not.
    # Later sources would give lower levels, as they take sources for full that are not: the first counts.
    level = F.max(F.when(F.col("_left") / F.col("_weights") <= F.col("_ratio"), F.col("_left") / F.col("_weights")))
    target = F.when(level.over(every).isNull(), F.col("_stop")).otherwise(
        F.least(F.col("_stop"), F.col("_w") * level.over(every)))
    return weighed.select(source, "source_size", target.alias("target"))


def rates(docs: DataFrame, *, key: str = "doc_id", source: str = "source", text: str = "text",
          weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = 7,
          ) -> tuple[DataFrame, DataFrame]:
    """(sized documents, rates): key, source and size of every document; one row per source.

    A source's rate is target / size (0 if it has no words). Every document of it gets
    floor(rate) copies and one more with probability equal to the fraction, drawn from its
    key's hash. Of the fixed draw functions a source uses the one whose words come nearest
    to its target, so small sources come near too; the choice is part of the rates row.
    """
    sized = settle(docs.select(F.col(key).alias("_key"), F.col(source).alias("_source"), n_words(text).alias("_size")))
    targets = source_targets(sized, "_source", "_size", weights, share, most).withColumn(
        "rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
    targets = broadcast_if_small(settle(targets))
    fraction = F.col("rate") - F.floor("rate")
    extra = [F.sum(F.when(d < fraction, F.col("_size")).otherwise(0)).alias(f"_e{k}")
             for k, d in enumerate(draws(F.col("_d")))]
    own = targets.withColumnRenamed("_source", "_s")
    taken = sized.withColumn("_d", first_draw(F.col("_key"), seed)).join(own, F.col("_source").eqNullSafe(F.col("_s")))
    tried = taken.groupBy("_s", "source_size", "target", "rate").agg(*extra)
    off = [F.abs(F.floor("rate") * F.col("source_size") + F.col(f"_e{k}") - F.col("target")) for k in range(len(MULTIPLIERS))]
    best = F.array_position(F.array(*off), F.array_min(F.array(*off))).cast("int") - 1
    chosen = tried.select("_s", "source_size", "target", "rate", best.alias("draw"))
    return sized, settle(chosen)


def copies(rate: Column, draw: Column, key: Column, seed: int) -> Column:
    """Whole copies of a document under its source's rate."""
    one = F.get(F.array(*draws(first_draw(key, seed))), draw)
    return (F.floor(rate) + F.when(one < rate - F.floor(rate), 1).otherwise(0)).cast("long")


def mix_counts(docs: DataFrame, *, key: str = "doc_id", source: str = "source", text: str = "text",
               weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = 7) -> DataFrame:
    """Per document: key, size, source_size, target of its source, n_copies and taken words.

    Null text counts as empty (size 0, nothing taken), null sources form one source, repeated
    rows are documents of their own that share a draw, an empty table gives an empty result.
    """
    sized, chosen = rates(docs, key=key, source=source, text=text, weights=weights, share=share, most=most, seed=seed)
    joined = sized.join(broadcast_if_small(chosen), F.col("_source").eqNullSafe(F.col("_s")))
    out = joined.withColumn("n_copies", copies(F.col("rate"), F.col("draw"), F.col("_key"), seed))
    return out.select(F.col("_key").alias(key), F.col("_size").alias("size"), "source_size", "target", "n_copies",
                      (F.col("n_copies") * F.col("_size")).alias("taken"))


def mix(docs: DataFrame, *, key: str = "doc_id", source: str = "source", text: str = "text",
        weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = 7) -> DataFrame:
    """The mix itself: every row of ``docs`` as many times as it is taken, all columns kept.

    Null text counts as empty: such rows are drawn by their source's rate and add no words;
    sources without words are left out. Null sources form one source, repeated rows share a
    draw, an empty table gives an empty result.
    """
    _, chosen = rates(docs, key=key, source=source, text=text, weights=weights, share=share, most=most, seed=seed)
    rate, copy = free_name(docs, "_mix_rate"), free_name(docs, "_mix_copy")
    own = broadcast_if_small(chosen.select(F.struct("_s", "rate", "draw").alias(rate)))
    joined = docs.join(own, docs[source].eqNullSafe(F.col(f"{rate}._s")))
    n = copies(F.col(f"{rate}.rate"), F.col(f"{rate}.draw"), docs[key], seed).cast("int")
    again = joined.withColumn(copy, F.explode(F.array_repeat(F.lit(1), n)))
    return again.select(*[F.col(f"`{c}`") for c in docs.columns])
