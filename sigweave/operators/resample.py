"""Bootstrap and permutation as replicate tables.

A bootstrap replicate is a set of integer weights, not a copied table: every row is
also a slot that draws a row position per replicate, and the counts of the drawn
positions are the weights. All metrics of a replicate use the same weights, which is
what makes differences paired.

Tables within the bounds of ``replicates`` take its kernels: replicates are spread over the
tasks and each works on whole vectors of weights over value orders that are fixed once. Larger
tables take relational plans with the same draws: slots are repartitioned once on the
drawn position and stay there for the count and for the join to the rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import vectors as V
from ..functions.draws import hash_number, position, slot_draw
from . import replicates as K
from .classify import macro_auroc, roc_and_pr
from .common import attach, join_groups, reuse, unpivot
from .groups import effect_size
from .ladder import row_index
from .rankstats import spearman

LO, HI = 0.025, 0.975


#: How far past the requested replicates a search for valid ones may go.
OVERDRAW = 3


def _number(seed: int, by: Sequence[str]) -> Column:
    return hash_number(seed, *[F.col(b) for b in by], F.col("rep"))


def draw_weights(df: DataFrame, key: str, reps: int | range, seed: int, by: Sequence[str] = (), *,
                 bounded: bool = False) -> DataFrame:
    """Rows of ``df`` per replicate with their draw count ``w``; undrawn rows are absent.

    With ``by``, each group (NULL is one) is resampled on its own to its own size.
    """
    by = list(by)
    reps = range(1, reps + 1) if isinstance(reps, int) else reps
    indexed = reuse(row_index(df, by, [key], "_i", bounded=bounded))
    drawn = indexed.select(
        *by, F.col("_i").alias("_slot"), F.col("n").alias("_n"),
        F.explode(F.sequence(F.lit(reps.start), F.lit(reps.stop - 1))).alias("rep"))
    drawn = drawn.select(*by, "rep", position(F.col("_n"), _number(seed, by), F.col("_slot")).alias("_i"))
    counts = drawn.repartition(*by, "_i").groupBy(*by, "_i", "rep").agg(F.count(F.lit(1)).alias("w"))
    return join_groups(indexed.drop("n"), counts, [*by, "_i"]).drop("_i")


def interval(reps: DataFrame, by: Sequence[str], stat: str, *, min_valid: int = 1) -> DataFrame:
    """Percentile interval and SE over valid replicates (as many values as replicates)."""
    g = reps.filter(F.col(stat).isNotNull()).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_boot"),
        F.percentile(stat, F.lit(LO)).alias("ci_lo"), F.percentile(stat, F.lit(HI)).alias("ci_hi"),
        F.stddev_pop(stat).alias("se"))
    if min_valid > 1:
        enough = F.col("n_boot") >= min_valid
        for c in ("ci_lo", "ci_hi", "se"):
            g = g.withColumn(c, F.when(enough, F.col(c)))
    return g


def one_sided_p(point: str, stat: str) -> Column:
    """Share of replicates on the other side of zero from the point estimate."""
    beyond = F.when(F.col(point) > 0, (F.col(stat) <= 0).cast("double")).otherwise(
        (F.col(stat) >= 0).cast("double"))
    return F.avg(beyond)


def _classifier_range(df: DataFrame, index: K.Index | None, key: str, scores: Sequence[str], label: str, reps: range,
                      seed: int, by: list[str]) -> DataFrame:
    if index is not None:
        return K.run(df, index, reps, K.roc_and_pr(seed, scores, label), "metric string, auroc double, auprc double")
    drawn = reuse(draw_weights(df.select(*by, key, label, *scores), key, reps, seed, by))
    long = unpivot(drawn, [*by, "rep", "w", label], scores, "metric", "score")
    return roc_and_pr(long, [*by, "rep", "metric"], "score", label, weight="w").drop("n_pos", "n_neg")


def classifier_replicates(df: DataFrame, key: str, scores: Sequence[str], label: str, reps: int,
                          seed: int, by: Sequence[str] = ()) -> DataFrame:
    """(by, rep, metric, auroc, auprc): the first ``reps`` replicates that hold both classes.

    Where a group and metric has fewer of them, numbers up to OVERDRAW times the request are
    drawn as well.
    """
    by = list(by)
    index = K.build(df, key, [label, *scores], by)
    found = reuse(_classifier_range(df, index, key, scores, label, range(1, reps + 1), seed, by))
    valid = found.filter(F.col("auroc").isNotNull())
    short = found.groupBy(*by, "metric").agg(F.count("auroc").alias("n")).filter(F.col("n") < reps)
    if short.isEmpty():
        return valid
    more = _classifier_range(df, index, key, scores, label, range(reps + 1, OVERDRAW * reps + 1), seed, by)
    each = Window.partitionBy(*by, "metric").orderBy("rep")
    kept = valid.unionByName(more.filter(F.col("auroc").isNotNull())).withColumn("_r", F.row_number().over(each))
    return reuse(kept.filter(F.col("_r") <= reps).drop("_r"))


def bootstrap_classifier(df: DataFrame, key: str, scores: Sequence[str], label: str, *,
                         reps: int = 10_000, seed: int = 42, by: Sequence[str] = ()) -> DataFrame:
    """AUROC and AUPRC of each score with percentile intervals and SE, per group of ``by``."""
    keys = [*by, "metric"]
    point = roc_and_pr(unpivot(df, [*by, label], scores, "metric", "score"), keys, "score", label)
    boot = classifier_replicates(df, key, scores, label, reps, seed, by)
    out = point
    for stat in ("auroc", "auprc"):
        ci = interval(boot, keys, stat)
        ci = ci.select(*keys, *(["n_boot"] if stat == "auroc" else []),
                       *[F.col(c).alias(f"{stat}_{c}") for c in ("ci_lo", "ci_hi", "se")])
        out = join_groups(out, ci, keys)
    return out


def bootstrap_classifier_difference(df: DataFrame, key: str, base: str, others: Sequence[str], label: str,
                                    *, stat: str = "auroc", reps: int = 10_000, seed: int = 42,
                                    min_valid: int = 1) -> DataFrame:
    """Paired difference base - other of AUROC or AUPRC, interval and one-sided p."""
    scores = [base, *others]
    point = roc_and_pr(unpivot(df, [label], scores, "metric", "score"), ["metric"], "score", label)
    boot = classifier_replicates(df, key, scores, label, reps, seed)
    p_base = point.filter(F.col("metric") == base).select(F.col(stat).alias("_pb"))
    points = attach(point.filter(F.col("metric") != base), p_base, []).select(
        "metric", (F.col("_pb") - F.col(stat)).alias("point_diff"))
    b = boot.filter(F.col("metric") == base).select("rep", F.col(stat).alias("_b"))
    diffs = boot.filter((F.col("metric") != base)).join(b, "rep").select(
        "rep", "metric", (F.col("_b") - F.col(stat)).alias("diff"))
    p = diffs.filter(F.col("diff").isNotNull()).join(points, "metric").groupBy("metric").agg(
        F.max("point_diff").alias("point_diff"), one_sided_p("point_diff", "diff").alias("p_value"))
    return p.join(interval(diffs, ["metric"], "diff", min_valid=min_valid), "metric")


def bootstrap_macro_gap(df: DataFrame, key: str, base: str, other: str, cls: str, *, min_class: int = 10,
                        reps: int = 2_000, seed: int = 42) -> DataFrame:
    """Interval of macro-AUROC(other) - macro-AUROC(base) over the classes eligible in the data."""
    eligible = reuse(df.groupBy(cls).count().filter((F.col("count") >= min_class) & F.col(cls).isNotNull()).select(cls))
    pick = lambda s: F.max(F.when(F.col("metric") == s, F.col("macro_auroc")))
    both = [pick(base).alias("macro_base"), pick(other).alias("macro_other")]

    def macro(rows, by, w=None):
        long = unpivot(rows, [*by, cls, *([w] if w else [])], [base, other], "metric", "score")
        return macro_auroc(long, [*by, "metric"], "score", cls, classes=eligible, weight=w).groupBy(*by).agg(*both)

    point = macro(df, [])
    numbered = row_index(eligible, [], [cls], "_class").drop("n")
    index = K.build(df.select(key, cls, base, other).join(numbered, cls, "left"), key, ["_class", base, other])
    if index is not None:
        found = K.run(df, index, range(1, reps + 1), K.one_vs_rest(seed, [base, other], "_class"), "metric string, macro_auroc double")
        boot = found.groupBy("rep").agg(*both)
    else:
        boot = macro(reuse(draw_weights(df.select(key, cls, base, other), key, reps, seed)), ["rep"], "w")
    gaps = boot.withColumn("gap", F.col("macro_other") - F.col("macro_base"))
    ci = interval(gaps, [], "gap")
    return attach(point.withColumn("gap", F.col("macro_other") - F.col("macro_base")), ci, [])


def bootstrap_spearman(df: DataFrame, key: str, xs: Sequence[str], y: str, *, reps: int = 10_000,
                       seed: int = 42) -> DataFrame:
    """Spearman of each x with y, percentile interval and SE."""
    point = spearman(unpivot(df, [y], xs, "metric", "x"), ["metric"], "x", y)
    boot = spearman_replicates(df, key, xs, y, reps, seed)
    return point.join(interval(boot, ["metric"], "rho"), "metric")


def spearman_replicates(df: DataFrame, key: str, xs: Sequence[str], y: str, reps: int, seed: int) -> DataFrame:
    """(rep, metric, rho)."""
    index = K.build(df, key, list(dict.fromkeys([*xs, y])))
    if index is not None:
        return K.run(df, index, range(1, reps + 1), K.spearman(seed, xs, y), "metric string, rho double")
    drawn = reuse(draw_weights(df.select(key, y, *xs), key, reps, seed))
    long = unpivot(drawn, ["rep", "w", y], xs, "metric", "x")
    return spearman(long, ["rep", "metric"], "x", y, weight="w").drop("n")


def bootstrap_spearman_difference(df: DataFrame, key: str, a: str, b: str, y: str, *, reps: int = 5_000,
                                  seed: int = 42) -> DataFrame:
    """Interval of rho(b, y) - rho(a, y) on common draws."""
    pick = lambda s: F.max(F.when(F.col("metric") == s, F.col("rho")))
    diff = (pick(b) - pick(a)).alias("diff")
    point = spearman(unpivot(df, [y], [a, b], "metric", "x"), ["metric"], "x", y).groupBy().agg(diff)
    boot = spearman_replicates(df, key, [a, b], y, reps, seed).groupBy("rep").agg(diff)
    return attach(point, interval(boot, [], "diff"), [])


def drawn_moments(df: DataFrame, key: str, value: str, reps: int, seed: int, by: Sequence[str] = (), *,
                  bounded: bool = False) -> DataFrame:
    """(by, rep, n, mean, var): moments of each group's drawn values, around the group's own mean."""
    by = list(by)
    rows = df.filter(F.col(value).isNotNull()).select(*by, key, F.col(value).cast("double").alias(value))
    index = K.build(rows, key, [value], by)
    if index is not None:
        return K.run(rows, index, range(1, reps + 1), K.moments(seed, value), "n long, mean double, var double")
    means = rows.groupBy(*by).agg(F.avg(value).alias("_mu"))
    drawn = attach(draw_weights(rows, key, reps, seed, by, bounded=bounded), means, by)
    c = F.col(value) - F.col("_mu")
    m = drawn.groupBy(*by, "rep").agg(
        F.sum("w").alias("n"), F.max("_mu").alias("_mu"), F.sum(F.col("w") * c).alias("s"),
        F.sum(F.col("w") * c * c).alias("q"))
    return m.select(*by, "rep", "n", (F.col("_mu") + F.col("s") / F.col("n")).alias("mean"),
                    F.when(F.col("n") > 1, F.try_divide(
                        F.col("q") - F.col("s") ** 2 / F.col("n"), (F.col("n") - 1).cast("double"))).alias("var"))


def group_replicates(df: DataFrame, key: str, value: str, group: str, reps: int, seed: int) -> DataFrame:
    """(rep, mean_diff, cohens_d): both groups drawn independently, weighted moments.

    Moments are taken around the group mean of the data, so squares do not cancel.
    """
    rows = df.filter(F.col(group).isin(0, 1) & F.col(value).isNotNull()).select(
        key, F.col(group).cast("int").alias(group), F.col(value).cast("double").alias(value))
    m = drawn_moments(rows, key, value, reps, seed, [group])
    side = lambda g, c: F.max(F.when(F.col(group) == g, F.col(c)))
    wide = m.groupBy("rep").agg(*[side(g, c).alias(f"{c}{g}") for g in (0, 1) for c in ("n", "mean", "var")])
    return wide.select(
        "rep", (F.col("mean1") - F.col("mean0")).alias("mean_diff"),
        effect_size("n1", "n0", "mean1", "mean0", "var1", "var0").alias("cohens_d"))


def bootstrap_cohens_d(df: DataFrame, key: str, value: str, group: str, *, reps: int = 10_000,
                       seed: int = 42) -> DataFrame:
    """Interval of the effect size. Group 0 may be a supplied null table unioned in."""
    from .groups import cohens_d
    point = cohens_d(df, [], value, group).select("n1", "n2", "cohens_d")
    return attach(point, interval(group_replicates(df, key, value, group, reps, seed), [], "cohens_d"), [])


def bootstrap_mean_diff(df: DataFrame, key: str, value: str, group: str, *, reps: int = 10_000,
                        seed: int = 42) -> DataFrame:
    """Interval and one-sided p of the difference of group means."""
    from .groups import cohens_d
    point = cohens_d(df, [], value, group).select(
        "n1", "n2", (F.col("mean1") - F.col("mean2")).alias("point_diff"))
    boot = reuse(group_replicates(df, key, value, group, reps, seed))
    p = attach(boot, point.select("point_diff"), []).agg(one_sided_p("point_diff", "mean_diff").alias("p_value"))
    return attach(attach(point, interval(boot, [], "mean_diff"), []), p, [])


def bootstrap_mean(df: DataFrame, key: str, value: str, *, reps: int = 10_000, seed: int = 42,
                   bounded: bool = False) -> DataFrame:
    """Interval of a mean, for instance of the per-fold gains (``bounded``)."""
    df = reuse(df.select(key, value))
    boot = drawn_moments(df, key, value, reps, seed, bounded=bounded)
    return attach(df.agg(F.avg(value).alias("point")), interval(boot, [], "mean"), [])


def label_permutations(df: DataFrame, key: str, value: str, label: str, *, reps: int = 10_000,
                       seed: int = 42) -> DataFrame:
    """(rep, stat): difference of group means under permuted labels, group sizes kept.

    A permutation is the order of (draw, position of the key); its first n1 rows become group 1.
    Rows without value or label take no part; with one class only there is no statistic.
    """
    rows = df.select(key, F.col(value).cast("double").alias("_v"), F.col(label).alias("_l")).dropna(subset=["_v", "_l"])
    index = K.build(rows, key, ["_v", "_l"])
    if index is not None:
        return K.run(rows, index, range(1, reps + 1), K.label_shuffle(seed, "_v", "_l"), "stat double").filter(F.col("stat").isNotNull())
    sizes = rows.agg(F.sum((F.col("_l") == 1).cast("long")).alias("_n1"), F.count(F.lit(1)).alias("_n"), F.sum("_v").alias("_all"))
    placed = row_index(rows, [], [key], "_i").drop("n").select("_i", "_v", F.explode(F.sequence(F.lit(1), F.lit(reps))).alias("rep"))
    shuffled = placed.withColumn("_h", slot_draw(_number(seed, []), F.col("_i")))
    placed = attach(row_index(shuffled, ["rep"], ["_h", "_i"], "_pos").drop("n"), sizes, [])
    g = placed.filter(F.col("_pos") < F.col("_n1")).groupBy("rep").agg(
        F.sum("_v").alias("_s1"), F.max("_n1").alias("_n1"), F.max("_n").alias("_n"), F.max("_all").alias("_all"))
    diff = F.col("_s1") / F.col("_n1") - F.try_divide(F.col("_all") - F.col("_s1"), (F.col("_n") - F.col("_n1")).cast("double"))
    return g.select("rep", diff.alias("stat")).filter(F.col("stat").isNotNull())


def null_summary(null: DataFrame, observed: DataFrame, stat: str, *, alternative: str = "two-sided") -> DataFrame:
    """Observed value (one row, column ``observed``) against the replicate distribution.

    ``p_value`` is b/n, ``p_plus_one`` is (b+1)/(n+1).
    """
    j = attach(null, observed.select("observed"), [])
    hit = {"two-sided": F.abs(stat) >= F.abs("observed"), "greater": F.col(stat) >= F.col("observed")}[alternative]
    b = F.sum(hit.cast("long"))
    n = F.count(F.lit(1))
    return j.agg(
        F.max("observed").alias("observed"), n.alias("n_reps"), F.avg(stat).alias("null_mean"),
        F.stddev_pop(stat).alias("null_std"), F.percentile(stat, F.lit(LO)).alias("q025"),
        F.percentile(stat, F.lit(HI)).alias("q975"), (b / n).alias("p_value"),
        ((b + 1) / (n + 1)).alias("p_plus_one"))


#: Numbers of a group's vectors up to which one task holds them, and replicates that share a copy of them: of groups of up to
#: COPY_CELLS numbers, and of larger ones, whose replicates then spread over more tasks.
VECTOR_CELLS, COPY_CELLS, REPS_PER_TASK, REPS_PER_LARGE = 4_000_000, 100_000, 500, 50


def _dealt(rows: DataFrame, group: Sequence[str], key: str, reps: int, seed: int, own: str, other: str) -> tuple[DataFrame, DataFrame]:
    """Rows of groups small enough for a kernel, once for each ``_per`` replicates, and the rows of larger groups."""
    group = list(group)
    sized = attach(rows, rows.groupBy(*group).agg((F.count(F.lit(1)) * F.max(F.size(own))).alias("_cells")), group)
    small = sized.filter(F.col("_cells") <= VECTOR_CELLS).withColumn("_per", F.when(F.col("_cells") <= COPY_CELLS, REPS_PER_TASK).otherwise(REPS_PER_LARGE)).drop("_cells")
    small = small.select("*", K.group_tag(group).alias("_tag"), F.struct(*[o.alias(f"o{i}") for i, o in enumerate(K.key_order(rows, key))]).alias("_order"),
                         F.explode(F.sequence(F.lit(0), F.ceil(F.lit(reps) / F.col("_per")).cast("int") - 1)).alias("_chunk"))
    return small, sized.filter(F.col("_cells") > VECTOR_CELLS).drop("_cells")


def _chunk(batches: Iterator[pa.RecordBatch], reps: int, seed: int) -> tuple[pa.Table, np.ndarray, np.ndarray]:
    """Rows in key order, replicate ids of the rows' chunk and their numbers."""
    rows = pa.Table.from_batches(batches)
    order = rows.column("_order").combine_chunks().flatten()
    place = pa.table(order, names=[str(i) for i in range(len(order))])
    rows = rows.take(pc.sort_indices(place, sort_keys=[(c, "ascending") for c in place.column_names]))
    chunk, per = rows.column("_chunk")[0].as_py(), rows.column("_per")[0].as_py()
    ids = np.arange(chunk * per + 1, min(reps, (chunk + 1) * per) + 1)
    return rows, ids, K.tagged_numbers(seed, rows.column("_tag")[0].as_py(), ids)


def _matrix(rows: pa.Table, column: str) -> np.ndarray:
    """Vectors as rows; vectors of different lengths are an error."""
    vectors = rows.column(column).combine_chunks()
    if len(np.unique(vectors.value_lengths().to_numpy(zero_copy_only=False))) > 1:
        raise ValueError(f"vectors of different lengths in {column}")
    return vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), -1)


def signature_permutations(loo: DataFrame, consensus: DataFrame, entity: str, context: str, *, reps: int = 1000,
                           seed: int, min_n: int = 20) -> DataFrame:
    """Per replicate and fold: hold-out vectors shuffled across entities, train side fixed.

    ``loo``: entity, context, train_di, train_ts; ``consensus``: entity, context,
    ``vec`` (held-out vector) and ``train_mean``. A fold whose vectors fit a task is shipped
    once for each REPS_PER_TASK (or REPS_PER_LARGE) replicates, and they gather from its cosines; in larger folds
    positions are permuted by a relational plan and each vector is shipped once per replicate.
    Both make the same draws. Returns rep, context, raw_spearman, ts_spearman.
    """
    scores = loo.select(entity, context, "train_di", "train_ts")
    rows = join_groups(scores, consensus.select(entity, context, "vec", "train_mean"), [entity, context])
    sizes = rows.groupBy(context).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= min_n)
    rows = reuse(join_groups(rows, sizes.select(context), [context]))
    small, large = _dealt(rows, [context], entity, reps, seed, "vec", "train_mean")
    out = T.StructType([T.StructField("rep", T.LongType()), loo.schema[context], T.StructField("raw_spearman", T.DoubleType()),
                        T.StructField("ts_spearman", T.DoubleType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, ids, numbers = _chunk(batches, reps, seed)
        scores = [group.column(c).to_numpy().astype(np.float64).round(12) for c in ("train_di", "train_ts")]
        for part, cos in K.shuffled_blocks(_matrix(group, "train_mean"), _matrix(group, "vec"), numbers, zero=0.0, eps=0.0):
            cos = cos.round(12)
            same = group.column(context).combine_chunks().take(pa.array(np.zeros(len(cos), np.int64)))
            rho = [K.row_correlations(K.midranks(s[None, ~np.isnan(s)]), K.midranks(cos[:, ~np.isnan(s)])) for s in scores]
            yield pa.RecordBatch.from_arrays([pa.array(ids[part]), same, *[pa.array(r, from_pandas=True) for r in rho]], names=out.fieldNames())

    done = small.groupBy(context, "_chunk").applyInArrow(work, out)
    if large.isEmpty():
        return done
    return done.unionByName(_permuted_by_joins(large, entity, context, reps, seed))


def _permuted_by_joins(rows: DataFrame, entity: str, context: str, reps: int, seed: int) -> DataFrame:
    """The same for folds of any size: only positions are exploded per replicate."""
    scores = reuse(row_index(rows.select(entity, context, "train_di", "train_ts"), [context], [entity], "_pos").drop("n"))
    ids = scores.select(entity, context, F.col("_pos").alias("_slot"), F.explode(F.sequence(F.lit(1), F.lit(reps))).alias("rep"))
    ids = ids.withColumn("_h", slot_draw(_number(seed, [context]), F.col("_slot")))
    perm = row_index(ids, [context, "rep"], ["_h", "_slot"], "_pos").drop("n", "_h", "_slot")
    vectors = rows.select(entity, context, "vec", "train_mean")
    donor = join_groups(scores.select(entity, context, "_pos"), vectors, [entity, context]).select(
        context, "_pos", F.col("vec").alias("_s"), V.norm("vec").alias("_sn"))
    own = join_groups(scores.drop("_pos"), vectors, [entity, context]).select(
        entity, context, "train_di", "train_ts", F.col("train_mean").alias("_m"), V.norm("train_mean").alias("_mn"))
    j = join_groups(join_groups(perm, donor, [context, "_pos"]), own, [entity, context])
    cos = V.cosine(V.dot("_s", "_m"), F.col("_sn"), F.col("_mn"))
    scored = reuse(j.select("rep", context, F.round("train_di", 12).alias("raw"),
                            F.round("train_ts", 12).alias("ts"), F.round(cos, 12).alias("cos")))
    rho = spearman(unpivot(scored, ["rep", context, "cos"], ["raw", "ts"], "score", "value"),
                   ["rep", context, "score"], "value", "cos")
    pick = lambda s: F.max(F.when(F.col("score") == s, F.col("rho")))
    return rho.groupBy("rep", context).agg(pick("raw").alias("raw_spearman"), pick("ts").alias("ts_spearman"))


def permutation_wins(folds: DataFrame) -> DataFrame:
    """Per replicate: number of folds won by TS and the mean gain."""
    gain = F.round(F.col("ts_spearman") - F.col("raw_spearman"), 12)
    return folds.groupBy("rep").agg(F.sum((gain > 0).cast("long")).alias("wins"), F.avg(gain).alias("mean_delta"))


def random_pair_null(df: DataFrame, key: str, a: str, b: str, *, reps: int = 1000, seed: int) -> DataFrame:
    """1 - |cos| between vector ``a`` of a row and vector ``b`` of a randomly matched row.

    (rep, key, instability); NULL where a vector is zero. As above, tables that fit a task are
    shipped once for some replicates, whose rows leave the task a block at a time; larger ones once per replicate.
    """
    whole = df.select(key, a, b).dropna(subset=[a, b])
    small, large = _dealt(whole, [], key, reps, seed, a, b)
    out = T.StructType([T.StructField("rep", T.LongType()), df.schema[key], T.StructField("instability", T.DoubleType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, ids, numbers = _chunk(batches, reps, seed)
        keys = group.column(key).combine_chunks()
        for part, cos in K.shuffled_blocks(_matrix(group, a), _matrix(group, b), numbers, zero=np.nan, eps=1e-12):
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids[part], len(keys))), pa.concat_arrays([keys] * len(cos)),
                                              pa.array((1.0 - np.abs(cos)).ravel(), from_pandas=True)], names=out.fieldNames())

    done = small.groupBy("_chunk").applyInArrow(work, out)
    if large.isEmpty():
        return done
    rows = reuse(row_index(large, [], [key], "_pos").drop("n"))
    ids = rows.select(key, F.col("_pos").alias("_slot"), F.explode(F.sequence(F.lit(1), F.lit(reps))).alias("rep"))
    ids = ids.withColumn("_h", slot_draw(_number(seed, []), F.col("_slot")))
    perm = row_index(ids, ["rep"], ["_h", "_slot"], "_pos").drop("n", "_h", "_slot")
    j = perm.join(rows.select("_pos", F.col(b).alias("_b")), "_pos").join(
        rows.select(key, F.col(a).alias("_a")), key)
    cos = V.cosine(V.dot("_a", "_b"), V.norm("_a"), V.norm("_b"), zero_vector="null", eps=1e-12)
    return done.unionByName(j.select("rep", key, (1.0 - F.abs(cos)).alias("instability")))
