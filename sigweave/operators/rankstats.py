"""Rank correlation and rank tests, grouped or global."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import pvalues as P
from .common import attach, join_groups, reuse, unpivot, without_nan
from .ladder import average_ranks, ladder, row_ranks, running


def spearman(df: DataFrame, by: Sequence[str], x: str, y: str, *, weight: str | None = None,
             rho: str = "rho", bounded: bool = False) -> DataFrame:
    """Spearman correlation per group: Pearson on mid-ranks, weights as repeat counts.

    Ranks come from the ladders of x and y and join back on the value. NULL when
    either side is constant. ``bounded`` groups (contexts of an entity, folds) take
    a single shuffle and plain windows.
    """
    by = list(by)
    rows = df.select(
        *by, without_nan(F.col(x).cast("double"), "double").alias("_x"), without_nan(F.col(y).cast("double"), "double").alias("_y"),
        (F.col(weight) if weight else F.lit(1).cast("long")).alias("_w")).filter("_x IS NOT NULL AND _y IS NOT NULL")
    if bounded:
        joined = rows
        for v, c in (("_x", "_cx"), ("_y", "_cy")):
            joined = joined.withColumn(c, _window_rank(by, v))
    else:
        joined = rows
        for v, c in (("_x", "_cx"), ("_y", "_cy")):
            ranks = average_ranks(rows, by, v, "_w", "_r")
            centred = F.col("_r") - (F.col("w_total") + 1) / 2.0
            joined = join_groups(joined, ranks.select(*by, v, centred.alias(c)), [v, *by])
    a, b, k = F.col("_cx"), F.col("_cy"), F.col("_w")
    g = joined.groupBy(*by).agg(
        F.sum("_w").alias("n"), F.sum(k * a * b).alias("_xy"),
        F.sum(k * a * a).alias("_xx"), F.sum(k * b * b).alias("_yy"))
    value = F.when((F.col("_xx") > 0) & (F.col("_yy") > 0),
                   F.try_divide(F.col("_xy"), F.sqrt(F.col("_xx") * F.col("_yy"))))
    return g.select(*by, "n", value.alias(rho))


def spearman_columns(df: DataFrame, by: Sequence[str], xs: Sequence[str], y: str) -> DataFrame:
    """(by, n, one column per x): Spearman of each x with y in groups of any size.

    Where no value is missing, every column is ranked once, and ranks meet by row. Else each
    x is ranked with y on the rows that have both; ``n`` then is the largest of these counts.
    """
    by, columns = list(by), [*xs, y]
    rows = reuse(df.select(*by, *[without_nan(F.col(c).cast("double"), "double").alias(c) for c in columns]))
    if rows.filter(" OR ".join(f"`{c}` IS NULL" for c in columns)).isEmpty():
        long = unpivot(rows.withColumn("_id", F.monotonically_increasing_id()), [*by, "_id"], columns, "_name", "_x")
        ranks = row_ranks(reuse(long), [*by, "_name"], "_x")
        wide = ranks.groupBy(*by, "_id").agg(*[F.max(F.when(F.col("_name") == c, F.col("rank"))).alias(f"_r{i}") for i, c in enumerate(columns)])
        r = [F.col(f"_r{i}") for i in range(len(columns))]
        g = wide.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *[F.sum(a * a).alias(f"_s{i}") for i, a in enumerate(r)],
                                  *[F.sum(a * r[-1]).alias(f"_p{i}") for i, a in enumerate(r[:-1])])
        rho = lambda i: F.when((F.col(f"_s{i}") > 0) & (F.col(f"_s{len(xs)}") > 0),
                               F.try_divide(F.col(f"_p{i}"), F.sqrt(F.col(f"_s{i}") * F.col(f"_s{len(xs)}"))))
        return g.select(*by, "n", *[rho(i).alias(x) for i, x in enumerate(xs)])
    each = spearman(unpivot(rows, [*by, y], xs, "_name", "_x"), [*by, "_name"], "_x", y)
    return each.groupBy(*by).agg(F.max("n").alias("n"), *[F.max(F.when(F.col("_name") == x, F.col("rho"))).alias(x) for x in xs])


def rank_matrix(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """``key`` and the mid-ranks of the columns, all from one ladder; NULL where a value is missing. Keys must be unique."""
    long = reuse(unpivot(df, [key], columns, "_name", "_x"))
    ranks = average_ranks(long, ["_name"], "_x").select("_name", "_x", "rank")
    placed = join_groups(long, ranks, ["_name", "_x"], "left")
    return placed.groupBy(key).agg(*[F.max(F.when(F.col("_name") == c, F.col("rank"))).alias(c) for c in columns])


def rank_correlations(df: DataFrame, key: str, metrics: Sequence[str], outcomes: Sequence[str]) -> DataFrame:
    """(metric, outcome, n, rho): Spearman of every metric with every outcome, over the rows that have both.

    Columns without gaps are ranked once, and all their correlations are cross moments of one
    pass over the rank matrix. Pairs with a gap are ranked on the rows they share.
    """
    columns = list(dict.fromkeys([*metrics, *outcomes]))
    rows = reuse(df.select(key, *[without_nan(F.col(c).cast("double"), "double").alias(c) for c in columns]))
    filled = rows.agg(F.count(F.lit(1)).alias("_n"), *[F.count(c).alias(c) for c in columns]).first()
    whole = {c for c in columns if filled[c] == filled["_n"]}
    pairs = [(m, o) for m in metrics for o in outcomes]
    plain = [(m, o) for m, o in pairs if m in whole and o in whole]
    parts = []
    if plain:
        ranks = rank_matrix(rows, key, [c for c in columns if c in whole])
        one = ranks.agg(F.count(F.lit(1)).alias("n"), F.array(*[F.struct(
            F.lit(m).alias("metric"), F.lit(o).alias("outcome"), F.corr(m, o).alias("rho")) for m, o in plain]).alias("_r"))
        parts.append(one.select("n", F.inline("_r")).select("metric", "outcome", "n", "rho"))
    gaps = [(m, o) for m, o in pairs if (m, o) not in plain]
    if gaps:
        each = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.lit(o).alias("outcome"), F.col(m).alias("x"), F.col(o).alias("y")) for m, o in gaps]))
        long = rows.select(each.alias("_p")).select("_p.*")
        parts.append(spearman(long, ["metric", "outcome"], "x", "y").select("metric", "outcome", "n", "rho"))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def _window_rank(by: Sequence[str], value: str) -> Column:
    """Centred weighted mid-rank by windows inside one small group."""
    group = Window.partitionBy(*(by or [F.lit(0)]))
    upto = group.orderBy(value).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    ties = group.orderBy(value).rangeBetween(Window.currentRow, Window.currentRow)
    last, t, n = F.sum("_w").over(upto), F.sum("_w").over(ties), F.sum("_w").over(group)
    return last - (t - 1) / 2.0 - (n + 1) / 2.0


def spearman_test(df: DataFrame, by: Sequence[str], x: str, y: str) -> DataFrame:
    """Spearman rho, its t statistic on n-2 degrees of freedom, and the two-sided p."""
    s = spearman(df, by, x, y)
    dof = F.col("n") - 2
    inside = F.when((F.abs("rho") < 1) & (F.col("n") > 2), dof / (1 - F.col("rho") ** 2))
    s = s.withColumn("t_stat", F.col("rho") * F.sqrt(inside))
    p = P.student_two_sided_p(F.col("t_stat"), dof.cast("double"))
    return s.withColumn("p_value", F.when(F.abs("rho") >= 1, 0.0).otherwise(p))


def pearson_interval(df: DataFrame, by: Sequence[str], x: str, y: str, z: float = 1.959964) -> DataFrame:
    """Pearson correlation per group with its Fisher-z interval."""
    g = df.groupBy(*by).agg(F.corr(x, y).alias("r"),
                            F.count(F.when(F.col(x).isNotNull() & F.col(y).isNotNull(), 1)).alias("n"))
    return fisher_z_interval(g, "r", "n", z)


def fisher_z_interval(df: DataFrame, r: str, n: str, z: float = 1.959964) -> DataFrame:
    """Interval tanh(atanh(r) -/+ z / sqrt(n - 3))."""
    centre = F.atanh(F.when(F.abs(r) < 1, F.col(r)))
    half = z / F.sqrt(F.when(F.col(n) > 3, F.col(n) - 3.0))
    return df.withColumn("fisher_z", centre).withColumn("ci_lo", F.tanh(centre - half)).withColumn(
        "ci_hi", F.tanh(centre + half))


def compare_correlations(df: DataFrame, r1: str, n1: str, r2: str, n2: str) -> DataFrame:
    """z test between two independent correlations."""
    se = F.sqrt(1.0 / (F.col(n1) - 3.0) + 1.0 / (F.col(n2) - 3.0))
    z = (F.atanh(r1) - F.atanh(r2)) / se
    return df.withColumn("z_diff", z).withColumn("p_value", 2.0 * P.normal_upper_p(F.abs(z)))


def steiger(df: DataFrame, by: Sequence[str], common: str, a: str, b: str) -> DataFrame:
    """Do corr(common, a) and corr(common, b) differ, measured on the same rows?

    Williams-type statistic on Fisher z with the covariance of the two correlations. Only
    rows with all three values count, for the correlations and for n alike.
    """
    whole = df.select(*by, *[without_nan(F.col(c).cast("double"), "double").alias(c) for c in dict.fromkeys((common, a, b))]).na.drop(subset=[common, a, b])
    g = whole.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.corr(common, a).alias("r_a"),
        F.corr(common, b).alias("r_b"), F.corr(a, b).alias("r_ab"))
    ra, rb, rab = F.col("r_a"), F.col("r_b"), F.col("r_ab")
    mean_sq = ((ra + rb) / 2) ** 2
    cov = rab * (1 - 2 * mean_sq) - 0.5 * mean_sq * (1 - 2 * mean_sq - rab ** 2)
    c = cov / (1 - mean_sq) ** 2
    z = (F.atanh(ra) - F.atanh(rb)) * F.sqrt(F.col("n") - 3.0) / F.sqrt(2.0 - 2.0 * c)
    return g.withColumn("z_stat", z).withColumn("p_value", 2.0 * P.normal_upper_p(F.abs(z)))


def _tail(z: Column, alternative: str) -> Column:
    if alternative == "two-sided":
        return F.least(F.lit(1.0), 2.0 * P.normal_upper_p(z))
    return P.normal_upper_p(z)


def mann_whitney(df: DataFrame, by: Sequence[str], value: str, group: str, *,
                 alternative: str = "two-sided") -> DataFrame:
    """U of the rows with ``group`` = 1 against 0, tie-corrected normal p, rank-biserial r.

    The 0.5 continuity correction is applied; r = 1 - 2U/(n1 n2).
    """
    by = list(by)
    is_one = (F.col(group).cast("int") == 1).cast("long")
    rows = df.filter(F.col(group).isNotNull()).select(
        *by, value, F.lit(1).cast("long").alias("w"), is_one.alias("n1"))
    lad = ladder(rows, by, value, ["w", "n1"])
    rank = F.col("w_before") + (F.col("w") + 1) / 2.0
    ties = F.col("w").cast("double") ** 3 - F.col("w")
    g = lad.groupBy(*by).agg(
        F.sum("w").alias("n"), F.sum("n1").alias("n1"),
        F.sum(F.col("n1") * rank).alias("_r1"), F.sum(ties).alias("_ties"))
    n1 = F.col("n1").cast("double")
    n2 = (F.col("n") - F.col("n1")).cast("double")
    n = F.col("n").cast("double")
    g = g.filter((n1 > 0) & (n2 > 0)).withColumn("u", F.col("_r1") - n1 * (n1 + 1) / 2)
    sd = F.sqrt(n1 * n2 / 12.0 * ((n + 1) - F.col("_ties") / (n * (n - 1))))
    other = n1 * n2 - F.col("u")
    stat = {"two-sided": F.greatest(F.col("u"), other), "greater": F.col("u"), "less": other}[alternative]
    g = g.withColumn("z", F.when(sd > 0, F.try_divide(stat - n1 * n2 / 2.0 - 0.5, sd)))
    return g.select(
        *by, F.col("n1"), (F.col("n") - F.col("n1")).alias("n2"), "u", "z",
        _tail(F.col("z"), alternative).alias("p_value"),
        (1.0 - 2.0 * F.col("u") / (n1 * n2)).alias("rank_biserial"))


def wilcoxon_signed_rank(df: DataFrame, by: Sequence[str], delta: str, *,
                         alternative: str = "greater", bounded: bool = False) -> DataFrame:
    """Signed-rank test on differences: zeros dropped, tie-corrected, no continuity term.

    A group with only zeros has no row.
    """
    by = list(by)
    sized = df.filter(F.col(delta) != 0).select(
        *by, F.abs(delta).alias("_a"), F.lit(1).cast("long").alias("w"),
        (F.col(delta) > 0).cast("long").alias("_up"))
    lad = ladder(sized, by, "_a", ["w", "_up"], bounded=bounded)
    rank = F.col("w_before") + (F.col("w") + 1) / 2.0
    g = lad.groupBy(*by).agg(
        F.sum("w").cast("double").alias("_n"), F.sum(F.col("_up") * rank).alias("w_plus"),
        F.sum(F.col("w").cast("double") ** 3 - F.col("w")).alias("_ties"))
    n = F.col("_n")
    sd = F.sqrt((n * (n + 1) * (2 * n + 1) - F.col("_ties") / 2.0) / 24.0)
    z = F.try_divide(F.col("w_plus") - n * (n + 1) / 4.0, sd)
    z = {"greater": z, "less": -z, "two-sided": F.abs(z)}[alternative]
    g = g.withColumn("wilcoxon_z", z)
    return g.select(*by, n.cast("long").alias("n_nonzero"), "w_plus", "wilcoxon_z",
                    _tail(F.col("wilcoxon_z"), alternative).alias("wilcoxon_p"))


def rank_shift(df: DataFrame, by: Sequence[str], key: str, raw: str, corrected: str) -> DataFrame:
    """Both mid-ranks of each row and their distance (top movers = orderBy + limit)."""
    by = list(by)
    a = average_ranks(df, by, raw, rank="rank_raw").select(*by, raw, "rank_raw")
    b = average_ranks(df, by, corrected, rank="rank_corrected").select(*by, corrected, "rank_corrected")
    rows = join_groups(join_groups(df.select(*by, key, raw, corrected), a, [*by, raw]), b, [*by, corrected])
    return rows.withColumn("shift", F.abs(F.col("rank_raw") - F.col("rank_corrected")))


def correction_verdict(df: DataFrame, by: Sequence[str], raw: str, corrected: str) -> DataFrame:
    """Spearman of raw against corrected scores, banded at 0.70 and 0.83."""
    s = spearman(df, by, raw, corrected)
    band = (F.when(F.col("rho") < 0.70, "reorders").when(F.col("rho") < 0.83, "intermediate")
            .when(F.col("rho").isNotNull(), "preserves"))
    return s.withColumn("verdict", band)


def holm(df: DataFrame, family: Sequence[str], p: str, test: str, *, bonferroni: bool = False) -> DataFrame:
    """Adjusted p-values (``p_adjusted``) within each family of tests.

    Places and the running maximum of the steps come from distributed scans, so one family may
    be the whole table. Tests without a p-value do not count and get none. ``test`` names a
    test within its family.
    """
    family = list(family)
    tested = df.filter(F.col(p).isNotNull())
    if bonferroni:
        sizes = tested.groupBy(*family).agg(F.count(F.lit(1)).alias("_m"))
        done = attach(tested, sizes, family).withColumn("p_adjusted", F.least(F.lit(1.0), F.col(p) * F.col("_m"))).drop("_m")
    else:
        placed = running(tested.withColumn("_one", F.lit(1).cast("long")), family, [p, test], ["_one"])
        step = placed.select(*df.columns, (F.col(p) * (F.col("_one_total") - F.col("_one_before"))).alias("_s"))
        done = running(step, family, [p, test], [], maxima=["_s"]).withColumn("p_adjusted", F.least(F.lit(1.0), F.col("_s_max"))).drop("_s", "_s_max")
    untested = df.filter(F.col(p).isNull()).withColumn("p_adjusted", F.lit(None).cast("double"))
    return done.unionByName(untested)


def binomial_tail(df: DataFrame, by: Sequence[str], success: Column, p0: float = 0.5) -> DataFrame:
    """k of n successes per group with the one- and two-sided binomial tail."""
    g = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum(success.cast("int")).alias("k"))
    upper = P.binomial_upper_p(F.col("k"), F.col("n"), F.lit(p0))
    lower = P.binomial_upper_p(F.col("n") - F.col("k"), F.col("n"), F.lit(1.0 - p0))
    return g.withColumn("p_upper", upper).withColumn(
        "p_two_sided", F.least(F.lit(1.0), 2.0 * F.least(F.col("p_upper"), lower)))


def removal_sensitivity(df: DataFrame, key: str, order: str, n_remove: int, x: str, y: str, *,
                        descending: bool = False) -> DataFrame:
    """Spearman of x and y after dropping the first ``n_remove`` rows by ``order``."""
    by_key = F.desc(order) if descending else F.asc(order)
    dropped = df.select(key, order).orderBy(by_key, F.asc(key)).limit(n_remove).select(key)
    return spearman(df.join(dropped, key, "left_anti"), [], x, y)
