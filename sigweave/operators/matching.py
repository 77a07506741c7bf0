"""Band join of similar entities, reason-coded lookups, fallback joins, set overlaps."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.draws import hash_number
from .common import attach, reuse, unpivot
from .ladder import quantiles


#: Rows of a key up to which its items travel as one array.
SET_ITEMS = 1000


def quartile_gates(df: DataFrame, a: str, b: str) -> DataFrame:
    """Add ``gate``: high when both columns reach their P75, low when both are within P25."""
    df = reuse(df)  # the cuts and both gates read it
    both = unpivot(df, [], [a, b], "_column", "_x")
    cuts = quantiles(both, ["_column"], "_x", {"_p25": 0.25, "_p75": 0.75})  # one ladder for both columns
    row = cuts.groupBy().agg(*[F.max(F.when(F.col("_column") == c, F.col(q))).alias(n + q)
                               for c, n in ((a, "_a"), (b, "_b")) for q in ("_p25", "_p75")])
    j = attach(df, reuse(row), [])
    high = (F.col(a) >= F.col("_a_p75")) & (F.col(b) >= F.col("_b_p75"))
    low = (F.col(a) <= F.col("_a_p25")) & (F.col(b) <= F.col("_b_p25"))
    return j.withColumn("gate", F.when(high, "high").when(low, "low")).drop("_a_p25", "_a_p75", "_b_p25", "_b_p75")


def band_join(high: DataFrame, low: DataFrame, x: str, tolerance: float, columns: Sequence[str], *,
              by: Sequence[str] = (), salts: int = 1, digits: int = 9) -> DataFrame:
    """Pairs (high, low) with |x_high - x_low| <= tolerance, the gap rounded to ``digits`` for the test.

    Rounding lets in pairs whose gap is the tolerance itself but for the last bits of a
    difference of doubles. Both sides are cut into cells a little wider than the tolerance, so
    that such a pair is not two cells apart; the low side visits its own
    and both neighbouring cells, the exact test follows. ``salts`` spreads a crowded cell:
    high rows keep one salt, low rows visit all of them.
    """
    by = list(by)
    width = tolerance + 10.0 ** -digits
    cell = lambda c: F.floor(F.col(c) / width).cast("long")
    first = columns[0]
    h = high.filter(F.col(x).isNotNull()).select(
        *by, cell(x).alias("_cell"), F.pmod(F.xxhash64(first), F.lit(salts)).cast("int").alias("_salt"),
        *[F.col(c).alias(f"high_{c}") for c in columns])
    lo = low.filter(F.col(x).isNotNull()).select(
        *by, F.explode(F.sequence(cell(x) - 1, cell(x) + 1)).alias("_cell"),
        *[F.col(c).alias(f"low_{c}") for c in columns])
    lo = lo.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    gap = F.abs(F.col(f"high_{x}") - F.col(f"low_{x}"))
    return h.join(lo, [*by, "_cell", "_salt"]).withColumn(f"{x}_gap", gap).filter(
        F.round(f"{x}_gap", digits) <= tolerance).drop("_cell", "_salt")


def top_band_pairs(high: DataFrame, low: DataFrame, x: str, tolerance: float, columns: Sequence[str], order: str, n: int, *,
                   digits: int = 6, salts: int = 1) -> DataFrame:
    """The ``n`` pairs of ``band_join`` with the largest gap of ``order`` (high less low), without the other pairs.

    The gap is rounded to ``digits`` (column ``<order>_gap``); ties go to the smaller first
    column of the high side, then of the low side. Two rows of one cell are hardly ever beyond the tolerance, so the
    best few rows of every cell give n true pairs and with them a gap that the answer reaches. A
    row then stays only if its gap to the best row of the other side in its own and the
    neighbouring cells reaches that bound, and only what stays is joined.
    """
    first, slack = columns[0], 10.0 ** -digits
    cell = lambda c: F.floor(F.col(c) / (tolerance + 1e-9)).cast("long")  # noqa: E731 (the cells of band_join)
    sides = {}
    for name, df in (("high", high), ("low", low)):
        rows = df.filter(F.col(x).isNotNull() & F.col(order).isNotNull() & ~F.isnan(F.col(order).cast("double")))
        sides[name] = reuse(rows.select(*dict.fromkeys([*columns, x, order])).withColumn("_cell", cell(x)))
    h, lo = sides["high"], sides["low"]
    few = math.isqrt(n - 1) + 1
    best_h = Window.partitionBy("_cell").orderBy(F.desc(order), first)
    best_l = Window.partitionBy("_cell").orderBy(order, first)
    seed_h = h.withColumn("_r", F.row_number().over(best_h)).filter(F.col("_r") <= few).select("_cell", F.col(x).alias("_hx"), F.col(order).alias("_h"))
    seed_l = lo.withColumn("_r", F.row_number().over(best_l)).filter(F.col("_r") <= few).select("_cell", F.col(x).alias("_lx"), F.col(order).alias("_l"))
    seeds = seed_h.join(seed_l, "_cell").filter(F.abs(F.col("_hx") - F.col("_lx")) <= tolerance).select(F.round(F.col("_h") - F.col("_l"), digits).alias("_g"))
    reached = seeds.orderBy(F.desc("_g")).limit(n).agg(F.count("_g").alias("n"), F.min("_g").alias("g")).first()
    bound = reached["g"] - slack if reached["n"] == n else None
    if bound is not None:
        around = lambda df, stat: df.groupBy("_cell").agg(stat.alias("_s")).select(
            F.explode(F.sequence(F.col("_cell") - 1, F.col("_cell") + 1)).alias("_cell"), "_s")
        least = around(lo, F.min(order)).groupBy("_cell").agg(F.min("_s").alias("_s"))
        most = around(h, F.max(order)).groupBy("_cell").agg(F.max("_s").alias("_s"))
        h = h.join(least, "_cell").filter(F.col(order) - F.col("_s") >= bound).drop("_s")
        lo = lo.join(most, "_cell").filter(F.col("_s") - F.col(order) >= bound).drop("_s")
    pairs = band_join(h, lo, x, tolerance, list(dict.fromkeys([*columns, x, order])), salts=salts)
    gap = f"{order}_gap"
    pairs = pairs.withColumn(gap, F.round(F.col(f"high_{order}") - F.col(f"low_{order}"), digits))
    return pairs.orderBy(F.desc(gap), f"high_{first}", f"low_{first}").limit(n)


def with_fallback(df: DataFrame, first: DataFrame, second: DataFrame, on: Sequence[str], column: str) -> DataFrame:
    """Left lookup in ``first``, and in ``second`` where that gave nothing."""
    a = first.select(*on, F.col(column).alias("_a")).dropDuplicates(list(on))
    b = second.select(*on, F.col(column).alias("_b")).dropDuplicates(list(on))
    return df.join(a, list(on), "left").join(b, list(on), "left").withColumn(
        column, F.coalesce("_a", "_b")).drop("_a", "_b")


def first_reason(reasons: Sequence[tuple[str, Column]], ok: str = "scored") -> Column:
    """The first reason whose condition holds, in the given order."""
    out = F.lit(ok)
    for name, cond in reversed(list(reasons)):
        out = F.when(cond, name).otherwise(out)
    return out


def either_of(df: DataFrame, a: DataFrame, b: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows found in at least one of two tables, with the columns of both, NULL where absent."""
    left = df.join(a.withColumn("_in_a", F.lit(True)), list(on), "left")
    both = left.join(b.withColumn("_in_b", F.lit(True)), list(on), "left")
    return both.filter(F.col("_in_a") | F.col("_in_b")).drop("_in_a", "_in_b")


def matched(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows where every listed column is present."""
    return df.dropna(subset=list(columns))


def found_in(names: DataFrame, scores: DataFrame, name: str, *, ignore_case: bool = False) -> DataFrame:
    """A curated list against a score table, with a ``found`` flag for every name."""
    key = (lambda c: F.lower(F.col(c))) if ignore_case else F.col
    l_ = names.select(F.col(name).alias("_name"), key(name).alias("_k"))
    r_ = scores.withColumn("_k", key(name))
    j = l_.join(r_.drop(name).withColumn("found", F.lit(True)), "_k", "left")
    return j.withColumn("found", F.coalesce("found", F.lit(False))).withColumnRenamed("_name", name).drop("_k")


def matched_cohort(a: DataFrame, b: DataFrame, on: str, min_count: int) -> DataFrame:
    """Exact-key inner join plus whether the matched number reaches the minimum."""
    return a.join(b, on).agg(F.count(F.lit(1)).alias("n_matched")).withColumn(
        "enough", F.col("n_matched") >= min_count)


def sampled_pairs(df: DataFrame, key: str, columns: Sequence[str], partners: int, seed: int) -> DataFrame:
    """Each entity with ``partners`` random others: a sample of pairs, the operator's purpose.

    Rows are placed in hash order per replicate and matched with the next place, so no
    cross product is formed and every entity appears in every replicate.
    """
    from .ladder import row_index
    ids = df.select(key, *columns, F.explode(F.sequence(F.lit(1), F.lit(partners))).alias("rep"))
    ids = ids.withColumn("_h", hash_number(seed, F.col("rep"), F.col(key)))
    placed = row_index(ids, ["rep"], ["_h", key], "_pos").drop("_h")
    a = placed.select("rep", "_pos", "n", *[F.col(c).alias(f"{c}_a") for c in [key, *columns]])
    b = placed.select("rep", ((F.col("_pos") - 1 + F.col("n")) % F.col("n")).alias("_pos"),
                      *[F.col(c).alias(f"{c}_b") for c in [key, *columns]])
    return a.join(b, ["rep", "_pos"]).drop("_pos", "n").filter(F.col(f"{key}_a") != F.col(f"{key}_b"))


def pair_set_overlap(pairs: DataFrame, members: DataFrame, key: str, item: str) -> DataFrame:
    """Jaccard of the item sets of both sides of each pair.

    Where no key has more than ``SET_ITEMS`` rows, each side brings its set in one row;
    else the items are joined one by one. A NULL item counts in a set and equals no other.
    """
    most = members.groupBy(key).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("n")).first()["n"]
    if (most or 0) <= SET_ITEMS:
        sets = members.groupBy(key).agg(F.collect_set(item).alias("_set"), F.max(F.col(item).isNull().cast("int")).alias("_null"))
        sets = sets.select(key, "_set", (F.size("_set") + F.col("_null")).alias("_size"))
        j = pairs
        for side in ("a", "b"):
            j = j.join(sets.withColumnsRenamed({key: f"{key}_{side}", "_set": f"_set_{side}", "_size": f"_size_{side}"}), f"{key}_{side}")
        shared = F.size(F.array_intersect("_set_a", "_set_b"))
        return j.withColumn("jaccard", shared / (F.col("_size_a") + F.col("_size_b") - shared)).drop(
            "_set_a", "_set_b", "_size_a", "_size_b")
    m = members.select(key, item).distinct()
    sizes = m.groupBy(key).agg(F.count(F.lit(1)).alias("_size"))
    a = pairs.join(sizes.withColumnsRenamed({key: f"{key}_a", "_size": "_na"}), f"{key}_a").join(
        sizes.withColumnsRenamed({key: f"{key}_b", "_size": "_nb"}), f"{key}_b")
    shared = pairs.select("rep", f"{key}_a", f"{key}_b").join(
        m.withColumnRenamed(key, f"{key}_a"), f"{key}_a").join(
        m.withColumnRenamed(key, f"{key}_b"), [f"{key}_b", item]).groupBy(
        "rep", f"{key}_a", f"{key}_b").agg(F.count(F.lit(1)).alias("_both"))
    j = a.join(shared, ["rep", f"{key}_a", f"{key}_b"], "left").na.fill(0, ["_both"])
    union = F.col("_na") + F.col("_nb") - F.col("_both")
    return j.withColumn("jaccard", F.col("_both") / union).drop("_na", "_nb", "_both")


def band_pair_count(high: DataFrame, low: DataFrame, x: str, tolerance: float, digits: int = 9) -> DataFrame:
    """Per distinct x of ``high``: how many ``low`` rows lie within the tolerance, without forming pairs.

    One ladder holds the low values and both band edges of the high ones; the running
    count of low rows at the edges gives the partners.
    """
    from .ladder import running
    lo = low.filter(F.col(x).isNotNull()).select(F.round(x, digits).alias("v"), F.lit(1).cast("long").alias("is_low"))
    hv = high.filter(F.col(x).isNotNull()).groupBy(F.round(x, digits).alias("x")).agg(F.count(F.lit(1)).alias("n_high"))
    edges = F.array(F.struct(F.round(F.col("x") - tolerance, digits).alias("v"), F.lit(0).alias("end")),
                    F.struct(F.round(F.col("x") + tolerance, digits).alias("v"), F.lit(1).alias("end")))
    ev = hv.select("x", "n_high", F.explode(edges).alias("e")).select("x", "n_high", "e.v", "e.end")
    points = lo.unionByName(ev.select("v", F.lit(0).cast("long").alias("is_low")))
    ladder = running(points.groupBy("v").agg(F.sum("is_low").alias("is_low")), [], ["v"], ["is_low"])
    j = ev.join(ladder, "v")
    below = F.max(F.when(F.col("end") == 0, F.col("is_low_before")))
    upto = F.max(F.when(F.col("end") == 1, F.col("is_low_before") + F.col("is_low")))
    return j.groupBy("x", "n_high").agg((upto - below).alias("per_row")).select(
        "x", "n_high", (F.col("n_high") * F.col("per_row")).alias("n_partners"))
