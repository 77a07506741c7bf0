"""Distributed running sums, ranks and exact quantiles.

A window ordered over a whole table, or over one hot group, sorts in a single
task. Here a *ladder* (one row per distinct value, after map-side combining, so
ties cost one row however many rows share them) is fixed once as a narrow table and
cut into pieces by an order-preserving function of the value: first a fixed
logarithmic one, then, where more than ``PIECE_ROWS`` rows fall into one piece, evenly
between that piece's own smallest and largest value, and again until every piece that holds
two different values is below the budget. Piece totals are tiny and give the offset
of each piece; the sort happens inside (group, piece). A table within the budget takes one
plain window. Everything rests on exact counts, minima and maxima and nothing on sampling, so
it is the same in every evaluation and after a lost executor. A NULL group is a group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.draws import hash_number
from .common import attach, join_groups, reuse, without_nan


#: Rows of a piece, over all groups, above which it is cut further.
PIECE_ROWS = 20_000
#: Crowded pieces of a round up to which every task gets them all; there are at most the table's rows / PIECE_ROWS of them.
SENT_PIECES = 200_000
#: Pieces that a crowded one is cut into, per PIECE_ROWS of its rows: uneven values then seldom need another round.
FINENESS = 4


def default_resolution(df: DataFrame) -> int:
    """Buckets per factor of two, tied to the session's shuffle width.

    A cluster that sets more shuffle partitions for more data also gets finer buckets.
    """
    return max(16, 2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))


def value_bucket(x: Column, resolution: int) -> Column:
    """Monotone bucket of a number: ``resolution`` buckets per factor of two.

    Linear below 2**-30, logarithmic above, symmetric in sign.
    """
    x = x.cast("double")
    return F.floor(F.signum(x) * F.log2(1.0 + F.abs(x) * float(2**30)) * resolution).cast("long")


def _extents(rows: DataFrame, order: str) -> DataFrame:
    x = F.col(order).cast("double")
    return rows.groupBy("_bucket", "_piece").agg(F.count(F.lit(1)).alias("_c"), F.min(x).alias("_lo"), F.max(x).alias("_hi"))


def _crowded() -> Column:
    return (F.col("_c") > PIECE_ROWS) & (F.col("_lo") < F.col("_hi"))


def with_pieces(rows: DataFrame, order: str, resolution: int) -> DataFrame | None:
    """Add ``_bucket`` and ``_piece`` (the path of the row's piece, one number a round), which
    together ascend with ``order``; None if the whole table is within the budget of one piece.

    ``rows`` is read once to count and once per round of refinement, so it should be fixed.
    ``order`` must be a number that is neither NULL nor NaN.
    """
    x = F.col(order).cast("double")
    placed = rows.withColumn("_bucket", value_bucket(x, resolution)).withColumn("_piece", F.array().cast("array<int>"))
    extents = _extents(placed, order)
    size = extents.agg(F.coalesce(F.sum("_c"), F.lit(0)).alias("n"), F.count_if(_crowded()).alias("crowded")).first()
    if size["n"] <= PIECE_ROWS:
        return None
    fresh, crowded = placed, size["crowded"]
    while crowded:
        cells = reuse(extents.filter(_crowded()).select("_bucket", "_piece", "_c", "_lo", "_hi"))
        if crowded <= SENT_PIECES:  # rows stay where they are: a shuffle by piece would gather crowded pieces in single tasks
            cells = F.broadcast(cells)
        placed, fresh = _cut(placed, cells, x, "left"), _cut(fresh, cells, x, "inner")
        extents = _extents(fresh, order)
        crowded = extents.agg(F.count_if(_crowded()).alias("crowded")).first()["crowded"]
    return placed


def _cut(rows: DataFrame, cells: DataFrame, x: Column, how: str) -> DataFrame:
    """Rows of the crowded ``cells`` get the number of their even share of the cell appended to their path."""
    pieces = F.ceil(F.col("_c") * FINENESS / F.lit(float(PIECE_ROWS)))
    share = (x / 2 - F.col("_lo") / 2) / (F.col("_hi") / 2 - F.col("_lo") / 2)
    path = F.array_append("_piece", F.floor(share * pieces).cast("int"))
    return rows.join(cells, ["_bucket", "_piece"], how).select(
        *[F.col(f"`{c}`") for c in rows.columns if c != "_piece"],
        F.when(F.col("_c").isNull(), F.col("_piece")).otherwise(path).alias("_piece"))


def running(df: DataFrame, by: Sequence[str], order: Sequence[str], sums: Sequence[str], *,
            maxima: Sequence[str] = (), descending: bool = False, resolution: int | None = None, bounded: bool = False) -> DataFrame:
    """Add ``<s>_before`` (sum over earlier rows of the group) and ``<s>_total``, and for each of
    ``maxima`` its running maximum ``<m>_max``, the row itself included.

    ``order[0]`` must be a number, not NULL or NaN; the remaining columns break ties and
    the whole of ``order`` must be unique within ``by``. ``bounded`` says that a group is
    small by construction (replicates, folds, contexts): then one plain window does, and
    nothing is computed ahead. Else ``df`` is fixed first.
    """
    by = list(by)
    direct = (lambda c: F.col(c).desc()) if descending else (lambda c: F.col(c).asc())
    keys = [direct(o) for o in order]
    rows = None
    if not bounded:
        df = reuse(df)
        rows = with_pieces(df, order[0], resolution or default_resolution(df))
    group = Window.partitionBy(*(by or [F.lit(0)]))
    if rows is None:
        prior = group.orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
        return df.select(
            "*", *[F.coalesce(F.sum(s).over(prior), F.lit(0)).alias(f"{s}_before") for s in sums],
            *[F.sum(s).over(group).alias(f"{s}_total") for s in sums],
            *[F.max(m).over(group.orderBy(*keys).rowsBetween(Window.unboundedPreceding, 0)).alias(f"{m}_max") for m in maxima])
    cut = [*by, "_bucket", "_piece"]
    totals = rows.groupBy(*cut).agg(F.count(F.lit(1)).alias("_rows"), *[F.sum(s).alias(f"_t_{s}") for s in sums],
                                    *[F.max(m).alias(f"_m_{m}") for m in maxima])
    earlier = group.orderBy(direct("_bucket"), direct("_piece")).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *cut,
        *[F.coalesce(F.sum(f"_t_{s}").over(earlier), F.lit(0)).alias(f"_o_{s}") for s in sums],
        *[F.sum(f"_t_{s}").over(group).alias(f"{s}_total") for s in sums],
        *[F.max(f"_m_{m}").over(earlier).alias(f"_p_{m}") for m in maxima],
    )
    place = Window.partitionBy("_bucket", "_piece", *by).orderBy(*keys)
    local, upto = place.rowsBetween(Window.unboundedPreceding, -1), place.rowsBetween(Window.unboundedPreceding, 0)
    inside = rows.select(
        "*", *[F.coalesce(F.sum(s).over(local), F.lit(0)).alias(f"_i_{s}") for s in sums],
        *[F.max(m).over(upto).alias(f"_i_{m}_max") for m in maxima])
    joined = join_groups(inside, offsets, cut)
    return joined.select(
        *df.columns,
        *[(F.col(f"_o_{s}") + F.col(f"_i_{s}")).alias(f"{s}_before") for s in sums],
        *[f"{s}_total" for s in sums],
        *[F.greatest(f"_p_{m}", f"_i_{m}_max").alias(f"{m}_max") for m in maxima],
    )


def ladder(df: DataFrame, by: Sequence[str], value: str, sums: Sequence[str], *,
           descending: bool = False, bounded: bool = False) -> DataFrame:
    """Distinct values of a group (NULL and NaN left out) with the sums of ``sums`` and their running sums.

    The distinct values are fixed once; cuts, piece totals and sorted pieces all read that table.
    """
    kind = df.schema[value].dataType.simpleString()
    rows = df.withColumn(value, without_nan(F.col(value), kind)).filter(F.col(value).isNotNull())
    cells = rows.groupBy(*by, value).agg(*[F.sum(s).alias(s) for s in sums])
    return running(cells, by, [value], sums, descending=descending, bounded=bounded)


def row_ranks(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Add every row's mid-rank less the mean rank (``rank``) in its group. Values are doubles without NULL or NaN.

    ``df`` should be fixed. Rows are sorted inside their piece in one shuffle: how many rows of the group come before a piece, and how
    many the group has, travel as a row of their own that comes first in the piece.
    """
    by = list(by)
    rows = with_pieces(df, value, default_resolution(df))
    part = [*by, "_bucket", "_piece"]
    if rows is None:
        rows, part = df, by
        marked = df.select("*", F.lit(1).cast("long").alias("_c"), F.lit(None).cast("long").alias("_all"))
        total = F.count(F.lit(1)).over(Window.partitionBy(*(part or [F.lit(0)])))
    else:
        group = Window.partitionBy(*(by or [F.lit(0)]))
        sizes = rows.groupBy(*part).agg(F.count(F.lit(1)).alias("_c"))
        earlier = group.orderBy("_bucket", "_piece").rowsBetween(Window.unboundedPreceding, -1)
        heads = sizes.select(*part, F.coalesce(F.sum("_c").over(earlier), F.lit(0)).alias("_c"), F.sum("_c").over(group).alias("_all"))
        marked = rows.withColumn("_c", F.lit(1).cast("long")).unionByName(heads, allowMissingColumns=True)
        total = F.max("_all").over(Window.partitionBy(*part))
    whole = Window.partitionBy(*(part or [F.lit(0)])).orderBy(F.asc_nulls_first(value))
    upto = F.sum("_c").over(whole.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    ties = F.sum("_c").over(whole.rangeBetween(Window.currentRow, Window.currentRow))
    ranked = marked.select("*", (upto - (ties - 1) / 2.0 - (total + 1) / 2.0).alias("rank"))
    return ranked.filter(F.col(value).isNotNull()).select(*df.columns, "rank")


def weighted(df: DataFrame, weight: str | None) -> DataFrame:
    """Add ``w``: the given weight, or 1."""
    return df.withColumn("w", F.col(weight) if weight else F.lit(1).cast("long"))


def average_ranks(df: DataFrame, by: Sequence[str], value: str, weight: str | None = None,
                  rank: str = "rank", bounded: bool = False) -> DataFrame:
    """Per distinct value: mid-rank of its ties, tie size ``w`` and group size ``w_total``."""
    lad = ladder(weighted(df, weight), by, value, ["w"], bounded=bounded)
    return lad.withColumn(rank, F.col("w_before") + (F.col("w") + 1) / 2.0).drop("w_before")


def row_index(df: DataFrame, by: Sequence[str], order: Sequence[str], out: str = "idx", *,
              descending: bool = False, bounded: bool = False) -> DataFrame:
    """0-based position in the group's order, and the group size ``n``.

    A text key is ordered by a hash of it first, then by itself.
    """
    order = list(order)
    rows = df.withColumn("_one", F.lit(1).cast("long"))
    if isinstance(df.schema[order[0]].dataType, T.StringType):
        rows = rows.withColumn("_key", hash_number(F.col(order[0])))
        order = ["_key", *order]
    one = running(rows, by, order, ["_one"], descending=descending, bounded=bounded)
    return (one.withColumnRenamed("_one_before", out).withColumnRenamed("_one_total", "n")
            .drop("_one", "_key"))


def quantiles(df: DataFrame, by: Sequence[str], value: str, probs: dict[str, float],
              weight: str | None = None) -> DataFrame:
    """Exact linearly interpolated quantiles per group, one column per entry of ``probs``."""
    lad = ladder(weighted(df, weight), by, value, ["w"])
    after = F.col("w_before") + F.col("w")
    aggs = []
    for name, p in probs.items():
        lo = F.floor(F.lit(float(p)) * (F.col("w_total") - 1))
        hi = F.least(lo + 1, F.col("w_total") - 1)
        for tag, pos in (("lo", lo), ("hi", hi)):
            hit = (F.col("w_before") <= pos) & (pos < after)
            aggs.append(F.max(F.when(hit, F.col(value).cast("double"))).alias(f"_{tag}_{name}"))
    g = lad.groupBy(*by).agg(F.max("w_total").alias("_n"), *aggs)
    cols = []
    for name, p in probs.items():
        pos = F.lit(float(p)) * (F.col("_n") - 1)
        frac = pos - F.floor(pos)
        a, b = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        cols.append((a + frac * (b - a)).alias(name))
    return g.select(*by, *cols)


def with_quantiles(df: DataFrame, by: Sequence[str], value: str,
                   probs: dict[str, float]) -> DataFrame:
    """Attach a group's quantiles to each of its rows (thresholds, medians, quartile gates)."""
    return attach(df, quantiles(df, by, value, probs), by)
