"""Statistics of context pairs inside an entity, computed block by block."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import vectors as V
from . import blocks
from .common import join_groups, reuse


def top_feature_jaccard(df: DataFrame, by: Sequence[str], context: str, n: int, *, vec: str = "vec",
                        block_size: int = blocks.BLOCK_SIZE) -> DataFrame:
    """Mean Jaccard of the top-``n`` feature sets over an entity's context pairs."""
    by = list(by)
    rounded = F.transform(vec, lambda x: F.round(x, 9))
    rows = df.select(*by, context, V.top_features(rounded, n).alias("items"))
    pairs = blocks.block_pairs(rows, by, context, ["items"], block_size)
    partial = blocks.map_blocks(pairs, by, blocks.overlap_kernel,
                                [T.StructField("partial", T.DoubleType()), T.StructField("pairs", T.LongType())])
    g = partial.groupBy(*by).agg(F.sum("partial").alias("_s"), F.sum("pairs").alias("n_pairs"))
    return g.filter(F.col("n_pairs") > 0).select(
        *by, "n_pairs", (F.col("_s") / F.col("n_pairs")).alias("mean_top_jaccard"))


def _level_pairs(df: DataFrame, by: list[str], level: str, vec: str, eps: float, block_size: int) -> DataFrame:
    n = V.norm(vec)
    rows = df.select(*by, F.col(level).cast("double").alias("level"),
                     F.when(n >= eps, n).otherwise(0.0).alias("n"),
                     V.scale(vec, V.inverse_norm(n, eps)).alias("u"))
    several = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_k")).filter(F.col("_k") >= 2)
    rows = join_groups(rows.withColumn("_m", F.col("level")), several.select(*by), by, "left_semi")
    return blocks.block_pairs(rows, by, "_m", ["level", "n", "u"], block_size)


def level_cosines(df: DataFrame, by: Sequence[str], level: str, *, vec: str = "vec", eps: float = 1e-10,
                  block_size: int = blocks.BLOCK_SIZE) -> DataFrame:
    """Cosine between every two dose levels of a group, with the dose ratio.

    The table of comparisons is the result here; ``level_distribution`` gives its
    distribution without it. Zero vectors take part in no comparison.
    """
    pairs = _level_pairs(df, list(by), level, vec, eps, block_size)
    out = [T.StructField("level_lo", T.DoubleType()), T.StructField("level_hi", T.DoubleType()),
           T.StructField("cosine", T.DoubleType())]
    cos = blocks.map_blocks(pairs, list(by), blocks.ordered_cosine_kernel, out)
    return cos.withColumn("ratio", F.try_divide(F.col("level_hi"), F.col("level_lo")))


def level_summary(cosines: DataFrame, by: Sequence[str]) -> DataFrame:
    """Per group: number of comparisons, mean and minimum cosine, level range."""
    return cosines.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_comparisons"), F.avg("cosine").alias("mean_cosine"),
        F.min("cosine").alias("min_cosine"), F.min("level_lo").alias("level_min"),
        F.max("level_hi").alias("level_max"))


#: Counting cells of an interval.
CELL_BITS = 12
CELLS = 1 << CELL_BITS


def level_distribution(df: DataFrame, by: Sequence[str], level: str, probs: dict[str, float], *, vec: str = "vec", eps: float = 1e-10,
                       edges: Sequence[float] = (), labels: Sequence[str] = (), other: str = "unbinned", digits: int = 9,
                       block_size: int = blocks.BLOCK_SIZE) -> DataFrame:
    """Distribution of the cosines between dose levels, without a row for a pair.

    One row per bin of the dose ratio (half-open [edge_i, edge_i+1), else ``other``), or a
    single row without ``edges``: n, mean, std (population), exact interpolated quantiles
    ``probs``, and the shares above 0.9 and 0.7 and below 0.5 and 0.3. The block kernel returns
    counts: first of CELLS cells over [-1, 1], then of as many within each cell that holds a
    wanted rank, until a cell is a single value. Cosines are rounded to ``digits``, so three
    passes do for nine of them.
    """
    pairs = reuse(_level_pairs(df, list(by), level, vec, eps, block_size))
    bounds, names = np.array(edges, float), [*labels, other] if len(edges) else [other]

    def bins(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        if not len(bounds):
            return np.zeros(len(lo), np.int64)
        at = np.searchsorted(bounds, np.divide(hi, lo, out=np.full(len(lo), np.nan), where=lo != 0), side="right") - 1
        return np.where((at < 0) | (at >= len(bounds) - 1), len(names) - 1, at)

    def cosines(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for _, lo, hi, cosine in blocks.ordered_cosines(blocks.Members(batch)):
            yield bins(lo, hi), cosine.round(digits)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(names), 7))
        for batch in batches:
            for g, c in cosines(batch):
                for k, x in enumerate((np.ones(len(c)), c, c * c, c > 0.9, c > 0.7, c < 0.5, c < 0.3)):
                    total[:, k] += np.bincount(g, x, len(names))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(names))), *[pa.array(x) for x in total.T]], names=["_g", *moments])

    moments = ["_n", "_s", "_q", "_a9", "_a7", "_b5", "_b3"]
    stats = reuse(pairs.mapInArrow(summed, "_g long, " + ", ".join(f"{c} double" for c in moments)).groupBy("_g").agg(
        *[F.sum(c).alias(c) for c in moments]).filter("_n > 0"))
    sizes = {r["_g"]: int(r["_n"]) for r in stats.select("_g", "_n").collect()}
    ranks = {g: sorted({r for p in probs.values() for r in (int(p * (n - 1)), min(int(p * (n - 1)) + 1, n - 1))}) for g, n in sizes.items()}
    found = _values_at(pairs, cosines, ranks, digits)
    table = []
    for g, n in sizes.items():
        own = {}
        for name, p in probs.items():
            at = int(p * (n - 1))
            low, high = found[g, at], found[g, min(at + 1, n - 1)]
            own[name] = float(low + (p * (n - 1) - at) * (high - low))
        table.append((g, names[g], *own.values()))
    quantiles = df.sparkSession.createDataFrame(table, "_g long, bin string, " + ", ".join(f"`{c}` double" for c in probs))
    n, mean = F.col("_n"), F.col("_s") / F.col("_n")
    return stats.join(quantiles, "_g").select(
        "bin", n.cast("long").alias("n"), mean.alias("mean"), F.sqrt(F.greatest(F.lit(0.0), F.col("_q") / n - mean * mean)).alias("std"), *probs,
        *[(F.col(c) / n).alias(a) for c, a in (("_a9", "frac_above_09"), ("_a7", "frac_above_07"), ("_b5", "frac_below_05"), ("_b3", "frac_below_03"))])


Cosines = Callable[[pa.RecordBatch], Iterator[tuple[np.ndarray, np.ndarray]]]


def _values_at(pairs: DataFrame, cosines: Cosines, ranks: dict[int, list[int]], digits: int) -> dict[tuple[int, int], float]:
    """The values at the wanted 0-based ranks of each group, by counting in ever narrower intervals.

    Values are whole numbers of 10**-digits. An interval is (group, first value, bits of its
    width, values before it, wanted ranks); there are at most as many as wanted ranks.
    """
    scale = 10 ** digits
    most = int(np.ceil(np.log2(2 * scale + 2)))
    found: dict[tuple[int, int], float] = {}
    wanted = [(g, -scale - 1, most, 0, rs) for g, rs in ranks.items()]
    while wanted:
        places = [(g, left, bits) for g, left, bits, _, _ in wanted]

        def count(batches: Iterator[pa.RecordBatch], places=places) -> Iterator[pa.RecordBatch]:
            held = np.zeros((len(places), CELLS), np.int64)
            for batch in batches:
                for g, c in cosines(batch):
                    whole = np.rint(c * scale).astype(np.int64)
                    for k, (group, left, bits) in enumerate(places):
                        inside = whole[g == group] - left
                        inside = inside[(inside >= 0) & (inside < 1 << bits)] >> max(0, bits - CELL_BITS)
                        held[k] += np.bincount(inside, minlength=CELLS)
            k, cell = np.nonzero(held)
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(cell), pa.array(held[k, cell])], names=["k", "cell", "n"])

        cells = pairs.mapInArrow(count, "k long, cell long, n long").groupBy("k", "cell").agg(F.sum("n").alias("n")).toPandas()
        narrower = []
        for k, (g, left, bits, before, rs) in enumerate(wanted):
            own = cells[cells["k"] == k].sort_values("cell")
            upto = before + own["n"].cumsum().to_numpy()
            finer = max(0, bits - CELL_BITS)
            for at in np.unique(np.searchsorted(upto, rs, side="right")):
                first, start = left + (int(own["cell"].iloc[at]) << finer), int(upto[at] - own["n"].iloc[at])
                here = [r for r in rs if start <= r < upto[at]]
                if finer:
                    narrower.append((g, first, finer, start, here))
                else:
                    found |= {(g, r): first / scale for r in here}
        wanted = narrower
    return found


def level_overall(df: DataFrame, by: Sequence[str], level: str, probs: dict[str, float] | None = None, *, vec: str = "vec") -> DataFrame:
    """All comparisons together: mean, quantiles, shares beyond 0.3, 0.5, 0.7, 0.9 and the two gates."""
    probs = probs or {f"p{p}": p / 100 for p in (5, 10, 25, 50, 75, 90, 95)}
    s = level_distribution(df, by, level, probs, vec=vec).drop("bin")
    return s.withColumn("passes_median", F.col("p50") > 0.7).withColumn(
        "passes_fraction", F.col("frac_below_05") < 0.20)


def level_strata(df: DataFrame, by: Sequence[str], level: str, edges: Sequence[float], labels: Sequence[str], *, vec: str = "vec") -> DataFrame:
    """Summary by dose-ratio bin; ratios outside every bin stay visible as ``unbinned``."""
    s = level_distribution(df, by, level, {"median": 0.5}, vec=vec, edges=edges, labels=labels)
    return s.select("bin", "n", "mean", "std", "median", "frac_below_05", "frac_above_09")


def replicate_depth(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Share of groups that rest on a single replicate."""
    g = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    return g.agg(F.count(F.lit(1)).alias("n_groups"),
                 F.avg((F.col("_n") == 1).cast("double")).alias("frac_single"))
