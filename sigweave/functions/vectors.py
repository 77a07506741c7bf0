"""Expressions over ``ARRAY<DOUBLE>`` columns, and feature-chunk explosion.

A vector stays one array per row while the work is row-local (norm, dot, mask).
For sums across rows it is exploded into slices of ``CHUNK`` features, not into
single features: one exploded row carries ``CHUNK`` codegen'd accumulators, so
the shuffle holds G/CHUNK rows per group and partial aggregation absorbs hot
groups on the map side.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHUNK = 16
WIDE = 64  # up to this many features one aggregate with a column per feature does
EPS_UNIT = 1e-12


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def sumsq(v: Column | str) -> Column:
    return F.aggregate(_c(v), F.lit(0.0), lambda a, x: a + x * x)


def norm(v: Column | str) -> Column:
    return F.sqrt(sumsq(v))


def dot(a: Column | str, b: Column | str) -> Column:
    products = F.zip_with(_c(a), _c(b), lambda x, y: x * y)
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def scale(v: Column | str, k: Column) -> Column:
    return F.transform(_c(v), lambda x: x * k)


def subtract(a: Column | str, b: Column | str) -> Column:
    return F.zip_with(_c(a), _c(b), lambda x, y: x - y)


def inverse_norm(n: Column, eps: float = EPS_UNIT) -> Column:
    """1 / max(norm, eps): the factor that turns a vector into its unit vector."""
    return F.lit(1.0) / F.greatest(n, F.lit(eps))


def cosine(d: Column, na: Column, nb: Column, *, zero_vector: str = "zero",
           eps: float = 1e-10) -> Column:
    """Cosine from a dot product and two norms.

    ``zero_vector`` says what a vector shorter than ``eps`` gives: 0 or NULL.
    """
    if zero_vector not in ("zero", "null"):
        raise ValueError("zero_vector must be 'zero' or 'null'")
    value = F.when((na >= eps) & (nb >= eps), F.try_divide(d, na * nb))
    return F.coalesce(value, F.lit(0.0)) if zero_vector == "zero" else value


def one_length(x: Column) -> Column:
    """``x`` if the group's vectors (lengths from ``_least`` to ``_most``) have one length, else an error."""
    return F.when(F.min("_least") == F.max("_most"), x).otherwise(F.raise_error(F.lit("vectors of a group differ in length")).cast("long"))


def clip_unit(x: Column) -> Column:
    """Clamp to [-1, 1]; acos of 1 + 2e-16 is NaN."""
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x))


def zero_out(v: Column | str, drop: Column) -> Column:
    """Zero the features whose index is in ``drop``: same angles as removing them."""
    return F.transform(
        _c(v), lambda x, i: F.when(F.array_contains(drop, i), 0.0).otherwise(x)
    )


def gather(v: Column | str, idx: Column) -> Column:
    """The features at the positions listed in ``idx``, in that order."""
    vec = _c(v)
    return F.transform(idx, lambda i: F.get(vec, i))


def top_features(v: Column | str, n: int) -> Column:
    """Indices of the ``n`` largest |x|, ties to the lower index; row-local, no shuffle."""
    keyed = F.transform(_c(v), lambda x, i: F.struct((-F.abs(x)).alias("a"), i.alias("i")))
    return F.transform(F.slice(F.array_sort(keyed), 1, n), lambda s: s["i"])


def explode_chunks(df: DataFrame, keep: Sequence[str], vecs: dict[str, str],
                   width: int = CHUNK) -> DataFrame:
    """One row per feature chunk: ``keep``, ``_chunk`` and ``<out>_<k>`` for each vector.

    Slots past the end of a vector are NULL, which sums ignore.
    """
    first = next(iter(vecs.values()))
    names = list(vecs)
    pieces = F.transform(
        F.sequence(F.lit(0), F.floor((F.size(first) - 1) / width).cast("int")),
        lambda c: F.struct(*[
            F.slice(F.col(vecs[o]), c * width + 1, width).alias(o) for o in names
        ]),
    )
    out = df.filter(F.size(first) > 0).select(
        *keep, F.size(first).alias("_dim"), F.posexplode(pieces).alias("_chunk", "_s")
    )
    cells = [F.get(F.col(f"_s.{o}"), F.lit(k)).alias(f"{o}_{k}")
             for o in names for k in range(width)]
    return out.select(*keep, "_dim", "_chunk", *cells)


def chunk_array(name: str, width: int = CHUNK) -> Column:
    return F.array(*[F.col(f"{name}_{k}") for k in range(width)])


def assemble(df: DataFrame, by: Sequence[str], names: Sequence[str],
             extra: Sequence[Column] = (), width: int = CHUNK) -> DataFrame:
    """Chunk rows back to one array per group; the list holds G/CHUNK items, never more."""
    lists = [
        F.array_sort(F.collect_list(F.struct("_chunk", chunk_array(o, width).alias("a"))))
        .alias(f"_l_{o}")
        for o in names
    ]
    g = df.groupBy(*by).agg(F.max("_dim").alias("_dim"), *lists, *extra)
    for o in names:
        flat = F.flatten(F.transform(F.col(f"_l_{o}"), lambda s: s["a"]))
        g = g.withColumn(o, F.slice(flat, F.lit(1), F.col("_dim"))).drop(f"_l_{o}")
    return g.drop("_dim")


def with_whole_vectors(df: DataFrame, vec: str, dim: int | None) -> DataFrame:
    """Rows that have a vector (NULL and empty ones go), each of ``dim`` features where that is given.

    A vector of another length fails the query: it is neither cut nor filled.
    """
    rows = df.filter(F.size(F.coalesce(F.col(vec), F.array().cast(df.schema[vec].dataType))) > 0)
    if dim is None:
        return rows
    sound = F.when(F.size(vec) == dim, F.col(vec))
    return rows.withColumn(vec, F.coalesce(sound, F.raise_error(F.lit(f"a vector does not have {dim} features")).cast(df.schema[vec].dataType)))


def is_wide(dim: int | None) -> bool:
    """Is the number of features known and small enough for one accumulator column each?"""
    return dim is not None and dim <= WIDE


def feature_array(vec: str, dim: int, cell) -> Column:
    """Array of ``cell(x_i)`` over the features, for aggregates of known width."""
    return F.array(*[cell(F.get(F.col(vec), F.lit(i))) for i in range(dim)])
