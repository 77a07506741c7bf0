"""Statistics over the pairs inside a group without one row per pair or one task per group.

A group's members are hashed into blocks of about ``block_size``; every unordered pair
of blocks becomes one bounded row, keyed by the group and both block numbers, so a group
that holds a third of the table turns into many rows that spread over the cluster. A
group of one block costs one shuffle and no join. A numpy kernel does the block product
and returns one partial result per member.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLOCK_SIZE = 128
#: Pairs of padded members that a kernel looks at in one step.
PADDED_CELLS = 1_000_000


def block_pairs(df: DataFrame, by: Sequence[str], member: str, payload: Sequence[str],
                block_size: int = BLOCK_SIZE, size: Column | None = None) -> DataFrame:
    """Rows ``by``, ``items``: array of struct(side, member, *payload), and ``same``.

    A row holds the members of one block (``same``), or of two blocks (sides 0 and 1). ``size`` is the number of members of the row's group where that is known.
    """
    by = list(by)
    if size is None:
        counted = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_size"))
        df, size = df.join(counted, by), F.col("_size")
    blocks_of = F.ceil(size / F.lit(block_size)).cast("int")
    rows = df.select(*by, F.col(member).alias("member"), *payload, blocks_of.alias("_nb"))
    rows = rows.withColumn("_b", F.pmod(F.xxhash64("member"), F.col("_nb")).cast("int"))
    rows = rows.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_nb") - 1)))
    low, high = F.least("_b", "_o").alias("_lo"), F.greatest("_b", "_o").alias("_hi")
    item = F.struct((F.col("_b") > F.col("_o")).cast("int").alias("side"), "member", *payload)
    meeting = rows.select(*by, low, high, item.alias("_item"))
    rows = meeting.groupBy(*by, "_lo", "_hi").agg(F.collect_list("_item").alias("items"))
    return rows.withColumn("same", F.col("_lo") == F.col("_hi")).drop("_lo", "_hi")


class Members:
    """The array-of-struct column of an Arrow batch: flat members plus row boundaries."""

    def __init__(self, batch: pa.RecordBatch):
        column = batch.column("items")
        self.same = batch.column("same").to_numpy(zero_copy_only=False)
        offsets = np.asarray(column.offsets)
        self.start = offsets - offsets[0]
        self.items = column.flatten()

    def field(self, name: str) -> pa.Array:
        return self.items.field(name)

    def scalars(self, name: str) -> np.ndarray:
        return self.field(name).to_numpy(zero_copy_only=False)

    def matrix(self, name: str) -> np.ndarray:
        """A vector field as rows; vectors of different lengths are an error."""
        field = self.field(name)
        if len(field) == 0:
            return np.zeros((0, 0))
        lengths = field.value_lengths().to_numpy(zero_copy_only=False)
        if not (lengths == lengths[0]).all():
            raise ValueError(f"vectors of different lengths: {np.unique(lengths[lengths == lengths]).tolist()}")
        return field.flatten().to_numpy(zero_copy_only=False).reshape(len(field), -1)

    def row_of(self) -> np.ndarray:
        """Batch row of every member."""
        return np.repeat(np.arange(len(self.start) - 1), np.diff(self.start))

    def small(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Rows of one block, many at a time: row numbers (R), member positions (R x m) and which of them are real.

        Rows of about the same size go together, the shorter ones padded.
        """
        one = np.flatnonzero(self.same)
        size = np.diff(self.start)[one]
        padded = 1 << np.ceil(np.log2(np.maximum(size, 1))).astype(int)
        for m in np.unique(padded):
            rows = one[padded == m]
            step = max(1, PADDED_CELLS // (m * m))
            for s in range(0, len(rows), step):
                r = rows[s:s + step]
                place = np.arange(m)[None, :]
                real = place < (self.start[r + 1] - self.start[r])[:, None]
                yield r, np.where(real, self.start[r][:, None] + place, 0), real

    def large(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Rows of two blocks: row number and the member positions of both sides."""
        side = self.scalars("side")
        for r in np.flatnonzero(~self.same):
            a, b = self.start[r], self.start[r + 1]
            yield r, a + np.flatnonzero(side[a:b] == 0), a + np.flatnonzero(side[a:b] == 1)


Kernel = Callable[[pa.RecordBatch, Members], tuple[np.ndarray, dict[str, pa.Array]]]


def map_blocks(pairs: DataFrame, by: Sequence[str], kernel: Kernel,
               out: list[T.StructField]) -> DataFrame:
    """Run ``kernel`` per Arrow batch of block pairs.

    It returns the batch row of every output row, and the output columns.
    """
    by = list(by)
    schema = T.StructType([pairs.schema[k] for k in by] + out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            rows, cols = kernel(batch, Members(batch))
            keys = [batch.column(k).take(pa.array(rows)) for k in by]
            yield pa.RecordBatch.from_arrays([*keys, *cols.values()], names=[*by, *cols])

    return pairs.mapInArrow(run, schema)


def angular_spread_kernel(batch: pa.RecordBatch, m: Members):
    """Squared angles of the other members to each member's held-out mean, summed.

    Payload: unit vector ``u``, ``g`` = u.T, and ``t`` = norm of T - u. The mean
    direction without h is (T - u_h) / (t_h + eps (K-1)), so u_i . mean_h needs
    only g_i and u_i.u_h. The scalars of a member pass through.
    """
    u, t, g = m.matrix("u"), m.scalars("t"), m.scalars("g")
    partial = np.zeros(len(t))
    for _, at, real in m.small():
        x = u[at]
        toward = _squared_angle(g[at][:, None, :] - x @ x.transpose(0, 2, 1), t[at])
        toward *= real[:, None, :] & ~np.eye(at.shape[1], dtype=bool)
        partial[at[real]] = toward.sum(axis=2)[real]
    for _, x, y in m.large():
        inner = u[x] @ u[y].T
        partial[x] += _squared_angle(g[y][None, :] - inner, t[x]).sum(axis=1)
        partial[y] += _squared_angle(g[x][None, :] - inner.T, t[y]).sum(axis=1)
    passed = {c: m.field(c) for c in ("member", "n_train", "train_di", "holdout_cosine")}
    return m.row_of(), {**passed, "partial": pa.array(partial)}


def _squared_angle(projection: np.ndarray, length: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(projection / length[..., None], -1.0, 1.0)) ** 2


def overlap_kernel(batch: pa.RecordBatch, m: Members):
    """Jaccard of index sets summed over the pairs of the row, and the number of pairs."""
    items = m.field("items")
    values, starts = items.flatten().to_numpy(), np.asarray(items.offsets)
    starts = starts - starts[0]
    member = np.zeros((len(items), int(values.max(initial=0)) + 1))
    member[np.repeat(np.arange(len(items)), np.diff(starts)), values] = 1.0
    size = member.sum(axis=1)
    total, count = np.zeros(batch.num_rows), np.zeros(batch.num_rows, dtype=np.int64)

    def ratios(both: np.ndarray, sx: np.ndarray, sy: np.ndarray) -> np.ndarray:
        union = sx + sy - both
        return np.divide(both, union, out=np.zeros_like(both), where=union > 0)

    for r, at, real in m.small():
        x = member[at]
        keep = real[:, :, None] & real[:, None, :] & np.triu(np.ones((at.shape[1],) * 2, dtype=bool), k=1)
        ratio = ratios(x @ x.transpose(0, 2, 1), size[at][:, :, None], size[at][:, None, :])
        total[r], count[r] = (ratio * keep).sum(axis=(1, 2)), keep.sum(axis=(1, 2))
    for r, x, y in m.large():
        ratio = ratios(member[x] @ member[y].T, size[x][:, None], size[y][None, :])
        total[r], count[r] = ratio.sum(), ratio.size
    return np.arange(batch.num_rows), {"partial": pa.array(total), "pairs": pa.array(count)}


def ordered_cosines(m: Members) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(batch row, lower level, higher level, cosine) of every pair of different levels, a bounded part at a time.

    Zero vectors give no pair.
    """
    u, n, level = m.matrix("u"), m.scalars("n"), m.scalars("level")
    fine = n > 0
    for r, at, real in m.small():
        x, ok = u[at], real & fine[at]
        k, i, j = np.nonzero((level[at][:, :, None] < level[at][:, None, :]) & ok[:, :, None] & ok[:, None, :])
        yield r[k], level[at[k, i]], level[at[k, j]], (x @ x.transpose(0, 2, 1))[k, i, j]
    for r, x, y in m.large():
        i, j = np.nonzero((level[x][:, None] != level[y][None, :]) & fine[x][:, None] & fine[y][None, :])
        first, second = level[x][i], level[y][j]
        yield np.full(len(i), r), np.minimum(first, second), np.maximum(first, second), (u[x] @ u[y].T)[i, j]


def ordered_cosine_kernel(batch: pa.RecordBatch, m: Members):
    """All of ``ordered_cosines`` as rows."""
    parts = list(ordered_cosines(m))
    rows, lo, hi, cosine = [np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, np.int64 if k == 0 else float) for k in range(4)]
    return rows, {"level_lo": pa.array(lo), "level_hi": pa.array(hi), "cosine": pa.array(cosine)}
