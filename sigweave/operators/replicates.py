"""Replicates of a bounded table by whole-replicate kernels.

Resampling is parallel over replicates. Where the resampled table is narrow and its counted
size is within ``INDEX_ROWS``, it travels to the tasks once, in key order,
as an *index*: rows of equal values share a *cell*, a row is the number of its cell, and every metric's value
order over the cells, with the bounds of its ties, is worked out once per
task. A replicate is then a vector of draw counts of the cells, and all its metrics follow from sums over
the fixed orders, for a block of replicates at a time. Nothing is exploded, joined or sorted per
replicate, and only the results leave the tasks. Beyond the bounds ``build`` gives None and
the caller takes its relational plan, which makes the same draws.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.draws import drawn_positions, hash_number, mixed, replicate_number
from .common import reuse

#: Size up to which a table travels to every task: rows (4 bytes each), and numbers of its distinct rows (8 bytes each).
INDEX_ROWS, INDEX_CELLS = 16_000_000, 32_000_000
#: Draw counts that a kernel holds at once: replicates of a block times rows of a group.
BLOCK_CELLS = 400_000


def key_order(df: DataFrame, key: str) -> list:
    """Order of the rows that positions refer to: a text key by a hash of it first."""
    text = isinstance(df.schema[key].dataType, T.StringType)
    return [*([hash_number(F.col(key))] if text else []), F.col(key)]


def group_tag(by: Sequence[str]) -> Column:
    """The keys of a group as they stand between the seed and the replicate in the text that is hashed."""
    return F.substring(F.concat_ws(":", F.lit("."), *[F.col(b).cast("string") for b in by]), 2, 1 << 30)


def tagged_numbers(seed: int, tag: str, reps: np.ndarray) -> np.ndarray:
    return np.array([replicate_number(f"{seed}{tag}:{r}") for r in reps], np.uint64)


@dataclass
class Order:
    """Rows of a group sorted by a value, missing ones left out, and where each distinct value starts."""
    rows: np.ndarray
    starts: np.ndarray

    @classmethod
    def of(cls, value: np.ndarray, present: np.ndarray, descending: bool = False) -> Order:
        rows = np.flatnonzero(present)
        rows = rows[np.argsort(-value[rows] if descending else value[rows], kind="stable")]
        x = value[rows]
        return cls(rows, np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, np.int64))

    def sums(self, weights: np.ndarray) -> np.ndarray:
        """Sums per distinct value of each row of ``weights``."""
        if not len(self.starts):
            return np.zeros((len(weights), 0))
        placed = np.take(weights, self.rows, axis=1).astype(np.float64, copy=False)
        return placed if len(self.starts) == len(self.rows) else np.add.reduceat(placed, self.starts, axis=1)

    def lengths(self) -> np.ndarray:
        """Rows of each distinct value."""
        return np.diff(np.append(self.starts, len(self.rows)))

    def ranks(self, weights: np.ndarray) -> np.ndarray:
        """Weighted mid-rank of every row; 0 where the value is missing."""
        w = self.sums(weights)
        mid = np.cumsum(w, axis=1)
        mid -= (w - 1) / 2
        out = np.zeros(weights.shape)
        if len(self.starts) == len(self.rows):
            out[:, self.rows] = mid
        else:
            out[:, self.rows] = np.repeat(mid, self.lengths(), axis=1)
        return out


@dataclass
class Group:
    """Rows of one group: their number, the text of its keys, the cell of each row in key order (None: every row is its
    own), and columns of the cells as float64, NaN where missing."""
    n: int
    tag: str
    columns: dict[str, np.ndarray]
    cell: np.ndarray | None = None
    orders: dict = field(default_factory=dict)
    spaces: dict = field(default_factory=dict)

    @classmethod
    def of(cls, n: int, tag: str, columns: dict[str, np.ndarray]) -> Group:
        """Rows in key order, those of equal values combined where that leaves at most half of them."""
        code = np.zeros(n, np.int64)
        for values in columns.values():
            distinct, own = np.unique(values, return_inverse=True)
            code, own = code * len(distinct), own.astype(np.int64, copy=False)
            code += own
            found, code = np.unique(code, return_inverse=True)
            if 2 * len(found) > n:
                return cls(n, tag, columns)
        first = np.zeros(int(code.max(initial=-1)) + 1, np.int64)
        first[code] = np.arange(n)
        return cls(n, tag, {c: v[first] for c, v in columns.items()}, code.astype(np.int32))

    @property
    def size(self) -> int:
        """Cells."""
        return self.n if self.cell is None else len(next(iter(self.columns.values())))

    def rows(self, column: str) -> np.ndarray:
        """A column of the rows, in key order."""
        v = self.columns[column]
        return v if self.cell is None else v[self.cell]

    def order(self, value: str, *needed: str, descending: bool = False) -> Order:
        """Value order over the rows that have the value and the ``needed`` columns; made once."""
        name = (value, needed, descending)
        if name not in self.orders:
            present = ~np.isnan(self.columns[value])
            for c in needed:
                present &= ~np.isnan(self.columns[c])
            self.orders[name] = Order.of(self.columns[value], present, descending)
            if len(self.columns) > 1 and needed and present.all():  # the same rows whatever else is needed
                self.orders[name] = self.orders.setdefault((value, (), descending), self.orders[name])
        return self.orders[name]

    def space(self, name: str, *shape: object) -> np.ndarray:
        """Memory that kernels use again from block to block (new pages cost more than the arithmetic): rows, columns, type."""
        rows, width, kind = *shape[:2], shape[2] if len(shape) > 2 else np.float64
        if name not in self.spaces or self.spaces[name].size < rows * width:
            self.spaces[name] = np.empty(rows * width, kind)
        return self.spaces[name][:rows * width].reshape(rows, width)

    def ties(self, order: Order) -> tuple[np.ndarray, np.ndarray]:
        """The last row of every distinct value, and of every row the number of its value; made once."""
        name = id(order)
        if name not in self.orders:
            self.orders[name] = np.append(order.starts[1:], len(order.rows)) - 1, np.repeat(np.arange(len(order.starts)), order.lengths())
        return self.orders[name]

    def within(self, order: Order, other: Order) -> np.ndarray:
        """Where the rows of one order, in turn, stand in another order of the same rows; made once."""
        name = (id(order), id(other))
        if name not in self.orders:
            place = np.empty(self.size, np.int64)
            place[other.rows] = np.arange(len(other.rows))
            self.orders[name] = place[order.rows]
        return self.orders[name]


@dataclass
class Index:
    """A bounded table by groups; ``keys`` has one row of grouping columns per group."""
    groups: list[Group]
    keys: pa.Table
    fields: list[T.StructField]


def build(df: DataFrame, key: str, columns: Sequence[str], by: Sequence[str] = ()) -> Index | None:
    """The index of a table, or None beyond the size bounds. ``columns`` must be numbers."""
    by = list(by)
    rows = reuse(df.select(*by, *[o.alias(f"_o{i}") for i, o in enumerate(key_order(df, key))],
                           *[F.col(c).cast("double").alias(f"_c{i}") for i, c in enumerate(columns)]))
    n = rows.count()
    if n > INDEX_ROWS:
        return None
    order = [c for c in rows.columns if c.startswith("_o")]
    sizes = rows.groupBy(*by, group_tag(by).alias("_tag")).agg(F.count(F.lit(1)).alias("_n"))
    keys = (sizes.orderBy(*by) if by else sizes).toArrow()
    ends = np.cumsum(keys.column("_n").to_numpy())
    t = rows.orderBy(*by, *order).select(*[f"_c{i}" for i in range(len(columns))]).toArrow()
    values = {c: t.column(f"_c{i}").to_numpy().astype(np.float64, copy=False) for i, c in enumerate(columns)}
    groups = [Group.of(int(e - s), tag, {c: v[s:e] for c, v in values.items()})
              for s, e, tag in zip(np.append(0, ends[:-1]), ends, keys.column("_tag").to_pylist(), strict=True)]
    if sum(g.size for g in groups) * len(columns) > INDEX_CELLS:
        return None
    return Index(groups, keys.select(by), [df.schema[b] for b in by])


def numbers(seed: int, group: Group, reps: np.ndarray) -> np.ndarray:
    return tagged_numbers(seed, group.tag, reps)


def draw_counts(seed: int, group: Group, reps: np.ndarray) -> np.ndarray:
    """How often each cell of the group is drawn, one row per replicate."""
    at = drawn_positions(numbers(seed, group, reps), group.n, group.cell)
    at += np.arange(len(reps))[:, None] * group.size
    return np.bincount(at.ravel(), minlength=len(reps) * group.size).reshape(len(reps), group.size)


def draw_order(seed: int, group: Group, reps: np.ndarray) -> np.ndarray:
    """A random order per replicate: draw and row as one number, so that no two rows tie."""
    return shuffle_keys(numbers(seed, group, reps), group.n)


def shuffle_keys(numbers: np.ndarray, n: int) -> np.ndarray:
    """Draw and position of each of n rows as one number, one row per replicate number."""
    slots = np.arange(n, dtype=np.uint64)[None, :]
    keys = mixed(np.asarray(numbers)[:, None], slots).astype(np.uint64)
    keys <<= np.uint64(31)
    keys |= slots
    return keys


Kernel = Callable[[Group, np.ndarray], dict[str, np.ndarray]]


def run(df: DataFrame, index: Index, reps: range, kernel: Kernel, schema: str) -> DataFrame:
    """(grouping columns, rep, columns of ``schema``): the kernel's rows for every group and replicate.

    The kernel takes a group and replicate numbers, and returns columns of equal length with
    "rep" among them; missing values are NaN.
    """
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(index)
    out = T.StructType([*index.fields, T.StructField("rep", T.LongType()), *T.StructType.fromDDL(schema).fields])
    names = out.fieldNames()
    doubles = {f.name for f in out.fields if isinstance(f.dataType, T.DoubleType)}

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for g, group in enumerate(table.groups):
                step = max(1, BLOCK_CELLS // max(1, group.n))
                for s in range(0, len(ids), step):
                    found = kernel(group, ids[s:s + step])
                    length = len(found["rep"])
                    keys = [table.keys.column(c).combine_chunks().take(pa.array(np.full(length, g))) for c in table.keys.column_names]
                    cols = [pa.array(found[c], from_pandas=c in doubles) for c in names[len(keys):]]
                    yield pa.RecordBatch.from_arrays([*keys, *cols], names=names)

    tasks = max(1, min(len(reps), 4 * spark.sparkContext.defaultParallelism))
    return spark.range(reps.start, reps.stop, 1, tasks).mapInArrow(work, out)


def _by_metric(reps: np.ndarray, found: dict[str, dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
    """Columns of several metrics, one after the other."""
    first = next(iter(found.values()))
    cols = {c: np.concatenate([f[c] for f in found.values()]) for c in first}
    return {"rep": np.tile(reps, len(found)).astype(np.int64), "metric": np.repeat(np.array(list(found), object), len(reps)), **cols}


def _ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.divide(a, b, out=np.full(np.broadcast(a, b).shape, np.nan), where=b > 0)


def roc_and_pr(seed: int, scores: Sequence[str], label: str) -> Kernel:
    """AUROC and average precision of each score; NaN where a replicate has one class only."""
    def kernel(group: Group, reps: np.ndarray) -> dict[str, np.ndarray]:
        w = draw_counts(seed, group, reps)
        positive = w * (group.columns[label] == 1)
        found = {}
        for s in scores:
            order = group.order(s, label, descending=True)
            p = order.sums(positive)
            q = order.sums(w) - p
            n_pos, n_neg = p.sum(1), q.sum(1)
            tp, fp = np.cumsum(p, axis=1), np.cumsum(q, axis=1)
            area = (p * (n_neg[:, None] - fp + q / 2)).sum(1)
            steps = np.divide(p * tp, tp + fp, out=np.zeros_like(p), where=tp + fp > 0).sum(1)
            both = (n_pos > 0) & (n_neg > 0)
            found[s] = {"auroc": _ratio(area, n_pos * n_neg), "auprc": np.where(both, _ratio(steps, n_pos), np.nan)}
        return _by_metric(reps, found)

    return kernel


def spearman(seed: int, xs: Sequence[str], y: str) -> Kernel:
    """Spearman of each x with y, draw counts as repeat counts.

    Ranks of y are worked out in the order of y; counts and ranks of y then are gathered in the order of x, where
    the ranks of x are running sums.
    """
    def kernel(group: Group, reps: np.ndarray) -> dict[str, np.ndarray]:
        w = draw_counts(seed, group, reps)
        found, side = {}, None
        for x in xs:
            a, b = group.order(x, y), group.order(y, x)
            if side is None or side[0] is not b:
                k = group.space("k", len(w), len(b.rows))
                k[:] = w if len(b.rows) == 0 else np.take(w, b.rows, axis=1, out=group.space("w", len(w), len(b.rows), np.int64), mode="clip")
                side = (b, k, *_centred(group, "y", k, b))
            _, k, ry, yy = side
            at = group.within(a, b)
            kx = np.take(k, at, axis=1, out=group.space("kx", *k.shape), mode="clip")
            rx, xx = _centred(group, "x", kx, a)
            kx *= rx
            xy = np.vecdot(kx, np.take(ry, at, axis=1, out=group.space("rx", *k.shape), mode="clip"))
            found[x] = {"rho": _ratio(xy, np.sqrt(xx * yy))}
        return _by_metric(reps, found)

    return kernel


def _centred(group: Group, name: str, k: np.ndarray, order: Order) -> tuple[np.ndarray, np.ndarray]:
    """Of counts in the value order: mid-ranks less their mean, and the weighted sum of their squares, one row per replicate."""
    plain = len(order.starts) == len(order.rows)
    sums = np.cumsum(k, axis=1, out=group.space("sums", *k.shape))
    if not plain:  # at the last row of every distinct value
        ends, of = group.ties(order)
        sums = np.take(sums, ends, axis=1, out=group.space("ends", len(k), len(ends)), mode="clip")
    rank, ties = (group.space(f"{part} {name}", *sums.shape) for part in ("rank", "ties"))
    if sums.shape[1]:
        rank[:, :1], ties[:, :1] = sums[:, :1], sums[:, :1]
        np.add(sums[:, 1:], sums[:, :-1], out=rank[:, 1:])
        np.subtract(sums[:, 1:], sums[:, :-1], out=ties[:, 1:])
        rank -= sums[:, -1:]
        rank *= 0.5
    ties *= rank
    squares = np.vecdot(ties, rank)
    if not plain:
        rank = np.take(rank, of, axis=1, out=group.space(f"rows {name}", *k.shape), mode="clip")
    return rank, squares


def one_vs_rest(seed: int, scores: Sequence[str], cls: str) -> Kernel:
    """Mean over the classes (numbers in column ``cls``) of the AUROC of the class against all other rows.

    Rows without a number belong to the others only. A class with fewer than 2 draws, or with
    all of them, is skipped in that replicate.
    """
    def kernel(group: Group, reps: np.ndarray) -> dict[str, np.ndarray]:
        w = draw_counts(seed, group, reps)
        found = {}
        for s in scores:
            order, own = group.order(s), group.order(cls, s)
            n_own, sums = own.sums(w), own.sums(w * order.ranks(w))
            n_rest = order.sums(w).sum(1, keepdims=True) - n_own
            area = _ratio(sums - n_own * (n_own + 1) / 2, n_own * n_rest)
            area[n_own < 2] = np.nan
            valid = ~np.isnan(area)
            found[s] = {"macro_auroc": _ratio(np.where(valid, area, 0).sum(1), valid.sum(1))}
        return _by_metric(reps, found)

    return kernel


def moments(seed: int, value: str) -> Kernel:
    """n, mean and sample variance of the drawn values, around the group's mean so that squares do not cancel."""
    def kernel(group: Group, reps: np.ndarray) -> dict[str, np.ndarray]:
        v = group.columns[value]
        w, n, mu = draw_counts(seed, group, reps).astype(np.float64), float(group.n), group.rows(value).mean()
        s, q = w @ (v - mu), w @ (v - mu) ** 2
        var = (q - s * s / n) / (n - 1) if n > 1 else np.full(len(reps), np.nan)
        return {"rep": reps.astype(np.int64), "n": np.full(len(reps), group.n), "mean": mu + s / n, "var": var}

    return kernel


def label_shuffle(seed: int, value: str, label: str) -> Kernel:
    """Difference of group means under permuted labels: the first n1 rows of a random order are group 1."""
    def kernel(group: Group, reps: np.ndarray) -> dict[str, np.ndarray]:
        v, n1 = group.rows(value), int((group.rows(label) == 1).sum())
        if not 0 < n1 < group.n:
            return {"rep": reps.astype(np.int64), "stat": np.full(len(reps), np.nan)}
        order = np.argpartition(draw_order(seed, group, reps), n1 - 1, axis=1)
        ones = v[order[:, :n1]].sum(1)
        return {"rep": reps.astype(np.int64), "stat": ones / n1 - (v.sum() - ones) / (group.n - n1)}

    return kernel


def midranks(values: np.ndarray) -> np.ndarray:
    """Mid-ranks along each row."""
    order = np.argsort(values, axis=1, kind="stable")
    x = np.take_along_axis(values, order, 1)
    at = np.broadcast_to(np.arange(values.shape[1]), values.shape)
    edge = np.ones((len(values), 1), bool)
    new = np.hstack([edge, x[:, 1:] != x[:, :-1]])[:, :values.shape[1]]
    first = np.maximum.accumulate(np.where(new, at, 0), axis=1)
    ends = np.hstack([new[:, 1:], edge])[:, :values.shape[1]]
    last = np.minimum.accumulate(np.where(ends, at, values.shape[1])[:, ::-1], axis=1)[:, ::-1]
    out = np.empty(values.shape)
    np.put_along_axis(out, order, (first + last) / 2 + 1, 1)
    return out


def row_correlations(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Pearson correlation of the rows of two matrices; NaN where one is constant."""
    a, b = a - a.mean(1, keepdims=True), b - b.mean(1, keepdims=True)
    return _ratio((a * b).sum(1), np.sqrt((a * a).sum(1) * (b * b).sum(1)))


def shuffled_blocks(own: np.ndarray, other: np.ndarray, numbers: np.ndarray, *, zero: float, eps: float) -> Iterator[tuple[slice, np.ndarray]]:
    """Cosine of every row of ``own`` with the row of ``other`` that a replicate's random order deals to it.

    Some replicates at a time: which, and their cosines. With fewer rows than replicates all cosines are worked out
    once, as one block product, and replicates gather single numbers; else each replicate takes its products alone.
    A vector whose norm is at most ``eps`` gives ``zero``.
    """
    n = len(own)

    def unit(x: np.ndarray) -> np.ndarray:
        norm = np.linalg.norm(x, axis=1, keepdims=True)
        return np.divide(x, norm, out=np.full(x.shape, np.nan), where=norm > eps)

    a, b = unit(own), unit(other)
    whole = a @ b.T if n <= len(numbers) else None
    step = max(1, BLOCK_CELLS // max(1, n))
    for s in range(0, len(numbers), step):
        keys = shuffle_keys(numbers[s:s + step], n)
        keys.sort(axis=1)
        order = (keys & np.uint64(2**31 - 1)).view(np.int64)  # the row that comes k-th is dealt row k of ``other``
        cos = np.empty(order.shape)
        for i, rows in enumerate(order):
            cos[i, rows] = whole[rows, np.arange(n)] if whole is not None else np.einsum("ij,ij->i", a[rows], b)
        yield slice(s, s + len(order)), np.where(np.isnan(cos), zero, cos)


def shuffled_cosines(own: np.ndarray, other: np.ndarray, numbers: np.ndarray, *, zero: float, eps: float) -> np.ndarray:
    """``shuffled_blocks`` of all replicates, one row each."""
    return np.concatenate([cos for _, cos in shuffled_blocks(own, other, numbers, zero=zero, eps=eps)])
