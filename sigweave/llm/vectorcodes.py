"""Vector compression to short codes with equal-average search.

A vector of whole numbers is cut into equal parts; every part position has a codebook of a few
entries, fitted by rounds of assignment and averaging. The nearest entry is found by
equal-average search: entries are sorted by component sum, and the search expands outward from
the part's own sum, the nearer side first. By Cauchy-Schwarz the squared distance is at least
the squared gap of the sums over the dimension, so a part stops where that bound strictly
exceeds its best distance; entries that could tie are still looked at. The search runs over all
parts of an Arrow batch at once, and all arithmetic is in integers: sums do not depend on the
order or the number of tasks, and a recomputed task returns the same rows.

Codebooks have a fixed size (parts x entries x part length), so they travel to the driver and
back with the task; vectors never do. A round reads the packed vectors once and returns one
row per task, part and entry.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.common import join_groups
from .common import settle

#: Keeps squared gaps of component sums inside 64-bit integers: 2 * part length * |component| stays below it.
LARGEST_GAP = 2**31
#: A table of group totals is broadcast if it has at most so many rows and bytes of keys.
BROADCAST_ROWS, BROADCAST_BYTES = 50_000, 4 << 20

Codebooks = dict[int, np.ndarray]  # by vector length: (parts, entries, part length)


def packed(vectors: DataFrame, key: str, vector: str, label: str | None, parts: int, scale: float) -> DataFrame:
    """_id, _label, _dim and _v: floor(scale * x) of each component as 32-bit integers.

    Rows whose vector is null or empty, holds null or non-finite components, or cannot be cut
    into ``parts`` equal parts take no part. A component too large for exact arithmetic is an error.
    """
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            size = np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False).astype(float)).astype(np.int64)
            x = np.floor(lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * scale)
            bad = np.bincount(np.repeat(np.arange(len(size)), size)[~np.isfinite(x)], minlength=len(size)) > 0
            good = (size > 0) & (size % parts == 0) & ~bad
            x, size = x[np.repeat(good, size)], size[good]
            if len(x) and (np.abs(x) * 2 * np.repeat(size // parts, size)).max() >= LARGEST_GAP:
                raise ValueError("a component is too large for exact codes")
            at = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
            if at[-1] * 4 >= 2**31:
                raise ValueError("a batch of vectors exceeds 2 GB; lower spark.sql.execution.arrow.maxRecordsPerBatch")
            values = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer((at * 4).astype(np.int32)), pa.py_buffer(x.astype("<i4"))])
            mask = pa.array(good)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask), pa.array(size, pa.int32()), values],
                                             names=["_id", "_label", "_dim", "_v"])

    given = vectors.select(F.col(key).cast("long").alias("_id"), (F.col(label) if label else F.lit(None).cast("int")).alias("_label"),
                           F.col(vector).cast("array<double>").alias("_x")).filter("_x IS NOT NULL")
    return given.mapInArrow(work, f"_id long, _label {given.schema['_label'].dataType.simpleString()}, _dim int, _v binary")


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of and squared distance to the nearest row of ``book`` for every row of ``x``, ties to the lower index."""
    n, width = x.shape
    sums = book.sum(1)
    order = np.argsort(sums, kind="stable")
    ladder, own = sums[order], x.sum(1)
    far = np.int64(LARGEST_GAP)
    right = np.searchsorted(ladder, own)
    left = right - 1
    best, at = np.full(n, np.iinfo(np.int64).max // max(1, width)), np.full(n, len(book))
    alive = np.arange(n)
    while len(alive):
        lower, upper = left[alive], right[alive]
        gap_left = np.where(lower >= 0, own[alive] - ladder[np.maximum(lower, 0)], far)
        gap_right = np.where(upper < len(book), ladder[np.minimum(upper, len(book) - 1)] - own[alive], far)
        gap = np.minimum(gap_left, gap_right)
        on = (gap < far) & (gap * gap <= best[alive] * width)
        alive, goes_left = alive[on], (gap_left < gap_right)[on]
        entry = order[np.where(goes_left, lower[on], upper[on])]
        distance = ((x[alive] - book[entry]) ** 2).sum(1)
        better = (distance < best[alive]) | ((distance == best[alive]) & (entry < at[alive]))
        best[alive[better]], at[alive[better]] = distance[better], entry[better]
        left[alive[goes_left]] -= 1
        right[alive[~goes_left]] += 1
    return at, best


def _by_length(batch: pa.RecordBatch, parts: int) -> Iterator[tuple[np.ndarray, int, np.ndarray]]:
    """(row numbers, length, integers of shape rows x parts x part length) of a batch, length by length."""
    dims = batch.column("_dim").to_numpy()
    for dim in np.unique(dims):
        rows = np.flatnonzero(dims == dim)
        flat = b"".join(batch.column("_v").take(pa.array(rows)).to_pylist())
        yield rows, int(dim), np.frombuffer(flat, "<i4").astype(np.int64).reshape(len(rows), parts, dim // parts)


def first_books(rows: DataFrame, parts: int, entries: int) -> Codebooks:
    """The parts of the vectors with the smallest different ids, ascending, for every vector length.

    Of rows that share an id, the one with the smallest packed bytes counts; rows without an id start no entry.
    """
    ids = rows.filter("_id IS NOT NULL").select("_dim", "_id").distinct()
    ids = ids.withColumn("_r", F.row_number().over(Window.partitionBy("_dim").orderBy("_id"))).filter(F.col("_r") <= entries)
    small = ids.groupBy("_dim").agg(F.max("_id").alias("_top"))
    seeds = rows.join(small, "_dim").filter(F.col("_id") <= F.col("_top")).groupBy("_dim", "_id").agg(F.min("_v").alias("_v")).collect()
    books: dict[int, list[np.ndarray]] = {}
    for r in sorted(seeds, key=lambda r: r["_id"]):
        books.setdefault(r["_dim"], []).append(np.frombuffer(bytes(r["_v"]), "<i4").astype(np.int64).reshape(parts, -1))
    return {dim: np.stack(found, axis=1) for dim, found in books.items()}


def averaged(rows: DataFrame, books: Codebooks, parts: int) -> Codebooks:
    """One round: every entry becomes the componentwise floor of the mean of the parts nearest to it; unused ones stay."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {dim: np.zeros_like(b) for dim, b in books.items()}
        counts = {dim: np.zeros(b.shape[:2], np.int64) for dim, b in books.items()}
        for batch in batches:
            for _, dim, x in _by_length(batch, parts):
                for p in range(parts if dim in books else 0):
                    at, _ = nearest(x[:, p], books[dim][p])
                    order = np.argsort(at, kind="stable")
                    used, starts = np.unique(at[order], return_index=True)
                    sums[dim][p, used] += np.add.reduceat(x[order, p], starts)
                    counts[dim][p] += np.bincount(at, minlength=books[dim].shape[1])
        for dim, c in counts.items():
            p, e = np.nonzero(c)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(p), dim), pa.int32()), pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(c[p, e], pa.int64()),
                 pa.array(list(sums[dim][p, e]), pa.list_(pa.int64()))], names=["_dim", "_p", "_e", "_n", "_s"])

    partial = rows.select("_dim", "_v").mapInArrow(work, "_dim int, _p int, _e int, _n long, _s array<long>")
    new = {dim: b.copy() for dim, b in books.items()}
    for dim, b in books.items():
        total = partial.filter(F.col("_dim") == dim).groupBy("_p", "_e").agg(
            F.sum("_n").alias("_n"), F.array(*[F.sum(F.get("_s", F.lit(i))) for i in range(b.shape[2])]).alias("_s"))
        for r in total.collect():
            new[dim][r["_p"], r["_e"]] = [s // r["_n"] for s in r["_s"]]
    return new


def fit(rows: DataFrame, *, parts: int, entries: int, rounds: int) -> Codebooks:
    """Codebooks of packed vectors, by vector length."""
    books = first_books(rows, parts, entries)
    for _ in range(rounds):
        books = averaged(rows, books, parts)
    return books


def digest(book: np.ndarray) -> str:
    """sha256 of the decimal components by part, entry and position, joined with commas."""
    return hashlib.sha256(",".join(map(str, book.ravel().tolist())).encode()).hexdigest()


def encode(rows: DataFrame, books: Codebooks, parts: int) -> DataFrame:
    """_id, _label, code (bytes, one index per part), error and codebooks_sha256 of packed vectors."""
    names = {dim: digest(b) for dim, b in books.items()}

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code, error = np.zeros((batch.num_rows, parts), np.uint8), np.zeros(batch.num_rows, np.int64)
            which = np.empty(batch.num_rows, object)
            for at, dim, x in _by_length(batch, parts):
                which[at] = names.get(dim)
                for p in range(parts if dim in books else 0):
                    index, distance = nearest(x[:, p], books[dim][p])
                    code[at, p] = index
                    error[at] += distance
            flat = code.tobytes()
            codes = [flat[i:i + parts] for i in range(0, len(flat), parts)]
            known = pa.array([w is not None for w in which], pa.bool_())
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id"), batch.column("_label"), pa.array(codes, pa.binary()), pa.array(error),
                 pa.array(which, pa.string())], names=["_id", "_label", "code", "error", "codebooks_sha256"]).filter(known)

    kind = rows.schema["_label"].dataType.simpleString()
    return rows.mapInArrow(work, f"_id long, _label {kind}, code binary, error long, codebooks_sha256 string")


def vector_codes(vectors: DataFrame, *, key: str = "vec_id", vector: str = "embedding", label: str | None = "label", parts: int = 8,
                 entries: int = 16, rounds: int = 6, scale: float = 4096.0) -> DataFrame:
    """key, label, code (bytes), error, label_error, codebooks_sha256 of every vector that takes part.

    Null and empty vectors, those with null or non-finite components, and those that cannot be
    cut into ``parts`` equal parts are left out. Vectors of each length have codebooks of their
    own. A table with fewer ids than ``entries`` has that many entries; a row with a null id is
    coded and averaged like any other but starts no entry, and if a length has no id at all its rows are
    left out. Repeated rows are coded each time and count each time, and start one entry. A null
    label is a label. An empty table gives an empty result; other columns are not kept.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code byte holds 1 to 256 entries")
    rows = settle(packed(vectors, key, vector, label, parts, scale))
    coded = settle(encode(rows, fit(rows, parts=parts, entries=entries, rounds=rounds), parts))
    totals = settle(coded.groupBy("_label").agg(F.sum("error").alias("label_error")))
    extent = totals.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length(F.col("_label").cast("string"))), F.lit(0)).alias("b")).first()
    if extent["n"] <= BROADCAST_ROWS and extent["b"] <= BROADCAST_BYTES:
        totals = F.broadcast(totals)
    out = join_groups(coded, totals, ["_label"])
    return out.select(F.col("_id").alias(key), *([F.col("_label").alias(label)] if label else []), "code", "error", "label_error", "codebooks_sha256")
