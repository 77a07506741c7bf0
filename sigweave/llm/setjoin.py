"""N-gram Jaccard join by a size-aware heavy-light split.

A document is its set of word shingles, as 64-bit hashes; equal sets collapse to one row first.
Two sets of sizes s and t are linked if they share o(s, t) shingles, a number that their sizes
and the threshold give. Sets up to a boundary size are *light*: each enumerates, for every size
that a partner may have, its subsets of exactly o(s, t) shingles, and two light sets are linked
if and only if they name a common subset. Larger sets are *heavy*: their shingles are kept in
inverted lists, and a heavy set is compared with the members of the lists that it scans. A pair
at the threshold shares one of the first s - ceil(share * s) + 1 shingles of either set in any
common order, so only these enter lists; the order puts shingles that many documents share
last, which keeps lists short and changes no result. The boundary is the size at which the
enumeration, counted exactly, shuffles more rows than the scan, measured on the lists.

No list is ever expanded into pairs. Members of a list are tried against its leader first (the
member with the most company over all lists), which joins a group of thousands of copies with
one comparison a member. Lists that then lie in one component are done. In the others, members
of different components with fitting sizes compare parity bitmaps: the bits in which two
bitmaps differ never exceed the shingles in which the sets differ, so the test drops no link.
Each member that is left tries its closest partner; what still faces a possible partner brings
its whole set to the list, where all pairs are counted exactly in blocks of bounded size.
Every link is confirmed on whole sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import TEXT_BATCH_ROWS, arrow_map, settle, whole_text
from .neardup import exact_links, full_sets, labelled, shingle_sets

#: Sizes up to this one may be light: beyond it subsets outnumber any scan.
LIGHT_MOST = 40
#: Rows shuffled for a subset, for a list entry, and for an entry of a list with company.
SUBSET_ROWS, ENTRY_ROWS, SHARED_ROWS = 2, 2, 8
#: Shingles looked at together when frequent ones are counted, and the count from which one of them is noted.
COUNTED_TOGETHER, NOTED = 4_000_000, 8
#: Shingles that the common order puts last, most frequent last: a bound on what is broadcast, not on results.
FREQUENT = 1 << 18
#: Members and shingles of a block of a list.
BLOCK_MEMBERS, BLOCK_SHINGLES = 512, 1 << 19
#: Partners that one copy of a hub's text serves when links are confirmed.
HUB_PARTNERS = 128
MEETING = ["_node", "_x", "_y"]


def overlap(s: int, t: int, percent: int) -> int:
    """Least number of common shingles at which sets of these sizes are linked."""
    return -(-percent * (s + t) // (100 + percent))


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def partner_sizes(n: int, percent: int) -> range:
    return range(-(-percent * n // 100), 100 * n // percent + 1)


def subset_count(n: int, percent: int) -> int:
    """Subsets that a light set of this size names, over all sizes of partners."""
    sizes = [(overlap(n, t, percent), t) for t in partner_sizes(n, percent)]
    return sum(comb(n, o) for o, t in sizes if o <= min(n, t) and not (t == n and o == n))


def frequent_shingles(docs: DataFrame, text: str, width: int) -> np.ndarray:
    """Up to FREQUENT of the most frequent shingles, the rarest of them first.

    Every task counts documents per shingle over stretches of its rows and reports those that
    occur NOTED times within a stretch; Spark adds the reports up.
    """
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def report() -> pa.RecordBatch:
            tokens, counts = np.unique(np.concatenate([*held, np.zeros(0, np.uint64)]), return_counts=True)
            often = counts >= NOTED
            return pa.RecordBatch.from_arrays([pa.array(tokens[often].view(np.int64)), pa.array(counts[often], pa.int64())], names=["_t", "_c"])

        for batch in batches:
            for start in range(0, batch.num_rows, TEXT_BATCH_ROWS):
                sets = shingle_sets(batch.column(0).slice(start, TEXT_BATCH_ROWS).to_pylist(), width)
                held += sets
                size += sum(map(len, sets))
                if size >= COUNTED_TOGETHER:
                    yield report()
                    held, size = [], 0
        yield report()

    noted = docs.select(whole_text(text).alias("_text")).mapInArrow(work, "_t long, _c long").groupBy("_t").agg(F.sum("_c").alias("_c"))
    top = noted.orderBy(F.desc("_c"), "_t").limit(FREQUENT).select("_t").toPandas()["_t"].to_numpy()
    return top[::-1].astype(np.int64).view(np.uint64)


def in_order(tokens: np.ndarray, wanted: int, names: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The first ``wanted`` shingles of a set (ascending) in the common order.

    ``names`` are the frequent shingles, ascending, and ``places`` their places in the order.
    """
    def place(part: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(names, part), len(names) - 1)
        return np.where(names[at] == part, places[at], -1)

    if not len(names):
        return tokens[:wanted]
    head = tokens[:2 * wanted]
    rare = head[place(head) < 0]
    if len(rare) < wanted:
        every = place(tokens)
        often = np.flatnonzero(every >= 0)
        rare = np.concatenate([tokens[every < 0], tokens[often[np.argsort(every[often])]]])
    return rare[:wanted]


def parity_bits(tokens: np.ndarray) -> tuple[bytes, bytes]:
    """Bitmap in which a shingle flips one bit, four to eight bits a shingle (a power of two, 256
    at least), and the same folded to an eighth of its length."""
    bits = max(256, 1 << (4 * len(tokens) - 1).bit_length())
    flips = np.bincount((tokens >> np.uint64(20) & np.uint64(bits - 1)).astype(np.int64), minlength=bits)
    packed = np.packbits((flips & 1).astype(np.uint8), bitorder="little")
    return packed.tobytes(), np.bitwise_xor.reduce(packed.reshape(8, -1), axis=0).tobytes()


def fingerprints(docs: DataFrame, key: str, text: str, width: int, percent: int, frequent: np.ndarray) -> DataFrame:
    """_id, n_shingles, _set (hash of the set, null if empty), _first (shingles in the common order), _bits and _small.

    _first holds what enters inverted lists, and the whole set where it may be light.
    """
    order = np.argsort(frequent)
    shared = docs.sparkSession.sparkContext.broadcast((frequent[order], order))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        names, places = shared.value
        sets = shingle_sets(batch.column(1).to_pylist(), width)
        digests = [hashlib.blake2b(t.tobytes(), digest_size=16).digest() if len(t) else None for t in sets]
        first = [in_order(t, len(t) if len(t) <= LIGHT_MOST else prefix_length(len(t), percent), names, places).view(np.int64) if len(t) else None
                 for t in sets]
        bits = [parity_bits(t) if len(t) else (None, None) for t in sets]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([len(t) for t in sets], pa.int64()), pa.array(digests, pa.binary()), pa.array(first, pa.list_(pa.int64())),
             pa.array([b for b, _ in bits], pa.binary()), pa.array([b for _, b in bits], pa.binary())],
            names=["_id", "n_shingles", "_set", "_first", "_bits", "_small"])

    frame = docs.select(F.col(key).cast("long").alias("_id"), whole_text(text).alias("_text"))
    return arrow_map(frame, work, "_id long, n_shingles long, _set binary, _first array<long>, _bits binary, _small binary")


def inverted_lists(sets: DataFrame, percent: int) -> DataFrame:
    """(_node, _id, _n, _m): the entries of lists with two members and more; _m is the list's length."""
    length = F.col("_n") - F.ceil(F.col("_n") * percent / F.lit(100.0)) + 1
    entries = sets.select("_id", "_n", F.explode(F.slice("_first", F.lit(1), length.cast("int"))).alias("_node"))
    shared = entries.groupBy("_node").agg(F.count("*").alias("_m")).filter("_m > 1")
    return entries.join(shared, "_node").select("_node", "_id", "_n", "_m")


def boundary(sets: DataFrame, lists: DataFrame, percent: int) -> int:
    """Largest light size: the one that minimises the rows to shuffle, of subsets up to it and of list entries above it."""
    small = {r["_n"]: r["c"] for r in sets.filter(F.col("_n") <= LIGHT_MOST).groupBy("_n").agg(F.count("*").alias("c")).collect()}
    shared = {r["_n"]: r["c"] for r in lists.filter(F.col("_n") <= LIGHT_MOST).groupBy("_n").agg(F.count("*").alias("c")).collect()}
    light = np.cumsum([0] + [SUBSET_ROWS * small.get(n, 0) * subset_count(n, percent) for n in range(1, LIGHT_MOST + 1)])
    heavy = [ENTRY_ROWS * small.get(n, 0) * prefix_length(n, percent) + SHARED_ROWS * shared.get(n, 0) for n in range(1, LIGHT_MOST + 1)]
    above = np.concatenate([np.cumsum(heavy[::-1])[::-1], [0]])
    best = np.flatnonzero(light + above == (light + above).min())
    return int(best[-1])


def light_pairs(sets: DataFrame, most: int, percent: int) -> DataFrame:
    """Pairs (a, b) that connect the light sets naming a common subset: to the least set on the other side.

    A subset's key is the sum of its shingles with the two sizes mixed in, so a set derives
    it from its total by taking out what is left over.
    """
    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, keys, sides = [], [], []
        for i, first in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            tokens = np.sort(first.values.to_numpy().view(np.uint64))
            n, total = len(tokens), tokens.sum(dtype=np.uint64)
            for t in partner_sizes(n, percent):
                common = overlap(n, t, percent)
                if t > most or common > min(n, t) or common == n == t:
                    continue
                out = np.array(list(combinations(range(n), n - common)), np.int64).reshape(comb(n, common), n - common)
                sums = total - tokens[out].sum(1, dtype=np.uint64)
                sizes = np.uint64(max(n, t) * (LIGHT_MOST + 1) + min(n, t))
                found = (sums ^ (sums >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + sizes
                ids.append(np.full(len(found), i))
                keys.append(found.view(np.int64))
                sides.append(np.full(len(found), 2 if n == t else int(n < t), np.int32))
        none = np.zeros(0, np.int64)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([*ids, none])), pa.array(np.concatenate([*keys, none])),
                                           pa.array(np.concatenate([*sides, none]).astype(np.int32))], names=["_id", "_k", "_side"])

    small = sets.filter(F.col("_n") <= most).select("_id", "_first")
    named = arrow_map(small, work, "_id long, _k long, _side int")
    least = named.groupBy("_k").agg(F.count("*").alias("_c"), *[F.min(F.when(F.col("_side") == s, F.col("_id"))).alias(f"_l{s}") for s in range(3)])
    other = F.when(F.col("_side") == 0, F.col("_l1")).when(F.col("_side") == 1, F.col("_l0")).otherwise(F.col("_l2"))
    return as_pairs(named.join(least.filter("_c > 1"), "_k"), F.col("_id"), other)


def as_pairs(rows: DataFrame, x: Column, y: Column) -> DataFrame:
    """Different (a, b) with a < b."""
    return rows.select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).filter("a < b").distinct()


def leader_pairs(lists: DataFrame, percent: int) -> DataFrame:
    """Pairs of every list member with the list's leader, the member with the most company in all its lists, where their sizes fit."""
    company = lists.groupBy("_id").agg(F.sum("_m").alias("_w"))
    leaders = lists.join(company, "_id").groupBy("_node").agg(F.max(F.struct("_w", (-F.col("_id")).alias("i"), "_n")).alias("_top"))
    fits = F.least("_n", "_top._n") * 100 >= F.greatest("_n", "_top._n") * percent
    return as_pairs(lists.join(leaders, "_node").filter(fits), F.col("_id"), -F.col("_top.i"))


def differing(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """Bits in which the bitmaps of each pair differ, the longer one folded to the shorter."""
    out = np.zeros(len(a), np.int64)
    sizes = np.array([(len(x), len(y)) for x, y in zip(a, b, strict=True)]).reshape(-1, 2)
    for la, lb in np.unique(sizes, axis=0):
        at = np.flatnonzero((sizes == (la, lb)).all(1))
        x = np.frombuffer(b"".join(a[i] for i in at), np.uint8).reshape(len(at), la)
        y = np.frombuffer(b"".join(b[i] for i in at), np.uint8).reshape(len(at), lb)
        low = min(la, lb)
        fold = lambda z: np.bitwise_xor.reduce(z.reshape(len(z), -1, low), axis=1)  # noqa: E731, B023
        out[at] = np.bitwise_count(fold(x) ^ fold(y)).sum(1, dtype=np.int64)
    return out


def may_link(differ: np.ndarray, s: np.ndarray, t: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of these sizes that differ in at least so many shingles can reach the threshold."""
    return (s + t - differ) * (100 + percent) >= 2 * percent * (s + t)


def plausible(pairs: DataFrame, sets: DataFrame, percent: int, bits: str) -> DataFrame:
    """The pairs whose sizes fit and whose bitmaps (column ``bits``) do not rule them out."""
    both = pairs
    for c in ("a", "b"):
        both = both.join(sets.select(F.col("_id").alias(c), F.col("_n").alias(f"_n{c}"), F.col(bits).alias(f"_b{c}")), c)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        s, t = batch.column(2).to_numpy(), batch.column(3).to_numpy()
        differ = differing(batch.column(4).to_pylist(), batch.column(5).to_pylist())
        return batch.select([0, 1]).filter(pa.array(may_link(differ, s, t, percent)))

    return arrow_map(both.select("a", "b", "_na", "_nb", "_ba", "_bb"), work, "a long, b long", rows=4096)


def confirmed(pairs: DataFrame, docs: DataFrame, key: str, text: str, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole sets reach the threshold.

    The end of a pair that has more pairs is its hub. Rows are sorted so that a hub's text comes
    before its partners' texts; a hub with many partners is dealt over several tasks, each
    with its text once.
    """
    ends = pairs.select(F.explode(F.array("a", "b")).alias("_id")).groupBy("_id").agg(F.count("*").alias("_w"))
    known = pairs
    for c in ("a", "b"):
        known = known.join(ends.select(F.col("_id").alias(c), F.col("_w").alias(f"_w{c}")), c)
    first = F.col("_wa") >= F.col("_wb")
    dealt = settle(known.select(
        F.when(first, F.col("a")).otherwise(F.col("b")).alias("_hub"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("_id"),
        F.ceil(F.greatest("_wa", "_wb") / HUB_PARTNERS).cast("int").alias("_parts")).withColumn(
            "_part", F.pmod(F.xxhash64("_id", F.lit(5)), F.col("_parts")).cast("int")))
    hubs = dealt.select("_hub", F.col("_hub").alias("_id"), "_part", F.lit(0).alias("_turn")).distinct()
    rows = hubs.unionByName(dealt.select("_hub", "_id", "_part", F.lit(1).alias("_turn")))
    texts = docs.select(F.col(key).cast("long").alias("_id"), whole_text(text).alias("_t")).filter(F.col("_id").isNotNull())
    sorted_ = texts.join(rows, "_id").select("_hub", "_part", "_turn", "_id", "_t").repartition("_hub", "_part").sortWithinPartitions(
        "_hub", "_part", "_turn", "_id")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub = np.zeros(0, np.uint64)
        for whole in batches:
            for start in range(0, whole.num_rows, TEXT_BATCH_ROWS):
                batch = whole.slice(start, TEXT_BATCH_ROWS)
                turn, good = batch.column(2).to_pylist(), []
                for t, own in zip(turn, shingle_sets(batch.column(4).to_pylist(), width), strict=True):
                    if t == 0:
                        hub = own
                    both = len(np.intersect1d(hub, own, assume_unique=True)) if t else 0
                    good.append(both > 0 and 100 * both >= percent * (len(hub) + len(own) - both))
                yield batch.select([0, 3]).rename_columns(["_hub", "_id"]).filter(pa.array(good, pa.bool_()))

    found = sorted_.mapInArrow(work, "_hub long, _id long")
    return as_pairs(found, F.col("_hub"), F.col("_id"))


def mixed_lists(lists: DataFrame, placed: DataFrame) -> DataFrame:
    """Entries of the lists whose members lie in more than one component, with the component."""
    rows = lists.join(placed, "_id")
    mixed = rows.groupBy("_node").agg(F.min("_component").alias("_lo"), F.max("_component").alias("_hi")).filter("_lo <> _hi")
    return rows.join(mixed.select("_node"), "_node", "left_semi")


def meetings(lists: DataFrame) -> DataFrame:
    """Members dealt into pairs of blocks: _x, _y and the member's _side there (2: the block meets itself)."""
    extent = lists.groupBy("_node").agg(F.count("*").alias("_c"), F.sum("_n").alias("_s"))
    blocks = F.ceil(F.greatest(F.col("_c") / BLOCK_MEMBERS, F.col("_s") / BLOCK_SHINGLES)).cast("int")
    dealt = lists.join(extent.select("_node", blocks.alias("_k")), "_node").withColumn("_b", F.pmod(F.xxhash64("_id", F.lit(3)), "_k").cast("int"))
    return dealt.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_k") - 1))).withColumns({
        "_x": F.least("_b", "_o"), "_y": F.greatest("_b", "_o"),
        "_side": F.when(F.col("_b") == F.col("_o"), 2).when(F.col("_b") < F.col("_o"), 0).otherwise(1)}).drop("_b", "_o", "_k")


def list_pairs(batch: pa.RecordBatch, light: int, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers (i, j) of the pairs of one meeting, component by component apart and of fitting sizes.

    Rows come sorted by meeting and size, so a row meets the next ones until the size no longer fits.
    """
    col = {c: batch.column(c).to_numpy() for c in (*MEETING, "_n", "_component", "_side")}
    starts = np.flatnonzero(np.concatenate([[True], np.any([np.diff(col[c]) != 0 for c in MEETING], axis=0)]))
    last = np.repeat(np.append(starts[1:], batch.num_rows), np.diff(np.append(starts, batch.num_rows)))
    i, step = np.arange(batch.num_rows), 0
    while len(i):
        step += 1
        i = i[i + step < last[i]]
        i = i[col["_n"][i] * 100 >= col["_n"][i + step] * percent]
        j = i + step
        fits = (col["_component"][i] != col["_component"][j]) & (col["_n"][j] > light) & ((col["_side"][i] == 2) | (col["_side"][i] != col["_side"][j]))
        if fits.any():
            yield i[fits], j[fits]


def by_meeting(rows: DataFrame, work: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """``work`` over Arrow batches of whole meetings, sorted by meeting and size."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if held is not None:
                batch = pa.concat_batches([held, batch])
            key = np.stack([batch.column(c).to_numpy() for c in MEETING])
            ends = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0))
            cut = int(ends[-1]) + 1 if len(ends) else 0
            held = batch.slice(cut)
            if cut:
                yield work(batch.slice(0, cut))
        if held is not None and held.num_rows:
            yield work(held)

    return rows.repartition(*MEETING).sortWithinPartitions(*MEETING, "_n", "_id").mapInArrow(run, schema)


OPEN = "_node long, _x int, _y int, _side int, _id long, _n long"
OPEN_COLUMNS = [c.split()[0] for c in OPEN.split(", ")]


def closest(rows: DataFrame, light: int, percent: int, bits: str) -> DataFrame:
    """Members with a partner of another component and of a fitting size that bitmaps (column
    ``bits``) do not rule out, and the closest of them (_partner)."""
    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        n, ids, maps = batch.column("_n").to_numpy(), batch.column("_id").to_numpy(), batch.column(bits).to_pylist()
        gap, partner = np.full(batch.num_rows, np.inf), np.zeros(batch.num_rows, np.int64)
        for i, j in list_pairs(batch, light, percent):
            for at in range(0, len(i), 4096):
                a, b = i[at:at + 4096], j[at:at + 4096]
                differ = differing([maps[k] for k in a], [maps[k] for k in b])
                good = may_link(differ, n[a], n[b], percent)
                a, b, share = a[good], b[good], (differ / (n[a] + n[b]))[good]
                for x, y in ((a, b), (b, a)):  # within one step every row occurs once on each side
                    nearer = share < gap[x]
                    gap[x[nearer]], partner[x[nearer]] = share[nearer], ids[y[nearer]]
        out = batch.select(OPEN_COLUMNS)
        return pa.RecordBatch.from_arrays([*out.columns, pa.array(partner)], names=[*OPEN_COLUMNS, "_partner"]).filter(pa.array(np.isfinite(gap)))

    return by_meeting(rows.select(*OPEN_COLUMNS, "_component", bits), work, OPEN + ", _partner long")


def jaccard_join(docs: DataFrame, *, key: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """Per document: key, n_shingles, component_id.

    Documents are linked if their shingle sets overlap by ``percent`` (1 to 100) of their union
    at least; component_id is the smallest key reachable over links. Null and empty texts, and
    texts without words, have no shingles and no links; rows with a null key have no component.
    Rows that repeat a key are one document (its text must be the same) and are all returned.
    An empty table gives an empty result; other columns are not kept.
    """
    prints = settle(fingerprints(docs, key, text, width, percent, frequent_shingles(docs, text, width)))
    known = prints.filter(F.col("_set").isNotNull() & F.col("_id").isNotNull())
    sets = settle(known.groupBy("_set").agg(
        F.min("_id").alias("_id"), F.any_value("n_shingles").alias("_n"), *[F.any_value(c).alias(c) for c in ("_first", "_bits", "_small")]))
    lists = settle(inverted_lists(sets, percent))
    light = boundary(sets, lists, percent)
    lists = lists.filter(F.col("_n") >= -(-percent * (light + 1) // 100))
    given = leader_pairs(lists, percent).unionByName(light_pairs(sets, light, percent)).distinct()
    tried = settle(plausible(settle(plausible(given, sets, percent, "_small")), sets, percent, "_bits"))
    links = settle(confirmed(tried, docs, key, text, width, percent))

    def bitmaps(column: str) -> DataFrame:
        return sets.select("_id", column)

    def placed_by(links: DataFrame) -> DataFrame:
        return settle(labelled(sets.select("_id"), links))

    final = placed_by(links)
    mixed = mixed_lists(lists, final).join(bitmaps("_small"), "_id")
    left = settle(closest(meetings(mixed), light, percent, "_small").drop("_partner"))
    left = settle(closest(left.join(bitmaps("_bits"), "_id").join(final, "_id"), light, percent, "_bits"))
    more = as_pairs(left, F.col("_id"), F.col("_partner")).join(tried, ["a", "b"], "left_anti")
    more = settle(confirmed(more, docs, key, text, width, percent))
    if not more.isEmpty():
        links = links.unionByName(more)
        final = placed_by(links)
    rows = mixed_lists(left.drop("_partner"), final)
    last = settle(closest(rows.join(bitmaps("_bits"), "_id"), light, percent, "_bits").drop("_partner", "_n").join(final, "_id"))
    exact = settle(exact_links(last.join(full_sets(last.select("_id"), docs, key, text, width), "_id"), percent))
    if not exact.isEmpty():
        final = placed_by(links.unionByName(exact))
    of_set = sets.select(F.col("_set").alias("_s"), "_id").join(final, "_id").select("_s", "_component")
    out = prints.join(of_set, F.col("_set") == F.col("_s"), "left")
    return out.select(F.col("_id").alias(key), "n_shingles", F.when(F.col("_id").isNotNull(), F.coalesce("_component", "_id")).alias("component_id"))
