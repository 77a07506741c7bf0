"""MinHash near-duplicates by chosen-path set similarity join.

A document is its set of word shingles, as 64-bit hashes. Equal sets collapse to one row
first. Each of several independent trees sends a set down by its minwise token under the
tree's hash function of that level, so two sets with similarity s stay together with
probability s per level. A node that is small is compared exhaustively; a large one branches
again, down to a last level where it is compared in bounded blocks.

Comparing starts with stars: every set of a node is tried against the node's leader, the
member that stands in the largest nodes over all trees (the least edited copy of a group,
as a rule), so a group of thousands of copies costs one comparison per member and not per
pair. A star pair is first held against its minwise signatures, with a margin that a similar
pair misses with a probability below 1e-8, then confirmed on the full sets, which travel to
the confirming task once per pair. Confirmed links join sets into components.

What is left are pairs of one node in different components. Members that still have such a
partner by signature, in the first node that the two share, bring their full sets to the node
(in blocks, where it is large). There all pairs are compared exactly by counting shared
shingles over postings, and the links of a spanning forest are returned: rows stay linear in
the members, however many pairs there are.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, settle, whole_text

#: Levels per branching step, branching steps and trees: a pair at 0.85 stays together over
#: two levels with probability 0.72, over four with 0.52; sixteen trees miss it with 1e-9
#: and 7e-6. At 0.8 the figures are 5e-8 and 2e-4.
STEP, STEPS, TREES = 2, 2, 16
LEVELS = STEP * STEPS
SIGNATURE = TREES * LEVELS
SMALL_NODE = 64  # members of a node that is compared in one piece
BLOCK = 1024  # members of a block where the last level is still large
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (two multiply-xorshift rounds)."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _constants() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte values, powers of an odd base and odd multipliers, all from one counter."""
    bytes_ = _mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * _GOLDEN)
    multipliers = _mix((np.arange(SIGNATURE, dtype=np.uint64) + np.uint64(1000)) * _GOLDEN) | np.uint64(1)
    base = np.array([0x2545F4914F6CDD1D], np.uint64)
    return bytes_, base, multipliers


BYTE_VALUES, BASE, MULTIPLIERS = _constants()


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hash of each word: a polynomial in its bytes, then mixed."""
    lens = np.fromiter(map(len, words), np.int64, len(words))
    flat = BYTE_VALUES[np.frombuffer(b"".join(words), np.uint8)]
    starts = np.cumsum(lens) - lens
    place = np.arange(len(flat)) - np.repeat(starts, lens)
    powers = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.repeat(BASE, int(lens.max()) if len(lens) else 0)]))
    sums = np.add.reduceat(flat * powers[place], starts) if len(words) else np.zeros(0, np.uint64)
    return _mix(sums + lens.astype(np.uint64) * _GOLDEN)


def shingle_sets(texts: list[str], width: int) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's ``width``-word shingles.

    Lower-cases A-Z and splits at ASCII white space. Fewer words make one shingle of all of
    them; no words make an empty set.
    """
    words = [t.encode("utf-8", "surrogatepass").lower().split() for t in texts]
    every = word_hashes([w for ws in words for w in ws])
    out, at = [], 0
    for ws in words:
        h = every[at:at + len(ws)]
        at += len(ws)
        n = min(width, len(ws))
        rolled = np.full(max(0, len(ws) - n + 1) if n else 0, n, np.uint64) * _GOLDEN
        for k in range(n):
            rolled = _mix(rolled + h[k:k + len(rolled)])
        out.append(np.unique(rolled))
    return out


def signature(tokens: np.ndarray) -> np.ndarray:
    """Minwise token under each hash function, as the function's smallest value."""
    low = np.full(SIGNATURE, np.iinfo(np.uint64).max, np.uint64)
    for s in range(0, len(tokens), 2048):
        part = tokens[s:s + 2048, None] * MULTIPLIERS[None, :]
        low = np.minimum(low, (part ^ (part >> np.uint64(29))).min(0))
    return low


def fingerprints(docs: DataFrame, key: str, text: str, width: int) -> DataFrame:
    """_id, n_shingles, _set (hash of the set, null if empty), _sig (low 32 bits of each minwise value)."""
    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        sizes, names, sigs = [], [], []
        for tokens in shingle_sets(batch.column(1).to_pylist(), width):
            sizes.append(len(tokens))
            names.append(hashlib.blake2b(tokens.tobytes(), digest_size=16).digest() if len(tokens) else None)
            sigs.append(_mix(signature(tokens)).astype(np.uint32).view(np.int32))
        rows = pa.FixedSizeListArray.from_arrays(pa.array(np.concatenate([*sigs, np.zeros(0, np.int32)])), SIGNATURE)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(names, pa.binary()),
                                           rows.cast(pa.list_(pa.int32()))], names=["_id", "n_shingles", "_set", "_sig"])

    frame = docs.select(F.col(key).cast("long").alias("_id"), whole_text(text).alias("_text"))
    return arrow_map(frame, work, "_id long, n_shingles long, _set binary, _sig array<int>")


def path(tree: int, depth: int) -> Column:
    """Name of the node that a set reaches after ``depth`` levels of a tree."""
    return F.xxhash64(F.lit(tree), F.lit(depth), *[F.get("_sig", F.lit(tree * LEVELS + d)) for d in range(depth)])


def nodes(sets: DataFrame) -> DataFrame:
    """(_node, _id, _n, _tree, _leader) of nodes with two sets and more.

    A node of more than SMALL_NODE sets branches on, down to the last level. ``_tree``
    orders a set's nodes; the leader is the member with the largest nodes in all trees.
    """
    levels = [F.array(*[path(t, STEP * (s + 1)) for t in range(TREES)]) for s in range(STEPS)]
    walking = sets.select("_id", F.posexplode(F.arrays_zip(*[x.alias(f"p{i}") for i, x in enumerate(levels)])).alias("_tree", "_p"))
    found = None
    for step in range(STEPS):
        rows = walking.select("_id", "_tree", "_p", F.col(f"_p.p{step}").alias("_node"))
        sizes = rows.groupBy("_node").agg(F.count("*").alias("_n")).filter("_n > 1")
        placed = settle(rows.join(sizes, "_node"))
        done = placed if step == STEPS - 1 else placed.filter(F.col("_n") <= SMALL_NODE)
        done = done.select("_node", "_id", "_n", "_tree")
        found = done if found is None else found.unionByName(done)
        walking = placed.filter(F.col("_n") > SMALL_NODE).select("_id", "_tree", "_p")
    weight = found.groupBy("_id").agg(F.sum("_n").alias("_w"))
    leaders = found.join(weight, "_id").groupBy("_node").agg(F.max(F.struct("_w", (-F.col("_id")).alias("i"))).alias("_top"))
    return settle(found.join(leaders.select("_node", (-F.col("_top.i")).alias("_leader")), "_node"))


def alike(a: Column, b: Column) -> Column:
    """Entries in which two signatures agree."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)


def least_agreement(percent: int) -> int:
    """Signature entries that a pair at the threshold falls short of with probability below 1e-8."""
    p = percent / 100
    return int(SIGNATURE * p - 6 * np.sqrt(SIGNATURE * p * (1 - p)))


def confirm(pairs: DataFrame, docs: DataFrame, key: str, text: str, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets overlap by ``percent`` of their union at least.

    Each pair fetches both texts by shuffled joins, and one Arrow map builds and compares
    the two sets of a pair; sets of a batch are built once per text.
    """
    texts = docs.select(F.col(key).cast("long").alias("_k"), whole_text(text).alias("_t")).filter(F.col("_k").isNotNull())
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("_k")).distinct()
    texts = texts.join(wanted, "_k", "left_semi").dropDuplicates(["_k"])
    joined = (pairs.join(texts.select(F.col("_k").alias("a"), F.col("_t").alias("_ta")), "a")
              .join(texts.select(F.col("_k").alias("b"), F.col("_t").alias("_tb")), "b").select("a", "b", "_ta", "_tb"))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        by_id = dict(zip(a, batch.column(2).to_pylist(), strict=True)) | dict(zip(b, batch.column(3).to_pylist(), strict=True))
        sets = dict(zip(by_id, shingle_sets(list(by_id.values()), width), strict=True))
        good = []
        for x, y in zip(a, b, strict=True):
            both = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
            good.append(both > 0 and 100 * both >= percent * (len(sets[x]) + len(sets[y]) - both))
        return batch.select([0, 1]).filter(pa.array(good, pa.bool_()))

    return arrow_map(joined, work, "a long, b long", rows=256)


def components(links: DataFrame, rounds: int = 50) -> DataFrame:
    """_id, _component: the smallest id reachable over the links, for ids that have one.

    Large and small stars in turn: each round hands every node's neighbours to the smallest
    of them, until nothing moves. Rows stay linear in the links, and a hub's neighbours are
    aggregated (min) and joined, never gathered.
    """
    edges = settle(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            low.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        new = settle(small)
        sums = [x.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first() for x in (edges, new)]
        edges = new
        if sums[0] == sums[1]:
            return edges.groupBy(F.col("u").alias("_id")).agg(F.min("v").alias("_component"))
    raise RuntimeError("components did not settle")


def labelled(ids: DataFrame, links: DataFrame) -> DataFrame:
    """``ids`` with _component: the least reachable id, itself where nothing links it."""
    return ids.join(components(links), "_id", "left").withColumn("_component", F.coalesce("_component", "_id"))


def _meetings(rows: DataFrame) -> DataFrame:
    """Members dealt into pairs of blocks: _node, _x, _y and the member's _side there.

    Side 2 is a block that meets itself; small nodes are one block.
    """
    blocks = F.when(F.col("_n") <= SMALL_NODE, 1).otherwise(F.ceil(F.col("_n") / BLOCK)).cast("int")
    dealt = rows.withColumn("_b", F.pmod(F.xxhash64("_id", F.lit(3)), blocks).cast("int"))
    return dealt.withColumn("_o", F.explode(F.sequence(F.lit(0), blocks - 1))).withColumns({
        "_x": F.least("_b", "_o"), "_y": F.greatest("_b", "_o"),
        "_side": F.when(F.col("_b") == F.col("_o"), 2).when(F.col("_b") < F.col("_o"), 0).otherwise(1)}).drop("_b", "_o")


MEETING = ["_node", "_x", "_y"]


def unsettled_members(members: DataFrame, agreement: int, percent: int) -> DataFrame:
    """Members of a meeting with a partner there of a fitting size that is similar by signature, lies in another
    component, and shares no node of an earlier tree with it (where the two have met).

    All meetings of an Arrow batch are compared together; most have two or three members.
    """
    from .setjoin import by_meeting, list_pairs  # the join over lists has the same meetings

    def compare(batch: pa.RecordBatch) -> pa.RecordBatch:
        sig = batch.column("_sig").flatten().to_numpy().reshape(-1, SIGNATURE)
        earlier = batch.column("_earlier").flatten().to_numpy().reshape(-1, TREES)
        tree, open_ = batch.column("_tree").to_numpy(), np.zeros(batch.num_rows, bool)
        for every, other in list_pairs(batch, 0, percent):
            for s in range(0, len(every), 4096):
                i, j = every[s:s + 4096], other[s:s + 4096]
                near = (sig[i] == sig[j]).sum(1) >= agreement
                i, j = i[near], j[near]
                met = (earlier[i] == earlier[j]) & (earlier[i] != 0) & (np.arange(TREES)[None, :] < tree[i][:, None])
                fresh = ~met.any(1)
                open_[i[fresh]] = open_[j[fresh]] = True
        return batch.select([*MEETING, "_id", "_component", "_side"]).filter(pa.array(open_))

    rows = members.select(*MEETING, "_side", "_id", F.col("_size").alias("_n"), "_component", "_tree", "_sig", "_earlier")
    return by_meeting(rows, compare, "_node long, _x int, _y int, _id long, _component long, _side int")


def exact_links(members: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) of a spanning forest over the exact similarities of a meeting's members.

    ``members`` bring their sets (_tokens, sorted 64-bit numbers as bytes). A task holds the
    sets of two blocks at most.
    """
    def compare(group: pd.DataFrame) -> pd.DataFrame:
        ids, side = group["_id"].to_numpy(), group["_side"].to_numpy()
        sets = [np.frombuffer(t, np.uint64) for t in group["_tokens"]]
        size = np.array([len(t) for t in sets])
        codes = np.unique(np.concatenate(sets), return_inverse=True)[1]
        owner = np.repeat(np.arange(len(ids)), size)
        order = np.argsort(codes, kind="stable")
        posting, bounds = owner[order], np.searchsorted(codes[order], np.arange(codes.max() + 2))
        names, of = np.unique(group["_component"].to_numpy(), return_inverse=True)
        up = list(range(len(names)))  # components that links have joined

        def find(x: int) -> int:
            while up[x] != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        found, at = [], np.cumsum(size) - size
        for i in range(len(ids) - 1):
            lists = [posting[bounds[c]:bounds[c + 1]] for c in codes[at[i]:at[i] + size[i]]]
            both = np.bincount(np.concatenate(lists), minlength=len(ids))
            linked = np.flatnonzero(100 * both >= percent * (size[i] + size - both))
            for j in linked[linked > i]:
                if side[i] == 2 or side[j] != side[i]:
                    x, y = find(of[i]), find(of[j])
                    if x != y:
                        up[x] = y
                        found.append((min(ids[i], ids[j]), max(ids[i], ids[j])))
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return members.groupBy(*MEETING).applyInPandas(compare, "a long, b long")


def full_sets(wanted: DataFrame, docs: DataFrame, key: str, text: str, width: int) -> DataFrame:
    """(_id, _tokens) of the documents in ``wanted`` (_id)."""
    texts = docs.select(F.col(key).cast("long").alias("_id"), whole_text(text).alias("_t")).filter(F.col("_id").isNotNull())
    texts = texts.join(wanted.distinct(), "_id", "left_semi").dropDuplicates(["_id"])

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        tokens = [t.tobytes() for t in shingle_sets(batch.column(1).to_pylist(), width)]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(tokens, pa.binary())], names=["_id", "_tokens"])

    return arrow_map(texts, work, "_id long, _tokens binary")


def near_duplicates(docs: DataFrame, *, key: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """Per document: key, n_shingles, component_id, kept.

    Documents are linked if their shingle sets overlap by ``percent`` of their union at
    least, confirmed on the full sets; component_id is the smallest key reachable over links,
    kept marks the document that bears it. Null and empty texts, and texts without words,
    have no shingles and no links; rows with a null key have no component and are kept. Rows
    that repeat a key are one document (the same component; its text must be the same). An
    empty table gives an empty result.
    """
    agreement = least_agreement(percent)
    prints = settle(fingerprints(docs, key, text, width))
    known = prints.filter(F.col("_set").isNotNull() & F.col("_id").isNotNull())
    sets = settle(known.groupBy("_set").agg(F.min("_id").alias("_id"), F.any_value("_sig").alias("_sig"), F.any_value("n_shingles").alias("_size")))
    every = nodes(sets)
    stars = every.filter("_id <> _leader").select(F.least("_leader", "_id").alias("a"), F.greatest("_leader", "_id").alias("b")).distinct()
    for c in ("a", "b"):
        stars = stars.join(sets.select(F.col("_id").alias(c), F.col("_sig").alias(f"_s{c}")), c)
    tried = settle(stars.filter(alike(F.col("_sa"), F.col("_sb")) >= agreement).select("a", "b"))
    links = settle(confirm(tried, docs, key, text, width, percent))
    placed = labelled(sets.select("_id"), links)

    mine = every.groupBy("_id").agg(F.map_from_entries(F.collect_list(F.struct("_tree", "_node"))).alias("_m"))  # at most one node per tree
    earlier = F.transform(F.sequence(F.lit(0), F.lit(TREES - 1)), lambda t: F.coalesce(F.try_element_at("_m", t), F.lit(0).cast("long")))
    facts = settle(placed.join(mine, "_id").join(sets.select("_id", "_sig", "_size"), "_id").select(
        "_id", "_component", "_sig", "_size", earlier.alias("_earlier")))
    rows = every.drop("_leader").join(facts.select("_id", "_component"), "_id")
    mixed = rows.groupBy("_node").agg(F.min("_component").alias("_lo"), F.max("_component").alias("_hi")).filter("_lo <> _hi")
    rows = rows.join(mixed.select("_node"), "_node", "left_semi").join(facts.select("_id", "_sig", "_size", "_earlier"), "_id")
    members = settle(unsettled_members(_meetings(rows), agreement, percent))
    more = exact_links(members.join(full_sets(members.select("_id"), docs, key, text, width), "_id"), percent)
    links = links.unionByName(more)
    final = settle(labelled(sets.select("_id"), links))
    of_set = sets.select(F.col("_set").alias("_s"), "_id").join(final, "_id").select("_s", "_component")
    out = prints.join(of_set, F.col("_set") == F.col("_s"), "left")
    component = F.when(F.col("_id").isNotNull(), F.coalesce("_component", "_id"))
    return out.select(F.col("_id").alias(key), "n_shingles", component.alias("component_id"),
                      F.coalesce(F.col("_id") == component, F.lit(True)).alias("kept"))
