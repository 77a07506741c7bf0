"""What large tables showed: band edges, replicates beyond the old bounds."""

import duckdb
import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from sigweave.functions import draws
from sigweave.operators import collapse, common, groups, ladder, matching, rankstats, resample
from sigweave.operators import replicates as K
from sigweave.operators.common import half_away


def test_band_edges_equal_sql(spark):
    """Scores of nine digits whose gaps often are the tolerance, or halves of the sixth digit."""
    rng = np.random.default_rng(3)
    steps = 0.7 + np.arange(60) * 0.0005
    h = pd.DataFrame({"entity": np.arange(400), "raw": np.round(np.concatenate([rng.choice(steps, 300), rng.uniform(0.7, 0.73, 100)]), 9)})
    lo = pd.DataFrame({"entity": np.arange(400), "raw": np.round(np.concatenate([rng.choice(steps, 300), rng.choice(steps, 100) + 0.0000005 * rng.integers(0, 400, 100)]), 9)})
    sides = [spark.createDataFrame(x) for x in (h, lo)]
    got = matching.band_join(*sides, "raw", 0.0005, ["entity", "raw"], salts=2).select(
        "high_entity", "low_entity", half_away(F.col("raw_gap"), 6).alias("gap")).toPandas()
    con = duckdb.connect()
    con.register("h", h), con.register("l", lo)
    want = con.execute("""SELECT h.entity AS high_entity, l.entity AS low_entity, round(abs(h.raw - l.raw), 6) AS gap FROM h, l
        WHERE round(abs(h.raw - l.raw), 9) <= 0.0005""").df()
    keys = ["high_entity", "low_entity"]
    pd.testing.assert_frame_equal(got.sort_values(keys).reset_index(drop=True), want.sort_values(keys).reset_index(drop=True), check_dtype=False, rtol=0, atol=1e-12)
    count = matching.band_pair_count(*sides, "raw", 0.0005).agg(F.sum("n_partners")).first()[0]
    assert count == len(want)


def test_repeated_rows_share_cells(spark):
    """Groups with many equal rows draw the same as their relational plan (tests of tables without them are elsewhere)."""
    rows = spark.range(600).select("id", (F.col("id") % 7).cast("double").alias("a"), F.when(F.col("id") % 5 > 0, (F.col("id") * 3) % 7 + 0.5).alias("b"),
                                   (F.col("id") % 35 % 4).cast("double").alias("c"), F.col("id").cast("string").alias("t"))
    index = K.build(rows, "id", ["a", "b", "c"])
    assert index.groups[0].size <= 35 and index.groups[0].n == 600
    brute = rows.orderBy("id").toPandas()
    got = resample.spearman_replicates(rows, "id", ["a", "b"], "c", 8, 3).toPandas()
    for r in got.itertuples():
        at = draws.drawn_positions(np.array([draws.replicate_number(3, r.rep)], np.uint64), 600)[0]
        drawn = brute.iloc[at].dropna(subset=[r.metric])
        assert abs(r.rho - drawn[r.metric].rank().corr(drawn["c"].rank())) < 1e-12
    moments = resample.drawn_moments(rows, "id", "a", 5, 3).toPandas()
    for r in moments.itertuples():
        v = brute["a"].to_numpy()[draws.drawn_positions(np.array([draws.replicate_number(3, r.rep)], np.uint64), 600)[0]]
        assert abs(r.mean - v.mean()) < 1e-12 and abs(r.var - v.var(ddof=1)) < 1e-12


def test_a_million_rows_stay_in_the_kernels(spark):
    """1.2 million parts: beyond a million rows the joins made a row for every draw."""
    rows = spark.range(1_200_000).select("id", (F.col("id") % 101).cast("double").alias("a"), (F.col("id") % 7).cast("double").alias("b"))
    index = K.build(rows, "id", ["a", "b"])
    assert index is not None and index.groups[0].size == 707
    w = K.draw_counts(1, index.groups[0], np.arange(1, 3))
    assert w.sum(1).tolist() == [1_200_000] * 2


def test_shuffles_leave_in_bounded_blocks():
    """Memory follows the rows of one block of replicates, not all replicates of a task."""
    n, reps = 120_000, 50
    vec = np.random.default_rng(1).normal(size=(n, 2))
    sizes = [cos.shape for _, cos in K.shuffled_blocks(vec, vec, np.arange(reps, dtype=np.uint64), zero=np.nan, eps=0.0)]
    assert sum(r for r, _ in sizes) == reps and max(r * n for r, _ in sizes) <= K.BLOCK_CELLS


def test_columns_are_ranked_once_in_crowded_pieces(spark, monkeypatch):
    """Fold tables: ranks in cut pieces equal pandas, with ties, NULL groups and gaps; rows stay where they are while pieces are cut."""
    monkeypatch.setattr(ladder, "PIECE_ROWS", 40)
    rng = np.random.default_rng(5)
    n = 1500
    data = pd.DataFrame({"g": rng.choice(["a", "b", None], n), "x": rng.normal(size=n).round(2), "z": rng.normal(0.9, 0.001, size=n), "y": rng.integers(0, 50, n) * 1.0})
    schema = "g string, x double, z double, y double"
    gap = data.copy()
    gap.loc[::7, "x"] = np.nan
    for table in (data, gap):
        got = rankstats.spearman_columns(spark.createDataFrame(table.astype(object).where(table.notna(), None).values.tolist(), schema), ["g"], ["x", "z"], "y").collect()
        assert len(got) == 3
        for r in got:
            own = table[table["g"].isna()] if r["g"] is None else table[table["g"] == r["g"]]
            assert r["n"] == len(own)
            for c in ("x", "z"):
                both = own.dropna(subset=[c])
                assert abs(r[c] - both[c].rank().corr(both["y"].rank())) < 1e-12
    placed = ladder.with_pieces(common.reuse(spark.createDataFrame(data[["z"]])), "z", 16)
    plan = placed._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_rows_of_a_large_region_stay_spread(spark):
    """Edges of a group's quantiles come to its rows; before, the rows of a group met them in one task."""
    rows = spark.range(4000).select((F.col("id") % 3).alias("g"), F.rand(1).alias("x"))
    plan = groups.quantile_group(rows, ["g"], "x", 4)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_centred_vectors_take_their_mean_once(spark):
    """The mean used to be put into the lambda of every feature and again into the filter on whole vectors."""
    rng = np.random.default_rng(8)
    rows = [(int(e), None if i > 3 else int(i), float(x)) for e, i, x in zip(rng.integers(0, 5, 60), rng.integers(0, 5, 60), rng.integers(1, 9, 60), strict=True)]
    long = spark.createDataFrame(rows, "entity long, idx int, x double")
    vectors = collapse.long_to_vectors(long, ["entity"], F.col("idx"), F.col("x"), 4, centred=True)
    got = {r["entity"]: r["vec"] for r in vectors.collect()}
    for e in range(5):
        own = np.array([sum(x for k, j, x in rows if k == e and j == i) for i in range(4)])
        assert np.allclose(got[e], own - own.mean(), atol=1e-12)
    whole = vectors.filter(F.size("vec") > 0)._jdf.queryExecution().executedPlan().toString()
    assert "lambda" not in whole and "aggregate(" not in whole


def test_gates_read_their_table_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    df = spark.range(4000).select("id", (F.col("id") % 997).cast("double").alias("a"), (F.col("id") % 89).cast("double").alias("b"))
    gated = matching.quartile_gates(df.mapInArrow(count, df.schema), "a", "b")
    a, b = np.arange(4000) % 997, np.arange(4000) % 89
    high = (a >= np.quantile(a, 0.75)) & (b >= np.quantile(b, 0.75))
    low = (a <= np.quantile(a, 0.25)) & (b <= np.quantile(b, 0.25))
    assert gated.filter("gate = 'high'").count() == high.sum() and gated.filter("gate = 'low'").count() == low.sum()
    assert seen.value == 4000


def test_set_overlaps_as_arrays_and_one_by_one(spark, monkeypatch):
    """A NULL item counts in its set and equals no other; repeated items count once."""
    items = {1: [1, 2, 3, 3], 2: [2, 3, None], 3: [None, None], 4: [9], 5: [3, 2, 1]}
    members = spark.createDataFrame([(k, i) for k, v in items.items() for i in v], "key long, item int")
    pairs = [(r, a, b) for r in (1, 2) for a in items for b in [*items, 6] if a != b]
    frame = spark.createDataFrame(pairs, "rep int, key_a long, key_b long")

    def size(v):
        return len(set(v))

    want = {}
    for r, a, b in pairs:
        if b in items:
            both = len({*items[a]} & {*items[b]} - {None})
            want[r, a, b] = both / (size(items[a]) + size(items[b]) - both)
    for bound, arrays in ((1000, True), (1, False)):
        monkeypatch.setattr(matching, "SET_ITEMS", bound)
        got = matching.pair_set_overlap(frame, members, "key", "item")
        assert {(x["rep"], x["key_a"], x["key_b"]): x["jaccard"] for x in got.collect()} == want
        assert got.columns.count("jaccard") == 1 and len(got.columns) == 4
        assert ("array_intersect" in got._jdf.queryExecution().executedPlan().toString()) == arrays
