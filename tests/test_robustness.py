"""Crowded values, NULL groups, NaN, whole vectors and incomplete rows."""

import math

import pandas as pd
import pytest
from pyspark.sql import functions as F

from sigweave.functions import pvalues
from sigweave.operators import classify, collapse, geometry, ladder, loo, pairstats, rankstats


def piece_sizes(df):
    cut = ladder.with_pieces(df, "x", 16)
    return [r["count"] for r in cut.groupBy("_bucket", "_piece").count().collect()]


def test_crowded_values_are_cut_into_pieces(spark, monkeypatch):
    monkeypatch.setattr(ladder, "PIECE_ROWS", 500)
    df = spark.range(20_000).select((0.9219 + F.col("id") / 2e7).alias("x"), F.lit(1).cast("long").alias("w"))
    assert max(piece_sizes(df)) <= 500
    for descending in (False, True):
        got = ladder.ladder(df, [], "x", ["w"], descending=descending).orderBy(F.desc("x") if descending else "x").collect()
        assert [r["w_before"] for r in got] == list(range(20_000))


def test_an_outlier_does_not_spoil_the_pieces(spark):
    dense = spark.range(200_000).select((0.922 + F.col("id") / 1e11).alias("x"))
    df = dense.unionByName(spark.createDataFrame([(0.9228,)], "x double"))
    assert max(piece_sizes(df)) <= 2 * ladder.PIECE_ROWS


@pytest.mark.parametrize("values", [
    lambda i: 1.0 + F.pow(F.lit(0.5), (i % 45).cast("double")) + i * 1e-16,  # ever denser towards 1
    lambda i: F.when(i % 2 == 0, i * 1e303).otherwise(i * -1e-320), lambda i: (i % 3).cast("double"),
    lambda i: F.lit(2**53).cast("double") + i * 2])
def test_pieces_keep_the_order_of_any_values(spark, monkeypatch, values):
    monkeypatch.setattr(ladder, "PIECE_ROWS", 100)
    df = spark.range(3000).select(values(F.col("id")).alias("x"), (F.col("id") % 5 == 0).alias("g"), F.lit(1).cast("long").alias("w"))
    rows = [(r["x"], r["g"]) for r in df.collect()]
    for r in ladder.ladder(df, ["g"], "x", ["w"]).collect():
        own = [x for x, g in rows if g == r["g"]]
        assert r["w_before"] == sum(x < r["x"] for x in own) and r["w"] == own.count(r["x"]) and r["w_total"] == len(own)


def test_small_tables_take_a_plain_window(spark):
    assert ladder.with_pieces(spark.range(50).select(F.col("id").cast("double").alias("x")), "x", 16) is None
    assert ladder.with_pieces(spark.range(0).select(F.col("id").cast("double").alias("x")), "x", 16) is None


def test_null_groups_and_nan(spark):
    rows = [(g, float(i), float(i * i % 7), i % 2) for g in ("x", None) for i in range(12)] + [("x", float("nan"), 1.0, 1), ("x", None, 2.0, 0)]
    df = spark.createDataFrame(rows, "g string, a double, b double, y int")
    for bounded in (False, True):
        got = {r["g"]: r for r in rankstats.spearman(df, ["g"], "a", "b", bounded=bounded).collect()}
        assert set(got) == {"x", None} and got["x"]["n"] == got[None]["n"] == 12
        assert got["x"]["rho"] == pytest.approx(got[None]["rho"])
    auc = {r["g"]: r["auroc"] for r in classify.auroc(df, ["g"], "a", "y").collect()}
    assert auc["x"] == auc[None] is not None


@pytest.mark.parametrize("dim", [63, 64, 65])
def test_vectors_are_whole(spark, dim):
    unit = [[1.0 if i == k else 0.0 for i in range(dim)] for k in range(3)]
    df = spark.createDataFrame([("e", v) for v in [*unit, None, []]], "entity string, vec array<double>")
    for d in (dim, None):
        r = geometry.direction_instability(df, ["entity"], {"di": "vec"}, dim=d).collect()[0]
        assert r["n_contexts"] == 3 and r["di"] == pytest.approx(1.0)
        assert geometry.entity_geometry(df, ["entity"], dim=d).collect()[0]["n_contexts"] == 3
    with pytest.raises(Exception, match="does not have"):
        geometry.direction_instability(df, ["entity"], {"di": "vec"}, dim=dim - 1).collect()
    long = spark.createDataFrame([("e", dim, 1.0)], "entity string, idx int, x double")
    with pytest.raises(Exception, match="outside"):
        collapse.long_to_vectors(long, ["entity"], F.col("idx"), F.col("x"), dim).collect()


def test_incomplete_rows(spark):
    df = spark.createDataFrame([(1.0, 1.0, 2.0), (2.0, 2.0, 1.0), (3.0, 3.0, 5.0), (4.0, 4.0, 4.0), (100.0, None, 1.0), (None, 50.0, 2.0)],
                               "x double, c double, b double")
    got = classify.residualize(df, [], "x", "c", "r").filter("r IS NOT NULL").collect()
    assert len(got) == 4 and all(abs(r["r"]) < 1e-9 for r in got)
    noisy = df.withColumn("a", F.col("x") + F.when(F.col("b") > 3, 0.5).otherwise(-0.2))
    assert rankstats.steiger(noisy, [], "c", "a", "b").collect()[0]["n"] == 4


def test_no_control_cells_is_an_error(spark):
    cells = spark.createDataFrame([("c1", "drug")], "cell_id string, perturbation string")
    with pytest.raises(Exception, match="control label"):
        collapse.pick_control_label(cells, "perturbation").collect()


def test_p_values_at_large_n():
    normal = math.erfc(1 / math.sqrt(2))
    for df in (1e9, 1e10):
        assert pvalues.student_two_sided(1.0, df) == pytest.approx(normal, abs=1e-9)
    assert pvalues.student_two_sided(1.0, 1) == pytest.approx(0.5)
    for n in (10, 101, 1000):
        exact = sum(math.comb(n, k) for k in range(n // 2, n + 1)) / 2**n
        assert pvalues.binomial_upper(n // 2, n, 0.5) == pytest.approx(exact, rel=1e-10)
    assert 0.5 < pvalues.binomial_upper(5 * 10**7, 10**8, 0.5) < 0.5001


def test_vectors_of_different_lengths_are_refused(spark):
    df = spark.createDataFrame([("e", 1, [1.0, 0.0]), ("e", 2, [0.0, 1.0, 1.0]), ("f", 1, [1.0]), ("f", 2, [2.0])], "entity string, context long, vec array<double>")
    fine = df.filter("entity = 'f'")
    for odd, call in ((df, lambda d: geometry.direction_instability(d, ["entity"], {"di": "vec"})),
                      (df, lambda d: geometry.entity_geometry(d, ["entity"])),
                      (df, lambda d: pairstats.level_cosines(d, ["entity"], "context"))):
        assert call(fine).count() == 1
        with pytest.raises(Exception, match="differ"):
            call(odd).collect()


def test_null_keys_stay_in_vector_operators(spark):
    rows = [(e, c, [float(c), 1.0, float(c * c)]) for e in ("x", None) for c in range(1, 8)]
    df = spark.createDataFrame(rows, "entity string, context long, vec array<double>")
    held = loo.leave_one_out(df, ["entity"], "context").collect()
    assert sorted(r["context"] for r in held if r["entity"] is None) == list(range(1, 8))
    by_context = {(r["entity"], r["context"]): r["train_ts"] for r in held}
    assert all(by_context[("x", c)] == pytest.approx(by_context[(None, c)]) for c in range(1, 8))
    masks = spark.createDataFrame([("x", [0]), (None, [0, 1])], "entity string, mask array<int>")
    got = {r["entity"]: r["localization"] for r in geometry.localization(df, masks, ["entity"], ["entity"]).collect()}
    inside = geometry.direction_instability(df.withColumn("vec", F.array(F.col("vec")[0], F.col("vec")[1])), ["entity"], {"di": "vec"}).first()["di"]
    whole = geometry.direction_instability(df, ["entity"], {"di": "vec"}).first()["di"]
    assert got["x"] == pytest.approx(0) and got[None] == pytest.approx(inside / whole)
    directions = spark.createDataFrame([("x", [1.0, 0.0, 0.0]), (None, [1.0, 0.0, 0.0])], "entity string, direction array<double>")
    assert geometry.phenotype_projection(df, directions, ["entity"], ["entity"]).count() == 2


def test_block_kernels_treat_uneven_groups_alike(spark):
    """Groups of many sizes share padded batches; each equals the same group computed alone."""
    rows = [(f"g{n}", c, [float((c * 7 + n) % 5), float(c % 3), 1.0]) for n in (5, 6, 9, 17, 30) for c in range(n)]
    df = spark.createDataFrame(rows, "entity string, context long, vec array<double>")
    whole = {(r["entity"], r["context"]): r["train_frechet"] for r in loo.leave_one_out(df, ["entity"], "context").collect()}
    split = {(r["entity"], r["context"]): r["train_frechet"] for r in loo.leave_one_out(df, ["entity"], "context", block_size=4).collect()}
    assert whole.keys() == split.keys() and all(whole[k] == pytest.approx(split[k]) for k in whole)
    jaccard = [{r["entity"]: (r["n_pairs"], r["mean_top_jaccard"]) for r in pairstats.top_feature_jaccard(df, ["entity"], "context", 2, block_size=b).collect()}
               for b in (4, 128)]
    assert jaccard[0].keys() == jaccard[1].keys()
    assert all(jaccard[0][k][0] == jaccard[1][k][0] and jaccard[0][k][1] == pytest.approx(jaccard[1][k][1]) for k in jaccard[0])
    cosines = [sorted((r["entity"], r["level_lo"], r["level_hi"], round(r["cosine"], 12)) for r in pairstats.level_cosines(
        df, ["entity"], "context", block_size=b).collect()) for b in (4, 128)]
    assert cosines[0] == cosines[1]


@pytest.mark.parametrize("block", [3, 128])
def test_pair_distribution_equals_the_pairs(spark, block):
    rows = [(f"e{n}", float(c + 1), [float((c * 7 + n) % 5) - 1, float(c % 3), float(n % 2)]) for n in (2, 3, 9, 14) for c in range(n)]
    rows += [("same", float(c), [1.0, 1.0, 0.0]) for c in range(1, 8)] + [("zero", 1.0, [0.0] * 3), ("zero", 2.0, [1.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "entity string, dose double, vec array<double>")
    pairs = pairstats.level_cosines(df, ["entity"], "dose", block_size=block).toPandas()
    pairs["cosine"] = pairs["cosine"].round(9)
    pairs["bin"] = pd.cut(pairs["ratio"], [1, 2, 5, 100], right=False, labels=["a", "b", "c"]).astype(object)
    probs = {"p0": 0.0, "p10": 0.1, "p50": 0.5, "p77": 0.77, "p100": 1.0}
    for edges, names in (([], []), ([1, 2, 5, 100], ["a", "b", "c"])):
        got = {r["bin"]: r for r in pairstats.level_distribution(df, ["entity"], "dose", probs, edges=edges, labels=names, block_size=block).collect()}
        want = dict(list(pairs.groupby("bin"))) if names else {"unbinned": pairs}
        assert got.keys() == want.keys()
        for b, part in want.items():
            c = part["cosine"]
            assert got[b]["n"] == len(c) and got[b]["mean"] == pytest.approx(c.mean()) and got[b]["std"] == pytest.approx(c.std(ddof=0))
            assert all(got[b][k] == pytest.approx(c.quantile(p)) for k, p in probs.items())
            assert got[b]["frac_below_05"] == pytest.approx((c < 0.5).mean()) and got[b]["frac_above_09"] == pytest.approx((c > 0.9).mean())
    assert pairstats.level_distribution(df.limit(0), ["entity"], "dose", probs).count() == 0
