import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sigweave.functions import pvalues
from sigweave.operators import classify, groups, ladder, matching, rankstats, resample
from sigweave.operators import replicates as K


def frame(spark, **cols):
    return spark.createDataFrame(pd.DataFrame(cols))


def rank(x):
    return pd.Series(x).rank().to_numpy()


def auc(s, y):
    s, y = np.asarray(s, float), np.asarray(y)
    p, q = s[y == 1], s[y == 0]
    return ((p[:, None] > q[None]).sum() + 0.5 * (p[:, None] == q[None]).sum()) / (len(p) * len(q))


OUT = [0.0, 0.1, 0.2, 0.8, 0.9, 1.0]


def fixture_auc(spark, pred, outcome, worse):
    df = frame(spark, pred=pred, y=outcome).select(
        classify.orient("pred", worse).alias("s"), classify.at_least("y", 0.5).alias("l"))
    return classify.auroc(df, [], "s", "l").first()["auroc"]


def test_auroc_cases(spark):
    assert fixture_auc(spark, [10, 9, 8, 1, .5, .1], OUT, True) == 1
    assert fixture_auc(spark, [.1, .2, .3, .8, .9, 1], OUT, False) == 1
    p, o = [.1, .5, .9, .2, .6, 1], [.8, .7, .1, .9, .3, .05]
    assert fixture_auc(spark, p, o, True) + fixture_auc(spark, p, o, False) == pytest.approx(1)
    assert fixture_auc(spark, p, [1.0] * 6, True) is None


def test_weights_equal_repeated_rows(spark):
    rng = np.random.default_rng(0)
    s, y, w = rng.integers(0, 12, 80) / 4.0 - 1, rng.integers(0, 2, 80), rng.integers(1, 4, 80)
    df = frame(spark, s=s, y=y, w=w, x=rng.normal(size=80))
    es, ey = np.repeat(s, w), np.repeat(y, w)
    both = classify.roc_and_pr(df, [], "s", "y", weight="w").first()
    assert both["auroc"] == pytest.approx(auc(es, ey))
    assert classify.auroc(df, [], "s", "y", weight="w").first()["auroc"] == pytest.approx(auc(es, ey))
    ap, seen = 0.0, 0
    for t in sorted(set(es), reverse=True):
        hit = (es >= t) & (ey == 1)
        ap += (hit.sum() - seen) / ey.sum() * hit.sum() / (es >= t).sum()
        seen = hit.sum()
    assert both["auprc"] == pytest.approx(ap)
    x = np.array([r["x"] for r in df.orderBy("s", "x").collect()])
    pdf = df.toPandas()
    want = np.corrcoef(rank(np.repeat(pdf.s, pdf.w)), rank(np.repeat(pdf.x, pdf.w)))[0, 1]
    for bounded in (False, True):
        got = rankstats.spearman(df, [], "s", "x", weight="w", bounded=bounded).first()
        assert got["rho"] == pytest.approx(want) and got["n"] == w.sum()
    assert len(x) == 80


def test_ladder_on_mixed_signs_and_ties(spark):
    rng = np.random.default_rng(1)
    v = np.concatenate([rng.normal(size=300) * 10.0 ** rng.integers(-12, 12, 300), np.zeros(200), [1e-300, -1e-300, 1e300]])
    df = frame(spark, v=v)
    got = ladder.average_ranks(df, [], "v").toPandas().set_index("v")["rank"]
    want = pd.Series(rank(v), index=v)
    want = want[~want.index.duplicated()]
    assert (got.sort_index().to_numpy() == want.sort_index().to_numpy()).all()
    probs = {"a": 0.025, "b": 0.5, "c": 0.975}
    q = ladder.quantiles(df.filter("abs(v) < 1e200"), [], "v", probs).first()
    small = v[np.abs(v) < 1e200]
    for k, p in probs.items():
        assert q[k] == pytest.approx(np.quantile(small, p), rel=1e-12, abs=1e-300)
    i = ladder.row_index(df.withColumn("id", F.monotonically_increasing_id()), [], ["v", "id"]).toPandas()
    assert sorted(i["idx"]) == list(range(len(v))) and (i.sort_values("idx")["v"].diff().dropna() >= 0).all()
    text = spark.createDataFrame([(f"k{j}",) for j in range(50)], "k string")
    assert sorted(r["idx"] for r in ladder.row_index(text, [], ["k"]).collect()) == list(range(50))


def test_published_p_values(spark):
    assert 2 * pvalues.normal_upper((18 * 88 - 425 - 792 - 0.5) / math.sqrt(18 * 88 * 107 / 12)) == pytest.approx(0.0020433, rel=1e-3)
    n, rho = 795, 0.3756
    t = rho * math.sqrt((n - 2) / (1 - rho * rho))
    assert pvalues.student_two_sided(t, n - 2) == pytest.approx(4.8e-28, rel=0.1)
    w, m = 2211, 66
    z = (w - m * (m + 1) / 4) / math.sqrt(m * (m + 1) * (2 * m + 1) / 24)
    assert pvalues.normal_upper(z) == pytest.approx(8.2e-13, rel=0.02)
    assert pvalues.binomial_upper(7, 10, 0.5) == pytest.approx(0.171875)
    assert pvalues.fisher_two_sided(8, 2, 1, 5) == pytest.approx(0.03497, abs=1e-4)
    assert pvalues.student_two_sided(2.0, 10) == pytest.approx(0.07338803, abs=1e-7)


def test_wilcoxon_all_positive(spark):
    r = rankstats.wilcoxon_signed_rank(frame(spark, d=np.arange(1, 67) / 100.0), [], "d").first()
    assert r["w_plus"] == 2211 and r["wilcoxon_p"] == pytest.approx(8.2e-13, rel=0.02)


def test_effect_sizes(spark):
    rng = np.random.default_rng(2)
    a, b = rng.normal(10, 1, 400), rng.normal(11, 1, 400)
    df = frame(spark, v=np.r_[a, b], g=np.r_[np.ones(400), np.zeros(400)].astype(int), k=np.arange(800))
    d = groups.cohens_d(df, [], "v", "g").first()["cohens_d"]
    sd = math.sqrt((a.var(ddof=1) + b.var(ddof=1)) / 2)
    assert d == pytest.approx((a.mean() - b.mean()) / sd)
    flat = frame(spark, v=[1.0] * 4, g=[1, 1, 0, 0])
    assert groups.cohens_d(flat, [], "v", "g").first()["cohens_d"] == 0
    ci = resample.bootstrap_mean_diff(df, "k", "v", "g", reps=200).first()
    assert ci["ci_hi"] < 0 and ci["p_value"] == 0 and ci["ci_lo"] < ci["point_diff"] < ci["ci_hi"]
    same = frame(spark, v=np.r_[a, a], g=np.r_[np.ones(400), np.zeros(400)].astype(int), k=np.arange(800))
    ci = resample.bootstrap_mean_diff(same, "k", "v", "g", reps=200).first()
    assert ci["ci_lo"] < 0 < ci["ci_hi"]


def test_draws_keep_the_sample_size(spark):
    df = frame(spark, k=np.arange(500), g=np.arange(500) % 2)
    w = resample.draw_weights(df, "k", 20, 3, by=["g"]).groupBy("rep", "g").agg(F.sum("w").alias("n")).collect()
    assert len(w) == 40 and all(r["n"] == 250 for r in w)
    distinct = resample.draw_weights(df, "k", 20, 3).groupBy("rep").count().toPandas()["count"]
    assert abs(distinct.mean() / 500 - (1 - math.exp(-1))) < 0.03


def test_permutations_keep_the_labels(spark):
    df = frame(spark, k=np.arange(60), v=np.arange(60) * 1.0, g=(np.arange(60) < 20).astype(int))
    null = resample.label_permutations(df, "k", "v", "g", reps=300).toPandas()["stat"]
    assert abs(null.mean()) < 1.5 and null.std() == pytest.approx(60 / math.sqrt(12) * math.sqrt(1 / 20 + 1 / 40), rel=0.15)


def test_residualize(spark):
    rng = np.random.default_rng(4)
    c = rng.normal(size=500)
    df = frame(spark, x=2 * c + rng.normal(size=500), c=c)
    r = classify.residualize(df, [], "x", "c", "r")
    assert abs(rankstats.spearman(r, [], "r", "c").first()["rho"]) < 0.15
    k = classify.residualize(frame(spark, x=[1., 2., 3., 4., 5.], c=[1.] * 5), [], "x", "c", "r")
    assert k.agg(F.avg("r")).first()[0] == pytest.approx(0)


def test_band_join_and_its_count(spark):
    rng = np.random.default_rng(5)
    h, lo = rng.random(60), np.r_[rng.random(80), np.full(40, 0.5)]
    hd = frame(spark, e=[f"h{i}" for i in range(60)], x=np.round(h, 6))
    ld = frame(spark, e=[f"l{i}" for i in range(120)], x=np.round(lo, 6))
    want = int((np.round(np.abs(np.round(h, 6)[:, None] - np.round(lo, 6)[None]), 9) <= 0.05).sum())
    pairs = matching.band_join(hd, ld, "x", 0.05, ["e", "x"], salts=3)
    assert pairs.count() == want == pairs.select("high_e", "low_e").distinct().count()
    assert matching.band_pair_count(hd, ld, "x", 0.05).agg(F.sum("n_partners")).first()[0] == want


def test_one_vs_rest_matches_brute_force(spark):
    rng = np.random.default_rng(6)
    cls, s = rng.choice(list("abc"), 150), rng.integers(0, 30, 150) * 1.0
    got = {r["cls"]: r["auroc"] for r in classify.one_vs_rest_auroc(frame(spark, cls=cls, s=s), [], "s", "cls").collect()}
    for c in "abc":
        assert got[c] == pytest.approx(auc(s, (cls == c).astype(int)))


def test_set_overlap_sample(spark):
    members = spark.createDataFrame([(e, i) for e in range(12) for i in range(e % 4 + 1)], "entity long, item long")
    ent = members.select("entity").distinct().withColumn("d", F.col("entity") * 1.0)
    pairs = matching.sampled_pairs(ent, "entity", ["d"], 3, 1)
    rows = matching.pair_set_overlap(pairs, members, "entity", "item").collect()
    assert len(rows) == pairs.count() == 36
    for r in rows:
        a, b = set(range(r["entity_a"] % 4 + 1)), set(range(r["entity_b"] % 4 + 1))
        assert r["jaccard"] == pytest.approx(len(a & b) / len(a | b))


def test_size_matching_counts_what_it_leaves_out(spark):
    rng = np.random.default_rng(7)
    size = np.r_[rng.normal(0, 1, 200), rng.normal(1, 1, 100)]
    g = np.r_[np.zeros(200), np.ones(100)].astype(int)
    df = frame(spark, k=np.arange(300), v=size * 2 + rng.normal(0, 0.1, 300), g=g, size=size)
    r = groups.size_matched_effect(df, "k", "v", "g", "size", 10).first()
    assert r["n1"] == r["n2"] and r["n1"] + r["unmatched1"] == 100 and r["n2"] + r["unmatched2"] == 200
    assert abs(r["cohens_d"]) < 0.35 < groups.cohens_d(df, [], "v", "g").first()["cohens_d"]
    gap = df.withColumn("size", F.when(F.col("k") % 4 > 0, F.col("size")))
    report = groups.match_report(groups.quantile_group(gap, [], "size", 5), ["bin"], "g").collect()
    assert sum(x["n1"] for x in report) == 100 and None in {x["bin"] for x in report}
    kept = groups.matched_rows(gap.withColumn("s", F.when(F.col("k") % 4 > 0, 1)), ["s"], "g", "k").groupBy("s", "g").count().collect()
    assert {(x["s"], x["g"]) for x in kept} == {(None, 0), (None, 1), (1, 0), (1, 1)}


def test_rank_correlations_with_and_without_gaps(spark):
    rng = np.random.default_rng(8)
    data = {c: rng.integers(0, 20, 120).astype(float) for c in "abcd"}
    data["b"][::7] = np.nan
    df = frame(spark, k=np.arange(120), **data)
    got = {(r["metric"], r["outcome"]): (r["n"], r["rho"]) for r in rankstats.rank_correlations(df, "k", ["a", "b"], ["c", "d"]).collect()}
    assert len(got) == 4
    for (m, o), (n, rho) in got.items():
        ok = ~np.isnan(data[m])
        x, y = (K.midranks(data[c][ok][None])[0] for c in (m, o))
        assert n == ok.sum() and rho == pytest.approx(np.corrcoef(x, y)[0, 1])


@pytest.mark.parametrize("piece", [None, 50])
def test_holm_over_a_family_of_any_size(spark, monkeypatch, piece):
    if piece:
        monkeypatch.setattr(ladder, "PIECE_ROWS", piece)
    rng = np.random.default_rng(9)
    rows = [(f, i, None if i == 3 else float(np.round(rng.random() ** 4, 3))) for f in ("a", None) for i in range(400)]
    df = spark.createDataFrame(rows, "f string, test long, p double")
    for f, part in (("a", rows[:400]), (None, rows[400:])):
        order = sorted((p, i) for _, i, p in part if p is not None)
        m, best, want = len(order), 0.0, {3: None}
        for k, (p, i) in enumerate(order):
            best = max(best, p * (m - k))
            want[i] = min(1.0, best)
        got = {r["test"]: r["p_adjusted"] for r in rankstats.holm(df, ["f"], "p", "test").filter(F.col("f").eqNullSafe(f)).collect()}
        assert got == {i: v if v is None else pytest.approx(v) for i, v in want.items()}
    plain = rankstats.holm(df, ["f"], "p", "test", bonferroni=True).filter("f = 'a' AND test = 5").first()
    assert plain["p_adjusted"] == pytest.approx(min(1.0, plain["p"] * 399))


@pytest.mark.parametrize("n", [1, 7, 60, 10_000])
def test_top_band_pairs_equal_the_sorted_join(spark, n):
    rng = np.random.default_rng(10)
    sides = [frame(spark, e=[f"{s}{i:03d}" for i in range(m)], x=np.round(rng.random(m), 3), y=rng.integers(0, 15, m) * 1.0)
             for s, m in (("h", 90), ("l", 110))]
    sides[0] = sides[0].unionByName(spark.createDataFrame([("h_null", None, 99.0), ("h_none", 0.5, None)], "e string, x double, y double"))
    pairs = matching.band_join(*sides, "x", 0.05, ["e", "x", "y"]).dropna().withColumn("y_gap", F.col("high_y") - F.col("low_y"))
    want = [(r["high_e"], r["low_e"], r["y_gap"]) for r in pairs.orderBy(F.desc("y_gap"), "high_e", "low_e").limit(n).collect()]
    got = [(r["high_e"], r["low_e"], r["y_gap"]) for r in matching.top_band_pairs(*sides, "x", 0.05, ["e"], "y", n, salts=3).collect()]
    assert got == want


def test_native_tails_equal_exact_sums(spark):
    cases = [(k, n, p) for n in (1, 2, 15, 16, 17, 60, 400) for p in (0.5, 0.2, 0.97) for k in range(-1, n + 2, max(1, n // 9))]
    df = spark.createDataFrame([*cases, (None, 5, 0.5)], "k long, n long, p double")
    for r in df.select("*", pvalues.binomial_upper_p(F.col("k"), F.col("n"), F.col("p")).alias("u")).collect():
        if r["k"] is None:
            assert r["u"] is None
            continue
        want = math.fsum(math.comb(r["n"], j) * r["p"] ** j * (1 - r["p"]) ** (r["n"] - j) for j in range(max(0, r["k"]), r["n"] + 1))
        assert r["u"] == pytest.approx(min(1.0, want), rel=1e-9, abs=1e-15)
    big = spark.createDataFrame([(500_900, 1_000_000, 0.5)], "k long, n long, p double")
    assert big.select(pvalues.binomial_upper_p(F.col("k"), F.col("n"), F.col("p"))).first()[0] == pytest.approx(
        pvalues.binomial_upper(500_900, 1_000_000, 0.5), rel=1e-9)
    rng = np.random.default_rng(11)
    tables = [tuple(int(x) for x in rng.integers(0, m, 4)) for m in (2, 6, 30, 200) for _ in range(12)] + [(0, 0, 0, 0), (9, 0, 0, 9), (0, 7, 5, 0)]
    rows = spark.createDataFrame(tables, "a long, b long, c long, d long")
    for r in rows.select("*", pvalues.fisher_two_sided_p(*[F.col(x) for x in "abcd"]).alias("u")).collect():
        row, col, n = r["a"] + r["b"], r["a"] + r["c"], r["a"] + r["b"] + r["c"] + r["d"]
        ways = {x: math.comb(col, x) * math.comb(n - col, row - x) for x in range(max(0, row + col - n), min(row, col) + 1)}
        want = sum(w for w in ways.values() if w <= ways[r["a"]] * (1 + 1e-7)) / sum(ways.values())
        assert r["u"] == pytest.approx(want, rel=1e-9)
