"""Bootstrap and permutation kernels against brute force and against the relational plans."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigweave.functions import draws
from sigweave.operators import replicates as K
from sigweave.operators import resample
from test_statistics import auc, frame


@pytest.fixture
def relational(monkeypatch):
    """Calls a function within the bounds of the kernels, and again beyond them."""
    def both(call):
        kernel = call()
        monkeypatch.setattr(K, "INDEX_ROWS", 0)
        monkeypatch.setattr(resample, "VECTOR_CELLS", 0)
        joined = call()
        monkeypatch.undo()
        return kernel, joined
    return both


def same(a, b):
    assert len(a) == len(b) > 0
    for x, y in zip(a, b, strict=True):
        for p, q in zip(x, y, strict=True):
            assert (p is None and q is None) or p == q or p == pytest.approx(q, rel=1e-9, abs=1e-9)


def ordered(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.select(*cols).orderBy(*cols[:-1]).collect()]


@pytest.fixture(scope="module")
def scores(spark):
    rng = np.random.default_rng(1)
    rows = [(i, g, float(rng.integers(0, 12)), float(rng.normal()) if i % 9 else None, int(rng.integers(0, 2)), ["x", "y", "z"][i % 3])
            for i, g in enumerate(["a"] * 40 + [None] * 30 + [""] * 25)]
    return spark.createDataFrame(rows, "k long, g string, s double, t double, y int, cls string")


def test_draws_agree_with_the_column_form(spark):
    slots = spark.range(200).select(F.col("id"), draws.position(F.lit(200), draws.hash_number(7, F.lit("g"), F.lit(3)), F.col("id")).alias("p"))
    want = draws.drawn_positions(np.array([draws.replicate_number(7, "g", 3)], np.uint64), 200)[0]
    assert [r["p"] for r in slots.orderBy("id").collect()] == want.tolist()


def test_draws_are_uniform_and_independent():
    numbers = np.array([draws.replicate_number(1, r) for r in range(2000)], np.uint64)
    at = draws.drawn_positions(numbers, 50)
    counts = np.bincount(at.ravel(), minlength=50)
    assert ((counts - 2000) ** 2 / 2000).sum() < 100  # chi-square on 49 degrees of freedom
    assert abs(np.corrcoef(at[:, 0], at[:, 1])[0, 1]) < 0.08 and abs(np.corrcoef(at[:-1, 7], at[1:, 7])[0, 1]) < 0.08


def test_classifier_replicates_equal_brute_force(spark, scores, relational):
    def call():
        return ordered(resample.classifier_replicates(scores, "k", ["s", "t"], "y", 25, 3, ["g"]), "g", "metric", "rep", "auroc", "auprc")
    kernel, joined = relational(call)
    same(kernel, joined)
    data = scores.orderBy("k").collect()
    for g, metric, rep, value, _ in kernel:
        own = [r for r in data if r["g"] == g]
        tag = [] if g is None else [g]
        at = draws.drawn_positions(np.array([draws.replicate_number(3, *tag, rep)], np.uint64), len(own))[0]
        drawn = [own[i] for i in at if own[i][metric] is not None]
        assert value == pytest.approx(auc(np.array([r[metric] for r in drawn]), np.array([r["y"] for r in drawn])))


def test_other_bootstraps_equal_their_relational_plans(spark, scores, relational):
    calls = [
        lambda: ordered(resample.bootstrap_classifier(scores, "k", ["s", "t"], "y", reps=20, by=["g"]),
                        "g", "metric", "n_boot", "auroc", "auroc_ci_lo", "auprc_se"),
        lambda: ordered(resample.spearman_replicates(scores, "k", ["s", "t"], "y", 20, 5), "metric", "rep", "rho"),
        lambda: ordered(resample.group_replicates(scores, "k", "s", "y", 20, 5), "rep", "mean_diff", "cohens_d"),
        lambda: ordered(resample.bootstrap_macro_gap(scores.dropna(subset=["t"]), "k", "s", "t", "cls", min_class=5, reps=20), "macro_base", "gap", "n_boot", "se"),
        lambda: ordered(resample.bootstrap_mean(scores, "k", "t", reps=20), "point", "n_boot", "se"),
        lambda: ordered(resample.label_permutations(scores, "k", "s", "y", reps=20, seed=5), "rep", "stat")]
    for call in calls:
        same(*relational(call))


def test_rare_classes_are_drawn_again(spark, relational):
    df = frame(spark, k=np.arange(30), s=np.arange(30) * 1.0, y=(np.arange(30) == 3).astype(int))
    reps = 150
    kernel, joined = relational(lambda: ordered(resample.classifier_replicates(df, "k", ["s"], "y", reps, 1), "rep", "auroc"))
    same(kernel, joined)
    assert len(kernel) == reps and kernel[-1][0] > reps
    hit = [r for r in range(1, 3 * reps + 1) if 3 in draws.drawn_positions(np.array([draws.replicate_number(1, r)], np.uint64), 30)[0]]
    assert [r for r, _ in kernel] == hit[:reps]
    assert resample.bootstrap_classifier(df, "k", ["s"], "y", reps=reps, seed=1).first()["n_boot"] == reps
    none = frame(spark, k=np.arange(5), s=np.arange(5) * 1.0, y=np.zeros(5, int))
    assert resample.classifier_replicates(none, "k", ["s"], "y", 5, 1).count() == 0


def test_signature_shuffles_equal_their_relational_plans(spark, relational):
    rng = np.random.default_rng(2)
    rows = [(f"e{i}", c, float(rng.normal()), float(rng.normal()), [float(x) for x in rng.normal(size=4)], [float(x) for x in rng.normal(size=4)])
            for c in (1, 2) for i in range(22 + c)]
    rows[5] = (*rows[5][:4], [0.0] * 4, rows[5][5])
    rows += [(f"e{i}", 3, 0.0, 0.0, [1.0] * 4, [1.0] * 4) for i in range(5)]  # too few for a fold
    df = spark.createDataFrame(rows, "entity string, context long, train_di double, train_ts double, vec array<double>, train_mean array<double>")
    kernel, joined = relational(lambda: ordered(resample.signature_permutations(
        df.drop("vec", "train_mean"), df.drop("train_di", "train_ts"), "entity", "context", reps=40, seed=7), "context", "rep", "raw_spearman", "ts_spearman"))
    same(kernel, joined)
    assert len(kernel) == 80
    one = df.filter("context = 1")
    same(*relational(lambda: ordered(resample.random_pair_null(one, "entity", "vec", "train_mean", reps=12, seed=5), "rep", "entity", "instability")))
    few = resample.random_pair_null(one, "entity", "vec", "train_mean", reps=1000, seed=5)  # more replicates than rows: gathered
    direct = K.shuffled_cosines(np.eye(3), np.eye(3), np.arange(2, dtype=np.uint64), zero=0.0, eps=0.0)
    gathered = K.shuffled_cosines(np.eye(3), np.eye(3), np.arange(9, dtype=np.uint64), zero=0.0, eps=0.0)
    assert (gathered[:2] == direct).all() and (gathered.sum(1) <= 3).all()
    assert few.filter("instability IS NULL").count() == 1000 and few.count() == 23_000


def test_midranks():
    values = np.array([[3.0, 1.0, 3.0, 2.0], [1.0, 1.0, 1.0, 1.0]])
    assert K.midranks(values).tolist() == [[3.5, 1.0, 3.5, 2.0], [2.5] * 4]
    assert K.midranks(np.zeros((2, 0))).shape == (2, 0)
