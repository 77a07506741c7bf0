import json
import random

import pytest
from pyspark.sql import functions as F

from sigweave.functions import text as X
from sigweave.operators import checks, collapse, groups, labels, matching, region
from sigweave.plans import studies
from sigweave.sources import lookups, readers, schemas, sinks


def classes(spark, column, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[0] for r in df.orderBy("i").select(column).collect()]


def test_narrow_classes(spark):
    c = X.keyword_class("t", lookups.NARROW_CLASSES, absent=None)
    got = classes(spark, c, ["HDAC inhibitor", "dopamine receptor agonist", "EGFR inhibitor", None, "", "vitamin",
                             "hdac INHIBITOR", "EGFR inhibitor|HDAC inhibitor", "EGFR inhibitor|dopamine receptor agonist"])
    assert got == ["machinery", "receptor", "kinase", None, None, "other", "machinery", "machinery", "kinase"]


def test_broad_classes(spark):
    c = X.keyword_class("t", lookups.BROAD_CLASSES, absent="no_annotation", other="excluded")
    texts = ["glucocorticoid receptor agonist", "estrogen receptor antagonist|HDAC inhibitor", None, "", "PARP inhibitor",
             "AKT inhibitor|opioid receptor agonist", "adenosine receptor antagonist", "unknown", "PARP inhibitor|AKT inhibitor"]
    want = ["excluded", "excluded", "no_annotation", "no_annotation", "machinery", "kinase", "receptor", "excluded", "machinery"]
    assert classes(spark, c, texts) == want
    rows = [(k, i, w) for i, (k, ws) in enumerate(lookups.BROAD_CLASSES) for w in ws]
    kw = spark.createDataFrame(rows, "class string, priority int, keyword string")
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    out = X.classify_by_table(df, "t", kw, absent="no_annotation", other="excluded").orderBy("i").collect()
    assert [r["cls"] for r in out] == want


def test_predicates(spark):
    nhr = X.any_keyword("t", lookups.NUCLEAR_RECEPTOR)
    con = X.without(X.any_keyword("t", lookups.CONSTITUTIVE_MACHINERY), nhr)
    nar = X.without(X.any_keyword("t", lookups.NARROW_CONSTITUTIVE_MACHINERY), nhr)
    texts = ["androgen receptor agonist", "Tubulin inhibitor", "HDAC inhibitor", "tubulin inhibitor|PPAR receptor agonist", None, ""]
    assert classes(spark, nhr, texts) == [True, False, False, True, False, False]
    assert classes(spark, con, texts) == [False, True, True, False, False, False]
    assert classes(spark, nar, texts) == [False, True, False, False, False, False]


def test_scalar_helpers(spark):
    df = spark.createDataFrame([("10", "AAA-BBB-CCC|x", " a | b"), ("bad", "Q", "c"), ("-1", "", None)], "d string, k string, l string")
    got = df.select(X.numeric_or_null("d"), X.key_prefix("k", 3), X.first_token("l"), X.integer_id("d")).collect()
    assert [tuple(r) for r in got] == [(10.0, "AAA", "a", 10), (None, "Q", "c", None), (-1.0, "", None, None)]
    r = spark.createDataFrame([(x,) for x in (0.5, 1.0, 2.0, 19.9, 10000.0)], "x double")
    b = groups.ratio_bin(F.col("x"), lookups.DOSE_RATIO_EDGES, lookups.DOSE_RATIO_LABELS)
    assert [q[0] for q in r.select(b).collect()] == ["unbinned", "1-2x", "2-5x", "5-20x", "unbinned"]


def test_removal_guard(spark):
    df = spark.createDataFrame([("HDAC1",), ("hdac6",), ("EGFR",), (None,)], "t string")
    assert labels.remove_class(df, "t", "HDAC", low=1, high=2).count() == 2
    with pytest.raises(Exception, match="outside its expected range"):
        labels.remove_class(df, "t", "HDAC", low=10, high=40).collect()
    syn = spark.createDataFrame([("Histone deacetylase 1",), ("HDAC1",)], "t string")
    assert labels.missed_synonyms(syn, "t", "HDAC", lookups.HDAC_SYNONYMS).count() == 1


def test_checks(spark):
    a = spark.createDataFrame([(0, "g0"), (1, "g1")], "idx int, feature_id string")
    b = spark.createDataFrame([(0, "g0"), (1, "gX"), (2, "g2")], "idx int, feature_id string")
    assert checks.axis_mismatches(a, a).isEmpty() and checks.axis_mismatches(a, b).count() == 2
    assert checks.duplicates(a.union(a), ["idx"]).count() == 2
    assert checks.not_contained(a, b, ["feature_id"]).count() == 1
    assert checks.overlap(a, b, ["feature_id"]).count() == 1
    with pytest.raises(Exception, match="broken"):
        checks.ensure(a, F.col("idx") == 0, "broken").collect()


def test_lists(spark):
    scores = spark.createDataFrame([("aspirin", 0.1), ("Imatinib", 0.9), ("x", 0.5)], "name string, di double")
    names = lookups.name_table(spark, ["aspirin", "imatinib", "absent"])
    exact = {r["name"]: r["found"] for r in matching.found_in(names, scores, "name").collect()}
    assert exact == {"aspirin": True, "imatinib": False, "absent": False}
    loose = matching.found_in(names, scores, "name", ignore_case=True).filter("found").count()
    assert loose == labels.in_list(scores, "name", names).count() == 2
    s = studies.list_study(scores, "name", "di", names).first()
    assert (s["n_listed"], s["n_found"], s["n_below"]) == (3, 1, 1)


def test_difference_signature_counts_absent_cells_as_zero(spark):
    cells = spark.createDataFrame([(f"p{i}", "G") for i in range(10)] + [(f"c{i}", "control") for i in range(4)]
                                  + [(f"q{i}", "few") for i in range(3)], "cell_id string, perturbation string")
    expr = spark.createDataFrame([("p0", "f1", 20.0), ("c0", "f1", 4.0), ("c1", "f2", 8.0), ("p1", "zz", 9.0), ("q0", "f1", 1.0)],
                                 schemas.CELL_EXPRESSION)
    panel = spark.createDataFrame([("f1",), ("f2",), ("f3",)], "feature string")
    d = collapse.difference_signature(expr, cells, panel)
    assert {(r["perturbation"], r["feature"]): r["diff"] for r in d.collect()} == {("G", "f1"): 1.0, ("G", "f2"): -2.0}
    full = collapse.zero_fill(panel, d.select("feature", F.col("diff").alias("x")), ["feature"]).collect()
    assert {r["feature"]: r["x"] for r in full} == {"f1": 1.0, "f2": -2.0, "f3": 0.0}


def test_region_instability(spark):
    import numpy as np
    rng = np.random.default_rng(0)
    y = np.array([0, 1] * 20)
    ev = rng.random(40)
    x = rng.normal(size=(40, 6, 5))
    act = spark.createDataFrame([("R", t, n, k, float(x[t, n, k])) for t in range(40) for n in range(6) for k in range(5)],
                                "region string, trial int, neuron int, t int, x double")
    trials = spark.createDataFrame([("R", t, float(y[t]), float(ev[t])) for t in range(40)], "region string, trial int, y double, ev double")
    got = region.coding_vector_instability(act, trials, window=(1, 4), evidence="ev").first()
    m = x[:, :, 1:4].mean(2)
    q = np.digitize(ev, np.quantile(ev, [.25, .5, .75]))
    vs = [m[(q == k) & (y == 1)].mean(0) - m[(q == k) & (y == 0)].mean(0) for k in range(4)]
    u = np.array([v / np.linalg.norm(v) for v in vs])
    raw = 1 - (u @ u.T)[np.triu_indices(4, 1)].mean()
    assert got["raw"] == pytest.approx(raw) and got["corrected"] == pytest.approx(raw / np.sqrt(6))


def test_readers_and_sinks(spark, tmp_path):
    (tmp_path / "sig_info.txt").write_text("sig_id\tpert_iname\tcell_id\tpert_type\tpert_dose\ns1\taspirin\tA\ttrt_cp\t10\ns2\tNaN\tA\ttrt_cp\tbad\n")
    info = readers.delimited(spark, str(tmp_path / "sig_info.txt"), schemas.SIG_INFO)
    assert [tuple(r) for r in info.orderBy("sig_id").select("pert_iname", "pert_dose").collect()] == [("aspirin", "10"), (None, "bad")]
    assert labels.dosed(info).count() == 1
    (tmp_path / "labels.json").write_text(json.dumps({"drugs": [{"pert_iname": "a", "target": "T1 | T2", "moa": "m"}, {"pert_iname": "b", "target": None, "moa": None}]}, indent=1))
    lab = readers.nested_labels(spark, str(tmp_path / "labels.json")).orderBy("pert_iname").collect()
    assert [r["first_target"] for r in lab] == ["T1", None]
    (tmp_path / "rows.json").write_text(json.dumps([{"drug": "a", "mean_heldout_cosine": 0.5}], indent=1))
    assert readers.json_records(spark, str(tmp_path / "rows.json"), schemas.HOLDOUT).first()["mean_heldout_cosine"] == 0.5
    (tmp_path / "keyed.json").write_text(json.dumps({"per_gene": {"G1": {"geodesic_distance": 1.5}, "G2": {"geodesic_distance": 2.0}}}))
    keyed = readers.json_keyed(spark, str(tmp_path / "keyed.json"), schemas.GEODESICS, wrapper="per_gene")
    assert {r["gene"]: r["geodesic_distance"] for r in keyed.collect()} == {"G1": 1.5, "G2": 2.0}
    (tmp_path / "reg.json").write_text(json.dumps({"per_region": {"A": {"raw_bn": 0.5, "n_neurons": 4}, "B": {"bracket_norm": 0.2, "neuron_count": 9}}}))
    reg = readers.region_scores(spark, str(tmp_path / "reg.json"))
    assert {r["region"]: (r["raw"], r["n_neurons"]) for r in reg.collect()} == {"A": (0.5, 4), "B": (0.2, 9)}
    (tmp_path / "bad.json").write_text(json.dumps({"A": {"raw_bn": 0.5}}))
    with pytest.raises(Exception, match="region without"):
        readers.region_scores(spark, str(tmp_path / "bad.json")).collect()
    df = spark.createDataFrame([("a", 0.5)], "drug string, di double")
    sinks.write_csv(df, str(tmp_path / "out_csv"), {"di": "direction_instability"})
    assert spark.read.option("header", True).csv(str(tmp_path / "out_csv")).columns == ["drug", "direction_instability"]
    sinks.write_json(df, str(tmp_path / "out_json"))
    assert spark.read.json(str(tmp_path / "out_json")).first()["di"] == 0.5
    sinks.write_parquet(spark.createDataFrame([("s", [1.0, 2.0])], schemas.SIGNATURES), str(tmp_path / "sig"))
    assert readers.signatures(spark, str(tmp_path / "sig")).first()["vec"] == [1.0, 2.0]
    assert sinks.hand_off(df).count() == 1


def test_class_and_control_studies(spark):
    import numpy as np
    rng = np.random.default_rng(1)
    names = ["HDAC inhibitor"] * 30 + ["dopamine receptor agonist"] * 30 + ["estrogen receptor agonist"] * 20
    vals = np.r_[rng.normal(0.5, 0.05, 30), rng.normal(0.9, 0.05, 30), rng.normal(0.8, 0.05, 20)]
    df = spark.createDataFrame([(i, n, float(v)) for i, (n, v) in enumerate(zip(names, vals))], "k long, moa string, di double")
    c = {r["variant"]: r for r in studies.class_study(df, "k", "moa", ["di"], reps=50).collect()}
    assert c["nuclear_as_machinery"]["auroc_ci_lo"] <= c["nuclear_as_machinery"]["auroc"] <= c["nuclear_as_machinery"]["auroc_ci_hi"]
    assert c["primary"]["auroc"] == 1 and c["nuclear_as_machinery"]["n_pos"] == 50 and c["nuclear_as_receptor"]["n_neg"] == 50
    p = studies.positive_control(df, "k", "moa", "di", reps=100).first()
    assert p["passes"] and p["auroc"] == 1 and p["rank_biserial"] == -1
    assert studies.group_separation(df, "moa", "di").count() == 3


def test_many_keywords_equal_few(spark, monkeypatch):
    rnd = random.Random(3)
    words = ["".join(rnd.choice("abAB é") for _ in range(rnd.randint(1, 5))) for _ in range(60)]
    table = spark.createDataFrame([(f"c{i % 7}", i % 9, w) for i, w in enumerate(words)], "class string, priority int, keyword string")
    texts = ["", None, "ÉA", *["".join(rnd.choice("abAB éx") for _ in range(rnd.randint(1, 30))) for _ in range(150)]]
    df = spark.createDataFrame([(i, t, "k") for i, t in enumerate(texts)], "id long, t string, cls0 string")
    native = X.classify_by_table(df, "t", table, absent="none", out="cls").orderBy("id").collect()
    monkeypatch.setattr(X, "FEW_KEYWORDS", 0)
    assert X.classify_by_table(df, "t", table, absent="none", out="cls").orderBy("id").collect() == native
    many = [(f"kw{i:05d}x", i) for i in range(10_000)]
    automaton = X.KeywordAutomaton(many)
    assert automaton.least("... kw00420x kw00007x kw0000") == 7 and automaton.least("kw00001 x") is None
