"""Classifiers, extraction, scoring, top-k search, near-duplicates and the pipeline."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sigweave.llm import neardup, pii, pseudolm, quality, topk, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, score string, _label string, _text string"


def frame(spark, texts, start=0):
    rows = [(start + i, t, "en", f"s{i % 2}", "x", "y", "z") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def prose(spark):
    """600 documents: a third shouts, a third holds two insults; with nulls and repeats."""
    rnd = random.Random(4)
    words = ["tree", "house", "water", "light", "stone", "river", "cloud", "the", "of", "and"]
    texts, labels = [], []
    for i in range(600):
        text = [rnd.choice(words) + rnd.choice(["", "s", "ed"]) for _ in range(rnd.randint(30, 90))]
        if i % 3 == 1:
            text = [w.upper() + "!!" for w in text]
        if i % 3 == 2:
            for _ in range(2):
                text.insert(rnd.randrange(len(text)), rnd.choice(["idiot", "moron", "scum"]) + rnd.choice(["", "s", "like"]))
        texts.append(" ".join(text))
        labels.append((i, int(i % 3 != 1), int(i % 3 == 2)))
    texts += [None, "", texts[0], " \n "]
    labels += [(None, 1, 1), (0, 1, None), (5000, 0, 0)]
    return frame(spark, texts), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_quality_separates_held_out(spark, prose, empty):
    docs, labels = prose
    model = quality.fit(docs, labels.filter("doc_id % 4 <> 0"))
    got = {r["doc_id"]: r for r in quality.score(docs, model).collect()}
    assert all(got[i]["predicted"] == int(i % 3 != 1) for i in range(0, 600, 4))
    assert all(0 <= r["score"] <= 1 for r in got.values()) and len(got) == docs.count()
    assert got[0]["score"] == got[602]["score"]  # a repeated text
    none = quality.fit(docs, labels.limit(0))
    assert {r["score"] for r in quality.score(docs, none).collect()} == {0.5}
    assert quality.score(empty, model).count() == 0


def test_tree_arrays_descend_like_single_rows():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 20))
    y = ((x[:, 3] > 0) ^ (x[:, 5] > 1)).astype(float)
    model = quality.grow(x, y, trees=20, depth=3)
    assert ((model.probability(x) > 0.5) == y).mean() > 0.97
    for row in range(25):
        margin = model.base
        for feature, cut, leaf in zip(model.feature, model.cut, model.leaf, strict=True):
            node = 0
            while node < len(feature):
                node = 2 * node + 1 + int(x[row, feature[node]] > cut[node])
            margin += leaf[node - len(feature)]
        assert model.margin(x[row:row + 1])[0] == pytest.approx(margin)


def test_toxicity_tags_spans(prose, empty):
    docs, labels = prose
    crf = toxicity.fit(docs, labels.filter("doc_id % 4 <> 0"))
    got = {r["doc_id"]: r for r in toxicity.score(docs.withColumn("again", F.col("text")), crf).collect()}
    for i in range(0, 600, 4):
        assert got[i]["predicted"] == int(i % 3 == 2), i
    for i in range(2, 600, 3):
        tagged = {got[i]["again"][s["start"]:s["end"]][:4] for s in got[i]["spans"]}
        assert tagged and tagged <= {"idio", "moro", "scum"}
    assert got[600]["spans"] == [] and got[600]["score"] == got[601]["score"] == got[603]["score"]
    none = toxicity.fit(docs, labels.limit(0))
    assert {r["score"] for r in toxicity.score(docs, none).collect()} == {0.5}
    assert toxicity.score(empty, crf).count() == 0


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(2)
    crf = toxicity.Field({}, rng.normal(size=(3, 7)), 0.3, rng.normal(size=(2, 2)))
    levels = [np.array(x, np.int8) for x in ([1, 0, 6, 2], [0], [], [3, 3, 0, 0, 5])]
    for x, p in zip(levels, toxicity.marginals(crf, levels), strict=True):
        weights, sums = 0.0, np.zeros(len(x))
        padded = [0, *x, 0]
        for labels in itertools.product((0, 1), repeat=len(x)):
            s = sum(y * (crf.bias + crf.emit[0][padded[i]] + crf.emit[1][padded[i + 1]] + crf.emit[2][padded[i + 2]]) for i, y in enumerate(labels))
            s += sum(crf.moves[a, b] for a, b in itertools.pairwise(labels))
            weights += np.exp(s)
            sums += np.exp(s) * np.array(labels)
        assert np.allclose(p, sums / weights)


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_spans(text):
    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))]
    for m in CARD.finditer(text):
        digits = [int(c) for c in m.group() if c.isdigit()]
        odd = sum(digits[-1::-2]) + sum(sum(divmod(2 * d, 10)) for d in digits[-2::-2])
        if 13 <= len(digits) <= 19 and odd % 10 == 0:
            out.append(("card", *m.span()))
    return out + [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m.group()) <= 15]


def test_base_spans_equal_plain_patterns():
    rnd = random.Random(5)
    for _ in range(20_000):
        text = "".join(rnd.choice("a.@-+1 2340é()5_") for _ in range(rnd.randint(0, 60)))
        assert pii.base_spans(text) == plain_spans(text)
    parts = ["4111111111111111", "4111 1111 1111 1111", " ", "+1 (222) 555-1234", "1.2.3.4", "300.1.1.1", "001.02.3.4", "x@y.co", "@", ".", "-", "5"]
    for _ in range(5_000):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 20)))
        assert pii.base_spans(text) == plain_spans(text)
    for text in ("1" * 50_000, "a" * 50_000 + "@", "a@" * 20_000, "1.2." * 20_000):  # long runs stay linear
        pii.base_spans(text)


def test_extraction_finds_unseen_identifiers(spark, empty):
    texts = [f"please call me at +1 (222) 555-{1000 + i} now" for i in range(20)]
    texts += ["please call me at 2225551234 now", "again 2225551234 elsewhere", "please pay 99887766 today", None, "", "x" * 30_000,
              "please call me at 2225551234 now"]
    docs = frame(spark, texts)
    got = {r["doc_id"]: r for r in pii.span_digest(pii.find_spans(docs)).collect()}
    assert len(got) == len(texts)
    assert got[20]["spans"] == "phone:18:28" and got[21]["spans"] == "phone:6:16" and got[22]["spans"] == ""
    assert got[20]["n_phone"] == 0 and got[0]["n_phone"] == 1
    for i, t in enumerate(texts):
        want = ",".join(f"{k}:{a}:{b}" for k, a, b in plain_spans(t or ""))
        assert got[i]["base_sha256"] == hashlib.sha256(want.encode()).hexdigest()
    masked = pii.mask(docs)
    assert masked.columns == docs.columns
    texts_out = {r["doc_id"]: r["text"] for r in masked.collect()}
    assert texts_out[0] == texts_out[20] == "please call me at [PHONE] now" and texts_out[23] is None
    assert pii.find_spans(empty).count() == 0 and pii.mask(empty).count() == 0


def test_candidates_are_whole_numbers_and_addresses():
    for text, want in (("ring 030 1234 5678 now", [("digits", "030 1234 5678")]), ("at (555) 123-4567.", [("digits", "(555) 123-4567")]),
                       ("card 4111 1111 1111 1112", [("digits", "4111 1111 1111 1112")]), ("to jane dot doe at site dot org now", [("at", "jane dot doe at site dot org")]),
                       ("to jane [at] site.org", [("at", "jane [at] site.org")]), ("ip 300.1.1.1", [("dotted", "300.1.1.1")]),
                       ("1 2 3 4 5 6 7 8", []), ("in 1999. 2000 people", []), ("call at noon", [])):
        assert [(k, text[a:b]) for k, a, b in pii.candidates(text, pii.base_spans(text))] == want
    for text in ("1 " * 50_000, "12 at " * 20_000, "a.b at " * 20_000, "a@b.co 12-34 " * 5_000):  # linear
        pii.candidates(text, pii.base_spans(text))


def test_extraction_reaches_spaced_numbers_and_a_second_hop(spark):
    """(030) numbers stand beside seeds' words; they alone induce the pattern that finds the last one."""
    texts = [f"please call me at +1 (222) 555-{1000 + i} now" for i in range(20)]
    texts += [f"please call me at (030) 1234 567{i} now" for i in range(4)]
    texts += [f"desk line is (030) 1234 567{i} thanks" for i in range(4)]
    texts += ["desk line is 040 7654 3210 thanks", "lottery draw was 11 2233 4455 today"]
    texts += [f"please write to a{i}@b.org today" for i in range(6)] + ["please write to jane dot doe at site dot org today"]
    docs = frame(spark, texts)
    masked = {r["doc_id"]: r["text"] for r in pii.mask(docs).collect()}
    assert masked[20] == "please call me at [PHONE] now" and masked[24] == "desk line is [PHONE] thanks"
    assert masked[28] == "desk line is [PHONE] thanks" and masked[29] == texts[29]
    assert masked[36] == "please write to [EMAIL] today"


def test_scoring_learns_order(spark, empty):
    rnd = random.Random(6)
    cycle = ["one", "two", "three", "four", "five", "six"]
    texts = []
    for _ in range(400):
        s = rnd.randrange(6)
        texts.append(" ".join(cycle[(s + i) % 6] for i in range(60)))
    shuffled = [" ".join(rnd.sample(t.split(), 60)) for t in texts[:40]]
    docs = frame(spark, [*texts, *shuffled, None, "", "unseen words only", "x " * 20_000])
    got = {r["doc_id"]: r for r in pseudolm.pseudo_likelihood(docs.withColumn("n_tokens", F.lit("clash"))).collect()}
    ordered = np.mean([got[i]["mean_log_likelihood"] for i in range(400)])
    mixed = np.mean([got[i]["mean_log_likelihood"] for i in range(400, 440)])
    assert ordered > mixed + 0.5
    assert got[440]["n_tokens"] == 0 and got[440]["log_likelihood"] == 0 and got[441]["mean_log_likelihood"] is None
    assert got[442]["n_tokens"] == 3 and got[443]["n_tokens"] == 20_000
    assert pseudolm.pseudo_likelihood(empty).count() == 0


def test_network_probabilities_sum_to_one():
    net = pseudolm.fresh()
    flat = np.full(5, pseudolm.PAD)
    flat[[0, 1, 3, 4]] = [5, 70, 3, 900]
    total = 0.0
    for w in range(pseudolm.VOCABULARY):
        flat[2] = w
        total += np.exp(pseudolm.log_probabilities(net, flat, np.array([2]))[0])
    assert total == pytest.approx(1, abs=1e-4)


def test_rare_words_are_scored_by_their_counts(spark):
    """Two words of one bucket differ by what the corpus counts for them, and every frequent word has its own place."""
    buckets, first, pair = pseudolm.BUCKETS, {}, None
    for i in range(1000):
        word = f"rare{i}"
        if (other := first.setdefault(zlib.crc32(word.encode()) % buckets, word)) != word:
            pair = (other, word)
            break
    fill = [" ".join(f"w{i}" for i in range(960))] * 30  # the frequent words
    texts = [*fill, *[f"w1 w2 {pair[0]} w3 w4"] * 16, *[f"w1 w2 {pair[1]} w3 w4"] * 2]
    got = {r["doc_id"]: r for r in pseudolm.pseudo_likelihood(frame(spark, texts)).collect()}
    assert got[30]["log_likelihood"] - got[46]["log_likelihood"] == pytest.approx(np.log(16 / 2), abs=1e-4)
    assert got[30]["log_likelihood"] == got[31]["log_likelihood"]
    often = spark.createDataFrame([(f"v{i}".encode(), pseudolm.OFTEN) for i in range(3000)], "word binary, n long")
    places = pseudolm.Ids(pseudolm.frequent_words(often))
    assert len({places[f"v{i}".encode()] for i in range(3000)}) == 3000 and places.first_bucket == 3000 < places.pad


def test_common_words_need_no_join_and_any_split_scores_alike(spark):
    """Where the shares of rarer words come from, a table or a join, tells no results apart."""
    fill = [" ".join(f"w{i}" for i in range(960))] * 30
    docs = frame(spark, [*fill, *["w1 Once" + " twice w2 twice" * (i % 3) + f" only{i}" for i in range(40)], None, ""])
    counts = pseudolm.word_counts(docs)
    times = {bytes(r["word"]): r["n"] for r in counts.collect()}
    assert len(times) == 960 + 42 and times[b"once"] == 40 and times[b"twice"] == 78 and times[b"only7"] == 1 and times[b"w1"] == 70
    frequent = pseudolm.frequent_words(counts)
    rare = times.keys() - frequent.keys()  # 42 of them: "once" and "twice" are among the frequent, two that occur 30 times are not
    assert len(rare) == 42 and sum(times[w] == 30 for w in rare) == 2
    got, net = [], None
    for most, held in ((0, 0), (1, 0), (41, 2), (42, 42), (pseudolm.COMMON, 42)):
        common, rest = pseudolm.split_shares(counts, frequent, most)
        joined = {bytes(r["word"]) for r in rest.collect()}
        assert common.num_rows == held and set(common.column("word").to_pylist()) | joined == rare and len(joined) == 42 - held
        ids, plain = pseudolm.Ids(frequent, common), pseudolm.Ids(frequent)
        own, share = ids.look_up(pa.array(sorted(times), pa.binary()))
        assert own.tolist() == [plain[w] for w in sorted(times)] and np.isnan(share).sum() == len(joined)
        net = net or pseudolm.train(docs, frequent, common)
        rows = pseudolm.score(docs, net, frequent, common, rest).orderBy("doc_id").collect()
        got.append([(r["n_tokens"], r["log_likelihood"]) for r in rows])
    for other in got[1:]:
        assert np.allclose(got[0], other, rtol=0, atol=1e-5)


def test_every_position_is_a_target_once():
    for n, masked in ((0, 0.15), (1, 0.15), (1000, 0.15), (30_000, 0.5), (10, 1.0)):
        steps = list(pseudolm.masks(np.arange(n), masked, np.random.default_rng(1)))
        assert sorted(i for s in steps for i in s) == list(range(n)) and all(len(s) <= pseudolm.BATCH for s in steps)


def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    vectors = [(i, [float(x) for x in rng.normal(size=20)]) for i in range(400)]
    vectors += [(400 + i, vectors[7][1]) for i in range(12)]  # ties
    odd = [(900, None), (901, [1.0, None] * 10), (950, [float("nan")] * 20), (902, [float("inf")] * 20), (None, vectors[0][1]), (903, []), (904, [1.0] * 3)]
    df = spark.createDataFrame(vectors + odd, "vec_id long, embedding array<float>").withColumn("score", F.lit("x"))
    for blocks in ({}, {"queries_per_block": 3, "candidates_per_block": 50, "dims_per_block": 3}):
        got = {}
        for r in topk.exact_top_k(df, F.col("vec_id") % 50 == 0, **blocks).collect():
            got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
        whole = {i: np.floor(256 * np.array(v, np.float32).astype(float)) for i, v in vectors}
        assert set(got) == {i for i in whole if i % 50 == 0}
        for q, rows in got.items():
            best = sorted((-int(whole[q] @ v), i) for i, v in whole.items() if i != q)[:5]
            assert sorted(rows) == [(k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert topk.exact_top_k(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def brute_components(texts, width, percent):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for i, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(lower))
        n = min(width, len(w))
        sets[i] = {tuple(w[k:k + n]) for k in range(len(w) - n + 1)} if n else set()
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize(("width", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates_equal_brute_force(spark, empty, width, percent):
    rnd = random.Random(7)
    vocabulary = [f"w{i}" for i in range(300)]
    texts = {}
    for g in range(25):
        base = [rnd.choice(vocabulary) for _ in range(rnd.randint(20, 120))]
        for _ in range(rnd.randint(1, 12)):
            copy = list(base)
            for _ in range(rnd.randint(0, max(1, len(copy) // 25))):
                copy[rnd.randrange(len(copy))] = rnd.choice(vocabulary)
            texts[len(texts)] = " ".join(copy)
    chain = [rnd.choice(vocabulary) for _ in range(100)]
    for _ in range(150):  # a drifting group larger than a small node
        chain = [*chain[1:], rnd.choice(vocabulary)]
        texts[len(texts)] = " ".join(chain)
    passage = " ".join(rnd.choice(vocabulary) for _ in range(60))
    for _ in range(90):  # a passage that unrelated documents share
        texts[len(texts)] = passage + " " + " ".join(rnd.choice(vocabulary) for _ in range(40))
    for t in [None, "", "  \n", "a b", "A  B", "b a", "a", "a b c", texts[0], texts[0].upper(), "x y " * 20_000]:
        texts[len(texts)] = t
    docs = spark.createDataFrame([(i, t, "k", "c", "d") for i, t in texts.items()], "doc_id long, text string, kept string, component_id string, _id string")
    docs = docs.unionByName(docs.filter("doc_id < 3")).unionByName(docs.filter("doc_id = 5").withColumn("doc_id", F.lit(None).cast("long")))
    want = brute_components(texts, width, percent)
    rows = neardup.near_duplicates(docs, width=width, percent=percent).collect()
    assert len(rows) == len(texts) + 4
    for r in rows:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]]
            assert r["kept"] == (r["doc_id"] == want[r["doc_id"]][1])
    assert neardup.near_duplicates(empty).count() == 0


def test_large_last_nodes_are_compared_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(neardup, "SMALL_NODE", 4)
    monkeypatch.setattr(neardup, "BLOCK", 5)
    rnd = random.Random(8)
    text = [f"w{i}" for i in range(80)]
    texts = {}
    for i in range(60):
        text = list(text)
        text[rnd.randrange(80)] = f"v{i}"
        texts[i] = " ".join(text)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    want = brute_components(texts, 3, 85)
    assert {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(docs, width=3, percent=85).collect()} == {i: c for i, (_, c) in want.items()}


def test_pipeline_equals_its_stages_by_brute_force(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = corpus_pipeline.quality_stage(spark, docs, sf)
    assert kept.columns == docs.columns
    kept.write.parquet(f"{tmp_path}/kept")
    kept = spark.read.parquet(f"{tmp_path}/kept")
    texts = {r["doc_id"]: r["text"] for r in kept.collect()}
    want = {i for i, (_, c) in brute_components(texts, 5, 80).items() if i == c}
    got = corpus_pipeline.run(spark, sf)
    rows = got.collect()
    assert {r["doc_id"] for r in rows} <= want
    unique = corpus_pipeline.near_duplicate_stage(spark, kept, sf)
    assert {r["doc_id"] for r in unique.collect()} == want
    masked = {r["doc_id"]: r["text"] for r in corpus_pipeline.personal_data_stage(spark, unique, sf).collect()}
    for r in rows:
        assert r["decoded_sha256"] == hashlib.sha256((masked[r["doc_id"]] or "").encode()).hexdigest()
        assert not plain_spans(masked[r["doc_id"]] or "")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), sf).count() == 0, name


def test_stages_take_clashing_names_and_repeated_rows(spark):
    rnd = random.Random(4)
    text = " ".join(rnd.choice("abcdefgh") + str(i) for i in range(60))
    rows = [(1, text), (1, text), (2, text + " more"), (3, "call +49 30 1234567 now"), (3, "call +49 30 1234567 now"), (None, text), (None, text), (None, None), (4, None), (5, "")]
    names = "doc_id long, text string, source string, _pii string, _pii_more string, _mix_rate string, _mix_copy string, _Pii_more2 string"
    docs = spark.createDataFrame([(i, t, None if i == 2 else "s", *"abcde") for i, t in rows], names)
    kept = corpus_pipeline.near_duplicate_stage(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in kept.collect()) == sorted([(0, ""), (0, text), (1, text), (3, rows[3][1]), (4, ""), (5, "")])
    masked = pii.mask(docs)
    assert masked.columns == docs.columns and masked.count() == len(rows)
    assert {r["text"] for r in masked.filter("doc_id = 3").collect()} == {"call [PHONE] now"}
    mixed = corpus_pipeline.mixing_stage(spark, docs, "")
    assert mixed.columns == docs.columns and {r["text"] for r in mixed.collect()} <= {t for _, t in rows}


def test_window_network_descends_its_gradient():
    rng = np.random.default_rng(3)
    net = {k: v.astype(np.float64) for k, v in pseudolm.fresh().items()}
    ids = rng.integers(0, 40, 30)
    flat = np.concatenate([[pseudolm.PAD] * 2, ids, [pseudolm.PAD] * 2])
    at, moved = np.arange(2, 32), {k: v.astype(np.float32) for k, v in net.items()}
    speed = {k: np.zeros_like(v) for k, v in moved.items()}
    pseudolm.train_step(moved, speed, flat, at, 0.05)
    for k in net:  # the first step's squared gradient is what AdaGrad has seen
        for i in rng.permutation(np.flatnonzero(speed[k] > 1e-8))[:6]:
            step = {}
            for sign in (1, -1):
                other = {n: v.copy() for n, v in net.items()}
                other[k].ravel()[i] += sign * 1e-3
                step[sign] = -pseudolm.log_probabilities({n: v.astype(np.float32) for n, v in other.items()}, flat, at).mean()
            slope = (step[1] - step[-1]) / 2e-3
            assert abs(slope * slope - speed[k].ravel()[i]) < 1e-3 * max(1.0, abs(slope)) and abs(
                abs(slope) - np.sqrt(speed[k].ravel()[i])) < 2e-3
            assert (moved[k].ravel()[i] - net[k].ravel()[i]) * slope < 0
    untouched = np.setdiff1d(np.arange(pseudolm.VOCABULARY), ids)
    assert (moved["embed"][untouched] == net["embed"][untouched].astype(np.float32)).all()


def test_words_of_a_batch_are_those_of_its_texts():
    texts = ["", "  A b\tÄ\x0bb ", "\n", "b\x1cc b\u2003c", "É a A\x0c", "x"]
    lens, entry, words = pseudolm.batch_words(pa.array(["cut off", *texts])[1:])
    assert lens.tolist() == [len(pseudolm.words_of(t)) for t in texts]
    assert words.take(pa.array(entry)).to_pylist() == [w for t in texts for w in pseudolm.words_of(t)]
    ids = pseudolm.Ids({b"b": 0, b"a": 1})
    flat, at, own = pseudolm.stream(lens, entry, words, ids)
    gap = [ids.pad] * 2
    assert flat.tolist() == gap + [i for t in texts for i in [*(ids[w] for w in pseudolm.words_of(t)), *gap]]
    assert at.tolist() == np.flatnonzero(flat != ids.pad).tolist()
    rare = pseudolm.rare_words(np.repeat(np.arange(6), lens), entry, words, own >= 2, 6).to_pylist()
    for t, found in zip(texts, rare, strict=True):
        own_words = pseudolm.words_of(t)
        assert {r["word"]: r["n"] for r in found} == {w: own_words.count(w) for w in own_words if w not in (b"a", b"b")}
    none = pseudolm.batch_words(pa.array([""]))
    assert none[0].tolist() == [0] and len(none[1]) == 0 and pseudolm.stream(*none, ids)[0].tolist() == gap * 2
    assert pseudolm.rare_words(np.zeros(0, int), none[1], none[2], np.zeros(0, bool), 1).to_pylist() == [[]]


def test_steep_networks_neither_overflow_nor_differ_in_pieces():
    rng = np.random.default_rng(6)
    ids = rng.integers(0, 900, 3000)
    flat, at = np.concatenate([[pseudolm.PAD] * 2, ids, [pseudolm.PAD] * 2]), np.arange(2, 3002)
    for scale in (1.0, 400.0):
        net = {k: (v * scale).astype(np.float32) for k, v in pseudolm.fresh().items()}
        assert pseudolm.stays_safe(net["cls"], net["word"]) == (scale == 1.0)
        cls, place = pseudolm.class_of(flat[at], pseudolm.CLASSES)
        h = pseudolm.hidden(net, flat, at)[2].astype(float)
        first = h @ net["cls"] + net["cls_bias"]
        second = np.einsum("nh,nhc->nc", h, net["word"][cls].astype(float)) + net["word_bias"][cls]
        each = np.arange(len(at))
        want = sum(x[each, i] - x.max(1) - np.log(np.exp(x - x.max(1, keepdims=True)).sum(1)) for x, i in ((first, cls), (second, place)))
        assert np.allclose(pseudolm.log_probabilities(net, flat, at), want, rtol=1e-4, atol=1e-4)
        speed = {k: np.zeros_like(v) for k, v in net.items()}
        pseudolm.train_step(net, speed, flat, at, 0.05)
        assert all(np.isfinite(v).all() for v in net.values())


def test_copies_are_averaged_by_weight_in_any_order(spark):
    rng = np.random.default_rng(4)
    values, weight = rng.normal(size=(150, 3)), rng.integers(1, 9, 150)
    rows = [(0, int(i), int(weight[i]), values[i].tolist()) for i in rng.permutation(150)]
    kind = "at long, copy long, weight long, values array<double>"
    copies = spark.createDataFrame(rows, kind).repartition(7)
    some = copies.groupBy("at", F.pmod("copy", F.lit(pseudolm.FAN)).alias("_part")).applyInArrow(pseudolm.block_mean, kind)
    (mean,) = some.groupBy("at").applyInArrow(pseudolm.block_mean, kind).collect()
    assert np.allclose(mean["values"], (values * weight[:, None]).sum(0) / weight.sum()) and mean["weight"] == weight.sum()
