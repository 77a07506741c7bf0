"""Fill-in-the-middle, vector codes and the n-gram join against brute force."""

import hashlib
import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigweave.llm import fim, setjoin, vectorcodes
from test_models_and_joins import brute_components

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def form_by_hand(key, text):
    text = text or ""
    digest = hashlib.sha256(f"42:{'' if key is None else key}".encode()).hexdigest()
    h = [int(digest[8 * i:8 * i + 8], 16) for i in range(4)]
    units = UNIT.findall(text)
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in fim.MARKERS) or h[2] % 100 >= 50:
        return n, "plain", None, None, text
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < 80:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_fill_in_middle_equals_brute_force(spark):
    rnd = random.Random(2)
    texts = [None, "", " ", " \t\n ", "a", " a", "a ", "x <P> y", "<S>", "a <M", "P> <S b", "$1 \\2 ${x}", "é 文 是 😀😀  z", "a\x00b c",
             "w " * 60_000, "x" * 200_000, " " * 100_000, "\n".join(["line of text"] * 20_000)]
    texts += ["".join(rnd.choice("ab \n\té😀<>PSM") for _ in range(rnd.randint(0, 300))) for _ in range(200)]
    rows = [(i, t, "n", "f", "_f") for i, t in enumerate(texts)]
    rows += [rows[-1], (None, "no key at all in this row", "n", "f", "_f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n string, _row string, _f string")
    made = fim.fill_in_middle(docs)
    assert made.columns == ["doc_id", "text", "_row", "_f", *fim.RESULTS]
    found = made.withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    assert len(found) == len(rows)
    for r in found:
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) == form_by_hand(r["doc_id"], r["text"])
        assert r["back"] == (r["text"] or "")
    assert {r["form"] for r in found} == {"plain", "psm", "spm"}
    assert fim.fill_in_middle(docs.limit(0)).count() == 0


def test_other_markers_and_rates(spark):
    docs = spark.createDataFrame([(i, f"one two{i} three  four") for i in range(60)], "doc_id long, text string")
    marks = ("[pre$1]", "[suf\\]", "[mid]")
    for r in fim.fill_in_middle(docs, percent=100, spm_percent=0, markers=marks).collect():
        assert r["form"] == "psm" and r["output"].startswith(marks[0])
        rest, middle = r["output"].split(marks[2])
        prefix, suffix = rest[len(marks[0]):].split(marks[1])
        assert prefix + middle + suffix == r["text"] and len(prefix) == r["prefix_chars"]
    for bad in (("<a>", "<a>", "<b>"), ("", "<a>", "<b>"), ("aa", "<b>", "<c>")):
        with pytest.raises(ValueError, match="markers"):
            fim.fill_in_middle(docs, markers=bad)


def codes_by_hand(vectors, parts=8, entries=16, rounds=6, scale=4096):
    """(codes, errors, entries) of [(id, integers)], by looking at every entry."""
    cut = {i: np.floor(np.array(v, float) * scale).astype(object).reshape(parts, -1) for i, v in vectors}
    ids = sorted(cut)
    books = [[cut[i][p] for i in ids[:entries]] for p in range(parts)]

    def best(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), e) for e, c in enumerate(books[p]))

    for _ in range(rounds):
        for p in range(parts):
            of = {}
            for i in ids:
                of.setdefault(best(p, cut[i][p])[1], []).append(cut[i][p])
            for e, xs in of.items():
                books[p][e] = np.array([int(c) // len(xs) for c in sum(xs)], object)
    found = {i: [best(p, cut[i][p]) for p in range(parts)] for i in ids}
    return {i: (bytes(e for _, e in f), int(sum(d for d, _ in f))) for i, f in found.items()}, books


@pytest.mark.parametrize("count", [5, 80])
def test_vector_codes_equal_brute_force(spark, count):
    rng = np.random.default_rng(4)
    vectors = [(int(i), [float(x) for x in np.float32(rng.normal(size=16))]) for i in rng.permutation(count)]
    vectors += [(1000 + i, vectors[i % 3][1]) for i in range(4)]  # the same vector under other ids
    odd = [(900, None), (901, [1.0, None] * 8), (902, [float("nan")] * 16), (903, [float("inf")] * 16), (904, []), (905, [1.0] * 9)]
    label = {i: None if i % 7 == 0 else f"l{i % 3}" for i, _ in vectors}
    rows = [(i, v, label.get(i), "x", "y") for i, v in vectors + odd]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label string, code string, _v string").repartition(5)
    want, books = codes_by_hand(vectors)
    sums = {}
    for i, (_, e) in want.items():
        sums[label[i]] = sums.get(label[i], 0) + e
    digest = hashlib.sha256(",".join(str(int(x)) for part in books for entry in part for x in entry).encode()).hexdigest()
    got = vectorcodes.vector_codes(df).collect()
    assert sorted(r["vec_id"] for r in got) == sorted(want)
    for r in got:
        assert (bytes(r["code"]), r["error"]) == want[r["vec_id"]]
        assert r["label_error"] == sums[r["label"]] and r["codebooks_sha256"] == digest
    assert vectorcodes.vector_codes(df.limit(0)).count() == 0


def test_vector_codes_of_repeated_rows_keys_and_lengths(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(size=8 if i % 2 else 16)], 1) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    apart = {r["vec_id"]: bytes(r["code"]) for n in (8, 16) for r in vectorcodes.vector_codes(df.filter(F.size("embedding") == n)).collect()}
    assert {r["vec_id"]: bytes(r["code"]) for r in vectorcodes.vector_codes(df).collect()} == apart
    twice = df.filter(F.size("embedding") == 8)
    twice = twice.unionByName(twice)
    assert {r["vec_id"]: bytes(r["code"]) for r in vectorcodes.vector_codes(twice).collect()} == {i: c for i, c in apart.items() if i % 2}
    no_key = spark.createDataFrame([(None, [0.5] * 8, 1), (3, [0.25] * 8, None)], df.schema)
    assert sorted(r["error"] for r in vectorcodes.vector_codes(no_key, rounds=0).collect()) == [0, 8 * 1024**2]
    assert vectorcodes.vector_codes(no_key.filter("vec_id IS NULL")).count() == 0
    with pytest.raises(Exception, match="too large"):
        vectorcodes.vector_codes(spark.createDataFrame([(1, [1e30] * 8, 1)], df.schema)).count()


def test_equal_average_search_equals_a_full_scan():
    rng = np.random.default_rng(6)
    for width, spread in ((1, 3), (4, 2), (8, 5000)):
        book = rng.integers(-spread, spread, (16, width))
        book[5] = book[2]
        x = rng.integers(-2 * spread, 2 * spread, (500, width))
        distance = ((x[:, None] - book[None]) ** 2).sum(2)
        at, best = vectorcodes.nearest(x, book)
        assert (at == distance.argmin(1)).all() and (best == distance.min(1)).all()


def corpus_of_sets():
    rnd = random.Random(11)
    vocabulary = [f"w{i}" for i in range(300)]
    texts = {}
    for size in [3, 5, 8, 11, 12, 13, 20, 22, 24, 31, 41, 45, 60, 120]:  # light, heavy and about the boundary
        for _ in range(2):
            base = [rnd.choice(vocabulary) for _ in range(size)]
            for _ in range(8):
                copy = list(base)
                for _ in range(rnd.randint(0, max(1, size // 40))):
                    copy[rnd.choice([0, -1, rnd.randrange(len(copy))])] = rnd.choice(vocabulary)
                texts[len(texts)] = " ".join(copy[:len(copy) - rnd.randint(0, 1 + size // 30)])
    chain = [rnd.choice(vocabulary) for _ in range(100)]
    for _ in range(120):  # a drifting group: no leader is close to all
        chain = [*chain[1:], rnd.choice(vocabulary)]
        texts[len(texts)] = " ".join(chain)
    passage = " ".join(rnd.choice(vocabulary) for _ in range(60))
    for i in range(90):  # a passage that unrelated documents share, and some that are little else
        texts[len(texts)] = passage + " " + " ".join(rnd.choice(vocabulary) for _ in range(40 if i % 3 else rnd.randint(0, 9)))
    for t in [None, "", "  \n", "a b", "A  B", "b a", "a", "a b c", texts[0], texts[0].upper(), "x y " * 20_000,
              " ".join(f"long{i}" for i in range(30_000)), " ".join(f"long{i}" for i in range(29_000))]:
        texts[len(texts)] = t
    return texts


@pytest.mark.parametrize(("width", "percent", "blocks"), [(3, 90, None), (3, 90, 5), (1, 50, 5)])
def test_jaccard_join_equals_brute_force(spark, monkeypatch, width, percent, blocks):
    if blocks:
        monkeypatch.setattr(setjoin, "BLOCK_MEMBERS", blocks)
        monkeypatch.setattr(setjoin, "HUB_PARTNERS", 2)
    texts = corpus_of_sets()
    docs = spark.createDataFrame([(i, t, "k", "c", "d") for i, t in texts.items()], "doc_id long, text string, _n string, component_id string, _id string")
    docs = docs.unionByName(docs.filter("doc_id < 3")).unionByName(docs.filter("doc_id = 5").withColumn("doc_id", F.lit(None).cast("long")))
    want = brute_components(texts, width, percent)
    rows = setjoin.jaccard_join(docs, width=width, percent=percent).collect()
    assert len(rows) == len(texts) + 4
    for r in rows:
        if r["doc_id"] is None:
            assert r["component_id"] is None
        else:
            assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]]
    assert setjoin.jaccard_join(docs.limit(0)).count() == 0


def test_light_sets_link_by_common_subsets_alone(spark):
    """With no heavy side at all, enumeration finds every linked pair of small sets."""
    rnd = random.Random(12)
    rows, sets = [], {}
    names = np.random.default_rng(1).integers(-2**63, 2**63 - 1, 24)
    for i in range(300):
        tokens = sorted(rnd.sample(range(24), rnd.randint(1, 22)))
        if tokens not in sets.values():
            sets[i] = tokens
            rows.append((i, len(tokens), [int(names[t]) for t in tokens]))
    for percent in (80, 90):
        frame = spark.createDataFrame(rows, "_id long, _n long, _first array<long>")
        got = {(r["a"], r["b"]) for r in setjoin.light_pairs(frame, 22, percent).collect()}
        linked = {(a, b) for a, b in itertools.combinations(sorted(sets), 2)
                  if 100 * len(set(sets[a]) & set(sets[b])) >= percent * len(set(sets[a]) | set(sets[b]))}
        assert got <= linked

        def classes(pairs):
            up = {i: i for i in sets}
            for _ in sets:
                for a, b in pairs:
                    up[a] = up[b] = min(up[a], up[b])
            return up

        assert classes(got) == classes(linked)


def test_bitmaps_never_rule_out_a_link():
    rng = np.random.default_rng(13)
    for n in (20, 63, 65, 300, 1000):
        whole = rng.integers(0, 2**63, 2 * n, dtype=np.uint64)
        for cut in (0, n // 20, n // 10, n // 3):
            a, b = np.unique(whole[:n]), np.unique(np.concatenate([whole[cut:n], whole[n:n + cut // 2]]))
            for x, y in zip(setjoin.parity_bits(a), setjoin.parity_bits(b), strict=True):
                assert setjoin.differing([x], [y])[0] <= len(np.setxor1d(a, b))


def test_frequent_shingles_come_last_whatever_the_count(spark, monkeypatch):
    monkeypatch.setattr(setjoin, "NOTED", 2)
    docs = spark.createDataFrame([(f"a b c u{i}",) for i in range(9)] + [("a b c d",)] * 2, "text string").coalesce(1)
    frequent = setjoin.frequent_shingles(docs, "text", 3)
    names = setjoin.shingle_sets(["a b c", "b c d"], 3)
    assert frequent.tolist() == [int(names[1][0]), int(names[0][0])]
    order = np.argsort(frequent)
    tokens = np.sort(np.concatenate([*names, np.array([1, 2], np.uint64)]))
    assert setjoin.in_order(tokens, 3, frequent[order], order).tolist() == [1, 2, int(names[1][0])]
