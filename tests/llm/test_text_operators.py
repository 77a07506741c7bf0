"""Token counts, byte-level BPE, quality rules and mixing against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
import tiktoken
from pyspark.sql import functions as F

from sigweave.llm import bpe, mixing, rules, tokens

MODEL, RANKS = P.path("piece_bpe_32k.model"), P.path("byte_bpe_50k.tiktoken")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_tokens string, _text string"


def odd_texts():
    rnd = random.Random(3)
    letters = "abcdefgh trn  \n\té①文是😀.,'0123456789▁\x00"
    return [None, "", " ", "a", "  a  b ", "▁▁", "<s>x</s> <|endoftext|>", "x" * 5000, " " * 3000, "the" * 1500, "\n\n \n" * 400,
            *["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 1500))) for _ in range(60)],
            *["".join(rnd.choice(["the", "ing", "tion", " ", "er", "'re", "http://", "==="]) for _ in range(900)) for _ in range(20)]]


@pytest.fixture(scope="module")
def odd(spark):
    """Odd texts with clashing column names, a repeated row and a null key."""
    rows = [(i, t, None if i % 5 == 0 else "en", None if i % 4 == 0 else f"s{i % 3}", "x", "y") for i, t in enumerate(odd_texts())]
    rows += [rows[-1], (None, "no key here", "en", "s0", "x", "y")]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_token_counts_equal_the_library(odd, empty):
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    for options in ({}, {"chunk_chars": 16, "look_back": 4}):
        got = tokens.token_counts(odd.withColumn("again", F.col("text")), MODEL, limit=50, **options)
        assert "again" in got.columns and got.columns.count("n_tokens") == 1
        for r in got.collect():
            text = r["again"] or ""
            want = len(library.encode(text))
            assert (r["n_tokens"], r["n_bytes"], r["over_limit"]) == (want, len(text.encode()), want > 50)
    assert tokens.token_counts(empty, MODEL).count() == 0


def test_transducer_refuses_other_models(tmp_path, monkeypatch):
    class Fake:
        def __init__(self, model_file):
            pass

        def vocab_size(self):
            return 1

        def id_to_piece(self, i):
            return "a▁b"

        def get_score(self, i):
            return 0.0

        is_byte = is_control = is_unknown = is_unused = lambda self, i: False

    monkeypatch.setattr(sentencepiece, "SentencePieceProcessor", Fake)
    with pytest.raises(ValueError, match="boundary"):
        tokens.read_pieces("x")


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(open(RANKS, "rb").read()), special_tokens={})


def test_encoding_equals_the_library_and_decodes(odd, empty, library):
    for options in ({}, {"chunk_chars": 20, "overlap_chars": 6}):
        got = bpe.encode(odd.withColumn("again", F.col("text")), RANKS, P.PATTERN, **options)
        for r in bpe.decode(got, RANKS).collect():
            text = r["again"] or ""
            ids = library.encode_ordinary(text)
            assert r["token_ids"] == ids and r["n_tokens"] == len(ids)
            assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
            assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
            assert bytes(r["decoded"]) == text.encode()
    assert bpe.encode(empty, RANKS, P.PATTERN).count() == 0


def test_explicit_pattern_matches_every_character():
    import regex
    plain, own = regex.compile(P.PATTERN), bpe.Matcher(P.PATTERN)
    for c in [*range(0xD800), *range(0xE000, 0x20000)]:
        text = f"a{chr(c)} {chr(c)}"
        assert own(text).findall(text) == plain.findall(text)


def rule_counts(text):
    words = WORD.findall(text)
    windows = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    often = Counter(windows)
    covered = {j for i, w in enumerate(windows) if often[w] > 1 for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))


def test_rule_counts(spark, odd, empty):
    texts = ["a b c d e a b c d e", "a a a a a a a", "w " * 9, "one\ntwo\none\n\n  \none", "1 2 3 4 5 6 1 2 3 4 5 9 1 2 3 4 5", "x # y | <z>"]
    more = spark.createDataFrame([(1000 + i, t, "en", "s", "", "") for i, t in enumerate(texts)], SCHEMA)
    for r in rules.quality_rules(odd.unionByName(more)).join(odd.unionByName(more).select("doc_id", "text"), "doc_id").collect():
        want = rule_counts(r["text"] or "")
        got = tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))
        assert got == want
        assert r["base_failed"] == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert not (r["base_failed"] and r["kept"])
    assert rules.quality_rules(empty).count() == 0


def test_divergence_rule_drops_the_odd_one(spark):
    rnd = random.Random(1)
    words = ["the", "of", "and", "tree", "house", "water", "to", "in", "is", "light"]
    rows = [(i, " ".join(rnd.choice(words) for _ in range(200)), "en") for i in range(40)]
    rows.append((99, " ".join(f"{rnd.randint(0, 99999)}!!" for _ in range(200)), "en"))
    rows.append((100, "SHORT 1 2 3 4 5 6 7 8 9 10", "en"))  # too short to judge
    got = {r["doc_id"]: r["kept"] for r in rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert [i for i, k in got.items() if not k] == [99]


CONTENT = {
    "en": "water house light which tree night school friend bread window thought people".split(),
    "fr": "maison lumière eau arbre nuit école ami pain fenêtre pensée gens beaucoup".split(),
    "de": "wasser haus licht baum nacht schule freund brot fenster gedanke leute zwischen".split(),
    "es": "agua casa luz árbol noche escuela amigo pan ventana pensamiento gente mucho".split(),
}


def prose(rnd, lang, n=300, common=0.35):
    words = [rnd.choice(rules.COMMON_WORDS[lang] if rnd.random() < common else CONTENT[lang]) for _ in range(n)]
    return " ".join(" ".join(words[i:i + 10]).capitalize() + "." for i in range(0, n, 10))


def test_divergence_rule_tells_languages_gibberish_and_salad(spark):
    rnd = random.Random(5)
    rows, clean, strange = [], [], []

    def add(text, lang, ids):
        ids.append(len(rows))
        rows.append((len(rows), text, lang))

    def gibberish():
        return " ".join("".join(rnd.choices("abcdefghijklmnopqrstuvwxyz", k=rnd.randint(2, 9))) for _ in range(500))

    for lang in ("en", "fr", "de"):
        for _ in range(30):
            add(prose(rnd, lang), lang, clean)
        add(prose(rnd, lang).replace(" the ", " The, "), lang, clean)
        add(gibberish(), lang, strange)
        add(prose(rnd, lang, common=0.0), lang, strange)  # a salad of its words
        for other in CONTENT:
            if other != lang:
                add(prose(rnd, other), lang, strange)
    for _ in range(20):
        add(gibberish(), "es", strange)  # junk alone: no reference for itself
    for lang in ("xx", None):
        for _ in range(20):
            add(prose(rnd, "en"), lang, clean)  # no list: by characters
    got = {r["doc_id"]: r for r in rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert not any(r["base_failed"] for r in got.values())
    assert [i for i in clean if not got[i]["kept"]] == []
    assert [i for i in strange if got[i]["kept"]] == []


def test_letters_and_common_words_are_counted(spark, odd):
    more = spark.createDataFrame([(1000, "The THE, the. of\x00of É é 7", "en", "s", "", ""), (1001, "jazz ünd", None, "s", "", "")], SCHEMA)
    for r in rules.text_counts(odd.unionByName(more)).join(odd.unionByName(more).select(F.col("doc_id").alias("_key"), "text"), "_key").collect():
        folded = re.sub("[A-Z]", lambda m: m[0].lower(), r["text"] or "")
        assert r["letters"] == [folded.count(c) for c in rules.LETTERS] + [sum(ord(c) > 127 for c in folded)]
        plain = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", folded)
        known = rules.COMMON_WORDS.get(r["_lang"])
        assert r["common"] == ([plain.count(k) for k in known] + [sum(w not in known for w in plain)] if known else [])


def brute_targets(sizes, weights=(5, 2, 1)):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {n: weights[i % 3] for i, n in enumerate(names)}
    target = {n: 1.5 * sum(sizes.values()) * w[n] / sum(w.values()) for n in names}
    while True:
        excess, free = 0.0, [n for n in names if target[n] < 2 * sizes[n]]
        for n in names:
            if target[n] > 2 * sizes[n]:
                excess += target[n] - 2 * sizes[n]
                target[n] = 2.0 * sizes[n]
        if not excess:
            return target
        for n in free:
            target[n] += excess * w[n] / sum(w[m] for m in free)


def test_mixing_targets_and_copies(spark, odd, empty):
    rnd = random.Random(2)
    big = spark.createDataFrame([(i, "w " * rnd.randint(1, 60), "en", rnd.choice(["a", "b", "b", "c", "d", None]), "", "") for i in range(2000)], SCHEMA)
    for docs in (big, odd):
        rows = mixing.mix_counts(docs.withColumn("doc_id", F.col("doc_id"))).join(docs.select("doc_id", "source", "text"), "doc_id").distinct().collect()
        sizes = Counter()
        for r in docs.collect():
            sizes[r["source"]] += len(WORD.findall(r["text"] or ""))
        want = brute_targets(sizes)
        for r in rows:
            assert r["size"] == len(WORD.findall(r["text"] or "")) and r["source_size"] == sizes[r["source"]]
            assert r["target"] == pytest.approx(want[r["source"]])
            assert r["taken"] <= 2 * r["size"] and (r["size"] == 0 or r["taken"] % r["size"] == 0)
    taken = Counter()
    for r in mixing.mix(big).collect():
        taken[r["source"]] += len(WORD.findall(r["text"]))
    counted = Counter()
    for r in mixing.mix_counts(big).join(big.select("doc_id", "source"), "doc_id").collect():
        counted[r["source"]] += r["taken"]
    assert taken == counted
    sizes = Counter()
    for r in big.collect():
        sizes[r["source"]] += len(WORD.findall(r["text"]))
    for s, t in brute_targets(sizes).items():
        assert abs(taken[s] - t) <= 0.02 * t
    assert mixing.mix_counts(empty).count() == 0 and mixing.mix(empty).count() == 0
    assert mixing.mix(odd).columns == odd.columns


def test_native_operators_run_no_python(odd):
    for df in (mixing.mix_counts(odd), mixing.mix(odd), rules.quality_rules(odd), rules.text_counts(odd)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|InArrow|CartesianProduct|NestedLoop", plan)
