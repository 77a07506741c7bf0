"""Quality rules from text statistics and divergence from language references.

DataFrame functions only. One pass turns every text into a narrow row of counts; the
language references are sums of those rows, so they cover all documents. Repeated windows
are found inside the row (sorted window hashes), so no word leaves its document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, WORD, broadcast_if_small, settle, whole_text

#: Frequent function words, by language. Fixed values; languages without a list are judged
#: by their characters alone.
COMMON_WORDS = {
    "en": ["the", "of", "and", "to", "a", "in", "is", "that", "for", "it", "was", "on", "with", "be", "as", "by"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "pour", "est", "qui", "dans", "par"],
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "auf", "des", "ist", "nicht", "im", "ein"],
    "es": ["de", "la", "que", "el", "en", "y", "los", "se", "del", "las", "por", "un", "no", "con", "su", "una"],
}
#: Letters from the most to the least frequent in the four languages together: what is counted
#: first shortens the rest.
LETTERS = "eanirstodlucmphgbvfqyzjxkw"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NO_LETTER = r"\x00-\x40\x5B-\x60\x7B-\x7F"
ANCHOR_PERCENT = 10  # of its words that must be common ones before a document speaks for its language
WINDOW = 5
CLASSES = ["lower", "upper", "digit", "symbol", "other"]
SYMBOLS = r"[#*$%&|<>]"


def without(text: Column, pattern: str) -> Column:
    return F.regexp_replace(text, pattern, "")


def _known(lang: Column) -> Column:
    """The common words of a row's language; none for a language without a list."""
    cases = F.array().cast("array<string>")
    for name, words in COMMON_WORDS.items():
        cases = F.when(lang == name, F.array(*map(F.lit, words))).otherwise(cases)
    return cases


def _counts(known: Column, found: Column, words: Column) -> Column:
    """How often each of ``known`` occurs in ``found``, then how many ``words`` are none of them.

    One expression for all languages: a branch for each would make a method too large to compile.
    """
    each = F.transform(known, lambda k: (F.size(found) - F.size(F.array_remove(found, k))).cast("long"))
    rest = F.array((F.size(words) - F.size(found)).cast("long"))
    return F.when(F.size(known) > 0, F.concat(each, rest)).otherwise(F.array().cast("array<bigint>"))


def _letters(folded: Column) -> Column:
    """How often each letter occurs, then how many characters beyond ASCII there are."""
    start = F.struct(folded.alias("t"), F.array().cast("array<int>").alias("n"))
    gone = F.aggregate(F.array(*map(F.lit, LETTERS)), start, lambda s, c: F.struct(
        F.replace(s["t"], c, F.lit("")).alias("t"), F.concat(s["n"], F.array(F.octet_length(s["t"]))).alias("n")))

    def finish(s: Column) -> Column:
        before, rest = s["n"], s["t"]
        after = F.concat(F.slice(before, 2, len(LETTERS) - 1), F.array(F.octet_length(rest)))
        beyond = F.length(F.regexp_replace(rest, r"[\x00-\x7F]+", ""))
        return F.concat(F.zip_with(before, after, lambda x, y: (x - y).cast("long")), F.array(beyond.cast("long")))

    return F.get(F.transform(F.array(gone), finish), F.lit(0))


def text_counts(docs: DataFrame, *, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Per document: _key, _lang, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    the character classes and letters of its words, and the counts of its language's common words
    and of all others (words of letters there: ASCII case folded, no punctuation)."""
    whole = docs.select(F.col(key).alias("_key"), F.col(lang).alias("_lang"), whole_text(text).alias("_text"))
    cut = whole.select(
        "_key", "_lang",
        F.filter(F.split("_text", rf"[{SPACE}]+"), lambda w: w != "").alias("_w"),
        without(F.col("_text"), rf"[a-z{SPACE}]+").alias("_rest"),
        F.translate("_text", UPPER, LOWER).alias("_folded"),
        F.filter(F.split("_text", "\n"), lambda x: x.rlike(WORD)).alias("_lines"))
    w = F.col("_w")
    cut = cut.withColumn("_v", F.transform(w, lambda x: F.xxhash64(x)))

    def beside(a: Column, b: Column, shift: int) -> Column:
        """Hash of each entry of ``a`` and the entry of ``b`` that lies ``shift`` further; the tail is void."""
        return F.zip_with(a, F.slice(b, shift + 1, F.greatest(F.size("_v") - shift, F.lit(0))), lambda x, y: F.xxhash64(x, y))

    cut = cut.withColumn("_v2", beside(F.col("_v"), F.col("_v"), 1))
    four = beside(F.col("_v2"), F.col("_v2"), 2)
    hashed = F.slice(beside(four, F.col("_v"), WINDOW - 1), 1, F.greatest(F.size(w) - WINDOW + 1, F.lit(0)))
    words = cut.select(
        "_key", "_lang", _known(F.col("_lang")).alias("_known"), "_folded", "_rest", F.filter(F.split("_folded", rf"[{NO_LETTER}]+"), lambda x: x != "").alias("_plain"), F.size(w).cast("long").alias("n_words"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        hashed.alias("_h"))
    h = F.col("_h")
    ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    seen = words.select(
        "*", F.when(F.size(F.array_distinct(h)) < F.size(h), ordered).alias("_o"),
        F.length("_rest").cast("long").alias("_n_rest"),
        *[(F.length("_rest") - F.length(without(F.col("_rest"), p))).cast("long").alias(f"_n_{n}")
          for n, p in (("upper", "[A-Z]+"), ("digit", "[0-9]+"), ("symbol", SYMBOLS + "+"))])
    o = F.col("_o")
    again = F.filter(o, lambda x, i: (F.get(o, i - 1)["h"] == x["h"]) | (F.get(o, i + 1)["h"] == x["h"]))
    plain = F.col("_plain")
    found = F.filter(plain, lambda x: F.array_contains("_known", x))
    placed = seen.withColumns({"_at": F.sort_array(F.transform(again, lambda x: x["i"])), "_found": found})
    at = F.col("_at")
    gaps = F.zip_with(F.slice(at, 2, F.greatest(F.size(at) - 1, F.lit(0))), F.slice(at, 1, F.greatest(F.size(at) - 1, F.lit(0))),
                      lambda b, a: F.least(F.lit(WINDOW), b - a))
    covered = F.when(F.size(at) > 0, F.aggregate(gaps, F.lit(WINDOW).cast("long"), lambda s, g: s + g)).otherwise(0)
    rest = F.col("_n_rest")
    return placed.select(
        "_key", "_lang", "n_words", "word_chars", F.col("_n_symbol").alias("n_symbols"), "n_dup_lines",
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.array(F.col("word_chars") - rest, "_n_upper", "_n_digit", "_n_symbol",
                rest - F.col("_n_upper") - F.col("_n_digit") - F.col("_n_symbol")).alias("classes"),
        _letters(F.col("_folded")).alias("letters"),
        _counts(F.col("_known"), F.col("_found"), plain).alias("common"))


def anchored(common: Column) -> Column:
    """Whether at least ``ANCHOR_PERCENT`` of the words are common ones; languages without a list always are."""
    def total(v: Column) -> Column:
        return F.aggregate(v, F.lit(0).cast("long"), lambda s, x: s + x)

    words = total(common)
    return (F.size(common) == 0) | ((words > 0) & (100 * (words - F.get(common, F.size(common) - 1)) >= ANCHOR_PERCENT * words))


def references(counts: DataFrame) -> DataFrame:
    """Per language: summed classes, letters and word counts of its anchored documents.

    The fixed words decide who speaks for a language, so that junk under its name is no
    reference for itself; without any such document the sums are zero.
    """
    sizes = {"classes": len(CLASSES), "letters": len(LETTERS) + 1, "common": 1 + max(map(len, COMMON_WORDS.values()))}
    own = counts.withColumn("_own", anchored(F.col("common")))
    cells = {c: [f"_{c}{i}" for i in range(n)] for c, n in sizes.items()}
    sums = [F.sum(F.when(F.col("_own"), F.get(c, F.lit(i))).otherwise(F.get(c, F.lit(i)) * 0)).alias(a)
            for c, names in cells.items() for i, a in enumerate(names)]
    return own.groupBy("_lang").agg(*sums).select(
        F.col("_lang").alias("_reference"),
        *[F.filter(F.array(*names), lambda x: x.isNotNull()).alias(f"ref_{c}") for c, names in cells.items()])


def jensen_shannon(a: Column, b: Column) -> Column:
    """Jensen-Shannon distance (base 2, 0 to 1) of two count vectors; null if either is empty."""
    def total(v: Column) -> Column:
        return F.aggregate(v, F.lit(0.0), lambda s, x: s + x)

    def part(p: Column, q: Column) -> Column:
        return F.when(p > 0, p * F.log2(p * 2 / (p + q))).otherwise(0.0)

    shares = F.zip_with(a, b, lambda x, y: part(F.try_divide(x, total(a)), F.try_divide(y, total(b)))
                        + part(F.try_divide(y, total(b)), F.try_divide(x, total(a))))
    value = F.sqrt(F.greatest(F.aggregate(shares, F.lit(0.0), lambda s, x: s + x) / 2, F.lit(0.0)))
    return F.when((total(a) > 0) & (total(b) > 0), value)


def quality_rules(docs: DataFrame, *, key: str = "doc_id", text: str = "text", lang: str = "lang",
                  max_class_distance: float = 0.32, max_letter_distance: float = 0.25, max_word_distance: float = 0.33,
                  min_words: int = 40, min_plain: int = 80) -> DataFrame:
    """Per document the counts, base_failed, three distances, and the verdict ``kept``.

    A document fails the base rules with fewer than 10 words or with more than 20 % of its
    words in repeated five-word windows. It fails the divergence rule if its character
    classes lie further than ``max_class_distance`` from its language's, given ``min_words``
    words, or its letters further than ``max_letter_distance`` or its common words further
    than ``max_word_distance``, given ``min_plain`` words of letters. A listed language with no
    anchored document lies at distance 1. Null or empty texts have no words and fail; a null
    language is a language of its own, judged by characters; repeated rows are judged alike;
    an empty table gives an empty result.
    """
    counts = settle(text_counts(docs, key=key, text=text, lang=lang))
    known = broadcast_if_small(settle(references(counts)))
    joined = counts.join(known, F.col("_lang").eqNullSafe(F.col("_reference")))
    plain = F.aggregate("common", F.lit(0).cast("long"), lambda s, x: s + x)
    long_enough = F.when(F.size("common") > 0, plain).otherwise(F.col("n_words")) >= min_plain
    judged = joined.select(
        F.col("_key").alias(key), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        ((F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))).alias("base_failed"),
        F.when(F.col("n_words") >= min_words, jensen_shannon(F.col("classes"), F.col("ref_classes"))).alias("class_distance"),
        F.when(long_enough, jensen_shannon(F.col("letters"), F.col("ref_letters"))).alias("letter_distance"),
        F.when(long_enough & (F.size("common") > 0),
               F.coalesce(jensen_shannon(F.col("common"), F.col("ref_common")), F.lit(1.0))).alias("word_distance"))
    limits = {"class_distance": max_class_distance, "letter_distance": max_letter_distance, "word_distance": max_word_distance}
    strange = [F.coalesce(F.col(c), F.lit(0.0)) > most for c, most in limits.items()]
    return judged.withColumn("kept", ~(F.col("base_failed") | strange[0] | strange[1] | strange[2]))
