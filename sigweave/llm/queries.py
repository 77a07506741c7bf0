"""One query per operator of this folder, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, fim, mixing, neardup, pii, pseudolm, quality, rules, setjoin, tokens, topk, toxicity, vectorcodes
from .common import SPACE, WORD, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return tokens.token_counts(docs, public_tokenizers.path("piece_bpe_32k.model"))


@query
def op2_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.exact_top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


SQL["op2_exact_top_k"] = """
WITH rows AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM rows q JOIN rows c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
FROM scored QUALIFY rank <= 5
"""


@query
def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, keep_ids=False)


@query
def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.span_digest(pii.find_spans(docs))


def fold(n: int) -> Column:
    """The document's remainder that decides whether its label may be learned."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(n))


@query
def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    crf = toxicity.fit(docs, table(spark, sf_dir, "labels").filter(fold(4) != 2))
    scored = toxicity.score(docs, crf, keep_spans=False)
    return scored.select("doc_id", (fold(4) == 2).alias("held_out"), "score", "predicted")


@query
def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, table(spark, sf_dir, "labels").filter(fold(5) != 0))
    scored = quality.score(docs, model)
    return scored.select("doc_id", (fold(5) == 0).alias("held_out"), "score", "predicted")


@query
def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_counts(table(spark, sf_dir, "documents"))


SQL["op7_mixing"] = f"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY 1),
r AS (SELECT *, stop / w AS ratio FROM (SELECT *, 2::DOUBLE * source_size AS stop,
   [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS w FROM s)),
l AS (SELECT *, sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(stop) OVER before, 0) AS rest,
   sum(w) OVER () - coalesce(sum(w) OVER before, 0) AS weights FROM r
  WINDOW before AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, CASE WHEN level IS NULL THEN stop ELSE least(stop, w * level) END AS target FROM (
   SELECT *, max(CASE WHEN rest / weights <= ratio THEN rest / weights END) OVER () AS level FROM l)),
q AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate FROM t),
f AS (SELECT d.doc_id, d.size, q.*, ('0x' || substr(md5('7:' || doc_id), 1, 8))::BIGINT % {mixing.DRAW_SPACE} AS first
  FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source),
u AS (SELECT f.*, k, ((first * {mixing.MULTIPLIERS}[k + 1] + k) % {mixing.DRAW_SPACE})::DOUBLE / {mixing.DRAW_SPACE} < rate - floor(rate) AS one_more
  FROM f, (SELECT unnest(range({len(mixing.MULTIPLIERS)})) AS k)),
e AS (SELECT source, k, abs(floor(any_value(rate)) * any_value(source_size) + sum(CASE WHEN one_more THEN size ELSE 0 END) - any_value(target)) AS off
  FROM u GROUP BY 1, 2),
b AS (SELECT source, k FROM e QUALIFY row_number() OVER (PARTITION BY source ORDER BY off, k) = 1),
c AS (SELECT u.*, (floor(rate) + one_more::INT)::BIGINT AS n_copies FROM u JOIN b ON u.source IS NOT DISTINCT FROM b.source AND u.k = b.k)
SELECT doc_id, size, source_size, target, n_copies, n_copies * size AS taken FROM c
"""


@query
def op8_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudolm.pseudo_likelihood(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query
def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = rules.quality_rules(table(spark, sf_dir, "documents"))
    return judged.withColumns({c: F.round(c, 6) for c in ("class_distance", "letter_distance", "word_distance")})


def _divergence(a: str, b: str) -> str:
    """SQL of the Jensen-Shannon distance of two count lists, null if either is empty."""
    p, q = f"z[1] / list_sum({a})", f"z[2] / list_sum({b})"
    part = "CASE WHEN {0} > 0 THEN ({0}) * log2(({0}) * 2 / (({0}) + ({1}))) ELSE 0 END"
    return (f"CASE WHEN list_sum({a}) > 0 AND list_sum({b}) > 0 THEN sqrt(greatest(list_sum(list_transform(list_zip({a}, {b}), "
            f"lambda z: {part.format(p, q)} + {part.format(q, p)})) / 2, 0)) END")


def _reference(counts: str, n: int) -> str:
    """SQL of the summed counts of each language's anchored documents."""
    return (f"r_{counts} AS (SELECT lang, coalesce(list(s ORDER BY i) FILTER (s IS NOT NULL), []) AS ref_{counts} FROM ("
            f"SELECT lang, i, sum(own * {counts}[i]::DOUBLE) AS s FROM o, (SELECT unnest(range(1, {n + 1})) AS i) GROUP BY 1, 2) GROUP BY 1)")


_KNOWN = " ".join(f"WHEN '{lang}' THEN {words}" for lang, words in rules.COMMON_WORDS.items())
SQL["op9_quality_rules"] = f"""
WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w,
   list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS lines,
   regexp_replace(coalesce(text, ''), '[a-z{SPACE}]+', '', 'g') AS rest,
   translate(coalesce(text, ''), '{rules.UPPER}', '{rules.LOWER}') AS folded,
   CASE lang {_KNOWN} ELSE []::VARCHAR[] END AS known FROM documents),
x AS (SELECT doc_id, unnest(range(1, len(w) - 3)) AS i,
   unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS g FROM d),
v AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM x),
cov AS (SELECT doc_id, count(DISTINCT i + o) AS n_repeat_words FROM v, (SELECT unnest(range(5)) AS o) WHERE n > 1 GROUP BY 1),
m AS (SELECT d.doc_id, lang, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
   length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
   coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, length(rest) AS n_rest,
   length(regexp_replace(rest, '[^A-Z]', '', 'g')) AS up, length(regexp_replace(rest, '[^0-9]', '', 'g')) AS dig,
   list_transform(string_split('{rules.LETTERS}', ''), lambda c: length(folded) - length(replace(folded, c, '')))
     || [length(regexp_replace(folded, '[\\x00-\\x7F]+', '', 'g'))] AS letters, known,
   regexp_extract_all(folded, '[^{rules.NO_LETTER}]+') AS plain
  FROM d LEFT JOIN cov ON d.doc_id = cov.doc_id),
c AS (SELECT *, [word_chars - n_rest, up, dig, n_symbols, n_rest - up - dig - n_symbols]::DOUBLE[] AS classes,
   CASE WHEN len(known) = 0 THEN []::DOUBLE[] ELSE list_transform(known, lambda k: len(list_filter(plain, lambda y: y = k))::DOUBLE)
     || [len(list_filter(plain, lambda y: NOT list_contains(known, y)))::DOUBLE] END AS common FROM m),
o AS (SELECT *, CASE WHEN len(common) = 0 OR (list_sum(common) > 0
     AND 100 * (list_sum(common) - common[-1]) >= {rules.ANCHOR_PERCENT} * list_sum(common)) THEN 1 ELSE 0 END AS own FROM c),
{_reference("classes", len(rules.CLASSES))},
{_reference("letters", len(rules.LETTERS) + 1)},
{_reference("common", 1 + max(map(len, rules.COMMON_WORDS.values())))},
j AS (SELECT c.*, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
   CASE WHEN n_words >= 40 THEN {_divergence("classes", "ref_classes")} END AS cd,
   CASE WHEN (CASE WHEN len(known) > 0 THEN len(plain) ELSE n_words END) >= 80 THEN {_divergence("letters", "ref_letters")} END AS ld,
   CASE WHEN len(known) > 0 AND len(plain) >= 80 THEN coalesce({_divergence("common", "ref_common")}, 1) END AS wd
  FROM o AS c JOIN r_classes a ON c.lang IS NOT DISTINCT FROM a.lang JOIN r_letters b ON c.lang IS NOT DISTINCT FROM b.lang
  JOIN r_common e ON c.lang IS NOT DISTINCT FROM e.lang)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, round(cd, 6) AS class_distance,
 round(ld, 6) AS letter_distance, round(wd, 6) AS word_distance,
 NOT base_failed AND coalesce(cd, 0) <= 0.32 AND coalesce(ld, 0) <= 0.25 AND coalesce(wd, 0) <= 0.33 AS kept FROM j
"""


@query
def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return neardup.near_duplicates(docs, width=3, percent=85)


@query
def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fim.fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                       F.sha2(fim.restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


SQL["op11_fill_in_middle"] = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || doc_id) AS h,
   regexp_extract_all(coalesce(text, ''), '[{SPACE}]*[^{SPACE}]+|[{SPACE}]+') AS u FROM documents),
x AS (SELECT *, len(u)::BIGINT AS n, [('0x' || substr(h, 8 * i + 1, 8))::BIGINT for i in range(4)] AS r FROM d),
c AS (SELECT *, least(r[1] % (n + 1), r[2] % (n + 1)) AS a, greatest(r[1] % (n + 1), r[2] % (n + 1)) AS b,
   CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR r[3] % 100 >= 50 THEN 'plain'
        WHEN r[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM x),
p AS (SELECT *, array_to_string(u[1:a], '') AS prefix, array_to_string(u[a + 1:b], '') AS middle, array_to_string(u[b + 1:n], '') AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
 sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(text) AS restored_sha256
FROM p
"""


@query
def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = vectorcodes.vector_codes(table(spark, sf_dir, "embeddings"))
    return coded.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", "codebooks_sha256")


def _coding_rounds(rounds: int) -> str:
    """CTEs b1, b2, ...: the codebooks (part, e, c) after each round, from p (vec_id, part, x) and b0."""
    near = "SELECT vec_id, part, x, min(list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT * 16 + e) AS best"
    ctes = []
    for i in range(1, rounds + 1):
        ctes.append(f"""a{i} AS MATERIALIZED ({near} FROM p JOIN b{i - 1} USING (part) GROUP BY ALL),
m{i} AS (SELECT part, e, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS c FROM (
   SELECT part, best % 16 AS e, i, sum(x[i])::BIGINT AS s, count(*) AS n FROM a{i}, (SELECT unnest(range(1, (SELECT max(len(x)) + 1 FROM p))) AS i) GROUP BY 1, 2, 3) GROUP BY 1, 2),
b{i} AS MATERIALIZED (SELECT o.part, o.e, coalesce(m.c, o.c) AS c FROM b{i - 1} o LEFT JOIN m{i} m ON o.part = m.part AND o.e = m.e)""")
    ctes.append(f"f AS MATERIALIZED ({near} FROM p JOIN b{rounds} USING (part) GROUP BY ALL)")
    return ",\n".join(ctes)


SQL["op12_vector_codes"] = f"""
WITH k AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT vec_id, part, v[part * (len(v) // 8) + 1:(part + 1) * (len(v) // 8)] AS x FROM k, (SELECT unnest(range(8)) AS part)),
b0 AS MATERIALIZED (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS e, x AS c FROM p QUALIFY e < 16),
{_coding_rounds(6)},
s AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, e)) AS codebooks_sha256 FROM b6),
r AS (SELECT vec_id, string_agg(printf('%02x', best % 16), '' ORDER BY part) AS code, sum(best // 16)::BIGINT AS error FROM f GROUP BY 1)
SELECT r.vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256
FROM r JOIN k ON r.vec_id = k.vec_id, s
"""


@query
def op13_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setjoin.jaccard_join(table(spark, sf_dir, "documents").select("doc_id", "text"), width=3, percent=90)
