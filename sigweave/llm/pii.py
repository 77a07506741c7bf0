"""Personal data by bootstrapped contextual extraction.

Seeds are what fixed patterns find (email, ip, card, phone). One pass over the texts yields,
per document, its seeds and its candidates: other tokens, runs of digit groups and spelled-out
addresses that look like identifiers, each with the words around it. The words make lexical
patterns. Spark then scores the graph of patterns and instances in rounds: seeds and the
instances accepted so far induce patterns, a pattern is as reliable as the mean of its
instances, a candidate as its best pattern. Instances whose score reaches the threshold are
identifiers too, wherever they occur, with the kind of the pattern that found them.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_map, broadcast_if_small, free_name, settle, text_last, whole_text

KINDS = ("email", "ip", "card", "phone")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A match can only start where a run of digits does: looking behind keeps long runs linear.
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
#: Candidate tokens: hold a digit or an at sign; trimmed of what usually surrounds a token.
_TOKEN = re.compile(r"[^\s,;:<>()\[\]{}\"'=]*[0-9@][^\s,;:<>()\[\]{}\"'=]*")
_TRIM = ".!?-_/"
LEAST_DIGITS, LONGEST = 6, 80
#: What may stand between the digit groups of one candidate; a run of more digits is a list of numbers.
_GROUP = re.compile(r"[0-9]+")
_GAP = re.compile(r"[\x20./-]|\x20[/-]\x20|\)[\x20./-]?|\x20?\(")
MOST_DIGITS = 19
_AT = re.compile(r"\x20?[(\[{]\x20?at\x20?[)\]}]\x20?|\x20at\x20", re.IGNORECASE)
_DOT = r"(?:\x20?[(\[{]\x20?dot\x20?[)\]}]\x20?|\x20dot\x20|\.)"
_BEFORE_AT = re.compile(rf"(?<![A-Za-z0-9_%+.-])[A-Za-z0-9_%+-]+(?:{_DOT}[A-Za-z0-9_%+-]+)*$", re.IGNORECASE)
_AFTER_AT = re.compile(rf"[A-Za-z0-9-]+(?:{_DOT}[A-Za-z0-9-]+)+", re.IGNORECASE)
#: Which candidates a kind's patterns may find, by shape.
SHAPES = {"email": "at", "ip": "dotted", "card": "digits", "phone": "digits"}


def _emails(text: str) -> list[tuple[int, int]]:
    found, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            end = m.end()
            found.append((start, end))
        at = text.find("@", max(at + 1, end))
    return found


def _luhn(digits: str) -> bool:
    doubled = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
    return sum(d - 9 * (d > 9) for d in doubled) % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind, then start: leftmost matches of each kind that pass its test."""
    out = [("email", a, b) for a, b in _emails(text)]
    if not _DIGIT.search(text):
        return out
    for m in _IP.finditer(text):
        if all(len(x := p.lstrip("0")) <= 3 and int(x or 0) <= 255 for p in m.group().split(".")):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and _luhn(digits):
            out.append(("card", *m.span()))
    for m in _PHONE.finditer(text):
        if 9 <= len(_DIGIT.findall(m.group())) <= 15:
            out.append(("phone", *m.span()))
    return out


def spelled_addresses(text: str) -> list[tuple[int, int]]:
    """Spans like "name at host dot org" or "name [at] host.org"."""
    out = []
    for m in _AT.finditer(text):
        low = max(0, m.start() - LONGEST, out[-1][1] if out else 0)
        if (after := _AFTER_AT.match(text, m.end())) and (before := _BEFORE_AT.search(text[low:m.start()])):
            out.append((low + before.start(), after.end()))
    return out


def digit_runs(text: str, taken: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans of two or more digit groups, joined as numbers are written, outside the sorted spans ``taken``."""
    runs, i, reach = [], 0, 0
    for m in _GROUP.finditer(text):
        a, b = m.span()
        while i < len(taken) and taken[i][0] < b:
            reach = max(reach, taken[i][1])
            i += 1
        if reach > a or text[a - 1:a].isalpha() or text[b:b + 1].isalpha():
            continue
        if runs and a - runs[-1][1] <= 3 and reach <= runs[-1][0] and _GAP.fullmatch(text, runs[-1][1], a):
            run = runs[-1]
            runs[-1] = (run[0], b, run[2] + b - a, run[3] + 1)
        else:
            runs.append((a, b, b - a, 1))
    out = []
    for a, b, digits, groups in runs:
        if groups > 1 and LEAST_DIGITS <= digits <= MOST_DIGITS and digits >= 2 * groups and not (groups == 4 and text.count(".", a, b) == 3):
            out.append((a - (text[a - 1:a] == "(" and ")" in text[a:b]), b))
    return out


def candidates(text: str, taken: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """(shape, start, end) of identifier-like spans outside the spans ``taken``: spelled-out
    addresses, runs of digit groups, and single tokens that neither covers."""
    spans = sorted((a, b) for _, a, b in taken)
    ends = list(accumulate((b for _, b in spans), max))

    def free(a: int, b: int) -> bool:
        k = bisect_left(spans, (b,))
        return b - a <= LONGEST and (k == 0 or ends[k - 1] <= a)

    out = [("at", a, b) for a, b in spelled_addresses(text) if free(a, b)]
    if "@" not in text and not _DIGIT.search(text):
        return out
    spans = sorted([*spans, *((a, b) for _, a, b in out)])
    runs = digit_runs(text, spans)
    out += [("digits", a, b) for a, b in runs]
    spans, i = sorted([*spans, *runs]), 0
    reach = 0  # the furthest end of a span that starts before the token
    for m in _TOKEN.finditer(text):
        start, end = m.span()
        while start < end and text[end - 1] in _TRIM:
            end -= 1
        while start < end and text[start] in _TRIM:
            start += 1
        while i < len(spans) and spans[i][0] < end:
            reach = max(reach, spans[i][1])
            i += 1
        if not 0 < end - start <= LONGEST or reach > start:
            continue
        token = text[start:end]
        n = len(_DIGIT.findall(token))
        if "@" in token:
            out.append(("at", start, end))
        elif n >= 4 and token.count(".") == 3 and token.replace(".", "").isdigit():
            out.append(("dotted", start, end))
        elif n >= LEAST_DIGITS and n >= 0.8 * len(token):
            out.append(("digits", start, end))
    return out


def patterns(text: str, start: int, end: int) -> list[str]:
    """Lexical patterns of an occurrence: its two words before, and one word on either side."""
    left = text[max(0, start - 80):start].lower().split()
    right = text[end:end + 40].lower().split()
    out = []
    if len(left) >= 2:
        out.append(f"{left[-2]} {left[-1]} _")
    if left and right:
        out.append(f"{left[-1]} _ {right[0].strip('.,;:!?')}")
    return out


_SPAN = "struct<kind:string,start:int,end:int>"
_SEEN = "struct<kind:string,start:int,end:int,instance:string,patterns:array<string>>"


def occurrences(docs: DataFrame, text: str) -> DataFrame:
    """All columns but the text, with _base spans and _seen: seeds and candidates with their patterns.

    A seed's kind is its own, a candidate's is "?" and its shape.
    """
    rest = [c for c in docs.columns if c != text]
    frame = text_last(docs, rest, text)
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema.fields[:len(rest)]]
    span = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
    seen_type = pa.struct([*span, ("instance", pa.string()), ("patterns", pa.list_(pa.string()))])

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        bases, seens = [], []
        for t in batch.column(len(rest)).to_pylist():
            base = base_spans(t)
            both = [*base, *(("?" + k, a, b) for k, a, b in candidates(t, base))]
            bases.append([{"kind": k, "start": a, "end": b} for k, a, b in base])
            seens.append([{"kind": k, "start": a, "end": b, "instance": t[a:b].lower(), "patterns": patterns(t, a, b)}
                          for k, a, b in both])
        return pa.RecordBatch.from_arrays([*batch.columns[:len(rest)], pa.array(bases, pa.list_(span)), pa.array(seens, pa.list_(seen_type))],
                                          names=[*rest, "_base", "_seen"])

    return arrow_map(frame, work, ", ".join([*fields, f"_base array<{_SPAN}>", f"_seen array<{_SEEN}>"]))


def score_graph(seen: DataFrame, *, rounds: int, min_instances: int, pattern_threshold: float,
                instance_threshold: float) -> DataFrame:
    """(instance, kind, score) of candidates, from the distinct edges of pattern and instance.

    ``seen``: pattern, instance, kind ("?shape" for a candidate). In every round a pattern
    counts for one kind, with at least ``min_instances`` distinct instances that are seeds of
    that kind or accepted for it so far; its reliability is the mean score of all its instances
    of the kind's shape, seeds counting 1.
    """
    seen = settle(seen)
    seeds = seen.filter(~F.col("kind").startswith("?")).select("pattern", F.col("kind").alias("p_kind"), F.lit(1).alias("seed"))
    shape = F.create_map(*[F.lit(x) for k in KINDS for x in (k, "?" + SHAPES[k])])[F.col("p_kind")]
    found = seen.filter(F.col("kind").startswith("?"))
    scores = found.limit(0).select("instance", F.col("kind").alias("p_kind"), F.lit(0.0).alias("score"))
    for _ in range(rounds):
        accepted = scores.filter(F.col("score") >= instance_threshold)
        more = found.join(accepted, "instance").filter(F.col("kind") == shape).select("pattern", "p_kind", F.lit(0).alias("seed"))
        # One row for each (pattern, kind) that has support, however many there are.
        induced = seeds.unionByName(more).groupBy("pattern", "p_kind").agg(
            F.count("*").alias("n"), F.sum("seed").alias("n_seeds")).filter(F.col("n") >= min_instances).drop("n")
        edges = settle(found.join(induced, "pattern").filter(F.col("kind") == shape).select("pattern", "p_kind", "n_seeds", "instance")
                       .join(scores, ["instance", "p_kind"], "left").fillna(0.0, ["score"]))
        reliable = edges.groupBy("pattern", "p_kind").agg(
            ((F.first("n_seeds") + F.sum("score")) / (F.first("n_seeds") + F.count("*"))).alias("reliability"))
        # A candidate's own score must not speak for itself at the start: patterns below the
        # threshold hand on half of what they have.
        passed = F.when(F.col("reliability") >= pattern_threshold, F.col("reliability")).otherwise(F.col("reliability") / 2)
        scores = settle(edges.select("pattern", "p_kind", "instance").join(reliable, ["pattern", "p_kind"])
                        .groupBy("instance", "p_kind").agg(F.max(passed).alias("score")))
    return scores.withColumnRenamed("p_kind", "kind")


def _listed(spans: Column) -> Column:
    order = F.transform(spans, lambda s: F.struct(
        F.array_position(F.array(*[F.lit(k) for k in KINDS]), s["kind"]).alias("k"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))
    return F.array_join(F.transform(F.array_sort(order), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _searched(docs: DataFrame, key: str, text: str, rounds: int, min_instances: int, pattern_threshold: float,
              instance_threshold: float) -> tuple[DataFrame, DataFrame]:
    """(_key, _digest, _base of every document; _digest and _more of texts with accepted candidates).

    A text is known by its SHA-256, so copies of a text share their accepted candidates.
    """
    given = docs.select(F.col(key).alias("_key"), F.sha2(whole_text(text), 256).alias("_digest"), F.col(text).alias("_doc_text"))
    found = settle(occurrences(given, "_doc_text"))
    single = found.select("_digest", F.explode("_seen").alias("s")).select("_digest", "s.*")
    edges = single.select(F.explode("patterns").alias("pattern"), "instance", "kind").distinct()
    scores = score_graph(edges, rounds=rounds, min_instances=min_instances, pattern_threshold=pattern_threshold,
                         instance_threshold=instance_threshold)
    best = Window.partitionBy("instance").orderBy(F.desc("score"), "kind")
    accepted = settle(scores.filter(F.col("score") >= instance_threshold).withColumn("r", F.row_number().over(best))
                      .filter("r = 1").select("instance", F.col("kind").alias("found_kind")))
    new = single.filter(F.col("kind").startswith("?")).join(accepted, "instance").select(
        "_digest", F.struct(F.col("found_kind").alias("kind"), "start", "end").alias("s")).distinct()
    more = settle(new.groupBy("_digest").agg(F.sort_array(F.collect_list("s")).alias("_more")))
    return found.select("_key", "_digest", "_base"), more


NO_SPANS = f"array<{_SPAN}>"


def find_spans(docs: DataFrame, *, key: str = "doc_id", text: str = "text", rounds: int = 3, min_instances: int = 3,
               pattern_threshold: float = 0.5, instance_threshold: float = 0.6) -> DataFrame:
    """Per document: key, base_spans and more_spans (kind, start, end in code points, end exclusive).

    Base spans are the fixed patterns' matches; more_spans are candidates that the graph
    accepts, never overlapping a base span. A null or empty text has none. Repeated rows get
    the same spans each; an empty table gives an empty result.
    """
    found, more = _searched(docs, key, text, rounds, min_instances, pattern_threshold, instance_threshold)
    return found.join(broadcast_if_small(more), "_digest", "left").select(
        F.col("_key").alias(key), F.col("_base").alias("base_spans"),
        F.coalesce("_more", F.array().cast(NO_SPANS)).alias("more_spans"))


def span_digest(spans: DataFrame, key: str = "doc_id") -> DataFrame:
    """Counts of base spans by kind, their digest, and all spans as text."""
    def count(kind: str) -> Column:
        return F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in KINDS]
    return spans.select(key, *counts, F.sha2(_listed(F.col("base_spans")), 256).alias("base_sha256"),
                        _listed(F.concat("base_spans", "more_spans")).alias("spans"))


def mask(docs: DataFrame, *, key: str = "doc_id", text: str = "text", rounds: int = 3, min_instances: int = 3,
         pattern_threshold: float = 0.5, instance_threshold: float = 0.6) -> DataFrame:
    """``docs`` with every found span replaced by its kind in brackets, e.g. [EMAIL].

    Overlapping spans are replaced together, under the name of the first. Null texts stay null,
    repeated rows are masked each, an empty table gives an empty result, and all other columns stay.
    """
    _, more = _searched(docs, key, text, rounds, min_instances, pattern_threshold, instance_threshold)
    found = free_name(docs, "_pii")
    own = broadcast_if_small(more.select(F.struct("_digest", "_more").alias(found)))
    joined = docs.join(own, F.sha2(whole_text(text), 256) == F.col(f"{found}._digest"), "left")
    columns = docs.columns
    frame = joined.select(*[F.col(f"`{c}`") for c in columns], F.col(f"{found}._more").alias(f"{found}_more"))
    at = columns.index(text)
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema.fields[:len(columns)]]

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = [None if t is None else _masked(t, [(s["kind"], s["start"], s["end"]) for s in m or []])
               for t, m in zip(batch.column(at).to_pylist(), batch.column(len(columns)).to_pylist(), strict=True)]
        new = list(batch.columns[:len(columns)])
        new[at] = pa.array(out, pa.string())
        return pa.RecordBatch.from_arrays(new, names=columns)

    return arrow_map(frame, work, ", ".join(fields))


def _masked(text: str, more: list[tuple[str, int, int]]) -> str:
    out, end = [], 0
    for kind, a, b in sorted([*base_spans(text), *more], key=lambda s: (s[1], -s[2])):
        if a < end:  # overlaps what is masked already
            end = max(end, b)
            continue
        out += [text[end:a], f"[{kind.upper()}]"]
        end = b
    return "".join([*out, text[end:]])
