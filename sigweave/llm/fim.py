"""Fill-in-the-middle transformation by counted-quantifier patterns.

A text is cut into units (a word with the white space before it, or white space at the end).
``regexp_count`` counts the units; two hash draws place the cuts after a and b of them. A
pattern made for the row, with possessive groups ``(?:unit){a}+`` and ``(?:unit){b-a}+`` and a
rest, captures prefix, middle and suffix in a single match, and its replacement puts them in
the order of the form between the markers. Possessive groups never step back, so a match is
linear in the text and its stack does not grow with the count. Everything stays in DataFrame
functions.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, whole_text

#: One unit: white space and the word after it, else the white space that ends the text.
UNIT = rf"[{SPACE}]*+[^{SPACE}]++|[{SPACE}]++"
#: Markers before the prefix, the suffix and the middle.
MARKERS = ("<P>", "<S>", "<M>")
RESULTS = ("n", "form", "output", "prefix_chars", "middle_chars")


def draws(key: Column, seed: int) -> list[Column]:
    """Four numbers from the sha256 of "seed:key" (its first 32-bit groups); a null key counts as empty."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def checked_markers(markers: Sequence[str]) -> list[str]:
    """The three markers. Each begins with a character found nowhere else in them but at their
    starts, so that no marker can arise where texts and markers meet."""
    heads = {m[:1] for m in markers}
    if len(set(markers)) != 3 or "" in heads or any(h in m[1:] for m in markers for h in heads):
        raise ValueError("three different markers are needed whose first characters occur at their starts only")
    return list(markers)


def fill_in_middle(docs: DataFrame, *, key: str = "doc_id", text: str = "text", seed: int = 42, percent: int = 50,
                   spm_percent: int = 80, markers: Sequence[str] = MARKERS) -> DataFrame:
    """``docs`` with n (units), form, output, prefix_chars and middle_chars.

    The form is "plain" (output is the text) for empty texts, for texts that hold a marker, and
    for all but ``percent`` of the rest; of these, ``spm_percent`` are "spm" (suffix, prefix,
    middle) and the others "psm" (prefix, suffix, middle). Lengths count code points and are
    null where the form is plain. A null text is empty; a null key draws as an empty one;
    repeated rows get the same cuts; an empty table gives an empty result. A column of ``docs``
    that bears the name of a result is replaced.
    """
    p, s, m = checked_markers(markers)
    kept = [c for c in docs.columns if c.lower() not in RESULTS]
    body = whole_text(text)
    facts = F.struct(body.alias("t"), F.regexp_count(body, F.lit(UNIT)).cast("long").alias("n"), *[
        h.alias(f"h{i}") for i, h in enumerate(draws(F.col(key), seed), 1)])
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("_row"), facts.alias("_f"))
    f = F.col("_f")
    first, second = f.h1 % (f.n + 1), f.h2 % (f.n + 1)
    marked = F.lit(False)
    for x in (p, s, m):
        marked = marked | F.contains(f.t, F.lit(x))
    form = F.when((f.t == "") | marked | (f.h3 % 100 >= percent), "plain").when(f.h4 % 100 < spm_percent, "spm").otherwise("psm")
    rows = rows.select("_row", "_f", form.alias("_form"), F.least(first, second).alias("_a"), F.greatest(first, second).alias("_b"))
    pattern = F.format_string(rf"\A((?:{UNIT}){{%d}}+)((?:{UNIT}){{%d}}+)([\s\S]*+)", F.col("_a"), F.col("_b") - F.col("_a"))
    quoted = [re.sub(r"([\\$])", r"\\\1", x) for x in (p, s, m)]
    order = {"psm": "{0}$1{1}$3{2}$2", "spm": "{1}$3{0}$1{2}$2"}
    ordered = F.when(F.col("_form") == "psm", order["psm"].format(*quoted)).otherwise(order["spm"].format(*quoted))
    output = F.when(F.col("_form") == "plain", f.t).otherwise(F.regexp_replace(f.t, pattern, ordered))
    rows = rows.select("_row", f.n.alias("_n"), "_form", output.alias("_output"))
    parts = pieces(F.col("_output"), F.col("_form"), markers)
    rows = rows.select("_row", "_n", "_form", "_output", parts.alias("_parts"))
    lengths = [F.when(F.col("_form") != "plain", F.char_length(F.col("_parts")[c]).cast("long")) for c in ("prefix", "middle")]
    return rows.select(*[F.col("_row")[c].alias(c) for c in kept], F.col("_n").alias("n"), F.col("_form").alias("form"),
                       F.col("_output").alias("output"), lengths[0].alias("prefix_chars"), lengths[1].alias("middle_chars"))


def pieces(output: Column, form: Column, markers: Sequence[str] = MARKERS) -> Column:
    """prefix, middle and suffix of an output as a struct; a plain output is all prefix."""
    cut = F.split(output, F.lit("|".join(re.escape(x) for x in checked_markers(markers))), -1)
    none = F.lit("")
    return F.when(form == "plain", F.struct(output.alias("prefix"), none.alias("middle"), none.alias("suffix"))).otherwise(
        F.struct(F.when(form == "psm", F.get(cut, F.lit(1))).otherwise(F.get(cut, F.lit(2))).alias("prefix"), F.get(cut, F.lit(3)).alias("middle"),
                 F.when(form == "psm", F.get(cut, F.lit(2))).otherwise(F.get(cut, F.lit(1))).alias("suffix")))


def restored(output: Column, form: Column, markers: Sequence[str] = MARKERS) -> Column:
    """The text that an output was made from."""
    p = pieces(output, form, markers)
    return F.concat(p["prefix"], p["middle"], p["suffix"])
