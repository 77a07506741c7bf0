"""Keyword predicates and classifiers as native expressions."""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _text(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def present(x: Column | str) -> Column:
    return _text(x).isNotNull() & (_text(x) != "")


def any_keyword(x: Column | str, keywords: Sequence[str]) -> Column:
    """Does the text contain one of the keywords, ignoring case? Absent text: false."""
    low = F.lower(_text(x))
    hits = F.lit(False)
    for k in keywords:
        hits = hits | low.contains(k.lower())
    return F.coalesce(hits, F.lit(False)) & present(x)


def keyword_class(x: Column | str, classes: Sequence[tuple[str, Sequence[str]]], *, absent: str | None,
                  other: str = "other") -> Column:
    """The first class, in the given order, with a keyword in the text."""
    chain = F.when(~present(x), F.lit(absent))
    for name, words in classes:
        chain = chain.when(any_keyword(x, words), name)
    missing = F.lit(absent).cast("string")
    return F.when(_text(x).isNull(), missing).otherwise(chain.otherwise(other))


def without(hit: Column, excluded: Column) -> Column:
    return hit & ~excluded


#: Keywords up to which every text is tried against each of them in the plan itself.
FEW_KEYWORDS = 100


def classify_by_table(df: DataFrame, x: str, keywords: DataFrame, *, absent: str | None,
                      other: str = "other", out: str = "cls") -> DataFrame:
    """``keyword_class`` with the keywords in a table (class, priority, keyword).

    The keyword with the least (priority, keyword) that a text contains gives the class. A
    short table folds into one row, an array of structs in priority order, that reaches the
    texts as a scalar subquery: no text x keyword join. A longer one, of any number of keywords
    that a task can hold, is compiled once per task into an automaton, and one pass over a text finds them all.
    """
    words = keywords.select("priority", F.lower("keyword").alias("keyword"), F.col("class").alias("class"))
    low = F.lower(F.col(x))
    if words.limit(FEW_KEYWORDS + 1).count() > FEW_KEYWORDS:
        cls = F.coalesce(_first_class(df, words)(low), F.lit(other))
        return df.withColumn(out, F.when(present(x), cls).otherwise(F.lit(absent).cast("string")))
    ordered = words.agg(F.array_sort(F.collect_list(F.struct("priority", "keyword", "class"))).alias("k"))
    rows = df.withColumn("_k", ordered.scalar())
    first = F.filter("_k", lambda s: low.contains(s["keyword"]))
    cls = F.coalesce(F.get(first, F.lit(0))["class"], F.lit(other))
    return rows.withColumn(out, F.when(present(x), cls).otherwise(F.lit(absent).cast("string"))).drop("_k")


def _first_class(df: DataFrame, words: DataFrame) -> Callable[[Column], Column]:
    """Arrow function from lower-case texts to the class of their first keyword, NULL without one."""
    ranked = sorted((r["priority"], r["keyword"], r["class"]) for r in words.dropna().distinct().collect())
    shared = df.sparkSession.sparkContext.broadcast(ranked)

    @F.pandas_udf(T.StringType())
    def classes(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        automaton = KeywordAutomaton([(keyword, rank) for rank, (_, keyword, _) in enumerate(shared.value)])
        for batch in texts:
            found = [automaton.least(t) if t else None for t in batch]
            yield pd.Series([None if r is None else shared.value[r][2] for r in found], dtype=object)

    return classes


class KeywordAutomaton:
    """Finds the least rank of the keywords that a text contains, in one pass over the text.

    States are the prefixes of keywords; a state knows the least rank of the keywords that
    end in it or in a state that is one of its suffixes.
    """

    def __init__(self, keywords: Sequence[tuple[str, int]]):
        self.step: list[dict[str, int]] = [{}]
        self.rank: list[float] = [math.inf]
        for word, rank in keywords:
            state = 0
            for c in word:
                if c not in self.step[state]:
                    self.step[state][c] = len(self.step)
                    self.step.append({})
                    self.rank.append(math.inf)
                state = self.step[state][c]
            self.rank[state] = min(self.rank[state], rank)
        self.back = [0] * len(self.step)
        queue = deque(self.step[0].values())
        while queue:
            state = queue.popleft()
            for c, child in self.step[state].items():
                at = self.back[state]
                while at and c not in self.step[at]:
                    at = self.back[at]
                self.back[child] = self.step[at].get(c, 0)
                self.rank[child] = min(self.rank[child], self.rank[self.back[child]])
                queue.append(child)

    def least(self, text: str) -> int | None:
        best, state = self.rank[0], 0
        for c in text:
            while state and c not in self.step[state]:
                state = self.back[state]
            state = self.step[state].get(c, 0)
            if self.rank[state] < best:
                best = self.rank[state]
        return None if best == math.inf else int(best)


def first_token(x: Column | str, sep: str = "|") -> Column:
    """The part before the first separator, trimmed."""
    return F.trim(F.split_part(_text(x), F.lit(sep), F.lit(1)))


def numeric_or_null(x: Column | str) -> Column:
    """A number, or NULL for text that is none."""
    return _text(x).try_cast("double")


def key_prefix(x: Column | str, n: int = 14) -> Column:
    return F.substring(_text(x), 1, n)


def integer_id(x: Column | str) -> Column:
    """An id made of digits only, as a number, else NULL."""
    return F.when(_text(x).rlike("^[0-9]+$"), _text(x).try_cast("long"))
