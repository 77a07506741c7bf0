"""Toxic spans by a linear-chain conditional random field over token evidence.

Learning has three steps. (1) Words and word beginnings of labelled documents are counted by
Spark, once per document; those clearly commoner in toxic documents form a lexicon with
log-odds. (2) Tokens of labelled documents get labels: in a toxic document, a token with
strong evidence is toxic; all others are not. The field learns from them how evidence of a
token and of its neighbours, and the labels beside it, go together. (3) Marginals of each
document are summed up, and a logistic curve turns the sums into P(label = 1).

With two labels, messages are odds, so forward and backward passes are one number per token;
all documents of a batch advance together.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, text_last
from .labelled import fit_logistic, labelled_texts

TOKEN = re.compile(r"\w+")
#: Word beginnings taken as features, in characters.
BEGINNINGS = (4, 5, 6, 7)
#: Log-odds from which each evidence level starts; level 0 is none.
LEVELS = np.array([1.0, 1.75, 2.5, 3.25, 4.0, 5.0])
STRONG = 5  # evidence level from which a token of a toxic document is labelled toxic
MEMO_ITEMS = 400_000


def features(word: str) -> list[str]:
    return ["=" + word, *(word[:k] for k in BEGINNINGS if len(word) > k)]


class Evidence(dict):
    """Lower-case word to evidence level, memoised in bounded space."""

    def __init__(self, lexicon: dict[str, float]):
        self.lexicon = lexicon

    def __missing__(self, word: str) -> int:
        best = max((self.lexicon.get(f, 0.0) for f in features(word)), default=0.0)
        level = int(np.searchsorted(LEVELS, best, side="right"))
        if len(self) >= MEMO_ITEMS:
            self.clear()
        self[word] = level
        return level


@dataclass
class Field:
    """Weights: ``emit`` (previous, own, next token's level), log transition scores, calibration."""

    lexicon: dict[str, float]
    emit: np.ndarray = field(default_factory=lambda: np.zeros((3, len(LEVELS) + 1)))
    bias: float = -2.0
    moves: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    calibration: np.ndarray = field(default_factory=lambda: np.zeros(4))


def lanes(levels: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token levels as a (position, sequence) matrix, longest sequence first; order and lengths."""
    lens = np.array([len(x) for x in levels], np.int64)
    order = np.argsort(-lens, kind="stable")
    lens = lens[order]
    grid = np.zeros((int(lens[0]) if len(lens) else 0, len(lens)), np.int8)
    for column, i in enumerate(order):
        grid[:lens[column], column] = levels[i]
    return grid, order, lens


def messages(crf: Field, grid: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token scores, forward odds and backward odds of label 1, clipped to finite numbers."""
    steps = len(grid)
    before, after = np.zeros_like(grid), np.zeros_like(grid)
    before[1:], after[:-1] = grid[:-1], grid[1:]
    psi = np.exp(np.clip(crf.bias + crf.emit[0][before] + crf.emit[1][grid] + crf.emit[2][after], -30, 30))
    (t00, t01), (t10, t11) = np.exp(crf.moves)
    live = len(lens) - np.searchsorted(lens[::-1], np.arange(steps), side="right")
    ahead, back = np.ones_like(psi), np.ones_like(psi)
    for t in range(steps):
        n = live[t]
        ahead[t, :n] = psi[t, :n] if t == 0 else psi[t, :n] * (t01 + ahead[t - 1, :n] * t11) / (t00 + ahead[t - 1, :n] * t10)
    for t in range(steps - 2, -1, -1):
        n = live[t + 1]
        m = psi[t + 1, :n] * back[t + 1, :n]
        back[t, :n] = (t10 + t11 * m) / (t00 + t01 * m)
    return psi, ahead, back


def marginals(crf: Field, levels: list[np.ndarray]) -> list[np.ndarray]:
    """P(token is toxic) for every token of every sequence."""
    grid, order, lens = lanes(levels)
    _, ahead, back = messages(crf, grid, lens)
    p = ahead * back / (1 + ahead * back)
    out: list[np.ndarray] = [np.zeros(0)] * len(levels)
    for column, i in enumerate(order):
        out[i] = p[:lens[column], column]
    return out


LANES = 256  # sequences whose messages are in memory at a time while training


def gradient(crf: Field, levels: list[np.ndarray], toxic: np.ndarray) -> tuple[np.ndarray, np.ndarray, float, int]:
    """Observed less expected emission levels, transitions and toxic tokens of some sequences;
    and the number of toxic tokens."""
    grid, order, lens = lanes(levels)
    truth = (grid >= STRONG) & toxic[order][None, :]
    inside = np.arange(len(grid))[:, None] < lens[None, :]
    before, after = np.zeros_like(grid), np.zeros_like(grid)
    before[1:], after[:-1] = grid[:-1], grid[1:]
    psi, ahead, back = messages(crf, grid, lens)
    wrong = np.where(inside, truth - ahead * back / (1 + ahead * back), 0.0)
    by_level = np.array([np.bincount(g[inside], wrong[inside], len(LEVELS) + 1) for g in (before, grid, after)])
    left = np.stack([np.ones_like(ahead[:-1]), ahead[:-1]])
    right = np.stack([np.ones_like(back[1:]), psi[1:] * back[1:]])
    joint = left[:, None] * np.exp(crf.moves)[:, :, None, None] * right[None]
    joint /= joint.sum((0, 1))
    seen = np.array([[np.sum(((truth[:-1] == i) & (truth[1:] == j))[inside[1:]]) for j in (0, 1)] for i in (0, 1)])
    return by_level, seen - np.where(inside[1:], joint, 0).sum((2, 3)), float(wrong.sum()), int(truth.sum())


def train_field(crf: Field, levels: list[np.ndarray], toxic: np.ndarray, *, rounds: int = 40, rate: float = 0.5) -> Field:
    """AdaGrad ascent on the log-likelihood of the token labels, summed over LANES sequences at a time."""
    order = sorted((i for i, x in enumerate(levels) if len(x)), key=lambda i: -len(levels[i]))
    if not order:
        return crf
    parts = [([levels[i] for i in order[s:s + LANES]], np.asarray(toxic, bool)[order[s:s + LANES]]) for s in range(0, len(order), LANES)]
    speed = [np.full((3, len(LEVELS) + 1), 1e-8), np.full((2, 2), 1e-8), 1e-8]  # squared gradients so far
    for _ in range(rounds):
        sums = [gradient(crf, *p) for p in parts]
        emit, moves, bias, count = (sum(s[k] for s in sums) for k in range(4))
        scale = max(1, count)
        step = [emit / scale - 1e-3 * crf.emit, moves / scale - 1e-3 * crf.moves, bias / scale]
        speed = [v + g**2 for v, g in zip(speed, step, strict=True)]
        crf.emit, crf.moves, crf.bias = (
            w + rate * g / np.sqrt(v) for w, g, v in zip((crf.emit, crf.moves, crf.bias), step, speed, strict=True))
    return crf


def summaries(parts: list[np.ndarray]) -> np.ndarray:
    """Document inputs of the calibration: log expected toxic tokens, highest marginal, log length."""
    return np.array([(np.log(p.sum() + 1e-3), p.max(), np.log1p(len(p))) if len(p) else (np.log(1e-3), 0.0, 0.0) for p in parts])


def lexicon(sample: DataFrame, *, min_documents: int = 4, max_entries: int = 20_000) -> dict[str, float]:
    """Log-odds of words and word beginnings that occur in at least ``min_documents`` toxic documents.

    Counted by Spark over the labelled sample; the strongest ``max_entries`` reach the driver.
    """
    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        names, ys = [], []
        for text, y in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            found = {f for w in set(TOKEN.findall(text.lower())) for f in features(w)}
            names += found
            ys += [y] * len(found)
        return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(ys, pa.int32())], names=["f", "y"])

    totals = sample.agg(F.sum("_label").alias("t"), F.count("*").alias("n")).first()
    toxic = float(totals["t"] or 0)
    clean = float(totals["n"]) - toxic
    counts = arrow_map(sample, work, "f string, y int").groupBy("f").agg(
        F.sum("y").alias("t"), F.sum(1 - F.col("y")).alias("c"))
    odds = F.log((F.col("t") + 0.5) / (toxic + 1.0)) - F.log((F.col("c") + 0.5) / (clean + 1.0))
    rows = counts.filter(F.col("t") >= min_documents).withColumn("odds", odds).filter(F.col("odds") >= float(LEVELS[0]))
    top = rows.orderBy(F.desc(F.col("odds") * F.sqrt("t")), "f").limit(max_entries).collect()
    return {r["f"]: float(r["odds"]) for r in top}


def levels_of(evidence: Evidence, text: str) -> np.ndarray:
    words = TOKEN.findall(text.lower())
    return np.fromiter(map(evidence.__getitem__, words), np.int8, len(words))


def fit(docs: DataFrame, labels: DataFrame, *, label: str = "toxic", key: str = "doc_id", text: str = "text",
        max_labelled: int = 20_000, max_tokens: int = 2_000_000) -> Field:
    """A field from about ``max_labelled`` labelled documents at most.

    The lexicon uses all of that sample. The field and its calibration train on the driver,
    on evidence levels (one byte a token) of documents drawn by their key's hash: about
    ``max_tokens`` tokens at most. Without labels of both kinds every score is one half.
    """
    sample = labelled_texts(docs, labels, label, key=key, text=text, max_rows=max_labelled)
    crf = Field(lexicon(sample))
    sizes = sample.agg(F.sum(F.length("_text") / 6 + 1).alias("tokens")).first()["tokens"] or 0
    part = sample.filter(F.pmod(F.xxhash64("_key", F.lit(1)), F.lit(1 << 20)) < int(min(1.0, max_tokens / max(sizes, 1)) * (1 << 20)))
    shared = docs.sparkSession.sparkContext.broadcast(crf.lexicon)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        evidence = Evidence(shared.value)
        rows = [levels_of(evidence, t).tobytes() for t in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(rows, pa.binary())], names=["k", "y", "v"])

    kind = part.schema["_key"].dataType.simpleString()
    got = arrow_map(part, work, f"k {kind}, y int, v binary").toPandas().sort_values("k", kind="stable")
    y = got["y"].to_numpy(float)
    if len(y) == 0 or y.min() == y.max():
        return crf
    levels = [np.frombuffer(v, np.int8) for v in got["v"]]
    chunked, owner = [], []  # pieces of at most 512 tokens, so that lanes stay even
    for i, x in enumerate(levels):
        for s in range(0, len(x), 512):
            chunked.append(x[s:s + 512])
            owner.append(i)
    train_field(crf, chunked, y[owner])
    parts = [p for s in range(0, len(levels), 512) for p in marginals(crf, levels[s:s + 512])]
    crf.calibration = fit_logistic(summaries(parts), y)
    return crf


def score(docs: DataFrame, crf: Field, *, text: str = "text", threshold: float = 0.3, span_threshold: float = 0.5,
          keep_spans: bool = True) -> DataFrame:
    """All columns of ``docs`` but the text, with score, predicted and toxic spans.

    ``spans`` lists [start, end) code point offsets of tokens whose marginal reaches
    ``span_threshold``. A null or empty text has no tokens and gets the score of none.
    """
    new = {"score": "double", "predicted": "int"} | ({"spans": "array<struct<start:int,end:int>>"} if keep_spans else {})
    rest = [c for c in docs.columns if c != text and c not in new]
    frame = text_last(docs, rest, text)
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema.fields[:len(rest)]]
    shared = docs.sparkSession.sparkContext.broadcast(crf)
    memo: list[Evidence] = []

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not memo:
            memo.append(Evidence(shared.value.lexicon))
        texts = batch.column(len(rest)).to_pylist()
        parts = marginals(shared.value, [levels_of(memo[0], t) for t in texts])
        margin = np.column_stack([summaries(parts), np.ones(len(parts))]) @ shared.value.calibration
        p = 1 / (1 + np.exp(-np.clip(margin, -30, 30)))
        columns = [pa.array(p), pa.array((p >= threshold).astype(np.int32))]
        if keep_spans:
            spans = []
            for t, m in zip(texts, parts, strict=True):
                hits = set(np.flatnonzero(m >= span_threshold).tolist())
                found = [x.span() for i, x in enumerate(TOKEN.finditer(t)) if i in hits] if hits else []
                spans.append([{"start": a, "end": b} for a, b in found])
            columns.append(pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))))
        return pa.RecordBatch.from_arrays([*batch.columns[:len(rest)], *columns], names=[*rest, *new])

    return arrow_map(frame, work, ", ".join([*fields, *(f"{k} {v}" for k, v in new.items())]))
