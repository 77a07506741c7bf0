"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of labelled documents are computed on the executors; only those numbers, of a
bounded sample, reach the driver, where the trees are grown on binned columns. A fitted
model is a few flat arrays: all trees are complete binary trees of one depth, so a batch of
documents descends all of them together by index arithmetic.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import arrow_map, text_last
from .labelled import labelled_texts

STATISTICS = [
    "log_bytes", "lower", "upper", "digit", "space", "newline", "symbol", "punctuation", "high", "distinct_bytes",
    "log_words", "word_length", "distinct_words", "distinct_pairs", "commonest_word", "distinct_lines", "line_words",
    "upper_words", "ending_words", "byte_entropy"]
_BYTES = np.arange(256)
_CLASSES = [
    (_BYTES >= 97) & (_BYTES <= 122), (_BYTES >= 65) & (_BYTES <= 90), (_BYTES >= 48) & (_BYTES <= 57),
    np.isin(_BYTES, [32, 9]), _BYTES == 10, np.isin(_BYTES, list(b"#*$%&|<>!=@^~_+{}[]\\/")),
    np.isin(_BYTES, list(b".,;:?'\"()-")), _BYTES >= 128]
_CLASS_MATRIX = np.array(_CLASSES, float).T


def statistics(texts: list[str]) -> np.ndarray:
    """One row of STATISTICS per text; an empty text gives zeros."""
    out = np.zeros((len(texts), len(STATISTICS)))
    counts = np.zeros((len(texts), 256))
    for row, text in enumerate(texts):
        raw = text.encode("utf-8", "surrogatepass")
        counts[row] = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
        words = raw.split()
        if not words:
            continue
        n = len(words)
        seen: dict[bytes, int] = {}
        for w in words:
            seen[w] = seen.get(w, 0) + 1
        lines = [x for x in raw.split(b"\n") if x]
        out[row, 10:19] = (
            np.log1p(n), sum(map(len, words)) / n, len(seen) / n, len(set(zip(words, words[1:], strict=False))) / n,
            max(seen.values()) / n, len(set(lines)) / max(1, len(lines)), np.log1p(n / max(1, len(lines))),
            sum(map(bytes.isupper, words)) / n, raw.count(b".") / n)
    total = np.maximum(counts.sum(1), 1)
    shares = counts / total[:, None]
    out[:, 0] = np.log1p(counts.sum(1))
    out[:, 1:9] = shares @ _CLASS_MATRIX
    out[:, 9] = (counts > 0).sum(1)
    out[:, 19] = -(shares * np.log2(np.where(shares > 0, shares, 1))).sum(1)
    return out


@dataclass
class Trees:
    """Flat complete trees: node i has children 2i+1 and 2i+2; row ``x`` goes right if x > cut."""

    base: float
    depth: int
    feature: np.ndarray  # (trees, inner nodes)
    cut: np.ndarray
    leaf: np.ndarray  # (trees, leaves)

    def margin(self, x: np.ndarray) -> np.ndarray:
        rows, trees = np.arange(len(x))[:, None], np.arange(len(self.feature))[None, :]
        node = np.zeros((len(x), len(self.feature)), np.int64)
        for _ in range(self.depth):
            node = 2 * node + 1 + (x[rows, self.feature[trees, node]] > self.cut[trees, node])
        return self.base + self.leaf[trees, node - self.feature.shape[1]].sum(1)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def grow(x: np.ndarray, y: np.ndarray, *, trees: int = 60, depth: int = 4, bins: int = 64, rate: float = 0.2,
         l2: float = 1.0) -> Trees:
    """Boosted trees with logistic loss on columns cut into equal-count bins.

    With no rows the probability is one half; with one class it is that class's rate.
    """
    inner, leaves, wide = 2**depth - 1, 2**depth, x.shape[1]
    p = (y.sum() + 0.5) / (len(y) + 1)
    model = Trees(float(np.log(p / (1 - p))), depth, np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)))
    if len(y) == 0 or y.min() == y.max():
        return model
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(wide)]
    codes = np.column_stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)])
    margin = np.full(len(y), model.base)
    features, cuts, values = [], [], []
    for _ in range(trees):
        prob = 1 / (1 + np.exp(-margin))
        g, h = prob - y, prob * (1 - prob)
        feature, cut, at = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(len(y), np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            best = np.zeros(width)
            split = np.full(width, -1)
            for f in range(wide):
                cell = (at - first) * bins + codes[:, f]
                gs = np.bincount(cell, g, width * bins).reshape(width, bins).cumsum(1)
                hs = np.bincount(cell, h, width * bins).reshape(width, bins).cumsum(1)
                gt, ht = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + l2) + (gt - gs) ** 2 / (ht - hs + l2) - gt**2 / (ht + l2)
                gain[(hs < 1) | (ht - hs < 1)] = 0
                gain = gain[:, :len(edges[f])]
                if not gain.shape[1]:
                    continue
                pick = gain.argmax(1)
                top = gain[np.arange(width), pick]
                better = top > best + 1e-9
                best[better], split[better] = top[better], pick[better]
                feature[first:first + width][better] = f
            for k in range(width):
                if split[k] >= 0:
                    cut[first + k] = edges[feature[first + k]][split[k]]
            at = 2 * at + 1 + (x[np.arange(len(y)), feature[at]] > cut[at])
        leaf = at - inner
        value = -rate * np.bincount(leaf, g, leaves) / (np.bincount(leaf, h, leaves) + l2)
        margin += value[leaf]
        features.append(feature)
        cuts.append(cut)
        values.append(value)
    return Trees(model.base, depth, np.array(features), np.array(cuts), np.array(values))


def fit(docs: DataFrame, labels: DataFrame, *, label: str = "quality", key: str = "doc_id", text: str = "text",
        max_labelled: int = 20_000) -> Trees:
    """Trees for P(label = 1) from at most about ``max_labelled`` labelled documents.

    That bound keeps what the driver holds constant: one row of statistics per document.
    """
    sample = labelled_texts(docs, labels, label, key=key, text=text, max_rows=max_labelled)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = statistics(batch.column(1).to_pylist())
        rows = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), len(STATISTICS)).cast(pa.list_(pa.float64()))
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), rows], names=["k", "y", "x"])

    kind = sample.schema["_key"].dataType.simpleString()
    got = arrow_map(sample, work, f"k {kind}, y int, x array<double>").toPandas().sort_values("k", kind="stable")
    x = np.array(got["x"].tolist(), float).reshape(-1, len(STATISTICS))
    return grow(x, got["y"].to_numpy(float))


def score(docs: DataFrame, model: Trees, *, text: str = "text", threshold: float = 0.3) -> DataFrame:
    """All columns of ``docs`` with score (P(label = 1)) and predicted (score >= threshold).

    A null or empty text is scored by its zero statistics. Columns named like a result give
    way to it; repeated rows get the same score.
    """
    rest = [c for c in docs.columns if c not in ("score", "predicted")]
    frame = text_last(docs, rest, text)
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema.fields[:len(rest)]]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        p = shared.value.probability(statistics(batch.column(len(rest)).to_pylist()))
        return pa.RecordBatch.from_arrays([*batch.columns[:len(rest)], pa.array(p), pa.array((p >= threshold).astype(np.int32))],
                                          names=[*rest, "score", "predicted"])

    return arrow_map(frame, work, ", ".join([*fields, "score double", "predicted int"]))
