"""Bounded samples of labelled documents, for fitting models."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle, whole_text

DRAW = 1 << 20


def labelled_texts(docs: DataFrame, labels: DataFrame, label: str, *, key: str = "doc_id", text: str = "text",
                   max_rows: int) -> DataFrame:
    """(_key, _text, _label) of labelled documents, about ``max_rows`` at most.

    Above that many labels a document takes part if its key's hash falls under
    max_rows / labels, so the sample is the same in every run and spread over all
    rows. Rows with a null key or label, or a label other than 0 and 1, take no part; a
    label given twice counts once, a contradictory one as its maximum.
    """
    known = labels.filter(F.col(key).isNotNull() & F.col(label).isin(0, 1)).groupBy(F.col(key).alias("_key")).agg(
        F.max(label).cast("int").alias("_label"))
    n = known.count()
    share = min(1.0, max_rows / max(n, 1))
    if share < 1.0:
        known = known.filter(F.pmod(F.xxhash64("_key"), F.lit(DRAW)) < int(share * DRAW))
    return docs.select(F.col(key).alias("_key"), whole_text(text).alias("_text")).join(
        F.broadcast(settle(known)), "_key")


def fit_logistic(x: np.ndarray, y: np.ndarray, l2: float = 1e-3, rounds: int = 30) -> np.ndarray:
    """Weights (bias last) of a logistic regression by Newton steps."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) + l2 * len(y) * w
        hessian = (x * (p * (1 - p))[:, None]).T @ x + l2 * len(y) * np.eye(len(w))
        w -= np.linalg.solve(hessian, gradient)
    return w
