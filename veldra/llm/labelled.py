"""A bounded sample of labelled documents, and a small logistic regression."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Labelled documents that a classifier is fitted on, at most; the rows of the least hashes of doc_id.
SAMPLE = 6000


def sample(docs: DataFrame, labels: DataFrame, label: str, rows: int = SAMPLE) -> DataFrame:
    """``doc_id, label, text`` of the documents that the sample's labels name, at most ``rows``.

    Rows without doc_id or label are passed over; of several labels of one document the greatest
    counts, and of several rows of one doc_id that of the least hash of its text.
    """
    named = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("label"))
    picked = named.select(F.col("doc_id").cast("long").alias("picked"), "label").join(docs.select(F.col("doc_id").cast("long").alias("picked")).distinct(), "picked", "left_semi")
    picked = picked.orderBy(F.xxhash64("picked"), "picked").limit(rows)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.struct(F.xxhash64(text).alias("h"), text.alias("text")).alias("r"))
    met = known.join(F.broadcast(picked), F.col("doc_id") == F.col("picked"))
    return met.groupBy("doc_id").agg(F.first("label").alias("label"), F.min("r").alias("r")).select("doc_id", "label", "r.text")


def logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1.0, steps: int = 30) -> np.ndarray:
    """Weights, the intercept last, by Newton's method with a ridge penalty; zeros if all labels are alike."""
    a = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(a.shape[1])
    if len(np.unique(y)) < 2:
        return w
    ridge = np.full(len(w), penalty)
    ridge[-1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p) + 1e-9)[:, None]).T @ a + np.diag(ridge), a.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w
