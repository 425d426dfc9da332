"""Bounded samples of labelled documents, bounded in rows and bytes, and the calibration the classifiers share."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(doc_id: Column | str, parts: int, part: int) -> Column:
    """Whether crc32 of the id as text falls on this part."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id), F.lit(parts)) == part


def choose(labels: DataFrame, label: str, parts: int, part: int, bounds: dict[int, int]) -> tuple[DataFrame, float]:
    """(doc_id, label) of at most `bounds[label]` rows of each label, none held out, and the share of label 1.

    The share counts all labels that may be learned from. Rows are drawn by a hash of their id."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
    known = known.where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out("doc_id", parts, part))
    counts = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    total = sum(counts.values())
    share = counts.get(1, 0) / total if total else 0.0
    chosen = None
    for value, most in bounds.items():
        some = known.where(F.col("label") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        chosen = some if chosen is None else chosen.union(some)
    return chosen, share


def texts_of(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """(doc_id, text, label) of the chosen rows, of which there are so few that they may be broadcast."""
    texts = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    )
    return texts.join(F.broadcast(chosen), "doc_id")


def drawn(rows: DataFrame, longest: int) -> DataFrame:
    """(doc_id, text, label) of `texts_of`, in an order that hangs on ids and texts only: of a text of more than
    `longest` characters a passage of so many, from a place drawn by a hash of text and id."""
    size = F.length("text")
    start = F.pmod(F.xxhash64("text", "doc_id"), F.greatest(size - longest, F.lit(1))).cast("int") + 1
    passage = F.when(size > longest, F.substring("text", start, F.lit(longest))).otherwise(F.col("text"))
    passages = rows.select("doc_id", passage.alias("text"), "label")
    return passages.orderBy(F.xxhash64("doc_id"), "doc_id", "text")


def passages(rows: DataFrame, longest: int) -> list[tuple[str, int]]:
    """(text, label) of what is `drawn`, for the driver. Equal passages count once."""
    return list(dict.fromkeys((r["text"], r["label"]) for r in drawn(rows, longest).collect()))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def logistic(features: np.ndarray, label: np.ndarray, share: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean, scale and weights (intercept last) of a logistic regression, its intercept moved to the share of label 1."""
    mean, scale = features.mean(axis=0), features.std(axis=0) + 1e-9
    x = np.column_stack(((features - mean) / scale, np.ones(len(features))))
    weights = np.zeros(x.shape[1])
    for _ in range(30):
        p = sigmoid(x @ weights)
        slope = x.T @ (p - label) + 1e-2 * weights
        curve = (x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(len(weights))
        weights = weights - np.linalg.solve(curve, slope)
    drawn = label.mean()
    weights[-1] += np.log(share / (1 - share)) - np.log(drawn / (1 - drawn))
    return mean, scale, weights
