"""Held-out splits, bounded labelled samples and logistic calibration, shared by the classifiers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(parts: int) -> Column:
    """crc32(doc_id as text) mod ``parts``; null for a null doc_id."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(parts))


def sample(docs: DataFrame, labels: DataFrame, label: str, learn: Column, each: int, longest: int = 65_536) -> tuple[list[tuple[int, int, str]], dict[int, int]]:
    """Up to ``each`` (doc_id, label, text) of either label 0 or 1, and how many rows had that label.

    Rows with null label, doc_id or text, or a text of more than ``longest`` characters are not learnt from.  The rows
    with the least hash of doc_id are taken, whatever the order; a doc_id that two rows label differently is left out, and
    of the texts of a repeated doc_id the least is learnt from.  ``each`` and ``longest`` bound what the driver holds.
    """
    # clashing names in either table do no harm: only these columns are read
    own = labels.select("doc_id", F.col(label).cast("int").alias("__y")).where("__y in (0, 1)").groupBy("doc_id").agg(F.min("__y").alias("__y"), F.max("__y").alias("__z")).where("__y = __z and doc_id is not null").drop("__z")
    ids = own.where(learn)
    many = {r["__y"]: r["count"] for r in ids.groupBy("__y").count().collect()}  # two rows at most
    first = [ids.where(F.col("__y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(each) for y in (0, 1)]
    chosen = F.broadcast(first[0].unionByName(first[1]))  # at most 2 * each ids
    rows = docs.select("doc_id", "text").where(F.col("text").isNotNull() & (F.length("text") <= longest)).join(chosen, "doc_id")
    rows = rows.groupBy("doc_id", "__y").agg(F.min("text").alias("text"))  # one row a doc_id, however often it is there
    return sorted((r["doc_id"], r["__y"], r["text"]) for r in rows.collect()), many


def logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, rounds: int = 50, ridge: float = 1e-3) -> np.ndarray:
    """Weights (constant last) of a logistic regression by Newton's method."""
    a = np.column_stack((x, np.ones(len(x))))
    b = np.zeros(a.shape[1])
    w = w / w.sum()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ b, -30, 30)))
        grad = a.T @ (w * (p - y)) + ridge * np.append(b[:-1], 0)
        hess = (a * (w * p * (1 - p))[:, None]).T @ a + ridge * np.eye(len(b))
        step = np.linalg.solve(hess, grad)
        b -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return b


def chance(b: np.ndarray, x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(np.column_stack((x, np.ones(len(x)))) @ b, -30, 30)))
