"""Toxicity scores of a character n-gram classifier with naive Bayes scaling.

Features are the character n-grams of the lower-cased text that it contains,
hashed into ``BUCKETS`` columns.  Each column is scaled by its naive Bayes
log-count ratio between the two classes, and a logistic regression with an L2
penalty is trained on the scaled columns.  Training takes a bounded sample of
labelled rows, ``SAMPLE_ROWS`` of each class at most, chosen by a hash of the
id; its feature lists are bounded by ``BUCKETS`` however long the texts are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, str_values

BUCKETS = 1 << 18
ORDERS = (3, 4, 5)
#: Labelled rows of each class that training takes at most.
SAMPLE_ROWS = 1_500
#: Columns in fewer training rows carry no weight.
MIN_ROWS = 3
SMOOTHING = 1.0
PENALTY = 1e-3
STEPS = 60
_CHUNK = 1 << 20


def ngram_buckets(text: str, seen: np.ndarray) -> np.ndarray:
    """Distinct buckets of the text's n-grams.  ``seen`` is scratch, all false."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    widest = max(ORDERS)
    for lo in range(0, max(1, len(codes)), _CHUNK):
        part = codes[lo : lo + _CHUNK + widest - 1]
        for n in ORDERS:
            size = len(part) - n + 1
            if size <= 0:
                continue
            h = np.full(size, n, np.uint32)
            for j in range(n):
                h = (h ^ part[j : j + size]) * np.uint32(0x01000193)
                h ^= h >> np.uint32(15)
            seen[h & np.uint32(BUCKETS - 1)] = True
    found = np.flatnonzero(seen)
    seen[found] = False
    return found.astype(np.int32)


@dataclass
class Model:
    weight: np.ndarray  # of each bucket, the log-count ratio included
    intercept: float

    def score(self, buckets: np.ndarray) -> float:
        z = float(self.weight[buckets].sum(dtype=np.float64)) + self.intercept
        return float(1 / (1 + np.exp(-np.clip(z, -60, 60))))


def fit(rows: list[np.ndarray], toxic: np.ndarray) -> Model:
    """Train on bucket lists, both classes with equal weight.

    With a single class in the rows the score is that class's share everywhere.
    """
    y = np.asarray(toxic, np.float64)
    n, ones = len(rows), float(y.sum())
    if n == 0 or ones in (0.0, float(n)):
        share = (ones + 0.5) / (n + 1.0)
        return Model(np.zeros(BUCKETS, np.float32), float(np.log(share / (1 - share))))
    sizes = np.array([len(r) for r in rows])
    columns = np.concatenate(rows)
    owner = np.repeat(np.arange(n), sizes)
    per_class = [np.bincount(columns[y[owner] == c], minlength=BUCKETS) + SMOOTHING for c in (0, 1)]
    ratio = np.log(per_class[1] / per_class[1].sum()) - np.log(per_class[0] / per_class[0].sum())
    ratio[per_class[0] + per_class[1] - 2 * SMOOTHING < MIN_ROWS] = 0
    # Columns that say next to nothing are left out of the matrix.
    use = np.abs(ratio[columns]) > 0.3
    columns, owner = columns[use], owner[use]
    value = ratio[columns].astype(np.float32)
    scale = 1 / max(1.0, float(np.sqrt(np.bincount(owner, value.astype(np.float64) ** 2, n).mean())))
    value *= scale
    weight, bias = np.zeros(BUCKETS), 0.0
    ahead_w, ahead_b = weight.copy(), bias
    balance = np.where(y == 1, n / (2 * ones), n / (2 * (n - ones)))
    rate = 4.0 / (1.0 + float(np.bincount(owner, value.astype(np.float64) ** 2, n).max()))
    for t in range(STEPS):
        z = np.bincount(owner, value * ahead_w[columns], n) + ahead_b
        error = balance * (1 / (1 + np.exp(-np.clip(z, -60, 60))) - y) / n
        grad = np.bincount(columns, value * error[owner], BUCKETS) + PENALTY / n * ahead_w
        new_w, new_b = ahead_w - rate * n * grad, ahead_b - rate * float(error.sum())
        step = t / (t + 3)
        ahead_w, ahead_b = new_w + step * (new_w - weight), new_b + step * (new_b - bias)
        weight, bias = new_w, new_b
    return Model((weight * ratio * scale).astype(np.float32), bias)


def held_out(id_col: str = "doc_id", folds: int = 3, fold: int = 1) -> Column:
    """Whether a row's id falls in the fold that training never sees."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == fold, F.lit(False))


def train(
    docs: DataFrame,
    labels: DataFrame,
    label_col: str = "toxic",
    sample_rows: int = SAMPLE_ROWS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> Model:
    """Fit on labelled rows outside the held-out fold.

    Null labels and null ids are left out; of labels that contradict each other
    for one id the larger counts.
    """
    known = (
        labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(id_col))
        .groupBy(F.col(id_col).alias("id"))
        .agg((F.max(label_col) > 0).cast("int").alias("label"))
    )
    order = F.xxhash64("id", F.lit(11))
    chosen = [known.where(F.col("label") == c).orderBy(order, "id").limit(sample_rows) for c in (0, 1)]
    # At most twice sample_rows ids.
    sample = F.broadcast(chosen[0].unionByName(chosen[1]))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(sample, "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(BUCKETS, bool)
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                part = batch.slice(lo, 64)
                found = [ngram_buckets(t, seen).tobytes() for t in str_values(part.column(2))]
                yield pa.record_batch([part.column(0).cast(pa.int64()), part.column(1), pa.array(found, pa.binary())], ["id", "label", "found"])

    got = arrow_map(texts, ["id", "label", "text"], run, "id long, label int, found binary").toArrow()
    rows = sorted(zip(got["id"].to_pylist(), got["label"].to_pylist(), got["found"].to_pylist()))
    return fit([np.frombuffer(f, np.int32) for _, _, f in rows], np.array([label for _, label, _ in rows]))


def score(
    docs: DataFrame,
    model: Model,
    threshold: float = 0.7,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for every row.

    A null or empty text has no n-grams and gets the score of the intercept.
    Null ids pass through, never held out; repeated rows give repeated rows.
    """
    # BUCKETS weights, about 1 MB.
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(BUCKETS, bool)
        own = shared.value
        for batch in batches:
            scores = np.array([own.score(ngram_buckets(t, seen)) for t in str_values(batch.column(1))], np.float64)
            yield pa.record_batch(
                [batch.column(0).cast(pa.int64()), pa.array(scores), pa.array((scores >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"]
            )

    found = arrow_map(docs, [id_col, text_col], run, "doc_id long, score double, predicted int")
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted")
