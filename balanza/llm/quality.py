"""Quality classifier: naive Bayes support vectors.

Features are indicators of byte trigrams (hashed into a fixed number of buckets) and of n-grams
of one repeated word. Each indicator is scaled by its log-count ratio between the classes, rows
are brought to unit length, and a linear hinge-loss model is fitted by dual coordinate descent.
Statistics and model come from a bounded sample of labelled rows; scoring is one pass over all
texts with one weight vector.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from balanza.llm.common import RangeHash, bounded_batches, labelled_sample, list_array, utf8_steps, without

BUCKET_BITS = 18
#: A word repeated this often in a row is an n-gram of its own, whichever word it is.
RUNS = (2, 3, 5, 10)
FEATURES = (1 << BUCKET_BITS) + len(RUNS)

#: Most labelled rows that a model is fitted on (chosen by the hash of their id).
SAMPLE_ROWS = 8_000
SMOOTHING = 1.0
PENALTY = 10.0
EPOCHS = 12


@dataclass
class QualityModel:
    """Weights by feature; a score is the logistic of ``scale * margin + shift``."""

    weights: np.ndarray
    bias: float
    scale: float
    shift: float


def features_of(data: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """Distinct feature numbers of one text's bytes. ``seen``: scratch of FEATURES longs."""
    n = len(data)
    if n < 3:
        return np.zeros(0, np.int64)
    wide = data.astype(np.uint32)
    code = (wide[:-2] << np.uint32(16)) | (wide[1:-1] << np.uint32(8)) | wide[2:]
    bucket = ((code * np.uint32(0x9E3779B1)) >> np.uint32(32 - BUCKET_BITS)).astype(np.int64)
    place = np.arange(len(bucket))
    seen[bucket] = place
    grams = bucket[seen[bucket] == place]  # the last of each
    return np.concatenate([grams, repeats_of(data)])


def repeats_of(data: np.ndarray) -> np.ndarray:
    """Features of the longest run of one word."""
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.flatnonzero(np.diff(np.concatenate([[True], blank, [True]]).astype(np.int8)))
    start, end = edge[::2], edge[1::2]
    if len(start) < 2:
        return np.zeros(0, np.int64)
    words = RangeHash(data).of(start, end)
    breaks = np.flatnonzero(np.concatenate([[True], words[1:] != words[:-1], [True]]))
    longest = int(np.diff(breaks).max())
    return np.array([(1 << BUCKET_BITS) + i for i, run in enumerate(RUNS) if longest >= run], np.int64)


def feature_rows(sample: DataFrame) -> tuple[list[np.ndarray], np.ndarray]:
    """Feature numbers and labels of a bounded sample, computed by tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(FEATURES, np.int64)
        for batch in batches:
            for first, end, data, offsets in utf8_steps(batch.column("text")):
                rows = [features_of(data[a:b], seen) for a, b in zip(offsets, offsets[1:])]
                flat = np.concatenate(rows).astype(np.int32)
                keys = batch.column("doc_id").slice(first, end - first)
                labels = batch.column("label").slice(first, end - first)
                lists = list_array(np.array([len(r) for r in rows]), pa.array(flat))
                yield pa.RecordBatch.from_arrays([keys, labels, lists], names=["doc_id", "label", "features"])

    found = sample.mapInArrow(run, "doc_id bigint, label int, features array<int>").toArrow()
    order = np.argsort(found.column("doc_id").to_numpy(), kind="stable")
    lists = found.column("features").combine_chunks()
    offsets, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
    rows = [flat[offsets[i] : offsets[i + 1]] for i in order]  # views
    return rows, found.column("label").to_numpy()[order]


def log_count_ratios(rows: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    """log of the smoothed share of each indicator among rows of label 1 over that among label 0."""
    ratio = np.zeros(FEATURES)
    for label, sign in ((1, 1.0), (0, -1.0)):
        own = [r for r, y in zip(rows, labels) if y == label]
        counts = np.full(FEATURES, SMOOTHING)
        for row in own:
            counts[row] += 1  # a row names a feature once
        ratio += sign * np.log(counts / (2 * SMOOTHING + len(own)))
    return ratio


def dual_descent(
    rows: list[np.ndarray], values: list[np.ndarray], signs: np.ndarray, penalty: float = PENALTY, epochs: int = EPOCHS
) -> np.ndarray:
    """Weights (the last is the bias) of the linear squared-hinge model, by dual coordinate descent."""
    weights, alpha, random = np.zeros(FEATURES + 1), np.zeros(len(rows)), np.random.default_rng(7)
    diagonal = 0.5 / penalty
    norms = np.array([v @ v + 1.0 for v in values]) + diagonal
    for _ in range(epochs):
        largest = 0.0
        for i in random.permutation(len(rows)):
            margin = weights[rows[i]] @ values[i] + weights[-1]
            gradient = signs[i] * margin - 1.0 + diagonal * alpha[i]
            if alpha[i] == 0.0 and gradient >= 0.0:
                continue
            changed = max(alpha[i] - gradient / norms[i], 0.0)
            move = (changed - alpha[i]) * signs[i]
            alpha[i] = changed
            weights[rows[i]] += move * values[i]
            weights[-1] += move
            largest = max(largest, abs(move))
        if largest < 1e-4:
            break
    return weights


def logistic_fit(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Scale and shift that turn margins into probabilities (smoothed targets, Newton steps)."""
    ones = labels.sum()
    target = np.where(labels == 1, (ones + 1) / (ones + 2), 1 / (len(labels) - ones + 2))
    at = np.array([1.0, 0.0])
    design = np.stack([margins, np.ones_like(margins)], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ at, -30, 30)))
        slope = design.T @ (p - target) + 1e-6 * at
        curve = (design * (p * (1 - p))[:, None]).T @ design + 1e-6 * np.eye(2)
        change = np.linalg.solve(curve, slope)
        at -= np.clip(change, -5, 5)
        if np.abs(change).max() < 1e-8:
            break
    return float(at[0]), float(at[1])


def unit(row: np.ndarray, ratio: np.ndarray) -> np.ndarray:
    values = ratio[row]
    return (values / max(np.sqrt(values @ values), 1e-12)).astype(np.float32)


def fit(sample: DataFrame) -> QualityModel | float:
    """A model from rows of (doc_id, text, label); a constant score where a class is missing."""
    rows, labels = feature_rows(sample)
    if len(labels) == 0 or labels.min() == labels.max():
        return float(labels[0] > 0) if len(labels) else 0.5
    labels = (labels > 0).astype(int)
    ratio = log_count_ratios(rows, labels)
    values = [unit(r, ratio) for r in rows]
    weights = dual_descent(rows, values, 2.0 * labels - 1.0)
    margins = np.array([weights[r] @ v + weights[-1] for r, v in zip(rows, values)])
    scale, shift = logistic_fit(margins, labels)
    return QualityModel(np.stack([ratio, weights[:-1]]).astype(np.float32), float(weights[-1]), scale, shift)


def score(df: DataFrame, model: QualityModel | float, text: str = "text") -> DataFrame:
    """``df`` with ``score double`` in 0 to 1 and ``predicted int`` (1 from 0.5 on).

    Null and empty texts have no features and get the score of the bias alone. Without both
    classes among the labelled rows the score is the only label, or 0.5 without any. Columns
    called score or predicted are replaced; all rows and other columns stay.
    """
    bounded_batches(df.sparkSession)
    df = without(df, ["score", "predicted"])
    if isinstance(model, float):
        return df.withColumns({"score": F.lit(model), "predicted": F.lit(int(model >= 0.5))})
    names = df.columns
    shared = df.sparkSession.sparkContext.broadcast(model)  # FEATURES weights, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, seen = shared.value, np.zeros(FEATURES, np.int64)
        ratio, weights = m.weights[0], m.weights[1]
        for batch in batches:
            for first, end, data, offsets in utf8_steps(batch.column(names.index(text))):
                margins = np.empty(end - first)
                for i, (a, b) in enumerate(zip(offsets, offsets[1:])):
                    row = features_of(data[a:b], seen)
                    values = ratio[row].astype(np.float64)
                    size = max(np.sqrt(values @ values), 1e-12)
                    margins[i] = weights[row].astype(np.float64) @ values / size + m.bias
                scores = 1 / (1 + np.exp(-np.clip(m.scale * margins + m.shift, -30, 30)))
                rows = batch.slice(first, end - first)
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(scores)], names=[*names, "score"])

    from pyspark.sql.types import DoubleType, StructField, StructType

    out = df.mapInArrow(run, StructType([*df.schema.fields, StructField("score", DoubleType())]))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


#: The held-out fold of the contract: ids whose crc32 leaves this rest teach nothing.
FOLDS, HELD_OUT = 3, 1


def fit_on_labels(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE_ROWS) -> QualityModel | float:
    """Fit on at most ``limit`` rows labelled for quality outside the held-out fold."""
    return fit(labelled_sample(docs, labels, "quality", limit, FOLDS, HELD_OUT))
