"""Toxicity by a linear classifier over character n-grams, scaled by naive Bayes log-count ratios."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, map_batches, sum_arrays
from .grams import hashed, held_out, labelled_sample, letter_text

SIZES, BITS, BLOCKS = (4, 5, 6), 20, 16
#: Labelled rows that the classifier is fitted on, about: the fit runs in one task, whose memory this bounds.
SAMPLE = 12_000
#: An n-gram counts where its log-count ratio is this many standard errors and at least LEAST_RATIO, either way.
LEAST_Z, LEAST_RATIO = 4.0, 0.5
PENALTY, EPOCHS, RATE, SEED = 1e-4, 12, 0.2, 3


def present(text: str | None) -> np.ndarray:
    """Hashes of the distinct n-grams of a text: letters in lower case, each run of other characters a space."""
    if not text:
        return np.zeros(0, np.int64)
    points = letter_text(text)
    return np.unique(np.concatenate([hashed(points, n, BITS) for n in SIZES]))


def log_count_ratio(positive: np.ndarray, negative: np.ndarray, n_positive: int, n_negative: int) -> np.ndarray:
    """Naive Bayes log-count ratios of presence, smoothed by one; 0 where the ratio is small or uncertain."""
    p, q = positive + 1.0, negative + 1.0
    ratio = np.log(p / (n_positive + 2)) - np.log(q / (n_negative + 2))
    ratio[(np.abs(ratio) < LEAST_Z * np.sqrt(1 / p + 1 / q)) | (np.abs(ratio) < LEAST_RATIO)] = 0
    return ratio


def fit(rows: list[np.ndarray], y: np.ndarray, ratio: np.ndarray) -> tuple[np.ndarray, float]:
    """(weights, bias): logistic regression by AdaGrad on presence times log-count ratio, the ratio multiplied in."""
    w, bias, grad, grad_bias = np.zeros(len(ratio)), 0.0, np.full(len(ratio), 1e-6), 1e-6
    draw = np.random.default_rng(SEED)
    for _ in range(EPOCHS):
        for i in draw.permutation(len(rows)):
            x = rows[i]
            r = ratio[x]
            error = 1 / (1 + np.exp(-np.clip(r @ w[x] + bias, -30, 30))) - y[i]
            g = error * r + PENALTY * w[x]
            grad[x] += g * g
            w[x] -= RATE * g / np.sqrt(grad[x])
            grad_bias += error * error
            bias -= RATE * error / np.sqrt(grad_bias)
    return (w * ratio).astype(np.float32), float(bias)


def _counts(rows: DataFrame) -> dict[int, tuple[int, np.ndarray]]:
    """Per label the rows and how many of them have each n-gram.

    The arrays of a task are shuffled in BLOCKS blocks, the last holding the number of rows, and summed as they come.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, found = [0, 0], np.zeros((2, 1 << BITS), np.int64)
        for batch in batches:
            for text, y in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                n[y > 0] += 1
                found[int(y > 0), present(text)] += 1
        task = TaskContext.get().partitionId()
        for y in (0, 1):
            for block, part in enumerate([*np.split(found[y], BLOCKS), np.array([n[y]])]):
                if part.any():
                    yield pa.RecordBatch.from_arrays([pa.array([y], pa.int32()), pa.array([block], pa.int32()), pa.array([task], pa.int32()), pa.array([zlib.compress(part.astype("<i8").tobytes(), 1)], pa.binary())], names=["y", "block", "task", "counts"])

    out = {y: np.zeros((1 << BITS) + 1, np.int64) for y in (0, 1)}
    for r in sum_arrays(map_arrow(rows, run, "y int, block int, task int, counts binary"), {"y": "int", "block": "int"}).collect():
        part = np.frombuffer(zlib.decompress(r["counts"]), "<i8")
        at = r["block"] * ((1 << BITS) // BLOCKS)
        out[r["y"]][at : at + len(part)] = part
    return {y: (int(x[-1]), x[:-1]) for y, x in out.items()}


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", *, sample: int = SAMPLE, **columns: str) -> tuple[np.ndarray, float]:
    """Counts by all executors, fits in one task, both on a bounded sample of labelled rows.

    Where one class is missing the weights are zero and the bias says the other; without labelled rows, label 0.
    """
    rows = labelled_sample(docs, labels, label, sample, **columns).select("doc_id", "text", "y")
    counts = _counts(rows)
    (n0, negative), (n1, positive) = counts[0], counts[1]
    if not n0 or not n1:
        return np.zeros(1 << BITS, np.float32), 6.0 if n1 else -6.0
    ratio = log_count_ratio(positive, negative, n1, n0)
    used = ratio != 0

    def features():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [present(t) for t in batch.column(1).to_pylist()]
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([x[used[x]].astype("<i4").tobytes() for x in found], pa.binary())], names=["doc_id", "y", "x"])

        return step

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = list(batches)
        if batches:
            table = pa.Table.from_batches(batches).sort_by([("doc_id", "ascending"), ("x", "ascending")])
            w, bias = fit([np.frombuffer(x, "<i4").astype(np.int64) for x in table["x"].to_pylist()], table["y"].to_numpy().astype(float), ratio)
            yield pa.RecordBatch.from_arrays([pa.array([w.tobytes()], pa.binary()), pa.array([bias])], names=["w", "bias"])

    got = map_batches(rows, features, "doc_id long, y int, x binary").repartition(1).mapInArrow(run, "w binary, bias double").first()
    return np.frombuffer(bytes(got["w"]), np.float32), got["bias"]


def score(docs: DataFrame, model: tuple[np.ndarray, float], *, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) per row in one scan. Null and empty texts score the bias alone.

    Repeated rows give repeated results; other columns are not read; an empty table gives no rows.
    """
    w, bias = model
    used = w != 0

    def start():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            scores = []
            for text in batch.column(2).to_pylist():
                points = letter_text(text) if text else np.zeros(0, np.uint32)
                x = np.concatenate([hashed(points, n, BITS) for n in SIZES])
                x = np.unique(x[used[x]])
                scores.append(1 / (1 + np.exp(-np.clip(float(w[x].sum()) + bias, -30, 30))))
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32())], names=["doc_id", "held_out", "score", "predicted"])

        return step

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    return map_batches(rows, start, "doc_id long, held_out boolean, score double, predicted int")
