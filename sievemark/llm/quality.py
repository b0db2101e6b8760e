"""Quality by nearest-neighbour voting among labelled documents in a latent semantic space."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, slices
from .grams import code_points, held_out, labelled_sample

BITS, SIZES = 14, (1, 2, 3, 4)
#: Labelled rows that vote, about: their vectors are broadcast (SAMPLE * DIMENSIONS floats, 1.5 MB).
SAMPLE, DIMENSIONS, OVERSAMPLE = 6_000, 64, 16
NEIGHBOURS = 15
BLOCK_ROWS = 256
SEED = 11
_SHAPES: list[np.ndarray] = []


def _shapes() -> np.ndarray:
    """A class for each code point: upper and lower letters, digits, white space, and other characters by themselves."""
    if not _SHAPES:
        table = np.arange(0x110000, dtype=np.uint32) + 16
        for c in range(0x110000):
            ch = chr(c)
            if ch.isalpha():
                table[c] = 1 if ch.isupper() else 2
            elif ch.isdigit():
                table[c] = 3
            elif ch.isspace():
                table[c] = 5 if ch == "\n" else 4
        _SHAPES.append(table)
    return _SHAPES[0]


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(indices, weights) of a text's terms, each weight 1 + ln(frequency).

    Terms are n-grams of character shapes, so that they mean the same in every language, and words that follow
    themselves, lines that come again and word lengths, each counted in steps of their share.
    """
    from .grams import hashed

    if not text:
        return np.zeros(0, np.int64), np.zeros(0, np.float32)
    points = _shapes()[code_points(text)]
    words, lines = text.split(), text.split("\n")
    same = sum(a == b for a, b in zip(words, words[1:], strict=False)) / max(1, len(words) - 1)
    again = 1 - len(set(lines)) / len(lines)
    kinds = len(set(words)) / max(1, len(words))
    mean = sum(map(len, words)) / max(1, len(words))
    own = [(1, int(10 * same)), (2, int(10 * again)), (3, int(10 * kinds * min(1.0, len(words) / 100))), (4, min(20, int(mean)))]
    grams = [hashed(points, n, BITS) for n in SIZES]
    extra = [np.full(1 + len(points) // 50, (kind * 7919 + step * 104_729) % (1 << BITS), np.int64) for kind, step in own]
    index, count = np.unique(np.concatenate([*grams, *extra]), return_counts=True)
    return index, (1 + np.log(count)).astype(np.float32)


class Space:
    """Latent vectors: inverse-document-frequency weights, a projection, and the labelled vectors that vote."""

    def __init__(self, idf: np.ndarray, basis: np.ndarray, vectors: np.ndarray, labels: np.ndarray, prior: float):
        self.projection, self.vectors, self.labels, self.prior = (basis * idf[:, None]).astype(np.float32), vectors, labels, prior

    def vector(self, text: str | None) -> np.ndarray:
        index, weight = features(text)
        v = weight @ self.projection[index] if len(index) else np.zeros(self.projection.shape[1], np.float32)
        return v / max(1e-12, float(np.sqrt(v @ v)))

    def vote(self, block: np.ndarray) -> np.ndarray:
        """Scores of a block of vectors: exact cosines with every labelled vector, the nearest weighted by theirs.

        All labelled rows that tie with the last place vote too; cosines are compared to six digits, as blocked sums
        differ in the last ones. A zero vector gets the sample's share of 1.
        """
        if not len(self.vectors):
            return np.full(len(block), self.prior)
        cosine = np.round(block @ self.vectors.T, 6)
        k = min(NEIGHBOURS, cosine.shape[1])
        last = -np.partition(-cosine, k - 1, axis=1)[:, k - 1]
        row, at = np.nonzero(cosine >= last[:, None])
        weight = np.maximum(cosine[row, at], 0).astype(np.float64) ** 8 + 1e-12
        out = np.bincount(row, weight * self.labels[at], len(block)) / np.bincount(row, weight, len(block))
        out[~block.any(axis=1)] = self.prior
        return np.clip(out, 0, 1)


def fit(texts: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray) -> Space:
    """Randomised SVD with one power iteration of the sample's term matrix, a sparse row at a time."""
    m, width, rank = len(texts), 1 << BITS, DIMENSIONS + OVERSAMPLE
    df = np.zeros(width)
    for index, _ in texts:
        df[index] += 1
    idf = np.log((1 + m) / (1 + df)) + 1
    rows = []
    for index, weight in texts:
        v = weight * idf[index]
        rows.append((index, (v / max(1e-12, np.sqrt(v @ v))).astype(np.float32)))
    times = lambda b: np.array([v @ b[i] if len(i) else np.zeros(b.shape[1], np.float32) for i, v in rows], np.float32)

    def back(q: np.ndarray) -> np.ndarray:
        out = np.zeros((width, q.shape[1]), np.float32)
        for (i, v), row in zip(rows, q, strict=True):
            out[i] += v[:, None] * row
        return out

    omega = np.random.default_rng(SEED).standard_normal((width, min(rank, m))).astype(np.float32)
    q, _ = np.linalg.qr(times(omega))
    q, _ = np.linalg.qr(times(back(q)))
    _, _, vt = np.linalg.svd(back(q).T, full_matrices=False)
    basis = np.zeros((width, DIMENSIONS), np.float32)
    basis[:, : min(DIMENSIONS, len(vt))] = vt[:DIMENSIONS].T
    vectors = times(basis)
    vectors /= np.maximum(1e-12, np.linalg.norm(vectors, axis=1, keepdims=True))
    return Space(idf, basis, vectors.astype(np.float32), y.astype(np.float64), float(y.mean()))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", *, sample: int = SAMPLE, **columns: str) -> Space:
    """Fits in one executor task on a bounded sample of labelled rows. Without labelled rows every score is 0.5."""
    rows = labelled_sample(docs, labels, label, sample, **columns)

    def start():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [features(t) for t in batch.column(1).to_pylist()]
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([i.astype("<i4").tobytes() for i, _ in found], pa.binary()), pa.array([w.astype("<f4").tobytes() for _, w in found], pa.binary())], names=["doc_id", "y", "i", "w"])

        return step

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = list(batches)
        if batches:
            table = pa.Table.from_batches(batches).sort_by([("doc_id", "ascending"), ("i", "ascending")])
            texts = [(np.frombuffer(i, "<i4").astype(np.int64), np.frombuffer(w, "<f4")) for i, w in zip(table["i"].to_pylist(), table["w"].to_pylist(), strict=True)]
            s = fit(texts, table["y"].to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (s.projection, s.vectors, s.labels)] + [pa.array([s.prior])], names=["p", "v", "y", "prior"])

    got = map_batches(rows.select("doc_id", "text", "y"), start, "doc_id long, y int, i binary, w binary").repartition(1).mapInArrow(run, "p binary, v binary, y binary, prior double").collect()
    space = Space(np.ones(1), np.zeros((1, DIMENSIONS)), np.zeros((0, DIMENSIONS), np.float32), np.zeros(0), 0.5)
    space.projection = np.zeros((1 << BITS, DIMENSIONS), np.float32)
    if got:
        space.projection = np.frombuffer(bytes(got[0]["p"]), np.float32).reshape(-1, DIMENSIONS)
        space.vectors, space.labels, space.prior = np.frombuffer(bytes(got[0]["v"]), np.float32).reshape(-1, DIMENSIONS), np.frombuffer(bytes(got[0]["y"]), np.float64), got[0]["prior"]
    return space


def score(docs: DataFrame, space: Space, *, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) per row in one scan. Null and empty texts get the sample's share of 1.

    Repeated rows give repeated results; other columns are not read; an empty table gives no rows.
    """

    def start():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            scores = [space.vote(np.array([space.vector(t) for t in part.column(2).to_pylist()], np.float32)) for part in slices(batch, BLOCK_ROWS)]
            scores = np.concatenate(scores) if scores else np.zeros(0)
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores, pa.float64()), pa.array((scores >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

        return step

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    return map_batches(rows, start, "doc_id long, held_out boolean, score double, predicted int")
