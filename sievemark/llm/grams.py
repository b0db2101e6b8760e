"""Character n-grams of texts as hashed numbers, and bounded samples of labelled rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix64

SPACE = np.uint32(32)
_LETTERS: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Whether each code point is a letter, computed once for a process."""
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _LETTERS[0]


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def letter_text(text: str) -> np.ndarray:
    """Lower-cased letters with every run of other characters as one space, and a space at either end; empty without letters."""
    points = code_points(text.lower())
    alpha = letters()[points]
    if not alpha.any():
        return points[:0]
    points = np.concatenate([[SPACE], np.where(alpha, points, SPACE), [SPACE]]).astype(np.uint32)
    keep = np.ones(len(points), bool)
    keep[1:] = (points[1:] != SPACE) | (points[:-1] != SPACE)
    return points[keep]


def hashed(points: np.ndarray, n: int, bits: int) -> np.ndarray:
    """Hashes below 2**bits of all n-grams (int64), in order."""
    count = len(points) - n + 1
    if count <= 0:
        return np.zeros(0, np.int64)
    acc = np.full(count, np.uint64(n))
    for j in range(n):
        acc = acc * np.uint64(0x100000001B3) + points[j : j + count]
    return (mix64(acc) >> np.uint64(64 - bits)).astype(np.int64)


def held_out(id_col: str = "doc_id", folds: int = 5):
    """The rows that nothing is learned from: crc32 of the id as text, modulo ``folds``, is 0. A null id isn't one."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(folds)) == 0, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, most: int, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, y) of about ``most`` labelled rows that aren't held out, drawn by a hash of the id.

    An id with several labels counts as the largest. At most about ``most`` small rows are broadcast.
    """
    known = labels.filter(F.col(id_col).isNotNull() & F.col(label).isNotNull() & ~held_out(id_col)).groupBy(F.col(id_col).alias("doc_id")).agg(F.max(label).cast("int").alias("y"))
    n = known.count()
    draw = F.pmod(F.xxhash64(F.lit(5), "doc_id"), F.lit(1_000_000))
    known = known.filter(draw < F.lit(1_000_000 if n <= most else int(1_000_000 * most / n)))
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(known), "doc_id").select("doc_id", "text", "y")
