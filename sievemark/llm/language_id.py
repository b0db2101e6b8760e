"""Language identification by multilingual mixtures: EM over n-gram likelihoods, a penalised choice of the languages."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import joined, map_arrow, map_batches, slices, sum_arrays
from .grams import hashed, held_out, letter_text

N, BITS, ALPHA = 3, 16, 0.5
#: EM rounds for each set of languages.
ROUNDS = 12
#: What a further language must add to the log-likelihood, for each log of the number of n-grams.
PENALTY = 6.0
BLOCK_ROWS, LEARN_ROWS = 256, 64
UNDETERMINED = "und"


def _grams(text: str | None) -> np.ndarray:
    return hashed(letter_text(text), N, BITS) if text else np.zeros(0, np.int64)


def gram_counts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> list[tuple[str, np.ndarray]]:
    """n-gram counts of each language over all rows that may be learned from.

    A task adds up its own counts, and a row of at most 2**BITS counts for each task and language is shuffled; those
    rows are summed as they come, in two levels. The driver sees one such row for each language.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in slices(batch, LEARN_ROWS):
                by: dict[str, list[np.ndarray]] = {}
                for text, lang in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    by.setdefault(lang, []).append(_grams(text))
                for lang, grams in by.items():
                    counts[lang] = counts.get(lang, 0) + np.bincount(np.concatenate(grams), minlength=1 << BITS)
        if counts:
            blobs, task = [zlib.compress(c.astype("<i8").tobytes(), 1) for c in counts.values()], TaskContext.get().partitionId()
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array([task] * len(counts), pa.int32()), pa.array(blobs, pa.binary())], names=["lang", "task", "counts"])

    learn = docs.filter(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull() & ~held_out(id_col)).select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    rows = sum_arrays(map_arrow(learn, run, "lang string, task int, counts binary"), {"lang": "string"}).collect()
    return sorted(((r["lang"], np.frombuffer(zlib.decompress(r["counts"]), "<i8")) for r in rows), key=lambda x: x[0])


class Mixtures:
    """Language proportions of documents, from smoothed n-gram probabilities of the languages learned."""

    def __init__(self, counts: list[tuple[str, np.ndarray]]):
        self.langs = [lang for lang, _ in counts]
        table = np.array([c for _, c in counts], np.float64).reshape(len(counts), 1 << BITS) + ALPHA
        self.p = (table / table.sum(axis=1, keepdims=True)).T.astype(np.float32)  # n-grams by languages

    @staticmethod
    def _em(p: np.ndarray, n: np.ndarray, starts: np.ndarray, doc: np.ndarray, totals: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Weights of each document's mixture after ROUNDS, and its log-likelihood. p: n-grams by the set's languages."""
        for _ in range(ROUNDS):
            share = p * weights[doc]
            share *= (n / np.maximum(share.sum(axis=1), 1e-30))[:, None]
            weights = np.add.reduceat(share, starts, axis=0) / totals[:, None]
        mixed = np.maximum((p * weights[doc]).sum(axis=1), 1e-30)
        return weights, np.add.reduceat(n * np.log(mixed), starts)

    def infer(self, grams: list[np.ndarray]) -> list[list[tuple[str, float]]]:
        """For each document its languages with proportions, largest first; none for one without n-grams."""
        out: list[list[tuple[str, float]]] = [[] for _ in grams]
        full = [i for i, g in enumerate(grams) if len(g)]
        if not full or not self.langs:
            return out
        keys = np.concatenate([(np.int64(k) << BITS) + grams[i] for k, i in enumerate(full)])
        keys, n = np.unique(keys, return_counts=True)
        doc = (keys >> BITS).astype(np.int64)
        p, n = self.p[keys & ((1 << BITS) - 1)], n.astype(np.float32)
        starts = np.searchsorted(doc, np.arange(len(full)))
        totals = np.add.reduceat(n, starts)
        count = len(self.langs)
        weights, ll = self._em(p, n, starts, doc, totals, np.full((len(full), count), 1 / count, np.float32))
        # No mixture is likelier than this: by Jensen's inequality, the optimum is at most totals * log(largest gradient)
        # above any weights. The slack is for sums of float32.
        gradient = np.add.reduceat(p * (n / np.maximum((p * weights[doc]).sum(axis=1), 1e-30))[:, None], starts, axis=0) / totals[:, None]
        bound = ll + totals * np.log(np.maximum(gradient.max(axis=1), 1)) + 1e-5 * np.abs(ll) + 1e-3
        single = np.add.reduceat(n[:, None] * np.log(p), starts, axis=0)
        order = np.argsort(-weights, axis=1, kind="stable")
        # The first set is the single likeliest language; the others grow by the full mixture's weights.
        first = single.argmax(axis=1)
        for r in range(len(full)):
            order[r] = [first[r], *(x for x in order[r] if x != first[r])]
        best, value = [np.ones(1, np.float32)] * len(full), single[np.arange(len(full)), first]
        cost = PENALTY * np.log1p(totals)
        for k in range(2, count + 1):
            # Only documents for which a set of k or more can still be the best; up to all languages learned.
            rows = np.flatnonzero(bound - (k - 1) * cost > value)
            if not len(rows):
                break
            size = np.diff(starts, append=len(doc))[rows]
            begin = np.cumsum(size) - size
            own = np.repeat(np.arange(len(rows)), size)
            at = np.arange(len(own)) + (starts[rows] - begin)[own]
            part = np.take_along_axis(p[at], order[rows][own, :k], axis=1)
            w, ll = self._em(part, n[at], begin, own, totals[rows], np.full((len(rows), k), 1 / k, np.float32))
            ll = ll - (k - 1) * cost[rows]
            for j in np.flatnonzero(ll > value[rows]).tolist():
                best[rows[j]], value[rows[j]] = w[j], ll[j]
        for r, i in enumerate(full):
            w = best[r]
            pairs = sorted(zip((self.langs[x] for x in order[r, : len(w)]), w.tolist(), strict=True), key=lambda x: (-x[1], x[0]))
            out[i] = [(lang, min(1.0, max(0.0, float(s)))) for lang, s in pairs]
        return out


def identify(docs: DataFrame, model: Mixtures, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, lang_pred, score, langs map<string,double>) per row, in one scan.

    langs is the chosen language set with proportions, lang_pred its largest part and score that part. A text without
    a letter, empty or null is 'und' with score 0, as is any text where no language was learned. Repeated rows give
    repeated results. Other columns are not read. An empty table gives no rows.
    """

    def start():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            outs = []
            for part in slices(batch, BLOCK_ROWS):
                found = model.infer([_grams(t) for t in part.column(2).to_pylist()])
                outs.append(
                    pa.RecordBatch.from_arrays(
                        [
                            part.column(0),
                            part.column(1),
                            pa.array([f[0][0] if f else UNDETERMINED for f in found], pa.string()),
                            pa.array([f[0][1] if f else 0.0 for f in found], pa.float64()),
                            pa.array([f for f in found], pa.map_(pa.string(), pa.float64())),
                        ],
                        names=["doc_id", "held_out", "lang_pred", "score", "langs"],
                    )
                )
            return joined(outs)

        return step

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    return map_batches(rows, start, "doc_id long, held_out boolean, lang_pred string, score double, langs map<string,double>")


def identify_all(docs: DataFrame, **columns: str) -> DataFrame:
    """Learns from the rows of ``docs`` that aren't held out and predicts all of its rows."""
    model = Mixtures(gram_counts(docs, **columns))
    columns.pop("lang_col", None)
    return identify(docs, model, **columns)


def keep_identified(docs: DataFrame, model: Mixtures, *, least: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose language is identified: a letter is there, and one language has ``least`` of the text.

    Rows are filtered where they are read, with all their columns.
    """
    at = docs.columns.index(text_col)

    def start():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            keep: list[bool] = []
            for part in slices(batch, BLOCK_ROWS):
                keep += [bool(f) and f[0][1] >= least for f in model.infer([_grams(t) for t in part.column(at).to_pylist()])]
            return batch.filter(pa.array(keep, pa.bool_()))

        return step

    return map_arrow(docs, _filtering(start), docs.schema)


def _filtering(start):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = start()
        for batch in batches:
            yield step(batch)

    return run
