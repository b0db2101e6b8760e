"""Scores of texts under a language model whose n-gram counts lie, quantised, in a log-frequency Bloom filter.

An n-gram of count c is in the filter with the levels 1 to q(c), q being a logarithm: probing level after level until one
is missing gives q back, never too small. Counts come from all training texts. They are gathered in slices of the hash
space, each of which makes its own segment of the filter, so a filter is as large as its n-grams need. Segments are
broadcast in packs of at most ``PACK_BYTES``; a worker holds one pack at a time.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .common import Scratch, mix64
from .grams import held_out
from .words import BATCH_WORDS, pieces, word_batches

ORDER, FOLDS = 3, 10
#: Levels grow by this factor of the count; the filter has so many bits for each level of each n-gram, and sets so many.
BASE, BITS, HASHES = 1.5, 8, 4
LEVELS = 128
#: Most that a history's own counts weigh against the history one shorter.
MOST = 0.99
ALPHA = 0.1
#: Largest part of the filter that one broadcast holds. A segment is one slice; more shuffle partitions make more slices.
PACK_BYTES = 32 << 20
#: Bytes of segments that the driver collects at once, about; one segment may be more.
SENT_BYTES = 4 << 20
#: Most tokens whose exact counts are broadcast; those of others meet the documents in a join.
FREQUENT = 1 << 18
#: Most times half of BATCH_WORDS that are scored together where the filter has many packs.
MOST_BATCHES = 4
#: Distinct n-grams of an order that a task holds before it sends them on.
HELD = 1 << 21
_SPACE = re.compile(rb"[\x20\x09-\x0d]")
START, END = np.uint64(0x9D39247E33776D41), np.uint64(0x2AF7398005AAA5C7)  # any two numbers
U = np.uint64
HISTORY = U(0xFFFFFFFFFF000000)


def token_hashes(data: bytes) -> np.ndarray:
    """64-bit hashes of the words of lower-cased UTF-8, then that of the end."""
    out = []
    for piece in pieces(data, _SPACE):
        words = piece.split()
        out.append(np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)))
    return np.concatenate([*out, np.array([END])])


def grams(parts: list[np.ndarray], order: int) -> list[np.ndarray]:
    """For each n-gram length, the code of the n-gram that ends at each token; before a text stands a start.

    A single token's code is a 64-bit hash. In a longer one's the first 40 bits are a hash of its history, the n-gram one
    shorter that ends one token before, so that in order of codes those with one history stand together.
    """
    tokens = np.concatenate(parts)
    starts = np.concatenate([[0], np.cumsum([len(p) for p in parts])[:-1]]).astype(np.int64)
    out = [mix64(tokens)]
    for n in range(2, order + 1):
        history = np.concatenate([[START], out[-1][:-1]])
        history[starts] = START
        out.append(mix64(history + U(n)) & HISTORY | out[0] >> U(40))
    return out


def level(counts: np.ndarray) -> np.ndarray:
    """1 + floor(log(count) / log(BASE)), as integers; 0 for 0."""
    counts = np.asarray(counts, np.float64)
    return np.where(counts > 0, 1 + np.floor(np.log(np.maximum(counts, 1)) / math.log(BASE) + 1e-9), 0).astype(np.int64)


def expected() -> np.ndarray:
    """The count that a level stands for: the middle of the counts it covers."""
    out = np.zeros(LEVELS + 1)
    for q in range(1, LEVELS + 1):
        low, high = math.ceil(BASE ** (q - 1) - 1e-9), math.ceil(BASE**q - 1e-9) - 1
        out[q] = (low + max(low, high)) / 2
    return out


def _seeds(hashes: np.ndarray, j: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the positions of n-grams at level j begin, and how far apart they are, before they are cut to the filter's size."""
    x = mix64(hashes ^ U(j * 0xD1B54A32D192ED03 & 0xFFFFFFFFFFFFFFFF))
    return x, (x >> U(32)) | U(1)


def segment(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The filter's bits (uint8) for one slice of distinct n-grams; sized by what goes in."""
    q = level(counts)
    size = -(-int(q.sum()) * BITS // 64) * 8 or 8
    out = np.zeros(size * 8, bool)
    for j in range(1, int(q.max(initial=0)) + 1):
        x, step = _seeds(hashes[q >= j], j)
        for i in range(HASHES):
            out[(x + U(i) * step) % U(size * 8)] = True
    return np.packbits(out, bitorder="little")


def _pack_hashes(values: np.ndarray) -> bytes:
    """Sorted uint64 as differences in byte planes, compressed."""
    planes = np.diff(values, prepend=U(0)).astype("<u8").view(np.uint8).reshape(-1, 8).T
    return pa.compress(np.ascontiguousarray(planes).tobytes(), "zstd", asbytes=True)


def _unpack_hashes(raw: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(raw, 8 * n, "zstd", asbytes=True), np.uint8).reshape(8, n)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").ravel(), dtype=np.uint64)


def _merged(hashes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes in order, and the sum of their counts."""
    h, c = np.concatenate(hashes), np.concatenate(counts)
    at = np.argsort(h, kind="stable")
    h, c = h[at], c[at]
    first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
    return h[first], np.add.reduceat(c, first) if len(h) else c


PARTIAL = "n int, slice int, size int, hashes binary, counts binary"
SLICE = "n int, slice int, items long, tokens long, bits binary, hashes array<bigint>, counts array<bigint>, levels array<bigint>, mass array<bigint>, again array<bigint>"


def _partial_counts(texts: DataFrame, order: int, slice_bits: int) -> DataFrame:
    """Distinct n-grams with counts, sent a slice of the hash space at a time."""
    schema = pa.schema([("n", pa.int32()), ("slice", pa.int32()), ("size", pa.int32()), ("hashes", pa.binary()), ("counts", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = [[] for _ in range(order)]

        def send(n: int) -> Iterator[pa.RecordBatch]:
            hashes, counts = _merged([h for h, _ in held[n]], [c for _, c in held[n]])
            held[n] = []
            cuts = np.searchsorted(hashes, np.arange(1, 1 << slice_bits, dtype=np.uint64) << U(64 - slice_bits)) if slice_bits else np.zeros(0, np.int64)
            cuts = [0, *cuts.tolist(), len(hashes)]
            for s, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                if a < b:
                    small = pa.compress(counts[a:b].astype("<i8").tobytes(), "zstd", asbytes=True)
                    yield pa.RecordBatch.from_pylist([{"n": n + 1, "slice": s, "size": b - a, "hashes": _pack_hashes(hashes[a:b]), "counts": small}], schema=schema)

        for batch in batches:
            for _, _, parts in word_batches(batch.column(0), token_hashes):
                for n, values in enumerate(grams(parts, order)):
                    held[n].append(np.unique(values, return_counts=True))
                    if sum(len(h) for h, _ in held[n]) >= HELD:
                        yield from send(n)
        for n in range(order):
            if held[n]:
                yield from send(n)

    return common.map_arrow(texts, run, PARTIAL)


def _repeats(h: np.ndarray, c: np.ndarray) -> dict[str, list[int]]:
    """By the level of a history's count: tokens that follow such histories, and those that follow the same one again."""
    first = np.flatnonzero(np.concatenate([[True], (h[1:] ^ h[:-1]) & HISTORY != 0]))
    mass, again = np.add.reduceat(c, first), np.add.reduceat(np.where(c > 1, c, 0), first)
    q = level(mass)
    return {k: np.bincount(q, weights=v, minlength=LEVELS + 1).astype(np.int64).tolist() for k, v in (("mass", mass), ("again", again))}


def _slices(partial: DataFrame) -> DataFrame:
    """A row for each slice: what it holds, its segment of the filter, and of single tokens the exact counts."""

    schema = pa.schema([("n", pa.int32()), ("slice", pa.int32()), ("items", pa.int64()), ("tokens", pa.int64()), ("bits", pa.binary()), *((c, pa.list_(pa.int64())) for c in ("hashes", "counts", "levels", "mass", "again"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, hashes, counts = None, [], []

        def done() -> Iterator[pa.RecordBatch]:
            if key is not None:
                h, c = _merged(hashes, counts)
                exact = {"hashes": h.view(np.int64).tolist(), "counts": c.tolist()} if key[0] == 1 else {"hashes": [], "counts": []}
                row = {"n": key[0], "slice": key[1], "items": len(h), "tokens": int(c.sum()), "bits": segment(h, c).tobytes(), "levels": np.bincount(level(c), minlength=LEVELS + 1).tolist()}
                yield pa.RecordBatch.from_pylist([row | exact | _repeats(h, c)], schema=schema)

        for batch in batches:
            for n, s, size, hs, cs in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if (n, s) != key:
                    yield from done()
                    key, hashes, counts = (n, s), [], []
                hashes.append(_unpack_hashes(hs, size))
                counts.append(np.frombuffer(pa.decompress(cs, 8 * size, "zstd", asbytes=True), "<i8"))
                if len(hashes) > 1 and sum(len(h) for h in hashes) > 2 * HELD + 2 * len(hashes[0]):
                    hashes, counts = ([x] for x in _merged(hashes, counts))
        yield from done()

    return common.map_arrow(partial.repartition("n", "slice").sortWithinPartitions("n", "slice"), run, SLICE)


class Model:
    """A trained model: the written slices, packs of broadcast filter segments, and the size of the training text."""

    def __init__(self, slices: DataFrame, texts: int, order: int, slice_bits: int, pack_bytes: int = PACK_BYTES, frequent: int = FREQUENT):
        self.slices, self.order, self.slice_bits, self.texts = slices, order, slice_bits, texts
        spark = slices.sparkSession
        sizes = slices.select("n", "slice", F.octet_length("bits").alias("size"), "items", "tokens").sort("n", "slice").collect()  # a small row for each slice
        self.n_tokens = sum(r["tokens"] for r in sizes if r["n"] == 1)
        self.n_types = sum(r["items"] for r in sizes if r["n"] == 1)
        self.floor = self.n_tokens + ALPHA * (self.n_types + 1)
        self.size = np.zeros((order, 1 << slice_bits), np.int64)
        self.start = np.zeros((order, 1 << slice_bits), np.int64)
        self.pack = np.full((order, 1 << slice_bits), -1, np.int64)
        self.packs, held, total = [], [], 0
        for r in [*sizes, None]:
            if r is None or (held and total + r["size"] > pack_bytes):
                if held:
                    self.packs.append(self._broadcast(spark, held))
                held, total = [], 0
            if r is not None:
                at = (r["n"] - 1, r["slice"])
                self.size[at], self.start[at], self.pack[at] = r["size"] * 8, total * 8, len(self.packs)
                held.append(r)
                total += r["size"]
        self.exact = self._frequent(spark, frequent)
        self.weight = self._weights()

    def _broadcast(self, spark: object, rows: list) -> object:
        """The segments of ``rows``, which are next to each other in order, as one broadcast; the driver gets a few megabytes of them at a time."""
        out, at, begin = np.zeros(sum(r["size"] for r in rows), np.uint8), 0, 0
        key, lit = F.struct("n", "slice"), lambda r: F.struct(F.lit(r["n"]).alias("n"), F.lit(r["slice"]).alias("slice"))
        for i, r in enumerate(rows):
            if i + 1 < len(rows) and sum(x["size"] for x in rows[begin : i + 1]) < SENT_BYTES:
                continue
            cells = self.slices.filter((key >= lit(rows[begin])) & (key <= lit(r))).select("n", "slice", "bits").collect()
            for cell in sorted(cells, key=lambda c: (c["n"], c["slice"])):
                out[at : at + len(cell["bits"])] = np.frombuffer(cell["bits"], np.uint8)
                at += len(cell["bits"])
            begin = i + 1
        sent = spark.sparkContext.broadcast(out)
        _forget(sent)
        del out, cells
        common.release()
        return sent

    def _frequent(self, spark: object, most: int) -> object:
        """Broadcast (hashes in order, counts) of all tokens from the least level on that leaves at most ``most`` of them."""
        per = {r["q"]: r["n"] for r in self.slices.filter("n = 1").select(F.posexplode("levels").alias("q", "c")).groupBy("q").agg(F.sum("c").alias("n")).collect()}
        left, self.least = 0, LEVELS + 1
        for q in range(LEVELS, 0, -1):
            left += per.get(q, 0)
            if left > most:
                break
            self.least = q
        self.rare = sum(n for q, n in per.items() if 0 < q < self.least) > 0
        bound = math.ceil(BASE ** (self.least - 1) - 1e-6)
        self.bound = bound
        cells = self.tokens().filter(F.col("c") >= F.lit(float(bound))).select("h", "c").toArrow() if self.n_types else None
        h = cells["h"].to_numpy().view(np.uint64) if cells is not None else np.zeros(0, np.uint64)
        c = cells["c"].to_numpy() if cells is not None else np.zeros(0, np.int64)
        at = np.argsort(h)
        sent = spark.sparkContext.broadcast((h[at], c[at]))
        del cells, h, c, at
        _forget(sent)
        common.release()
        return sent

    def close(self) -> None:
        """Gives up the broadcasts. What ``score`` gave before needs them no more."""
        for held in (*self.packs, self.exact):
            held.destroy()

    def _weights(self) -> np.ndarray:
        """Of each n-gram length and level of a history's count, the weight of that history's own counts.

        It is how often, over all training text, a token that follows such a history follows the same one elsewhere. Of a
        history that occurs once that can't be told; with counts weighing c / (c + k), one weighs w / (2 - w) where two
        weigh w.
        """
        sums = np.zeros((2, self.order + 1, LEVELS + 1))
        for i, name in enumerate(("mass", "again")):
            for r in self.slices.select("n", F.posexplode(name).alias("q", "c")).groupBy("n", "q").agg(F.sum("c").alias("c")).collect():
                sums[i, r["n"], r["q"]] = r["c"]
        out = np.minimum(sums[1] / (sums[0] + 1), MOST)
        out[:, 1] = out[:, 2] / (2 - out[:, 2])
        return out

    def tokens(self) -> DataFrame:
        """(h, c): every distinct token's hash and exact count."""
        return self.slices.filter("n = 1").select(F.explode(F.arrays_zip("hashes", "counts")).alias("x")).select(F.col("x.hashes").alias("h"), F.col("x.counts").alias("c"))


def train(df: DataFrame, *, scratch: Scratch, order: int = ORDER, id_col: str = "doc_id", text_col: str = "text", folds: int = FOLDS, pack_bytes: int = PACK_BYTES, frequent: int = FREQUENT) -> Model:
    """A model of all whole texts that aren't held out; null is an empty text, which has its end only.

    There are as many slices as shuffle partitions, rounded up to a power of two.
    """
    texts = df.filter(~held_out(id_col, folds)).select(F.col(text_col).alias("text"))
    slice_bits = max(0, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length()
    slices = scratch.keep(_slices(_partial_counts(texts, order, slice_bits)), "slices")
    return Model(slices, texts.count(), order, slice_bits, pack_bytes, frequent)


def _forget(packs: object) -> None:
    """Drops this process's copy of a broadcast value; its file stays and is read again when the value is asked for."""
    if hasattr(packs, "_value"):
        del packs._value


class _Scorer:
    """What a task needs to score texts. Of the filter one pack is in memory at a time."""

    def __init__(self, model: Model):
        self.size, self.start, self.pack = model.size, model.start, model.pack
        self.packs, self.exact, self.slice_bits = model.packs, model.exact, model.slice_bits
        self.order, self.texts, self.floor, self.weight, self.now = model.order, model.texts, model.floor, model.weight, None
        self.counts = expected()

    def _bits(self, p: int) -> np.ndarray:
        if self.now not in (None, p):
            _forget(self.packs[self.now])
        self.now = p
        return self.packs[p].value

    def _levels(self, n: int, hashes: np.ndarray) -> np.ndarray:
        """Of each n-gram of length n, the last level that the filter has after all those before; 0 without the first."""
        out = np.zeros(len(hashes), np.int64)
        own = (hashes >> U(64 - self.slice_bits)).astype(np.int64) if self.slice_bits else np.zeros(len(hashes), np.int64)
        pack = self.pack[n - 1][own]
        for p in np.unique(pack[pack >= 0]).tolist():
            bits, at = self._bits(p), np.flatnonzero(pack == p)
            for j in range(1, LEVELS + 1):
                x, step = _seeds(hashes[at], j)
                size, start = self.size[n - 1][own[at]].astype(np.uint64), self.start[n - 1][own[at]]
                left = np.arange(len(at))
                for i in range(HASHES):
                    pos = ((x[left] + U(i) * step[left]) % size[left]).astype(np.int64) + start[left]
                    left = left[(bits[pos >> 3] >> (pos & 7).astype(np.uint8)) & 1 > 0]
                at = at[left]
                out[at] = j
                if not len(at):
                    break
        return out

    def score(self, parts: list[np.ndarray]) -> dict[str, np.ndarray]:
        """Numbers of the texts whose token hashes ``parts`` has; rare tokens as (text, hash, times)."""
        ends, starts = grams(parts, self.order), np.concatenate([[0], np.cumsum([len(p) for p in parts])[:-1]]).astype(np.int64)
        single, inverse = np.unique(ends[0], return_inverse=True)
        levels = self._levels(1, single)
        seen = levels[inverse]
        prob = (self.counts[seen] + ALPHA) / self.floor
        for n in range(2, self.order + 1):
            history = np.concatenate([[0], seen[:-1]])
            history[starts] = level(self.texts)  # a start comes before every text
            # an n-gram occurs only where its last n - 1 tokens and its history do
            at = np.flatnonzero((seen > 0) & (history > 0))
            some, back = np.unique(ends[n - 1][at], return_inverse=True)
            seen = np.zeros(len(seen), np.int64)
            seen[at] = self._levels(n, some)[back]
            own = np.minimum(self.counts[seen] / np.maximum(self.counts[history], 1), 1)
            prob = self.weight[n][history] * own + (1 - self.weight[n][history]) * prob
        known, exact = self.exact.value
        at = np.minimum(np.searchsorted(known, single), max(len(known) - 1, 0))
        often = known[at] == single if len(known) else np.zeros(len(single), bool)
        count = np.where(often, exact[at] if len(known) else 0, 0)
        base = np.log10((count + ALPHA) / self.floor)
        # the filter never loses a token: one without a level wasn't learned from
        rare = np.flatnonzero((~often & (levels > 0))[inverse])
        doc = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
        pairs, times = np.unique(doc[rare] * len(single) + inverse[rare], return_counts=True)
        return {
            "n_tokens": np.array([len(p) for p in parts], np.int64),
            "n_known": np.add.reduceat(often[inverse].astype(np.int64), starts),
            "base_score": np.add.reduceat(base[inverse], starts),
            "score": np.add.reduceat(np.log10(prob), starts),
            "rare_of": pairs // len(single),
            "rare": single[pairs % len(single)].view(np.int64),
            "times": times,
        }


def score(df: DataFrame, model: Model, *, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", folds: int = FOLDS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row of ``df``.

    ``score`` is the log10 probability of the text: from single tokens up, an n-gram's part of its history's count, both
    as the filter has them, is mixed with the probability under the history one shorter. ``base_score`` and ``n_known``
    are exact: frequent tokens' counts are broadcast, the few others of a document meet theirs in a join.

    * Null and empty texts are their end alone; rows with equal or null ids are scored one by one, null ids aren't held out;
    * an empty ``df`` gives no rows; a model of no text gives every token the same probability;
    * other columns aren't read. A text of 1 GB takes some 10 GB of a worker, as its tokens' numbers lie side by side.

    Tokens are told apart by 64-bit hashes, tokens after one history by 24 bits. The join leans on spark.sql.adaptive.skewJoin only where a token that is rare
    in the training texts is frequent in the others.
    """
    rows = df.select(F.col(id_col).alias("doc_id"), held_out(id_col, folds).alias("held_out"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    # each batch reads every pack again, so batches grow with them as far as a worker's memory goes
    most = BATCH_WORDS // 2 * max(1, min(MOST_BATCHES, len(model.packs) // 16))
    parts_of = _Parts(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer, held, total = _Scorer(parts_of), [], 0

        def scores() -> pa.RecordBatch:
            got = scorer.score([x for _, _, parts in held for x in parts])
            cuts = np.searchsorted(got["rare_of"], np.arange(len(got["n_tokens"]) + 1))
            lists = [pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(got[c], pa.int64())) for c in ("rare", "times")]
            cols = [pa.concat_arrays([h[i] for h in held]) for i in (0, 1)] + [pa.array(got[c]) for c in ("n_tokens", "n_known", "base_score", "score")]
            return pa.RecordBatch.from_arrays([*cols, *lists], names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "rare", "times"])

        for batch in batches:
            for first, end, parts in word_batches(batch.column(2), token_hashes):
                held.append((*(batch.column(i).slice(first, end - first) for i in (0, 1)), parts))
                total += sum(map(len, parts))
                if total >= most:
                    yield scores()
                    held, total = [], 0
        if held:
            yield scores()

    scored = common.map_arrow(rows, run, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double, rare array<bigint>, times array<bigint>")
    scored = scratch.keep(scored.withColumn("row", F.monotonically_increasing_id()), "scored")  # from here on without the model
    own = ["doc_id", "held_out", "n_tokens"]
    if model.rare:
        # a rare token counts as unseen above; what its count adds to that
        tokens = model.tokens().filter(F.col("c") < F.lit(model.bound)).select("h", (F.log10((F.col("c") + ALPHA) / F.lit(ALPHA))).alias("more"))
        uses = scored.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row", F.col("x.rare").alias("h"), F.col("x.times").alias("times"))
        found = uses.join(tokens, "h").groupBy("row").agg(F.sum("times").alias("known"), F.sum(F.col("times") * F.col("more")).alias("more"))
        scored = scored.drop("rare", "times").join(found, "row", "left").withColumn("n_known", F.col("n_known") + F.coalesce("known", F.lit(0))).withColumn("base_score", F.col("base_score") + F.coalesce("more", F.lit(0.0)))
    return scored.select(*own, "n_known", F.lit(model.n_tokens).cast("long").alias("train_tokens"), "base_score", "score")


class _Parts:
    """What of a model goes to the executors."""

    def __init__(self, model: Model):
        for name in ("size", "start", "pack", "packs", "exact", "slice_bits", "order", "texts", "floor", "weight"):
            setattr(self, name, getattr(model, name))
