"""Benchmark decontamination over a stored positional inverted index of the corpus, one written row for each block.

``build_index`` writes, for each block of documents, every token with its posting list: the positions it has in the
block, whose documents lie end to end. A search reads that table and not the texts: a window of consecutive tokens is
found by intersecting posting lists, shifted by the tokens' offsets, from the rarest token on. A block's row holds all
its lists, so neither building nor searching shuffles anything, and one index serves any number of benchmarks.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, joined, map_arrow, map_batches

#: Fixed value: ASCII that is no word character after lower-casing: \x00-\x2F, \x3A-\x60 and \x7B-\x7F.
SEPARATORS = bytes([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])
_TO_SPACE = bytes.maketrans(SEPARATORS, b" " * len(SEPARATORS))
WINDOW = 10
#: A block ends with the document that brings it to either size, so only one very long document makes it larger. Cells
#: stay well below a megabyte, so that executors hold and write them as small objects.
BLOCK_ROWS, BLOCK_BYTES = 1024, 1 << 20
#: Words of a benchmark that one pass over the index takes; a larger one is searched in several passes.
PASS_WORDS = 2_000_000
#: A row of the index: its documents (id, number of words), its tokens with a space between, for each the number
#: of its positions, and all positions in the order of tokens, as differences in byte planes. Tokens, numbers and positions
#: are compressed.
INDEX = "block long, docs array<bigint>, lengths binary, terms binary, counts binary, positions binary"


def words(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z) maximal runs of 0-9, a-z and characters beyond ASCII, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").lower().translate(_TO_SPACE).split() if text else []


def _pack(values: np.ndarray) -> bytes:
    """int32 values as differences, all first bytes, then all second ones and so on, which compress well."""
    return _squeeze(np.diff(values, prepend=np.int32(0)).astype("<i4").view(np.uint8).reshape(-1, 4).T.tobytes())


def _unpack(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(_spread(raw), np.uint8).reshape(4, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<i4").ravel(), dtype=np.int64)


def _squeeze(raw: bytes) -> bytes:
    """Compressed, after the length as eight little-endian bytes."""
    return len(raw).to_bytes(8, "little") + (pa.compress(raw, "zstd", asbytes=True) if raw else b"")


def _spread(cell: bytes) -> bytes:
    size = int.from_bytes(cell[:8], "little")
    return pa.decompress(cell[8:], size, "zstd", asbytes=True) if size else b""


def _cuts(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """(start, end) of the blocks of a batch."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    begin = held = 0
    for i, size in enumerate(sizes.tolist()):
        held += size
        if held >= BLOCK_BYTES or i + 1 - begin == BLOCK_ROWS:
            yield begin, i + 1
            begin, held = i + 1, 0
    if begin < len(sizes):
        yield begin, len(sizes)


def _postings(texts: list[str | None]) -> tuple[np.ndarray, list[bytes], np.ndarray, np.ndarray]:
    """Number of words of each document, distinct terms, number of positions of each, and positions term by term."""
    ids: defaultdict[bytes, int] = defaultdict()
    ids.default_factory = ids.__len__
    parts = []
    for text in texts:
        tokens = words(text)
        parts.append(np.fromiter(map(ids.__getitem__, tokens), np.int32, len(tokens)))
    stream = np.concatenate(parts) if parts else np.zeros(0, np.int32)
    return np.array([len(p) for p in parts], np.int64), list(ids), np.bincount(stream, minlength=len(ids)), np.argsort(stream, kind="stable")


def build_index(df: DataFrame, scratch: Scratch, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The written index of all rows (columns ``INDEX``); it goes when the interpreter ends.

    All tokens of whole texts are in it. Null and empty texts are documents without words; rows with equal or null ids
    are documents of their own; an empty table gives an empty index. Other columns aren't read.
    """
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def start():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch | None:
            out = []
            for begin, end in _cuts(batch.column(1)):
                ids = batch.column(0).slice(begin, end - begin)
                docs = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
                lengths, terms, counts, positions = _postings(batch.column(1).slice(begin, end - begin).to_pylist())
                cells = [lengths.astype("<i8").tobytes(), _squeeze(b" ".join(terms)), _squeeze(counts.astype("<i4").tobytes()), _pack(positions.astype(np.int32))]
                out.append(pa.RecordBatch.from_arrays([pa.array([0], pa.int64()), docs, *(pa.array([x], pa.binary()) for x in cells)], names=["block", "docs", "lengths", "terms", "counts", "positions"]))
            return joined(out)

        return step

    # a block's number is fixed when the table is written, not when it is read
    return scratch.keep(map_batches(rows, start, INDEX).withColumn("block", F.monotonically_increasing_id()), "index")


class Windows:
    """The distinct windows of benchmark items, with the items that hold each."""

    def __init__(self, items: list[tuple[object, list[bytes]]], size: int = WINDOW):
        self.terms: dict[bytes, int] = {}
        self.items: list[object] = []
        found: dict[tuple[int, ...], list[int]] = {}
        for item, tokens in items:
            if not tokens:
                continue
            self.items.append(item)
            ids = [self.terms.setdefault(w, len(self.terms)) for w in tokens]
            width = min(size, len(ids))
            for i in range(len(ids) - width + 1):
                held = found.setdefault(tuple(ids[i : i + width]), [])
                if not held or held[-1] != len(self.items) - 1:
                    held.append(len(self.items) - 1)
        self.windows, self.holders = list(found), list(found.values())
        self.widths: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for width in {len(w) for w in self.windows}:
            own = [k for k, w in enumerate(self.windows) if len(w) == width]
            self.widths[width] = np.array(own), np.array([self.windows[k] for k in own], np.int32)

    def within(self, present: np.ndarray) -> Iterator[int]:
        """The windows all of whose terms are present."""
        for own, terms in self.widths.values():
            yield from own[present[terms].all(axis=1)].tolist()


class Block:
    """The posting lists of one block for the terms that a search asks for."""

    def __init__(self, lengths: np.ndarray, terms: list[bytes], counts: np.ndarray, positions: Callable[[], np.ndarray], asked: dict[bytes, int]):
        self.lengths = lengths
        self.ends = np.cumsum(self.lengths)
        self.starts = self.ends - self.lengths
        self.size = int(self.ends[-1]) if len(self.ends) else 0
        bounds = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
        slots = np.fromiter((asked.get(t, -1) for t in terms), np.int64, len(terms))
        held = np.flatnonzero(slots >= 0)
        self.begin, self.end = np.zeros(len(asked), np.int64), np.zeros(len(asked), np.int64)
        self.begin[slots[held]], self.end[slots[held]] = bounds[held], bounds[held + 1]
        self.positions = positions() if len(held) else np.zeros(0, np.int64)

    @classmethod
    def stored(cls, lengths: bytes, terms: bytes, counts: bytes, positions: bytes, asked: dict[bytes, int]) -> Block:
        """The block of a row of the index."""
        return cls(np.frombuffer(lengths, "<i8"), _spread(terms).split(), np.frombuffer(_spread(counts), "<i4"), lambda: _unpack(positions), asked)

    @classmethod
    def of(cls, texts: list[str | None], asked: dict[bytes, int]) -> Block:
        """The block of texts that are at hand."""
        lengths, terms, counts, positions = _postings(texts)
        return cls(lengths, terms, counts, lambda: positions, asked)

    def list(self, term: int) -> np.ndarray:
        return self.positions[self.begin[term] : self.end[term]]

    def present(self) -> np.ndarray:
        return self.end > self.begin

    def document(self, at: np.ndarray) -> np.ndarray:
        """The document of each position; those without words have none."""
        return np.searchsorted(self.ends, at, side="right")

    def _rarest_first(self, terms: tuple[int, ...]) -> list[int]:
        return sorted(range(len(terms)), key=lambda j: self.end[terms[j]] - self.begin[terms[j]])

    def phrase(self, window: tuple[int, ...]) -> np.ndarray:
        """Start positions of the exact phrase inside one document: the rarest token's list, narrowed by each other's."""
        order = self._rarest_first(window)
        at = self.list(window[order[0]]) - order[0]
        at = at[(at >= 0) & (at + len(window) <= self.size)]
        for j in order[1:]:
            if not len(at):
                return at
            other = self.list(window[j])
            if not len(other):
                return at[:0]
            at = at[other[np.minimum(np.searchsorted(other, at + j), len(other) - 1)] == at + j]
        return at[at + len(window) <= self.ends[self.document(at)]]

    def near(self, terms: tuple[int, ...], span: int) -> np.ndarray:
        """Positions of the rarest term that have every other term at most ``span`` tokens away in their document."""
        order = self._rarest_first(terms)
        at = self.list(terms[order[0]])
        for j in order[1:]:
            doc, other = self.document(at), self.list(terms[j])
            low, high = np.maximum(at - span, self.starts[doc]), np.minimum(at + span, self.ends[doc] - 1)
            at = at[np.searchsorted(other, low, side="left") < np.searchsorted(other, high, side="right")]
        return at


def _search(index: DataFrame, terms: dict[bytes, int], match: Callable[[Block, int, pa.Array], pa.RecordBatch], schema: str) -> DataFrame:
    """The rows that ``match`` gives for each block, its number and its documents."""

    def start():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch | None:
            out = []
            for i in range(batch.num_rows):
                number, docs, *cells = (batch.column(c)[i] for c in range(6))
                out.append(match(Block.stored(*(x.as_py() for x in cells), terms), number.as_py(), docs.values))
            return joined(out)

        return step

    return map_batches(index, start, schema)


def _marked(windows: Windows, block: Block) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(window, start positions, their documents) for the windows that occur in a block."""
    for k in windows.within(block.present()):
        at = block.phrase(windows.windows[k])
        if len(at):
            yield k, at, block.document(at)


def find_windows(index: DataFrame, windows: Windows) -> DataFrame:
    """(block, at, doc_id, n_words, hits binary of int64 word positions, items array<string>) of every indexed row.

    ``at`` is the row's place in its block. Rows are not joined or aggregated by id, so rows with equal or null ids
    stay apart. Null and empty texts have no words and no hits.
    """
    holders, names = windows.holders, [str(i) for i in windows.items]

    def match(block: Block, number: int, docs: pa.Array) -> pa.RecordBatch:
        n = len(block.lengths)
        marks = np.zeros(block.size + 1, np.int32)
        held: list[set[str]] = [set() for _ in range(n)]
        for k, at, doc in _marked(windows, block):
            np.add.at(marks, at, 1)
            np.add.at(marks, at + len(windows.windows[k]), -1)
            for d in np.unique(doc).tolist():
                held[d].update(names[i] for i in holders[k])
        inside = np.flatnonzero(np.cumsum(marks[:-1]) > 0)
        lo, hi = np.searchsorted(inside, block.starts), np.searchsorted(inside, block.ends)
        hits = [(inside[a:b] - s).astype("<i8").tobytes() for a, b, s in zip(lo, hi, block.starts, strict=True)]
        columns = [pa.array([number] * n, pa.int64()), pa.array(np.arange(n)), docs, pa.array(block.lengths), pa.array(hits, pa.binary()), pa.array([sorted(h) for h in held], pa.list_(pa.string()))]
        return pa.RecordBatch.from_arrays(columns, names=["block", "at", "doc_id", "n_words", "hits", "items"])

    return _search(index, windows.terms, match, "block long, at long, doc_id long, n_words long, hits binary, items array<string>")


def _places(index: DataFrame, queries: list[tuple[object, str]], find: Callable[[Block, tuple[int, ...]], np.ndarray]) -> DataFrame:
    terms: dict[bytes, int] = {}
    asked = [(str(q), tuple(terms.setdefault(w, len(terms)) for w in words(text))) for q, text in queries if words(text)]

    def match(block: Block, number: int, docs: pa.Array) -> pa.RecordBatch:
        ids, names, places = [], [], []
        present = block.present()
        for name, wanted in asked:
            if not present[list(wanted)].all():
                continue
            at = find(block, wanted)
            doc = block.document(at)
            ids += doc.tolist()
            places += (at - block.starts[doc]).tolist()
            names += [name] * len(at)
        return pa.RecordBatch.from_arrays([docs.take(pa.array(ids, pa.int64())), pa.array(names, pa.string()), pa.array(places, pa.int64())], names=["doc_id", "query", "position"])

    return _search(index, terms, match, "doc_id long, query string, position long")


def phrase_matches(index: DataFrame, queries: list[tuple[object, str]]) -> DataFrame:
    """Exact phrases of any length: (doc_id, query string, position of the first word) of every occurrence.

    Queries without words match nothing.
    """
    return _places(index, queries, Block.phrase)


def near_matches(df: DataFrame, queries: list[tuple[object, str]], span: int, id_col: str = "doc_id", text_col: str = "text", *, index: DataFrame | None = None) -> DataFrame:
    """Proximity search: (doc_id, query string, position) where all words of a query lie within ``span`` of its rarest.

    Searches ``index`` if it is given, or one that is built of ``df``. Queries without words match nothing.
    """
    index = index or build_index(df, Scratch(df.sparkSession), id_col=id_col, text_col=text_col)
    return _places(index, queries, lambda block, terms: block.near(terms, span))


def passes(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", most: int = PASS_WORDS) -> list[Windows]:
    """The benchmark as window sets of about ``most`` words each: the size of what a task is sent is bounded by it."""
    out, items, size = [], [], 0
    for row in benchmark.select(item_col, text_col).toLocalIterator():
        tokens = words(row[1])
        items.append((row[0], tokens))
        size += len(tokens)
        if size >= most:
            out.append(Windows(items))
            items, size = [], 0
    return [*out, Windows(items)] if items or not out else out


def contamination(df: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", index: DataFrame | None = None) -> DataFrame:
    """Per row of ``df``: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    n_hit counts words inside any occurrence of a benchmark window (WINDOW consecutive words of an item; all words of
    a shorter one). Items with the same text all count, an item id counts once; null or empty items occur nowhere; with
    an empty benchmark no row is contaminated. Rows keep apart even with equal or null ids: several passes meet by a
    row's block and place in the index. ``index`` is one that ``build_index`` made of ``df``; without it one is built.
    """
    sets = passes(benchmark, item_col, item_text_col)
    index = index or build_index(df, Scratch(df.sparkSession), id_col=id_col, text_col=text_col)
    found = find_windows(index, sets[0])
    for w in sets[1:]:
        found = found.unionByName(find_windows(index, w).filter(F.length("hits") > 0))
    if len(sets) > 1:  # every row once from the first pass, and from others where they hit; hits may overlap
        found = found.groupBy("block", "at", "doc_id", "n_words").agg(F.collect_list("hits").alias("hits"), F.flatten(F.collect_list("items")).alias("items"))
    else:
        found = found.withColumn("hits", F.array("hits"))

    def start():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            n_hit, n_items, digests = [], [], []
            for hits, items in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                n_hit.append(len(hits[0]) // 8 if len(hits) == 1 else len(np.unique(np.frombuffer(b"".join(hits), "<i8"))))
                held = sorted(set(items))
                n_items.append(len(held))
                digests.append(hashlib.sha256(",".join(held).encode()).hexdigest())
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n_hit, pa.int64()), pa.array(n_items, pa.int64()), pa.array(digests), pa.array([h > 0 for h in n_hit])], names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])

        return step

    return map_batches(found.select("doc_id", "n_words", "hits", "items"), start, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")


def drop_contaminated(df: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of ``df`` without any benchmark window, with all their columns, whatever their names.

    As each text is read once, a block's posting lists are searched where they are built and not written: rows are
    filtered where they are, without an index table, a join or a shuffle. Null and empty texts stay.
    """
    at = df.columns.index(text_col)
    for w in passes(benchmark, item_col, item_text_col):

        def run(batches: Iterator[pa.RecordBatch], w: Windows = w) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for begin, end in _cuts(batch.column(at)):
                    part = batch.slice(begin, end - begin)
                    block = Block.of(part.column(at).to_pylist(), w.terms)
                    hit = np.zeros(part.num_rows, bool)
                    for _, _, docs in _marked(w, block):
                        hit[docs] = True
                    yield part.filter(pa.array(~hit))

        df = map_arrow(df, run, df.schema)
    return df
