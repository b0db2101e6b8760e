"""Packing token pieces into fixed-length sequences: first-fit decreasing over a tournament tree of bin capacities."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, mix64

#: Units that an encoder knows at most, about: beyond it it starts anew. Texts are cut together in blocks of about
#: BLOCK_BYTES bytes.
CACHE, BLOCK_BYTES = 300_000, 1 << 18
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, copy long"
# What the tokenizer's pattern tells apart, as classes of bytes.
SPACE, LETTER, DIGIT, SIGN, ODD = range(5)


def _classes() -> np.ndarray:
    """The class of each byte: white space, letters (with the bytes of U+00C0 to U+024F), digits, signs, and others."""
    table = np.full(256, ODD, np.uint8)
    table[0x21:0x7F] = SIGN
    table[[0x09, 0x0A, 0x0D, 0x20]] = SPACE
    table[0x30:0x3A] = DIGIT
    table[0x41:0x5B] = table[0x61:0x7B] = table[0x80:0xC0] = table[0xC3:0xCA] = LETTER
    table[0x27] = ODD  # an apostrophe may begin a piece with the letters after it
    return table


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one after the other."""
    ends = np.cumsum(lengths)
    out = np.arange(ends[-1] if len(ends) else 0)
    return out + np.repeat(starts - (ends - lengths), lengths)


class Encoder:
    """Token ids of texts, as arrays of little-endian uint32.

    White space ends every piece of the tokenizer's pre-tokenizer and is dropped, so the ids of a text are those of its
    words one after the other. A word of ASCII letters, digits and signs and of Latin letters is cut into units here as
    the tokenizer's pattern does: runs of letters, single digits, runs of signs. Any other word is one unit, and goes
    through the whole tokenizer by itself. Units are told apart by 128-bit hashes, so each is tokenized once while it
    is known, and no Python object is made for one that is.
    """

    def __init__(self, path: str | None, cache: int = CACHE, *, text: str | None = None):
        import json

        from tokenizers import Tokenizer

        spec = json.loads(text if text is not None else file_text(path))
        self.tokenizer, self.size = Tokenizer.from_str(json.dumps(spec)), cache
        split, byte_level = (spec["pre_tokenizer"] or {}).get("pretokenizers", [{}, {}])[:2]
        end = spec["model"].get("end_of_word_suffix")
        self.by_pieces = bool(end) and [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])] == ["NFC", "Replace", "Lowercase"] and split.get("behavior") == "Removed" and byte_level.get("type") == "ByteLevel"
        self.ends = np.zeros(max(spec["model"]["vocab"].values()) + 1, bool)
        for token, i in spec["model"]["vocab"].items():
            self.ends[i] = bool(end) and token.endswith(end)
        self.classes, self.tables = _classes(), [mix64(np.arange(256, dtype=np.uint64) + np.uint64(k)) for k in (1, 1000)]
        self.up = self.down = np.zeros(0, np.uint64)
        self._forget()

    def _forget(self) -> None:
        self.known, self.check, self.number = (np.zeros(0, t) for t in (np.uint64, np.uint64, np.int64))
        self.ids, self.first, self.count = np.zeros(0, "<u4"), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _units(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(begin, end, odd) of all units. odd: the whole word goes through the tokenizer."""
        n = len(data)
        kind = self.classes[data]
        # Bytes of characters that are no plain letter: the multiplication and division signs and the dotted I, and
        # C3 to C9 without exactly one continuation byte cannot come from a cut text.
        pair = data[:-1].astype(np.uint16) << 8 | data[1:]
        for sign in (0xC397, 0xC3B7, 0xC4B0, 0x3C7C):  # the last: "<|", as in special tokens
            kind[np.flatnonzero(pair == sign)] = ODD
        cut = np.zeros(n + 1, bool)
        cut[offsets] = True
        ink = kind != SPACE
        begin = ink.copy()
        begin[1:] &= ~ink[:-1] | cut[1:n]
        words = np.flatnonzero(begin)
        end = ink.copy()
        end[:-1] &= ~ink[1:] | cut[1:n]
        ends = np.flatnonzero(end) + 1
        bad = np.concatenate([[0], np.cumsum(kind == ODD)])
        bad = bad[ends] > bad[words] if self.by_pieces else np.ones(len(words), bool)
        if bad.any():  # as if such a word were one run
            kind[_ranges(words[bad], (ends - words)[bad])] = ODD
        step = ink.copy()
        step[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT) | cut[1:n]
        at = np.flatnonzero(step)
        stop = np.append(at[1:], n)
        stop = np.minimum(stop, ends[np.searchsorted(words, at, side="right") - 1])
        return at, stop, kind[at] == ODD

    def _learn(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray, odd: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, count of each) of new units."""
        raw = data.tobytes()
        texts = [raw[a:b].decode("utf-8", "surrogatepass") for a, b in zip(begin.tolist(), end.tolist(), strict=True)]
        plain = np.flatnonzero(~odd)
        ids = np.zeros(0, "<u4")
        if len(plain):
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join([texts[i] for i in plain.tolist()])], add_special_tokens=False)[0].ids, dtype="<u4")
        after = np.concatenate([[0], np.flatnonzero(self.ends[ids]) + 1])
        if len(after) != len(plain) + 1:
            raise _Apart  # the tokenizer cuts words in another way
        count = np.zeros(len(texts), np.int64)
        count[plain] = np.diff(after)
        if odd.any():
            whole = [np.array(x.ids, dtype="<u4") for x in self.tokenizer.encode_batch_fast([texts[i] for i in np.flatnonzero(odd).tolist()], add_special_tokens=False)]
            count[odd] = [len(x) for x in whole]
            first = np.cumsum(count) - count
            out = np.zeros(int(count.sum()), "<u4")
            out[_ranges(first[plain], count[plain])] = ids
            out[_ranges(first[odd], count[odd])] = np.concatenate(whole)
            return out, count
        return ids, count

    def __call__(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text; of a null one none."""
        texts = texts.cast(pa.large_binary())
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
        at = 0
        while at < len(texts):
            to = max(at + 1, int(np.searchsorted(offsets[1:], offsets[at] + BLOCK_BYTES, side="right")))
            block, own = data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
            try:
                ids = self._block(block, own)
            except _Apart:  # these texts go through the tokenizer whole
                ids = [np.array(self.tokenizer.encode(block[a:b].tobytes().decode("utf-8", "surrogatepass"), add_special_tokens=False).ids, dtype="<u4") for a, b in zip(own[:-1].tolist(), own[1:].tolist(), strict=True)]
                self._forget()
            yield from ids
            at = to

    def _hashes(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(data)
        if n > len(self.up):
            size = max(2 * BLOCK_BYTES, 2 * n) if n > BLOCK_BYTES else 2 * BLOCK_BYTES
            self.up, self.down = (np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size - 1, np.uint64(x)))]) for x in (MULTIPLIER, pow(MULTIPLIER, -1, 1 << 64)))
        out = []
        for table in self.tables:
            sums = np.zeros(n + 1, np.uint64)
            np.cumsum(table[data] * self.up[:n], out=sums[1:])
            out.append(mix64((sums[end] - sums[begin]) * self.down[begin] + (end - begin).astype(np.uint64)))
        return out[0], out[1]

    def _block(self, data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        if not len(data):
            return [np.zeros(0, "<u4")] * (len(offsets) - 1)
        begin, end, odd = self._units(data, offsets)
        key, check = self._hashes(data, begin, end)
        distinct, first, which = np.unique(key, return_index=True, return_inverse=True)
        at = np.searchsorted(self.known, distinct)
        there = at < len(self.known)
        there[there] = self.known[at[there]] == distinct[there]
        new = np.flatnonzero(~there)
        number = np.zeros(len(distinct), np.int64)
        number[there] = self.number[at[there]]
        if len(new):
            ids, count = self._learn(data, begin[first[new]], end[first[new]], odd[first[new]])
            number[new] = len(self.count) + np.arange(len(new))
            self.first = np.concatenate([self.first, len(self.ids) + np.cumsum(count) - count])
            self.ids, self.count, self.check = (np.concatenate(x) for x in ((self.ids, ids), (self.count, count), (self.check, check[first[new]])))
            self.known, self.number = np.insert(self.known, at[new], distinct[new]), np.insert(self.number, at[new], number[new])
        unit = number[which]
        if (self.check[unit] != check).any():
            raise _Apart  # two units have one hash
        count = self.count[unit]
        total = np.concatenate([[0], np.cumsum(count)])
        ids = self.ids[_ranges(self.first[unit], count)]
        bounds = total[np.searchsorted(begin, offsets)].tolist()
        if len(self.known) > self.size:
            self._forget()
        return [ids[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]


class _Apart(Exception):
    """A block's units can't be told apart or cut as the tokenizer does."""


def file_text(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


#: Fixed value: the multiplier of the byte polynomial, odd and so invertible modulo 2**64.
MULTIPLIER = 0xD1342543DE82EF95
#: One encoder for a Python worker, which reads a tokenizer once and not once a task.
_ENCODER: dict[int, Encoder] = {}


def encoder(text: str) -> Encoder:
    """The encoder of a tokenizer's JSON."""
    key = zlib.crc32(text.encode())
    if key not in _ENCODER:
        _ENCODER.clear()
        _ENCODER[key] = Encoder(None, text=text)
    return _ENCODER[key]


def token_pieces(df: DataFrame, tokenizer_path: str, *, capacity: int, end_id: int, parts: int, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Each document's ids and the end id, cut every ``capacity`` ids: a row for each piece.

    ``part`` is the randomised group that packs the piece, drawn from the piece's own values, so a task that runs again
    sends it to the same group. Pieces alike in all values are counted, before they shuffle within each task, and drawn
    by their number too: they spread over the groups however many they are. Null text is empty: one piece with the end
    id alone. ``with_ids`` adds the ids. The driver reads the tokenizer's file and broadcasts its few megabytes.
    """
    spec = df.sparkSession.sparkContext.broadcast(file_text(tokenizer_path))

    def start():
        encode = encoder(spec.value)
        end = np.array([end_id], dtype="<u4")
        seen: dict[int, int] = {}  # copies in this task so far, of pieces it has had

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            at, starts, lengths, crcs, totals, ids = [], [], [], [], [], []
            for i, own in enumerate(encode(batch.column(1))):
                raw = np.concatenate([own, end])
                for begin in range(0, len(raw), capacity):
                    piece = raw[begin : begin + capacity]
                    at.append(i)
                    starts.append(begin)
                    lengths.append(len(piece))
                    crcs.append(zlib.crc32(piece))
                    totals.append(len(raw))
                    if with_ids:
                        ids.append(piece.tobytes())
            docs = batch.column(0).take(pa.array(at, pa.int64()))
            draw = docs.fill_null(-1).to_numpy().view(np.uint64)
            for x in (starts, crcs, totals):
                draw = mix64(draw + np.uint64(seed)) + np.array(x, np.uint64)
            copies = []
            for d in draw.tolist():
                seen[d] = copy = seen.get(d, -1) + 1
                copies.append(copy)
            columns = [docs, pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array(crcs, pa.int64()), pa.array(totals, pa.int64()), pa.array(copies, pa.int64())]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "copy"]
            if with_ids:
                columns.append(pa.array(ids, pa.binary()))
                names.append("ids")
            return pa.RecordBatch.from_arrays(columns, names)

        return step

    own = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", *(["ids"] if with_ids else [])]
    cut = map_batches(df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), start, PIECES + (", ids binary" if with_ids else ""))
    # copies numbered alike came from different tasks, so there are at most as many as tasks
    counted = cut.groupBy(*own, "copy").agg(F.count("*").alias("n"))
    single = counted.filter("n = 1").withColumn("at", F.lit(0).cast("long"))
    many = counted.filter("n > 1").withColumn("at", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    part = F.pmod(F.xxhash64(F.lit(seed), "doc_id", "start", "ids_crc32", "doc_tokens", "copy", "at"), F.lit(parts)).cast("int")
    return single.unionByName(many).select(*own[:5], part.alias("part"), *own[5:])


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each item: largest first, each into the first bin that has room.

    A tournament tree holds in each node the largest room below it, so the first bin with room is found from the root
    in log2(bins) steps. Ties keep the order of the items.
    """
    n = len(sizes)
    leaves = 1 << max(0, (n - 1).bit_length())
    room = [capacity] * (2 * leaves)
    bins, offsets = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for i in np.argsort(-sizes, kind="stable").tolist():
        size, node = int(sizes[i]), 1
        while node < leaves:
            node *= 2
            if room[node] < size:
                node += 1
        bins[i], offsets[i] = node - leaves, capacity - room[node]
        room[node] -= size
        while node > 1:
            node //= 2
            left, right = room[2 * node], room[2 * node + 1]
            room[node] = left if left > right else right
    return bins, offsets


def pack_pieces(pieces: DataFrame, *, capacity: int) -> DataFrame:
    """Adds sequence_id and offset to rows with part and length; every part is packed by itself in one task.

    A part holds a bounded number of documents, so this shuffle carries small rows and no group grows with the input.
    """

    def pack(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["doc_id", "start", "ids_crc32"], kind="stable")
        bins, offsets = first_fit_decreasing(part["length"].to_numpy(), capacity)
        return part.assign(sequence_id=(part["part"].to_numpy().astype(np.int64) << 32) + bins, offset=offsets).drop(columns="part")

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema if f.name != "part")
    return pieces.groupBy("part").applyInPandas(pack, schema + ", sequence_id long, offset long")


def pack_documents(df: DataFrame, tokenizer_path: str, *, capacity: int = 4096, end_id: int = 2, docs_per_part: int = 4096, with_ids: bool = False, **columns: str) -> DataFrame:
    """Every token of every document in exactly one sequence of at most ``capacity`` tokens.

    Returns doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids with ``with_ids``) per piece. A
    sequence's pieces lie gapless from offset 0. Documents longer than a sequence are cut every ``capacity`` ids, which
    leaves full sequences and one rest; rests are packed. Null and empty texts hold the end id alone. Rows with equal
    or null ids are packed like any other. Other columns of ``df`` are not read. An empty table gives no rows.
    """
    parts = max(1, round(df.count() / docs_per_part))
    return pack_pieces(token_pieces(df, tokenizer_path, capacity=capacity, end_id=end_id, parts=parts, with_ids=with_ids, **columns), capacity=capacity)


def sequences(packed: DataFrame, *, capacity: int = 4096, pad_id: int = 0) -> DataFrame:
    """The training rows themselves: (sequence_id, tokens array<int>, n_tokens, n_padding) from pieces with ids.

    A sequence is padded to ``capacity``, except where its length is a power of two.
    """

    def join(part: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in part:
            out = []
            for pieces in rows["pieces"]:
                raw = b"".join(bytes(p["ids"]) for p in sorted(pieces, key=lambda p: p["offset"]))
                ids = np.frombuffer(raw, dtype="<u4").astype(np.int32)
                pad = 0 if len(ids) & (len(ids) - 1) == 0 else capacity - len(ids)
                out.append((np.concatenate([ids, np.full(pad, pad_id, np.int32)]), len(ids), pad))
            yield pd.DataFrame({"sequence_id": rows["sequence_id"], "tokens": [o[0] for o in out], "n_tokens": [o[1] for o in out], "n_padding": [o[2] for o in out]})

    grouped = packed.groupBy("sequence_id").agg(F.collect_list(F.struct("offset", "ids")).alias("pieces"))  # at most capacity pieces
    return grouped.mapInPandas(join, "sequence_id long, tokens array<int>, n_tokens long, n_padding long")
