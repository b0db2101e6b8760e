"""Words of long texts in pieces, and the CRCs of word runs from the CRCs of their words."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Bytes of a text that are split into words at once: the words of a piece, not of a text, are Python objects.
PIECE = 1 << 21
#: Words that are worked on at once, over any number of texts.
BATCH_WORDS = 1 << 20


def pieces(data: bytes, separator: re.Pattern[bytes]) -> Iterator[bytes]:
    """``data`` cut at separators (of one byte each) into pieces of about PIECE bytes."""
    at = 0
    while len(data) - at > PIECE and (cut := separator.search(data, at + PIECE)):
        yield data[at : cut.start()]
        at = cut.end()
    yield data[at:]


def text_bytes(text: str | None) -> bytes:
    """UTF-8 with A-Z lower-cased; null is empty."""
    return (text or "").encode("utf-8", "surrogatepass").lower()


def word_batches(texts: pa.Array, read: Callable[[bytes], np.ndarray]) -> Iterator[tuple[int, int, list[np.ndarray]]]:
    """(first, end, word arrays of those texts), closed whenever they hold BATCH_WORDS words. Only one text may hold more."""
    first, held, parts = 0, 0, []
    for i in range(len(texts)):
        parts.append(read(text_bytes(texts[i].as_py())))
        held += len(parts[-1])
        if held >= BATCH_WORDS:
            yield first, i + 1, parts
            first, held, parts = i + 1, 0, []
    if parts:
        yield first, len(texts), parts


#: Fixed value: the polynomial of CRC-32, reflected.
POLYNOMIAL = 0xEDB88320


def _one_byte() -> np.ndarray:
    """What a zero byte makes of each single bit of a CRC register: a matrix over GF(2), a column for each bit."""
    columns = []
    for bit in range(32):
        c = 1 << bit
        for _ in range(8):
            c = (c >> 1) ^ (POLYNOMIAL if c & 1 else 0)
        columns.append(c)
    return np.array(columns, np.uint32)


def _lookup(columns: np.ndarray) -> np.ndarray:
    """The matrix as four tables, one for each byte of the register."""
    values = np.arange(256, dtype=np.uint32)
    out = np.zeros((4, 256), np.uint32)
    for byte in range(4):
        for bit in range(8):
            out[byte] ^= np.where(values >> np.uint32(bit) & 1, columns[8 * byte + bit], 0).astype(np.uint32)
    return out


def _apply(table: np.ndarray, crc: np.ndarray) -> np.ndarray:
    byte = np.uint32(255)
    return table[0][crc & byte] ^ table[1][crc >> np.uint32(8) & byte] ^ table[2][crc >> np.uint32(16) & byte] ^ table[3][crc >> np.uint32(24)]


class CrcAlgebra:
    """crc32(a + b) from crc32(a), crc32(b) and the length of b: a's register moved over that many zero bytes, xor b's.

    ``shifts[k]`` is the matrix that moves a register over 2**k bytes, the square of the one before.
    """

    def __init__(self, bits: int = 32):
        columns, self.shifts = _one_byte(), []
        for _ in range(bits):
            self.shifts.append(_lookup(columns))
            columns = _apply(self.shifts[-1], columns)

    def shift(self, crc: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        crc, bit = crc.copy(), 0
        while (left := lengths >> bit).any():
            at = np.flatnonzero(left & 1)
            crc[at] = _apply(self.shifts[bit], crc[at])
            bit += 1
        return crc

    def append(self, crc: np.ndarray, tail: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        return self.shift(crc, lengths) ^ tail

    def append_byte(self, crc: np.ndarray, byte: bytes) -> np.ndarray:
        return _apply(self.shifts[0], crc) ^ np.uint32(zlib.crc32(byte))
