"""Words of whole Arrow text columns as 64-bit hashes, and hashes of runs of words.

A word is a run of bytes other than the blank and the bytes 9 to 13. All work is done
a slice of documents at a time, so a task's memory follows the slice and the longest text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 2 << 20
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)

_BLANK = np.zeros(256, bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True
#: Besides all ASCII characters that are neither letters nor digits.
PUNCTUATION = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_MASKS = np.array([(1 << (8 * n)) - 1 for n in range(9)], np.uint64)


def slices(batch: pa.RecordBatch, column: str | int = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Pieces of a batch with about ``limit`` bytes of text each (at least one row)."""
    if batch.num_rows == 0:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    part = (np.cumsum(sizes, dtype=np.int64) - sizes) // limit
    cuts = np.flatnonzero(np.diff(part)) + 1
    for start, end in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
        yield batch.slice(start, end - start)


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in a row (null: none) and where each text begins, with the end last."""
    lengths = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    offsets = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(lengths, out=offsets[1:])
    joined = b"".join(x for x in texts.cast(pa.large_binary()).to_pylist() if x)
    return np.frombuffer(joined, np.uint8), offsets


class Words:
    """The words of some texts.

    ``data`` holds the bytes of all texts, which begin at ``offsets``, ``begin`` and ``end`` the place of each word in
    them, and ``starts`` the number of each text's first word, with the word count last.
    ``blanks`` tells which bytes separate words; ``lower`` puts A-Z in lower case.
    """

    def __init__(self, texts: pa.Array, blanks: np.ndarray = _BLANK, lower: bool = False):
        self.data, self.offsets = text_bytes(texts)
        solid = ~blanks[self.data]
        edge = np.zeros(len(solid) + 1, bool)
        edge[self.offsets] = True
        begins, ends = solid.copy(), solid.copy()
        begins[1:] &= ~solid[:-1] | edge[1:-1]
        ends[:-1] &= ~solid[1:] | edge[1:-1]
        self.begin, self.end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        self.starts = np.searchsorted(self.begin, self.offsets)
        if lower:
            self.data = np.where((self.data >= 65) & (self.data <= 90), self.data + 32, self.data).astype(np.uint8)

    def __len__(self) -> int:
        return len(self.begin)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word."""
        return span_hashes(self.data, self.begin, self.end)


def span_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray, seed: np.uint64 = MULTIPLIER) -> np.ndarray:
    """A 64-bit hash of the bytes in each span, eight bytes at a time."""
    size = end - begin
    result = mixed(size.astype(np.uint64) + seed)
    if not len(size):
        return result
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eights = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    active, done = np.arange(len(size)), 0
    with np.errstate(over="ignore"):
        while len(active):
            left = np.minimum(size[active] - done, 8)
            part = eights[begin[active] + done] & _MASKS[left]
            result[active] = mixed((result[active] ^ part) * MULTIPLIER)
            done += 8
            active = active[size[active] > done]
    return result


def gathered(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places begin, begin + 1, ... of each span, one span after the other."""
    return np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(size.sum())


def mixed(values: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every input bit over all output bits."""
    with np.errstate(over="ignore"):
        values = values ^ (values >> np.uint64(30))
        values = values * np.uint64(0xBF58476D1CE4E5B9)
        values = values ^ (values >> np.uint64(27))
        values = values * np.uint64(0x94D049BB133111EB)
        return values ^ (values >> np.uint64(31))


def run_hashes(hashes: np.ndarray, size: int, multiplier: np.uint64 = MULTIPLIER) -> np.ndarray:
    """Hash of the ``size`` words from each place on; places with fewer words left are cut off.

    The hash is a polynomial in ``multiplier`` modulo 2**64, built by doubling run lengths.
    """
    count = len(hashes) - size + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    total, done = None, 0
    power, length, factor, left = hashes, 1, multiplier, size
    with np.errstate(over="ignore"):
        while left:
            if left & 1:
                if total is None:
                    total = power
                else:
                    n = len(power) - done
                    total = total[:n] * factor + power[done:]
                done += length
            left >>= 1
            if left:
                power = power[:-length] * factor + power[length:]
                factor = factor * factor
                length *= 2
    return mixed(total[:count])
