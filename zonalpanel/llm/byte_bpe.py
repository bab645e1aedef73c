"""Byte-level byte-pair encoding and decoding with a published file of ranks.

A text is split by a pattern, and each match is encoded by itself: the pair of neighbouring
symbols with the lowest rank, the leftmost of equal ones, becomes one symbol until no pair has
a rank. A segment tree over the byte positions of a match has at each leaf the rank of the pair
that begins there, with the position as tie break, so that its root is the next merge. A merge
changes three leaves: the pair is gone, the pair it begins and the pair of its live left
neighbour are new; each change walks up one path of the tree.

A task encodes the distinct matches of a slice of texts. Trees of one size stand in the rows
of a matrix and take their merges in step; a match longer than ``STEP_BYTES`` has a tree of
its own. Matches seen in earlier slices come from a bounded dictionary. No rows are shuffled.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator
from functools import lru_cache, partial
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import without
from .words import gathered, slices

#: Texts of about so many bytes are split and encoded together.
SLICE_BYTES = 2 << 20
#: Matches of up to so many bytes are merged in step with others (a power of two).
STEP_BYTES = 256
#: So many trees are in step at a time.
STEP_ROWS = 1 << 14
#: The dictionary of encoded matches is emptied when it has this many.
KNOWN = 1 << 18
#: A text longer than this is split by and by.
LONG_TEXT = 1 << 20
#: So many ids are decoded at a time.
DECODE_IDS = 1 << 20
#: White space as the pattern means it (fixed values); the regex module's own \s has more.
_SPACE = r"\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_NONE = np.iinfo(np.int32).max


class ByteEncoder:
    """The ranks of a file and the pattern that splits texts."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as file:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
        if not all(bytes([b]) in ranks for b in range(256)):
            raise ValueError(f"{path} has no rank for some byte")
        self.pattern = regex.compile(
            pattern.replace(r"[^\s", f"[^{_SPACE}").replace(r"\S", f"[^{_SPACE}]").replace(r"\s", f"[{_SPACE}]")
        )
        self.whole = {token: np.array([rank], "<u4").tobytes() for token, rank in ranks.items()}
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        self.n_ids = max(ranks.values()) + 1
        self.pair = {
            ranks[token[:i]] * self.n_ids + ranks[token[i:]]: rank
            for token, rank in ranks.items()
            for i in range(1, len(token))
            if token[:i] in ranks and token[i:] in ranks
        }
        self.pair_keys = np.array(sorted(self.pair), np.int64)
        self.pair_ranks = np.array([self.pair[k] for k in self.pair_keys.tolist()], np.int64)
        sizes = np.zeros(self.n_ids + 1, np.int64)
        for token, rank in ranks.items():
            sizes[rank + 1] = len(token)
        self.token_size = sizes[1:]
        self.token_start = np.cumsum(sizes)[:-1]
        self.token_data = np.frombuffer(b"".join(sorted(ranks, key=ranks.__getitem__)), np.uint8)
        self.known: dict[str, bytes] = {}

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair of ids, -1 where it has none (as for the id -1)."""
        keys = left * self.n_ids + right
        place = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where((self.pair_keys[place] == keys) & (left >= 0) & (right >= 0), self.pair_ranks[place], -1)

    def merge_in_step(self, pieces: list[bytes], size: int) -> list[bytes]:
        """The ids of pieces of more than ``size`` / 2 and at most ``size`` bytes, a power of two."""
        count = len(pieces)
        lengths = np.array([len(p) for p in pieces])
        rows = np.arange(count)
        wide = size + 1  # the last column stands for what is outside of a piece
        symbol = np.full((count, wide), -1, np.int64)
        inside = np.arange(wide) < lengths[:, None]
        symbol[inside] = self.byte[np.frombuffer(b"".join(pieces), np.uint8)]
        after = np.where(np.arange(1, wide + 1) < lengths[:, None], np.arange(1, wide + 1), size)
        before = np.tile(np.where(np.arange(wide) > 0, np.arange(wide) - 1, size), (count, 1))

        tree = np.full((count, 2 * size), _NONE, np.int64)
        rank = self.ranks(symbol[:, : size - 1], symbol[:, 1:size])
        tree[:, size:-1] = np.where(rank >= 0, rank * size + np.arange(size - 1), _NONE)
        level = size >> 1
        while level:
            below = tree[:, 2 * level : 4 * level]
            tree[:, level : 2 * level] = np.minimum(below[:, ::2], below[:, 1::2])
            level >>= 1

        while True:
            rows = rows[tree[rows, 1] < _NONE]
            if not len(rows):
                break
            made, at = np.divmod(tree[rows, 1], size)
            second, first = after[rows, at], before[rows, at]
            third = after[rows, second]
            symbol[rows, at] = made
            symbol[rows, second] = -1
            after[rows, at] = third
            before[rows, third] = at
            right = self.ranks(made, symbol[rows, third])
            left = self.ranks(symbol[rows, first], made)
            tree[rows, size + at] = np.where(right >= 0, right * size + at, _NONE)
            tree[rows, size + second] = _NONE
            some = first < size
            tree[rows[some], size + first[some]] = np.where(left >= 0, left * size + first, _NONE)[some]
            changed = np.concatenate([rows, rows, rows[some]])
            node = (size + np.concatenate([at, second, first[some]])) >> 1
            while node[0]:
                tree[changed, node] = np.minimum(tree[changed, 2 * node], tree[changed, 2 * node + 1])
                node >>= 1
        stay = symbol >= 0
        data = symbol[stay].astype("<u4").tobytes()
        ends = np.cumsum(4 * stay.sum(axis=1)).tolist()
        return [data[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]

    def merge_alone(self, piece: bytes) -> bytes:
        """The ids of one piece."""
        count, pair, wide = len(piece), self.pair, self.n_ids
        size = 1 << (count - 1).bit_length()
        none = 1 << 62
        symbol = array("q", self.byte[np.frombuffer(piece, np.uint8)].tobytes())
        after, before = array("q", range(1, count + 1)), array("q", range(-1, count - 1))
        leaves = np.full(2 * size, none, np.int64)
        ids = np.frombuffer(symbol, np.int64)
        rank = self.ranks(ids[:-1], ids[1:])
        leaves[size : size + count - 1] = np.where(rank >= 0, rank * size + np.arange(count - 1), none)
        level = size >> 1
        while level:
            below = leaves[2 * level : 4 * level]
            leaves[level : 2 * level] = np.minimum(below[::2], below[1::2])
            level >>= 1
        tree = array("q", leaves.tobytes())
        del leaves

        def put(position: int, left: int, right: int) -> None:
            found = pair.get(left * wide + right) if right >= 0 else None
            node = size + position
            value = none if found is None else found * size + position
            tree[node] = value
            while node > 1:
                other = tree[node ^ 1]
                if other < value:
                    value = other
                node >>= 1
                if tree[node] == value:
                    break
                tree[node] = value

        while tree[1] < none:
            made, at = divmod(tree[1], size)
            second = after[at]
            third, first = after[second], before[at]
            symbol[at], symbol[second] = made, -1
            after[at] = third
            put(second, -1, -1)
            if third < count:
                before[third] = at
                put(at, made, symbol[third])
            else:
                put(at, -1, -1)
            if first >= 0:
                put(first, symbol[first], made)
        ids = np.frombuffer(symbol, np.int64)
        return ids[ids >= 0].astype("<u4").tobytes()

    def learn(self, split: list[list[str]]) -> None:
        """Put the ids of the matches of some texts into the dictionary."""
        distinct = set().union(*split)
        new = {p: p.encode() for p in distinct if p not in self.known}
        if len(self.known) + len(new) > KNOWN:
            self.known.clear()
            new = {p: p.encode() for p in distinct}
        classes: dict[int, list[str]] = {}
        for text, data in new.items():
            if data in self.whole:
                self.known[text] = self.whole[data]
            elif len(data) > STEP_BYTES:
                self.known[text] = self.merge_alone(data)
            else:
                classes.setdefault(1 << (len(data) - 1).bit_length(), []).append(text)
        for size, texts in classes.items():
            for low in range(0, len(texts), STEP_ROWS):
                part = texts[low : low + STEP_ROWS]
                self.known.update(zip(part, self.merge_in_step([new[t] for t in part], size), strict=True))

    def encode_texts(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text (null: none) as little-endian unsigned 32-bit integers."""
        if sum(len(t or "") for t in texts) > LONG_TEXT and len(texts) == 1:
            return [self._encode_long(texts[0])]
        split = [self.pattern.findall(t) if t else [] for t in texts]
        self.learn(split)
        return [b"".join(map(self.known.__getitem__, pieces)) for pieces in split]

    def _encode_long(self, text: str) -> bytes:
        matches = (m.group() for m in self.pattern.finditer(text))
        found = bytearray()
        while pieces := list(islice(matches, LONG_TEXT // 8)):
            self.learn([pieces])
            found += b"".join(map(self.known.__getitem__, pieces))
        return bytes(found)

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of the ids' tokens, one after the other."""
        if len(ids) and not (0 <= ids.min() and ids.max() < self.n_ids):
            raise ValueError("an id is not in the vocabulary")
        parts = []
        for low in range(0, len(ids), DECODE_IDS):
            part = ids[low : low + DECODE_IDS]
            parts.append(self.token_data[gathered(self.token_start[part], self.token_size[part])].tobytes())
        return b"".join(parts)


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> ByteEncoder:
    """The encoder of a file, loaded once in each Python worker."""
    return ByteEncoder(path, pattern)


def _encode(batches: Iterator[pa.RecordBatch], path: str, pattern: str) -> Iterator[pa.RecordBatch]:
    ranks = encoder(path, pattern)
    for batch in batches:
        for rows in slices(batch, limit=SLICE_BYTES):
            found = ranks.encode_texts(rows.column("text").to_pylist())
            ends = np.cumsum([0, *[len(f) // 4 for f in found]]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(found), "<i4")))
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), ids], names=["doc_id", "ids"])


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, ids) of each row: the token ids of its text, without special tokens.

    Needs ``doc_id`` and ``text``; other columns are ignored. A null or empty text has no ids;
    texts of any length are encoded whole, one of equal rows like the other; an empty table gives
    no rows. ``path`` is the file of ranks, at the same place on every executor, ``pattern``
    what splits a text into matches.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(partial(_encode, path=path, pattern=pattern), "doc_id long, ids array<int>")


def _decode(batches: Iterator[pa.RecordBatch], path: str, pattern: str) -> Iterator[pa.RecordBatch]:
    ranks = encoder(path, pattern)
    for batch in batches:
        ids = batch.column("ids")
        for row in range(batch.num_rows):
            values = ids[row].values
            data = b"" if values is None else ranks.decode(values.to_numpy(zero_copy_only=False))
            one = batch.slice(row, 1)
            yield pa.RecordBatch.from_arrays(
                [*one.columns, pa.array([data], pa.binary())], names=[*batch.schema.names, "decoded"]
            )


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """``encoded`` (with an ``ids`` column of integers) and ``decoded``: the bytes of its tokens.

    Null or empty ids decode to no bytes. A column named ``decoded`` is replaced. Bytes of ids that
    do not come from a text need not be valid UTF-8. Ids that are not in the vocabulary (null
    ones too) raise a ValueError. Rows stay rows; an empty table gives no rows.
    """
    encoded = without(encoded, "decoded")
    schema = T.StructType([*encoded.schema.fields, T.StructField("decoded", T.BinaryType())])
    return encoded.mapInArrow(partial(_decode, path=path, pattern=pattern), schema)
