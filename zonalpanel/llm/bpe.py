"""Byte-pair encoding and decoding with a published vocabulary file.

The file is one of the ``tokenizers`` library whose pre-tokenizer drops white space, so
that each word between blanks is encoded by itself. A task encodes the distinct words of a
slice of texts together: an index maps each pair of symbols that has a rank to all its positions
in the slice; the active ranks are taken in ascending order, every position of a rank is
merged at once, and the lists of the pairs this makes are extended. Words merged before in
the same worker come from a bounded dictionary and are not indexed again. The tasks share
nothing and no rows are shuffled.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from .common import without
from .words import Words, gathered, slices, span_hashes

#: Texts of about so many bytes share one pair index.
INDEX_BYTES = 2 << 20
#: The dictionary of merged words starts anew beyond this many.
KNOWN_WORDS = 1 << 18
#: Bytes of the characters that the byte-level alphabet shows as themselves (fixed values).
_SHOWN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
#: The published pattern for pre-tokens (a fixed value).
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: What a byte is in a plain word: a letter, a digit, a sign, or no byte of plain words.
#: Plain words have printable ASCII but for the apostrophe, and the letters from U+00C0 to U+00FF.
_LETTER, _DIGIT, _SIGN, _ODD = range(4)
_LATIN = 0xC3
_CHECK = np.uint64(0xD6E8FEB86659FD93)


def _byte_kinds() -> np.ndarray:
    kinds = np.full(256, _ODD, np.uint8)
    for byte in range(0x21, 0x7F):
        shown = chr(byte)
        kinds[byte] = _LETTER if shown.isalpha() else _DIGIT if shown.isdigit() else _SIGN
    kinds[ord("'")] = _ODD
    kinds[_LATIN] = _LETTER
    return kinds


def _alphabet() -> list[str]:
    """The character that stands for each byte; the bytes not shown get those from 256 on."""
    hidden = iter(range(256, 512))
    return [chr(b) if b in _SHOWN else chr(next(hidden)) for b in range(256)]


class Encoder:
    """The merges of a vocabulary file, as arrays."""

    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            stored = json.load(file)
        model = stored["model"]
        steps = (stored["pre_tokenizer"] or {}).get("pretokenizers", [{}])
        pattern = steps[0].get("pattern", {}).get("Regex")
        if model["type"] != "BPE" or pattern != _PATTERN or steps[0]["behavior"] != "Removed":
            raise ValueError(f"{path} is not a BPE file that splits words by the known pattern and drops white space")
        vocabulary, suffix = model["vocab"], model["end_of_word_suffix"]
        self.kinds = _byte_kinds()
        letters = _alphabet()
        self.byte_of = {c: b for b, c in enumerate(letters)}
        self.inner = np.array([vocabulary[c] for c in letters], np.int32)
        self.final = np.array([vocabulary[c + suffix] for c in letters], np.int32)
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.left = np.array([vocabulary[a] for a, _ in merges], np.int32)
        self.right = np.array([vocabulary[b] for _, b in merges], np.int32)
        self.made = np.array([vocabulary[a + b] for a, b in merges], np.int32)
        keys = self.left.astype(np.int64) << 32 | self.right
        self.order = np.argsort(keys).astype(np.int32)
        self.keys = keys[self.order]
        rank_of = np.full(int(self.made.max()) + 1, -1)
        rank_of[self.made] = np.arange(len(merges))
        if (np.maximum(rank_of[self.left], rank_of[self.right]) >= np.arange(len(merges))).any():
            raise ValueError(f"{path} ranks a merge before one that it needs")
        self.special = {t["content"]: t["id"] for t in stored["added_tokens"]}
        self.split_special = re.compile("(" + "|".join(re.escape(s) for s in self.special) + ")") if self.special else None
        self.path = path
        self.known = _Known()

    def pieces(self, words: list[bytes]) -> tuple[list[bytes | int], list[int]]:
        """The pre-tokens (bytes) and special tokens (ids) of words, and how many each has, by the library."""
        found: list[bytes | int] = []
        counts = []
        for text in map(bytes.decode, words):
            before = len(found)
            for part in self.split_special.split(text) if self.split_special else [text]:
                if part in self.special:
                    found.append(self.special[part])
                elif part:
                    shown = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(part))
                    found += [bytes(map(self.byte_of.__getitem__, s)) for s, _ in shown]
            counts.append(len(found) - before)
        return found, counts

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, -1 where it has none."""
        keys = left.astype(np.int64) << 32 | right
        place = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[place] == keys, self.order[place], -1)

    def merge(self, raw: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pre-tokens and how many each has, by the pair occurrence index.

        ``raw`` has their bytes one after the other, ``sizes`` the number of bytes of each.
        """
        if not len(sizes):
            return np.zeros(0, "<u4"), np.zeros(0, np.int64)
        ends = np.cumsum(sizes)
        symbol = self.inner[raw]
        symbol[ends - 1] = self.final[raw[ends - 1]]
        count = len(symbol)
        after = np.arange(1, count + 1, dtype=np.int32)
        after[ends - 1] = -1
        before = np.arange(-1, count - 1, dtype=np.int32)
        before[ends - sizes] = -1

        index: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def extend(rank: np.ndarray, position: np.ndarray) -> None:
            known = rank >= 0
            rank, position = rank[known], position[known]
            if not len(rank):
                return
            order = np.argsort(rank, kind="stable")
            rank, position = rank[order], position[order]
            cuts = np.flatnonzero(rank[1:] != rank[:-1]) + 1
            low = 0
            for high in [*cuts.tolist(), len(rank)]:
                key = int(rank[low])
                if key in index:
                    index[key].append(position[low:high])
                else:
                    index[key] = [position[low:high]]
                    heapq.heappush(active, key)
                low = high

        pairs = np.flatnonzero(after >= 0).astype(np.int32)
        extend(self.ranks(symbol[pairs], symbol[pairs + 1]), pairs)
        while active:
            rank = heapq.heappop(active)
            lists = index.pop(rank)
            at = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
            left, right, made = self.left[rank], self.right[rank], self.made[rank]
            second = after[at]
            live = (symbol[at] == left) & (second >= 0)
            live &= symbol[second] == right
            at, second = at[live], second[live]
            if left == right and len(at) > 1:  # overlapping pairs: the leftmost go first
                used, keep = -1, []
                for k, (a, b) in enumerate(zip(at.tolist(), second.tolist(), strict=True)):
                    if a != used:
                        keep.append(k)
                        used = b
                at, second = at[keep], second[keep]
            if not len(at):
                continue
            symbol[at] = made
            symbol[second] = -1
            third = after[second]
            after[at] = third
            some = third >= 0
            before[third[some]] = at[some]
            first = before[at]
            prior = first >= 0
            extend(
                self.ranks(
                    np.concatenate([symbol[at[some]], symbol[first[prior]]]),
                    np.concatenate([symbol[third[some]], symbol[at[prior]]]),
                ),
                np.concatenate([at[some], first[prior]]),
            )
        stay = symbol >= 0
        owner = np.repeat(np.arange(len(sizes)), sizes)[stay]
        return symbol[stay].astype("<u4"), np.bincount(owner, minlength=len(sizes))

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of any words and how many each has, with pre-tokens from the library."""
        pieces, counts = self.pieces(words)
        distinct = [p for p in dict.fromkeys(pieces) if isinstance(p, bytes)]
        sizes = np.array([len(p) for p in distinct], np.int64)
        ids, n = self.merge(np.frombuffer(b"".join(distinct), np.uint8), sizes)
        known: dict[bytes | int, list[int]] = {i: [i] for i in self.special.values()}
        known |= {p: part.tolist() for p, part in zip(distinct, np.split(ids, np.cumsum(n)[:-1]), strict=False)}
        found, lengths, at = [], [], iter(pieces)
        for count in counts:
            own = [i for _ in range(count) for i in known[next(at)]]
            found += own
            lengths.append(len(own))
        return np.array(found, "<u4"), np.array(lengths, np.int64)

    def encode_part(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (null: none), and where those of each text begin, with the end last."""
        words = Words(texts)
        data = words.data.copy()
        kinds = self.kinds[data]
        after = np.zeros(len(data), bool)
        after[1:] = data[:-1] == _LATIN  # the second byte of a plain letter, but for the signs 0x97 and 0xB7
        kinds[after & (data >= 0x80) & (data != 0x97) & (data != 0xB7)] = _LETTER
        odd_byte = kinds == _ODD
        odd_byte[:-1] |= (data[:-1] == ord("<")) & (data[1:] == ord("|"))  # may begin a special token
        odd_before = np.append(0, np.cumsum(odd_byte))
        odd = odd_before[words.end] > odd_before[words.begin]
        capital = (data >= 65) & (data <= 90) | after & (data >= 0x80) & (data <= 0x9E)
        data[capital] += 32

        inside = np.zeros(len(data) + 1, np.int8)
        plain = ~odd
        inside[words.begin[plain]] = 1
        inside[words.end[plain]] -= 1
        inside = np.cumsum(inside[:-1], dtype=np.int8) > 0
        starts = np.zeros(len(data), bool)
        starts[1:] = (kinds[1:] != kinds[:-1]) | (kinds[1:] == _DIGIT)
        starts[words.begin] = True
        begin = np.flatnonzero(starts & inside)
        ends = np.zeros(len(data) + 1, bool)
        ends[begin] = True
        ends[words.end[plain]] = True
        end = np.flatnonzero(ends)
        end = end[np.searchsorted(end, begin, side="right")] if len(begin) else begin

        hashes = span_hashes(data, begin, end)
        distinct, first, code = np.unique(hashes, return_index=True, return_inverse=True)
        check = span_hashes(data, begin, end, _CHECK)
        if (check != check[first][code]).any():
            raise RuntimeError("two different words have the same hash")
        new = self.known.missing(distinct, check[first])
        sizes = (end - begin)[first][new]
        self.known.add(distinct, check[first], new, *self.merge(data[gathered(begin[first][new], sizes)], sizes))
        ids, n_ids = self.known.of(distinct)

        strange = [words.data[a:b].tobytes() for a, b in zip(words.begin[odd], words.end[odd], strict=True)]
        numbers = {word: i for i, word in enumerate(dict.fromkeys(strange))}
        more, n_more = self.encode_words(list(numbers))
        ids, n_ids = np.concatenate([ids, more]), np.concatenate([n_ids, n_more])

        at = np.concatenate([begin, words.begin[odd]])
        unit = np.concatenate([code, np.fromiter(map(numbers.__getitem__, strange), np.int64, len(strange)) + len(first)])
        order = np.argsort(at, kind="stable")
        at, unit = at[order], unit[order]
        size = n_ids[unit]
        total = np.append(0, np.cumsum(size))
        flat = ids[gathered((np.cumsum(n_ids) - n_ids)[unit], size)]
        return flat, total[np.searchsorted(at, words.offsets)]

    def encode_texts(self, texts: pa.Array) -> Iterator[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers, in order."""
        batch = pa.RecordBatch.from_arrays([texts], names=["text"])
        for part in slices(batch, limit=INDEX_BYTES):
            ids, starts = self.encode_part(part.column(0))
            data = ids.tobytes()
            for a, b in zip((4 * starts[:-1]).tolist(), (4 * starts[1:]).tolist(), strict=True):
                yield data[a:b]

    def decode(self, ids: Iterable[int]) -> str:
        """The tokens of the ids with a blank between any two, special tokens included."""
        return " ".join(tokens(self.path)[ids].tolist())


class _Known:
    """Hashes of merged words, sorted, and where their ids are; starts anew beyond ``KNOWN_WORDS``."""

    def __init__(self) -> None:
        self.hash, self.check = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        self.start, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, "<u4")

    def missing(self, hashes: np.ndarray, check: np.ndarray) -> np.ndarray:
        """Which of some words (by sorted hashes) are not known; all, if there would be too many."""
        place = np.searchsorted(self.hash, hashes)
        found = place < len(self.hash)
        found[found] = self.hash[place[found]] == hashes[found]
        if (self.check[place[found]] != check[found]).any():
            raise RuntimeError("two different words have the same hash")
        if len(self.hash) + len(hashes) - found.sum() > KNOWN_WORDS:
            self.__init__()
            return np.ones(len(hashes), bool)
        return ~found

    def add(self, hashes: np.ndarray, check: np.ndarray, new: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> None:
        """Put the words marked as new in, with their ids one after the other."""
        order = np.argsort(both := np.concatenate([self.hash, hashes[new]]), kind="stable")
        self.hash = both[order]
        self.check = np.concatenate([self.check, check[new]])[order]
        self.start = np.concatenate([self.start, len(self.ids) + np.cumsum(sizes) - sizes])[order]
        self.size = np.concatenate([self.size, sizes])[order]
        self.ids = np.concatenate([self.ids, ids])

    def of(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of known words, one after the other, and how many each has."""
        place = np.searchsorted(self.hash, hashes)
        return self.ids[gathered(self.start[place], self.size[place])], self.size[place]


@lru_cache(maxsize=2)
def tokens(path: str) -> np.ndarray:
    """The token of each id, all that decoding needs of a file."""
    with open(path, encoding="utf-8") as file:
        stored = json.load(file)
    found = {i: token for token, i in stored["model"]["vocab"].items()}
    found |= {t["id"]: t["content"] for t in stored["added_tokens"]}
    return np.array([found[i] for i in range(len(found))], object)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """The encoder of a file, loaded once in each Python worker."""
    return Encoder(path)


def _encode(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    merges = encoder(path)
    for batch in batches:
        texts = batch.column("text")
        for rows, ids in _grouped(batch, merges.encode_texts(texts)):
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(ids, pa.binary())], names=["doc_id", "ids"])


def _grouped(batch: pa.RecordBatch, values: Iterator[bytes]) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """The rows of a batch with their values, a slice at a time."""
    for rows in slices(batch):
        yield rows, [next(values) for _ in range(rows.num_rows)]


def encode(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids) of each row: token ids as little-endian unsigned 32-bit integers.

    Needs ``doc_id`` and ``text``; other columns are ignored, whatever their names. A null, empty
    or blank text has no ids; texts of any length are encoded whole; repeated rows stay repeated
    rows; an empty table gives no rows. ``path`` is the vocabulary file, at the same place on
    every executor.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(partial(_encode, path=path), "doc_id long, ids binary")


def _decode(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    token = tokens(path)
    for batch in batches:
        for rows in slices(batch, "ids"):
            found = (np.frombuffer(ids or b"", "<u4") for ids in rows.column("ids").to_pylist())
            texts = [" ".join(token[ids].tolist()) for ids in found]
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(texts, pa.string())], names=[*rows.schema.names, "decoded_text"])


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``encoded`` (with an ``ids`` column) and ``decoded_text``: its tokens, with blanks between them.

    Null or empty ids decode to the empty text, ids of any number to one text; repeated rows stay
    repeated rows and an empty table gives no rows. A column named ``decoded_text`` is replaced. Ids
    that are not in the vocabulary raise an IndexError.
    """
    encoded = without(encoded, "decoded_text")
    schema = T.StructType([*encoded.schema.fields, T.StructField("decoded_text", T.StringType())])
    return encoded.mapInArrow(partial(_decode, path=path), schema)
