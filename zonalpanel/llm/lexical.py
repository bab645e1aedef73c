"""Ranked lexical search of a stated set of items over all documents.

Documents become shards of an inverted index: a task gathers the postings of the items' terms
in some megabytes of text into one row of a table, so that no rows are shuffled for it. The
shards' list lengths add up to document frequencies, from which the terms' weights come. Each
task then answers every item on its shards and keeps the best ``top`` documents, and windows
in Spark take the best of those.

On a shard an item's short lists are added up term at a time into accumulators. The
accumulators are one more iterator, with its largest sum as bound, beside the long lists, and
these are walked document at a time in windows of documents. A window whose bounds add up
to less than the worst score that still counts is skipped in all lists. In a window the
iterators that can't reach that score together name no candidates; they are only probed for
the candidates of the others, from the largest bound on, as long as a candidate can reach it.

Terms are told apart by 64-bit hashes. The items are taken in blocks of about ``BLOCK_TERMS``
terms, so what the driver and each task hold of them has a bound; each block is one pass.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import settled
from .words import Words, slices

TOP = 50
#: Terms, with one count for each item that holds them, that share a pass over the documents.
BLOCK_TERMS = 1 << 17
#: Bytes of text whose postings make a shard.
SHARD_BYTES = 4 << 20
#: A longer text is counted in pieces.
LONG_TEXT = 8 << 20
#: A list is short if it has at most one of so many documents of the shard.
SHORT_PART = 16
#: Documents of a window.
WINDOW = 512
#: Bytes that are no part of a term: ASCII but for letters and digits.
SEPARATORS = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
#: Stands for a null doc_id, which sorts before all others.
_NULL = np.iinfo(np.int64).min

_SHARD = (
    "n_docs long, n_terms long, doc_ids binary, lengths binary, "
    "terms binary, list_sizes binary, postings binary, counts binary"
)


@dataclass(frozen=True)
class Items:
    """A block of items: their ids, and the terms of each as places in ``vocabulary`` (sorted hashes)."""

    ids: pa.Array
    vocabulary: np.ndarray
    terms: list[np.ndarray]


@dataclass(frozen=True)
class Weights:
    """Shards, documents with terms, their terms with repeats, and a weight for each term of the vocabulary."""

    shards: int
    documents: int
    terms: int
    term: np.ndarray


def _hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each term of some texts, and the number of each text's first term, with the count last."""
    words = Words(texts, SEPARATORS, lower=True)
    return words.hashes(), words.starts


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows in slices(batch):
            hashes, starts = _hashes(rows.column("text"))
            owner = np.repeat(np.arange(rows.num_rows), np.diff(starts))
            yield pa.RecordBatch.from_arrays(
                [rows.column("item_id").take(pa.array(owner)), pa.array(hashes.view(np.int64))], names=["item_id", "term"]
            )


def item_blocks(items: DataFrame) -> Iterator[Items]:
    """The items in blocks; an item without terms is in none."""
    schema = T.StructType([T.StructField("item_id", items.schema["item_id"].dataType), T.StructField("term", T.LongType())])
    terms = settled(items.select("item_id", "text").mapInArrow(_terms, schema).distinct(), "item_terms")
    blocks = -(-terms.count() // BLOCK_TERMS)
    for block in range(blocks):
        rows = terms.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).toArrow().combine_chunks()
        if rows.num_rows == 0:
            continue
        coded = rows["item_id"].combine_chunks().dictionary_encode(null_encoding="encode")
        owner = coded.indices.to_numpy()
        vocabulary, place = np.unique(rows["term"].to_numpy().view(np.uint64), return_inverse=True)
        order = np.argsort(owner, kind="stable")
        cuts = np.flatnonzero(np.diff(owner[order])) + 1
        yield Items(coded.dictionary, vocabulary, np.split(place[order], cuts))


def _pieces(text: bytes) -> Iterator[bytes]:
    """A long text cut between terms."""
    data, low = np.frombuffer(text, np.uint8), 0
    while low < len(text):
        size = LONG_TEXT
        while low + size < len(text):
            gaps = np.flatnonzero(SEPARATORS[data[low : low + size]])
            if len(gaps):
                size = int(gaps[-1]) + 1
                break
            size *= 2
        yield text[low : low + size]
        low += size


def _counted(texts: pa.Array, vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The terms of each text with repeats; text, term and count of the postings."""
    hashes, starts = _hashes(texts)
    owner = np.repeat(np.arange(len(texts)), np.diff(starts))
    place = np.minimum(np.searchsorted(vocabulary, hashes), len(vocabulary) - 1)
    hit = vocabulary[place] == hashes
    keys, counts = np.unique(owner[hit] * len(vocabulary) + place[hit], return_counts=True)
    return np.diff(starts), *np.divmod(keys, len(vocabulary)), counts


def _counted_long(text: bytes, vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    total, counts = 0, np.zeros(len(vocabulary), np.int64)
    for piece in _pieces(text):
        sizes, _, term, count = _counted(pa.array([piece], pa.large_binary()), vocabulary)
        total += int(sizes[0])
        counts[term] += count
    used = np.flatnonzero(counts)
    return np.array([total]), np.zeros(len(used), np.int64), used, counts[used]


def _shard(parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
    """One row with the postings of (doc_ids, terms of each text, text, term, count) of some slices of texts."""
    bases = np.cumsum([0, *[len(p[0]) for p in parts]])
    doc_ids, lengths = (np.concatenate([p[c] for p in parts]) for c in (0, 1))
    text = np.concatenate([p[2] + b for p, b in zip(parts, bases, strict=False)])
    term, count = (np.concatenate([p[c] for p in parts]) for c in (3, 4))
    named, text = np.unique(text, return_inverse=True)
    order = np.lexsort((text, term))
    terms, sizes = np.unique(term, return_counts=True)
    blobs = [
        doc_ids[named].astype("<i8"),
        lengths[named].astype("<i8"),
        terms.astype("<u4"),
        sizes.astype("<u4"),
        text[order].astype("<u4"),
        count[order].astype("<u4"),
    ]
    values = [[int((lengths > 0).sum())], [int(lengths.sum())], *[[b.tobytes()] for b in blobs]]
    return pa.RecordBatch.from_pydict(dict(zip([c.split()[0] for c in _SHARD.split(", ")], values, strict=True)))


def _index(batches: Iterator[pa.RecordBatch], vocabulary: np.ndarray) -> Iterator[pa.RecordBatch]:
    parts, size = [], 0
    for batch in batches:
        for rows in slices(batch):
            texts, nbytes = rows.column("text"), rows.column("text").nbytes
            if rows.num_rows == 1 and nbytes > LONG_TEXT:
                counted = _counted_long(texts[0].as_buffer().to_pybytes(), vocabulary)
            else:
                counted = _counted(texts, vocabulary)
            doc_ids = rows.column("doc_id").fill_null(_NULL).to_numpy()
            parts.append((doc_ids, *counted))
            size += nbytes
            if size >= SHARD_BYTES:
                yield _shard(parts)
                parts, size = [], 0
    if parts:
        yield _shard(parts)


def index(docs: DataFrame, vocabulary: np.ndarray) -> DataFrame:
    """Shards of an inverted index of ``docs`` over the terms of a vocabulary (sorted hashes).

    A row is a shard: its documents with terms, its terms with repeats, and as little-endian
    integers the ids and lengths of the documents that hold a term of the vocabulary, these terms, the
    sizes of their lists and, list by list, each document's place in the shard and its count.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(partial(_index, vocabulary=vocabulary), _SHARD)


def _list_sizes(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """How many of the task's documents hold each term; term -1 counts documents, -2 terms, -3 shards."""
    held, documents, terms, shards = np.zeros(size, np.int64), 0, 0, 0
    for batch in batches:
        for row in batch.to_pylist():
            documents += row["n_docs"]
            terms += row["n_terms"]
            shards += 1
            held[np.frombuffer(row["terms"], "<u4")] += np.frombuffer(row["list_sizes"], "<u4")
    used = np.flatnonzero(held)
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.append(used, [-1, -2, -3])), pa.array(np.append(held[used], [documents, terms, shards]))],
        names=["term", "n"],
    )


def weights(shards: DataFrame, size: int) -> Weights:
    """Counts over all shards, of ``size`` terms at most, and the terms' weights."""
    rows = shards.select("n_docs", "n_terms", "terms", "list_sizes").mapInArrow(partial(_list_sizes, size=size), "term long, n long")
    found = {r["term"]: r["n"] for r in rows.groupBy("term").agg(F.sum("n").alias("n")).collect()}
    documents, terms, shards = (found.pop(key, 0) for key in (-1, -2, -3))
    weight = np.zeros(size, np.int64)
    for term, held in found.items():
        weight[term] = math.floor(1000 * math.log((2 * documents + 2) / (2 * held + 1)))
    return Weights(shards, documents, terms, weight)


class _Best:
    """The best documents of one item so far: highest scores first, of equal ones the smaller id."""

    def __init__(self, top: int):
        self.top = top
        self.scores, self.docs = np.zeros(0, np.int64), np.zeros(0, np.int64)

    @property
    def least(self) -> int:
        """A score below this no longer counts."""
        return int(self.scores[-1]) if len(self.scores) == self.top else 1

    def add(self, scores: np.ndarray, docs: np.ndarray) -> None:
        scores, docs = np.concatenate([self.scores, scores]), np.concatenate([self.docs, docs])
        order = np.lexsort((docs, -scores))[: self.top]
        self.scores, self.docs = scores[order], docs[order]


class _Lists:
    """The lists of a shard, with what each posting adds to a score."""

    def __init__(self, row: dict, held: Weights):
        self.doc_ids = np.frombuffer(row["doc_ids"], "<i8")
        self.count = len(self.doc_ids)
        lengths = np.frombuffer(row["lengths"], "<i8")
        if 50 * int(lengths.max(initial=0)) * held.documents < 1 << 63:
            norm = 50 * lengths * held.documents // max(held.terms, 1)
        else:
            norm = np.array([50 * n * held.documents // held.terms for n in lengths.tolist()], np.int64)
        terms = np.frombuffer(row["terms"], "<u4").astype(np.int64)
        sizes = np.frombuffer(row["list_sizes"], "<u4").astype(np.int64)
        self.postings = np.frombuffer(row["postings"], "<u4").astype(np.int64)
        counts = np.frombuffer(row["counts"], "<u4").astype(np.int64)
        ends = np.cumsum(sizes)
        self.added = np.repeat(held.term[terms], sizes) * (
            1_000_000_000 * counts // (1000 * counts + 20 * (50 + norm[self.postings]))
        )
        size = len(held.term)
        self.begin, self.end = np.zeros(size, np.int64), np.zeros(size, np.int64)
        self.begin[terms], self.end[terms] = ends - sizes, ends
        self.end[held.term == 0] = self.begin[held.term == 0]
        self.edges = np.append(np.arange(0, self.count, WINDOW), self.count)
        self._windows: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def of(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        part = slice(self.begin[term], self.end[term])
        return self.postings[part], self.added[part]

    def windows(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        """Where each window begins in a list, and the most that a posting in the window adds."""
        if term not in self._windows:
            postings, added = self.of(term)
            cuts = np.searchsorted(postings, self.edges)
            some = cuts[1:] > cuts[:-1]
            most = np.zeros(len(some), np.int64)
            most[some] = np.maximum.reduceat(added, cuts[:-1][some])
            self._windows[term] = cuts, most
        return self._windows[term]


def _answer(lists: _Lists, terms: np.ndarray, best: _Best) -> None:
    """Bring the documents of a shard into the best of an item with these terms."""
    sizes = lists.end[terms] - lists.begin[terms]
    short = terms[(sizes > 0) & (sizes <= max(1, lists.count // SHORT_PART))].tolist()
    long = terms[sizes > max(1, lists.count // SHORT_PART)].tolist()
    sums = np.zeros(lists.count, np.int64)
    for term in short:  # term at a time; a list names no document twice
        postings, added = lists.of(term)
        sums[postings] += added
    if not long:
        found = np.flatnonzero(sums >= best.least)
        if len(found):
            best.add(sums[found], lists.doc_ids[found])
        return

    tables = [lists.windows(t) for t in long]
    most = np.stack([np.maximum.reduceat(sums, lists.edges[:-1]), *[m for _, m in tables]])
    for window in np.flatnonzero(most.sum(axis=0) >= best.least).tolist():
        least, bounds = best.least, most[:, window]
        if bounds.sum() < least:  # the least has grown since
            continue
        low, high = int(lists.edges[window]), int(lists.edges[window + 1])
        order = np.argsort(bounds, kind="stable")
        reach = np.cumsum(bounds[order])
        probed = int(np.searchsorted(reach, least))  # so many can't reach it together
        scores = np.zeros(high - low, np.int64)
        for which in order[probed:].tolist():
            if which == 0:
                scores += sums[low:high]
            else:
                cuts = tables[which - 1][0]
                postings, added = lists.of(long[which - 1])
                part = slice(cuts[window], cuts[window + 1])
                scores[postings[part] - low] += added[part]
        found = np.flatnonzero(scores)
        scores = scores[found]
        for place in range(probed - 1, -1, -1):
            able = scores + reach[place] >= least
            found, scores = found[able], scores[able]
            which = int(order[place])
            if not len(found) or bounds[which] == 0:
                break
            if which == 0:
                scores += sums[low + found]
            else:
                cuts = tables[which - 1][0]
                postings, added = lists.of(long[which - 1])
                part = slice(cuts[window], cuts[window + 1])
                postings, added = postings[part], added[part]
                at = np.minimum(np.searchsorted(postings, low + found), len(postings) - 1)
                scores += np.where(postings[at] == low + found, added[at], 0)
        able = scores >= least
        if able.any():
            best.add(scores[able], lists.doc_ids[low + found[able]])


def _search(batches: Iterator[pa.RecordBatch], items: Items, held: Weights, top: int) -> Iterator[pa.RecordBatch]:
    best = [_Best(top) for _ in items.terms]
    for batch in batches:
        for k in range(batch.num_rows):
            lists = _Lists(batch.slice(k, 1).to_pylist()[0], held)
            if lists.count:
                for terms, own in zip(items.terms, best, strict=True):
                    _answer(lists, terms, own)
    owner = np.repeat(np.arange(len(best)), [len(b.docs) for b in best])
    docs = np.concatenate([b.docs for b in best])
    scores = np.concatenate([b.scores for b in best])
    yield pa.RecordBatch.from_arrays(
        [items.ids.take(pa.array(owner)), pa.array(docs, mask=docs == _NULL), pa.array(scores)],
        names=["item_id", "doc_id", "score"],
    )


def rank(items: DataFrame, docs: DataFrame, top: int = TOP) -> DataFrame:
    """The ``top`` documents for each item: (item_id, rank from 1, doc_id, score), equal scores by doc_id.

    ``items`` needs ``item_id`` and ``text``, ``docs`` needs ``doc_id`` and ``text``; other columns are
    ignored. Terms are runs of non-ASCII characters and ASCII letters and digits, A-Z in lower
    case. With N documents that have a term, L terms in all, n in the document, df documents
    with the term and tf of its occurrences, a term weighs floor(1000 ln((2 N + 2) / (2 df + 1))) and
    adds that times (10**9 tf) div (1000 tf + 20 (50 + (50 n N) div L)). Only scores above 0 count.

    Null, empty and termless texts match nothing and are no documents in N. Rows with the same
    item_id, nulls too, are one item with the terms of all its texts, once each. Each row of ``docs`` is
    a document, repeated ones too (equal ids then share equal scores); a null doc_id comes before
    others. Texts of any length are counted whole. Empty tables give no rows.
    """
    schema = T.StructType(
        [
            T.StructField("item_id", items.schema["item_id"].dataType),
            T.StructField("doc_id", T.LongType()),
            T.StructField("score", T.LongType()),
        ]
    )
    found, shards = items.sparkSession.createDataFrame([], schema), 0
    for block in item_blocks(items):
        postings = settled(index(docs, block.vocabulary), "postings")
        held = weights(postings, len(block.vocabulary))
        found = found.union(postings.mapInArrow(partial(_search, items=block, held=held, top=top), schema))
        shards = max(shards, held.shards)
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_first()]
    if shards > top:  # an item has the best of many tasks: part by part first
        part = F.pmod(F.xxhash64("doc_id"), F.lit(math.isqrt(shards)))
        parts = found.withColumn("part", part)
        ranked = parts.withColumn("rank", F.row_number().over(Window.partitionBy("item_id", "part").orderBy(*order)))
        found = ranked.where(F.col("rank") <= top).drop("part", "rank")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(*order)))
    return ranked.where(F.col("rank") <= top).select("item_id", "rank", "doc_id", "score")
