"""Exact removal of repeated runs of words, by a compacted de Bruijn graph.

Every window of ``window`` words is an edge. Windows in a row that share their minimizer
(the k-mer with the smallest hash in them) form one path, a few rows long instead of one
row per edge. Equal windows have equal minimizers, so all that can repeat meets under the
minimizer's hash, and:

1. Paths whose minimizer occurs once hold no repeated window and are dropped.
2. Paths with the same words (a nonbranching stretch of the graph) compact to their first
   source coordinate; every later one is a copy of it. The digest of its words must equal
   that of the words at the source coordinate, else it is treated as in 3.
3. Where one minimizer has several different paths (the graph branches), the first of each
   is opened into its windows, and these are compared one by one.

Hot minimizers and paths are aggregated before they are shuffled, and the joins back to
their occurrences are plain equi-joins whose hot keys Spark splits.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settled, text_key, with_text
from .words import Words, mixed, run_hashes, slices

WINDOW = 20
KMER = 8
CHECK_MULTIPLIER = np.uint64(0xD6E8FEB86659FD93)
DIGEST_MULTIPLIER = np.uint64(0xA0761D6478BD642F)

_PATHS = "minimizer long, path long, digest long, doc_id long, text_key long, start int, edges int"
_WINDOWS = "hash_a long, hash_b long, doc_id long, text_key long, start int"


def _long(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64))


def _paths(batches: Iterator[pa.RecordBatch], window: int, kmer: int) -> Iterator[pa.RecordBatch]:
    """Maximal runs of windows with one minimizer, of each text."""
    for batch in batches:
        for rows in slices(batch):
            words = Words(rows.column("text"))
            count = len(words) - window + 1
            if count <= 0:
                continue
            hashes = words.hashes()
            grams = run_hashes(hashes, kmer)
            least = grams[:count].copy()
            place = np.zeros(count, np.int64)
            for shift in range(1, window - kmer + 1):
                other = grams[shift : shift + count]
                less = other < least
                least[less] = other[less]
                place[less] = shift
            at = np.arange(count)
            place += at
            text = np.searchsorted(words.starts, at, side="right") - 1
            inside = np.flatnonzero(at + window <= words.starts[text + 1])
            if not len(inside):
                continue
            new = np.ones(len(inside), bool)
            new[1:] = (np.diff(place[inside]) != 0) | (np.diff(text[inside]) != 0)
            heads = np.flatnonzero(new)
            edges = np.diff(np.append(heads, len(inside)))
            first = inside[heads]
            last = first + edges - 1
            sums = []
            for multiplier in (CHECK_MULTIPLIER, DIGEST_MULTIPLIER):
                windows = run_hashes(hashes, window, multiplier)
                with np.errstate(over="ignore"):
                    sums.append(mixed(mixed(windows[first] + edges.astype(np.uint64)) * np.uint64(3) + windows[last]))
            source = pa.array(text[first])
            yield pa.RecordBatch.from_arrays(
                [
                    _long(least[first]),
                    _long(sums[0]),
                    _long(sums[1]),
                    rows.column("doc_id").take(source),
                    rows.column("text_key").take(source),
                    pa.array((first - words.starts[text[first]]).astype(np.int32)),
                    pa.array(edges.astype(np.int32)),
                ],
                names=["minimizer", "path", "digest", "doc_id", "text_key", "start", "edges"],
            )


def _span_places(spans: pa.Array, base: np.ndarray, extra: int) -> tuple[np.ndarray, np.ndarray]:
    """Absolute begin and end (exclusive) of each text's (start, edges) spans."""
    flat = pa.ListArray.flatten(spans)
    start = flat.field("start").to_numpy(zero_copy_only=False)
    edges = flat.field("edges").to_numpy(zero_copy_only=False)
    sizes = spans.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    begin = np.repeat(base, sizes) + start
    return begin, begin + edges + extra


def _windows(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Each window of the texts' opened paths, with two hashes of its words."""
    for batch in batches:
        for rows in slices(batch):
            words = Words(rows.column("text"))
            hashes = words.hashes()
            begin, end = _span_places(rows.column("spans"), words.starts[:-1], 0)
            at = np.repeat(begin - np.append(0, np.cumsum(end - begin)[:-1]), end - begin) + np.arange((end - begin).sum())
            text = np.searchsorted(words.starts, at, side="right") - 1
            source = pa.array(text)
            yield pa.RecordBatch.from_arrays(
                [
                    _long(run_hashes(hashes, window)[at]),
                    _long(run_hashes(hashes, window, CHECK_MULTIPLIER)[at]),
                    rows.column("doc_id").take(source),
                    rows.column("text_key").take(source),
                    pa.array((at - words.starts[text]).astype(np.int32)),
                ],
                names=["hash_a", "hash_b", "doc_id", "text_key", "start"],
            )


def _kept(rows: pa.RecordBatch, window: int, text: str) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Words, removed words and the words that stay (joined by one blank) of each text."""
    texts = rows.column(text)
    words = Words(texts)
    gone = np.zeros(len(words) + 1, np.int32)
    begin, end = _span_places(rows.column("spans"), words.starts[:-1], window - 1)
    np.add.at(gone, begin, 1)
    np.add.at(gone, end, -1)
    dropped = np.cumsum(gone[:-1]) > 0
    removed = np.diff(np.append(0, np.cumsum(dropped))[words.starts])
    kept = []
    for i, value in enumerate(texts.cast(pa.large_binary()).to_pylist()):
        parts = value.split() if value else []
        if removed[i]:
            stay = ~dropped[words.starts[i] : words.starts[i + 1]]
            parts = [parts[j] for j in np.flatnonzero(stay).tolist()]
        kept.append(b" ".join(parts))
    return np.diff(words.starts), removed, kept


def _cut(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows in slices(batch):
            counts, removed, kept = _kept(rows, window, "text")
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id"), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())],
                names=["doc_id", "n_words", "n_removed", "kept_text"],
            )


def _replace(batches: Iterator[pa.RecordBatch], window: int, text: str) -> Iterator[pa.RecordBatch]:
    """The rows without ``spans``, and with other texts where words go."""
    for batch in batches:
        for rows in slices(batch, text):
            _, removed, kept = _kept(rows, window, text)
            old = rows.column(text)
            new = pc.if_else(pa.array(removed > 0), pa.array(kept, pa.binary()).cast(pa.string()), old.cast(pa.string()))
            names = [n for n in rows.schema.names if n != "spans"]
            yield pa.RecordBatch.from_arrays([new if n == text else rows.column(n) for n in names], names=names)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("text_key"), "text")


def repeated_spans(docs: DataFrame, window: int = WINDOW, kmer: int = KMER) -> DataFrame:
    """Runs of ``edges`` windows from word ``start`` on that all begin earlier elsewhere.

    Returns (doc_id, text_key, start, edges, source_doc_id, source_start). "Earlier" means
    a smaller doc_id, or the same document and a smaller start; a null doc_id counts as the
    smallest. Rows that repeat a doc_id are told apart by ``text_key`` when their words are
    cut, but do not count as earlier than one another at the same start.
    """
    if not 1 <= kmer <= window:
        raise ValueError("kmer must be between 1 and window")
    texts = _texts(docs)
    paths = texts.mapInArrow(partial(_paths, window=window, kmer=kmer), _PATHS)
    shared = (
        paths.groupBy("minimizer")
        .agg(F.count("*").alias("n"), F.min("path").alias("low"), F.max("path").alias("high"))
        .where("n > 1")
        .select("minimizer", (F.col("low") != F.col("high")).alias("branching"))
    )
    # written, as are the aggregates below, so that Spark can split hot keys of the joins
    shared = settled(shared, "shared-minimizers")
    hits = settled(paths.join(shared, "minimizer"), "repeated-paths")

    first = hits.groupBy("minimizer", "path").agg(F.min(F.struct("doc_id", "start", "digest")).alias("source"))
    first = settled(first, "first-paths")
    here = F.col("doc_id").eqNullSafe(F.col("source.doc_id")) & (F.col("start") == F.col("source.start"))
    marked = settled(
        hits.join(first, ["minimizer", "path"])
        .withColumn("copy", ~here & (F.col("digest") == F.col("source.digest")))
        .where("copy or branching or digest != source.digest")
        .select(
            "doc_id",
            "text_key",
            "start",
            "edges",
            "copy",
            F.col("source.doc_id").alias("source_doc_id"),
            F.col("source.start").alias("source_start"),
        ),
        "marked-paths",
    )
    opened = (
        marked.where("not copy")
        .groupBy("doc_id", "text_key")
        .agg(F.sort_array(F.collect_list(F.struct("start", "edges"))).alias("spans"))
    )
    windows = settled(
        _with_spans(texts, opened, "inner").mapInArrow(partial(_windows, window=window), _WINDOWS), "opened-windows"
    )
    source = (
        windows.groupBy("hash_a", "hash_b")
        .agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "start")).alias("source"))
        .where("n > 1")
        .drop("n")
    )
    source = settled(source, "repeated-windows")
    single = (
        windows.join(source, ["hash_a", "hash_b"])
        .where(~here)
        .select(
            "doc_id",
            "text_key",
            "start",
            F.lit(1).alias("edges"),
            F.col("source.doc_id").alias("source_doc_id"),
            F.col("source.start").alias("source_start"),
        )
    )
    return marked.where("copy").drop("copy").unionByName(single)


def _with_spans(texts: DataFrame, spans: DataFrame, how: str) -> DataFrame:
    other = spans.select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), "spans")
    same = texts["doc_id"].eqNullSafe(other["_id"]) & (texts["text_key"] == other["_key"])
    return texts.join(other, same, how).drop("_id", "_key")


def _spans_of_texts(docs: DataFrame, window: int, kmer: int) -> DataFrame:
    return (
        repeated_spans(docs, window, kmer)
        .groupBy("doc_id", "text_key")
        .agg(F.collect_list(F.struct("start", "edges")).alias("spans"))
    )


def remove_repeats(docs: DataFrame, window: int = WINDOW, kmer: int = KMER) -> DataFrame:
    """Documents without the words of windows that begin earlier elsewhere.

    Needs ``doc_id`` and ``text``; other columns are ignored. Returns one row per input row:
    (doc_id, n_words, n_removed, kept_text), the kept words joined by one blank. A null or
    blank text has no words and an empty ``kept_text``; an empty table gives an empty result.
    """
    return _with_spans(_texts(docs), _spans_of_texts(docs, window, kmer), "left").mapInArrow(
        partial(_cut, window=window), "doc_id long, n_words long, n_removed long, kept_text string"
    )


def without_repeats(docs: DataFrame, window: int = WINDOW, kmer: int = KMER) -> DataFrame:
    """``docs`` with the texts of ``remove_repeats`` where words go; all else is unchanged.

    A text that loses no word keeps its white space, so null, empty and blank texts stay as they
    are; of equal windows the earliest stays, of equal rows (same doc_id and text) all lose the
    same words; texts of any length are taken whole; columns of any names are kept. A column
    ``n_chars`` is counted anew. An empty table stays empty.
    """
    numbered = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    id_name, text_name = (f"c{docs.columns.index(c)}" for c in ("doc_id", "text"))
    other = _spans_of_texts(docs, window, kmer).withColumnsRenamed({"doc_id": "_id", "text_key": "_key"})
    same = numbered[id_name].cast("long").eqNullSafe(other["_id"]) & (text_key(numbered[text_name]) == other["_key"])
    found = (
        numbered.join(other, same, "left")
        .drop("_id", "_key")
        .mapInArrow(partial(_replace, window=window, text=text_name), numbered.schema)
        .toDF(*docs.columns)
    )
    return with_text(found, docs.columns, F.col("text"))
