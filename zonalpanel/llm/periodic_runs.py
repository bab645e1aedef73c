"""Maximal periodic runs of words in each text, by seeds on diagonals that are extended.

A run of smallest period q and length L has L - q places i at which the words i and i + q are
equal: a stretch of the diagonal with lag q. Lags are taken in classes; k, a power of two, is
a class's length that every run's stretch is guaranteed to have, and it exceeds the class's
lags. Two occurrences of a k-gram inside a run are therefore a multiple of q apart, so the
k-gram at the run's begin occurs next exactly q words on: only neighbouring occurrences in the
index of k-grams need to be enumerated, however often a gram occurs. Such pairs are seeds;
seeds that overlap on a diagonal are one; a table of how far each lag is covered keeps a
stretch from being extended again. Grams that occur once are out of the next class, whose
grams are made of two of the last one.

Texts are independent: tasks stream over the table, a slice of texts at a time in numpy, and
nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .words import MULTIPLIER, Words, gathered, mixed, slices

MIN_WORDS = 24
MIN_POWER = 3
#: So many words are written to collapsed texts at a time.
_WRITE_WORDS = 1 << 17

_RUN = "struct<start:long,length:long,period:long>"
_SCHEMA = f"doc_id long, n_words long, runs array<{_RUN}>, strongest {_RUN}, collapsed_text string"


def guaranteed_overlap(min_words: int, min_power: int) -> int:
    """The least stretch of a run of any period: the smallest max(min_words - q, (min_power - 1) * q)."""
    return -(-min_words * (min_power - 1) // min_power)


def _seeds(hashes: np.ndarray, text: np.ndarray, ends: np.ndarray, first: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(k, begin, lag) of neighbouring equal k-grams of a text with the lags of k's class, by lag and begin.

    ``ends`` holds for each word where its text ends.
    """
    size, grams = 1, hashes.copy()
    at = np.arange(len(hashes))
    with np.errstate(over="ignore"):
        while True:
            at = at[at + size <= ends[at]]
            if size >= first:
                keys = mixed(grams[at] + text[at].astype(np.uint64) * MULTIPLIER)
                order = np.argsort(keys, kind="stable")
                keys = keys[order]
                same = keys[1:] == keys[:-1]
                if not same.any():
                    return
                found = at[order]
                begin, lag = found[:-1][same], np.diff(found)[same]
                fits = (lag < size) & (lag >= (1 if size == first else size // 2))
                begin, lag = begin[fits], lag[fits]
                order = np.lexsort((begin, lag))
                yield size, begin[order], lag[order]
                repeated = np.append(same, False)
                repeated[1:] |= same
                at = np.sort(found[repeated])
            at = at[at + 2 * size <= ends[at]]
            if not len(at):
                return
            grams[at] = mixed((grams[at] * MULTIPLIER) ^ grams[at + size])
            size *= 2


def _stretch(hashes: np.ndarray, lag: int, begin: int, end: int, low: int, high: int) -> tuple[int, int]:
    """The equal places of a diagonal around [begin, end), within words low to high."""
    step, limit = 16, high - lag
    while end < limit:
        to = min(limit, end + step)
        other = np.flatnonzero(hashes[end:to] != hashes[end + lag : to + lag])
        if len(other):
            end += int(other[0])
            break
        end, step = to, 2 * step
    step = 16
    while begin > low:
        to = max(low, begin - step)
        other = np.flatnonzero(hashes[to:begin] != hashes[to + lag : begin + lag])
        if len(other):
            begin = to + int(other[-1]) + 1
            break
        begin, step = to, 2 * step
    return begin, end


def find(hashes: np.ndarray, starts: np.ndarray, min_words: int = MIN_WORDS, min_power: int = MIN_POWER) -> np.ndarray:
    """Rows (text, start, length, period) of all runs of some texts, sorted.

    ``hashes`` tells words apart, ``starts`` holds the number of each text's first word, with
    the word count last; a run's start counts from its text's first word.
    """
    if min_power < 3 or min_words < 1:
        raise ValueError("runs need at least three periods and one word")
    text = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    first = 1 << (guaranteed_overlap(min_words, min_power).bit_length() - 1)
    runs = []
    for size, begin, lag in _seeds(hashes, text, starts[1:][text], first):
        if not len(begin):
            continue
        new = np.ones(len(begin), bool)
        new[1:] = (np.diff(lag) != 0) | (np.diff(begin) > size) | (np.diff(text[begin]) != 0)
        heads = np.flatnonzero(new)
        tails = begin[np.append(heads[1:], len(begin)) - 1] + size
        covered: dict[tuple[int, int], int] = {}
        for q, a, b in zip(lag[heads].tolist(), begin[heads].tolist(), tails.tolist(), strict=True):
            if (hashes[a:b] != hashes[a + q : b + q]).any():
                raise RuntimeError("two different grams have the same hash")
            own = int(text[a])
            if a < covered.get((own, q), 0):
                continue
            low = int(starts[own])
            a, b = _stretch(hashes, q, a, b, low, int(starts[own + 1]))
            covered[own, q] = b
            if b - a + q >= max(min_words, min_power * q):
                runs.append((own, a - low, b - a + q, q))
    found = np.array(runs, np.int64).reshape(-1, 4)
    return found[np.lexsort((found[:, 3], found[:, 1], found[:, 0]))]


def _kept(words: Words, runs: np.ndarray) -> np.ndarray:
    """Which words stay when of each run only the first period does."""
    marks = np.zeros(len(words) + 1, np.int64)
    begin = words.starts[runs[:, 0]] + runs[:, 1]
    np.add.at(marks, begin + runs[:, 3], 1)
    np.add.at(marks, begin + runs[:, 2], -1)
    return np.cumsum(marks[:-1]) == 0


def _joined(words: Words, keep: np.ndarray) -> Iterator[bytes]:
    """The kept words of each text with a blank between any two."""
    data = np.append(words.data, np.uint8(32))
    for low, high in zip(words.starts[:-1].tolist(), words.starts[1:].tolist(), strict=True):
        parts = []
        for at in range(low, high, _WRITE_WORDS):
            stay = at + np.flatnonzero(keep[at : min(high, at + _WRITE_WORDS)])
            size = words.end[stay] - words.begin[stay] + 1
            part = data[gathered(words.begin[stay], size)]
            part[np.cumsum(size) - 1] = 32
            parts.append(part.tobytes())
        yield b"".join(parts)[:-1]


def _structs(runs: np.ndarray) -> pa.StructArray:
    return pa.StructArray.from_arrays([pa.array(runs[:, c]) for c in (1, 2, 3)], ["start", "length", "period"])


def _find(batches: Iterator[pa.RecordBatch], min_words: int, min_power: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows in slices(batch):
            words = Words(rows.column("text"))
            runs = find(words.hashes(), words.starts, min_words, min_power)
            ends = np.searchsorted(runs[:, 0], np.arange(rows.num_rows + 1))
            # quotients of numbers below 2**26 are equal in doubles only if they are equal
            best = runs[np.lexsort((runs[:, 3], runs[:, 1], -(runs[:, 2] / runs[:, 3]), runs[:, 0]))]
            some = ends[1:] > ends[:-1]
            strongest = _structs(best).take(pa.array(ends[:-1], mask=~some))
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column("doc_id"),
                    pa.array(np.diff(words.starts)),
                    pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), _structs(runs)),
                    strongest,
                    pa.array([t.decode() for t in _joined(words, _kept(words, runs))], pa.string()),
                ],
                names=["doc_id", "n_words", "runs", "strongest", "collapsed_text"],
            )


def find_runs(docs: DataFrame, min_words: int = MIN_WORDS, min_power: int = MIN_POWER) -> DataFrame:
    """The periodic runs of each text, and the text without their repetitions.

    Needs ``doc_id`` and ``text``; other columns are ignored. Words are runs of anything but the
    blank and bytes 9 to 13. A run is a stretch of words with a smallest period q (words q
    apart are equal), at least ``min_words`` and ``min_power`` times q words long, that no neighbour
    extends. Returns one row per input row: doc_id, n_words, runs by start and period, strongest
    (the run of the greatest length / period, of equal ones the first, null without runs) and
    collapsed_text: the words, with one blank between any two, but for those that some run holds
    after its first q. A null, empty or blank text has no words, no runs and an empty
    collapsed_text; texts of any length are taken whole; equal rows give equal rows; an empty table
    gives no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(partial(_find, min_words=min_words, min_power=min_power), _SCHEMA)


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, text) with a periodic tail in the texts of about a tenth of the documents.

    With h = crc32 of the decimal doc_id and g = h div 10, a text of n > 0 words whose h is a
    multiple of 10 keeps its first a = g % n words and then repeats the next 1 + (n - a) div (3 + g % 8)
    words up to its length. Texts without words, and those without a doc_id, stay as they are.
    """
    digest = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    rows = docs.select(
        "doc_id",
        "text",
        F.when(digest % 10 == 0, F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))).alias("words"),
        F.floor(digest / 10).alias("g"),
    )
    rows = rows.select("*", F.size("words").alias("n"))
    rows = rows.select("*", F.when(F.col("n") > 0, F.col("g") % F.col("n")).cast("int").alias("a"))
    rows = rows.select("*", F.expr("CAST(1 + (n - a) div (3 + g % 8) AS int)").alias("p"))

    def part(begin: str, size: str) -> Column:
        return F.slice("words", F.expr(begin), F.expr(size))

    times = F.expr("CAST(ceil((n - a) / p) AS int)")
    repeated = F.concat(part("1", "a"), F.flatten(F.array_repeat(part("a + 1", "p"), times)))
    return rows.select(
        "doc_id", F.when(F.col("n") > 0, F.array_join(F.slice(repeated, 1, F.col("n")), " ")).otherwise(F.col("text")).alias("text")
    )
