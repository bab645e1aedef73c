"""Quality rules on repetition: how much of a text stands in n-grams and lines that occur twice.

Each text is judged by itself, so tasks stream over the table and nothing is shuffled. The
words of a slice of texts are hashed in numpy, n-grams are rolling hashes of several lengths,
and a repeated one marks the words it covers; characters are counted in marked words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import MULTIPLIER, Words, mixed, run_hashes, slices

SYMBOLS = b"#*$%&|<>"


@dataclass(frozen=True)
class Rules:
    """Limits; shares are of the characters in words."""

    min_words: int = 10
    base_gram: int = 5
    max_repeat_words_pct: int = 20
    #: Largest share inside repeated n-grams of each length.
    max_gram_share: dict[int, float] = field(
        default_factory=lambda: {5: 0.20, 6: 0.19, 7: 0.18, 8: 0.17, 9: 0.16, 10: 0.15}
    )
    #: Largest share inside lines equal to an earlier one.
    max_line_share: float = 0.30


_SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, line_share double, gram_shares array<double>"
)


def _covered(hashes: np.ndarray, text: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """Words inside an n-gram that its text holds twice or more."""
    marks = np.zeros(len(hashes) + 1, np.int32)
    grams = run_hashes(hashes, size)
    inside = np.flatnonzero(np.arange(len(grams)) + size <= starts[text[: len(grams)] + 1])
    if len(inside):
        with np.errstate(over="ignore"):
            keys = mixed(grams[inside] + text[inside].astype(np.uint64) * MULTIPLIER)
        order = np.argsort(keys)
        same = keys[order][1:] == keys[order][:-1]
        twice = np.zeros(len(keys), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        begin = inside[twice]
        np.add.at(marks, begin, 1)
        np.add.at(marks, begin + size, -1)
    return np.cumsum(marks[:-1]) > 0


def _repeated_lines(text: bytes) -> tuple[int, int]:
    """How many lines with a word equal an earlier line, and the code points in their words."""
    seen: set[bytes] = set()
    lines = chars = 0
    for line in text.split(b"\n"):
        parts = line.split()
        if not parts:
            continue
        if line in seen:
            lines += 1
            chars += sum(len(p.decode()) for p in parts)
        seen.add(line)
    return lines, chars


def _judge(batches: Iterator[pa.RecordBatch], rules: Rules) -> Iterator[pa.RecordBatch]:
    symbols = np.zeros(256, bool)
    symbols[list(SYMBOLS)] = True
    for batch in batches:
        for rows in slices(batch):
            texts = rows.column("text")
            words = Words(texts)
            hashes, starts = words.hashes(), words.starts
            text = np.repeat(np.arange(rows.num_rows), np.diff(starts))

            def per_text(values: np.ndarray, starts: np.ndarray = starts) -> np.ndarray:
                return np.diff(np.append(0, np.cumsum(values))[starts]).astype(np.int64)

            points = np.append(0, np.cumsum((words.data & 0xC0) != 0x80))
            chars = points[words.end] - points[words.begin]
            n_words, word_chars = np.diff(starts).astype(np.int64), per_text(chars)
            n_symbols = np.diff(np.append(0, np.cumsum(symbols[words.data]))[words.offsets]).astype(np.int64)
            lines = np.array(
                [_repeated_lines(t) if t else (0, 0) for t in texts.cast(pa.large_binary()).to_pylist()], np.int64
            ).reshape(-1, 2)
            total = np.maximum(word_chars, 1)
            repeats = per_text(_covered(hashes, text, starts, rules.base_gram))
            shares = np.array(
                [per_text(np.where(_covered(hashes, text, starts, n), chars, 0)) / total for n in rules.max_gram_share]
            ).reshape(len(rules.max_gram_share), -1)
            line_share = lines[:, 1] / total
            failed = (n_words < rules.min_words) | (100 * repeats > rules.max_repeat_words_pct * n_words)
            limits = np.array(list(rules.max_gram_share.values())).reshape(-1, 1)
            kept = ~failed & (line_share <= rules.max_line_share) & (shares <= limits).all(axis=0)
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column("doc_id"),
                    *map(pa.array, (n_words, word_chars, n_symbols, lines[:, 0], repeats, failed, kept, line_share)),
                    pa.array(list(shares.T), pa.list_(pa.float64())),
                ],
                names=[c.split()[0] for c in _SCHEMA.split(", ")],
            )


def judge(docs: DataFrame, rules: Rules | None = None) -> DataFrame:
    """Repetition figures of each text and whether it is kept.

    Needs ``doc_id`` and ``text``; other columns are ignored. Words are runs of anything but
    the blank and bytes 9 to 13. Returns one row per input row: doc_id, n_words, word_chars
    (code points in words), n_symbols, n_dup_lines (lines with a word that equal an earlier
    line), n_repeat_words (words inside n-grams of ``base_gram`` words found twice), base_failed,
    kept, line_share and gram_shares (in the order of ``max_gram_share``). Texts that are null,
    empty or blank have no words and fail; repeated rows are judged alike; an empty table gives
    no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(partial(_judge, rules=rules or Rules()), _SCHEMA)
