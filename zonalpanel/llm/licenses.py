"""License notices in texts: MinHash bands over overlapping windows, then exact containment.

Templates are few and short, so every task holds them. A text is covered by overlapping
windows, a quarter longer than a template and a quarter apart, so that each notice lies whole
in some window. Windows that share a MinHash band with a template are checked exactly: the
share of the template's shingles that the window holds. The number of bands follows from the
smallest similarity that a window holding ``containment`` of a template can have, so that it
meets the template with a probability of ``certainty`` or more. A template of fewer than five
words is one shingle of all its words, and its windows are the runs of so many words. Nothing
is shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import MULTIPLIER, PUNCTUATION, Words, mixed, run_hashes, slices

SHINGLE = 5
#: Words of the shortest template.
SHORTEST = 3
CONTAINMENT = 0.8
CERTAINTY = 0.9999

#: The wording of public notices.
TEMPLATES: dict[str, str] = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at',
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "mit": "Released under the MIT License.",
    "mit-permission": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}

#: Notices of fewer words than a shingle has elsewhere.
SHORT_TEMPLATES: dict[str, str] = {
    "all-rights-reserved": "All rights reserved.",
}

_SCHEMA = "doc_id long, license string, containment double, start_word int, n_words int"


def shingle_size(words: int) -> int:
    """Words of a shingle of a template of so many words."""
    return min(SHINGLE, words)


def window_size(words: int) -> tuple[int, int]:
    """Length and distance of the windows for a template of so many words."""
    if words < SHINGLE:
        return words, 1
    step = max(1, words // 4)
    return words + step, step


def bands_for(words: int, containment: float = CONTAINMENT, certainty: float = CERTAINTY) -> int:
    """How many bands of one MinHash let a window meet a template of so many words.

    A window that holds the share c of the template's t shingles and has w of its own has a
    Jaccard similarity of at least c t / (t + w - c t).
    """
    shingle = shingle_size(words)
    t, w = words - shingle + 1, window_size(words)[0] - shingle + 1
    shared = math.ceil(containment * t - 1e-9)
    similarity = shared / (t + w - shared)
    if similarity == 1:
        return 1
    return math.ceil(math.log(1 - certainty) / math.log(1 - similarity))


class _Templates:
    """The templates' shingles, and for each template length the minima of its templates in each band."""

    def __init__(self, templates: tuple[tuple[str, str], ...], containment: float, certainty: float):
        self.containment = containment
        self.names, self.shingles, sizes = [], [], []
        for name, text in templates:
            words = Words(pa.array([text]), PUNCTUATION, lower=True)
            if len(words) < SHORTEST:
                raise ValueError(f"template {name} has fewer than {SHORTEST} words")
            self.names.append(name)
            self.shingles.append(np.unique(run_hashes(words.hashes(), shingle_size(len(words)))))
            sizes.append(len(words))
        self.classes: list[tuple[int, list[int], list[tuple[np.ndarray, dict[int, list[int]]]]]] = []
        for size in sorted(set(sizes)):
            members = [i for i, n in enumerate(sizes) if n == size]
            bands = []
            for band in range(bands_for(size, containment, certainty)):
                table, owners = np.zeros(1 << 16, bool), {}
                for i in members:
                    low = int(_band(self.shingles[i], band).min())
                    table[low >> 48] = True
                    owners.setdefault(low, []).append(i)
                bands.append((table, owners))
            self.classes.append((size, members, bands))
        #: How many bands each shingle size needs.
        self.bands: dict[int, int] = {}
        for size, _, bands in self.classes:
            self.bands[shingle_size(size)] = max(self.bands.get(shingle_size(size), 0), len(bands))


def _band(shingles: np.ndarray, band: int) -> np.ndarray:
    """The shingles, which are hashes already, in the order of one more hash."""
    factor = mixed(np.array([band], np.uint64) + MULTIPLIER)[0] | np.uint64(1)
    with np.errstate(over="ignore"):
        return shingles * factor


@lru_cache(maxsize=2)
def _prepared(templates: tuple[tuple[str, str], ...], containment: float, certainty: float) -> _Templates:
    return _Templates(templates, containment, certainty)


def _windows(words: Words, shingle: int, size: int, step: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, first and last (exclusive) word of every window; the last windows of a text are shorter."""
    counts = np.diff(words.starts)
    n = np.where(counts >= shingle, (counts - shingle) // step + 1, 0)
    text = np.repeat(np.arange(len(counts)), n)
    nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    first = words.starts[text] + nth * step
    return text, first, np.minimum(first + size, words.starts[text + 1])


def _places(windows: list[tuple[float, int, int]]) -> Iterator[tuple[float, int, int]]:
    """The first of the best of each run of overlapping windows (share, start, words), which are ordered by start."""
    best, end = windows[0], windows[0][1] + windows[0][2]
    for window in windows[1:]:
        if window[1] >= end:
            yield best
            best = window
        elif window[0] > best[0]:
            best = window
        end = window[1] + window[2]
    yield best


def _scan(batches: Iterator[pa.RecordBatch], templates, containment: float, certainty: float) -> Iterator[pa.RecordBatch]:
    known = _prepared(templates, containment, certainty)
    for batch in batches:
        for rows in slices(batch):
            words = Words(rows.column("text"), PUNCTUATION, lower=True)
            hashes, none, runs = words.hashes(), np.uint64(2**64 - 1), {}
            for n, count in known.bands.items():
                own = run_hashes(hashes, n)
                runs[n] = own, [np.append(_band(own, b), none) for b in range(count)]
            verified: dict[tuple[int, int], list[tuple[float, int, int]]] = {}
            for size, _, bands in known.classes:
                length = shingle_size(size)
                shingles, values = runs[length]
                text, first, last = _windows(words, length, *window_size(size))
                if not len(first):
                    continue
                edges = np.minimum(np.stack([first, last - length + 1], axis=1).ravel(), len(shingles))
                meets: set[tuple[int, int]] = set()
                for band, (table, owners) in enumerate(bands):
                    lows = np.minimum.reduceat(values[band], edges)[::2]
                    for i in np.flatnonzero(table[(lows >> np.uint64(48)).astype(np.int64)]).tolist():
                        meets.update((i, template) for template in owners.get(int(lows[i]), ()))
                for i, template in sorted(meets):
                    own = shingles[first[i] : last[i] - length + 1]
                    wanted = known.shingles[template]
                    share = np.isin(wanted, own).sum() / len(wanted)
                    if share >= containment:
                        start = int(first[i] - words.starts[text[i]])
                        window = float(share), start, int(last[i] - first[i])
                        verified.setdefault((int(text[i]), template), []).append(window)
            places = [(*key, *place) for key in sorted(verified) for place in _places(verified[key])]
            if places:
                yield pa.RecordBatch.from_arrays(
                    [
                        rows.column("doc_id").take(pa.array([p[0] for p in places])),
                        pa.array([known.names[p[1]] for p in places]),
                        pa.array([p[2] for p in places]),
                        pa.array([p[3] for p in places], pa.int32()),
                        pa.array([p[4] for p in places], pa.int32()),
                    ],
                    names=[c.split()[0] for c in _SCHEMA.split(", ")],
                )


def find_licenses(
    docs: DataFrame,
    templates: dict[str, str] | None = None,
    containment: float = CONTAINMENT,
    certainty: float = CERTAINTY,
) -> DataFrame:
    """Which texts hold which license notices.

    Needs ``doc_id`` and ``text``; other columns are ignored. Words are runs of letters, digits
    and non-ASCII characters, in lower case; shingles are five words, or all words of a template
    with fewer. Returns one row per input row, template and place that holds ``containment`` or
    more of it: (doc_id, license, containment, start_word, n_words). A place is a run of
    overlapping windows, and its row the first of those that hold most; notices so close that
    their windows overlap are one place. Texts that are null, empty or shorter than every
    template's shingles hold none; repeated rows give repeated rows. ``templates`` (name to text
    of three words or more; else ``TEMPLATES`` and ``SHORT_TEMPLATES``) are held by every task.
    """
    chosen = tuple(sorted((templates or TEMPLATES | SHORT_TEMPLATES).items()))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(
        partial(_scan, templates=chosen, containment=containment, certainty=certainty), _SCHEMA
    )
