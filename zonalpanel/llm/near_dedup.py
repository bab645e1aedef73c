"""Near-equal documents by improved consistent weighted sampling over TF-IDF shingles.

A shingle (five words in a row, letters lower-cased) weighs its count in the document times
its inverse document frequency. Document frequencies are counted over all documents in a
sketch of two rows of ``CELLS`` cells, of which the smaller one counts. A cell holds about
(distinct shingles of a document) / ``CELLS`` of all documents beside the shingle's own, so what
is sent to tasks has one size for any table. Shingles of less than ``RARE`` of the documents
weigh alike, which that error does not reach: common passages count for little, but a group
of copies does not make its own shingles light.

A sample is the shingle, and the step of its weight, that comes first by random numbers of
its own (two from Gamma(2, 1), one uniform); two documents share it with a probability of their
weighted Jaccard similarity (Ioffe, 2010). Samples are banded; documents that share a band
meet, and a link counts if the weighted Jaccard similarity of the whole texts, with weights as
they are, reaches the threshold.

Documents with the same words are one class before anything is compared. In a bucket every
class is verified against the smallest one; only where that leaves a bucket with several
components are all its classes compared, as products of shingle matrices of two blocks, which
give star links. No bucket is capped and no list of a bucket's pairs is made. Joins that carry
texts or shingles are sort-merge joins at every size, and each table goes after its last reader.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, partial
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zonalpanel.session import discard

from .common import free_name, settled
from .components import components, stars
from .words import MULTIPLIER, Words, gathered, mixed, run_hashes, slices

SHINGLE = 5
THRESHOLD = 0.8
#: Two documents with a similarity of 0.8 share a band with a probability of 0.998.
BANDS, BAND_ROWS = 12, 4
SAMPLES = BANDS * BAND_ROWS
#: Cells of each of the two rows of the sketch of document frequencies.
CELLS = 1 << 16
#: Share of documents below which a shingle is as heavy as one found once.
RARE = 0.01
#: Shingles of a block of classes that is compared with others of its bucket.
BLOCK_SHINGLES = 400_000
#: Classes of such a block, and of the pieces of it that are multiplied at a time.
BLOCK_MEMBERS, PIECE_MEMBERS = 8_000, 2_000

#: Shingles that are hashed at a time.
_CHUNK = 1 << 14
_COLUMNS = 4096
_COUNT = (1 << 32) - 1
_SIGNATURES = "row_a long, row_b long, doc_id long, words_a long, words_b long, samples array<int>"


def _cells(shingle: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The cell of each shingle in both rows of the sketch."""
    spread = mixed(shingle)
    return (spread >> np.uint64(48)).astype(np.int64), (spread >> np.uint64(32) & np.uint64(CELLS - 1)).astype(np.int64)


def _shingles(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, shingle hash and count of each distinct shingle, ordered by text and hash.

    A text of fewer than five words is one shingle.
    """
    hashes, counts = words.hashes(), np.diff(words.starts)
    text, shingle = [], []
    for size in range(1, SHINGLE + 1):
        runs = run_hashes(hashes, size)
        owner = np.repeat(np.arange(len(counts)), counts)[: len(runs)]
        fits = np.arange(len(runs)) + size <= words.starts[owner + 1]
        at = np.flatnonzero(fits & ((counts[owner] == size) | (size == SHINGLE)))
        text.append(owner[at])
        shingle.append(runs[at])
    text, shingle = np.concatenate(text), np.concatenate(shingle)
    order = np.lexsort((shingle, text))
    text, shingle = text[order], shingle[order]
    first = np.flatnonzero(np.append(True, (shingle[1:] != shingle[:-1]) | (text[1:] != text[:-1])) if len(text) else [])
    return text[first], shingle[first], np.diff(np.append(first, len(text)))


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many of the task's documents hold a shingle of each cell; cell -1 counts documents."""
    total, docs = np.zeros(2 * CELLS, np.int64), 0
    for batch in batches:
        for rows in slices(batch):
            _, shingle, _ = _shingles(Words(rows.column("text"), lower=True))
            one, two = _cells(shingle)
            total += np.bincount(np.concatenate([one, CELLS + two]), minlength=2 * CELLS)
            docs += rows.num_rows
    used = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.append(used, -1)), pa.array(np.append(total[used], docs))], names=["cell", "n"]
    )


def inverse_frequencies(docs: DataFrame) -> np.ndarray:
    """log2(1 + documents / documents counted in the cell, ``RARE`` of all at least) of both rows of cells, over all documents.

    The driver holds ``2 * CELLS`` numbers, whatever the size of the table.
    """
    counts = docs.select("text").mapInArrow(_frequencies, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    found = counts.toArrow()
    cell, n = found["cell"].to_numpy(), found["n"].to_numpy()
    total = int(n[cell < 0].sum())
    held = np.ones(2 * CELLS)
    held[cell[cell >= 0]] = n[cell >= 0]
    held = np.maximum(held, RARE * total)
    return np.log2(1 + total / held).astype(np.float32).reshape(2, CELLS)


def _idf(shingle: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """The inverse document frequency of each shingle; at least a positive number."""
    one, two = _cells(shingle)
    return np.maximum(np.maximum(idf[0][one], idf[1][two]), 1e-6).astype(np.float64)


@lru_cache(maxsize=1)
def _randoms() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A seed for each sample; r, 1 / r and log(c) by 16 random bits, r and c from Gamma(2, 1)."""
    seeds = np.random.Generator(np.random.PCG64(20240229)).integers(0, 1 << 63, SAMPLES).astype(np.uint64)
    chance = (np.arange(1 << 16) + 0.5) / (1 << 16)
    low, high = np.zeros(len(chance)), np.full(len(chance), 64.0)
    for _ in range(60):  # the chance of at most x is 1 - (1 + x) exp(-x)
        middle = (low + high) / 2
        less = 1 - (1 + middle) * np.exp(-middle) < chance
        low, high = np.where(less, middle, low), np.where(less, high, middle)
    return seeds, high.astype(np.float32), (1 / high).astype(np.float32), np.log(high).astype(np.float32)


def _samples(text: np.ndarray, shingle: np.ndarray, weight: np.ndarray, texts: int) -> np.ndarray:
    """The samples of each text (zeros for texts without shingles).

    With r and c from Gamma(2, 1) and b from U(0, 1), all from a hash of shingle and sample,
    t = floor(ln(weight) / r + b) and the arrival is ln(c) - r (t - b + 1); the sample is the
    shingle that arrives first, and its t.
    """
    result = np.zeros((texts, SAMPLES), np.int32)
    best = np.full((texts, SAMPLES), np.inf, np.float32)
    seeds, gamma, inverse, log_gamma = _randoms()
    height = np.log(weight).astype(np.float32)
    for at in range(0, len(text), _CHUNK):
        part = slice(at, at + _CHUNK)
        owner, own, log_weight = text[part], shingle[part], height[part]
        heads = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
        sizes, rows = np.diff(np.append(heads, len(owner))), owner[heads]
        for k in range(SAMPLES):
            bits = mixed(own ^ seeds[k]).view(np.uint16).reshape(-1, 4)
            which = bits[:, 0].astype(np.intp)
            r, b = gamma[which], (bits[:, 1] + np.float32(0.5)) * np.float32(2.0**-16)
            t = np.floor(log_weight * inverse[which] + b)
            arrival = log_gamma[bits[:, 2].astype(np.intp)] - r * (t - b + np.float32(1))
            lows = np.minimum.reduceat(arrival, heads)
            first = np.flatnonzero(arrival == np.repeat(lows, sizes))
            if len(first) > len(heads):  # of equal arrivals the first
                first = first[np.append(True, owner[first][1:] != owner[first][:-1])]
            with np.errstate(over="ignore"):
                value = mixed(own[first] + t[first].astype(np.int64).view(np.uint64) * MULTIPLIER)
            sooner = lows < best[rows, k]
            best[rows[sooner], k] = lows[sooner]
            result[rows[sooner], k] = value[sooner].view(np.int64).astype(np.int32)
    return result


def _sign(batches: Iterator[pa.RecordBatch], idf: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A digest of all words and the samples of each text; no digest for texts without words."""
    for batch in batches:
        for rows in slices(batch):
            words = Words(rows.column("text"), lower=True)
            hashes = words.hashes()
            counts = np.diff(words.starts)
            text, shingle, times = _shingles(words)
            samples = _samples(text, shingle, times * _idf(shingle, idf), rows.num_rows)
            digests = []
            for seed in (3, 5):  # sums over words, each mixed with its place in the text
                place = np.arange(len(hashes)) - np.repeat(words.starts[:-1], counts)
                with np.errstate(over="ignore"):
                    terms = mixed(mixed(hashes * np.uint64(seed)) + place.astype(np.uint64) * MULTIPLIER)
                    total = np.append(np.uint64(0), np.cumsum(terms, dtype=np.uint64))
                    value = mixed(total[words.starts[1:]] - total[words.starts[:-1]] + counts.astype(np.uint64))
                digests.append(pa.array(value.view(np.int64), mask=counts == 0))
            yield pa.RecordBatch.from_arrays(
                [
                    *[rows.column(n) for n in ("row_a", "row_b", "doc_id")],
                    *digests,
                    pa.array(list(samples), pa.list_(pa.int32())),
                ],
                names=["row_a", "row_b", "doc_id", "words_a", "words_b", "samples"],
            )


def _weighted(text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    words = Words(pa.array([text]), lower=True)
    _, shingle, times = _shingles(words)
    return shingle, times * _idf(shingle, idf)


def similarity(a: str, b: str, idf: np.ndarray) -> float:
    """The weighted Jaccard similarity of two texts; 0 if either has no words."""
    (x, wx), (y, wy) = _weighted(a, idf), _weighted(b, idf)
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    both = np.minimum(wx[i], wy[j]).sum()
    total = wx.sum() + wy.sum() - both
    return float(both / total) if total else 0.0


def _verify(batches: Iterator[pa.RecordBatch], idf: np.ndarray, threshold: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows in slices(batch, "text_u"):
            good = [
                similarity(a, b, idf) >= threshold
                for a, b in zip(rows.column("text_u").to_pylist(), rows.column("text_v").to_pylist(), strict=True)
            ]
            yield rows.select(["u", "v"]).filter(pa.array(good, pa.bool_()))


def _verified(pairs: DataFrame, texts: DataFrame, idf: np.ndarray, threshold: float, label: str) -> DataFrame:
    """The pairs (u, v) of classes whose texts reach the threshold."""
    side = lambda c: texts.select(F.col("class_id").alias(c), F.col("text").alias(f"text_{c}"))
    both = pairs.hint("merge").join(side("u"), "u").hint("merge").join(side("v"), "v").select("u", "v", "text_u", "text_v")
    return settled(both.mapInArrow(partial(_verify, idf=idf, threshold=threshold), "u long, v long"), label)


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shingles (64-bit) and their counts (32-bit) of each class, as bytes, and how many there are."""
    for batch in batches:
        for rows in slices(batch):
            text, shingle, times = _shingles(Words(rows.column("text"), lower=True))
            ends = np.searchsorted(text, np.arange(rows.num_rows + 1))
            spans = list(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True))
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column("class_id"),
                    pa.array(np.diff(ends), pa.int64()),
                    pa.array([shingle[x:y].tobytes() for x, y in spans], pa.binary()),
                    pa.array([times[x:y].astype("<u4").tobytes() for x, y in spans], pa.binary()),
                ],
                names=["class_id", "n", "shingles", "counts"],
            )


class _Block:
    """Classes of a bucket with their shingles: arrays over all shingles, and over classes."""

    def __init__(self, members: list[dict], idf: np.ndarray):
        self.ids = np.array([m["class_id"] for m in members], np.int64)
        self.component = np.array([m["component"] for m in members], np.int64)
        self.shingle = np.frombuffer(b"".join(m["shingles"] for m in members), np.uint64)
        self.count = np.frombuffer(b"".join(m["counts"] for m in members), "<u4").astype(np.int64)
        self.owner = np.repeat(np.arange(len(members)), [len(m["counts"]) // 4 for m in members])
        self.total = np.bincount(self.owner, self.count * _idf(self.shingle, idf), len(members))


def _shared_weight(x: _Block, y: _Block, idf: np.ndarray) -> np.ndarray:
    """The sum of the smaller weights over the shingles that two classes share, for all pairs of classes.

    The counts that a shingle has in the two blocks are steps; a weight is the sum of those up
    to the class's count, and a smaller weight that of the steps both reach: a product of
    matrices with a row for each class and a column for each step.
    """
    both = np.intersect1d(x.shingle, y.shingle)
    result = np.zeros((len(x.ids), len(y.ids)))
    if not len(both):
        return result
    sides = []
    for block in (x, y):
        place = np.minimum(np.searchsorted(both, block.shingle), len(both) - 1)
        known = both[place] == block.shingle
        code = place[known] << 32 | block.count[known]
        order = np.argsort(code, kind="stable")
        sides.append((block.owner[known][order], code[order]))
    steps = np.unique(np.concatenate([code for _, code in sides]))
    place, count = steps >> 32, steps & _COUNT
    before = np.append(0, np.where(place[1:] == place[:-1], count[:-1], 0))
    weight = _idf(both, idf)[place] * (count - before)
    spans = []
    for owner, code in sides:
        last = np.searchsorted(steps, code)
        spans.append((owner, np.searchsorted(place, code >> 32), last))
    for low in range(0, len(steps), _COLUMNS):
        high = min(low + _COLUMNS, len(steps))
        dense = []
        for (owner, first, last), block in zip(spans, (x, y), strict=True):
            within = slice(np.searchsorted(last, low), np.searchsorted(first, high))
            begin = np.maximum(first[within], low) - low
            size = np.minimum(last[within], high - 1) - low - begin + 1
            matrix = np.zeros((len(block.ids), high - low))
            matrix[np.repeat(owner[within], size), gathered(begin, size)] = 1
            dense.append(matrix)
        result += (dense[0] * weight[low:high]) @ dense[1].T
    return result


def _linked(batches: Iterator[pa.RecordBatch], idf: np.ndarray, threshold: float) -> Iterator[pa.RecordBatch]:
    """Star links between the components in two blocks of a bucket, every pair of classes compared."""
    for batch in batches:
        for part in range(batch.num_rows):
            row = batch.slice(part, 1).to_pylist()[0]
            pieces = [
                [_Block(m[k : k + PIECE_MEMBERS], idf) for k in range(0, len(m), PIECE_MEMBERS)] for m in (row["x"], row["y"])
            ]
            for x, y in product(*pieces):
                shared = _shared_weight(x, y, idf)
                linked = shared >= threshold * (x.total[:, None] + y.total[None, :] - shared)
                linked &= x.component[:, None] != y.component[None, :]
                if not linked.any():
                    continue
                i, j = np.flatnonzero(linked.any(axis=1)), np.flatnonzero(linked.any(axis=0))
                rows, columns = stars(linked[np.ix_(i, j)])
                u, v = np.concatenate([x.ids[i], y.ids[j]]), x.ids[i][np.concatenate([rows, columns])]
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])


def _rest(members: DataFrame, labels: DataFrame, texts: DataFrame, idf: np.ndarray, threshold: float) -> DataFrame:
    """Links in buckets whose classes are not yet all in one component.

    Classes outside a bucket's largest component meet all its classes; within that component
    nothing is left to find. A bucket of two was settled when its leader was compared.
    """
    labelled = members.join(labels, F.col("class_id") == F.col("node"), "left").select(
        "bucket", "class_id", F.coalesce("component", "class_id").alias("component")
    )
    labelled = settled(labelled, "labelled-members")
    parts = labelled.groupBy("bucket", "component").agg(F.count("*").alias("n"))
    several = settled(
        parts.groupBy("bucket")
        .agg(F.sum("n").alias("members"), F.count("*").alias("components"), F.max_by("component", "n").alias("major"))
        .where("components > 1 and members > 2")
        .select("bucket", "major"),
        "open-buckets",
    )
    opened = settled(labelled.join(several, "bucket"), "open-members")
    discard(labelled, several)
    wanted = settled(opened.select("class_id").distinct(), "open-classes")
    features = settled(
        texts.join(wanted.hint("merge"), "class_id").mapInArrow(
            _featured, "class_id long, n long, shingles binary, counts binary"
        ),
        "open-features",
    )
    minor = F.col("component") != F.col("major")
    sized = opened.join(features.select("class_id", "n"), "class_id").groupBy("bucket").agg(
        F.sum("n").alias("n"),
        F.sum(F.when(minor, F.col("n"))).alias("n_minor"),
        F.count("*").alias("n_members"),
        F.count_if(minor).alias("n_minor_members"),
    )

    def count(side: str) -> Column:
        by_size = F.greatest(F.col(side) / BLOCK_SHINGLES, F.col(f"{side}_members") / BLOCK_MEMBERS)
        return F.greatest(F.ceil(by_size), F.lit(1)).cast("int").alias(f"{side}_blocks")

    sizes = settled(sized.select("bucket", count("n"), count("n_minor")), "open-sizes")
    full = settled(opened.join(sizes, "bucket").withColumn("minor", minor).drop("major"), "sized-members")
    member = F.struct("class_id", "component", "shingles", "counts")

    def blocks(rows: DataFrame, count: str) -> DataFrame:
        """Members with their shingles, gathered by a hash into blocks of about the same size."""
        number = F.pmod(F.xxhash64("class_id", "bucket"), F.col(count)).cast("int")
        keyed = rows.hint("merge").join(features, "class_id").withColumn("block", number)
        return keyed.groupBy("bucket", "block", "n_blocks").agg(F.collect_list(member).alias("members"))

    left = blocks(full.where("minor"), "n_minor_blocks").select(
        "bucket", F.col("members").alias("x"), F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)).alias("block")
    )
    right = blocks(full, "n_blocks").select("bucket", "block", F.col("members").alias("y"))
    pairs = left.hint("merge").join(right, ["bucket", "block"]).select("x", "y")
    compare = partial(_linked, idf=idf, threshold=threshold)
    links = settled(pairs.mapInArrow(compare, "u long, v long").distinct(), "other-links")
    discard(opened, wanted, features, sizes, full)
    return links


def _row_keys(a: str = "row_a", b: str = "row_b") -> list[Column]:
    values = [F.col("doc_id").cast("long"), F.col("text")]
    return [F.xxhash64(*values).alias(a), F.xxhash64(F.lit("row"), *values).alias(b)]


def near_classes(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The class of near-equal documents of each row, linked directly or through others.

    Needs ``doc_id`` and ``text``; other columns are ignored. Returns one row per input row:
    (row_a, row_b, doc_id, class_id, keeper). ``class_id`` is the smallest doc_id of the class
    (null only if all are null); ``keeper`` marks the rows that hold the class's smallest
    doc_id, and of different texts under that id one. ``row_a`` and ``row_b`` hash doc_id and
    text; equal rows have equal hashes and are all keepers or none. Words are runs of anything
    but the blank and bytes 9 to 13; texts with fewer than five are one shingle, and texts
    without words (null, empty, blank) link with nothing. Texts of any length are compared whole.
    An empty table gives no rows.
    """
    texts = docs.select(*_row_keys(), F.col("doc_id").cast("long").alias("doc_id"), "text")
    idf = inverse_frequencies(texts)
    signatures = settled(texts.mapInArrow(partial(_sign, idf=idf), _SIGNATURES), "signatures")
    signed = settled(signatures.drop("samples"), "signed-rows")
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_a", "row_b")
    classes = settled(
        signatures.where("words_a is not null")
        .groupBy("words_a", "words_b")
        .agg(F.min(order).alias("low"), F.first("samples").alias("samples"))
        .withColumn("class_id", F.monotonically_increasing_id()),
        "word-classes",
    )
    discard(signatures)
    bands = [
        F.xxhash64(F.lit(b), *[F.col("samples")[b * BAND_ROWS + i] for i in range(BAND_ROWS)]) for b in range(BANDS)
    ]
    banded = classes.select("class_id", F.explode(F.array(*bands)).alias("bucket"))
    shared = settled(
        banded.groupBy("bucket")
        .agg(F.count("*").alias("n"), F.min("class_id").alias("leader"))
        .where("n > 1")
        .select("bucket", "leader"),
        "shared-buckets",
    )
    members = settled(banded.join(shared, "bucket").select("bucket", "class_id", "leader"), "bucket-members")
    pairs = settled(
        members.where("class_id != leader").select(F.col("class_id").alias("u"), F.col("leader").alias("v")).distinct(),
        "leader-pairs",
    )
    discard(shared)
    wanted = settled(
        members.select("class_id")
        .distinct()
        .join(classes.select("class_id", "low.row_a", "low.row_b"), "class_id")
        .select("class_id", "row_a", "row_b"),
        "bucket-rows",
    )
    candidates = settled(
        texts.select("row_a", "row_b", "text")
        .join(wanted.hint("merge"), ["row_a", "row_b"])
        .groupBy("row_a", "row_b", "class_id")
        .agg(F.first("text").alias("text"))
        .select("class_id", "text"),
        "candidate-texts",
    )
    discard(wanted)
    first = _verified(pairs, candidates, idf, threshold, "leader-links")
    discard(pairs)
    labels = settled(components(first), "leader-components")
    others = _rest(members, labels, candidates, idf, threshold)
    discard(members, labels, candidates)
    labels = settled(components(first.unionByName(others)), "components")
    discard(first, others)

    named = classes.join(labels, F.col("class_id") == F.col("node"), "left").withColumn(
        "component", F.coalesce("component", "class_id")
    )
    named = settled(named.select("component", "words_a", "words_b", "low"), "named-classes")
    discard(classes, labels)
    lows = settled(named.groupBy("component").agg(F.min("low").alias("first")), "class-lows")
    results = settled(
        named.join(lows, "component").select("words_a", "words_b", "first"),
        "class-results",
    )
    discard(named, lows)
    found = signed.join(results, ["words_a", "words_b"], "left")
    alone = F.col("first").isNull()
    keeps = (F.col("row_a") == F.col("first.row_a")) & (F.col("row_b") == F.col("first.row_b"))
    return found.select(
        "row_a",
        "row_b",
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("class_id"),
        (alone | keeps).alias("keeper"),
    )


def drop_near_copies(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with one row of each class of near-equal documents, all columns unchanged.

    Documents without words (null, empty, blank) all stay. Of equal rows of a class one stays, of
    rows equal in doc_id and text that differ elsewhere any one; a class whose doc_ids are all null
    keeps one row too. Texts of any length are compared whole; columns of any names are kept; an
    empty table gives no rows.
    """
    a, b, whole = (free_name(n, docs.columns) for n in ("row_a", "row_b", "whole"))
    keep = settled(
        near_classes(docs, threshold).where("keeper").select(F.col("row_a").alias(a), F.col("row_b").alias(b)).distinct(),
        "kept-rows",
    )
    columns = [F.col(f"`{c}`") for c in docs.columns]
    wordless = F.btrim(F.coalesce("text", F.lit("")), F.lit(" \t\n\v\f\r")) == ""
    keyed = docs.where(~wordless).select(*_row_keys(a, b), F.struct(*columns).alias(whole))
    # one of the equal rows, taken before the shuffle where they stand together
    single = keyed.groupBy(a, b).agg(F.first(whole).alias(whole))
    kept = single.join(keep.hint("merge"), [a, b]).select(*[F.col(f"`{whole}`.`{c}`") for c in docs.columns])
    return kept.unionAll(docs.where(wordless))
