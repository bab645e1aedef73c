"""A toxicity classifier that does not react to who a sentence is about.

A logistic regression on words and word beginnings is fitted to labelled texts. Sentences of
these texts that name an identity are rewritten with another identity of the same group; a
sentence that names none gets one placed in it. The squared difference of the scores (before
the logistic function) of a sentence and its counterfactual is part of the loss, so that
neither naming a group nor which one it is raises a score. The terms themselves are always
among the model's features, so that the penalty has pairs on any table.

The fit uses a bounded sample of labelled rows (``PER_CLASS`` of each class, chosen by a hash
of the id) and keeps at most ``MAX_FEATURES`` features beside those of the terms; scoring
streams over the whole table and shuffles nothing.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name, settled, without
from .words import slices

PER_CLASS = 8000
MAX_FEATURES = 20_000
#: Least evidence for a feature: its log odds over their standard error, and the rows that have it.
MIN_Z, MIN_ROWS = 4.0, 3
L2 = 1e-4
FAIRNESS = 1.0
ROUNDS = 300
HASH_BUCKETS = 1 << 20
PREFIXES = range(3, 9)
FOLDS = 5
#: Terms within a group stand for one another; English, French, German and Spanish.
IDENTITY_GROUPS: tuple[tuple[str, ...], ...] = (
    ("women", "men"),
    ("woman", "man"),
    ("girls", "boys"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("black", "white", "asian", "latino"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("immigrants", "citizens", "refugees"),
    ("disabled", "deaf", "blind"),
    ("old", "young"),
    ("africans", "americans", "europeans", "mexicans"),
    ("femmes", "hommes"),
    ("filles", "garçons"),
    ("musulmans", "chrétiens", "juifs", "hindous", "bouddhistes", "athées"),
    ("noirs", "blancs", "asiatiques", "arabes"),
    ("homosexuels", "hétérosexuels", "lesbiennes", "transgenres"),
    ("immigrés", "réfugiés", "citoyens"),
    ("africains", "américains", "européens", "mexicains"),
    ("frauen", "männer"),
    ("mädchen", "jungen"),
    ("muslime", "christen", "juden", "hindus", "buddhisten", "atheisten"),
    ("schwarze", "weiße", "asiaten", "araber"),
    ("schwule", "lesben", "bisexuelle", "heterosexuelle"),
    ("einwanderer", "flüchtlinge", "bürger"),
    ("afrikaner", "amerikaner", "europäer", "mexikaner"),
    ("mujeres", "hombres"),
    ("chicas", "chicos"),
    ("musulmanes", "cristianos", "judíos", "hindúes", "budistas", "ateos"),
    ("negros", "blancos", "asiáticos", "árabes"),
    ("homosexuales", "heterosexuales", "lesbianas", "transexuales"),
    ("inmigrantes", "refugiados", "ciudadanos"),
    ("africanos", "americanos", "europeos", "mexicanos"),
)

_WORD = re.compile(r"\w+")
_SENTENCE = re.compile(r"[^.!?\n]+")
_CACHED = 300_000


def _buckets(word: str) -> list[int]:
    """Hash buckets of a word and of its beginnings."""
    names = ["=" + word, *("^" + word[:n] for n in PREFIXES if n <= len(word))]
    return [zlib.crc32(name.encode()) % HASH_BUCKETS for name in names]


class _Features:
    """The known features of texts, each once; words met before are looked up."""

    def __init__(self, known: dict[int, int] | None = None):
        self.known = known
        self.of_word: dict[str, tuple[int, ...]] = {}

    def __call__(self, text: str) -> set[int]:
        found: set[int] = set()
        for word in set(_WORD.findall(text.lower())):
            own = self.of_word.get(word)
            if own is None:
                own = tuple(_buckets(word))
                if self.known is not None:
                    own = tuple(self.known[b] for b in own if b in self.known)
                if len(self.of_word) > _CACHED:
                    self.of_word.clear()
                self.of_word[word] = own
            if own:
                found.update(own)
        return found


def _swaps(groups: Iterable[Iterable[str]]) -> dict[str, str]:
    """Each identity term and the next one of its group."""
    found: dict[str, str] = {}
    for group in groups:
        terms = list(group)
        found |= dict(zip(terms, terms[1:] + terms[:1], strict=True))
    return found


def counterfactuals(text: str, swaps: dict[str, str]) -> list[tuple[str, str]]:
    """The sentences of a text that name an identity, each with the identities swapped."""
    pairs = []
    for sentence in _SENTENCE.findall(text):
        other = _WORD.sub(lambda m: swaps.get(m[0].lower(), m[0]), sentence)
        if other != sentence:
            pairs.append((sentence, other))
    return pairs


def placements(text: str, terms: list[str]) -> list[tuple[str, str]]:
    """The sentences of a text that name no identity, each with one placed in it.

    Which of the terms it is, and after which word it comes, depends on the sentence alone.
    """
    pairs, named = [], set(terms)
    for sentence in _SENTENCE.findall(text):
        words = list(_WORD.finditer(sentence))
        if words and terms and not any(m[0].lower() in named for m in words):
            draw = zlib.crc32(sentence.encode())
            end = words[draw % len(words)].end()
            pairs.append((sentence, f"{sentence[:end]} {terms[draw // len(words) % len(terms)]}{sentence[end:]}"))
    return pairs


@dataclass(frozen=True)
class Model:
    """Hash buckets of the features, their weights, the constant, and how many counterfactual pairs were used."""

    buckets: list[int]
    weights: np.ndarray
    bias: float
    pairs: int = 0

    def score(self, found: Iterable[int]) -> float:
        """Between 0 and 1, from the features' numbers."""
        total = self.bias + float(self.weights[sorted(found)].sum())
        return float(1 / (1 + np.exp(-total))) if total > -700 else 0.0


def _class_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each bucket that occurs, how many of the task's rows of either class have it."""
    features = _Features()
    counts = np.zeros((2, HASH_BUCKETS), np.int64)
    for batch in batches:
        for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist(), strict=True):
            counts[label, list(features(text or ""))] += 1
    used = np.flatnonzero(counts.any(axis=0))
    yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts[0, used]), pa.array(counts[1, used])], names=["bucket", "clean", "toxic"])


def _rows(batches: Iterator[pa.RecordBatch], buckets: list[int], swaps: dict[str, str]) -> Iterator[pa.RecordBatch]:
    """Feature numbers of labelled texts, and those that only one of a sentence and its counterfactual has, with counts."""
    features = _Features({b: i for i, b in enumerate(buckets)})
    terms = sorted(swaps)
    ints = pa.list_(pa.int32())
    schema = pa.schema([("label", pa.int32()), ("plus", ints), ("minus", ints), ("n", pa.int64())])
    pairs: Counter[tuple[tuple[int, ...], tuple[int, ...]]] = Counter()
    for batch in batches:
        rows: list[dict] = []
        for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist(), strict=True):
            rows.append({"label": label, "plus": sorted(features(text or "")), "minus": [], "n": 1})
            for sentence, other in counterfactuals(text or "", swaps) + placements(text or "", terms):
                a, b = features(sentence), features(other)
                if a != b:
                    pairs[tuple(sorted(a - b)), tuple(sorted(b - a))] += 1
        yield pa.RecordBatch.from_pylist(rows, schema)
    found = [{"label": None, "plus": list(a), "minus": list(b), "n": n} for (a, b), n in pairs.items()]
    yield pa.RecordBatch.from_pylist(found, schema)


def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Members of all lists in a row, and the list that each belongs to."""
    sizes = np.array([len(x) for x in lists], np.int64)
    return np.array([i for x in lists for i in x], np.int64), np.repeat(np.arange(len(lists)), sizes)


def objective(
    rows: list[dict], weights_of: dict[int, float], size: int, fairness: float, l2: float
) -> Callable[[np.ndarray], tuple[float, np.ndarray]]:
    """The loss of weights (the constant last) and its gradient.

    The loss is the weighted mean logistic loss of the texts, half of ``l2`` times the squared
    weights, and ``fairness`` times the mean squared score change of the pairs.
    """
    texts = [r for r in rows if r["label"] is not None]
    pairs = [r for r in rows if r["label"] is None]
    feature, owner = _flat([r["plus"] for r in texts])
    label = np.array([r["label"] for r in texts], np.float64)
    share = np.array([weights_of[r["label"]] for r in texts])
    share /= share.sum()
    plus, plus_of = _flat([r["plus"] for r in pairs])
    minus, minus_of = _flat([r["minus"] for r in pairs])
    times = np.array([r["n"] for r in pairs], np.float64)
    times /= max(times.sum(), 1)

    def value(weight: np.ndarray) -> tuple[float, np.ndarray]:
        total = np.bincount(owner, weight[feature], len(texts)) + weight[-1]
        loss = (share * (np.logaddexp(0, total) - label * total)).sum() + l2 / 2 * (weight[:-1] ** 2).sum()
        slope = (1 / (1 + np.exp(-np.clip(total, -60, 60))) - label) * share
        gradient = np.append(np.bincount(feature, slope[owner], size) + l2 * weight[:-1], slope.sum())
        if pairs:
            gap = np.bincount(plus_of, weight[plus], len(pairs)) - np.bincount(minus_of, weight[minus], len(pairs))
            loss += fairness * (times * gap**2).sum()
            gap *= 2 * fairness * times
            gradient[:-1] += np.bincount(plus, gap[plus_of], size) - np.bincount(minus, gap[minus_of], size)
        return float(loss), gradient

    return value


def _descend(rows: list, weights_of: dict[int, float], size: int, fairness: float, l2: float, rounds: int) -> tuple[np.ndarray, float]:
    """Weights and constant by full-batch gradient descent with Adam's steps."""
    value = objective(rows, weights_of, size, fairness, l2)
    weight = np.zeros(size + 1)
    mean, square = np.zeros(size + 1), np.zeros(size + 1)
    for step in range(1, rounds + 1):
        _, gradient = value(weight)
        mean = 0.9 * mean + 0.1 * gradient
        square = 0.99 * square + 0.01 * gradient**2
        weight -= 0.1 * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
    return weight[:-1], float(weight[-1])


def remainder(doc_id: str | Column = "doc_id", folds: int = FOLDS) -> Column:
    """crc32 of the id's digits modulo ``folds``; rows with 0 are held out (a null id counts as no digits)."""
    text = (F.col(doc_id) if isinstance(doc_id, str) else doc_id).cast("long").cast("string")
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary")) % folds


def fit(
    docs: DataFrame,
    labels: DataFrame,
    label: str = "toxic",
    per_class: int = PER_CLASS,
    identity_groups: Iterable[Iterable[str]] = IDENTITY_GROUPS,
    fairness: float = FAIRNESS,
    max_features: int = MAX_FEATURES,
) -> Model:
    """Fit to labelled rows that are not held out.

    ``labels`` has doc_id and ``label`` (0 or 1; other values and nulls are skipped). At most
    ``per_class`` rows of each class are used, those with the smallest hashes of doc_id, and
    weighted so that the classes count as in all labelled rows. Where a doc_id repeats in
    ``docs`` one of its texts is used; null and empty texts have no features, texts of any length
    all of theirs. Without rows of both classes, or of any documents, the model is a constant.
    """
    swaps = _swaps(identity_groups)
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).where(
        "doc_id is not null and label in (0, 1)"
    )
    usable = usable.where(remainder() != 0).distinct()
    totals = {r["label"]: r["n"] for r in usable.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(totals) < 2:
        share = (totals.get(1, 0) + 1) / (sum(totals.values()) + 2)
        return Model([], np.zeros(0), float(np.log(share / (1 - share))))
    order = [F.xxhash64("doc_id"), "doc_id"]
    parts = [usable.where(F.col("label") == c).orderBy(*order).limit(per_class) for c in (0, 1)]
    chosen = F.broadcast(parts[0].unionByName(parts[1]))  # 2 * per_class rows of 12 bytes at most
    sample = settled(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        .join(chosen, "doc_id")
        .groupBy("doc_id", "label")
        .agg(F.min("text").alias("text")),
        "labelled-texts",
    )
    sizes = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        share = (totals[1] + 1) / (sum(totals.values()) + 2)
        return Model([], np.zeros(0), float(np.log(share / (1 - share))))

    def odds(name: str, total: int) -> Column:
        return F.log((F.col(name) + 0.5) / (total - F.col(name) + 0.5))

    counts = sample.select("text", "label").mapInArrow(_class_counts, "bucket long, clean long, toxic long")
    error = F.sqrt(1 / (F.col("toxic") + 0.5) + 1 / (F.col("clean") + 0.5))
    strong = (
        counts.groupBy("bucket")
        .agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
        .where(F.col("clean") + F.col("toxic") >= MIN_ROWS)
        .select("bucket", F.abs((odds("toxic", sizes[1]) - odds("clean", sizes[0])) / error).alias("z"))
        .where(F.col("z") >= MIN_Z)
        .orderBy(F.desc("z"), "bucket")
        .limit(max_features)
    )
    found = [r["bucket"] for r in strong.collect()]
    buckets = list(dict.fromkeys([*found, *(_buckets(term)[0] for term in sorted(swaps))]))
    featured = sample.select("text", "label").mapInArrow(
        partial(_rows, buckets=buckets, swaps=swaps), "label int, plus array<int>, minus array<int>, n long"
    )
    featured = settled(featured, "labelled-features")
    # equal pairs are one row: the terms' features, and the few that sentences share with them
    pairs = featured.where("label is null").groupBy("label", "plus", "minus").agg(F.sum("n").alias("n"))
    rows = featured.where("label is not null").unionByName(pairs).collect()
    weights_of = {c: totals[c] / sizes[c] for c in (0, 1)}
    weights, bias = _descend(rows, weights_of, len(buckets), fairness, L2, ROUNDS)
    return Model(buckets, weights, bias, sum(r["n"] for r in rows if r["label"] is None))


def _score(batches: Iterator[pa.RecordBatch], model: Model, text: int) -> Iterator[pa.RecordBatch]:
    """``text`` is the number of the text column."""
    features = _Features({b: i for i, b in enumerate(model.buckets)})
    for batch in batches:
        scores = [model.score(features(t or "")) for rows in slices(batch, text) for t in rows.column(text).to_pylist()]
        names = [*batch.schema.names, "score"]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=names)


def score(docs: DataFrame, model: Model, column: str = "score") -> DataFrame:
    """All rows and columns of ``docs`` with a score in ``column`` (0 to 1, higher for toxic texts).

    Only ``text`` is looked at; null and empty texts get the score of a text without features.
    A column of the score's name is replaced.
    """
    docs = without(docs, column)
    schema = T.StructType([*docs.schema.fields, T.StructField(column, T.DoubleType())])
    scored = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    inner = T.StructType([T.StructField(f"c{i}", f.dataType) for i, f in enumerate(docs.schema)])
    found = scored.mapInArrow(
        partial(_score, model=model, text=docs.columns.index("text")), inner.add("score", T.DoubleType())
    )
    return found.toDF(*schema.names)


def drop_toxic(docs: DataFrame, model: Model, limit: float = 0.5) -> DataFrame:
    """The rows of ``docs`` with a score under ``limit``, all columns unchanged."""
    column = free_name("score", docs.columns)
    return score(docs, model, column).where(F.col(f"`{column}`") < limit).drop(column)
