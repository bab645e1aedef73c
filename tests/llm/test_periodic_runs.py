import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from zonalpanel.llm import periodic_runs, queries


def brute(words, min_words=24, power=3):
    """All runs by comparing every place with every lag; of equal stretches the smallest period."""
    n, best = len(words), {}
    for q in range(1, n // power + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(min_words, power * q):
                best.setdefault((i, j + q), q)
            i = j
    return sorted((a, b - a, q) for (a, b), q in best.items())


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def collapsed(words, runs):
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def hashed(texts):
    hashes = np.array([zlib.crc32(w.encode()) for t in texts for w in t], np.uint64)
    return hashes, np.cumsum([0, *map(len, texts)])


def random_texts(seed):
    rng = random.Random(seed)
    texts = []
    for _ in range(60):
        words = []
        while len(words) < rng.randint(0, 400):
            unit = [rng.choice("ab" if rng.random() < 0.7 else "abcdefgh") for _ in range(rng.choice([1, 2, 3, 7, 8, 9, 15, 16, 17, 31, 33, 60]))]
            if rng.random() < 0.4:  # a period whose parts occur more than once in it
                unit = unit * 2 + unit[: len(unit) // 2] * 2
            words += (unit * 9)[: rng.randint(1, 5 * len(unit))]
            words += [rng.choice("abc") for _ in range(rng.choice([0, 0, 1, 3]))]
        texts.append(words)
    return texts


@pytest.mark.parametrize("seed", range(6))
def test_same_as_brute_force(seed):
    texts = [*random_texts(seed), [], ["a"] * 23, ["a"] * 24, ["a", "b"] * 300, list("abcdefgh") * 3, list("abcdefghi") * 3]
    found = periodic_runs.find(*hashed(texts))
    assert [tuple(r) for r in found.tolist()] == [(k, *r) for k, t in enumerate(texts) for r in brute(t)]


@pytest.mark.parametrize(("min_words", "power"), [(1, 3), (6, 3), (10, 4), (100, 5)])
def test_other_limits(min_words, power):
    texts = random_texts(9)[:25]
    found = periodic_runs.find(*hashed(texts), min_words, power)
    assert [tuple(r) for r in found.tolist()] == [(k, *r) for k, t in enumerate(texts) for r in brute(t, min_words, power)]


def test_long_periods_whose_grams_recur_inside():
    rng = random.Random(5)
    x, y = ([rng.choice("abcd") for _ in range(n)] for n in (40, 47))
    texts = [(x + x + y + y) * 3, (x + y + x + x + y) * 4 + x, [w for _ in range(5) for w in x + ["z"] + x + ["v"]]]
    found = periodic_runs.find(*hashed(texts))
    assert [tuple(r) for r in found.tolist()] == [(k, *r) for k, t in enumerate(texts) for r in brute(t)]


def test_a_very_repetitive_long_text_makes_few_seeds():
    hashes, starts = hashed([["a"] * 300_000 + list("bc") * 100_000])
    assert periodic_runs.find(hashes, starts).tolist() == [[0, 0, 300_000, 1], [0, 300_000, 200_000, 2]]
    assert sum(len(b) for _, b, _ in periodic_runs._seeds(hashes, np.zeros(500_000, int), np.full(500_000, 500_000), 16)) < 500_000


def test_rows_of_a_table(documents, corpus):
    rows = [(i, t) for i, t in corpus if i != 73] + [(80, "x y " * 30 + "z"), (80, "x y " * 30 + "z"), (81, "é ü\n" * 12)]
    got = sorted(map(str, periodic_runs.find_runs(documents(rows)).collect()))
    expected = []
    for i, text in rows:
        words = split(text)
        runs = brute(words)
        expected.append((i, len(words), runs, collapsed(words, runs)))
    assert len(got) == len(expected)
    found = [
        (r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed_text)
        for r in periodic_runs.find_runs(documents(rows)).collect()
    ]
    assert sorted(found, key=str) == sorted(expected, key=str)


def test_query_same_as_brute_force(spark, tmp_path, documents, corpus):
    rows = [r for r in corpus if r[0] is not None and r[0] != 73]
    rows = [(1000 * k + i, t) for k in range(3) for i, t in rows]
    documents(rows).write.parquet(f"{tmp_path}/documents.parquet")
    expected = []
    planted = 0
    for i, text in rows:
        words, h = split(text), zlib.crc32(str(i).encode())
        n, g = len(words), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if k < a else words[a + (k - a) % p] for k, w in enumerate(words)]
            planted += 1
        runs = brute(words)
        best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
        lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
        expected.append(
            (i, len(runs), *(best or (None, None, None)), 1000 * best[1] // best[2] if best else None)
            + tuple(hashlib.sha256(x.encode()).hexdigest() for x in (lines, collapsed(words, runs)))
        )
    assert planted > 10
    got = [tuple(r) for r in queries.op11_periodic_runs(spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted(expected, key=str)


def test_empty_table(documents):
    assert periodic_runs.find_runs(documents([])).count() == 0
    assert periodic_runs.with_planted_runs(documents([])).count() == 0
