import math
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from zonalpanel.llm import lexical, queries

ITEM = "item_id long, text string, rank string, score string"


def terms_of(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lowered)


def brute(items, docs, top):
    """By scoring every document for every item."""
    counted = [(i, Counter(terms_of(t))) for i, t in docs]
    documents = sum(1 for _, c in counted if c)
    total = sum(sum(c.values()) for _, c in counted)
    held = Counter(t for _, c in counted for t in c)
    weight = {t: math.floor(1000 * math.log((2 * documents + 2) / (2 * n + 1))) for t, n in held.items()}
    wanted = defaultdict(set)
    for i, t in items:
        wanted[i] |= set(terms_of(t))
    rows = []
    for item, terms in wanted.items():
        scored = []
        for doc, counts in counted:
            n = sum(counts.values())
            score = 0
            for t in terms & set(counts):
                m = 50 + (50 * n * documents) // total
                score += weight[t] * ((10**9 * counts[t]) // (1000 * counts[t] + 20 * m))
            if score > 0:
                scored.append((-score, doc is not None, doc or 0, doc))
        scored.sort(key=lambda s: s[:3])
        rows += [(item, k + 1, s[3], -s[0]) for k, s in enumerate(scored[:top])]
    return sorted(rows, key=str)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(11)
    words = [f"w{k}" for k in range(400)]

    def text():
        return " ".join(rng.choice(words[: rng.choice([3, 30, 400])]) for _ in range(rng.randint(1, 80)))

    docs = [(k, text()) for k in range(900)] + [(k, "same words here W1") for k in range(900, 1000)]
    docs += [(1000, None), (1001, ""), (1002, "_-: \n"), (None, "w1 w2 w399"), (5, "w1 w1 w2"), (5, "w1 w1 w2"), (1003, "Ünï漢字 w7" * 50)]
    items = [(k, text()) for k in range(30)] + [(30, "same"), (31, "ünï Ünï漢字 w7"), (32, None), (33, "..."), (34, "absent"), (35, "w1 w1 W1")]
    items += [(None, "w5 w6"), (None, "w300"), (36, "w9"), (36, "w9"), (36, "w10")]
    return items, docs


def ranked(spark, documents, items, docs, top, tasks=5):
    frame = spark.createDataFrame([(i, t, "x", "y") for i, t in items], ITEM)
    found = lexical.rank(frame, documents(docs).repartition(tasks), top).collect()
    return sorted((tuple(r) for r in found), key=str)


def test_same_as_brute_force(spark, documents, texts):
    items, docs = texts
    assert ranked(spark, documents, items, docs, 50) == brute(items, docs, 50)


@pytest.mark.parametrize("window", [8, 64])
def test_many_shards_windows_and_blocks(spark, documents, texts, monkeypatch, window):
    items, docs = texts
    monkeypatch.setattr(lexical, "BLOCK_TERMS", 200)
    real = lexical._index, lexical._search

    def small(name):
        def run(batches, **given):
            lexical.WINDOW, lexical.SHARD_BYTES, lexical.SHORT_PART, lexical.LONG_TEXT = window, 4000, 16, 300
            return real[name](batches, **given)

        return run

    monkeypatch.setattr(lexical, "_index", small(0))
    monkeypatch.setattr(lexical, "_search", small(1))
    assert ranked(spark, documents, items, docs, 7) == brute(items, docs, 7)


def test_windows_are_skipped(texts):
    """Without Spark: most windows of the long lists are not looked at once good documents are known."""
    items, docs = texts
    hashes = np.unique(lexical._hashes(lexical.pa.array([t for _, t in items]))[0])
    big = [(k, "w1 w2 " + "w3 " * (k % 50)) for k in range(20_000)]
    big[7] = (7, "w1 w2 w399 w398")
    batch = lexical.pa.RecordBatch.from_pydict(
        {"doc_id": lexical.pa.array([k for k, _ in big]), "text": lexical.pa.array([t for _, t in big])}
    )
    row = next(lexical._index(iter([batch]), hashes)).to_pylist()[0]
    weight = np.zeros(len(hashes), np.int64)
    query = np.searchsorted(hashes, np.sort(lexical._hashes(lexical.pa.array(["w1 w2 w399"]))[0]))
    weight[query] = [10 if t in lexical._hashes(lexical.pa.array(["w1 w2"]))[0] else 9000 for t in hashes[query]]
    lists = lexical._Lists(row, lexical.Weights(1, 20_000, 600_000, weight))
    best = lexical._Best(1)
    best.add(np.array([1]), np.array([0]))
    looked, real = [], lists.of
    lists.of = lambda term: looked.append(term) or real(term)
    lexical._answer(lists, query, best)
    assert best.docs.tolist() == [7]
    assert len(looked) < 10 < lists.count / lexical.WINDOW


def test_long_texts_are_cut_between_terms(monkeypatch):
    monkeypatch.setattr(lexical, "LONG_TEXT", 10)
    text = "aa bb cccccccccccccccccccccccccc dd é漢字é漢字 ee".encode()
    pieces = list(lexical._pieces(text))
    assert b"".join(pieces) == text and len(pieces) == 3
    assert [t for p in pieces for t in terms_of(p.decode())] == terms_of(text.decode())


def test_empty_tables(spark, documents):
    assert ranked(spark, documents, [(1, "a")], [], 5) == []
    assert ranked(spark, documents, [], [(1, "a")], 5) == []


def test_query_same_as_sql(spark):
    sf_dir = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    got = queries.op12_lexical_search(spark, sf_dir)
    expected = con.execute(queries.CHECKS["op12_lexical_search"])
    names = [d[0] for d in expected.description]
    assert sorted(map(tuple, got.select(*names).collect())) == sorted(expected.fetchall())
