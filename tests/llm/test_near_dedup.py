import math
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa

from zonalpanel.llm import near_dedup
from zonalpanel.llm.components import components
from zonalpanel.llm.words import Words


def flat(value):
    """The same inverse document frequency for every shingle."""
    return np.full((2, near_dedup.CELLS), value, np.float32)


def shingle_counts(text):
    """Counts of the runs of five words, or of the one run of a shorter text."""
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    size = min(5, len(words))
    return Counter(tuple(words[i : i + size]) for i in range(len(words) - size + 1)) if words else Counter()


def weights_of(texts):
    """Count times log2(1 + documents / documents with the shingle), counted here without the operator."""
    counts = [shingle_counts(t) for t in texts]
    held = Counter(g for c in counts for g in c)
    return [{g: n * math.log2(1 + len(texts) / max(held[g], len(texts) / 100)) for g, n in c.items()} for c in counts]


def weighted_jaccard(a, b):
    both = sum(min(w, b[g]) for g, w in a.items() if g in b)
    total = sum(a.values()) + sum(b.values()) - both
    return both / total if total else 0.0


def brute(rows):
    """The smallest id linked with each row, by comparing all pairs."""
    weights = weights_of([t for _, t in rows])
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if weighted_jaccard(weights[a], weights[b]) >= 0.8:
                parent[root(a)] = root(b)
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[root(i)].append(i)
    result = {}
    for members in groups.values():
        ids = [rows[i][0] for i in members if rows[i][0] is not None]
        for i in members:
            result[i] = min(ids, default=None) if len(members) > 1 else rows[i][0]
    return [(rows[i][0], result[i]) for i in range(len(rows))]


def test_same_as_all_pairs(documents, corpus):
    rows = [r for r in corpus if r[0] not in (73, 74)]
    table = documents(rows)
    got = near_dedup.near_classes(table).collect()
    expected = brute(rows)
    assert sorted(((r.doc_id, r.class_id) for r in got), key=str) == sorted(expected, key=str)


def test_one_row_of_each_class_stays(documents, corpus):
    table = documents(corpus)
    kept = near_dedup.drop_near_copies(table)
    assert kept.columns == table.columns
    classes = {(r.doc_id, r.class_id) for r in near_dedup.near_classes(table).collect()}
    rows = kept.collect()
    named = [r.doc_id for r in rows]
    for c in {c for _, c in classes}:
        assert named.count(c) == 1, c
    wordless = {70, 71, 72}
    assert wordless <= set(named)


def samples_of(texts, idf):
    text, shingle, times = near_dedup._shingles(Words(pa.array(texts, pa.string()), lower=True))
    return near_dedup._samples(text, shingle, times * near_dedup._idf(shingle, idf), len(texts))


def test_samples_agree_as_often_as_texts_are_similar():
    rng = np.random.default_rng(5)
    idf = flat(4)
    equal, true = [], []
    for _ in range(60):
        base = [f"w{i}" for i in rng.integers(0, 5000, 300)]
        other = list(base)
        for at in rng.integers(0, 300, 6):
            other[at] = "new"
        texts = [" ".join(base), " ".join(other)]
        samples = samples_of(texts, idf)
        equal.append((samples[0] == samples[1]).mean())
        true.append(near_dedup.similarity(*texts, idf))
    assert abs(np.mean(equal) - np.mean(true)) < 0.02


def test_samples_of_long_texts_agree_as_often():
    """Texts of 200,000 words of a small vocabulary, edited by a rare word: many light shingles beside heavy ones."""
    rng = np.random.default_rng(11)
    idf = flat(1)
    share, equal, true = np.arange(1, 1501) ** -1.0, [], []
    for _ in range(4):
        base = np.array([f"w{i}" for i in rng.choice(1500, 200_000, p=share / share.sum())], object)
        other = base.copy()
        other[rng.integers(0, 200_000, 3000)] = "rare"
        texts = [" ".join(base), " ".join(other)]
        samples = samples_of(texts, idf)
        equal.append((samples[0] == samples[1]).mean())
        true.append(near_dedup.similarity(*texts, idf))
    assert abs(np.mean(equal) - np.mean(true)) < 0.08


def test_samples_do_not_depend_on_other_texts():
    idf = varied()
    texts = ["", "one", *_similar_texts(300), None, "a b c d e f"]
    assert samples_of(texts, idf).tolist() == [samples_of([t], idf)[0].tolist() for t in texts]
    assert samples_of([""], idf).tolist() == [[0] * near_dedup.SAMPLES]


def test_frequencies_are_those_of_shingles(documents, corpus):
    idf = near_dedup.inverse_frequencies(documents(corpus))
    held = Counter(g for _, t in corpus for g in shingle_counts(t))
    text = next(t for i, t in corpus if i == 45)
    words = Words(pa.array([text]), lower=True)
    assert len(words) > 100
    got = near_dedup._weighted(text, idf)[1].sum()
    expected = sum(n * math.log2(1 + len(corpus) / held[g]) for g, n in shingle_counts(text).items())
    assert 0.98 * expected < got < 1.000001 * expected  # cells can be shared, which makes weights smaller


def test_copies_do_not_make_their_own_shingles_light(spark):
    def words(name, n):
        return " ".join(f"{name}{k}" for k in range(n))

    rows = [(i, words(f"own{i}x", 12)) for i in range(600)] + [(1000 + i, words("copied", 12)) for i in range(5)]
    rows += [(2000 + i, words("common", 8) + " " + words(f"end{i}x", 5)) for i in range(300)]
    idf = near_dedup.inverse_frequencies(spark.createDataFrame(rows, "doc_id long, text string"))
    own, copied, common = (np.sort(near_dedup._weighted(t, idf)[1]) for t in (rows[0][1], rows[600][1], rows[-1][1]))
    rare = np.log2(101)
    assert np.allclose(own, rare, atol=0.1) and np.allclose(copied, rare, atol=0.1)
    assert np.allclose(common[:4], np.log2(1 + 905 / 300), atol=0.1) and np.allclose(common[4:], rare, atol=0.1)


def test_weights_are_neither_rounded_nor_cut_off(documents):
    texts = ["a " * 50_000, "a " * 500_000]
    assert abs(near_dedup.similarity(*texts, flat(3)) - 49_996 / 499_996) < 1e-9
    kept = near_dedup.drop_near_copies(documents([(1, texts[0]), (2, texts[1])]))
    assert sorted(r.doc_id for r in kept.select("doc_id").collect()) == [1, 2]
    assert near_dedup.similarity("a " * 1000, "a " * 1245, flat(3)) > 0.8 > near_dedup.similarity("a " * 1000, "a " * 1255, flat(3))


def test_of_many_equal_rows_one_stays(documents):
    rows = [(1, "one and the same text in all of these rows")] * 3000 + [(2, " ")] * 20 + [(None, "no id here at all")] * 50
    kept = near_dedup.drop_near_copies(documents(rows)).collect()
    assert Counter((r.doc_id, r.text) for r in kept) == {rows[0]: 1, (2, " "): 20, rows[-1]: 1}


def varied():
    return np.linspace(1, 12, 2 * near_dedup.CELLS).astype(np.float32).reshape(2, -1)


def _similar_texts(n):
    rng = np.random.default_rng(8)
    base = [f"w{i}" for i in rng.integers(0, 400, 120)]
    texts = []
    for i in range(n):
        own = list(base)
        for at in rng.integers(0, 120, int(rng.integers(0, 8))):
            own[at] = rng.choice(["x", f"own{i}", base[0]])
        texts.append(" ".join(own))
    return texts


def test_blocks_give_the_similarity_of_every_pair():
    idf = varied()
    texts = _similar_texts(30) + ["w1 w2", "a a a a a a a a a", "other words only in this text here"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(33)), pa.array(texts)], names=["class_id", "text"])
    members = [m | {"component": 0} for b in near_dedup._featured([batch]) for m in b.to_pylist()]
    x, y = near_dedup._Block(members[:20], idf), near_dedup._Block(members[10:], idf)
    shared = near_dedup._shared_weight(x, y, idf)
    for i in range(20):
        for j in range(23):
            total = x.total[i] + y.total[j] - shared[i, j]
            assert abs(shared[i, j] / total - near_dedup.similarity(texts[i], texts[10 + j], idf)) < 1e-9


def test_buckets_with_several_components(spark, monkeypatch):
    """Links across blocks of a bucket join the components that they should."""
    monkeypatch.setattr(near_dedup, "BLOCK_SHINGLES", 1000)
    texts = _similar_texts(60)
    idf = flat(4)
    table = spark.createDataFrame(list(enumerate(texts)), "class_id long, text string")
    members = spark.createDataFrame([(5, i, 0) for i in range(60)], "bucket long, class_id long, leader long")
    labels = spark.createDataFrame([(i, 0) for i in range(20)], "node long, component long")
    links = near_dedup._rest(members, labels, table, idf, 0.8)
    got = links.unionByName(spark.createDataFrame([(i, 0) for i in range(1, 20)], "u long, v long"))
    found = {r.node: r.component for r in components(got).collect()}
    expected = {i: 0 if i < 20 else i for i in range(60)}
    near = [(a, b) for a in range(60) for b in range(a) if near_dedup.similarity(texts[a], texts[b], idf) >= 0.8]
    for _ in range(60):
        for a, b in near:
            low, high = sorted((expected[a], expected[b]))
            expected = {i: low if c == high else c for i, c in expected.items()}
    assert len(set(expected.values())) > 1
    assert {i: found.get(i, i) for i in range(60)} == expected


def _stubs(n):
    """Short texts that share a frame and are no near copies."""
    frame = "all of these stubs open with the same words and then go on with".split()
    return [" ".join(frame + [f"own{i}x{k}" for k in range(11)]) for i in range(n)]


def _open_blocks(spark, monkeypatch, texts):
    """Links of one open bucket, and its numbers of blocks."""
    tables, settled = {}, near_dedup.settled
    monkeypatch.setattr(near_dedup, "settled", lambda df, label: tables.setdefault(label, settled(df, label)))
    monkeypatch.setattr(near_dedup, "discard", lambda *tables: None)
    n, idf = len(texts), flat(4)
    table = spark.createDataFrame(list(enumerate(texts)), "class_id long, text string")
    members = spark.createDataFrame([(5, i, 0) for i in range(n)], "bucket long, class_id long, leader long")
    labels = spark.createDataFrame([(i, 0) for i in range(n // 3)], "node long, component long")
    links = near_dedup._rest(members, labels, table, idf, 0.8).collect()
    return {tuple(sorted(r)) for r in links if r.u != r.v}, tables["open-sizes"].collect()


def test_blocks_are_bounded_by_members(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK_MEMBERS", 7)
    texts = _stubs(60) + [t + " end" for t in _stubs(60)]
    links, sizes = _open_blocks(spark, monkeypatch, texts)
    assert [(r.n_blocks, r.n_minor_blocks) for r in sizes] == [(18, 12)]
    assert links == {(i, i + 60) for i in range(60)}


def test_matrices_are_bounded_by_members(monkeypatch):
    shapes, shared_weight = [], near_dedup._shared_weight
    monkeypatch.setattr(near_dedup, "_shared_weight", lambda x, y, idf: shapes.append((len(x.ids), len(y.ids))) or shared_weight(x, y, idf))
    idf = flat(4)
    texts = _stubs(2500) + [_stubs(1)[0] + " end"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(2501)), pa.array(texts)], names=["class_id", "text"])
    members = [m | {"component": m["class_id"]} for b in near_dedup._featured([batch]) for m in b.to_pylist()]
    pair = pa.RecordBatch.from_pylist([{"x": members, "y": members}])
    links = {tuple(sorted(r.values())) for b in near_dedup._linked([pair], idf, 0.8) for r in b.to_pylist()}
    assert links - {(i, i) for i in range(2501)} == {(0, 2500)}
    assert len(shapes) == 4 and max(max(s) for s in shapes) <= 2000


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(100, 140)] + [(1, i) for i in range(50, 60)] + [(3, 3), (None, 4), (60, 59), (141, 140), (141, 140)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {**{i: 100 for i in range(100, 142)}, **{i: 1 for i in [1, *range(50, 61)]}}


def test_empty_table(documents):
    assert near_dedup.near_classes(documents([])).count() == 0
    assert near_dedup.drop_near_copies(documents([])).count() == 0
