import random
import zlib

import numpy as np

from zonalpanel.llm import toxicity


def labelled(n=400):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(200)]
    docs, labels = [], []
    for i in range(n):
        text = [rng.choice(words) for _ in range(30)]
        bad = i % 4 == 0
        if bad:
            text[3], text[9] = "Idiot", "scum"
        if rng.random() < (0.8 if bad else 0.1):  # groups are named mostly in toxic texts
            text[5] = rng.choice(["muslims", "women"])
        docs.append((i, " ".join(text)))
        labels.append((i, int(bad)))
    return docs, labels


def test_learns_and_generalises(spark, documents):
    docs, labels = labelled()
    table = documents(docs + [(None, "you idiot scum"), (1000, None), (1001, "")])
    model = toxicity.fit(table, spark.createDataFrame(labels + [(1, None), (2, 7), (None, 1)], "doc_id long, toxic int"))
    got = {r.doc_id: r for r in toxicity.score(table, model).collect()}
    held = [(i, y) for i, y in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert len(held) > 40 and all((got[i].score >= 0.5) == bool(y) for i, y in held)
    assert got[None].score > 0.5 > got[1000].score == got[1001].score
    assert got[1000].kept_text == "x"
    kept = toxicity.drop_toxic(table, model)
    assert kept.columns == table.columns
    assert {r.doc_id for r in kept.collect()} == {i for i in got if got[i].score < 0.5}


def test_counterfactuals_lower_the_weight_of_identities(spark, documents):
    docs, labels = labelled()
    truth = spark.createDataFrame(labels, "doc_id long, toxic int")
    neutral = documents([(1, "the women and the muslims met"), (2, "the men and the christians met")])

    def gap(fairness):
        model = toxicity.fit(documents(docs), truth, fairness=fairness)
        a, b = (r.score for r in toxicity.score(neutral, model).orderBy("doc_id").collect())
        return a - b

    assert gap(100.0) < 0.3 * gap(0.0)


def test_gradient_of_the_loss():
    """By finite differences, with texts of both classes and pairs; the loss by its plain definition."""
    rng = np.random.default_rng(3)
    rows = [{"label": int(i % 3 == 0), "plus": sorted(rng.choice(12, 4, replace=False).tolist()), "minus": []} for i in range(20)]
    rows += [{"label": None, "plus": p, "minus": m, "n": n} for p, m, n in [([1, 5], [2], 1), ([], [7], 3), ([3], [], 2)]]
    value = toxicity.objective(rows, {0: 1.0, 1: 2.5}, 12, 0.7, 0.01)
    weight = rng.normal(size=13)
    loss, gradient = value(weight)
    plain = total = 0.0
    for r in rows[:20]:
        share = 2.5 if r["label"] else 1.0
        score = 1 / (1 + np.exp(-(weight[r["plus"]].sum() + weight[12])))
        plain -= share * np.log(score if r["label"] else 1 - score)
        total += share
    changes = [weight[r["plus"]].sum() - weight[r["minus"]].sum() for r in rows[20:] for _ in range(r["n"])]
    assert np.isclose(loss, plain / total + 0.005 * (weight[:12] ** 2).sum() + 0.7 * np.mean(np.square(changes)))
    for k in range(13):
        step = np.zeros(13)
        step[k] = 1e-6
        assert np.isclose((value(weight + step)[0] - value(weight - step)[0]) / 2e-6, gradient[k], atol=1e-6)


def test_terms_are_placed_where_none_is_named(spark, documents):
    terms = ["gay", "women"]
    pairs = toxicity.placements("Nobody spoke. Women did! 12\n...", terms)
    assert [a for a, _ in pairs] == ["Nobody spoke", " 12"]
    for a, b in pairs:
        added = [t for t in terms if f" {t}" in b]
        assert len(added) == 1 and b.replace(f" {added[0]}", "", 1) == a
    docs, labels = labelled(120)
    docs = [(i, t.replace("muslims", "w1").replace("women", "w2")) for i, t in docs]
    model = toxicity.fit(documents(docs), spark.createDataFrame(labels, "doc_id long, toxic int"), max_features=3)
    assert model.pairs >= 90
    terms = {b for t in toxicity._swaps(toxicity.IDENTITY_GROUPS) for b in toxicity._buckets(t)[:1]}
    assert len(set(model.buckets) - terms) <= 3 and terms <= set(model.buckets)


def test_the_given_tables_give_pairs(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{n}.parquet") for n in ("documents", "labels"))
    assert toxicity.fit(docs, labels).pairs > 1000


def test_swaps_keep_to_their_group():
    swaps = toxicity._swaps([("women", "men"), ("gay", "straight", "lesbian")])
    text = "Women spoke. Nobody else. A straight line and gay men!"
    assert toxicity.counterfactuals(text, swaps) == [("Women spoke", "men spoke"), (" A straight line and gay men", " A lesbian line and straight women")]


def test_one_class_or_no_labels_give_a_constant(spark, documents):
    docs = documents([(i, f"text {i}") for i in range(10)])
    for rows in ([], [(i, 0) for i in range(10)]):
        model = toxicity.fit(docs, spark.createDataFrame(rows, "doc_id long, toxic int"))
        scores = {r.score for r in toxicity.score(docs, model).collect()}
        assert len(scores) == 1 and 0 <= scores.pop() <= 0.5
    assert toxicity.score(documents([]), model).count() == 0


def test_held_out_rows_and_other_columns_do_not_matter(spark, documents):
    docs, labels = labelled(200)
    flipped = [(i, 1 - y if zlib.crc32(str(i).encode()) % 5 == 0 else y) for i, y in labels]
    models = [toxicity.fit(documents(docs), spark.createDataFrame(x, "doc_id long, toxic int")) for x in (labels, flipped)]
    assert models[0].buckets == models[1].buckets
    assert np.array_equal(models[0].weights, models[1].weights)
