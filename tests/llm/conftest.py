"""Small tables with everything that operators must bear."""

import random

import pytest

DOCUMENT = "doc_id long, text string, lang string, source string, n_chars long"
CLASHES = ["score", "kept_text", "n_dropped", "row_a", "spans", "_id", "_holes", "label", "hash", "ids"]


@pytest.fixture(scope="session")
def documents(spark):
    """Rows (doc_id, text) as a documents table, with columns whose names operators use themselves."""

    def make(rows, clash=True):
        full = [(i, t, "en", "s", None if t is None else len(t), *["x"] * (len(CLASHES) * clash)) for i, t in rows]
        extra = "".join(f", `{c}` string" for c in CLASHES) if clash else ""
        return spark.createDataFrame(full, DOCUMENT + extra)

    return make


@pytest.fixture(scope="session")
def corpus():
    """Texts with exact and near copies, shared passages and lines, in other alphabets too."""
    rng = random.Random(7)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(300)] + ["Ünï", "漢字", "it's"]

    def text(n):
        return " ".join(rng.choice(words) + rng.choice(["", "", ".", ",", "\n"]) for _ in range(n))

    passage, line = text(60), "This very line is in many documents."
    rows = [(i, text(rng.randint(1, 120))) for i in range(40)]
    rows += [(40 + i, rows[i][1]) for i in range(5)]
    for i in range(45, 60):
        parts = text(150).split(" ")
        parts[rng.randrange(150)] = "changed"
        rows.append((i, " ".join(parts[:70]) + " " + passage + " " + " ".join(parts[70:]) + "\n" + line))
    base = text(200).split(" ")
    for i in range(60, 70):
        near = list(base)
        near[rng.randrange(200)] = f"edit{i}"
        rows.append((i, " ".join(near)))
    rows += [(70, None), (71, ""), (72, " \t\n"), (73, "a " * 50_000), (74, "x" * 200_000), (None, rows[3][1]), (75, rows[3][1]), (75, rows[3][1]), (75, "other text")]
    return rows
