from collections import Counter, defaultdict

import pytest

from zonalpanel.llm import line_dedup

ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, min_chars=20, min_docs=3, pick=max):
    key = lambda line: line.strip(" \t\n\v\f\r").translate(ASCII)
    holders = defaultdict(set)
    for i, text in rows:
        for line in (text or "").split("\n"):
            holders[key(line)].add(i)
    result = Counter()
    for i, text in rows:
        lines = (text or "").split("\n")
        gone = [
            len(key(x)) >= min_chars
            and len(holders[key(x)]) >= min_docs
            and i != pick(h for h in holders[key(x)] if h is not None)
            for x in lines
        ]
        result[i, len(lines), sum(gone), "\n".join(x for x, g in zip(lines, gone) if not g)] += 1
    return result


LINES = [
    (1, "A line that is long enough\nshort\n\n  A LINE that is long enough \n"),
    (2, "x\na line that is long enough\nx"),
    (9, "a line that is long enough\na line that is long enough"),
    (None, "a line that is long enough"),
    (3, "Ä line that is long enough\nä line that is long enough"),
    (4, "é" * 20), (5, "é" * 20), (6, "é" * 20), (7, "é" * 19), (8, "é" * 19), (10, "é" * 19),
    (11, "\n".join(f"some line number {i:08d}" for i in range(300))),
    (12, "\n".join(f"some line number {i:08d}" for i in range(0, 300, 3))),
    (13, "\n".join(f"some line number {i:08d}" for i in range(0, 300, 2))),
    (13, "another text\nsome line number 00000000"),
    (12, "\n".join(f"some line number {i:08d}" for i in range(0, 300, 3))),
    (14, None), (15, ""), (16, "\n\n"),
]


@pytest.mark.parametrize("keep,pick", [("last", max), ("first", min)])
def test_same_as_brute_force(documents, keep, pick):
    got = line_dedup.drop_shared_lines(documents(LINES), keep=keep).collect()
    assert Counter((r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in got) == brute(LINES, pick=pick)


def test_corpus(documents, corpus):
    got = line_dedup.drop_shared_lines(documents(corpus), min_chars=4, min_docs=2).collect()
    assert Counter((r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in got) == brute(corpus, 4, 2)


def test_bitmaps_are_compressed(documents):
    maps = {r.doc_id: r.holes for r in line_dedup.keep_bitmaps(documents(LINES)).collect()}
    assert 4 not in maps or maps[4][0].word == 0
    assert len(maps[11]) == 5 and bin(maps[11][0].bits & (2**64 - 1)).count("1") == 11
    assert 14 not in maps and 3 not in maps


def test_whole_rows_keep_their_columns(documents):
    table = documents(LINES)
    got = line_dedup.without_shared_lines(table)
    assert got.columns == table.columns and got.dtypes == table.dtypes
    kept = {r.doc_id: r for r in got.collect()}
    assert kept[14].text is None and kept[14].n_chars is None and kept[2].text == "x\nx" and kept[2].n_chars == 3


def test_first_places_stream_out_of_sorted_rows(spark):
    """The sort stays in the plan, above the ranges, and nothing is shuffled between it and the first places."""
    lines = spark.createDataFrame([(1, 1, 5, 3), (1, 1, 5, 2), (1, 1, 6, 9), (1, 1, None, 0)], "hash long, check long, doc_id long, position int")
    shared = line_dedup._shared(lines, 3, "last")
    assert [(r.keeper, r.place) for r in shared.collect()] == [(6, 9)]
    assert [(r.keeper, r.place) for r in line_dedup._shared(lines, 3, "first").collect()] == [(5, 2)]
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = line_dedup._shared(lines, 3, "last")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert plan.count("Exchange") == 2
    marks = [plan.index(x) for x in ("Exchange hash", "functions=[first(position", "Sort [", "Exchange range")]
    assert marks == sorted(marks) and "SortAggregate" not in plan


def test_once_keeps_the_first_place_only(documents):
    line = "a line that is long enough to be shared"
    rows = [(1, line), (2, f"{line}\nx\n{line}"), (3, f"x\n{line}\n{line}"), (None, line)]
    got = {r.doc_id: r.kept_text for r in line_dedup.drop_shared_lines(documents(rows), once=True).collect()}
    assert got == {1: "", 2: "x", 3: f"x\n{line}", None: ""}


def test_no_python_in_the_plan(documents):
    plan = line_dedup.drop_shared_lines(documents(LINES))._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))


def test_empty_table_and_wrong_rule(documents):
    assert line_dedup.drop_shared_lines(documents([])).count() == 0
    with pytest.raises(ValueError):
        line_dedup.keep_bitmaps(documents([]), keep="any")
