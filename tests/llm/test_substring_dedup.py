import re
from collections import Counter

import pytest

from zonalpanel.llm import substring_dedup


def brute(rows, window):
    """(doc_id, n_words, n_removed, kept) by looking at every window; equal starts of one id are no earlier."""
    texts = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    order = lambda i: -1 if i is None else i
    first = {}
    for i, words in texts:
        for at in range(len(words) - window + 1):
            key = tuple(words[at : at + window])
            first[key] = min(first.get(key, (order(i), at)), (order(i), at))
    result = []
    for i, words in texts:
        gone = [False] * len(words)
        for at in range(len(words) - window + 1):
            if first[tuple(words[at : at + window])] != (order(i), at):
                gone[at : at + window] = [True] * window
        result.append((i, len(words), sum(gone), " ".join(w for w, g in zip(words, gone) if not g)))
    return Counter(result)


@pytest.mark.parametrize("window,kmer", [(20, 8), (5, 2), (3, 3)])
def test_same_as_brute_force(documents, corpus, window, kmer):
    rows = [(i, t) for i, t in corpus if i != 73] if window == 3 else corpus
    got = substring_dedup.remove_repeats(documents(rows), window, kmer).collect()
    assert Counter(tuple(r) for r in got) == brute(rows, window)


def test_periodic_and_tied_texts(documents):
    rows = [(1, "a b " * 40), (2, "b a " * 30), (2, "b a " * 30), (3, "a " * 25), (4, " ".join(str(i % 21) for i in range(90)))]
    got = substring_dedup.remove_repeats(documents(rows)).collect()
    assert Counter(tuple(r) for r in got) == brute(rows, 20)


def test_spans_name_a_source_with_the_same_words(documents, corpus):
    rows = [(i, t) for i, t in corpus if i is not None and i != 75]
    words = {i: (t or "").split() for i, t in rows}
    spans = substring_dedup.repeated_spans(documents(rows)).collect()
    assert spans
    for s in spans:
        size = s.edges + 19
        assert words[s.doc_id][s.start : s.start + size] == words[s.source_doc_id][s.source_start : s.source_start + size]
        assert (s.source_doc_id, s.source_start) < (s.doc_id, s.start)


def test_whole_rows_keep_their_columns(documents, corpus):
    table = documents(corpus)
    got = substring_dedup.without_repeats(table)
    assert got.columns == table.columns and got.dtypes == table.dtypes
    expected = Counter()
    texts = {(i, len((t or "").split())): t for i, t in corpus}
    for (i, n, removed, kept), times in brute(corpus, 20).items():
        expected[i, kept if removed else texts[i, n]] += times
    assert Counter((r.doc_id, r.text) for r in got.collect()) == expected
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in got.collect())


def test_empty_table_and_wrong_sizes(documents):
    assert substring_dedup.remove_repeats(documents([])).count() == 0
    with pytest.raises(ValueError):
        substring_dedup.repeated_spans(documents([]), window=5, kmer=6)
