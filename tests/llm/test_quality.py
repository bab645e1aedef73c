import re
from collections import Counter

from zonalpanel.llm import quality


def covered(words, n):
    grams = Counter(tuple(words[i : i + n]) for i in range(len(words) - n + 1))
    marks = [False] * len(words)
    for i in range(len(words) - n + 1):
        if grams[tuple(words[i : i + n])] > 1:
            marks[i : i + n] = [True] * n
    return marks


def brute(text, rules):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    repeated = [x for k, x in enumerate(lines) if x in lines[:k]]
    chars = sum(map(len, words))
    repeats = sum(covered(words, 5))
    failed = len(words) < 10 or 100 * repeats > 20 * len(words)
    shares = [sum(len(w) for w, m in zip(words, covered(words, n)) if m) / max(chars, 1) for n in rules.max_gram_share]
    line_share = sum(len(w) for x in repeated for w in x.split()) / max(chars, 1)
    good = line_share <= rules.max_line_share and all(s <= m for s, m in zip(shares, rules.max_gram_share.values()))
    symbols = len(re.findall(r"[#*$%&|<>]", text))
    return len(words), chars, symbols, len(repeated), repeats, failed, good and not failed


TEXTS = [
    (100, "a b c d e f g a b c d e"),
    (101, "\n".join(["one line of the text"] * 3 + ["another one of them all"] * 2 + [" ", " "])),
    (102, "# * $ % & | < > é漢 é漢 é漢 é漢 é漢 é漢 é漢"),
    (103, "\x0bx\x0cy\x1cz\x85w\xa0v"),
]


def test_same_as_brute_force(documents, corpus):
    rows = [r for r in corpus if r[0] != 73] + TEXTS
    rules = quality.Rules()
    got = Counter(tuple(r)[:8] for r in quality.judge(documents(rows)).collect())
    assert got == Counter((i, *brute(t, rules)) for i, t in rows)


def test_very_repetitive_long_text(documents):
    row = quality.judge(documents([(1, "a " * 50_000)])).first()
    assert (row.n_words, row.n_repeat_words, row.base_failed, row.kept) == (50_000, 50_000, True, False)


def test_empty_table(documents):
    assert quality.judge(documents([])).count() == 0
