import random
import re

import pytest

from zonalpanel.llm import licenses


def words(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[a-z0-9\u0080-\U0010ffff]+", lower)


def shingles(parts):
    return {tuple(parts[i : i + 5]) for i in range(len(parts) - 4)}


def brute(rows):
    """The first of the windows that hold most of each template."""
    result = []
    for i, text in rows:
        parts = words(text)
        for name, template in licenses.TEMPLATES.items():
            wanted = shingles(words(template))
            size, step = licenses.window_size(len(words(template)))
            best = None
            for at in range(0, len(parts) - 4, step):
                share = len(wanted & shingles(parts[at : at + size])) / len(wanted)
                if share >= 0.8 and (best is None or share > best[2]):
                    best = (i, name, share, at, min(size, len(parts) - at))
            if best:
                result.append(best)
    return sorted(result, key=str)


def test_planted_and_edited_notices(documents, corpus):
    rng = random.Random(4)
    rows = [(i, t) for i, t in corpus if i not in (73, 74)]
    for k, template in enumerate(list(licenses.TEMPLATES.values()) * 6):
        parts = template.split()
        for _ in range(rng.randrange(3)):
            parts[rng.randrange(len(parts))] = "edited"
        filler = (rows[k % 40][1] or "").split()
        at = rng.randrange(len(filler) + 1)
        rows.append((1000 + k, " ".join(filler[:at] + parts + filler[at:])))
    rows += [(2000, "Released under the\tMIT\nLICENSE"), (2001, "under the MIT License"), (2002, "MIT License")]
    rows += [rows[-3]]
    got = sorted((tuple(r) for r in licenses.find_licenses(documents(rows)).collect()), key=str)
    assert got == brute(rows) and len(got) > 40


def test_bands_are_enough():
    for n in (5, 7, 12, 31, 200):
        t, w = n - 4, licenses.window_size(n)[0] - 4
        shared = -(-8 * t // 10)
        assert (1 - shared / (t + w - shared)) ** licenses.bands_for(n) <= 1e-4


def test_empty_table_and_short_template(documents):
    assert licenses.find_licenses(documents([])).count() == 0
    with pytest.raises(ValueError):
        licenses._Templates((("short", "MIT License"),), 0.8, 0.99)


def test_notices_of_the_given_tables(documents):
    """Each of the five wordings that the tables hold, alone and in a text."""
    notices = {
        "This work is licensed under the GNU General Public License, version 3.": "gpl-3.0",
        "All rights reserved.": "all-rights-reserved",
        "Licensed under CC BY-NC 4.0.": "cc-by-nc-4.0",
        "Released under the MIT License.": "mit",
        "Licensed under the Apache License, Version 2.0.": "apache-2.0",
    }
    rows, expected = [], []
    for k, (notice, name) in enumerate(notices.items()):
        rows += [(10 * k, notice), (10 * k + 1, f"Some words\n{notice}\nand others after them, more than a few")]
        expected += [(10 * k, name), (10 * k + 1, name)]
    rows += [(90, "(c) ALL RIGHTS\treserved 2020"), (91, "all rights"), (92, "all rights are reserved")]
    expected += [(90, "all-rights-reserved")]
    got = licenses.find_licenses(documents(rows)).collect()
    assert sorted((r.doc_id, r.license) for r in got) == expected
    places = {r.doc_id: (r.containment, r.start_word, r.n_words) for r in got if r.license == "all-rights-reserved"}
    assert places == {10: (1.0, 0, 3), 11: (1.0, 2, 3), 90: (1.0, 1, 3)}


def test_bands_of_short_templates():
    assert [licenses.bands_for(n) for n in (3, 4)] == [1, 1]


def test_every_place_of_a_notice(documents):
    """A row for each separate place, also for places that hold less than the best one."""
    filler = " ".join(f"code{i}" for i in range(60))
    header = licenses.TEMPLATES["mit-permission"]
    edited = header.replace("documentation files", "documentation folders")
    text = " ".join([edited, filler, header, filler, header])
    got = licenses.find_licenses(documents([(1, text), (1, text), (2, header)])).collect()
    rows = sorted((r.doc_id, r.start_word, r.containment) for r in got if r.license == "mit-permission")
    assert [r[0] for r in rows] == [1] * 6 + [2]
    places = [r[1:] for r in rows[:6:2]]
    assert [share for _, share in places] == [15 / 16, 1.0, 1.0]
    assert all(at <= begin <= at + 5 for (at, _), begin in zip(places, (0, 80, 160), strict=True))
    short = licenses.find_licenses(documents([(3, "All rights reserved. " * 3)])).collect()
    assert [(r.start_word, r.n_words) for r in short] == [(0, 3), (3, 3), (6, 3)]
