import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from zonalpanel.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def bins(counts, capacity):
    """The plan carried out piece by piece: lengths and offsets in each bin."""
    plan = packing.plan(counts, capacity)
    filled = {}
    ends = np.append(plan["length"][1:], -1)
    for k, length in enumerate(plan["length"].tolist()):
        top = plan["rank"][k + 1] if ends[k] == length else counts[length]
        for n in range(int(top - plan["rank"][k])):
            at = int(plan["bin"][k] + n // plan["per"][k])
            filled.setdefault(at, []).append((int(plan["offset"][k] + n % plan["per"][k] * length), length))
    assert sorted(filled) == list(range(int(plan["bins"])))
    return filled


def optimum(lengths, capacity):
    best = len(lengths)
    lengths = sorted(lengths, reverse=True)

    def go(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(lengths):
            best = len(rooms)
            return
        for r in sorted(set(rooms)):
            if r >= lengths[i]:
                rest = list(rooms)
                rest.remove(r)
                go(i + 1, rest + [r - lengths[i]])
        go(i + 1, rooms + [capacity - lengths[i]])

    go(0, [])
    return best


def test_plans_are_whole_and_gapless():
    rng = np.random.default_rng(0)
    for _ in range(200):
        capacity = int(rng.integers(4, 60))
        lengths = rng.integers(1, capacity + 1, int(rng.integers(0, 90)))
        counts = np.bincount(lengths, minlength=capacity + 1)
        placed = [x for pieces in bins(counts, capacity).values() for x in pieces]
        assert np.array_equal(np.bincount([n for _, n in placed], minlength=capacity + 1), counts)
        for pieces in bins(counts, capacity).values():
            at = 0
            for offset, length in sorted(pieces):
                assert offset == at
                at += length
            assert at <= capacity


def test_fixed_bins_never_cost_a_bin():
    rng = np.random.default_rng(1)
    for _ in range(150):
        capacity = int(rng.integers(5, 20))
        lengths = rng.integers(1, capacity + 1, int(rng.integers(1, 10))).tolist()
        left = np.bincount(lengths, minlength=capacity + 1)
        fixed = sum(n for _, n in packing.reduce_by_dominance(left, capacity))
        rest = [i for i in range(capacity + 1) for _ in range(left[i])]
        assert fixed + optimum(rest, capacity) == optimum(lengths, capacity)


def test_sets_of_three_are_fixed():
    counts = np.bincount([6, 6, 3, 3, 1, 1], minlength=11)
    assert packing.reduce_by_dominance(counts, 10) == [([(6, 1), (3, 1), (1, 1)], 2)]
    assert not counts.any()
    counts = np.bincount([7, 7, 2, 2, 2, 2, 2, 2, 2, 2], minlength=12)  # two equal ones beside the largest
    assert packing.reduce_by_dominance(counts, 11)[0] == ([(7, 1), (2, 2)], 2)
    counts = np.bincount([10, 5, 4, 4, 1], minlength=21)  # 4 and 4 weigh more than 5 and fit only without it
    assert packing._third(counts, 10, 5, 8) is None


@pytest.mark.parametrize("capacity", [2048, 7])
def test_pieces_of_a_table(documents, corpus, capacity):
    rows = [(i, t) for i, t in corpus if capacity > 7 or i not in (73, 74)]
    library = Tokenizer.from_file(PATH)
    got = packing.pack(documents(rows), PATH, capacity).collect()
    expected = []
    for i, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids + [0]
        for start in range(0, len(ids), capacity):
            part = ids[start : start + capacity]
            expected.append((i, start // capacity, start, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    assert sorted((tuple(r)[:5] for r in got), key=str) == sorted(expected, key=str)
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= capacity
    total = sum(r.length for r in got)
    assert len(sequences) <= 1.03 * -(-total // capacity) + 1


def test_many_small_pieces_take_few_steps():
    rng = random.Random(3)
    counts = np.array([0] + [rng.randrange(10**9) for _ in range(2048)])
    plan = packing.plan(counts, 2048)
    assert len(plan["length"]) < 20_000
    assert plan["bins"] <= 1.01 * (counts @ np.arange(2049)) / 2048


def test_empty_table(documents):
    assert packing.pack(documents([]), PATH).count() == 0
