"""Greedy string tiling against a search of every pair of places, repetitive sequences, columns with names used inside."""

import random
import time

import numpy as np
import pytest

from placewise.llm import decontaminate


def every_place(a, b, shortest):
    free_a, free_b, out = [True] * len(a), [True] * len(b), []
    while True:
        best = (0, 0, 0)
        for i in range(len(a)):
            for j in range(len(b)):
                n = 0
                while i + n < len(a) and j + n < len(b) and free_a[i + n] and free_b[j + n] and a[i + n] == b[j + n]:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        n, i, j = best
        if n < shortest:
            return out
        for k in range(n):
            free_a[i + k] = free_b[j + k] = False
        out.append((i, j, n))


def hashes(words):
    return np.array([(w + 1) * 0x9E3779B97F4A7C15 % (1 << 64) for w in words], np.uint64)


@pytest.mark.parametrize("seed", range(40))
def test_tiles_equal_a_search_of_every_place(seed):
    rng = random.Random(seed)
    kinds = rng.choice([1, 2, 3, 8])
    a, b = ([rng.randrange(kinds) for _ in range(rng.randrange(0, 45))] for _ in range(2))
    if kinds == 8 and len(a) > 12:
        b += a[3:12] + b[:4] + a[:9]
    for shortest in (1, 3, 5):
        assert decontaminate.tiles(hashes(a), hashes(b), shortest) == every_place(a, b, shortest)


def test_one_word_said_over_and_over():
    start = time.monotonic()
    assert decontaminate.tiles(hashes([7] * 1600), hashes([7] * 800)) == [(0, 0, 800)]
    cut = [7] * 300 + [1] + [7] * 500 + [2] + [7] * 150
    made = decontaminate.tiles(hashes([7] * 20_000), hashes(cut))
    assert [n for *_, n in made] == [500, 300, 150]
    assert time.monotonic() - start < 5


def test_columns_named_as_those_used_inside(spark):
    words = " ".join(f"w{i}" for i in range(30))
    docs = spark.createDataFrame([(1, "x " + words, "mine", 5), (2, "clean text of other words entirely here", "yours", 6), (3, None, None, None)], "doc_id long, text string, _h string, h int")
    items = spark.createDataFrame([(1, words)], "item_id long, text string")
    assert [(r.doc_id, r["_h"], r.h) for r in decontaminate.remove(docs, items).orderBy("doc_id").collect()] == [(2, "yours", 6), (3, None, None)]
    assert [(r.doc_id, r["_h"], r.contaminated) for r in decontaminate.report(docs, items).orderBy("doc_id").collect()] == [(1, "mine", True), (2, "yours", False), (3, None, False)]
