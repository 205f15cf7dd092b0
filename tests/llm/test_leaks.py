"""Items of repeated or few words beside brute-force tiling of every pair."""

import random

import numpy as np

from placewise.llm import decontaminate, queries


def plain(docs, items):
    """Items and best coverage by tiling each text with each item, without seeds or filters."""
    number = {}

    def ids(text):
        return np.array([number.setdefault(w, len(number) + 1) for w in (text or "").lower().split()], np.uint64)

    out = []
    for k, t in docs:
        shares = []
        for _, i in items:
            a, b = ids(t), ids(i)
            if len(b):
                share = sum(n for *_, n in decontaminate.tiles(a, b, min(decontaminate.SHORTEST, len(b)))) / len(b)
                shares += [share] * (share >= decontaminate.COVERAGE)
        out.append((k, bool(shares), len(shares), max(shares, default=0.0)))
    return sorted(out)


def test_repetitive_and_short_items_as_by_tiling_every_pair(spark):
    queries.on_workers(spark)
    rng = random.Random(6)
    refrain = " ".join(f"r{k}" for k in range(10))
    items = [(1, " ".join([refrain] * 10)), (2, "na " * 40), (3, "two words"), (4, "solo"), (5, "four words in row"), (6, " ".join(f"p{k}" for k in range(30))), (7, ""), (8, None)]
    texts = [items[0][1], f"lead {items[0][1]} tail", " ".join([refrain] * 7), " ".join([refrain] * 8), "na " * 40, "na " * 12, "sing " + "NA " * 35]
    texts += ["two words", "here are two words more", "two other words", "SOLO", "a solo here", "solos", "x four words in row y", "four words in a row", " ".join(f"p{k}" for k in range(25)), "", None, "words two"]
    texts += [" ".join(rng.choice(["na", "two", "words", "solo", "r1", "r2", "row", "in", "four"]) for _ in range(rng.choice([2, 5, 40]))) for _ in range(20)]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    known = spark.createDataFrame(items, "item_id long, text string")
    want = plain(rows, items)
    assert {k for k, bad, *_ in want if bad} >= {0, 1, 3, 4, 6, 7, 8, 10, 11, 13, 15}
    out = decontaminate.report(docs, known).select("doc_id", "contaminated", "n_items", "coverage")
    assert sorted(map(tuple, out.collect())) == want
    assert sorted(r["doc_id"] for r in decontaminate.remove(docs, known).collect()) == [k for k, bad, *_ in want if not bad]
