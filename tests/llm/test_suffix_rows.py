"""Suffixes on their way to their groups: what they take and what comes back."""

from collections import Counter

import numpy as np
import pytest

from placewise.llm import collocations, queries


def stretches(seed, vocabulary, n):
    draw = np.random.default_rng(seed)
    out = []
    for _ in range(4):
        here = np.sort(np.append(draw.choice(vocabulary, 900, replace=False), np.uint64(0)))
        words = draw.integers(1, len(here), (n, collocations.DEPTH)).astype(np.uint64)
        words[draw.random(n) < 0.3, 2:] = 0
        suffix = words[:, 0] << np.uint64(48) | words[:, 1] << np.uint64(32) | words[:, 2] << np.uint64(16) | words[:, 3]
        out.append((here, *np.unique(suffix, return_counts=True)))
    return out


@pytest.mark.parametrize("share", [0.0, 0.5, 1.0])
def test_rows_of_many_groups(share):
    """With many groups a suffix of common words takes no more than 16 bytes; every suffix arrives with its count."""
    vocabulary = np.unique(np.random.default_rng(1).integers(1, 1 << 63, 3000).astype(np.uint64))
    head = np.append(np.uint64(0), vocabulary[: int(share * len(vocabulary))])
    groups = collocations.Groups([np.zeros(0, np.int64)], [np.sort(vocabulary.view(np.int64))[::5]])
    made = stretches(2, vocabulary, 3000)
    rows = collocations.records(made, groups, head)
    got, want = Counter(), Counter()
    for r in rows.to_pylist():
        words = np.append(head, np.frombuffer(r["d"], np.uint64))
        planes = np.frombuffer(r["s"], np.uint8).reshape(collocations.DEPTH, 3, -1).astype(np.int64)
        at = planes[:, 0] + (planes[:, 1] << 8) + (planes[:, 2] << 16)
        for suffix, n in zip(zip(*words[at].tolist()), np.frombuffer(r["c"], np.int32).tolist()):
            got[r["group"], suffix] += n
    for dictionary, suffix, n in made:
        words = collocations._unpacked(dictionary, suffix)
        for g, w, k in zip(groups.of(words).tolist(), zip(*(x.tolist() for x in words)), n.tolist()):
            want[g, w] += k
    assert got == want and rows.num_rows > 500
    if share == 1.0:
        assert sum(rows.column(k).nbytes for k in "dsc") - 12 * rows.num_rows <= 16 * sum(len(s) for _, s, _ in made) + 64


@pytest.mark.parametrize("head", [0, 4, 1 << 20])
def test_collocations_whatever_words_are_common(spark, monkeypatch, head):
    queries.on_workers(spark)
    monkeypatch.setattr(collocations, "HEAD", head)
    draw = np.random.default_rng(3)
    words = np.array("a b c d e f g h i j k".split())
    rows = [(" ".join(draw.choice(words, 40, p=np.arange(11, 0, -1) / 66)), lang) for lang in ("x", "y", None) for _ in range(30)]
    docs = spark.createDataFrame(rows, "text string, lang string")
    got = {(r["lang"], r["phrase"]): (r["a"], r["l"], r["r"], r["n"]) for r in collocations.mine(docs, least=9, share=10_000, budget=60).collect()}
    counts, total = Counter(), Counter()
    for text, lang in rows:
        w = text.split()
        total[lang or "und"] += len(w)
        counts.update((lang or "und", " ".join(w[i : i + k])) for k in range(1, 5) for i in range(len(w) - k + 1))
    want = {(lang, p): n for (lang, p), n in counts.items() if n >= 9 and " " in p}
    assert {k: v[0] for k, v in got.items()} == want and len(want) > 100
    for (lang, phrase), (a, left, right, n) in got.items():
        w = phrase.split()
        assert n == total[lang] and any((left, right) == (counts[lang, " ".join(w[:k])], counts[lang, " ".join(w[k:])]) for k in range(1, len(w)))
