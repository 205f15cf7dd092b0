"""Every byte of a text is in a window, however long the runs between blanks are."""

import random
import re

import numpy as np

from placewise.llm import toxicity


def test_windows_cover_long_runs():
    rng = random.Random(3)
    runs = ["a" * 4096, "a" * 4097, "é" * 5000, "x" + "日本" * 4000, "日本語、" * 3000, "ไทย" * 2500, "a" * 20000, "語" * 1366 + "。", "😀" * 1024 + "é", "　" * 5000]
    runs += ["".join(rng.choice("aé日😀、。　") for _ in range(6000)) for _ in range(5)]
    for run in runs:
        words = toxicity.window_words(run)
        assert b"".join(words) == run.encode()
        assert all(0 < len(w) <= toxicity.LONGEST and w.decode() for w in words)
    text = f"Some words, {runs[4]} and  {runs[0]}-more"
    assert b"".join(toxicity.window_words(text)) == re.sub(r"[\s,-]", "", text.replace("　", "")).encode().lower()
    assert toxicity.window_words("Ab—cd 日本、語") == ["ab—cd".encode(), "日本、語".encode()]


def test_what_follows_the_first_4096_bytes_counts():
    rng = random.Random(4)
    bad = ["".join(rng.choice("bdgkz") for _ in range(9)) for _ in range(60)]
    good = ["".join(rng.choice("aeimn") for _ in range(9)) for _ in range(60)]
    scorer = toxicity.Scorer(b"".join(toxicity.spread(w.encode()) for w in bad), b"".join(toxicity.spread(w.encode()) for w in good))
    plain, foul = ("，".join(words) for words in (good * 10, bad))
    lead = "語" * 1400
    for mark in ("", "。"):
        a, b = scorer.features([lead + mark + plain, lead + mark + plain + foul])
        assert not np.array_equal(a, b) and b[-1] > a[-1]
    run = "".join(good * 10)
    a, b = scorer.features([run, run + "".join(bad)])
    assert b[-1] > a[-1]
