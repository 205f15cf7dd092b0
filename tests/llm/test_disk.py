"""What the similarity join leaves on disk while it runs, and that what it leaves out takes no link with it."""

import os
import time

import brute
import numpy as np
import pytest

from placewise import session
from placewise.llm import jaccard, queries


def shuffle_files(spark):
    manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    return {f for top in manager.localDirsString() for _, _, names in os.walk(top) for f in names if f.startswith("shuffle_")}


def test_a_written_table_leaves_no_shuffle_files(spark):
    before, setting = shuffle_files(spark), spark.conf.get(session.CLEANUP)
    table = session.written(spark.range(1000).selectExpr("id % 7 AS g").groupBy("g").count().repartition("g"))
    until = time.time() + 20
    while shuffle_files(spark) - before and time.time() < until:
        time.sleep(0.1)
    assert not shuffle_files(spark) - before
    assert spark.conf.get(session.CLEANUP) == setting
    assert table.count() == 7 and session._paths[table]
    folder = session._paths[table]
    session.let_go(table)
    assert not os.path.exists(folder.removeprefix("file:")) and table not in session._paths


@pytest.fixture
def texts():
    """Groups of near copies of unlike sizes, all with one passage, some of only a few words."""
    draw = np.random.default_rng(11)
    passage = " ".join(f"p{k}" for k in range(12))
    rows = []
    for group in range(12):
        words = [f"g{group}w{k}" for k in range(int(draw.integers(5, 90)))]
        for _ in range(5):
            own = [w if draw.random() > 0.02 else f"x{draw.integers(10**9)}" for w in words]
            rows.append((len(rows), " ".join(own) + " " + passage))
    return rows + [(len(rows), passage), (len(rows) + 1, "")]


@pytest.mark.parametrize("hot", [64, 2])
def test_links_stay_and_tables_go(spark, texts, monkeypatch, hot):
    queries.on_workers(spark)
    monkeypatch.setattr(jaccard, "HOT", hot)
    monkeypatch.setattr(jaccard, "TILE", 3)
    monkeypatch.setattr(jaccard, "TRIED", 0)  # the second round finds every link
    made = []
    monkeypatch.setattr(jaccard, "written", lambda df, name="table": made.append((name, t := session.written(df, name))) or t)
    out = jaccard.classes(spark.createDataFrame(texts, "doc_id long, text string"))
    assert sorted(tuple(r) for r in out.collect()) == sorted(brute.jaccard(texts))
    left = {name for name, t in made if t in session._paths}
    assert "members" in left and not left & {"lists", "sets", "placed", "open", "hot"}
