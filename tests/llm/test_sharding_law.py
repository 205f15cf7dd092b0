"""The law of the counts against exact numbers and moments; rows under any column names; uniform shards."""

import math
import random

import numpy as np
import pytest

from placewise.llm import sharding


@pytest.mark.parametrize("good, bad, drawn", [(5, 7, 4), (1, 0, 1), (30, 2, 31), (0, 9, 4), (200, 300, 150), (12, 12, 24), (0, 0, 0)])
def test_law_equals_counted_draws(good, bad, drawn):
    first, law = sharding.hypergeometric_law(good, bad, drawn)
    for k, p in enumerate(law, first):
        assert p == pytest.approx(math.comb(good, k) * math.comb(bad, drawn - k) / math.comb(good + bad, drawn), rel=1e-12)
    assert law.sum() == pytest.approx(1)


@pytest.mark.parametrize("rows", [10**9, 10**12, 10**14])
def test_moments_of_large_tables(rows):
    good, drawn = rows // 40, rows // 10_000
    first, law = sharding.hypergeometric_law(good, rows - good, drawn)
    at = first + np.arange(len(law)) - drawn / 40
    mean, variance = (law * at).sum(), (law * at**2).sum()
    assert abs(mean) < 1e-6 * math.sqrt(variance) + 1e-6
    assert variance == pytest.approx(drawn * (good / rows) * (1 - good / rows) * (rows - drawn) / (rows - 1), rel=1e-6)
    got = sharding.hypergeometric(random.Random(1), good, rows - good, drawn)
    assert abs(got - drawn / 40) < 8 * math.sqrt(variance)


def test_any_column_names(spark):
    names = ["_local", "_again", "_at", "_part", "_rank", "_ends", "_block", "_base", "_in", "_n", "row", "n", "a.b"]
    df = spark.createDataFrame([tuple(range(i, i + len(names))) for i in range(50)], [*names])
    out = sharding.shard(df, 4, seed=3)
    assert out.columns == [*names, "shard", "slot"]
    rows = out.collect()
    assert sorted(tuple(r)[:-2] for r in rows) == [tuple(range(i, i + len(names))) for i in range(50)]
    assert sorted((r.shard, r.slot) for r in rows) == [(s, k) for s in range(4) for k in range(13 if s < 2 else 12)]


def test_rows_go_to_shards_uniformly():
    """To which shards 40 rows of 5 partitions go in 4000 drawn matrices: chi-squared within five deviations."""
    rng, counts = random.Random(2), np.zeros((40, 4))
    for _ in range(4000):
        matrix = sharding.communication_matrix([8] * 5, [10] * 4, rng.randrange(1 << 40))
        for part, line in enumerate(matrix):
            assert sum(line) == 8
            places = [s for s, n in enumerate(line) for _ in range(n)]
            rng.shuffle(places)
            for k, s in enumerate(places):
                counts[part * 8 + k, s] += 1
    chi = ((counts - 1000) ** 2 / 1000).sum()
    assert abs(chi - 120) < 5 * math.sqrt(240)
