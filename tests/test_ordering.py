"""Exact quantiles, blocked order operators, the paint fold."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from placewise.operators import brush, prefix, ranking
from placewise.operators.quantile import _bucket, _decades, exact_quantiles

PROBS = {"p1": 0.01, "median": 0.5, "p99": 0.99, "p995": 0.995, "top": 1.0}


@pytest.mark.parametrize("case", ["uniform", "outlier", "constant", "few", "third", "one", "negative", "decades"])
def test_quantiles_match_numpy(spark, case):
    rng = np.random.default_rng(11)
    data = {
        "uniform": rng.random(3000), "outlier": np.append(rng.random(2000), [1e12, -1e9]), "constant": np.full(50, 4.25), "few": np.array([1.0, 2.0, 4.0]),
        "third": np.concatenate([np.full(1000, 0.5), rng.normal(size=2000)]), "one": np.array([7.0]), "negative": -np.exp(rng.normal(size=1500) * 4),
        "decades": 10.0 ** rng.uniform(-10, 11, 3000),
    }[case]
    df = spark.createDataFrame([(float(v),) for v in data] + [(None,), (float("nan"),)], "v double")
    row = exact_quantiles(df, "v", PROBS).first()
    for name, p in PROBS.items():
        assert row[name] == pytest.approx(np.quantile(data, p), rel=1e-12, abs=1e-12), name


def test_quantiles_per_layer(spark):
    rng = np.random.default_rng(2)
    layers = {k: rng.gamma(1.0 + i, size=400 + i) for i, k in enumerate("abc")}
    df = spark.createDataFrame([(k, float(v)) for k, vs in layers.items() for v in vs], "axis string, v double")
    got = {r.axis: r for r in exact_quantiles(df, "v", PROBS, ["axis"]).collect()}
    for k, vs in layers.items():
        assert [got[k][n] for n in PROBS] == pytest.approx([np.quantile(vs, p) for p in PROBS.values()])


def test_decades_leave_few_values_in_a_bucket(spark):
    rng = np.random.default_rng(1)
    df = spark.createDataFrame([(float(v),) for v in 10.0 ** rng.uniform(-10, 11, 20_000)], "v double").withColumns({"lo": F.lit(1e-10), "hi": F.lit(1e11)})
    most = df.groupBy(_bucket("v", "lo", "hi", _decades)).count().agg(F.max("count")).first()[0]
    assert most < 30


def test_quantile_of_nothing(spark):
    df = spark.createDataFrame([(None,)], "v double")
    assert exact_quantiles(df, "v", {"m": 0.5}).first().m is None


def test_blocked_order_operators(spark):
    rng = random.Random(4)
    data = [(rng.choice("aaab"), o, rng.randint(1, 9)) for o in rng.sample(range(-500, 5000), 600)]
    df = spark.createDataFrame(data, "k string, o bigint, v int")
    sums = {(r.k, r.o): r.s for r in prefix.running_sum(df, ["k"], "o", "v", "s", block=64).collect()}
    counts = {(r.k, r.o): r.n for r in prefix.running_count(df, ["k"], "o", "n", block=64).collect()}
    previous = {(r.k, r.o): r.p for r in prefix.previous_value(df, ["k"], "o", "p", block=64).collect()}
    for k in "ab":
        total, last = 0, None
        for i, (_k, o, v) in enumerate(sorted(d for d in data if d[0] == k)):
            total += v
            assert (sums[k, o], counts[k, o], previous[k, o]) == (total, i + 1, last)
            last = o


def test_blocks_of_sparse_order_values_are_even(spark):
    rng = random.Random(8)
    hashed = [rng.randrange(-(1 << 62), 1 << 62) for _ in range(6000)]
    data = [("hot", o) for o in hashed] + [("cold", o) for o in hashed[:50]] + [(None, o) for o in hashed[:300]]
    df = spark.createDataFrame(data, "k string, o bigint").repartition(7)
    for keys in (["k"], []):
        sizes = prefix._blocked(df, keys, "o", 100).groupBy(*keys, "_block").count().collect()
        hot = [r["count"] for r in sizes if not keys or r.k == "hot"]
        assert 60 <= len(hot) <= 130 and max(hot) <= 125 and min(hot) >= 20
        assert not keys or [r["count"] for r in sizes if r.k == "cold"] == [50]
    got = {(r.k, r.o): r.n for r in prefix.running_count(df, ["k"], "o", "n", block=100).collect()}
    for k in ("hot", "cold", None):
        assert [got[k, o] for o in sorted(o for name, o in data if name == k)] == list(range(1, sum(name == k for name, _ in data) + 1))


def test_missing_order_values_come_first(spark):
    df = spark.createDataFrame([(None, 5), *[(o * 1000, 1) for o in range(40)]], "o bigint, v int")
    sums = {r.o: r.s for r in prefix.running_sum(df, [], "o", "v", "s", block=8).collect()}
    assert sums[None] == 5 and sums[0] == 6 and sums[39_000] == 45


def test_numbering_with_hashed_order_values(spark):
    df = spark.range(900).select(F.xxhash64("id").alias("o"), (F.col("id") % 2).cast("string").alias("k"), F.lit("p").alias("p"), F.lit("n").alias("n"))
    names = {r.unique_key for r in ranking.dedupe_keys(df, "k", "o", "p", "n").collect()}
    assert names == {f"{k}" if i == 1 else f"{k}#{i}" for k in "01" for i in range(1, 451)}


def test_dedupe_keys(spark):
    df = spark.createDataFrame([(0, "A", "c", "x"), (1, "A", "c", "x"), (2, "B", "c", "x"), (3, "A", "c", "x"), (4, None, "", "n"), (5, "", "q", None)], "o int, k string, p string, n string")
    got = [r.unique_key for r in ranking.dedupe_keys(df, "k", "o", "p", "n").orderBy("o").collect()]
    assert got == ["A", "A#2", "B", "A#3", "??::n", "q::?"]


def cells(df):
    return sorted((r.level, r.cx, r.cy) for r in df.collect())


def test_erase_splits_the_painted_parent(spark):
    events = spark.createDataFrame([(1, "paint", 1, 0, 0), (2, "erase", 2, 1, 1)], "seq bigint, op string, level int, cx int, cy int")
    assert cells(brush.fold_mask(events)) == [(2, 0, 0), (2, 0, 1), (2, 1, 0)]


def test_repeated_paint_changes_nothing(spark):
    events = spark.createDataFrame([(i, "paint", 3, 2, 5) for i in range(4)] + [(9, "paint", 5, 8, 20)], "seq bigint, op string, level int, cx int, cy int")
    assert cells(brush.fold_mask(events)) == [(3, 2, 5)]


@pytest.mark.parametrize("seed", range(4))
def test_fold_matches_a_replayed_canvas(spark, seed):
    rng = random.Random(seed)
    finest, canvas, log = 5, np.zeros((32, 32), bool), []
    for seq in range(120):
        level, op = rng.choice([0, 1, 2, 3, 4, 5, 5, 5]), rng.choice(["paint", "paint", "erase"])
        cx, cy = rng.randrange(1 << level), rng.randrange(1 << level)
        log.append((seq, op, level, cx, cy))
        n = 1 << (finest - level)
        canvas[cy * n:(cy + 1) * n, cx * n:(cx + 1) * n] = op == "paint"
    events = spark.createDataFrame(log, "seq bigint, op string, level int, cx int, cy int")
    seen = np.zeros((32, 32), int)
    for level, cx, cy in cells(brush.fold_mask(events)):
        n = 1 << (finest - level)
        seen[cy * n:(cy + 1) * n, cx * n:(cx + 1) * n] += 1
    assert (seen == canvas).all()


def test_merging_batches_keeps_what_decides(spark):
    rng = random.Random(7)
    log = [(seq, rng.choice(["paint", "erase"]), (level := rng.choice([0, 2, 4, 5, 5])), rng.randrange(1 << level), rng.randrange(1 << level)) for seq in range(150)]
    schema = "seq bigint, op string, level int, cx int, cy int"
    late, early, none = log[60:], log[:80], []
    state = brush.compact_events(spark.createDataFrame(late, schema))
    for batch in (early, none, early[:20]):
        state = brush.merge_events(state, spark.createDataFrame(batch, schema))
    newest = {}
    for seq, op, level, cx, cy in log:
        newest[level, cx, cy] = (op, seq)
    above = lambda c: [newest[u] for k in range(1, c[0] + 1) if (u := (c[0] - k, c[1] >> k, c[2] >> k)) in newest]
    want = sorted((*c, op, seq) for c, (op, seq) in newest.items() if all(s < seq for _, s in above(c)))
    assert sorted(tuple(r) for r in state.select("level", "cx", "cy", "op", "seq").collect()) == want
    assert cells(brush.fold_mask(state)) == cells(brush.fold_mask(spark.createDataFrame(log, schema)))


def test_erase_far_below_a_coarse_cell_stays_small(spark):
    events = spark.createDataFrame([(1, "paint", 0, 0, 0), (2, "erase", 16, 40000, 12345)], "seq bigint, op string, level int, cx int, cy int")
    assert len(cells(brush.fold_mask(events))) == 3 * 16


def test_deltas_by_hand_and_back(spark):
    mask = spark.createDataFrame([(2, 1, 1), (2, 1, 2), (2, 2, 2)], "level int, cx int, cy int")
    deltas = brush.mask_deltas(mask)
    assert [r.delta for r in deltas.orderBy("key").collect()] == [5, 4, 1]
    assert cells(brush.mask_from_deltas(deltas.withColumnRenamed("key", "pos"))) == [(2, 1, 1), (2, 1, 2), (2, 2, 2)]


def test_brush_wraps_and_is_cut(spark):
    stroke = spark.createDataFrame([(1, "paint", 3, 0, 0, 1)], "seq int, op string, level int, cx int, cy int, r int")
    got = {(r.cx, r.cy) for r in brush.brush_cells(stroke).collect()}
    assert got == {(0, 0), (1, 0), (7, 0), (0, 1), (1, 1), (7, 1)}


def test_mask_at_sees_ancestors_and_descendants(spark):
    mask = spark.createDataFrame([(1, 0, 0), (6, 63, 63)], "level int, cx int, cy int")
    view = spark.createDataFrame([(3, 3, 3), (3, 7, 7), (3, 5, 5)], "level int, cx int, cy int")
    assert cells(brush.mask_at(view, mask)) == [(3, 3, 3), (3, 7, 7)]
    drawn = {(r.cx, r.cy): r.f_draw for r in brush.mask_axis(view, mask).collect()}
    assert drawn == {(3, 3): 1.0, (7, 7): 1.0, (5, 5): 0.0}


def test_top_n_ties_go_to_the_higher_index(spark):
    df = spark.createDataFrame([(0, 0, i, v) for i, v in enumerate([3.0, 5.0, 5.0, 0.0, 2.5, 1.0, 0.5])], "row int, col int, crop int, value double")
    got = [(r.crop, r.amount) for r in ranking.top_n_per_cell(df, "crop").orderBy("rank").collect()]
    assert got == [(2, 5), (1, 5), (0, 3), (4, 2), (5, 1)]
