"""Scores of many profiles over one grid: all cells, or each profile's best places without looking at all cells.

Formulas and curves are data here: no formula reaches the driver and the plan has one shape for any number of profiles.
The grid is cut into squares of ``span`` cells, each axis of a square into blocks of ``side`` by ``side`` bytes with the
least and greatest byte beside them. What a formula can reach on a block follows from those two bytes by interval
arithmetic, so a task takes the blocks of a square in the order of what they may reach and stops when the next one cannot
change a profile's best places. Whole squares are left out the same way: each profile looks at its most promising square
first, and then only at squares that can beat what it found there.

Profiles meet squares in a shuffle keyed by square; squares that very many profiles ask for are sent several times and
take a share of them each.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from placewise.functions.formula import Formula, FormulaError
from placewise.session import written

#: Cells along a square's and a block's edge.
SPAN, SIDE = 1024, 16
#: Squares times axes whose bounds tasks are sent (24 bytes each); a finer grid asks for a larger span.
INDEXED = 1 << 20
#: Profiles that one copy of a square serves where they look for their best places.
SEARCHING = 4096
#: Blocks scored at once, and curves whose lookups a task keeps.
BATCH, KEPT = 16, 4096
SQUARE = ["gr", "gc"]
_LINEAR = np.arange(256) / 255.0


def lookup(points: list[dict] | None) -> np.ndarray:
    """The 256 scores of a curve, in 255ths; without a curve (``None``) a byte counts as it is."""
    if points is None:
        return _LINEAR
    x = np.arange(256) / 255.0
    y = np.full(256, 0.5)
    if points:
        p = sorted(points, key=lambda q: q["x"])
        for a, b in list(zip(p[:-1], p[1:]))[::-1]:
            along = (x - a["x"]) / (b["x"] - a["x"]) if b["x"] > a["x"] else 0.0
            here = (x >= a["x"]) & (x <= b["x"])
            y = np.where(here, a["y"] + along * (b["y"] - a["y"]), y)
        y = np.where(x >= p[-1]["x"], p[-1]["y"], y)
        y = np.where(x <= p[0]["x"], p[0]["y"], y)
    return np.floor(np.clip(1.0 - y, 0.0, 1.0) * 255.0 + 0.5) / 255.0


class Curves:
    """Lookups and their range minima and maxima, the latest few kept."""

    def __init__(self):
        self.kept: OrderedDict[tuple | None, tuple] = OrderedDict()

    def __call__(self, points: list[dict] | None) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
        key = None if points is None else tuple((p["x"], p["y"]) for p in points)
        if key not in self.kept:
            lut = lookup(points)
            least, most = [lut], [lut]
            for j in range(8):
                step = 1 << j
                least.append(np.minimum(least[-1][:-step], least[-1][step:]))
                most.append(np.maximum(most[-1][:-step], most[-1][step:]))
            self.kept[key] = lut, least, most
            if len(self.kept) > KEPT:
                self.kept.popitem(last=False)
        self.kept.move_to_end(key)
        return self.kept[key]

    def between(self, points: list[dict] | None, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest score over the bytes from ``low`` to ``high``; both between 1 and 255."""
        _, least, most = self(points)
        level = np.frexp(high - low + 1)[1] - 1
        a, b = np.empty(len(low)), np.empty(len(low))
        for j in np.unique(level):
            at = level == j
            lo, hi = low[at], high[at] - (1 << int(j)) + 1
            a[at] = np.minimum(least[j][lo], least[j][hi])
            b[at] = np.maximum(most[j][lo], most[j][hi])
        return a, b


def _asked(formula: str | None, active: str | None) -> Formula | None:
    """The formula of a profile, its active axis where it has none; nothing where it cannot be scored."""
    try:
        return Formula((formula or "").strip() or (active or ""))
    except FormulaError:
        return None


def pack(layer: DataFrame, span: int = SPAN, side: int = SIDE) -> DataFrame:
    """``gr, gc, axis, low, high, data``: the bytes of each square and axis, block by block; 0 where there are none.

    ``layer`` holds ``axis, row, col, byte``; of several bytes of a cell the largest counts.
    """
    blocks = span // side

    def lay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key = None, None
        for rows in batches:
            names = [rows.column(c) for c in ("gr", "gc", "axis")]
            code = np.zeros(rows.num_rows, bool)
            for c in names:
                code[1:] |= pc.not_equal(c.slice(1), c.slice(0, len(c) - 1)).to_numpy(zero_copy_only=False)
            edges = np.append(np.flatnonzero(np.append(True, code[1:])), rows.num_rows)
            at, byte = rows.column("at").to_numpy(), rows.column("byte").to_numpy()
            for a, b in zip(edges[:-1], edges[1:]):
                here = tuple(c[int(a)].as_py() for c in names)
                if here != key:
                    if key is not None:
                        yield packed(key, held)
                    held, key = np.zeros(span * span, np.uint8), here
                np.maximum.at(held, at[a:b], byte[a:b].astype(np.uint8))
        if key is not None:
            yield packed(key, held)

    def packed(key: tuple, data: np.ndarray) -> pa.RecordBatch:
        some = data[data > 0]
        return pa.RecordBatch.from_pydict({
            "gr": pa.array([key[0]], pa.int32()), "gc": pa.array([key[1]], pa.int32()), "axis": [key[2]],
            "low": pa.array([int(some.min())], pa.int32()), "high": pa.array([int(some.max())], pa.int32()), "data": pa.array([data.tobytes()], pa.binary()),
        })

    r, c = F.pmod("row", F.lit(span)), F.pmod("col", F.lit(span))
    block = F.floor(r / side) * blocks + F.floor(c / side)
    at = (block * side * side + F.pmod(r, F.lit(side)) * side + F.pmod(c, F.lit(side))).cast("long")
    cells = layer.where(F.col("byte").between(1, 255)).select(F.floor(F.col("row") / span).cast("int").alias("gr"), F.floor(F.col("col") / span).cast("int").alias("gc"), "axis", at.alias("at"), F.col("byte").cast("int").alias("byte"))
    keys = [*SQUARE, "axis"]
    return cells.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(lay, "gr int, gc int, axis string, low int, high int, data binary")


def with_curves(profiles: DataFrame, curves: DataFrame) -> DataFrame:
    """``profile, formula, active, curves``: each profile with its curves by axis."""
    active = F.col("active_axis") if "active_axis" in profiles.columns else F.lit(None).cast("string")
    per = curves.groupBy("profile").agg(F.map_from_entries(F.collect_list(F.struct("axis", "points"))).alias("curves"))
    return profiles.select("profile", "formula", active.alias("active")).join(per, "profile", "left")


class _Index:
    """Bounds of every square, by axis."""

    def __init__(self, rows: pa.Table, span: int):
        at = sorted(set(zip(rows.column("gr").to_pylist(), rows.column("gc").to_pylist())))
        place = {k: i for i, k in enumerate(at)}
        self.square, self.span = np.array(at, np.int32).reshape(-1, 2), span
        self.low, self.high = {}, {}
        where = np.array([place[k] for k in zip(rows.column("gr").to_pylist(), rows.column("gc").to_pylist())], np.int64)
        names = np.array(rows.column("axis").to_pylist(), object)
        for axis in set(names):
            mine = names == axis
            self.low[axis], self.high[axis] = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
            self.low[axis][where[mine]] = rows.column("low").to_numpy()[mine]
            self.high[axis][where[mine]] = rows.column("high").to_numpy()[mine]

    def reach(self, formula: Formula, curves: dict, luts: Curves) -> tuple[np.ndarray, np.ndarray]:
        """Squares that have every axis of a formula, and a bound on the scores of each."""
        return _reach(formula, curves, luts, self.low, self.high, len(self.square))


def _reach(formula: Formula, curves: dict, luts: Curves, low: dict, high: dict, n: int) -> tuple[np.ndarray, np.ndarray]:
    there = np.ones(n, bool)
    for a in formula.axes:
        there &= high[a] > 0 if a in high else False
    at = np.flatnonzero(there)
    if not len(at):
        return at, np.zeros(0)
    ranges = {a: luts.between(curves.get(a), low[a][at], high[a][at]) for a in formula.axes}
    best = formula.best({a: r[0] for a, r in ranges.items()}, {a: r[1] for a, r in ranges.items()})
    return at, np.broadcast_to(best, len(at))


class _Best:
    """The ``k`` best cells so far: score descending, then row and column."""

    def __init__(self, k: int, floor: tuple | None):
        self.k, self.floor = k, floor
        self.score, self.row, self.col = np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def worst(self) -> tuple | None:
        """What a further cell must come before: (-score, row, col)."""
        own = (-self.score[-1], self.row[-1], self.col[-1]) if len(self.score) == self.k else None
        return min((x for x in (own, self.floor) if x is not None), default=None)

    def take(self, score: np.ndarray, row: np.ndarray, col: np.ndarray) -> None:
        score, row, col = (np.concatenate(p) for p in ((self.score, score), (self.row, row), (self.col, col)))
        order = np.lexsort((col, row, -score))[: self.k]
        self.score, self.row, self.col = score[order], row[order], col[order]


class _Square:
    """The packed axes of a square."""

    def __init__(self, gr: int, gc: int, axes: dict[str, bytes], span: int, side: int):
        self.first, self.side, self.across = (gr * span, gc * span), side, span // side
        data = {a: np.frombuffer(b, np.uint8).reshape(-1, side * side) for a, b in axes.items()}
        self.block = np.flatnonzero(np.any([d.any(axis=1) for d in data.values()], axis=0))  # of seas nothing is kept
        self.data = {a: d[self.block] for a, d in data.items()}
        self.low, self.high = {}, {}
        for a, d in self.data.items():
            self.high[a] = d.max(axis=1).astype(np.int64)
            self.low[a] = np.where(d > 0, d, 255).min(axis=1).astype(np.int64)

    def corner(self, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = self.block[blocks]
        return self.first[0] + at // self.across * self.side, self.first[1] + at % self.across * self.side

    def scores(self, formula: Formula, curves: dict, luts: Curves, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """Score, row and column of the cells of some blocks that have a score, and how many cells were looked at."""
        if not set(formula.axes) <= set(self.data):
            return np.zeros(0), blocks[:0], blocks[:0], 0
        data = {a: self.data[a][blocks] for a in formula.axes}
        there = np.ones((len(blocks), self.side**2), bool)
        for d in data.values():
            there &= d > 0
        block, at = np.nonzero(there)
        if not len(block):
            return np.zeros(0), block, at, 0
        score = formula.scores({a: luts(curves.get(a))[0][d[block, at]] for a, d in data.items()})
        score = np.broadcast_to(score, len(block))
        known = ~np.isnan(score)
        at, (row, col) = at[known], self.corner(blocks[block[known]])
        return score[known], row + at // self.side, col + at % self.side, len(block)

    def best(self, formula: Formula, curves: dict, luts: Curves, k: int, floor: tuple | None) -> tuple[_Best, int]:
        """The ``k`` best cells that come before ``floor``, and how many cells were looked at."""
        blocks, reach = _reach(formula, curves, luts, self.low, self.high, len(self.block))
        order = np.lexsort((blocks, -reach))
        blocks, reach = blocks[order], reach[order]
        found, looked, at = _Best(k, floor), 0, 0
        while at < len(blocks):
            worst = found.worst()
            if worst is not None and -reach[at] > worst[0]:
                break
            some = blocks[at : at + BATCH]
            if worst is not None:
                row, col = self.corner(some)
                r = reach[at : at + BATCH]
                some = some[(-r < worst[0]) | ((-r == worst[0]) & ((row < worst[1]) | ((row == worst[1]) & (col < worst[2]))))]
            at += BATCH
            if not len(some):
                continue
            score, row, col, n = self.scores(formula, curves, luts, np.sort(some))
            looked += n
            if worst is not None:
                near = (-score < worst[0]) | ((-score == worst[0]) & ((row < worst[1]) | ((row == worst[1]) & (col < worst[2]))))
                score, row, col = score[near], row[near], col[near]
            found.take(score, row, col)
        return found, looked


def _index(squares: DataFrame, span: int):
    bounds = squares.select(*SQUARE, "axis", "low", "high")
    if (n := bounds.count()) > INDEXED:
        raise ValueError(f"{n} squares and axes are too many to send to tasks; take a span above {span}")
    return squares.sparkSession.sparkContext.broadcast(_Index(bounds.toArrow(), span))


def _ask(profiles: DataFrame, squares: DataFrame, span: int, work: str) -> DataFrame:
    """Which squares each profile asks for: every one (``all``), the most promising (``first``), or those that may beat
    what it has (``rest``; ``had`` and ``least`` say what that is)."""
    index = _index(squares, span)

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        luts = Curves()
        for rows in batches:
            who, which = [], []
            columns = [rows.column(c).to_pylist() for c in rows.schema.names if c in ("formula", "active", "curves", "had", "least")]
            for i, (formula, active, curves, *known) in enumerate(zip(*columns)):
                if (asked := _asked(formula, active)) is None:
                    continue
                at, reach = index.value.reach(asked, dict(curves or ()), luts)
                if work == "first" and len(at):
                    at = at[[int(np.argmax(reach))]]
                elif work == "rest":
                    had, least = known
                    first = index.value.square[at] * span
                    wanted = np.array([had is None or tuple(s) != (had["gr"], had["gc"]) for s in index.value.square[at].tolist()], bool)
                    if least is not None:
                        same = (reach == least["score"]) & ((first[:, 0] < least["row"]) | ((first[:, 0] == least["row"]) & (first[:, 1] < least["col"])))
                        wanted &= (reach > least["score"]) | same
                    at = at[wanted]
                who += [i] * len(at)
                which += at.tolist()
            square = index.value.square[which] if which else np.zeros((0, 2), np.int32)
            out = rows.take(pa.array(who, pa.int64()))
            yield out.append_column("gr", pa.array(square[:, 0])).append_column("gc", pa.array(square[:, 1]))

    fields = [*profiles.schema.fields, T.StructField("gr", T.IntegerType()), T.StructField("gc", T.IntegerType())]
    return profiles.mapInArrow(choose, T.StructType(fields))


def _meet(asks: DataFrame, squares: DataFrame, span: int, side: int, k: int | None, served: int) -> DataFrame:
    """``profile, row, col, score, looked, gr, gc`` of what asking profiles find; a row without a cell says that there is none."""
    profile = asks.schema["profile"]
    asks = written(asks, "asks")
    copies = asks.groupBy(*SQUARE).agg(F.ceil(F.count("*") / served).cast("int").alias("copies"))
    share = F.pmod(F.xxhash64("profile"), F.col("copies").cast("long")).cast("int")
    columns = ["profile", "formula", "active", "curves", "least"]
    asking = asks if "least" in asks.columns else asks.withColumn("least", F.lit(None).cast("struct<score:double,row:int,col:int>"))
    asking = asking.join(copies, SQUARE).select(*SQUARE, share.alias("copy"), F.lit(1).alias("part"), *columns)
    sent = squares.join(copies, SQUARE).select(*SQUARE, F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"), F.lit(0).alias("part"), "axis", "data")
    both = sent.unionByName(asking, allowMissingColumns=True)
    key = [*SQUARE, "copy"]

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        luts, here, axes, square = Curves(), None, {}, None
        for rows in batches:
            made = []
            part, profiles = rows.column("part").to_numpy(), rows.column("profile")
            keys = list(zip(*(rows.column(c).to_pylist() for c in key)))
            fields = {c: rows.column(c) for c in ("axis", "data", "formula", "active", "curves", "least")}
            for i in range(rows.num_rows):
                if keys[i] != here:
                    here, axes, square = keys[i], {}, None
                if part[i] == 0:
                    axes[fields["axis"][i].as_py()] = fields["data"][i].as_py()
                    continue
                if square is None:
                    square = _Square(here[0], here[1], axes, span, side)
                formula = _asked(fields["formula"][i].as_py(), fields["active"][i].as_py())
                curves = dict(fields["curves"][i].as_py() or ())
                if k is None:
                    score, row, col, looked = square.scores(formula, curves, luts, np.arange(len(square.block)))
                else:
                    least = fields["least"][i].as_py()
                    found, looked = square.best(formula, curves, luts, k, None if least is None else (-least["score"], least["row"], least["col"]))
                    score, row, col = found.score, found.row, found.col
                made.append((i, score, row, col, looked, here))
                if sum(len(m[1]) for m in made) > 1 << 16:
                    yield result(profiles, made)
                    made = []
            if made:
                yield result(profiles, made)

    def result(profiles: pa.Array, made: list) -> pa.RecordBatch:
        sizes = np.array([max(len(m[1]), 1) for m in made])
        fill = lambda j, none: np.concatenate([m[j] if len(m[j]) else np.array([none]) for m in made])
        empty = np.concatenate([np.full(max(len(m[1]), 1), not len(m[1])) for m in made])
        first = np.zeros(sizes.sum(), np.int64)
        first[np.cumsum(sizes) - sizes] = [m[4] for m in made]
        who = profiles.take(pa.array(np.repeat([m[0] for m in made], sizes)))
        return pa.RecordBatch.from_pydict({
            "profile": who, "row": pa.array(fill(2, 0).astype(np.int32), mask=empty), "col": pa.array(fill(3, 0).astype(np.int32), mask=empty),
            "score": pa.array(fill(1, 0.0), mask=empty), "looked": first,
            "gr": pa.array(np.repeat([m[5][0] for m in made], sizes).astype(np.int32)), "gc": pa.array(np.repeat([m[5][1] for m in made], sizes).astype(np.int32)),
        })

    fields = [T.StructField("profile", profile.dataType), *T._parse_datatype_string("row int, col int, score double, looked long, gr int, gc int").fields]
    return both.repartition(*key).sortWithinPartitions(*key, "part").mapInArrow(look, T.StructType(fields))


def score_all(layer: DataFrame, profiles: DataFrame, curves: DataFrame, span: int = SPAN, side: int = SIDE, served: int = 64) -> DataFrame:
    """``profile, row, col, score`` of every cell that a profile can score.

    ``profiles`` holds ``profile, formula`` and, if it likes, ``active_axis``, which is scored alone where the formula is
    empty; ``curves`` holds ``profile, axis, points``. An axis without a curve counts as its byte in 255ths. A profile
    whose formula cannot be read, names an unknown axis or too many has no rows, whatever the others say. One copy of a
    square's bytes serves ``served`` profiles.
    """
    squares = written(pack(layer, span, side), "squares")
    asks = _ask(with_curves(profiles, curves), squares, span, "all")
    return _meet(asks, squares, span, side, None, served).where(F.col("score").isNotNull()).select("profile", "row", "col", "score")


def search(layer: DataFrame, profiles: DataFrame, curves: DataFrame, k: int, span: int = SPAN, side: int = SIDE) -> DataFrame:
    """What :func:`best_places` and :func:`cells_looked_at` read: the best cells of the squares that profiles looked at."""
    squares = written(pack(layer, span, side), "squares")
    asking = written(with_curves(profiles, curves), "profiles")
    first = written(_meet(_ask(asking, squares, span, "first"), squares, span, side, k, SEARCHING), "found")
    place = F.struct(F.col("score").alias("score"), F.col("row").alias("row"), F.col("col").alias("col"))
    last = F.struct((-F.col("score")).alias("_down"), F.col("row").alias("_row"), F.col("col").alias("_col"))
    known = first.groupBy("profile").agg(
        F.first(F.struct(*SQUARE)).alias("had"),
        F.when(F.count("score") >= k, F.max_by(place, F.when(F.col("score").isNotNull(), last))).alias("least"),
    )
    rest = _meet(_ask(asking.join(known, "profile"), squares, span, "rest"), squares, span, side, k, SEARCHING)
    return written(first.unionByName(rest), "found")


def first_places(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("profile").orderBy(F.desc("score"), "row", "col")
    ranked = found.where(F.col("score").isNotNull()).withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= k).select("profile", "rank", "row", "col", "score")


def best_places(layer: DataFrame, profiles: DataFrame, curves: DataFrame, k: int, span: int = SPAN, side: int = SIDE) -> DataFrame:
    """``profile, rank, row, col, score``: each profile's ``k`` best cells, ties by row and column.

    The same cells as the first ``k`` of :func:`score_all`, of which most are never scored.
    """
    return first_places(search(layer, profiles, curves, k, span, side), k)


def cells_looked_at(found: DataFrame) -> DataFrame:
    """``profile, looked``: how many cells a search scored for each profile."""
    return found.groupBy("profile").agg(F.sum("looked").alias("looked"))
