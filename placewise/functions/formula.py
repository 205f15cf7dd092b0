"""Formulas over axes as Spark columns.

A formula is plain arithmetic, so Python's own expression grammar reads it; this module only rewrites
words to axis columns, checks the result and builds the ``Column``.
"""

from __future__ import annotations

import ast
import re

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from placewise import dims
from placewise.functions.rounding import clamp

#: Numbers, words, operators and brackets; anything else in a formula is ignored.
PIECES = r"\d+\.?\d*|\.\d+|[A-Za-z_]\w*|[-+*/()]"
PREFIX = "f_"


class FormulaError(ValueError):
    """The formula cannot be scored."""


def canonical_axis(word: str) -> str:
    return dims.ALIASES.get(word.lower(), word.lower())


def _prepare(formula: str) -> ast.expr:
    """The expression tree with every word replaced by its axis column name."""

    def piece(text: str) -> str:
        if text.lower() == "x":
            return "*"
        if text[0].isalpha() or text[0] == "_":
            return PREFIX + canonical_axis(text)
        return repr(float(text)) if text[0] in ".0123456789" else text

    source = " ".join(piece(p) for p in re.findall(PIECES, formula, flags=re.ASCII))
    if not source:
        raise FormulaError("Empty expression")
    try:
        return ast.parse(source, mode="eval").body
    except SyntaxError as error:
        raise FormulaError(f"Cannot read formula: {formula!r}") from error


def formula_axes(formula: str) -> list[str]:
    """Distinct axes in order of first use."""
    names = [n for n in ast.walk(_prepare(formula)) if isinstance(n, ast.Name)]
    return list(dict.fromkeys(n.id[len(PREFIX):] for n in sorted(names, key=lambda n: n.col_offset)))


def validate_formula(formula: str) -> list[str]:
    """The axes of a usable formula; raises with the reason otherwise."""
    axes = formula_axes(formula)
    unknown = [a for a in axes if a not in dims.AXES]
    if unknown:
        raise FormulaError(f"Unknown: {', '.join(unknown)}")
    if len(axes) > dims.MAX_FORMULA_AXES:
        raise FormulaError(f"Max {dims.MAX_FORMULA_AXES} axes in a formula")
    return axes


def ieee_divide(num: Column, den: Column) -> Column:
    """Floating-point division with signed infinities and NaN instead of an error."""
    return F.when(den == 0, num * F.pow(den, F.lit(-1.0))).otherwise(num / den)


def formula_column(formula: str) -> Column:
    """The formula over columns ``f_<axis>``; NULL as soon as one axis is NULL."""
    operators = {
        ast.Add: lambda a, b: a + b,
        ast.Sub: lambda a, b: a - b,
        ast.Mult: lambda a, b: a * b,
        ast.Div: ieee_divide,
    }

    def build(node: ast.expr) -> Column:
        if isinstance(node, ast.Name):
            return F.col(node.id)
        if isinstance(node, ast.Constant) and isinstance(node.value, float):
            return F.lit(node.value)
        if isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.USub):
            return -build(node.operand)
        if isinstance(node, ast.BinOp) and type(node.op) in operators:
            return operators[type(node.op)](build(node.left), build(node.right))
        raise FormulaError(f"Unsupported element in {formula!r}")

    return build(_prepare(formula))


def clamp_score(result: Column) -> Column:
    """Into [0, 1]; not-a-number has no score."""
    return F.when(~F.isnan(result), clamp(result, 0.0, 1.0))


def interval_product(a: tuple, b: tuple) -> tuple:
    corners = np.stack([a[0] * b[0], a[0] * b[1], a[1] * b[0], a[1] * b[1]])
    # 0 * inf: an endpoint that is only approached adds nothing beyond the other corners but zero
    corners = np.where(np.isnan(corners), 0.0, corners)
    return corners.min(axis=0), corners.max(axis=0)


def interval_quotient(a: tuple, b: tuple) -> tuple:
    corners = np.stack([a[0] / b[0], a[0] / b[1], a[1] / b[0], a[1] / b[1]])
    through = (b[0] <= 0) & (b[1] >= 0)
    low, high = np.nanmin(np.where(through, -np.inf, corners), axis=0), np.nanmax(np.where(through, np.inf, corners), axis=0)
    # over denominators that reach down to zero and not below, a numerator of one sign has results of that sign
    one_side = through & (b[0] == 0) & ~np.signbit(b[0])
    low = np.where(one_side & (a[0] >= 0), np.where(b[1] > 0, a[0] / b[1], 0.0), low)
    high = np.where(one_side & (a[1] <= 0), np.where(b[1] > 0, a[1] / b[1], 0.0), high)
    return low, high


class Formula:
    """A formula over NumPy arrays, for tasks that meet formulas as data.

    The same arithmetic in the same order as :func:`formula_column`, so both give the same doubles.
    """

    def __init__(self, text: str):
        self.axes = validate_formula(text)
        self.tree = _prepare(text)
        self._walk(self.tree, lambda name: 0.0, {k: lambda *a: 0.0 for k in self._values})  # refuses other elements

    _values = {
        ast.Add: lambda a, b: a + b,
        ast.Sub: lambda a, b: a - b,
        ast.Mult: lambda a, b: a * b,
        ast.Div: lambda a, b: a / b,
        ast.USub: lambda a: -a,
    }
    _bounds = {
        ast.Add: lambda a, b: (a[0] + b[0], a[1] + b[1]),
        ast.Sub: lambda a, b: (a[0] - b[1], a[1] - b[0]),
        ast.Mult: interval_product,
        ast.Div: interval_quotient,
        ast.USub: lambda a: (-a[1], -a[0]),
    }

    def _walk(self, node: ast.expr, leaf, operators: dict):
        if isinstance(node, ast.Name):
            return leaf(node.id[len(PREFIX):])
        if isinstance(node, ast.Constant) and isinstance(node.value, float):
            return leaf(node.value)
        if isinstance(node, ast.UnaryOp) and type(node.op) in operators:
            return operators[type(node.op)](self._walk(node.operand, leaf, operators))
        if isinstance(node, ast.BinOp) and type(node.op) in operators:
            return operators[type(node.op)](self._walk(node.left, leaf, operators), self._walk(node.right, leaf, operators))
        raise FormulaError("Unsupported element in a formula")

    def scores(self, values: dict[str, np.ndarray]) -> np.ndarray:
        """Scores in [0, 1]; NaN where the result is no number."""
        with np.errstate(all="ignore"):
            result = self._walk(self.tree, lambda x: np.float64(x) if isinstance(x, float) else values[x], self._values)
            return np.minimum(np.maximum(result, 0.0), 1.0)

    def best(self, low: dict[str, np.ndarray], high: dict[str, np.ndarray]) -> np.ndarray:
        """A bound that no score passes where each axis lies between ``low`` and ``high``.

        Rounded arithmetic is monotone, so bounds worked out on endpoints hold for every value between them.
        """
        with np.errstate(all="ignore"):
            leaf = lambda x: (np.float64(x), np.float64(x)) if isinstance(x, float) else (low[x], high[x])
            _, top = self._walk(self.tree, leaf, self._bounds)
            return np.minimum(np.maximum(np.where(np.isnan(top), 1.0, top), 0.0), 1.0)
