"""Formulas over ``eml(x, y) = exp(x) - ln(y)`` as columns.

A formula is ``"1"``, ``"x"``, ``("f", value)`` or ``("eml", left, right)``.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

from pyspark.sql import Column
from pyspark.sql import functions as F

Formula = str | tuple
#: Fixed value: largest magnitude of a finite node.
MAX_ABS = 1e6


def eml(x: Column, y: Column) -> Column:
    """NaN unless ``y`` is over 0."""
    return F.when(y > 0, F.exp(x) - F.log(y)).otherwise(F.lit(float("nan")))


def _gate(c: Column) -> Column:
    return F.when(F.abs(c) <= MAX_ABS, c)  # null for NaN too: it sorts above every number


def _node(formula: Formula, x: Column) -> Column:
    """Null where the node or one below fails the gate."""
    if formula == "1":
        return F.lit(1.0)
    if formula == "x":
        return _gate(x)
    if formula[0] == "f":
        return _gate(F.lit(float(formula[1])))
    return _gate(eml(_node(formula[1], x), _node(formula[2], x)))


def predict(formula: Formula, x: Column) -> Column:
    """The formula's value, NaN where any node isn't finite or is over 1e6 in magnitude."""
    return F.coalesce(_node(formula, x.cast("double")), F.lit(float("nan")))


def rpn(formula: Formula) -> str:
    if isinstance(formula, str):
        return formula
    return "f" if formula[0] == "f" else f"{rpn(formula[1])} {rpn(formula[2])} eml"


def leaves(formula: Formula) -> int:
    return 1 if formula in ("1", "x") or formula[0] == "f" else leaves(formula[1]) + leaves(formula[2])


def _shapes(nodes: int) -> Iterator[Formula]:
    if nodes == 0:
        yield "1"
    for left in range(nodes):
        for a, b in product(list(_shapes(left)), list(_shapes(nodes - 1 - left))):
            yield ("eml", a, b)


def _fill(shape: Formula, kinds: Iterator[str]) -> Formula:
    if shape == "1":
        kind = next(kinds)
        return ("f", 1.0) if kind == "f" else kind
    left = _fill(shape[1], kinds)
    return ("eml", left, _fill(shape[2], kinds))


def enumerate_formulas(max_nodes: int) -> list[Formula]:
    """All formulas of up to ``max_nodes`` operators, by size, shape and leaves; fewer than 13 leaves.

    The first leaf changes fastest, through 1, x and f (of value 1).
    """
    return [_fill(shape, iter(reversed(kinds))) for n in range(1, max_nodes + 1) if n + 1 < 13 for shape in _shapes(n) for kinds in product("1xf", repeat=n + 1)]


def constants(formula: Formula) -> list[float]:
    if isinstance(formula, str):
        return []
    return [formula[1]] if formula[0] == "f" else [*constants(formula[1]), *constants(formula[2])]


def with_constants(formula: Formula, values: Iterator[float]) -> Formula:
    if isinstance(formula, str):
        return formula
    if formula[0] == "f":
        return ("f", next(values))
    left = with_constants(formula[1], values)
    return ("eml", left, with_constants(formula[2], values))
