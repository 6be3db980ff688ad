"""Column helpers with numpy's rules for missing numbers: a comparison with NaN or NULL is false."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_DOUBLE = 1.7976931348623157e308


def _nan_to_num(x: str) -> str:
    return f"CASE WHEN isnan({x}) THEN 0D WHEN {x} = double('inf') THEN {MAX_DOUBLE!r}D WHEN {x} = double('-inf') THEN {-MAX_DOUBLE!r}D ELSE {x} END"


def unrolled(name: str, width: int, known: str, otherwise: str) -> Column:
    """``known``, SQL that is written out element by element and so runs in generated code, where the array column ``name`` has
    ``width`` elements; else ``otherwise``, which calls a function for each. As one text, it is parsed at once."""
    return F.expr(f"CASE WHEN size({name}) = {width} THEN {known} ELSE {otherwise} END")


def clean_array(name: str, width: int) -> Column:
    """The array column with NaN as 0 and infinities as the largest double of their sign."""
    known = ", ".join(_nan_to_num(f"get({name}, {k})") for k in range(width))
    return unrolled(name, width, f"array({known})", f"transform({name}, x -> {_nan_to_num('x')})")


def nonfinite(name: str, width: int) -> Column:
    """How many elements of the array column are NaN or infinite."""
    known = " + ".join(f"CASE WHEN isnan(get({name}, {k})) OR abs(get({name}, {k})) = double('inf') THEN 1 ELSE 0 END" for k in range(width))
    return unrolled(name, width, f"({known})", f"size(filter({name}, x -> isnan(x) OR abs(x) = double('inf')))")


def number(c: Column) -> Column:
    """NaN as NULL, so that aggregates skip it."""
    return F.when(~F.isnan(c.cast("double")), c.cast("double"))


def test(c: Column, op: str, bound: Column | float) -> Column:
    """``c op bound``, strict, false where either is NaN or NULL."""
    c, bound = number(c), number(bound if isinstance(bound, Column) else F.lit(bound))
    return F.coalesce(c > bound if op == ">" else c < bound, F.lit(False))


def norm(parts: list[Column]) -> Column:
    return F.sqrt(reduce(lambda a, b: a + b, (F.pow(p, F.lit(2.0)) for p in parts)))
