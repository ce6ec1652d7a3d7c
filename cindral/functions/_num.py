"""Small helpers shared by the function modules."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

Number = Column | float | int


def col(v: Number | str) -> Column:
    """A Column of a Column, a column name or a number."""
    if isinstance(v, Column):
        return v
    return F.col(v) if isinstance(v, str) else F.lit(float(v))


def clip(v: Column, lo: float, hi: float) -> Column:
    """v within lo..hi; null stays null."""
    return F.when(v < lo, F.lit(lo)).when(v > hi, F.lit(hi)).otherwise(v)


def at_least(v: Column, lo: float) -> Column:
    """The larger of v and lo; null stays null (greatest() would skip it)."""
    return F.when(v < lo, F.lit(lo)).otherwise(v)


def at_most(v: Column, hi: float) -> Column:
    return F.when(v > hi, F.lit(hi)).otherwise(v)


def div(a: Column, b: Column) -> Column:
    """a / b, null where b is 0 (ANSI division would raise)."""
    return F.try_divide(a, b)


def lookup(key: Column, table: dict, default=None) -> Column:
    """Value of key in a small fixed table, as one CASE expression."""
    out = None
    for k, v in table.items():
        out = F.when(key == k, F.lit(v)) if out is None else out.when(key == k, F.lit(v))
    return out.otherwise(F.lit(default)) if default is not None else out


def digitize(v: Column, edges: list[float] | tuple[float, ...]) -> Column:
    """Number of edges at or below v; null for null."""
    n = F.lit(0)
    for e in edges:
        n = n + F.when(v >= float(e), 1).otherwise(0)
    return F.when(v.isNotNull(), n)


class InColumns:
    """What the equations that are needed both as Columns and on arrays are written in: here as Columns."""

    exp, ln, sqrt, div = staticmethod(F.exp), staticmethod(F.ln), staticmethod(F.sqrt), staticmethod(F.try_divide)
    at_least, at_most, clip = staticmethod(at_least), staticmethod(at_most), staticmethod(clip)

    @staticmethod
    def power(v, k):
        return F.pow(v if isinstance(v, Column) else F.lit(v), k if isinstance(k, Column) else F.lit(k))

    @staticmethod
    def pick(condition, a, b):
        return F.when(condition, a).otherwise(b)


class InArrays:
    """The same on NumPy arrays; what is not picked may be any number."""

    exp, ln, sqrt, at_least, at_most, clip, power, pick = (staticmethod(f) for f in (np.exp, np.log, np.sqrt, np.maximum, np.minimum, np.clip, np.power, np.where))

    @staticmethod
    def div(a, b):
        return np.divide(a, np.where(b == 0, np.nan, b))
