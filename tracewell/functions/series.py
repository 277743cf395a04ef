"""Column functions over ordered series: fills, rolling figures, and small helpers.

``keys`` are the columns that name a series and ``order`` the one that orders it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

START, END = Window.unboundedPreceding, Window.unboundedFollowing


def filled(c: Column, *keys: str, order: str = "t") -> Column:
    """Gaps take the last value before them; leading gaps stay."""
    return F.last(c, ignorenulls=True).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(START, 0))


def back_filled(c: Column, *keys: str, order: str = "t") -> Column:
    """Gaps take the next value after them; trailing gaps stay. Read in reverse, so that each row is looked at once."""
    return F.last(c, ignorenulls=True).over(Window.partitionBy(*keys).orderBy(F.desc(order)).rowsBetween(START, 0))


def both_ways(c: Column, *keys: str, order: str = "t") -> Column:
    """Gaps take the last value before them, leading gaps the first value after them."""
    return F.coalesce(filled(c, *keys, order=order), back_filled(c, *keys, order=order))


def rolling(c: Column, by: WindowSpec, width: int, least: int, what) -> Column:
    """``what(c)`` over the last ``width`` rows, null with fewer than ``least`` values."""
    w = by.rowsBetween(1 - width, 0)
    return F.when(F.count(c).over(w) >= least, what(c).over(w))


def clipped(c: Column, low, high) -> Column:
    """c within [low, high]; null stays null."""
    return F.when(c.isNotNull(), F.greatest(F.least(c, high), low))


def unit(c: Column) -> Column:
    return clipped(c, F.lit(0.0), F.lit(1.0))
