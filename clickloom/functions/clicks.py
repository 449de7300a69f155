"""Column functions over click arrays and (numerator, denominator) parameters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from clickloom.config import RANKS

#: Rank that stands for "nothing was clicked on the page" and for "no click above this rank".
NO_CLICK, NO_PREVIOUS = 10, 9
CEILING = 1 - 1e-6


def clicked_ranks(clicks: Column) -> Column:
    return F.filter(F.transform(clicks, lambda c, i: F.when(c == 1, i)), lambda x: x.isNotNull())


def last_click(clicks: Column) -> Column:
    """Highest clicked rank; 10 without a click."""
    return F.coalesce(F.array_max(clicked_ranks(clicks)), F.lit(NO_CLICK))


def previous_clicks(clicks: Column) -> Column:
    """For each rank the nearest clicked rank above it; 9 without one."""
    above = lambda r: F.array_max(F.filter(clicked_ranks(clicks), lambda x: x < r))
    return F.transform(F.sequence(F.lit(0), F.lit(RANKS - 1)), lambda r: F.coalesce(above(r), F.lit(NO_PREVIOUS)))


def slot(rank: Column, previous: Column, exact: bool = False) -> Column:
    """Number of the (rank, previous click) cell.

    The triangular number plus the previous rank gives eight pairs of cells one number, as 9 stands for "none";
    ``exact`` keeps all cells apart.
    """
    if exact:
        return (rank * 10 + previous).cast("int")
    return (F.floor(rank * (rank + 1) / 2) + previous).cast("int")


def value(num: Column, den: Column) -> Column:
    """num / den, at most 1 - 1e-6; what is no number (0 / 0) gives that ceiling too."""
    x = F.try_divide(num, den)
    return F.when(x < CEILING, x).otherwise(F.lit(CEILING))
