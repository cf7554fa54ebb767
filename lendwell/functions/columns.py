"""Null-safe column helpers shared by features, reports and checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(numerator: Column, denominator: Column) -> Column:
    """Division that yields null, not an error, for a zero denominator."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def at_least(column: Column, floor: float) -> Column:
    """Elementwise floor; null stays null, which plain ``greatest`` would replace."""
    return F.when(column.isNotNull(), F.greatest(column, F.lit(floor)))


def clamp(column: Column, low: float, high: float) -> Column:
    """Limit to ``[low, high]``; null stays null."""
    return F.when(column.isNotNull(), F.least(F.greatest(column, F.lit(low)), F.lit(high)))


def flag(condition: Column) -> Column:
    """1 where the condition holds, 0 where it does not or is unknown."""
    return F.coalesce(condition, F.lit(False)).cast("int")


def rounded(column: Column, digits: int) -> Column:
    """Round halves away from zero as decimal arithmetic would.

    Sums of doubles depend on the order of the rows in their last digits; these are
    taken off first, so that a half is always seen as a half.
    """
    return F.round(F.round(column.cast("double"), 10), digits)


def below_bands(column: Column, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """Left-closed bands: first edge above the value names it, null takes the last label."""
    bands = F.when(column < edges[0], labels[0])
    for edge, label in zip(edges[1:], labels[1:]):
        bands = bands.when(column < edge, label)
    return bands.otherwise(labels[-1])


def cut(
    column: Column,
    edges: Sequence[float | None],
    labels: Sequence[str],
    include_lowest: bool = False,
) -> Column:
    """Right-closed bins ``(low, high]``; outside every bin is null.

    A last edge of None leaves the top bin open.
    """
    bins = None
    for position, label in enumerate(labels):
        low, high = edges[position], edges[position + 1]
        above = column >= low if include_lowest and position == 0 else column > low
        inside = above if high is None else above & (column <= high)
        bins = F.when(inside, label) if bins is None else bins.when(inside, label)
    return bins


def lookup(column: Column, codes: dict[str, int], default: int = 0) -> Column:
    """Constant mapping with a default for unknown or missing keys."""
    pairs = [F.lit(item) for pair in codes.items() for item in pair]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), column), F.lit(default))
