"""Era numbers, their names in the several lists in use, and the floor that a birth year sets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Ranges by era number, and ordinal names.
RANGES = ("pre-1600", "1600-1680", "1680-1730", "1730-1800", "1800-1870", "1870-1950", "1950-present")
ORDINALS = ("Zeroth", "First", "Second", "Third", "Fourth", "Fifth", "Sixth")
FLOORS = ((1930, 6), (1850, 5), (1780, 4))


def label(number: Column) -> Column:
    return F.when(number.isNotNull(), F.concat(F.lit("Calc"), number.cast("string")))


def ordinal(number: Column) -> Column:
    return F.when(number.between(0, 6), F.element_at(F.array(*map(F.lit, ORDINALS)), (number + 1).cast("int"))).otherwise("")


def raised(number: Column, birth_year: Column) -> Column:
    """The era number, raised to the floor of the birth year; null where either is missing stays as it was."""
    n, y = F.expr("try_cast(%s as int)" % number) if isinstance(number, str) else number, birth_year
    floor = F.lit(None).cast("int")
    for year, era in reversed(FLOORS):
        floor = F.when(y >= year, era).otherwise(floor)
    return F.when(n.isNotNull() & floor.isNotNull() & (n < floor), floor).otherwise(n)
