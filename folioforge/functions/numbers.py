"""Numbers as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded(c: Column, places: int) -> Column:
    """The decimal of so many places nearest to the double itself, as Python's round gives it; SQL's round goes by the shortest digits that name the double.

    They part where those digits end in a 5 behind the last place: there the double is a little above or below the
    middle, and what it is above it is worked out without an error: the double is the sum of two parts of few digits, whose products
    with the power of ten are whole in a double. If it is the middle, the even neighbour counts. Doubles up to a million, six places
    at most; null stays null.
    """
    if not 0 <= places <= 6:
        raise ValueError("0 to 6 places")
    ten = float(10 ** (places + 1))
    c = c.cast("double")
    middle = F.rint(c * ten)
    high = c.cast("float").cast("double")
    above = (high * ten - middle) + (c - high) * ten
    down = F.floor((middle - 5) / 10).cast("double")
    up, even = (down + 1) / (ten / 10), F.pmod(down, F.lit(2.0)) == 0
    down = down / (ten / 10)
    tie = (F.pmod(middle, F.lit(10.0)) == 5) & (F.round(c, places + 1) == c)
    return F.when(~tie, F.round(c, places)).when(above > 0, up).when((above < 0) | even, down).otherwise(up)
