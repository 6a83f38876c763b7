"""Names of columns, and expressions with a name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def free_name(df: DataFrame, name: str) -> str:
    """A column name that df does not have, whatever its letters' case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def bound(c: Column, f: Callable[[Column], Column]) -> Column:
    """f of c, where c is worked out once a row however often f names it. Spark writes an expression out at each place that names it, and inside the functions of arrays it does not share what is equal."""
    return F.transform(F.array(c), f)[0]
