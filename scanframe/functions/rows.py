"""Arrays of structs to rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """Bind ``value`` once and use it in ``body``, also inside lambdas there.

    A column used inside a lambda would be computed again for every element once the
    optimizer merges the projection that defines it.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def unnest(df: DataFrame, keep: list, array: Column, key: str) -> DataFrame:
    """One row per array element next to the columns in ``keep``; ``key`` is never null inside.

    Written as an outer generator plus a filter on its output: for an inner one the optimizer
    adds a size test of the array below it, which would compute a whole scan twice.
    """
    return df.select(*keep, F.inline_outer(array)).where(F.col(key).isNotNull())
