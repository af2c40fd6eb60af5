"""A value that is made once per row however often it is used."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value given as a lambda's element: Catalyst repeats an expression for each
    use of it in conditionals and lambdas, but not an element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))
