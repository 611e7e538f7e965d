"""A way to name an intermediate value inside a Column expression."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value evaluated once: expressions that use it often stay small."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def once(function: Callable[..., Column]) -> Callable[..., Column]:
    """The function of a column with its first argument evaluated once."""

    @wraps(function)
    def run(c: Column, *more, **named) -> Column:
        return let(c, lambda x: function(x, *more, **named))

    return run
