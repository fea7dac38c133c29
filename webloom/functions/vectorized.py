"""Arrow UDFs that are made when used, so that workers can import their modules."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column
from pyspark.sql import functions as F


def vectorized(returns: str) -> Callable[[Callable], Callable[..., Column]]:
    """Decorator: a function over pandas series as a column expression of type ``returns``."""

    def made(f: Callable) -> Callable[..., Column]:
        @wraps(f)
        def column(*columns: Column) -> Column:
            return F.pandas_udf(f, returns)(*columns)

        return column

    return made
