"""Values that an expression names several times."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), the value evaluated once for a row however often the body names it: inside a function of an array or map
    Spark evaluates what is named anew for each element."""
    return F.transform(F.array(value), lambda x: body(x))[0]
