"""Name an intermediate value inside one expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of the value, computed once.

    Writing a column into an expression twice copies its whole tree; a few such
    steps deep, the plan is megabytes. A lambda over a one-element array binds the
    value instead, and the tree stays as long as the code that wrote it.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))
