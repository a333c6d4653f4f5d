"""Name an intermediate value inside one expression, so that it is computed and planned once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strict_json(text: Column) -> Column:
    """The whole text as one JSON value (VARIANT), else null.

    Spark's parser stops behind the first value; inside brackets anything that follows is an error or
    a second element.
    """
    wrapped = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    values = F.try_variant_get(wrapped, "$", "array<variant>")
    return let(values, lambda v: F.when(F.size(v) == 1, F.get(v, F.lit(0))))
