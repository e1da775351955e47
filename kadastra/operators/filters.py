"""Predicate trees and facet filters as one Column each, so that they reach the scan."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_TESTS = {
    "$eq": lambda c, v: c == v, "$ne": lambda c, v: c != v, "$gt": lambda c, v: c > v, "$gte": lambda c, v: c >= v, "$lt": lambda c, v: c < v, "$lte": lambda c, v: c <= v,
    "$in": lambda c, v: c.isin(list(v)), "$nin": lambda c, v: ~c.isin(list(v)),
}


def predicate(tree: dict[str, Any]) -> Column:
    """A tree of $and, $or and comparisons by column; an empty tree holds for every row."""
    parts = []
    for key, value in tree.items():
        if key in ("$and", "$or"):
            parts.append(reduce(lambda a, b: a & b if key == "$and" else a | b, map(predicate, value)))
        elif isinstance(value, dict):
            parts += [_TESTS[op](F.col(key), v) for op, v in value.items()]
        else:
            parts.append(F.col(key) == value)
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def facets(**values: Any) -> Column:
    """Equality on every facet that has a value."""
    return predicate({k: v for k, v in values.items() if v is not None})


def lookup(df: DataFrame, key: str, value: str, columns: Sequence[str]) -> DataFrame:
    """Rows of a key, case aside; of the columns asked for those that exist."""
    return df.where(F.lower(key) == value.lower()).select(*(c for c in columns if c in df.columns))
