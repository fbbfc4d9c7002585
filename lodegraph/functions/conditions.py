"""Condition trees on metadata as one Column: {"$and": [...]}, {"$or": [...]}, {field: value}, {field: {"$in": [...]}}."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

COMPARED = {
    "$eq": lambda c, v: c == v, "$ne": lambda c, v: c != v, "$gt": lambda c, v: c > v, "$gte": lambda c, v: c >= v, "$lt": lambda c, v: c < v, "$lte": lambda c, v: c <= v,
    "$in": lambda c, v: c.isin(list(v)), "$nin": lambda c, v: ~c.isin(list(v)),
}


def condition(tree: Mapping | None) -> Column:
    """The tree as a filter, of plain comparisons, so that it is pushed into the scan. Several keys of one level must all hold.

    A null field fulfils nothing; an empty $in holds for no row, an empty $nin for all with a value, no tree for all.
    """
    if not tree:
        return F.lit(True)
    parts = []
    for key, value in tree.items():
        if key in ("$and", "$or"):
            if not value:
                raise ValueError(f"{key} of nothing")
            parts.append(reduce(Column.__and__ if key == "$and" else Column.__or__, map(condition, value)))
        elif key.startswith("$"):
            raise ValueError(f"no such operator: {key}")
        elif isinstance(value, Mapping):
            unknown = set(value) - set(COMPARED)
            if unknown or not value:
                raise ValueError(f"{key}: no such comparison: {sorted(unknown)}")
            for op, v in value.items():
                parts.append(F.col(key).isNotNull() & (F.lit(op == "$nin") if op in ("$in", "$nin") and not v else COMPARED[op](F.col(key), v)))
        else:
            parts.append(F.col(key).isNull() & False if value is None else F.col(key) == value)
    return reduce(Column.__and__, parts)
