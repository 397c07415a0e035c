"""Filters that users put together, as predicates that reach the scan."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_COMPARE = {
    "=": lambda c, v: c == v, "!=": lambda c, v: c != v, "<": lambda c, v: c < v, "<=": lambda c, v: c <= v, ">": lambda c, v: c > v, ">=": lambda c, v: c >= v,
    "starts": lambda c, v: c.startswith(v),
}


def predicate(df: DataFrame, tree: dict[str, Any] | None) -> Column:
    """A filter tree as one predicate over ``df``'s own columns.

    A tree is {"and": [trees]}, {"or": [trees]}, {"not": tree}, {"column": name, "is": comparison, "value": value}, with "in" (a list)
    and "null" (true or false) beside the comparisons. None and an empty "and" keep all rows, an empty "or" and an empty "in" none.
    Values become literals of the column's type, never text of a query, so that they are pushed down; unknown names, comparisons and
    values that don't fit the type are errors. A value of None is one too: ask for "null".
    """
    if tree is None:
        return F.lit(True)
    if set(tree) == {"and"} or set(tree) == {"or"}:
        ((how, parts),) = tree.items()
        made = [predicate(df, t) for t in parts]
        return reduce(and_ if how == "and" else or_, made) if made else F.lit(how == "and")
    if set(tree) == {"not"}:
        return ~predicate(df, tree["not"])
    if set(tree) != {"column", "is", "value"}:
        raise ValueError(f"not a filter: {sorted(tree)}")
    name, how, value = tree["column"], tree["is"], tree["value"]
    if name not in df.columns:
        raise ValueError(f"no column {name!r}")
    kind, c = df.schema[name].dataType, df["`" + name.replace("`", "``") + "`"]
    if how == "null":
        return c.isNull() if value else c.isNotNull()

    def fitting(v: Any) -> Column:
        text = isinstance(v, str)
        if v is None or isinstance(v, (list, dict)) or (kind.typeName() == "string") != text and kind.typeName() not in ("date", "timestamp", "timestamp_ntz") or isinstance(v, bool) != (kind.typeName() == "boolean"):
            raise ValueError(f"{v!r} does not fit {name} of type {kind.simpleString()}")
        # a fraction against whole numbers stays a fraction
        return F.lit(v) if isinstance(v, float) else F.lit(v).cast(kind)

    if how == "in":
        return c.isin([fitting(v) for v in value]) if value else F.lit(False)
    if how not in _COMPARE or (how == "starts" and kind.typeName() != "string"):
        raise ValueError(f"no comparison {how!r} for {name}")
    return _COMPARE[how](c, fitting(value))


def filtered(df: DataFrame, tree: dict[str, Any] | None) -> DataFrame:
    return df.where(predicate(df, tree))
