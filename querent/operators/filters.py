"""The filter dialect over payload fields, with two-valued logic: a missing field decides, it never makes a row unknown."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


class FilterError(ValueError):
    """An expression that the dialect doesn't know."""


def _compare(op, field: Column, value) -> Column:
    if isinstance(value, (dict, list)) or value is None:
        raise FilterError(f"{op} needs a scalar")
    made = {"$gt": field > value, "$gte": field >= value, "$lt": field < value, "$lte": field <= value}[op]
    return F.coalesce(made, F.lit(False))


def _member(field: Column, values) -> Column:
    if not isinstance(values, (list, tuple, set, frozenset)):
        return F.lit(False)
    known = [v for v in values if v is not None]
    hit = F.coalesce(field.isin(*known), F.lit(False)) if known else F.lit(False)
    return hit | field.isNull() if len(known) < len(list(values)) else hit


def _field(field: Column, test) -> Column:
    if not isinstance(test, dict):
        return field.eqNullSafe(F.lit(test))
    parts = []
    for op, value in test.items():
        if op == "$eq":
            parts.append(field.eqNullSafe(F.lit(value)))
        elif op == "$ne":
            parts.append(~field.eqNullSafe(F.lit(value)))
        elif op == "$in":
            parts.append(_member(field, value))
        elif op == "$nin":
            parts.append(~_member(field, value))
        elif op in ("$gt", "$gte", "$lt", "$lte"):
            parts.append(_compare(op, field, value))
        elif op == "$exists":
            parts.append(field.isNotNull() if value else field.isNull())
        elif op == "$not":
            parts.append(~_field(field, value))
        else:
            raise FilterError(f"unknown operator {op}")
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def predicate(expression: dict, fields=F.col) -> Column:
    """The expression as a Column; an empty one holds for every row."""
    parts = []
    for key, value in (expression or {}).items():
        if key in ("$and", "$or"):
            inner = [predicate(e, fields) for e in value]
            parts.append(reduce((lambda a, b: a & b) if key == "$and" else (lambda a, b: a | b), inner, F.lit(key == "$and")))
        elif key == "$not":
            parts.append(~predicate(value, fields))
        elif key.startswith("$"):
            raise FilterError(f"unknown operator {key}")
        else:
            parts.append(_field(fields(key), value))
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def scoped(expression: dict, tenant: str, acl_hashes: list[str]) -> Column:
    """A leg's filter within a principal's scope; a leg cannot widen it."""
    return predicate(expression) & predicate({"tenant_id": tenant, "acl_hash": {"$in": [*acl_hashes, "public"]}})
