"""Containment of JSON values: what a metadata column must hold, as one condition."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What schema_of_variant calls numbers.
_NUMBERS = r"^(BIGINT|DOUBLE|FLOAT|DECIMAL\(.*\))$"


def _member(value: Column, path: str, key: str) -> tuple[Column, str]:
    """A variant and the path in it that lead to a member of the object at a path."""
    if "'" not in key:
        return value, f"{path}['{key}']"
    if '"' not in key:
        return value, f'{path}["{key}"]'
    return F.element_at(F.try_variant_get(value, path, "map<string,variant>"), key), "$"  # no path can name it


def _kind(value: Column, path: str) -> Column:
    """The type of the value at a path as schema_of_variant names it; null where there is none."""
    return F.schema_of_variant(F.variant_get(value, path, "variant") if path != "$" else value)


def _all(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def _holds(value: Column, path: str, pattern) -> Column:
    """Whether the value at a path of a variant contains the pattern; null where the path leads nowhere."""
    kind = _kind(value, path)
    if isinstance(pattern, dict):
        return kind.startswith("OBJECT") & _all([_holds(*_member(value, path, k), v) for k, v in pattern.items()])
    if isinstance(pattern, list):
        items = F.variant_get(value, path, "array<variant>")
        return kind.startswith("ARRAY") & _all([_some(F.when(kind.startswith("ARRAY"), items), p) for p in pattern])
    if pattern is None:
        return kind == "VOID"
    if isinstance(pattern, bool):
        return (kind == "BOOLEAN") & (F.try_variant_get(value, path, "boolean") == pattern)
    if isinstance(pattern, str):
        return (kind == "STRING") & (F.try_variant_get(value, path, "string") == pattern)
    if isinstance(pattern, int):
        return kind.rlike(_NUMBERS) & (F.try_variant_get(value, path, "decimal(38,10)") == F.lit(pattern).cast("decimal(38,10)"))
    return kind.rlike(_NUMBERS) & (F.try_variant_get(value, path, "double") == float(pattern))


def _some(items: Column, pattern) -> Column:
    """Whether one of the items contains the pattern."""
    return F.exists(items, lambda x: F.coalesce(_holds(x, "$", pattern), F.lit(False)))


def contains(value: Column, pattern) -> Column:
    """Whether a variant contains a JSON pattern (dict, list, str, number, bool or None, or its JSON text in brackets).

    An object contains another if it has each of its keys with a value that contains the other's;
    an array contains another if each of the other's elements is contained in one of its own, in
    any order and number; an array also contains a scalar that it has; other values contain their
    equals, numbers by value. Never null: what isn't there contains nothing. Paths of objects are
    fixed, so a variant column in Parquet is read by those paths alone where its file is shredded.
    """
    if isinstance(pattern, (dict, list)):
        return F.coalesce(_holds(value, "$", pattern), F.lit(False))
    listed = F.when(_kind(value, "$").startswith("ARRAY"), F.variant_get(value, "$", "array<variant>"))
    return F.coalesce(_some(listed, pattern), _holds(value, "$", pattern), F.lit(False))


def contains_text(value: Column, pattern: str) -> Column:
    """contains() of JSON texts; a text that isn't JSON contains nothing."""
    return contains(F.try_parse_json(value), json.loads(pattern))
