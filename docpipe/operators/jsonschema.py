"""JSON-Schema predicates as boolean columns, settled by type where that suffices."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.core import DOUBLE, V, get_field
from .match import all_of, any_of, deep_equal, negated, type_test

#: JSON type names and what they are called as value types.
JSON_TYPES = {"object": "object", "array": "array", "string": "string", "number": "number", "integer": "int", "boolean": "bool", "null": "null"}


def _strict_type(v: V, name: str) -> Column:
    """The type of the value itself, arrays not looked into."""
    if v.is_array and name != "array":
        return v.col.isNull() if name == "null" else F.lit(False)
    return type_test(v, name)


def _where(kind: bool, v: V, test: Column) -> Column:
    """Keywords of one type hold for values of any other."""
    return F.when(v.col.isNotNull(), F.coalesce(test, F.lit(False))).otherwise(True) if kind else F.lit(True)


def valid(v: V, schema: dict) -> Column:
    out: list[Column] = []
    for key, value in schema.items():
        if key in ("bsonType", "type"):
            names = value if isinstance(value, list) else [value]
            out.append(any_of([_strict_type(v, JSON_TYPES.get(n, n) if key == "type" else n) for n in names]))
        elif key == "enum":
            out.append(any_of([deep_equal(v, x) for x in value]))
        elif key in ("allOf", "anyOf"):
            out.append((all_of if key == "allOf" else any_of)([valid(v, s) for s in value]))
        elif key == "oneOf":
            total = sum((F.when(valid(v, s), 1).otherwise(0) for s in value), F.lit(0))
            out.append(total == 1)
        elif key == "not":
            out.append(negated(valid(v, value)))
    out += _object_rules(v, schema) + _array_rules(v, schema) + _string_rules(v, schema) + _number_rules(v, schema)
    return all_of(out)


def _present(v: V, name: str) -> Column:
    f = get_field(v, name)
    return F.lit(False) if f.missing else f.col.isNotNull()


def _object_rules(v: V, s: dict) -> list[Column]:
    if not v.is_struct and not v.is_map:
        return []
    out = [_where(True, v, _present(v, name)) for name in s.get("required", ())]
    names = v.type.names if v.is_struct else []
    count = sum((F.when(_present(v, n), 1).otherwise(0) for n in names), F.lit(0)) if v.is_struct else F.size(v.col)
    if "minProperties" in s:
        out.append(_where(True, v, count >= s["minProperties"]))
    if "maxProperties" in s:
        out.append(_where(True, v, count <= s["maxProperties"]))
    properties, patterns = s.get("properties", {}), s.get("patternProperties", {})
    for name in names:
        f = get_field(v, name)
        rules = ([properties[name]] if name in properties else []) + [r for p, r in patterns.items() if re.search(p, name)]
        extra = s.get("additionalProperties", True)
        if not rules and extra is not True:
            out.append(_where(True, v, f.col.isNull() if extra is False else f.col.isNull() | valid(f, extra)))
        out += [_where(True, v, f.col.isNull() | valid(f, r)) for r in rules]
    for name, needs in s.get("dependencies", {}).items():
        met = all_of([_present(v, n) for n in needs]) if isinstance(needs, list) else valid(v, needs)
        out.append(_where(True, v, ~_present(v, name) | met))
    return out


def _array_rules(v: V, s: dict) -> list[Column]:
    if not v.is_array:
        return []
    size, out, element = F.size(v.col), [], v.type.elementType
    if "minItems" in s:
        out.append(size >= s["minItems"])
    if "maxItems" in s:
        out.append(size <= s["maxItems"])
    if s.get("uniqueItems"):
        out.append(F.size(F.array_distinct(v.col)) == size)
    items = s.get("items")
    if isinstance(items, dict):
        out.append(F.forall(v.col, lambda x: valid(V(x, element), items)))
    elif isinstance(items, list):
        out += [(size <= i) | valid(V(F.get(v.col, i), element), r) for i, r in enumerate(items)]
        extra = s.get("additionalItems", True)
        if extra is False:
            out.append(size <= len(items))
        elif isinstance(extra, dict):
            out.append(F.forall(F.slice(v.col, F.lit(len(items) + 1), F.greatest(size - len(items), F.lit(0))), lambda x: valid(V(x, element), extra)))
    return [_where(True, v, c) for c in out]


def _string_rules(v: V, s: dict) -> list[Column]:
    tests = {"minLength": lambda n: F.char_length(v.col) >= n, "maxLength": lambda n: F.char_length(v.col) <= n, "pattern": lambda p: F.rlike(v.col, F.lit(p))}
    return [_where(v.is_string, v, fn(s[k])) for k, fn in tests.items() if k in s and v.is_string]


def _number_rules(v: V, s: dict) -> list[Column]:
    if not v.is_number:
        return []
    out = []
    if "minimum" in s:
        out.append(v.col > s["minimum"] if s.get("exclusiveMinimum") is True else v.col >= s["minimum"])
    if "maximum" in s:
        out.append(v.col < s["maximum"] if s.get("exclusiveMaximum") is True else v.col <= s["maximum"])
    if "multipleOf" in s:
        quotient = v.col.cast(DOUBLE) / F.lit(float(s["multipleOf"]))
        out.append(F.abs(quotient - F.round(quotient)) < 1e-10)
    return [_where(True, v, c) for c in out]


