"""The filter language: filter documents become boolean columns.

A predicate that is null counts as false.  Comparisons are left bare, so that
they reach the scan; negations close what they negate first, and so keep rows
whose field is null or missing.
"""

from __future__ import annotations

import datetime as dt
import re
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import DocError, TypeMismatch, UnknownOperator
from ..functions.core import (
    DOUBLE, LONG, Scope, V, any_on_path, comparable, compared, compile_expr, less, literal, rank_of, truthy, unified,
)
from ..functions.strings import java_regex

#: Type names and codes of the ``$type`` predicate.
TYPE_CODES = {
    "double": 1, "string": 2, "object": 3, "array": 4, "binData": 5, "undefined": 6, "objectId": 7, "bool": 8, "date": 9, "null": 10,
    "regex": 11, "javascript": 13, "int": 16, "timestamp": 17, "long": 18, "decimal": 19, "minKey": -1, "maxKey": 127,
}
_NAMES = {code: name for name, code in TYPE_CODES.items()}


def _yes() -> Column:
    return F.lit(True)


def _no() -> Column:
    return F.lit(False)


def negated(c: Column) -> Column:
    """True where the predicate is false or null."""
    return ~F.coalesce(c, F.lit(False))


def all_of(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, parts) if parts else _yes()


def any_of(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, parts) if parts else _no()


def _regex(value: re.Pattern, options: str = "") -> str:
    flags = "".join(f for f, bit in (("i", re.I), ("m", re.M), ("s", re.S)) if value.flags & bit)
    return java_regex(value.pattern, options or flags)


def _matches(v: V, pattern: str) -> Column:
    if v.is_string:
        return (F.rlike(v.col, F.lit(pattern)))
    if v.is_array and isinstance(v.type.elementType, T.StringType):
        return (F.exists(v.col, lambda x: F.rlike(x, F.lit(pattern))))
    return _no()


def deep_equal(v: V, value: Any) -> Column:
    """Equality with a literal, of the value itself: no look into arrays."""
    if value is None:
        return v.col.isNull()
    if v.missing or v.is_null:
        return _no()
    if isinstance(value, dict):
        if not v.is_struct:
            return _no()
        if set(v.type.names) != set(value):
            return _no()
        return v.col.isNotNull() & all_of([deep_equal(V(v.col.getField(f.name), f.dataType), value[f.name]) for f in v.type.fields])
    wanted = literal(value)
    if rank_of(wanted.type) != rank_of(v.type):
        return _no()
    try:
        (a, b), _ = unified([v, wanted])
    except TypeMismatch:
        return _no()
    return (a == b)


def equals(v: V, value: Any) -> Column:
    """Equality of filters: an array also matches by one of its elements."""
    if isinstance(value, re.Pattern):
        return _matches(v, _regex(value))
    whole = deep_equal(v, value)
    if v.is_array:
        element = v.type.elementType
        if value is None:
            inside = (F.exists(v.col, lambda x: x.isNull()))
        else:
            inside = (F.exists(v.col, lambda x: deep_equal(V(x, element), value)))
        return whole | inside
    return whole


def _ordered(v: V, op: str, value: Any) -> Column:
    w = literal(value)
    plain = not v.missing and not v.is_array and not v.is_struct and not v.is_null
    if plain and value is not None and comparable(v, w):
        x, y = compared(v, w)
        test = {"$lt": x < y, "$lte": x <= y, "$gt": x > y, "$gte": x >= y}[op]
        return test | x.isNull() if op in ("$lt", "$lte") else test
    if op in ("$lt", "$lte"):
        return less(v, w, op == "$lte")
    return less(w, v, op == "$gte")


def type_test(v: V, wanted: Any) -> Column:
    if isinstance(wanted, (list, tuple)):
        return any_of([type_test(v, w) for w in wanted])
    name = _NAMES.get(wanted) if isinstance(wanted, (int, float)) and not isinstance(wanted, bool) else wanted
    if name != "number" and name not in TYPE_CODES:
        raise DocError(f"unknown type name or code: {wanted}")
    if v.missing:
        return _no()
    if name == "array":
        return v.col.isNotNull() if v.is_array else _no()
    if v.is_array:
        return (F.exists(v.col, lambda x: type_test(V(x, v.type.elementType), name)))
    if name == "null":
        return v.col.isNull()
    held = v.col.isNotNull()
    if v.is_number:
        whole = held if v.is_integer else held & (v.col == F.floor(v.col))
        return {"number": held, "int": (whole), "double": (held & ~whole)}.get(name, _no())
    kind = {"string": v.is_string, "bool": v.is_bool, "date": v.is_date, "object": v.is_struct or v.is_map, "binData": isinstance(v.type, T.BinaryType)}
    if name == "objectId" and v.is_string:
        return (F.rlike(v.col, F.lit("^[0-9a-f]{24}$")))
    return held if kind.get(name) else _no()


def _mask(value: Any) -> int:
    if isinstance(value, bool):
        raise DocError("a bit mask is a non-negative integer or a list of positions")
    if isinstance(value, (list, tuple)):
        return reduce(lambda m, p: m | 1 << p, value, 0)
    if isinstance(value, int) and value >= 0:
        return value
    raise DocError("a bit mask is a non-negative integer or a list of positions")


def _bits(v: V, op: str, value: Any) -> Column:
    mask = _mask(value)
    if v.is_array:
        return (F.exists(v.col, lambda x: _bits(V(x, v.type.elementType), op, value)))
    if not v.is_number:
        return _no()
    held = v.cast(LONG).col.bitwiseAND(F.lit(mask).cast(LONG))
    test = {
        "$bitsAllSet": held == mask, "$bitsAllClear": held == 0, "$bitsAnySet": held != 0, "$bitsAnyClear": held != mask,
    }[op]
    whole = _yes() if v.is_integer else v.col == F.floor(v.col)
    return (test & whole)


def _mod(v: V, value: Any) -> Column:
    if not isinstance(value, (list, tuple)) or len(value) != 2:
        raise DocError("malformed mod, needs a divisor and a remainder")
    divisor, rest = int(value[0]), int(value[1])
    if divisor == 0:
        raise DocError("divisor cannot be 0")
    if not v.is_number:
        return _no()
    x = F.when(v.cast(DOUBLE).col < 0, F.ceil(v.col)).otherwise(F.floor(v.col)).cast(LONG)
    return (x % divisor == rest)


def _unequal(v: V, value: Any) -> Column:
    plain = not v.missing and not v.is_array and not v.is_struct and not v.is_null
    if plain and isinstance(value, (str, int, float, bool)) and comparable(v, literal(value)):
        x, y = compared(v, literal(value))
        return (x != y) | x.isNull()
    return negated(equals(v, value))


def _elem_match(v: V, cond: dict, scope: Scope) -> Column:
    if not v.is_array:
        return _no()
    element = v.type.elementType

    def test(x: Column) -> Column:
        if cond and all(k.startswith("$") and k not in ("$and", "$or", "$nor", "$expr") for k in cond):
            return field_test(V(x, element), [], cond, scope)
        if not isinstance(element, T.StructType):
            return _no()
        inner = Scope(element, scope.variables, scope.now, V(x, element), scope.order)
        return compile_filter(cond, inner)

    return (F.exists(v.col, test))


def _all(v: V, value: Any, scope: Scope) -> Column:
    if not isinstance(value, (list, tuple)):
        raise DocError("$all needs an array")
    if not value:
        return _no()
    return all_of([_elem_match(v, x["$elemMatch"], scope) if isinstance(x, dict) and "$elemMatch" in x else equals(v, x) for x in value])


def _in(v: V, value: Any, op: str) -> Column:
    if not isinstance(value, (list, tuple)):
        raise DocError(f"{op} needs an array")
    plain = [x for x in value if x is not None and not isinstance(x, (re.Pattern, dict, list, tuple))]
    tests = [equals(v, x) for x in value if x not in plain] if len(plain) < len(value) else []
    if not v.missing and not v.is_null and plain:
        if not v.is_array:
            same = [x for x in plain if rank_of(literal(x).type) == rank_of(v.type)]
            if same and not any(isinstance(x, (dt.datetime, dt.date)) for x in same):
                tests.append((v.col.isin(*same)))
            else:
                tests += [equals(v, x) for x in same]
        else:
            tests += [equals(v, x) for x in plain]
    return any_of(tests)


def _is_operators(cond: Any) -> bool:
    return isinstance(cond, dict) and bool(cond) and all(k.startswith("$") for k in cond)


def field_test(v: V, parts: list[str], cond: Any, scope: Scope) -> Column:
    """Whether the field at the path meets a value or operators."""
    reach = lambda test: any_on_path(v, parts, test)
    if not _is_operators(cond):
        return reach(lambda x: equals(x, cond))
    out = []
    for op, value in cond.items():
        if op == "$eq":
            out.append(reach(lambda x, value=value: equals(x, value)))
        elif op == "$ne":
            out.append(reach(lambda x, value=value: _unequal(x, value)))
        elif op in ("$gt", "$gte", "$lt", "$lte"):
            out.append(reach(lambda x, op=op, value=value: _ordered(x, op, value)))
        elif op == "$in":
            out.append(reach(lambda x, value=value: _in(x, value, "$in")))
        elif op == "$nin":
            out.append(reach(lambda x, value=value: negated(_in(x, value, "$nin"))))
        elif op == "$exists":
            there = reach(lambda x: _no() if x.missing else (_yes() if not parts else x.col.isNotNull()))
            out.append(there if value else ~there)
        elif op == "$not":
            if not isinstance(value, re.Pattern) and not _is_operators(value):
                raise DocError("$not needs a regex or a document of operators")
            inner = field_test(v, parts, value, scope) if not isinstance(value, re.Pattern) else reach(lambda x, value=value: equals(x, value))
            out.append(negated(inner))
        elif op == "$size":
            if not isinstance(value, int) or isinstance(value, bool) or value < 0:
                raise DocError("$size needs a non-negative integer")
            out.append(reach(lambda x, value=value: (F.size(x.col) == value) if x.is_array else _no()))
        elif op == "$all":
            out.append(reach(lambda x, value=value: _all(x, value, scope)))
        elif op == "$elemMatch":
            out.append(reach(lambda x, value=value: _elem_match(x, value, scope)))
        elif op == "$regex":
            options = cond.get("$options", "")
            pattern = _regex(value, options) if isinstance(value, re.Pattern) else java_regex(value, options)
            out.append(reach(lambda x, pattern=pattern: _matches(x, pattern)))
        elif op == "$options":
            if "$regex" not in cond:
                raise DocError("$options needs a $regex")
        elif op == "$type":
            out.append(reach(lambda x, value=value: type_test(x, value)))
        elif op == "$mod":
            out.append(reach(lambda x, value=value: _mod(x, value)))
        elif op in ("$bitsAllSet", "$bitsAllClear", "$bitsAnySet", "$bitsAnyClear"):
            out.append(reach(lambda x, op=op, value=value: _bits(x, op, value)))
        elif op == "$geoWithin":
            from .geo import within

            out.append(reach(lambda x, value=value: within(x, value)))
        elif op == "$geoIntersects":
            from .geo import intersects

            out.append(reach(lambda x, value=value: intersects(x, value)))
        elif op in ("$near", "$nearSphere", "$maxDistance", "$minDistance"):
            raise DocError(f"{op} is only allowed in find()", 2)
        else:
            raise UnknownOperator(f"unknown operator: {op}", 2)
    return all_of(out)


def compile_filter(spec: dict, scope: Scope) -> Column:
    """The boolean column of a filter document."""
    if not isinstance(spec, dict):
        raise TypeMismatch("a filter is an object")
    out = []
    for key, cond in spec.items():
        if key in ("$and", "$or", "$nor"):
            if not isinstance(cond, (list, tuple)) or not cond:
                raise DocError(f"{key} must be a nonempty array")
            parts = [compile_filter(c, scope) for c in cond]
            out.append(all_of(parts) if key == "$and" else any_of(parts) if key == "$or" else negated(any_of(parts)))
        elif key == "$expr":
            out.append(truthy(compile_expr(cond, scope), True))
        elif key == "$comment":
            continue
        elif key == "$jsonSchema":
            from .jsonschema import valid

            out.append(valid(scope.document(), cond))
        elif key == "$text":
            raise DocError("$text is only allowed in find(), count and distinct")
        elif key.startswith("$"):
            raise UnknownOperator(f"unknown top level operator: {key}", 2)
        else:
            head, *rest = key.split(".")
            out.append(field_test(scope.field(head), rest, cond, scope))
    return all_of(out)
