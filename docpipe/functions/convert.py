"""Type conversion and object expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import DocError, TypeMismatch
from .core import (
    BOOL, DOUBLE, LONG, NTZ, NULL, REMOVE, STRING, V, common_type, compile_expr, failing_when, get_field, literal,
    named, one, operator, struct_of,
)
from .dates import millis, of_millis
from .strings import to_text


def _prefix(s: Column, pattern: str) -> Column:
    """The number a text begins with, null if it begins with none."""
    found = F.regexp_extract(s, pattern, 1)
    return F.when(found != "", found)


def to_whole(v: V, op: str) -> Column:
    if v.is_null or v.is_integer or v.is_bool:
        return v.col.cast(LONG)
    if v.is_number:
        x = v.col.cast(DOUBLE)
        return F.when(x < 0, F.ceil(x)).otherwise(F.floor(x)).cast(LONG)
    if v.is_string:
        return _prefix(v.col, r"^\s*([-+]?\d+)").cast(LONG)
    if v.is_date:
        return millis(v.col)
    raise TypeMismatch(f"{op} can't convert {v.type.simpleString()}", 241)


def to_double(v: V, op: str) -> Column:
    if v.is_null or v.is_number:
        return v.col.cast(DOUBLE)
    if v.is_bool:
        return v.col.cast("int").cast(DOUBLE)
    if v.is_string:
        infinite = F.when(F.rlike(v.col, F.lit(r"^\s*\+?Infinity")), float("inf")).when(F.rlike(v.col, F.lit(r"^\s*-Infinity")), float("-inf"))
        return F.coalesce(infinite, _prefix(v.col, r"^\s*([-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?)").cast(DOUBLE))
    if v.is_date:
        return millis(v.col).cast(DOUBLE)
    raise TypeMismatch(f"{op} can't convert {v.type.simpleString()}", 241)


def to_bool(v: V, op: str) -> Column:
    if v.is_null or v.is_bool:
        return v.col.cast(BOOL)
    if v.is_number:
        return v.col != 0
    return F.when(v.col.isNotNull(), F.lit(True))


def to_date(v: V, op: str) -> Column:
    if v.is_null or v.is_date:
        return v.col.cast(NTZ)
    if v.is_number:
        return of_millis(v.col.cast(LONG))
    if v.is_string:
        return F.try_to_timestamp(v.col).cast(NTZ)
    raise TypeMismatch(f"{op} can't convert {v.type.simpleString()}", 241)


def to_object_id(v: V, op: str) -> Column:
    if not v.is_string and not v.is_null:
        raise TypeMismatch(f"{op} can't convert {v.type.simpleString()}", 241)
    s = v.col.cast(STRING)
    return F.when(F.rlike(s, F.lit("^[0-9a-fA-F]{24}$")), F.lower(s))


_KINDS = {
    "int": (to_whole, LONG), "long": (to_whole, LONG), "double": (to_double, DOUBLE), "decimal": (to_double, DOUBLE), "bool": (to_bool, BOOL),
    "date": (to_date, NTZ), "string": (to_text, STRING), "objectId": (to_object_id, STRING),
}
#: The numeric codes of conversion targets.
_CODES = {1: "double", 2: "string", 7: "objectId", 8: "bool", 9: "date", 16: "int", 18: "long", 19: "decimal"}


def _converter(name: str, kind: str):
    fn, out = _KINDS[kind]

    @operator(name)
    def compiled(raw, scope):
        v = one(raw, scope, name)
        good = fn(v, name)
        return V(failing_when(v.col.isNotNull() & good.isNull(), f"{name}: failed to convert value", good, out), out)


for _name, _kind in (("$toInt", "int"), ("$toLong", "long"), ("$toDouble", "double"), ("$toDecimal", "decimal"), ("$toBool", "bool"), ("$toDate", "date"), ("$toObjectId", "objectId")):
    _converter(_name, _kind)


@operator("$convert")
def convert(raw, scope):
    named(raw, "$convert", ("input", "to"), ("onError", "onNull"))
    to = raw["to"]
    to = _CODES.get(to, to) if not isinstance(to, str) else to
    if to not in _KINDS:
        raise DocError(f"$convert: unknown type: {raw['to']}")
    fn, kind = _KINDS[to]
    v = compile_expr(raw["input"], scope)
    on_error = compile_expr(raw["onError"], scope) if "onError" in raw else None
    on_null = compile_expr(raw["onNull"], scope) if "onNull" in raw else V(F.lit(None), NULL)
    try:
        good = fn(v, "$convert")
    except DocError:
        if on_error is None:
            raise
        good = F.lit(None).cast(kind)
    out = common_type([kind, on_null.type] + ([on_error.type] if on_error else []))
    bad = on_error.cast(out).col if on_error else F.raise_error(F.lit("$convert: failed to convert value")).cast(out)
    return V(F.when(v.col.isNull(), on_null.cast(out).col).when(good.isNull(), bad).otherwise(good.cast(out)), out)


def type_name(t: T.DataType) -> str:
    """The name that the ``$type`` expression gives a value of this type."""
    if isinstance(t, T.NumericType):
        return "double"
    if isinstance(t, T.StringType):
        return "string"
    if isinstance(t, T.BooleanType):
        return "bool"
    if isinstance(t, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "date"
    if isinstance(t, T.ArrayType):
        return "array"
    if isinstance(t, (T.StructType, T.MapType)):
        return "object"
    return "binData" if isinstance(t, T.BinaryType) else "null"


@operator("$type")
def type_(raw, scope):
    v = one(raw, scope, "$type")
    if v.missing:
        return literal("missing")
    return V(F.when(v.col.isNull(), "null").otherwise(type_name(v.type)), STRING)


@operator("$isNumber")
def is_number(raw, scope):
    v = one(raw, scope, "$isNumber")
    if not v.is_number:
        return V(F.lit(False), BOOL)
    good = v.col.isNotNull()
    return V(good if v.is_integer else good & ~F.isnan(v.col.cast(DOUBLE)), BOOL)


@operator("$getField")
def get_field_(raw, scope):
    if isinstance(raw, dict) and "field" in raw:
        named(raw, "$getField", ("field",), ("input",))
        v = compile_expr(raw.get("input", "$$CURRENT"), scope) if "input" in raw else scope.document()
        name = raw["field"]
    else:
        v, name = scope.document(), raw
    name = name["$literal"] if isinstance(name, dict) and "$literal" in name else name
    if not isinstance(name, str):
        raise DocError("$getField requires a constant field name")
    return get_field(v, name)


@operator("$setField")
def set_field(raw, scope):
    named(raw, "$setField", ("field", "input", "value"))
    name = raw["field"]["$literal"] if isinstance(raw["field"], dict) else raw["field"]
    v, value = compile_expr(raw["input"], scope), compile_expr(raw["value"], scope)
    if v.is_map:
        kept = F.map_filter(v.col, lambda k, _: k != name)
        return V(kept if value.const is REMOVE else F.map_concat(kept, F.create_map(F.lit(name), value.cast(v.type.valueType).col)), v.type)
    if not v.is_struct:
        raise TypeMismatch("$setField requires an object")
    fields = {f.name: V(v.col.getField(f.name), f.dataType) for f in v.type.fields}
    fields.pop(name, None) if value.const is REMOVE else fields.update({name: V(value.col, value.type)})
    out = struct_of(fields)
    return V(F.when(v.col.isNotNull(), out.col), out.type)


def merged_objects(values: list[V]) -> V:
    """Later fields win; a null object changes nothing."""
    values = [v for v in values if not v.is_null]
    if not values:
        return struct_of({})
    if all(v.is_map for v in values):
        def join(a: Column, b: Column) -> Column:
            return F.map_concat(F.map_filter(a, lambda k, _: ~F.array_contains(F.map_keys(b), k)), b)

        empty = lambda v: F.coalesce(v.col, F.create_map().cast(v.type))
        return V(reduce(join, [empty(v) for v in values]), values[0].type)
    fields: dict[str, V] = {}
    for v in values:
        if not v.is_struct:
            raise TypeMismatch("$mergeObjects requires objects", 40400)
        for f in v.type.fields:
            new = V(v.col.getField(f.name), f.dataType)
            old = fields.get(f.name)
            if old is None:
                fields[f.name] = new
            else:
                try:
                    kind = common_type([old.type, new.type])
                except TypeMismatch:
                    kind, old = new.type, V(F.lit(None), NULL)
                fields[f.name] = V(F.when(v.col.isNotNull(), new.cast(kind).col).otherwise(old.cast(kind).col), kind)
    return struct_of(fields)


@operator("$mergeObjects")
def merge_objects(raw, scope):
    items = raw if isinstance(raw, (list, tuple)) else [raw]
    return merged_objects([compile_expr(x, scope) for x in items])
