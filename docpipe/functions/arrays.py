"""Array and set expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import DocError, TypeMismatch
from .core import (
    BOOL, LONG, STRING, V, array, array_of, common_type, compile_expr, failing_when, get_first, literal, named, number,
    one, operands, operator, struct_of, truthy, unified,
)


def _int(v: V, op: str) -> Column:
    return number(v, op).cast(LONG).col.cast("int")


@operator("$size")
def size(raw, scope):
    v = one(raw, scope, "$size")
    if not v.is_array:
        raise TypeMismatch("The argument to $size must be an array", 17124)
    return V(failing_when(v.col.isNull(), "The argument to $size must be an array", F.size(v.col).cast(LONG), LONG), LONG)


@operator("$arrayElemAt")
def array_elem_at(raw, scope):
    v, i = operands(raw, scope, "$arrayElemAt", 2, 2)
    v, at = array(v, "$arrayElemAt"), _int(i, "$arrayElemAt")
    return V(F.get(v.col, F.when(at < 0, F.size(v.col) + at).otherwise(at)), v.type.elementType)


@operator("$slice")
def slice_(raw, scope):
    v, *rest = operands(raw, scope, "$slice", 2, 3)
    v = array(v, "$slice")
    if len(rest) == 1:
        n = _int(rest[0], "$slice")
        first = F.when(n < 0, F.greatest(F.size(v.col) + n, F.lit(0))).otherwise(F.lit(0))
        count = F.abs(n)
    else:
        pos, count = (_int(r, "$slice") for r in rest)
        first = F.when(pos < 0, F.greatest(F.size(v.col) + pos, F.lit(0))).otherwise(pos)
    return V(F.slice(v.col, first + 1, count), v.type)


@operator("$concatArrays")
def concat_arrays(raw, scope):
    cols, kind = unified([array(v, "$concatArrays") for v in operands(raw, scope, "$concatArrays")])
    return V(F.concat(*cols), kind)


@operator("$filter")
def filter_(raw, scope):
    named(raw, "$filter", ("input", "cond"), ("as", "limit"))
    v = array(compile_expr(raw["input"], scope), "$filter")
    name = raw.get("as", "this")
    kept = F.filter(v.col, lambda x: truthy(compile_expr(raw["cond"], scope.with_vars(**{name: V(x, v.type.elementType)})), True))
    return V(kept, v.type)


@operator("$map")
def map_(raw, scope):
    named(raw, "$map", ("input", "in"), ("as",))
    v = array(compile_expr(raw["input"], scope), "$map")
    name = raw.get("as", "this")
    inner = lambda x: compile_expr(raw["in"], scope.with_vars(**{name: V(x, v.type.elementType)}))
    return V(F.transform(v.col, lambda x: inner(x).col), T.ArrayType(inner(F.lit(None)).type))


@operator("$reduce")
def reduce_(raw, scope):
    named(raw, "$reduce", ("input", "initialValue", "in"))
    v = array(compile_expr(raw["input"], scope), "$reduce")
    start = compile_expr(raw["initialValue"], scope)
    inner = lambda a, x, t: compile_expr(raw["in"], scope.with_vars(value=V(a, t), this=V(x, v.type.elementType)))
    kind = start.type
    for _ in range(4):  # until the accumulator's type holds what a step makes of it
        wider = common_type([kind, inner(F.lit(None), F.lit(None), kind).type])
        if wider == kind:
            break
        kind = wider
    return V(F.aggregate(v.col, start.cast(kind).col, lambda a, x: inner(a, x, kind).cast(kind).col), kind)


def _contains(a: V, x: V) -> Column:
    try:
        (needle, _), kind = unified([x, V(F.lit(None), a.type.elementType)])
    except TypeMismatch:
        return F.lit(False)
    held = a.cast(T.ArrayType(kind)).col
    return F.coalesce(F.exists(held, lambda y: y.eqNullSafe(needle)), F.lit(False))


@operator("$in")
def in_(raw, scope):
    x, a = operands(raw, scope, "$in", 2, 2)
    if not a.is_array:
        raise TypeMismatch("$in requires an array as a second argument", 40081)
    return V(_contains(a, x), BOOL)


@operator("$first")
def first(raw, scope):
    v = array(one(raw, scope, "$first"), "$first")
    return V(F.get(v.col, 0), v.type.elementType)


@operator("$last")
def last(raw, scope):
    v = array(one(raw, scope, "$last"), "$last")
    return V(F.try_element_at(v.col, F.lit(-1)), v.type.elementType)


@operator("$indexOfArray")
def index_of_array(raw, scope):
    v, x, *bounds = operands(raw, scope, "$indexOfArray", 2, 4)
    v = array(v, "$indexOfArray")
    if any(b.const is not None and b.const < 0 for b in bounds):
        raise DocError("$indexOfArray requires non-negative bounds")
    start = _int(bounds[0], "$indexOfArray") if bounds else F.lit(0)
    end = _int(bounds[1], "$indexOfArray") if len(bounds) > 1 else F.size(v.col)
    (needle, _), kind = unified([x, V(F.lit(None), v.type.elementType)])
    part = F.slice(v.cast(T.ArrayType(kind)).col, start + 1, F.greatest(end - start, F.lit(0)))
    at = F.array_position(part, needle)
    return V(F.when(v.col.isNotNull(), F.when(at > 0, at - 1 + start).otherwise(-1)).cast(LONG), LONG)


@operator("$isArray")
def is_array(raw, scope):
    v = one(raw, scope, "$isArray") if not isinstance(raw, list) or len(raw) == 1 else compile_expr(raw, scope)
    return V(v.col.isNotNull() if v.is_array else F.lit(False), BOOL)


@operator("$range")
def range_(raw, scope):
    start, end, *step = (_int(v, "$range") for v in operands(raw, scope, "$range", 2, 3))
    by = step[0] if step else F.lit(1)
    by = failing_when(by == 0, "$range requires a non-zero step", by, T.IntegerType())
    kind = T.ArrayType(LONG)
    some = ((by > 0) & (start < end)) | ((by < 0) & (start > end))
    values = F.sequence(start, F.when(some, end - F.signum(by).cast("int")).otherwise(start), F.when(some, by).otherwise(F.lit(1)))
    return V(F.when(some, values.cast(kind)).otherwise(F.array().cast(kind)), kind)


@operator("$reverseArray")
def reverse_array(raw, scope):
    v = array(one(raw, scope, "$reverseArray"), "$reverseArray")
    return V(F.reverse(v.col), v.type)


@operator("$arrayToObject")
def array_to_object(raw, scope):
    """A map, later keys win, from [key, value] arrays or {k, v} objects."""
    if isinstance(raw, (list, tuple)) and len(raw) == 1:
        raw = raw[0]
    if isinstance(raw, (list, tuple)) and all(isinstance(x, (list, tuple)) and len(x) == 2 for x in raw):
        v = array_of([struct_of({"k": compile_expr(k, scope), "v": compile_expr(x, scope)}) for k, x in raw])
    else:
        v = array(compile_expr(raw, scope), "$arrayToObject")
    inner = v.type.elementType
    if isinstance(inner, T.ArrayType):
        pairs = F.transform(v.col, lambda x: F.struct(F.get(x, 0).cast(STRING).alias("k"), F.get(x, 1).alias("v")))
        value = inner.elementType
    elif isinstance(inner, T.StructType) and {"k", "v"} <= set(inner.names):
        pairs = F.transform(v.col, lambda x: F.struct(x.getField("k").cast(STRING).alias("k"), x.getField("v").alias("v")))
        value = inner["v"].dataType
    else:
        raise TypeMismatch("$arrayToObject requires pairs", 40386)
    later = F.filter(pairs, lambda x, i: ~F.exists(F.slice(pairs, i + 2, F.greatest(F.size(pairs) - i - 1, F.lit(0))), lambda y: y.getField("k") == x.getField("k")))
    return V(F.map_from_entries(later), T.MapType(STRING, value))


@operator("$objectToArray")
def object_to_array(raw, scope):
    v = one(raw, scope, "$objectToArray")
    if v.is_map:
        entries = F.transform(F.map_entries(v.col), lambda e: F.struct(e.getField("key").alias("k"), e.getField("value").alias("v")))
        return V(entries, T.ArrayType(T.StructType([T.StructField("k", STRING), T.StructField("v", v.type.valueType)])))
    if not v.is_struct:
        raise TypeMismatch("$objectToArray requires an object", 40390)
    pairs = [struct_of({"k": literal(f.name), "v": V(v.col.getField(f.name), f.dataType)}) for f in v.type.fields]
    kind = common_type([f.dataType for f in v.type.fields])
    pairs = [V(F.struct(F.lit(f.name).alias("k"), v.col.getField(f.name).cast(kind).alias("v")), T.StructType([T.StructField("k", STRING), T.StructField("v", kind)])) for f in v.type.fields]
    return V(F.when(v.col.isNotNull(), F.array(*[p.col for p in pairs])), T.ArrayType(pairs[0].type))


@operator("$zip")
def zip_(raw, scope):
    named(raw, "$zip", ("inputs",), ("useLongestLength", "defaults"))
    inputs = [array(compile_expr(x, scope), "$zip") for x in raw["inputs"]]
    longest = raw.get("useLongestLength", False)
    if "defaults" in raw and not longest:
        raise DocError("$zip defaults need useLongestLength", 34467)
    kind = common_type([v.type.elementType for v in inputs] + [literal(d).type for d in raw.get("defaults", [])])
    defaults = [literal(d).cast(kind).col for d in raw.get("defaults", [None] * len(inputs))]
    cols = [v.cast(T.ArrayType(kind)).col for v in inputs]
    sizes = [F.size(c) for c in cols]
    n = (F.greatest if longest else F.least)(*sizes) if len(cols) > 1 else sizes[0]
    at = F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: i < n)
    rows = F.transform(at, lambda i: F.array(*[F.when(i < s, F.get(c, i)).otherwise(d) for c, s, d in zip(cols, sizes, defaults)]))
    some = reduce(lambda a, b: a & b, [c.isNotNull() for c in cols])
    return V(F.when(some, rows), T.ArrayType(T.ArrayType(kind)))


def sorted_by(v: V, spec) -> Column:
    """``array_sort`` by a direction, or by fields with directions; nulls low."""
    fields = [((), spec)] if not isinstance(spec, dict) else [(tuple(k.split(".")), d) for k, d in spec.items()]
    element = v.type.elementType

    def compare(a: Column, b: Column) -> Column:
        out = F.lit(0)
        for parts, direction in reversed(fields):
            x, y = (get_first(V(c, element), list(parts)).col for c in (a, b))
            up = F.when(x.isNull() & y.isNull(), 0).when(x.isNull(), -1).when(y.isNull(), 1).when(x < y, -1).when(x > y, 1).otherwise(0)
            here = up if direction == 1 else -up
            out = F.when(here != 0, here).otherwise(out)
        return out.cast("int")

    return F.array_sort(v.col, compare)


@operator("$sortArray")
def sort_array(raw, scope):
    named(raw, "$sortArray", ("input", "sortBy"))
    v = array(compile_expr(raw["input"], scope), "$sortArray")
    return V(sorted_by(v, raw["sortBy"]), v.type)


def _n_of(name: str, pick):
    @operator(name)
    def compiled(raw, scope):
        named(raw, name, ("n", "input"))
        n = compile_expr(raw["n"], scope)
        if n.const is not None and (not isinstance(n.const, int) or n.const < 0):
            raise DocError(f"{name} requires n to be a non-negative integer")
        v = array(compile_expr(raw["input"], scope), name)
        return V(pick(v, _int(n, name)), v.type)


_n_of("$firstN", lambda v, n: F.slice(v.col, F.lit(1), n))
_n_of("$lastN", lambda v, n: F.slice(v.col, F.greatest(F.size(v.col) - n, F.lit(0)) + 1, n))
_n_of("$minN", lambda v, n: F.slice(F.sort_array(F.filter(v.col, lambda x: x.isNotNull())), F.lit(1), n))
_n_of("$maxN", lambda v, n: F.slice(F.sort_array(F.filter(v.col, lambda x: x.isNotNull()), False), F.lit(1), n))


def _set(name: str, fold):
    @operator(name)
    def compiled(raw, scope):
        cols, kind = unified([array(v, name) for v in operands(raw, scope, name, 1)])
        return V(F.array_distinct(reduce(fold, cols)), kind)


_set("$setUnion", F.array_union)
_set("$setIntersection", F.array_intersect)
_set("$setDifference", F.array_except)


def _set_test(name: str, test):
    @operator(name)
    def compiled(raw, scope):
        values = [array(v, name) for v in operands(raw, scope, name, 2)]
        if any(v.is_null for v in values):
            raise TypeMismatch(f"{name} requires arrays")
        cols, _ = unified(values)
        null = reduce(lambda a, b: a | b, [c.isNull() for c in cols])
        return V(failing_when(null, f"{name} requires arrays", test(cols), BOOL), BOOL)


def _within(a: Column, b: Column) -> Column:
    return F.size(F.array_except(a, b)) == 0


_set_test("$setEquals", lambda cols: reduce(lambda a, b: a & b, [_within(cols[0], c) & _within(c, cols[0]) for c in cols[1:]]))
_set_test("$setIsSubset", lambda cols: _within(cols[0], cols[1]))


def _elements(name: str, fn):
    @operator(name)
    def compiled(raw, scope):
        raw = raw[0] if isinstance(raw, (list, tuple)) and len(raw) == 1 else raw
        v = array(compile_expr(raw, scope), name)
        return V(fn(v.col, lambda x: truthy(V(x, v.type.elementType), False)), BOOL)


_elements("$allElementsTrue", F.forall)
_elements("$anyElementTrue", F.exists)
