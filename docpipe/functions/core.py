"""Typed columns, scopes, paths, and the expression compiler.

An expression document becomes one Spark ``Column`` together with its data
type.  The type decides at compile time what a document interpreter would have
to find out for each value: whether a path fans out over an array, what is
missing, how a value counts as true.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import DocError, TypeMismatch, UnknownOperator

NTZ = T.TimestampNTZType()
LONG, DOUBLE, STRING, BOOL, NULL = T.LongType(), T.DoubleType(), T.StringType(), T.BooleanType(), T.NullType()


@dataclass(frozen=True)
class V:
    """A column, its type, and whether the path it came from does not exist."""

    col: Column
    type: T.DataType
    missing: bool = False
    const: Any = None  # the Python value of a literal

    @property
    def is_array(self) -> bool:
        return isinstance(self.type, T.ArrayType)

    @property
    def is_struct(self) -> bool:
        return isinstance(self.type, T.StructType)

    @property
    def is_map(self) -> bool:
        return isinstance(self.type, T.MapType)

    @property
    def is_number(self) -> bool:
        return isinstance(self.type, T.NumericType)

    @property
    def is_integer(self) -> bool:
        return isinstance(self.type, T.IntegralType)

    @property
    def is_date(self) -> bool:
        return isinstance(self.type, (T.TimestampType, T.TimestampNTZType, T.DateType))

    @property
    def is_null(self) -> bool:
        return isinstance(self.type, T.NullType)

    @property
    def is_string(self) -> bool:
        return isinstance(self.type, T.StringType)

    @property
    def is_bool(self) -> bool:
        return isinstance(self.type, T.BooleanType)

    def cast(self, to: T.DataType) -> V:
        return self if self.type == to else V(self.col.cast(to), to)


def missing() -> V:
    return V(F.lit(None), NULL, missing=True)


def name_of(field_name: str) -> str:
    return "`" + field_name.replace("`", "``") + "`"


@dataclass
class Scope:
    """What an expression can see: the row, variables, and the time of the run."""

    schema: T.StructType
    variables: dict[str, V] = field(default_factory=dict)
    now: dt.datetime = field(default_factory=lambda: dt.datetime.now(dt.timezone.utc).replace(tzinfo=None))
    root: V | None = None  # set where the row is a struct of its own, as in lambdas
    order: list[Column] = field(default_factory=list)

    def field(self, name: str) -> V:
        if self.root is not None:
            return get_field(self.root, name)
        for f in self.schema.fields:
            if f.name == name:
                return V(F.col(name_of(name)), f.dataType)
        return missing()

    def document(self) -> V:
        if self.root is not None:
            return self.root
        return V(F.struct(*[F.col(name_of(f.name)).alias(f.name) for f in self.schema.fields]), self.schema)

    def with_vars(self, **values: V) -> Scope:
        return replace(self, variables={**self.variables, **values})


def get_field(v: V, name: str) -> V:
    if v.is_struct:
        for f in v.type.fields:
            if f.name == name:
                return V(v.col.getField(name), f.dataType)
    if v.is_map:
        return V(F.try_element_at(v.col, F.lit(name)), v.type.valueType)
    return missing()


def get_first(v: V, parts: list[str]) -> V:
    """Path lookup of expressions: over an array, the first element that has it."""
    if not parts or v.missing:
        return v
    head, rest = parts[0], parts[1:]
    if v.is_array:
        if head.lstrip("-").isdigit():
            return get_first(V(F.get(v.col, int(head)), v.type.elementType), rest)
        inner = get_first(V(F.lit(None), v.type.elementType), parts)
        if inner.missing:
            return missing()
        found = F.filter(F.transform(v.col, lambda x: get_first(V(x, v.type.elementType), parts).col), lambda x: x.isNotNull())
        return V(F.get(found, 0), inner.type)
    return get_first(get_field(v, head), rest)


def any_on_path(v: V, parts: list[str], test: Callable[[V], Column]) -> Column:
    """Whether the test holds for a value that the path reaches, over all arrays."""
    if v.missing or not parts:
        return test(v)
    head, rest = parts[0], parts[1:]
    if v.is_array:
        if head.isdigit():
            return any_on_path(V(F.get(v.col, int(head)), v.type.elementType), rest, test)
        return F.coalesce(F.exists(v.col, lambda x: any_on_path(V(x, v.type.elementType), parts, test)), F.lit(False))
    return any_on_path(get_field(v, head), rest, test)


def path(scope: Scope, dotted: str) -> V:
    parts = dotted.split(".")
    return get_first(scope.field(parts[0]), parts[1:])


def common_type(types: list[T.DataType]) -> T.DataType:
    """The type to which all can be widened; nulls fit any."""
    out: T.DataType = NULL
    for t in types:
        if isinstance(t, T.NullType) or t == out:
            continue
        if isinstance(out, T.NullType):
            out = t
        elif isinstance(t, T.NumericType) and isinstance(out, T.NumericType):
            whole = isinstance(t, T.IntegralType) and isinstance(out, T.IntegralType)
            out = LONG if whole else DOUBLE
        elif isinstance(t, T.ArrayType) and isinstance(out, T.ArrayType):
            out = T.ArrayType(common_type([t.elementType, out.elementType]))
        elif isinstance(t, T.StructType) and isinstance(out, T.StructType) and t.names == out.names:
            out = T.StructType([T.StructField(a.name, common_type([a.dataType, b.dataType])) for a, b in zip(t.fields, out.fields)])
        elif isinstance(t, (T.TimestampType, T.TimestampNTZType, T.DateType)) and isinstance(out, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            out = NTZ
        else:
            raise TypeMismatch(f"no common type of {t.simpleString()} and {out.simpleString()}")
    return out


def unified(values: list[V]) -> tuple[list[Column], T.DataType]:
    t = common_type([v.type for v in values])
    return [v.cast(t).col for v in values], t


def literal(value: Any) -> V:
    if value is None:
        return V(F.lit(None), NULL, const=None)
    if isinstance(value, bool):
        return V(F.lit(value), BOOL, const=value)
    if isinstance(value, int):
        return V(F.lit(value).cast(LONG), LONG, const=value)
    if isinstance(value, float):
        return V(F.lit(value), DOUBLE, const=value)
    if isinstance(value, str):
        return V(F.lit(value), STRING, const=value)
    if isinstance(value, dt.datetime):
        plain = value.astimezone(dt.timezone.utc).replace(tzinfo=None) if value.tzinfo else value
        return V(F.lit(plain.isoformat(sep=" ")).cast(NTZ), NTZ, const=value)
    if isinstance(value, dt.date):
        return literal(dt.datetime(value.year, value.month, value.day))
    if isinstance(value, (list, tuple)):
        return replace(array_of([literal(x) for x in value]), const=list(value))
    if isinstance(value, dict):
        return replace(struct_of({k: literal(x) for k, x in value.items()}), const=value)
    raise TypeMismatch(f"no literal for {type(value).__name__}")


def array_of(values: list[V]) -> V:
    cols, t = unified(values)
    return V(F.array(*cols) if cols else F.array().cast(T.ArrayType(t)), T.ArrayType(t))


def struct_of(fields: dict[str, V]) -> V:
    kept = {k: v for k, v in fields.items() if not v.missing}
    kind = T.StructType([T.StructField(k, v.type) for k, v in kept.items()])
    if not kept:
        return V(F.from_json(F.lit("{}"), T.StructType([T.StructField("_", NULL)])), T.StructType([]))
    return V(F.struct(*[v.col.alias(k) for k, v in kept.items()]), kind)


Compiler = Callable[[Any, Scope], V]
OPERATORS: dict[str, Compiler] = {}


def operator(*names: str) -> Callable[[Compiler], Compiler]:
    def put(fn: Compiler) -> Compiler:
        for n in names:
            OPERATORS[n] = fn
        return fn

    return put


REMOVE = object()


def compile_expr(e: Any, scope: Scope) -> V:
    """The typed column of an expression document."""
    if isinstance(e, str) and e.startswith("$$"):
        name, _, rest = e[2:].partition(".")
        if name in ("ROOT", "CURRENT"):
            v = path(scope, rest) if rest else scope.document()
            return v
        if name == "NOW":
            return literal(scope.now)
        if name in ("DESCEND", "PRUNE", "KEEP"):
            return literal(e)
        if name == "REMOVE":
            return V(F.lit(None), NULL, missing=True, const=REMOVE)
        if name not in scope.variables:
            raise DocError(f"Use of undefined variable: {name}", 17276)
        return get_first(scope.variables[name], rest.split(".") if rest else [])
    if isinstance(e, str) and e.startswith("$"):
        return path(scope, e[1:])
    if isinstance(e, (list, tuple)):
        return array_of([compile_expr(x, scope) for x in e])
    if isinstance(e, dict):
        ops = [k for k in e if k.startswith("$")]
        if ops:
            if len(e) != 1:
                raise DocError("an expression has exactly one operator", 15983)
            op = ops[0]
            if op == "$literal":
                return literal(e[op])
            if op not in OPERATORS:
                raise UnknownOperator(f"Unrecognized expression operator: '{op}'")
            return OPERATORS[op](e[op], scope)
        return struct_of({k: compile_expr(x, scope) for k, x in e.items()})
    return literal(e)


def operands(raw: Any, scope: Scope, op: str, low: int = 0, high: int | None = None) -> list[V]:
    """Compiled arguments; a single value counts as a list of one."""
    items = raw if isinstance(raw, (list, tuple)) else [raw]
    if len(items) < low or (high is not None and len(items) > high):
        raise DocError(f"{op} takes {low}{'' if high == low else ' or more'} arguments", 16020)
    return [compile_expr(x, scope) for x in items]


def one(raw: Any, scope: Scope, op: str) -> V:
    return operands(raw, scope, op, 1, 1)[0]


def named(raw: Any, op: str, required: tuple[str, ...], optional: tuple[str, ...] = ()) -> dict:
    if not isinstance(raw, dict):
        raise DocError(f"{op} takes an object")
    for k in required:
        if k not in raw:
            raise DocError(f"{op} needs '{k}'")
    for k in raw:
        if k not in required and k not in optional:
            raise DocError(f"{op} does not know '{k}'")
    return raw


def number(v: V, op: str) -> V:
    if v.is_null:
        return V(v.col.cast(LONG), LONG, const=v.const)
    if not v.is_number:
        raise TypeMismatch(f"{op} only supports numeric types, not {v.type.simpleString()}")
    return v if isinstance(v.type, (T.DoubleType, T.LongType)) else v.cast(LONG if v.is_integer else DOUBLE)


def text(v: V, op: str) -> V:
    if v.is_null:
        return V(v.col.cast(STRING), STRING)
    if not v.is_string:
        raise TypeMismatch(f"{op} requires a string argument, found: {v.type.simpleString()}")
    return v


def moment(v: V, op: str) -> V:
    if v.is_null:
        return V(v.col.cast(NTZ), NTZ)
    if not v.is_date:
        raise TypeMismatch(f"{op} requires a date argument, found: {v.type.simpleString()}")
    return v.cast(NTZ)


def array(v: V, op: str) -> V:
    if not v.is_array and not v.is_null:
        raise TypeMismatch(f"{op} requires an array argument, found: {v.type.simpleString()}")
    return v if v.is_array else V(v.col.cast(T.ArrayType(NULL)), T.ArrayType(NULL))


def failing_when(bad: Column, message: str, good: Column, kind: T.DataType) -> Column:
    return F.when(F.coalesce(bad, F.lit(False)), F.raise_error(F.lit(message)).cast(kind)).otherwise(good)


def truthy(v: V, empty_is_false: bool) -> Column:
    """Whether a value counts as true; of '' and NaN, two rules are in use."""
    if v.is_null:
        return F.lit(False)
    if v.is_bool:
        return F.coalesce(v.col, F.lit(False))
    if v.is_number:
        good = v.col != 0
        if empty_is_false and not v.is_integer:
            good = good & ~F.isnan(v.col)
        return F.coalesce(good, F.lit(False))
    if v.is_string and empty_is_false:
        return F.coalesce(v.col != "", F.lit(False))
    return v.col.isNotNull()


def rank_of(t: T.DataType) -> int:
    """The place of a type in the order of mixed values."""
    if isinstance(t, T.NullType):
        return 2
    if isinstance(t, T.NumericType):
        return 3
    if isinstance(t, T.StringType):
        return 4
    if isinstance(t, (T.StructType, T.MapType)):
        return 5
    if isinstance(t, T.ArrayType):
        return 6
    if isinstance(t, T.BooleanType):
        return 9
    if isinstance(t, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return 10
    return 13


def comparable(a: V, b: V) -> bool:
    return rank_of(a.type) == rank_of(b.type) and not (a.is_map or b.is_map)


def compared(a: V, b: V) -> tuple[Column, Column]:
    """Both columns in one type, for operands of the same rank."""
    (x, y), _ = unified([a, b])
    return x, y


def equal(a: V, b: V) -> Column:
    """Equality of expressions: null equals null; other types never are equal."""
    if a.is_null or b.is_null:
        return F.coalesce(a.col.isNull() & b.col.isNull(), F.lit(False))
    if not comparable(a, b):
        return a.col.isNull() & b.col.isNull()
    try:
        x, y = compared(a, b)
    except TypeMismatch:
        return a.col.isNull() & b.col.isNull()
    return x.eqNullSafe(y)


def less(a: V, b: V, or_equal: bool) -> Column:
    """Order of expressions: null below all; incomparable values never are less."""
    both_null = a.col.isNull() & b.col.isNull() if or_equal else F.lit(False)
    low = (a.col.isNull() & b.col.isNotNull()) | both_null
    if a.is_null or b.is_null or not comparable(a, b) or a.is_struct or a.is_array:
        return low
    x, y = compared(a, b)
    return F.coalesce(x <= y if or_equal else x < y, low)
