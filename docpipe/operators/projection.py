"""Building and taking apart documents: projections, added and removed fields."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import DocError, TypeMismatch
from ..functions.core import REMOVE, Scope, V, compile_expr, get_field, missing, name_of, struct_of


def fields_of(df: DataFrame) -> dict[str, V]:
    return {f.name: V(F.col(name_of(f.name)), f.dataType) for f in df.schema.fields}


def select(df: DataFrame, fields: dict[str, V]) -> DataFrame:
    """The frame with just these fields; missing ones are left out."""
    cols = [v.col.alias(k) for k, v in fields.items() if not v.missing]
    if not cols:
        return df.select(F.lit(None).alias("_empty"))
    return df.select(*cols)




def _subfields(v: V) -> dict[str, V]:
    return {f.name: V(v.col.getField(f.name), f.dataType) for f in v.type.fields} if v.is_struct else {}


def _rebuilt(parent: V, fields: dict[str, V]) -> V:
    out = struct_of(fields)
    if not parent.missing and parent.is_struct and fields:
        return V(F.when(parent.col.isNotNull(), out.col), out.type)
    return out


def put(fields: dict[str, V], parts: list[str], value: V) -> dict[str, V]:
    """The fields with a value at a path; objects on the way are made."""
    head, rest = parts[0], parts[1:]
    if not rest:
        new = {k: v for k, v in fields.items() if k != head or value.const is not REMOVE}
        if value.missing:
            new.pop(head, None)
            return new
        new[head] = value
        return new
    parent = fields.get(head, missing())
    if parent.is_array and isinstance(parent.type.elementType, T.StructType):
        element = parent.type.elementType
        one = struct_of(put(_subfields(V(F.lit(None), element)), rest, value))
        col = F.transform(parent.col, lambda x: struct_of(put(_subfields(V(x, element)), rest, value)).col)
        return {**fields, head: V(col, T.ArrayType(one.type))}
    return {**fields, head: struct_of(put(_subfields(parent), rest, value))}


def without(fields: dict[str, V], parts: list[str]) -> dict[str, V]:
    """The fields without what stands at a path, in all elements of arrays."""
    head, rest = parts[0], parts[1:]
    if head not in fields:
        return fields
    if not rest:
        return {k: v for k, v in fields.items() if k != head}
    v = fields[head]
    if v.is_struct:
        return {**fields, head: _rebuilt(v, without(_subfields(v), rest))}
    if v.is_array and isinstance(v.type.elementType, T.StructType):
        element = v.type.elementType
        inner = lambda x: struct_of(without(_subfields(V(x, element)), rest))
        return {**fields, head: V(F.transform(v.col, lambda x: inner(x).col), T.ArrayType(inner(F.lit(None)).type))}
    return fields


def picked(v: V, parts: list[str]) -> V:
    """What stands at a path, with the objects around it and nothing else."""
    if not parts or v.missing:
        return v
    if v.is_array and isinstance(v.type.elementType, T.StructType):
        element = v.type.elementType
        inner = lambda x: struct_of({parts[0]: picked(get_field(V(x, element), parts[0]), parts[1:])})
        return V(F.transform(v.col, lambda x: inner(x).col), T.ArrayType(inner(F.lit(None)).type))
    f = get_field(v, parts[0])
    return _rebuilt(v, {parts[0]: picked(f, parts[1:])}) if not f.missing else missing()


def merged(a: V | None, b: V) -> V:
    """Two picks from one field, as one object."""
    if a is None or a.missing or not (a.is_struct and b.is_struct):
        return b
    fields = _subfields(a)
    for k, v in _subfields(b).items():
        fields[k] = merged(fields.get(k), v)
    out = struct_of(fields)
    return V(F.when(a.col.isNotNull() | b.col.isNotNull(), out.col), out.type)


def project(df: DataFrame, spec: dict, scope: Scope) -> DataFrame:
    """Inclusion or exclusion; ``_id`` stays unless it is set to 0."""
    if not isinstance(spec, dict) or not spec:
        raise DocError("$project requires at least one field", 51272)
    is_zero = lambda v: v is False or isinstance(v, (int, float)) and not isinstance(v, bool) and v == 0
    is_one = lambda v: v is True or isinstance(v, (int, float)) and not isinstance(v, bool) and v != 0
    others = {k: v for k, v in spec.items() if k != "_id"}
    zeros = [k for k, v in others.items() if is_zero(v)]
    if zeros and len(zeros) < len(others):
        raise DocError("a projection can't mix inclusion and exclusion", 31254)
    fields = fields_of(df)
    if zeros or not others:
        if "_id" in spec and is_zero(spec["_id"]):
            zeros = [*zeros, "_id"]
        if not others and is_one(spec.get("_id", 0)):
            return select(df, {k: v for k, v in fields.items() if k == "_id"})
        for k in zeros:
            fields = without(fields, k.split("."))
        return select(df, fields)
    out: dict[str, V] = {}
    if "_id" in fields and not is_zero(spec.get("_id", 1)):
        out["_id"] = fields["_id"]
    for k, v in spec.items():
        if k == "_id" and (is_one(v) or is_zero(v)):
            continue
        if is_one(v):
            head, *rest = k.split(".")
            pick = picked(fields[head], rest) if head in fields else missing()
            if not pick.missing:
                out[head] = merged(out.get(head), pick)
        elif isinstance(v, (dict, list)) or isinstance(v, str) and v.startswith("$"):
            value = compile_expr(v, scope)
            if not value.missing:
                out = put(out, k.split("."), value)
    return select(df, out)


def add_fields(df: DataFrame, spec: dict, scope: Scope) -> DataFrame:
    """All expressions see the document as it came in."""
    if not isinstance(spec, dict):
        raise TypeMismatch("$addFields takes an object", 40272)
    fields = fields_of(df)
    for k, e in spec.items():
        fields = put(fields, k.split("."), compile_expr(e, scope))
    return select(df, fields)


def unset(df: DataFrame, spec: Any) -> DataFrame:
    names = [spec] if isinstance(spec, str) else spec
    if not names or not all(isinstance(n, str) and n for n in names):
        raise DocError("$unset takes a field name or a list of them", 31002)
    fields = fields_of(df)
    for n in names:
        fields = without(fields, n.split("."))
    return select(df, fields)


def replace_root(df: DataFrame, e: Any, scope: Scope) -> DataFrame:
    v = compile_expr(e, scope)
    if not v.is_struct:
        raise TypeMismatch("'newRoot' expression must evaluate to an object", 40228)
    whole = F.when(v.col.isNull(), F.raise_error(F.lit("'newRoot' expression must evaluate to an object")).cast(v.type)).otherwise(v.col)
    return df.select(whole.alias("_root")).select(*[F.col("_root").getField(f.name).alias(f.name) for f in v.type.fields])


def find_projection(df: DataFrame, spec: dict, scope: Scope, score: str | None = None) -> DataFrame:
    """The projection of find(): also ``$slice``, ``$elemMatch`` and ``$meta``."""
    from .match import _elem_match, compile_filter

    special = {k: v for k, v in spec.items() if isinstance(v, dict)}
    plain = {k: v for k, v in spec.items() if k not in special}
    fields = fields_of(df)
    made: dict[str, V] = {}
    for k, v in special.items():
        op, arg = next(iter(v.items()))
        held = fields.get(k, missing())
        if op == "$slice" and held.is_array:
            if isinstance(arg, (list, tuple)):
                skip, n = arg
                first = F.lit(skip) if skip >= 0 else F.greatest(F.size(held.col) + skip, F.lit(0))
            else:
                first, n = (F.lit(0), arg) if arg >= 0 else (F.greatest(F.size(held.col) + arg, F.lit(0)), -arg)
            made[k] = V(F.slice(held.col, first + 1, F.lit(n)), held.type)
        elif op == "$elemMatch" and held.is_array:
            element = held.type.elementType
            hits = F.filter(held.col, lambda x: compile_filter(arg, Scope(element, scope.variables, scope.now, V(x, element), [])))
            made[k] = V(F.when(_elem_match(held, arg, scope), F.slice(hits, 1, 1)), held.type)
        elif op == "$meta" and score:
            made[k] = fields[score]
        elif op not in ("$slice", "$elemMatch", "$meta"):
            made[k] = compile_expr(v, scope)
    excluding = bool(plain) and all(not v for v in plain.values()) and set(plain) != {"_id"}
    if not special:
        return project(df, plain, scope)
    if excluding or not plain and all("$meta" in v for v in special.values()):
        out = {k: v for k, v in fields.items() if k not in plain}
        return select(df, {**out, **made})
    keep = {k: 1 for k, v in plain.items() if v}
    out = {k: v for k, v in fields.items() if k in keep or k == "_id" and plain.get("_id", 1)}
    for k in keep:
        head, *rest = k.split(".")
        if rest and head in fields:
            out[head] = merged(out.get(head), picked(fields[head], rest))
    return select(df, {**out, **made})
