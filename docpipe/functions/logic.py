"""Comparison, boolean and conditional expressions, variables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..errors import DocError
from .core import (
    BOOL, LONG, V, common_type, compile_expr, equal, less, literal, named, one, operands, operator, truthy,
)


def _comparison(name: str, fn):
    @operator(name)
    def compiled(raw, scope):
        a, b = operands(raw, scope, name, 2, 2)
        return V(fn(a, b), BOOL)


_comparison("$eq", equal)
_comparison("$ne", lambda a, b: ~equal(a, b))
_comparison("$lt", lambda a, b: less(a, b, False))
_comparison("$lte", lambda a, b: less(a, b, True))
_comparison("$gt", lambda a, b: less(b, a, False))
_comparison("$gte", lambda a, b: less(b, a, True))


@operator("$cmp")
def cmp(raw, scope):
    a, b = operands(raw, scope, "$cmp", 2, 2)
    sign = F.when(less(a, b, False), -1).when(less(b, a, False), 1).otherwise(0)
    return V(sign.cast(LONG), LONG)


def _all(raw, scope, op):
    if not isinstance(raw, (list, tuple)):
        raise DocError(f"{op} requires an array of expressions")
    return [truthy(compile_expr(x, scope), False) for x in raw]


@operator("$and")
def both(raw, scope):
    return V(reduce(lambda a, b: a & b, _all(raw, scope, "$and"), F.lit(True)), BOOL)


@operator("$or")
def either(raw, scope):
    return V(reduce(lambda a, b: a | b, _all(raw, scope, "$or"), F.lit(False)), BOOL)


@operator("$not")
def negation(raw, scope):
    return V(~truthy(one(raw, scope, "$not"), False), BOOL)


@operator("$cond")
def cond(raw, scope):
    if isinstance(raw, dict):
        named(raw, "$cond", ("if", "then", "else"))
        raw = [raw["if"], raw["then"], raw["else"]]
    test, then, other = operands(raw, scope, "$cond", 3, 3)
    kind = common_type([then.type, other.type])
    return V(F.when(truthy(test, True), then.cast(kind).col).otherwise(other.cast(kind).col), kind)


@operator("$ifNull")
def if_null(raw, scope):
    values = operands(raw, scope, "$ifNull", 2)
    kind = common_type([v.type for v in values])
    return V(F.coalesce(*[v.cast(kind).col for v in values]), kind)


@operator("$switch")
def switch(raw, scope):
    named(raw, "$switch", ("branches",), ("default",))
    if not raw["branches"]:
        raise DocError("$switch requires at least one branch", 40068)
    branches = [(truthy(compile_expr(b["case"], scope), True), compile_expr(b["then"], scope)) for b in raw["branches"]]
    default = compile_expr(raw["default"], scope) if "default" in raw else None
    kind = common_type([v.type for _, v in branches] + ([default.type] if default else []))
    out = F
    for test, value in branches:
        out = out.when(test, value.cast(kind).col)
    last = default.cast(kind).col if default else F.raise_error(F.lit("$switch could not find a matching branch")).cast(kind)
    return V(out.otherwise(last), kind)


@operator("$let")
def let(raw, scope):
    named(raw, "$let", ("vars", "in"))
    for k in raw["vars"]:
        if k.startswith("$"):
            raise DocError(f"a variable can't start with $: {k}")
    values = {k: compile_expr(x, scope) for k, x in raw["vars"].items()}
    return compile_expr(raw["in"], scope.with_vars(**values))


