"""Arithmetic and trigonometry."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .core import DOUBLE, LONG, V, common_type, failing_when, number, one, operands, operator


def _fold(name: str, combine):
    @operator(name)
    def compiled(raw, scope):
        values = [number(v, name) for v in operands(raw, scope, name, 1)]
        kind = common_type([v.type for v in values])
        return V(reduce(combine, [v.cast(kind).col for v in values]), kind)


_fold("$add", lambda a, b: a + b)
_fold("$multiply", lambda a, b: a * b)


@operator("$subtract")
def subtract(raw, scope):
    a, b = (number(v, "$subtract") for v in operands(raw, scope, "$subtract", 2, 2))
    kind = common_type([a.type, b.type])
    return V(a.cast(kind).col - b.cast(kind).col, kind)


@operator("$divide")
def divide(raw, scope):
    a, b = (number(v, "$divide").cast(DOUBLE).col for v in operands(raw, scope, "$divide", 2, 2))
    infinite = F.when(a.isNull(), None).when(a >= 0, float("inf")).otherwise(float("-inf"))
    return V(F.when(b == 0, infinite).otherwise(F.try_divide(a, b)), DOUBLE)


@operator("$mod")
def mod(raw, scope):
    a, b = (number(v, "$mod") for v in operands(raw, scope, "$mod", 2, 2))
    kind = common_type([a.type, b.type])
    x, y = a.cast(kind).col, b.cast(kind).col
    return V(failing_when(y == 0, "$mod by zero", F.when(y != 0, x % F.when(y != 0, y)), kind), kind)


def _rounding(name: str, whole):
    @operator(name)
    def compiled(raw, scope):
        v = number(one(raw, scope, name), name)
        return v if v.is_integer else V(whole(v.col).cast(DOUBLE), DOUBLE)


_rounding("$ceil", F.ceil)
_rounding("$floor", F.floor)


@operator("$abs")
def absolute(raw, scope):
    v = number(one(raw, scope, "$abs"), "$abs")
    return V(F.abs(v.col), v.type)


def _halfway(x: Column) -> Column:
    return F.abs(x - F.rint(x)) == 0.5


@operator("$round")
def rounded(raw, scope):
    """Half to even; a negative place rounds to tens and so on.

    Places are moved by a product, as SQL does; the shortest spelling, by which
    ``bround`` goes, may end in 5 where the number does not.  Only what lies
    halfway to the last bit goes to even, other products in .5 go away from zero.
    """
    v, *place = operands(raw, scope, "$round", 1, 2)
    v = number(v, "$round")
    n = int(place[0].const) if place else 0
    if v.is_integer and n >= 0:
        return v
    spelled = F.bround(v.col, n).cast(v.type)
    if not 0 <= n <= 22:  # beyond, powers of ten are not exact
        return V(spelled, v.type)
    moved = v.col * 10.0**n
    # halfway between places means an odd multiple of 2 ** -(n + 1)
    away = _halfway(moved) & ~_halfway(v.col * 2.0**n)
    farther = (moved + F.signum(moved) * 0.5) / 10.0**n
    return V(F.when(away, farther).when(F.abs(moved) < 2.0**52, F.rint(moved) / 10.0**n).otherwise(spelled), v.type)


@operator("$trunc")
def truncated(raw, scope):
    v, *place = operands(raw, scope, "$trunc", 1, 2)
    v = number(v, "$trunc")
    n = int(place[0].const) if place else 0
    if v.is_integer and n >= 0:
        return v
    scaled = v.col.cast(DOUBLE) * (10.0**n)
    cut = F.when(scaled < 0, F.ceil(scaled)).otherwise(F.floor(scaled)) / (10.0**n)
    return V(cut.cast(v.type), v.type)


@operator("$rand")
def rand(raw, scope):
    return V(F.rand(), DOUBLE)


def _double(name: str, fn, bad=None, message: str = "out of domain"):
    @operator(name)
    def compiled(raw, scope):
        x = number(one(raw, scope, name), name).cast(DOUBLE).col
        good = fn(x)
        return V(failing_when(bad(x), f"{name}: {message}", good, DOUBLE) if bad else good, DOUBLE)


def _not_finite(x: Column) -> Column:
    return (x == float("inf")) | (x == float("-inf"))


_positive = "argument must be positive"
_double("$exp", F.exp)
_double("$ln", F.ln, lambda x: x <= 0, _positive)
_double("$log10", F.log10, lambda x: x <= 0, _positive)
_double("$sqrt", F.sqrt, lambda x: x < 0, "argument must not be negative")
_double("$sin", F.sin, _not_finite)
_double("$cos", F.cos, _not_finite)
_double("$tan", F.tan, _not_finite)
_double("$asin", F.asin, lambda x: (x < -1) | (x > 1))
_double("$acos", F.acos, lambda x: (x < -1) | (x > 1))
_double("$atan", F.atan)
_double("$sinh", F.sinh)
_double("$cosh", F.cosh)
_double("$tanh", F.tanh)
_double("$asinh", F.asinh)
_double("$acosh", F.acosh, lambda x: x < 1)
_double("$atanh", F.atanh, lambda x: (x < -1) | (x > 1))
_double("$degreesToRadians", F.radians)
_double("$radiansToDegrees", F.degrees)


@operator("$atan2")
def atan2(raw, scope):
    y, x = (number(v, "$atan2").cast(DOUBLE).col for v in operands(raw, scope, "$atan2", 2, 2))
    return V(F.atan2(y, x), DOUBLE)


@operator("$log")
def log(raw, scope):
    x, base = (number(v, "$log").cast(DOUBLE).col for v in operands(raw, scope, "$log", 2, 2))
    good = F.ln(x) / F.when(F.ln(base) != 0, F.ln(base))
    return V(failing_when((x <= 0) | (base <= 0) | (base == 1), "$log: argument and base must be positive, the base not 1", good, DOUBLE), DOUBLE)


@operator("$pow")
def power(raw, scope):
    a, b = operands(raw, scope, "$pow", 2, 2)
    return V(F.pow(number(a, "$pow").cast(DOUBLE).col, number(b, "$pow").cast(DOUBLE).col), DOUBLE)


def as_long(v: V) -> Column:
    return v.cast(LONG).col
