"""Group accumulators, and the window operators of ``$setWindowFields``."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import DocError, TypeMismatch, UnknownOperator
from ..functions.core import DOUBLE, LONG, NULL, Scope, V, compile_expr, named, struct_of
from ..functions.dates import UNIT_MS, millis

_NUMERIC = {"$sum", "$avg", "$stdDevPop", "$stdDevSamp"}


def _numeric(v: V, name: str) -> V:
    """The value if it is a number, else a null that sums and means pass over."""
    if v.is_number:
        return v
    return V(F.lit(None).cast(DOUBLE), DOUBLE)


def _ordinal(scope: Scope) -> Column:
    """What earlier means: the keys of the last $sort."""
    return F.struct(*[c.alias(f"o{i}") for i, c in enumerate(scope.order)])


def accumulate(name: str, raw: Any, scope: Scope) -> V:
    """The aggregate column of ``{name: raw}``."""
    if name == "$count":
        if raw != {}:
            raise DocError("$count takes no arguments, i.e. $count:{}", 40234)
        return V(F.count(F.lit(1)), LONG)
    v = compile_expr(raw, scope)
    if name in _NUMERIC:
        v = _numeric(v, name)
    kind = v.type
    if name == "$sum":
        out = LONG if v.is_integer else DOUBLE
        return V(F.coalesce(F.sum(v.col).cast(out), F.lit(0).cast(out)), out)
    if name == "$avg":
        return V(F.avg(v.col), DOUBLE)
    if name == "$stdDevPop":
        return V(F.stddev_pop(v.col), DOUBLE)
    if name == "$stdDevSamp":
        return V(F.stddev_samp(v.col), DOUBLE)
    if name in ("$min", "$max"):
        return V((F.min if name == "$min" else F.max)(v.col), kind)
    if name in ("$first", "$last"):
        value = F.struct(v.col.alias("v"))
        if not scope.order:  # any row may be the first
            return V((F.first if name == "$first" else F.last)(value).getField("v"), kind)
        by = F.min_by if name == "$first" else F.max_by
        return V(by(value, _ordinal(scope)).getField("v"), kind)
    if name == "$push":
        if v.missing:
            v = V(F.lit(None), NULL)
        rows = F.sort_array(F.collect_list(F.struct(_ordinal(scope).alias("o"), v.col.alias("v")))) if scope.order else F.collect_list(F.struct(v.col.alias("v")))
        return V(F.transform(rows, lambda x: x.getField("v")), T.ArrayType(kind))
    if name == "$addToSet":
        return V(F.transform(F.sort_array(F.collect_set(F.struct(v.col.alias("v")))), lambda x: x.getField("v")), T.ArrayType(kind))
    if name == "$mergeObjects":
        if not v.is_struct:
            raise TypeMismatch("$mergeObjects requires objects", 40400)

        def latest(f: T.StructField) -> Column:
            value = F.when(v.col.isNotNull(), F.struct(v.col.getField(f.name).alias("v")))
            return (F.max_by(value, F.when(v.col.isNotNull(), _ordinal(scope))) if scope.order else F.last(value, True)).getField("v")

        return struct_of({f.name: V(latest(f), f.dataType) for f in v.type.fields})
    raise UnknownOperator(f"unknown group operator '{name}'", 15952)


ACCUMULATORS = ("$sum", "$avg", "$min", "$max", "$first", "$last", "$push", "$addToSet", "$count", "$mergeObjects", "$stdDevPop", "$stdDevSamp")


def single_accumulator(field: str, spec: Any) -> tuple[str, Any]:
    if not isinstance(spec, dict) or len(spec) != 1 or not next(iter(spec)).startswith("$"):
        raise DocError(f"the field '{field}' must be an accumulator object", 40234)
    return next(iter(spec.items()))


# --- windows ---------------------------------------------------------------

_WHOLE = (Window.unboundedPreceding, Window.unboundedFollowing)


def _bound(value: Any, low: bool) -> int:
    if value == "unbounded":
        return Window.unboundedPreceding if low else Window.unboundedFollowing
    if value == "current":
        return Window.currentRow
    if isinstance(value, bool) or not isinstance(value, int):
        raise DocError("a window bound is an integer, 'current' or 'unbounded'")
    return value


class Windows:
    """Frames of one partition and order; the sort's first key serves ranges."""

    def __init__(self, partition: list[Column], order: list[tuple[Column, int, T.DataType]]):
        self.partition = partition
        self.order = order
        self.plain = Window.partitionBy(*(partition or [F.lit(0)]))
        self.sorted = self.plain.orderBy(*self.order_keys())

    def order_keys(self) -> list[Column]:
        """The sort keys; without any the rows as they come."""
        return [c.asc_nulls_first() if d == 1 else c.desc_nulls_last() for c, d, _ in self.order] or [F.monotonically_increasing_id()]

    def first_key(self) -> tuple[Column, int, T.DataType]:
        if not self.order:
            raise DocError("the operator needs a sortBy", 5339602)
        return self.order[0]

    def frame(self, window: dict | None):
        if not window:
            return self.sorted.rowsBetween(*_WHOLE) if self.order else self.plain.rowsBetween(*_WHOLE)
        if "documents" in window:
            low, high = window["documents"]
            low, high = _bound(low, True), _bound(high, False)
            if low > high:
                raise DocError("the lower bound is above the upper bound")
            return self.sorted.rowsBetween(low, high)
        if "range" in window:
            key, direction, kind = self.first_key()
            low, high = window["range"]
            scale = 1
            if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
                key, scale = millis(key), UNIT_MS[window.get("unit", "millisecond")]
            ordered = self.plain.orderBy(key.asc_nulls_first() if direction == 1 else key.desc_nulls_last())
            bounds = [_bound(b, i == 0) if isinstance(b, str) else b * scale for i, b in enumerate((low, high))]
            return ordered.rangeBetween(*bounds)
        raise DocError("a window has documents or range")


def _step(w: Windows, unit: str | None) -> Column:
    """From the row before to this one, along the first sort key.

    Dates are subtracted as whole milliseconds and divided after that, so that
    short steps keep their digits.
    """
    key, _, kind = w.first_key()
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return (millis(key) - F.lag(millis(key)).over(w.sorted)).cast(DOUBLE) / UNIT_MS[unit or "millisecond"]
    return (key - F.lag(key).over(w.sorted)).cast(DOUBLE)


def linear_fill(x: Column, w: Windows) -> Column:
    """Between two known values, by the number of rows; null at the edges."""
    at = F.row_number().over(w.sorted)
    back, ahead = w.sorted.rowsBetween(Window.unboundedPreceding, 0), w.sorted.rowsBetween(0, Window.unboundedFollowing)
    v0, i0 = F.last(x, True).over(back), F.last(F.when(x.isNotNull(), at), True).over(back)
    v1, i1 = F.first(x, True).over(ahead), F.first(F.when(x.isNotNull(), at), True).over(ahead)
    return F.coalesce(x, v0 + (v1 - v0) * (at - i0) / F.when(i1 != i0, i1 - i0))


def last_known(x: Column, w: Windows) -> Column:
    return F.last(x, True).over(w.sorted.rowsBetween(Window.unboundedPreceding, 0))


#: Decimal orders of magnitude that the weights of one block span.
_BLOCK_ORDERS = 100


def moving_average(x: Column, alpha: float, w: Windows) -> Column:
    """Exponential average of the known values so far; a null keeps the last.

    With a = 1 - alpha, the average after k known values is a sum of them with
    weights a^(k-i).  Known values are dealt into blocks in which a^-j stays below
    1e100.  Within a block the sum is a running one; from the block before it
    takes that block's sum, and what lies further back weighs under 1e-100.
    """
    if alpha >= 1:
        return last_known(x, w)
    import math

    a = 1 - alpha
    size = max(1, int(_BLOCK_ORDERS / -math.log10(a)))
    known = F.sum(F.when(x.isNotNull(), 1).otherwise(0)).over(w.sorted.rowsBetween(Window.unboundedPreceding, 0))
    at = (known - 1) % size
    block = F.floor((known - 1) / size)
    weighted = F.when(x.isNotNull(), x * F.when(known == 1, 1.0).otherwise(alpha) * F.pow(F.lit(a), -at))
    inside = Window.partitionBy(*(w.partition or [F.lit(0)]), block).orderBy(*w.order_keys()).rowsBetween(Window.unboundedPreceding, 0)
    own = F.pow(F.lit(a), at) * F.sum(weighted).over(inside)
    ended = F.last(F.when(x.isNotNull() & (at == size - 1), own), True).over(w.sorted.rowsBetween(Window.unboundedPreceding, -1))
    average = own + F.pow(F.lit(a), at + 1) * F.when(block > 0, ended).otherwise(0.0)
    return last_known(F.when(x.isNotNull(), average), w)


def window_value(name: str, raw: Any, window: dict | None, w: Windows, scope: Scope) -> V:
    """The column of one window operator."""
    if name == "$documentNumber":
        return V(F.row_number().over(w.sorted).cast(LONG), LONG)
    if name == "$rank":
        return V((F.rank() if w.order else F.row_number()).over(w.sorted).cast(LONG), LONG)
    if name == "$denseRank":
        return V((F.dense_rank() if w.order else F.row_number()).over(w.sorted).cast(LONG), LONG)
    if name == "$count":
        return V(F.count(F.lit(1)).over(w.frame(window)), LONG)
    if name == "$shift":
        named(raw, name, ("output", "by"), ("default",))
        v = compile_expr(raw["output"], scope)
        default = raw.get("default")
        by = raw["by"]
        if not isinstance(by, int):
            raise DocError("$shift requires an integer 'by'")
        there = F.lead(F.lit(True), by).over(w.sorted) if by >= 0 else F.lag(F.lit(True), -by).over(w.sorted)
        moved = F.lead(v.col, by).over(w.sorted) if by >= 0 else F.lag(v.col, -by).over(w.sorted)
        return V(moved if default is None else F.when(there.isNotNull(), moved).otherwise(F.lit(default).cast(v.type)), v.type)
    if name in ("$derivative", "$integral"):
        named(raw, name, ("input",), ("unit",))
        x = _numeric(compile_expr(raw["input"], scope), name).col.cast(DOUBLE)
        dx, dt_ = x - F.lag(x).over(w.sorted), _step(w, raw.get("unit"))
        if name == "$derivative":
            return V(dx / F.when(dt_ != 0, dt_), DOUBLE)
        area = F.coalesce((x + F.lag(x).over(w.sorted)) / 2 * dt_, F.lit(0.0))
        if not window:
            return V(F.sum(area).over(w.frame(None)), DOUBLE)
        frame = w.frame(window)
        # The first row of a frame has no area of its own within it.
        head = F.first(F.struct(area.alias("a"))).over(frame).getField("a")
        return V(F.coalesce(F.sum(area).over(frame) - head, F.lit(0.0)), DOUBLE)
    if name == "$expMovingAvg":
        named(raw, name, ("input",), ("N", "alpha"))
        if ("N" in raw) == ("alpha" in raw):
            raise DocError("$expMovingAvg needs either N or alpha")
        alpha = raw.get("alpha", 2 / (raw["N"] + 1) if "N" in raw else None)
        if not 0 < alpha <= 1:
            raise DocError("alpha lies between 0 and 1")
        x = _numeric(compile_expr(raw["input"], scope), name).col.cast(DOUBLE)
        return V(moving_average(x, float(alpha), w), DOUBLE)
    if name in ("$covariancePop", "$covarianceSamp"):
        a, b = (_numeric(compile_expr(x, scope), name).col for x in raw)
        fn = F.covar_pop if name == "$covariancePop" else F.covar_samp
        value = fn(a, b).over(w.frame(window))
        if name == "$covarianceSamp":
            both = F.count(F.when(a.isNotNull() & b.isNotNull(), 1)).over(w.frame(window))
            value = F.when(both > 1, value)
        return V(value, DOUBLE)
    v = compile_expr(raw, scope)
    if name == "$locf":
        return V(last_known(v.col, w), v.type)
    if name == "$linearFill":
        return V(linear_fill(_numeric(v, name).col.cast(DOUBLE), w), DOUBLE)
    frame = w.frame(window)
    if name == "$sum":
        v = _numeric(v, name)
        out = LONG if v.is_integer else DOUBLE
        return V(F.coalesce(F.sum(v.col).over(frame).cast(out), F.lit(0).cast(out)), out)
    if name == "$avg":
        return V(F.avg(_numeric(v, name).col).over(frame), DOUBLE)
    if name in ("$min", "$max"):
        return V((F.min if name == "$min" else F.max)(v.col).over(frame), v.type)
    if name in ("$first", "$last"):
        return V((F.first if name == "$first" else F.last)(F.struct(v.col.alias("v"))).over(frame).getField("v"), v.type)
    if name in ("$stdDevPop", "$stdDevSamp"):
        x = _numeric(v, name).col
        return V((F.stddev_pop if name == "$stdDevPop" else F.stddev_samp)(x).over(frame), DOUBLE)
    if name in ("$push", "$addToSet"):
        rows = F.collect_list(F.struct(v.col.alias("v"))).over(frame)
        rows = F.array_distinct(rows) if name == "$addToSet" else rows
        return V(F.transform(rows, lambda x: x.getField("v")), T.ArrayType(v.type))
    raise UnknownOperator(f"unknown window operator: {name}")


