"""Date expressions; all parts are UTC."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import DocError
from .core import LONG, NTZ, STRING, V, compile_expr, moment, named, number, one, operator, struct_of
from .strings import ISO

#: The units and their milliseconds; months are handled apart.
UNIT_MS = {"week": 604_800_000, "day": 86_400_000, "hour": 3_600_000, "minute": 60_000, "second": 1_000, "millisecond": 1}
UNIT_MONTHS = {"year": 12, "quarter": 3, "month": 1}


def millis(d: Column) -> Column:
    return F.unix_millis(d.cast("timestamp"))


def of_millis(ms: Column) -> Column:
    return F.timestamp_millis(ms).cast(NTZ)


def _part(name: str, fn):
    @operator(name)
    def compiled(raw, scope):
        if isinstance(raw, dict) and "date" in raw:
            raw = raw["date"]
        return V(fn(moment(one(raw, scope, name), name).col).cast(LONG), LONG)


def week(d: Column) -> Column:
    """Weeks begin on Sunday; those before the first one are week 0."""
    first = F.dayofweek(F.trunc(d, "year")) - 1
    return F.floor((F.dayofyear(d) - 1 + first) / 7)


def iso_year(d: Column) -> Column:
    return F.date_part(F.lit("YEAROFWEEK"), d)


def iso_day(d: Column) -> Column:
    return F.weekday(d) + 1


def millisecond(d: Column) -> Column:
    return F.pmod(millis(d), F.lit(1000))


for _name, _fn in {
    "$year": F.year, "$month": F.month, "$dayOfMonth": F.dayofmonth, "$hour": F.hour, "$minute": F.minute, "$second": F.second,
    "$millisecond": millisecond, "$dayOfWeek": F.dayofweek, "$dayOfYear": F.dayofyear, "$week": week, "$isoWeek": F.weekofyear,
    "$isoWeekYear": iso_year, "$isoDayOfWeek": iso_day,
}.items():
    _part(_name, _fn)


def plus(d: Column, unit: str, amount: Column) -> Column:
    """Calendar arithmetic; days beyond the end of a month run into the next."""
    if unit in UNIT_MS:
        return of_millis(millis(d) + amount * UNIT_MS[unit])
    if unit not in UNIT_MONTHS:
        raise DocError(f"unknown time unit: {unit}")
    month = F.add_months(F.trunc(d, "month"), (amount * UNIT_MONTHS[unit]).cast("int"))
    start = month.cast("timestamp")
    rest = millis(d) - millis(F.date_trunc("month", d))
    return of_millis(F.unix_millis(start) + rest)


def _unit(raw, op) -> str:
    unit = raw["unit"]
    if unit not in UNIT_MS and unit not in UNIT_MONTHS:
        raise DocError(f"{op}: unknown time unit: {unit}")
    return unit


def _adding(name: str, sign: int):
    @operator(name)
    def compiled(raw, scope):
        named(raw, name, ("startDate", "unit", "amount"))
        d = moment(compile_expr(raw["startDate"], scope), name).col
        amount = number(compile_expr(raw["amount"], scope), name).cast(LONG).col
        return V(plus(d, _unit(raw, name), amount * sign), NTZ)


_adding("$dateAdd", 1)
_adding("$dateSubtract", -1)


@operator("$dateDiff")
def date_diff(raw, scope):
    """Months and longer by calendar boundaries, weeks and shorter by time passed."""
    named(raw, "$dateDiff", ("startDate", "endDate", "unit"))
    a, b = (moment(compile_expr(raw[k], scope), "$dateDiff").col for k in ("startDate", "endDate"))
    unit = _unit(raw, "$dateDiff")
    if unit in UNIT_MS:
        out = F.floor((millis(b) - millis(a)) / UNIT_MS[unit])
    elif unit == "year":
        out = F.year(b) - F.year(a)
    elif unit == "quarter":
        out = (F.year(b) - F.year(a)) * 4 + F.quarter(b) - F.quarter(a)
    else:
        out = (F.year(b) - F.year(a)) * 12 + F.month(b) - F.month(a)
    return V(out.cast(LONG), LONG)


@operator("$dateTrunc")
def date_trunc(raw, scope):
    named(raw, "$dateTrunc", ("date", "unit"))
    return V(F.date_trunc(_unit(raw, "$dateTrunc"), moment(compile_expr(raw["date"], scope), "$dateTrunc").col).cast(NTZ), NTZ)


@operator("$dateFromParts")
def date_from_parts(raw, scope):
    """Parts beyond their range carry over into the next larger one."""
    iso = "isoWeekYear" in raw
    known = ("isoWeekYear", "isoWeek", "isoDayOfWeek") if iso else ("year", "month", "day")
    named(raw, "$dateFromParts", known[:1], (*known[1:], "hour", "minute", "second", "millisecond"))

    def part(name: str, default: int) -> Column:
        return number(compile_expr(raw.get(name, default), scope), "$dateFromParts").cast(LONG).col

    if iso:
        fourth = F.make_date(part(known[0], 0).cast("int"), F.lit(1), F.lit(4))
        monday = F.date_sub(fourth, F.weekday(fourth))
        days = F.date_add(monday, ((part("isoWeek", 1) - 1) * 7 + part("isoDayOfWeek", 1) - 1).cast("int"))
    else:
        first = F.add_months(F.make_date(part("year", 1970).cast("int"), F.lit(1), F.lit(1)), (part("month", 1) - 1).cast("int"))
        days = F.date_add(first, (part("day", 1) - 1).cast("int"))
    clock = ((part("hour", 0) * 60 + part("minute", 0)) * 60 + part("second", 0)) * 1000 + part("millisecond", 0)
    return V(of_millis(F.unix_millis(days.cast("timestamp")) + clock), NTZ)


@operator("$dateToParts")
def date_to_parts(raw, scope):
    named(raw, "$dateToParts", ("date",), ("iso8601",))
    d = moment(compile_expr(raw["date"], scope), "$dateToParts").col
    head = (
        {"isoWeekYear": iso_year(d), "isoWeek": F.weekofyear(d), "isoDayOfWeek": iso_day(d)}
        if raw.get("iso8601")
        else {"year": F.year(d), "month": F.month(d), "day": F.dayofmonth(d)}
    )
    parts = head | {"hour": F.hour(d), "minute": F.minute(d), "second": F.second(d), "millisecond": millisecond(d)}
    v = struct_of({k: V(c.cast(LONG), LONG) for k, c in parts.items()})
    return V(F.when(d.isNotNull(), v.col), v.type)


def formatted(d: Column, pattern: str) -> Column:
    digits = lambda c, n: F.lpad(c.cast(STRING), n, "0")
    known = {
        "Y": lambda: F.date_format(d, "yyyy"), "m": lambda: F.date_format(d, "MM"), "d": lambda: F.date_format(d, "dd"), "H": lambda: F.date_format(d, "HH"),
        "M": lambda: F.date_format(d, "mm"), "S": lambda: F.date_format(d, "ss"), "L": lambda: F.date_format(d, "SSS"), "j": lambda: digits(F.dayofyear(d), 3),
        "w": lambda: F.dayofweek(d).cast(STRING), "u": lambda: iso_day(d).cast(STRING), "U": lambda: digits(week(d), 2), "V": lambda: digits(F.weekofyear(d), 2),
    }
    parts = re.split(r"%([YmdHMSLjwuUV])", pattern)
    return F.concat(*[known[p]() if i % 2 else F.lit(p) for i, p in enumerate(parts) if i % 2 or p])


@operator("$dateToString")
def date_to_string(raw, scope):
    named(raw, "$dateToString", ("date",), ("format", "onNull"))
    d = moment(compile_expr(raw["date"], scope), "$dateToString").col
    out = formatted(d, raw["format"]) if "format" in raw else F.date_format(d, ISO)
    if "onNull" in raw:
        out = F.coalesce(out, compile_expr(raw["onNull"], scope).cast(STRING).col)
    return V(out, STRING)


@operator("$dateFromString")
def date_from_string(raw, scope):
    named(raw, "$dateFromString", ("dateString",), ("format", "onNull", "onError"))
    s = compile_expr(raw["dateString"], scope).cast(STRING).col
    good = F.try_to_timestamp(s).cast(NTZ)
    bad = compile_expr(raw["onError"], scope).cast(NTZ).col if "onError" in raw else F.raise_error(F.lit("$dateFromString can't parse its input")).cast(NTZ)
    null = compile_expr(raw["onNull"], scope).cast(NTZ).col if "onNull" in raw else F.lit(None).cast(NTZ)
    return V(F.when(s.isNull(), null).when(good.isNull(), bad).otherwise(good), NTZ)


