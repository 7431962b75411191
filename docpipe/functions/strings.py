"""String expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import DocError
from .core import (
    BOOL, DOUBLE, LONG, STRING, V, failing_when, named, compile_expr, number, one, operands, operator, text,
)

ISO = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"


@operator("$concat")
def concat(raw, scope):
    return V(F.concat(*[text(v, "$concat").col for v in operands(raw, scope, "$concat")]), STRING)


@operator("$toUpper")
def upper(raw, scope):
    return V(F.upper(F.coalesce(text(one(raw, scope, "$toUpper"), "$toUpper").col, F.lit(""))), STRING)


@operator("$toLower")
def lower(raw, scope):
    return V(F.lower(F.coalesce(text(one(raw, scope, "$toLower"), "$toLower").col, F.lit(""))), STRING)


@operator("$substrCP", "$substr")
def substr(raw, scope):
    s, start, n = operands(raw, scope, "$substrCP", 3, 3)
    first = F.greatest(number(start, "$substrCP").col, F.lit(0)).cast("int")
    count = F.greatest(number(n, "$substrCP").col, F.lit(0)).cast("int")
    return V(F.substring(F.coalesce(text(s, "$substrCP").col, F.lit("")), first + 1, count), STRING)


def _length(name, fn):
    @operator(name)
    def compiled(raw, scope):
        s = text(one(raw, scope, name), name).col
        return V(failing_when(s.isNull(), f"{name} requires a string argument", fn(s).cast(LONG), LONG), LONG)


_length("$strLenCP", F.char_length)
_length("$strLenBytes", F.octet_length)


@operator("$split")
def split(raw, scope):
    s, delimiter = operands(raw, scope, "$split", 2, 2)
    kind = T.ArrayType(STRING)
    if delimiter.is_null:
        raise DocError("$split requires a delimiter")
    if delimiter.const is not None:
        if delimiter.const == "":
            raise DocError("$split requires a non-empty delimiter")
        return V(F.split(text(s, "$split").col, re.escape(delimiter.const), -1), kind)
    quoted = F.concat(F.lit("\\Q"), text(delimiter, "$split").col, F.lit("\\E"))
    return V(F.split(text(s, "$split").col, quoted, -1), kind)


def _trim(name: str, left: bool, right: bool):
    @operator(name)
    def compiled(raw, scope):
        named(raw, name, ("input",), ("chars",))
        v = compile_expr(raw["input"], scope)
        if v.is_null:
            raise DocError(f"{name} requires its input to be a string")
        s = text(v, name).col
        chars = raw.get("chars")
        inner = "\\s" if chars is None else "".join(re.escape(c) for c in str(chars))
        if inner:
            pattern = "|".join([f"^[{inner}]+"] * left + [f"[{inner}]+$"] * right)
            good = F.regexp_replace(s, pattern, "")
        else:
            good = s
        return V(failing_when(s.isNull(), f"{name} requires its input to be a string", good, STRING), STRING)


_trim("$trim", True, True)
_trim("$ltrim", True, False)
_trim("$rtrim", False, True)


def number_text(v: V) -> Column:
    """A number as text: whole values without a fraction."""
    if v.is_integer:
        return v.col.cast(STRING)
    whole = (v.col == F.floor(v.col)) & (F.abs(v.col) < 1e15)
    return F.when(whole, v.col.cast(LONG).cast(STRING)).otherwise(v.col.cast(STRING))


def to_text(v: V, op: str) -> Column:
    if v.is_null or v.is_string or v.is_bool:
        return v.col.cast(STRING)
    if v.is_number:
        return number_text(v)
    if v.is_date:
        return F.date_format(v.col, ISO)
    raise DocError(f"{op} can't convert {v.type.simpleString()} to a string", 241)


@operator("$toString")
def to_string(raw, scope):
    return V(to_text(one(raw, scope, "$toString"), "$toString"), STRING)


def _between(raw, scope, op):
    s, sub, *bounds = operands(raw, scope, op, 2, 4)
    if sub.is_null:
        raise DocError(f"{op} requires a string to look for")
    return text(s, op).col, text(sub, op).col, [number(b, op).cast(LONG).col.cast("int") for b in bounds]


@operator("$indexOfCP")
def index_of(raw, scope):
    s, sub, bounds = _between(raw, scope, "$indexOfCP")
    seen = F.substring(s, F.lit(1), bounds[1]) if len(bounds) > 1 else s
    start = bounds[0] + 1 if bounds else F.lit(1)
    return V((F.locate(sub, seen, start) if isinstance(start, int) else F.call_function("locate", sub, seen, start)).cast(LONG) - 1, LONG)


@operator("$indexOfBytes")
def index_of_bytes(raw, scope):
    s, sub, bounds = _between(raw, scope, "$indexOfBytes")
    start = bounds[0] if bounds else F.lit(0)
    raw_s = F.encode(s, "UTF-8")
    end = F.least(bounds[1], F.octet_length(s)) if len(bounds) > 1 else F.octet_length(s)
    tail = F.decode(F.substring(raw_s, start + 1, F.greatest(end - start, F.lit(0))), "UTF-8")
    at = F.call_function("locate", sub, tail, F.lit(1))
    found = start + F.octet_length(F.substring(tail, F.lit(1), at - 1))
    return V(F.when(s.isNotNull(), F.when(at > 0, found).otherwise(-1)).cast(LONG), LONG)


@operator("$substrBytes")
def substr_bytes(raw, scope):
    s, start, n = operands(raw, scope, "$substrBytes", 3, 3)
    raw_s = F.encode(F.coalesce(text(s, "$substrBytes").col, F.lit("")), "UTF-8")
    part = F.substring(raw_s, number(start, "$substrBytes").col.cast("int") + 1, number(n, "$substrBytes").col.cast("int"))
    return V(F.decode(part, "UTF-8"), STRING)


@operator("$strcasecmp")
def strcasecmp(raw, scope):
    a, b = (F.lower(F.coalesce(text(v, "$strcasecmp").col, F.lit(""))) for v in operands(raw, scope, "$strcasecmp", 2, 2))
    return V(F.when(a < b, -1).when(a > b, 1).otherwise(0).cast(LONG), LONG)


def java_regex(pattern: str, options: str = "") -> str:
    """A pattern with its flags in front; i, m and s are known."""
    bad = set(options) - set("ims")
    if bad:
        raise DocError(f"invalid regular expression options: {''.join(sorted(bad))}", 51108)
    try:
        groups = re.compile(pattern).groups
    except re.error as error:
        raise DocError(f"invalid regular expression: {error}", 51091) from None
    del groups
    return (f"(?{options})" if options else "") + pattern


def _regex(raw, scope, op) -> tuple[Column, str]:
    named(raw, op, ("input", "regex"), ("options",))
    v = compile_expr(raw["input"], scope)
    regex, options = raw["regex"], raw.get("options", "")
    if isinstance(regex, re.Pattern):
        options += "".join(f for f, bit in (("i", re.I), ("m", re.M), ("s", re.S)) if regex.flags & bit)
        regex = regex.pattern
    if not isinstance(regex, str):
        raise DocError(f"{op} requires its regex to be a string", 51105)
    return text(v, op).col, java_regex(regex, options)


_MATCH = T.StructType([T.StructField("match", STRING), T.StructField("idx", LONG), T.StructField("captures", T.ArrayType(STRING))])


@operator("$regexMatch")
def regex_match(raw, scope):
    s, pattern = _regex(raw, scope, "$regexMatch")
    return V(F.coalesce(F.rlike(s, F.lit(pattern)), F.lit(False)), BOOL)


@operator("$regexFind")
def regex_find(raw, scope):
    s, pattern = _regex(raw, scope, "$regexFind")
    p = F.lit(pattern)
    captures = F.array(*[F.regexp_extract(s, pattern, i) for i in range(1, re.compile(pattern).groups + 1)]).cast(T.ArrayType(STRING))
    found = F.struct(F.regexp_extract(s, pattern, 0).alias("match"), (F.regexp_instr(s, p).cast(LONG) - 1).alias("idx"), captures.alias("captures"))
    return V(F.when(F.rlike(s, p), found), _MATCH)


@operator("$regexFindAll")
def regex_find_all(raw, scope):
    """Matches in order; where each begins is counted from what precedes it.

    Every match is found by the text that the ones before it leave.  A pattern
    that matches the empty string is refused.
    """
    s, pattern = _regex(raw, scope, "$regexFindAll")
    if re.compile(pattern).match(""):
        raise DocError("$regexFindAll requires a pattern that matches no empty string")
    groups = re.compile(pattern).groups
    kinds = [F.regexp_extract_all(s, F.lit(pattern), F.lit(g)) for g in range(groups + 1)]
    rows = F.arrays_zip(*[k.alias(f"g{i}") for i, k in enumerate(kinds)])
    # Between matches lie the parts of a split, so starts are running sums of lengths.
    parts = F.split(s, pattern, -1)

    def row(x: Column, i: Column) -> Column:
        before = F.aggregate(F.slice(parts, F.lit(1), i + 1), F.lit(0).cast(LONG), lambda total, p: total + F.char_length(p))
        earlier = F.aggregate(F.slice(kinds[0], F.lit(1), i), F.lit(0).cast(LONG), lambda total, p: total + F.char_length(p))
        captures = F.array(*[x.getField(str(g)) for g in range(1, groups + 1)]).cast(T.ArrayType(STRING))
        return F.struct(x.getField("0").alias("match"), (before + earlier).alias("idx"), captures.alias("captures"))

    zipped = F.transform(rows, lambda x: F.struct(*[x.getField(f"g{g}").alias(str(g)) for g in range(groups + 1)]))
    kind = T.ArrayType(_MATCH)
    return V(F.coalesce(F.transform(zipped, row), F.array().cast(kind)), kind)


def _replace(name: str, every: bool):
    @operator(name)
    def compiled(raw, scope):
        named(raw, name, ("input", "find", "replacement"))
        s, find, new = (text(compile_expr(raw[k], scope), name).col for k in ("input", "find", "replacement"))
        if every:
            return V(F.when(s.isNotNull() & find.isNotNull() & new.isNotNull(), F.replace(s, find, new)), STRING)
        at = F.call_function("locate", find, s, F.lit(1))
        swapped = F.concat(F.substring(s, F.lit(1), at - 1), new, F.substring(s, at + F.char_length(find), F.char_length(s)))
        return V(F.when(new.isNotNull() & find.isNotNull(), F.when(at > 0, swapped).otherwise(s)), STRING)


_replace("$replaceOne", False)
_replace("$replaceAll", True)
