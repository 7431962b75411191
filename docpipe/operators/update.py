"""The update language: update documents become replacement columns."""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import DocError, TypeMismatch
from ..functions.arrays import sorted_by
from ..functions.core import LONG, Scope, V, common_type, get_field, less, literal, missing, number, struct_of
from .match import _is_operators, compile_filter, equals, field_test, negated
from .projection import put, without

#: Operators in the order in which they are applied, whatever their order in the document.
ORDER = (
    "$set", "$unset", "$inc", "$push", "$addToSet", "$pop", "$pull", "$pullAll", "$min", "$max", "$mul", "$rename", "$currentDate", "$bit",
)
POSITIONAL = ("$set", "$unset", "$inc", "$min", "$max", "$mul")


def check_update(update: dict) -> None:
    if not isinstance(update, dict) or not update or not all(k.startswith("$") for k in update):
        raise DocError("an update document consists of update operators", 9)
    for op in update:
        if op not in ORDER and op != "$setOnInsert":
            raise DocError(f"Unknown modifier: {op}", 9)


def check_replacement(doc: dict) -> None:
    if any(k.startswith("$") for k in doc):
        raise DocError("the replacement document must not contain atomic operators", 9)


class Updater:
    """Applies an update to the fields of a row."""

    def __init__(self, scope: Scope, query: dict, array_filters: list[dict] | None = None, now: dt.datetime | None = None):
        self.scope = scope
        self.query = query
        self.filters: dict[str, dict] = {}
        for f in array_filters or []:
            names = {k.split(".")[0] for k in f if not k.startswith("$")}
            if len(names) != 1:
                raise DocError("an array filter names exactly one identifier", 9)
            self.filters[names.pop()] = f
        self.now = now or scope.now

    def apply(self, fields: dict[str, V], update: dict) -> dict[str, V]:
        check_update(update)
        used = {m[1] for spec in update.values() for k in spec for m in re.finditer(r"\$\[(\w+)\]", k)}
        for name in self.filters.keys() - used:
            raise DocError(f"the array filter for identifier '{name}' was not used", 9)
        for op in ORDER:
            for dotted, value in (update.get(op) or {}).items():
                parts = dotted.split(".")
                if op not in POSITIONAL and any(p.startswith("$") for p in parts):
                    raise DocError(f"{op} does not take positional paths", 2)
                if op == "$rename":
                    fields = self._rename(fields, dotted, value)
                elif op == "$unset" and not any(p.startswith("$") or p.isdigit() for p in parts):
                    fields = without(fields, parts)
                else:
                    fields = self._at(fields, parts, lambda old, op=op, value=value: self._changed(op, old, value), [])
        return fields

    # A path is followed through objects and arrays; the change is made at its end.
    def _at(self, fields: dict[str, V], parts: list[str], change: Callable[[V], V], trail: list[str]) -> dict[str, V]:
        head, rest = parts[0], parts[1:]
        old = fields.get(head, missing())
        return put(fields, [head], self._value(old, rest, change, [*trail, head]))

    def _value(self, old: V, parts: list[str], change: Callable[[V], V], trail: list[str]) -> V:
        if not parts:
            return change(old)
        head, rest = parts[0], parts[1:]
        if old.is_array and (head.startswith("$") or head.isdigit()):
            return self._elements(old, head, rest, change, trail)
        if head.startswith("$"):
            if head == "$[]" or old.missing or old.is_null:
                return old
            raise DocError(f"the path '{'.'.join(trail)}' must be an array for {head}", 2)
        sub = {f.name: V(old.col.getField(f.name), f.dataType) for f in old.type.fields} if old.is_struct else {}
        return struct_of(self._at(sub, parts, change, trail))

    def _elements(self, old: V, head: str, rest: list[str], change: Callable[[V], V], trail: list[str]) -> V:
        element = old.type.elementType
        new_type = common_type([self._value(V(F.lit(None).cast(element), element), rest, change, trail).type]) if rest else None
        kind = new_type or common_type([change(V(F.lit(None).cast(element), element)).type, element])
        keep = (lambda x: self._value(V(x, element), rest, lambda v: v, trail).cast(kind).col) if rest else (lambda x: V(x, element).cast(kind).col)

        def changed(x: Column) -> Column:
            return self._value(V(x, element), rest, change, trail).cast(kind).col

        if head == "$[]":
            return V(F.transform(old.col, changed), T.ArrayType(kind))
        if head.isdigit():
            # Shorter arrays are filled with nulls up to the index.
            n = int(head)
            padded = F.concat(old.col, F.array_repeat(F.lit(None).cast(element), F.greatest(F.lit(n + 1) - F.size(old.col), F.lit(0))))
            return V(F.transform(padded, lambda x, i: F.when(i == n, changed(x)).otherwise(keep(x))), T.ArrayType(kind))
        if head == "$":
            at = self._matched(old, trail)
            return V(F.transform(old.col, lambda x, i: F.when(i == at, changed(x)).otherwise(keep(x))), T.ArrayType(kind))
        name = head[2:-1]
        if name not in self.filters:
            raise DocError(f"No array filter found for identifier '{name}'", 2)
        return V(F.transform(old.col, lambda x: F.when(self._chosen(V(x, element), name), changed(x)).otherwise(keep(x))), T.ArrayType(kind))

    def _chosen(self, x: V, name: str) -> Column:
        out = F.lit(True)
        for key, cond in self.filters[name].items():
            parts = key.split(".")[1:]
            out = out & field_test(x, parts, cond, self.scope)
        return out

    def _matched(self, array: V, trail: list[str]) -> Column:
        """The index of the first element that meets the query's conditions on the array."""
        prefix, element = ".".join(trail), array.type.elementType
        tests = []
        for key, cond in self.query.items():
            if key == prefix:
                if isinstance(cond, dict) and "$elemMatch" in cond:
                    inner = cond["$elemMatch"]
                    if _is_operators(inner):
                        tests.append(lambda x, c=inner: field_test(V(x, element), [], c, self.scope))
                    else:
                        tests.append(lambda x, c=inner: compile_filter(c, Scope(element, {}, self.now, V(x, element), [])))
                else:
                    tests.append(lambda x, c=cond: field_test(V(x, element), [], c, self.scope))
            elif key.startswith(prefix + "."):
                rest = key[len(prefix) + 1 :].split(".")
                tests.append(lambda x, r=rest, c=cond: field_test(V(x, element), r, c, self.scope))
        if not tests:
            raise DocError("The positional operator did not find the match needed from the query.", 2)

        def meets(x: Column) -> Column:
            out = F.lit(True)
            for t in tests:
                out = out & t(x)
            return out

        return F.array_position(F.transform(array.col, meets), F.lit(True)).cast("int") - 1

    def _rename(self, fields: dict[str, V], old: str, new: str) -> dict[str, V]:
        if old == new:
            raise DocError("The source and target field for $rename must differ", 2)
        parts = old.split(".")
        v = fields.get(parts[0], missing())
        for p in parts[1:]:
            v = get_field(v, p)
        return fields if v.missing else put(without(fields, parts), new.split("."), v)

    def _changed(self, op: str, old: V, value: Any) -> V:
        if op == "$set":
            new = literal(value)
            return new.cast(old.type) if new.is_null and not old.missing else new
        if op == "$unset":
            return V(F.lit(None).cast(old.type), old.type)
        if op in ("$inc", "$mul"):
            if isinstance(value, bool) or not isinstance(value, (int, float)):
                raise TypeMismatch(f"Cannot {op[1:]} with non-numeric argument")
            n = literal(value)
            if old.missing or not old.is_number:
                if op == "$mul" and not (old.missing or old.is_null):
                    raise TypeMismatch("Cannot apply $mul to a value of non-numeric type")
                return n if op == "$inc" else literal(0 * value)
            kind = common_type([number(old, op).type, n.type])
            before = F.coalesce(old.cast(kind).col, F.lit(0).cast(kind))
            return V(before + n.cast(kind).col if op == "$inc" else before * n.cast(kind).col, kind)
        if op in ("$min", "$max"):
            n = literal(value)
            if old.missing or old.is_null:
                return n
            kind = common_type([old.type, n.type])
            a, b = old.cast(kind), n.cast(kind)
            better = less(b, a, False) if op == "$min" else less(a, b, False)
            return V(F.when(better, b.col).otherwise(a.col), kind)
        if op == "$currentDate":
            if isinstance(value, dict) and value.get("$type") == "timestamp":
                return literal(int(self.now.replace(tzinfo=dt.timezone.utc).timestamp() * 1000))
            return literal(self.now)
        if op == "$bit":
            out = F.lit(0).cast("int") if old.missing else F.coalesce(old.col.cast("int"), F.lit(0))
            for name, fn in (("and", "bitwiseAND"), ("or", "bitwiseOR"), ("xor", "bitwiseXOR")):
                if name in value:
                    out = getattr(out, fn)(F.lit(value[name]).cast("int"))
            return V(out.cast(LONG), LONG)
        return self._array(op, old, value)

    def _array(self, op: str, old: V, value: Any) -> V:
        if not old.missing and not old.is_array:
            raise TypeMismatch(f"The field must be an array for {op} but is of type {old.type.simpleString()}")
        if old.missing:
            if op not in ("$push", "$addToSet"):
                return old
            element = None
        else:
            element = old.type.elementType
        if op in ("$push", "$addToSet"):
            mods = value if isinstance(value, dict) and "$each" in value else {"$each": [value]}
            new = literal(list(mods["$each"]))
            kind = new.type if element is None else common_type([old.type, new.type])
            before = F.array().cast(kind) if element is None else F.coalesce(old.cast(kind).col, F.array().cast(kind))
            added = new.cast(kind).col
            if op == "$addToSet":
                fresh = F.filter(F.array_distinct(added), lambda x: ~F.exists(before, lambda y: y.eqNullSafe(x)))
                return V(F.concat(before, fresh), kind)
            if "$position" in mods:
                n = mods["$position"]
                if isinstance(n, bool) or not isinstance(n, int):
                    raise DocError("$position must be an integer")
                at = F.least(F.lit(n), F.size(before)) if n >= 0 else F.greatest(F.size(before) + n, F.lit(0))
                out = F.concat(F.slice(before, F.lit(1), at), added, F.slice(before, at + 1, F.size(before)))
            else:
                out = F.concat(before, added)
            if "$sort" in mods:
                out = sorted_by(V(out, kind), mods["$sort"])
            if "$slice" in mods:
                n = mods["$slice"]
                size = F.size(out)
                out = F.slice(out, F.lit(1), F.lit(n)) if n >= 0 else F.slice(out, F.greatest(size + n, F.lit(0)) + 1, F.lit(-n))
            return V(out, kind)
        if op == "$pop":
            if value not in (1, -1):
                raise DocError("$pop expects 1 or -1", 9)
            n = F.greatest(F.size(old.col) - 1, F.lit(0))
            return V(F.slice(old.col, F.lit(1 if value == 1 else 2), n), old.type)
        if op == "$pullAll":
            return V(F.filter(old.col, lambda x: negated(_any([equals(V(x, element), y) for y in value]))), old.type)

        def gone(x: Column) -> Column:
            v = V(x, element)
            if isinstance(value, dict) and not _is_operators(value) and isinstance(element, T.StructType):
                return compile_filter(value, Scope(element, {}, self.now, v, []))
            return field_test(v, [], value, self.scope)

        return V(F.filter(old.col, lambda x: negated(gone(x))), old.type)


def _any(parts: list[Column]) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | p
    return out


def upsert_seed(query: dict) -> dict:
    """The document that an upsert starts from: the query's equalities."""
    out: dict[str, Any] = {}
    for k, v in query.items():
        if k == "$and":
            for part in v:
                out.update(upsert_seed(part))
        elif not k.startswith("$") and not isinstance(v, re.Pattern):
            if isinstance(v, dict) and set(v) == {"$eq"}:
                _put_plain(out, k.split("."), v["$eq"])
            elif not _is_operators(v):
                _put_plain(out, k.split("."), v)
    return out


def _put_plain(doc: dict, parts: list[str], value: Any) -> None:
    for p in parts[:-1]:
        doc = doc.setdefault(p, {})
    doc[parts[-1]] = value


