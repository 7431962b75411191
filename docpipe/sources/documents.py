"""Frames from literal documents, and rows back to documents."""

from __future__ import annotations

import datetime as dt
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import types as T

from ..errors import TypeMismatch
from ..functions.core import BOOL, DOUBLE, LONG, NTZ, NULL, STRING, common_type


def type_of(value: Any) -> T.DataType:
    """The type of a document value; fields of objects are those seen."""
    if value is None:
        return NULL
    if isinstance(value, bool):
        return BOOL
    if isinstance(value, int):
        return LONG
    if isinstance(value, float):
        return DOUBLE
    if isinstance(value, str):
        return STRING
    if isinstance(value, (bytes, bytearray)):
        return T.BinaryType()
    if isinstance(value, (dt.datetime, dt.date)):
        return NTZ
    if isinstance(value, (list, tuple)):
        return T.ArrayType(_common([type_of(x) for x in value]))
    if isinstance(value, dict):
        if set(value) == {"$oid"}:
            return STRING
        if set(value) == {"$date"}:
            return NTZ
        return T.StructType([T.StructField(k, type_of(x)) for k, x in value.items()])
    raise TypeMismatch(f"no type for {type(value).__name__}")


def _common(types: list[T.DataType]) -> T.DataType:
    """Like common_type, but objects with different fields are joined."""
    structs = [t for t in types if isinstance(t, T.StructType)]
    if structs and all(isinstance(t, (T.StructType, T.NullType)) for t in types):
        fields: dict[str, list[T.DataType]] = {}
        for s in structs:
            for f in s.fields:
                fields.setdefault(f.name, []).append(f.dataType)
        return T.StructType([T.StructField(k, _common(ts)) for k, ts in fields.items()])
    arrays = [t for t in types if isinstance(t, T.ArrayType)]
    if arrays and all(isinstance(t, (T.ArrayType, T.NullType)) for t in types):
        return T.ArrayType(_common([a.elementType for a in arrays]))
    return common_type(types)


def _shaped(value: Any, t: T.DataType) -> Any:
    if value is None:
        return None
    if isinstance(value, dict) and set(value) == {"$oid"}:
        return value["$oid"]
    if isinstance(value, dict) and set(value) == {"$date"}:
        raw = value["$date"]
        value = dt.datetime.fromtimestamp(raw / 1000, dt.timezone.utc) if isinstance(raw, (int, float)) else dt.datetime.fromisoformat(raw.replace("Z", "+00:00"))
    if isinstance(t, T.StructType):
        return tuple(_shaped(value.get(f.name), f.dataType) for f in t.fields)
    if isinstance(t, T.ArrayType):
        return [_shaped(x, t.elementType) for x in value]
    if isinstance(t, T.DoubleType):
        return float(value)
    if isinstance(value, dt.datetime) and value.tzinfo:
        return value.astimezone(dt.timezone.utc).replace(tzinfo=None)
    if isinstance(value, dt.date) and not isinstance(value, dt.datetime):
        return dt.datetime(value.year, value.month, value.day)
    return value


def frame_of(spark: SparkSession, docs: list[dict], schema: T.StructType | None = None) -> DataFrame:
    """A frame of literal documents; a field that some lack is null for them."""
    docs = list(docs)
    kind = schema or (_common([type_of(d) for d in docs]) if docs else T.StructType([T.StructField("_id", STRING)]))
    return spark.createDataFrame([_shaped(d, kind) for d in docs], kind)


def document_of(value: Any) -> Any:
    """A collected row as plain dicts and lists."""
    if isinstance(value, Row):
        return {k: document_of(value[k]) for k in value.__fields__}
    if isinstance(value, list):
        return [document_of(x) for x in value]
    if isinstance(value, dict):
        return {k: document_of(x) for k, x in value.items()}
    return value
