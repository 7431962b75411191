"""Collections in JSON files, with extended JSON for ids and dates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.core import NTZ, STRING
from ..functions.strings import ISO

#: The wrappers of extended JSON.
OID, DATE = "$oid", "$date"


def _revived(col: Column, kind: T.DataType) -> tuple[Column, T.DataType]:
    if isinstance(kind, T.StructType):
        if kind.names == [OID]:
            return col.getField(OID).cast(STRING), STRING
        if kind.names == [DATE]:
            inner = col.getField(DATE)
            if isinstance(kind[DATE].dataType, T.NumericType):
                return F.timestamp_millis(inner.cast("long")).cast(NTZ), NTZ
            return F.try_to_timestamp(inner).cast(NTZ), NTZ
        parts = {f.name: _revived(col.getField(f.name), f.dataType) for f in kind.fields}
        out = T.StructType([T.StructField(k, t) for k, (_, t) in parts.items()])
        return F.when(col.isNotNull(), F.struct(*[c.alias(k) for k, (c, _) in parts.items()])), out
    if isinstance(kind, T.ArrayType):
        _, element = _revived(F.lit(None).cast(kind.elementType), kind.elementType)
        if element == kind.elementType:
            return col, kind
        return F.transform(col, lambda x: _revived(x, kind.elementType)[0]), T.ArrayType(element)
    return col, kind


def read_json(spark: SparkSession, path: str, schema: T.StructType | None = None, lines: bool = True) -> DataFrame:
    """Documents of a JSON file or folder: one to a line, or one array to a file.

    Without a schema all files are read once to infer it.  A field whose values
    are of several types comes as text.
    """
    reader = spark.read.option("multiLine", not lines).option("primitivesAsString", False)
    df = (reader.schema(schema) if schema else reader).json(path)
    return df.select(*[_revived(F.col(f"`{f.name}`"), f.dataType)[0].alias(f.name) for f in df.schema.fields])


def _plain(col: Column, kind: T.DataType) -> Column:
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.when(col.isNotNull(), F.struct(F.date_format(col, ISO).alias(DATE)))
    if isinstance(kind, T.StructType):
        return F.when(col.isNotNull(), F.struct(*[_plain(col.getField(f.name), f.dataType).alias(f.name) for f in kind.fields]))
    if isinstance(kind, T.ArrayType):
        return F.transform(col, lambda x: _plain(x, kind.elementType))
    return col


def write_json(df: DataFrame, path: str) -> None:
    """One document to a line; dates as {"$date": ISO}.  Fields that are null are left out."""
    df.select(*[_plain(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields]).write.json(path)
