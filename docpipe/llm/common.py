"""Helpers that the operators of this subpackage share.

Documents are rows with an integer id and a text.  Every operator selects the
columns it needs by name, so further columns of any name are no concern of it.
A null text counts as an empty one unless an operator says otherwise.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docpipe.sources.scratch import scratch_path, shared_dir, stash

__all__ = ["scratch_path", "shared_dir", "stash"]

#: The contract's white space: space and U+0009 to U+000D, as for bytes.split().
SPACE_CLASS = r"\x20\x09-\x0D"
WORD = re.compile(rf"[^{SPACE_CLASS}]+")

#: Bytes of an Arrow batch that operators are handed; one row may be longer.
BATCH_BYTES = 4 << 20
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"
_BATCH_DEFAULT = "67108864b"


def bounded_batches(spark: SparkSession) -> None:
    """Have Spark cut Arrow batches by ``BATCH_BYTES``, unless the session names a size itself."""
    if spark.conf.get(_BATCH_SETTING, _BATCH_DEFAULT) == _BATCH_DEFAULT:
        spark.conf.set(_BATCH_SETTING, str(BATCH_BYTES))


def content_key(df: DataFrame, *columns: str) -> list[Column]:
    """``(k1, k2)``: 128 bits that stand for the values of the columns, nulls told apart."""

    def value(c: str) -> Column:
        kind = df.schema[c].dataType.simpleString()
        column = F.col(f"`{c}`")
        return F.to_json(F.struct(column)) if "map<" in kind or "variant" in kind else column  # neither can be hashed

    values = [x for c in columns for x in (value(c), F.col(f"`{c}`").isNull())]
    return [F.xxhash64(F.lit(salt), *values).alias(name) for salt, name in ((11, "k1"), (23, "k2"))]


def with_content_key(docs: DataFrame, *columns: str) -> DataFrame:
    """``(row, k1, k2)``: each row whole in a struct, beside the key of the columns."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *content_key(docs, *columns))


def without_content(docs: DataFrame, keys: DataFrame, *columns: str) -> DataFrame:
    """The rows of ``docs`` whose values of the columns have no key in ``keys(k1, k2)``."""
    return with_content_key(docs, *columns).join(keys.select("k1", "k2"), ["k1", "k2"], "left_anti").select("row.*")


def arrow_map(
    df: DataFrame,
    columns: list[str],
    fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
    schema: str,
) -> DataFrame:
    """``mapInArrow`` over just the given columns, in batches of bounded bytes."""
    bounded_batches(df.sparkSession)
    return df.select(*[F.col(f"`{c}`") for c in columns]).mapInArrow(fn, schema)


def utf8_values(column: pa.Array) -> list[bytes]:
    """The texts of a string column as UTF-8, nulls as empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def str_values(column: pa.Array) -> list[str]:
    return ["" if x is None else x for x in column.to_pylist()]


def spans_of_equal(*keys: np.ndarray) -> np.ndarray:
    """Start offsets of the runs of equal keys, with the length appended."""
    n = len(keys[0])
    if n == 0:
        return np.zeros(1, np.int64)
    new = np.zeros(n, bool)
    new[0] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.append(np.flatnonzero(new), n)


def sorted_groups(
    batches: Iterator[pa.RecordBatch], keys: list[str]
) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole key groups, with group offsets, from batches sorted by key.

    Integer keys only.  Memory holds one batch and the group that crosses its end.
    """
    carry: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([*carry, batch])
        cols = [table[k].to_numpy() for k in keys]
        cuts = spans_of_equal(*cols)
        last = int(cuts[-2])
        if last:
            yield table.slice(0, last).combine_chunks(), cuts[:-1]
        carry = table.slice(last).to_batches()
    if carry:
        table = pa.Table.from_batches(carry).combine_chunks()
        yield table, np.array([0, table.num_rows])
