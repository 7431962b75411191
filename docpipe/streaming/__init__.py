"""Pipelines over streams: the stages that need no order, and event-time groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import DocError
from ..functions.core import Scope, compile_expr
from ..operators.accumulators import accumulate, single_accumulator
from ..operators.stages import STAGES, Context

#: Stages that work row by row.
ROW_STAGES = ("$match", "$project", "$addFields", "$set", "$unset", "$replaceRoot", "$replaceWith", "$unwind")


def run_stream(df: DataFrame, pipeline: list[dict], ctx: Context) -> DataFrame:
    """Row stages, and ``$group`` by plain keys, over a streaming frame."""
    for stage in pipeline:
        name, spec = next(iter(stage.items()))
        if name not in (*ROW_STAGES, "$group"):
            raise DocError(f"{name} is not supported on streams")
        df = STAGES[name](df, spec, ctx)
    return df


def windowed_group(df: DataFrame, time: str, size: str, output: dict, by: dict | None = None, slide: str | None = None, late: str = "0 seconds") -> DataFrame:
    """Accumulators in event-time windows, rows later than ``late`` left out."""
    scope = Scope(df.schema)
    keys = [compile_expr(e, scope).col.alias(k) for k, e in (by or {}).items()]
    stamped = df.withColumn("_time", F.col(time).cast("timestamp")).withWatermark("_time", late)
    window = F.window("_time", size, slide) if slide else F.window("_time", size)
    aggregates = [accumulate(*single_accumulator(k, a), scope).col.alias(k) for k, a in output.items()]
    grouped = stamped.groupBy(window.alias("w"), *keys).agg(*aggregates)
    return grouped.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *[k for k in (by or {})], *output)
