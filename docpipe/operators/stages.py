"""Pipeline stages: each takes a frame and gives one."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import DocError, TypeMismatch, UnknownOperator
from ..functions.core import DOUBLE, LONG, NTZ, NULL, STRING, Scope, V, common_type, compile_expr, literal, name_of, named, path, struct_of
from ..functions.dates import UNIT_MS, UNIT_MONTHS, millis, of_millis, plus
from ..plans.rewrite import rewrite
from . import geo
from .accumulators import Windows, accumulate, last_known, linear_fill, single_accumulator, window_value
from .match import compile_filter
from .projection import add_fields, fields_of, project, put, replace_root, select, unset


@dataclass
class Context:
    """What a pipeline sees besides its frame."""

    spark: SparkSession
    collection: Callable[[str], DataFrame]
    write: Callable[[str, DataFrame], None] | None = None
    merge: Callable[[dict, DataFrame], None] | None = None
    indexes: Callable[[], list[dict]] | None = None
    variables: dict[str, V] = field(default_factory=dict)
    now: dt.datetime = field(default_factory=lambda: dt.datetime.now(dt.timezone.utc).replace(tzinfo=None, microsecond=0))
    order: list[Column] = field(default_factory=list)
    checkpoint: bool = True

    def scope(self, df: DataFrame) -> Scope:
        return Scope(df.schema, dict(self.variables), self.now, order=[c for c in self.order])


STAGES: dict[str, Callable[[DataFrame, Any, Context], DataFrame]] = {}


def stage(*names: str):
    def put_in(fn):
        for n in names:
            STAGES[n] = fn
        return fn

    return put_in


def validate(pipeline: list) -> None:
    if not isinstance(pipeline, (list, tuple)):
        raise TypeMismatch("a pipeline is a list of stages")
    for i, s in enumerate(pipeline):
        if not isinstance(s, dict) or len(s) != 1:
            raise DocError("a pipeline stage specification object must contain exactly one field", 40323)
        name = next(iter(s))
        if name not in STAGES:
            raise UnknownOperator(f"Unrecognized pipeline stage name: '{name}'", 40324)
        if name == "$out" and i != len(pipeline) - 1:
            raise DocError("$out can only be the final stage in the pipeline", 40601)
        if name in ("$documents", "$geoNear") and i:
            raise DocError(f"{name} is only valid as the first stage in a pipeline", 40602)


def run_pipeline(df: DataFrame, pipeline: list[dict], ctx: Context) -> DataFrame:
    """Compile the whole pipeline over ``df``; nothing runs but sinks."""
    validate(pipeline)
    for s in rewrite(list(pipeline)):
        name, spec = next(iter(s.items()))
        df = STAGES[name](df, spec, ctx)
    return df


@stage("$match")
def match(df, spec, ctx):
    return df.where(compile_filter(spec, ctx.scope(df)))


@stage("$project")
def project_(df, spec, ctx):
    return project(df, spec, ctx.scope(df))


@stage("$addFields", "$set")
def add_fields_(df, spec, ctx):
    return add_fields(df, spec, ctx.scope(df))


@stage("$unset")
def unset_(df, spec, ctx):
    return unset(df, spec)


@stage("$replaceRoot")
def replace_root_(df, spec, ctx):
    named(spec, "$replaceRoot", ("newRoot",))
    return replace_root(df, spec["newRoot"], ctx.scope(df))


@stage("$replaceWith")
def replace_with(df, spec, ctx):
    return replace_root(df, spec, ctx.scope(df))


def sort_columns(spec: dict, scope: Scope) -> list[tuple[Column, int, T.DataType]]:
    """Columns, directions and types to sort by; an array sorts by its least or greatest element, [] lowest."""
    keys = []
    for dotted, direction in spec.items():
        if direction not in (1, -1):
            raise DocError("a sort direction is 1 or -1", 15975)
        v = path(scope, dotted)
        if v.is_array:
            edge = F.array_min(v.col) if direction == 1 else F.array_max(v.col)
            keys += [(F.when(F.size(v.col) == 0, 0).otherwise(1), direction, T.IntegerType()), (edge, direction, v.type.elementType)]
        elif v.is_map:
            keys.append((F.to_json(v.col), direction, STRING))
        else:
            keys.append((v.col, direction, v.type))
    return keys


def sort_keys(df: DataFrame, spec: dict, scope: Scope) -> list[Column]:
    """Nulls are lowest."""
    return [c.asc_nulls_first() if d == 1 else c.desc_nulls_last() for c, d, _ in sort_columns(spec, scope)]


@stage("$sort")
def sort(df, spec, ctx):
    df = order_only(df, spec, ctx)
    return df.orderBy(*sort_keys(df, spec, ctx.scope(df)))


@stage("$_order")
def order_only(df, spec, ctx):
    """A sort before a stage that takes the order from its keys: rows need not move."""
    if not isinstance(spec, dict) or not spec:
        raise DocError("$sort needs at least one field", 15976)
    ctx.order = [growing(*key) for key in sort_columns(spec, ctx.scope(df))]
    return df


def growing(col: Column, direction: int, kind: T.DataType) -> Column:
    """A value that grows along the sort, nulls included.

    Descending texts become their negated codes, closed by a 1 that puts a text
    behind those it begins; objects go part by part, arrays in them by their JSON.
    """
    if direction == 1:
        return col
    if isinstance(kind, T.IntegralType):
        key = F.bitwise_not(col)  # unlike the negative it can't overflow
    elif isinstance(kind, (T.DoubleType, T.FloatType)):
        key = F.struct(~F.isnan(col), -col)
    elif isinstance(kind, T.DecimalType):
        key = -col
    elif isinstance(kind, T.BooleanType):
        key = ~col
    elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        key = -F.unix_micros(col.cast("timestamp"))
    elif isinstance(kind, T.DateType):
        key = -F.unix_date(col)
    elif isinstance(kind, T.StructType):
        key = F.struct(*[growing(col.getField(f.name), -1, f.dataType).alias(f.name) for f in kind.fields])
    elif isinstance(kind, (T.ArrayType, T.MapType)):
        return growing(F.to_json(col), -1, STRING)
    elif isinstance(kind, T.NullType):
        return F.lit(0)
    else:
        codes = F.transform(F.filter(F.split(col.cast(STRING), ""), lambda c: c != ""), lambda c: -F.ascii(c))
        key = F.concat(codes, F.array(F.lit(1)))
    return F.struct(col.isNull(), key)


@stage("$limit")
def limit(df, spec, ctx):
    if isinstance(spec, bool) or not isinstance(spec, int) or spec <= 0:
        raise DocError("the limit must be positive", 15958)
    return df.limit(spec)


@stage("$skip")
def skip(df, spec, ctx):
    if isinstance(spec, bool) or not isinstance(spec, int) or spec < 0:
        raise DocError("the argument to $skip must be a non-negative integer", 15956)
    return df.offset(spec)


@stage("$count")
def count(df, spec, ctx):
    if not isinstance(spec, str) or not spec or spec.startswith("$") or "." in spec:
        raise DocError("the count field must be a non-empty name without $ or .", 40156)
    ctx.order = []
    return df.agg(F.count(F.lit(1)).alias(spec)).where(F.col(name_of(spec)) > 0)


@stage("$unwind")
def unwind(df, spec, ctx):
    spec = {"path": spec} if isinstance(spec, str) else spec
    named(spec, "$unwind", ("path",), ("preserveNullAndEmptyArrays", "includeArrayIndex"))
    if not spec["path"].startswith("$"):
        raise DocError("path option to $unwind stage should be prefixed with a '$'", 28818)
    parts = spec["path"][1:].split(".")
    keep, index = spec.get("preserveNullAndEmptyArrays", False), spec.get("includeArrayIndex")
    fields = fields_of(df)
    v = path(ctx.scope(df), ".".join(parts)) if len(parts) == 1 else _exact(fields, parts)
    if v.missing:
        return df if keep else df.where(F.lit(False))
    at = f"_index_{len(fields)}"
    if not v.is_array:
        out = df if keep else df.where(v.col.isNotNull())
        return out.withColumn(index, F.when(v.col.isNotNull(), F.lit(0).cast(LONG))) if index else out
    if len(parts) == 1 and not index:
        others = [F.col(name_of(k)) for k in fields]
        exploded = (F.explode_outer if keep else F.explode)(v.col).alias("_value")
        out = df.select(*others, exploded)
        return out.select(*[(F.col("_value") if k == parts[0] else F.col(name_of(k))).alias(k) for k in fields])
    out = df.select("*", (F.posexplode_outer if keep else F.posexplode)(v.col).alias(at, "_value"))
    fields = {k: x for k, x in fields_of(out).items() if k not in (at, "_value")}
    fields = put(fields, parts, V(F.col("_value"), v.type.elementType))
    if index:
        fields[index] = V(F.col(at).cast(LONG), LONG)
    return select(out, fields)


def _exact(fields: dict[str, V], parts: list[str]) -> V:
    from ..functions.core import get_field, missing

    v = fields.get(parts[0], missing())
    for p in parts[1:]:
        v = get_field(v, p)
    return v


@stage("$group")
def group(df, spec, ctx):
    if "_id" not in spec:
        raise DocError("a group specification must include an _id", 15955)
    scope = ctx.scope(df)
    key = compile_expr(spec["_id"], scope)
    aggregates = []
    for name, acc in spec.items():
        if name == "_id":
            continue
        op, raw = single_accumulator(name, acc)
        v = accumulate(op, raw, scope)
        aggregates.append(v.col.alias(name))
    ctx.order = []
    if key.const is not None or key.is_null:
        # One group, and none of no rows.
        out = df.agg(F.count(F.lit(1)).alias("_rows"), *aggregates).where("_rows > 0")
        return out.select(key.col.alias("_id"), *[F.col(name_of(n)) for n in spec if n != "_id"])
    if key.is_struct and isinstance(spec["_id"], dict) and not any(k.startswith("$") for k in spec["_id"]):
        # Grouping by the parts keeps keys flat in the shuffle.
        parts = {f.name: key.col.getField(f.name) for f in key.type.fields}
        fields = {k: compile_expr(e, scope) for k, e in spec["_id"].items()}
        keys = [fields[k].col.alias(f"_key_{i}") for i, k in enumerate(parts)]
        grouped = df.groupBy(*keys)
        out = grouped.agg(*aggregates) if aggregates else df.select(*keys).distinct()
        whole = F.struct(*[F.col(f"_key_{i}").alias(k) for i, k in enumerate(parts)]).alias("_id")
        return out.select(whole, *[F.col(name_of(n)) for n in spec if n != "_id"])
    grouped = df.groupBy(key.col.alias("_id"))
    return grouped.agg(*aggregates) if aggregates else df.select(key.col.alias("_id")).distinct()


@stage("$sortByCount")
def sort_by_count(df, spec, ctx):
    key = compile_expr(spec, ctx.scope(df))
    ctx.order = []
    return df.groupBy(key.col.alias("_id")).agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"))


_COUNT = {"count": {"$sum": 1}}


def _output(df: DataFrame, spec: dict, scope: Scope) -> list[Column]:
    return [accumulate(*single_accumulator(k, a), scope).col.alias(k) for k, a in (spec.get("output") or _COUNT).items()]


@stage("$bucket")
def bucket(df, spec, ctx):
    named(spec, "$bucket", ("groupBy", "boundaries"), ("default", "output"))
    bounds = spec["boundaries"]
    if len(bounds) < 2 or any(b <= a for a, b in zip(bounds, bounds[1:])):
        raise DocError("$bucket boundaries must be two or more, in ascending order", 40194)
    scope = ctx.scope(df)
    v = compile_expr(spec["groupBy"], scope)
    kinds = [literal(b).type for b in bounds] + ([literal(spec["default"]).type] if "default" in spec else [])
    kind = common_type(kinds)
    other = literal(spec["default"]).cast(kind).col if "default" in spec else F.raise_error(F.lit("$bucket could not find a matching branch")).cast(kind)
    where = F
    for low, high in zip(bounds, bounds[1:]):
        inside = (v.col >= low) & (v.col < high) if v.is_number else F.lit(False)
        where = where.when(inside, literal(low).cast(kind).col)
    aggregates = _output(df, spec, scope)
    ctx.order = []
    return df.groupBy(where.otherwise(other).alias("_id")).agg(*aggregates).orderBy("_id")


@stage("$bucketAuto")
def bucket_auto(df, spec, ctx):
    """Equal slices of ceil(n / buckets) rows in order; rows without a value go.

    Positions come from counts of distinct values by range, so no partition
    holds all rows: a running count over the distinct values of each range plus
    the totals of the ranges before it.
    """
    named(spec, "$bucketAuto", ("groupBy", "buckets"), ("output", "granularity"))
    n = spec["buckets"]
    if isinstance(n, bool) or not isinstance(n, int) or n <= 0:
        raise DocError("$bucketAuto needs a positive number of buckets", 40243)
    scope = ctx.scope(df)
    v = compile_expr(spec["groupBy"], scope)
    rows = df.withColumn("_v", v.col).where("_v is not null")
    sized = positioned(rows, "_v", [F.col(name_of(c)) for c in df.columns if not isinstance(df.schema[c].dataType, T.MapType)])
    each = F.ceil(F.col("_total") / n)
    sized = sized.withColumn("_b", F.floor((F.col("_position") - 1) / each))
    aggregates = _output(df, spec, scope)
    grouped = sized.groupBy("_b").agg(F.min("_v").alias("_min"), F.max("_v").alias("_max"), *aggregates)
    after = F.lead("_min").over(Window.orderBy("_b"))  # as many rows as buckets
    ctx.order = []
    names = list((spec.get("output") or _COUNT))
    return grouped.select(F.struct(F.col("_min").alias("min"), F.coalesce(after, F.col("_max")).alias("max")).alias("_id"), *[F.col(name_of(k)) for k in names]).orderBy("_id")


def positioned(df: DataFrame, key: str, ties: list[Column]) -> DataFrame:
    """Rows with ``_position`` in the order of the key and ``_total``.

    A range partitioning sorts; each partition counts its own rows, and the
    counts before it, one for each partition, are added by a broadcast join.
    """
    from ..sources.scratch import stash

    ordered = df.repartitionByRange(F.col(key), *ties).sortWithinPartitions(key, *ties)
    row = F.monotonically_increasing_id()
    part, place = F.shiftright(row, 33), row.bitwiseAND(F.lit((1 << 33) - 1))
    # Written once: a second range partitioning might cut elsewhere.
    numbered = stash(ordered.select("*", part.alias("_p"), place.alias("_place")), "positions")
    counts = numbered.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    order = Window.orderBy("_p")
    before = counts.select("_p", (F.sum("_n").over(order) - F.col("_n")).alias("_before"), F.sum("_n").over(Window.partitionBy()).alias("_total"))
    return numbered.join(F.broadcast(before), "_p").withColumn("_position", F.col("_place") + F.col("_before") + 1).drop("_p", "_place", "_before")


@stage("$facet")
def facet(df, spec, ctx):
    """One row; each facet scans the input on its own, so nothing need be cached."""
    out = None
    for name, pipeline in spec.items():
        for s in pipeline:
            if next(iter(s)) in ("$facet", "$out", "$merge", "$geoNear", "$documents"):
                raise DocError(f"{next(iter(s))} is not allowed to be used within a $facet stage", 40600)
        inner = _copy(ctx)
        part = run_pipeline(df, pipeline, inner)
        whole = F.struct(*[F.col(name_of(c)) for c in part.columns])
        if inner.order:
            # The rows of a sort keep their order in the array.
            key = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(inner.order)])
            rows = F.transform(F.sort_array(F.collect_list(F.struct(key.alias("o"), whole.alias("v")))), lambda x: x.getField("v"))
        else:
            rows = F.collect_list(whole)
        one = part.agg(rows.alias(name))
        out = one if out is None else out.crossJoin(one)  # one row each
    ctx.order = []
    return out


def _copy(ctx: Context) -> Context:
    from dataclasses import replace

    return replace(ctx, variables=dict(ctx.variables), order=list(ctx.order))


def _keys_equal(a: V, b: V) -> Column:
    kind = common_type([a.type, b.type])
    return a.cast(kind).col.eqNullSafe(b.cast(kind).col)


@stage("$lookup")
def lookup(df, spec, ctx):
    """Rows of another collection as an array, grouped there before the join."""
    if "pipeline" in spec:
        return _lookup_pipeline(df, spec, ctx)
    named(spec, "$lookup", ("from", "localField", "foreignField", "as"))
    foreign = ctx.collection(spec["from"])
    scope = Scope(foreign.schema)
    key = path(scope, spec["foreignField"])
    whole = F.struct(*[F.col(name_of(c)) for c in foreign.columns])
    local = path(ctx.scope(df), spec["localField"])
    empty = T.ArrayType(foreign.schema)
    try:
        kind = common_type([local.type, key.type])
    except TypeMismatch:
        return _with_array(df, spec["as"], F.array().cast(empty))
    nested = foreign.groupBy(key.cast(kind).col.alias("_k")).agg(F.collect_list(whole).alias("_found"))
    left = df.withColumn("_j", local.cast(kind).col)
    joined = left.join(nested, F.col("_j").eqNullSafe(F.col("_k")), "left")
    return _with_array(joined, spec["as"], F.coalesce(F.col("_found"), F.array().cast(empty))).drop("_j", "_k", "_found")


def _with_array(df: DataFrame, name: str, col: Column) -> DataFrame:
    return df.withColumn(name, col)


@stage("$_join")
def join(df, spec, ctx):
    """A rewritten $lookup: the joined row as one object, or a semi or anti join."""
    foreign = ctx.collection(spec["from"])
    key = path(Scope(foreign.schema), spec["foreignField"])
    local = path(ctx.scope(df), spec["localField"])
    kind = common_type([local.type, key.type])
    left = df.drop(spec["as"]).withColumn("_j", local.cast(kind).col)
    on = F.col("_j").eqNullSafe(F.col("_k"))
    if spec["how"] in ("semi", "anti"):
        out = left.join(foreign.select(key.cast(kind).col.alias("_k")), on, f"left_{spec['how']}").drop("_j")
        return out.withColumn(spec["as"], F.array().cast(T.ArrayType(foreign.schema))) if spec.get("keep") else out
    right = foreign.select(key.cast(kind).col.alias("_k"), F.struct(*[F.col(name_of(c)) for c in foreign.columns]).alias(spec["as"]))
    return left.join(right, on, spec["how"]).drop("_j", "_k")


def _conjuncts(e: Any) -> list[Any]:
    return [c for x in e["$and"] for c in _conjuncts(x)] if isinstance(e, dict) and set(e) == {"$and"} else [e]


def _mentions(e: Any, names: set[str]) -> bool:
    if isinstance(e, str):
        return e.startswith("$$") and e[2:].split(".")[0] in names
    if isinstance(e, dict):
        return any(_mentions(v, names) for v in e.values())
    return isinstance(e, (list, tuple)) and any(_mentions(v, names) for v in e)


def _lookup_pipeline(df: DataFrame, spec: dict, ctx: Context) -> DataFrame:
    """A correlated lookup as a join on distinct values of its variables.

    The variables' distinct values meet the foreign rows under the ``$expr``
    conditions that name them, equalities becoming join keys; the rest of the
    sub-pipeline runs for each value by grouping or ranking within it.
    """
    named(spec, "$lookup", ("from", "pipeline", "as"), ("let", "localField", "foreignField"))
    foreign = ctx.collection(spec["from"])
    pipeline = [dict(s) for s in spec["pipeline"]]
    scope = ctx.scope(df)
    values = {k: compile_expr(e, scope) for k, e in spec.get("let", {}).items()}
    if "localField" in spec:
        values["_local"] = path(scope, spec["localField"])
        pipeline.insert(0, {"$match": {"$expr": {"$eq": ["$" + spec["foreignField"], "$$_local"]}}})
    names = set(values)
    keyed = df.withColumns({f"_v_{k}": v.col for k, v in values.items()}) if values else df
    inner = _copy(ctx)
    if not any(_mentions(s, names) for s in pipeline):
        rows = run_pipeline(foreign, pipeline, inner)
        whole = _ordered_rows(rows, inner)
        return keyed.crossJoin(rows.agg(whole.alias(spec["as"]))).drop(*[f"_v_{k}" for k in values])  # one row
    distinct = keyed.select(*[f"_v_{k}" for k in values]).distinct()
    first = pipeline[0].get("$match", {}) if pipeline else {}
    conditions = _conjuncts(first["$expr"]) if "$expr" in first else []
    bound = {k: V(F.col(f"_v_{k}"), v.type) for k, v in values.items()}
    inner.variables.update(bound)
    on = []
    both = Scope(T.StructType(foreign.schema.fields + distinct.schema.fields), dict(inner.variables), ctx.now)
    for c in conditions:
        pair = c.get("$eq") if isinstance(c, dict) else None
        if pair and sum(isinstance(p, str) and p.startswith("$$") and p[2:] in names for p in pair) == 1:
            a, b = (compile_expr(p, both) for p in pair)
            on.append(_keys_equal(a, b))
        else:
            from ..functions.core import truthy

            on.append(truthy(compile_expr(c, both), True))
    rest = {k: v for k, v in first.items() if k != "$expr"}
    later = ([{"$match": rest}] if rest else []) + pipeline[1 if "$match" in (pipeline[0] if pipeline else {}) else 0 :]
    if not conditions and "$match" in (pipeline[0] if pipeline else {}):
        later = pipeline
    joined = foreign.join(distinct, reduce(lambda a, b: a & b, on)) if on else foreign.crossJoin(distinct)
    keys = [f"_v_{k}" for k in values]
    rows = _run_keyed(joined, later, inner, keys)
    nested = rows.groupBy(*keys).agg(_ordered_rows(rows.drop(*keys), inner).alias("_found"))
    empty = T.ArrayType(T.StructType([f for f in rows.schema.fields if f.name not in keys]))
    nested = nested.select(*[F.col(k).alias(f"{k}_r") for k in keys], "_found")
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"{k}_r")) for k in keys])
    out = keyed.join(nested, same, "left")
    return out.withColumn(spec["as"], F.coalesce(F.col("_found"), F.array().cast(empty))).drop("_found", *keys, *[f"{k}_r" for k in keys])


def _ordered_rows(rows: DataFrame, inner: Context) -> Column:
    whole = F.struct(*[F.col(name_of(c)) for c in rows.columns])
    if not inner.order:
        return F.collect_list(whole)
    key = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(inner.order)])
    return F.transform(F.sort_array(F.collect_list(F.struct(key.alias("o"), whole.alias("v")))), lambda x: x.getField("v"))


def _run_keyed(df: DataFrame, pipeline: list[dict], ctx: Context, keys: list[str]) -> DataFrame:
    """Stages that run within each value of the keys."""
    cols = [F.col(k) for k in keys]
    window = Window.partitionBy(*cols)
    for s in pipeline:
        name, spec = next(iter(s.items()))
        if name == "$sort":
            scope = ctx.scope(df)
            ctx.order = [growing(*key) for key in sort_columns(spec, scope)]
        elif name in ("$limit", "$skip"):
            ranked = df.withColumn("_rn", F.row_number().over(window.orderBy(*(ctx.order or [F.lit(1)]))))
            df = ranked.where(F.col("_rn") <= spec if name == "$limit" else F.col("_rn") > spec).drop("_rn")
        elif name == "$count":
            df = df.groupBy(*cols).agg(F.count(F.lit(1)).alias(spec))
        elif name == "$group":
            scope = ctx.scope(df)
            key = compile_expr(spec["_id"], scope)
            aggregates = [accumulate(*single_accumulator(k, a), scope).col.alias(k) for k, a in spec.items() if k != "_id"]
            ctx.order = []
            whole = key.col.cast(STRING) if key.is_null else key.col
            df = df.groupBy(*cols, whole.alias("_id")).agg(*aggregates) if aggregates else df.select(*cols, whole.alias("_id")).distinct()
        elif name == "$project":
            kept = {**spec, **{k: 1 for k in keys}} if not all(v in (0, False) for k, v in spec.items() if k != "_id") else spec
            df = project(df, kept, ctx.scope(df))
        elif name in ("$match", "$addFields", "$set", "$unset", "$unwind"):
            df = STAGES[name](df, spec, ctx)
        else:
            raise DocError(f"{name} is not supported in a correlated $lookup pipeline")
    return df


@stage("$graphLookup")
def graph_lookup(df, spec, ctx):
    """Breadth-first search by one join a level over (start, node), each node once.

    Levels are written to the shared folder; the search ends at maxDepth or when
    no start reaches a node that it has not met.
    """
    named(spec, "$graphLookup", ("from", "startWith", "connectFromField", "connectToField", "as"), ("maxDepth", "depthField", "restrictSearchWithMatch"))
    from ..sources.scratch import stash

    foreign = ctx.collection(spec["from"])
    if "restrictSearchWithMatch" in spec:
        foreign = foreign.where(compile_filter(spec["restrictSearchWithMatch"], Scope(foreign.schema, now=ctx.now)))
    fscope = Scope(foreign.schema, now=ctx.now)
    to, frm = path(fscope, spec["connectToField"]), path(fscope, spec["connectFromField"])
    start = compile_expr(spec["startWith"], ctx.scope(df))
    element = lambda v: v.type.elementType if v.is_array else v.type
    kind = common_type([element(to), element(frm), element(start)])
    many = lambda v: v.cast(T.ArrayType(kind)).col if v.is_array else F.array(v.cast(kind).col)
    whole = F.struct(*[F.col(name_of(c)) for c in foreign.columns])
    nodes = foreign.select(F.explode(many(to)).alias("_to"), many(frm).alias("_from"), whole.alias("_node"))
    nodes = nodes.withColumn("_nid", F.xxhash64(F.to_json("_node")))
    starts = df.select(many(start).alias("_s")).distinct()
    frontier = starts.select("_s", F.explode("_s").alias("_key")).where("_key is not null").distinct()
    found, depth, limit_ = None, 0, spec.get("maxDepth")
    while True:
        step = frontier.join(nodes, F.col("_key") == F.col("_to")).select("_s", "_nid", "_node", "_from")
        step = step.dropDuplicates(["_s", "_nid"])
        if found is not None:
            step = step.join(found.select("_s", "_nid"), ["_s", "_nid"], "left_anti")
        step = stash(step.withColumn("_depth", F.lit(depth).cast(LONG)), "graph")
        if step.limit(1).count() == 0:
            found = step if found is None else found
            break
        found = step if found is None else found.unionByName(step)
        if limit_ is not None and depth >= limit_:
            break
        frontier = step.select("_s", F.explode("_from").alias("_key")).where("_key is not null").distinct()
        depth += 1
    node = F.col("_node")
    if "depthField" in spec:
        node = struct_of({**{f.name: V(F.col("_node").getField(f.name), f.dataType) for f in foreign.schema.fields}, spec["depthField"]: V(F.col("_depth"), LONG)}).col
    shaped = found.select("_s", "_depth", node.alias("_node"))
    nested = shaped.groupBy("_s").agg(F.transform(F.sort_array(F.collect_list(F.struct("_depth", F.to_json("_node").alias("_j"), "_node"))), lambda x: x.getField("_node")).alias("_found"))
    out = df.withColumn("_start", many(start)).join(nested, F.col("_start") == F.col("_s"), "left")
    empty = T.ArrayType(shaped.schema["_node"].dataType)
    return out.withColumn(spec["as"], F.coalesce(F.col("_found"), F.array().cast(empty))).drop("_start", "_s", "_found")


@stage("$redact")
def redact(df, spec, ctx):
    """Keep, prune or descend at every level of nested documents."""

    def walk(v: V) -> V:
        inner = Scope(v.type, dict(ctx.variables), ctx.now, v)
        verdict = compile_expr(spec, inner)
        fields = {}
        for f in v.type.fields:
            child = V(v.col.getField(f.name), f.dataType)
            if child.is_struct:
                child = walk(child)
            elif child.is_array and isinstance(child.type.elementType, T.StructType):
                element = child.type.elementType
                kind = walk(V(F.lit(None).cast(element), element)).type
                child = V(F.filter(F.transform(child.col, lambda x: walk(V(x, element)).col), lambda x: x.isNotNull()), T.ArrayType(kind))
            fields[f.name] = child
        built = struct_of(fields)
        down = F.when(verdict.col == "$$DESCEND", built.col).when(verdict.col == "$$KEEP", v.col.cast(built.type))
        bad = ~F.coalesce(verdict.col.isin("$$DESCEND", "$$KEEP", "$$PRUNE"), F.lit(False))
        guard = F.when(v.col.isNotNull() & bad, F.raise_error(F.lit("$redact must return $$KEEP, $$PRUNE or $$DESCEND")).cast(built.type))
        return V(F.when(v.col.isNotNull(), F.coalesce(guard, down)), built.type)

    document = ctx.scope(df).document()
    out = walk(document)
    rows = df.select(out.col.alias("_root")).where("_root is not null")
    return rows.select(*[F.col("_root").getField(f.name).alias(f.name) for f in out.type.fields])


#: Rows of a sample that are kept in order by each task and then by one.
TOP_ROWS = 100_000


@stage("$sample")
def sample(df, spec, ctx):
    named(spec, "$sample", ("size",))
    if isinstance(spec["size"], bool) or not isinstance(spec["size"], (int, float)) or spec["size"] < 0:
        raise DocError("size argument to $sample must not be negative", 28747)
    ctx.order = []
    if int(spec["size"]) <= TOP_ROWS:
        return df.orderBy(F.rand()).limit(int(spec["size"]))
    # More rows than one task should hold: the lowest positions of a distributed order.
    drawn = positioned(df.withColumn("_drawn", F.rand()), "_drawn", [])
    return drawn.where(F.col("_position") <= int(spec["size"])).drop("_drawn", "_position", "_total")


#: Grid points that one row of a $densify grid stands for before they are laid out.
GRID_BLOCK = 10_000


@stage("$densify")
def densify(df, spec, ctx):
    """Rows for the grid points of each partition that have none; all rows stay."""
    named(spec, "$densify", ("field", "range"), ("partitionByFields",))
    name, parts = spec["field"], spec.get("partitionByFields", [])
    rng = named(spec["range"], "$densify", ("step",), ("unit", "bounds"))
    step, unit, bounds = rng["step"], rng.get("unit"), rng.get("bounds", "full")
    v = path(ctx.scope(df), name)
    if not isinstance(step, (int, float)) or step <= 0:
        raise DocError("$densify needs a positive step", 5733401)
    if v.is_date != (unit is not None):
        raise DocError("$densify needs a unit for dates and for dates only", 5733402)
    keys = [F.col(name_of(p)) for p in parts]
    held = df.where(v.col.isNotNull())
    if isinstance(bounds, (list, tuple)):
        low, high = (literal(b).cast(NTZ if v.is_date else v.type).col for b in bounds)
        spans = (held.select(*keys).distinct() if keys else df.sparkSession.range(1).select()).select(*keys, low.alias("_lo"), high.alias("_hi"))
        inclusive = False
    else:
        by = keys if bounds == "partition" or keys and bounds != "full" else []
        spans = held.groupBy(*by).agg(F.min(v.col).alias("_lo"), F.max(v.col).alias("_hi"))
        if keys and not by:
            spans = held.select(*keys).distinct().crossJoin(spans)  # one row
        inclusive = True
    low, high = F.col("_lo"), F.col("_hi")
    if v.is_date and unit in UNIT_MONTHS:
        steps = F.ceil(F.floor((F.year(high) - F.year(low)) * 12 + F.month(high) - F.month(low)) / (step * UNIT_MONTHS[unit]))
        point = lambda i: plus(low, unit, (i * step).cast(LONG))
    elif v.is_date:
        size = step * UNIT_MS[unit]
        steps = F.floor((millis(high) - millis(low)) / size)
        point = lambda i: of_millis(millis(low) + (i * size).cast(LONG))
    else:
        steps = F.floor((high - low) / step)
        point = lambda i: (low + i * step).cast(v.type)
    # A long grid is dealt out in blocks; no row holds all of it.
    spans = spans.where("_lo is not null and _lo <= _hi").select(*keys, low, high, steps.cast(LONG).alias("_steps"))
    blocks = spans.select("*", F.explode(F.sequence(F.lit(0).cast(LONG), F.col("_steps"), F.lit(GRID_BLOCK).cast(LONG))).alias("_block")).repartition("_block", *keys)
    within = F.sequence(F.col("_block"), F.least(F.col("_steps"), F.col("_block") + (GRID_BLOCK - 1)))
    grid = blocks.select(*keys, "_hi", F.explode(F.transform(within, point)).alias("_point"))
    grid = grid.where(F.col("_point") <= high if inclusive else F.col("_point") < high).drop("_hi")
    there = held.select(*[k.alias(f"_p{i}") for i, k in enumerate(keys)], v.col.alias("_at")).distinct()
    same = reduce(lambda a, b: a & b, [k.eqNullSafe(F.col(f"_p{i}")) for i, k in enumerate(keys)], F.col("_point") == F.col("_at"))
    new = grid.join(there, same, "left_anti").select(*keys, F.col("_point").cast(v.type).alias(name))
    return df.unionByName(new, allowMissingColumns=True)


def _windows(df: DataFrame, partition: list[Column], sort_by: dict, scope: Scope) -> Windows:
    order = []
    for k, d in (sort_by or {}).items():
        v = path(scope, k)
        order.append((v.col, d, v.type))
    return Windows(partition, order)


def _partition(spec: dict, scope: Scope) -> list[Column]:
    by = spec.get("partitionBy")
    if "partitionByFields" in spec:
        return [path(scope, f).col for f in spec["partitionByFields"]]
    if by is None:
        return []
    if isinstance(by, str):
        return [compile_expr(by, scope).col]
    if any(k.startswith("$") for k in by):
        return [compile_expr(by, scope).col]
    return [compile_expr(e, scope).col for e in by.values()]


@stage("$fill")
def fill(df, spec, ctx):
    named(spec, "$fill", ("output",), ("sortBy", "partitionBy", "partitionByFields"))
    scope = ctx.scope(df)
    w = _windows(df, _partition(spec, scope), spec.get("sortBy"), scope)
    fields = fields_of(df)
    for name, how in spec["output"].items():
        if not isinstance(how, dict) or ("value" in how) == ("method" in how):
            raise DocError("$fill takes either a value or a method for a field", 6050202)
        old = fields.get(name)
        if "value" in how:
            value = compile_expr(how["value"], scope)
            kind = common_type([value.type, old.type if old else NULL])
            new = V(F.coalesce(old.cast(kind).col, value.cast(kind).col) if old else value.col, kind)
        elif how["method"] == "locf":
            new = V(last_known(old.col, w), old.type)
        elif how["method"] == "linear":
            if not w.order:
                raise DocError("linear fill needs a sortBy", 6050204)
            new = V(linear_fill(old.cast(DOUBLE).col, w), DOUBLE)
        else:
            raise DocError(f"unknown fill method: {how['method']}")
        fields = put(fields, name.split("."), new)
    return select(df, fields)


@stage("$setWindowFields")
def set_window_fields(df, spec, ctx):
    """Outputs are computed one after the other: a later one sees earlier ones."""
    named(spec, "$setWindowFields", ("output",), ("partitionBy", "sortBy"))
    for name, how in spec["output"].items():
        scope = ctx.scope(df)
        w = _windows(df, _partition(spec, scope), spec.get("sortBy"), scope)
        ops = [k for k in how if k != "window"]
        if len(ops) != 1:
            raise DocError("a window output has exactly one operator", 5397900)
        v = window_value(ops[0], how[ops[0]], how.get("window"), w, scope)
        df = select(df, put(fields_of(df), name.split("."), v))
    return df


@stage("$geoNear")
def geo_near(df, spec, ctx):
    named(spec, "$geoNear", ("near", "distanceField"), ("spherical", "maxDistance", "minDistance", "query", "distanceMultiplier", "includeLocs", "key", "limit"))
    key, planar = spec.get("key"), False
    indexes = ctx.indexes() if ctx.indexes else []
    for index in indexes:
        for f, kind in index["key"].items():
            if kind in ("2d", "2dsphere") and key in (None, f):
                key, planar = f, kind == "2d" and not spec.get("spherical")
    if key is None:
        from ..errors import IndexNotFound

        raise IndexNotFound("unable to find index for $geoNear query")
    if not indexes and spec.get("spherical") is False:
        planar = True
    px, py = geo.point_of(spec["near"])
    x, y = geo.coordinates(path(ctx.scope(df), key))
    distance = geo.euclidean(x, y, px, py) if planar else geo.haversine(x, y, px, py)
    rows = df.withColumn("_d", distance).where("_d is not null")
    if "query" in spec:
        rows = rows.where(compile_filter(spec["query"], ctx.scope(df)))
    if "minDistance" in spec:
        rows = rows.where(F.col("_d") >= spec["minDistance"])
    if "maxDistance" in spec:
        rows = rows.where(F.col("_d") <= spec["maxDistance"])
    fields = {k: v for k, v in fields_of(rows).items() if k != "_d"}
    fields = put(fields, spec["distanceField"].split("."), V(F.col("_d") * float(spec.get("distanceMultiplier", 1)), DOUBLE))
    if spec.get("includeLocs"):
        fields = put(fields, spec["includeLocs"].split("."), path(ctx.scope(df), key))
    ctx.order = [path(Scope(select(rows, fields).schema), spec["distanceField"]).col]
    return select(rows.orderBy("_d"), fields)


@stage("$documents")
def documents(df, spec, ctx):
    from ..sources.documents import frame_of

    if not isinstance(spec, (list, tuple)) or not all(isinstance(d, dict) for d in spec):
        raise TypeMismatch("$documents takes an array of objects", 40228)
    return frame_of(ctx.spark, spec)


@stage("$unionWith")
def union_with(df, spec, ctx):
    if not isinstance(spec, dict):
        raise TypeMismatch("$unionWith takes an object with 'coll'", 9)
    named(spec, "$unionWith", ("coll",), ("pipeline",))
    other = run_pipeline(ctx.collection(spec["coll"]), spec.get("pipeline", []), _copy(ctx))
    shared = [c for c in df.columns if c in other.columns]
    for c in shared:
        kind = common_type([df.schema[c].dataType, other.schema[c].dataType])
        df = df.withColumn(c, F.col(name_of(c)).cast(kind))
        other = other.withColumn(c, F.col(name_of(c)).cast(kind))
    ctx.order = []
    return df.unionByName(other, allowMissingColumns=True)


@stage("$out")
def out(df, spec, ctx):
    if ctx.write is None:
        raise DocError("$out needs a database to write to")
    ctx.write(spec, df)
    return df.limit(0)


@stage("$merge")
def merge(df, spec, ctx):
    if ctx.merge is None:
        raise DocError("$merge needs a database to write to")
    ctx.merge({"into": spec} if isinstance(spec, str) else spec, df)
    return df.limit(0)
