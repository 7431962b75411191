"""Engine, databases and collections: the API that users see."""

from __future__ import annotations

import datetime as dt
import os
import re
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .errors import (
    BadHint, BulkWriteError, CannotCreateIndex, DocError, DuplicateKey, IllegalOperation, IndexNotFound, InvalidOptions, NamespaceExists,
    NamespaceNotFound,
)
from .functions.core import LONG, Scope, V, compile_expr, literal, missing, name_of, path, struct_of
from .operators import geo, text
from .operators.match import compile_filter
from .operators.projection import fields_of, find_projection, put, select
from .operators.stages import Context, run_pipeline, sort_keys
from .operators.update import Updater, check_replacement, check_update, upsert_seed
from .sources.catalog import ID_INDEX, Catalog, atomic, check_name
from .sources.documents import document_of, frame_of
from .sources.json_files import read_json

ORDINAL = "_ord"
_SCORE = "_text_score"
_DISTANCE = "_near_distance"


def object_id() -> str:
    """Twelve bytes: four of time, eight at random, as 24 hex digits."""
    return int(dt.datetime.now(dt.timezone.utc).timestamp()).to_bytes(4, "big").hex() + os.urandom(8).hex()


class Engine:
    """A Spark session with a root folder for databases."""

    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark = spark
        self.root = root or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/docpipe"
        self._databases: dict[str, Database] = {}

    def connect(self) -> Engine:
        Catalog(self.spark, self.root, "").files.make(self.root)
        return self

    def close(self) -> None:
        self._databases.clear()

    def db(self, name: str) -> Database:
        if name not in self._databases:
            self._databases[name] = Database(self, name)
        return self._databases[name]

    def from_parquet(self, folder: str, name: str = "tables") -> Database:
        """A read-only database of the Parquet tables in a folder."""
        return Database(self, name, tables=folder)

    def from_frames(self, frames: dict[str, DataFrame], indexes: dict[str, list[dict]] | None = None, name: str = "frames") -> Database:
        """A read-only database of frames, with index metadata for text and geo queries."""
        return Database(self, name, tables="frames", frames=frames, given_indexes=indexes or {})

    def from_json(self, folder: str, name: str = "documents", lines: bool = True) -> Database:
        """A read-only database of the JSON files ``<collection>.json`` in a folder."""
        return Database(self, name, tables=folder, json_lines=lines)

    def __getitem__(self, name: str) -> Database:
        return self.db(name)


class Database:
    def __init__(
        self,
        engine: Engine,
        name: str,
        tables: str | None = None,
        json_lines: bool | None = None,
        frames: dict[str, DataFrame] | None = None,
        given_indexes: dict[str, list[dict]] | None = None,
    ):
        self.engine, self.name, self.tables, self.json_lines = engine, name, tables, json_lines
        self.frames, self.given_indexes = frames, given_indexes or {}
        self.spark = engine.spark
        self.catalog = Catalog(engine.spark, engine.root, name)
        self._collections: dict[str, Collection] = {}

    def collection(self, name: str) -> Collection:
        if name not in self._collections:
            self._collections[name] = Collection(self, name)
        return self._collections[name]

    def __getitem__(self, name: str) -> Collection:
        return self.collection(name)

    def __getattr__(self, name: str) -> Collection:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.collection(name)

    def aggregate(self, pipeline: list[dict]) -> Cursor:
        """A pipeline without a collection; it begins with $documents."""
        empty = self.spark.createDataFrame([], T.StructType([]))
        return Cursor(run_pipeline(empty, pipeline, self.context()))

    def context(self) -> Context:
        return Context(self.spark, lambda n: self.collection(n).frame(), write=self._out, merge=self._merge)

    def _out(self, name: str, df: DataFrame) -> None:
        self.collection(name)._commit(_with_ids(df))

    def _merge(self, spec: dict, df: DataFrame) -> None:
        self.collection(_own(spec["into"]))._merge_rows(spec, df)

    def list_collections(self, filter: dict | None = None, name_only: bool = False) -> list[dict]:
        names = self.catalog.names()
        wanted = (filter or {}).get("name")
        if isinstance(wanted, re.Pattern):
            names = [n for n in names if wanted.search(n)]
        elif wanted is not None:
            names = [n for n in names if n == wanted]
        base = [{"name": n, "type": "collection"} for n in names]
        return base if name_only else [{**b, "options": {}, "info": {"readOnly": False}, "idIndex": dict(ID_INDEX)} for b in base]

    def stats(self) -> dict:
        each = [self.collection(n).stats() for n in self.catalog.names()]
        total = lambda k: sum(s[k] for s in each)
        objects = total("count")
        return {
            "db": self.name, "collections": len(each), "views": 0, "objects": objects, "avgObjSize": total("size") / objects if objects else 0,
            "dataSize": total("size"), "storageSize": total("storageSize"), "indexes": total("nindexes"), "indexSize": 0, "totalSize": total("storageSize"), "ok": 1,
        }

    def drop_database(self) -> bool:
        self._collections.clear()
        self.catalog.files.remove(self.catalog.path)
        return True


def _own(into: Any) -> str:
    if isinstance(into, dict):
        if "db" in into:
            raise DocError("$merge into another database is not supported")
        return into["coll"]
    return into


def _with_ids(df: DataFrame) -> DataFrame:
    if "_id" in df.columns:
        return df
    return df.select(F.substring(F.sha2(F.concat_ws("-", F.uuid(), F.uuid()), 256), 1, 24).alias("_id"), "*")


class Cursor:
    """A lazy result: a frame, and on request its rows as documents."""

    def __init__(self, df: DataFrame):
        self.df = df

    def to_df(self) -> DataFrame:
        return self.df

    def to_list(self) -> list[dict]:
        return [document_of(r) for r in self.df.collect()]

    def __iter__(self):
        return (document_of(r) for r in self.df.toLocalIterator())


class FindCursor(Cursor):
    """Modifiers apply in the order sort, skip, limit, projection, however called."""

    def __init__(self, collection: Collection, filter: dict, projection: dict | None):
        self.collection, self.filter, self.projection = collection, filter, projection
        self._sort: dict | None = None
        self._skip = self._limit = 0
        self._hint: Any = None

    def sort(self, spec: dict) -> FindCursor:
        self._sort = spec
        return self

    def skip(self, n: int) -> FindCursor:
        if n < 0:
            raise DocError("skip must be non-negative")
        self._skip = n
        return self

    def limit(self, n: int) -> FindCursor:
        self._limit = abs(n)
        return self

    def hint(self, index: Any) -> FindCursor:
        self._hint = index
        return self

    @property
    def df(self) -> DataFrame:  # type: ignore[override]
        if self._hint is not None:
            self.collection._check_hint(self._hint)
        df = self.collection._filtered(self.filter)
        scope = Scope(df.schema)
        if self._sort:
            if any(isinstance(v, dict) for v in self._sort.values()):
                df = df.orderBy(F.desc(_SCORE))
            else:
                df = df.orderBy(*sort_keys(df, self._sort, scope))
        elif _DISTANCE in df.columns:
            df = df.orderBy(_DISTANCE)
        elif ORDINAL in df.columns:
            back = isinstance(self._hint, dict) and self._hint.get("$natural") == -1
            if back or self._skip or self._limit:
                df = df.orderBy(F.desc(ORDINAL) if back else F.asc(ORDINAL))
        if self._skip:
            df = df.offset(self._skip)
        if self._limit:
            df = df.limit(self._limit)
        if self.projection:
            hidden = [c for c in (ORDINAL, _DISTANCE) if c in df.columns]
            df = find_projection(df.drop(*hidden), self.projection, Scope(df.drop(*hidden).schema), _SCORE if _SCORE in df.columns else None)
        return df.drop(ORDINAL, _DISTANCE, *([_SCORE] if not self._shows_score() else []))

    def _shows_score(self) -> bool:
        return False

    def to_df(self) -> DataFrame:
        return self.df


def _split_near(filter: dict) -> tuple[dict, tuple[str, dict] | None]:
    rest, near = {}, None
    for k, v in filter.items():
        if isinstance(v, dict) and ("$near" in v or "$nearSphere" in v):
            near = (k, v)
            other = {op: x for op, x in v.items() if op not in ("$near", "$nearSphere", "$maxDistance", "$minDistance")}
            if other:
                rest[k] = other
        else:
            rest[k] = v
    return rest, near


class Collection:
    """Reads give lazy frames; writes give a new snapshot."""

    def __init__(self, db: Database, name: str):
        check_name(name)
        self.db, self.name, self.spark = db, name, db.spark

    # --- reading ---

    def _raw(self) -> DataFrame:
        if self.db.frames is not None:
            return self.db.frames[self.name]
        if self.db.tables and self.db.json_lines is not None:
            return read_json(self.spark, f"{self.db.tables}/{self.name}.json", lines=self.db.json_lines)
        if self.db.tables:
            return self.spark.read.parquet(f"{self.db.tables}/{self.name}.parquet")
        df = self.db.catalog.read(self.name)
        return df if df is not None else self.spark.createDataFrame([], "_id string")

    def frame(self) -> DataFrame:
        """All documents."""
        return self._raw().drop(ORDINAL)

    def indexes(self) -> list[dict]:
        given = self.db.given_indexes.get(self.name, [])
        return [dict(ID_INDEX), *given] if self.db.tables else self.db.catalog.state(self.name).indexes

    list_indexes = indexes

    def _usable_indexes(self) -> list[dict]:
        """Hidden indexes serve neither hints nor look-ups."""
        return [i for i in self.indexes() if not i.get("hidden")]

    def _text_fields(self) -> list[str] | None:
        for index in self._usable_indexes():
            fields = [f for f, kind in index["key"].items() if kind == "text"]
            if fields:
                return fields
        return None

    def _filtered(self, filter: dict) -> DataFrame:
        df = self._raw()
        rest, near = _split_near(filter)
        scope = Scope(df.schema)
        if "$text" in rest:
            spec = rest["$text"]
            rest = {k: v for k, v in rest.items() if k != "$text"}
            df = df.withColumn(_SCORE, text.score(self._text_fields(), spec, scope)).where(F.col(_SCORE) > 0)
        if near:
            df = self._near(df, near, scope)
        return df.where(compile_filter(rest, scope)) if rest else df

    def _near(self, df: DataFrame, near: tuple[str, dict], scope: Scope) -> DataFrame:
        name, spec = near
        kinds = [i["key"][name] for i in self._usable_indexes() if i["key"].get(name) in ("2d", "2dsphere")]
        if not kinds:
            raise IndexNotFound("unable to find index for $geoNear query")
        op = "$nearSphere" if "$nearSphere" in spec else "$near"
        where = spec[op]
        px, py = geo.point_of(where)
        limits = {k: (where if isinstance(where, dict) and k in where else spec).get(k) for k in ("$maxDistance", "$minDistance")}
        x, y = geo.coordinates(path(scope, name))
        spherical = kinds[0] == "2dsphere" or op == "$nearSphere"
        distance = geo.haversine(x, y, px, py) if spherical else geo.euclidean(x, y, px, py)
        out = df.withColumn(_DISTANCE, distance).where(F.col(_DISTANCE).isNotNull())
        if limits["$maxDistance"] is not None:
            out = out.where(F.col(_DISTANCE) <= limits["$maxDistance"])
        if limits["$minDistance"] is not None:
            out = out.where(F.col(_DISTANCE) >= limits["$minDistance"])
        return out

    def _check_hint(self, hint: Any) -> None:
        if isinstance(hint, dict) and "$natural" in hint:
            return
        if not any(i["name"] == hint or i["key"] == hint for i in self._usable_indexes()):
            raise BadHint("error processing query: hint provided does not correspond to an existing index")

    def find(self, filter: dict | None = None, projection: dict | None = None) -> FindCursor:
        return FindCursor(self, filter or {}, projection)

    def find_one(self, filter: dict | None = None, projection: dict | None = None, sort: dict | None = None, skip: int = 0) -> dict | None:
        cursor = self.find(filter, projection).skip(skip).limit(1)
        rows = (cursor.sort(sort) if sort else cursor).to_list()
        return rows[0] if rows else None

    def aggregate(self, pipeline: list[dict]) -> Cursor:
        ctx = self.db.context()
        ctx.indexes = self._usable_indexes
        return Cursor(run_pipeline(self.frame(), pipeline, ctx))

    def count_documents(self, filter: dict | None = None) -> int:
        return self._filtered(filter or {}).count()

    def estimated_document_count(self) -> int:
        return self._raw().count()

    def distinct(self, field: str, filter: dict | None = None) -> list:
        return [document_of(r[0]) for r in self.distinct_df(field, filter).collect()]

    def distinct_df(self, field: str, filter: dict | None = None) -> DataFrame:
        """Values of a field, arrays taken apart one level; nulls count as a value."""
        df = self._filtered(filter or {})
        v = path(Scope(df.schema), field)
        if v.missing:
            return df.limit(0).select(F.lit(None).alias("value"))
        return df.select((F.explode(v.col) if v.is_array else v.col).alias("value")).distinct()

    def stats(self) -> dict:
        df = self._raw()
        size = self.db.catalog.files.size(self.db.catalog.folder(self.name))
        n = df.count()
        indexes = self.indexes()
        return {
            "ns": f"{self.db.name}.{self.name}", "count": n, "size": size, "avgObjSize": size / n if n else 0, "storageSize": size,
            "totalIndexSize": 0, "indexSizes": {i["name"]: 0 for i in indexes}, "nindexes": len(indexes), "ok": 1,
        }

    # --- writing ---

    def _writable(self) -> None:
        if self.db.tables:
            raise IllegalOperation("the database is read-only")

    @atomic
    def _commit(self, df: DataFrame) -> None:
        self._writable()
        if ORDINAL not in df.columns:
            df = df.withColumn(ORDINAL, F.monotonically_increasing_id())
        self._check_unique(df)
        self.db.catalog.commit(self.name, df)

    def _check_unique(self, df: DataFrame) -> None:
        for index in [{"key": {"_id": 1}, "name": "_id_"}] + [i for i in self.indexes() if i.get("unique")]:
            scope = Scope(df.schema)
            values = [path(scope, f) for f in index["key"]]
            if any(v.missing for v in values) and index.get("sparse"):
                continue
            rows = df
            if index.get("sparse"):
                rows = rows.where(reduce(lambda a, b: a | b, [v.col.isNotNull() for v in values]))
            if index.get("partialFilterExpression"):
                rows = rows.where(compile_filter(index["partialFilterExpression"], scope))
            keys = [v.col.cast("string").alias(f"k{i}") if v.missing else v.col.alias(f"k{i}") for i, v in enumerate(values)]
            twice = rows.groupBy(*keys).count().where("count > 1").limit(1).collect()
            if twice:
                shown = ", ".join(f"{f}: {document_of(twice[0][i])!r}" for i, f in enumerate(index["key"]))
                raise DuplicateKey(f"E11000 duplicate key error collection: {self.db.name}.{self.name} index: {index['name']} dup key: {{ {shown} }}")

    def _aligned(self, old: DataFrame, new: DataFrame) -> DataFrame:
        """Both frames under one schema."""
        from .sources.documents import _common

        kinds = {}
        for df in (old, new):
            for f in df.schema.fields:
                kinds[f.name] = _common([kinds[f.name], f.dataType]) if f.name in kinds else f.dataType
        return _fitted(old, kinds).unionByName(_fitted(new, kinds))

    def insert_one(self, doc: dict) -> dict:
        ids = self.insert_many([doc])["inserted_ids"]
        return {"acknowledged": True, "inserted_id": ids[0]}

    def insert_many(self, docs: list[dict]) -> dict:
        if not docs:
            raise DocError("documents must be a non-empty list")
        docs = [d if "_id" in d else {"_id": object_id(), **d} for d in docs]
        self.insert_frame(frame_of(self.spark, docs))
        return {"acknowledged": True, "inserted_count": len(docs), "inserted_ids": [d["_id"] for d in docs]}

    @atomic
    def insert_frame(self, df: DataFrame) -> None:
        """Append the rows of a frame, whatever their number."""
        self._writable()
        df = _with_ids(df)
        existing = self.db.catalog.read(self.name)
        if existing is None:
            self._commit(df)
            return
        top = existing.agg(F.max(ORDINAL)).first()[0]
        new = df.withColumn(ORDINAL, F.monotonically_increasing_id() + (0 if top is None else top + 1))
        self._commit(self._aligned(existing, new))

    def _target(self, filter: dict, one: bool, sort: dict | None = None) -> tuple[DataFrame, Column]:
        """The rows, and which of them the filter selects (the first if ``one``)."""
        df = self._raw()
        if ORDINAL not in df.columns:
            df = df.withColumn(ORDINAL, F.monotonically_increasing_id())
        hit = compile_filter(filter, Scope(df.drop(ORDINAL).schema))
        if not one:
            return df, hit
        rows = df.where(hit)
        rows = rows.orderBy(*sort_keys(df, sort, Scope(df.schema)), ORDINAL) if sort else rows.orderBy(ORDINAL)
        first = rows.select(ORDINAL).limit(1).collect()
        return df, F.col(ORDINAL) == (first[0][0] if first else -1)

    @atomic
    def _update(self, filter: dict, update: dict, one: bool, upsert: bool, array_filters: list[dict] | None, sort: dict | None = None) -> dict:
        self._writable()
        check_update(update)
        df, hit = self._target(filter, one, sort)
        scope = Scope(df.drop(ORDINAL).schema)
        matched = df.where(hit).count()
        result = {"acknowledged": True, "matched_count": matched, "modified_count": 0, "upserted_id": None, "upserted_count": 0}
        if not matched:
            if upsert:
                seed = frame_of(self.spark, [upsert_seed(filter) or {"_": None}])
                updater = Updater(Scope(seed.schema), filter, array_filters)
                fields = {k: v for k, v in fields_of(seed).items() if k != "_"}
                merged = {**update, "$set": {**update.get("$set", {}), **update.get("$setOnInsert", {})}}
                merged.pop("$setOnInsert", None)
                fields = updater.apply(fields, {k: v for k, v in merged.items() if v})
                new_id = None
                if "_id" not in fields:
                    new_id = object_id()
                    fields = {"_id": literal(new_id), **fields}
                row = select(seed, fields)
                result["upserted_id"] = new_id or row.first()["_id"]
                result["upserted_count"] = 1
                self.insert_frame(row)
            return result
        body = {k: v for k, v in update.items() if k != "$setOnInsert"}
        if not body:
            return result
        changed = Updater(scope, filter, array_filters).apply(fields_of(df.drop(ORDINAL)), body)
        new, same = _replaced(df, hit, changed)
        result["modified_count"] = df.where(hit & ~same).count()
        if result["modified_count"]:
            self._commit(new)
        return result

    def updated_df(self, filter: dict, update: dict, array_filters: list[dict] | None = None) -> DataFrame:
        """All documents as an update of many would leave them; nothing is written."""
        check_update(update)
        df = self._raw()
        df = df if ORDINAL in df.columns else df.withColumn(ORDINAL, F.lit(0).cast(LONG))
        scope = Scope(df.drop(ORDINAL).schema)
        hit = compile_filter(filter, scope)
        body = {k: v for k, v in update.items() if k != "$setOnInsert"}
        changed = Updater(scope, filter, array_filters).apply(fields_of(df.drop(ORDINAL)), body)
        return _replaced(df, hit, changed)[0].drop(ORDINAL)

    def update_one(self, filter: dict, update: dict, upsert: bool = False, array_filters: list[dict] | None = None) -> dict:
        return self._update(filter, update, True, upsert, array_filters)

    def update_many(self, filter: dict, update: dict, upsert: bool = False, array_filters: list[dict] | None = None) -> dict:
        return self._update(filter, update, False, upsert, array_filters)

    def _rewrite(self, df: DataFrame, ordinal: int, doc: dict) -> None:
        old = df.where(F.col(ORDINAL) == ordinal).select("_id").first()[0]
        new = frame_of(self.spark, [{"_id": old, **{k: v for k, v in doc.items() if k != "_id"}}]).withColumn(ORDINAL, F.lit(ordinal).cast(LONG))
        self._commit(self._aligned(df.where(F.col(ORDINAL) != ordinal), new))

    @atomic
    def replace_one(self, filter: dict, doc: dict, upsert: bool = False) -> dict:
        self._writable()
        check_replacement(doc)
        df, hit = self._target(filter, True)
        found = df.where(hit).select(ORDINAL).collect()
        result = {"acknowledged": True, "matched_count": len(found), "modified_count": len(found), "upserted_id": None, "upserted_count": 0}
        if found:
            self._rewrite(df, found[0][0], doc)
        elif upsert:
            seed = upsert_seed(filter)
            new = {"_id": doc.get("_id", seed.get("_id") or object_id()), **doc}
            self.insert_many([new])
            result |= {"upserted_id": new["_id"], "upserted_count": 1}
        return result

    @atomic
    def _delete(self, filter: dict, one: bool) -> dict:
        self._writable()
        df, hit = self._target(filter, one)
        n = df.where(hit).count()
        if n:
            self._commit(df.where(~F.coalesce(hit, F.lit(False))))
        return {"acknowledged": True, "deleted_count": n}

    def delete_one(self, filter: dict) -> dict:
        return self._delete(filter, True)

    def delete_many(self, filter: dict) -> dict:
        return self._delete(filter, False)

    def _one(self, filter: dict, sort: dict | None) -> tuple[DataFrame, int | None]:
        df, hit = self._target(filter, True, sort)
        found = df.where(hit).select(ORDINAL).collect()
        return df, found[0][0] if found else None

    def _shown(self, df: DataFrame, ordinal: int, projection: dict | None) -> dict:
        row = df.where(F.col(ORDINAL) == ordinal).drop(ORDINAL)
        row = find_projection(row, projection, Scope(row.schema)) if projection else row
        return document_of(row.first())

    @atomic
    def find_one_and_delete(self, filter: dict, sort: dict | None = None, projection: dict | None = None) -> dict | None:
        df, at = self._one(filter, sort)
        if at is None:
            return None
        out = self._shown(df, at, projection)
        self._commit(df.where(F.col(ORDINAL) != at))
        return out

    @atomic
    def find_one_and_replace(self, filter: dict, doc: dict, sort=None, projection=None, return_document: str = "before", upsert: bool = False) -> dict | None:
        check_replacement(doc)
        df, at = self._one(filter, sort)
        if at is None:
            if not upsert:
                return None
            new = self.replace_one(filter, doc, upsert=True)["upserted_id"]
            return self.find_one({"_id": new}, projection) if return_document == "after" else None
        before = self._shown(df, at, projection)
        self._rewrite(df, at, doc)
        return before if return_document == "before" else self._shown(self._raw(), at, projection)

    @atomic
    def find_one_and_update(self, filter: dict, update: dict, sort=None, projection=None, return_document: str = "before", upsert: bool = False) -> dict | None:
        df, at = self._one(filter, sort)
        before = self._shown(df, at, projection) if at is not None else None
        result = self._update(filter, update, True, upsert, None, sort)
        if at is None:
            return self.find_one({"_id": result["upserted_id"]}, projection) if upsert and return_document == "after" else None
        return before if return_document == "before" else self._shown(self._raw(), at, projection)

    @atomic
    def bulk_write(self, ops: list[dict], ordered: bool = True) -> dict:
        """Operations one after the other; unordered ones go on after errors."""
        total = {"inserted_count": 0, "matched_count": 0, "modified_count": 0, "deleted_count": 0, "upserted_count": 0, "upserted_ids": {}}
        errors = []
        for i, op in enumerate(ops):
            kind, spec = next(iter(op.items()))
            try:
                if kind == "insertOne":
                    self.insert_one(spec["document"])
                    r = {"inserted_count": 1}
                elif kind in ("updateOne", "updateMany"):
                    r = self._update(spec["filter"], spec["update"], kind == "updateOne", spec.get("upsert", False), spec.get("arrayFilters"))
                elif kind == "replaceOne":
                    r = self.replace_one(spec["filter"], spec["replacement"], spec.get("upsert", False))
                elif kind in ("deleteOne", "deleteMany"):
                    r = self._delete(spec["filter"], kind == "deleteOne")
                else:
                    raise DocError(f"unknown bulk operation: {kind}")
            except DocError as error:
                if ordered:
                    raise
                errors.append({"index": i, "code": error.code, "errmsg": str(error)})
                continue
            for k in total:
                total[k] = total[k] + r.get(k, 0) if k != "upserted_ids" else total[k]
            if r.get("upserted_id") is not None:
                total["upserted_ids"][i] = r["upserted_id"]
        if errors:
            raise BulkWriteError(errors, total)
        return total

    @atomic
    def _merge_rows(self, spec: dict, df: DataFrame) -> None:
        """Upsert all rows by one full outer join on the ``on`` fields.

        In the mode merge every field that the new rows have replaces the old one,
        by null as well.  Of several new rows with one key the last counts.
        """
        on = spec.get("on", "_id")
        on = [on] if isinstance(on, str) else list(on)
        matched, unmatched = spec.get("whenMatched", "merge"), spec.get("whenNotMatched", "insert")
        if unmatched not in ("insert", "discard", "fail") or not isinstance(matched, list) and matched not in ("replace", "keepExisting", "merge", "fail"):
            raise DocError("unknown $merge mode")
        df = _with_ids(df)
        old = self.db.catalog.read(self.name)
        if old is None:
            old = frame_of(self.spark, [], T.StructType([*df.schema.fields, T.StructField(ORDINAL, LONG)]))
        top = old.agg(F.max(ORDINAL)).first()[0]
        a = old.select(F.struct(*[F.col(name_of(c)) for c in old.columns if c != ORDINAL]).alias("a"), F.col(ORDINAL).alias("o"), *[F.col(name_of(k)).alias(f"ka{i}") for i, k in enumerate(on)])
        keys = [f"kb{i}" for i in range(len(on))]
        b = df.select(F.struct(*[F.col(name_of(c)) for c in df.columns]).alias("b"), *[F.col(name_of(k)).alias(n) for k, n in zip(on, keys)])
        # Rows that share a key come one after the other: the last one wins, with keepExisting the first.
        pick = F.min_by if matched == "keepExisting" else F.max_by
        b = b.withColumn("i", F.monotonically_increasing_id()).groupBy(*keys).agg(pick("b", "i").alias("b"))
        same = reduce(lambda x, y: x & y, [F.col(f"ka{i}").eqNullSafe(F.col(f"kb{i}")) for i in range(len(on))])
        how = {"insert": "full", "discard": "left", "fail": "full"}[unmatched]
        joined = a.join(b, same, how)
        both = F.col("a").isNotNull() & F.col("b").isNotNull()
        if matched == "fail":
            joined = joined.where(F.when(both, F.raise_error(F.lit("$merge found a matching document")).cast("boolean")).otherwise(True))
        if unmatched == "fail":
            joined = joined.where(F.when(F.col("a").isNull(), F.raise_error(F.lit("$merge could not find a matching document")).cast("boolean")).otherwise(True))
        va, vb = V(F.col("a"), a.schema["a"].dataType), V(F.col("b"), b.schema["b"].dataType)
        if isinstance(matched, list):
            merged = self._pipeline_value(joined, matched, va, vb)
        else:
            merged = {"keepExisting": va, "fail": va, "replace": vb}.get(matched)
        fields: dict[str, V] = {}
        names = list(dict.fromkeys([*va.type.names, *vb.type.names, *(merged.type.names if merged else [])]))
        from .functions.core import common_type, get_field

        for n in names:
            x, y = get_field(va, n), get_field(vb, n)
            z = get_field(merged, n) if merged else (y if not y.missing else x)
            kind = common_type([v.type for v in (x, y, z) if not v.missing])
            part = lambda v: v.cast(kind).col if not v.missing else F.lit(None).cast(kind)
            fields[n] = V(F.when(both, part(z)).when(F.col("b").isNull(), part(x)).otherwise(part(y)), kind)
        order = F.coalesce(F.col("o"), F.monotonically_increasing_id() + (0 if top is None else top + 1))
        self._commit(joined.select(*[v.col.alias(k) for k, v in fields.items()], order.alias(ORDINAL)))

    def _pipeline_value(self, joined: DataFrame, pipeline: list[dict], old: V, new: V) -> V:
        """The document that update stages make of a matched one, with $$new."""
        doc = old
        for s in pipeline:
            name, spec = next(iter(s.items()))
            scope = Scope(doc.type, {"new": new}, root=doc)
            if name in ("$addFields", "$set"):
                fields = {f.name: V(doc.col.getField(f.name), f.dataType) for f in doc.type.fields}
                for k, e in spec.items():
                    fields = put(fields, k.split("."), compile_expr(e, scope))
                doc = struct_of(fields)
            elif name in ("$replaceWith", "$replaceRoot"):
                doc = compile_expr(spec if name == "$replaceWith" else spec["newRoot"], scope)
            elif name == "$unset":
                gone = [spec] if isinstance(spec, str) else spec
                doc = struct_of({f.name: V(doc.col.getField(f.name), f.dataType) for f in doc.type.fields if f.name not in gone})
            else:
                raise DocError(f"{name} is not allowed in a whenMatched pipeline")
        return doc

    # --- administration ---

    @atomic
    def drop(self) -> bool:
        self._writable()
        return self.db.catalog.drop(self.name)

    def rename(self, new: str, drop_target: bool = False) -> None:
        self._writable()
        check_name(new)
        if not self.db.catalog.exists(self.name):
            raise NamespaceNotFound(f"Source collection {self.db.name}.{self.name} does not exist")
        if new == self.name:
            raise IllegalOperation("Can't rename a collection to itself")
        if self.db.catalog.exists(new):
            if not drop_target:
                raise NamespaceExists("target namespace exists")
            self.db.catalog.drop(new)
        self.db.catalog.files.rename(self.db.catalog.folder(self.name), self.db.catalog.folder(new))
        self.name = new

    @atomic
    def create_index(self, keys: dict | str, **options: Any) -> str:
        """Checked and kept as metadata; statistics of Parquet files do the skipping."""
        self._writable()
        keys = {keys: 1} if isinstance(keys, str) else dict(keys)
        check_index(keys, options)
        state = self.db.catalog.state(self.name)
        for index in state.indexes:
            if index["key"] == keys:
                return index["name"]
        name = options.pop("name", None) or "_".join(f"{k}_{d}" for k, d in keys.items())
        if any(i["name"] == name for i in state.indexes):
            raise CannotCreateIndex(f"an index named {name} exists with other keys", 86, "IndexKeySpecsConflict")
        for f, kind in keys.items():
            if kind in ("2d", "2dsphere") and any(i["key"].get(f) in ("2d", "2dsphere") for i in state.indexes):
                raise CannotCreateIndex(f"the field {f} has a geo index already")
        state.indexes.append({"v": 2, "key": keys, "name": name, **options})
        self.db.catalog.save(self.name, state)
        return name

    def create_indexes(self, specs: list[dict]) -> list[str]:
        return [self.create_index(s["key"], **{k: v for k, v in s.items() if k != "key"}) for s in specs]

    @atomic
    def drop_index(self, index: Any) -> None:
        self._writable()
        state = self.db.catalog.state(self.name)
        found = [i for i in state.indexes if i["name"] == index or i["key"] == index]
        if not found:
            raise IndexNotFound(f"index not found with name [{index}]")
        if found[0]["name"] == "_id_":
            raise InvalidOptions("cannot drop _id index")
        state.indexes.remove(found[0])
        self.db.catalog.save(self.name, state)

    def drop_indexes(self, names: Any = "*") -> None:
        if names == "*":
            names = [i["name"] for i in self.indexes() if i["name"] != "_id_"]
        for n in [names] if isinstance(names, str) else names:
            self.drop_index(n)


#: Kinds of index keys besides directions.
INDEX_KINDS = ("text", "2d", "2dsphere", "hashed")


def check_index(keys: dict, options: dict) -> None:
    """The rules on which kinds and options go together."""
    if not keys:
        raise CannotCreateIndex("an index needs at least one field")
    kinds = [k for k in keys.values() if k in INDEX_KINDS]
    for f, kind in keys.items():
        if kind not in (1, -1) and kind not in INDEX_KINDS:
            raise CannotCreateIndex(f"unknown index type '{kind}' of field {f}")
        if f.startswith("$") and f != "$**":
            raise CannotCreateIndex(f"index keys can't begin with $: {f}")
    wildcard = any("$**" in f for f in keys)
    if "expireAfterSeconds" in options:
        if len(keys) > 1 or "_id" in keys or kinds or wildcard:
            raise CannotCreateIndex("TTL indexes are single-field indexes, not on _id")
        if isinstance(options["expireAfterSeconds"], bool) or not isinstance(options["expireAfterSeconds"], (int, float)) or options["expireAfterSeconds"] < 0:
            raise CannotCreateIndex("expireAfterSeconds must be a non-negative number")
        if options["expireAfterSeconds"] > 2_147_483_647:
            raise CannotCreateIndex("expireAfterSeconds must be at most 2147483647")
    if "hidden" in options and not isinstance(options["hidden"], bool):
        raise TypeMismatch("hidden must be a boolean")
    weights = options.get("weights", {})
    if not isinstance(weights, dict):
        raise TypeMismatch("weights must be an object")
    if any(isinstance(w, bool) or not isinstance(w, (int, float)) or not 1 <= w <= 99_999 for w in weights.values()):
        raise CannotCreateIndex("a weight is a number from 1 to 99999")
    if "collation" in options and not (isinstance(options["collation"], dict) and isinstance(options["collation"].get("locale"), str) and options["collation"]["locale"]):
        raise CannotCreateIndex("a collation needs a locale")
    if "hashed" in kinds:
        if options.get("unique"):
            raise CannotCreateIndex("hashed indexes can't be unique")
        if kinds.count("hashed") > 1:
            raise CannotCreateIndex("an index has one hashed field at most")
    if wildcard and (options.get("unique") or len(keys) > 1):
        raise CannotCreateIndex("wildcard indexes can't be unique or compound")
    if "text" in kinds and options.get("unique"):
        raise CannotCreateIndex("text indexes can't be unique")
    if options.get("sparse") and options.get("partialFilterExpression"):
        raise CannotCreateIndex("an index is either sparse or partial")
    if options.get("hidden") and list(keys) == ["_id"]:
        raise CannotCreateIndex("can't hide the _id index")


def _fitted(df: DataFrame, kinds: dict[str, T.DataType]) -> DataFrame:
    return df.select(*[
        (fit(F.col(name_of(n)), df.schema[n].dataType, t) if n in df.columns else F.lit(None).cast(t)).alias(n) for n, t in kinds.items()
    ])


def fit(col: Column, old: T.DataType, new: T.DataType) -> Column:
    """A column under a wider type; objects get the fields they lack as nulls."""
    if old == new:
        return col
    if isinstance(old, T.StructType) and isinstance(new, T.StructType):
        parts = [(fit(col.getField(f.name), old[f.name].dataType, f.dataType) if f.name in old.names else F.lit(None).cast(f.dataType)).alias(f.name) for f in new.fields]
        return F.when(col.isNotNull(), F.struct(*parts))
    if isinstance(old, T.ArrayType) and isinstance(new, T.ArrayType):
        return F.transform(col, lambda x: fit(x, old.elementType, new.elementType))
    return col.cast(new)


def _replaced(df: DataFrame, hit: Column, changed: dict[str, V]) -> tuple[DataFrame, Column]:
    """The rows with the selected ones changed, and whether a row stays the same."""
    from .sources.documents import _common

    fields, same = {}, F.lit(True)
    names = list(dict.fromkeys([c for c in df.columns if c != ORDINAL] + list(changed)))
    for n in names:
        old = V(F.col(name_of(n)), df.schema[n].dataType) if n in df.columns else missing()
        new = changed.get(n, missing())
        kind = _common([old.type, new.type])
        a = fit(old.col, old.type, kind) if not old.missing else F.lit(None).cast(kind)
        b = fit(new.col, new.type, kind) if not new.missing else F.lit(None).cast(kind)
        fields[n] = F.when(hit, b).otherwise(a).alias(n)
        same = same & (a.eqNullSafe(b) if not isinstance(kind, T.MapType) else F.lit(False))
    return df.select(*fields.values(), F.col(ORDINAL)), same


__all__ = ["Collection", "Cursor", "Database", "Engine", "FindCursor"]
