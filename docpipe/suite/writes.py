"""Queries of the write API, the catalog, indexes, errors and rarer operators.

Each writes whole tables into a collection of its own in the shared folder, and
reads them back; the SQL says what must be there afterwards.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import DocError
from ..session import Database, Engine
from ..sources.json_files import write_json
from ..sources.scratch import scratch_path

Entry = tuple[Callable[[SparkSession, str], DataFrame], str]
WRITES: dict[str, Entry] = {}


def query(name: str, sql: str):
    def put(fn: Callable[[SparkSession, str], DataFrame]):
        WRITES[name] = (fn, sql)
        return fn

    return put


def _store(spark: SparkSession) -> Database:
    return Engine(spark, scratch_path(spark, "suite")).connect().db("d")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _customers(spark: SparkSession, sf_dir: str) -> Database:
    db = _store(spark)
    db.c.insert_frame(_table(spark, sf_dir, "customer").selectExpr("c_custkey AS _id", "c_nationkey AS nation", "c_acctbal AS bal", "c_mktsegment AS seg"))
    return db


def _words(spark: SparkSession, sf_dir: str) -> Database:
    db = _store(spark)
    db.p.insert_frame(_table(spark, sf_dir, "part").selectExpr("p_partkey AS _id", "split(p_name, ' ') AS w"))
    return db


def _joined(db: Database, collection: str = "p") -> DataFrame:
    """Arrays of words as one text, which any engine compares alike."""
    text = {"$reduce": {"input": "$w", "initialValue": "", "in": {"$concat": ["$$value", "/", "$$this"]}}}
    return db.collection(collection).aggregate([{"$project": {"_id": 1, "w": text}}]).to_df()


_CUSTOMERS = "SELECT c_custkey AS _id, c_nationkey AS nation, c_acctbal AS bal, c_mktsegment AS seg FROM customer"
_PARTS = "SELECT p_partkey AS _id, string_split(p_name, ' ') AS w FROM part"


def _slashed(words: str) -> str:
    return f"array_to_string(list_transform({words}, lambda x: '/' || x), '')"


@query("q_write_insert", "SELECT r_regionkey AS _id, r_name AS name FROM region UNION ALL SELECT * FROM (VALUES (100, 'one'), (101, 'two'), (102, 'three')) t(_id, name)")
def insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = _store(spark)
    db.r.insert_frame(_table(spark, sf_dir, "region").selectExpr("CAST(r_regionkey AS bigint) AS _id", "r_name AS name"))
    db.r.insert_one({"_id": 100, "name": "one"})
    db.r.insert_many([{"_id": 101, "name": "two"}, {"_id": 102, "name": "three"}])
    return db.r.find().to_df()


@query(
    "q_write_update",
    """SELECT c_custkey AS _id, CASE WHEN seg THEN c_nationkey | 64 ELSE c_nationkey END AS nation, CASE WHEN NOT seg THEN c_acctbal END AS bal,
 CASE WHEN seg THEN c_acctbal END AS balance, seg AS stamped, CASE WHEN c_custkey = 7 THEN 'seven' END AS mark FROM (SELECT *, c_mktsegment = 'BUILDING' AS seg FROM customer)""",
)
def update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """$rename, $bit and $currentDate on many, $set on one."""
    db = _customers(spark, sf_dir)
    db.c.update_many({"seg": "BUILDING"}, {"$rename": {"bal": "balance"}, "$bit": {"nation": {"or": 64}}, "$currentDate": {"at": True}})
    db.c.update_one({"_id": 7}, {"$set": {"mark": "seven"}})
    df = db.c.find().to_df()
    return df.select("_id", "nation", "bal", "balance", F.col("at").isNotNull().alias("stamped"), "mark")


@query(
    "q_write_array_ops",
    f"""WITH a AS ({_PARTS}), b AS (SELECT _id, CASE WHEN list_contains(w, 'red') THEN list_concat(w[1:1], list_concat(['X', 'Y'], w[2:])) ELSE w END AS w FROM a),
c AS (SELECT _id, CASE WHEN list_contains(w, 'bolt') THEN w[2:] ELSE w END AS w FROM b), d AS (SELECT _id, CASE WHEN list_contains(w, 'ring') THEN w[:len(w) - 1] ELSE w END AS w FROM c)
SELECT _id, {_slashed("list_filter(w, lambda x: x NOT IN ('small', 'X'))")} AS w FROM d""",
)
def array_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """$push at a $position, $pop from both ends, $pullAll."""
    db = _words(spark, sf_dir)
    db.p.update_many({"w": "red"}, {"$push": {"w": {"$each": ["X", "Y"], "$position": 1}}})
    db.p.update_many({"w": "bolt"}, {"$pop": {"w": -1}})
    db.p.update_many({"w": "ring"}, {"$pop": {"w": 1}})
    db.p.update_many({}, {"$pullAll": {"w": ["small", "X"]}})
    return _joined(db)


@query(
    "q_write_upsert",
    f"""SELECT _id, nation, bal, seg, CAST(NULL AS VARCHAR) AS born FROM ({_CUSTOMERS}) UNION ALL SELECT -1, 3, 2.5, 'NEW', 'yes'
UNION ALL SELECT -2, NULL, 9.0, NULL, NULL""",
)
def upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An update of nothing seeds a row from filter, $set and $setOnInsert; a replacement of nothing inserts."""
    db = _customers(spark, sf_dir)
    db.c.update_one({"_id": -1, "seg": "NEW"}, {"$set": {"bal": 2.5}, "$setOnInsert": {"born": "yes", "nation": 3}}, upsert=True)
    db.c.update_many({"_id": -1}, {"$setOnInsert": {"born": "no"}}, upsert=True)
    db.c.replace_one({"_id": -2}, {"bal": 9.0}, upsert=True)
    return db.c.find().to_df()


@query(
    "q_write_replace_delete",
    f"""SELECT _id, CASE WHEN _id = 5 THEN NULL ELSE nation END AS nation, CASE WHEN _id = 5 THEN 1.5 ELSE bal END AS bal, CASE WHEN _id = 5 THEN NULL ELSE seg END AS seg
FROM ({_CUSTOMERS}) WHERE _id <> 6 AND (nation % 5 <> 2 OR _id = 5)""",
)
def replace_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = _customers(spark, sf_dir)
    db.c.delete_one({"_id": 6})
    db.c.replace_one({"_id": 5}, {"bal": 1.5})
    db.c.delete_many({"nation": {"$mod": [5, 2]}})
    return db.c.find().to_df()


@query(
    "q_write_find_and",
    """SELECT 'before' AS what, c_acctbal AS bal FROM customer WHERE c_custkey = 1 UNION ALL SELECT 'after', c_acctbal + 10 FROM customer WHERE c_custkey = 2
UNION ALL SELECT 'replaced', 4.5 UNION ALL SELECT 'deleted', max(c_acctbal) FROM customer WHERE c_custkey NOT IN (1, 2, 3)
UNION ALL SELECT 'left', count(*) - 1 FROM customer""",
)
def find_and(spark: SparkSession, sf_dir: str) -> DataFrame:
    """findOneAndUpdate, findOneAndReplace and findOneAndDelete: what they return, and what is left."""
    db = _customers(spark, sf_dir)
    rows = [("before", db.c.find_one_and_update({"_id": 1}, {"$inc": {"bal": 10}})["bal"])]
    rows.append(("after", db.c.find_one_and_update({"_id": 2}, {"$inc": {"bal": 10}}, return_document="after")["bal"]))
    rows.append(("replaced", db.c.find_one_and_replace({"_id": 3}, {"bal": 4.5}, return_document="after")["bal"]))
    rows.append(("deleted", db.c.find_one_and_delete({"_id": {"$nin": [1, 2, 3]}}, sort={"bal": -1})["bal"]))
    rows.append(("left", float(db.c.count_documents())))
    return spark.createDataFrame(rows, "what string, bal double")


@query(
    "q_write_bulk",
    """SELECT c_custkey AS _id, CASE WHEN c_custkey = 4 THEN NULL WHEN c_mktsegment = 'AUTOMOBILE' THEN 1 ELSE c_nationkey END AS nation,
 CASE WHEN c_custkey = 4 THEN 8.0 WHEN c_custkey = 9 THEN 0.25 ELSE c_acctbal END AS bal FROM customer WHERE c_custkey <> 3 AND c_mktsegment <> 'MACHINERY'
UNION ALL SELECT -5, 2, 3.0""",
)
def bulk(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = _customers(spark, sf_dir)
    db.c.bulk_write([
        {"insertOne": {"document": {"_id": -5, "nation": 2, "bal": 3.0}}},
        {"updateOne": {"filter": {"_id": 9}, "update": {"$set": {"bal": 0.25}}}},
        {"updateMany": {"filter": {"seg": "AUTOMOBILE"}, "update": {"$set": {"nation": 1}}}},
        {"deleteOne": {"filter": {"_id": 3}}},
        {"deleteMany": {"filter": {"seg": "MACHINERY", "_id": {"$ne": 4}}}},
        {"replaceOne": {"filter": {"_id": 4}, "replacement": {"bal": 8.0}}},
    ])
    return db.c.aggregate([{"$match": {"$or": [{"seg": {"$ne": "MACHINERY"}}, {"_id": 4}]}}, {"$project": {"nation": 1, "bal": 1}}]).to_df()


WRITES["q_write_bulk"] = (bulk, WRITES["q_write_bulk"][1].replace("AND c_mktsegment <> 'MACHINERY'", "AND (c_mktsegment <> 'MACHINERY' OR c_custkey = 4)"))


@query(
    "q_merge_nulls",
    """SELECT c_custkey AS _id, CASE WHEN c_nationkey % 2 = 0 THEN NULL ELSE c_acctbal END AS bal, c_mktsegment AS seg, CASE WHEN c_nationkey % 2 = 0 THEN 2 END AS n FROM customer""",
)
def merge_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A null of a new row replaces the old value; of rows with one key the last counts."""
    db = _store(spark)
    customers = _table(spark, sf_dir, "customer")
    db.c.insert_frame(customers.selectExpr("c_custkey AS _id", "c_acctbal AS bal", "c_mktsegment AS seg"))
    even = customers.where("c_nationkey % 2 = 0")
    twice = even.selectExpr("c_custkey AS key", "CAST(1 AS double) AS bal", "1 AS n").unionByName(even.selectExpr("c_custkey AS key", "CAST(NULL AS double) AS bal", "2 AS n"))
    source = Engine(spark).from_frames({"s": twice.coalesce(1)})
    rows = source.s.aggregate([{"$project": {"_id": "$key", "bal": 1, "n": 1}}]).to_df()
    db.c._merge_rows({"into": "c"}, rows)
    return db.c.find().to_df()


@query("q_catalog", "SELECT * FROM (VALUES ('names', 'b,c'), ('stats', '2'), ('objects', '30'), ('renamed', 'c,moved'), ('dropped', 'c'), ('database', ''), ('size', 'true')) t(what, value)")
def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names, statistics, renaming and dropping of collections."""
    db = _store(spark)
    db.b.insert_frame(_table(spark, sf_dir, "region").selectExpr("r_regionkey AS _id"))
    db.c.insert_frame(_table(spark, sf_dir, "nation").selectExpr("n_nationkey AS _id"))
    names = lambda: ",".join(x["name"] for x in db.list_collections(name_only=True))
    rows = [("names", names()), ("stats", str(db.stats()["collections"])), ("objects", str(db.stats()["objects"])), ("size", str(db.b.stats()["size"] > 0).lower())]
    db.collection("b").rename("moved")
    rows.append(("renamed", names()))
    db.collection("moved").drop()
    rows.append(("dropped", names()))
    db.drop_database()
    rows.append(("database", names()))
    return spark.createDataFrame(rows, "what string, value string")


@query("q_indexes", "SELECT * FROM (VALUES ('_id_', 1), ('nation_1', 2), ('seg_1_bal_-1', 2), ('bal_hashed', 1), ('$**_1', 1), ('seg_text', 1), ('by_place', 1), ('ttl', 1), ('left', 2)) t(name, n)")
def indexes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds and options of indexes, and what is left after dropping; n counts key fields and flags."""
    db = _customers(spark, sf_dir)
    db.c.create_index({"nation": 1}, sparse=True)
    db.c.create_indexes([{"key": {"seg": 1, "bal": -1}}, {"key": {"bal": "hashed"}}, {"key": {"$**": 1}}, {"key": {"seg": "text"}}])
    db.c.create_index({"place": "2dsphere"}, name="by_place")
    db.c.create_index({"at": 1}, name="ttl", expireAfterSeconds=60)
    rows = [(i["name"], len(i["key"]) + bool(i.get("sparse"))) for i in db.c.list_indexes()]
    db.c.drop_index("ttl")
    db.c.drop_index({"nation": 1})
    db.c.drop_indexes(["seg_1_bal_-1", "bal_hashed", "$**_1", "by_place"])
    rows.append(("left", len(db.c.indexes())))
    return spark.createDataFrame(rows, "name string, n int")


@query(
    "q_reads",
    """SELECT 'count' AS what, count(*)::VARCHAR AS value FROM customer WHERE c_mktsegment = 'BUILDING' UNION ALL SELECT 'estimate', count(*)::VARCHAR FROM customer
UNION ALL SELECT 'one', c_custkey::VARCHAR FROM (SELECT c_custkey FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 1 OFFSET 2)
UNION ALL SELECT 'hint', max(c_custkey)::VARCHAR FROM customer UNION ALL SELECT 'list', string_agg(r_name, ',' ORDER BY r_regionkey) FROM region
UNION ALL SELECT 'comment', count(*)::VARCHAR FROM customer WHERE c_nationkey = 3""",
)
def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """findOne, counts, hints, toArray and $comment."""
    db = _customers(spark, sf_dir)
    db.r.insert_frame(_table(spark, sf_dir, "region").selectExpr("r_regionkey AS _id", "r_name AS name"))
    rows = [
        ("count", str(db.c.count_documents({"seg": "BUILDING"}))),
        ("estimate", str(db.c.estimated_document_count())),
        ("one", str(db.c.find_one({}, {"_id": 1}, sort={"bal": -1, "_id": 1}, skip=2)["_id"])),
        ("hint", str(db.c.find().sort({"_id": -1}).hint("_id_").limit(1).to_list()[0]["_id"])),
        ("list", ",".join(x["name"] for x in db.r.find().sort({"_id": 1}).to_list())),
        ("comment", str(db.c.count_documents({"$comment": "a note", "nation": 3}))),
    ]
    return spark.createDataFrame(rows, "what string, value string")


@query("q_json_roundtrip", "SELECT o_orderkey, o_orderstatus, o_totalprice, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderdate END AS o_orderdate FROM orders")
def json_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates in extended JSON and nulls, written to files and read back under their schema's names."""
    folder = scratch_path(spark, "json")
    orders = _table(spark, sf_dir, "orders").selectExpr("o_orderkey", "o_orderstatus", "o_totalprice", "CASE WHEN o_orderstatus <> 'P' THEN o_orderdate END AS o_orderdate")
    write_json(orders, f"{folder}/orders.json")
    return Engine(spark).from_json(folder).orders.find().to_df().select(*orders.columns)


def _provoked(db: Database) -> dict[str, Callable]:
    c = db.c
    return {
        "unknown accumulator": lambda: c.aggregate([{"$group": {"_id": None, "x": {"$nope": 1}}}]).to_list(),
        "unknown stage": lambda: c.aggregate([{"$nope": {}}]).to_list(),
        "unknown filter operator": lambda: c.find({"nation": {"$nope": 1}}).to_list(),
        "unknown update operator": lambda: c.update_one({}, {"$nope": {"a": 1}}),
        "replacement with operators": lambda: c.replace_one({"_id": 1}, {"$set": {"a": 1}}),
        "open ring": lambda: c.find({"p": {"$geoWithin": {"$geometry": {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 1], [0, 1]]]}}}}).to_list(),
        "unknown geometry": lambda: c.find({"p": {"$geoIntersects": {"$geometry": {"type": "Blob", "coordinates": []}}}}).to_list(),
        "duplicate id": lambda: c.insert_one({"_id": 1}),
        "duplicate of a unique index": lambda: (c.create_index({"tag": 1}, unique=True, sparse=True), c.insert_many([{"_id": -1, "tag": "t"}, {"_id": -2, "tag": "t"}])),
        "hint without an index": lambda: c.find().hint("nope").to_list(),
        "hint of a hidden index": lambda: (c.create_index({"seg": 1}, hidden=True), c.find().hint("seg_1").to_list()),
        "near without an index": lambda: c.find({"p": {"$near": [0, 0]}}).to_list(),
        "unique text index": lambda: c.create_index({"seg": "text"}, unique=True),
        "weight out of range": lambda: c.create_index({"seg": "text"}, weights={"seg": 0}),
        "collation without a locale": lambda: c.create_index({"bal": 1}, collation={}),
        "dropping the id index": lambda: c.drop_index("_id_"),
        "renaming nothing": lambda: db.collection("nothing").rename("x"),
    }


_ERRORS = list(_provoked(type("Names", (), {"c": None})()))


@query("q_errors", "SELECT * FROM (VALUES " + ", ".join(f"('{name}', true)" for name in _ERRORS) + ") t(what, raised)")
def errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bad specifications and broken rules raise, and leave all rows as they were."""
    db = _customers(spark, sf_dir)
    before = db.c.count_documents()
    rows = []
    for name, provoke in _provoked(db).items():
        try:
            provoke()
            raised = False
        except DocError:
            raised = db.c.count_documents() == before
        rows.append((name, raised))
    return spark.createDataFrame(rows, "what string, raised boolean")


def _near(spark: SparkSession, sf_dir: str, kind: str, filter: dict) -> DataFrame:
    customers = _table(spark, sf_dir, "customer").selectExpr("c_custkey", "array(CAST((c_custkey % 360) - 180 AS double), CAST(((c_custkey * 7) % 170) - 85 AS double)) AS loc")
    db = Engine(spark).from_frames({"c": customers}, {"c": [{"key": {"loc": kind}, "name": f"loc_{kind}"}]})
    return db.c.find(filter, {"_id": 0, "c_custkey": 1}).to_df()


_XY = "SELECT c_custkey, (c_custkey % 360) - 180 AS x, ((c_custkey * 7) % 170) - 85 AS y FROM customer"
_HAV = "2 * 6378100.0 * asin(sqrt(pow(sin(radians(20 - y) / 2), 2) + cos(radians(y)) * cos(radians(20)) * pow(sin(radians(10 - x) / 2), 2)))"


@query("q_near_plane", f"SELECT c_custkey FROM ({_XY}) WHERE sqrt((x - 10) * (x - 10) + (y - 20) * (y - 20)) <= 30.5 AND sqrt((x - 10) * (x - 10) + (y - 20) * (y - 20)) >= 4.5")
def near_plane(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _near(spark, sf_dir, "2d", {"loc": {"$near": [10, 20], "$maxDistance": 30.5, "$minDistance": 4.5}})


@query("q_near_sphere", f"SELECT c_custkey FROM ({_XY}) WHERE {_HAV} <= 2500000")
def near_sphere(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _near(spark, sf_dir, "2dsphere", {"loc": {"$nearSphere": {"$geometry": {"type": "Point", "coordinates": [10, 20]}, "$maxDistance": 2_500_000}}})
