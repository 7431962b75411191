"""One query for each operator family, with DuckDB SQL for the same rows.

Each entry: the collection, the pipeline, and the SQL (None where SQL cannot say
it).  Results are flat columns of plain types under the same names.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import Engine
from .writes import WRITES

D = dt.datetime
REVENUE = {"$multiply": ["$l_extendedprice", {"$subtract": [1, "$l_discount"]}]}

FLAGSHIP = [
    {"$match": {"l_discount": {"$gte": 0.02}, "l_quantity": {"$lt": 40}}},
    {"$lookup": {"from": "orders", "localField": "l_orderkey", "foreignField": "o_orderkey", "as": "o"}},
    {"$unwind": "$o"},
    {"$lookup": {"from": "customer", "localField": "o.o_custkey", "foreignField": "c_custkey", "as": "c"}},
    {"$unwind": "$c"},
    {"$group": {"_id": {"segment": "$c.c_mktsegment", "year": {"$year": "$o.o_orderdate"}}, "revenue": {"$sum": REVENUE}, "n": {"$count": {}}}},
    {"$sort": {"revenue": -1}},
    {"$project": {"_id": 0, "segment": "$_id.segment", "year": "$_id.year", "revenue": {"$round": ["$revenue", 2]}, "n": 1}},
]

Entry = tuple[str, list, str | None]
CATALOGUE: dict[str, Entry] = {}


def add(name: str, collection: str, pipeline: list, sql: str | None = None) -> None:
    CATALOGUE[name] = (collection, pipeline, sql)


def keep(*names: str, **made) -> dict:
    return {"$project": {"_id": 0, **{n: 1 for n in names}, **made}}


add("q_flagship", "lineitem", FLAGSHIP, """
SELECT c_mktsegment AS segment, year(o_orderdate) AS year, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
WHERE l_discount >= 0.02 AND l_quantity < 40 GROUP BY ALL""")

# --- filters ---
_L = ["l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice"]
_LSQL = "SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice FROM lineitem WHERE "
add("q_match_cmp", "lineitem", [{"$match": {"l_quantity": {"$gt": 10, "$lte": 20}, "l_discount": {"$gte": 0.05}}}, keep(*_L)], _LSQL + "l_quantity > 10 AND l_quantity <= 20 AND l_discount >= 0.05")
add("q_match_eq_ne", "orders", [{"$match": {"o_orderstatus": {"$ne": "F"}, "o_orderpriority": "1-URGENT"}}, keep("o_orderkey")], "SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F' AND o_orderpriority = '1-URGENT'")
add("q_match_in", "lineitem", [{"$match": {"l_linenumber": {"$in": [1, 3]}, "l_returnflag": {"$nin": ["R", "A"]}}}, keep(*_L)], _LSQL + "l_linenumber IN (1, 3) AND l_returnflag NOT IN ('R', 'A')")
add("q_match_logic", "lineitem", [{"$match": {"$or": [{"l_quantity": {"$lt": 3}}, {"$and": [{"l_tax": {"$gte": 0.07}}, {"l_quantity": {"$gt": 47}}]}], "$nor": [{"l_returnflag": "R"}]}}, keep(*_L)], _LSQL + "(l_quantity < 3 OR (l_tax >= 0.07 AND l_quantity > 47)) AND NOT l_returnflag = 'R'")
add("q_match_not", "lineitem", [{"$match": {"l_quantity": {"$not": {"$gte": 4}}}}, keep(*_L)], _LSQL + "NOT l_quantity >= 4")
add("q_match_regex", "part", [{"$match": {"p_type": {"$regex": "^[a-m].*e", "$options": "i"}}}, keep("p_partkey", "p_type")], "SELECT p_partkey, p_type FROM part WHERE regexp_matches(p_type, '^[a-m].*e', 'i')")
add("q_match_mod", "orders", [{"$match": {"o_orderkey": {"$mod": [7, 3]}}}, keep("o_orderkey")], "SELECT o_orderkey FROM orders WHERE o_orderkey % 7 = 3")
add("q_match_bits", "orders", [{"$match": {"o_orderkey": {"$bitsAllSet": 5, "$bitsAnyClear": [1, 3]}, "o_custkey": {"$bitsAnySet": 6, "$bitsAllClear": [0]}}}, keep("o_orderkey", "o_custkey")], "SELECT o_orderkey, o_custkey FROM orders WHERE (o_orderkey & 5) = 5 AND (o_orderkey & 10) <> 10 AND (o_custkey & 6) <> 0 AND (o_custkey & 1) = 0")
add("q_match_expr", "lineitem", [{"$match": {"$expr": {"$gt": [{"$multiply": ["$l_quantity", 1500]}, "$l_extendedprice"]}}}, keep(*_L)], _LSQL + "l_quantity * 1500 > l_extendedprice")
add("q_match_type", "lineitem", [{"$match": {"l_discount": {"$type": "double"}, "l_returnflag": {"$type": "string"}}}, keep(*_L)], _LSQL + "l_discount <> floor(l_discount)")
add("q_match_exists", "orders", [{"$match": {"o_orderkey": {"$exists": True}, "o_nothing": {"$exists": False}, "o_custkey": {"$lt": 50}}}, keep("o_orderkey")], "SELECT o_orderkey FROM orders WHERE o_custkey < 50")
add("q_match_exists_whole", "orders", [{"$match": {"o_orderkey": {"$exists": True}, "o_nothing": {"$exists": False}}}, keep("o_orderkey")], "SELECT o_orderkey FROM orders")
add("q_match_array", "embeddings", [{"$match": {"embedding": {"$size": 64, "$elemMatch": {"$gt": 0.3, "$lt": 0.31}}}}, keep("vec_id")], "SELECT vec_id FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x > 0.3 AND x < 0.31)) > 0")
add("q_match_all", "part", [{"$addFields": {"words": {"$split": ["$p_type", " "]}}}, {"$match": {"words": {"$all": ["STEEL"]}}}, keep("p_partkey")], "SELECT p_partkey FROM part WHERE list_contains(string_split(p_type, ' '), 'STEEL')")
add("q_match_jsonschema", "orders", [{"$match": {"$jsonSchema": {"required": ["o_orderkey"], "properties": {"o_totalprice": {"bsonType": "number", "minimum": 1000, "maximum": 50000}, "o_orderstatus": {"enum": ["O", "P"]}, "o_orderpriority": {"type": "string", "pattern": "^[12]", "minLength": 3}}}}}, keep("o_orderkey")], "SELECT o_orderkey FROM orders WHERE o_totalprice BETWEEN 1000 AND 50000 AND o_orderstatus IN ('O', 'P') AND regexp_matches(o_orderpriority, '^[12]')")

# --- shaping ---
add("q_project_incl", "orders", [{"$project": {"_id": 0, "o_orderkey": 1, "double": {"$multiply": ["$o_totalprice", 2]}}}], "SELECT o_orderkey, o_totalprice * 2 AS double FROM orders")
add("q_project_excl", "customer", [{"$project": {"c_name": 0, "c_acctbal": 0}}], "SELECT * EXCLUDE (c_name, c_acctbal) FROM customer")
add("q_addfields", "customer", [{"$addFields": {"big": {"$gt": ["$c_acctbal", 5000]}, "label": {"$concat": ["$c_mktsegment", "-", "$c_name"]}}}], "SELECT *, c_acctbal > 5000 AS big, c_mktsegment || '-' || c_name AS label FROM customer")
add("q_unset", "supplier", [{"$unset": ["s_name", "s_acctbal"]}], "SELECT s_suppkey, s_nationkey FROM supplier")
add("q_replace_root", "nation", [{"$replaceRoot": {"newRoot": {"key": "$n_nationkey", "name": {"$toLower": "$n_name"}}}}], "SELECT n_nationkey AS key, lower(n_name) AS name FROM nation")
add("q_replace_with", "region", [{"$replaceWith": {"r": "$r_regionkey"}}], "SELECT r_regionkey AS r FROM region")

# --- groups ---
_RF = {"flag": "$l_returnflag", "status": "$l_linestatus"}
_FLAT = {"_id": 0, "flag": "$_id.flag", "status": "$_id.status"}
add("q_group_basic", "lineitem", [{"$group": {"_id": "$l_returnflag", "qty": {"$sum": "$l_quantity"}, "least": {"$min": "$l_extendedprice"}, "most": {"$max": "$l_extendedprice"}, "n": {"$sum": 1}}}, {"$project": {"_id": 0, "flag": "$_id", "qty": 1, "least": 1, "most": 1, "n": 1}}], "SELECT l_returnflag AS flag, sum(l_quantity) AS qty, min(l_extendedprice) AS least, max(l_extendedprice) AS most, count(*) AS n FROM lineitem GROUP BY ALL")
add("q_group_compound", "lineitem", [{"$group": {"_id": _RF, "mean": {"$avg": "$l_quantity"}, "n": {"$count": {}}}}, {"$project": {**_FLAT, "mean": {"$round": ["$mean", 6]}, "n": 1}}], "SELECT l_returnflag AS flag, l_linestatus AS status, round(avg(l_quantity), 6) AS mean, count(*) AS n FROM lineitem GROUP BY ALL")
add("q_group_null", "lineitem", [{"$group": {"_id": None, "n": {"$count": {}}, "qty": {"$sum": "$l_quantity"}}}, keep("n", "qty")], "SELECT count(*) AS n, sum(l_quantity) AS qty FROM lineitem")
add("q_group_stddev", "lineitem", [{"$group": {"_id": _RF, "p": {"$stdDevPop": "$l_quantity"}, "s": {"$stdDevSamp": "$l_quantity"}}}, {"$project": {**_FLAT, "p": {"$round": ["$p", 6]}, "s": {"$round": ["$s", 6]}}}], "SELECT l_returnflag AS flag, l_linestatus AS status, round(stddev_pop(l_quantity), 6) AS p, round(stddev_samp(l_quantity), 6) AS s FROM lineitem GROUP BY ALL")
add("q_group_first_last", "orders", [{"$sort": {"o_orderdate": 1, "o_orderkey": 1}}, {"$group": {"_id": "$o_custkey", "first": {"$first": "$o_orderkey"}, "last": {"$last": "$o_orderkey"}}}, {"$project": {"_id": 0, "cust": "$_id", "first": 1, "last": 1}}], "SELECT o_custkey AS cust, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS first, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS last FROM orders GROUP BY ALL")
add("q_group_push", "orders", [{"$sort": {"o_orderdate": 1, "o_orderkey": 1}}, {"$group": {"_id": "$o_custkey", "keys": {"$push": "$o_orderkey"}}}, {"$project": {"_id": 0, "cust": "$_id", "n": {"$size": "$keys"}, "second": {"$arrayElemAt": ["$keys", 1]}}}], "SELECT o_custkey AS cust, count(*) AS n, (list(o_orderkey ORDER BY o_orderdate, o_orderkey))[2] AS second FROM orders GROUP BY ALL")
add("q_group_addtoset", "orders", [{"$group": {"_id": "$o_custkey", "s": {"$addToSet": "$o_orderstatus"}}}, {"$project": {"_id": 0, "cust": "$_id", "n": {"$size": "$s"}, "least": {"$arrayElemAt": ["$s", 0]}}}], "SELECT o_custkey AS cust, count(DISTINCT o_orderstatus) AS n, min(o_orderstatus) AS least FROM orders GROUP BY ALL")
add("q_group_mergeobjects", "orders", [{"$sort": {"o_orderkey": 1}}, {"$group": {"_id": "$o_custkey", "m": {"$mergeObjects": {"key": "$o_orderkey", "status": "$o_orderstatus"}}}}, {"$project": {"_id": 0, "cust": "$_id", "key": "$m.key", "status": "$m.status"}}], "SELECT o_custkey AS cust, max(o_orderkey) AS key, arg_max(o_orderstatus, o_orderkey) AS status FROM orders GROUP BY ALL")
add("q_sort_limit", "orders", [{"$sort": {"o_totalprice": -1, "o_orderkey": 1}}, {"$limit": 25}, keep("o_orderkey", "o_totalprice")], "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
add("q_skip", "orders", [{"$sort": {"o_orderkey": 1}}, {"$skip": 100}, {"$limit": 50}, keep("o_orderkey")], "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 50 OFFSET 100")
add("q_count", "lineitem", [{"$match": {"l_quantity": {"$gt": 30}}}, {"$count": "n"}], "SELECT count(*) AS n FROM lineitem WHERE l_quantity > 30")
add("q_sortbycount", "orders", [{"$sortByCount": "$o_orderpriority"}, {"$project": {"_id": 0, "priority": "$_id", "count": 1}}], "SELECT o_orderpriority AS priority, count(*) AS count FROM orders GROUP BY ALL")
add("q_bucket", "lineitem", [{"$bucket": {"groupBy": "$l_quantity", "boundaries": [0, 10, 20, 40], "default": -1, "output": {"n": {"$sum": 1}, "most": {"$max": "$l_extendedprice"}}}}, {"$project": {"_id": 0, "low": "$_id", "n": 1, "most": 1}}], "SELECT CASE WHEN l_quantity < 10 THEN 0 WHEN l_quantity < 20 THEN 10 WHEN l_quantity < 40 THEN 20 ELSE -1 END::BIGINT AS low, count(*) AS n, max(l_extendedprice) AS most FROM lineitem GROUP BY ALL")
add("q_bucketauto", "orders", [{"$bucketAuto": {"groupBy": "$o_orderkey", "buckets": 7}}, {"$project": {"_id": 0, "low": "$_id.min", "high": "$_id.max", "count": 1}}], "WITH r AS (SELECT o_orderkey AS k, row_number() OVER (ORDER BY o_orderkey) - 1 AS rn, count(*) OVER () AS n FROM orders), b AS (SELECT rn // CAST(ceil(n / 7.0) AS BIGINT) AS b, min(k) AS low, max(k) AS top, count(*) AS count FROM r GROUP BY 1) SELECT low, coalesce(lead(low) OVER (ORDER BY b), top) AS high, count FROM b")
add("q_facet", "orders", [{"$facet": {"a": [{"$match": {"o_orderstatus": "F"}}, {"$count": "n"}], "b": [{"$sort": {"o_totalprice": -1}}, {"$limit": 3}]}}, {"$project": {"_id": 0, "n": {"$first": {"$map": {"input": "$a", "in": "$$this.n"}}}, "top": {"$first": {"$map": {"input": "$b", "in": "$$this.o_totalprice"}}}, "size": {"$size": "$b"}}}], "SELECT (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') AS n, (SELECT max(o_totalprice) FROM orders) AS top, 3::BIGINT AS size")
add("q_sample", "orders", [{"$sample": {"size": 20}}, {"$count": "n"}], "SELECT 20::BIGINT AS n")

# --- arrays to rows ---
add("q_unwind", "embeddings", [{"$unwind": "$embedding"}, {"$group": {"_id": "$label", "n": {"$sum": 1}, "most": {"$max": "$embedding"}}}, {"$project": {"_id": 0, "label": "$_id", "n": 1, "most": 1}}], "SELECT label, count(*) AS n, max(e) AS most FROM (SELECT label, unnest(embedding) AS e FROM embeddings) GROUP BY ALL")
add("q_unwind_preserve", "part", [{"$addFields": {"w": {"$filter": {"input": {"$split": ["$p_type", " "]}, "as": "x", "cond": {"$eq": ["$$x", "BRASS"]}}}}}, {"$unwind": {"path": "$w", "preserveNullAndEmptyArrays": True}}, keep("p_partkey", "w")], "SELECT p_partkey, CASE WHEN list_contains(string_split(p_type, ' '), 'BRASS') THEN 'BRASS' END AS w FROM part")
add("q_unwind_index", "part", [{"$addFields": {"w": {"$split": ["$p_type", " "]}}}, {"$unwind": {"path": "$w", "includeArrayIndex": "i"}}, keep("p_partkey", "w", "i")], "SELECT p_partkey, unnest(string_split(p_type, ' ')) AS w, unnest(range(len(string_split(p_type, ' ')))) AS i FROM part")

# --- joins ---
_CO = {"$lookup": {"from": "orders", "localField": "c_custkey", "foreignField": "o_custkey", "as": "os"}}
add("q_lookup_nest", "customer", [_CO, {"$project": {"_id": 0, "c_custkey": 1, "n": {"$size": "$os"}}}], "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY ALL")
add("q_lookup_unwind", "customer", [_CO, {"$unwind": "$os"}, {"$project": {"_id": 0, "c_custkey": 1, "key": "$os.o_orderkey"}}], "SELECT c_custkey, o_orderkey AS key FROM customer JOIN orders ON c_custkey = o_custkey")
add("q_lookup_left", "customer", [_CO, {"$unwind": {"path": "$os", "preserveNullAndEmptyArrays": True}}, {"$project": {"_id": 0, "c_custkey": 1, "key": "$os.o_orderkey"}}], "SELECT c_custkey, o_orderkey AS key FROM customer LEFT JOIN orders ON c_custkey = o_custkey")
add("q_lookup_semi", "customer", [_CO, {"$match": {"os": {"$ne": []}}}, keep("c_custkey")], "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
add("q_lookup_anti", "orders", [{"$lookup": {"from": "lineitem", "localField": "o_orderkey", "foreignField": "l_orderkey", "as": "ls"}}, {"$match": {"ls": {"$size": 0}}}, keep("o_orderkey")], "SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
add("q_lookup_range", "nation", [{"$lookup": {"from": "supplier", "let": {"k": "$n_nationkey"}, "pipeline": [{"$match": {"$expr": {"$and": [{"$eq": ["$s_nationkey", "$$k"]}, {"$gt": ["$s_acctbal", {"$multiply": ["$$k", 100]}]}]}}}], "as": "ss"}}, {"$project": {"_id": 0, "n_nationkey": 1, "n": {"$size": "$ss"}}}], "SELECT n_nationkey, count(s_suppkey) AS n FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey AND s_acctbal > n_nationkey * 100 GROUP BY ALL")
add("q_lookup_topn", "customer", [{"$lookup": {"from": "orders", "let": {"c": "$c_custkey"}, "pipeline": [{"$match": {"$expr": {"$eq": ["$o_custkey", "$$c"]}}}, {"$sort": {"o_totalprice": -1, "o_orderkey": 1}}, {"$limit": 1}], "as": "top"}}, {"$unwind": "$top"}, {"$project": {"_id": 0, "c_custkey": 1, "key": "$top.o_orderkey"}}], "SELECT o_custkey AS c_custkey, o_orderkey AS key FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1")
add("q_lookup_pipeline_group", "customer", [{"$lookup": {"from": "orders", "let": {"c": "$c_custkey"}, "pipeline": [{"$match": {"$expr": {"$eq": ["$o_custkey", "$$c"]}, "o_orderstatus": "O"}}, {"$group": {"_id": None, "total": {"$sum": "$o_totalprice"}, "n": {"$sum": 1}}}], "as": "t"}}, {"$unwind": "$t"}, {"$project": {"_id": 0, "c_custkey": 1, "total": {"$round": ["$t.total", 2]}, "n": "$t.n"}}], "SELECT o_custkey AS c_custkey, round(sum(o_totalprice), 2) AS total, count(*) AS n FROM orders WHERE o_orderstatus = 'O' GROUP BY ALL")
add("q_unionwith", "customer", [keep(name="$c_name", nation="$c_nationkey"), {"$unionWith": {"coll": "supplier", "pipeline": [keep(name="$s_name", nation="$s_nationkey")]}}], "SELECT c_name AS name, c_nationkey AS nation FROM customer UNION ALL SELECT s_name, s_nationkey FROM supplier")
add("q_graphlookup", "nation", [{"$match": {"n_nationkey": {"$lt": 10}}}, {"$graphLookup": {"from": "nation", "startWith": "$n_regionkey", "connectFromField": "n_regionkey", "connectToField": "n_nationkey", "as": "g", "depthField": "d", "maxDepth": 5}}, {"$unwind": "$g"}, {"$project": {"_id": 0, "n_nationkey": 1, "to": "$g.n_nationkey", "depth": "$g.d"}}], "WITH RECURSIVE r AS (SELECT n.n_nationkey AS s, t.n_nationkey AS k, t.n_regionkey AS nx, 0 AS d FROM nation n JOIN nation t ON t.n_nationkey = n.n_regionkey WHERE n.n_nationkey < 10 UNION ALL SELECT r.s, t.n_nationkey, t.n_regionkey, r.d + 1 FROM r JOIN nation t ON t.n_nationkey = r.nx WHERE r.d < 5) SELECT s AS n_nationkey, k AS to, min(d)::BIGINT AS depth FROM r GROUP BY s, k")
add("q_graphlookup_whole", "nation", [{"$graphLookup": {"from": "nation", "startWith": "$n_regionkey", "connectFromField": "n_regionkey", "connectToField": "n_nationkey", "as": "g", "depthField": "d", "maxDepth": 5}}, {"$unwind": "$g"}, {"$project": {"_id": 0, "n_nationkey": 1, "to": "$g.n_nationkey", "depth": "$g.d"}}], "WITH RECURSIVE r AS (SELECT n.n_nationkey AS s, t.n_nationkey AS k, t.n_regionkey AS nx, 0 AS d FROM nation n JOIN nation t ON t.n_nationkey = n.n_regionkey UNION ALL SELECT r.s, t.n_nationkey, t.n_regionkey, r.d + 1 FROM r JOIN nation t ON t.n_nationkey = r.nx WHERE r.d < 5) SELECT s AS n_nationkey, k AS to, min(d)::BIGINT AS depth FROM r GROUP BY s, k")

# --- windows ---
_PART = {"c": "$o_custkey"}
_BY = {"o_orderdate": 1, "o_orderkey": 1}


def window(name: str, output: dict, sql: str, fields: dict, by: dict = _BY, partition: dict = _PART, collection: str = "orders", key: str = "o_orderkey", table: str = "orders", w: str = "PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey") -> None:
    add(name, collection, [{"$setWindowFields": {"partitionBy": partition, "sortBy": by, "output": output}}, {"$project": {"_id": 0, key: 1, **fields}}], f"SELECT {key}, {sql} FROM {table} WINDOW w AS ({w})")


_EW = {"by": {"ts": 1}, "partition": {"u": "$user_id"}, "collection": "events", "key": "event_id", "table": "events", "w": "PARTITION BY user_id ORDER BY ts"}
window("q_win_rank", {"r": {"$rank": {}}, "d": {"$denseRank": {}}}, "rank() OVER w AS r, dense_rank() OVER w AS d", {"r": 1, "d": 1}, by={"o_orderpriority": 1}, w="PARTITION BY o_custkey ORDER BY o_orderpriority")
window("q_win_rownum", {"n": {"$documentNumber": {}}}, "row_number() OVER w AS n", {"n": 1})
window("q_win_shift", {"p": {"$shift": {"output": "$o_orderkey", "by": -1, "default": -1}}, "q": {"$shift": {"output": "$o_orderkey", "by": 2}}}, "lag(o_orderkey, 1, -1) OVER w AS p, lead(o_orderkey, 2) OVER w AS q", {"p": 1, "q": 1})
window("q_win_moving", {"m": {"$avg": "$o_totalprice", "window": {"documents": [-2, "current"]}}, "c": {"$count": {}, "window": {"documents": ["unbounded", "current"]}}, "s": {"$sum": "$o_totalprice", "window": {"documents": ["unbounded", "unbounded"]}}}, "round(avg(o_totalprice) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 4) AS m, count(*) OVER (w ROWS UNBOUNDED PRECEDING) AS c, round(sum(o_totalprice) OVER (PARTITION BY o_custkey), 2) AS s", {"m": {"$round": ["$m", 4]}, "c": 1, "s": {"$round": ["$s", 2]}})
window("q_win_range", {"n": {"$count": {}, "window": {"range": [-30, 0], "unit": "day"}}}, "count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderdate RANGE BETWEEN INTERVAL 30 DAY PRECEDING AND CURRENT ROW) AS n", {"n": 1}, by={"o_orderdate": 1})
window("q_win_covar", {"p": {"$covariancePop": ["$o_totalprice", "$o_orderkey"]}, "s": {"$covarianceSamp": ["$o_totalprice", "$o_orderkey"]}}, "round(covar_pop(o_totalprice, o_orderkey) OVER (PARTITION BY o_custkey) / 1e6, 2) AS p, round(covar_samp(o_totalprice, o_orderkey) OVER (PARTITION BY o_custkey) / 1e6, 2) AS s", {"p": {"$round": [{"$divide": ["$p", 1e6]}, 2]}, "s": {"$round": [{"$divide": ["$s", 1e6]}, 2]}})
window("q_win_stddev", {"p": {"$stdDevPop": "$o_totalprice"}, "s": {"$stdDevSamp": "$o_totalprice"}}, "round(stddev_pop(o_totalprice) OVER (PARTITION BY o_custkey), 2) AS p, round(stddev_samp(o_totalprice) OVER (PARTITION BY o_custkey), 2) AS s", {"p": {"$round": ["$p", 2]}, "s": {"$round": ["$s", 2]}})
window("q_win_minmax", {"a": {"$min": "$o_totalprice"}, "b": {"$max": "$o_totalprice", "window": {"documents": ["unbounded", "current"]}}, "f": {"$first": "$o_orderkey"}, "l": {"$last": "$o_orderkey"}}, "min(o_totalprice) OVER (PARTITION BY o_custkey) AS a, max(o_totalprice) OVER (w ROWS UNBOUNDED PRECEDING) AS b, first(o_orderkey) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS f, last(o_orderkey) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS l", {"a": 1, "b": 1, "f": 1, "l": 1})
window("q_win_push", {"a": {"$push": "$o_orderkey", "window": {"documents": [-1, 1]}}, "s": {"$addToSet": "$o_orderstatus"}}, "len(list(o_orderkey) OVER (w ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)) AS a, len(list_distinct(list(o_orderstatus) OVER (PARTITION BY o_custkey))) AS s", {"a": {"$size": "$a"}, "s": {"$size": "$s"}})
# The small addends keep values off the ties between two roundings.
window("q_win_derivative", {"d": {"$derivative": {"input": "$value", "unit": "hour"}}}, "round((value - lag(value) OVER w) / ((epoch_us(ts) // 1000) - (epoch_us(lag(ts) OVER w) // 1000)) * 3600000 + 1.234e-6, 4) AS d", {"d": {"$round": [{"$add": ["$d", 1.234e-6]}, 4]}}, **_EW)
window("q_win_integral", {"a": {"$integral": {"input": "$value", "unit": "hour"}, "window": {"documents": ["unbounded", "current"]}}}, "a", {"a": {"$round": [{"$add": ["$a", 1.234e-5]}, 3]}}, **_EW)
CATALOGUE["q_win_integral"] = (*CATALOGUE["q_win_integral"][:2], "WITH x AS (SELECT *, (value + lag(value) OVER w) / 2 * ((epoch_us(ts) // 1000) - (epoch_us(lag(ts) OVER w) // 1000)) / 3600000 AS part FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)) SELECT event_id, round(sum(coalesce(part, 0)) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) + 1.234e-5, 3) AS a FROM x")
_HOLES = {"$addFields": {"v": {"$cond": [{"$eq": [{"$mod": ["$event_id", 3]}, 0]}, "$value", None]}}}
add("q_win_locf", "events", [_HOLES, {"$setWindowFields": {"partitionBy": {"u": "$user_id"}, "sortBy": {"ts": 1}, "output": {"x": {"$locf": "$v"}}}}, keep("event_id", "x")], "WITH h AS (SELECT *, CASE WHEN event_id % 3 = 0 THEN value END AS v FROM events) SELECT event_id, last_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS x FROM h")
_LINEAR = """WITH h AS (SELECT *, CASE WHEN event_id % 3 = 0 THEN value END AS v, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS i FROM events),
b AS (SELECT *, last_value(v IGNORE NULLS) OVER p AS v0, last_value(CASE WHEN v IS NOT NULL THEN i END IGNORE NULLS) OVER p AS i0,
 first_value(v IGNORE NULLS) OVER n AS v1, first_value(CASE WHEN v IS NOT NULL THEN i END IGNORE NULLS) OVER n AS i1
 FROM h WINDOW p AS (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING), n AS (PARTITION BY user_id ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT event_id, round(coalesce(v, v0 + (v1 - v0) * (i - i0) / nullif(i1 - i0, 0)), 6) AS x FROM b"""
add("q_win_linearfill", "events", [_HOLES, {"$setWindowFields": {"partitionBy": {"u": "$user_id"}, "sortBy": {"ts": 1}, "output": {"x": {"$linearFill": "$v"}}}}, keep("event_id", x={"$round": ["$x", 6]})], _LINEAR)
add("q_fill", "events", [_HOLES, {"$fill": {"partitionBy": {"u": "$user_id"}, "sortBy": {"ts": 1}, "output": {"v": {"method": "linear"}}}}, keep("event_id", x={"$round": ["$v", 6]})], _LINEAR)
add("q_fill_value", "events", [_HOLES, {"$fill": {"output": {"v": {"value": -1.0}}}}, keep("event_id", "v")], "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN value ELSE -1.0 END AS v FROM events")
add("q_win_ema", "events", [{"$setWindowFields": {"partitionBy": {"u": "$user_id"}, "sortBy": {"ts": 1}, "output": {"x": {"$expMovingAvg": {"input": "$value", "N": 4}}}}}, keep("event_id", x={"$round": ["$x", 5]})], "WITH RECURSIVE n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS i FROM events), r AS (SELECT event_id, user_id, i, value AS x FROM n WHERE i = 1 UNION ALL SELECT n.event_id, n.user_id, n.i, n.value * 0.4::DOUBLE + r.x * 0.6::DOUBLE FROM r JOIN n ON n.user_id = r.user_id AND n.i = r.i + 1) SELECT event_id, round(x, 5) AS x FROM r")
add("q_densify", "events", [{"$match": {"user_id": {"$lt": 3}}}, {"$group": {"_id": {"$dateFromParts": {"year": {"$year": "$ts"}, "month": {"$month": "$ts"}, "day": {"$dayOfMonth": "$ts"}}}, "n": {"$sum": 1}}}, {"$project": {"_id": 0, "day": "$_id", "n": 1}}, {"$densify": {"field": "day", "range": {"step": 1, "unit": "day", "bounds": "full"}}}], "WITH d AS (SELECT date_trunc('day', ts)::TIMESTAMP AS day, count(*) AS n FROM events WHERE user_id < 3 GROUP BY 1) SELECT g.day, d.n FROM (SELECT unnest(generate_series((SELECT min(day) FROM d), (SELECT max(day) FROM d), INTERVAL 1 DAY)) AS day) g LEFT JOIN d ON g.day = d.day")
add("q_densify_whole", "events", [{"$group": {"_id": {"$dateFromParts": {"year": {"$year": "$ts"}, "month": {"$month": "$ts"}, "day": {"$dayOfMonth": "$ts"}}}, "n": {"$sum": 1}}}, {"$project": {"_id": 0, "day": "$_id", "n": 1}}, {"$densify": {"field": "day", "range": {"step": 1, "unit": "day", "bounds": "full"}}}], "WITH d AS (SELECT date_trunc('day', ts)::TIMESTAMP AS day, count(*) AS n FROM events GROUP BY 1) SELECT g.day, d.n FROM (SELECT unnest(generate_series((SELECT min(day) FROM d), (SELECT max(day) FROM d), INTERVAL 1 DAY)) AS day) g LEFT JOIN d ON g.day = d.day")

# --- expressions ---


def expr(name: str, collection: str, key: str, fields: dict, sql: str) -> None:
    add(name, collection, [{"$project": {"_id": 0, key: 1, **fields}}], f"SELECT {key}, {sql} FROM {collection}")


expr("q_arith", "orders", "o_orderkey", {"a": {"$add": ["$o_orderkey", 2, "$o_custkey"]}, "b": {"$subtract": ["$o_orderkey", "$o_custkey"]}, "c": {"$divide": ["$o_totalprice", {"$mod": ["$o_orderkey", 3]}]}, "d": {"$abs": {"$subtract": ["$o_custkey", "$o_orderkey"]}}, "e": {"$mod": ["$o_orderkey", 7]}, "f": {"$pow": [{"$mod": ["$o_orderkey", 5]}, 3]}, "g": {"$round": [{"$sqrt": "$o_orderkey"}, 6]}}, "o_orderkey + 2 + o_custkey AS a, o_orderkey - o_custkey AS b, o_totalprice / (o_orderkey % 3)::DOUBLE AS c, abs(o_custkey - o_orderkey) AS d, o_orderkey % 7 AS e, pow(o_orderkey % 5, 3) AS f, round(sqrt(o_orderkey), 6) AS g")
expr("q_round", "orders", "o_orderkey", {"c": {"$ceil": "$o_totalprice"}, "f": {"$floor": "$o_totalprice"}, "t": {"$trunc": "$o_totalprice"}, "r": {"$round": ["$o_totalprice", 0]}}, "ceil(o_totalprice) AS c, floor(o_totalprice) AS f, trunc(o_totalprice) AS t, round_even(o_totalprice, 0) AS r")
expr("q_log", "orders", "o_orderkey", {"l": {"$round": [{"$ln": {"$add": ["$o_orderkey", 1]}}, 8]}, "m": {"$round": [{"$log10": {"$add": ["$o_orderkey", 1]}}, 8]}, "n": {"$round": [{"$log": [{"$add": ["$o_orderkey", 1]}, 3]}, 8]}, "e": {"$round": [{"$exp": {"$mod": ["$o_orderkey", 5]}}, 6]}}, "round(ln(o_orderkey + 1), 8) AS l, round(log10(o_orderkey + 1), 8) AS m, round(ln(o_orderkey + 1) / ln(3), 8) AS n, round(exp(o_orderkey % 5), 6) AS e")
expr("q_trig", "orders", "o_orderkey", {k: {"$round": [{f"${k}": "$o_custkey"}, 8]} for k in ("sin", "cos", "atan", "asinh")} | {"h": {"$round": [{"$tanh": {"$divide": ["$o_custkey", 1000]}}, 8]}, "d": {"$round": [{"$degreesToRadians": "$o_custkey"}, 8]}, "g": {"$round": [{"$radiansToDegrees": "$o_custkey"}, 6]}, "a2": {"$round": [{"$atan2": ["$o_custkey", 7]}, 8]}, "as": {"$round": [{"$asin": {"$divide": [{"$mod": ["$o_custkey", 10]}, 10]}}, 8]}}, "round(sin(o_custkey), 8) AS sin, round(cos(o_custkey), 8) AS cos, round(atan(o_custkey), 8) AS atan, round(asinh(o_custkey), 8) AS asinh, round(tanh(o_custkey / 1000.0), 8) AS h, round(radians(o_custkey), 8) AS d, round(degrees(o_custkey), 6) AS g, round(atan2(o_custkey, 7), 8) AS a2, round(asin((o_custkey % 10) / 10.0), 8) AS \"as\"")
expr("q_strings", "part", "p_partkey", {"u": {"$toUpper": "$p_name"}, "l": {"$toLower": "$p_type"}, "s": {"$substrCP": ["$p_name", 2, 5]}, "n": {"$strLenCP": "$p_name"}, "i": {"$indexOfCP": ["$p_type", "E"]}, "c": {"$concat": ["$p_brand", "/", "$p_type"]}, "t": {"$trim": {"input": {"$concat": ["  ", "$p_brand", " "]}}}, "k": {"$strcasecmp": ["$p_brand", "brand#3"]}}, "upper(p_name) AS u, lower(p_type) AS l, substr(p_name, 3, 5) AS s, length(p_name) AS n, instr(p_type, 'E') - 1 AS i, p_brand || '/' || p_type AS c, p_brand AS t, CASE WHEN lower(p_brand) < 'brand#3' THEN -1 WHEN lower(p_brand) > 'brand#3' THEN 1 ELSE 0 END::BIGINT AS k")
expr("q_bytes", "documents", "doc_id", {"b": {"$strLenBytes": "$text"}, "i": {"$indexOfBytes": ["$text", "en"]}, "s": {"$substrBytes": ["$lang", 0, 1]}}, "octet_length(encode(text)) AS b, CASE WHEN instr(text, 'en') > 0 THEN octet_length(encode(substr(text, 1, instr(text, 'en') - 1))) ELSE -1 END AS i, substr(lang, 1, 1) AS s")
expr("q_split", "part", "p_partkey", {"a": {"$arrayElemAt": [{"$split": ["$p_type", " "]}, 0]}, "n": {"$size": {"$split": ["$p_type", " "]}}}, "string_split(p_type, ' ')[1] AS a, len(string_split(p_type, ' ')) AS n")
expr("q_replace", "part", "p_partkey", {"a": {"$replaceAll": {"input": "$p_type", "find": "E", "replacement": "__"}}, "o": {"$replaceOne": {"input": "$p_type", "find": "E", "replacement": "_"}}}, "replace(p_type, 'E', '__') AS a, CASE WHEN instr(p_type, 'E') > 0 THEN substr(p_type, 1, instr(p_type, 'E') - 1) || '_' || substr(p_type, instr(p_type, 'E') + 1) ELSE p_type END AS o")
expr("q_regexfind", "part", "p_partkey", {"m": {"$regexMatch": {"input": "$p_type", "regex": "S[A-Z]+L"}}, "f": {"$getField": {"field": "match", "input": {"$regexFind": {"input": "$p_type", "regex": "[A-Z]+$"}}}}, "n": {"$size": {"$regexFindAll": {"input": "$p_type", "regex": "[AEIOU]"}}}}, "regexp_matches(p_type, 'S[A-Z]+L') AS m, regexp_extract(p_type, '[A-Z]+$') AS f, len(regexp_extract_all(p_type, '[AEIOU]')) AS n")
expr("q_dates", "orders", "o_orderkey", {"y": {"$year": "$o_orderdate"}, "m": {"$month": "$o_orderdate"}, "d": {"$dayOfMonth": "$o_orderdate"}, "w": {"$dayOfWeek": "$o_orderdate"}, "j": {"$dayOfYear": "$o_orderdate"}, "h": {"$hour": "$o_orderdate"}, "n": {"$minute": "$o_orderdate"}, "s": {"$second": "$o_orderdate"}, "ms": {"$millisecond": "$o_orderdate"}}, "year(o_orderdate) AS y, month(o_orderdate) AS m, day(o_orderdate) AS d, dayofweek(o_orderdate) + 1 AS w, dayofyear(o_orderdate) AS j, hour(o_orderdate) AS h, minute(o_orderdate) AS n, second(o_orderdate) AS s, epoch_ms(o_orderdate) % 1000 AS ms")
expr("q_iso", "orders", "o_orderkey", {"w": {"$isoWeek": "$o_orderdate"}, "y": {"$isoWeekYear": "$o_orderdate"}, "d": {"$isoDayOfWeek": "$o_orderdate"}, "u": {"$week": "$o_orderdate"}}, "weekofyear(o_orderdate) AS w, isoyear(o_orderdate) AS y, isodow(o_orderdate) AS d, (dayofyear(o_orderdate) - 1 + dayofweek(date_trunc('year', o_orderdate))) // 7 AS u")
expr("q_datediff", "orders", "o_orderkey", {k: {"$dateDiff": {"startDate": D(1994, 3, 15), "endDate": "$o_orderdate", "unit": k}} for k in ("year", "quarter", "month", "week", "day", "hour")}, "year(o_orderdate) - 1994 AS year, (year(o_orderdate) - 1994) * 4 + quarter(o_orderdate) - 1 AS quarter, (year(o_orderdate) - 1994) * 12 + month(o_orderdate) - 3 AS month, floor((epoch_ms(o_orderdate) - epoch_ms(TIMESTAMP '1994-03-15')) / 604800000.0)::BIGINT AS week, floor((epoch_ms(o_orderdate) - epoch_ms(TIMESTAMP '1994-03-15')) / 86400000.0)::BIGINT AS day, floor((epoch_ms(o_orderdate) - epoch_ms(TIMESTAMP '1994-03-15')) / 3600000.0)::BIGINT AS hour")
expr("q_dateadd", "orders", "o_orderkey", {"a": {"$dateAdd": {"startDate": "$o_orderdate", "unit": "day", "amount": 45}}, "b": {"$dateSubtract": {"startDate": "$o_orderdate", "unit": "hour", "amount": 30}}, "c": {"$dateAdd": {"startDate": "$o_orderdate", "unit": "month", "amount": 1}}}, "o_orderdate + INTERVAL 45 DAY AS a, o_orderdate - INTERVAL 30 HOUR AS b, date_trunc('month', o_orderdate) + INTERVAL 1 MONTH + (o_orderdate - date_trunc('month', o_orderdate)) AS c")
expr("q_dateparts", "orders", "o_orderkey", {"m": {"$getField": {"field": "month", "input": {"$dateToParts": {"date": "$o_orderdate"}}}}, "f": {"$dateFromParts": {"year": {"$year": "$o_orderdate"}, "month": 14, "day": {"$dayOfMonth": "$o_orderdate"}}}, "s": {"$dateFromString": {"dateString": "1995-06-07T08:09:10Z"}}}, "month(o_orderdate) AS m, make_timestamp(year(o_orderdate) + 1, 2, 1, 0, 0, 0) + to_days(CAST(day(o_orderdate) - 1 AS INTEGER)) AS f, TIMESTAMP '1995-06-07 08:09:10' AS s")
expr("q_datetostring", "orders", "o_orderkey", {"a": {"$dateToString": {"date": "$o_orderdate", "format": "%Y/%m/%d %H:%M:%S"}}, "b": {"$dateToString": {"date": "$o_orderdate"}}, "j": {"$dateToString": {"date": "$o_orderdate", "format": "%j-%w"}}}, "strftime(o_orderdate, '%Y/%m/%d %H:%M:%S') AS a, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.') || strftime(o_orderdate, '%g') || 'Z' AS b, strftime(o_orderdate, '%j-') || (dayofweek(o_orderdate) + 1) AS j")
expr("q_convert", "orders", "o_orderkey", {"s": {"$toString": "$o_orderkey"}, "i": {"$toInt": "$o_totalprice"}, "d": {"$toDouble": {"$substrCP": ["$o_orderpriority", 0, 1]}}, "b": {"$toBool": {"$mod": ["$o_orderkey", 2]}}, "c": {"$convert": {"input": "$o_orderpriority", "to": "double", "onError": -1.0}}, "e": {"$convert": {"input": "$o_orderstatus", "to": "int", "onError": -7}}, "t": {"$toDate": {"$multiply": ["$o_orderkey", 1000]}}, "g": {"$toLong": "$o_custkey"}}, "o_orderkey::VARCHAR AS s, trunc(o_totalprice)::BIGINT AS i, substr(o_orderpriority, 1, 1)::DOUBLE AS d, o_orderkey % 2 <> 0 AS b, substr(o_orderpriority, 1, 1)::DOUBLE AS c, -7::BIGINT AS e, make_timestamp(o_orderkey * 1000000) AS t, o_custkey AS g")
expr("q_cond", "orders", "o_orderkey", {"c": {"$cond": [{"$gt": ["$o_totalprice", 100000]}, "big", "small"]}, "n": {"$ifNull": [{"$cond": [{"$eq": ["$o_orderstatus", "F"]}, None, "$o_custkey"]}, -1]}, "s": {"$switch": {"branches": [{"case": {"$lt": ["$o_totalprice", 1000]}, "then": 1}, {"case": {"$lt": ["$o_totalprice", 50000]}, "then": 2}], "default": 3}}, "m": {"$cmp": ["$o_custkey", "$o_orderkey"]}, "a": {"$and": ["$o_orderkey", {"$not": [{"$eq": ["$o_orderstatus", "O"]}]}]}, "o": {"$or": [{"$eq": ["$o_orderstatus", "F"]}, {"$mod": ["$o_orderkey", 2]}]}}, "CASE WHEN o_totalprice > 100000 THEN 'big' ELSE 'small' END AS c, CASE WHEN o_orderstatus = 'F' THEN -1 ELSE o_custkey END AS n, CASE WHEN o_totalprice < 1000 THEN 1 WHEN o_totalprice < 50000 THEN 2 ELSE 3 END::BIGINT AS s, sign(o_custkey - o_orderkey)::BIGINT AS m, o_orderkey <> 0 AND o_orderstatus <> 'O' AS a, o_orderstatus = 'F' OR o_orderkey % 2 <> 0 AS o")
expr("q_let", "orders", "o_orderkey", {"x": {"$let": {"vars": {"a": "$o_custkey", "b": {"$mod": ["$o_orderkey", 10]}}, "in": {"$add": ["$$a", {"$multiply": ["$$b", 2]}]}}}, "l": {"$literal": "$notafield"}}, "o_custkey + (o_orderkey % 10) * 2 AS x, '$notafield' AS l")
_E = "$embedding"
expr("q_arrays", "embeddings", "vec_id", {"n": {"$size": _E}, "f": {"$first": _E}, "l": {"$last": _E}, "e": {"$arrayElemAt": [_E, -2]}, "s": {"$size": {"$slice": [_E, -5]}}, "r": {"$first": {"$reverseArray": _E}}, "i": {"$indexOfArray": [{"$range": [0, 20, 2]}, {"$mod": ["$vec_id", 20]}]}, "in": {"$in": ["$label", [1, 3]]}, "c": {"$size": {"$concatArrays": [_E, [1, 2]]}}, "a": {"$isArray": _E}}, "len(embedding) AS n, embedding[1] AS f, embedding[64] AS l, embedding[63] AS e, 5::BIGINT AS s, embedding[64] AS r, coalesce(list_position(range(0, 20, 2), vec_id % 20), 0) - 1 AS i, label IN (1, 3) AS \"in\", 66::BIGINT AS c, true AS a")
expr("q_arrayfn", "embeddings", "vec_id", {"f": {"$size": {"$filter": {"input": _E, "as": "x", "cond": {"$gt": ["$$x", 0]}}}}, "m": {"$arrayElemAt": [{"$map": {"input": {"$range": [0, 5]}, "as": "i", "in": {"$multiply": ["$$i", "$vec_id"]}}}, 3]}, "r": {"$reduce": {"input": {"$range": [1, 6]}, "initialValue": "$vec_id", "in": {"$add": ["$$value", "$$this"]}}}, "t": {"$allElementsTrue": [[1, "$label"]]}, "u": {"$anyElementTrue": [[0, "$label"]]}}, "len(list_filter(embedding, lambda x: x > 0)) AS f, vec_id * 3 AS m, vec_id + 15 AS r, label <> 0 AS t, label <> 0 AS u")
_A, _B = {"$range": [0, {"$mod": ["$o_orderkey", 6]}]}, {"$range": [2, 5]}
expr("q_sets", "orders", "o_orderkey", {"u": {"$size": {"$setUnion": [_A, _B]}}, "i": {"$size": {"$setIntersection": [_A, _B]}}, "d": {"$size": {"$setDifference": [_A, _B]}}, "e": {"$setEquals": [_A, [0, 1, 2]]}, "s": {"$setIsSubset": [[0, 1], _A]}}, "len(list_distinct(list_concat(range(o_orderkey % 6), range(2, 5)))) AS u, len(list_intersect(range(o_orderkey % 6), range(2, 5))) AS i, len(list_filter(range(o_orderkey % 6), lambda x: x NOT IN (2, 3, 4))) AS d, o_orderkey % 6 = 3 AS e, o_orderkey % 6 >= 2 AS s")
expr("q_zip", "orders", "o_orderkey", {"n": {"$size": {"$zip": {"inputs": [_A, _B]}}}, "m": {"$size": {"$zip": {"inputs": [_A, _B], "useLongestLength": True}}}}, "least(o_orderkey % 6, 3) AS n, greatest(o_orderkey % 6, 3) AS m")
expr("q_sortarray", "embeddings", "vec_id", {"lo": {"$first": {"$sortArray": {"input": _E, "sortBy": 1}}}, "hi": {"$first": {"$sortArray": {"input": _E, "sortBy": -1}}}}, "list_min(embedding) AS lo, list_max(embedding) AS hi")
expr("q_nops", "embeddings", "vec_id", {"a": {"$last": {"$firstN": {"n": 3, "input": _E}}}, "b": {"$first": {"$lastN": {"n": 3, "input": _E}}}, "c": {"$last": {"$minN": {"n": 2, "input": _E}}}, "d": {"$last": {"$maxN": {"n": 2, "input": _E}}}}, "embedding[3] AS a, embedding[62] AS b, list_sort(embedding)[2] AS c, list_reverse_sort(embedding)[2] AS d")
_O = {"a": "$o_orderkey", "b": "$o_custkey"}
expr("q_objects", "orders", "o_orderkey", {"n": {"$size": {"$objectToArray": _O}}, "m": {"$getField": {"field": "b", "input": {"$mergeObjects": [_O, {"b": 9}]}}}, "s": {"$getField": {"field": "c", "input": {"$setField": {"field": "c", "input": _O, "value": "$o_custkey"}}}}, "k": {"$getField": {"field": "x", "input": {"$arrayToObject": [[["x", "$o_custkey"], ["y", 2]]]}}}, "t": {"$type": "$o_orderstatus"}, "i": {"$isNumber": "$o_orderkey"}}, "2::BIGINT AS n, 9::BIGINT AS m, o_custkey AS s, o_custkey AS k, 'string' AS t, true AS i")

_SMALL = {"$divide": [{"$mod": ["$o_custkey", 1000]}, 1001]}
expr("q_trig_more", "orders", "o_orderkey", {k: {"$round": [{f"${k}": _SMALL}, 8]} for k in ("tan", "acos", "sinh", "cosh", "atanh")} | {"acosh": {"$round": [{"$acosh": {"$add": [1, _SMALL]}}, 8]}}, ", ".join(f"round({k}((o_custkey % 1000) / 1001.0::DOUBLE), 8) AS {k}" for k in ("tan", "acos", "sinh", "cosh", "atanh")) + ", round(acosh(1 + (o_custkey % 1000) / 1001.0::DOUBLE), 8) AS acosh")
expr("q_trims", "part", "p_partkey", {"l": {"$ltrim": {"input": {"$concat": ["  ", "$p_brand", " "]}}}, "r": {"$rtrim": {"input": {"$concat": [" ", "$p_brand", "  "]}}}, "lc": {"$ltrim": {"input": "$p_name", "chars": "sremd"}}, "rc": {"$rtrim": {"input": "$p_name", "chars": "gnit"}}}, "p_brand || ' ' AS l, ' ' || p_brand AS r, ltrim(p_name, 'sremd') AS lc, rtrim(p_name, 'gnit') AS rc")
expr("q_convert_more", "orders", "o_orderkey", {"d": {"$toDouble": {"$toDecimal": "$o_totalprice"}}, "o": {"$toString": {"$toObjectId": {"$concat": ["00000000000000000", {"$substrCP": [{"$toString": {"$add": ["$o_orderkey", 1000000]}}, 0, 7]}]}}}}, "o_totalprice AS d, '00000000000000000' || substr((o_orderkey + 1000000)::VARCHAR, 1, 7) AS o")
expr("q_rand", "orders", "o_orderkey", {"ok": {"$let": {"vars": {"r": {"$rand": {}}}, "in": {"$and": [{"$gte": ["$$r", 0]}, {"$lt": ["$$r", 1]}]}}}}, "true AS ok")
_PIECE = {"$substrCP": ["$o_orderpriority", 0, {"$add": [1, {"$mod": ["$o_orderkey", 4]}]}]}
_PIECE_SQL = "substr(o_orderpriority, 1, CAST(o_orderkey % 4 + 1 AS INTEGER))"
add("q_push_desc_string", "orders", [{"$addFields": {"p": _PIECE}}, {"$sort": {"p": -1, "o_orderkey": 1}}, {"$group": {"_id": "$o_custkey", "ps": {"$push": "$p"}, "first": {"$first": "$p"}, "last": {"$last": "$p"}}}, {"$project": {"_id": 0, "cust": "$_id", "first": 1, "last": 1, "ps": {"$reduce": {"input": "$ps", "initialValue": "", "in": {"$concat": ["$$value", ",", "$$this"]}}}}}], f"SELECT o_custkey AS cust, max({_PIECE_SQL}) AS first, min({_PIECE_SQL}) AS last, string_agg(',' || {_PIECE_SQL}, '' ORDER BY {_PIECE_SQL} DESC) AS ps FROM orders GROUP BY ALL")
add("q_first_desc_nulls", "orders", [{"$addFields": {"p": {"$cond": [{"$eq": ["$o_orderstatus", "F"]}, None, _PIECE]}, "n": {"$cond": [{"$eq": ["$o_orderstatus", "O"]}, None, "$o_totalprice"]}}}, {"$sort": {"p": -1, "n": -1, "o_orderkey": -1}}, {"$group": {"_id": "$o_custkey", "first": {"$first": "$o_orderkey"}, "last": {"$last": "$o_orderkey"}}}, {"$project": {"_id": 0, "cust": "$_id", "first": 1, "last": 1}}], f"SELECT o_custkey AS cust, first(o_orderkey ORDER BY p DESC NULLS LAST, n DESC NULLS LAST, o_orderkey DESC) AS first, last(o_orderkey ORDER BY p DESC NULLS LAST, n DESC NULLS LAST, o_orderkey DESC) AS last FROM (SELECT *, CASE WHEN o_orderstatus <> 'F' THEN {_PIECE_SQL} END AS p, CASE WHEN o_orderstatus <> 'O' THEN o_totalprice END AS n FROM orders) GROUP BY ALL")
add("q_lookup_desc_string", "customer", [{"$lookup": {"from": "orders", "let": {"c": "$c_custkey"}, "pipeline": [{"$match": {"$expr": {"$eq": ["$o_custkey", "$$c"]}}}, {"$project": {"_id": 0, "o_orderkey": 1, "p": _PIECE}}, {"$sort": {"p": -1, "o_orderkey": -1}}, {"$limit": 2}], "as": "top"}}, {"$unwind": "$top"}, {"$project": {"_id": 0, "c_custkey": 1, "key": "$top.o_orderkey"}}], f"SELECT o_custkey AS c_custkey, o_orderkey AS key FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY {_PIECE_SQL} DESC, o_orderkey DESC) <= 2")
add("q_match_all_words", "part", [{"$addFields": {"words": {"$split": ["$p_name", " "]}}}, {"$match": {"words": {"$all": ["red", "bolt"]}}}, keep("p_partkey")], "SELECT p_partkey FROM part WHERE list_contains(string_split(p_name, ' '), 'red') AND list_contains(string_split(p_name, ' '), 'bolt')")
add("q_match_jsonschema_arrays", "embeddings", [{"$match": {"$jsonSchema": {"properties": {"embedding": {"bsonType": "array", "minItems": 64, "maxItems": 64, "uniqueItems": True, "items": {"bsonType": "number", "maximum": 0.375}}}}}}, keep("vec_id")], "SELECT vec_id FROM embeddings WHERE len(embedding) = 64 AND list_max(embedding) <= 0.375::FLOAT AND len(list_distinct(embedding)) = 64")
add("q_sample_members", "orders", [{"$sample": {"size": 1000000000}}, keep("o_orderkey", "o_custkey")], "SELECT o_orderkey, o_custkey FROM orders")
add("q_ema_nulls", "events", [{"$addFields": {"v": {"$cond": [{"$lt": [{"$mod": ["$event_id", 11]}, 2]}, "$value", None]}}}, {"$setWindowFields": {"partitionBy": {"u": "$user_id"}, "sortBy": {"ts": 1}, "output": {"x": {"$expMovingAvg": {"input": "$v", "alpha": 0.9}}, "y": {"$expMovingAvg": {"input": "$v", "N": 40}}}}}, keep("event_id", x={"$round": ["$x", 5]}, y={"$round": ["$y", 5]})], """WITH RECURSIVE h AS (SELECT event_id, user_id, ts, CASE WHEN event_id % 11 < 2 THEN value END AS v FROM events),
n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS i FROM h WHERE v IS NOT NULL),
r AS (SELECT event_id, user_id, i, v AS x, v AS y FROM n WHERE i = 1 UNION ALL SELECT n.event_id, n.user_id, n.i, n.v * 0.9::DOUBLE + r.x * (1 - 0.9::DOUBLE), n.v * (2 / 41.0::DOUBLE) + r.y * (1 - 2 / 41.0::DOUBLE) FROM n JOIN r ON n.user_id = r.user_id AND n.i = r.i + 1)
SELECT h.event_id, round(last_value(r.x IGNORE NULLS) OVER w, 5) AS x, round(last_value(r.y IGNORE NULLS) OVER w, 5) AS y FROM h LEFT JOIN r ON h.event_id = r.event_id WINDOW w AS (PARTITION BY h.user_id ORDER BY ts ROWS UNBOUNDED PRECEDING)""")

# --- geo ---
_LOC = {"$addFields": {"loc": {"type": "Point", "coordinates": [{"$subtract": [{"$mod": ["$c_custkey", 360]}, 180]}, {"$subtract": [{"$mod": [{"$multiply": ["$c_custkey", 7]}, 170]}, 85]}]}}}
_XY = "SELECT c_custkey, (c_custkey % 360) - 180 AS x, ((c_custkey * 7) % 170) - 85 AS y FROM customer"
add("q_geo_box", "customer", [_LOC, {"$match": {"loc": {"$geoWithin": {"$box": [[-20, -10], [40, 30]]}}}}, keep("c_custkey")], f"SELECT c_custkey FROM ({_XY}) WHERE x BETWEEN -20 AND 40 AND y BETWEEN -10 AND 30")
_HAV = "2 * 6378100.0 * asin(sqrt(pow(sin(radians(20 - y) / 2), 2) + cos(radians(y)) * cos(radians(20)) * pow(sin(radians(10 - x) / 2), 2)))"
add("q_geo_sphere", "customer", [_LOC, {"$match": {"loc": {"$geoWithin": {"$centerSphere": [[10, 20], 0.6]}}}}, keep("c_custkey")], f"SELECT c_custkey FROM ({_XY}) WHERE {_HAV} <= 0.6 * 6378100")
add("q_geo_polygon", "customer", [_LOC, {"$match": {"loc": {"$geoWithin": {"$geometry": {"type": "Polygon", "coordinates": [[[0.5, 0.5], [60.5, 0.5], [60.5, 40.5], [0.5, 40.5], [0.5, 0.5]]]}}}}}, keep("c_custkey")], f"SELECT c_custkey FROM ({_XY}) WHERE x > 0.5 AND x < 60.5 AND y > 0.5 AND y < 40.5")
add("q_geo_intersects", "customer", [_LOC, {"$match": {"loc": {"$geoIntersects": {"$geometry": {"type": "LineString", "coordinates": [[-180, 0], [180, 0]]}}}}}, keep("c_custkey")], f"SELECT c_custkey FROM ({_XY}) WHERE y = 0")

add("q_geo_center", "customer", [_LOC, {"$match": {"loc": {"$geoWithin": {"$center": [[10, 20], 25.5]}}}}, keep("c_custkey")], f"SELECT c_custkey FROM ({_XY}) WHERE sqrt((x - 10) * (x - 10) + (y - 20) * (y - 20)) <= 25.5")
add("q_geo_triangle", "customer", [_LOC, {"$match": {"loc": {"$geoWithin": {"$polygon": [[-50.5, -40.25], [70.5, -40.25], [10.5, 60.75]]}}}}, keep("c_custkey")], f"SELECT c_custkey FROM ({_XY}) WHERE y > -40.25 AND (x + 50.5) * 101 > (y + 40.25) * 61 AND (70.5 - x) * 101 > (y + 40.25) * 60")
_HOLE = [[[0.5, 0.5], [60.5, 0.5], [60.5, 40.5], [0.5, 40.5], [0.5, 0.5]], [[10.5, 10.5], [30.5, 10.5], [30.5, 25.5], [10.5, 25.5], [10.5, 10.5]]]
_IN_HOLE = "x > 0.5 AND x < 60.5 AND y > 0.5 AND y < 40.5 AND NOT (x > 10.5 AND x < 30.5 AND y > 10.5 AND y < 25.5)"
add("q_geo_hole", "customer", [_LOC, {"$match": {"loc": {"$geoWithin": {"$geometry": {"type": "Polygon", "coordinates": _HOLE}}}}}, keep("c_custkey")], f"SELECT c_custkey FROM ({_XY}) WHERE {_IN_HOLE}")
add("q_geo_meets_area", "customer", [_LOC, {"$match": {"loc": {"$geoIntersects": {"$geometry": {"type": "MultiPolygon", "coordinates": [_HOLE, [[[-20, -20], [-10, -20], [-10, -10], [-20, -10], [-20, -20]]]]}}}}}, keep("c_custkey")], f"SELECT c_custkey FROM ({_XY}) WHERE ({_IN_HOLE}) OR (x BETWEEN -20 AND -10 AND y BETWEEN -20 AND -10)")
add("q_geo_lines", "customer", [{"$addFields": {"line": {"type": "LineString", "coordinates": [[{"$mod": ["$c_custkey", 50]}, -1.5], [{"$mod": ["$c_custkey", 50]}, 1.5]]}}}, {"$match": {"line": {"$geoIntersects": {"$geometry": {"type": "LineString", "coordinates": [[9.5, 0.25], [30.5, 0.25]]}}}}}, keep("c_custkey")], "SELECT c_custkey FROM customer WHERE c_custkey % 50 BETWEEN 10 AND 30")

# --- documents ---
add("q_documents", "", [{"$documents": [{"x": 1, "y": "a"}, {"x": 2, "y": None}, {"x": 3}]}, {"$match": {"y": None}}, keep("x")], "SELECT * FROM (VALUES (2::BIGINT), (3::BIGINT)) t(x)")
add("q_redact", "nation", [{"$addFields": {"in": {"key": "$n_regionkey", "v": "$n_name"}}}, {"$redact": {"$cond": [{"$eq": ["$key", 2]}, "$$PRUNE", "$$DESCEND"]}}, {"$project": {"_id": 0, "n_nationkey": 1, "v": "$in.v"}}], "SELECT n_nationkey, CASE WHEN n_regionkey <> 2 THEN n_name END AS v FROM nation")


def _runner(collection: str, pipeline: list) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        db = Engine(spark).from_parquet(sf_dir)
        return (db.collection(collection).aggregate(pipeline) if collection else db.aggregate(pipeline)).to_df()

    return run


def _find_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    coll = Engine(spark).from_parquet(sf_dir).collection("orders")
    return coll.find({"o_orderstatus": "O"}, {"o_orderkey": 1, "o_custkey": 1}).sort({"o_totalprice": -1, "o_orderkey": 1}).skip(10).limit(20).to_df()


def _distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Engine(spark).from_parquet(sf_dir).collection("orders").distinct_df("o_orderpriority", {"o_orderstatus": "F"})


# --- updates, sinks, text and near queries ---
_UPDATE = {"$set": {"flag": "x"}, "$inc": {"o_custkey": 5}, "$mul": {"o_totalprice": 2}, "$unset": {"o_orderpriority": ""}, "$min": {"o_orderkey": 500}}


def _update_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    coll = Engine(spark).from_parquet(sf_dir).collection("orders")
    return coll.updated_df({"o_orderstatus": "F"}, _UPDATE).drop("o_orderdate")


def _words(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = spark.read.parquet(f"{sf_dir}/part.parquet")
    return Engine(spark).from_frames({"p": parts}).collection("p").aggregate([{"$project": {"p_partkey": 1, "w": {"$split": ["$p_type", " "]}}}]).to_df()


def _update_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    coll = Engine(spark).from_frames({"p": _words(spark, sf_dir)}).collection("p")
    once = coll.updated_df({"w": "STEEL"}, {"$push": {"w": {"$each": ["ZZ", "AA"], "$sort": 1, "$slice": 3}}})
    twice = Engine(spark).from_frames({"p": once}).collection("p").updated_df({}, {"$addToSet": {"w": "AA"}, "$pull": {"w": "BRASS"}})
    return Engine(spark).from_frames({"p": twice}).collection("p").aggregate([{"$project": {"p_partkey": 1, "n": {"$size": "$w"}, "first": {"$first": "$w"}}}]).to_df()


def _update_positional(spark: SparkSession, sf_dir: str) -> DataFrame:
    coll = Engine(spark).from_frames({"p": _words(spark, sf_dir)}).collection("p")
    df = coll.updated_df({"w": "STEEL"}, {"$set": {"w.$": "IRON", "w.$[t]": "TALL"}}, [{"t": {"$regex": "^T"}}])
    return Engine(spark).from_frames({"p": df}).collection("p").aggregate([{"$project": {"p_partkey": 1, "iron": {"$in": ["IRON", "$w"]}, "tall": {"$size": {"$filter": {"input": "$w", "cond": {"$eq": ["$$this", "TALL"]}}}}}}]).to_df()


def _out_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored copy of some orders, into which changed and further ones are merged."""
    from uuid import uuid4

    from ..sources.scratch import shared_dir

    db = Engine(spark, f"{shared_dir(spark)}/suite-{uuid4().hex}").connect().db("d")
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    db.source.insert_frame(orders.selectExpr("o_orderkey AS _id", "o_custkey AS cust", "o_totalprice AS price"))
    db.source.aggregate([{"$match": {"cust": {"$lt": 100}}}, {"$out": "kept"}])
    db.source.aggregate([{"$match": {"cust": {"$gte": 50, "$lt": 150}}}, {"$project": {"price": {"$multiply": ["$price", 10]}}}, {"$merge": {"into": "kept"}}])
    return db.kept.aggregate([{"$project": {"_id": 0, "key": "$_id", "cust": 1, "price": 1}}]).to_df()


def _out_merge_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over all orders: closed ones are stored, changed others and open ones merged in."""
    from uuid import uuid4

    from ..sources.scratch import shared_dir

    db = Engine(spark, f"{shared_dir(spark)}/suite-{uuid4().hex}").connect().db("d")
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    db.source.insert_frame(orders.selectExpr("o_orderkey AS _id", "o_custkey AS cust", "o_totalprice AS price", "o_orderstatus AS status"))
    db.source.aggregate([{"$match": {"status": {"$ne": "O"}}}, {"$project": {"cust": 1, "price": 1}}, {"$out": "kept"}])
    db.source.aggregate([{"$match": {"status": {"$ne": "F"}}}, {"$project": {"price": {"$multiply": ["$price", 10]}}}, {"$merge": {"into": "kept"}}])
    return db.kept.aggregate([{"$project": {"_id": 0, "key": "$_id", "cust": 1, "price": 1}}]).to_df()


def _text(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    db = Engine(spark).from_frames({"d": docs}, {"d": [{"key": {"text": "text"}, "name": "text_text"}]})
    found = db.d.find({"$text": {"$search": "tion -worthless"}}, {"doc_id": 1, "score": {"$meta": "textScore"}}).to_df()
    return Engine(spark).from_frames({"f": found}).f.aggregate([{"$project": {"doc_id": 1, "score": {"$round": ["$score", 8]}}}]).to_df()


def _geo_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet")
    placed = Engine(spark).from_frames({"c": customers}).c.aggregate([_LOC]).to_df()
    db = Engine(spark).from_frames({"c": placed}, {"c": [{"key": {"loc": "2dsphere"}, "name": "loc_2dsphere"}]})
    near = {"$geoNear": {"near": {"type": "Point", "coordinates": [10, 20]}, "distanceField": "d", "maxDistance": 3_000_000, "distanceMultiplier": 0.001, "query": {"c_acctbal": {"$gt": 0}}}}
    return db.c.aggregate([near, {"$project": {"c_custkey": 1, "d": {"$round": ["$d", 3]}}}]).to_df()


WRITTEN: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    "q_update_fields": (_update_fields, "SELECT CASE WHEN o_orderstatus = 'F' THEN least(o_orderkey, 500) ELSE o_orderkey END AS o_orderkey, CASE WHEN o_orderstatus = 'F' THEN o_custkey + 5 ELSE o_custkey END AS o_custkey, o_orderstatus, CASE WHEN o_orderstatus = 'F' THEN o_totalprice * 2 ELSE o_totalprice END AS o_totalprice, CASE WHEN o_orderstatus <> 'F' THEN o_orderpriority END AS o_orderpriority, CASE WHEN o_orderstatus = 'F' THEN 'x' END AS flag FROM orders"),
    "q_update_arrays": (_update_arrays, "WITH a AS (SELECT p_partkey, string_split(p_type, ' ') AS w FROM part), b AS (SELECT p_partkey, CASE WHEN list_contains(w, 'STEEL') THEN list_sort(list_concat(w, ['ZZ', 'AA']))[1:3] ELSE w END AS w FROM a), c AS (SELECT p_partkey, list_filter(CASE WHEN list_contains(w, 'AA') THEN w ELSE list_append(w, 'AA') END, lambda x: x <> 'BRASS') AS w FROM b) SELECT p_partkey, len(w) AS n, w[1] AS first FROM c"),
    "q_update_positional": (_update_positional, "SELECT p_partkey, list_contains(string_split(p_type, ' '), 'STEEL') AS iron, CASE WHEN list_contains(string_split(p_type, ' '), 'STEEL') THEN len(list_filter(string_split(p_type, ' '), lambda x: x LIKE 'T%')) ELSE 0 END AS tall FROM part"),
    "q_out_merge": (_out_merge, "SELECT o_orderkey AS key, CASE WHEN o_custkey < 100 THEN o_custkey END AS cust, CASE WHEN o_custkey >= 50 THEN o_totalprice * 10 ELSE o_totalprice END AS price FROM orders WHERE o_custkey < 150"),
    "q_out_merge_whole": (_out_merge_whole, "SELECT o_orderkey AS key, CASE WHEN o_orderstatus <> 'O' THEN o_custkey END AS cust, CASE WHEN o_orderstatus <> 'F' THEN o_totalprice * 10 ELSE o_totalprice END AS price FROM orders"),
    "q_text": (_text, r"WITH w AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '[\s[:punct:]]+'), lambda x: x <> '') AS w FROM documents) SELECT doc_id, round(len(list_filter(w, lambda x: contains(x, 'tion'))) / sqrt(len(w)), 8) AS score FROM w WHERE len(list_filter(w, lambda x: contains(x, 'tion'))) > 0 AND len(list_filter(w, lambda x: contains(x, 'worthless'))) = 0"),
    "q_geo_near": (_geo_near, f"SELECT c_custkey, round({_HAV} / 1000, 3) AS d FROM (SELECT c_custkey, c_acctbal, (c_custkey % 360) - 180 AS x, ((c_custkey * 7) % 170) - 85 AS y FROM customer) WHERE {_HAV} <= 3000000 AND c_acctbal > 0"),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out = {name: _runner(collection, pipeline) for name, (collection, pipeline, _) in CATALOGUE.items()}
    return out | {"q_find_sort_page": _find_page, "q_distinct": _distinct} | {name: fn for name, (fn, _) in (WRITTEN | WRITES).items()}


def oracle_sql() -> dict[str, str]:
    out = {name: sql for name, (_, _, sql) in CATALOGUE.items() if sql}
    return out | {name: sql for name, (_, sql) in (WRITTEN | WRITES).items()} | {
        "q_find_sort_page": "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'O' ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 10",
        "q_distinct": "SELECT DISTINCT o_orderpriority AS value FROM orders WHERE o_orderstatus = 'F'",
    }
