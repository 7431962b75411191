"""Stages on literal documents, where SQL would say little."""

import pytest

from docpipe.errors import DocError

ROWS = [{"_id": 1, "g": "a", "x": 1}, {"_id": 2, "g": "a", "x": None}, {"_id": 3, "g": "b", "x": 5}]


def ids(out):
    return sorted(d["_id"] for d in out)


@pytest.mark.parametrize(
    "filter, want",
    [
        ({"x": None}, [2]), ({"nothing": None}, [1, 2, 3]), ({"x": {"$lt": 3}}, [1, 2]), ({"x": {"$ne": 1}}, [2, 3]), ({"x": {"$not": {"$gt": 2}}}, [1, 2]),
        ({"x": {"$in": [1, None]}}, [1, 2]), ({"x": {"$nin": [1]}}, [2, 3]), ({"$nor": [{"x": 1}]}, [2, 3]), ({"g": "a", "$comment": "c"}, [1, 2]),
        ({"$expr": {"$gt": ["$x", 2]}}, [3]), ({"x": {"$type": "null"}}, [2]), ({"x": {"$type": ["int", "null"]}}, [1, 2, 3]), ({"x": {"$exists": False}}, []), ({"y": {"$exists": False}}, [1, 2, 3]),
    ],
)
def test_match(docs, filter, want):
    assert ids(docs(ROWS, [{"$match": filter}])) == want


def test_match_arrays(docs):
    rows = [{"_id": 1, "t": ["a", "b"], "o": [{"k": 1, "v": 2}]}, {"_id": 2, "t": [], "o": [{"k": 1, "v": 9}, {"k": 3, "v": 2}]}]
    m = lambda f: ids(docs(rows, [{"$match": f}]))
    assert m({"t": "a"}) == [1]
    assert m({"t": ["a", "b"]}) == [1]
    assert m({"t": {"$size": 0}}) == [2]
    assert m({"t": {"$all": ["a", "b"]}}) == [1]
    assert m({"o.v": 2}) == [1, 2]
    assert m({"o": {"$elemMatch": {"k": 1, "v": 9}}}) == [2]
    assert m({"o.0.k": 1}) == [1, 2]
    assert m({"t": {"$gt": ""}}) == []


@pytest.mark.parametrize("filter", [{"$bad": 1}, {"x": {"$bad": 1}}, {"$or": []}, {"x": {"$in": 1}}, {"x": {"$mod": [0, 1]}}, {"$text": {"$search": "a"}}, {"x": {"$size": -1}}])
def test_bad_filters(docs, filter):
    with pytest.raises(DocError):
        docs(ROWS, [{"$match": filter}])


@pytest.mark.parametrize("stage", [{"$limit": 0}, {"$skip": -1}, {"$nope": 1}, {"$project": {}}, {"$project": {"a": 1, "b": 0}}, {"$unwind": "x"}, {"$count": "$n"}, {"$group": {"x": 1}}, {"$group": {"_id": 1, "x": 2}}, {"$group": {"_id": 1, "x": {"$nope": 1}}}, {"$unionWith": "c"}, {"$bucket": {"groupBy": "$x", "boundaries": [1]}}, {"$facet": {"a": [{"$facet": {}}]}}])
def test_bad_stages(docs, stage):
    with pytest.raises(DocError):
        docs(ROWS, [stage])


def test_empty_input(docs):
    assert docs(ROWS, [{"$match": {"x": 99}}, {"$count": "n"}]) == []
    assert docs(ROWS, [{"$match": {"x": 99}}, {"$group": {"_id": None, "n": {"$sum": 1}}}]) == []


def test_group_keeps_nulls(docs):
    out = docs(ROWS, [{"$sort": {"_id": 1}}, {"$group": {"_id": "$g", "p": {"$push": "$x"}, "s": {"$sum": "$x"}, "f": {"$first": "$x"}, "l": {"$last": "$x"}}}, {"$sort": {"_id": 1}}])
    assert out[0] == {"_id": "a", "p": [1, None], "s": 1, "f": 1, "l": None}


def test_unwind_modes(docs):
    rows = [{"_id": 1, "a": [1, 2]}, {"_id": 2, "a": []}, {"_id": 3, "a": None}]
    assert len(docs(rows, [{"$unwind": "$a"}])) == 2
    out = docs(rows, [{"$unwind": {"path": "$a", "preserveNullAndEmptyArrays": True, "includeArrayIndex": "i"}}])
    assert sorted((d["_id"], d["a"], d["i"]) for d in out if d["a"]) == [(1, 1, 0), (1, 2, 1)]
    assert sum(d["i"] is None for d in out) == 2


def test_nested_paths(docs):
    rows = [{"_id": 1, "a": {"b": 1, "c": 2}, "l": [{"x": 1, "y": 2}]}]
    assert docs(rows, [{"$project": {"a.b": 1}}]) == [{"_id": 1, "a": {"b": 1}}]
    assert docs(rows, [{"$project": {"a.b": 0, "l": 0}}]) == [{"_id": 1, "a": {"c": 2}}]
    assert docs(rows, [{"$set": {"a.d.e": "$a.b"}}])[0]["a"] == {"b": 1, "c": 2, "d": {"e": 1}}
    assert docs(rows, [{"$unset": "l.x"}])[0]["l"] == [{"y": 2}]
    assert docs(rows, [{"$replaceWith": "$a"}]) == [{"b": 1, "c": 2}]


def test_redact(docs):
    rows = [{"_id": 1, "level": 1, "in": {"level": 5, "v": 1}, "l": [{"level": 1, "v": 2}, {"level": 9, "v": 3}]}]
    out = docs(rows, [{"$redact": {"$cond": [{"$gt": ["$level", 3]}, "$$PRUNE", "$$DESCEND"]}}])
    assert out[0]["in"] is None and out[0]["l"] == [{"level": 1, "v": 2}]


def test_densify_numbers(docs):
    out = docs([{"x": 0, "g": 1}, {"x": 4, "g": 1}], [{"$densify": {"field": "x", "range": {"step": 2, "bounds": "full"}}}, {"$sort": {"x": 1}}])
    assert [d["x"] for d in out] == [0, 2, 4]
    out = docs([{"x": 1, "g": 1}], [{"$densify": {"field": "x", "partitionByFields": ["g"], "range": {"step": 1, "bounds": [0, 3]}}}])
    assert sorted(d["x"] for d in out) == [0, 1, 2]


def test_bucket_auto_and_facet(docs):
    rows = [{"x": i} for i in range(7)]
    out = docs(rows, [{"$bucketAuto": {"groupBy": "$x", "buckets": 3}}])
    assert [(d["_id"]["min"], d["_id"]["max"], d["count"]) for d in out] == [(0, 3, 3), (3, 6, 3), (6, 6, 1)]
    out = docs(rows, [{"$facet": {"a": [{"$match": {"x": {"$gt": 9}}}], "b": [{"$sort": {"x": -1}}, {"$limit": 2}]}}])
    assert out[0]["a"] == [] and [d["x"] for d in out[0]["b"]] == [6, 5]


def test_graph_lookup_cycle(db):
    db.people.insert_many([{"_id": 1, "boss": 2}, {"_id": 2, "boss": 3}, {"_id": 3, "boss": 1}])
    out = db.people.aggregate([{"$graphLookup": {"from": "people", "startWith": "$boss", "connectFromField": "boss", "connectToField": "_id", "as": "up", "depthField": "d"}}]).to_list()
    assert all(sorted(u["_id"] for u in d["up"]) == [1, 2, 3] for d in out)


def test_lookup_null_keys(db):
    db.a.insert_many([{"_id": 1, "k": None}, {"_id": 2, "k": 5}])
    db.b.insert_many([{"_id": 1, "j": None}, {"_id": 2, "j": 7}])
    out = db.a.aggregate([{"$lookup": {"from": "b", "localField": "k", "foreignField": "j", "as": "m"}}, {"$sort": {"_id": 1}}]).to_list()
    assert [len(d["m"]) for d in out] == [1, 0]


def test_window_gap_operators(docs):
    rows = [{"t": i, "v": v} for i, v in enumerate([1.0, None, None, 4.0, None])]
    out = docs(rows, [{"$setWindowFields": {"sortBy": {"t": 1}, "output": {"l": {"$locf": "$v"}, "f": {"$linearFill": "$v"}, "e": {"$expMovingAvg": {"input": "$v", "alpha": 0.5}}}}}, {"$sort": {"t": 1}}])
    assert [d["l"] for d in out] == [1, 1, 1, 4, 4]
    assert [d["f"] for d in out] == [1, 2, 3, 4, None]
    assert out[3]["e"] == 2.5


def test_plans(spark, small):
    from docpipe import Engine
    from docpipe.suite.queries import FLAGSHIP

    db = Engine(spark).from_parquet(small)

    def plan(collection, pipeline):
        return db.collection(collection).aggregate(pipeline).to_df()._jdf.queryExecution().optimizedPlan().toString()

    flagship = plan("lineitem", FLAGSHIP)
    assert flagship.count("Join Inner") == 2 and "collect_list" not in flagship and "Python" not in flagship
    look = {"$lookup": {"from": "orders", "localField": "c_custkey", "foreignField": "o_custkey", "as": "os"}}
    assert "LeftAnti" in plan("customer", [look, {"$match": {"os": []}}, {"$project": {"c_custkey": 1}}])
    assert "LeftSemi" in plan("customer", [look, {"$match": {"os": {"$ne": []}}}, {"$project": {"c_custkey": 1}}])


def test_filters_reach_the_scan(spark, small):
    from docpipe import Engine

    db = Engine(spark).from_parquet(small)

    def pushed(filter):
        df = db.lineitem.aggregate([{"$match": filter}, {"$project": {"l_orderkey": 1, "l_quantity": 1}}]).to_df()
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "l_comment" not in plan.split("ReadSchema")[1]
        return plan.split("PushedFilters: [")[1].split("]")[0]

    assert "GreaterThan(l_quantity,10.0)" in pushed({"l_quantity": {"$gt": 10}})
    assert "LessThan(l_quantity,3.0)" in pushed({"l_quantity": {"$lt": 3}})
    assert "EqualTo(l_returnflag,R)" in pushed({"l_returnflag": "R"})
    assert "In(l_linenumber, [1,3" in pushed({"l_linenumber": {"$in": [1, 3]}})
    assert "Not(EqualTo(l_returnflag,R))" in pushed({"l_returnflag": {"$ne": "R"}})


def test_geometry(docs):
    from docpipe.operators.geo import geometries_meet

    square = {"type": "Polygon", "coordinates": [[[0, 0], [4, 0], [4, 4], [0, 4], [0, 0]]]}
    assert geometries_meet({"type": "Point", "coordinates": [1, 1]}, square)
    assert not geometries_meet({"type": "Point", "coordinates": [5, 1]}, square)
    assert geometries_meet({"type": "LineString", "coordinates": [[-1, 2], [5, 2]]}, square)
    assert geometries_meet({"type": "Polygon", "coordinates": [[[1, 1], [2, 1], [2, 2], [1, 1]]]}, square)
    rows = [{"_id": 1, "p": [1, 1]}, {"_id": 2, "p": [9, 9]}]
    assert ids(docs(rows, [{"$match": {"p": {"$geoWithin": {"$center": [[0, 0], 2]}}}}])) == [1]
    assert ids(docs(rows, [{"$match": {"p": {"$geoIntersects": {"$geometry": square}}}}])) == [1]


def test_average_over_long_gaps(spark):
    """The average stays over any number of nulls, and reaches back over any number of values."""
    from docpipe import Engine

    for alpha in (2 / 3, 0.999, 1e-4, 1.0):
        rows = [(i, float(i % 17) if i % 60 in (0, 7) else None) for i in range(700)]
        df = spark.createDataFrame(rows, "t int, v double")
        got = Engine(spark).from_frames({"r": df}).r.aggregate([{"$setWindowFields": {"sortBy": {"t": 1}, "output": {"x": {"$expMovingAvg": {"input": "$v", "alpha": alpha}}}}}]).to_df()
        want, last = {}, None
        for t, v in rows:
            last = v if last is None else last if v is None else alpha * v + (1 - alpha) * last
            want[t] = last
        for r in got.collect():
            assert abs(r.x - want[r.t]) < 1e-9


def test_pushes_follow_descending_texts(docs):
    rows = [{"k": k} for k in ("b", "ab", "a", "", None, "abc", "é", "z")]
    got = docs(rows, [{"$sort": {"k": -1}}, {"$group": {"_id": None, "ks": {"$push": "$k"}, "first": {"$first": "$k"}, "last": {"$last": "$k"}}}])
    assert got[0]["ks"] == ["é", "z", "b", "abc", "ab", "a", "", None] and got[0]["first"] == "é" and got[0]["last"] is None
