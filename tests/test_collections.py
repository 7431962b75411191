"""Reads, writes, indexes and administration of stored collections."""

import pytest

from docpipe.errors import BadHint, BulkWriteError, CannotCreateIndex, DocError, DuplicateKey, IndexNotFound, NamespaceExists, NamespaceNotFound

ROWS = [{"_id": i, "n": i * 10, "tags": ["a", "b"] if i % 2 else ["c"], "in": {"k": i}} for i in range(1, 5)]


@pytest.fixture
def coll(db):
    db.things.insert_many(ROWS)
    return db.things


def test_find(coll):
    assert [d["_id"] for d in coll.find({"n": {"$gt": 10}}).sort({"n": -1}).skip(1).limit(2).to_list()] == [3, 2]
    assert coll.find_one({"_id": 2}, {"n": 1}) == {"_id": 2, "n": 20}
    assert coll.find_one({"_id": 9}) is None
    assert coll.find({"_id": 1}, {"tags": {"$slice": 1}, "_id": 1}).to_list() == [{"_id": 1, "tags": ["a"]}]
    assert [d["_id"] for d in coll.find().hint({"$natural": -1}).to_list()] == [4, 3, 2, 1]
    assert coll.count_documents({"tags": "a"}) == 2 and coll.estimated_document_count() == 4
    assert sorted(coll.distinct("tags")) == ["a", "b", "c"]
    with pytest.raises(BadHint):
        coll.find().hint("nope").to_list()


def test_updates(coll):
    r = coll.update_many({"n": {"$gte": 20}}, {"$inc": {"n": 1}, "$set": {"in.z": "x"}})
    assert (r["matched_count"], r["modified_count"]) == (3, 3)
    assert coll.find_one({"_id": 2}) == {"_id": 2, "n": 21, "tags": ["c"], "in": {"k": 2, "z": "x"}}
    r = coll.update_one({"tags": "c"}, {"$push": {"tags": {"$each": ["z", "y"], "$sort": 1, "$slice": -2}}})
    assert r["matched_count"] == 1 and coll.find_one({"_id": 2})["tags"] == ["y", "z"]
    coll.update_one({"_id": 1}, {"$addToSet": {"tags": "a"}, "$mul": {"n": 3}, "$min": {"in.k": -1}, "$rename": {"n": "m"}})
    got = coll.find_one({"_id": 1})
    assert got["tags"] == ["a", "b"] and got["m"] == 30 and got["in"]["k"] == -1
    coll.update_one({"_id": 1, "tags": "b"}, {"$set": {"tags.$": "B"}})
    assert coll.find_one({"_id": 1})["tags"] == ["a", "B"]
    coll.update_one({"_id": 1}, {"$set": {"tags.$[t]": "Q"}}, array_filters=[{"t": "a"}])
    assert coll.find_one({"_id": 1})["tags"] == ["Q", "B"]
    coll.update_one({"_id": 1}, {"$pull": {"tags": "Q"}})
    coll.update_one({"_id": 3}, {"$pop": {"tags": -1}})
    coll.update_one({"_id": 4}, {"$bit": {"bits": {"or": 5}}})
    assert coll.find_one({"_id": 1})["tags"] == ["B"] and coll.find_one({"_id": 3})["tags"] == ["b"] and coll.find_one({"_id": 4})["bits"] == 5
    assert coll.update_many({"_id": 1}, {"$set": {"tags": ["B"]}})["modified_count"] == 0
    for bad in ({}, {"n": 1}, {"$nope": {"a": 1}}, {"$inc": {"n": "x"}}, {"$pop": {"tags": 3}}):
        with pytest.raises(DocError):
            coll.update_one({"_id": 1}, bad)


def test_upsert_and_replace(coll):
    r = coll.update_one({"_id": 9, "kind": "new"}, {"$set": {"n": 1}, "$setOnInsert": {"first": True}}, upsert=True)
    assert r["upserted_id"] == 9 and coll.find_one({"_id": 9})["first"] is True
    coll.replace_one({"_id": 9}, {"n": 2})
    got = coll.find_one({"_id": 9})
    assert got["n"] == 2 and got["first"] is None
    assert coll.find_one_and_update({"_id": 9}, {"$inc": {"n": 5}}, return_document="after")["n"] == 7
    assert coll.find_one_and_delete({"_id": 9})["n"] == 7 and coll.count_documents({"_id": 9}) == 0
    assert coll.find_one_and_replace({"_id": 1}, {"n": 0})["n"] == 10
    assert coll.delete_one({"n": {"$gte": 0}})["deleted_count"] == 1 and coll.delete_many({})["deleted_count"] == 3


def test_unique_and_indexes(coll):
    with pytest.raises(DuplicateKey):
        coll.insert_one({"_id": 1})
    assert coll.create_index({"n": 1}, unique=True) == "n_1" == coll.create_index({"n": 1}, unique=True)
    with pytest.raises(DuplicateKey):
        coll.insert_one({"_id": 50, "n": 10})
    assert [i["name"] for i in coll.indexes()] == ["_id_", "n_1"]
    coll.drop_index("n_1")
    with pytest.raises(IndexNotFound):
        coll.drop_index("n_1")
    for keys, options in (({"a": 2}, {}), ({"a": 1, "b": 1}, {"expireAfterSeconds": 5}), ({"a": "hashed"}, {"unique": True}), ({}, {}), ({"a": 1}, {"sparse": True, "partialFilterExpression": {"a": 1}})):
        with pytest.raises(CannotCreateIndex):
            coll.create_index(keys, **options)


def test_bulk(coll):
    r = coll.bulk_write([{"insertOne": {"document": {"_id": 7}}}, {"updateMany": {"filter": {}, "update": {"$set": {"z": 1}}}}, {"deleteOne": {"filter": {"_id": 7}}}])
    assert (r["inserted_count"], r["modified_count"], r["deleted_count"]) == (1, 5, 1)
    with pytest.raises(BulkWriteError) as e:
        coll.bulk_write([{"insertOne": {"document": {"_id": 1}}}, {"insertOne": {"document": {"_id": 8}}}], ordered=False)
    assert e.value.result["inserted_count"] == 1


def test_text_and_near(db):
    db.t.insert_many([{"_id": 1, "c": "coffee and cake"}, {"_id": 2, "c": "coffee shop"}, {"_id": 3, "c": "tea"}])
    with pytest.raises(IndexNotFound):
        db.t.find({"$text": {"$search": "coffee"}}).to_list()
    db.t.create_index({"c": "text"})
    assert sorted(d["_id"] for d in db.t.find({"$text": {"$search": "coffee -cake"}}).to_list()) == [2]
    assert [d["_id"] for d in db.t.find({"$text": {"$search": '"coffee shop" tea'}}).to_list()] == [2]
    db.g.insert_many([{"_id": 1, "p": {"type": "Point", "coordinates": [0.0, 0.0]}}, {"_id": 2, "p": {"type": "Point", "coordinates": [1.0, 0.0]}}])
    with pytest.raises(IndexNotFound):
        db.g.find({"p": {"$near": [0, 0]}}).to_list()
    db.g.create_index({"p": "2dsphere"})
    near = {"p": {"$near": {"$geometry": {"type": "Point", "coordinates": [0.9, 0]}, "$maxDistance": 50_000}}}
    assert [d["_id"] for d in db.g.find(near).to_list()] == [2]
    out = db.g.aggregate([{"$geoNear": {"near": [0.9, 0], "distanceField": "d", "spherical": True}}]).to_list()
    assert [d["_id"] for d in out] == [2, 1] and out[0]["d"] < out[1]["d"]


def test_out_and_merge(coll, db):
    assert coll.aggregate([{"$match": {"n": {"$gt": 20}}}, {"$out": "big"}]).to_list() == []
    assert db.big.count_documents() == 2
    coll.aggregate([{"$project": {"n": 1, "m": {"$add": ["$n", 1]}}}, {"$merge": {"into": "big"}}])
    assert db.big.count_documents() == 4 and db.big.find_one({"_id": 3})["m"] == 31 and db.big.find_one({"_id": 3})["tags"] == ["a", "b"]
    coll.aggregate([{"$merge": {"into": "big", "whenMatched": [{"$set": {"was": "$n", "now": {"$add": ["$$new.n", 5]}}}], "whenNotMatched": "discard"}}])
    assert db.big.find_one({"_id": 4})["now"] == 45
    with pytest.raises(Exception):
        coll.aggregate([{"$merge": {"into": "big", "whenMatched": "fail"}}])


def test_administration(coll, db):
    assert [c["name"] for c in db.list_collections()] == ["things"]
    assert coll.stats()["count"] == 4 and db.stats()["objects"] == 4
    db.other.insert_one({"_id": 1})
    with pytest.raises(NamespaceExists):
        coll.rename("other")
    coll.rename("moved")
    assert db.collection("moved").count_documents() == 4
    with pytest.raises(NamespaceNotFound):
        db.collection("nowhere").rename("x")
    assert db.collection("moved").drop() and not db.collection("moved").drop()
    assert db.drop_database()


def test_writers_in_threads_lose_no_update(db):
    """Updates of shared documents from several threads, with reads between."""
    import threading

    db.n.insert_many([{"_id": i, "count": 0} for i in range(4)])
    errors = []

    def work(k):
        try:
            for i in range(3):
                db.n.update_one({"_id": (k + i) % 4}, {"$inc": {"count": 1}})
                assert db.n.count_documents({}) == 4
        except Exception as error:  # noqa: BLE001
            errors.append(error)

    threads = [threading.Thread(target=work, args=(k,)) for k in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not errors and sum(d["count"] for d in db.n.find().to_list()) == 12


def test_a_writer_that_comes_second_starts_again(spark, db):
    """Two processes are two catalogs that share no lock: the later pointer is refused, and the write repeated."""
    from docpipe import Engine
    from docpipe.sources import catalog as catalogs

    db.n.insert_many([{"_id": 1, "count": 0}])
    other = Engine(spark, db.engine.root).connect().db("test")
    raced = []
    real = catalogs.Catalog.save

    def save(self, name, state):
        if self is db.catalog and not raced:
            raced.append(1)
            saved, catalogs._locks = catalogs._locks, {}  # the other process knows nothing of this one's locks
            other.n.update_one({"_id": 1}, {"$inc": {"count": 10}})
            catalogs._locks = saved
        return real(self, name, state)

    catalogs.Catalog.save = save
    try:
        db.n.update_one({"_id": 1}, {"$inc": {"count": 1}})
    finally:
        catalogs.Catalog.save = real
    assert raced and db.n.find_one({"_id": 1})["count"] == 11
