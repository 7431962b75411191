"""Collections in JSON files."""

import datetime as dt
import json

from docpipe import Engine
from docpipe.sources.json_files import write_json


def test_extended_json(spark, tmp_path):
    rows = [
        {"_id": {"$oid": "a" * 24}, "at": {"$date": "2024-01-02T03:04:05.000Z"}, "l": [{"d": {"$date": "2024-01-01T00:00:00Z"}}], "n": 1},
        {"_id": {"$oid": "b" * 24}, "at": None, "n": 2.5},
    ]
    (tmp_path / "lines.json").write_text("\n".join(map(json.dumps, rows)))
    (tmp_path / "array.json").write_text(json.dumps(rows, indent=1))
    engine = Engine(spark)
    for name, lines in (("lines", True), ("array", False)):
        coll = engine.from_json(f"file://{tmp_path}", lines=lines).collection(name)
        got = coll.find({"at": {"$gt": dt.datetime(2024, 1, 1)}}).to_list()
        assert got[0]["_id"] == "a" * 24 and got[0]["at"] == dt.datetime(2024, 1, 2, 3, 4, 5)
        assert got[0]["l"] == [{"d": dt.datetime(2024, 1, 1)}] and coll.count_documents() == 2
    write_json(coll.frame(), f"file://{tmp_path}/out.json")
    assert sorted(d["n"] for d in engine.from_json(f"file://{tmp_path}").collection("out").find().to_list()) == [1.0, 2.5]
