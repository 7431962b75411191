"""Edge cases of expressions on literal documents."""

import datetime as dt

import pytest

from docpipe.errors import DocError

CASES = [
    ({"$divide": [1, 0]}, float("inf")),
    ({"$divide": [-1, 0]}, float("-inf")),
    ({"$add": [1, None]}, None),
    ({"$add": [1, 2.5]}, 3.5),
    ({"$mod": [-5, 3]}, -2),
    ({"$round": [2.5]}, 2.0),
    ({"$round": [1234, -2]}, 1200),
    ({"$trunc": [-7.8]}, -7.0),
    ({"$concat": ["a", None]}, None),
    ({"$toUpper": None}, ""),
    ({"$substrCP": ["hello", 1, 3]}, "ell"),
    ({"$split": ["a.b.c", "."]}, ["a", "b", "c"]),
    ({"$trim": {"input": "  x "}}, "x"),
    ({"$trim": {"input": "xxaxx", "chars": "x"}}, "a"),
    ({"$indexOfCP": ["cafe", "f"]}, 2),
    ({"$indexOfBytes": ["né!", "!"]}, 3),
    ({"$strLenBytes": "né"}, 3),
    ({"$replaceOne": {"input": "aaa", "find": "a", "replacement": "b"}}, "baa"),
    ({"$replaceAll": {"input": "a.a", "find": ".", "replacement": "-"}}, "a-a"),
    ({"$toString": 1.0}, "1"),
    ({"$toInt": "12abc"}, 12),
    ({"$toDouble": "3.5x"}, 3.5),
    ({"$toBool": "false"}, True),
    ({"$convert": {"input": "x", "to": "int", "onError": -1}}, -1),
    ({"$convert": {"input": None, "to": "int", "onNull": 7}}, 7),
    ({"$type": 1}, "double"),
    ({"$type": "$nothing"}, "missing"),
    ({"$isNumber": "a"}, False),
    ({"$cond": ["", 1, 2]}, 2),
    ({"$and": [""]}, True),
    ({"$ifNull": [None, "$nothing", 3]}, 3),
    ({"$cmp": [1, 2]}, -1),
    ({"$gt": [1, None]}, True),
    ({"$lt": ["a", 1]}, False),
    ({"$eq": [None, "$nothing"]}, True),
    ({"$let": {"vars": {"a": 2}, "in": {"$multiply": ["$$a", 3]}}}, 6),
    ({"$slice": [[1, 2, 3], -2]}, [2, 3]),
    ({"$slice": [[1, 2, 3], 1, 1]}, [2]),
    ({"$arrayElemAt": [[1, 2], 5]}, None),
    ({"$range": [0, 5, 2]}, [0, 2, 4]),
    ({"$range": [0, 0]}, []),
    ({"$range": [3, 0, -1]}, [3, 2, 1]),
    ({"$reduce": {"input": [1, 2], "initialValue": 0, "in": {"$add": ["$$value", {"$multiply": ["$$this", 1.5]}]}}}, 4.5),
    ({"$zip": {"inputs": [[1, 2], [3]], "useLongestLength": True, "defaults": [0, 9]}}, [[1, 3], [2, 9]]),
    ({"$setUnion": [[1, 2], [2, 3]]}, [1, 2, 3]),
    ({"$setEquals": [[1, 2, 2], [2, 1]]}, True),
    ({"$sortArray": {"input": [{"a": 2}, {"a": 1}], "sortBy": {"a": 1}}}, [{"a": 1}, {"a": 2}]),
    ({"$indexOfArray": [[1, 2, 3], 3]}, 2),
    ({"$maxN": {"n": 2, "input": [3, 1, 2]}}, [3, 2]),
    ({"$lastN": {"n": 5, "input": [3, 1]}}, [3, 1]),
    ({"$objectToArray": {"a": 1}}, [{"k": "a", "v": 1}]),
    ({"$arrayToObject": [[["a", 1], ["a", 2]]]}, {"a": 2}),
    ({"$mergeObjects": [{"a": 1}, {"b": 2}]}, {"a": 1, "b": 2}),
    ({"$setField": {"field": "a", "input": {"a": 1, "b": 2}, "value": "$$REMOVE"}}, {"b": 2}),
    ({"$dateAdd": {"startDate": dt.datetime(2024, 1, 31), "unit": "month", "amount": 1}}, dt.datetime(2024, 3, 2)),
    ({"$dateDiff": {"startDate": dt.datetime(2024, 1, 31), "endDate": dt.datetime(2024, 2, 1), "unit": "month"}}, 1),
    ({"$dateFromParts": {"year": 2024, "month": 14}}, dt.datetime(2025, 2, 1)),
    ({"$dateFromParts": {"isoWeekYear": 2020, "isoWeek": 53, "isoDayOfWeek": 5}}, dt.datetime(2021, 1, 1)),
    ({"$isoWeek": dt.datetime(2021, 1, 1)}, 53),
    ({"$week": dt.datetime(2023, 1, 1)}, 0),
    ({"$dateToString": {"date": dt.datetime(2024, 1, 2, 3, 4, 5), "format": "%Y%m%d %H:%M:%S.%L"}}, "20240102 03:04:05.000"),
    ({"$regexFind": {"input": "ab12", "regex": "([a-z])(\\d)"}}, {"match": "b1", "idx": 1, "captures": ["b", "1"]}),
    ({"$regexFindAll": {"input": "a1bb22", "regex": "[a-z]+(\\d+)"}}, [{"match": "a1", "idx": 0, "captures": ["1"]}, {"match": "bb22", "idx": 2, "captures": ["22"]}]),
    ({"$literal": "$a"}, "$a"),
    ("$a.b", 5),
    ("$arr.x", 1),
]


@pytest.mark.parametrize("case", range(len(CASES)))
def test_value(docs, case):
    expression, want = CASES[case]
    got = docs([{"a": {"b": 5}, "arr": [{"x": 1}, {"x": 2}]}], [{"$project": {"_id": 0, "v": expression}}])
    assert (got[0].get("v") if got else None) == want


ROUNDED = [
    ([2.5, 0], 2.0), ([-3.5, 0], -4.0), ([0.125, 2], 0.12), ([-0.375, 2], -0.38), ([250, -2], 200), ([250.0, -2], 200.0),
    ([2.675, 2], 2.68), ([-2.665, 2], -2.67), ([1.015, 2], 1.01), ([0.49999999999999994, 0], 0.0), ([{"$sqrt": 5075052}, 6], 2252.787607), ([{"$sqrt": 4101826}, 6], 2025.296522),
    ([1e300, 3], 1e300), ([123456789012345.67, 2], 123456789012345.67), ([1.5e-23, 30], 1.5e-23), ([float("-inf"), 2], float("-inf")), ([None, 2], None),
]


def test_rounding(docs):
    """Exact halves go to even; what is only spelled like a half, or comes to one by the product, does not."""
    names = [f"v{i}" for i in range(len(ROUNDED))]
    got = docs([{"a": 1}], [{"$project": {"_id": 0, **{n: {"$round": e} for n, (e, _) in zip(names, ROUNDED)}}}])
    assert [got[0].get(n) for n in names] == [want for _, want in ROUNDED]


@pytest.mark.parametrize("expression", [{"$ln": 0}, {"$sqrt": -1}, {"$mod": [1, 0]}, {"$size": "$a"}, {"$acos": 2}, {"$toInt": "x"}, {"$switch": {"branches": [{"case": False, "then": 1}]}}])
def test_data_errors(docs, expression):
    with pytest.raises(Exception):
        docs([{"a": 1}], [{"$project": {"v": expression}}])


@pytest.mark.parametrize("expression", [{"$nope": 1}, {"$add": ["a", 1]}, "$$undefined", {"$a": 1, "$b": 2}, {"$zip": {"inputs": [[1]], "defaults": [1]}}])
def test_compile_errors(docs, expression):
    with pytest.raises(DocError):
        docs([{"a": 1}], [{"$project": {"v": expression}}])


def test_all_names_are_known():
    from docpipe.functions import OPERATORS

    assert len(OPERATORS) >= 128
