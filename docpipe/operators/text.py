"""Text search: terms, phrases and exclusions over the indexed fields."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import IndexNotFound
from ..functions.core import Scope, path

#: Fixed value: what parts words, in search strings and in texts.
SEPARATORS = r"[\s\p{Punct}]+"
_PYTHON_SEPARATORS = re.compile(r"[\s!-/:-@\[-`{-~]+")


@dataclass
class Search:
    terms: list[str]
    phrases: list[str]
    excluded: list[str]


def parse_search(search: str, case_sensitive: bool = False) -> Search:
    s = search if case_sensitive else search.lower()
    phrases = re.findall(r'"([^"]+)"', s)
    rest = re.sub(r'"[^"]*"', " ", s).split()
    excluded = [w[1:] for w in rest if w.startswith("-") and len(w) > 1]
    terms = [t for w in rest if not w.startswith("-") for t in _PYTHON_SEPARATORS.split(w) if t]
    return Search(terms, phrases, excluded)


def score(fields: list[str] | None, spec: dict, scope: Scope) -> Column:
    """Hits of terms in words, phrases counting twice, over the root of the words.

    All phrases have to be there and no excluded word may be; else the score is 0.
    """
    if not fields:
        raise IndexNotFound("text index required for $text query")
    case = bool(spec.get("$caseSensitive"))
    wanted = parse_search(spec["$search"], case)
    texts = [path(scope, f) for f in fields]
    whole = F.concat_ws(" ", *[v.col for v in texts if v.is_string])
    whole = whole if case else F.lower(whole)
    words = F.filter(F.split(whole, SEPARATORS), lambda w: w != "")

    def holds(part: str):
        return lambda w: F.contains(w, F.lit(part))

    hits = [F.size(F.filter(words, holds(t))) for t in wanted.terms]
    counted = [F.regexp_count(whole, F.lit(re.escape(p))) * 2 for p in wanted.phrases]
    total = reduce(lambda a, b: a + b, hits + counted, F.lit(0))
    bad = [~F.contains(whole, F.lit(p)) for p in wanted.phrases] + [F.exists(words, holds(x)) for x in wanted.excluded]
    veto = reduce(lambda a, b: a | b, bad, F.lit(False))
    if not wanted.terms and not wanted.phrases:
        total = F.lit(0)
    return F.when(veto | (F.size(words) == 0), 0.0).otherwise(total / F.sqrt(F.greatest(F.size(words), F.lit(1))))
