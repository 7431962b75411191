"""Geospatial predicates and distances, longitude first."""

from __future__ import annotations

import json
from functools import reduce
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import DocError
from ..functions.core import DOUBLE, V

EARTH_RADIUS_M = 6_378_100.0
KINDS = ("Point", "LineString", "Polygon", "MultiPoint", "MultiLineString", "MultiPolygon", "GeometryCollection")


def coordinates(v: V) -> tuple[Column, Column]:
    """Longitude and latitude of a GeoJSON point, a pair, {x, y} or {lng, lat}; else null."""
    if v.is_array and isinstance(v.type.elementType, T.NumericType):
        return F.get(v.col, 0).cast(DOUBLE), F.get(v.col, 1).cast(DOUBLE)
    if v.is_struct:
        names = v.type.names
        if "coordinates" in names:
            c = v.type["coordinates"].dataType
            if isinstance(c, T.ArrayType) and isinstance(c.elementType, T.NumericType):
                point = v.col.getField("type") == "Point" if "type" in names else F.lit(True)
                pair = v.col.getField("coordinates")
                return F.when(point, F.get(pair, 0)).cast(DOUBLE), F.when(point, F.get(pair, 1)).cast(DOUBLE)
        for a, b in (("x", "y"), ("lng", "lat")):
            if a in names and b in names:
                return v.col.getField(a).cast(DOUBLE), v.col.getField(b).cast(DOUBLE)
    return F.lit(None).cast(DOUBLE), F.lit(None).cast(DOUBLE)


def point_of(value: Any) -> tuple[float, float]:
    """The pair of a literal point."""
    if isinstance(value, dict):
        if "$geometry" in value:
            return point_of(value["$geometry"])
        if "coordinates" in value:
            check_geometry(value)
            return point_of(value["coordinates"])
        for a, b in (("x", "y"), ("lng", "lat")):
            if a in value:
                return float(value[a]), float(value[b])
    if isinstance(value, (list, tuple)) and len(value) >= 2:
        return float(value[0]), float(value[1])
    raise DocError(f"not a point: {value}")


def check_geometry(g: Any) -> dict:
    if not isinstance(g, dict) or g.get("type") not in KINDS:
        raise DocError(f"unknown GeoJSON type: {g.get('type') if isinstance(g, dict) else g}")
    polygons = [g["coordinates"]] if g["type"] == "Polygon" else g["coordinates"] if g["type"] == "MultiPolygon" else []
    for polygon in polygons:
        for ring in polygon:
            if len(ring) < 4 or list(ring[0]) != list(ring[-1]):
                raise DocError("a ring is closed and has four positions at least")
    return g


def haversine(x: Column, y: Column, lon: float, lat: float) -> Column:
    """Metres on the sphere."""
    dlat, dlon = F.radians(F.lit(lat) - y), F.radians(F.lit(lon) - x)
    a = F.pow(F.sin(dlat / 2), 2) + F.cos(F.radians(y)) * F.cos(F.radians(F.lit(lat))) * F.pow(F.sin(dlon / 2), 2)
    return F.lit(2 * EARTH_RADIUS_M) * F.atan2(F.sqrt(a), F.sqrt(F.greatest(1 - a, F.lit(0.0))))


def euclidean(x: Column, y: Column, px: float, py: float) -> Column:
    return F.hypot(x - px, y - py)


def in_ring(x: Column, y: Column, ring: list) -> Column:
    """Even-odd rule over the edges of a literal ring."""
    crossings = []
    for (x1, y1), (x2, y2) in zip([p[:2] for p in ring], [p[:2] for p in ring[1:]]):
        if y1 == y2:
            continue
        at = F.lit(float(x1)) + (y - float(y1)) * ((x2 - x1) / (y2 - y1))
        spans = ((F.lit(float(y1)) > y) != (F.lit(float(y2)) > y))
        crossings.append(F.when(spans & (x < at), 1).otherwise(0))
    total = reduce(lambda a, b: a + b, crossings) if crossings else F.lit(0)
    return total % 2 == 1


def in_polygon(x: Column, y: Column, rings: list) -> Column:
    inside = in_ring(x, y, rings[0])
    for hole in rings[1:]:
        inside = inside & ~in_ring(x, y, hole)
    return inside


def _shape(x: Column, y: Column, spec: dict) -> Column:
    if "$box" in spec:
        (x1, y1), (x2, y2) = (point_of(p) for p in spec["$box"])
        return x.between(min(x1, x2), max(x1, x2)) & y.between(min(y1, y2), max(y1, y2))
    if "$center" in spec:
        (px, py), r = point_of(spec["$center"][0]), spec["$center"][1]
        return euclidean(x, y, px, py) <= r
    if "$centerSphere" in spec:
        (px, py), r = point_of(spec["$centerSphere"][0]), spec["$centerSphere"][1]
        return haversine(x, y, px, py) <= r * EARTH_RADIUS_M
    if "$polygon" in spec:
        ring = [list(point_of(p)) for p in spec["$polygon"]]
        return in_ring(x, y, ring if ring[0] == ring[-1] else [*ring, ring[0]])
    if "$geometry" in spec:
        g = check_geometry(spec["$geometry"])
        if g["type"] == "Polygon":
            return in_polygon(x, y, g["coordinates"])
        if g["type"] == "MultiPolygon":
            return reduce(lambda a, b: a | b, [in_polygon(x, y, p) for p in g["coordinates"]])
        raise DocError("$geoWithin needs a polygon")
    raise DocError("$geoWithin needs a shape")


def within(v: V, spec: dict) -> Column:
    if v.is_array and isinstance(v.type.elementType, (T.StructType, T.ArrayType)):
        return F.coalesce(F.exists(v.col, lambda p: within(V(p, v.type.elementType), spec)), F.lit(False))
    x, y = coordinates(v)
    return F.coalesce(_shape(x, y, spec), F.lit(False))


# --- any geometry against any other ----------------------------------------


def _flat(g: dict) -> tuple[list, list, list]:
    """Points, segments and polygons of a geometry."""
    kind, c = g["type"], g.get("coordinates")
    if kind == "Point":
        return [c], [], []
    if kind == "MultiPoint":
        return list(c), [], []
    if kind == "LineString":
        return [], list(zip(c, c[1:])), []
    if kind == "MultiLineString":
        return [], [s for line in c for s in zip(line, line[1:])], []
    if kind == "Polygon":
        return [], [], [c]
    if kind == "MultiPolygon":
        return [], [], list(c)
    points, segments, polygons = [], [], []
    for part in g.get("geometries", ()):
        for whole, own in zip((points, segments, polygons), _flat(part)):
            whole += own
    return points, segments, polygons


def _side(p, q, r) -> float:
    return (q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0])


def _on(p, a, b) -> bool:
    return abs(_side(a, b, p)) <= 1e-10 and min(a[0], b[0]) - 1e-10 <= p[0] <= max(a[0], b[0]) + 1e-10 and min(a[1], b[1]) - 1e-10 <= p[1] <= max(a[1], b[1]) + 1e-10


def _cross(s, t) -> bool:
    (a, b), (c, d) = s, t
    if _side(a, b, c) * _side(a, b, d) < 0 and _side(c, d, a) * _side(c, d, b) < 0:
        return True
    return _on(a, c, d) or _on(b, c, d) or _on(c, a, b) or _on(d, a, b)


def _inside(p, ring) -> bool:
    odd = False
    for a, b in zip(ring, ring[1:]):
        if (a[1] > p[1]) != (b[1] > p[1]) and p[0] < a[0] + (p[1] - a[1]) * (b[0] - a[0]) / (b[1] - a[1]):
            odd = not odd
    return odd


def _in_area(p, polygon) -> bool:
    if any(_on(p, a, b) for ring in polygon for a, b in zip(ring, ring[1:])):
        return True
    return _inside(p, polygon[0]) and not any(_inside(p, hole) for hole in polygon[1:])


def geometries_meet(g: dict, h: dict) -> bool:
    """Whether two geometries share a point, on the plane."""
    (p1, s1, a1), (p2, s2, a2) = _flat(g), _flat(h)
    edges = lambda areas: [e for polygon in areas for ring in polygon for e in zip(ring, ring[1:])]
    e1, e2 = s1 + edges(a1), s2 + edges(a2)
    if any(abs(p[0] - q[0]) <= 1e-10 and abs(p[1] - q[1]) <= 1e-10 for p in p1 for q in p2):
        return True
    if any(_on(p, *e) for p in p1 for e in e2) or any(_on(p, *e) for p in p2 for e in e1) or any(_cross(s, t) for s in e1 for t in e2):
        return True
    ends = lambda points, segments, areas: points + [s[0] for s in segments] + [a[0][0] for a in areas]
    return any(_in_area(p, a) for a in a2 for p in ends(p1, s1, a1)) or any(_in_area(p, a) for a in a1 for p in ends(p2, s2, a2))


_NEAR = 1e-10


def _on_edge(x: Column, y: Column, a: list, b: list) -> Column:
    (ax, ay), (bx, by) = (tuple(map(float, p[:2])) for p in (a, b))
    off = F.abs((y - ay) * (bx - ax) - (x - ax) * (by - ay)) <= _NEAR
    return off & x.between(min(ax, bx) - _NEAR, max(ax, bx) + _NEAR) & y.between(min(ay, by) - _NEAR, max(ay, by) + _NEAR)


def point_meets(x: Column, y: Column, g: dict) -> Column:
    """Whether a point lies on or in a literal geometry, its borders included."""
    points, segments, areas = _flat(g)
    tests = [(F.abs(x - float(p[0])) <= _NEAR) & (F.abs(y - float(p[1])) <= _NEAR) for p in points]
    tests += [_on_edge(x, y, a, b) for a, b in segments]
    for rings in areas:
        tests += [_on_edge(x, y, a, b) for ring in rings for a, b in zip(ring, ring[1:])]
        tests.append(in_polygon(x, y, rings))
    return reduce(lambda a, b: a | b, tests) if tests else F.lit(False)


def intersects(v: V, spec: dict) -> Column:
    """Column math for points; other geometries meet in a Python function, batch by batch."""
    g = check_geometry(spec["$geometry"])
    if v.missing:
        return F.lit(False)
    kind = v.type
    if v.is_struct and "coordinates" in kind.names and isinstance(kind["coordinates"].dataType, T.ArrayType) and isinstance(kind["coordinates"].dataType.elementType, T.ArrayType):
        text = F.to_json(v.col)
    elif v.is_array or v.is_struct:
        # A flat list of numbers is a point, whatever else the field may hold.
        return F.coalesce(point_meets(*coordinates(v), g), F.lit(False))
    elif v.is_string:
        text = v.col
    else:
        return F.lit(False)

    @F.pandas_udf("boolean")
    def meets(values: pd.Series) -> pd.Series:
        return values.map(lambda s: s is not None and geometries_meet(json.loads(s), g)).astype(bool)

    return F.coalesce(meets(text), F.lit(False))
