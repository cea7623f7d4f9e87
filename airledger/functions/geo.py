"""Great-circle distance, bounding boxes and the state of a point."""

from __future__ import annotations

import json
import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0088


def distance_km(lat: Column, lon: Column, lat0: float | Column, lon0: float | Column) -> Column:
    """Haversine distance on a sphere of the mean radius."""
    lat0, lon0 = (F.lit(x) if isinstance(x, int | float) else x for x in (lat0, lon0))
    half = lambda x: F.sin(F.radians(x) / 2)
    h = half(lat - lat0) * half(lat - lat0) + F.cos(F.radians(lat0)) * F.cos(F.radians(lat)) * half(lon - lon0) * half(lon - lon0)
    return F.lit(2 * EARTH_KM) * F.asin(F.sqrt(F.least(F.lit(1.0), h)))


def box(lat0: float, lon0: float, radius_km: float) -> tuple[tuple[float, float], list[tuple[float, float]]]:
    """Latitudes, and one or two ranges of longitude, that hold every point within a radius."""
    reach = math.degrees(radius_km / EARTH_KM) * (1 + 1e-9)
    south, north = lat0 - reach, lat0 + reach
    if north >= 90 or south <= -90:
        return (max(south, -90.0), min(north, 90.0)), [(-180.0, 180.0)]
    ratio = math.sin(math.radians(reach)) / math.cos(math.radians(lat0))
    if ratio >= 1:
        return (south, north), [(-180.0, 180.0)]
    side = math.degrees(math.asin(ratio)) * (1 + 1e-9)
    west, east = lon0 - side, lon0 + side
    if west < -180:
        return (south, north), [(west + 360, 180.0), (-180.0, east)]
    if east > 180:
        return (south, north), [(west, 180.0), (-180.0, east - 360)]
    return (south, north), [(west, east)]


def in_box(lat: Column, lon: Column, lat0: float, lon0: float, radius_km: float) -> Column:
    """A predicate of plain ranges, which reach the Parquet scan."""
    (south, north), ranges = box(lat0, lon0, radius_km)
    sides = F.lit(False)
    for west, east in ranges:
        sides = sides | lon.between(west, east)
    return lat.between(south, north) & (sides if len(ranges) > 1 else lon.between(*ranges[0]))


def curve(lat: str, lon: str, bits: int = 16) -> str:
    """SQL of a point's place on a Z-order curve of 2 to the bits steps each way; points without coordinates come first.

    Neighbours on it are neighbours on the ground in both directions, so rows in its order lie in files, row groups and
    pages of few degrees each way, and a box's ranges of lat and lon exclude most of them.
    """
    last = 2**bits - 1
    step = lambda c, low, width: f"least({last}, greatest(0, cast(floor(({c} - ({low})) * {(last + 1) / width}) AS INT)))"
    spread = lambda c, shift: " + ".join(f"shiftleft(cast(shiftright({c}, {i}) & 1 AS BIGINT), {2 * i + shift})" for i in range(bits))
    return f"transform(array(struct({step(lat, -90.0, 180.0)} AS y, {step(lon, -180.0, 360.0)} AS x)), p -> {spread('p.y', 1)} + {spread('p.x', 0)})[0]"


def state_of(lat: Column, lon: Column, polygons: list[tuple[str, list[list[tuple[float, float]]]]]) -> Column:
    """The first state whose polygon holds a point, by the even-odd rule; null if none does.

    polygons: (state, rings of (lon, lat)), holes being rings too. They are literals of the plan: boundaries of states
    are a few thousand points, whatever the number of sites. Each state's bounding box is tried before its edges.
    """
    found = F.lit(None).cast("string")
    for name, rings in reversed(polygons):
        xs, ys = [p[0] for r in rings for p in r], [p[1] for r in rings for p in r]
        edges = [(p, r[(i + 1) % len(r)]) for r in rings for i, p in enumerate(r)]
        table = F.from_json(F.lit(json.dumps([[x1, y1, x2, y2] for (x1, y1), (x2, y2) in edges])), "array<array<double>>")
        crossings = F.size(F.filter(table, lambda e: ((e[1] > lat) != (e[3] > lat)) & (lon < (e[2] - e[0]) * (lat - e[1]) / (e[3] - e[1]) + e[0])))
        inside = lon.between(min(xs), max(xs)) & lat.between(min(ys), max(ys)) & (crossings % 2 == 1)
        found = F.when(inside, F.lit(name)).otherwise(found)
    return found


def load_polygons(path: str) -> list[tuple[str, list[list[tuple[float, float]]]]]:
    """Polygons of a GeoJSON file whose features have a property `state`."""
    with open(path, encoding="utf-8") as f:
        features = json.load(f)["features"]
    out = []
    for feature in features:
        geometry = feature["geometry"]
        parts = geometry["coordinates"] if geometry["type"] == "MultiPolygon" else [geometry["coordinates"]]
        out.append((feature["properties"]["state"], [[(p[0], p[1]) for p in ring] for part in parts for ring in part]))
    return out
