"""The state of many points: an index of the cells inside and on the borders of polygons, which points join by cell."""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import shared_dir

Polygons = list[tuple[str, list[list[tuple[float, float]]]]]
#: Cells to a degree, each way: a power of two, so that cells' sides are exact numbers.
CELLS = 4
#: Edges this near to a cell, in degrees, count as touching it; a crossing's rounding is far below.
SLACK = 1e-9
#: Numbers (of cells and edges) up to which an index is broadcast, 8 bytes each; a larger one meets the points by a shuffle.
MOST_BROADCAST = 8_000_000


def edges(spark: SparkSession, polygons: Polygons) -> DataFrame:
    """place (of the polygon), state, x1, y1, x2 and y2 of every edge; horizontal ones, which nothing crosses, included."""
    rows = [(i, name, *map(float, (*p, *ring[(k + 1) % len(ring)]))) for i, (name, rings) in enumerate(polygons) for ring in rings for k, p in enumerate(ring)]
    return spark.createDataFrame(rows, "place int, state string, x1 double, y1 double, x2 double, y2 double")


def _crossing(e: Column, lat: Column) -> Column:
    """Longitude at which an edge crosses a latitude; for edges that do."""
    return (e["x2"] - e["x1"]) * (lat - e["y1"]) / (e["y2"] - e["y1"]) + e["x1"]


def _crosses(e: Column, lat: Column) -> Column:
    return (e["y1"] > lat) != (e["y2"] > lat)


def cover(every: DataFrame, cells: int = CELLS) -> DataFrame:
    """ix, iy and polygons: what a point of the cell must try, in the polygons' order, as (place, state, flip, edges).

    A point is in a polygon if an odd number of its edges are crossed to the east, by the even-odd rule. In a cell that
    no edge touches all points agree: such cells inside are kept with a flip of 1 and no edges. A cell that is touched
    keeps the edges of its row that some of its points may or may not cross, and in flip the parity of those that all of
    them cross, so that the answer is the same as from all edges. Work and size follow the borders' length in cells and
    the areas, whatever the number of points.
    """
    cell = lambda c: F.floor(c * cells)
    e = {c: F.col(c) for c in ("x1", "y1", "x2", "y2")}
    low, high = F.least("y1", "y2"), F.greatest("y1", "y2")
    rows = every.withColumn("iy", F.explode(F.sequence(cell(low - SLACK), cell(high + SLACK))))
    bottom, top, left, right = F.col("iy") / cells, (F.col("iy") + 1) / cells, F.col("ix") / cells, (F.col("ix") + 1) / cells
    clipped = lambda y: F.when(low < high, _crossing(e, F.least(F.greatest(y, low), high)))
    a, b = clipped(bottom - SLACK), clipped(top + SLACK)
    west, east = F.when(low < high, F.least(a, b)).otherwise(F.least("x1", "x2")), F.when(low < high, F.greatest(a, b)).otherwise(F.greatest("x1", "x2"))
    touched = rows.withColumn("ix", F.explode(F.sequence(cell(west - SLACK), cell(east + SLACK)))).select("place", "state", "ix", "iy").distinct()

    own = rows.groupBy("place", "iy").agg(F.collect_list(F.struct("x1", "y1", "x2", "y2")).alias("es"))
    beyond = lambda e: (F.least(e["x1"], e["x2"]) > right + SLACK) & (F.least(e["y1"], e["y2"]) <= bottom) & (F.greatest(e["y1"], e["y2"]) >= top)
    near = lambda e: (F.greatest(e["x1"], e["x2"]) >= left - SLACK) & (e["y1"] != e["y2"]) & ~beyond(e)
    border = touched.join(own, ["place", "iy"]).select("ix", "iy", "place", "state", (F.size(F.filter("es", beyond)) % 2).alias("flip"), F.filter("es", near).alias("edges"))

    middle = (F.col("iy") + 0.5) / cells
    crossed = rows.where(_crosses(e, middle)).groupBy("place", "state", "iy").agg(F.array_sort(F.collect_list(_crossing(e, middle))).alias("xs"))
    reached = crossed.withColumn("ix", F.explode(F.sequence(cell(F.element_at("xs", 1)), cell(F.element_at("xs", -1)))))
    odd = F.size(F.filter("xs", lambda x: x > (F.col("ix") + 0.5) / cells)) % 2 == 1
    inner = reached.where(odd).join(touched.select("place", "ix", "iy"), ["place", "ix", "iy"], "left_anti")
    inside = inner.select("ix", "iy", "place", "state", F.lit(1).alias("flip"), F.expr("cast(array() AS array<struct<x1: double, y1: double, x2: double, y2: double>>)").alias("edges"))
    return border.unionByName(inside).groupBy("ix", "iy").agg(F.array_sort(F.collect_list(F.struct("place", "state", "flip", "edges"))).alias("polygons"))


class StateCells:
    """An index of polygons' cells, made and written once, by which any number of points find their state."""

    def __init__(self, spark: SparkSession, polygons: Polygons, cells: int = CELLS):
        self.cells = cells
        self.digest = hashlib.sha256(json.dumps([polygons, cells]).encode()).hexdigest()
        path = f"{shared_dir(spark)}/airledger-cells/{uuid.uuid4().hex}"
        made = cover(edges(spark, polygons), cells)
        made.write.parquet(path)
        self.cover = spark.read.schema(made.schema).parquet(path)
        numbers = F.expr("sum(2 + aggregate(polygons, 0L, (n, p) -> n + 4 + 4 * size(p.edges)))")
        self.small = (self.cover.agg(numbers.alias("n")).first()["n"] or 0) <= MOST_BROADCAST

    def __str__(self) -> str:
        """The same for equal polygons: a build that is named by its inputs can go on with it."""
        return f"cells {self.digest}"

    def locate(self, points: DataFrame, name: str, lat: str = "lat", lon: str = "lon", where: Column | None = None) -> DataFrame:
        """points with the state of each, as geo.state_of gives it: the first polygon that holds it, else null.

        Null and NaN coordinates, and rows for which `where` isn't true, have none. Repeated rows stay. Columns of points
        may have any names but __ix, __iy, __polygons and (unless it is replaced) the result's.
        """
        y, x = F.col(f"`{lat}`"), F.col(f"`{lon}`")
        asked = ~F.isnan(y) & ~F.isnan(x) & (F.lit(True) if where is None else where)
        at = points.withColumns({"__ix": F.when(asked, F.floor(x * self.cells)), "__iy": F.when(asked, F.floor(y * self.cells))})
        index = self.cover.select(F.col("ix").alias("__ix"), F.col("iy").alias("__iy"), F.col("polygons").alias("__polygons"))
        met = at.join(F.broadcast(index) if self.small else index, ["__ix", "__iy"], "left")
        crossed = lambda p: F.size(F.filter(p["edges"], lambda e: _crosses(e, y) & (x < _crossing(e, y))))
        holds = F.filter("__polygons", lambda p: (crossed(p) + p["flip"]) % 2 == 1)
        return met.withColumn(name, F.get(holds, 0)["state"]).drop("__ix", "__iy", "__polygons")
