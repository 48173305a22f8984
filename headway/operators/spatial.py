"""Spatial lookups on a grid: points to links and zones near them.

A point lies in one cell; what it may meet is dealt to every cell that its
envelope, widened by the radius, touches. The join on cells therefore makes each
pair once, and its hot cells are split by the adaptive skew join like any other.

Where points crowd, as in the centre of a city, :func:`quartered` finds the cells
that hold too many and quarters them until none does; the join then runs on the
leaves. A box is dealt to the leaves that it touches only, so the copies of boxes
stay below the pairs that come of them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from headway.functions import geo
from headway.sources.tables import small, written

ZONE_RADIUS, LINK_RADIUS, BUFFER, SNAP, MAX_ANGLE = 40.0, 40.0, 8.0, 5.0, 100.0


#: Points that a cell may hold before it is quartered; the most times a cell is.
PER_CELL, MAX_QUARTERS = 10_000, 8
#: Cells of a line's box up to which all of them are taken, near the line or not.
BOX_CELLS = 16


def _cell(at: str, size: float) -> Column:
    return F.floor(F.col(at) / size)


def quartered(points: DataFrame, radius: float, per_cell: int = PER_CELL) -> list[DataFrame]:
    """Of each level, the cells (cx, cy) with more than ``per_cell`` points (x, y); those of level k are 2 * radius / 2 ** k wide.

    A level looks only at the points of cells that the one before has split. A table has at most one row for ``per_cell`` points.
    """
    found, left = [], points.select("x", "y")
    for level in range(MAX_QUARTERS):
        size = 2 * radius / 2**level
        placed = left.withColumns({"cx": _cell("x", size), "cy": _cell("y", size)})
        crowded = written(placed.groupBy("cx", "cy").agg(F.count("*").alias("_n")).filter(F.col("_n") > per_cell).drop("_n"))
        if crowded.isEmpty():
            break
        found.append(crowded)
        left = placed.join(small(crowded), ["cx", "cy"], "left_semi").select("x", "y")
    return found


def _on_leaves(rows: DataFrame, crowded: list[DataFrame], radius: float, children: dict[str, Callable[[float], Column]]) -> DataFrame:
    """Rows with ``_level``, ``_cx`` and ``_cy`` of a leaf: cells that are split give way to what ``children`` name as arrays of their quarters."""
    for level, cells in enumerate(crowded):
        size = radius / 2**level
        split = small(cells).select(F.lit(level).alias("_level"), F.col("cx").alias("_cx"), F.col("cy").alias("_cy"), F.lit(True).alias("_split"))
        known = rows.join(split, ["_level", "_cx", "_cy"], "left")
        down = known.filter("_split").withColumn("_level", F.col("_level") + 1).withColumn("_nx", F.explode(children["x"](size))).withColumn("_ny", F.explode(children["y"](size)))
        rows = known.filter("_split is null").drop("_split").unionByName(down.withColumns({"_cx": F.col("_nx"), "_cy": F.col("_ny")}).drop("_nx", "_ny", "_split"))
    return rows


def on_leaves(points: DataFrame, crowded: list[DataFrame], radius: float) -> DataFrame:
    """Points with ``_level``, ``_cx`` and ``_cy`` of their leaf."""
    placed = points.withColumns({"_level": F.lit(0), "_cx": _cell("x", 2 * radius), "_cy": _cell("y", 2 * radius)})
    return _on_leaves(placed, crowded, radius, {k: lambda s, k=k: F.array(_cell(k, s)) for k in "xy"})


def in_box_join(points: DataFrame, boxes: DataFrame, radius: float, line: str | None = None, crowded: list[DataFrame] | None = None) -> DataFrame:
    """Pairs of points (x, y) and boxes (x_min, x_max, y_min, y_max) where the box meets the point's square of half width ``radius``.

    With ``line``, the box is that of the line in this column; if it is large, a pair also needs a step of the line
    near the point's cell: cells then follow the line's length. ``crowded`` are the cells to be split, from :func:`quartered`.
    """
    size = 2 * radius
    placed = on_leaves(points, crowded or [], radius)
    low, high = {k: F.col(f"{k}_min") - radius for k in "xy"}, {k: F.col(f"{k}_max") + radius for k in "xy"}
    wide = geo.cells(low["x"], high["x"], low["y"], high["y"], size)
    if line is not None:
        n = (F.floor(high["x"] / size) - F.floor(low["x"] / size) + 1) * (F.floor(high["y"] / size) - F.floor(low["y"] / size) + 1)
        wide = F.when(n <= BOX_CELLS, wide).otherwise(geo.line_cells(F.col(line), radius, size))
    dealt = boxes.withColumn("_cell", F.explode(wide)).withColumns({"_cx": F.col("_cell.cx"), "_cy": F.col("_cell.cy")}).drop("_cell")
    keys = ["_cx", "_cy"]
    if crowded:
        keys = ["_level", *keys]
        touched = {k: lambda s, k=k: F.sequence(F.greatest(2 * F.col(f"_c{k}"), F.floor(low[k] / s)), F.least(2 * F.col(f"_c{k}") + 1, F.floor(high[k] / s))) for k in "xy"}
        # Cells near a line may lie beside its box by a cell's width at most, where no quarter is touched.
        inside = [F.floor(low[k] / size) <= F.col(f"_c{k}") for k in "xy"] + [F.floor(high[k] / size) >= F.col(f"_c{k}") for k in "xy"]
        dealt = _on_leaves(dealt.filter(inside[0] & inside[1] & inside[2] & inside[3]).withColumn("_level", F.lit(0)), crowded, radius, touched)
    near = (F.col("x_max") >= F.col("x") - radius) & (F.col("x_min") <= F.col("x") + radius) & (F.col("y_max") >= F.col("y") - radius) & (F.col("y_min") <= F.col("y") + radius)
    return placed.join(dealt, keys).filter(near).drop("_level", "_cx", "_cy")


def link_boxes(links: DataFrame) -> DataFrame:
    xs, ys = F.transform("geometry", lambda p: p["x"]), F.transform("geometry", lambda p: p["y"])
    return links.withColumns({"x_min": F.array_min(xs), "x_max": F.array_max(xs), "y_min": F.array_min(ys), "y_max": F.array_max(ys)})


def near_links(stops: DataFrame, links: DataFrame, radius: float = LINK_RADIUS, by_line: bool = False, crowded: list[DataFrame] | None = None) -> DataFrame:
    """Pairs of stops and links, with ``near`` (the closest point of the link) and d2, the squared distance to it.

    A pair's boxes meet; with ``by_line`` some pairs farther apart than the radius are left out, and long links cost by their length.
    """
    pairs = in_box_join(stops, link_boxes(links), radius, "geometry" if by_line else None, crowded).drop("x_min", "x_max", "y_min", "y_max")
    return pairs.withColumn("near", geo.closest_on_line(F.col("x"), F.col("y"), F.col("geometry"))).withColumn("d2", F.col("near.d2"))


def near_zones(stops: DataFrame, zones: DataFrame, radius: float = ZONE_RADIUS, crowded: list[DataFrame] | None = None) -> DataFrame:
    """Pairs of stops and zones (zx, zy) with their squared distance."""
    boxes = zones.withColumnsRenamed({"x": "zx", "y": "zy"}).withColumns({"x_min": F.col("zx"), "x_max": F.col("zx"), "y_min": F.col("zy"), "y_max": F.col("zy")})
    dx, dy = F.col("x") - F.col("zx"), F.col("y") - F.col("zy")
    return in_box_join(stops, boxes, radius, crowded=crowded).drop("x_min", "x_max", "y_min", "y_max").withColumn("d2", dx * dx + dy * dy)


def closest(pairs: DataFrame, key: str, choice: str) -> DataFrame:
    """For each ``key`` the pair with the least d2, of equals that with the least ``choice``."""
    nth = F.row_number().over(Window.partitionBy(key).orderBy("d2", choice))
    return pairs.withColumn("_nth", nth).filter("_nth = 1").drop("_nth")


def within_buffer(pairs: DataFrame, key: str = "stop_id", buffer: float = BUFFER) -> DataFrame:
    """Pairs at most ``buffer`` metres farther than the closest one of their key."""
    least = F.sqrt(F.min("d2").over(Window.partitionBy(key)))
    return pairs.withColumn("_least", least).filter(F.sqrt("d2") <= F.col("_least") + buffer).drop("_least")


def to_access_nodes(pairs: DataFrame, connectoids: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs of stops and zones with d2 to the closest access node of the zone; to the zone's own place if it has no connectoid."""
    at = connectoids.select("zone_id", F.col("access_node").alias("node_id")).distinct().join(nodes.select("node_id", F.col("x").alias("_nx"), F.col("y").alias("_ny")), "node_id")
    dx, dy = F.col("x") - F.col("_nx"), F.col("y") - F.col("_ny")
    least = pairs.select("stop_id", "zone_id", "x", "y").join(at, "zone_id").groupBy("stop_id", "zone_id").agg(F.min(dx * dx + dy * dy).alias("_d2"))
    return pairs.join(least, ["stop_id", "zone_id"], "left").withColumn("d2", F.coalesce("_d2", "d2")).drop("_d2")


def bounding_box(nodes: DataFrame) -> DataFrame:
    return nodes.agg(F.min("x").alias("x_min"), F.max("x").alias("x_max"), F.min("y").alias("y_min"), F.max("y").alias("y_max"))


def in_box(stops: DataFrame, x_min: float, x_max: float, y_min: float, y_max: float, margin: float = 100.0) -> DataFrame:
    """Stops inside the box, and with ``near_edge`` whether they lie within ``margin`` of its border."""
    inside = F.col("x").between(x_min, x_max) & F.col("y").between(y_min, y_max)
    edge = F.least(F.col("x") - x_min, x_max - F.col("x"), F.col("y") - y_min, y_max - F.col("y"))
    return stops.filter(inside).withColumn("near_edge", edge <= margin)


def with_locations(stops: DataFrame, overrides: DataFrame) -> DataFrame:
    """Stops with x and y from ``overrides`` (stop_id, x, y) where they have one."""
    given = overrides.select("stop_id", F.col("x").alias("_x"), F.col("y").alias("_y"))
    moved = stops.join(given, "stop_id", "left")
    return moved.withColumns({"x": F.coalesce("_x", "x"), "y": F.coalesce("_y", "y")}).drop("_x", "_y")
