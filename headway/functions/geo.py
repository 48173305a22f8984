"""Planar geometry as column expressions. Points are (x, y) in metres, lines arrays of such structs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

METRES_PER_DEGREE = 111_319.49079327358


@dataclass(frozen=True)
class Projection:
    """Longitude and latitude to metres about a centre (equirectangular)."""

    lon: float
    lat: float

    def x(self, lon: Column) -> Column:
        return (lon - self.lon) * METRES_PER_DEGREE * F.cos(F.radians(F.lit(self.lat)))

    def y(self, lat: Column) -> Column:
        return (lat - self.lat) * METRES_PER_DEGREE


def closest_fraction(px: Column, py: Column, a: Column, b: Column) -> Column:
    """How far along the segment from a to b its point closest to (px, py) lies, 0 to 1."""
    dx, dy = b["x"] - a["x"], b["y"] - a["y"]
    t = ((px - a["x"]) * dx + (py - a["y"]) * dy) / F.nullif(dx * dx + dy * dy, F.lit(0.0))
    return F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), t)), F.lit(0.0))


def closest_on_segment(px: Column, py: Column, a: Column, b: Column) -> Column:
    """struct(d2, x, y, dx, dy): squared distance, closest point, direction of the segment."""
    t = closest_fraction(px, py, a, b)
    x, y = a["x"] + t * (b["x"] - a["x"]), a["y"] + t * (b["y"] - a["y"])
    return F.struct(
        ((px - x) * (px - x) + (py - y) * (py - y)).alias("d2"), x.alias("x"), y.alias("y"),
        (b["x"] - a["x"]).alias("dx"), (b["y"] - a["y"]).alias("dy"),
    )


def closest_on_line(px: Column, py: Column, line: Column) -> Column:
    """As :func:`closest_on_segment` with ``along`` (number of the segment from 0, and the fraction of it), for the closest segment of a line.

    Of segments that are equally close the smallest struct counts.
    """
    def one(i: Column) -> Column:
        near = closest_on_segment(px, py, F.get(line, i - 1), F.get(line, i))
        return near.withField("along", i - 1 + closest_fraction(px, py, F.get(line, i - 1), F.get(line, i)))

    return F.array_min(F.transform(F.sequence(F.lit(1), F.size(line) - 1), one))


def line_cells(line: Column, radius: float, size: float) -> Column:
    """The grid cells (cx, cy) within ``radius`` of the boxes of a line's steps of at most ``size``: as many as its length asks for, not its box."""
    step = lambda a, b, k, n: F.struct((a["x"] + (b["x"] - a["x"]) * k / n).alias("x"), (a["y"] + (b["y"] - a["y"]) * k / n).alias("y"))

    def of_segment(i: Column) -> Column:
        a, b = F.get(line, i - 1), F.get(line, i)
        n = F.greatest(F.ceil(F.greatest(F.abs(b["x"] - a["x"]), F.abs(b["y"] - a["y"])) / size), F.lit(1))
        boxes = F.transform(F.sequence(F.lit(1).cast("long"), n), lambda k: F.struct(step(a, b, k - 1, n).alias("p"), step(a, b, k, n).alias("q")))
        return F.flatten(F.transform(boxes, lambda s: cells(
            F.least(s["p"]["x"], s["q"]["x"]) - radius, F.greatest(s["p"]["x"], s["q"]["x"]) + radius,
            F.least(s["p"]["y"], s["q"]["y"]) - radius, F.greatest(s["p"]["y"], s["q"]["y"]) + radius, size,
        )))

    return F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.size(line) - 1), of_segment)))


def length(line: Column) -> Column:
    """The length of a line."""
    steps = F.transform(F.sequence(F.lit(1), F.size(line) - 1), lambda i: F.hypot(F.get(line, i)["x"] - F.get(line, i - 1)["x"], F.get(line, i)["y"] - F.get(line, i - 1)["y"]))
    return F.aggregate(steps, F.lit(0.0), lambda a, x: a + x)


def side(px: Column, py: Column, near: Column) -> Column:
    """LEFT, RIGHT or ON: where the point lies seen along the closest segment."""
    cross = near["dx"] * (py - near["y"]) - near["dy"] * (px - near["x"])
    return F.when(cross > 0, "LEFT").when(cross < 0, "RIGHT").otherwise("ON")


def azimuth(from_x: Column, from_y: Column, to_x: Column, to_y: Column) -> Column:
    """Degrees clockwise from north, 0 to below 360."""
    return F.pmod(F.degrees(F.atan2(to_x - from_x, to_y - from_y)), F.lit(360.0))


def angle_between(a: Column, b: Column) -> Column:
    d = F.abs(a - b)
    return F.least(d, 360.0 - d)


def cells(x_min: Column, x_max: Column, y_min: Column, y_max: Column, size: float) -> Column:
    """The grid cells (cx, cy) that a box touches."""
    span = lambda a, b: F.sequence(F.floor(a / size), F.floor(b / size))
    return F.flatten(F.transform(span(x_min, x_max), lambda cx: F.transform(span(y_min, y_max), lambda cy: F.struct(cx.alias("cx"), cy.alias("cy")))))
