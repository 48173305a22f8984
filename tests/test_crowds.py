"""The adaptive grid, modes common to all segments, conflicts of modes, suppliers that are called once."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from headway.operators import matching, spatial
from headway.plans.intermodal import Intermodal, ZoningConfig


def crowd(n=4000, seed=3):
    """A third of all points in a few metres, a third along a street, the others anywhere."""
    rng = random.Random(seed)
    return [(i, *((rng.gauss(400, 3), rng.gauss(400, 3)) if i % 3 == 0 else (rng.uniform(0, 2000), 395.0) if i % 3 == 1 else (rng.uniform(0, 2000), rng.uniform(0, 2000)))) for i in range(n)]


def lines(spark):
    rng, rows = random.Random(5), []
    for k in range(150):
        x, y = rng.uniform(0, 2000), rng.uniform(0, 2000)
        rows.append((k, [{"x": x, "y": y}, {"x": x + rng.uniform(-90, 90), "y": y + rng.uniform(-90, 90)}]))
    rows += [(900, [{"x": -50.0, "y": -50.0}, {"x": 2100.0, "y": 2050.0}]), (901, [{"x": 0.0, "y": 401.0}, {"x": 2000.0, "y": 401.0}]), (902, [{"x": 399.0, "y": 399.0}, {"x": 401.0, "y": 402.0}])]
    return spark.createDataFrame(rows, "link_id long, geometry array<struct<x:double,y:double>>")


def test_crowded_cells_are_quartered(spark):
    points = spark.createDataFrame(crowd(), "point_id long, x double, y double")
    found = spatial.quartered(points, 40.0, 100)
    assert len(found) >= 3
    placed = spatial.on_leaves(points, found, 40.0)
    sizes = Counter((r["_level"], r["_cx"], r["_cy"]) for r in placed.collect())
    assert sum(sizes.values()) == 4000 and max(sizes.values()) <= 100
    hot = points.groupBy(spatial._cell("x", 80.0), spatial._cell("y", 80.0)).count().agg(F.max("count")).first()[0]
    assert hot > 3 * 100


@pytest.mark.parametrize("by_line", [False, True])
def test_pairs_are_the_same_on_leaves(spark, by_line):
    points, links = spark.createDataFrame(crowd(1200), "point_id long, x double, y double"), lines(spark)
    pairs = lambda crowded: {(r["point_id"], r["link_id"]): r["d2"] for r in spatial.near_links(points, links, 40.0, by_line, crowded).filter("d2 <= 1600").collect()}
    plain = pairs(None)
    assert pairs(spatial.quartered(points, 40.0, 40)) == plain and len(plain) > 800
    shown = spatial.near_links(points, links, 40.0, by_line, spatial.quartered(points, 40.0, 40)).count()
    assert shown == spatial.near_links(points, links, 40.0, by_line, spatial.quartered(points, 40.0, 40)).select("point_id", "link_id").distinct().count()


def test_tasks_are_even_on_leaves(spark):
    """The points of the largest task are at most three times those of the median one."""
    points = spark.createDataFrame(crowd(12_000), "point_id long, x double, y double")
    found = spatial.quartered(points, 40.0, 60)
    placed = spatial.on_leaves(points, found, 40.0)
    tasks = sorted(r["count"] for r in placed.repartition(16, "_level", "_cx", "_cy").groupBy(F.spark_partition_id()).count().collect())
    assert tasks[-1] <= 3 * tasks[len(tasks) // 2]


def test_connectoids_allow_what_all_segments_of_a_stop_allow(spark):
    entries = spark.createDataFrame(
        [(1, "BUS", 10, 5, ["BUS", "TRAM"]), (1, "BUS", 11, 5, ["BUS"]), (1, "TRAIN", 12, 6, ["TRAIN", "TRAM"]), (2, "TRAM", 13, 7, ["LIGHTRAIL", "TRAM"])],
        "stop_id long, mode string, segment_id long, to_node long, modes array<string>",
    )
    types = spark.createDataFrame([(1, "BUS", True), (1, "TRAM", False), (2, "TRAM", True), (2, "LIGHTRAIL", False), (3, "TRAIN", True)], "route_type int, mode string, is_primary boolean")
    zones = entries.select("stop_id", "mode").distinct()
    made = {(r["zone_key"], r["segment_id"]): r["modes"] for r in matching.connectoids_for(zones, entries, types).collect()}
    assert made == {(1, 10): ["BUS"], (1, 11): ["BUS"], (1, 12): ["TRAIN"], (2, 13): ["LIGHTRAIL", "TRAM"]}
    alone = {(r["zone_key"], r["segment_id"]): r["modes"] for r in matching.connectoids_for(zones, entries).collect()}
    assert alone[2, 13] == ["TRAM"]


def test_conflicts_are_listed(spark):
    rows = [(1, "BUS", 7, 3, 1.0), (1, "BUS", 8, 4, 0.5), (1, "FERRY", 8, 5, 2.0), (2, "BUS", 7, 3, 1.0), (2, "FERRY", 7, 5, 1.0), (3, "BUS", 9, 3, 0.1)]
    found = matching.conflicts(spark.createDataFrame(rows, "stop_id long, mode string, zone_id long, priority int, d2 double")).collect()
    assert [(r["stop_id"], [tuple(z) for z in r["zones"]]) for r in found] == [(1, [("BUS", 7), ("FERRY", 8)])]


def test_suppliers_are_called_once_and_late(spark):
    calls = []

    def physical():
        calls.append(1)
        empty = {"nodes": "node_id long, x double, y double", "links": "link_id long", "segments": "segment_id long"}
        return {k: spark.createDataFrame([], v) for k, v in empty.items()}

    stops = spark.createDataFrame([], "stop_id string, x double, y double, platform_code string")
    work = Intermodal(lambda: calls.append(2), stops, physical, ZoningConfig())
    assert calls == []
    assert work.physical["zones"].count() == 0 and work.physical is work.physical and calls == [1]
    with pytest.raises(ValueError, match="links, segments"):
        _ = Intermodal(lambda: None, stops, lambda: {"nodes": None}).physical
