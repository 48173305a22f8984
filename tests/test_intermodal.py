"""A whole conversion on a network without zones, and on one with them."""

import pytest
from pyspark.sql import functions as F

from headway.functions import geo
from headway.plans.intermodal import Intermodal, ZoningConfig
from headway.plans.services import Services, ServicesConfig, from_feed
from headway.sources.feed import Feed


@pytest.fixture(scope="module")
def place(tmp_path_factory):
    """Buses along a street from west to east and back, with a stop in mid-link on each side, and one stop far away."""
    folder = tmp_path_factory.mktemp("feed")
    times = ""
    for trip, stops, start in (("e1", "ABC", 6 * 3600), ("e2", "ABC", 7 * 3600), ("w1", "cba", 8 * 3600), ("far", "ABX", 9 * 3600), ("far2", "ABXB", 9 * 3600 + 60)):
        for i, stop in enumerate(stops):
            t = start + 120 * i
            times += f"{trip},{t // 3600:02d}:{t // 60 % 60:02d}:00,{t // 3600:02d}:{t // 60 % 60:02d}:00,{stop},{i}\n"
    metres = 1 / geo.METRES_PER_DEGREE
    at = {"A": (50, 5), "B": (150, 5), "C": (250, 5), "a": (52, -5), "b": (152, -5), "c": (252, -5), "X": (9_000, 9_000), "D": (55, 5)}
    stops = "".join(f"{s},stop {s},{y * metres!r},{x * metres!r},{0 if s != 'D' else 1},{s}\n" for s, (x, y) in at.items())
    tables = {
        "agency": "agency_id\n1\n", "routes": "route_id,route_short_name,route_type\nr,R,3\n",
        "calendar": "service_id,monday,tuesday,wednesday,thursday,friday,saturday,sunday\ns,0,0,0,1,0,0,0\n",
        "trips": "trip_id,route_id,service_id\n" + "".join(f"{t},r,s\n" for t in ("e1", "e2", "w1", "far", "far2")),
        "stops": "stop_id,stop_name,stop_lat,stop_lon,location_type,platform_code\n" + stops,
        "stop_times": "trip_id,arrival_time,departure_time,stop_id,stop_sequence\n" + times,
    }
    for name, text in tables.items():
        (folder / f"{name}.txt").write_text(text)
    return f"file://{folder}"


def street(spark):
    points = [(0, 0.0), (1, 100.0), (2, 200.0), (3, 300.0)]
    nodes = spark.createDataFrame([(i, x, 0.0) for i, x in points] + [(9, 0.0, -50.0), (10, 300.0, 50.0)], "node_id long, x double, y double")
    bend = [(0.0, 0.0), (30.0, 0.0), (100.0, 0.0)]
    lines = [bend, [(100.0, 0.0), (200.0, 0.0)], [(200.0, 0.0), (300.0, 0.0)]]
    links = spark.createDataFrame([(k, f"way {k}", k, k + 1, [{"x": x, "y": y} for x, y in pts]) for k, pts in enumerate(lines)], "link_id long, external_id string, node_a long, node_b long, geometry array<struct<x:double,y:double>>")
    rows = [(2 * k + d, k, k + d, k + 1 - d, ["BUS"], 1.0, 0.1, 50.0) for k in range(3) for d in (0, 1)]
    segments = spark.createDataFrame(rows, "segment_id long, link_id long, from_node long, to_node long, modes array<string>, capacity double, length_km double, speed_kmh double")
    return {"nodes": nodes, "links": links, "segments": segments}


def services(spark, place):
    tables = from_feed(Feed(spark, place).tables())
    return tables, Services(tables, ServicesConfig("thursday", periods=[(6 * 3600, 10 * 3600)]))


def test_a_network_without_zones(spark, place):
    tables, plan = services(spark, place)
    work = Intermodal(plan, tables["stops"], street(spark), ZoningConfig(projection=geo.Projection(0.0, 0.0)))
    assert work.matches.count() == 0
    assert {r["stop_id"]: r["zone_id"] for r in work.created.collect()} == {"A": 1, "B": 2, "C": 3, "a": 4, "b": 5, "c": 6}
    out = work.results()
    assert out["nodes"].count() == 6 + 6 and out["links"].count() == 3 + 6 and out["segments"].count() == 6 + 12
    assert out["segments"].agg(F.round(F.sum("length_km"), 6)).first()[0] == 0.6
    first = sorted(([p["x"] for p in r["geometry"]] for r in out["links"].filter("node_a = 0 or node_b = 1").collect()))
    assert first == [pytest.approx([0.0, 30.0, 50.0]), pytest.approx([52.0, 100.0])]
    seg = {r["segment_id"]: r for r in out["segments"].collect()}
    found = {(r["from_stop"], r["to_stop"]): r for r in out["leg_paths"].collect()}
    assert found.keys() == {("A", "B"), ("B", "C"), ("c", "b"), ("b", "a")}
    for (a, b), r in found.items():
        assert r["length"] == pytest.approx(0.1)
        steps = [seg[s] for s in r["segments"]]
        assert all(x["to_node"] == y["from_node"] for x, y in zip(steps, steps[1:], strict=False))
        assert (steps[0]["from_node"] < steps[0]["to_node"]) is not None
    end = {stop: seg[found[leg]["segments"][i]][side] for stop, leg, i, side in (("B", ("A", "B"), -1, "to_node"), ("b", ("c", "b"), -1, "to_node"))}
    assert seg[found["B", "C"]["segments"][0]]["from_node"] == end["B"] and seg[found["b", "a"]["segments"][0]]["from_node"] == end["b"]
    assert sorted((r["n_trips"], len(r["timings"]), r["departures"]) for r in out["trips"].collect()) == [(1, 2, [28800]), (2, 1, [32400, 32460]), (2, 2, [21600, 25200])]
    assert {r["external_ids"] for r in out["zones"].collect()} == set("ABCabc")
    assert out["connectoids"].count() == 6 and out["leg_segments"].count() == 4
    nodes = {(r["stop_id"], r["node_id"]) for r in work.mappings()["stop_nodes"].collect()}
    assert len(nodes) == 6 and work.mappings()["stop_zones"].count() == 6
    counts = {r["outcome"]: r["n"] for r in work.counters().collect()}
    assert counts == {"created": 6, "stops": 7, "augmented": 0, "connectoids": 6}


def test_zones_that_are_there_and_overrides(spark, place):
    tables, plan = services(spark, place)
    physical = street(spark)
    zones = [(7, "north", ["B"], 150.0, 6.0, "z7"), (8, "south", ["b"], 152.0, -6.0, "z8"), (9, "unused", ["q"], 299.0, 30.0, "z9")]
    physical["zones"] = spark.createDataFrame(zones, "zone_id long, name string, platforms array<string>, x double, y double, external_id string")
    rows = [(70, 7, 2, 1, 2, ["BUS"]), (80, 8, 3, 1, 1, ["BUS"]), (90, 9, 4, 2, 3, ["BUS"])]
    physical["connectoids"] = spark.createDataFrame(rows, "connectoid_id long, zone_id long, segment_id long, link_id long, access_node long, modes array<string>")
    config = ZoningConfig(projection=geo.Projection(0.0, 0.0), exclude=["a"], force_new=["b"])
    over = {
        "links": spark.createDataFrame([("C", "way 1", "EXTERNAL_ID", 1), ("A", "none", "ID", 1)], "stop_id string, value string, id_type string, pos int"),
        "places": spark.createDataFrame([("A", 40.0, 5.0)], "stop_id string, x double, y double"),
    }
    work = Intermodal(plan, tables["stops"], physical, config, over)
    assert {(r["stop_id"], r["zone_id"]) for r in work.matches.collect()} == {("B", 7)}
    assert {r["stop_id"]: r["link_id"] for r in work.created.collect()} == {"A": 0, "C": 1, "b": 1, "c": 2}
    out = work.results()
    # C has to use the link that ends where B is, so no path leads on to it without turning back.
    assert {(r["from_stop"], r["to_stop"]) for r in out["leg_paths"].collect()} == {("A", "B"), ("c", "b")}
    assert 9 not in {r["zone_id"] for r in out["zones"].collect()} and 90 not in {r["connectoid_id"] for r in out["connectoids"].collect()}
    moved = {r["connectoid_id"]: r for r in work.connectoids.collect()}
    ends = {r["segment_id"]: r["to_node"] for r in work.split.segments.collect()}
    assert all(ends[r["segment_id"]] == r["access_node"] for r in moved.values())
    assert {"B"} <= {x for r in out["zones"].collect() for x in r["external_ids"].split(";")}
