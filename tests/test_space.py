import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from headway.functions import geo
from headway.operators import cells, matching, paths, search, spatial


def line(spark, rows):
    """links of (link_id, node_a, node_b, points)."""
    return spark.createDataFrame([(i, a, b, [{"x": float(x), "y": float(y)} for x, y in pts]) for i, a, b, pts in rows], "link_id long, node_a long, node_b long, geometry array<struct<x:double,y:double>>")


def stops(spark, rows):
    return spark.createDataFrame([(i, float(x), float(y), m, p) for i, x, y, m, p in rows], "stop_id long, x double, y double, mode string, platform_code string")


def segment_distance(p, a, b):
    dx, dy = b[0] - a[0], b[1] - a[1]
    n = dx * dx + dy * dy
    t = max(0, min(1, ((p[0] - a[0]) * dx + (p[1] - a[1]) * dy) / n)) if n else 0
    return (p[0] - a[0] - t * dx) ** 2 + (p[1] - a[1] - t * dy) ** 2


def test_grid_join_equals_nested_loops(spark):
    rng = random.Random(5)
    ps = [(i, rng.uniform(-300, 300), rng.uniform(-300, 300), "BUS", None) for i in range(80)]
    ls = [(i, 0, 0, [(rng.uniform(-300, 300), rng.uniform(-300, 300)) for _ in range(rng.choice([2, 3, 4]))]) for i in range(60)]
    found = {(r["stop_id"], r["link_id"]): r["d2"] for r in spatial.near_links(stops(spark, ps), line(spark, ls)).collect()}
    want = {}
    for (i, x, y, *_), (k, _, _, pts) in itertools.product(ps, ls):
        xs, ys = [p[0] for p in pts], [p[1] for p in pts]
        if max(xs) >= x - 40 and min(xs) <= x + 40 and max(ys) >= y - 40 and min(ys) <= y + 40:
            want[i, k] = min(segment_distance((x, y), a, b) for a, b in itertools.pairwise(pts))
    assert found.keys() == want.keys()
    assert all(math.isclose(found[k], want[k], abs_tol=1e-6) for k in want)


def test_angles_and_projection(spark):
    row = spark.range(1).select(
        geo.azimuth(F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(0.0)), geo.azimuth(F.lit(0.0), F.lit(0.0), F.lit(-1.0), F.lit(0.0)), geo.angle_between(F.lit(350.0), F.lit(20.0)),
        geo.Projection(10.0, 60.0).x(F.lit(10.01)), geo.Projection(10.0, 60.0).y(F.lit(60.01)),
    ).first()
    assert [round(x, 3) for x in row[:3]] == [90.0, 270.0, 30.0]
    assert row[3] == pytest.approx(556.6, abs=0.1) and row[4] == pytest.approx(1113.2, abs=0.1)


def two_way(link_id, a, b, modes=("BUS",), capacity=1.0):
    return [(2 * link_id, link_id, a, b, list(modes), capacity, 0.1, 50.0), (2 * link_id + 1, link_id, b, a, list(modes), capacity, 0.1, 50.0)]


SEGMENTS = "segment_id long, link_id long, from_node long, to_node long, modes array<string>, capacity double, length_km double, speed_kmh double"


def test_side_of_road(spark):
    links = line(spark, [(1, 1, 2, [(0, 0), (100, 0)]), (2, 3, 4, [(0, 200), (100, 200)])])
    segments = spark.createDataFrame(two_way(1, 1, 2) + two_way(2, 3, 4)[:1], SEGMENTS)
    s = stops(spark, [(1, 50, 5, "BUS", None), (2, 50, -5, "BUS", None), (3, 50, 195, "BUS", None), (4, 50, 205, "BUS", None)])
    entries = matching.entry_segments(matching.access_links(s, links, segments), segments)
    assert {(r["stop_id"], r["segment_id"]) for r in entries.collect()} == {(1, 2), (2, 3), (4, 4)}
    right = matching.entry_segments(matching.access_links(s, links, segments), segments, left_hand=False)
    assert {(r["stop_id"], r["segment_id"]) for r in right.collect()} == {(1, 3), (2, 2), (3, 4)}


def test_snap_and_split(spark):
    links = line(spark, [(1, 1, 2, [(0, 0), (100, 0)]), (2, 3, 4, [(0, 100), (2, 100)]), (3, 5, 6, [(0, 200), (100, 200)])])
    segments = spark.createDataFrame(two_way(1, 1, 2) + two_way(2, 3, 4) + two_way(3, 5, 6), SEGMENTS)
    nodes = spark.createDataFrame([(1, 0.0, 0.0), (2, 100.0, 0.0), (3, 0.0, 100.0), (4, 2.0, 100.0), (5, 0.0, 200.0), (6, 100.0, 200.0)], "node_id long, x double, y double")
    s = stops(spark, [(1, 4.9, 1, "BUS", None), (2, 5.1, 1, "BUS", None), (3, 1, 101, "BUS", None), (4, 60, 201, "BUS", None), (5, 30, 199, "BUS", None), (6, 30, 201, "BUS", None)])
    snapped = matching.snapped(matching.access_links(s, links, segments), nodes)
    assert {r["stop_id"]: r["access_node"] for r in snapped.collect()} == {1: 1, 2: None, 3: 4, 4: None, 5: None, 6: None}
    pieces = sorted((r["link_id"], r["piece"], r["x0"], r["x1"]) for r in matching.split_links(links, snapped).collect())
    assert pieces == [(1, 0, 0.0, 5.1), (1, 1, 5.1, 100.0), (2, 0, 0.0, 2.0), (3, 0, 0.0, 30.0), (3, 1, 30.0, 60.0), (3, 2, 60.0, 100.0)]


def test_most_capacity_on_roads(spark):
    links = line(spark, [(1, 1, 2, [(0, 0), (100, 0)]), (2, 3, 4, [(0, 6), (100, 6)])])
    for mode, want in (("BUS", 2), ("TRAIN", 1)):
        segments = spark.createDataFrame(two_way(1, 1, 2, [mode], 1.0) + two_way(2, 3, 4, [mode], 9.0), SEGMENTS)
        assert matching.access_links(stops(spark, [(1, 50, 1, mode, None)]), links, segments).first()["link_id"] == want


def test_platforms_overrides_and_new_zones(spark):
    links = line(spark, [(1, 1, 2, [(0, 0), (100, 0)])])
    segments = spark.createDataFrame(two_way(1, 1, 2), SEGMENTS)
    zones = spark.createDataFrame([(1, "z1", ["A"], 50.0, 10.0, "e1", "x1"), (2, "z2", [], 52.0, 10.0, "e2", "x2"), (3, "z3", ["a"], 50.0, 12.0, None, None)], "zone_id long, name string, platforms array<string>, x double, y double, external_id string, xml_id string")
    connectoids = spark.createDataFrame([(1, 1, 2, 1, 2, ["BUS"]), (2, 2, 2, 1, 2, ["BUS"]), (3, 3, 2, 1, 2, ["TRAIN"])], "connectoid_id long, zone_id long, segment_id long, link_id long, access_node long, modes array<string>")
    s = stops(spark, [(1, 50, 5, "BUS", "a"), (2, 51, 5, "BUS", None), (3, 90, -500, "BUS", None), (4, 95, 4, "TRAM", None)])
    access = matching.access_links(s, links, segments)
    best = matching.matched(matching.zone_candidates(s, zones, connectoids, access))
    assert {r["stop_id"]: (r["zone_id"], r["priority"]) for r in best.collect()} == {1: (1, matching.PLATFORM), 2: (1, matching.ACCESS_LINK)}
    given = spark.createDataFrame([(2, "e2", "EXTERNAL_ID", 1), (2, "x1", "XML_ID", 2), (2, "2", "ID", 3), (1, "none", "ID", 1)], "stop_id long, value string, id_type string, pos int")
    forced = matching.matched(matching.zone_candidates(s, zones, connectoids, access), matching.resolved_overrides(given, zones))
    assert {r["stop_id"]: (r["zone_id"], r["priority"]) for r in forced.collect()} == {1: (1, matching.PLATFORM), 2: (2, matching.OVERRIDE)}
    names = s.withColumn("stop_name", F.concat(F.lit("stop number "), "stop_id"))
    got = {r["zone_id"]: (r["external_ids"], r["name"], sorted(r["platforms"])) for r in matching.attached(zones, forced, names).collect()}
    assert got == {1: ("e1;1", "z1", ["A", "a"]), 2: ("e2;2", "stop number 2", []), 3: ("", "z3", ["a"])}
    box = spatial.bounding_box(spark.createDataFrame([(0.0, 0.0), (100.0, 10.0)], "x double, y double"))
    assert matching.new_zones(s, best.filter("stop_id = 1"), box, access).select("stop_id").collect()[0][0] == 2
    assert spark.range(1).select(matching.last_external_id(F.lit("a,b"))).first()[0] == "b"


def grid(spark, n=4):
    rows, k = [], 0
    for r, c in itertools.product(range(n), range(n)):
        for dr, dc in ((0, 1), (1, 0)):
            if r + dr < n and c + dc < n:
                rows += [(s, l, a, b, m, cap, 0.1 * (1 + (k * 7) % 3), sp) for s, l, a, b, m, cap, _, sp in two_way(k, r * n + c, (r + dr) * n + c + dc, ["BUS", "TRAIN"])]
                k += 1
    return spark.createDataFrame(rows, SEGMENTS)


def test_paths_equal_plain_search_and_joins(spark):
    edges = paths.edges(grid(spark))
    rng = random.Random(2)
    asked = [(i, "BUS", rng.randrange(16), rng.randrange(16), [rng.randrange(40)]) for i in range(20)] + [(99, "FERRY", 0, 1, []), (98, "BUS", 0, 999, [])]
    requests = spark.createDataFrame(asked, "request_id long, mode string, origin long, target long, banned array<long>")
    got = {r["request_id"]: (r["segments"], r["ticks"] / paths.TICKS, r["length"]) for r in paths.shortest(requests, edges).collect()}
    rows = edges.filter("mode = 'BUS'").collect()
    for i, _, origin, target, banned in asked[:20]:
        best = {origin: 0.0}
        for _ in range(20):
            for e in rows:
                if e["segment_id"] not in banned and e["from_node"] in best:
                    best[e["to_node"]] = min(best.get(e["to_node"], 9e9), best[e["from_node"]] + e["cost"])
        assert got[i][1] == pytest.approx(best[target])
        by_id, node = {e["segment_id"]: e for e in rows}, origin
        for s in got[i][0]:
            assert by_id[s]["from_node"] == node and s not in banned
            node = by_id[s]["to_node"]
        assert node == target
    assert 99 not in got and 98 not in got
    few = requests.filter("request_id < 4 or request_id >= 98")
    joined = {r["request_id"]: (r["segments"], r["ticks"] / paths.TICKS) for r in paths.shortest(few, edges, max_bytes=0).collect()}
    assert joined == {i: got[i][:2] for i in range(4)}


def test_ties_go_to_fewer_segments_and_lesser_ids(spark):
    """A grid of equal edges has many best paths; both searches give the one whose ids are least, as a plain enumeration does."""
    n, k, rows = 4, 0, []
    rng = random.Random(4)
    ids = rng.sample(range(1000), 48)
    for r, c in itertools.product(range(n), range(n)):
        for dr, dc in ((0, 1), (1, 0)):
            if r + dr < n and c + dc < n:
                for a, b in ((r * n + c, (r + dr) * n + c + dc), ((r + dr) * n + c + dc, r * n + c)):
                    rows.append((ids[k], k // 2, a, b, ["BUS"], 1.0, 0.1, 50.0))
                    k += 1
    rows.append((2000, 999, 0, 2, ["BUS"], 1.0, 0.2, 50.0))  # as long as two edges, but one segment
    edges = paths.edges(spark.createDataFrame(rows, SEGMENTS))
    asked = [(i, "BUS", a, b, banned) for i, (a, b, banned) in enumerate([(0, 15, []), (0, 15, [2000]), (0, 15, [ids[0]]), (3, 12, []), (5, 5, []), (0, 2, []), (12, 3, [ids[7], ids[20]])])]
    requests = spark.createDataFrame(asked, "request_id long, mode string, origin long, target long, banned array<long>")
    near = {r["request_id"]: (r["segments"], r["ticks"]) for r in paths.shortest(requests, edges).collect()}
    far = {r["request_id"]: (r["segments"], r["ticks"]) for r in paths.shortest(requests, edges, max_bytes=0).collect()}
    out = {}
    for e in rows:
        out.setdefault(e[2], []).append((e[0], e[3], round(e[6] / 50 * paths.TICKS)))
    for i, _, a, b, banned in asked:
        best, front = None, [(0, [], a)]
        for _ in range(8):
            for ticks, path, node in front:
                if node == b and (best is None or (ticks, len(path), path[::-1]) < best):
                    best = (ticks, len(path), path[::-1])
            front = [(t + dt, [*p, s], to) for t, p, v in front for s, to, dt in out[v] if s not in banned and (best is None or t + dt <= best[0])]
        assert near[i] == far[i] == (best[2][::-1], best[0])


def test_a_search_that_is_cut_short_raises(spark):
    edges = paths.edges(grid(spark)).withColumn("ticks", F.lit(1).cast("long"))
    nodes = spark.range(16).selectExpr("id AS node", "id AS cell")
    requests = spark.createDataFrame([(1, "BUS", 0, 15, [])], "request_id long, mode string, origin long, target long, banned array<long>")
    with pytest.raises(RuntimeError, match="after 2 rounds"):
        cells.shortest(requests, edges, nodes, max_rounds=2)


def test_paths_of_a_stop_share_a_node(spark):
    rows = [("a", "b", "BUS", 1, 5, 3.0), ("a", "b", "BUS", 2, 5, 1.0), ("c", "a", "BUS", 7, 1, 2.0), ("a", "d", "BUS", 1, 9, 4.0), ("a", "d", "TRAIN", 2, 9, 4.0)]
    kept = paths.one_node_per_stop(spark.createDataFrame(rows, "from_stop string, to_stop string, mode string, origin long, end long, length double"))
    assert sorted((r["from_stop"], r["to_stop"], r["mode"], r["origin"], r["end"]) for r in kept.collect()) == [("a", "b", "BUS", 1, 5), ("a", "d", "BUS", 1, 9), ("a", "d", "TRAIN", 2, 9), ("c", "a", "BUS", 7, 1)]


def test_legs_take_the_shortest_candidate_and_ban_turning_back(spark):
    segments = grid(spark)
    pairs = spark.createDataFrame([(1, 1), (2, 2), (3, 3)], "stop_id long, zone_id long")
    seg = {r["segment_id"]: r for r in segments.collect()}
    into = lambda node: [s for s, r in seg.items() if r["to_node"] == node]
    rows = [(100 * z + k, z, s, seg[s]["link_id"], seg[s]["to_node"], ["BUS"]) for z, node in ((1, 0), (2, 10)) for k, s in enumerate(into(node))]
    connectoids = spark.createDataFrame(rows, "connectoid_id long, zone_id long, segment_id long, link_id long, access_node long, modes array<string>")
    legs = spark.createDataFrame([(1, 2, "BUS"), (1, 3, "BUS"), (2, 1, "TRAIN")], "from_stop long, to_stop long, mode string")
    requests = paths.requests_for(legs, pairs, connectoids, segments)
    found = paths.leg_paths(requests, paths.edges(segments)).collect()
    assert [(r["from_stop"], r["to_stop"]) for r in found] == [(1, 2)]
    path = found[0]["segments"]
    assert seg[path[-1]]["to_node"] == 10 and seg[path[0]]["from_node"] == 0
    assert all(a ^ 1 != b for a, b in itertools.pairwise(path))
