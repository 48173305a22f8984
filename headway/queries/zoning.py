"""Queries on stops, links, zones, connectoids and paths."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from headway.functions import geo
from headway.operators import matching, network, paths, spatial
from headway.queries.adapter import duckdb, spark_tables

CROWDED = "SELECT o_orderkey AS point_id, CAST(CASE WHEN o_orderkey % 3 = 0 THEN 210 + o_custkey % 61 ELSE o_custkey * 7 % 4900 END AS DOUBLE) AS x, CAST(CASE WHEN o_orderkey % 3 = 0 THEN 105 + o_orderkey % 53 ELSE o_orderkey * 11 % 3900 END AS DOUBLE) AS y FROM {orders}"
PHYSICAL = ("nodes", "links", "segments", "zones", "connectoids")


class _World:
    def __init__(self, spark: SparkSession, sf_dir: str):
        t = spark_tables(spark, sf_dir, "stops", *PHYSICAL)
        self.stops, self.nodes, self.links, self.segments, self.zones, self.connectoids = (t[n] for n in ("stops", *PHYSICAL))
        self.access = matching.access_links(self.stops, self.links, self.segments)
        self.candidates = matching.zone_candidates(self.stops, self.zones, self.connectoids, self.access)
        self.matches = matching.matched(self.candidates)


def _links(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    t = spark_tables(spark, sf_dir, "stops", "links")
    return t["stops"], t["links"]


def network_bbox(spark, sf_dir):
    return spatial.bounding_box(spark_tables(spark, sf_dir, "nodes")["nodes"])


def stops_in_bbox(spark, sf_dir):
    return spatial.in_box(spark_tables(spark, sf_dir, "stops")["stops"], 0.0, 500.0, 0.0, 400.0).select("stop_id", "x", "y", "near_edge")


def stop_near_links(spark, sf_dir):
    return spatial.near_links(*_links(spark, sf_dir)).select("stop_id", "link_id", F.round("d2", 4).alias("d2"))


def crowded_points_near_links(spark, sf_dir):
    """Orders as points, a third of them in one block, near the links around; cells with more than 200 points are quartered."""
    points = spark.sql(CROWDED, orders=spark.read.parquet(f"{sf_dir}/orders.parquet"))
    crowded = spatial.quartered(points, spatial.LINK_RADIUS, 200)
    pairs = spatial.near_links(points, spark_tables(spark, sf_dir, "links")["links"], crowded=crowded)
    return pairs.groupBy("link_id").agg(F.count("*").alias("n_points"), F.round(F.sum("d2"), 2).alias("sum_d2"))


def stop_near_zones(spark, sf_dir):
    t = spark_tables(spark, sf_dir, "stops", "zones")
    return spatial.near_zones(t["stops"], t["zones"]).select("stop_id", "zone_id", "d2")


def closest_link(spark, sf_dir):
    return spatial.closest(spatial.near_links(*_links(spark, sf_dir)), "stop_id", "link_id").select("stop_id", "link_id", "d2")


def links_within_buffer(spark, sf_dir):
    return spatial.within_buffer(spatial.near_links(*_links(spark, sf_dir))).select("stop_id", "link_id")


def side_of_road(spark, sf_dir):
    return matching.sides(*_links(spark, sf_dir)).select("stop_id", "link_id", "side")


def azimuth_diff(spark, sf_dir):
    near = spatial.near_links(*_links(spark, sf_dir))
    a = geo.azimuth(F.col("near.x"), F.col("near.y"), F.col("x"), F.col("y"))
    return near.select("stop_id", "link_id", F.floor(F.round(a, 6) / 45).alias("octant"), F.round(geo.angle_between(a, F.lit(350.0)), 4).alias("from_350"))


def closest_zone(spark, sf_dir):
    t = spark_tables(spark, sf_dir, "stops", "zones")
    return spatial.closest(spatial.near_zones(t["stops"], t["zones"]), "stop_id", "zone_id").select("stop_id", "zone_id", "d2")


def access_link_choice(spark, sf_dir):
    return _World(spark, sf_dir).access.select("stop_id", "link_id", "link_capacity", "d2")


def zone_match_ranked(spark, sf_dir):
    return _World(spark, sf_dir).matches


def match_counters(spark, sf_dir):
    w = _World(spark, sf_dir)
    return matching.counters(w.matches, matching.new_zones(w.stops, w.matches, spatial.bounding_box(w.nodes), w.access))


def new_zones(spark, sf_dir):
    w = _World(spark, sf_dir)
    return matching.new_zones(w.stops, w.matches, spatial.bounding_box(w.nodes), w.access).select("stop_id", "mode", "link_id")


def entry_segments(spark, sf_dir):
    w = _World(spark, sf_dir)
    return matching.entry_segments(w.access, w.segments).select("stop_id", "segment_id", "side")


def connectoids(spark, sf_dir):
    w = _World(spark, sf_dir)
    created = matching.new_zones(w.stops, w.matches, spatial.bounding_box(w.nodes), w.access)
    made = matching.connectoids_for(created, matching.entry_segments(w.access, w.segments))
    return made.select("zone_key", "segment_id", "access_node", F.array_join("modes", ",").alias("modes"))


def snap_or_split(spark, sf_dir):
    w = _World(spark, sf_dir)
    return matching.snapped(w.access, w.nodes).select("stop_id", "link_id", "access_node", "is_new")


def split_links(spark, sf_dir):
    w = _World(spark, sf_dir)
    return matching.split_links(w.links, matching.snapped(w.access, w.nodes)).drop("geometry")


def zone_modes(spark, sf_dir):
    return matching.zone_modes(spark_tables(spark, sf_dir, "connectoids")["connectoids"]).select("zone_id", F.array_join("modes", ",").alias("modes"))


def zone_registry(spark, sf_dir):
    pairs = spark_tables(spark, sf_dir, "stop_times")["stop_times"].selectExpr("stop_id", "trip_id % 100 * 5 AS zone_id", "trip_id * 1000 + stop_sequence AS pos")
    return matching.registry(pairs)


def _overrides(spark, sf_dir) -> DataFrame:
    return spark_tables(spark, sf_dir, "stops")["stops"].selectExpr(
        "stop_id", "CASE stop_id % 3 WHEN 0 THEN CAST(stop_id * 5 AS STRING) ELSE concat('zone ', CAST(stop_id * 5 + stop_id % 2 AS STRING)) END AS value",
        "CASE stop_id % 3 WHEN 0 THEN 'ID' WHEN 1 THEN 'EXTERNAL_ID' ELSE 'XML_ID' END AS id_type", "stop_id AS pos",
    )


def zone_overrides(spark, sf_dir):
    zones = spark_tables(spark, sf_dir, "zones")["zones"].withColumns({"external_id": F.col("name"), "xml_id": F.col("name")})
    return matching.resolved_overrides(_overrides(spark, sf_dir), zones).select("stop_id", "zone_id")


def zones_with_stops(spark, sf_dir):
    w = _World(spark, sf_dir)
    zones = w.zones.withColumn("external_id", F.lit(None).cast("string"))
    return matching.attached(zones, w.matches, w.stops).select("zone_id", "external_ids", "name", F.array_join(F.array_sort("platforms"), ",").alias("platforms"))


def stops_excluded(spark, sf_dir):
    stops = spark_tables(spark, sf_dir, "stops")["stops"]
    return matching.excluded(stops, stops.filter("stop_id % 7 = 3").select("stop_id")).select("stop_id")


def location_override(spark, sf_dir):
    stops = spark_tables(spark, sf_dir, "stops")["stops"]
    given = stops.filter("stop_id % 5 = 1").selectExpr("stop_id", "x + 1 AS x", "y - 2 AS y")
    return spatial.with_locations(stops, given).select("stop_id", "x", "y")


def unused_zone_cascade(spark, sf_dir):
    w = _World(spark, sf_dir)
    groups = w.zones.selectExpr("zone_id DIV 100 AS group_id", "zone_id")
    used = w.connectoids.filter("connectoid_id % 3 = 0 AND zone_id % 10 = 0")
    left, zones, kept = network.unused_cascade(w.connectoids, w.zones, groups, used)
    count = lambda df, kind, key: df.agg(F.countDistinct(key).alias("n"), F.sum(key).alias("total")).select(F.lit(kind).alias("kind"), "n", "total")
    return count(left, "connectoid", "connectoid_id").unionByName(count(zones, "zone", "zone_id")).unionByName(count(kept, "group", "group_id"))


def link_costs(spark, sf_dir):
    segments = spark_tables(spark, sf_dir, "segments")["segments"]
    return paths.edges(segments).select("segment_id", "mode", F.round("cost", 9).alias("cost"))


QUERIES = {
    f.__name__: f
    for f in (
        network_bbox, stops_in_bbox, stop_near_links, crowded_points_near_links, stop_near_zones, closest_link, links_within_buffer, side_of_road, azimuth_diff, closest_zone, access_link_choice,
        zone_match_ranked, match_counters, new_zones, entry_segments, connectoids, snap_or_split, split_links, zone_modes, zone_registry, zone_overrides, zones_with_stops,
        stops_excluded, location_override, unused_zone_cascade, link_costs,
    )
}

# -- the same in SQL ----------------------------------------------------------
_T = "greatest(0.0, least(1.0, ((s.x - l.x0) * (l.x1 - l.x0) + (s.y - l.y0) * (l.y1 - l.y0)) / ((l.x1 - l.x0) * (l.x1 - l.x0) + (l.y1 - l.y0) * (l.y1 - l.y0))))"
_STEPS = {
    "pair": f"""SELECT q.*, (x - nx) * (x - nx) + (y - ny) * (y - ny) AS d2 FROM (SELECT s.*, l.*, l.x0 + {_T} * (l.x1 - l.x0) AS nx, l.y0 + {_T} * (l.y1 - l.y0) AS ny FROM stops s, links l
        WHERE greatest(l.x0, l.x1) >= s.x - 40 AND least(l.x0, l.x1) <= s.x + 40 AND greatest(l.y0, l.y1) >= s.y - 40 AND least(l.y0, l.y1) <= s.y + 40) q""",
    "zpair": "SELECT s.stop_id, s.mode, s.platform_code, s.x, s.y, z.zone_id, z.platforms, z.x AS zx, z.y AS zy, (s.x - z.x) * (s.x - z.x) + (s.y - z.y) * (s.y - z.y) AS d2 FROM stops s JOIN zones z ON abs(s.x - z.x) <= 40 AND abs(s.y - z.y) <= 40",
    "lmode": "SELECT link_id, min(modes) AS modes, max(capacity) AS link_capacity FROM segments GROUP BY link_id",
    "cand": "SELECT p.*, m.link_capacity FROM pair p JOIN lmode m ON m.link_id = p.link_id WHERE list_contains(string_split(m.modes, ','), p.mode) AND p.d2 <= 1600",
    "chosen": """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY stop_id ORDER BY CASE WHEN mode = 'BUS' THEN link_capacity ELSE 0 END DESC, d2, link_id) AS pick FROM (
        SELECT *, min(sqrt(d2)) OVER (PARTITION BY stop_id) AS nearest FROM cand) q WHERE sqrt(d2) <= nearest + 8) r WHERE pick = 1""",
    "zmode": "SELECT zone_id, list_sort(list_distinct(flatten(list(string_split(modes, ','))))) AS zm, list_distinct(list(link_id)) AS zl FROM connectoids GROUP BY zone_id",
    "option": """SELECT stop_id, zone_id, priority, d2 FROM (SELECT p.stop_id, p.zone_id, p.d2, CASE WHEN lower(p.platforms) = lower(p.platform_code) THEN 3 WHEN list_contains(m.zl, c.link_id) AND p.d2 <= 6400 THEN 4
        WHEN least(abs(az1 - az2), 360 - abs(az1 - az2)) < 100 THEN 5 END AS priority FROM zpair p JOIN zmode m ON m.zone_id = p.zone_id AND list_contains(m.zm, p.mode) LEFT JOIN chosen c ON c.stop_id = p.stop_id,
        LATERAL (SELECT (degrees(atan2(p.x - c.nx, p.y - c.ny)) + 360) % 360 AS az1, (degrees(atan2(p.zx - c.nx, p.zy - c.ny)) + 360) % 360 AS az2) a) q WHERE priority IS NOT NULL""",
    "best": "SELECT stop_id, zone_id, CAST(priority AS INT) AS priority FROM (SELECT *, row_number() OVER (PARTITION BY stop_id ORDER BY priority, d2, zone_id) AS pick FROM option) q WHERE pick = 1",
    "fresh": "SELECT s.stop_id, s.mode, c.link_id FROM stops s JOIN chosen c ON c.stop_id = s.stop_id, (SELECT min(x) a, max(x) b, min(y) c, max(y) d FROM nodes) n WHERE s.stop_id NOT IN (SELECT stop_id FROM best) AND s.x BETWEEN n.a AND n.b AND s.y BETWEEN n.c AND n.d",
    "entry": """SELECT stop_id, mode, segment_id, to_node, side FROM (SELECT c.stop_id, c.mode, g.segment_id, g.to_node, CASE WHEN c.cr = 0 THEN 'ON' WHEN (c.cr > 0) = (g.from_node = c.node_a) THEN 'LEFT' ELSE 'RIGHT' END AS side
        FROM (SELECT *, (x1 - x0) * (y - ny) - (y1 - y0) * (x - nx) AS cr FROM chosen) c JOIN segments g ON g.link_id = c.link_id AND list_contains(string_split(g.modes, ','), c.mode)) q WHERE mode <> 'BUS' OR side <> 'RIGHT'""",
    "snapped": """SELECT stop_id, link_id, nx, ny, CASE WHEN (nx - x1) * (nx - x1) + (ny - y1) * (ny - y1) <= 25 THEN node_b WHEN (nx - x0) * (nx - x0) + (ny - y0) * (ny - y0) <= 25 THEN node_a END AS access_node FROM chosen""",
    "point": """SELECT link_id, x0 AS x, y0 AS y, 0 AS d, 0 AS kind FROM links UNION ALL SELECT link_id, x1, y1, 1e9, 2 FROM links
        UNION ALL SELECT DISTINCT l.link_id, s.nx, s.ny, (s.nx - l.x0) * (s.nx - l.x0) + (s.ny - l.y0) * (s.ny - l.y0), 1 FROM snapped s JOIN links l ON l.link_id = s.link_id WHERE s.access_node IS NULL""",
}


def _sql(text: str) -> str:
    needed, todo = set(), [text]
    while todo:
        now = todo.pop()
        found = {s for s in _STEPS if re.search(rf"\b{s}\b", now)} - needed
        needed |= found
        todo += [_STEPS[s] for s in found]
    return duckdb(("WITH " + ", ".join(f"{s} AS ({_STEPS[s]})" for s in _STEPS if s in needed) + " " + text) if needed else text)


_SPEED = "CASE m WHEN 'FERRY' THEN 40.0 ELSE 50.0 END"
SQL = {
    name: _sql(text)
    for name, text in {
        "network_bbox": "SELECT min(x) AS x_min, max(x) AS x_max, min(y) AS y_min, max(y) AS y_max FROM nodes",
        "stops_in_bbox": "SELECT stop_id, x, y, least(x, 500 - x, y, 400 - y) <= 100 AS near_edge FROM stops WHERE x BETWEEN 0 AND 500 AND y BETWEEN 0 AND 400",
        "stop_near_links": "SELECT stop_id, link_id, round(d2, 4) AS d2 FROM pair",
        "crowded_points_near_links": f"""SELECT link_id, count(*) AS n_points, round(sum((x - nx) * (x - nx) + (y - ny) * (y - ny)), 2) AS sum_d2 FROM (SELECT s.x, s.y, l.link_id, l.x0 + {_T} * (l.x1 - l.x0) AS nx, l.y0 + {_T} * (l.y1 - l.y0) AS ny
            FROM ({CROWDED.replace("{orders}", "orders")}) s, links l WHERE greatest(l.x0, l.x1) >= s.x - 40 AND least(l.x0, l.x1) <= s.x + 40 AND greatest(l.y0, l.y1) >= s.y - 40 AND least(l.y0, l.y1) <= s.y + 40) q GROUP BY link_id""",
        "stop_near_zones": "SELECT stop_id, zone_id, d2 FROM zpair",
        "closest_link": "SELECT stop_id, link_id, d2 FROM (SELECT *, row_number() OVER (PARTITION BY stop_id ORDER BY d2, link_id) AS pick FROM pair) q WHERE pick = 1",
        "links_within_buffer": "SELECT stop_id, link_id FROM (SELECT *, min(sqrt(d2)) OVER (PARTITION BY stop_id) AS nearest FROM pair) q WHERE sqrt(d2) <= nearest + 8",
        "side_of_road": "SELECT stop_id, link_id, CASE WHEN cr > 0 THEN 'LEFT' WHEN cr < 0 THEN 'RIGHT' ELSE 'ON' END AS side FROM (SELECT *, (x1 - x0) * (y - ny) - (y1 - y0) * (x - nx) AS cr FROM pair) q",
        "azimuth_diff": "SELECT stop_id, link_id, CAST(floor(round(a, 6) / 45) AS BIGINT) AS octant, round(least(abs(a - 350), 360 - abs(a - 350)), 4) AS from_350 FROM (SELECT *, (degrees(atan2(x - nx, y - ny)) + 360) % 360 AS a FROM pair) q",
        "closest_zone": "SELECT stop_id, zone_id, d2 FROM (SELECT *, row_number() OVER (PARTITION BY stop_id ORDER BY d2, zone_id) AS pick FROM zpair) q WHERE pick = 1",
        "access_link_choice": "SELECT stop_id, link_id, link_capacity, d2 FROM chosen",
        "zone_match_ranked": "SELECT * FROM best",
        "match_counters": "SELECT CASE priority WHEN 3 THEN 'platform' WHEN 4 THEN 'access_link' ELSE 'angle' END AS outcome, count(*) AS n FROM best GROUP BY ALL UNION ALL SELECT 'created', count(*) FROM fresh",
        "new_zones": "SELECT * FROM fresh",
        "entry_segments": "SELECT stop_id, segment_id, side FROM entry",
        "connectoids": "SELECT f.stop_id AS zone_key, e.segment_id, e.to_node AS access_node, f.mode AS modes FROM fresh f JOIN entry e ON e.stop_id = f.stop_id",
        "snap_or_split": "SELECT stop_id, link_id, access_node, access_node IS NULL AS is_new FROM snapped",
        "split_links": "SELECT link_id, CAST(row_number() OVER w - 1 AS INT) AS piece, x AS x0, y AS y0, lead(x) OVER w AS x1, lead(y) OVER w AS y1 FROM point WINDOW w AS (PARTITION BY link_id ORDER BY kind, d) QUALIFY lead(x) OVER w IS NOT NULL",
        "zone_modes": "SELECT zone_id, array_to_string(zm, ',') AS modes FROM zmode",
        "zone_registry": "SELECT stop_id, arg_max(trip_id % 100 * 5, trip_id * 1000 + stop_sequence) AS zone_id FROM stop_times GROUP BY stop_id",
        "zone_overrides": "SELECT s.stop_id, z.zone_id FROM stops s JOIN zones z ON CASE s.stop_id % 3 WHEN 0 THEN z.zone_id = s.stop_id * 5 ELSE z.name = concat('zone ', s.stop_id * 5 + s.stop_id % 2) END",
        "zones_with_stops": """SELECT z.zone_id, coalesce(array_to_string(list_sort(list(CAST(b.stop_id AS VARCHAR)) FILTER (b.stop_id IS NOT NULL)), ';'), '') AS external_ids, z.name,
            array_to_string(list_sort(list_distinct(list_append(list(s.platform_code) FILTER (s.platform_code IS NOT NULL), z.platforms))), ',') AS platforms
            FROM zones z LEFT JOIN best b ON b.zone_id = z.zone_id LEFT JOIN stops s ON s.stop_id = b.stop_id GROUP BY z.zone_id, z.name, z.platforms""",
        "stops_excluded": "SELECT stop_id FROM stops WHERE stop_id % 7 <> 3",
        "location_override": "SELECT stop_id, CASE WHEN stop_id % 5 = 1 THEN x + 1 ELSE x END AS x, CASE WHEN stop_id % 5 = 1 THEN y - 2 ELSE y END AS y FROM stops",
        "unused_zone_cascade": """SELECT 'connectoid' AS kind, count(*) AS n, CAST(sum(connectoid_id) AS BIGINT) AS total FROM connectoids WHERE connectoid_id % 3 = 0 AND zone_id % 10 = 0
            UNION ALL SELECT 'zone', count(*), CAST(sum(zone_id) AS BIGINT) FROM (SELECT DISTINCT zone_id FROM connectoids WHERE connectoid_id % 3 = 0 AND zone_id % 10 = 0) q
            UNION ALL SELECT 'group', count(DISTINCT zone_id DIV 100), CAST(sum(zone_id DIV 100) AS BIGINT) FROM (SELECT DISTINCT zone_id FROM connectoids WHERE connectoid_id % 3 = 0 AND zone_id % 10 = 0) q""",
        "link_costs": f"SELECT segment_id, m AS mode, round(0.1 / {_SPEED}, 9) AS cost FROM (SELECT segment_id, unnest(string_split(modes, ',')) AS m FROM segments) q",
    }.items()
}
