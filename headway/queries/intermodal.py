"""Queries on feeds as files, on rules for stops and zones, and on the whole intermodal conversion."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from headway.functions import geo, modes
from headway.functions.modes import ModeMap
from headway.operators import ids, matching, network, paths, spatial, splitting
from headway.plans.intermodal import Intermodal, ZoningConfig
from headway.plans.services import from_feed
from headway.queries import services, zoning
from headway.queries.adapter import duckdb, spark_tables
from headway.sources.feed import Feed
from headway.sources.tables import released, shared, written


def _world(spark: SparkSession, sf_dir: str) -> zoning._World:
    """The world with its tables written in the order in which each follows from the ones before."""
    w = zoning._World(spark, sf_dir)
    w.links, w.segments, w.connectoids = written(w.links), written(w.segments), written(w.connectoids)
    w.access = written(matching.access_links(w.stops, w.links, w.segments))
    released(spark)
    w.candidates = written(matching.zone_candidates(w.stops, w.zones, w.connectoids, w.access))
    w.matches = written(matching.matched(w.candidates))
    released(spark)
    return w


# -- feeds -------------------------------------------------------------------

def _feed(spark: SparkSession, sf_dir: str, *names: str) -> Feed:
    """The star tables as files of a feed, written to the shared folder and read back."""
    folder = shared(spark, "feed")
    t = spark_tables(spark, sf_dir, *names)
    clock = lambda c: F.format_string("%02d:%02d:%02d", F.floor(F.col(c) / 3600), F.floor(F.col(c) / 60) % 60, F.col(c) % 60)
    shapes = {
        "stop_times": lambda d: d.select(F.col("stop_sequence").alias(" Stop_Sequence"), "trip_id", clock("arr").alias("arrival_time"), clock("dep").alias("departure_time"), "stop_id", F.lit("x").alias("extra")),
        "stops": lambda d: d.select("stop_id", F.concat("stop_name", F.lit(', "main"')).alias("stop_name"), F.col("y").alias("stop_lat"), F.col("x").alias("stop_lon"), F.when(F.col("stop_id") % 5 == 0, "1").when(F.col("stop_id") % 5 == 1, "").otherwise("0").alias("location_type"), "platform_code"),
    }
    for name in names:
        df = shapes.get(name, lambda d: d)(t[name])
        df.select(*[F.col(c).cast("string") for c in df.columns]).write.csv(f"{folder}/{name}.txt", header=True, quote='"', escape='"')
    return Feed(spark, folder)


def feed_stop_times(spark, sf_dir):
    feed = _feed(spark, sf_dir, "routes", "calendar", "trips", "stop_times")
    return from_feed(feed.tables())["stop_times"].select("trip_id", "stop_id", "stop_sequence", "arr", "dep")


def feed_stops(spark, sf_dir):
    feed = _feed(spark, sf_dir, "routes", "calendar", "trips", "stop_times", "stops")
    at = geo.Projection(10.0, 0.0)
    rows = from_feed(feed.tables())["stops"]
    return rows.select("stop_id", "stop_name", F.round(at.x(F.col("lon")), 2).alias("x"), F.round(at.y(F.col("lat")), 2).alias("y"))


def feed_row_counts(spark, sf_dir):
    """Rows of each table as counted while it is read."""
    names = ("routes", "calendar", "trips", "stop_times")
    feed, rows = _feed(spark, sf_dir, *names), []
    for name in names:
        df, seen = feed.counted(name)
        df.write.format("noop").mode("overwrite").save()
        rows.append((f"{name}.txt", seen.get["rows"]))
    return spark.createDataFrame(rows, "file string, n_rows long")


def feed_services(spark, sf_dir):
    """Trips and stop times by mode, from files."""
    from headway.plans.services import Services, ServicesConfig

    tables = from_feed(_feed(spark, sf_dir, *services.CORE).tables())
    return Services(tables, ServicesConfig("thursday", periods=services.PERIODS, exclude_names=services.EXCLUDED)).summary()


# -- rules -------------------------------------------------------------------

def _several(spark, sf_dir) -> zoning._World:
    """The world where stops serve a second mode, and zones are looked up 300 metres around."""
    w = zoning._World(spark, sf_dir)
    second = w.stops.withColumn("mode", F.when(F.col("stop_id") % 3 == 0, "BUS").when(F.col("stop_id") % 3 == 1, "FERRY").otherwise("TRAIN"))
    w.stops = written(w.stops.unionByName(second).dropDuplicates(["stop_id", "mode"]))
    w.access = written(matching.access_links(w.stops, w.links, w.segments))
    return w


def zone_conflicts(spark, sf_dir):
    """Stops whose modes fit different zones best."""
    w = _several(spark, sf_dir)
    found = matching.conflicts(matching.zone_candidates(w.stops, w.zones, w.connectoids, w.access, 300.0))
    return found.select("stop_id", F.array_join(F.transform("zones", lambda z: F.concat(z["mode"], F.lit(" "), z["zone_id"].cast("string"))), ",").alias("zones"))


def connectoids_of_several_modes(spark, sf_dir):
    """Connectoids of new zones for stops of several modes: one zone a stop, modes that all segments of a stop and mode allow."""
    w = _several(spark, sf_dir)
    made = matching.connectoids_for(w.stops.select("stop_id", "mode"), matching.entry_segments(w.access, w.segments), ModeMap().rows(spark))
    return made.select("zone_key", "segment_id", "access_node", F.array_join("modes", ",").alias("modes"))


def link_overrides(spark, sf_dir):
    w = zoning._World(spark, sf_dir)
    links = w.links.withColumn("external_id", F.concat(F.lit("way "), F.col("link_id").cast("string")))
    given = w.stops.selectExpr("stop_id", "CASE stop_id % 3 WHEN 0 THEN CAST(stop_id * 2 AS STRING) ELSE concat('way ', CAST(stop_id * 2 + 1 AS STRING)) END AS value", "CASE stop_id % 3 WHEN 0 THEN 'ID' WHEN 1 THEN 'EXTERNAL_ID' ELSE 'XML_ID' END AS id_type", "1 AS pos")
    return matching.access_links(w.stops, links, w.segments, matching.link_overrides(given, links)).select("stop_id", "link_id")


def joint_rules(spark, sf_dir):
    w = _world(spark, sf_dir)
    listed = lambda cond: w.stops.filter(cond).select("stop_id")
    return matching.matched(w.candidates, force_new=listed("stop_id % 5 = 2"), no_joint=listed("stop_id % 2 = 0"))


def zone_sides(spark, sf_dir):
    w = zoning._World(spark, sf_dir)
    pairs = spatial.near_zones(w.stops, w.zones)
    return matching.on_driving_side(pairs, w.connectoids, w.segments, w.links)


def zone_match_sides(spark, sf_dir):
    w = _world(spark, sf_dir)
    side = matching.on_driving_side(spatial.near_zones(w.stops, w.zones), w.connectoids, w.segments, w.links)
    compatible = modes.compatibility(ModeMap().rows(spark))
    return matching.matched(matching.zone_candidates(w.stops, w.zones, w.connectoids, w.access, compatible=compatible, side=side))


def closest_zone_access(spark, sf_dir):
    w = zoning._World(spark, sf_dir)
    pairs = spatial.to_access_nodes(spatial.near_zones(w.stops, w.zones), w.connectoids, w.nodes)
    return spatial.closest(pairs, "stop_id", "zone_id").select("stop_id", "zone_id", "d2")


def connectoids_by_node(spark, sf_dir):
    """At both ends of the stops' links."""
    w = zoning._World(spark, sf_dir)
    at = w.access.select(F.explode(F.array("node_a", "node_b")).alias("node_id"))
    return matching.connectoids_at(at, w.connectoids).select("node_id", "connectoid_id", "zone_id", "segment_id")


def widened_connectoids(spark, sf_dir):
    w = _world(spark, sf_dir)
    more = matching.widened(w.connectoids, w.matches, w.stops, w.segments, modes.compatibility(ModeMap().rows(spark)))
    return more.select("connectoid_id", F.array_join("modes", ",").alias("modes"))


def zoning_counters(spark, sf_dir):
    w = _world(spark, sf_dir)
    created = matching.new_zones(w.stops, w.matches, spatial.bounding_box(w.nodes), w.access)
    made = matching.connectoids_for(created, matching.entry_segments(w.access, w.segments))
    return matching.counters(w.matches, created, w.stops, made)


def stops_by_active_mode(spark, sf_dir):
    s, t = services._services(spark, sf_dir), spark_tables(spark, sf_dir, "stops")
    kept = matching.served(t["stops"].drop("mode"), network.stop_modes(s.stop_times), ["BUS", "FERRY"])
    return kept.select("stop_id", F.array_join("modes", ",").alias("modes"))


def numbered_nodes(spark, sf_dir):
    return ids.numbered(services._services(spark, sf_dir).nodes, ["stop_id"], "node_id", 1)


def appended_ids(spark, sf_dir):
    routes = spark_tables(spark, sf_dir, "routes")["routes"]
    given = F.concat((F.col("route_id") % 7).cast("string"), F.lit(";"), (F.col("route_id") % 3).cast("string"))
    return routes.select("route_id", ids.appended(given, (F.col("route_id") % 5).cast("string")).alias("external_ids"))


# -- paths and what follows from them -----------------------------------------

def _with_legs(spark, sf_dir) -> services.Services:
    """The services with their legs written, for queries that need them before and after paths are found."""
    s = services._services(spark, sf_dir)
    s.legs = written(s.legs.select("trip_id", "route_id", "mode", "from_stop", "to_stop", "arr", "duration", "dwell", "nth", "too_long"))
    s.segments = network.leg_segments(s.legs)
    released(spark)
    return s


def _leg_paths(spark, sf_dir, s) -> DataFrame:
    w = _world(spark, sf_dir)
    requests = paths.requests_for(s.segments, w.matches, w.connectoids, w.segments)
    return paths.leg_paths(requests, paths.edges(w.segments))


def mapped_service_network(spark, sf_dir):
    s = _with_legs(spark, sf_dir)
    return network.mapped_network(s.segments, written(_leg_paths(spark, sf_dir, s)))


def truncated_trips(spark, sf_dir):
    s = _with_legs(spark, sf_dir)
    parts = network.truncated(s.legs, written(_leg_paths(spark, sf_dir, s)))
    return parts.groupBy("trip_id", "part").agg(F.count("*").alias("n_legs"), F.min("nth").alias("first_leg"), F.sum("duration").alias("duration"))


def consolidated_parts(spark, sf_dir):
    """Parts of trips, equal ones as one again."""
    s = _with_legs(spark, sf_dir)
    rows = network.consolidated(network.part_schedules(network.truncated(s.legs, written(_leg_paths(spark, sf_dir, s)))))
    return rows.select("route_id", "mode", services._timings().alias("timings"), "n_trips", F.array_join(F.transform("departures", lambda d: d.cast("string")), ",").alias("departures"))


def path_requests(spark, sf_dir):
    """Candidate searches of all legs."""
    s, w = services._services(spark, sf_dir), _world(spark, sf_dir)
    found = paths.requests_for(s.segments, w.matches, w.connectoids, w.segments)
    return found.select("from_stop", "to_stop", "mode", "origin", "target", "end", "last", F.array_join(F.transform("banned", lambda b: b.cast("string")), ",").alias("banned"))


def leg_shortest_path(spark, sf_dir):
    """The path of every leg of the service network that has one."""
    found = _leg_paths(spark, sf_dir, services._services(spark, sf_dir))
    shown = F.array_join(F.transform("segments", lambda i: i.cast("string")), ",")
    return found.select("from_stop", "to_stop", "mode", F.size("segments").alias("n_segments"), F.round("length", 6).alias("length_km"), F.round("cost", 6).alias("hours"), shown.alias("segments"))


def cut_network(spark, sf_dir):
    """All segments of the network cut at the new nodes of stops: where they begin and end, their share of the length, their modes."""
    w = zoning._World(spark, sf_dir)
    split = splitting.split_network(w.nodes, w.links, w.segments, written(matching.snapped(w.access, w.nodes)))
    end = lambda node, k: split.nodes.select(F.col("node_id").alias(node), F.col("x").alias(f"x{k}"), F.col("y").alias(f"y{k}"))
    rows = split.segments.join(end("from_node", 0), "from_node").join(end("to_node", 1), "to_node")
    return rows.select("x0", "y0", "x1", "y1", F.round("length_km", 6).alias("length_km"), F.array_join("modes", ",").alias("modes"))


def _intermodal(spark, sf_dir) -> Intermodal:
    t = spark_tables(spark, sf_dir, "stops", "nodes", "links", "segments")
    return Intermodal(services._services(spark, sf_dir), t["stops"], {k: t[k] for k in ("nodes", "links", "segments")}, ZoningConfig())


def intermodal_zones(spark, sf_dir):
    """Zones of a conversion on a network without any."""
    rows = _intermodal(spark, sf_dir).zones
    return rows.select("zone_id", "external_ids", "name", "x", "y", F.array_join("modes", ",").alias("modes"))


def intermodal_paths(spark, sf_dir):
    rows = _intermodal(spark, sf_dir).leg_paths
    return rows.select("from_stop", "to_stop", "mode", F.size("segments").alias("n_segments"), F.round("length", 6).alias("length_km"))


QUERIES = {
    f.__name__: f
    for f in (
        feed_stop_times, feed_stops, feed_row_counts, feed_services, zone_conflicts, connectoids_of_several_modes, link_overrides, joint_rules, zone_sides, zone_match_sides, closest_zone_access, connectoids_by_node,
        widened_connectoids, zoning_counters, stops_by_active_mode, numbered_nodes, appended_ids, mapped_service_network, truncated_trips, consolidated_parts,
        path_requests, leg_shortest_path, cut_network, intermodal_zones, intermodal_paths,
    )
}

# -- the same in SQL ----------------------------------------------------------
_SIDE = f"""SELECT zp.stop_id, zp.zone_id, zp.mode, CASE WHEN (l.x1 - l.x0) * (zp.y - (l.y0 + {{t}} * (l.y1 - l.y0))) - (l.y1 - l.y0) * (zp.x - (l.x0 + {{t}} * (l.x1 - l.x0))) = 0 THEN true
    ELSE ((l.x1 - l.x0) * (zp.y - (l.y0 + {{t}} * (l.y1 - l.y0))) - (l.y1 - l.y0) * (zp.x - (l.x0 + {{t}} * (l.x1 - l.x0))) > 0) = (g.from_node = l.node_a) END AS good
    FROM zpair zp JOIN connectoids c ON c.zone_id = zp.zone_id AND list_contains(string_split(c.modes, ','), zp.mode) JOIN segments g ON g.segment_id = c.segment_id JOIN links l ON l.link_id = g.link_id""".format(t=zoning._T.replace("s.x", "zp.x").replace("s.y", "zp.y"))
def _chosen(stops: str) -> str:
    """The link of each stop and mode of a step."""
    return f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY stop_id, mode ORDER BY CASE WHEN mode = 'BUS' THEN link_capacity ELSE 0 END DESC, d2, link_id) AS pick FROM (SELECT *, min(sqrt(d2)) OVER (PARTITION BY stop_id, mode) AS nearest FROM (
        SELECT c.*, m.link_capacity FROM (SELECT q.*, (x - nx) * (x - nx) + (y - ny) * (y - ny) AS d2 FROM (SELECT s.*, l.*, l.x0 + {zoning._T} * (l.x1 - l.x0) AS nx, l.y0 + {zoning._T} * (l.y1 - l.y0) AS ny FROM {stops} s, links l
        WHERE greatest(l.x0, l.x1) >= s.x - 40 AND least(l.x0, l.x1) <= s.x + 40 AND greatest(l.y0, l.y1) >= s.y - 40 AND least(l.y0, l.y1) <= s.y + 40) q) c JOIN lmode m ON m.link_id = c.link_id
        WHERE list_contains(string_split(m.modes, ','), c.mode) AND c.d2 <= 1600) q) r WHERE sqrt(d2) <= nearest + 8) t WHERE pick = 1"""


def _entry(chosen: str) -> str:
    """The segments by which stops may be entered from the links of a step."""
    return f"""SELECT stop_id, mode, segment_id, to_node, modes FROM (SELECT c.stop_id, c.mode, g.segment_id, g.to_node, g.modes, CASE WHEN c.cr = 0 THEN 'ON' WHEN (c.cr > 0) = (g.from_node = c.node_a) THEN 'LEFT' ELSE 'RIGHT' END AS side
        FROM (SELECT *, (x1 - x0) * (y - ny) - (y1 - y0) * (x - nx) AS cr FROM {chosen}) c JOIN segments g ON g.link_id = c.link_id AND list_contains(string_split(g.modes, ','), c.mode)) q WHERE mode <> 'BUS' OR side <> 'RIGHT'"""


_STEPS = zoning._STEPS | services._STEPS | {
    "compat": "SELECT DISTINCT a.mode, b.mode AS with_mode FROM mode_map a JOIN mode_map b USING (route_type)",
    "sided": f"SELECT stop_id, zone_id, bool_or(good) AS any_on_side, bool_and(good) AS all_on_side FROM ({_SIDE}) q GROUP BY stop_id, zone_id",
    "leg3": """SELECT * FROM (SELECT trip_id, route_id, mode, lag(stop_id) OVER w AS from_stop, stop_id AS to_stop, arr - lag(dep) OVER w AS duration, dep - arr AS dwell, lag(dep) OVER w AS started, row_number() OVER w AS nth
        FROM begun WINDOW w AS (PARTITION BY trip_id ORDER BY stop_sequence)) q WHERE nth > 1""",
    "cut_piece": "SELECT link_id, x AS px, y AS py, lead(x) OVER w AS qx, lead(y) OVER w AS qy FROM point WINDOW w AS (PARTITION BY link_id ORDER BY kind, d) QUALIFY lead(x) OVER w IS NOT NULL",
    "many": "SELECT stop_id, platform_code, x, y, mode FROM stops UNION SELECT stop_id, platform_code, x, y, CASE stop_id % 3 WHEN 0 THEN 'BUS' WHEN 1 THEN 'FERRY' ELSE 'TRAIN' END FROM stops",
    "mchosen": _chosen("many"),
    "moption": """SELECT stop_id, mode, zone_id, priority, d2 FROM (SELECT p.stop_id, p.mode, p.zone_id, p.d2, CASE WHEN lower(p.platforms) = lower(p.platform_code) THEN 3 WHEN list_contains(m.zl, c.link_id) AND p.d2 <= 115600 THEN 4
        WHEN least(abs(az1 - az2), 360 - abs(az1 - az2)) < 100 THEN 5 END AS priority FROM (SELECT s.stop_id, s.mode, s.platform_code, s.x, s.y, z.zone_id, z.platforms, z.x AS zx, z.y AS zy, (s.x - z.x) * (s.x - z.x) + (s.y - z.y) * (s.y - z.y) AS d2
        FROM many s JOIN zones z ON abs(s.x - z.x) <= 300 AND abs(s.y - z.y) <= 300) p JOIN zmode m ON m.zone_id = p.zone_id AND list_contains(m.zm, p.mode) LEFT JOIN mchosen c ON c.stop_id = p.stop_id AND c.mode = p.mode,
        LATERAL (SELECT (degrees(atan2(p.x - c.nx, p.y - c.ny)) + 360) % 360 AS az1, (degrees(atan2(p.zx - c.nx, p.zy - c.ny)) + 360) % 360 AS az2) a) q WHERE priority IS NOT NULL""",
    "mentry": _entry("mchosen"),
    # The conversion of a network without zones: stops by the modes of the trips that call there.
    "called": "SELECT DISTINCT s.stop_id, s.stop_name, s.platform_code, s.x, s.y, b.mode FROM stops s JOIN begun b ON b.stop_id = s.stop_id",
    "vchosen": _chosen("called"),
    "ventry": _entry("vchosen"),
    "vplace": """SELECT stop_id, mode, link_id, CASE WHEN (nx - x1) * (nx - x1) + (ny - y1) * (ny - y1) <= 25 THEN node_b WHEN (nx - x0) * (nx - x0) + (ny - y0) * (ny - y0) <= 25 THEN node_a END AS access_node FROM vchosen
        WHERE x BETWEEN (SELECT min(x) FROM nodes) AND (SELECT max(x) FROM nodes) AND y BETWEEN (SELECT min(y) FROM nodes) AND (SELECT max(y) FROM nodes)""",
    "vown": "SELECT c.stop_id, c.mode, e.segment_id, e.modes FROM vplace c JOIN ventry e ON e.stop_id = c.stop_id AND e.mode = c.mode WHERE c.access_node IS NULL OR e.to_node = c.access_node",
    "vaccess": """SELECT * FROM vown UNION ALL SELECT c.stop_id, c.mode, g.segment_id, g.modes FROM (SELECT * FROM vplace ANTI JOIN vown USING (stop_id, mode)) c
        JOIN segments g ON g.to_node = c.access_node AND list_contains(string_split(g.modes, ','), c.mode) AND g.link_id <> c.link_id""",
    "vmodes": """SELECT e.stop_id, string_agg(DISTINCT u.with_mode, ',' ORDER BY u.with_mode) AS modes FROM vaccess e JOIN compat u ON u.mode = e.mode
        WHERE NOT EXISTS (SELECT 1 FROM vaccess o WHERE o.stop_id = e.stop_id AND o.mode = e.mode AND NOT list_contains(string_split(o.modes, ','), u.with_mode)) GROUP BY e.stop_id""",
    "asked": """SELECT DISTINCT l.from_stop, l.to_stop, l.mode, c.access_node AS origin, g.from_node AS target, d.access_node AS finish, d.segment_id AS last,
            list_sort(list_distinct(list_filter([CASE WHEN d.segment_id % 2 = 0 THEN d.segment_id + 1 ELSE d.segment_id - 1 END, CASE WHEN l.mode = 'BUS' THEN CASE WHEN c.segment_id % 2 = 0 THEN c.segment_id + 1 ELSE c.segment_id - 1 END END], lambda x: x IS NOT NULL))) AS banned
            FROM (SELECT DISTINCT from_stop, to_stop, mode FROM leg3) l JOIN best a ON a.stop_id = l.from_stop JOIN best b ON b.stop_id = l.to_stop JOIN connectoids c ON c.zone_id = a.zone_id AND list_contains(string_split(c.modes, ','), l.mode)
            JOIN connectoids d ON d.zone_id = b.zone_id AND list_contains(string_split(d.modes, ','), l.mode) JOIN segments g ON g.segment_id = d.segment_id""",
    "edge": f"""SELECT segment_id, from_node, to_node, mode, length_km, CAST(round(length_km / least(speed_kmh, CASE mode {" ".join(f"WHEN '{m}' THEN {v}" for m, (_, v) in modes.MODES.items())} END) * {paths.TICKS}) AS BIGINT) AS ticks
            FROM (SELECT *, unnest(string_split(modes, ',')) AS mode FROM (SELECT * EXCLUDE (modes), modes FROM segments) x) y""",
    "source": "SELECT row_number() OVER () AS rid, mode, origin, banned FROM (SELECT DISTINCT mode, origin, banned FROM asked) q",
    # Labels as in the search: each round betters those of the last one's neighbours; the last segment settles ties and names the way.
    "label": """SELECT rid, origin AS node, CAST(0 AS BIGINT) AS ticks, CAST(0 AS BIGINT) AS steps, CAST(-1 AS BIGINT) AS segment FROM source
        UNION SELECT n.rid, n.node, n.ticks, n.steps, n.segment FROM (SELECT l.rid, e.to_node AS node, l.ticks + e.ticks AS ticks, l.steps + 1 AS steps, e.segment_id AS segment,
            row_number() OVER (PARTITION BY l.rid, e.to_node ORDER BY l.ticks + e.ticks, l.steps + 1, e.segment_id) AS nth
            FROM label l JOIN source s ON s.rid = l.rid JOIN edge e ON e.mode = s.mode AND e.from_node = l.node WHERE NOT list_contains(s.banned, e.segment_id)) n
            LEFT JOIN recurring.label o ON o.rid = n.rid AND o.node = n.node WHERE n.nth = 1 AND (o.rid IS NULL OR (n.ticks, n.steps, n.segment) < (o.ticks, o.steps, o.segment))""",
    "walk": """SELECT q.rid, q.target, q.target AS node, CAST([] AS BIGINT[]) AS segs FROM (SELECT DISTINCT s.rid, a.target FROM asked a JOIN source s ON s.mode = a.mode AND s.origin = a.origin AND s.banned = a.banned) q JOIN label l ON l.rid = q.rid AND l.node = q.target
        UNION ALL SELECT w.rid, w.target, e.from_node, list_prepend(l.segment, w.segs) FROM walk w JOIN label l ON l.rid = w.rid AND l.node = w.node JOIN segments e ON e.segment_id = l.segment""",
    "option_path": """SELECT a.from_stop, a.to_stop, a.mode, a.origin, a.finish, list_append(w.segs, a.last) AS segs, (l.ticks + e.ticks) / 1e9 AS cost, round((l.steps + 1) * e.length_km, 9) AS km
        FROM asked a JOIN source s ON s.mode = a.mode AND s.origin = a.origin AND s.banned = a.banned JOIN label l ON l.rid = s.rid AND l.node = a.target
        JOIN (SELECT * FROM walk WHERE len(segs) = (SELECT steps FROM label b WHERE b.rid = walk.rid AND b.node = walk.target)) w ON w.rid = s.rid AND w.target = a.target JOIN edge e ON e.segment_id = a.last AND e.mode = a.mode""",
    "stop_node": """SELECT stop_id, mode, node FROM (SELECT *, row_number() OVER (PARTITION BY stop_id, mode ORDER BY n DESC, total, node) AS nth FROM (SELECT stop_id, mode, node, count(*) AS n, round(sum(km), 6) AS total FROM (
        SELECT stop_id, mode, node, from_stop, to_stop, min(km) AS km FROM (SELECT from_stop AS stop_id, mode, origin AS node, from_stop, to_stop, km FROM option_path UNION ALL SELECT to_stop, mode, finish, from_stop, to_stop, km FROM option_path) u GROUP BY ALL) v GROUP BY ALL) x) y WHERE nth = 1""",
    "found": """SELECT * EXCLUDE (nth) FROM (SELECT p.*, row_number() OVER (PARTITION BY p.from_stop, p.to_stop, p.mode ORDER BY km, cost, segs) AS nth FROM option_path p
        JOIN stop_node a ON a.stop_id = p.from_stop AND a.mode = p.mode AND a.node = p.origin JOIN stop_node b ON b.stop_id = p.to_stop AND b.mode = p.mode AND b.node = p.finish) q WHERE nth = 1""",
    "parted": """SELECT *, dense_rank() OVER (PARTITION BY trip_id ORDER BY run) AS part FROM (SELECT *, nth - row_number() OVER (PARTITION BY trip_id ORDER BY nth) AS run FROM leg3 SEMI JOIN found USING (from_stop, to_stop, mode)) q""",
}


def _sql(text: str) -> str:
    needed, todo = set(), [text]
    while todo:
        now = todo.pop()
        found = {s for s in _STEPS if re.search(rf"\b{s}\b", now)} - needed
        needed |= found
        todo += [_STEPS[s] for s in found]
    key = {"label": "label USING KEY (rid, node)"}
    whole = duckdb(("WITH " + ", ".join(f"{key.get(s, s)} AS ({_STEPS[s]})" for s in _STEPS if s in needed) + " " + text) if needed else text)
    return whole.replace("WITH ", "WITH RECURSIVE ", 1) if "label" in needed else whole


_FORCED = "CASE stop_id % 3 WHEN 0 THEN stop_id * 2 WHEN 1 THEN stop_id * 2 + 1 END"
_M = 111319.49079327358
SQL = {
    name: _sql(text)
    for name, text in {
        "feed_stop_times": "SELECT CAST(trip_id AS VARCHAR) AS trip_id, CAST(stop_id AS VARCHAR) AS stop_id, CAST(stop_sequence AS INT) AS stop_sequence, CAST(arr AS INT) AS arr, CAST(dep AS INT) AS dep FROM stop_times",
        "feed_stops": f"SELECT CAST(stop_id AS VARCHAR) AS stop_id, concat(stop_name, ', \"main\"') AS stop_name, round((x - 10) * {_M}, 2) AS x, round(y * {_M}, 2) AS y FROM stops WHERE stop_id % 5 <> 0",
        "feed_row_counts": "SELECT 'routes.txt' AS file, count(*) AS n_rows FROM routes UNION ALL SELECT 'calendar.txt', count(*) FROM calendar UNION ALL SELECT 'trips.txt', count(*) FROM trips UNION ALL SELECT 'stop_times.txt', count(*) FROM stop_times",
        "feed_services": "SELECT mode, count(*) AS n_trips, CAST(sum(n) AS BIGINT) AS n_stop_times FROM (SELECT trip_id, mode, count(*) AS n FROM begun GROUP BY ALL HAVING count(*) >= 2) q GROUP BY mode",
        "zone_conflicts": """SELECT stop_id, array_to_string(list_sort(list(concat(mode, ' ', zone_id))), ',') AS zones FROM (SELECT *, row_number() OVER (PARTITION BY stop_id, mode ORDER BY priority, d2, zone_id) AS pick FROM moption) q
            WHERE pick = 1 GROUP BY stop_id HAVING min(zone_id) <> max(zone_id)""",
        "connectoids_of_several_modes": """SELECT e.stop_id AS zone_key, e.segment_id, e.to_node AS access_node, string_agg(DISTINCT u.with_mode, ',' ORDER BY u.with_mode) AS modes FROM mentry e JOIN compat u ON u.mode = e.mode
            WHERE NOT EXISTS (SELECT 1 FROM mentry o WHERE o.stop_id = e.stop_id AND o.mode = e.mode AND NOT list_contains(string_split(o.modes, ','), u.with_mode)) GROUP BY e.stop_id, e.segment_id, e.to_node""",
        "link_overrides": f"""SELECT s.stop_id, coalesce(f.link_id, c.link_id) AS link_id FROM stops s LEFT JOIN (SELECT st.stop_id, g.link_id FROM (SELECT stop_id, mode, {_FORCED} AS wanted FROM stops) st JOIN lmode g ON g.link_id = st.wanted AND list_contains(string_split(g.modes, ','), st.mode)) f ON f.stop_id = s.stop_id
            LEFT JOIN chosen c ON c.stop_id = s.stop_id WHERE coalesce(f.link_id, c.link_id) IS NOT NULL""",
        "joint_rules": """SELECT stop_id, zone_id, priority FROM (SELECT *, row_number() OVER (PARTITION BY zone_id ORDER BY stop_id % 2 = 0, priority, d2, stop_id) AS nth FROM (
            SELECT stop_id, zone_id, CAST(priority AS INT) AS priority, d2 FROM (SELECT *, row_number() OVER (PARTITION BY stop_id ORDER BY priority, d2, zone_id) AS pick FROM option) q WHERE pick = 1 AND stop_id % 5 <> 2) p) r WHERE stop_id % 2 <> 0 OR nth = 1""",
        "zone_sides": "SELECT * FROM sided",
        "zone_match_sides": """SELECT stop_id, zone_id, priority FROM (SELECT *, row_number() OVER (PARTITION BY stop_id ORDER BY priority, d2, zone_id) AS pick FROM (SELECT p.stop_id, p.zone_id, p.d2, CAST(CASE WHEN lower(p.platforms) = lower(p.platform_code) THEN 3 WHEN list_contains(m.zl, c.link_id) AND p.d2 <= 6400 THEN 4
            WHEN least(abs(az1 - az2), 360 - abs(az1 - az2)) < 100 THEN 5 END AS INT) AS priority FROM zpair p JOIN zmode m ON m.zone_id = p.zone_id LEFT JOIN sided sd ON sd.stop_id = p.stop_id AND sd.zone_id = p.zone_id LEFT JOIN chosen c ON c.stop_id = p.stop_id,
            LATERAL (SELECT (degrees(atan2(p.x - c.nx, p.y - c.ny)) + 360) % 360 AS az1, (degrees(atan2(p.zx - c.nx, p.zy - c.ny)) + 360) % 360 AS az2) a
            WHERE EXISTS (SELECT 1 FROM compat k WHERE k.mode = p.mode AND list_contains(m.zm, k.with_mode)) AND (p.mode <> 'BUS' OR coalesce(sd.any_on_side, false))) q WHERE priority IS NOT NULL) r WHERE pick = 1""",
        "closest_zone_access": """SELECT stop_id, zone_id, d2 FROM (SELECT *, row_number() OVER (PARTITION BY stop_id ORDER BY d2, zone_id) AS pick FROM (SELECT p.stop_id, p.zone_id, coalesce(min((p.x - n.x) * (p.x - n.x) + (p.y - n.y) * (p.y - n.y)), any_value(p.d2)) AS d2
            FROM zpair p LEFT JOIN connectoids c ON c.zone_id = p.zone_id LEFT JOIN nodes n ON n.node_id = c.access_node GROUP BY p.stop_id, p.zone_id) q) r WHERE pick = 1""",
        "connectoids_by_node": "SELECT s.node_id, c.connectoid_id, c.zone_id, c.segment_id FROM (SELECT node_a AS node_id FROM chosen UNION SELECT node_b FROM chosen) s JOIN connectoids c ON c.access_node = s.node_id",
        "widened_connectoids": """SELECT c.connectoid_id, array_to_string(list_sort(list_distinct(list_concat(string_split(c.modes, ','), list_filter(coalesce(m.more, []), lambda x: list_contains(string_split(g.modes, ','), x))))), ',') AS modes
            FROM connectoids c JOIN segments g ON g.segment_id = c.segment_id LEFT JOIN (SELECT b.zone_id, list(DISTINCT k.with_mode) AS more FROM best b JOIN stops s ON s.stop_id = b.stop_id JOIN compat k ON k.mode = s.mode GROUP BY b.zone_id) m ON m.zone_id = c.zone_id""",
        "zoning_counters": """SELECT CASE priority WHEN 3 THEN 'platform' WHEN 4 THEN 'access_link' ELSE 'angle' END AS outcome, count(*) AS n FROM best GROUP BY ALL UNION ALL SELECT 'created', count(*) FROM fresh UNION ALL SELECT 'stops', count(*) FROM stops
            UNION ALL SELECT 'augmented', count(DISTINCT zone_id) FROM best UNION ALL SELECT 'connectoids', count(*) FROM fresh f JOIN entry e ON e.stop_id = f.stop_id""",
        "stops_by_active_mode": "SELECT stop_id, string_agg(mode, ',' ORDER BY mode) AS modes FROM (SELECT DISTINCT b.stop_id, b.mode FROM begun b JOIN stops s ON s.stop_id = b.stop_id WHERE b.mode IN ('BUS', 'FERRY')) q GROUP BY stop_id",
        "numbered_nodes": "SELECT stop_id, row_number() OVER (ORDER BY stop_id) AS node_id FROM (SELECT DISTINCT stop_id FROM begun) q",
        "appended_ids": "SELECT route_id, concat(route_id % 7, CASE WHEN route_id % 3 <> route_id % 7 THEN concat(';', route_id % 3) ELSE '' END, CASE WHEN route_id % 5 NOT IN (route_id % 7, route_id % 3) THEN concat(';', route_id % 5) ELSE '' END) AS external_ids FROM routes",
        "mapped_service_network": "SELECT from_stop, to_stop, mode, count(*) AS uses FROM leg3 SEMI JOIN found USING (from_stop, to_stop, mode) GROUP BY ALL",
        "truncated_trips": "SELECT trip_id, part, count(*) AS n_legs, min(nth) AS first_leg, CAST(sum(duration) AS BIGINT) AS duration FROM parted GROUP BY trip_id, part",
        "consolidated_parts": """SELECT route_id, mode, timings, count(*) AS n_trips, array_to_string(list_sort(list_distinct(list(departure))), ',') AS departures FROM (SELECT trip_id, part, route_id, mode, arg_min(started, nth) AS departure,
            string_agg(concat(from_stop, '>', to_stop, ':', duration, '+', dwell), ' ' ORDER BY nth) AS timings FROM parted GROUP BY ALL) q GROUP BY route_id, mode, timings""",
        "intermodal_zones": """SELECT row_number() OVER (ORDER BY q.stop_id) AS zone_id, CAST(q.stop_id AS VARCHAR) AS external_ids, s.stop_name AS name, s.x, s.y, m.modes
            FROM (SELECT DISTINCT stop_id FROM vplace) q JOIN stops s ON s.stop_id = q.stop_id LEFT JOIN vmodes m ON m.stop_id = q.stop_id""",
        "cut_network": """SELECT CASE WHEN ahead THEN px ELSE qx END AS x0, CASE WHEN ahead THEN py ELSE qy END AS y0, CASE WHEN ahead THEN qx ELSE px END AS x1, CASE WHEN ahead THEN qy ELSE py END AS y1, round(length_km * share, 6) AS length_km, modes
            FROM (SELECT s.from_node = l.node_a AS ahead, p.*, s.length_km, s.modes, sqrt((qx - px) * (qx - px) + (qy - py) * (qy - py)) / sqrt((l.x1 - l.x0) * (l.x1 - l.x0) + (l.y1 - l.y0) * (l.y1 - l.y0)) AS share
            FROM segments s JOIN links l ON l.link_id = s.link_id JOIN cut_piece p ON p.link_id = s.link_id) q""",
        "path_requests": """SELECT from_stop, to_stop, mode, origin, target, finish AS "end", last, array_to_string(banned, ',') AS banned FROM asked""",
        "leg_shortest_path": "SELECT from_stop, to_stop, mode, CAST(len(segs) AS INT) AS n_segments, round(km, 6) AS length_km, round(cost, 6) AS hours, array_to_string(segs, ',') AS segments FROM found",
    }.items()
}
