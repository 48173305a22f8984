"""Queries on feeds, calendar, routes, trips and stop times, for a Thursday from 06:00:00 to 09:59:59."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from headway.functions import modes, time
from headway.functions.modes import ModeMap
from headway.operators import network, services
from headway.plans.services import Services, ServicesConfig
from headway.queries.adapter import TABLES, duckdb, spark_tables
from headway.sources import feed, schema

PERIODS = [(6 * 3600, 10 * 3600 - 1)]
EXCLUDED = ["Customer#3", "Customer#000000003", "Customer#8", "Customer#000000008"]
CORE = ("routes", "calendar", "trips", "stop_times")


def _services(spark: SparkSession, sf_dir: str, **config) -> Services:
    return Services(spark_tables(spark, sf_dir, *CORE), ServicesConfig("thursday", periods=PERIODS, exclude_names=EXCLUDED, **config))


# The SQL of both days, classified routes and trips, and stop times, by steps.
_MAP = ", ".join(f"({t}, '{m}', {m == ms[0]})" for t, ms in sorted(ModeMap().of.items()) for m in ms)
_NAMES = ", ".join(f"'{x}'" for x in EXCLUDED)
_STEPS = {
    "mode_map": f"SELECT * FROM (VALUES {_MAP}) v(route_type, mode, is_primary)",
    "cls_routes": f"""SELECT r.route_id, r.route_short_name, r.route_long_name, r.route_type, m.mode, CASE WHEN route_short_name IN ({_NAMES}) THEN 'SETTINGS_EXCLUDED' WHEN m.mode IS NULL THEN 'MODE_INCOMPATIBLE' END AS removal_reason
        FROM routes r LEFT JOIN mode_map m ON m.route_type = r.route_type AND m.is_primary""",
    "active": "SELECT service_id, thursday = 1 AS today, wednesday = 1 AS yesterday FROM calendar WHERE thursday = 1 OR wednesday = 1",
    "cls_trips": """SELECT t.trip_id, t.route_id, t.service_id, r.mode, a.today, a.yesterday, CASE WHEN a.today IS NULL THEN 'SERVICE_ID_DISCARDED' WHEN r.route_id IS NULL THEN 'UNKNOWN'
        WHEN r.removal_reason = 'MODE_INCOMPATIBLE' THEN 'ROUTE_MODE_INCOMPATIBLE' WHEN r.removal_reason = 'SETTINGS_EXCLUDED' THEN 'ROUTE_EXCLUDED' END AS removal_reason
        FROM trips t LEFT JOIN active a USING (service_id) LEFT JOIN cls_routes r ON r.route_id = t.route_id""",
    "kept": "SELECT * FROM cls_trips WHERE removal_reason IS NULL",
    "flagged": f"""SELECT s.trip_id, s.stop_id, s.stop_sequence, s.arr, s.dep, k.route_id, k.mode, CASE WHEN k.today THEN s.dep < 86400 AND s.dep BETWEEN {PERIODS[0][0]} AND {PERIODS[0][1]}
        ELSE s.dep >= 86400 AND s.dep - 86400 BETWEEN {PERIODS[0][0]} AND {PERIODS[0][1]} END AS ok FROM stop_times s JOIN kept k USING (trip_id)""",
    "begun": """SELECT * FROM (SELECT *, max(CAST(ok AS INT)) OVER (PARTITION BY trip_id ORDER BY stop_sequence ROWS UNBOUNDED PRECEDING) AS is_on,
        first_value(ok) OVER (PARTITION BY trip_id ORDER BY stop_sequence) AS first_ok FROM flagged) q WHERE is_on = 1""",
    "leg": """SELECT * FROM (SELECT trip_id, route_id, mode, stop_sequence, lag(stop_id) OVER w AS from_stop, stop_id AS to_stop, arr - lag(dep) OVER w AS duration, dep - arr AS dwell, row_number() OVER w AS nth
        FROM begun WINDOW w AS (PARTITION BY trip_id ORDER BY stop_sequence)) q WHERE nth > 1""",
    "first_dep": "SELECT trip_id, min_by(dep, stop_sequence) AS departure FROM begun GROUP BY trip_id",
    "schedule": """SELECT l.trip_id, l.route_id, l.mode, d.departure, string_agg(concat(from_stop, '>', to_stop, ':', duration, '+', dwell), ' ' ORDER BY nth) AS timings FROM leg l JOIN first_dep d ON d.trip_id = l.trip_id GROUP BY ALL""",
    "twice": """SELECT trip_id, stop_id, stop_sequence, arr, dep FROM stop_times UNION ALL SELECT trip_id, stop_id, stop_sequence, arr, dep FROM stop_times WHERE trip_id % 7 = 0""",
}


def steps(text: str) -> str:
    """``text`` after the steps and tables that it needs."""
    needed, todo = set(), [text]
    while todo:
        now = todo.pop()
        found = {s for s in _STEPS if re.search(rf"\b{s}\b", now)} - needed
        needed |= found
        todo += [_STEPS[s] for s in found]
    return duckdb(("WITH " + ", ".join(f"{s} AS ({_STEPS[s]})" for s in _STEPS if s in needed) + " " + text) if needed else text)


def _timings():
    return F.array_join(F.transform("timings", lambda t: F.concat(t["from_stop"].cast("string"), F.lit(">"), t["to_stop"].cast("string"), F.lit(":"), t["duration"].cast("string"), F.lit("+"), t["dwell"].cast("string"))), " ")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trips and stop times by mode on a Thursday morning."""
    config = ServicesConfig("thursday", periods=PERIODS)
    return Services(spark_tables(spark, sf_dir, *CORE), config).summary()


def _scan(name: str):
    columns = {"stops": ["stop_id", "stop_name", "x", "y", "mode", "platform_code"]}.get(name)
    return lambda spark, sf_dir: spark_tables(spark, sf_dir, name)[name].select(*(columns or ["*"]))


def calendar_active_any(spark, sf_dir):
    return services.active_any(spark_tables(spark, sf_dir, "calendar")["calendar"], ["saturday", "sunday"])


def calendar_active_services(spark, sf_dir):
    return services.active_services(spark_tables(spark, sf_dir, "calendar")["calendar"], "thursday")


def routes_name_filter(spark, sf_dir):
    return services.filter_names(spark_tables(spark, sf_dir, "routes")["routes"], EXCLUDED).select("route_id", "route_short_name")


def routes_removed_reason(spark, sf_dir):
    return _services(spark, sf_dir).routes.filter("removal_reason is not null").select("route_id", "route_type", "removal_reason")


def routes_by_mode(spark, sf_dir):
    """Routes by mode, and how many have a name where every 11th lacks one and every 7th a blank one."""
    rows = _services(spark, sf_dir).routes
    bare = (F.col("route_id") % 11 == 0) | (F.col("route_id") % 7 == 0)
    rows = rows.withColumns({"route_short_name": F.when(F.col("route_id") % 11 != 0, F.when(F.col("route_id") % 7 == 0, F.lit(" ")).otherwise(F.col("route_short_name"))), "route_long_name": F.when(~bare, F.col("route_long_name"))})
    return services.routed_services(rows).groupBy("mode").agg(F.count("*").alias("n_routes"), F.count_if("valid_name").alias("n_named"))


def routed_service_names(spark, sf_dir):
    return services.routed_services(_services(spark, sf_dir).routes).select("external_id", "name", "name_description", "mode")


def mode_compatibility(spark, sf_dir):
    """Stops by the modes that go with theirs."""
    stops = spark_tables(spark, sf_dir, "stops")["stops"]
    return stops.join(modes.compatibility(ModeMap().rows(spark)), "mode").groupBy("mode", "with_mode").agg(F.count("*").alias("n_stops"))


def trips_active(spark, sf_dir):
    return _services(spark, sf_dir).trips.select("trip_id", "route_id", "mode")


def trips_of_chosen_services(spark, sf_dir):
    """Kept trips where a condition on calendar rows leaves some of the day's services."""
    return _services(spark, sf_dir, only_services="service_id % 3 <> 1 AND friday = 0").trips.select("trip_id", "route_id", "service_id")


def trips_removed_reason(spark, sf_dir):
    return _services(spark, sf_dir).all_trips.filter("removal_reason is not null").select("trip_id", "removal_reason")


def stop_times_in_window(spark, sf_dir):
    return _services(spark, sf_dir).raw_stop_times.filter(services.in_window(PERIODS)).select("trip_id", "stop_sequence", "stop_id", "dep")


def trip_late_start(spark, sf_dir):
    return _services(spark, sf_dir).started.select("trip_id", "stop_sequence", "stop_id", "arr", "dep")


def trip_strict_window(spark, sf_dir):
    return _services(spark, sf_dir, partial_trips=False).started.select("trip_id", "stop_sequence", "stop_id", "arr", "dep")


def stop_time_duplicates(spark, sf_dir):
    rows = spark_tables(spark, sf_dir, "stop_times")["stop_times"]
    twice = rows.unionByName(rows.filter("trip_id % 7 = 0"))
    return services.repeated(twice).groupBy("trip_id").agg(F.count("*").alias("n_rows"), F.count_if("repeats_last").alias("n_repeats"))


def leg_timings(spark, sf_dir):
    return _services(spark, sf_dir).legs.select("trip_id", "nth", "from_stop", "to_stop", "duration", "dwell", "too_long")


def trip_departure(spark, sf_dir):
    return _services(spark, sf_dir).departures


def service_nodes(spark, sf_dir):
    return _services(spark, sf_dir).nodes


def leg_segments_by_mode(spark, sf_dir):
    return _services(spark, sf_dir).segments


def legs_undirected(spark, sf_dir):
    return _services(spark, sf_dir).undirected


def trips_without_legs(spark, sf_dir):
    s = _services(spark, sf_dir)
    return network.without_legs(s.trips, s.legs).select("trip_id", "route_id")


def services_without_trips(spark, sf_dir):
    s = _services(spark, sf_dir)
    return network.without_trips(services.routed_services(s.routes), s.schedules).select("external_id", "mode")


def modes_empty(spark, sf_dir):
    s = _services(spark, sf_dir)
    ran = s.schedules.groupBy("mode").agg(F.count("*").alias("n_trips"))
    return s.mode_map.select("mode").distinct().join(ran, "mode", "left").select("mode", F.coalesce("n_trips", F.lit(0)).alias("n_trips"))


def consolidated_trips(spark, sf_dir):
    return _services(spark, sf_dir).consolidated.select("route_id", "mode", _timings().alias("timings"), "n_trips", "trip_id", F.array_join(F.transform("departures", lambda d: d.cast("string")), ",").alias("departures"))


def distinct_departures(spark, sf_dir):
    rows = _services(spark, sf_dir).consolidated.select("route_id", "mode", F.explode("departures").alias("departure"))
    return rows.groupBy("route_id", "mode").agg(F.countDistinct("departure").alias("n_departures"), F.min("departure").alias("first_departure"), F.max("departure").alias("last_departure"))


def routes_per_stop(spark, sf_dir):
    s = _services(spark, sf_dir)
    return network.stop_routes(s.stop_times, s.routes)


def modes_per_stop(spark, sf_dir):
    s = _services(spark, sf_dir)
    return network.stop_modes(s.stop_times, s.mode_map).select("stop_id", F.array_join("modes", ",").alias("modes"))


def removed_counts(spark, sf_dir):
    s = _services(spark, sf_dir)
    return network.removed_counts(s.routes, s.all_trips)


def route_type_counts(spark, sf_dir):
    s = _services(spark, sf_dir)
    return network.counts_by_type(s.routes, s.trips, s.stop_times)


def feed_validation(spark, sf_dir):
    """What the rules say of the files of many feeds, a nation each; which files a feed has follows from its number."""
    nations = spark_tables(spark, sf_dir, "agency")["agency"].select(F.col("agency_id").alias("feed_id"))
    files = F.array(*[F.when((F.col("feed_id") * (k + 3)) % 5 > 1, F.lit(n)) for k, n in enumerate(schema.PRESENCE)])
    return feed.presence_findings(nations.select("feed_id", F.explode(files).alias("file")), ("feed_id",))


def extended_times(spark, sf_dir):
    rows = spark_tables(spark, sf_dir, "stop_times")["stop_times"].select("trip_id", "stop_sequence", time.clock(F.col("dep")).alias("clock"))
    t = time.seconds(F.col("clock"))
    return rows.select("trip_id", "stop_sequence", "clock", t.alias("seconds"), (t >= time.DAY).alias("after_midnight"), (t % time.DAY).alias("day_seconds"))


def location_types(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey", F.when(F.col("s_suppkey") % 7 == 0, " ").when(F.col("s_suppkey") % 7 == 6, "x").otherwise((F.col("s_suppkey") % 7).cast("string")).alias("raw"))
    return rows.select(F.col("s_suppkey").alias("stop_id"), modes.location_type(F.col("raw")).alias("location_type"))


def row_lines(spark, sf_dir):
    return feed.described(spark_tables(spark, sf_dir, "trips")["trips"], "trip")


def feed_needed_columns(spark, sf_dir):
    trips = spark_tables(spark, sf_dir, "routes")["routes"].withColumn("route_url", F.lit("u"))
    return trips.select(*[c for c in schema.kept_columns("routes", "needed") if c in trips.columns])


def mode_map_original(spark, sf_dir):
    """Routes by the modes of their types in the original dialect; types 5 to 10, 12 and 13 have none."""
    routes = spark_tables(spark, sf_dir, "routes")["routes"].select((F.col("route_id") % 14).cast("int").alias("route_type"))
    return routes.join(ModeMap("ORIGINAL").rows(spark), "route_type").groupBy("route_type", "mode", "is_primary").agg(F.count("*").alias("n_routes"))


def mode_map_on_roads(spark, sf_dir):
    """Routes by mode where the network has only the links along one axis, which have no rails, and one type is switched off."""
    t = spark_tables(spark, sf_dir, "routes", "segments")
    routes = t["routes"].select(F.element_at(F.array(*map(F.lit, (3, 4, 700, 1000, 2, 900))), (F.col("route_id") % 6 + 1).cast("int")).alias("route_type"))
    kept = ModeMap()
    kept.deactivate(700)
    on = modes.on_tracks(kept.rows(spark), t["segments"].filter("link_id % 2 = 1"))
    return routes.join(on, "route_type").groupBy("route_type", "mode").agg(F.count("*").alias("n_routes"))


def mode_tracks(spark, sf_dir):
    """Routes by the track of their mode."""
    track = F.coalesce(*[F.when(F.col("mode") == m, F.lit(t)) for m, (t, _) in modes.MODES.items()])
    return _services(spark, sf_dir).routes.filter("removal_reason is null").groupBy(track.alias("track")).agg(F.count("*").alias("n_routes"))


def routes_only_names(spark, sf_dir):
    return services.filter_names(spark_tables(spark, sf_dir, "routes")["routes"], only=EXCLUDED).select("route_id", "route_short_name")


def stop_times_two_periods(spark, sf_dir):
    """Stop times in two periods, where a service of both days also counts after midnight; a third period overlaps and is not taken."""
    periods: list[tuple[int, int]] = []
    for a, b in ((6, 8), (17, 19), (7, 18)):
        periods = time.add_period(periods, a * 3600, b * 3600)
    rows = _services(spark, sf_dir).raw_stop_times
    return rows.filter(services.in_window(periods, both_days=True)).groupBy("mode").agg(F.count("*").alias("n_rows"), F.sum("dep").alias("total"))


QUERIES = {f"scan_{n}": _scan(n) for n in ("agency", *CORE, "stops")} | {
    f.__name__: f
    for f in (
        calendar_active_any, calendar_active_services, routes_name_filter, routes_removed_reason, routes_by_mode, routed_service_names, mode_compatibility, trips_of_chosen_services,
        trips_active, trips_removed_reason, stop_times_in_window, trip_late_start, trip_strict_window, stop_time_duplicates, leg_timings, trip_departure,
        service_nodes, leg_segments_by_mode, legs_undirected, trips_without_legs, services_without_trips, modes_empty, consolidated_trips, distinct_departures,
        routes_per_stop, modes_per_stop, removed_counts, route_type_counts, feed_validation, extended_times, location_types,
        row_lines, feed_needed_columns, flagship, mode_map_original, mode_map_on_roads, mode_tracks, routes_only_names, stop_times_two_periods,
    )
}
_SCHEDULED = "SELECT route_id FROM schedule"
SQL = {f"scan_{n}": duckdb(f"SELECT * FROM {n}") for n in ("agency", *CORE, "stops")} | {
    name: steps(text)
    for name, text in {
        "calendar_active_any": "SELECT service_id FROM calendar WHERE saturday = 1 OR sunday = 1",
        "calendar_active_services": "SELECT * FROM active",
        "routes_name_filter": f"SELECT route_id, route_short_name FROM routes WHERE route_short_name NOT IN ({_NAMES})",
        "routes_removed_reason": "SELECT route_id, route_type, removal_reason FROM cls_routes WHERE removal_reason IS NOT NULL",
        "routes_by_mode": "SELECT mode, count(*) AS n_routes, count(*) FILTER (route_id % 11 <> 0 AND route_id % 7 <> 0) AS n_named FROM cls_routes WHERE removal_reason IS NULL GROUP BY mode",
        "routed_service_names": "SELECT route_id AS external_id, route_short_name AS name, route_long_name AS name_description, mode FROM cls_routes WHERE removal_reason IS NULL",
        "trips_of_chosen_services": "SELECT trip_id, route_id, service_id FROM kept WHERE service_id IN (SELECT service_id FROM calendar WHERE service_id % 3 <> 1 AND friday = 0)",
        "mode_compatibility": "SELECT s.mode, c.with_mode, count(*) AS n_stops FROM stops s JOIN (SELECT DISTINCT a.mode, b.mode AS with_mode FROM mode_map a JOIN mode_map b USING (route_type)) c ON c.mode = s.mode GROUP BY ALL",
        "trips_active": "SELECT trip_id, route_id, mode FROM kept",
        "trips_removed_reason": "SELECT trip_id, removal_reason FROM cls_trips WHERE removal_reason IS NOT NULL",
        "stop_times_in_window": "SELECT trip_id, stop_sequence, stop_id, dep FROM flagged WHERE ok",
        "trip_late_start": "SELECT trip_id, stop_sequence, stop_id, arr, dep FROM begun",
        "trip_strict_window": "SELECT trip_id, stop_sequence, stop_id, arr, dep FROM begun WHERE first_ok",
        "stop_time_duplicates": "SELECT trip_id, count(*) AS n_rows, CASE WHEN trip_id % 7 = 0 THEN count(*) // 2 ELSE 0 END AS n_repeats FROM twice GROUP BY trip_id",
        "leg_timings": "SELECT trip_id, nth, from_stop, to_stop, duration, dwell, duration >= 86400 OR dwell >= 86400 AS too_long FROM leg",
        "trip_departure": "SELECT * FROM first_dep",
        "service_nodes": "SELECT DISTINCT stop_id FROM begun",
        "leg_segments_by_mode": "SELECT from_stop, to_stop, mode, count(*) AS uses FROM leg GROUP BY ALL",
        "legs_undirected": "SELECT least(from_stop, to_stop) AS stop_a, greatest(from_stop, to_stop) AS stop_b, mode, count(*) AS directions FROM (SELECT DISTINCT from_stop, to_stop, mode FROM leg) q GROUP BY ALL",
        "trips_without_legs": "SELECT trip_id, route_id FROM kept WHERE trip_id NOT IN (SELECT trip_id FROM leg)",
        "services_without_trips": f"SELECT route_id AS external_id, mode FROM cls_routes WHERE removal_reason IS NULL AND route_id NOT IN ({_SCHEDULED})",
        "modes_empty": "SELECT m.mode, count(s.trip_id) AS n_trips FROM (SELECT DISTINCT mode FROM mode_map) m LEFT JOIN schedule s ON s.mode = m.mode GROUP BY m.mode",
        "consolidated_trips": "SELECT route_id, mode, timings, count(*) AS n_trips, min(trip_id) AS trip_id, array_to_string(list_sort(list_distinct(list(departure))), ',') AS departures FROM schedule GROUP BY route_id, mode, timings",
        "distinct_departures": "SELECT route_id, mode, count(DISTINCT departure) AS n_departures, min(departure) AS first_departure, max(departure) AS last_departure FROM schedule GROUP BY ALL",
        "routes_per_stop": "SELECT stop_id, count(*) AS n_routes, array_to_string(list_sort(list(concat('name: ', r.route_short_name, ' id: ', r.route_id))), ', ') AS routes FROM (SELECT DISTINCT stop_id, route_id FROM begun) q JOIN routes r ON r.route_id = q.route_id GROUP BY stop_id",
        "modes_per_stop": "SELECT stop_id, array_to_string(list_sort(list_distinct(list(b.mode))), ',') AS modes FROM (SELECT DISTINCT stop_id, mode FROM begun) q JOIN mode_map a ON a.mode = q.mode JOIN mode_map b ON b.route_type = a.route_type GROUP BY stop_id",
        "removed_counts": "SELECT 'route' AS kind, removal_reason, count(*) AS n FROM cls_routes WHERE removal_reason IS NOT NULL GROUP BY ALL UNION ALL SELECT 'trip', removal_reason, count(*) FROM cls_trips WHERE removal_reason IS NOT NULL GROUP BY ALL",
        "route_type_counts": """SELECT r.route_type, count(*) AS n_routes, CAST(sum(coalesce(t.n, 0)) AS BIGINT) AS n_trips, CAST(sum(coalesce(s.n, 0)) AS BIGINT) AS n_stop_times FROM cls_routes r LEFT JOIN (SELECT route_id, count(*) AS n FROM kept GROUP BY route_id) t ON t.route_id = r.route_id
            LEFT JOIN (SELECT route_id, count(*) AS n FROM begun GROUP BY route_id) s ON s.route_id = r.route_id WHERE r.removal_reason IS NULL GROUP BY r.route_type""",
        "feed_validation": f"""WITH f AS (SELECT agency_id AS feed_id, r.file, r.kind, r.other, (agency_id * (r.k + 3)) % 5 > 1 AS here FROM agency, (VALUES {", ".join(f"({k}, '{n}', '{p.kind}', '{p.other or ''}')" for k, (n, p) in enumerate(schema.PRESENCE.items()))}) r(k, file, kind, other))
            SELECT f.feed_id, f.file, CASE WHEN f.here THEN 'ok' WHEN f.kind = 'required' OR (f.kind = 'present' AND coalesce(o.here, false)) OR (f.kind = 'absent' AND NOT coalesce(o.here, false)) THEN 'missing' ELSE 'absent' END AS status
            FROM f LEFT JOIN f o ON o.feed_id = f.feed_id AND o.file = f.other""",
        "extended_times": "SELECT trip_id, stop_sequence, format('{:02d}:{:02d}:{:02d}', dep // 3600, dep // 60 % 60, dep % 60) AS clock, CAST(dep AS INT) AS seconds, dep >= 86400 AS after_midnight, CAST(dep % 86400 AS INT) AS day_seconds FROM stop_times",
        "location_types": "SELECT s_suppkey AS stop_id, CAST(CASE WHEN s_suppkey % 7 = 0 THEN 0 WHEN s_suppkey % 7 <= 4 THEN s_suppkey % 7 END AS INT) AS location_type FROM supplier",
        "row_lines": "SELECT concat('TRIP: trip_id ', trip_id, ', route_id ', route_id, ', service_id ', service_id) AS line FROM trips",
        "feed_needed_columns": "SELECT route_id, route_short_name, route_long_name, route_type FROM routes",
        "mode_map_original": """SELECT r.route_type, v.mode, v.is_primary, count(*) AS n_routes FROM (SELECT CAST(route_id % 14 AS INT) AS route_type FROM routes) r
            JOIN (VALUES (0, 'LIGHTRAIL', true), (0, 'TRAM', false), (1, 'SUBWAY', true), (2, 'TRAIN', true), (3, 'BUS', true), (4, 'FERRY', true), (11, 'BUS', true)) v(route_type, mode, is_primary) ON v.route_type = r.route_type GROUP BY ALL""",
        "mode_map_on_roads": """SELECT route_type, mode, count(*) AS n_routes FROM (SELECT CASE route_id % 6 WHEN 0 THEN 3 WHEN 1 THEN 4 WHEN 2 THEN 700 WHEN 3 THEN 1000 WHEN 4 THEN 2 ELSE 900 END AS route_type FROM routes) r JOIN mode_map m USING (route_type)
            WHERE route_type <> 700 AND CASE mode WHEN 'BUS' THEN 'ROAD' WHEN 'FERRY' THEN 'WATER' ELSE 'RAIL' END IN (SELECT CASE m WHEN 'BUS' THEN 'ROAD' WHEN 'FERRY' THEN 'WATER' ELSE 'RAIL' END FROM (SELECT unnest(string_split(modes, ',')) AS m FROM segments WHERE link_id % 2 = 1) q) GROUP BY ALL""",
        "mode_tracks": "SELECT CASE mode WHEN 'BUS' THEN 'ROAD' WHEN 'FERRY' THEN 'WATER' ELSE 'RAIL' END AS track, count(*) AS n_routes FROM cls_routes WHERE removal_reason IS NULL GROUP BY ALL",
        "routes_only_names": f"SELECT route_id, route_short_name FROM routes WHERE route_short_name IN ({_NAMES})",
        "stop_times_two_periods": """SELECT k.mode, count(*) AS n_rows, CAST(sum(s.dep) AS BIGINT) AS total FROM stop_times s JOIN kept k ON k.trip_id = s.trip_id WHERE (k.today AND (s.dep BETWEEN 21600 AND 28800 OR s.dep BETWEEN 61200 AND 68400))
            OR (k.yesterday AND s.dep >= 86400 AND (s.dep - 86400 BETWEEN 21600 AND 28800 OR s.dep - 86400 BETWEEN 61200 AND 68400)) GROUP BY k.mode""",
        "flagship": f"""SELECT mode, count(*) AS n_trips, CAST(sum(n) AS BIGINT) AS n_stop_times FROM (SELECT trip_id, mode, count(*) AS n FROM begun GROUP BY ALL HAVING count(*) >= 2) q GROUP BY mode""",
    }.items()
}
# The flagship excludes no names.
SQL["flagship"] = SQL["flagship"].replace(f"WHEN route_short_name IN ({_NAMES}) THEN 'SETTINGS_EXCLUDED' ", "")
assert set(SQL) <= set(QUERIES) and TABLES
