"""The service network that stop times make, and the schedules on it.

Keys are natural: a stop, a directed pair of stops with a mode, an undirected
one. Legs of different modes between the same stops stay apart.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def service_nodes(stop_times: DataFrame) -> DataFrame:
    return stop_times.select("stop_id").distinct()


def leg_segments(legs: DataFrame) -> DataFrame:
    """(from_stop, to_stop, mode, uses)."""
    return legs.groupBy("from_stop", "to_stop", "mode").agg(F.count("*").alias("uses"))


def undirected_legs(segments: DataFrame) -> DataFrame:
    """(stop_a, stop_b, mode, directions): both directions of a pair share a leg."""
    return segments.groupBy(F.least("from_stop", "to_stop").alias("stop_a"), F.greatest("from_stop", "to_stop").alias("stop_b"), "mode").agg(F.count("*").alias("directions"))


def schedules(legs: DataFrame, departures: DataFrame) -> DataFrame:
    """Trips with route, mode, departure and timings, an array of (nth, from_stop, to_stop, duration, dwell); trips without legs are absent."""
    kept = legs.filter("not too_long")
    step = F.struct("nth", "from_stop", "to_stop", "duration", "dwell")
    trips = kept.groupBy("trip_id", "route_id", "mode").agg(F.array_sort(F.collect_list(step)).alias("timings"))
    return trips.join(departures, "trip_id")


def without_legs(trips: DataFrame, legs: DataFrame) -> DataFrame:
    """Kept trips that have no leg left."""
    return trips.join(legs.filter("not too_long").select("trip_id"), "trip_id", "left_anti")


def without_trips(services: DataFrame, trips: DataFrame) -> DataFrame:
    """Services (external_id) that none of the trips runs."""
    return services.join(trips.select(F.col("route_id").alias("external_id")).distinct(), "external_id", "left_anti")


def consolidated(schedules: DataFrame) -> DataFrame:
    """Trips of a route and mode with equal timings as one, with all their departures, sorted and without repeats."""
    steps = F.transform("timings", lambda t: F.struct(t["from_stop"].alias("from_stop"), t["to_stop"].alias("to_stop"), t["duration"].alias("duration"), t["dwell"].alias("dwell")))
    return schedules.withColumn("timings", steps).groupBy("route_id", "mode", "timings").agg(
        F.count("*").alias("n_trips"), F.min("trip_id").alias("trip_id"), F.array_sort(F.collect_set("departure")).alias("departures")
    )


def stop_modes(stop_times: DataFrame, mode_map: DataFrame | None = None) -> DataFrame:
    """(stop_id, modes): sorted modes of the trips that call there; with a map, also modes that share a route type."""
    pairs = stop_times.select("stop_id", "mode").distinct()
    if mode_map is not None:
        from headway.functions.modes import compatibility

        pairs = pairs.join(compatibility(mode_map), "mode").select("stop_id", F.col("with_mode").alias("mode")).distinct()
    return pairs.groupBy("stop_id").agg(F.array_sort(F.collect_list("mode")).alias("modes"))


def stop_routes(stop_times: DataFrame, routes: DataFrame, stops: list | None = None) -> DataFrame:
    """(stop_id, n_routes, routes): the routes at each stop, or at the given ones, as ``name: X id: Y``, sorted."""
    rows = stop_times if stops is None else stop_times.filter(F.col("stop_id").isin(stops))
    pairs = rows.select("stop_id", "route_id").distinct()
    names = routes.select("route_id", F.concat(F.lit("name: "), F.coalesce("route_short_name", F.lit("")), F.lit(" id: "), F.col("route_id").cast("string")).alias("_line"))
    return pairs.join(names, "route_id").groupBy("stop_id").agg(F.count("*").alias("n_routes"), F.array_join(F.array_sort(F.collect_list("_line")), ", ").alias("routes"))


def counts_by_type(routes: DataFrame, trips: DataFrame, stop_times: DataFrame) -> DataFrame:
    """(route_type, n_routes, n_trips, n_stop_times) of what is kept; routes are classified."""
    rows = stop_times.groupBy("trip_id").agg(F.count("*").alias("_n"))
    per_route = trips.join(rows, "trip_id", "left").groupBy("route_id").agg(F.count("*").alias("_trips"), F.coalesce(F.sum("_n"), F.lit(0)).alias("_rows"))
    kept = routes.filter("removal_reason is null").select("route_id", "route_type").join(per_route, "route_id", "left")
    return kept.groupBy("route_type").agg(
        F.count("*").alias("n_routes"), F.coalesce(F.sum("_trips"), F.lit(0)).alias("n_trips"), F.coalesce(F.sum("_rows"), F.lit(0)).alias("n_stop_times")
    )


def removed_counts(routes: DataFrame, trips: DataFrame) -> DataFrame:
    """(kind, removal_reason, n) over classified routes and trips."""
    count = lambda df, kind: df.filter("removal_reason is not null").groupBy("removal_reason").agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "removal_reason", "n")
    return count(routes, "route").unionByName(count(trips, "trip"))


# -- after legs have been mapped to paths ------------------------------------

def mapped_network(segments: DataFrame, mapped: DataFrame) -> DataFrame:
    """Leg segments that have a path; ``mapped`` is (from_stop, to_stop, mode)."""
    return segments.join(mapped.select("from_stop", "to_stop", "mode").distinct(), ["from_stop", "to_stop", "mode"], "left_semi")


def truncated(legs: DataFrame, mapped: DataFrame) -> DataFrame:
    """Legs with a path, with ``part``: a trip falls into parts where legs without a path were cut out.

    ``nth`` less the number of kept legs so far is constant within a run of consecutive legs.
    """
    from pyspark.sql import Window

    have = mapped.select("from_stop", "to_stop", "mode").distinct()
    kept = legs.filter("not too_long").join(have, ["from_stop", "to_stop", "mode"], "left_semi")
    by = Window.partitionBy("trip_id").orderBy("nth")
    runs = kept.withColumn("_run", F.col("nth") - F.row_number().over(by))
    return runs.withColumn("part", F.dense_rank().over(Window.partitionBy("trip_id").orderBy("_run"))).drop("_run")


def part_schedules(parts: DataFrame) -> DataFrame:
    """As :func:`schedules`, for the parts of truncated trips: each departs when its first leg does."""
    step = F.struct("nth", "from_stop", "to_stop", "duration", "dwell")
    start = F.min(F.struct("nth", (F.col("arr") - F.col("duration")).alias("_at")))["_at"]
    return parts.groupBy("trip_id", "part", "route_id", "mode").agg(F.array_sort(F.collect_list(step)).alias("timings"), start.alias("departure"))


def unused_cascade(connectoids: DataFrame, zones: DataFrame, groups: DataFrame, used: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Connectoids in use, zones that still have one, and zone groups (group_id, zone_id) that still have a zone."""
    left = connectoids.join(used.select("connectoid_id").distinct(), "connectoid_id", "left_semi")
    kept = zones.join(left.select("zone_id").distinct(), "zone_id", "left_semi")
    return left, kept, groups.join(kept.select("zone_id"), "zone_id", "left_semi")
