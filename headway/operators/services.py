"""Filters and lookups from routes, calendar and trips to the stop times that count.

Canonical columns: routes (route_id, route_short_name, route_long_name,
route_type int), calendar (service_id, monday ... sunday), trips (trip_id,
route_id, service_id), stop_times (trip_id, stop_id, stop_sequence int, arr int,
dep int). Times are seconds that may pass a day.

Joins carry no hints but that on the modes of route types, which are small numbers,
so at most a row each: Spark broadcasts a side whose measured size is under its
threshold and shuffles both otherwise.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from headway.functions import modes, time


def blank(column: str):
    return F.trim(F.coalesce(F.col(column).cast("string"), F.lit(""))) == ""


# -- calendar ---------------------------------------------------------------

def active_services(calendar: DataFrame, day: str, position: str | None = None) -> DataFrame:
    """(service_id, today, yesterday) of services that run on ``day`` or the day before it.

    Services of the day before matter for trips after midnight. Of rows with
    one service_id the last counts, by the column ``position`` if it is named.
    """
    rows = calendar.select("service_id", time.flag(day).alias("today"), time.flag(time.day_before(day)).alias("yesterday"), (F.col(position) if position else F.lit(0)).alias("_at"))
    last = rows.groupBy("service_id").agg(F.max(F.struct("_at", "today", "yesterday")).alias("_r"))
    return last.select("service_id", "_r.today", "_r.yesterday").filter("today or yesterday")


def active_any(calendar: DataFrame, days: list[str]) -> DataFrame:
    return calendar.filter(time.active_on_any(days)).select("service_id")


# -- routes -----------------------------------------------------------------

def filter_names(routes: DataFrame, exclude: Iterable[str] = (), only: Iterable[str] = ()) -> DataFrame:
    """Routes whose short name is not excluded and, if ``only`` has names, is one of them."""
    exclude, only = list(exclude), list(only)
    name = F.col("route_short_name")
    kept = ~F.coalesce(name.isin(exclude), F.lit(False)) if exclude else F.lit(True)
    return routes.filter(kept & (F.coalesce(name.isin(only), F.lit(False)) if only else F.lit(True)))


def classified_routes(routes: DataFrame, mode_map: DataFrame, exclude: Iterable[str] = (), only: Iterable[str] = ()) -> DataFrame:
    """Routes with mode (the primary one) and removal_reason: SETTINGS_EXCLUDED, MODE_INCOMPATIBLE or null."""
    exclude, only = list(exclude), list(only)
    name = F.col("route_short_name")
    out = F.coalesce(name.isin(exclude), F.lit(False)) if exclude else F.lit(False)
    out = out | (~F.coalesce(name.isin(only), F.lit(False)) if only else F.lit(False))
    primary = mode_map.filter("is_primary").select(F.col("route_type").alias("_type"), "mode")
    typed = routes.withColumn("_t", modes.route_type(F.col("route_type"))).join(F.broadcast(primary), F.col("_t") == F.col("_type"), "left").drop("_t", "_type")
    return typed.withColumn("removal_reason", F.when(out, "SETTINGS_EXCLUDED").when(F.col("mode").isNull(), "MODE_INCOMPATIBLE"))


def routed_services(routes: DataFrame) -> DataFrame:
    """Kept routes as services: external_id, name, name_description, service_description, mode and valid_name; blanks are null."""
    text = lambda c: F.nullif(F.trim(F.col(c).cast("string")), F.lit("")) if c in routes.columns else F.lit(None).cast("string")
    short, long = text("route_short_name"), text("route_long_name")
    return routes.filter("removal_reason is null").select(
        F.col("route_id").alias("external_id"), short.alias("name"), long.alias("name_description"),
        text("route_desc").alias("service_description"), "mode", (short.isNotNull() | long.isNotNull()).alias("valid_name"),
    )


# -- trips ------------------------------------------------------------------

def classified_trips(trips: DataFrame, services: DataFrame, routes: DataFrame) -> DataFrame:
    """Trips with mode, today, yesterday and removal_reason; routes are classified.

    Reasons, the first that holds: SERVICE_ID_DISCARDED, ROUTE_MODE_INCOMPATIBLE, ROUTE_EXCLUDED, UNKNOWN (no such route).
    """
    active = services.select("service_id", "today", "yesterday")
    known = routes.select("route_id", "mode", F.col("removal_reason").alias("_why"), F.lit(True).alias("_known"))
    joined = trips.join(active, "service_id", "left").join(known, "route_id", "left")
    reason = (
        F.when(F.col("today").isNull(), "SERVICE_ID_DISCARDED")
        .when(F.col("_known").isNull(), "UNKNOWN")
        .when(F.col("_why") == "MODE_INCOMPATIBLE", "ROUTE_MODE_INCOMPATIBLE")
        .when(F.col("_why") == "SETTINGS_EXCLUDED", "ROUTE_EXCLUDED")
    )
    return joined.withColumn("removal_reason", reason).drop("_why", "_known")


def kept_trips(classified: DataFrame) -> DataFrame:
    return classified.filter("removal_reason is null").select("trip_id", "route_id", "service_id", "mode", "today", "yesterday")


# -- stop times -------------------------------------------------------------

def in_window(periods: list[tuple[int, int]], both_days: bool = False):
    """Whether ``dep`` counts for a trip with ``today`` and ``yesterday``.

    A service of the day counts before midnight, one of the day before after
    it. A service of both days counts before midnight only; ``both_days`` lets
    it count after midnight as well.
    """
    dep = F.col("dep")
    same = (dep < time.DAY) & time.within(dep, periods)
    over = (dep >= time.DAY) & time.within(dep - time.DAY, periods)
    today, yesterday = F.coalesce(F.col("today"), F.lit(False)), F.coalesce(F.col("yesterday"), F.lit(False))
    ok = (today & same) | (yesterday & over) if both_days else F.when(today, same).when(yesterday, over).otherwise(False)
    return F.coalesce(ok, F.lit(False))


def with_trips(stop_times: DataFrame, trips: DataFrame) -> DataFrame:
    """Stop times of kept trips, with the trip's columns; rows without a time are left out."""
    return stop_times.filter("arr is not null and dep is not null").join(trips, "trip_id")


def order():
    return Window.partitionBy("trip_id").orderBy("stop_sequence", "arr", "dep", "stop_id")


def started(stop_times: DataFrame, periods: list[tuple[int, int]], partial: bool = True, both_days: bool = False) -> DataFrame:
    """The rows of each trip from its first one inside the window, also when the window closes later.

    Without ``partial``, trips whose very first row lies outside are dropped.
    """
    rows = order().rowsBetween(Window.unboundedPreceding, 0)
    whole = order().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    marked = stop_times.withColumn("_ok", in_window(periods, both_days))
    kept = F.max("_ok").over(rows) if partial else F.first("_ok").over(whole)
    return marked.withColumn("_on", kept).filter("_on").drop("_ok", "_on")


def repeated(stop_times: DataFrame) -> DataFrame:
    """With repeats_last: whether a row equals the row before in stop, arrival and departure."""
    last = F.lag(F.struct("stop_id", "arr", "dep")).over(order())
    return stop_times.withColumn("repeats_last", F.coalesce(last == F.struct("stop_id", "arr", "dep"), F.lit(False)))


def without_repeats(stop_times: DataFrame) -> DataFrame:
    return repeated(stop_times).filter("not repeats_last").drop("repeats_last")


def legs(stop_times: DataFrame) -> DataFrame:
    """A row per consecutive pair of stops: from_stop, to_stop, duration (arrival less last departure), dwell and too_long (a day or more)."""
    by = order()
    rows = stop_times.select(
        "*", F.lag("stop_id").over(by).alias("from_stop"), F.col("stop_id").alias("to_stop"),
        (F.col("arr") - F.lag("dep").over(by)).alias("duration"), (F.col("dep") - F.col("arr")).alias("dwell"), F.row_number().over(by).alias("nth"),
    )
    return rows.filter("nth > 1").withColumn("too_long", (F.col("duration") >= time.DAY) | (F.col("dwell") >= time.DAY))


def departures(stop_times: DataFrame) -> DataFrame:
    """(trip_id, departure): the first row's departure."""
    first = F.min(F.struct("stop_sequence", "arr", "dep", "stop_id"))["dep"]
    return stop_times.groupBy("trip_id").agg(first.alias("departure"))
