"""From a feed's tables to services on a network: one plan per result, built lazily."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from headway.functions import time
from headway.functions.modes import ModeMap, location_type
from headway.operators import network, services


@dataclass
class ServicesConfig:
    """``day`` must be set. Periods hold both their ends; none means the whole day. ``only_services`` is a condition on calendar rows."""

    day: str
    dialect: str = "EXTENDED"
    periods: list[tuple[int, int]] = field(default_factory=list)
    exclude_names: list[str] = field(default_factory=list)
    only_names: list[str] = field(default_factory=list)
    only_services: Column | str | None = None
    partial_trips: bool = True
    both_days: bool = False
    group_identical: bool = True
    track_stops: list | None = None
    modes: ModeMap | None = None

    def __post_init__(self):
        if self.day not in time.DAYS:
            raise ValueError(f"day must be one of {', '.join(time.DAYS)}")
        self.modes = self.modes or ModeMap(self.dialect)

    def add_period(self, start: int, end: int) -> None:
        self.periods = time.add_period(self.periods, start, end)


def from_feed(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Feed tables (all strings) with the types that the operators use.

    Of stops only those where vehicles stop remain (location type 0 or blank);
    lat and lon are null where they are no numbers.
    """
    times = tables["stop_times"]
    out = {
        "routes": tables["routes"], "calendar": tables["calendar"], "trips": tables["trips"],
        "stop_times": times.select(
            "trip_id", "stop_id", F.col("stop_sequence").try_cast("int").alias("stop_sequence"),
            time.seconds(F.col("arrival_time")).alias("arr"), time.seconds(F.col("departure_time")).alias("dep"),
        ),
    }
    if "stops" in tables:
        platforms = tables["stops"].filter(location_type(F.col("location_type")) == 0)
        number = lambda c: F.trim(c).try_cast("double")
        out["stops"] = platforms.select("stop_id", "stop_name", "platform_code", number(F.col("stop_lat")).alias("lat"), number(F.col("stop_lon")).alias("lon"))
    return out


class Services:
    """Every intermediate and final table of the conversion, each a lazy DataFrame."""

    def __init__(self, tables: dict[str, DataFrame], config: ServicesConfig):
        spark = tables["routes"].sparkSession
        self.config = config
        self.mode_map = config.modes.rows(spark)
        self.routes = services.classified_routes(tables["routes"], self.mode_map, config.exclude_names, config.only_names)
        calendar = tables["calendar"] if config.only_services is None else tables["calendar"].filter(config.only_services)
        self.active = services.active_services(calendar, config.day)
        self.all_trips = services.classified_trips(tables["trips"].select("trip_id", "route_id", "service_id"), self.active, self.routes)
        self.trips = services.kept_trips(self.all_trips)
        rows = services.with_trips(tables["stop_times"], self.trips)
        self.raw_stop_times = rows
        self.started = services.started(rows, config.periods, config.partial_trips, config.both_days)
        self.stop_times = services.without_repeats(self.started)
        self.legs = services.legs(self.stop_times)
        self.nodes = network.service_nodes(self.stop_times)
        self.segments = network.leg_segments(self.legs)
        self.undirected = network.undirected_legs(self.segments)
        self.departures = services.departures(self.stop_times)
        self.schedules = network.schedules(self.legs, self.departures)
        self.consolidated = network.consolidated(self.schedules)

    def summary(self) -> DataFrame:
        """(mode, n_trips, n_stop_times) of trips with at least two kept stop times."""
        per_trip = self.stop_times.groupBy("trip_id", "mode").agg(F.count("*").alias("_n")).filter("_n >= 2")
        return per_trip.groupBy("mode").agg(F.count("*").alias("n_trips"), F.sum("_n").alias("n_stop_times"))

    def routed_services(self) -> DataFrame:
        """Services with at least one trip left."""
        all_ = services.routed_services(self.routes)
        ran = self.schedules.select(F.col("route_id").alias("external_id")).distinct()
        return all_.join(ran, "external_id", "left_semi")

    def results(self) -> dict[str, DataFrame]:
        trips = self.consolidated if self.config.group_identical else self.schedules
        return {"service_nodes": self.nodes, "leg_segments": self.segments, "legs": self.undirected, "routed_services": self.routed_services(), "trips": trips}

    def write(self, folder: str) -> None:
        """Every result as Parquet below ``folder``."""
        for name, df in self.results().items():
            df.write.mode("overwrite").parquet(f"{folder}/{name}")
