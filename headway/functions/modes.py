"""Modes of travel and how route types map to them."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Track and top speed of the modes, and their route types.
MODES = {
    "BUS": ("ROAD", 80.0), "TRAIN": ("RAIL", 140.0), "TRAM": ("RAIL", 60.0),
    "LIGHTRAIL": ("RAIL", 80.0), "SUBWAY": ("RAIL", 100.0), "FERRY": ("WATER", 40.0),
}
ORIGINAL: dict[int, tuple[str, ...]] = {0: ("LIGHTRAIL", "TRAM"), 1: ("SUBWAY",), 2: ("TRAIN",), 3: ("BUS",), 4: ("FERRY",), 11: ("BUS",)}
EXTENDED_RANGES: tuple[tuple[int, int, tuple[str, ...]], ...] = (
    (100, 117, ("TRAIN",)), (400, 400, ("TRAIN",)), (403, 404, ("TRAIN",)), (1503, 1503, ("TRAIN",)),
    (200, 209, ("BUS",)), (700, 716, ("BUS",)), (800, 800, ("BUS",)),
    (900, 906, ("LIGHTRAIL", "TRAM")),
    (1000, 1000, ("FERRY",)), (1200, 1200, ("FERRY",)), (1502, 1502, ("FERRY",)),
)
#: Metro types, which the usual mapping leaves out.
METRO = {401: ("SUBWAY",), 402: ("SUBWAY",)}


class ModeMap:
    """Route types by number, each with its modes, the first being the primary one; types can be switched off."""

    def __init__(self, dialect: str = "EXTENDED", with_metro: bool = False):
        if dialect not in ("ORIGINAL", "EXTENDED"):
            raise ValueError(f"unknown dialect {dialect!r}")
        self.of = dict(ORIGINAL)
        if dialect == "EXTENDED":
            self.of |= {t: modes for a, b, modes in EXTENDED_RANGES for t in range(a, b + 1)}
            self.of |= METRO if with_metro else {}
        self.active = set(self.of)

    def map(self, route_type: int, *modes: str) -> None:
        if unknown := set(modes) - set(MODES):
            raise ValueError(f"unknown modes {sorted(unknown)}")
        self.of[route_type] = tuple(dict.fromkeys(modes))
        self.active.add(route_type)

    def deactivate(self, *route_types: int) -> None:
        self.active -= set(route_types)

    def deactivate_all_except(self, *route_types: int) -> None:
        self.active &= set(route_types)

    def only_tracks(self, tracks: Iterable[str]) -> None:
        """Switches off types none of whose modes runs on one of the tracks."""
        self.active = {t for t in self.active if any(MODES[m][0] in set(tracks) for m in self.of[t])}

    def is_active(self, route_type: int) -> bool:
        return route_type in self.active

    def primary(self, route_type: int) -> str | None:
        return self.of[route_type][0] if route_type in self.active else None

    def active_modes(self) -> list[str]:
        return sorted({m for t in self.active for m in self.of[t]})

    def types_of(self, mode: str) -> list[int]:
        return sorted(t for t in self.active if mode in self.of[t])

    def rows(self, spark: SparkSession) -> DataFrame:
        """(route_type, mode, is_primary) of active types."""
        rows = [(t, m, m == self.of[t][0]) for t in sorted(self.active) for m in self.of[t]]
        return spark.createDataFrame(rows, "route_type int, mode string, is_primary boolean")


def compatibility(mode_map: DataFrame) -> DataFrame:
    """(mode, with_mode): modes that some route type has in common, each with itself too."""
    other = mode_map.select("route_type", F.col("mode").alias("with_mode"))
    return mode_map.select("route_type", "mode").join(other, "route_type").select("mode", "with_mode").distinct()


def on_tracks(mode_map: DataFrame, segments: DataFrame) -> DataFrame:
    """The rows of a mode map whose mode runs on a track that some segment (modes array) has a mode for."""
    track = lambda column: F.coalesce(*[F.when(F.col(column) == m, F.lit(t)) for m, (t, _) in MODES.items()])
    there = segments.select(F.explode("modes").alias("_m")).distinct().select(track("_m").alias("_track")).distinct()
    return mode_map.withColumn("_track", track("mode")).join(there, "_track", "left_semi").drop("_track")


def route_type(value: Column) -> Column:
    return value.cast("string").try_cast("smallint").cast("int")


def location_type(value: Column) -> Column:
    """0 (a stop or platform) for blank; null for what is no number from 0 to 4."""
    n = F.trim(F.coalesce(value.cast("string"), F.lit("")))
    code = n.try_cast("int")
    return F.when(n == "", F.lit(0)).otherwise(F.when(code.between(0, 4), code))
