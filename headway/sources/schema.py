"""The tables of a schedule feed: file names, columns and when a file must be there.

All columns are strings that may be null; operators cast what they use.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql.types import StringType, StructField, StructType

# Fixed values of the feed format.
COLUMNS: dict[str, tuple[str, ...]] = {
    "agency": tuple("agency_id agency_name agency_url agency_timezone agency_lang agency_fare_url agency_phone agency_email".split()),
    "stops": tuple("stop_id stop_code stop_name stop_desc stop_lat stop_lon zone_id stop_url location_type parent_station stop_timezone wheelchair_boarding level_id platform_code".split()),
    "routes": tuple("route_id agency_id route_short_name route_long_name route_desc route_type route_url route_color route_text_color route_sort_order continuous_pickup continuous_drop_off".split()),
    "trips": tuple("route_id service_id trip_id trip_headsign trip_short_name direction_id block_id wheelchair_accessible bikes_allowed shape_id".split()),
    "stop_times": tuple("trip_id arrival_time departure_time stop_id stop_sequence stop_headsign pickup_type drop_off_type continuous_pickup continuous_drop_off shape_dist_traveled timepoint".split()),
    "calendar": tuple("service_id monday tuesday wednesday thursday friday saturday sunday start_date end_date".split()),
    "calendar_dates": tuple("service_id date exception_type".split()),
    "fare_attributes": tuple("agency_id currency_type fare_id payment_method price transfers transfer_duration".split()),
    "fare_rules": tuple("fare_id route_id origin_id destination_id contains_id transfers transfer_duration".split()),
    "shapes": tuple("shape_id shape_pt_lat shape_pt_lon shape_pt_sequence".split()),
    "frequencies": tuple("trip_id start_time end_time headway_secs exact_times".split()),
    "transfers": tuple("from_stop_id to_stop_id transfer_type min_transfer_time".split()),
    "pathways": tuple("pathway_id from_stop_id to_stop_id pathway_mode length traversal_time stair_count max_slope min_width signposted_as reversed_signposted_as is_bidirectional".split()),
    "levels": tuple("level_id level_index level_name".split()),
    "feed_info": tuple("feed_publisher_name feed_publisher_url feed_lang default_lang feed_start_date feed_end_date feed_version feed_contact_email feed_contact_url".split()),
    "translations": tuple("table_name field_name language translation record_id record_sub_id field_value".split()),
    "attributions": tuple("attribution_id agency_id route_id trip_id organization_name is_producer is_operator is_authority attribution_url attribution_email attribution_phone".split()),
}

#: Columns that the conversion to services does not need, by table.
UNNEEDED: dict[str, tuple[str, ...]] = {
    "routes": ("route_url", "route_color", "route_text_color", "route_sort_order", "continuous_pickup", "continuous_drop_off"),
    "stop_times": ("stop_headsign",),
    "trips": ("wheelchair_accessible", "bikes_allowed"),
    "frequencies": (),
    "stops": ("stop_code", "stop_url", "stop_timezone", "wheelchair_boarding"),
}


@dataclass(frozen=True)
class Presence:
    """``required``, ``optional``, or required if another file is ``present`` or ``absent``."""

    kind: str
    other: str | None = None

    def required(self, there: set[str]) -> bool:
        return self.kind == "required" or (self.kind == "present" and self.other in there) or (self.kind == "absent" and self.other not in there)


PRESENCE: dict[str, Presence] = {name: Presence("optional") for name in COLUMNS} | {
    **{name: Presence("required") for name in ("agency", "stops", "routes", "trips", "stop_times")},
    "calendar": Presence("absent", "calendar_dates"),
    "calendar_dates": Presence("absent", "calendar"),
    "feed_info": Presence("present", "translations"),
}


def struct(name: str) -> StructType:
    return StructType([StructField(c, StringType()) for c in COLUMNS[name]])


def kept_columns(name: str, columns: str = "all", exclude: tuple[str, ...] = ()) -> list[str]:
    """Columns of a table: ``all``, ``needed`` by the conversion, or ``none``; less those excluded."""
    if columns not in ("all", "needed", "none"):
        raise ValueError(f"columns must be all, needed or none, not {columns!r}")
    dropped = {*exclude, *(UNNEEDED.get(name, ()) if columns == "needed" else ())}
    return [] if columns == "none" else [c for c in COLUMNS[name] if c not in dropped]
