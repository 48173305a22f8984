"""Stops to transfer zones and to the links that give access to them.

Tables: stops (stop_id, x, y, mode, platform_code), zones (zone_id, platforms
array, x, y), connectoids (connectoid_id, zone_id, segment_id, link_id,
access_node, modes array), links (link_id, node_a, node_b, geometry), segments
(segment_id, link_id, from_node, to_node, modes array, capacity). Every choice is
one ranking with a fixed order of ties, so results don't depend on the order in
which stops are seen. All splits of a link are made at once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from headway.functions import geo
from headway.functions.modes import MODES
from headway.operators import spatial

OVERRIDE, PLATFORM, ACCESS_LINK, ANGLE = 1, 3, 4, 5


def allowing(links: DataFrame, segments: DataFrame) -> DataFrame:
    """Links with the modes and the largest capacity of their segments."""
    per = segments.groupBy("link_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("modes")))).alias("link_modes"), F.max("capacity").alias("link_capacity"))
    return links.join(per, "link_id")


def candidate_links(stops: DataFrame, links: DataFrame, segments: DataFrame, radius: float = spatial.LINK_RADIUS, crowded: list[DataFrame] | None = None) -> DataFrame:
    """Near links that allow the stop's mode, no farther than the radius; only their segments are looked at, not those of the whole network."""
    pairs = spatial.near_links(stops, links, radius, by_line=True, crowded=crowded).filter(F.col("d2") <= radius * radius)
    keys = ["stop_id", "mode", "link_id"]
    rest = F.first(F.struct(*[c for c in pairs.columns if c not in keys])).alias("_rest")
    modes = F.array_sort(F.array_distinct(F.flatten(F.collect_list("_modes")))).alias("link_modes")
    own = segments.select("link_id", F.col("modes").alias("_modes"), F.col("capacity").alias("_capacity"))
    seen = pairs.join(own, "link_id").groupBy(*keys).agg(rest, modes, F.max("_capacity").alias("link_capacity")).filter(F.array_contains("link_modes", F.col("mode")))
    columns = [*stops.columns, *[c for c in links.columns if c not in stops.columns], "link_modes", "link_capacity", "near", "d2"]
    return seen.select(*[c if c in (*keys, "link_modes", "link_capacity") else F.col(f"_rest.{c}") for c in columns])


ROAD_MODES = [m for m, (track, _) in MODES.items() if track == "ROAD"]


def access_links(stops: DataFrame, links: DataFrame, segments: DataFrame, forced: DataFrame | None = None, crowded: list[DataFrame] | None = None) -> DataFrame:
    """One link per stop and mode: of those within the buffer of the closest, on roads the one with most capacity, then the closest, then the least id.

    ``forced`` (stop_id, link_id) names links that stops have to use wherever they lie, if they allow the mode.
    """
    near = spatial.within_buffer(candidate_links(stops, links, segments, crowded=crowded).withColumn("_key", F.struct("stop_id", "mode")), "_key").drop("_key")
    road = F.when(F.col("mode").isin(ROAD_MODES), F.col("link_capacity")).otherwise(F.lit(0.0))
    nth = F.row_number().over(Window.partitionBy("stop_id", "mode").orderBy(F.desc("_road"), "d2", "link_id"))
    best = near.withColumn("_road", road).withColumn("_nth", nth).filter("_nth = 1").drop("_nth", "_road")
    if forced is None:
        return best
    given = stops.join(forced.select("stop_id", "link_id"), "stop_id").join(allowing(links, segments), "link_id").filter(F.array_contains("link_modes", F.col("mode")))
    given = given.withColumn("near", geo.closest_on_line(F.col("x"), F.col("y"), F.col("geometry"))).withColumn("d2", F.col("near.d2"))
    return best.join(given.select("stop_id", "mode"), ["stop_id", "mode"], "left_anti").unionByName(given.select(best.columns))


def link_overrides(overrides: DataFrame, links: DataFrame) -> DataFrame:
    """(stop_id, link_id) of overrides (stop_id, value, id_type, pos) by a link's id, external_id or xml_id; the last of a stop counts, those that name no link none."""
    kinds = [(k, c) for k, c in (("ID", "link_id"), ("EXTERNAL_ID", "external_id"), ("XML_ID", "xml_id")) if c in links.columns]
    keyed = [links.select(F.lit(kind).alias("id_type"), F.col(column).cast("string").alias("value"), "link_id") for kind, column in kinds]
    for more in keyed[1:]:
        keyed[0] = keyed[0].unionByName(more)
    found = overrides.join(keyed[0], ["id_type", "value"])
    return found.groupBy("stop_id").agg(F.max(F.struct("pos", "link_id"))["link_id"].alias("link_id"))


def on_driving_side(pairs: DataFrame, connectoids: DataFrame, segments: DataFrame, links: DataFrame, left_hand: bool = True) -> DataFrame:
    """(stop_id, zone_id, any_on_side, all_on_side) of pairs (stop_id, zone_id, mode, x, y).

    Whether the stop lies on the side of travel of some, or of every, access segment of the zone that allows the mode.
    """
    ends = connectoids.select("zone_id", "segment_id", F.col("modes").alias("_modes")).join(segments.select("segment_id", "link_id", "from_node"), "segment_id").join(links.select("link_id", "node_a", "geometry"), "link_id")
    seen = pairs.select("stop_id", "zone_id", "mode", "x", "y").join(ends, "zone_id").filter(F.array_contains("_modes", F.col("mode")))
    side = geo.side(F.col("x"), F.col("y"), geo.closest_on_line(F.col("x"), F.col("y"), F.col("geometry")))
    along = F.col("from_node") == F.col("node_a")
    wanted, other = ("LEFT", "RIGHT") if left_hand else ("RIGHT", "LEFT")
    right = (side == "ON") | (side == F.when(along, wanted).otherwise(other))
    return seen.groupBy("stop_id", "zone_id").agg(F.max(right).alias("any_on_side"), F.min(right).alias("all_on_side"))


def zone_modes(connectoids: DataFrame) -> DataFrame:
    """(zone_id, modes): all modes of a zone's connectoids, sorted."""
    return connectoids.groupBy("zone_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("modes")))).alias("modes"))


def sides(stops: DataFrame, links: DataFrame) -> DataFrame:
    """(stop_id, link_id, side) of every near link: where the stop lies seen along it."""
    return spatial.near_links(stops, links).withColumn("side", geo.side(F.col("x"), F.col("y"), F.col("near")))


def entry_segments(chosen: DataFrame, segments: DataFrame, left_hand: bool = True) -> DataFrame:
    """The segments of each stop's link that allow its mode and, on roads, have the stop on the side of travel.

    ``chosen`` has near, as from :func:`access_links`; a segment along the link
    sees the stop as the line does, one against it the other way round.
    """
    own = segments.select("segment_id", "link_id", "from_node", "to_node", "modes")
    pairs = chosen.select("stop_id", "mode", "x", "y", "link_id", "node_a", "node_b", "near", "d2").join(own, "link_id").filter(F.array_contains("modes", F.col("mode")))
    side = geo.side(F.col("x"), F.col("y"), F.col("near"))
    seen = F.when(F.col("from_node") == F.col("node_a"), side).otherwise(F.when(side == "LEFT", "RIGHT").when(side == "RIGHT", "LEFT").otherwise(side))
    road = F.col("mode").isin(ROAD_MODES)
    wanted = "LEFT" if left_hand else "RIGHT"
    return pairs.withColumn("side", seen).filter(~road | F.col("side").isin(wanted, "ON"))


def platform_matches():
    return F.coalesce(F.exists("platforms", lambda p: F.lower(p) == F.lower(F.col("platform_code"))), F.lit(False))


def zone_candidates(stops: DataFrame, zones: DataFrame, connectoids: DataFrame, access: DataFrame, radius: float = spatial.ZONE_RADIUS, compatible: DataFrame | None = None, side: DataFrame | None = None) -> DataFrame:
    """(stop_id, mode, zone_id, priority, d2) of every way in which a near zone that serves the stop's mode fits.

    With ``compatible`` (mode, with_mode) a zone may also serve a mode that goes with the stop's. With ``side``
    (stop_id, zone_id, any_on_side, as from :func:`on_driving_side`), a zone none of whose access segments has a
    road stop on its side of travel does not fit.

    Priority 3: a platform has the stop's code, in any case. 4: a connectoid of
    the zone lies on the stop's own link, at most the zone's and the link's
    radius away. 5: seen from the stop's link, zone and stop lie in directions
    less than ``MAX_ANGLE`` apart.
    """
    served = zone_modes(connectoids).withColumnRenamed("modes", "zone_modes")
    pairs = spatial.near_zones(stops, zones, radius).join(served, "zone_id")
    if compatible is None:
        pairs = pairs.filter(F.array_contains("zone_modes", F.col("mode")))
    else:
        pairs = pairs.join(compatible.groupBy("mode").agg(F.collect_set("with_mode").alias("_with")), "mode").filter(F.arrays_overlap("zone_modes", "_with")).drop("_with")
    if side is not None:
        pairs = pairs.join(side.select("stop_id", "zone_id", "any_on_side"), ["stop_id", "zone_id"], "left")
        pairs = pairs.filter(~F.col("mode").isin(ROAD_MODES) | F.coalesce("any_on_side", F.lit(False))).drop("any_on_side")
    reach = radius + spatial.LINK_RADIUS
    zone_links = connectoids.select("zone_id", F.col("link_id").alias("_link")).distinct().groupBy("zone_id").agg(F.collect_set("_link").alias("_links"))
    own = access.select("stop_id", "mode", F.col("link_id").alias("_own"), F.col("near").alias("_near"))
    seen = pairs.join(zone_links, "zone_id", "left").join(own, ["stop_id", "mode"], "left")
    same = F.coalesce(F.array_contains("_links", F.col("_own")), F.lit(False)) & (F.col("d2") <= reach * reach)
    to_stop = geo.azimuth(F.col("_near.x"), F.col("_near.y"), F.col("x"), F.col("y"))
    to_zone = geo.azimuth(F.col("_near.x"), F.col("_near.y"), F.col("zx"), F.col("zy"))
    angle = F.coalesce(geo.angle_between(to_stop, to_zone) < spatial.MAX_ANGLE, F.lit(False))
    priority = F.when(platform_matches(), PLATFORM).when(same, ACCESS_LINK).when(angle, ANGLE)
    return seen.select("stop_id", "mode", "zone_id", priority.alias("priority"), "d2").filter("priority is not null")


def conflicts(candidates: DataFrame) -> DataFrame:
    """(stop_id, zones) of stops whose modes fit different zones best; zones is an array of (mode, zone_id), sorted. A mode without candidates is in no conflict."""
    nth = F.row_number().over(Window.partitionBy("stop_id", "mode").orderBy("priority", "d2", "zone_id"))
    best = candidates.withColumn("_nth", nth).filter("_nth = 1")
    per = best.groupBy("stop_id").agg(F.array_sort(F.collect_list(F.struct("mode", "zone_id"))).alias("zones"), (F.min("zone_id") != F.max("zone_id")).alias("_differ"))
    return per.filter("_differ").drop("_differ")


def matched(candidates: DataFrame, overrides: DataFrame | None = None, force_new: DataFrame | None = None, no_joint: DataFrame | None = None) -> DataFrame:
    """(stop_id, zone_id, priority): the best candidate of each stop.

    ``overrides`` (stop_id, zone_id, pos) beat all, the last of them first. Other stops in ``force_new`` (stop_id) are
    matched to none. Stops in ``no_joint`` (stop_id) share no zone: such a stop keeps its zone only if no other stop
    is matched to it, but of several that all are in the list the best candidate does.
    """
    nth = F.row_number().over(Window.partitionBy("stop_id").orderBy("priority", "d2", "zone_id"))
    best = candidates.withColumn("_nth", nth).filter("_nth = 1").select("stop_id", "zone_id", "priority", "d2")
    if force_new is not None:
        best = best.join(force_new.select("stop_id").distinct(), "stop_id", "left_anti")
    if overrides is not None:
        given = registry(overrides).select("stop_id", "zone_id", F.lit(OVERRIDE).alias("priority"), F.lit(0.0).alias("d2"))
        best = given.unionByName(best.join(given.select("stop_id"), "stop_id", "left_anti"))
    if no_joint is not None:
        alone = best.join(no_joint.select("stop_id", F.lit(True).alias("_alone")).distinct(), "stop_id", "left").withColumn("_alone", F.coalesce("_alone", F.lit(False)) & (F.col("priority") != OVERRIDE))
        here = Window.partitionBy("zone_id")
        first = F.row_number().over(here.orderBy("_alone", "priority", "d2", "stop_id"))
        best = alone.withColumn("_first", first).filter("not _alone or _first = 1")
    return best.select("stop_id", "zone_id", "priority")


def registry(pairs: DataFrame) -> DataFrame:
    """(stop_id, zone_id): one zone per stop, the one with the highest pos."""
    return pairs.groupBy("stop_id").agg(F.max(F.struct("pos", "zone_id"))["zone_id"].alias("zone_id"))


def resolved_overrides(overrides: DataFrame, zones: DataFrame) -> DataFrame:
    """Overrides (stop_id, value, id_type, pos) by a zone's id, external_id or xml_id; those that name none are left out."""
    ids = [zones.select(F.lit(kind.upper()).alias("id_type"), F.col(column).cast("string").alias("value"), "zone_id") for kind, column in (("id", "zone_id"), ("external_id", "external_id"), ("xml_id", "xml_id"))]
    keyed = ids[0].unionByName(ids[1]).unionByName(ids[2])
    return overrides.join(keyed, ["id_type", "value"]).select("stop_id", "zone_id", "pos")


def attached(zones: DataFrame, pairs: DataFrame, stops: DataFrame) -> DataFrame:
    """Zones with the stops matched to them: external_ids, name and platforms.

    A zone without platforms takes the longest stop name if that is longer than its own.
    """
    found = pairs.join(stops.select("stop_id", "stop_name", "platform_code"), "stop_id").groupBy("zone_id").agg(
        F.array_sort(F.collect_set(F.col("stop_id").cast("string"))).alias("_ids"),
        F.max(F.struct(F.char_length("stop_name"), "stop_name"))["stop_name"].alias("_name"),
        F.array_sort(F.collect_set("platform_code")).alias("_codes"),
    )
    named = F.when((F.size("platforms") == 0) & (F.coalesce(F.char_length("_name"), F.lit(0)) > F.coalesce(F.char_length("name"), F.lit(0))), F.col("_name")).otherwise(F.col("name"))
    joined = zones.join(found, "zone_id", "left")
    own = F.filter(F.array("external_id"), lambda x: x.isNotNull())
    return joined.withColumns({
        "external_ids": F.array_join(F.array_distinct(F.concat(own, F.coalesce("_ids", F.array().cast("array<string>")))), ";"),
        "name": named, "platforms": F.array_distinct(F.concat("platforms", F.coalesce("_codes", F.array().cast("array<string>")))),
    }).drop("_ids", "_name", "_codes", "external_id")


def last_external_id(ids):
    """The last of external ids that commas part."""
    return F.element_at(F.split(ids, ","), -1)


def snapped(chosen: DataFrame, nodes: DataFrame, snap: float = spatial.SNAP) -> DataFrame:
    """Where each chosen link is entered: at an end node no farther than ``snap`` (the second of both), or at a new node at fraction ``at``."""
    ends = nodes.select(F.col("node_id"), F.col("x").alias("_nx"), F.col("y").alias("_ny"))
    both = chosen.join(ends.select(F.col("node_id").alias("node_a"), F.col("_nx").alias("ax"), F.col("_ny").alias("ay")), "node_a")
    both = both.join(ends.select(F.col("node_id").alias("node_b"), F.col("_nx").alias("bx"), F.col("_ny").alias("by")), "node_b")
    square = lambda a, b: (F.col("near.x") - F.col(a)) * (F.col("near.x") - F.col(a)) + (F.col("near.y") - F.col(b)) * (F.col("near.y") - F.col(b))
    node = F.when(square("bx", "by") <= snap * snap, F.col("node_b")).when(square("ax", "ay") <= snap * snap, F.col("node_a"))
    return both.withColumns({"access_node": node, "is_new": node.isNull()})


def split_links(links: DataFrame, entries: DataFrame) -> DataFrame:
    """Links cut at all their new nodes at once: (link_id, piece, x0, y0, x1, y1, geometry), pieces numbered from 0 along the link.

    Pieces keep the points between their ends; equal places cut once.
    """
    place = F.struct(F.col("near.along").alias("along"), F.col("near.x").alias("x"), F.col("near.y").alias("y"))
    per = entries.filter("is_new").select("link_id", place.alias("_p")).groupBy("link_id").agg(F.collect_list("_p").alias("_all"))
    # Of cuts at one point the first along the link counts.
    sorted_ = F.array_sort("_all")
    once = F.filter(F.transform(sorted_, lambda p, i: F.when((i > 0) & (F.get("_all", i - 1)["x"] == p["x"]) & (F.get("_all", i - 1)["y"] == p["y"]), F.lit(None)).otherwise(p)), lambda p: p.isNotNull())
    per = per.withColumn("_all", sorted_).withColumn("_cuts", once).drop("_all")
    cut = links.join(per, "link_id", "left").withColumn("_cuts", F.coalesce("_cuts", F.array().cast("array<struct<along:double,x:double,y:double>>")))
    end = lambda at, p: F.array(F.struct(at.cast("double").alias("along"), p["x"].alias("x"), p["y"].alias("y")))
    chain = F.concat(end(F.lit(0), F.element_at("geometry", 1)), "_cuts", end(F.size("geometry") - 1, F.element_at("geometry", -1)))
    pieces = cut.withColumn("_chain", chain).select("link_id", "geometry", "_chain", F.posexplode(F.slice("_chain", 2, F.size("_chain") - 1)).alias("piece", "_to"))
    here = F.get("_chain", F.col("piece"))
    between = F.filter(F.transform("geometry", lambda p, i: F.when((i > here["along"]) & (i < F.col("_to.along")), p)), lambda p: p.isNotNull())
    point = lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))
    return pieces.select(
        "link_id", "piece", here["x"].alias("x0"), here["y"].alias("y0"), F.col("_to.x").alias("x1"), F.col("_to.y").alias("y1"),
        F.concat(F.array(point(here)), between, F.array(point(F.col("_to")))).alias("geometry"),
    )


def new_zones(stops: DataFrame, pairs: DataFrame, box: DataFrame, access: DataFrame) -> DataFrame:
    """A zone for each stop inside the network's box that was matched to none and has a link to enter: (stop_id, mode, x, y, link_id), a row per mode."""
    alone = stops.join(pairs.select("stop_id"), "stop_id", "left_anti")
    inside = alone.join(F.broadcast(box)).filter(F.col("x").between(F.col("x_min"), F.col("x_max")) & F.col("y").between(F.col("y_min"), F.col("y_max")))  # box is one row
    return inside.select("stop_id", "mode", "x", "y").join(access.select("stop_id", "mode", "link_id"), ["stop_id", "mode"])


def common_modes(entries: DataFrame, compatible: DataFrame | None = None) -> DataFrame:
    """(stop_id, mode, common) of entries (stop_id, mode, segment_id, modes): the modes that all of a stop's entry segments for its mode allow.

    Only the mode itself counts, or with ``compatible`` (mode, with_mode) those that go with it.
    """
    per = entries.groupBy("stop_id", "mode").agg(F.collect_set("modes").alias("_all"))
    shared = F.aggregate(F.slice("_all", 2, F.size("_all")), F.get("_all", 0), lambda a, m: F.array_intersect(a, m))
    wanted = F.array("mode")
    if compatible is not None:
        per = per.join(compatible.groupBy("mode").agg(F.collect_set("with_mode").alias("_with")), "mode", "left")
        wanted = F.array_union(F.array("mode"), F.coalesce("_with", F.array().cast("array<string>")))
    return per.select("stop_id", "mode", F.array_sort(F.array_intersect(shared, wanted)).alias("common"))


def connectoids_for(zones: DataFrame, entries: DataFrame, mode_map: DataFrame | None = None) -> DataFrame:
    """(zone_key, segment_id, access_node, modes): a connectoid for each entry segment of a new zone.

    A stop has one zone for all its modes. For each of them its connectoids allow those modes that every entry segment
    for it allows: the mode itself and, with a mode map, those that share a route type with it. A segment by which
    several modes enter allows what any of them brings.
    """
    from headway.functions.modes import compatibility

    own = entries.join(zones.select("stop_id", "mode"), ["stop_id", "mode"], "left_semi").select("stop_id", "mode", "segment_id", F.col("to_node").alias("access_node"), "modes")
    brought = own.join(common_modes(own, None if mode_map is None else compatibility(mode_map)), ["stop_id", "mode"])
    made = brought.groupBy(F.col("stop_id").alias("zone_key"), "segment_id", "access_node").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("common")))).alias("modes"))
    return made.filter(F.size("modes") > 0)


def excluded(stops: DataFrame, ids: DataFrame) -> DataFrame:
    return stops.join(ids.select("stop_id").distinct(), "stop_id", "left_anti")


def served(stops: DataFrame, stop_modes: DataFrame, active: list[str] | None = None) -> DataFrame:
    """Stops where some kept trip of an active mode calls; ``modes`` (of stop_modes) less the others."""
    own = stop_modes if active is None else stop_modes.withColumn("modes", F.array_intersect("modes", F.array(*map(F.lit, active)).cast("array<string>")))
    kept = own.filter(F.size("modes") > 0)
    return stops.join(kept.select("stop_id", "modes") if "modes" not in stops.columns else kept.select("stop_id"), "stop_id", "inner" if "modes" not in stops.columns else "left_semi")


def connectoids_at(nodes: DataFrame, connectoids: DataFrame) -> DataFrame:
    """(node_id, connectoid_id, zone_id, segment_id, modes) of the connectoids that give access at each of the nodes."""
    at = connectoids.select(F.col("access_node").alias("node_id"), "connectoid_id", "zone_id", "segment_id", "modes")
    return nodes.select("node_id").distinct().join(at, "node_id")


def widened(connectoids: DataFrame, pairs: DataFrame, stops: DataFrame, segments: DataFrame, compatible: DataFrame) -> DataFrame:
    """Connectoids whose modes take in those that go with the modes of the stops matched to their zone, as far as the access segment allows them.

    ``stops`` has stop_id and mode, a row per mode; ``compatible`` has (mode, with_mode).
    """
    more = pairs.select("stop_id", "zone_id").join(stops.select("stop_id", "mode"), "stop_id").join(compatible, "mode").groupBy("zone_id").agg(F.collect_set("with_mode").alias("_more"))
    allowed = segments.select("segment_id", F.col("modes").alias("_allowed"))
    joined = connectoids.join(more, "zone_id", "left").join(allowed, "segment_id", "left")
    extra = F.array_intersect(F.coalesce("_more", F.array().cast("array<string>")), F.coalesce("_allowed", F.array().cast("array<string>")))
    return joined.withColumn("modes", F.array_sort(F.array_union("modes", extra))).select(connectoids.columns)


def counters(pairs: DataFrame, created: DataFrame, stops: DataFrame | None = None, connectoids: DataFrame | None = None) -> DataFrame:
    """(outcome, n): matches by strategy, and zones created; with ``stops`` and ``connectoids`` also stops seen, zones augmented and connectoids made."""
    name = F.when(F.col("priority") == OVERRIDE, "override").when(F.col("priority") == PLATFORM, "platform").when(F.col("priority") == ACCESS_LINK, "access_link").otherwise("angle")
    out = pairs.groupBy(name.alias("outcome")).agg(F.count("*").alias("n"))
    one = lambda df, what, n: df.agg(n.alias("n")).select(F.lit(what).alias("outcome"), "n")
    out = out.unionByName(one(created, "created", F.countDistinct("stop_id")))
    if stops is not None:
        out = out.unionByName(one(stops, "stops", F.countDistinct("stop_id"))).unionByName(one(pairs, "augmented", F.countDistinct("zone_id")))
    if connectoids is not None:
        out = out.unionByName(one(connectoids, "connectoids", F.count("*")))
    return out
