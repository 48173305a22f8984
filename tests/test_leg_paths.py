"""Paths of the legs of the star tables against plain search over all requests, ties and bans included."""

from collections import defaultdict

import pytest

from headway.functions.modes import MODES
from headway.operators import paths
from headway.queries import intermodal, services


def plain_best(edges, origin, target, banned):
    """Least (ticks, segments, ids from the last one back) by relaxing everything until nothing changes."""
    best, front = {origin: (0, 0, ())}, {origin}
    while front:
        nxt = set()
        for node in front:
            ticks, n, ids = best[node]
            for s, to, dt in edges[node]:
                if s not in banned:
                    new = (ticks + dt, n + 1, (s, *ids))
                    if to not in best or new < best[to]:
                        best[to] = new
                        nxt.add(to)
        front = nxt
    return best.get(target)


def test_leg_paths_equal_plain_search(spark):
    sf = "/root/testdata/sf0.01"
    s, w = services._services(spark, sf), intermodal._world(spark, sf)
    asked = intermodal.written(paths.requests_for(s.segments, w.matches, w.connectoids, w.segments))
    segs = {r["segment_id"]: r for r in w.segments.collect()}
    ticks = lambda r, mode: round(r["length_km"] / min(r["speed_kmh"], MODES[mode][1]) * paths.TICKS)
    edges = {m: defaultdict(list) for m in MODES}
    for r in segs.values():
        for m in r["modes"]:
            edges[m][r["from_node"]].append((r["segment_id"], r["to_node"], ticks(r, m)))
    found = []
    for r in asked.collect():
        got = plain_best(edges[r["mode"]], r["origin"], r["target"], set(r["banned"]))
        if got:
            ids = [*got[2][::-1], r["last"]]
            length = round(sum(segs[i]["length_km"] for i in ids), 9)
            found.append((r["from_stop"], r["to_stop"], r["mode"], r["origin"], r["end"], length, (got[0] + ticks(segs[r["last"]], r["mode"])) / paths.TICKS, ids))
    per_leg = defaultdict(list)
    for f in found:
        for stop, node in ((f[0], f[3]), (f[1], f[4])):
            per_leg[stop, f[2], node].append(((f[0], f[1]), f[5]))
    node_of = {}
    for (stop, mode, node), legs in per_leg.items():
        least = defaultdict(lambda: 9e9)
        for leg, length in legs:
            least[leg] = min(least[leg], length)
        key = (-len(least), round(sum(least.values()), 6), node)
        node_of[stop, mode] = min(node_of.get((stop, mode), key), key)
    want = {}
    for f in found:
        if node_of[f[0], f[2]][2] == f[3] and node_of[f[1], f[2]][2] == f[4]:
            leg, value = f[:3], (f[5], f[6], f[7])
            want[leg] = min(want.get(leg, value), value)
    got = {(r["from_stop"], r["to_stop"], r["mode"]): (r["length"], r["cost"], r["segments"]) for r in paths.leg_paths(asked, paths.edges(w.segments)).collect()}
    assert len(want) > 5 and got.keys() == want.keys()
    assert all(got[k][2] == want[k][2] and abs(got[k][0] - want[k][0]) < 1e-6 and abs(got[k][1] - want[k][1]) < 1e-9 for k in want)


@pytest.mark.parametrize("name", ["mapped_service_network", "truncated_trips", "consolidated_parts"])
def test_legs_are_made_once(spark, small, name):
    """What follows after the paths reads the legs that the paths were sought for, and not stop times once more."""
    plan = intermodal.QUERIES[name](spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert "stop_sequence" not in plan and "l_linenumber" not in plan
