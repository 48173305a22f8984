"""Handlers with completion, tables laid out by trip, presence rules of many feeds."""

import os
import subprocess
import sys

import pytest

from headway.plans.services import Services, ServicesConfig
from headway.queries import services
from headway.queries.adapter import spark_tables
from headway.sources import feed, layout
from headway.sources.handlers import Counting, Handler, Handlers


def place(tmp_path):
    (tmp_path / "trips.txt").write_text("trip_id,service_id,route_id\n" + "".join(f"t{i},s{i % 3},r{i % 7}\n" for i in range(100)))
    (tmp_path / "calendar.txt").write_text("service_id,monday\ns0,1\ns1,0\n")
    return f"file://{tmp_path}"


def test_handlers_see_all_rows_and_complete_once(spark, tmp_path):
    done = []

    class Longest(Handler):
        table = "trips"

        def begin(self):
            return ""

        def row(self, value, row):
            return max(value, row["trip_id"], key=lambda t: (len(t), t))

        def merge(self, a, b):
            return max(a, b, key=lambda t: (len(t), t))

        def complete(self, value):
            done.append(value)

    run = Handlers(feed.Feed(spark, place(tmp_path)))
    one, two, none = Counting("trips", "service_id"), Counting("calendar", "monday"), Counting("agency", "agency_id")
    for h in (one, Longest(), two, none):
        run.register(h)
    for _ in range(2):  # a second reading begins anew
        run.read()
        assert one.counts == {"s0": 34, "s1": 33, "s2": 33} and two.counts == {"1": 1, "0": 1} and none.counts == {}
    assert done == ["t99", "t99"]
    run.reset()
    assert one.counts is None


def test_handlers_of_another_table_are_refused(spark, tmp_path):
    run = Handlers(feed.Feed(spark, place(tmp_path)))
    with pytest.raises(feed.FeedError, match="trips"):
        run.register(Counting("trips", "service_id"), "stops")
    with pytest.raises(feed.FeedError):
        run.register(Counting("nothing", "x"))


RETRIED = """
import sys
from pyspark import TaskContext
from pyspark.sql import SparkSession
from headway.sources.handlers import Counting, handled

class Failing(Counting):
    def row(self, value, row):
        if TaskContext.get().attemptNumber() == 0 and row["k"] == "b":
            raise RuntimeError("lost")
        return super().row(value, row)

spark = SparkSession.builder.master("local[2,3]").config("spark.ui.enabled", "false").getOrCreate()
spark.sparkContext.setLogLevel("OFF")
rows = spark.createDataFrame([("a",)] * 5 + [("b",)] * 4 + [("c",)], "k string").repartition(3)
print(sorted(handled(rows, [Failing("t", "k")])[0].items()))
"""


def test_rows_of_repeated_tasks_count_once():
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    out = subprocess.run([sys.executable, "-c", RETRIED], capture_output=True, text=True, timeout=300, env=os.environ | {"PYTHONPATH": root}, check=False)
    assert out.stdout.strip().endswith("[('a', 5), ('b', 4), ('c', 1)]"), out.stderr[-2000:]


def test_tables_by_trip_need_no_exchange_by_trip(spark, small):
    given = spark_tables(spark, small, *services.CORE)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    moved, names = "hashpartitioning(trip_id", ("stop_times", "legs", "schedules")
    made = lambda tables: Services(tables, ServicesConfig("thursday", periods=services.PERIODS))
    laid = layout.laid_out(given, 8)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        # Where nothing is broadcast, trips come back from their routes and are moved; stop times never are.
        plain, laid = made(given), made(laid)
        for name in names:
            assert plan(getattr(laid, name)).count(moved) < plan(getattr(plain, name)).count(moved), name
        assert plan(plain.stop_times).count(moved) == 2 and plan(laid.stop_times).count(moved) == 1
        assert sorted(map(tuple, laid.segments.collect())) == sorted(map(tuple, plain.segments.collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_presence_rules_of_many_feeds(spark):
    rows = spark.createDataFrame([("x", "agency"), ("x", "calendar"), ("y", "translations"), ("z", None)], "feed string, file string")
    got = {(r["feed"], r["file"]): r["status"] for r in feed.presence_findings(rows, ("feed",)).collect()}
    assert got["x", "agency"] == "ok" and got["x", "calendar_dates"] == "absent" and got["x", "feed_info"] == "absent" and got["x", "stops"] == "missing"
    assert got["y", "feed_info"] == "missing" and got["y", "calendar"] == got["y", "calendar_dates"] == "missing"
    assert len(got) == 51 and got["z", "translations"] == "absent"
