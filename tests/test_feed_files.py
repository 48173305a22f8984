"""Feeds as files: splits, zips, line feeds in fields, row counts."""

import zipfile

import pytest
from pyspark.sql import functions as F

from headway.plans.services import from_feed
from headway.sources import feed as feeds
from headway.sources import tables


def written(folder, **files):
    folder.mkdir(parents=True, exist_ok=True)
    for name, text in files.items():
        (folder / f"{name}.txt").write_text(text, encoding="utf-8")
    return f"file://{folder}"


def test_large_tables_are_read_in_splits(spark, tmp_path):
    rows = "".join(f't{i},08:00:00,08:00:10,"s,{i % 7}",{i}\n' for i in range(120_000))
    place = written(tmp_path / "f", stop_times="trip_id,arrival_time,departure_time,stop_id,stop_sequence\n" + rows)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "256k")
    try:
        df = feeds.Feed(spark, place).table("stop_times")
        assert df.rdd.getNumPartitions() >= len(rows) // (256 << 10)
        assert df.agg(F.count("*"), F.countDistinct("trip_id"), F.max("stop_id")).first() == (120_000, 120_000, "s,6")
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_line_feeds_in_fields(spark, tmp_path):
    place = written(tmp_path / "f", stops='stop_id,stop_name,stop_desc\n1,"A ""b""","two\nlines"\n2,C,\n', routes='route_id,route_short_name\n1,"x ""y"""\n')
    feed = feeds.Feed(spark, place)
    assert feed.multiline("stops") and not feed.multiline("routes")
    got = sorted((r["stop_id"], r["stop_name"], r["stop_desc"]) for r in feed.table("stops").collect())
    assert got == [("1", 'A "b"', "two\nlines"), ("2", "C", "")]
    assert feed.table("routes").first()["route_short_name"] == 'x "y"'


def test_zips_are_unpacked_by_tasks(spark, tmp_path):
    path = tmp_path / "feed.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("sub/stops.txt", "stop_id,stop_name\n1,a\n2,b\n")
        z.writestr("routes.txt", "route_id\n5\n")
        z.writestr("notes.txt", "x")
    feed = feeds.Feed(spark, f"file://{path}")
    assert sorted(feed.tables()) == ["routes", "stops"] and feed.table("stops").count() == 2
    with zipfile.ZipFile(path, "a") as z:
        z.writestr("stops.txt", "stop_id\n1\n")
    with pytest.raises(feeds.FeedError, match="twice"):
        feeds.Feed(spark, f"file://{path}")


def test_rows_are_counted_as_they_are_read(spark, tmp_path):
    place = written(tmp_path / "f", stops="stop_id\n" + "".join(f"{i}\n" for i in range(50)))
    df, seen = feeds.Feed(spark, place).counted("stops")
    assert df.filter("stop_id < 10").count() == 10
    assert seen.get["rows"] == 50


def test_shared_folder_is_asked_for_on_clusters(spark, monkeypatch):
    class Session:
        class conf:
            get = staticmethod(lambda name, default=None: default)

        class sparkContext:
            master = "spark://somewhere:7077"

    with pytest.raises(ValueError, match="checkpoint"):
        tables.shared(Session())


def test_stops_of_a_feed(spark, tmp_path):
    stops = "stop_id,stop_name,stop_lat,stop_lon,location_type,platform_code\n1,A,-33.5,151.0,,2\n2,B,-33.6,151.1,1,\n3,C,x,151.1,0,\n4,D,-33.6,151.1,0,\n"
    place = written(tmp_path / "f", routes="route_id\n", calendar="service_id\n", trips="trip_id\n", stop_times="trip_id\n", stops=stops)
    got = from_feed(feeds.Feed(spark, place).tables())["stops"].collect()
    rows = {r["stop_id"]: (r["lat"], r["lon"], r["platform_code"]) for r in got}
    assert rows == {"1": (-33.5, 151.0, "2"), "3": (None, 151.1, ""), "4": (-33.6, 151.1, "")}
