import zipfile

import pytest

from headway.sources import schema
from headway.sources.feed import Feed, FeedError, described, normal

TRIPS = "﻿ Trip_ID ,ROUTE_ID,service_id,extra,trip_headsign\nt1,r1,s1,?,\"Main, \"\"North\"\"\"\nt2,r1,s2,?,\n"


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "trips.txt").write_text(TRIPS, encoding="utf-8")
    (tmp_path / "stops.txt").write_text("stop_id,stop_name\n1,a\n2,\"two\nlines\"\n", encoding="utf-8")
    (tmp_path / "translations.txt").write_text("table_name,language\nstops,fr\n")
    (tmp_path / "calendar_dates.txt").write_text("service_id,date\ns,20240101\n")
    return tmp_path


def test_headers_are_normalised_and_missing_columns_null(spark, folder):
    feed = Feed(spark, f"file://{folder}")
    trips = feed.table("trips")
    assert trips.columns == list(schema.COLUMNS["trips"])
    rows = {r["trip_id"]: r for r in trips.collect()}
    assert rows["t1"]["trip_headsign"] == 'Main, "North"' and rows["t2"]["trip_headsign"] == ""
    assert rows["t1"]["shape_id"] is None
    assert feed.unknown_columns("trips") == ["extra"]
    assert feed.table("stops").filter("stop_id = '2'").first()["stop_name"] == "two\nlines"


def test_zip_gives_the_same_tables(spark, folder, tmp_path_factory):
    path = tmp_path_factory.mktemp("zip") / "feed.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in folder.iterdir():
            z.write(f, f.name)
        z.writestr("readme.md", "no table")
    a, b = Feed(spark, f"file://{folder}"), Feed(spark, f"file://{path}")
    assert sorted(a.tables()) == sorted(b.tables())
    for name in a.tables():
        assert sorted(map(tuple, a.table(name).collect()), key=repr) == sorted(map(tuple, b.table(name).collect()), key=repr)


def test_columns_and_transforms(spark, folder):
    feed = Feed(spark, str(folder))
    assert "trip_headsign" not in feed.table("trips", exclude=("trip_headsign",)).columns
    assert "bikes_allowed" not in feed.table("trips", "needed").columns
    none = feed.table("trips", "none")
    assert none.columns == [] and none.count() == 2
    feed.register("trips", lambda df: df.filter("service_id = 's2'"))
    assert [r["trip_id"] for r in feed.table("trips").collect()] == ["t2"]
    with pytest.raises(FeedError):
        feed.register("nothing", lambda df: df)
    with pytest.raises(ValueError):
        schema.kept_columns("trips", "some")
    feed.views()
    assert spark.sql("select count(*) from translations").first()[0] == 1


def test_presence(spark, folder):
    status = {r["file"]: r["status"] for r in Feed(spark, str(folder)).validate().collect()}
    assert status["agency.txt"] == "missing" and status["calendar.txt"] == "absent" and status["feed_info.txt"] == "missing"
    assert status["calendar_dates.txt"] == "ok" and status["levels.txt"] == "absent"


def test_bad_locations(spark, tmp_path):
    with pytest.raises(FeedError):
        Feed(spark, str(tmp_path / "none"))
    (tmp_path / "a.txt").write_text("x")
    with pytest.raises(FeedError):
        Feed(spark, str(tmp_path / "a.txt"))
    with pytest.raises(FeedError):
        Feed(spark, str(tmp_path)).table("trips")


def test_lines_and_headers(spark):
    df = spark.createDataFrame([("a", None)], "x string, y string")
    assert described(df, "trip").first()["line"] == "TRIP: x a, y n/a"
    assert normal(["﻿Stop_ID ", " B"]) == ["stop_id", "b"]
