"""What reading an archive verifies."""

import base64
import hashlib
import json
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from headway.llm import warc
from headway.llm.base import shared_dir

SHA1 = hashlib.sha1(b"<p>a").hexdigest()


def test_a_record_with_a_false_digest_or_length_is_refused():
    good = warc.record(1, "http://a/", b"<p>a", SHA1, None)
    assert warc.parse_record(good)["payload"] == b"<p>a"
    with pytest.raises(ValueError, match="digest"):
        warc.parse_record(warc.record(1, "http://a/", b"<p>b", SHA1, None))
    with pytest.raises(ValueError, match="bytes"):
        warc.parse_record(good.replace(b"\r\nContent-Length: 4\r\n", b"\r\nContent-Length: 5\r\n"))
    assert warc.parse_record(warc.record(2, "http://a/", b"<p>a", SHA1, 1))["refers_to"] == 1


def package(path, archives, entries, method=zipfile.ZIP_STORED):
    with zipfile.ZipFile(path, "w") as z:
        for name, raw in archives.items():
            z.writestr(name, raw, method)
        for name, lines in entries.items():
            z.writestr(name, "\n".join(lines), zipfile.ZIP_DEFLATED)


def packed(raw):
    gz = zlib.compressobj(6, zlib.DEFLATED, 31)
    return gz.compress(raw) + gz.flush()


def test_all_archives_and_indexes_are_read(tmp_path):
    a, b = (packed(warc.record(i, f"http://a/{i}", t, hashlib.sha1(t).hexdigest(), None)) for i, t in ((1, b"one"), (2, b"two")))
    line = lambda name, raw: f"com,a)/ 20000101000000 {json.dumps({'filename': name, 'offset': '0', 'length': str(len(raw))})}"
    path = tmp_path / "p.wacz"
    package(path, {"archive/x.warc.gz": a, "archive/y.warc.gz": b}, {"indexes/1.cdxj": ["!meta", line("x.warc.gz", a)], "indexes/2.cdxj": [line("archive/y.warc.gz", b)]})
    assert [r["page_id"] for r in warc.records(f"file://{path}")] == [1, 2]
    package(path, {"archive/x.warc.gz": a}, {"indexes/1.cdxj": [line("z.warc.gz", a)]})
    with pytest.raises(ValueError, match="not in the package"):
        list(warc.records(f"file://{path}"))
    package(path, {"archive/x.warc.gz": a}, {"indexes/1.cdxj": [line("x.warc.gz", a)]}, zipfile.ZIP_DEFLATED)
    with pytest.raises(ValueError, match="not stored"):
        list(warc.records(f"file://{path}"))


def test_lost_responses_are_noticed(spark):
    rows = [(1, 3, "D", "response", None), (2, 3, "D", "revisit", 1), (3, 3, "E", "revisit", 1), (4, 3, "D", "revisit", 9)]
    found = spark.createDataFrame(rows, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
    assert sorted(r["page_id"] for r in warc.unfounded(found).collect()) == [3, 4]


@pytest.mark.parametrize("limit", [0, 10**6])
def test_both_ways_of_joining_and_clashing_columns(spark, monkeypatch, limit):
    from headway.llm import base

    monkeypatch.setattr(base, "BROADCAST_ROWS", limit)
    rows = [(5, "u", "x"), (3, "u", "x"), (None, "u", "x"), (None, "v", "y"), (None, "w", "y"), (7, "u", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"sha1": F.lit(1), "refers_to": F.lit("r"), "payload": F.lit(2)})
    digest = lambda t: base64.b32encode(hashlib.sha1(t).digest()).decode()
    x, y, none = digest(b"x"), digest(b"y"), digest(b"")
    want = [(3, 1, x, "response", None), (5, 1, x, "revisit", 3), (None, 1, x, "revisit", 3), (None, 1, y, "response", None), (None, 1, y, "response", None), (7, 0, none, "response", None)]
    assert sorted(map(tuple, warc.round_trip(pages).collect()), key=repr) == sorted(want, key=repr)


def test_a_package_a_task(spark):
    pages = spark.range(40).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.concat(F.lit("p"), "id").alias("html"))
    manifest = warc.write(pages.repartition(2), shared_dir(spark), package_bytes=1_000)
    found = warc.read(manifest)
    assert manifest.count() > 4 and found.rdd.getNumPartitions() == manifest.count() and found.count() == 40
