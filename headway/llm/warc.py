"""WARC records in ZIP packages, written and read where the data lies.

Writing: payloads are digested in the scan; the smallest page_id of a digest is
found by grouping (with partial minima before the shuffle) and joined to its
copies, as narrow rows. That table of copies is written and measured: with at
most ``base.BROADCAST_ROWS`` rows it is sent to where the payloads lie, and no
payload is shuffled; with more, both sides are, once. Then each partition writes
packages of about ``PACKAGE_BYTES``. A package stores ``archive/data.warc.gz``
(one gzip member a record) and ``indexes/index.cdxj`` (sorted by key; each line a
key, a time and JSON with filename, offset and length) without compression, so
both can be read by range.

Reading: the end of a package gives its central directory (ZIP64 too), that the
places of all archive members and indexes; each record that an index names is then
one range of the package, unpacked on its own. Nothing is extracted to disk. The
length and SHA-1 of each response's payload are computed and compared with its
headers. A revisit holds no payload; ``round_trip`` compares its length and digest
with those of the response that it names.

Packages have unique names and count only if listed in the returned manifest, so
a task that runs twice leaves a file that nobody reads. Files are opened with
``pyarrow.fs``, for any store it knows.

Null payloads are empty; a null page_id is written without one and is a response
where no page with its payload has a page_id; equal rows are all written, and rows
that repeat the smallest page_id with its payload are all responses. Very
long payloads are one record each, which a task holds in memory once. Revisit
records keep the length and digest of the full payload. An empty table gives no
package and no records. Columns besides page_id, url and html are ignored, so
names cannot clash.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import struct
import urllib.parse
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from headway.llm.base import shared_dir, small, written

PACKAGE_BYTES, MAX_TASKS = 64 << 20, 10_000
ARCHIVE, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
DATE, CDX_TIME = "2000-01-01T00:00:00Z", "20000101000000"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def planned(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, url, payload, sha1 (hex) and refers_to of every row: the page that holds an equal payload."""
    rows = pages.select("page_id", "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload")).withColumn("sha1", F.sha1("payload"))
    slim = rows.filter(F.octet_length("payload") >= min_bytes).select("page_id", F.unhex("sha1").alias("_sha1"))
    firsts = slim.groupBy("_sha1").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("_n")).filter("_n > 1 and refers_to is not null").drop("_n")
    copies = slim.join(firsts, "_sha1").filter(~F.col("page_id").eqNullSafe(F.col("refers_to"))).select(F.col("page_id").alias("_id"), "_sha1", "refers_to")
    copies = written(copies.distinct())
    return rows.join(small(copies), rows["page_id"].eqNullSafe(copies["_id"]) & (F.unhex("sha1") == copies["_sha1"]), "left").drop("_id", "_sha1")


def surt(url: str | None) -> str:
    """A key that sorts a host's pages together: its labels from the right, then the rest of the URL."""
    _, found, rest = (url or "").partition("://")
    host, slash, path = rest.partition("/")
    return urllib.parse.quote(f"{','.join(reversed(host.lower().split('.')))}){slash}{path}" if found else url or "", safe=",)/?=&")


def base32(sha1: str) -> str:
    return base64.b32encode(binascii.unhexlify(sha1)).decode()


def record(page_id: int | None, url: str | None, payload: bytes, sha1: str, refers_to: int | None) -> bytes:
    name = lambda n: f"<urn:page:{n}>"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {f'<urn:uuid:{uuid.uuid4()}>' if page_id is None else name(page_id)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {urllib.parse.quote(url or '', safe=''.join(map(chr, range(33, 127))))}",
        f"WARC-Payload-Digest: sha1:{base32(sha1)}",
        *([f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: {name(refers_to)}"] if refers_to is not None else []),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class Package:
    """A ZIP package that is being written: records go to the store as they come, the index is kept until the end."""

    def __init__(self, folder: str):
        self.path = f"{folder}/{uuid.uuid4().hex}.wacz"
        store, path = fs.FileSystem.from_uri(self.path)
        self.out = store.open_output_stream(path)
        self.zip = zipfile.ZipFile(self.out, "w", zipfile.ZIP_STORED)
        self.member = self.zip.open(zipfile.ZipInfo(ARCHIVE), "w", force_zip64=True)
        self.size, self.index = 0, []

    def add(self, url: str | None, sha1: str, raw: bytes) -> None:
        gz = zlib.compressobj(6, zlib.DEFLATED, 31)
        data = gz.compress(raw) + gz.flush()
        self.member.write(data)
        fields = {"url": url or "", "digest": f"sha1:{base32(sha1)}", "filename": ARCHIVE, "offset": self.size, "length": len(data)}
        self.index.append(f"{surt(url)} {CDX_TIME} {json.dumps(fields)}")
        self.size += len(data)

    def close(self) -> tuple[str, int, int]:
        self.member.close()
        self.zip.writestr(INDEX, "\n".join(sorted(self.index)))
        self.zip.close()
        self.out.close()
        return self.path, len(self.index), self.size


def write(pages: DataFrame, folder: str, min_bytes: int = 0, package_bytes: int = PACKAGE_BYTES) -> DataFrame:
    """Writes a record per row and returns the manifest (path, records, bytes), a table of its own."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        package, done = None, []
        for f in frames:
            for page_id, url, payload, sha1, refers_to in f.itertuples(index=False, name=None):
                if package is None:
                    store, path = fs.FileSystem.from_uri(folder)
                    store.create_dir(path)
                    package = Package(folder)
                page_id, refers_to = (None if pd.isna(x) else int(x) for x in (page_id, refers_to))
                package.add(url, sha1, record(page_id, url, bytes(payload), sha1, refers_to))
                if package.size >= package_bytes:
                    done.append(package.close())
                    package = None
        if package is not None:
            done.append(package.close())
        yield pd.DataFrame(done, columns=["path", "records", "bytes"])

    rows = planned(pages, min_bytes).select("page_id", "url", "payload", "sha1", "refers_to")
    return written(rows.mapInPandas(run, "path string, records long, bytes long"))


@dataclass(frozen=True)
class Member:
    """A member of a package: how it is packed, and where its local header and its data are."""

    method: int
    packed: int
    size: int
    header: int


def _ranged(f, start: int, length: int) -> bytes:
    f.seek(start)
    return f.read(length)


def directory(f, size: int) -> dict[str, Member]:
    """The members by name, from the central directory of a package of ``size`` bytes."""
    tail_at = max(0, size - 65_557)
    tail = _ranged(f, tail_at, size - tail_at)
    at = tail.rfind(b"PK\x05\x06")
    if at < 0:
        raise ValueError("no end of central directory: not a ZIP package")
    count, length, start = struct.unpack_from("<HII", tail, at + 10)
    if (count == 0xFFFF or length == 0xFFFFFFFF or start == 0xFFFFFFFF) and at >= 20 and tail[at - 20 : at - 16] == b"PK\x06\x07":
        end64 = _ranged(f, struct.unpack_from("<Q", tail, at - 12)[0], 56)
        if end64[:4] != b"PK\x06\x06":
            raise ValueError("the ZIP64 end of central directory is not where its locator says")
        count, length, start = struct.unpack_from("<QQQ", end64, 32)
    entries, at, found = _ranged(f, start, length), 0, {}
    for _ in range(count):
        if entries[at : at + 4] != b"PK\x01\x02":
            raise ValueError("the central directory is damaged")
        method, packed, full = struct.unpack_from("<H8xII", entries, at + 10)
        n_name, n_extra, n_note = struct.unpack_from("<HHH", entries, at + 28)
        header = struct.unpack_from("<I", entries, at + 42)[0]
        name = entries[at + 46 : at + 46 + n_name].decode("utf-8", "replace")
        extra = entries[at + 46 + n_name : at + 46 + n_name + n_extra]
        values = [full, packed, header]
        while len(extra) >= 4:
            kind, n = struct.unpack_from("<HH", extra)
            if kind == 1:  # holds, in this order, only those that didn't fit
                wide = list(struct.unpack_from(f"<{n // 8}Q", extra, 4))
                values = [wide.pop(0) if v == 0xFFFFFFFF and wide else v for v in values]
            extra = extra[4 + n :]
        found[name] = Member(method, values[1], values[0], values[2])
        at += 46 + n_name + n_extra + n_note
    return found


def data_start(f, member: Member) -> int:
    n_name, n_extra = struct.unpack_from("<HH", _ranged(f, member.header, 30), 26)
    return member.header + 30 + n_name + n_extra


def parse_record(raw: bytes) -> dict:
    """The fields of one record; raises if a response's length or digest does not fit its payload."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    lines = dict(x.lower().split(": ", 1) for x in http.decode().split("\r\n")[1:])
    size, digest = int(lines["content-length"]), fields["WARC-Payload-Digest"].removeprefix("sha1:")
    response = fields["WARC-Type"] == "response"
    if response:
        own = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        if (len(payload), own) != (size, digest):
            raise ValueError(f"{fields['WARC-Record-ID']}: the payload has {len(payload)} bytes and digest {own}, its headers say {size} and {digest}")
    page = lambda key: int(fields[key].split(":")[2][:-1]) if fields.get(key, "").startswith("<urn:page:") else None
    return {
        "page_id": page("WARC-Record-ID"), "url": fields["WARC-Target-URI"], "record_type": fields["WARC-Type"],
        "payload_bytes": size, "payload_digest": digest, "refers_to": page("WARC-Refers-To"), "payload": payload if response else None,
    }


def _listed(f, member: Member) -> list[dict]:
    """The JSON part of each line of an index."""
    raw = _ranged(f, data_start(f, member), member.packed)
    text = (zlib.decompress(raw, -15) if member.method == 8 else raw).decode()
    return [json.loads(line[line.index("{") :]) for line in text.splitlines() if "{" in line]


def records(uri: str) -> Iterator[dict]:
    """Every record that the indexes of a package name, in the order of the archives, each read by its range."""
    store, path = fs.FileSystem.from_uri(uri)
    with store.open_input_file(path) as f:
        members = directory(f, f.size())
        archives = {n: m for n, m in members.items() if n.startswith("archive/") and not n.endswith("/")}
        entries = [e for n in sorted(members) if n.startswith("indexes/") and not n.endswith("/") for e in _listed(f, members[n])]
        names = {n: n for n in archives} | {n.removeprefix("archive/"): n for n in archives}
        if unknown := {e["filename"] for e in entries} - names.keys():
            raise ValueError(f"{uri}: an index names {sorted(unknown)[0]}, which is not in the package")
        starts = {}
        for name, offset, length in sorted({(names[e["filename"]], int(e["offset"]), int(e["length"])) for e in entries}):
            if archives[name].method != 0:
                raise ValueError(f"{uri}: {name} is not stored, so records have no ranges")
            if name not in starts:
                starts[name] = data_start(f, archives[name])
            yield parse_record(zlib.decompress(_ranged(f, starts[name] + offset, length), 31))


def read(manifest: DataFrame, payloads: bool = True) -> DataFrame:
    """The records of all packages, a package a task; without ``payloads`` that column is left out."""
    names = ["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", *(["payload"] if payloads else [])]
    kinds = {"page_id": "long", "payload_bytes": "long", "refers_to": "long", "payload": "binary"}

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made = lambda rows: pd.DataFrame(rows, columns=names).astype({"page_id": "Int64", "refers_to": "Int64"})
        for f in frames:
            for uri in f["path"]:
                rows = []
                for r in records(uri):
                    rows.append([r[n] for n in names])
                    if len(rows) == 256:
                        yield made(rows)
                        rows = []
                yield made(rows)

    # Packages are numbered and dealt out by number, one to a task (and 10,000 tasks at most, a few packages each).
    n = manifest.count()
    numbered = manifest.select("path", F.row_number().over(Window.orderBy("path")).alias("_n"))  # a row per package
    dealt = numbered.repartitionByRange(max(1, min(n, MAX_TASKS)), "_n")
    return dealt.select("path").mapInPandas(run, ", ".join(f"{n} {kinds.get(n, 'string')}" for n in names))


def unfounded(found: DataFrame) -> DataFrame:
    """Revisits among records that name no response of their digest and length."""
    lead = found.filter("record_type = 'response'").select(F.col("page_id").alias("refers_to"), "payload_digest", "payload_bytes").distinct()
    return found.filter("record_type = 'revisit'").join(lead, ["refers_to", "payload_digest", "payload_bytes"], "left_anti")


def round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Writes the pages to packages in the shared folder and returns what their records say; raises if a revisit fits no response."""
    manifest = write(pages, shared_dir(pages.sparkSession), min_bytes)
    found = written(read(manifest, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"))
    wrong = unfounded(found).first()
    if wrong is not None:
        raise ValueError(f"the revisit of page {wrong['page_id']} names page {wrong['refers_to']}, which has no response of its payload")
    return found
