"""Feeds as zips: members unpacked into parts by tasks, and folders packed into a zip.

Only reading a member from its start unpacks it, so a member is one task's
stream; but what comes out is written in parts of about ``PART_BYTES``, each with
the header and cut at record ends, and everything after that is parallel. An
attempt writes below a name of its own, and its parts count only once it reports
them: the driver puts what the finished tasks report into ``MANIFEST``, which is
what a reader goes by. So parts of an attempt that was lost or repeated are never read.
"""

from __future__ import annotations

import gzip
import io
import json
import uuid
import zipfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

from headway.sources.records import inside_after

MANIFEST = "_tables.json"
PART_BYTES, CHUNK = 128_000_000, 1 << 20


def qualified(spark: SparkSession, location: str) -> str:
    path = spark._jvm.org.apache.hadoop.fs.Path(location)
    uri = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toUri().toString()
    return "file://" + uri.removeprefix("file:") if uri.startswith("file:/") and not uri.startswith("file://") else uri


def _opened(uri: str):
    from pyarrow import fs

    store, name = fs.FileSystem.from_uri(uri)
    return store.open_input_file(name)


def members(spark: SparkSession, location: str) -> list[str]:
    with _opened(qualified(spark, location)) as f, zipfile.ZipFile(f) as z:
        return z.namelist()


def _by_parity(block: bytes) -> tuple[int, bool] | None:
    """As :func:`_record_end` for a block that begins a record, None if a quote opens a field elsewhere than at its beginning.

    Where none does, the number of quotes before a line feed says whether it is in a field; a doubled quote is two.
    """
    raw = np.frombuffer(block, np.uint8)
    quotes = np.flatnonzero(raw == ord('"'))
    opening = quotes[::2]
    if not np.isin(raw[opening[opening > 0] - 1], np.frombuffer(b',\n"', np.uint8)).all():
        return None
    feeds = np.flatnonzero(raw == ord("\n"))
    outside = feeds[np.searchsorted(quotes, feeds) % 2 == 0]
    return int(outside[-1]) + 1 if len(outside) else 0, len(quotes) % 2 == 1


def _record_end(block: bytes, inside: bool) -> tuple[int, bool]:
    """Where the last record of a block of whole lines ends (0 if none does), and the state behind the block."""
    if not inside and b'"' not in block:
        return len(block), False
    if not inside and block.endswith(b"\n") and (found := _by_parity(block)):
        return found
    at = end = 0
    for line in block.split(b"\n"):
        at += len(line) + 1
        if b'"' in line:
            inside = inside_after(line.decode("latin-1"), inside)
        if not inside:
            end = min(at, len(block))
    return end, inside


def blocks(member: io.BufferedIOBase, chunk: int = CHUNK) -> Iterator[tuple[bytes, int]]:
    """A stream in blocks of whole lines, each with the end of its last record."""
    rest, inside = b"", False
    while data := member.read(chunk):
        data = rest + data
        cut = data.rfind(b"\n") + 1
        rest = data[cut:]
        if cut:
            end, inside = _record_end(data[:cut], inside)
            yield data[:cut], end
    if rest:
        yield rest, len(rest)


def unpacked(spark: SparkSession, location: str, names: dict[str, str], folder: str, part_bytes: int = PART_BYTES, chunk: int = CHUNK, splittable: bool = True, compressed: bool = False) -> dict[str, list[str]]:
    """Unpacks members (table to name) of a zip into ``folder``; returns the parts of each table, as ``MANIFEST`` holds them.

    Without ``splittable`` (encodings in which a line feed is not one byte) a member is one part. ``compressed`` parts
    are gzip files of ``part_bytes`` of text, each a split, so a feed takes about as much disk as its zip.
    """
    uri, suffix = qualified(spark, location), "txt.gz" if compressed else "txt"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            done = []
            for table, name in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = f"{table}-{uuid.uuid4().hex}"
                store.create_dir(f"{root}/{own}")
                parts, out, size, header = [], None, 0, b""

                def opened(own=own, parts=parts):
                    parts.append(f"{folder}/{own}/part-{len(parts):05d}.{suffix}")
                    raw = store.open_output_stream(f"{root}/{own}/part-{len(parts) - 1:05d}.{suffix}", compression=None)
                    return _Gzip(raw) if compressed else raw

                with _opened(uri) as f, zipfile.ZipFile(f) as z, z.open(name) as member:
                    for block, end in blocks(member, chunk):
                        if out is None:
                            header, out = block[: block.find(b"\n") + 1], opened()
                        if splittable and end and size + end > part_bytes:
                            out.write(block[:end])
                            out.close()
                            out, size, block = opened(), 0, block[end:]
                            out.write(header)
                        out.write(block)
                        size += len(block)
                if out is None:
                    out = opened()
                out.close()
                done.append((table, parts))
            columns = zip(*done, strict=True) if done else [[], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, [pa.string(), pa.list_(pa.string())], strict=True)], ["table", "parts"])

    if not names:
        return {}
    rows = spark.createDataFrame(sorted(names.items()), "table string, name string")  # a row per table of the format
    found = {r["table"]: r["parts"] for r in rows.repartition(len(names), "table").mapInArrow(run, "table string, parts array<string>").collect()}
    _write(spark, f"{folder}/{MANIFEST}", json.dumps(found))
    return found


def _write(spark: SparkSession, location: str, text: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(location)
    out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def manifest(spark: SparkSession, folder: str) -> dict[str, list[str]]:
    """The parts of each table that was unpacked into a folder; empty for a folder that is a feed by itself."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{MANIFEST}")
    store = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not store.exists(path):
        return {}
    stream = store.open(path)
    try:
        return json.loads(bytes(stream.readAllBytes()).decode())
    finally:
        stream.close()


def packed(spark: SparkSession, folder: str, location: str) -> str:
    """Packs the tables of a feed's folder (files, or folders of parts with equal headers) into one zip. A zip is one stream, so this is one task."""
    source, target = qualified(spark, folder), qualified(spark, location)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(source)
        out_store, out_name = fs.FileSystem.from_uri(target)
        for batch in batches:
            draft = f"{out_name}.{uuid.uuid4().hex}"
            with out_store.open_output_stream(draft) as raw, zipfile.ZipFile(_Stream(raw), "w", zipfile.ZIP_DEFLATED) as z:
                for info in sorted(store.get_file_info(fs.FileSelector(root)), key=lambda i: i.path):
                    if not info.base_name.endswith(".txt"):
                        continue
                    inner = [info] if info.type == fs.FileType.File else sorted((i for i in store.get_file_info(fs.FileSelector(info.path)) if not i.base_name.startswith(("_", "."))), key=lambda i: i.path)
                    with z.open(info.base_name, "w", force_zip64=True) as member:
                        for nth, part in enumerate(inner):
                            with store.open_input_stream(part.path) as data:
                                if nth:
                                    _skip_line(data)
                                while chunk := data.read(CHUNK):
                                    member.write(chunk)
            out_store.move(draft, out_name)
            yield batch

    spark.range(1).mapInArrow(run, "id long").count()
    return location


def _skip_line(data) -> None:
    """Reads the header of a part and nothing after it."""
    while data.read(1) not in (b"", b"\n"):
        pass


class _Gzip(gzip.GzipFile):
    """A compressed stream that closes the one below it too."""

    def __init__(self, raw):
        super().__init__(fileobj=raw, mode="wb", compresslevel=1)
        self.raw_stream = raw

    def close(self) -> None:
        super().close()
        if not self.raw_stream.closed:
            self.raw_stream.close()


class _Stream(io.RawIOBase):
    """An output stream that only goes forward, as a zip's writer takes it."""

    def __init__(self, raw):
        self.raw_stream, self.at = raw, 0

    def writable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return False

    def tell(self) -> int:
        raise OSError("only forward")

    def write(self, data) -> int:
        self.raw_stream.write(data)
        return len(data)

    def flush(self) -> None:
        self.raw_stream.flush() if not self.raw_stream.closed else None
