"""Schedule feeds: a folder or a zip of comma-separated tables, as lazy DataFrames.

Headers may be in any order, case and padding, lack columns or have unknown
ones. A table is a file, or a folder of parts that all have the same header. A
zip's members are unpacked once, into compressed parts in a folder that all executors
share (``spark.checkpoint.dir``; :mod:`archives`). Files are read in splits, so a large
table has as many tasks as its size asks for, also one whose fields hold line feeds
(:mod:`records`; whether they do is asked once, by a scan of the lines with quotes).
"""

from __future__ import annotations

import csv
import io
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from headway.sources import archives, records, schema
from headway.sources.tables import shared

Transform = Callable[[DataFrame], DataFrame]


class FeedError(ValueError):
    """The location holds no feed, or a table that was asked for is not in it."""


def _path(spark: SparkSession, name: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def _unzipped(spark: SparkSession, location: str, encoding: str) -> str:
    """A shared folder with the parts of the zip's tables."""
    names: dict[str, str] = {}
    for name in archives.members(spark, location):
        table = name.rsplit("/", 1)[-1].removesuffix(".txt")
        if name.endswith(".txt") and table in schema.COLUMNS:
            if table in names:
                raise FeedError(f"{location} has {table}.txt twice: {names[table]} and {name}")
            names[table] = name
    folder = shared(spark, "feed")
    archives.unpacked(spark, location, names, folder, splittable=not encoding.upper().startswith(("UTF-16", "UTF-32")), compressed=True)
    return folder


def normal(header: Iterable[str]) -> list[str]:
    """Header names without byte order mark and padding, in lower case."""
    return [h.removeprefix("﻿").strip().lower() for h in header]


class Feed:
    """The tables at a location. ``register`` adds a transformation that ``table`` then applies.

    ``line_feeds=False`` says that no field holds a line feed; by default each table is looked through for them once.
    """

    def __init__(self, spark: SparkSession, location: str, encoding: str = "UTF-8", line_feeds: bool | None = None):
        self.spark, self.location, self.encoding, self.line_feeds = spark, location, encoding, line_feeds
        path, store = _path(spark, location)
        if not store.exists(path):
            raise FeedError(f"no feed at {location}")
        if store.getFileStatus(path).isDirectory():
            self.folder = location.rstrip("/")
        elif location.lower().endswith(".zip"):
            self.folder = _unzipped(spark, location, encoding)
        else:
            raise FeedError(f"{location} is neither a folder nor a zip")
        self._transforms: dict[str, list[Transform]] = {}
        self._parts = archives.manifest(spark, self.folder)
        self._maps: dict[str, list] = {}

    def has(self, name: str) -> bool:
        if self._parts:
            return name in self._parts
        path, store = _path(self.spark, f"{self.folder}/{name}.txt")
        return store.exists(path)

    def place(self, name: str) -> str | list[str]:
        """The file or folder of a table, or its parts."""
        return self._parts.get(name) or f"{self.folder}/{name}.txt"

    def header(self, name: str) -> list[str]:
        """The header fields as written."""
        if not self.has(name):
            raise FeedError(f"{self.location} has no {name}.txt")
        place = self.place(name)
        path, store = _path(self.spark, place if isinstance(place, str) else place[0])
        if store.getFileStatus(path).isDirectory():
            parts = sorted(str(f.getPath()) for f in store.listStatus(path) if not f.getPath().getName().startswith(("_", ".")))
            if not parts:
                return []
            path, store = _path(self.spark, parts[0])
        codec = self.spark._jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(self.spark._jsc.hadoopConfiguration()).getCodec(path)
        stream = store.open(path) if codec is None else codec.createInputStream(store.open(path))
        reader = self.spark._jvm.java.io.BufferedReader(self.spark._jvm.java.io.InputStreamReader(stream, self.encoding))
        try:
            line = reader.readLine() or ""
        finally:
            reader.close()
        return next(csv.reader(io.StringIO(line.removeprefix("﻿"))), [])

    def unknown_columns(self, name: str) -> list[str]:
        """Columns of the file that the table doesn't have; they are ignored."""
        return [c for c in normal(self.header(name)) if c and c not in schema.COLUMNS[name]]

    def register(self, name: str, transform: Transform) -> None:
        if name not in schema.COLUMNS:
            raise FeedError(f"no table is named {name}")
        self._transforms.setdefault(name, []).append(transform)

    def multiline(self, name: str) -> bool:
        """Whether a field of the table holds a line feed. Asked once per table."""
        if self.line_feeds is False:
            return False
        if name not in self._maps:
            found = self.spark, self.place(name), self.encoding
            self._maps[name] = records.split_maps(*found).collect() if records.any_open(*found) else []  # a row per split with quotes
        return any(m["opens"] for m in self._maps[name])

    def counted(self, name: str, columns: str = "all", exclude: tuple[str, ...] = ()) -> tuple[DataFrame, Observation]:
        """As :meth:`table`, and what counts its rows as they are read: ``.get["rows"]`` after the first action."""
        seen = Observation(f"rows of {name}")
        return self.table(name, columns, exclude).observe(seen, F.count(F.lit(1)).alias("rows")), seen

    def table(self, name: str, columns: str = "all", exclude: tuple[str, ...] = ()) -> DataFrame:
        """One table; columns that its file lacks are null, the first of equal names counts."""
        if name not in schema.COLUMNS:
            raise FeedError(f"no table is named {name}")
        header = normal(self.header(name))
        raw = StructType([StructField(f"c{i}", StringType()) for i in range(len(header))])
        if self.multiline(name):
            rows = records.parsed(records.records(self.spark, self.place(name), self._maps[name], self.encoding), raw)
        else:
            rows = self.spark.read.csv(self.place(name), schema=raw, header=True, quote='"', escape='"', mode="FAILFAST", encoding=self.encoding, enforceSchema=True)
        place = {c: i for i, c in reversed(list(enumerate(header)))}
        # An empty field is an empty string in the format; nulls are left to columns that are not there.
        fields = [
            (F.coalesce(F.col(f"c{place[c]}"), F.lit("")) if c in place else F.lit(None).cast("string")).alias(c)
            for c in schema.kept_columns(name, columns, exclude)
        ]
        out = rows.select(*fields)
        for transform in self._transforms.get(name, []):
            out = transform(out)
        return out

    def tables(self, columns: str = "all") -> dict[str, DataFrame]:
        """All tables that the feed has."""
        return {name: self.table(name, columns) for name in schema.COLUMNS if self.has(name)}

    def views(self, columns: str = "all") -> None:
        """Registers every table of the feed as a temporary view of its name."""
        for name, df in self.tables(columns).items():
            df.createOrReplaceTempView(name)

    def validate(self) -> DataFrame:
        """A row per table: file, rule, other, present, status (ok, missing or absent) and unknown columns."""
        there = {name for name in schema.COLUMNS if self.has(name)}
        rows = []
        for name, rule in schema.PRESENCE.items():
            status = "ok" if name in there else "missing" if rule.required(there) else "absent"
            unknown = ", ".join(self.unknown_columns(name)) if name in there else ""
            rows.append((f"{name}.txt", rule.kind, rule.other, name in there, status, unknown))
        return self.spark.createDataFrame(rows, "file string, rule string, other string, present boolean, status string, unknown_columns string")


def presence_findings(present: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Of a table with the files (column ``file``, names without suffix) that a feed has: (file, status) of every table of the format.

    With ``by`` the table holds many feeds, told apart by these columns; each is judged by its own files. Null files are none.
    """
    spark = present.sparkSession
    rules = spark.createDataFrame([(n, p.kind, p.other) for n, p in schema.PRESENCE.items()], "file string, kind string, other string")
    here = present.groupBy(*by).agg(F.collect_set("file").alias("_files"))  # a few names at most
    each = here.join(F.broadcast(rules)) if by else rules.join(F.broadcast(here))  # a row per table of the format
    on, other = F.array_contains("_files", F.col("file")), F.array_contains("_files", F.coalesce("other", F.lit("")))
    needed = (F.col("kind") == "required") | ((F.col("kind") == "present") & other) | ((F.col("kind") == "absent") & ~other)
    return each.select(*by, "file", F.when(on, "ok").when(needed, "missing").otherwise("absent").alias("status"))


def described(df: DataFrame, kind: str) -> DataFrame:
    """Each row as one line: ``KIND: column value, ...``, with n/a for nulls."""
    parts = [F.concat(F.lit(f"{c} "), F.coalesce(F.col(c).cast("string"), F.lit("n/a"))) for c in df.columns]
    return df.select(F.concat(F.lit(f"{kind.upper()}: "), F.concat_ws(", ", *parts)).alias("line"))
