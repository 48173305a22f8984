"""Records of comma-separated tables whose fields may hold line feeds, read in splits.

Whether a line feed ends a record depends on all quotes before it. Seen from a
line, there are two cases only, outside or inside a quoted field, and a line takes
each to one of the two. So a split takes each to one of the two as well, and

1. a first pass over the lines with quotes gives that map for each split;
2. the maps of a file's splits, chained from its start, give the state in which
   each split begins (a row per split, so a small table);
3. a second pass cuts each split at true record ends. What a border cuts is put
   together by file and number, at most two pieces a split.

Records are then parsed one by one by Spark's own parser. A quote opens a field
only where the field begins; elsewhere it is a letter. Doubled quotes are one.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def inside_after(line: str, inside: bool) -> bool:
    """Whether a quoted field is open at the end of a line that begins ``inside`` one or at a field's beginning."""
    at = 0
    while True:
        if not inside:
            if not line.startswith('"', at):
                at = line.find(",", at) + 1
                if not at:
                    return False
                continue
            at += 1
        end = line.find('"', at)
        if end < 0:
            return True
        inside, at = line.startswith('"', end + 1), end + 2 if line.startswith('"', end + 1) else end + 1
        if not inside:
            at = line.find(",", at) + 1
            if not at:
                return False


def _lines(spark: SparkSession, path: str | list[str], encoding: str) -> DataFrame:
    """(value, file, block): the lines in their order; block is where their split begins."""
    text = spark.read.option("encoding", encoding).option("lineSep", "\n").text(path)
    return text.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))


def _by_split(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], Iterator[str]]]:
    """((file, block), lines) of each run of rows of one split in a batch."""
    for batch in batches:
        values, files, blocks = (c.to_pylist() for c in batch.columns)
        start = 0
        for i in range(1, len(values) + 1):
            if i == len(values) or (files[i], blocks[i]) != (files[start], blocks[start]):
                yield (files[start], blocks[start]), values[start:i]
                start = i


def split_maps(spark: SparkSession, path: str | list[str], encoding: str = "UTF-8") -> DataFrame:
    """(file, block, outside, inside, opens): the state behind a split that begins outside and inside a quoted field; whether a line from outside leaves one open.

    Splits without quotes, which change nothing, are absent.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maps: dict[tuple[str, int], list[bool]] = {}
        for key, lines in _by_split(batches):
            state = maps.setdefault(key, [False, True, False])
            for line in lines:
                after = inside_after(line, False), inside_after(line, True)
                state[:2] = after[state[0]], after[state[1]]
                state[2] |= after[0]
        rows = [(*key, *state) for key, state in maps.items()]
        columns = zip(*rows, strict=True) if rows else [[]] * 5
        kinds = [pa.string(), pa.int64(), pa.bool_(), pa.bool_(), pa.bool_()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["file", "block", "outside", "inside", "opens"])

    quoted = _lines(spark, path, encoding).filter(F.contains("value", F.lit('"')))
    return quoted.mapInArrow(run, "file string, block long, outside boolean, inside boolean, opens boolean")


def any_open(spark: SparkSession, path: str | list[str], encoding: str = "UTF-8") -> bool:
    """Whether some line may leave a quoted field open, seen from outside. No line does whose quotes are doubled ones and those around whole fields.

    Where none may, no field holds a line feed and nothing needs :func:`split_maps`.
    """
    plain = F.regexp_replace(F.replace("value", F.lit('""'), F.lit("")), r'(^|,)"[^"]*"(?=,|\r?$)', "")
    return not _lines(spark, path, encoding).filter(F.contains(plain, F.lit('"'))).select("block").isEmpty()


def _begins(maps: list) -> dict[str, tuple[list[int], list[bool]]]:
    """Of each file: the splits that have quotes in order, and the state behind each."""
    found: dict[str, tuple[list[int], list[bool]]] = {}
    state: dict[str, bool] = {}
    for r in sorted(maps, key=lambda r: (r["file"], r["block"])):
        after = r["inside"] if state.get(r["file"], False) else r["outside"]
        state[r["file"]] = after
        blocks, states = found.setdefault(r["file"], ([], []))
        blocks.append(r["block"])
        states.append(after)
    return found


def records(spark: SparkSession, path: str | list[str], maps: list, encoding: str = "UTF-8") -> DataFrame:
    """(record) of every record but the first of each file, its header; ``maps`` are the rows of :func:`split_maps` (one a split with quotes)."""
    begins = spark.sparkContext.broadcast(_begins(maps))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # What is open: (split, pieces, whether its beginning lies in an earlier split).
        current, pieces, inside, headless, header = None, [], False, False, False

        def cut(key: tuple[str, int], kind: str) -> tuple:
            return "\n".join(pieces), *key, kind

        for batch in batches:
            out = []
            for key, lines in _by_split([batch]):
                if key != current:
                    if current and (pieces or headless):
                        out.append(cut(current, "middle" if headless else "begin"))
                    blocks, states = begins.value.get(key[0], ([], []))
                    before = bisect.bisect_left(blocks, key[1])
                    inside = states[before - 1] if before else False
                    current, pieces, headless, header = key, [], inside, key[1] == 0
                for line in lines:
                    pieces.append(line)
                    if '"' in line:
                        inside = inside_after(line, inside)
                    if inside:
                        continue
                    pieces[-1] = line.removesuffix("\r")
                    if headless:
                        out.append(cut(key, "end"))
                    elif header:
                        header = False
                    elif len(pieces) > 1 or pieces[0].strip():
                        out.append((pieces[0] if len(pieces) == 1 else "\n".join(pieces), None, None, None))
                    pieces, headless = [], False
            if out:
                yield _record_batch(out)
        if current and (pieces or headless):
            yield _record_batch([cut(current, "middle" if headless else "begin")])

    whole = _lines(spark, path, encoding).mapInArrow(run, "record string, file string, block long, kind string")
    # At most an end (or a middle) and a beginning of each split.
    parts = whole.filter("kind is not null").groupBy("file").agg(F.array_sort(F.collect_list(F.struct("block", F.when(F.col("kind") == "begin", 1).otherwise(0).alias("late"), "record"))).alias("_p"))
    groups = F.aggregate(
        "_p", F.array().cast("array<array<string>>"),
        lambda a, p: F.when(p["late"] == 1, F.array_append(a, F.array(p["record"]))).otherwise(
            F.concat(F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0))), F.array(F.array_append(F.coalesce(F.try_element_at(a, F.lit(-1)), F.array().cast("array<string>")), p["record"])))
        ),
    )
    joined = parts.select(F.explode(F.transform(groups, lambda g: F.array_join(g, "\n"))).alias("record"))
    return whole.filter("kind is null").select("record").unionByName(joined)


def _record_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.string(), pa.int64(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["record", "file", "block", "kind"])


def parsed(found: DataFrame, raw: StructType) -> DataFrame:
    """The fields of each record; a record with too few or too many fails."""
    options = {"quote": '"', "escape": '"', "mode": "FAILFAST", "multiLine": "true"}
    row = F.from_csv("record", ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in raw), options)
    return found.select(row.alias("_r")).select("_r.*")
