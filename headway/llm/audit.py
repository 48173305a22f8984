"""What filters do to each other: each order of five filters, per source.

A document's failures are a mask, a bit for each filter. Four filters look at
the text alone; the fifth (``DUPLICATE``) fails whatever has the text of a
smaller doc_id, and is found by routing fingerprints:

1. tasks read texts where they lie, and settle copies among the rows at hand: of
   each text only the rows with the least id stay open, all others have failed.
   That is written, so a lost executor costs no second look at the texts;
2. open rows go as an RDD to the partition of their text's xxhash64, sorted by it; there
   the chain of a fingerprint holds each of its texts in full with the least id so
   far, and whatever is not the least is passed on as failed;
3. the narrow rows that come out are joined to the labels, and per source
   ``combineByKey`` merges vectors of counts by mask: all documents, good and
   toxic ones. Every figure of every order is a sum over such a vector.

Scale: a text with a third of all rows is in the shuffle once per ``HELD_BYTES``
of input, so its task reads that many rows one after another; a task holds the
texts of one fingerprint, as the sort spills. Vectors have 96 numbers, merged
before they are shuffled. Everything is recomputed from the input if an executor
is lost, and no result depends on the order of rows.

Null texts are empty, so equal; null sources and the empty one are one part. A
null doc_id is neither smaller nor larger than another: such rows never fail
``DUPLICATE`` nor make others fail, and have no label. Rows that repeat the least
doc_id with its text don't fail. A label holds for a doc_id if any of its rows has
it. Very long texts are counted in slices of words, but compared whole. Empty
tables give no rows. Other columns are ignored, so names cannot clash.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import permutations

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from headway.llm.base import written

LETTERS = "ABCDE"
MIN_WORDS, DISTINCT_PERCENT, UPPER_PERCENT, SYMBOLS = 50, 65, 5, b"#$%&*|"
DUPLICATE = 16
#: Bytes of distinct texts that a task holds to settle copies before the shuffle.
HELD_BYTES = 32_000_000
SLICE_BYTES = 4_000_000
CAPITALS = bytes(range(65, 91))
GAP = re.compile(rb"[\x20\x09-\x0D]")
COUNTS = "kept removed redundant unique_fails good_lost toxic_lost shapley".split()
MASKS = 1 << len(LETTERS)

Chain = list  # [text, least doc_id, mask, {source: rows}]


def own_failures(text: str) -> int:
    """The mask of the filters that look at the text alone."""
    raw, words, distinct, start = text.encode(), 0, set(), 0
    while start < len(raw):
        gap = GAP.search(raw, start + SLICE_BYTES)
        end = gap.start() if gap else len(raw)
        these = raw[start:end].split()  # at ASCII white space
        words += len(these)
        distinct.update(these)
        start = end
    capitals = len(raw) - len(raw.translate(None, CAPITALS))
    failed = (
        words < MIN_WORDS, 100 * len(distinct) < DISTINCT_PERCENT * words, 100 * capitals > UPPER_PERCENT * len(text),
        len(raw.translate(None, SYMBOLS)) < len(raw),
    )
    return sum(f << k for k, f in enumerate(failed))


def _failed(chain: Chain) -> Iterator[tuple]:
    return ((chain[1], chain[2] | DUPLICATE, source, n) for source, n in chain[3].items())


def _meet(chain: Chain, doc_id, sources: dict[str, int]) -> Iterator[tuple]:
    """Takes rows of the chain's text into it; yields (doc_id, mask, source, rows) of what is not the least."""
    if doc_id > chain[1]:
        yield from ((doc_id, chain[2] | DUPLICATE, source, n) for source, n in sources.items())
        return
    if doc_id < chain[1]:
        yield from _failed(chain)
        chain[1], chain[3] = doc_id, {}
    for source, n in sources.items():
        chain[3][source] = chain[3].get(source, 0) + n


def _fingerprint(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode()) - (1 << 63)


def _settled(row: tuple) -> tuple:
    """A row that needs no chain, spread by its id."""
    return _fingerprint(str(row[0])), None, *row


def _scan(rows: Iterable) -> Iterator[tuple]:
    """(fingerprint, text, doc_id, mask, source, rows) of (doc_id, text, source); the text of settled rows is null, their fingerprint means nothing."""
    held: dict[str, Chain] = {}
    bare: Counter = Counter()
    size = 0

    def opened() -> Iterator[tuple]:
        for text, chain in held.items():
            for source, n in chain[3].items():
                yield _fingerprint(text), text, chain[1], chain[2], source, n
        held.clear()

    for doc_id, text, source in rows:
        chain = held.get(text)
        if doc_id is None:
            bare[chain[2] if chain else own_failures(text), source] += 1
        elif chain:
            yield from map(_settled, _meet(chain, doc_id, {source: 1}))
        else:
            held[text] = [None, doc_id, own_failures(text), {source: 1}]
            size += len(text)
            if size > HELD_BYTES:
                yield from opened()
                size = 0
    yield from opened()
    for (mask, source), n in bare.items():
        yield _settled((None, mask, source, n))


def _chained(rows: Iterable[tuple[int, tuple]]) -> Iterator[tuple]:
    """(doc_id, mask, source, rows) of rows sorted by fingerprint."""
    chains: list[Chain] = []
    last = None
    heads = lambda: ((c[1], c[2], *x) for c in chains for x in c[3].items())
    for fingerprint, (text, doc_id, mask, source, n) in rows:
        if text is None:
            yield doc_id, mask, source, n
            continue
        if fingerprint != last:
            yield from heads()
            chains, last = [], fingerprint
        chain = next((c for c in chains if c[0] == text), None)
        if chain:
            yield from _meet(chain, doc_id, {source: n})
        else:
            chains.append([text, doc_id, mask, {source: n}])
    yield from heads()


#: Rows that a task hands over at once; fewer where texts are long.
BATCH_ROWS, BATCH_CHARS = 2000, 4_000_000


def _scanned(docs: DataFrame) -> DataFrame:
    """What :func:`_scan` makes of each task's rows."""
    from pyspark.sql.pandas.types import to_arrow_type

    kind = docs.schema["doc_id"].dataType
    names = "fingerprint text doc_id mask source rows".split()
    types = [pa.int64(), pa.string(), to_arrow_type(kind), pa.int32(), pa.string(), pa.int64()]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, chars = [], 0
        for row in _scan(r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True)):
            rows.append(row)
            chars += len(row[1] or "")
            if len(rows) >= BATCH_ROWS or chars > BATCH_CHARS:
                yield batch(rows)
                rows, chars = [], 0
        if rows:
            yield batch(rows)

    whole = docs.select("doc_id", F.coalesce("text", F.lit("")), F.coalesce(F.col("source").cast("string"), F.lit("")))
    return whole.mapInArrow(run, f"fingerprint long, text string, doc_id {kind.simpleString()}, mask int, source string, rows long")


def masks(docs: DataFrame) -> DataFrame:
    """(doc_id, mask, part, rows): which filters each document fails; rows with one doc_id, mask and part are counted in one."""
    spark, kind = docs.sparkSession, docs.schema["doc_id"].dataType.simpleString()
    rows = written(_scanned(docs)).rdd
    parts = max(rows.getNumPartitions(), int(spark.conf.get("spark.sql.shuffle.partitions")))
    keyed = rows.map(lambda r: (r[0], tuple(r[1:])))
    routed = keyed.repartitionAndSortWithinPartitions(parts, lambda fingerprint: fingerprint).mapPartitions(_chained)
    found = spark.createDataFrame(routed, f"doc_id {kind}, mask int, part string, rows long", verifySchema=False)
    return written(found.groupBy("doc_id", "mask", "part").agg(F.sum("rows").alias("rows")))


def _counted(vector: list[int], row: tuple) -> list[int]:
    """``vector`` holds the rows by mask, then the good ones, then the toxic ones."""
    mask, rows, good, toxic = row
    vector[mask] += rows
    vector[MASKS + mask] += rows * good
    vector[2 * MASKS + mask] += rows * toxic
    return vector


def _merged(a: list[int], b: list[int]) -> list[int]:
    return [x + y for x, y in zip(a, b, strict=True)]


def _report(part: str, vector: list[int]) -> Iterator[tuple]:
    """A row per order and step."""
    every, good, toxic = (vector[k * MASKS : (k + 1) * MASKS] for k in range(3))
    found, shapley = [], Counter()
    for order in permutations(LETTERS):
        gone = 0
        for step, letter in enumerate(order, 1):
            bit = 1 << LETTERS.index(letter)
            here = [m for m in range(MASKS) if m & bit and not m & gone]
            removed = sum(every[m] for m in here)
            redundant = sum(every[m] for m in range(MASKS) if m & bit and m & gone)
            gone |= bit
            shapley[letter] += removed
            found.append((
                part, "".join(order), step, sum(every[m] for m in range(MASKS) if not m & gone), removed, redundant, every[bit],
                sum(good[m] for m in here), sum(toxic[m] for m in here),
            ))
    return ((*row, shapley[row[1][row[2] - 1]]) for row in found)


def interactions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step and the counts, for each part, order of filters and step."""
    told = labels.filter("quality = 1 or toxic = 1").groupBy("doc_id").agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False)).cast("int")).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False)).cast("int")).alias("toxic")
    )
    rows = masks(docs).join(told, "doc_id", "left").select("part", "mask", "rows", F.coalesce("good", F.lit(0)), F.coalesce("toxic", F.lit(0)))
    vectors = rows.rdd.map(lambda r: (r[0], tuple(r[1:]))).combineByKey(lambda row: _counted([0] * 3 * MASKS, row), _counted, _merged)
    return docs.sparkSession.createDataFrame(
        vectors.flatMap(lambda x: _report(*x)), "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COUNTS), verifySchema=False
    )
