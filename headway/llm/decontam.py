"""Benchmark decontamination by SimHash windows of item size.

Words are bare of marks at their ends and lower-cased. For an item of L words,
windows of L words slide over a text one word at a time (a shorter text is one
window). A window's fingerprint has 64 bits: the sign of the sum of its words'
hash bits. It is compared with those of all items of its length to which a
shingle of the text points: each item is pointed to by its rarest shingles, as
many as any similar window must hold one of, so a phrase that many items have (a
template of questions) points to none of them. Candidates within the radius are then compared exactly:
five-word shingles with their numbers of occurrences as weights, sum of minima
over sum of maxima, ``SIMILARITY`` or more.

Only windows that hold such a shingle can be similar enough, so fingerprints are
made for those alone, and only for lengths of items to which it points. The radius of a length follows from the most words that may differ at
similarity 0.8, those cut at the edges: where they are distinct, the odds of a
fingerprint beyond it are at most ``ODDS`` (see ``radius``). At 20 bits and more
no block of a fingerprint is selective, so there are none.

Scale: items are taken in blocks of at most about ``BLOCK_WORDS`` words, each
broadcast in turn, so the benchmark may be of any size; a block costs a pass
over the texts, in place and without a shuffle. A passage that many documents
share is found in each of them on its own.

Null and empty texts match nothing, nor do items without words. Very long texts
are searched whole, in slices of windows. Items with fewer words than a shingle
match where they occur word by word. Equal items and repeated rows each get their
rows; of windows that are equally similar and near the first counts. An empty
benchmark or table gives no rows. Columns besides doc_id and text are ignored or,
by ``keep_clean``, passed on, so names cannot clash.

What the fingerprints do: shingles narrow the windows and items down first, as
blocks of a 64-bit fingerprint are not selective at these radii (``radius``); the
distance then spares the exact comparison of most pairs (figures in
``tests/llm/test_decontam_cases.py``).
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from headway.llm.base import word_count

N, SIMILARITY = 5, 0.8
ODDS, LEAST_RADIUS = 1e-5, 15
PAIRS = 2_000_000
BLOCK_WORDS = 250_000
MEMO = 1_000_000
#: Words whose hash bits (256 bytes each, and as much for their sums) are held at once.
SLICE_WORDS = 50_000
EDGES = ".,;:!?*&$%#|<>\"'`()[]{}-_/\\…“”‘’«»"
POWERS = np.array([pow(0x9E3779B97F4A7C15, k, 2**64) for k in range(N)], np.uint64)


def bare(word: str) -> str:
    return word.strip(EDGES).lower()


def word_bits(word: str) -> np.ndarray:
    """The 64 hash bits of a word as -1 and 1."""
    bits = np.unpackbits(np.frombuffer(hashlib.blake2b(word.encode(), digest_size=8).digest(), np.uint8))
    return bits.astype(np.int32) * 2 - 1


def fingerprints(bits: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """Of the windows of ``size`` rows at ``starts``."""
    run = np.zeros((len(bits) + 1, 64), np.int32)
    np.cumsum(bits, axis=0, out=run[1:])
    return np.packbits(run[starts + size] - run[starts] > 0, axis=1).view(np.uint64).ravel()


def shingle_counts(words: list[str]) -> Counter:
    k = min(N, len(words))
    return Counter(tuple(words[i : i + k]) for i in range(len(words) - k + 1)) if k else Counter()


def similarity(a: Counter, b: Counter) -> float:
    common = sum((a & b).values())
    return common / (a.total() + b.total() - common) if common else 0.0


def changes(n: int) -> list[tuple[int, int]]:
    """(cut, new): the most words of an item of n that a window with so many new ones may lack at ``SIMILARITY``."""
    shingles, out = max(n - N + 1, 1), []
    for new in range(n + 1):
        # common / (shingles + new) with common = shingles - cut
        cut = math.floor(shingles - SIMILARITY * (shingles + new) + 1e-9)
        if cut < new:
            break
        out.append((cut, new))
    return out


@cache
def radius(n: int) -> int:
    """The distance that a window within ``SIMILARITY`` of an item of n words exceeds with odds of ``ODDS`` at most.

    Sums of hash bits are taken as normal, which puts the chance of a bit to differ a little too high.
    """
    angle = max(math.acos(min(1.0, math.sqrt((n - cut) / n * (n - cut) / (n - cut + new)))) for cut, new in changes(n))
    p = angle / math.pi
    odds = [math.comb(64, d) * p**d * (1 - p) ** (64 - d) for d in range(65)]
    return max(LEAST_RADIUS, next(r for r in range(65) if sum(odds[r + 1 :]) <= ODDS))


def pointers(own: Counter, holders: Counter) -> list[int]:
    """The shingles of an item, the rarest among the items first, one of which every window within ``SIMILARITY`` holds.

    Such a window has ``SIMILARITY`` of the item's shingles in common with it, so it cannot do with the rest alone.
    """
    need, left, found = math.ceil(SIMILARITY * own.total() - 1e-9), own.total(), []
    for h in sorted(own, key=lambda h: (holders[h], h)):
        if left < need:
            break
        found.append(h)
        left -= own[h]
    return found


class Words(dict):
    """Numbers of the benchmark's words by raw token: 0 for others, -1 for tokens of marks only."""

    def __init__(self, vocabulary: dict[str, int]):
        super().__init__()
        self.vocabulary = vocabulary

    def __missing__(self, token: str) -> int:
        if len(self) > MEMO:
            self.clear()
        w = bare(token)
        number = self[token] = self.vocabulary.get(w, 0) if w else -1
        return number


class Items:
    """A block of items, with what finds them in a text."""

    def __init__(self, items: list[tuple[int, str]]):
        split = [(i, [w for w in map(bare, (text or "").split()) if w]) for i, text in items]
        self.items = [(i, words, shingle_counts(words)) for i, words in split if words]
        vocabulary: dict[str, int] = {}
        for _, words, _ in self.items:
            for w in words:
                vocabulary.setdefault(w, len(vocabulary) + 1)
        self.words = Words(vocabulary)
        self.bits: dict[str, np.ndarray] = {}
        by_length, held = defaultdict(list), []
        for at, (_, words, _) in enumerate(self.items):
            by_length[len(words)].append(at)
            held.append(Counter(self._hashes(np.array([vocabulary[w] for w in words], np.uint64), min(N, len(words))).tolist()))
        holders = Counter(h for own in held for h in own)
        #: By shingle length: sorted hashes of the shingles that point to items, and those items.
        anchors: dict[int, dict[int, set[int]]] = defaultdict(lambda: defaultdict(set))
        for at, own in enumerate(held):
            for h in pointers(own, holders):
                anchors[min(N, len(self.items[at][1]))][h].add(at)
        self.anchors = {k: (np.array(sorted(found), np.uint64), found) for k, found in anchors.items()}
        self.index = {n: self._indexed(n, ats) for n, ats in by_length.items()}

    @staticmethod
    def _hashes(ids: np.ndarray, k: int) -> np.ndarray:
        out = np.zeros(len(ids) - k + 1, np.uint64)
        for i in range(k):
            out += ids[i : len(ids) - k + 1 + i] * POWERS[i]
        return out

    def _of(self, words: list[str]) -> np.ndarray:
        if len(self.bits) > MEMO // 4:
            self.bits.clear()
        for w in words:
            if w not in self.bits:
                self.bits[w] = word_bits(w)
        return np.stack([self.bits[w] for w in words])

    def _indexed(self, n: int, ats: list[int]):
        """Items of n words: their places, fingerprints, radius, and where each item's fingerprint lies."""
        prints = np.array([fingerprints(self._of(self.items[at][1]), np.zeros(1, np.int64), n)[0] for at in ats], np.uint64)
        return np.array(ats), prints, radius(n), {at: i for i, at in enumerate(ats)}

    def _candidates(self, n: int, prints: np.ndarray, likely: set[int] | None = None) -> Iterator[tuple[int, int, int]]:
        """(item, window, distance) of all fingerprints within the radius of a (likely) item of n words."""
        ats, own, limit, where = self.index[n]
        if likely is not None:
            rows = np.fromiter(sorted(where[at] for at in likely), np.int64, len(likely))
            ats, own = ats[rows], own[rows]
        step = max(1, PAIRS // max(1, len(prints)))
        for low in range(0, len(own), step):
            distance = np.bitwise_count(own[low : low + step, None] ^ prints[None, :])
            holder, window = np.nonzero(distance <= limit)
            yield from zip(ats[low + holder].tolist(), window.tolist(), distance[holder, window].tolist(), strict=True)

    def hits(self, text: str | None) -> list[tuple[int, int, int, int, float]]:
        """(item_id, first word, words, distance, similarity) of each item's best window in a text."""
        tokens = (text or "").split()
        ids = np.fromiter(map(self.words.__getitem__, tokens), np.int64, len(tokens))
        ids = ids[ids >= 0] if (ids < 0).any() else ids
        known = ids > 0
        places: dict[int, list[tuple[int, int]]] = defaultdict(list)  # item length: (first, last) start of windows
        likely: dict[int, set[int]] = defaultdict(set)  # item length: items to which a shingle of the text points
        for k, (hashes, found) in self.anchors.items():
            if len(ids) < k:
                continue
            run = known[: len(ids) - k + 1].copy()
            for i in range(1, k):
                run &= known[i : len(ids) - k + 1 + i]
            at = np.flatnonzero(run)
            if not len(at):
                continue
            h = np.zeros(len(at), np.uint64)
            for i in range(k):
                h += ids[at + i].astype(np.uint64) * POWERS[i]
            near = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
            same = hashes[near] == h
            seen: dict[int, set[int]] = {}  # shingle: lengths of its items
            for p, x in zip(at[same].tolist(), h[same].tolist(), strict=True):
                if x not in seen:
                    seen[x] = {len(self.items[i][1]) for i in found[x]}
                    for i in found[x]:
                        likely[len(self.items[i][1])].add(i)
                for n in seen[x]:
                    last = max(0, len(ids) - n)
                    places[n].append((min(max(0, p - n + k), last), min(p, last)))
        if not places:
            return []
        words = [w for w in map(bare, tokens) if w]
        best: dict[int, tuple[float, int, int, int]] = {}  # similarity, then the nearest and first window
        for n, spans in places.items():
            size = min(n, len(words))
            # A long run of windows is taken in slices, so memory follows the slice and not the text.
            for low, high in (part for span in _merged(spans) for part in _sliced(*span, max(SLICE_WORDS - size, 1))):
                bits = self._of(words[low : high + size])
                counts: dict[int, Counter] = {}
                for item, window, distance in self._candidates(n, fingerprints(bits, np.arange(high - low + 1), size), likely[n]):
                    start = low + window
                    if start not in counts:
                        counts[start] = shingle_counts(words[start : start + size])
                    s = similarity(self.items[item][2], counts[start])
                    if s >= SIMILARITY:
                        best[item] = max(best.get(item, (0.0, 0, 0, 0)), (s, -distance, -start, size))
        return [(self.items[i][0], -start, size, -distance, s) for i, (s, distance, start, size) in sorted(best.items())]


def _sliced(low: int, high: int, windows: int) -> Iterator[tuple[int, int]]:
    """A run of windows in runs of at most so many."""
    for first in range(low, high + 1, windows):
        yield first, min(high, first + windows - 1)


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for low, high in sorted(spans):
        if out and low <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], high)
        else:
            out.append([low, high])
    return [(a, b) for a, b in out]


def blocks(benchmark: DataFrame, block_words: int = BLOCK_WORDS) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of about ``block_words`` words."""
    total = benchmark.agg(F.sum(word_count(F.col("text")))).first()[0] or 0
    n = max(1, -(-total // block_words))
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
    for k in range(n):
        rows = benchmark.filter("text is not null").filter(block == k).select("item_id", "text").collect()
        if rows:
            yield [(r["item_id"], r["text"]) for r in sorted(rows, key=lambda r: (r["item_id"] is None, r["item_id"], r["text"]))]


HITS = "item_id long, first_word long, n_words long, distance int, similarity double"


def leaks(docs: DataFrame, benchmark: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """A row per document and item that it holds: doc_id and the item's best window."""
    spark, found = docs.sparkSession, None
    for items in blocks(benchmark, block_words):
        sent = spark.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            index = Items(sent.value)
            for batch in batches:
                out = [(d, *hit) for d, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True) for hit in index.hits(text)]
                columns = list(zip(*out, strict=True)) if out else [[]] * 6
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "item_id", "first_word", "n_words", "distance", "similarity"])

        part = docs.select("doc_id", "text").mapInArrow(run, f"doc_id long, {HITS}")
        found = part if found is None else found.unionByName(part)
    return found if found is not None else spark.createDataFrame([], f"doc_id long, {HITS}")


def keep_clean(docs: DataFrame, benchmark: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows of ``docs`` that hold no item, with their columns; filtered in place."""
    for items in blocks(benchmark, block_words):
        sent = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            index = Items(sent.value)
            for batch in batches:
                yield batch.filter(pa.array([not index.hits(t) for t in batch.column("text").to_pylist()], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
