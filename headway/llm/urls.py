"""URL filters: rules by host and path, and a character model for the rest.

A URL that a rule decides is an example. Four in five of them (by a hash of the
URL) train two models, one of allowed and one of blocked URLs; the others set the
threshold. Both models count strings of up to ``ORDER`` bytes of the whole URL,
from scheme to fragment, with a start and an end; the probability of a byte mixes
the orders, each weighted by how often its context was seen against how many
different bytes followed it (Witten-Bell), so the order varies with what is
known. A URL's score is the difference of both log-likelihoods per byte, blocked
less allowed. The threshold is the one at which the share of held-out blocked
URLs above it exceeds that of allowed ones by most.

Scale: what the models know grows with the input and stays a distributed table,
keyed by string. Rows are dealt to blocks of at most ``BLOCK_ROWS`` rows, those of
more than ``LONG`` bytes to blocks of their own. A block asks for each of its
strings once, so a string asks at most once a block however common it is; the
answers meet the block's rows in one task, which needs memory in proportion to a
block's bytes. Copies of a URL are spread over blocks like any rows. Nothing is broadcast. Only the
histogram of held-out scores, a row per step and side, goes to the driver.

Null URLs, and those without ``://``, have an empty host and path and fit no rule;
the model judges their text (none for null). Very long URLs are judged whole.
Repeated rows each get their row; columns besides page_id and url are ignored, so
names cannot clash. Without training examples of both sides every score is 0 and
the method allows all; without held-out ones of both sides the threshold is 0. At
the threshold itself a URL is allowed. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from headway.llm.base import ascii_lower, written

#: Strings of up to so many bytes fit a 64-bit key beside their length.
ORDER = 7
ALPHABET = 256
START, END = b"\x02", b"\x03"
BLOCK_ROWS, LONG = 4_096, 1_024
#: Bytes of URLs that are taken apart together, which bounds the arrays.
SLICE_BYTES = 2_000_000
#: One in so many ruled URLs sets the threshold instead of training; scores are counted in steps of 1 / STEPS for it.
HOLD, STEPS = 5, 200
FACTS = ("n_allow", "n_block", "seen_allow", "seen_block", "kinds_allow", "kinds_block")


@dataclass(frozen=True)
class Rule:
    """``target`` is a host, then a path from its first ``/``; the rule fits the host, its subdomains, and paths that start so."""

    verdict: str
    target: str

    def fits(self, host: Column, path: Column) -> Column:
        name, _, rest = self.target.partition("/")
        return ((host == name) | host.endswith("." + name)) & path.startswith("/" + rest)


RULES = (
    Rule("block", "com/en/"), Rule("allow", "example.com/en/7"), Rule("allow", "net/de/"),
    Rule("block", "example.net/de/8"), Rule("block", "org/es/"),
)


def parse(pages: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """page_id, url, host, path, the longest rule that fits, and that rule's verdict."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    url = F.coalesce("url", F.lit(""))
    host, path = F.col("host"), F.col("path")
    longest = sorted(rules, key=lambda r: -len(r.target))
    pick = lambda value: reduce(lambda c, r: c.when(r.fits(host, path), F.lit(value(r))), longest[1:], F.when(longest[0].fits(host, path), F.lit(value(longest[0]))))
    none = F.lit(None).cast("string")
    parsed = pages.select("page_id", "url", ascii_lower(F.regexp_extract(url, pattern, 1)).alias("host"), F.regexp_extract(url, pattern, 2).alias("path"))
    return parsed.select("*", (pick(lambda r: r.target) if rules else none).alias("rule"), (pick(lambda r: r.verdict) if rules else none).alias("ruled"))


def dealt(parsed: DataFrame) -> DataFrame:
    """``parsed`` as a written table with block and held (whether a ruled URL is kept from training)."""
    at = F.monotonically_increasing_id()
    long = F.coalesce(F.octet_length("url"), F.lit(0)) > LONG
    rows = parsed.withColumn("_at", at).withColumn("block", F.when(long, -1 - F.col("_at")).otherwise(F.floor(F.col("_at") / BLOCK_ROWS).cast("long")))
    return written(rows.drop("_at").withColumn("held", F.pmod(F.crc32(F.col("url").cast("binary")), F.lit(HOLD)) == 0))


class Lines:
    """The bytes of some URLs, one after another between START and END; index by place."""

    def __init__(self, urls: list[str | None]):
        parts = [START + (u or "").encode() + END for u in urls]
        self.sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        self.firsts = np.cumsum(self.sizes) - self.sizes
        self.codes = np.frombuffer(b"".join(parts), np.uint8).astype(np.uint64)
        self.place = np.arange(len(self.codes)) - np.repeat(self.firsts, self.sizes)

    def strings(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """By length k: the places after START where a string of k bytes ends, its key, and the key of its first k - 1 bytes."""
        packed = np.zeros(len(self.codes), np.uint64)
        for k in range(1, ORDER + 1):
            packed[k - 1 :] |= self.codes[: len(self.codes) - k + 1] << np.uint64(8 * (k - 1))
            at = np.flatnonzero(self.place >= max(k - 1, 1))
            own = packed[at]
            yield at, own | np.uint64(k << 56), (own >> np.uint64(8)) | np.uint64((k - 1) << 56)


def _slices(urls: list[str | None]) -> Iterator[tuple[int, int]]:
    """Runs of rows of about ``SLICE_BYTES``."""
    low = size = 0
    for i, u in enumerate(urls):
        size += len(u or "") + 2
        if size >= SLICE_BYTES:
            yield low, i + 1
            low, size = i + 1, 0
    if low < len(urls):
        yield low, len(urls)


def facts(rows: DataFrame) -> DataFrame:
    """key, and FACTS: how often a string was seen by side, how often it was followed, and by how many different bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            urls, sides = batch.column("url").to_pylist(), np.array(batch.column("ruled").to_pylist(), object)
            for low, high in _slices(urls):
                for side in ("allow", "block"):
                    lines = Lines([u for u, s in zip(urls[low:high], sides[low:high], strict=True) if s == side])
                    for _, keys, _ in lines.strings():
                        keys, n = np.unique(keys, return_counts=True)
                        n, none = pa.array(n.astype(np.int64)), pa.array(np.zeros(len(n), np.int64))
                        yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), n if side == "allow" else none, n if side == "block" else none], ["key", "n_allow", "n_block"])

    taught = rows.filter("ruled is not null and not held").select("url", "ruled")
    grams = written(taught.mapInArrow(run, "key long, n_allow long, n_block long").groupBy("key").agg(F.sum("n_allow").alias("n_allow"), F.sum("n_block").alias("n_block")))
    size, low = F.shiftright("key", 56), F.col("key").bitwiseAND(F.lit((1 << 56) - 1))
    context = F.shiftright(low, 8).bitwiseOR(F.shiftleft(size - 1, 56))
    contexts = grams.groupBy(context.alias("key")).agg(
        F.sum("n_allow").alias("seen_allow"), F.sum("n_block").alias("seen_block"), F.count_if(F.col("n_allow") > 0).alias("kinds_allow"), F.count_if(F.col("n_block") > 0).alias("kinds_block")
    )
    both = grams.unionByName(contexts, allowMissingColumns=True)
    return both.groupBy("key").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in FACTS])


def asked(rows: DataFrame) -> DataFrame:
    """(block, key): the strings of each block, each at least once and seldom more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            urls, blocks = batch.column("url").to_pylist(), batch.column("block").to_numpy()
            for block in np.unique(blocks).tolist():
                own = [urls[i] for i in np.flatnonzero(blocks == block)]
                for low, high in _slices(own):
                    for _, keys, contexts in Lines(own[low:high]).strings():
                        wanted = np.unique(np.concatenate([keys, contexts]))
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(wanted), block)), pa.array(wanted.view(np.int64))], ["block", "key"])

    return rows.select("url", "block").mapInArrow(run, "block long, key long")


def answered(rows: DataFrame) -> DataFrame:
    """(block, key, FACTS) of the strings that each block asks for and that are known.

    Both sides are shuffled: the strings' file is a small part of what their facts take in memory (0.25 MB of one were
    25 MB broadcast), so Spark would send tables through the driver that do not fit there.
    """
    return asked(rows).join(facts(rows).hint("merge"), "key").select("block", "key", *FACTS)


def log_likelihoods(lines: Lines, keys: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Mean log probability of the bytes after START of each line, by side (allow, block); ``known`` has FACTS in the rows of ``keys``, sorted."""

    def found(wanted: np.ndarray, columns: slice) -> np.ndarray:
        at = np.minimum(np.searchsorted(keys, wanted), max(len(keys) - 1, 0))
        out = known[at, columns].astype(float) if len(keys) else np.zeros((len(wanted), 2))
        out[(keys[at] != wanted) if len(keys) else slice(None)] = 0
        return out

    p = np.full((len(lines.codes), 2), 1 / ALPHABET)
    for at, own, context in lines.strings():
        n, seen, kinds = found(own, slice(0, 2)), found(context, slice(2, 4)), found(context, slice(4, 6))
        p[at] = np.where(seen > 0, (n + kinds * p[at]) / np.maximum(seen + kinds, 1), p[at])
    p[lines.firsts] = 1.0
    return np.add.reduceat(np.log(p), lines.firsts) / (lines.sizes - 1)[:, None]


def scored(rows: DataFrame) -> DataFrame:
    """A dealt table as a written table with score: over zero where the blocked side likens a URL more; zero if a side has no examples."""
    sides = rows.filter("ruled is not null and not held").select("ruled").distinct().count()
    if sides < 2:
        return rows.withColumn("score", F.lit(0.0))
    names = rows.columns
    answers = answered(rows)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        left, right = left.combine_chunks(), right.combine_chunks()
        keys, first = np.unique(right.column("key").to_numpy(), return_index=True)
        known = np.stack([right.column(c).to_numpy()[first] for c in FACTS], axis=1)
        urls, score = left.column("url").to_pylist(), []
        for low, high in _slices(urls):
            both = log_likelihoods(Lines(urls[low:high]), keys.view(np.uint64), known)
            score.append(both[:, 1] - both[:, 0])
        return left.append_column("score", pa.array(np.concatenate([np.zeros(0), *score]), pa.float64())).select([*names, "score"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return written(rows.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, f"{fields}, score double"))


def threshold(scores: DataFrame) -> float:
    """The step of the score that parts held-out blocked from allowed URLs best; the highest of equals."""
    step = F.floor(F.col("score") * STEPS).cast("long")
    counted = scores.filter("ruled is not null and held").groupBy(step.alias("step"), "ruled").count().collect()  # a row per step and side
    total = {v: sum(r["count"] for r in counted if r["ruled"] == v) for v in ("allow", "block")}
    if not all(total.values()):
        return 0.0
    best, above = (0.0, None), {"allow": 0, "block": 0}
    for s in sorted({r["step"] for r in counted}, reverse=True):
        for r in counted:
            if r["step"] == s:
                above[r["ruled"]] += r["count"]
        gap = above["block"] / total["block"] - above["allow"] / total["allow"]
        if best[1] is None or gap > best[0] + 1e-12:
            best = (gap, s)
    return best[1] / STEPS


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict and score of every row."""
    scores = scored(dealt(parse(pages, rules)))
    limit = threshold(scores)
    verdict = F.coalesce("ruled", F.when(F.col("score") > limit, "block").otherwise("allow"))
    return scores.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score")
