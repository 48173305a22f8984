"""N-gram Jaccard join with adaptive multi-match prefixes, and the components of its links.

A document is the set of its n-word shingles (as 64-bit hashes). All sets share
one order: rare shingles by hash, then frequent ones by count. If two sets meet
the threshold, both overlap with the other in at least a = ceil(t * size)
shingles, so their first size - a + l shingles have l in common, for any l (and
more, as far as the sizes of both ask for a larger overlap than a). A document takes the l for which its estimated cost is least (entries to index,
plus the other holders of its prefix's shingles, who are verified only with l
matches); a pair needs as many shared prefix shingles as the smaller l of both.

1. A pass over the texts counts shingles in chunks; those frequent in a chunk,
   with their sums, are the frequent ones (at most ``MAX_FREQUENT``, which bounds
   the broadcast; the order decides the cost and never the result).
2. A pass writes size, digest and prefix of every text. Equal sets form a class.
3. Prefixes are dealt out by shingle; those that one class alone has are dropped.
   The sets of classes that still have one are written.
4. Rounds of stars: in every shingle's holders, a central one is verified against
   all others outside its component. A group of near copies is joined by as many
   comparisons as it has members, so no round makes pairs of a group's size squared.
5. When few pairs across components are left, or a round leaves nine tenths of
   them, all with enough matches are verified: no link between components is lost.

Texts without words are linked with nothing: size 0, own doc_id. Very long texts
are taken whole; their sets are held one at a time. Equal texts are one class, so
ties and repeated rows share a component; an empty table gives no rows. Columns
besides doc_id and text are ignored or, by ``keep_first``, passed on. Rows with
equal doc_id count as different texts. A null doc_id never names a component; rows
without any other doc_id in their component have a null one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from headway.llm.base import small as _small
from headway.llm.base import released, written
from headway.llm.shingles import each_text, shingles

MAX_FREQUENT, CHUNK, LOCAL = 1_000_000, 2_000_000, 3
#: Costs in entries of the index; a shingle that is not frequent has RARE other holders on average.
MIN_MATCHES, MAX_MATCHES, VERIFY_COST, RARE = 4, 12, 20.0, 0.5


def _need(n: int, percent: int) -> int:
    return -(-percent * n // 100)


def _part(n, percent: int):
    """ceil(percent of n), as a column."""
    return F.floor((n * percent + 99) / 100).cast("int")


def _overlap(n, m, percent: int):
    """The least overlap with which sets of n and m shingles meet the threshold, as a column."""
    return F.floor(((n + m) * percent + 99 + percent) / (100 + percent)).cast("int")


def frequent(docs: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that occur in LOCAL texts of some chunk, sorted, and in how many of those chunks' texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, seen, size = [], set(), 0

        def counted() -> pa.RecordBatch:
            values, counts = np.unique(np.concatenate([np.zeros(0, np.uint64), *sets]), return_counts=True)
            often = counts >= LOCAL
            return pa.RecordBatch.from_arrays([pa.array(values[often].view(np.int64)), pa.array(counts[often].astype(np.int64))], ["shingle", "n"])

        for batch in batches:
            for words in each_text(batch.column("text")):
                own = np.unique(shingles(words, n))
                key = hash(own.tobytes())
                if key in seen:
                    continue
                seen.add(key)
                sets.append(own)
                size += len(own)
                if size >= CHUNK:
                    yield counted()
                    sets, seen, size = [], set(), 0
        yield counted()

    found = docs.select("text").mapInArrow(run, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
    rows = found.orderBy(F.desc("n"), "shingle").limit(MAX_FREQUENT).toPandas()
    values = rows["shingle"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(values)
    return values[order], rows["n"].to_numpy(np.int64)[order]


def _prefix(own: np.ndarray, often: np.ndarray, counts: np.ndarray, percent: int) -> tuple[np.ndarray, int]:
    """The prefix of a sorted set, and the matches it asks for."""
    n = len(own)
    at = np.searchsorted(often, own)
    hit = np.zeros(n, bool)
    inside = at < len(often)
    hit[inside] = often[at[inside]] == own[inside]
    rank = np.where(hit, counts[np.minimum(at, len(often) - 1)], 0) if len(often) else np.zeros(n, np.int64)
    order = np.argsort(rank, kind="stable")
    need = _need(n, percent)
    others = np.cumsum(np.maximum(rank[order] - 1, RARE))
    best, matches = None, 1
    for k in range(min(MIN_MATCHES, need), min(MAX_MATCHES, need) + 1):
        size = n - need + k
        cost = size + others[size - 1] * (1 + VERIFY_COST / k)
        if best is None or cost < best:
            best, matches = cost, k
    return own[order[: n - need + matches]], matches


def row_key():
    """A hash of doc_id and text, so rows with null or equal doc_ids are told apart by their texts."""
    return F.xxhash64("doc_id", "text").alias("key")


def profiles(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """doc_id, key, n_shingles, digest, matches and prefix of every row; of equal sets in a task, the first has the prefix."""
    often = docs.sparkSession.sparkContext.broadcast(frequent(docs, n))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in batches:
            sizes, digests, matches, prefixes = [], [], [], []
            for words in each_text(batch.column("text")):
                own = np.unique(shingles(words, n))
                digest = hashlib.blake2b(own.tobytes(), digest_size=16).digest()
                sizes.append(len(own))
                digests.append(digest)
                new = len(own) and digest not in seen
                if new:
                    seen.add(digest)
                    prefix, k = _prefix(own, *often.value, percent)
                prefixes.append(prefix.view(np.int64) if new else None)
                matches.append(k if new else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("key"), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(matches, pa.int32()), pa.array(prefixes, pa.list_(pa.int64()))],
                ["doc_id", "key", "n_shingles", "digest", "matches", "prefix"],
            )

    return docs.select("doc_id", row_key(), "text").mapInArrow(run, "doc_id long, key long, n_shingles long, digest binary, matches int, prefix array<long>")


def _sets(docs: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """cid and sorted set of each wanted class (cid, key, digest), from the rows of that key, once a task; a chance match of keys has another digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given: set[int] = set()
        for batch in batches:
            cids, sets = [], []
            for cid, digest, words in zip(batch.column("cid").to_pylist(), batch.column("digest").to_pylist(), each_text(batch.column("text")), strict=True):
                if cid not in given:
                    own = np.unique(shingles(words, n))
                    if hashlib.blake2b(own.tobytes(), digest_size=16).digest() == digest:
                        given.add(cid)
                        cids.append(cid)
                        sets.append(own.view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(cids, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], ["cid", "own"])

    texts = docs.select(row_key(), "text").join(_small(wanted), "key")
    return texts.select("cid", "digest", "text").mapInArrow(run, "cid long, own array<long>")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of a written table whose sets meet the threshold.

    Pairs are few numbers, so they go to the sets where those lie; then only the sets of ``a`` move, to that of ``b``.
    """
    pairs = _small(pairs)
    left = sets.select(F.col("cid").alias("a"), F.col("own").alias("own_a")).join(pairs, "a")
    right = sets.select(F.col("cid").alias("b"), F.col("own").alias("own_b")).join(pairs.select("b").distinct(), "b", "left_semi")
    common = F.size(F.array_intersect("own_a", "own_b"))
    fits = 100 * common >= percent * (F.size("own_a") + F.size("own_b") - common)
    return left.join(right, "b").filter(fits).select("a", "b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(cid, root) of every node of the edges (a, b), by alternating large and small stars until nothing changes."""
    now, last = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()), None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        now = written(small)
        state = now.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40)))).first()
        if state == last:
            return now.select(F.col("u").alias("cid"), F.col("v").alias("root"))
        last = state


def _grouped(live: DataFrame, roots: DataFrame | None, percent: int) -> DataFrame:
    """Prefix entries with the component of their class, without those of which no other holder has a size that could do, and without shingles of a single component."""
    live = live.drop("root")
    placed = live.withColumn("root", F.col("cid")) if roots is None else live.join(roots, "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    by, sized = Window.partitionBy("shingle"), Window.partitionBy("shingle").orderBy("n", "cid")
    near = (F.lag("n").over(sized) * 100 >= F.col("n") * percent) | (F.col("n") * 100 >= F.lead("n").over(sized) * percent)
    placed = placed.withColumn("_near", F.coalesce(near, F.lit(False))).filter("_near").drop("_near")
    return placed.withColumn("_few", F.min("root").over(by) == F.max("root").over(by)).filter("not _few").drop("_few")


def _counted(entries: DataFrame, turn: int) -> DataFrame:
    """With each shingle's holders: all, own (of the same component), main (the largest component) and hub.

    The hub is the holder most of whose prefix others share, as it stands in the middle of its copies; later rounds vary
    the choice. All windows go by shingle, on one exchange.
    """
    by = Window.partitionBy("shingle")
    chance = F.pmod(F.xxhash64(F.lit(turn), "cid"), F.lit(1024)) / 1024
    hub = F.max(F.struct(F.col("met") * (0.5 + chance) if turn else F.col("met").cast("double"), "cid", "root", "n", "matches", "asked")).over(by)
    return entries.withColumn("own", F.count("*").over(Window.partitionBy("shingle", "root"))).withColumns(
        {"all": F.count("*").over(by), "main": F.max(F.struct("own", "root")).over(by)["root"], "hub": hub}
    )


def links(live: DataFrame, prefixes: DataFrame, sets: DataFrame, percent: int) -> DataFrame | None:
    """Roots of the classes that are linked with others; None if none are."""
    edges: list[DataFrame] = []
    roots, open_, last, turn = None, live, None, 0
    base = ["cid", "n", "matches", "shingle", "met", "asked"]
    while True:
        open_ = written(_counted(_grouped(open_.select(base), roots, percent), turn))
        across, entries = open_.agg(F.sum(F.col("all") - F.col("own")) / 2, F.count("*")).first()
        if not entries:
            return roots
        if last is not None and (across <= 4 * entries or across > 0.9 * last):
            break
        star = open_.filter("root <> hub.root").filter(F.least("n", "hub.n") * 100 >= percent * F.greatest("n", "hub.n"))
        star = star.groupBy(F.col("cid").alias("a"), F.col("hub.cid").alias("b")).agg(F.count("*").alias("_c"), F.min(F.least("matches", "hub.matches") - F.greatest("asked", "hub.asked") + 1).alias("_m"))
        found = written(verified(written(star.filter("_c >= _m").select("a", "b")), sets, percent))
        if not found.isEmpty():
            edges.append(found)
            roots = written(components(_union(edges)))
        last, turn = across, turn + 1
        del star
        released(live.sparkSession)
    # In a shingle's holders, the largest component's members meet only the others, so they are never paired among themselves.
    # The join itself compares the prefixes, so it gives only pairs with enough matches.
    rows = written(open_.select("cid", "root", "n", "matches", "shingle", "main").join(prefixes, "cid"))
    side = lambda k: [F.col(c).alias(f"{k}_{c}") for c in ("cid", "root", "n", "matches", "prefix", "twice")]
    few = rows.filter("root <> main").select("shingle", *side("a"))
    many = rows.select("shingle", (F.col("root") == F.col("main")).alias("in_main"), *side("b"))
    spare = F.least(F.col("a_matches") - _part(F.col("a_n"), percent), F.col("b_matches") - _part(F.col("b_n"), percent))
    need = _overlap(F.col("a_n"), F.col("b_n"), percent) + spare
    sized = F.least("a_n", "b_n") * 100 >= percent * F.greatest("a_n", "b_n")
    other = (F.col("a_root") != F.col("b_root")) & (F.col("in_main") | (F.col("a_cid") < F.col("b_cid")))
    on = (few["shingle"] == many["shingle"]) & other & sized & (F.size(F.array_intersect("a_prefix", "b_prefix")) + F.least("a_twice", "b_twice") >= need)
    pairs = few.join(many, on).select(F.least("a_cid", "b_cid").alias("a"), F.greatest("a_cid", "b_cid").alias("b")).distinct()
    found = written(verified(written(pairs), sets, percent))
    if not found.isEmpty():
        roots = written(components(_union([*edges, found])))
    return roots


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def join(docs: DataFrame, n: int = 3, percent: int = 90) -> DataFrame:
    """doc_id, n_shingles and component_id of every row."""
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = written(profiles(docs, n, percent))
    classes = rows.filter("n_shingles > 0").groupBy("digest").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("_none"), "doc_id", "key")).alias("_first"), F.first("n_shingles").alias("n"),
        F.first("matches", True).alias("matches"), F.first("prefix", True).alias("prefix"),
    )
    classes = classes.select("digest", F.col("_first.doc_id").alias("doc"), F.col("_first.key").alias("key"), "n", "matches", "prefix")
    classes = written(classes.withColumn("cid", F.monotonically_increasing_id()))
    entries = classes.select("cid", "n", "matches", F.explode("prefix").alias("shingle"))
    holders = Window.partitionBy("shingle")
    met = _grouped(entries, None, percent).drop("root").withColumns({
        "_least": F.min("matches").over(holders), "_size": F.count("*").over(holders),
        "_low": F.greatest(F.min("n").over(holders), _part(F.col("n"), percent)), "_high": F.max("n").over(holders),
    })
    met = written(met)
    released(docs.sparkSession)
    # The sizes of possible partners tell how many shared shingles a pair of the class could do with. A class that shares
    # fewer has no pair; the others can do without their most common ones, one fewer than that: the rarest that a pair
    # shares is left to both.
    own = Window.partitionBy("cid")
    size, low, high = F.col("n"), F.min("_low").over(own), F.least(F.max("_high").over(own), F.floor(F.col("n") * 100 / percent))
    least = F.greatest(F.min("_least").over(own), F.least(F.lit(MIN_MATCHES), _part(_part(size, percent), percent)))
    asked = F.least(F.col("matches") + _overlap(size, low, percent) - _part(size, percent), least + _overlap(size, high, percent) - _part(high, percent) - 1)
    ranked = met.withColumns({"met": F.count("*").over(own), "asked": F.greatest(asked, F.lit(1)), "_nth": F.row_number().over(own.orderBy(F.desc("_size"), F.desc("shingle")))})
    ranked = written(ranked.filter("met >= asked").drop("_least", "_size", "_low", "_high"))
    live = written(_grouped(ranked.filter("_nth >= asked").drop("_nth"), None, percent).drop("root"))
    wanted = written(live.select("cid").distinct().join(classes.select("cid", "key", "digest"), "cid"))
    # Shingles as 16 bits: equal ones stay equal, and a chance match between two prefixes only lets a pair be verified.
    # Those that fall together within one prefix are counted, as a set of common values misses them.
    prefixes = ranked.groupBy("cid").agg(F.collect_list((F.pmod(F.hash("shingle"), F.lit(65_536)) - 32_768).cast("smallint")).alias("prefix"))
    prefixes = prefixes.withColumn("twice", F.size("prefix") - F.size(F.array_distinct("prefix")))
    sets = written(_sets(docs, wanted, n))
    released(docs.sparkSession)
    roots = links(live, prefixes, sets, percent)
    if roots is None:
        known = classes.select("digest", F.col("doc").alias("component_id"))
    else:
        rooted = classes.select("digest", "cid", "doc").join(roots, "cid", "left").withColumn("root", F.coalesce("root", "cid"))
        least = rooted.groupBy("root").agg(F.min("doc").alias("component_id"))
        known = rooted.join(least, "root").select("digest", "component_id")
    small = rows.select("doc_id", "n_shingles", "digest")
    found = small.join(known, "digest", "left")
    return found.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_first(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """One row of each component of ``docs``, with its columns: the smallest doc_id, nulls last, then any one of equals.

    Rows are told apart by a key of their own, so repeated rows and null doc_ids count as the copies that they are. The
    keys of rows to leave out are sent to where the texts lie if they are at most ``base.BROADCAST_ROWS``; no text is shuffled then.
    """
    row = next(c for c in (f"_row{i}" for i in range(len(docs.columns) + 1)) if c not in docs.columns)
    keyed = written(docs.withColumn(row, F.monotonically_increasing_id()))
    linked = join(keyed.select(F.col(row).alias("doc_id"), "text"), n, percent).filter("n_shingles > 0")
    linked = linked.select(F.col("doc_id").alias("_row"), F.col("component_id").alias("_component"))
    rows = written(linked.join(keyed.select(F.col(row).alias("_row"), "doc_id"), "_row"))
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_row"))["_row"]
    groups = rows.groupBy("_component").agg(first.alias("_first"), F.count("*").alias("_rows")).filter("_rows > 1")
    gone = written(rows.join(groups, "_component").filter("_row <> _first").select(F.col("_row").alias(row)))
    return keyed.join(_small(gone), row, "left_anti").select(docs.columns)
