"""Mixing sources to target weights over a curriculum that changes with time.

A phase gives every source a weight for a stretch of the training run. The
integral of a source's schedule is its share of all words; shares above
``max_repeats`` times what a source has are cut to that, and the excess goes to
the other sources by weight. Within a source, documents stand in a fixed random
order and repeat in passes over it; the word at which a copy starts is looked up
in the source's cumulative demand, which gives the moment of the run, and so the
training position, of the copy. The last copy of a source is cut where its
target is reached.

Scale: texts are reduced to a word count in the scan. The order within a source
is cut into ``BUCKETS`` slices by hash, so running sums never gather a source in
one task: slices are summed first (with partial sums before the shuffle), and
documents are summed within their slice. Only tables with one row per slice and
per source are joined back. One row per source goes through a single task, which
suits up to some million sources.

Null sources form one source, after all others. Null or empty texts have size 0
and are never taken; very long ones are counted whole, in the scan. The order
hashes doc_id with the text, so rows with a null doc_id or with one doc_id and
different texts are separate documents in places of their own; equal rows are
interchangeable and follow one another. An empty table gives an empty mix.
Columns besides doc_id, source and text are ignored, so names cannot clash.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from headway.llm.base import word_count

BUCKETS = 1024


@dataclass(frozen=True)
class Phase:
    """Until ``end`` (a fraction of the run), sources weigh ``weights``, dealt out in turn by code point."""

    end: float
    weights: tuple[float, ...]


#: Integrates to 5, 2, 1: broad sources lead, the others grow in the second half.
CURRICULUM = (Phase(0.5, (6.0, 1.5, 0.5)), Phase(1.0, (4.0, 2.5, 1.5)))
MAX_REPEATS = 3


def _turn(values: list[float], rank: Column) -> Column:
    return F.get(F.array(*[F.lit(float(v)) for v in values]), (rank % len(values)).cast("int"))


def targets(sizes: DataFrame, phases: tuple[Phase, ...] = CURRICULUM, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """Of (source, source_size), one row per source: also weight and target.

    With caps c and weights w, sources in order of c / w are cut as long as the
    level (what is left) / (weight that is left) exceeds their c / w; all later
    ones get the level times their weight.
    """
    n = max(len(p.weights) for p in phases)
    starts = [0.0, *[p.end for p in phases]]
    total = [sum((p.end - s) * p.weights[i % len(p.weights)] for s, p in zip(starts, phases, strict=False)) for i in range(n)]
    ranked = sizes.withColumn("_rank", F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1)
    ranked = ranked.withColumn("weight", _turn(total, F.col("_rank"))).withColumn("_cap", F.col("source_size") * float(max_repeats))
    everything = Window.partitionBy()
    by_need = Window.orderBy(F.col("_cap") / F.col("weight"), "_rank")
    before = by_need.rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))
    weight_left = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    level = left / F.greatest(weight_left, F.col("weight"))
    leveled = ranked.withColumn("_level", level)
    is_open = F.col("_level") * F.col("weight") <= F.col("_cap")
    first = F.min(F.when(is_open, F.struct("_rank_by_need", "_level"))).over(everything)
    leveled = leveled.withColumn("_rank_by_need", F.row_number().over(by_need)).withColumn("_open", first["_level"])
    return leveled.select(
        "source", "source_size", "_rank", "weight",
        F.coalesce(F.least(F.col("_cap"), F.col("_open") * F.col("weight")), F.col("_cap")).alias("target"),
    )


def _moment(done: Column, rank: Column, phases: tuple[Phase, ...]) -> Column:
    """The fraction of the run at which a source's cumulative demand reaches the fraction ``done`` of its target."""
    n = max(len(p.weights) for p in phases)
    starts = [0.0, *[p.end for p in phases]]
    found: Column | None = None
    for k in reversed(range(len(phases))):
        low, rate = [], []
        for i in range(n):
            mass = [(p.end - s) * p.weights[i % len(p.weights)] for s, p in zip(starts, phases, strict=False)]
            low.append(sum(mass[:k]) / sum(mass))
            rate.append(phases[k].weights[i % len(phases[k].weights)] / sum(mass))
        here = F.least(F.lit(phases[k].end), starts[k] + F.coalesce(F.try_divide(done - _turn(low, rank), _turn(rate, rank)), F.lit(0.0)))
        found = here if found is None else F.when(done < above, here).otherwise(found)
        above = _turn(low, rank)
    return found


def assign(docs: DataFrame, phases: tuple[Phase, ...] = CURRICULUM, max_repeats: int = MAX_REPEATS, seed: int = 17) -> DataFrame:
    """Each row's doc_id, source, size, source_size, target and copies.

    ``copies`` holds (copy, words, moment) for every time that the row is taken.
    """
    slim = docs.select(
        "doc_id", word_count(F.col("text")).alias("size"),
        F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")).alias("_key"),
        F.xxhash64(F.lit(seed), "doc_id", "text").alias("_at"),
    ).withColumn("_bucket", F.pmod("_at", F.lit(BUCKETS)).cast("int"))
    slices = slim.groupBy("_key", "_bucket").agg(F.sum("size").alias("_sum"))
    in_source = Window.partitionBy("_key")
    slices = slices.select(
        "_key", "_bucket", F.sum("_sum").over(in_source).alias("source_size"),
        (F.sum("_sum").over(in_source.orderBy("_bucket")) - F.col("_sum")).alias("_base"),
    )
    sources = slices.groupBy("_key").agg(F.max("source_size").alias("source_size"))
    sources = targets(sources.select(F.when(F.col("_key") != "", F.substr("_key", F.lit(2))).alias("source"), "source_size"), phases, max_repeats)
    sources = sources.select(F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")).alias("_key"), "_rank", "target")
    slices = slices.join(sources, "_key")
    # Equal rows stand one after another, whichever comes first, so they are one row with a number until their places are known.
    own = ["_key", "_bucket", "_at", "doc_id", "size"]
    here = Window.partitionBy("_key", "_bucket").orderBy("_at", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    equal = slim.groupBy(*own).agg(F.count("*").alias("_rows")).withColumn("_in", F.sum(F.col("size") * F.col("_rows")).over(here) - F.col("size") * F.col("_rows"))
    each = equal.withColumn("_nth", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_rows") - 1))).withColumn("_in", F.col("_in") + F.col("_nth") * F.col("size"))
    placed = each.join(slices, ["_key", "_bucket"]).withColumn("source", F.when(F.col("_key") != "", F.substr("_key", F.lit(2))))
    goal = F.floor("target").cast("long")

    def copy(e: int) -> Column:
        start = F.lit(e) * F.col("source_size") + F.col("_base") + F.col("_in")
        taken = F.greatest(F.lit(0), F.least(F.col("size"), goal - start)).cast("long")
        moment = _moment(F.coalesce(F.try_divide(start, F.col("target")), F.lit(0.0)), F.col("_rank"), phases)
        return F.when(taken > 0, F.struct(F.lit(e).alias("copy"), taken.alias("words"), moment.alias("moment")))

    copies = F.filter(F.array(*[copy(e) for e in range(max_repeats)]), lambda c: c.isNotNull())
    return placed.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"))


def mix(docs: DataFrame, phases: tuple[Phase, ...] = CURRICULUM, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """The training order: a row per copy taken, in ranges by moment, then doc_id and copy."""
    copies = assign(docs, phases, max_repeats).select("doc_id", "source", "size", F.explode("copies").alias("_c"))
    return copies.select("doc_id", "source", "size", "_c.copy", "_c.words", "_c.moment").orderBy("moment", "doc_id", "copy")


def shares(docs: DataFrame, phases: tuple[Phase, ...] = CURRICULUM, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """A row per row of ``docs`` with what the mix takes of it, in order of its first moment; rows not taken come last."""
    taken = F.aggregate("copies", F.lit(0).cast("long"), lambda a, c: a + c["words"])
    return (
        assign(docs, phases, max_repeats)
        .select(
            "doc_id", "size", "source_size", "target", taken.alias("taken"), F.size("copies").alias("n_copies"),
            F.get("copies", F.lit(0))["moment"].alias("first_moment"),
        )
        .orderBy(F.asc_nulls_last("first_moment"), "doc_id")
    )
