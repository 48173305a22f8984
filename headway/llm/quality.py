"""Quality rules: a table of thresholds compiled into one projection.

Every rule names a ratio and the range it must lie in. All counts come from the
whole text, in one scan, with built-in functions only; nothing is shuffled, so
the cost follows the bytes read and a hot source or a group of copies does not
matter.

Null and empty texts have no words and fail the base rules. Very long texts and
lines are counted whole. Repeated rows each get their own verdict, and an empty
table gives no rows. Columns of the input besides the ones named are ignored, so
names cannot clash.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from headway.llm.base import WHITE, let, named_back, plainly_named, word_count, words

SYMBOLS = "#*$%&|<>"

#: Frequent function words of English, French, German and Spanish (fixed values).
STOP_WORDS = (
    "a an and are as at be by for from he in is it of on or that the this to was were what when which who with you "
    "au aux avec ce dans de des du elle en est et il la le les ne pas par pour qu que qui se sur un une "
    "als auf das dem den der des die ein eine einen es für ich in ist mit nicht sich sie und von war zu zum zur "
    "al como con del el las lo los más me mi no para pero por si su una uno ya y"
).split()


@dataclass(frozen=True)
class Rule:
    """A document passes if ``low <= ratio <= high``; None leaves a side open."""

    name: str
    ratio: str
    low: float | None = None
    high: float | None = None

    def passes(self) -> Column:
        value = F.expr(self.ratio)
        sides = [value >= self.low] if self.low is not None else []
        sides += [value <= self.high] if self.high is not None else []
        return F.coalesce(reduce(Column.__and__, sides, F.lit(True)), F.lit(False))


#: Ratios over the counts of :func:`counts`.
RULES = (
    Rule("word length", "word_chars / n_words", 1.5, 15.0),
    Rule("symbols", "n_symbols / n_words", None, 0.1),
    Rule("shouting", "n_upper / word_chars", None, 0.4),
    Rule("stop words", "n_stop_words / n_words", 0.01, None),
    Rule("repeated lines", "n_dup_lines / n_lines", None, 0.4),
)

MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50


def _repeated(ws: Column) -> Column:
    """Words inside 3-word windows that occur at least twice.

    Sorting the windows of one text brings equal ones together; the positions
    of those, sorted again, cover three words each less what they overlap. A
    text whose windows all have different hashes has no equal ones, so only the
    others are sorted.
    """
    heads = F.slice(ws, 1, F.greatest(F.size(ws) - 2, F.lit(0)))
    hashes = F.transform(heads, lambda w, i: F.xxhash64(w, F.get(ws, i + 1), F.get(ws, i + 2)))
    windows = F.transform(heads, lambda w, i: F.struct(F.concat_ws(" ", w, F.get(ws, i + 1), F.get(ws, i + 2)).alias("s"), i.alias("p")))
    twins = lambda xs: F.transform(
        xs, lambda x, i: F.when((F.get(xs, i - 1)["s"] == x["s"]) | (F.get(xs, i + 1)["s"] == x["s"]), x["p"])
    )
    covered = lambda ps: F.transform(ps, lambda p, i: F.least(F.lit(3), F.coalesce(p - F.get(ps, i - 1), F.lit(3))))
    places = let(F.array_sort(windows), lambda xs: F.array_sort(F.filter(twins(xs), lambda p: p.isNotNull())))
    total = let(places, lambda ps: F.aggregate(covered(ps), F.lit(0), lambda a, x: a + x))
    return F.when(let(hashes, lambda h: F.size(F.array_distinct(h)) == F.size(h)), F.lit(0)).otherwise(total)


def counts(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` and the counts that rules may use, all long."""
    body = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(body, "\n"), lambda x: F.btrim(x, F.lit(WHITE)) != "")
    stops = lambda ws: F.size(F.filter(ws, lambda w: F.lower(F.btrim(w, F.lit(".,;:!?\"'()"))).isin(*STOP_WORDS)))
    by_words = let(words(body), lambda ws: F.struct(_repeated(ws).alias("rep"), stops(ws).alias("stop")))
    by_lines = let(lines, lambda xs: F.struct(F.size(xs).alias("n"), (F.size(xs) - F.size(F.array_distinct(xs))).alias("dup")))
    return docs.select(
        *keep,
        word_count(body).alias("n_words"),
        F.char_length(F.translate(body, WHITE, "")).cast("long").alias("word_chars"),
        (F.char_length(body) - F.char_length(F.translate(body, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.regexp_count(body, F.lit(r"\p{Lu}")).cast("long").alias("n_upper"),
        by_lines.alias("_by_lines"),
        by_words.alias("_by_words"),
    ).select(
        *keep, "n_words", "word_chars", "n_symbols", "n_upper",
        F.col("_by_lines.n").cast("long").alias("n_lines"),
        F.col("_by_lines.dup").cast("long").alias("n_dup_lines"),
        F.col("_by_words.rep").cast("long").alias("n_repeat_words"),
        F.col("_by_words.stop").cast("long").alias("n_stop_words"),
    )


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, the counts, base_failed, kept and the names of the rules that failed."""
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    some = F.col("n_words") > 0
    broken = F.filter(F.array(*[F.when(some & ~r.passes(), F.lit(r.name)) for r in rules]), lambda x: x.isNotNull())
    ok = reduce(Column.__and__, [F.when(some, r.passes()).otherwise(False) for r in rules], F.lit(True))
    return counts(docs, text, keep).select(
        "*", base.alias("base_failed"), (~base & ok).alias("kept"), F.array_join(broken, ", ").alias("failed_rules")
    )


def keep_good(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with their columns as they came.

    The verdict is generated as one row of an array, so the optimizer can neither
    copy its expression into the filter nor evaluate it twice.
    """
    rows, names = plainly_named(docs)
    judged = judge(rows, rules, names["text"], tuple(names.values()))
    return named_back(judged.select(*names.values(), F.explode(F.array("kept")).alias("_kept")).filter("_kept"), names)
