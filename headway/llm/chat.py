"""Chat formatting in windows of a token budget.

Turns of a conversation stand one after another on a token axis (prefix sums).
The axis is cut into buckets of the budget less what the system turn and the
history may take: turns inside one bucket form a window, and a turn across a
bucket's border is a window of its own, so spans are turn-aligned and only a
single turn can pass the budget. Every window begins with the system turn and
with the last turns before it, as far as ``history_turns`` and
``history_tokens`` go; those copies are marked as repeated and never carry
loss. Loss lies on the text of assistant turns, once each.

``<|im_start|>role\\ntext<|im_end|>\\n`` marks a turn. Inside roles and texts a
backslash is doubled and ``<|`` becomes ``\\i`` (and a line feed in a role
``\\n``), so no text can make a marker, and :func:`read_back` restores it.

Scale: prefix sums are taken per block of ``BLOCK`` turn numbers and then over
the blocks, and history is looked up in blocks by rank with an overlap of
``history_turns`` rows, so a conversation that holds a third of all rows is
spread over tasks. A window holds a budget's worth of text.

Null texts and roles are empty; null turns come first; turns with equal numbers
are ordered by role and text; repeated rows are separate turns. A null conv_id
is a conversation of its own. A very long turn is a window of its own, whole.
Columns besides conv_id, turn, role and text are ignored, so names cannot clash.
An empty table gives no windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from headway.llm.base import let

START, END = "<|im_start|>", "<|im_end|>"
BUDGET, HISTORY_TURNS, HISTORY_TOKENS = 2048, 2, 512
BLOCK = 256


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("\\i"))


def unescape(text: Column) -> Column:
    """Splitting at doubled backslashes from the left leaves only single ones, each before its letter."""
    parts = F.split(text, r"\\\\", -1)
    plain = lambda p: F.replace(F.replace(p, F.lit("\\i"), F.lit("<|")), F.lit("\\n"), F.lit("\n"))
    return F.array_join(F.transform(parts, plain), "\\")


def turn_tokens(text: Column) -> Column:
    """An estimate: a token for four bytes and four for the markers."""
    return F.ceil(F.octet_length(text) / 4).cast("long") + 4


def _ranked(rows: DataFrame) -> DataFrame:
    """rows with rank and start of each turn in its conversation, and its system turn if it has one."""
    slim = rows.select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    ).withColumns({"tokens": turn_tokens(F.col("text")), "_block": F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(-(2**62)))})
    blocks = slim.groupBy("conv_id", "_block").agg(
        F.sum("tokens").alias("_tokens"), F.count("*").alias("_rows"), F.min(F.struct("turn", "role", "text", "tokens")).alias("_first")
    )
    earlier = Window.partitionBy("conv_id").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("conv_id").orderBy("_block").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    blocks = blocks.select(
        F.col("conv_id").alias("_conv"), F.col("_block").alias("_its"),
        F.coalesce(F.sum("_tokens").over(earlier), F.lit(0)).alias("_t0"),
        F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_r0"),
        F.first("_first").over(whole).alias("_head"),
    )
    here = Window.partitionBy("conv_id", "_block").orderBy("turn", "role", "text")
    upto = here.rowsBetween(Window.unboundedPreceding, 0)
    placed = slim.withColumns({"_in": F.sum("tokens").over(upto) - F.col("tokens"), "_nth": F.row_number().over(here) - 1})
    placed = placed.join(blocks, placed["conv_id"].eqNullSafe(blocks["_conv"]) & (placed["_block"] == blocks["_its"]))
    return placed.select(
        "conv_id", "role", "text", "tokens",
        (F.col("_r0") + F.col("_nth")).alias("rank"), (F.col("_t0") + F.col("_in")).alias("start"),
        F.when(F.col("_head.role") == "system", F.struct("_head.role", "_head.text", "_head.tokens")).alias("system"),
    )


def _windowed(rows: DataFrame, budget: int, history_turns: int, history_tokens: int) -> DataFrame:
    """A row per turn with its window and the turns before it."""
    own = F.coalesce(F.col("system.tokens"), F.lit(0))
    size = F.greatest(F.lit(budget) - own - history_tokens, F.lit(1))
    is_system = F.col("system").isNotNull() & (F.col("rank") == 0)
    at = F.when(is_system, F.lit(0)).otherwise(F.col("start") - own)
    last = F.when(is_system, F.lit(0)).otherwise(F.col("start") - own + F.col("tokens") - 1)
    ranked = _ranked(rows).withColumns({"window": F.floor(at / size) + F.floor(last / size), "is_system": is_system})
    block = F.floor(F.col("rank") / BLOCK)
    halo = F.when(F.col("rank") % BLOCK >= BLOCK - history_turns, F.array(block, block + 1)).otherwise(F.array(block))
    dealt = ranked.withColumns({"_own": block, "_part": F.explode(halo)})
    here = Window.partitionBy("conv_id", "_part").orderBy("rank")
    past = F.array(*[F.lag(F.struct("role", "text", "start", "is_system"), k).over(here) for k in range(history_turns, 0, -1)])
    past = past if history_turns else F.array().cast("array<struct<role:string,text:string,start:long,is_system:boolean>>")
    near = lambda p: p.isNotNull() & ~p["is_system"] & (F.col("start") - p["start"] <= history_tokens)
    return dealt.withColumn("_past", past).filter("_own = _part").withColumn(
        "_past", F.transform(F.filter("_past", near), lambda p: F.struct(p["role"].alias("role"), p["text"].alias("text")))
    )


def windows(rows: DataFrame, budget: int = BUDGET, history_turns: int = HISTORY_TURNS, history_tokens: int = HISTORY_TOKENS) -> DataFrame:
    """A row per window: conv_id, window, formatted, and per turn its repeated flag and loss span.

    ``turns`` is an array of (repeated, loss, start, end): start and end are the
    code points of the turn's text in ``formatted``, loss says that the span
    counts as a target.
    """
    turns = _windowed(rows, budget, history_turns, history_tokens).groupBy("conv_id", "window").agg(
        F.array_sort(F.collect_list(F.struct("rank", "role", "text"))).alias("_new"),
        F.min(F.struct("rank", "_past", "system")).alias("_lead"),
    )
    line = lambda t, again: F.struct(
        F.lit(again).alias("again"), (t["role"] == "assistant").alias("target"),
        F.concat(F.lit(START), F.replace(escape(t["role"]), F.lit("\n"), F.lit("\\n")), F.lit("\n")).alias("head"), escape(t["text"]).alias("body"),
    )
    system = F.when(F.col("_lead.system").isNotNull() & (F.col("_lead.rank") > 0), F.array(F.col("_lead.system"))).otherwise(F.array())
    shown = F.transform(system, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    lines = F.concat(
        F.transform(F.concat(shown, F.col("_lead._past")), lambda t: line(t, True)), F.transform("_new", lambda t: line(t, False))
    )
    tail = f"{END}\n"
    built = turns.select("conv_id", "window", lines.alias("_lines")).withColumn(
        "_ends",
        F.aggregate(
            "_lines", F.array().cast("array<long>"),
            lambda a, x: F.array_append(a, F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0)) + F.char_length(x["head"]) + F.char_length(x["body"]) + len(tail)),
        ),
    )
    spans = F.transform(
        "_lines",
        lambda x, i: F.struct(
            x["again"].alias("repeated"), (x["target"] & ~x["again"]).alias("loss"),
            (F.get("_ends", i) - len(tail) - F.char_length(x["body"])).cast("int").alias("start"),
            (F.get("_ends", i) - len(tail)).cast("int").alias("end"),
        ),
    )
    text = F.array_join(F.transform("_lines", lambda x: F.concat(x["head"], x["body"], F.lit(tail))), "")
    return built.select("conv_id", "window", text.alias("formatted"), spans.alias("turns"))


def read_back(formatted: DataFrame) -> DataFrame:
    """From the output of :func:`windows`, per window: the new turns as (role, text), and the texts under the loss mask."""
    pieces = F.slice(F.split("formatted", r"<\|im_start\|>", -1), 2, F.size("turns"))
    body = lambda p: F.substr(p, F.instr(p, "\n") + 1, F.char_length(p) - F.instr(p, "\n") - len(END) - 1)
    parsed = F.transform(
        pieces, lambda p, i: F.struct(unescape(F.substring_index(p, "\n", 1)).alias("role"), unescape(body(p)).alias("text"), F.get("turns", i)["repeated"].alias("again"))
    )
    new = F.transform(F.filter(parsed, lambda t: ~t["again"]), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    under = F.transform(F.filter("turns", lambda t: t["loss"]), lambda t: unescape(F.substr(F.col("formatted"), t["start"] + 1, t["end"] - t["start"])))
    return formatted.select("conv_id", "window", new.alias("new_turns"), under.alias("loss_texts"), F.char_length("formatted").cast("long").alias("chars"))


def digests(formatted: DataFrame) -> DataFrame:
    """One row per conversation of what its windows hold. A digest of a whole conversation needs its text in one place."""
    whole = read_back(formatted).groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("window", "new_turns", "loss_texts"))).alias("_w"), F.sum("chars").alias("formatted_chars"), F.count("*").alias("n_windows")
    )
    turns = F.flatten(F.transform("_w", lambda w: w["new_turns"]))
    joined = F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.flatten(F.transform("_w", lambda w: w["loss_texts"])), "")
    return whole.select(
        "conv_id", F.size(turns).cast("long").alias("n_turns"), F.sha2(joined, 256).alias("turns_sha256"),
        let(loss, lambda x: F.char_length(x)).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"),
        "formatted_chars", "n_windows",
    )
