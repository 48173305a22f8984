"""Repair of conversations against a plain search of each conversation as a whole."""

import hashlib
import random
import zlib
from collections import defaultdict
from functools import cache

import pytest
from pyspark.sql import functions as F

from headway.llm import repair
from headway.llm.base import table
from headway.llm.queries import op13_conversation_repair

WHITE = " \t\n\x0b\x0c\r"
AFTER_KEEP = {"-s": "s", "-u": "u", "su": "u", "ua": "a", "au": "u"}


def damage(rows):
    kept = []
    for conv, turn, role, text in rows:
        show = lambda x: " " if x is None else str(x)
        harm, role, text = zlib.crc32(f"{show(conv)}:{show(turn)}".encode()) % 20, show(role), show(text)
        if harm == 0:
            continue
        text = "" if harm == 1 else "".join(c for c in text if c not in ".!?") if harm == 2 else text
        kept += [(conv, turn, "user" if harm == 4 else role, text)] * (2 if harm == 3 else 1)
    return kept


def plain(rows, conversations):
    groups = defaultdict(list)
    for conv, turn, role, text in rows:
        groups[conv].append((turn is not None, turn or 0, role, hashlib.sha256(text.encode()).hexdigest(), text))
    return {c: one(sorted(groups[c])) for c in {*conversations, *groups}}


def one(rows):
    seen, kinds, faults = set(), [], [0, 0, 0]
    for _, _, role, _, text in rows:
        bare = text.strip(WHITE)
        fault = 0 if not bare else 1 if (role, text) in seen else 2 if bare[-1] not in ".!?" else None
        seen.add((role, text))
        kinds.append((role, text, fault))
        if fault is not None:
            faults[fault] += 1
    illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    turns = {t for known, t, *_ in rows if known}
    other = {"-": "user", "s": "user", "u": "assistant", "a": "user"}

    @cache
    def best(i, state, put):
        """(cost, audit) from row i on; ``put`` turns in a row have been put in."""
        found = []
        if i == len(kinds):
            found = [(0, "")] if state in "-a" else []
        else:
            role, text, fault = kinds[i]
            more = 3 if fault == 2 else 0
            ways = [(4, "D", state)]
            if fault not in (0, 1):
                ways += [(3 + more, "R", other[state][0])] + [(more, "K", AFTER_KEEP.get(state + role[:1]))] * (state + role[:1] in AFTER_KEEP)
            for cost, edit, to in ways:
                c, a = best(i + 1, to, 0)
                found.append((c + cost, edit + a))
        if put < 3:
            c, a = best(i, other[state][0], put + 1)
            found.append((c + 3, "I" + a))
        return min(found, default=(10**9, ""))

    for start in range(len(kinds), 0, -50):
        for state in "-sua":
            best(max(start - 50, 0), state, 0)
    cost, audit = best(0, "-", 0)
    lines, i, state = [], 0, "-"
    for edit in audit:
        role, text = (other[state], "") if edit == "I" else kinds[i][:2]
        i += edit != "I"
        if edit != "D":
            role = other[state] if edit == "R" else role
            state = role[0]
            lines.append(f"{role}:{text}")
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    return gaps, *faults, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()


def result(df):
    rows = [tuple(r) for r in df.collect()]
    assert len({r[0] for r in rows}) == len(rows)
    return {r[0]: r[1:] for r in rows}


def frame(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def test_query_on_the_given_table(spark, small):
    rows = [tuple(r) for r in table(spark, small, "conversations").select("conv_id", "turn", "role", "text").collect()]
    assert result(op13_conversation_repair(spark, small)) == plain(damage(rows), {r[0] for r in rows})


@pytest.mark.parametrize("parts", ["1", "7", "200"])
def test_random_conversations_over_any_number_of_slices(spark, parts):
    """With 200 slices nearly every row is a slice of its own, so all vectors are chained."""
    rng = random.Random(13)
    texts = ["a.", "b!", "c?", "cut", "", " \n", "d. ", "é…", "e.\x0b", "f. "]
    roles = ["user", "assistant", "system", "tool", "", " ", "sage", "User"]
    rows = []
    for conv in range(60):
        for turn in range(rng.randint(1, 14)):
            rows.append((conv if conv else None, rng.choice([turn, turn, turn, None, 3]), rng.choices(roles, [6, 6, 3, 1, 1, 1, 1, 1])[0], rng.choice(texts) + str(rng.choice(["", rng.random()]))[:4] + rng.choice([".", ""])))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = result(repair.repaired(frame(spark, rows), frame(spark, [(99, 0, "user", "x")])))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == plain(rows, {99})


def test_hot_conversation_and_copies_are_many_slices(spark):
    rows = [(1, i % 400, ["user", "assistant"][i % 2], f"t{i}." if i % 3 else "same.") for i in range(3000)] + [(1, 5, "user", "copy.")] * 2000 + [(2, 0, "user", "x.")]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else so few rows are one slice
    try:
        sizes = [r["count"] for r in repair._placed(frame(spark, rows)).groupBy(F.shiftright("at", 33)).count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(sizes) == 8 and max(sizes) < 2 * sum(sizes) / len(sizes)
    assert result(repair.repaired(frame(spark, rows), frame(spark, rows))) == plain(rows, set())


def test_nulls_empty_tables_and_clashing_names(spark):
    rows = [(None, None, None, None), (None, 1, "assistant", None), (7, None, "user", "a."), (7, None, "user", "a."), (8, 2, "system", "x" * 200_000), (8, 9, None, "y.")]
    df = frame(spark, rows).withColumns({c: F.lit("clash") for c in ("at", "kind", "digest", "audit", "cost", "behind")})
    assert result(repair.repaired(repair.damaged(df), df)) == plain(damage(rows), {r[0] for r in rows})
    shown = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    assert result(repair.repaired(df, df)) == plain(shown, set())
    empty = repair.repaired(df.limit(0), df.limit(0))
    assert empty.count() == 0
    nothing = result(repair.repaired(df.limit(0), df))
    assert nothing[7] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) and len(nothing) == 3


def test_table_has_few_states():
    table = repair.Table()
    rng = random.Random(1)
    for _ in range(300):
        table.scan(bytes(rng.randrange(10) for _ in range(200)), repair.pack(repair.END))
    assert len({v for v, _ in table.moves.values()}) < 60
