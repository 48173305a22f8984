"""The audit of filters against a plain count over each order."""

import random
import re
from collections import defaultdict
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from headway.llm import audit
from headway.llm.base import table
from headway.llm.queries import op12_filter_audit

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(docs, labels):
    least = {}
    for i, text, _ in docs:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    parts = defaultdict(list)
    for i, text, source in docs:
        t = text or ""
        w = WORD.findall(t)
        failed = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and i > least[t]}
        parts[source or ""].append(({k for k, v in failed.items() if v}, i in good, i in toxic))
    rows, shapley = [], defaultdict(int)
    for part, all_docs in parts.items():
        for order in permutations("ABCDE"):
            left = all_docs
            for step, letter in enumerate(order, 1):
                here, left = [d for d in left if letter in d[0]], [d for d in left if letter not in d[0]]
                failing = sum(letter in d[0] for d in all_docs)
                shapley[part, letter] += len(here)
                rows.append([part, "".join(order), step, len(left), len(here), failing - len(here), sum(d[0] == {letter} for d in all_docs), sum(d[1] for d in here), sum(d[2] for d in here)])
    return sorted((*r, shapley[r[0], r[1][r[2] - 1]]) for r in rows)


def frames(spark, docs, labels):
    return spark.createDataFrame(docs, "doc_id long, text string, source string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_query_on_the_given_tables(spark, small):
    docs = [tuple(r) for r in table(spark, small, "documents").select("doc_id", "text", "source").collect()]
    labels = [tuple(r) for r in table(spark, small, "labels").select("doc_id", "quality", "toxic").collect()]
    assert sorted(map(tuple, op12_filter_audit(spark, small).collect())) == plain(docs, labels)


@pytest.mark.parametrize("held", [10, audit.HELD_BYTES])
def test_copies_nulls_and_repeats(spark, monkeypatch, held):
    """With little held, copies meet only behind the shuffle."""
    monkeypatch.setattr(audit, "HELD_BYTES", held)
    rng = random.Random(3)
    texts = [None, "", " \n", "x", "A B C", "w " * 60, " ".join(f"w{i}" for i in range(60)), " ".join(f"W{i}" for i in range(60)) + "$", "# " + " ".join(map(str, range(80))), "  \u0085", "É" * 9]
    docs = [(rng.choice([None, *range(40)]), rng.choice(texts), rng.choice([None, "", "a", "b", "b", "b"])) for _ in range(400)]
    docs += [(i, "the same text", "hot") for i in range(300, 0, -1)] + [(1, "the same text", "cold")] * 3 + [(None, "null", "n")] * 50
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 320, 2)] + [(4, 1, 1), (4, 0, 0), (None, 1, 1)]
    d, x = frames(spark, docs, labels)
    d = d.withColumns({c: F.lit("clash") for c in ("mask", "part", "rows", "good", "kept")}).repartition(5)
    assert sorted(map(tuple, audit.interactions(d, x).collect())) == plain(docs, labels)
    assert audit.interactions(d.limit(0), x).count() == 0
    assert {r["good_lost"] for r in audit.interactions(d, x.limit(0)).select("good_lost").collect()} == {0}


def test_fingerprints_that_collide_keep_their_texts_apart(spark, monkeypatch):
    rows = [("t1", 5), ("t2", 3), ("t1", 4), ("t2", 9), ("t3", 1)]
    routed = sorted(((0, (t, i, 0, "s", 1)) for t, i in rows), key=lambda r: r[0])
    assert sorted(audit._chained(routed)) == sorted([(5, 16, "s", 1), (4, 0, "s", 1), (3, 0, "s", 1), (9, 16, "s", 1), (1, 0, "s", 1)])


def test_hot_text_is_shuffled_once_a_task():
    opened = [x for x in audit._scan([(i, "hot", "s") for i in range(1000, 0, -1)]) if x[1] is not None]
    assert len(opened) == 1 and opened[0][2] == 1


def test_long_texts_are_counted_in_slices(monkeypatch):
    text = "ab cd ef " * 1000 + "A" * 5000
    whole = audit.own_failures(text)
    monkeypatch.setattr(audit, "SLICE_BYTES", 7)
    assert audit.own_failures(text) == whole == 2 + 4
