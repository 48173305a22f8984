"""Decontamination: what fingerprints spare, recall at the limit, long texts, clashing columns, repeated rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from headway.llm import decontam


def passages(n, size, seed=1):
    rng = random.Random(seed)
    return [[f"k{rng.randrange(3_000)}" for _ in range(size)] for _ in range(n)]


def edited(words, rng):
    """A copy with up to three words replaced, dropped or put in."""
    w = list(words)
    for _ in range(rng.randrange(4)):
        k = rng.randrange(len(w))
        w[k : k + rng.choice([0, 1])] = [f"z{rng.random()}"] if rng.random() < 0.7 else []
    return w


def test_recall_of_edited_passages():
    """Every passage with some window of 0.8 or more is found, and no other."""
    rng, found, wanted = random.Random(9), [], []
    for size in (12, 24, 40, 60):
        items = passages(60, size, size)
        index = decontam.Items([(i, " ".join(w)) for i, w in enumerate(items)])
        for i, w in enumerate(items):
            text = [f"f{rng.random()}" for _ in range(30)] + edited(w, rng) + [f"f{rng.random()}" for _ in range(30)]
            own = decontam.shingle_counts(w)
            wanted.append(any(decontam.similarity(own, decontam.shingle_counts(text[s : s + size])) >= decontam.SIMILARITY for s in range(len(text) - size + 1)))
            found.append(i in {h[0] for h in index.hits(" ".join(text))})
    assert found == wanted and 100 <= sum(wanted) < 240


def test_distances_spare_exact_comparisons(monkeypatch):
    """Texts that hold one pointing shingle of each of many items: of the pairs of windows and items few are within the radius."""
    items = passages(200, 40)
    index = decontam.Items([(i, " ".join(w)) for i, w in enumerate(items)])
    known = index.anchors[decontam.N][1]
    compared, rng, text = [], random.Random(2), []
    for w in items:
        hashes = decontam.Items._hashes(np.array([index.words.vocabulary[x] for x in w], np.uint64), decontam.N).tolist()
        k = next(k for k, h in enumerate(hashes) if h in known)
        text += [f"f{rng.random()}" for _ in range(40)] + w[k : k + decontam.N]
    monkeypatch.setattr(decontam, "similarity", lambda a, b: compared.append(1) or 0.0)
    index.hits(" ".join(text))
    pairs = 200 * 36 * 200  # every window that holds a pointing shingle, with every item that some shingle of the text points to
    assert 0 < len(compared) < 0.1 * pairs


def test_long_texts_are_searched_in_slices(monkeypatch):
    monkeypatch.setattr(decontam, "SLICE_WORDS", 200)
    sizes = []
    made = decontam.Items._of
    monkeypatch.setattr(decontam.Items, "_of", lambda self, words: sizes.append(len(words)) or made(self, words))
    (item,) = passages(1, 30)
    index = decontam.Items([(7, " ".join(item))])
    sizes.clear()
    text = item * 200 + ["x"] * 50
    hits = index.hits(" ".join(text))
    assert [(h[0], h[1], h[4]) for h in hits] == [(7, 0, 1.0)] and max(sizes) <= 200 and len(sizes) > 10


def test_clashing_columns_repeated_rows_and_nulls(spark):
    (item,) = passages(1, 20)
    text = " ".join(item)
    rows = [(1, text), (1, text), (None, text), (2, None), (3, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"item_id": F.lit("x"), "similarity": F.lit(1)})
    bench = spark.createDataFrame([(5, text)], "item_id long, text string").withColumn("doc_id", F.lit(0))
    got = sorted(((r["doc_id"], r["item_id"]) for r in decontam.leaks(docs, bench).collect()), key=repr)
    assert got == [(1, 5), (1, 5), (None, 5)]
    clean = decontam.keep_clean(docs, bench)
    assert clean.columns == docs.columns and sorted(r["doc_id"] for r in clean.collect()) == [2, 3]


def test_a_text_of_a_million_words():
    (item,) = passages(1, 40)
    index = decontam.Items([(7, " ".join(item))])
    text = " ".join(["word"] * 500_000 + item + ["word"] * 500_000)
    assert [(h[0], h[1]) for h in index.hits(text)] == [(7, 500_000)]


@pytest.mark.parametrize("span", [(0, 0), (3, 20), (0, 99)])
def test_slices_cover_all_windows(span):
    parts = list(decontam._sliced(*span, 7))
    assert [w for a, b in parts for w in range(a, b + 1)] == list(range(span[0], span[1] + 1))


def test_a_phrase_that_items_share_points_to_none_of_them():
    """5,000 items behind one template, in a text that repeats the template 50 times and holds one item."""
    import random
    import time

    rng = random.Random(8)
    fresh = lambda n: [f"x{rng.randrange(10**9)}" for _ in range(n)]
    template = "which of the following answers fits the question below best".split()
    items = [(i, " ".join(template + fresh(30))) for i in range(5000)]
    index = decontam.Items(items)
    text = " ".join(" ".join(fresh(60) + template) for _ in range(50))
    began = time.perf_counter()
    assert index.hits(text) == []
    assert [h[0] for h in index.hits(f"{text} {items[7][1]} {text}")] == [7]
    assert time.perf_counter() - began < 2
    shared = {h for own in [decontam.Items._hashes(np.array([index.words.vocabulary[w] for w in template], np.uint64), decontam.N)] for h in own.tolist()}
    assert not shared & set(index.anchors[decontam.N][1])


def test_items_that_are_all_template_are_still_found():
    items = [(i, f"name the capital of the country {c} please") for i, c in enumerate(("france", "spain", "chile"))] + [(9, "one two three four five six"), (10, "one two three four five six")]
    index = decontam.Items(items)
    assert [h[0] for h in index.hits("so name the capital of the country spain please now")] == [1]
    assert [h[0] for h in index.hits("one two three four five six")] == [9, 10]
