"""Cases in which an operator once did less than its whole job."""

import random

import pytest

from headway.llm import decontam, jaccard


@pytest.mark.parametrize("n", [24, 30, 40, 50])
def test_windows_cut_at_the_edges_are_found(n):
    rng = random.Random(n)
    fresh = lambda k: [f"x{rng.randrange(10**12)}" for _ in range(k)]
    k = max(new for _, new in decontam.changes(n))
    for turn in range(200):
        words = fresh(n)
        left = k if turn % 2 else k // 2
        text = fresh(left) + words[left : n - (k - left)] + fresh(k - left)
        assert decontam.similarity(decontam.shingle_counts(words), decontam.shingle_counts(text)) >= decontam.SIMILARITY
        assert decontam.Items([(1, " ".join(words))]).hits(" ".join(text))


def test_one_row_of_each_group_is_kept(spark):
    one, two, three, four = "a b c d e f", "g h i j k l", "m n o p q r", "s t u v w x"
    rows = [(7, one)] * 3 + [(None, two)] * 2 + [(3, three), (5, three), (5, four)] + [(9, "y z"), (None, "y z"), (8, "Y z")]
    docs = spark.createDataFrame(rows + [(1, None), (1, "")], "doc_id long, text string")
    got = jaccard.keep_first(docs)
    assert got.columns == docs.columns
    want = [(7, one), (None, two), (3, three), (5, four), (8, "Y z"), (1, None), (1, "")]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
