"""Jaccard join, decontamination, toxicity and the pipeline."""

import random

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from headway.llm import decontam, jaccard, toxicity
from headway.llm.base import table, written


def near_copies():
    rng = random.Random(3)
    base, rows = [f"w{rng.randrange(400)}" for _ in range(300)], []
    for k in range(150):
        b = list(base)
        for _ in range(rng.randrange(4)):
            b[rng.randrange(300)] = f"z{rng.randrange(10**6)}"
        rows.append((10**6 + k, " ".join(b[: rng.choice([300, 299, 298])])))
    short = [f"v{rng.randrange(900)}" for _ in range(150)]
    for k in range(150):  # copies with so many edits that only some pairs are linked
        b = list(short)
        for _ in range(rng.randrange(6)):
            b[rng.randrange(150)] = f"y{rng.randrange(10**6)}"
        rows.append((5 * 10**6 + k, " ".join(b)))
    rows += [(2 * 10**6 + k, " ".join(base[100:200] + [f"q{rng.randrange(10**6)}" for _ in range(rng.choice([5, 60]))])) for k in range(30)]
    for k in range(40):  # a chain in which only neighbours are linked
        rows.append((3 * 10**6 + k, " ".join(f"c{i}" for i in range(6 * k, 6 * k + 130))))
    return rows + [(4 * 10**6, None), (4 * 10**6 + 1, ""), (4 * 10**6 + 2, "a b"), (4 * 10**6 + 3, "A  b"), (4 * 10**6 + 4, "a"), (4 * 10**6 + 5, " \n")]


@pytest.mark.parametrize(("n", "percent"), [(3, 90), (5, 80), (1, 50)])
def test_join_equals_all_pairs(spark, small, n, percent):
    docs = table(spark, small, "documents").select("doc_id", "text").unionByName(spark.createDataFrame(near_copies(), "doc_id long, text string"))
    want = brute.components([tuple(r) for r in docs.collect()], n, percent)
    got = {r[0]: (r[1], r[2]) for r in jaccard.join(docs.withColumn("cid", F.lit(1)), n, percent).collect()}
    assert got == want


def test_join_edges(spark):
    schema = "doc_id long, text string"
    docs = spark.createDataFrame([(5, "a b c d"), (5, "x y z"), (9, "A b  c d"), (None, "x y z"), (None, "q r s"), (3, None)], schema)
    got = sorted(map(tuple, jaccard.join(docs).collect()), key=repr)
    assert got == sorted([(5, 2, 5), (5, 1, 5), (9, 2, 5), (None, 1, 5), (None, 1, None), (3, 0, 3)], key=repr)
    assert jaccard.join(docs.limit(0)).count() == 0
    kept = jaccard.keep_first(docs.withColumn("extra", F.lit(1)))
    # One row of each group: (5, "a b c d") of two and (5, "x y z") of two, whose copy has no doc_id.
    assert kept.columns == ["doc_id", "text", "extra"] and sorted([r[0] for r in kept.collect()], key=repr) == sorted([5, 5, None, 3], key=repr)


def test_prefix_shares_enough():
    rng = np.random.default_rng(1)
    often = np.unique(rng.integers(0, 2**63, 50).astype(np.uint64))
    counts = rng.integers(3, 90, len(often))
    for _ in range(200):
        a = np.unique(np.concatenate([rng.choice(often, 10), rng.integers(0, 2**63, rng.integers(5, 80)).astype(np.uint64)]))
        b = np.unique(np.concatenate([rng.choice(a, max(1, int(len(a) * rng.uniform(0.8, 1))), False), rng.integers(0, 2**63, rng.integers(0, 8)).astype(np.uint64)]))
        for percent in (50, 80, 90):
            (pa_, ka), (pb, kb) = (jaccard._prefix(x, often, counts, percent) for x in (a, b))
            common = len(np.intersect1d(a, b))
            if 100 * common >= percent * (len(a) + len(b) - common):
                assert len(np.intersect1d(pa_, pb)) >= min(ka, kb)


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (5, 5)], "a long, b long")
    got = {r["cid"]: r["root"] for r in jaccard.components(edges).collect()}
    assert all(got[i] == 0 for i in range(1, 61)) and got[101] == 100


def dense_leaks(items, rows):
    split = [(i, [w for w in map(decontam.bare, (t or "").split()) if w]) for i, t in items]
    out = {}
    for d, text in rows:
        w = [x for x in map(decontam.bare, (text or "").split()) if x]
        for i, v in split:
            if v and w:
                n = min(len(v), len(w))
                best = max(decontam.similarity(decontam.shingle_counts(v), decontam.shingle_counts(w[s : s + n])) for s in range(len(w) - n + 1))
                if best >= decontam.SIMILARITY:
                    out[d, i] = round(best, 9)
    return out


def test_leaks_equal_all_windows(spark, small):
    rng = random.Random(8)
    items = [(r["item_id"], r["text"]) for r in table(spark, small, "benchmark").collect()] + [(900, "a b"), (901, ""), (902, None), (903, "One two, three four five!"), (None, "q w e r t y u i o p")]
    rows = [(r["doc_id"], r["text"]) for r in table(spark, small, "documents").filter("n_chars < 3000").collect()]
    for k in range(120):
        v = (items[k % 40][1] or "").split()
        v[rng.choice([0, 1, len(v) - 1, rng.randrange(len(v))])] = f"zz{k}"
        rows.append((5000 + k, " ".join([f"x{rng.random()}" for _ in range(9)] + v[rng.randrange(3) :] + ["***", "end"])))
    rows += [(7000, "zz a B, c one two three four! five"), (7001, None), (7002, ""), (7003, "w e r t y u i o p")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = dense_leaks(items, rows)
    got = {(r["doc_id"], r["item_id"]): round(r["similarity"], 9) for r in decontam.leaks(docs, bench).collect()}
    assert got == want and len(want) > 80
    assert {(r["doc_id"], r["item_id"]): round(r["similarity"], 9) for r in decontam.leaks(docs, bench, block_words=200).collect()} == want
    clean = decontam.keep_clean(docs, bench, block_words=200)
    assert clean.columns == docs.columns and {r["doc_id"] for r in clean.collect()} == {d for d, _ in rows} - {d for d, _ in want}
    assert decontam.leaks(docs, bench.limit(0)).count() == 0 and decontam.leaks(docs.limit(0), bench).count() == 0
    assert decontam.keep_clean(docs, bench.limit(0)).count() == len(rows)


def test_blocks_find_all_within_the_radius():
    rng = random.Random(4)
    items = decontam.Items([(k, " ".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=n))) for n in (10, 30) for k in range(40)])
    for n, (ats, own, radius, _) in items.index.items():
        prints = np.array([int(p) ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(20))) for p in np.repeat(own, 10)], np.uint64)
        want = {(int(ats[i]), w) for i in range(len(own)) for w in range(len(prints)) if (int(own[i]) ^ int(prints[w])).bit_count() <= radius}
        assert {(i, w) for i, w, _ in items._candidates(n, prints)} == want and want


def labelled(spark, n=600):
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(n):
        bad = rng.random() < 0.3
        words = [f"w{rng.randrange(3000)}" for _ in range(60)] + (rng.sample(["vile", "nasty", "awful", "rotten"], 2) if bad else [])
        rng.shuffle(words)
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(bad)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_on_held_out(spark):
    docs, labels = labelled(spark)
    got = toxicity.judge(docs, labels).join(labels, "doc_id").filter("held_out").collect()
    assert len(got) > 80 and sum(r["predicted"] != r["toxic"] for r in got) <= 3
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    assert any(r["evidence"] for r in got)


def test_labels_of_held_out_rows_teach_nothing(spark):
    docs, labels = labelled(spark, 300)
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    score = lambda x: {r["doc_id"]: r["score"] for r in toxicity.judge(docs, x).collect()}
    assert score(labels) == score(flipped)


def test_toxicity_edges(spark):
    docs, labels = labelled(spark, 200)
    odd = spark.createDataFrame([(10**6, None), (10**6 + 1, ""), (None, "vile nasty awful"), (10**6, "***"), (1, "vile " * 20_000)], "doc_id long, text string")
    got = toxicity.judge(docs.unionByName(odd).withColumn("score", F.lit("clash")), labels.unionByName(spark.createDataFrame([(None, 1, 1), (10**6, None, None), (0, 1, 0)], labels.schema)))
    assert got.count() == 205 and got.filter("score is null or score < 0 or score > 1").count() == 0
    one = toxicity.judge(docs, labels.filter("toxic = 0")).agg(F.max("score")).first()[0]
    assert one == 0.0 and toxicity.judge(docs, labels.limit(0)).agg(F.max("score")).first()[0] == 0.0
    assert toxicity.judge(docs.limit(0), labels).count() == 0
    kept = toxicity.keep_clean(docs.withColumn("score", F.lit(1)), labels)
    assert kept.columns == ["doc_id", "text", "score"]


def test_isotonic():
    x, y = toxicity.isotonic(np.array([0.1, 0.2, 0.3, 0.4]), np.array([0.0, 1.0, 0.0, 1.0]))
    assert list(y) == [0.0, 0.5, 1.0] and list(np.round(x, 3)) == [0.1, 0.25, 0.4]


def test_pipeline_stages(spark, small):
    docs = table(spark, small, "documents")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    seen = [set(texts)]
    for name, stage in corpus_pipeline.STAGES:
        out = written(stage(spark, docs, small))
        if name != "mixing":
            assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
            docs = out
        seen.append({r["doc_id"] for r in out.select("doc_id").collect()})
        assert seen[-1] <= seen[-2]
    assert all(len(texts[d].split()) >= 50 for d in seen[1])
    groups = brute.components([(d, texts[d]) for d in seen[2]], 5, 80)
    assert seen[3] == {d for d in seen[2] if groups[d][1] == d}
    items = [(r["item_id"], r["text"]) for r in table(spark, small, "benchmark").collect()]
    assert seen[4] == seen[3] - {d for d, _ in dense_leaks(items, [(d, texts[d]) for d in seen[3]])}
    assert out.columns == ["doc_id", "source", "size", "copy", "words", "moment"]
    total = out.agg(F.sum("words")).first()[0]
    kept = sum(len(brute.words(texts[d])) for d in seen[4])
    assert abs(total - kept) <= 20
    assert corpus_pipeline.run(spark, small).count() == out.count()
