"""Null doc_ids, very long texts, clashing columns, repeated rows and empty tables, operator by operator."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from headway.llm import chat, jaccard, mixing, quality, tokens, warc
from headway.llm.base import join_counted, shared_dir, table, written

DOCS = "doc_id long, text string, source string"


def test_mix_with_null_and_repeated_ids_long_texts_and_clashes(spark):
    long = "word " * 400_000
    rows = [(None, f"a b c{i}", "x") for i in range(300)] + [(7, f"d e f{i}", "x") for i in range(300)] + [(8, "same text", None)] * 5 + [(9, long, "y")]
    docs = spark.createDataFrame(rows, DOCS).withColumns({"size": F.lit("s"), "target": F.lit("t"), "_key": F.lit(1), "copies": F.lit(2)})
    got = mixing.shares(docs).collect()
    assert len(got) == len(rows) and {r["size"] for r in got if r["doc_id"] == 9} == {400_000}
    assert all(0 <= r["taken"] <= 3 * r["size"] for r in got)
    for size in {r["source_size"] for r in got}:
        of = [r for r in got if r["source_size"] == size]
        assert abs(sum(r["taken"] for r in of) - of[0]["target"]) <= 1
    slim = mixing.assign(docs)
    assert slim.count() == len(rows)
    # Rows without doc_id get places of their own instead of one slice.
    at = docs.filter("doc_id is null").select(F.pmod(F.xxhash64(F.lit(17), "doc_id", "text"), F.lit(mixing.BUCKETS)).alias("b")).distinct().count()
    assert at > 200


def test_token_counts_of_long_texts_and_clashing_columns(spark):
    path, cache = public_tokenizers.path("word_bpe_49k.json"), shared_dir(spark)
    from tokenizers import Tokenizer

    long = "A few words, and then some more. " * 20_000
    assert len(long) > tokens.CHUNK_CHARS
    rows = [(1, long), (None, long), (2, "a b"), (2, "a b"), (None, "a  b"), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"content": F.lit("c"), "n_tokens": F.lit("n"), "body": F.lit("b"), "_row": F.lit(1)})
    got = sorted(map(tuple, tokens.count(docs, path, cache).collect()), key=repr)
    tok = Tokenizer.from_file(path)
    n = lambda t: len(tok.encode(t or "", add_special_tokens=False).ids)
    assert got == sorted([(i, len((t or "").encode()), n(t), n(t) > 2048) for i, t in rows], key=repr)
    assert spark.read.parquet(cache).groupBy("content").count().count() == 3


def test_a_second_run_encodes_only_what_is_new(spark, monkeypatch):
    path, cache = public_tokenizers.path("word_bpe_49k.json"), shared_dir(spark)
    seen = []
    plain = tokens.encoded
    monkeypatch.setattr(tokens, "encoded", lambda texts, p: seen.append(texts.count()) or plain(texts, p))
    docs = spark.createDataFrame([(i, f"text {i % 5}") for i in range(20)], "doc_id long, text string")
    assert tokens.count(docs, path, cache).count() == 20
    more = docs.unionByName(spark.createDataFrame([(99, "text 77"), (98, "text 77")], docs.schema))
    assert tokens.count(more, path, cache).count() == 22
    assert tokens.count(more, path, cache).filter("n_tokens is null").count() == 0
    assert seen == [5, 1, 0]


def test_joins_beside_hot_keys(spark, monkeypatch):
    from headway.llm import base

    monkeypatch.setattr(base, "HOT_KEYS", 2)
    rows = written(spark.range(100).select(F.when(F.col("id") < 60, 0).when(F.col("id") < 80, 1).otherwise(F.col("id")).alias("k"), "id"))
    known = written(rows.groupBy("k").agg(F.count("*").alias("_rows"), (F.first("k") * 2).alias("v")).filter("k <> 85"))
    got = join_counted(rows, known, "k").collect()
    assert len(got) == 100 and all(r["v"] == (None if r["k"] == 85 else 2 * r["k"]) for r in got)


def test_chat_with_clashing_columns(spark):
    rows = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", "x" * 20_000), (1, 1, "assistant", "again")], "conv_id long, turn long, role string, text string")
    clash = rows.withColumns({"window": F.lit("w"), "rank": F.lit(1), "tokens": F.lit("t"), "system": F.lit(0)})
    pick = lambda df: sorted(map(tuple, chat.digests(chat.windows(df)).collect()))
    assert pick(clash) == pick(rows) and pick(rows)[0][1] == 3


def test_quality_of_very_long_lines(spark):
    line = " ".join(f"the word {i}" for i in range(60_000))
    docs = spark.createDataFrame([(1, line), (2, "\n".join([line] * 2))], "doc_id long, text string").withColumn("n_words", F.lit("clash"))
    got = {r["doc_id"]: r for r in quality.judge(docs).collect()}
    assert (got[1]["n_words"], got[1]["n_dup_lines"], got[1]["n_repeat_words"]) == (180_000, 0, 0)
    assert (got[2]["n_words"], got[2]["n_dup_lines"]) == (360_000, 1) and got[2]["base_failed"]


def test_jaccard_of_very_long_texts(spark):
    base = [f"w{i}" for i in range(120_000)]
    near = list(base)
    near[60_000] = "other"
    docs = spark.createDataFrame([(4, " ".join(base)), (2, " ".join(near)), (3, "short text of five words")], "doc_id long, text string").withColumn("digest", F.lit(1))
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.join(docs).collect()} == {4: (119_998, 2), 2: (119_998, 2), 3: (3, 3)}


@pytest.fixture
def corpus(spark, tmp_path):
    """A small copy of the tables with null columns, repeated rows and clashing extra columns."""
    small = "/root/testdata/sf0.001"
    docs = table(spark, small, "documents")
    nulls = spark.createDataFrame([(None, None, None, None, None), (None, "a b", "en", None, 3)], docs.schema)
    some = docs.limit(40)
    docs = docs.unionByName(some).unionByName(nulls).unionByName(some.limit(3).withColumn("doc_id", F.lit(None).cast("long")))
    docs.withColumns({"kept": F.lit("k"), "score": F.lit("s"), "_row": F.lit(0), "component_id": F.lit("c")}).write.parquet(f"file://{tmp_path}/documents.parquet")
    for name in ("labels", "benchmark"):
        table(spark, small, name).write.parquet(f"file://{tmp_path}/{name}.parquet")
    return f"file://{tmp_path}"


def test_stages_with_nulls_repeats_and_clashes(spark, corpus):
    docs = table(spark, corpus, "documents")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, written(stage(spark, docs, corpus))
        assert docs.columns == columns, name
        assert docs.exceptAll(before).count() == 0, name
    texts = [r["text"] for r in docs.select("text").collect()]
    assert texts and len(texts) == len(set(texts))  # of repeated rows one stays
    assert corpus_pipeline.run(spark, corpus).count() > 0


def test_stages_of_an_empty_table(spark, corpus, tmp_path):
    docs = table(spark, corpus, "documents").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, corpus))
        assert docs.count() == 0, name


def test_many_null_and_equal_doc_ids_cost_what_others_do(spark):
    """Pairs of near copies, every row with one and the same doc_id, or with none: as many texts are looked at as with ids."""
    import time

    word = lambda i, k: f"w{(i * 7919 + k * 104729) % 1_000_003}"
    texts = [" ".join(word(i // 2, k) for k in range(60)) + (" tail" if i % 2 else "") for i in range(6000)]
    took = {}
    for name, ids in (("own", range(6000)), ("null", [None] * 6000), ("same", [5] * 6000)):
        docs = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string")
        began = time.perf_counter()
        rows = jaccard.join(docs).collect()
        took[name] = time.perf_counter() - began
        assert len(rows) == 6000
        if name == "own":
            assert all(r["component_id"] == r["doc_id"] - r["doc_id"] % 2 for r in rows)
        else:
            assert {r["component_id"] for r in rows} == {ids[0]}
    assert max(took["null"], took["same"]) < 3 * took["own"] + 10


def test_repeated_rows_give_their_set_once_a_task(spark):
    from headway.llm.base import written

    docs = spark.createDataFrame([(None, "a b c d")] * 500 + [(None, "e f g h")] * 5, "doc_id long, text string").coalesce(2)
    rows = jaccard.profiles(docs, 3, 90)
    wanted = written(rows.groupBy("digest").agg(F.first("key").alias("key")).withColumn("cid", F.monotonically_increasing_id()))
    assert jaccard._sets(docs, wanted, 3).count() <= 4


def test_equal_rows_are_mixed_as_one_until_their_places_are_known(spark):
    docs = spark.createDataFrame([(None, "one two three", "s")] * 3000 + [(i, f"text number {i}", "s") for i in range(3000)], "doc_id long, text string, source string")
    rows = mixing.shares(docs).collect()
    assert len(rows) == 6000 and sum(r["taken"] for r in rows) == 18_000 and {r["taken"] for r in rows} == {3}
    order = mixing.mix(docs).collect()
    assert len(order) == 6000 and [r["moment"] for r in order] == sorted(r["moment"] for r in order) and len({r["moment"] for r in order}) == 6000


def test_pages_that_repeat_the_first_id_and_payload_are_all_responses(spark):
    pages = spark.createDataFrame([(1, "u", "x"), (1, "u", "x"), (2, "u", "x"), (None, "u", "x")], "page_id long, url string, html string")
    got = sorted((r["page_id"] or -1, r["record_type"], r["refers_to"]) for r in warc.round_trip(pages).collect())
    assert got == [(-1, "revisit", 1), (1, "response", None), (1, "response", None), (2, "revisit", 1)]
