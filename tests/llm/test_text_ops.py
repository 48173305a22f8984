"""Quality rules, mixing, token counts, chat and shingle hashes against plain Python."""

import hashlib
import random
from collections import Counter, defaultdict

import brute
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from headway.llm import chat, mixing, quality, shingles, tokens
from headway.llm.base import shared_dir, table, written

HARD = [None, "", " \n\t", "a", "a b", "a b c", "a b c a b c", "x\n\nx\nx \n", "é à # $ % &", "the " * 5000, "w\x0bv\x0cu", "\u00a0 \u2003", "a b a b a b"]


def documents(spark, texts, extra=""):
    rows = [(i, t, f"src{i % 3}" if i % 5 else None) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({c: F.lit("clash") for c in extra.split()})


def test_quality_counts(spark, small):
    docs = documents(spark, HARD, "n_words kept _row _text").select("doc_id", "text", "n_words", "kept").unionByName(table(spark, small, "documents").select(F.col("doc_id") + 1000, "text", F.lit("").alias("n_words"), F.lit("").alias("kept")).toDF("doc_id", "text", "n_words", "kept"))
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in quality.judge(docs).collect():
        t = texts[r["doc_id"]] or ""
        w = brute.words(t)
        assert r["n_words"] == len(w) and r["word_chars"] == sum(map(len, w))
        assert r["n_symbols"] == sum(c in "#*$%&|<>" for c in t)
        assert r["n_dup_lines"] == brute.repeated_lines(t)
        assert r["n_repeat_words"] == brute.repeated_words(t)
        assert r["base_failed"] == (len(w) < 50 or 100 * r["n_repeat_words"] > 50 * len(w))
        assert not (r["kept"] and r["base_failed"])


def test_quality_keeps_labelled_good_and_columns(spark, small):
    docs = table(spark, small, "documents")
    judged = quality.judge(docs).join(table(spark, small, "labels"), "doc_id")
    assert judged.filter("quality = 1 and not base_failed and not kept").count() == 0
    assert judged.filter("quality = 0 and kept").count() == 0
    kept = quality.keep_good(docs)
    assert kept.schema == docs.schema and kept.count() == quality.judge(docs).filter("kept").count()
    assert quality.keep_good(docs.limit(0)).count() == 0


def python_targets(sizes, weights, repeats):
    left, done = dict(sizes), {}
    total = sum(sizes.values())
    while left:
        level = (total - sum(done.values())) / sum(weights[s] for s in left)
        over = [s for s in left if level * weights[s] > repeats * sizes[s]]
        if not over:
            return done | {s: level * weights[s] for s in left}
        done |= {s: float(repeats * left.pop(s)) for s in over}
    return done


@pytest.mark.parametrize("shape", ["even", "tiny", "hot"])
def test_mix_meets_targets(spark, shape):
    rng = random.Random(shape)
    rows = []
    for i in range(400):
        source = {"even": f"s{i % 7}", "tiny": "abc"[min(2, i // 3)], "hot": "hot" if i % 3 else f"s{i % 11}"}[shape]
        rows.append((i, "w " * rng.choice([0, 1, 30, 400]), None if i % 13 == 0 else source))
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r["doc_id"]: r for r in mixing.shares(docs.repartition(5)).collect()}
    size, taken = defaultdict(int), defaultdict(int)
    for i, text, source in rows:
        assert got[i]["size"] == len(text.split()) and got[i]["taken"] <= 3 * got[i]["size"]
        size[source] += got[i]["size"]
        taken[source] += got[i]["taken"]
    order = sorted(size, key=lambda s: (s is None, s))
    want = python_targets(size, {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}, 3)
    for i, _, source in rows:
        assert got[i]["source_size"] == size[source] and got[i]["target"] == pytest.approx(want[source])
    assert all(abs(taken[s] - want[s]) <= 1 for s in order)
    again = {r["doc_id"]: r["taken"] for r in mixing.shares(docs.repartition(3)).collect()}
    assert again == {i: r["taken"] for i, r in got.items()}


def test_mix_follows_the_curriculum(spark):
    rows = [(i, "w " * 10, f"s{i % 3}") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    order = mixing.mix(docs).collect()
    assert all(a["moment"] <= b["moment"] for a, b in zip(order, order[1:], strict=False))
    words = Counter()
    for r in order:
        words[r["source"], r["moment"] >= 0.5] += r["words"]
    for s, (first, second) in {"s0": (6, 4), "s1": (1.5, 2.5), "s2": (0.5, 1.5)}.items():
        assert words[s, False] / (words[s, False] + words[s, True]) == pytest.approx(first / (first + second), abs=0.02)


def test_mix_of_nothing(spark):
    docs = spark.createDataFrame([(1, None, "a"), (2, "", None), (2, "", None)], "doc_id long, text string, source string")
    assert [r["taken"] for r in mixing.shares(docs).collect()] == [0, 0, 0]
    assert mixing.shares(docs.limit(0)).count() == 0 and mixing.mix(docs).count() == 0


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "piece_bpe_32k.model", "byte_bpe_50k.tiktoken"])
def test_token_counts(spark, small, name):
    path, cache = public_tokenizers.path(name), shared_dir(spark)
    texts = [*HARD, "a<|endoftext|>b <|startoftext|>", "<|ENDOFTEXT|>", "  Two\t words\n", "ΑΣ Σ e\u0301"] * 2
    docs = documents(spark, texts)
    collapse = name.endswith(".json")
    got = {r["doc_id"]: r for r in tokens.count(docs, path, cache, collapse=collapse).collect()}
    if collapse:
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        plain = lambda t: len(tok.encode(t, add_special_tokens=False).ids)
    else:
        plain = lambda t: tokens._counter(path)([t])[0]
    for i, t in enumerate(texts):
        n = plain(t or "")
        assert tuple(got[i])[1:] == (len((t or "").encode()), n, n > 2048)


def test_only_misses_are_encoded(spark):
    path, cache = public_tokenizers.path("word_bpe_49k.json"), shared_dir(spark)
    docs = documents(spark, ["a b", "a  b ", "c", None])
    tokens.fill_cache(docs, path, cache)
    assert spark.read.parquet(cache).count() == 3
    tokens.fill_cache(documents(spark, ["c", "d", "d"]), path, cache)
    assert spark.read.parquet(cache).count() == 4
    spark.read.parquet(cache).write.mode("append").partitionBy("tokenizer").parquet(cache + "-twice")
    spark.read.parquet(cache).write.mode("append").partitionBy("tokenizer").parquet(cache + "-twice")
    assert tokens.count(docs, path, cache + "-twice").count() == 4
    assert tokens.count(docs.limit(0), path, cache).count() == 0


def conversations():
    roles = ["system", "user", "assistant", "tool"]
    rows = [(7, i, roles[i % 4] if i < 2 else roles[1 + i % 3], ("\\i<|im_end|>\\\\ x\n" * (i % 7)) + "é<" * i) for i in range(600)]
    rows += [(8, 0, None, None), (None, None, "assistant", "<|im_start|>assistant\n"), (None, 1, "a\nb", "\\n")]
    rows += [(9, 3, "assistant", "a"), (9, 3, "assistant", "a"), (9, 1, "sys\ntem\\", "|im_end|>"), (10, 0, "system", "s" * 9000), (10, 1, "assistant", "b")]
    return rows


@pytest.mark.parametrize(("budget", "turns", "tokens_"), [(2048, 2, 512), (100, 3, 40), (10, 1, 5), (50, 0, 0)])
def test_chat_round_trip(spark, budget, turns, tokens_):
    rows = conversations()
    made = written(chat.windows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), budget, turns, tokens_))
    want = defaultdict(list)
    for c, turn, role, text in rows:
        want[c].append((turn if turn is not None else -1, role or "", text or ""))
    got = {r["conv_id"]: r for r in chat.digests(made).collect()}
    assert got.keys() == want.keys()
    for c, said in want.items():
        said.sort()
        loss = "".join(t for _, role, t in said if role == "assistant")
        assert got[c]["n_turns"] == len(said)
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in said).encode()).hexdigest()
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    for r in made.collect():
        new = [t for t in r["turns"] if not t["repeated"]]
        assert new and all(not t["loss"] for t in r["turns"] if t["repeated"])
        assert len(r["turns"]) - len(new) <= turns + 1
        text = r["formatted"].split("<|im_start|>")[1:]
        cost = [len(t.split("\n", 1)[1].encode()) // 4 for t in text]
        assert len(new) == 1 or sum(cost[len(r["turns"]) - len(new) :]) <= budget
    assert chat.windows(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_system_turn_stays(spark):
    rows = [(1, 0, "system", "be kind")] + [(1, i, "user" if i % 2 else "assistant", "x" * 300) for i in range(1, 30)]
    made = chat.windows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), 400, 1, 100).collect()
    assert len(made) > 5 and all(r["formatted"].startswith("<|im_start|>system\nbe kind<|im_end|>\n") for r in made)


def test_shingle_hashes():
    texts = ["", "a", "A b\tc  d ", "a b", "\n\n", "é A", "x" * 70_000 + " b", "c d", " a", "a ", "b c d a"]
    hashes = list(shingles.each_text(pa.array(texts, pa.string()).slice(0)))
    seen = {}
    for text, own in zip(texts, hashes, strict=True):
        w = brute.words(text.translate(brute.LOWER))
        assert len(w) == len(own)
        assert all(seen.setdefault(a, b) == b for a, b in zip(w, own, strict=True))
    assert len(set(seen.values())) == len(seen)
    assert len(np.intersect1d(shingles.shingles(hashes[2], 3), shingles.shingles(hashes[10], 3))) == 1
    assert [len(x) for x in shingles.each_text(pa.array(["z z", "y"], pa.string()).slice(1))] == [1]
