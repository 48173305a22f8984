"""The table of prefixes against the library whose ids it must give."""

import hashlib
import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from headway.llm import pieces
from headway.llm.base import table
from headway.llm.queries import op11_sentencepiece

PATH = public_tokenizers.path("piece_bpe_32k.model")
PARTS = ["a", "b", "the", " ", "  ", "   ", "\n", "\t", "é", "日", "本語", "▁", "▁▁", "ﬁ", "①", "\0", "\xa0", "\x85", "😀", "<s>", "</s>", "<0x0A>", "<unk>", "ing", "tion", "22", "।", "﻿", "‍", "é", "aaaa", "abab", "한국", "...", "م"]


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def expected(library, text):
    ids = library.encode(text or "")
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return len(ids), digest(",".join(map(str, ids))), digest(library.decode(ids))


def test_odd_texts_have_the_librarys_ids(library):
    rng, own = random.Random(11), pieces.model(PATH)
    for _ in range(5000):
        text = "".join(rng.choice(PARTS) for _ in range(rng.randint(0, 30)))
        ids = own.encode(text)
        assert ids == library.encode(text) and own.decode(ids) == library.decode(ids), repr(text)
        assert own.digests(text) == expected(library, text)


@pytest.mark.parametrize("text", ["x" * 50_000, "aaab" * 10_000, "日本" * 10_000, "ab " * 40_000, " " * 20_000])
def test_long_texts_and_ties(library, text):
    assert pieces.model(PATH).digests(text) == expected(library, text)


def test_each_prefix_has_the_last_token_of_its_own_encoding(library):
    own = pieces.model(PATH)
    for word in ("▁internationalization", "▁aaaaaaa", "▁▁▁▁x", "▁日本語x"):
        for end, last in enumerate(own.last_tokens(word)):
            assert last == pieces.UNKNOWN or own.pieces[last] == own.joined(word[: end + 1])[-1]


def test_memos_may_be_cleared_at_any_time(library, monkeypatch):
    monkeypatch.setattr(pieces, "MEMO", 3)
    monkeypatch.setattr(pieces, "RUN_WORDS", 2)
    own = pieces.Model(PATH)
    for text in ("one two three four five six seven", " two  spaces in front", "one"):
        assert own.digests(text) == expected(library, text) and len(own.words) <= 3


def test_other_normalisations_are_refused():
    with pytest.raises(Exception):  # noqa: B017
        pieces.Model(public_tokenizers.path("byte_bpe_50k.json"))


def test_query_gives_the_librarys_digests(spark, library, small):
    texts = {r["doc_id"]: r["text"] for r in table(spark, small, "documents").collect()}
    rows = op11_sentencepiece(spark, small).collect()
    assert len(rows) == len(texts)
    assert all((r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == expected(library, texts[r["doc_id"]]) for r in rows)


def test_nulls_repeats_clashing_columns_and_round_trip(spark, library):
    given = [(1, None), (2, ""), (3, "a b"), (3, "a b"), (None, " x\n"), (4, "y" * 300_000)]
    docs = spark.createDataFrame(given, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("ids", "n_tokens", "ids_sha256")})
    key = lambda r: str(r)
    assert sorted(map(tuple, pieces.digests(docs, PATH).collect()), key=key) == sorted([(i, *expected(library, t)) for i, t in given], key=key)
    back = pieces.decoded(pieces.encoded(docs, PATH), PATH)
    assert sorted(map(tuple, back.collect()), key=key) == sorted([(i, t or "") for i, t in given], key=key)
    assert pieces.digests(docs.limit(0), PATH).count() == 0
