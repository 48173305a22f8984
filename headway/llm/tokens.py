"""Token counts through a digest cache.

The cache is a table (tokenizer, content, n_tokens): the digest of the
tokenizer's file, the digest of a text after normalisation, and its count. A run

1. digests every text, and writes (doc_id, bytes, digest, row key), the row key
   being a hash of doc_id and digest;
2. groups the digests, so that of each content that the cache lacks the rows with
   the least key, equal rows, are to be encoded, once a task;
3. encodes where the texts lie and appends the counts to the cache. The rows that
   are not to be encoded (copies, and contents in the cache) are left out by key;
4. joins the counts to the rows by digest.

Scale: no text is shuffled while the rows to leave out are at most
``base.BROADCAST_ROWS`` keys, which are broadcast; beyond that they are matched by
a join on the key. Digests are grouped with partial sums, and the contents with
most rows are joined by broadcast, so a content that a third of all rows share is
in no one's shuffle. Counts are those of the library for the whole text; a task
hands over at most about ``CHUNK_CHARS`` characters at once, or one text.

Normalisation turns runs of ASCII white space into one blank and trims, which
no supported tokenizer of kind ``.json`` with white space dropped can tell
apart; pass ``collapse=False`` for the others.

Null texts are empty and have no tokens. Very long texts are counted whole.
Repeated rows each get their row; a null doc_id stays null. An empty table gives
no rows. Columns besides doc_id and the text are ignored, so names cannot clash.
An append that is retried only adds equal counts, which are grouped on reading.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from headway.llm.base import WHITE, WHITE_RE, join_counted, small, written

CONTEXT = 2048
#: Characters that one call of the library gets, so its offsets and strings stay small.
CHUNK_CHARS = 400_000
#: Digests that a task remembers to encode equal rows once.
MEMO = 100_000


@functools.cache
def _counter(path: str):
    """A function from texts to counts, loaded once per worker. The library is told by the file's suffix."""
    if path.endswith(".json"):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        return lambda texts: [len(e.ids) for e in tok.encode_batch_fast(texts, add_special_tokens=False)]
    if path.endswith(".model"):
        import sentencepiece

        tok = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(ids) for ids in tok.encode(texts, num_threads=1)]
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    tok = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return lambda texts: [len(tok.encode_ordinary(t)) for t in texts]


def tokenizer_digest(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def content(text: Column, collapse: bool = True) -> Column:
    body = F.coalesce(text, F.lit(""))
    return F.regexp_replace(F.btrim(body, F.lit(WHITE)), WHITE_RE, " ") if collapse else body


def content_digest(normal: Column) -> Column:
    return F.unhex(F.sha2(normal, 256))


def encoded(texts: DataFrame, path: str) -> DataFrame:
    """Of (content, body): (content, n_tokens)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, seen = _counter(path), set()
        for batch in batches:
            # Equal rows have one key, so all of them come; in a task one is enough.
            new = [i for i, c in enumerate(batch.column("content").to_pylist()) if c not in seen and not seen.add(c)]
            batch = batch.take(pa.array(new, pa.int64()))
            if len(seen) > MEMO:
                seen.clear()
            bodies, counts, chunk, size = batch.column("body").to_pylist(), [], [], 0
            for body in bodies:
                chunk.append(body)
                size += len(body)
                if size >= CHUNK_CHARS:
                    counts += count(chunk)
                    chunk, size = [], 0
            counts += count(chunk) if chunk else []
            yield pa.RecordBatch.from_arrays([batch.column("content"), pa.array(counts, pa.int64())], ["content", "n_tokens"])

    return texts.select("content", "body").mapInArrow(run, "content binary, n_tokens long")


def read_cache(spark, cache: str, tokenizer: str) -> DataFrame:
    """One count for each content of a tokenizer; empty where nothing is stored yet."""
    path = spark._jvm.org.apache.hadoop.fs.Path(cache)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], "content binary, n_tokens long")
    stored = spark.read.schema("content binary, n_tokens long, tokenizer string").parquet(cache)
    return stored.filter(F.col("tokenizer") == tokenizer).groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))


def keyed(docs: DataFrame, text: str = "text", collapse: bool = True) -> DataFrame:
    """doc_id, n_bytes, body (normalised), content and _row (a hash of doc_id and content) of every row."""
    rows = docs.select("doc_id", F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), content(F.col(text), collapse).alias("body"))
    return rows.withColumn("content", content_digest(F.col("body"))).withColumn("_row", F.xxhash64("doc_id", "content"))


def fill_cache(docs: DataFrame, path: str, cache: str, text: str = "text", collapse: bool = True) -> tuple[DataFrame, DataFrame]:
    """Encodes the distinct contents that the cache lacks and appends their counts.

    Returns the rows (doc_id, n_bytes, content), and the contents with their number of rows.
    """
    tokenizer = tokenizer_digest(path)
    rows = written(keyed(docs, text, collapse).drop("body"))
    stored = read_cache(docs.sparkSession, cache, tokenizer).select("content", F.lit(True).alias("_stored"))
    groups = rows.groupBy("content").agg(F.count("*").alias("_rows"), F.min("_row").alias("_first")).join(stored, "content", "left")
    groups = written(groups.withColumn("_stored", F.coalesce("_stored", F.lit(False))))
    # Left out: rows of stored contents, and all but the first of others. A hash that two rows share leaves both in if one is needed.
    marked = join_counted(rows.select("content", "_row"), written(groups.filter("_rows > 1 or _stored")), "content")
    spare = marked.groupBy("_row").agg(F.min(F.coalesce(F.col("_stored") | (F.col("_row") != F.col("_first")), F.lit(False))).alias("_spare")).filter("_spare").select("_row")
    missing = keyed(docs, text, collapse).join(small(written(spare)), "_row", "left_anti")
    encoded(missing, path).withColumn("tokenizer", F.lit(tokenizer)).write.mode("append").partitionBy("tokenizer").parquet(cache)
    return rows, groups.select("content", "_rows")


def count(docs: DataFrame, path: str, cache: str, limit: int = CONTEXT, collapse: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every row; fills ``cache`` first."""
    rows, groups = fill_cache(docs, path, cache, "text", collapse)
    stored = read_cache(docs.sparkSession, cache, tokenizer_digest(path))
    known = written(groups.join(stored, "content"))
    return join_counted(rows, known, "content").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
