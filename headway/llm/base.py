"""What the corpus operators share: words, tables and the shared scratch folder."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space; everything between it is a word.
WHITE = " \t\n\x0b\x0c\r"
WHITE_RE = r"[\x20\x09-\x0D]+"
WORD_RE = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def plainly_named(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with columns ``_c0``, ``_c1``, ... that clash with nothing, and those names by the columns' own."""
    names = {c: f"_c{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def named_back(rows: DataFrame, names: dict[str, str]) -> DataFrame:
    return rows.select(*[F.col(short).alias(c) for c, short in names.items()])


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """The words of a text, in order; none for null."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(WHITE))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, WHITE_RE))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_RE)), F.lit(0)).cast("long")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def shared_dir(spark: SparkSession) -> str:
    """A new folder name under the folder that all executors share.

    The cluster names that folder in ``spark.checkpoint.dir``. Where it is unset
    a temporary folder takes its place if everything runs on this machine; other
    clusters raise, as their executors would write where nobody else can read.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="headway-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder: computed once, and cut from its lineage."""
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def released(spark: SparkSession) -> None:
    """Lets Spark remove the shuffle files of plans that are done, as it does once the driver's garbage is collected; else those of all rounds add up."""
    gc.collect()
    spark._jvm.System.gc()


#: Rows of a few numbers that are broadcast at most; the most frequent keys that a join leaves out of its shuffle.
BROADCAST_ROWS, HOT_KEYS = 1_000_000, 10_000


def small(df: DataFrame) -> DataFrame:
    """``df`` (a written table of narrow rows) marked for broadcast if it has few enough of them."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def join_counted(rows: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """``rows`` left joined to ``known`` (key, _rows, ...; one row a key, _rows of ``rows`` have it); both are written tables.

    The ``HOT_KEYS`` keys with most rows are broadcast, so a key with a third of
    all rows stays where it lies; each of the others has at most one in
    ``HOT_KEYS`` of all rows, and those meet by a shuffle.
    """
    hot = known.orderBy(F.desc("_rows"), key).limit(HOT_KEYS)
    if known.count() <= HOT_KEYS:
        return rows.join(F.broadcast(known.drop("_rows")), key, "left")
    hot = written(hot)
    cold = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(known.drop("_rows"), key, "left")
    return rows.join(F.broadcast(hot.drop("_rows")), key).unionByName(cold)
