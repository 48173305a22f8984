"""Tables in the folder that all executors share (``spark.checkpoint.dir``)."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a few numbers that are broadcast at most.
BROADCAST_ROWS = 1_000_000


def shared(spark: SparkSession, kind: str = "table") -> str:
    """A new folder name there.

    Where the setting is missing, a temporary folder takes its place if
    everything runs on this machine; other clusters raise, as their executors
    would write where nobody else can read.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="headway-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table there: computed once, read often, cut from its lineage."""
    path = shared(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def released(spark: SparkSession) -> None:
    """Lets Spark remove the shuffle files of plans that are done, as it does once the driver's garbage is collected; else those of all steps add up."""
    gc.collect()
    spark._jvm.System.gc()


def small(df: DataFrame) -> DataFrame:
    """``df`` (a written table of narrow rows) marked for broadcast if it has few enough of them."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df
