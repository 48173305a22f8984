"""Tables laid out by trip, so that joins and windows by trip move no rows.

Stop times and trips are written in buckets of their trip, stop times sorted by
it and their sequence. What reads them through the catalog is already spread by
trip: the join of both, the windows over a trip's stop times and its grouping into
legs and schedules all run bucket by bucket. A conversion of many days or windows
over one feed so shuffles stop times once, when they are written.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

BUCKETED = {"stop_times": ("trip_id", "stop_sequence"), "trips": ("trip_id",)}


def save_by_trip(tables: dict[str, DataFrame], prefix: str, buckets: int) -> None:
    """Saves typed feed tables as catalog tables ``prefix_name``; those of :data:`BUCKETED` in ``buckets`` buckets by trip."""
    for name, df in tables.items():
        if name in BUCKETED:
            # One file a bucket: rows are spread by the buckets' own hash first.
            spread = df.repartition(buckets, "trip_id")
            spread.write.mode("overwrite").bucketBy(buckets, "trip_id").sortBy(*BUCKETED[name]).saveAsTable(f"{prefix}_{name}")
        else:
            df.write.mode("overwrite").saveAsTable(f"{prefix}_{name}")


def read_by_trip(spark: SparkSession, prefix: str, names: tuple[str, ...]) -> dict[str, DataFrame]:
    return {name: spark.table(f"{prefix}_{name}") for name in names}


def laid_out(tables: dict[str, DataFrame], buckets: int) -> dict[str, DataFrame]:
    """The tables saved under a new name and read again."""
    spark, prefix = next(iter(tables.values())).sparkSession, f"feed_{uuid.uuid4().hex}"
    save_by_trip(tables, prefix, buckets)
    return read_by_trip(spark, prefix, tuple(tables))
