"""Stop times that arrive as files: the same window rule on a stream.

An addition for live feeds: rows are joined to the (static) kept trips, filtered
like in a batch, and counted by mode and hour of departure.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from headway.operators import services


def hourly(stop_times: DataFrame, trips: DataFrame, periods: list[tuple[int, int]]) -> DataFrame:
    """(mode, hour, n) of a stream (or table) of stop times inside the periods."""
    rows = services.with_trips(stop_times, trips).filter(services.in_window(periods))
    return rows.groupBy("mode", F.floor(F.col("dep") / 3600).alias("hour")).agg(F.count("*").alias("n"))
