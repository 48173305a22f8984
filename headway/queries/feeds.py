"""Queries on feeds as zips and files: parts, quoted line feeds, all 17 tables, handlers, and tables laid out by trip."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from headway.plans.services import Services, ServicesConfig, from_feed
from headway.queries import intermodal, services
from headway.queries.adapter import duckdb, spark_tables
from headway.sources import archives, layout, schema
from headway.sources.feed import Feed
from headway.sources.handlers import Counting, Handlers
from headway.sources.tables import shared

#: The table whose rows make each table of a feed, and their number.
MADE_OF = {
    "agency": ("nation", "n_nationkey"), "attributions": ("nation", "n_nationkey"), "calendar": ("nation", "n_nationkey"), "calendar_dates": ("nation", "n_nationkey"),
    "fare_attributes": ("supplier", "s_suppkey"), "fare_rules": ("customer", "c_custkey"), "feed_info": ("region", "r_regionkey"), "frequencies": ("orders", "o_orderkey"),
    "levels": ("region", "r_regionkey"), "pathways": ("part", "p_partkey"), "routes": ("customer", "c_custkey"), "shapes": ("part", "p_partkey"), "stop_times": ("lineitem", "l_orderkey * 10 + l_linenumber"),
    "stops": ("supplier", "s_suppkey"), "transfers": ("supplier", "s_suppkey"), "translations": ("nation", "n_nationkey"), "trips": ("orders", "o_orderkey"),
}


def _all_tables(spark: SparkSession, sf_dir: str) -> str:
    """A zip with every table of the format, each field made of its row's and its column's number."""
    folder = shared(spark, "feed")
    for name, (source, key) in MADE_OF.items():
        rows = spark.read.parquet(f"{sf_dir}/{source}.parquet").select(F.expr(key).alias("_k"))
        fields = [F.concat(F.lit(f'{c} "'), (F.col("_k") % (7 + i)).cast("string"), F.lit('", x')).alias(c.upper()) for i, c in enumerate(schema.COLUMNS[name])]
        rows.select(*fields, F.lit("?").alias("Odd One")).write.csv(f"{folder}/{name}.txt", header=True, quote='"', escape='"', compression="gzip")
    place = archives.packed(spark, folder, f"{folder}.zip")
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)  # its tables are in the zip now
    return place


def feed_all_tables(spark, sf_dir):
    """Of each table of a zip: rows, columns, letters in all fields, distinct values of the last column."""
    feed, out = Feed(spark, _all_tables(spark, sf_dir)), None
    for name in schema.COLUMNS:
        df = feed.table(name)
        letters = F.sum(sum((F.char_length(c) for c in df.columns[1:]), F.char_length(df.columns[0])))
        row = df.agg(F.count("*").alias("n_rows"), letters.alias("n_letters"), F.countDistinct(df.columns[-1]).alias("n_last")).select(
            F.lit(f"{name}.txt").alias("file"), F.lit(len(df.columns)).alias("n_columns"), "n_rows", "n_letters", "n_last", F.lit(", ".join(feed.unknown_columns(name))).alias("unknown")
        )
        out = row if out is None else out.unionByName(row)
    return out


def feed_zip_stop_times(spark, sf_dir):
    """Stop times through a zip that is unpacked into parts."""
    made = intermodal._feed(spark, sf_dir, "routes", "calendar", "trips", "stop_times")
    feed = Feed(spark, archives.packed(spark, made.folder, f"{made.folder}.zip"))
    return from_feed(feed.tables())["stop_times"].select("trip_id", "stop_id", "stop_sequence", "arr", "dep")


def feed_quoted_stops(spark, sf_dir):
    """Customers as stops whose names hold line feeds, quotes and commas."""
    folder = shared(spark, "feed")
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet")
    name = F.concat("c_name", F.when(F.col("c_custkey") % 3 == 0, '\nby the "old", mill\n').when(F.col("c_custkey") % 3 == 1, '"').otherwise(""))
    rows.select(F.col("c_custkey").alias("stop_id"), name.alias("stop_name"), F.lit("x").alias("stop_desc")).write.csv(f"{folder}/stops.txt", header=True, quote='"', escape='"', quoteAll=True, ignoreTrailingWhiteSpace=False)
    return Feed(spark, folder).table("stops").select("stop_id", "stop_name", "stop_desc")


def feed_handlers(spark, sf_dir):
    """What two handlers of one table and one of another have counted."""
    handlers = [Counting("trips", "service_id"), Counting("trips", "route_id"), Counting("calendar", "monday")]
    run = Handlers(intermodal._feed(spark, sf_dir, "trips", "calendar"))
    for h in handlers:
        run.register(h)
    run.read()
    rows = [(h.table, h.column, value, n) for h in handlers for value, n in sorted(h.counts.items()) if h.column != "route_id"]
    rows.append(("trips", "route_id", "", len(handlers[1].counts)))
    return spark.createDataFrame(rows, "file string, field string, value string, n long")


def legs_by_trip_layout(spark, sf_dir):
    """Legs and their times from stop times and trips in buckets by trip."""
    tables = layout.laid_out(spark_tables(spark, sf_dir, *services.CORE), int(spark.conf.get("spark.sql.shuffle.partitions")))
    s = Services(tables, ServicesConfig("thursday", periods=services.PERIODS, exclude_names=services.EXCLUDED))
    return s.legs.groupBy("from_stop", "to_stop", "mode").agg(F.count("*").alias("uses"), F.sum("duration").alias("duration"), F.sum("dwell").alias("dwell"))


QUERIES = {f.__name__: f for f in (feed_all_tables, feed_zip_stop_times, feed_quoted_stops, feed_handlers, legs_by_trip_layout)}


def _letters(name: str) -> str:
    return " + ".join(f"length(concat('{c} \"', k % {7 + i}, '\", x'))" for i, c in enumerate(schema.COLUMNS[name]))


SQL = {
    "feed_all_tables": " UNION ALL ".join(
        f"SELECT '{n}.txt' AS file, {len(schema.COLUMNS[n])} AS n_columns, count(*) AS n_rows, CAST(sum({_letters(n)}) AS BIGINT) AS n_letters, count(DISTINCT k % {6 + len(schema.COLUMNS[n])}) AS n_last, 'odd one' AS unknown FROM (SELECT {key} AS k FROM {source}) q"
        for n, (source, key) in MADE_OF.items()
    ),
    "feed_zip_stop_times": intermodal.SQL["feed_stop_times"],
    "feed_quoted_stops": "SELECT CAST(c_custkey AS VARCHAR) AS stop_id, concat(c_name, CASE c_custkey % 3 WHEN 0 THEN concat(chr(10), 'by the \"old\", mill', chr(10)) WHEN 1 THEN '\"' ELSE '' END) AS stop_name, 'x' AS stop_desc FROM customer",
    "feed_handlers": duckdb("""SELECT 'trips' AS file, 'service_id' AS field, CAST(service_id AS VARCHAR) AS value, count(*) AS n FROM trips GROUP BY ALL UNION ALL SELECT 'trips', 'route_id', '', count(DISTINCT route_id) FROM trips
        UNION ALL SELECT 'calendar', 'monday', CAST(monday AS VARCHAR), count(*) FROM calendar GROUP BY ALL"""),
    "legs_by_trip_layout": services.steps("SELECT from_stop, to_stop, mode, count(*) AS uses, CAST(sum(duration) AS BIGINT) AS duration, CAST(sum(dwell) AS BIGINT) AS dwell FROM leg GROUP BY from_stop, to_stop, mode"),
}
