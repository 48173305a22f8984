"""Transit tables made from the star tables by integer SQL that both engines read.

``{customer}`` stands for a table and ``DIV`` for integer division. Lists are
texts parted by commas here; :func:`spark_tables` turns them into arrays.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LINKS = """
SELECT 2 * a.p_partkey AS link_id, a.p_partkey AS node_a, b.p_partkey AS node_b, 1 AS flat FROM {part} a JOIN {part} b ON b.p_partkey = a.p_partkey + 1 WHERE a.p_partkey % 50 <> 49
UNION ALL
SELECT 2 * a.p_partkey + 1 AS link_id, a.p_partkey AS node_a, b.p_partkey AS node_b, 0 AS flat FROM {part} a JOIN {part} b ON b.p_partkey = a.p_partkey + 50
"""
ROW = "((l.link_id DIV 2) DIV 50)"
MODES = f"""CASE WHEN l.flat = 0 THEN 'BUS,FERRY' ELSE concat('BUS', CASE WHEN {ROW} % 2 = 0 THEN ',LIGHTRAIL' ELSE '' END,
 CASE WHEN {ROW} % 3 = 0 THEN ',TRAIN' ELSE '' END, CASE WHEN {ROW} % 5 = 0 THEN ',FERRY' ELSE '' END) END"""
SEGMENT_FIELDS = f"{MODES} AS modes, CAST(800 + (l.link_id % 3) * 200 AS DOUBLE) AS capacity, CAST(0.1 AS DOUBLE) AS length_km, CAST(50 AS DOUBLE) AS speed_kmh"
SEGMENTS = f"""
SELECT 2 * l.link_id AS segment_id, l.link_id, l.node_a AS from_node, l.node_b AS to_node, {SEGMENT_FIELDS} FROM ({LINKS}) l
UNION ALL
SELECT 2 * l.link_id + 1 AS segment_id, l.link_id, l.node_b AS from_node, l.node_a AS to_node, {SEGMENT_FIELDS} FROM ({LINKS}) l
"""
X, Y = "CAST({k} % 50 * 100 AS DOUBLE)", "CAST({k} DIV 50 * 100 AS DOUBLE)"
TABLES: dict[str, str] = {
    "agency": "SELECT n_nationkey AS agency_id, n_name AS agency_name FROM {nation}",
    "routes": """SELECT c_custkey AS route_id, c_name AS route_short_name, c_mktsegment AS route_long_name,
        CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 3 WHEN 'BUILDING' THEN 2 WHEN 'FURNITURE' THEN 900 WHEN 'HOUSEHOLD' THEN 4 WHEN 'MACHINERY' THEN 401 END AS route_type FROM {customer}""",
    "calendar": """SELECT n_nationkey AS service_id, n_nationkey % 2 AS monday, (n_nationkey DIV 2) % 2 AS tuesday, (n_nationkey DIV 4) % 2 AS wednesday, (n_nationkey DIV 8) % 2 AS thursday,
        (n_nationkey DIV 16) % 2 AS friday, CASE WHEN n_nationkey % 3 = 0 THEN 1 ELSE 0 END AS saturday, CASE WHEN n_nationkey % 5 = 0 THEN 1 ELSE 0 END AS sunday FROM {nation}""",
    "trips": "SELECT o_orderkey AS trip_id, o_custkey AS route_id, o_orderkey % 25 AS service_id FROM {orders}",
    "stops": """SELECT s_suppkey AS stop_id, s_name AS stop_name, CAST(s_suppkey % 10 * 100 + 30 + s_suppkey % 7 AS DOUBLE) AS x, CAST(s_suppkey DIV 10 * 100 + 8 AS DOUBLE) AS y,
        CASE s_suppkey % 4 WHEN 0 THEN 'BUS' WHEN 1 THEN 'FERRY' WHEN 2 THEN 'LIGHTRAIL' ELSE 'TRAIN' END AS mode, CAST(s_suppkey % 50 AS VARCHAR(9)) AS platform_code FROM {supplier}""",
    "stop_times": """SELECT trip_id, stop_id, stop_sequence, ((trip_id * 37) % 1800) * 60 + stop_sequence * 600 + part % 300 AS arr, ((trip_id * 37) % 1800) * 60 + stop_sequence * 600 + part % 300 + stop_id % 60 AS dep FROM (
        SELECT l_orderkey AS trip_id, l_suppkey AS stop_id, l_partkey AS part, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity, l_extendedprice) AS stop_sequence FROM {lineitem}) t""",
    "nodes": f"SELECT p_partkey AS node_id, {X.format(k='p_partkey')} AS x, {Y.format(k='p_partkey')} AS y FROM {{part}}",
    "links": f"SELECT l.link_id, l.node_a, l.node_b, {X.format(k='l.node_a')} AS x0, {Y.format(k='l.node_a')} AS y0, {X.format(k='l.node_b')} AS x1, {Y.format(k='l.node_b')} AS y1 FROM ({LINKS}) l",
    "segments": SEGMENTS,
    "zones": f"SELECT p_partkey AS zone_id, concat('zone ', CAST(p_partkey AS VARCHAR(20))) AS name, CAST(p_size AS VARCHAR(9)) AS platforms, {X.format(k='p_partkey')} + 10 AS x, {Y.format(k='p_partkey')} + 5 AS y FROM {{part}} WHERE p_partkey % 5 = 0",
    "connectoids": f"SELECT s.segment_id AS connectoid_id, s.to_node AS zone_id, s.segment_id, s.link_id, s.to_node AS access_node, s.modes FROM ({SEGMENTS}) s WHERE s.to_node % 5 = 0",
}


def spark_tables(spark: SparkSession, sf_dir: str, *names: str) -> dict[str, DataFrame]:
    """The named tables (all by default), each a lazy plan over the Parquet files."""
    out = {}
    for name in names or TABLES:
        used = set(re.findall(r"{(\w+)}", TABLES[name]))
        df = spark.sql(TABLES[name], **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in used})
        if name == "links":
            point = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
            df = df.select("link_id", "node_a", "node_b", F.array(point("x0", "y0"), point("x1", "y1")).alias("geometry"))
        for column in {"modes", "platforms"} & set(df.columns):
            df = df.withColumn(column, F.split(column, ","))
        out[name] = df
    return out


def duckdb(text: str) -> str:
    """A query for DuckDB: names of :data:`TABLES` in ``text`` become common table expressions before it."""
    text = text.strip()
    parts, seen = [], set()
    for name, sql in TABLES.items():
        if re.search(rf"\b{name}\b", text):
            seen.add(name)
            parts.append(f"{name} AS ({re.sub(r'{(\w+)}', r'\1', sql)})")
    body = re.sub(r"\bDIV\b", "//", ", ".join(parts))
    rest = re.sub(r"\bDIV\b", "//", text)
    if rest.upper().startswith("WITH "):
        return f"WITH {body}, {rest[5:]}" if body else rest
    return f"WITH {body} {rest}" if body else rest
