"""Every query with SQL gives the rows that DuckDB gives."""

import math

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(n for n in entry.oracle_sql() if not n.startswith("op") and n != "pipeline"))
def test_same_rows(spark, small, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{small}/{t}.parquet'")
    found = entry.queries()[name](spark, small)
    wanted = con.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in wanted.description]
    assert sorted(found.columns) == sorted(columns)
    assert rows_of(found.columns, found.collect()) == rows_of(columns, wanted.fetchall())


def test_entry_counts(spark):
    got = {r["mode"]: (r["n_trips"], r["n_stop_times"]) for r in entry.entry(spark).collect()}
    assert got == {"BUS": (13, 60), "FERRY": (15, 53), "LIGHTRAIL": (21, 97), "TRAIN": (20, 83)}


def test_names_are_known():
    assert set(entry.oracle_sql()) <= set(entry.queries())
