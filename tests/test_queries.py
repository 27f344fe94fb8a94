"""Every registered query against its DuckDB twin on the smallest tables."""

import os

import duckdb
import pytest

from cueforge.plans import registry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def sorted_rows(rows):
    return sorted((tuple(str(v) for v in r) for r in rows))


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted_rows(df.select(*columns).collect())
    assert got, "no rows"
    if name in registry.ORACLE:
        want = duck.sql(registry.ORACLE[name])
        assert sorted(want.columns) == columns
        assert got == sorted_rows(want.project(", ".join(f'"{c}"' for c in columns)).fetchall())


def test_stream_events_in_many_batches(spark, tmp_path, monkeypatch):
    import datetime

    from cueforge.streaming import streams

    source = streams.source
    monkeypatch.setattr(streams, "source", lambda spark, path, schema, **_: source(spark, path, schema, per_trigger=1))
    for day in range(6, 0, -1):
        rows = [(10 * day + k, datetime.datetime(2026, 1, day, k), "click") for k in range(3)]
        spark.createDataFrame(rows, "event_id long, ts timestamp, event_type string").coalesce(1).write.mode("append").parquet(str(tmp_path / "events.parquet"))
    assert [tuple(r) for r in registry.QUERIES["stream_events"](spark, str(tmp_path)).collect()] == [("click", 18)]


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(registry.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
