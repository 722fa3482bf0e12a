"""Every registered query of the library against its SQL, on the smallest tables."""

import os

import pytest

from colloquy.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(x):
    if x is None or x != x:
        return None
    if hasattr(x, "isoformat"):
        return str(x)[:26]
    if isinstance(x, float):
        return int(x) if x == int(x) else round(x, 6)
    return x


def table(df):
    df = df[sorted(df.columns)]
    return sorted((tuple(plain(x) for x in r) for r in df.astype(object).where(df.notna(), None).itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_sql(spark, duck, name):
    got, want = registry.QUERIES[name](spark, SF).toPandas(), duck.sql(registry.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert table(got) == table(want)


@pytest.fixture(scope="module")
def late_users(spark, tmp_path_factory):
    """The events with user ids from 10,000 on."""
    import duckdb

    path = str(tmp_path_factory.mktemp("late"))
    rows = spark.read.parquet(f"{SF}/events.parquet")
    rows.withColumn("user_id", (rows["user_id"] + 10_000).cast(rows.schema["user_id"].dataType)).coalesce(1).write.parquet(f"{path}/events.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{path}/events.parquet/*.parquet'")
    return path, con


@pytest.mark.parametrize("name", ["member_events", "ingest", "stream_backfill"])
def test_consent_holds_for_every_user_id(spark, late_users, name):
    path, con = late_users
    got, want = registry.QUERIES[name](spark, path).toPandas(), con.sql(registry.SQL[name]).df()
    assert len(want) and table(got) == table(want)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_query_runs(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(registry.QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())


def test_a_feed_delivered_twice_is_laid_out_by_as_many_tasks_as_read_it(spark):
    from colloquy.plans import feeds

    rows = spark.range(0, 9000, 1, 20).withColumnRenamed("id", "seq")
    path, schema, files = feeds.delivered_twice(spark, rows, "seq % 3 = 0", "twice")
    stored = spark.read.schema(schema).parquet(path)
    assert len(stored.inputFiles()) >= 40 and files == 14 and stored.count() == 12_000 and stored.distinct().count() == 9000


def test_a_partition_of_a_sink_gets_one_file_a_call(spark, tmp_path):
    from colloquy.sources import io

    path = str(tmp_path / "sink")
    rows = spark.range(0, 4000, 1, 8).selectExpr("CAST(id AS STRING) AS event_key", "id AS at", "id % 5 AS slot")
    for part in ("at < 3000", "at >= 1000"):
        io.sink_events_idempotent(rows.where(part), path, ["at"], within="slot")
    assert spark.read.parquet(path).count() == 4000 and len(spark.read.parquet(path).inputFiles()) == 10


@pytest.mark.parametrize("name", ["scan_calls", "scan_status"])
def test_documents_are_read_parsed_and_checked_once(spark, name):
    plan = registry.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan text") == 1 and plan.count("parseJson") == 1 and plan.count("[[callId,missing]]") == 1


def test_either_half_of_a_scan_parses_a_document_once(spark, tmp_path):
    from colloquy.sources import io

    (tmp_path / "x").write_text("{}\n[]\n{ half\n")
    for half in io.scan_calls(spark, str(tmp_path), lines=True):
        assert half._jdf.queryExecution().executedPlan().toString().count("parseJson") == 1
    assert half.count() == 3
