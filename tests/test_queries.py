"""Every registered query against its SQL statement on the smallest data set."""

import math
from decimal import Decimal

import duckdb
import pytest

import __spark_entry__ as contract
from alertlake.plans import catalog
from oracle import statements

SF_DIR = "/root/testdata/sf0.001"
QUERIES, STATEMENTS = catalog.registered(), statements.all_statements()


@pytest.fixture(scope="module")
def database():
    connection = duckdb.connect()
    for table in ("events", "documents"):
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF_DIR}/{table}.parquet'")
    return connection


def plain(value):
    if isinstance(value, (float, Decimal)):
        return None if math.isnan(value) else round(float(value), 6)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([tuple(plain(r[i]) for i in order) for r in rows], key=repr)


def test_every_query_has_a_statement():
    assert set(QUERIES) == set(STATEMENTS)
    assert QUERIES.keys() <= contract.queries().keys() and STATEMENTS.keys() <= contract.oracle_sql().keys()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, database, name):
    df = QUERIES[name](spark, SF_DIR)
    cursor = database.execute(STATEMENTS[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(df.columns) == sorted(columns)
    expected = rows_of(columns, cursor.fetchall())
    assert expected and rows_of(df.columns, df.collect()) == expected


def test_entry(spark):
    rows = contract.entry(spark).collect()
    assert [r.priority for r in sorted(rows, key=lambda r: r.priority)] == list(range(1, len(rows) + 1))


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_alerts_are_not_multiplied_or_sorted_to_be_counted(spark):
    made = {n: plan_of(QUERIES[n](spark, SF_DIR)) for n in ("metrics", "timeline", "mitre_summary", "report_top_assets", "report_timeline_share")}
    assert not any("Expand" in plan for plan in made.values())
    assert "SortAggregate" not in made["timeline"] and "SortAggregate" not in made["report_timeline_share"]
    # Both read small written tables alone.
    assert "shown-by_asset" in made["report_top_assets"] and "/alerts-" not in made["report_top_assets"]
    assert "timeline-buckets" in made["report_timeline_share"] and "/alerts-" not in made["report_timeline_share"]
