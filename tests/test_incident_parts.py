"""Incidents are made only as far as they are asked for, and counted without their texts."""

import pytest
from pyspark.sql import functions as F

from alertlake import dims
from alertlake.operators import filters, incidents
from alertlake.operators.filters import dedup_best, repeated_hashes
from alertlake.operators.views import priority_incidents
from alertlake.plans import catalog
from alertlake.session import written
from tests.conftest import alerts_of, attack, make_alert, success
from tests.test_scale import KINDS

HOUR = "2026-07-26T{:02d}:{:02d}:00Z"


def rows_of(df):
    return sorted(map(repr, df.select(*sorted(df.columns)).collect()))


def test_parts_equal_what_the_whole_table_gives(spark, tmp_path):
    """Sixty users fail, log in, work and fail again for a week."""
    i = F.col("id")
    spark.range(3_000).select(
        i.alias("event_id"), F.timestamp_micros(F.lit(1_704_067_200_000_000) + i * 200_000_000).alias("ts"), (i % 60).alias("user_id"),
        F.get(F.array(*[F.lit(k) for k in KINDS]), F.floor(i / 60).cast("int") % 5).alias("event_type"),
        (i % 500).cast("double").alias("value"), F.lit('{"k": 3}').alias("props"),
    ).coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    names = [
        "recommendations", "compromise_incidents", "summary_by_source", "summary_by_asset", "sink_json", "metrics", "incident_counts",
        "incident_score", "incident_queue", "report_priority_incidents", "report_posture",
    ]
    alone = {n: rows_of(catalog.registered()[n](spark, str(tmp_path))) for n in names}
    assert all(alone.values()) and "incidents" not in catalog._tables
    # What needs the lists of all incidents is written once for whoever comes after.
    assert catalog.registered()["export_incidents"](spark, str(tmp_path)).count() and "incidents" in catalog._tables
    assert alone == {n: rows_of(catalog.registered()[n](spark, str(tmp_path))) for n in names}


@pytest.fixture
def run(spark):
    rows = [attack(f"a{i}", HOUR.format(i, 0), source=f"10.44.7.{i}") for i in range(1, 9)]
    rows += [success(f"s{i}", HOUR.format(i, 2), source=f"10.44.7.{i}") for i in (2, 5)]
    rows += [make_alert(f"o{i}", HOUR.format(i, 30), level=1 + i, groups=["web"], rule_id="31101") for i in range(9)]
    return incidents.correlate(alerts_of(spark, rows)[0], 10)


def names_written(monkeypatch):
    seen = []
    monkeypatch.setattr(incidents, "written", lambda df, name: seen.append((name, df.columns)) or written(df, name))
    return seen


def test_counting_incidents_makes_no_texts(run, monkeypatch):
    seen = names_written(monkeypatch)
    facts = incidents.session_facts(run)
    counted = incidents.listed(run, facts)
    assert [n for n, _ in seen] == ["session-facts", "shared-lines"]
    assert not {"full_log", "timestamp", "summary"} & set(facts.columns)
    whole = incidents.build_incidents(run)
    columns = ["source_ip", "risk_score", "risk_level", "event_count"]
    assert rows_of(counted.select(*columns)) == rows_of(whole.select(*columns))


def test_advice_needs_no_lists(run, monkeypatch):
    seen = names_written(monkeypatch)
    monkeypatch.setattr(incidents, "session_lists", None)
    monkeypatch.setattr(incidents, "agent_outages", None)
    made = incidents.build_incidents(run, dims.RECOMMENDATION_COLUMNS)
    rows = rows_of(made)
    assert "log" not in dict(seen)["session-alerts"]
    monkeypatch.undo()
    assert rows == rows_of(incidents.build_incidents(run).select(*dims.RECOMMENDATION_COLUMNS))


def test_compromises_are_made_without_the_other_incidents(run, monkeypatch):
    facts = incidents.session_facts(run)
    whole = rows_of(incidents.build_incidents(run, dims.INCIDENT_COLUMNS, facts).filter("event_category = 'Suspected Compromise'"))
    counts = []
    monkeypatch.setattr(incidents, "written", lambda df, name: counts.append((name, df.count())) or written(df, name))
    made = incidents.build_incidents(run, dims.INCIDENT_COLUMNS, facts.filter("compromised"), True)
    assert len(whole) == 2 and rows_of(made) == whole
    assert dict(counts)["session-alerts"] <= 4


def test_the_most_urgent_are_all_there_and_few_others(run):
    facts = incidents.session_facts(run)
    whole = incidents.build_incidents(run)
    for n in (1, 3, 50):
        few = incidents.most_urgent(run, facts, n)
        assert rows_of(priority_incidents(few, n)) == rows_of(priority_incidents(whole, n))
    assert incidents.most_urgent(run, facts, 1).count() < whole.count() / 2


def test_shared_line_numbers_count_as_often_as_they_are_shown(spark):
    rows = [attack("1", HOUR.format(1, 0)), make_alert("2", HOUR.format(5, 0))]
    alerts = alerts_of(spark, rows)[0]
    run = incidents.correlate(alerts.unionByName(alerts.filter("event_id = '1'")), 10)
    counted = incidents.listed(run, incidents.session_facts(run))
    whole = incidents.build_incidents(run)
    assert whole.count() == 9 and rows_of(counted.select("risk_score", "event_count")) == rows_of(whole.select("risk_score", "event_count"))


def test_alerts_without_copies_stay_in_the_task_that_reads_them(spark, monkeypatch):
    rows = [make_alert(str(i), HOUR.format(0, i % 60), level=5) for i in range(300)]
    rows += [make_alert(str(i), HOUR.format(1, i), level=9) for i in range(5)] + [make_alert("", HOUR.format(2, 0))] * 2
    _, records = alerts_of(spark, rows)
    names = ["spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"]
    for name in names:
        spark.conf.set(name, "-1")
    try:
        made = dedup_best(records)
        plan = made._jdf.queryExecution().executedPlan().toString()
        # The one shuffle join is that of doubtful alerts; the marks reach every task.
        assert plan.count("SortMergeJoin") == 1 and plan.count("BroadcastHashJoin") >= 2
        result = {(r.record_number, r.pos, r.copies) for r in made.collect()}
    finally:
        for name in names:
            spark.conf.unset(name)
    expected = {(i, i, 1) for i in range(6, 301)} | {(300 + i, i, 2) for i in range(1, 6)} | {(306, 306, 1), (307, 307, 1)}
    assert result == expected
    # Marks shared by all hashes cost a comparison and change nothing.
    monkeypatch.setattr(filters, "_WORD_BITS", 1)
    assert {(r.record_number, r.pos, r.copies) for r in dedup_best(records).collect()} == expected


def test_marks_of_repeated_hashes_are_few_words(spark):
    hashes = spark.range(200_000).selectExpr("xxhash64(id) AS key_hash")
    assert repeated_hashes(hashes).isEmpty()
    marks = repeated_hashes(hashes.unionByName(hashes.limit(1_000)))
    assert marks.count() <= 1_000 and marks.selectExpr("sum(bit_count(marks))").first()[0] <= 1_000
