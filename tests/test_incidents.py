"""Sessions, compromises, outages and their order on small scenarios and against plain loops."""

import random
from collections import defaultdict, deque

import pytest
from pyspark.sql import functions as F

from alertlake.operators import incidents as I
from alertlake.operators import sessions
from alertlake.operators.outages import agent_outages
from alertlake.operators.ranges import ranked
from alertlake.operators.summaries import by_asset, timeline, top_values
from alertlake.plans.analysis import analyze
from tests.conftest import alerts_of, attack, make_alert, success

DAY = "2026-07-26T"


def stop(event_id, time, **more):
    return make_alert(event_id, DAY + time, "506", 3, groups=["agent_health"], full_log="stopped", **more)


def start(event_id, time, **more):
    return make_alert(event_id, DAY + time, "503", 3, groups=["agent_health"], full_log="started", **more)


# One agent per scenario keeps them apart in a single run.
SCENARIOS = {
    "compromise": [attack("1", DAY + "00:00:00Z"), success("2", DAY + "00:02:00Z")],
    "single": [make_alert("1", DAY + "00:00:00Z"), success("2", DAY + "00:01:00Z")],
    "account": [attack("1", DAY + "00:00:00Z"), success("2", DAY + "00:01:00Z", "operator")],
    "nobody": [attack("1", DAY + "00:00:00Z", None), success("2", DAY + "00:01:00Z", "operator")],
    "late": [attack("1", "9999-12-31T23:55:00+00:00"), success("2", "9999-12-31T23:56:00+00:00")],
    "edge": [make_alert("1", DAY + "00:00:00Z"), make_alert("2", DAY + "00:10:00Z"), make_alert("3", DAY + "00:20:00.001Z")],
    "taken": [
        attack("1", DAY + "00:00:00Z"), success("2", DAY + "00:05:00Z"),
        success("0", "2026-07-25T23:56:00Z"), success("3", DAY + "00:14:00Z"),
    ],
    "outage": [stop("1", "00:00:00Z"), stop("2", "00:01:00Z"), start("3", "00:02:30Z")],
    "untimed": [make_alert("1", "never"), make_alert("2", "never")],
    "unsourced": [make_alert(str(i), DAY + "00:00:00Z", full_log="failed", groups=["sshd"]) for i in range(3)],
}


@pytest.fixture(scope="module")
def scenario_alerts(spark):
    rows = []
    for name, alerts in SCENARIOS.items():
        for alert in alerts:
            alert["agent"] = {**alert["agent"], "id": name, "name": name}
            rows.append(alert)
    return alerts_of(spark, rows)[0]


@pytest.fixture(scope="module")
def result(scenario_alerts):
    return analyze(scenario_alerts, 10)


@pytest.fixture(scope="module")
def by_agent(result):
    groups = defaultdict(list)
    for row in result.incidents.collect():
        groups[row.agent_id].append(row)
    return groups


def categories(rows):
    return sorted(r.event_category for r in rows)


def test_failure_then_success_is_one_critical_incident(by_agent):
    (row,) = by_agent["compromise"]
    assert (row.event_category, row.event_count, row.risk_level, row.confidence) == ("Suspected Compromise", 2, "Critical", "High")
    assert row.risk_score >= 95 and row.target_users == "root" and row.rule_ids == "2502, 5715"
    assert [r.event_category for r in by_agent["late"]] == ["Suspected Compromise"]


def test_no_compromise_without_chain_account_or_target(by_agent):
    for name in ("single", "account", "nobody"):
        assert categories(by_agent[name]) == ["Authentication Success", "Credential Attack"]


def test_a_gap_as_long_as_the_window_stays_inside(by_agent):
    assert sorted(r.event_count for r in by_agent["edge"]) == [1, 2]


def test_a_session_that_loses_its_middle_success_stays_one(by_agent):
    rows = {r.event_category: r for r in by_agent["taken"]}
    assert rows["Suspected Compromise"].event_count == 2
    assert (rows["Authentication Success"].event_count, rows["Authentication Success"].duration_seconds) == (2, 1080)


def test_outages_pair_first_stop_with_first_start(by_agent):
    (row,) = by_agent["outage"]
    assert "检测到 2 次停止/断连与 1 次启动/恢复；已匹配 1 个恢复周期，累计中断约 150 秒。仍有 1 次停止未见恢复。" in row.summary


def test_alerts_without_time_or_source_stay_apart(by_agent):
    assert [r.event_count for r in by_agent["untimed"]] == [1, 1]
    assert {r.first_seen for r in by_agent["untimed"]} == {"never"}
    assert all(r.incident_id.startswith("INC-UNKNOWN-") for r in by_agent["untimed"])
    assert [r.event_count for r in by_agent["unsourced"]] == [1, 1, 1]


def test_every_alert_is_in_exactly_one_incident(scenario_alerts, by_agent):
    assert sum(r.event_count for rows in by_agent.values() for r in rows) == scenario_alerts.count()


def test_headline_numbers_agree_with_the_tables(result, by_agent):
    numbers = result.metrics.first()
    assert numbers.total_incidents == sum(map(len, by_agent.values()))
    assert numbers.asset_count == len(SCENARIOS) == result.by_asset.count()
    assert numbers.highest_risk_level == "Critical"


def test_incident_ids_ignore_rank_and_display_zone(spark, scenario_alerts):
    base = scenario_alerts.filter("agent_id = 'compromise'")
    shifted = base.withColumns({"offset_s": F.lit(-18000), "timestamp": F.lit("other")})
    ids = [sorted(r.incident_id for r in I.incidents(a).collect()) for a in (base, shifted, scenario_alerts)]
    assert ids[0] == ids[1] and set(ids[0]) <= set(ids[2])


def test_same_agent_on_two_managers_is_two_assets(spark):
    alerts, _ = alerts_of(spark, [make_alert("a"), make_alert("b", manager="second")])
    rows = by_asset(alerts, I.incidents(alerts)).collect()
    assert sorted(r.manager_name for r in rows) == ["hub-1", "second"]


def test_empty_input(spark, scenario_alerts):
    none = scenario_alerts.limit(0)
    empty = analyze(none)
    row = empty.metrics.first()
    assert (row.total_alerts, row.mitre_coverage_percent, row.highest_risk_level, row.first_seen) == (0, 0.0, "None", "-")
    assert empty.incidents.count() == empty.timeline.count() == 0


def plain_sessions(times, width):
    """record -> start of its session, by a plain loop."""
    result, last, opened = {}, None, None
    for us, record in sorted(times):
        if last is None or us - last > width:
            opened = us
        result[record], last = opened, us
    return result


@pytest.mark.parametrize("seed", [1, 2])
def test_sessions_match_a_plain_loop_with_a_hot_key(spark, seed):
    rng = random.Random(seed)
    width = sessions.window_us(1)
    rows, expected = [], {}
    for key, n in (("hot", 3000), ("a", 200), ("b", 5)):
        times = [(rng.randrange(-200 * width, 200 * width), len(rows) + i + 1) for i in range(n)]
        expected.update(plain_sessions(times, width))
        rows += [(r, us, key) for us, r in times]
    df = spark.createDataFrame(rows, "record_number bigint, event_us bigint, manager_name string").withColumns({
        "agent_id": F.lit("1"), "affected_asset": F.lit("x"), "source_ip": F.lit("1.1.1.1"),
        "event_category": F.lit("Reconnaissance"), "target_user": F.lit("-"), "actor_user": F.lit("-"),
        "rule_id": F.lit("100030"),
    })
    tagged = sessions.keyed(df, 1)
    placed = sessions.with_sessions(tagged, sessions.session_cells(tagged, 1))
    assert {r.record_number: r.session_us for r in placed.collect()} == expected


@pytest.mark.parametrize("seed", [3, 4])
def test_outages_match_a_plain_queue(spark, seed):
    rng = random.Random(seed)
    rows, expected = [], {}
    for session in range(6):
        n = 2000 if session == 0 else rng.randrange(1, 40)
        events = sorted((rng.randrange(0, 10**10), len(rows) + i, rng.random() < 0.5) for i in range(n))
        waiting, stops, recovered, seconds = deque(), 0, 0, 0
        for us, _, is_stop in events:
            if is_stop:
                waiting.append(us)
                stops += 1
            elif waiting:
                seconds += (us - waiting.popleft()) // 1_000_000
                recovered += 1
        expected[session] = (stops, n - stops, recovered, seconds, len(waiting))
        rows += [(session, us, r, "504" if s else "503") for us, r, s in events]
    df = spark.createDataFrame(rows, "session_us bigint, event_us bigint, record_number bigint, rule_id string").withColumns({
        **{n: F.lit("x") for n in sessions.KEY_TEXTS}, "key_hash": F.lit(1), "event_category": F.lit("Agent Visibility"), "solo": F.lit(0),
    })
    found = {
        r.session_us: (r.stop_count, r.start_count, r.recovered_count, r.recovered_seconds, r.outstanding)
        for r in agent_outages(df).collect()
    }
    assert found == expected


def test_ranks_are_global(spark):
    df = spark.range(5000).withColumn("v", F.pmod(F.hash("id"), F.lit(50)))
    rows = ranked(df, F.col("v").desc(), F.col("id")).collect()
    order = [r.id for r in sorted(rows, key=lambda r: r.priority)]
    assert order == [r.id for r in sorted(rows, key=lambda r: (-r.v, r.id))]
    assert sorted(r.priority for r in rows) == list(range(1, 5001))


def test_top_values_break_ties_by_first_appearance(spark):
    rows = [(1, "k", "b"), (2, "k", "a"), (3, "k", "a"), (4, "k", "b"), *[(10 + i, "k", f"v{i}") for i in range(6)]]
    df = spark.createDataFrame(rows, "pos bigint, key string, v string")
    assert top_values(df, ["key"], {"top": F.col("v")}).first().top == "b(2); a(2); v0(1); v1(1); v2(1)"


@pytest.mark.parametrize("hours,expected", [(1, 600), (20, 3600), (100, 21600), (300, 86400)])
def test_timeline_bucket_follows_the_span(spark, hours, expected):
    rows = [(i, i * 60_000_000, 28800) for i in (0, 9, hours * 60)]
    df = spark.createDataFrame(rows, "pos bigint, event_us bigint, offset_s int").withColumns(
        {"risk_level": F.lit("High"), "event_category": F.lit("x")})
    buckets = timeline(df).collect()
    assert sum(r.alert_count for r in buckets) == 3
    assert buckets[0].period_start == "1970-01-01T08:00+08:00" and buckets[0].alert_count == 2
    assert (hours * 3600) // expected * expected == (
        int(buckets[-1].period_start[8:10]) - 1) * 86400 + (int(buckets[-1].period_start[11:13]) - 8) * 3600 + int(buckets[-1].period_start[14:16]) * 60
