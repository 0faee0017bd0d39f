"""Normalisation, filters and the choice of copies on hand-made alerts."""

import pytest

from tests.conftest import alerts_of, attack, make_alert

CASES = {
    "agent ip is no source": make_alert("a1", rule_id="503", level=3, groups=["agent_health"], full_log="agent is up"),
    "sudo": make_alert(
        "a2", rule_id="5402", level=3, groups=["syslog", "sudo"],
        data={"srcuser": "mallory", "dstuser": "root", "command": "/usr/bin/whoami"},
        full_log="mallory : TTY=pts/7 ; PWD=/home/mallory ; USER=root ; COMMAND=/usr/bin/whoami"),
    "by": make_alert("a3", rule_id="5762", level=4, data={"srcip": "10.44.7.1", "dstuser": "by"},
                    full_log="Connection reset by 10.44.7.1 port 50112 [preauth]"),
    "web": make_alert("a4", rule_id="31101", description="access refused", groups=["web", "accesslog"],
                     full_log='GET /moved/password/from/9.9.9.9?user=guest HTTP/2" 404'),
    "clamp": make_alert("a5", level=999, full_log="normal\n‮forged"),
    "unknown critical": make_alert("a6", rule_id="999999", level=15, groups=["custom"], full_log="evidence"),
    "port scan": make_alert("a7", rule_id="100030", level=10, groups=["firewall", "port_scan"],
                           data={"srcip": "198.51.100.77"}, full_log="dropped"),
    "text source": make_alert("a8"),
    "ragged": {"id": "a9", "rule": "none", "agent": [1], "data": "x", "timestamp": 5, "full_log": None},
    "types": {**make_alert("a10"), "rule": {"id": 5760, "level": "7", "groups": "sshd", "firedtimes": 0}},
    "mitre": make_alert("a11", mitre={"id": ["T1110", "T9999", "T1110"], "technique": "Given, Two"}),
    "v6": make_alert("a12", groups=["x"], rule_id="1", data={"net": {"srcIP": "2001:DB8::0001"}}),
    "fraction": make_alert("a13", level=9.7, firedtimes="3"),
}


@pytest.fixture(scope="module")
def normal(spark):
    alerts, _ = alerts_of(spark, list(CASES.values()))
    rows = {r.event_id: r for r in alerts.collect()}
    return {name: rows[f"a{i}"] for i, name in enumerate(CASES, 1)}


def test_sources(normal):
    first = normal["agent ip is no source"]
    assert (first.source_ip, first.source_confidence, first.destination_ip) == ("-", "Unknown", "10.44.7.9")
    assert (normal["web"].source_ip, normal["web"].target_user) == ("-", "-")
    assert (normal["text source"].source_ip, normal["text source"].source_confidence) == ("10.44.7.1", "Medium")
    assert (normal["v6"].source_ip, normal["v6"].source_scope) == ("2001:db8::1", "Reserved")
    assert normal["by"].target_user == "-"


def test_users(normal):
    sudo = normal["sudo"]
    assert (sudo.actor_user, sudo.target_user, sudo.username, sudo.command) == ("mallory", "root", "mallory", "/usr/bin/whoami")


def test_classes_and_scores(normal):
    assert (normal["web"].alert_type, normal["web"].event_category) == ("Web Directory Brute Force", "Reconnaissance")
    assert normal["clamp"].rule_level == 16
    assert normal["clamp"].full_log == "normal\\n forged"
    critical = normal["unknown critical"]
    assert (critical.alert_type, critical.risk_level, critical.risk_score) == ("Other Security Event", "Critical", 85)
    assert (critical.mitre_tactics, critical.attack_stage) == ("-", "Unmapped")
    scan = normal["port scan"]
    assert "目标端口" in scan.response_suggestion and "ACL" in scan.response_suggestion
    assert (normal["fraction"].rule_level, normal["fraction"].fired_times) == (9, 3)
    assert normal["mitre"].mitre_ids == "T1110, T9999"
    assert (normal["mitre"].mitre_tactics, normal["mitre"].mitre_techniques) == ("Credential Access", "Given, Two")


def test_wrong_shapes_become_missing(normal):
    ragged = normal["ragged"]
    assert (ragged.rule_id, ragged.agent_name, ragged.affected_asset, ragged.full_log, ragged.event_us) == ("-", "-", "-", "-", None)
    assert ragged.timestamp == "5"
    types = normal["types"]
    assert (types.rule_id, types.rule_level, types.fired_times, types.source_ip) == ("5760", 7, 1, "10.44.7.1")


def test_copies_and_filters(spark):
    low, high = make_alert("c", level=0), make_alert("c", level=10, rule_id="2502")
    other_agent = make_alert("c", level=6, agent_id="002")
    unnamed = [make_alert("", level=5, agent_name=f"n{i}") for i in range(3)]
    kept, records = alerts_of(spark, [low, high, other_agent, *unnamed], min_level=5)
    assert sorted((r.rule_level, r.copies) for r in kept.collect()) == [(5, 1), (5, 1), (5, 1), (6, 1), (10, 1)]
    assert records.filter("drop_reason = 'level'").count() == 1


def test_a_better_copy_takes_the_first_place(spark):
    rows = [make_alert("x", level=5), make_alert("y", level=5), attack("x", "2026-07-26T00:00:00Z"), make_alert("y", level=5)]
    kept, _ = alerts_of(spark, rows)
    assert sorted((r.event_id, r.pos, r.record_number, r.copies) for r in kept.collect()) == [("x", 1, 3, 2), ("y", 2, 2, 2)]


def test_time_and_scope_filters(spark):
    rows = [
        make_alert("1", "2026-07-26T00:00:00Z"), make_alert("2", "2026-07-26T01:00:00Z"), make_alert("3", "never"),
        make_alert("4", "2026-07-26T02:00:00Z"), make_alert("5", "2026-07-26T00:30:00Z", rule_id="5501"),
    ]
    kept, records = alerts_of(
        spark, rows, since="2026-07-26T00:00:00Z", until="2026-07-26T01:00:00+00:00", scope_only=True)
    assert sorted(r.event_id for r in kept.collect()) == ["1", "2"]
    assert sorted(r.drop_reason for r in records.filter("drop_reason is not null").collect()) == ["scope", "time", "time"]
