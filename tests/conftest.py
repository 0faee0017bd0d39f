from __future__ import annotations

import json
import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from alertlake.plans.analysis import Options, accepted, load_records  # noqa: E402
from alertlake.session import discard_written, prepare, written  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    shared = tmp_path_factory.mktemp("shared")
    session = (
        SparkSession.builder.master("local[8]").appName("alertlake-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "6g")
        .config("spark.checkpoint.dir", f"{shared}/work")
        .config("spark.sql.warehouse.dir", f"{shared}/warehouse")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield prepare(session)
    discard_written(session)
    session.stop()


_PLACES = {
    "rule": ("description", "groups", "firedtimes", "mitre"), "agent": {"agent_id": "id", "agent_name": "name", "agent_ip": "ip"},
}


def make_alert(event_id="1.1", timestamp="2026-07-26T00:00:00.000+0800", rule_id="5760", level=5, **more) -> dict:
    """An alert line as a dictionary: a failed login on web-03, changed by what is given."""
    alert = {
        "id": event_id, "timestamp": timestamp, "location": "/var/log/secure", "decoder": {"name": "sshd"},
        "rule": {"id": rule_id, "level": level, "description": "login refused", "groups": ["sshd", "authentication_failed"], "firedtimes": 1},
        "agent": {"id": "001", "name": "web-03", "ip": "10.44.7.9"}, "manager": {"name": more.pop("manager", "hub-1")},
        "data": {}, "full_log": "Failed password for root from 10.44.7.1 port 4022 ssh2",
    }
    for name, value in more.items():
        if name in _PLACES["rule"]:
            alert["rule"][name] = value
        elif name in _PLACES["agent"]:
            alert["agent"][_PLACES["agent"][name]] = value
        else:
            alert[name] = value
    return alert


def success(event_id, timestamp, user="root", source="10.44.7.1", **more) -> dict:
    return make_alert(
        event_id, timestamp, "5715", 3, groups=["syslog", "sshd", "authentication_success"],
        data={"srcip": source, "dstuser": user},
        full_log=f"Accepted password for {user} from {source} port 4022 ssh2", **more,
    )


def attack(event_id, timestamp, user="root", source="10.44.7.1", **more) -> dict:
    data = {"srcip": source, **({"dstuser": user} if user else {})}
    log = f"PAM failures rhost={source}" + (f" user={user}" if user else "")
    return make_alert(event_id, timestamp, "2502", 10, data=data, full_log=log, **more)


def lines_of(spark, rows: list) -> object:
    """Numbered lines from alerts (dicts) or raw texts."""
    texts = [r if isinstance(r, str) else json.dumps(r) for r in rows]
    return spark.createDataFrame(list(enumerate(texts, 1)), "record_number bigint, value string")


def alerts_of(spark, rows: list, **options):
    records = written(load_records(lines_of(spark, rows), Options(**options)), "records")
    return written(accepted(records), "alerts"), records
