import csv
import glob
import json

import pytest
from pyspark.sql import functions as F

from alertlake import dims
from alertlake.plans.analysis import report
from alertlake.plans.publish import BundleMissing, publish, publish_bundle, read_bundle, read_manifest, write_csv
from tests.conftest import attack, make_alert, success


def read_csv(path):
    rows = []
    for part in sorted(glob.glob(f"{path}/part-*.csv")):
        with open(part, encoding="utf-8", newline="") as handle:
            rows += list(csv.DictReader(handle))
    return rows


def test_cells_survive_the_csv_round_trip(spark, tmp_path):
    values = ["=cmd|' /C calc'!A0", "-", ' "quoted", comma ', "", "​@x", "  padded  ", None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").coalesce(1)
    write_csv(df, ["v", "i", "absent"], str(tmp_path / "t"))
    rows = read_csv(tmp_path / "t")
    assert [r["v"] for r in rows] == ["'=cmd|' /C calc'!A0", "-", ' "quoted", comma ', "", "'​@x", "  padded  ", ""]
    assert list(rows[0]) == ["v", "i", "absent"] and rows[0]["absent"] == ""


def test_a_report_is_published_whole_or_not_at_all(spark, tmp_path):
    source = tmp_path / "alerts.json"
    alerts = [attack("1", "2026-07-26T00:00:00Z"), success("2", "2026-07-26T00:02:00Z"), make_alert("3", full_log="=1+1")]
    source.write_text("".join(json.dumps(a) + "\n" for a in alerts))
    made = report(spark, str(source))
    target = tmp_path / "out"
    names = publish(made, str(target), {"title": "Test"})
    assert {p.name for p in target.iterdir()} == set(names) and len(names) == 11
    rows = read_csv(target / "cleaned_alerts.csv")
    assert list(rows[0]) == dims.ALERT_COLUMNS and [r["event_id"] for r in rows] == ["1", "2", "3"]
    assert rows[2]["full_log"] == "'=1+1"
    assert list(read_csv(target / "incidents.csv")[0]) == dims.INCIDENT_COLUMNS
    assert read_csv(target / "alert_timeline.csv")[0]["alert_count"] == "1"
    assert len(read_csv(target / "data_quality.csv")) == 16
    (part,) = glob.glob(str(target / "report_summary.json" / "part-*"))
    with open(part, encoding="utf-8") as handle:
        summary = json.load(handle)
    assert summary["report"]["title"] == "Test" and summary["metrics"]["total_alerts"] == 3
    assert summary["data_quality"]["parsed_records"] == 3
    assert summary["priority_incidents"][0]["event_category"] == "Suspected Compromise"
    with pytest.raises(ValueError):
        publish(made, str(target))


@pytest.fixture(scope="module")
def small_report(spark, tmp_path_factory):
    source = tmp_path_factory.mktemp("bundle") / "alerts.json"
    source.write_text("".join(json.dumps(make_alert(str(i), full_log=f"a,\n\"{i}\"")) + "\n" for i in range(5)))
    return report(spark, str(source))


def test_versions_are_read_through_manifests(spark, tmp_path, small_report):
    root = str(tmp_path / "out")
    with pytest.raises(BundleMissing):
        read_manifest(spark, root)
    first = publish_bundle(small_report, root, {"title": "One"})
    assert first["version"] == 1 and first["rows"]["cleaned_alerts"] == 5 and read_manifest(spark, root) == first
    rows = read_bundle(spark, root, "cleaned_alerts").collect()
    assert [r["event_id"] for r in rows] == [str(i) for i in range(5)] and rows[3]["full_log"] == 'a,\\n"3"'
    second = publish_bundle(small_report, root)
    assert read_manifest(spark, root) == second and second["version"] == 2 and second["run"] != first["run"]
    assert read_bundle(spark, root, "incidents", first).count() == first["rows"]["incidents"]
    # A manifest cut off while it was written is passed over, and its number is not used again.
    (tmp_path / "out" / "manifests" / "000000000003.json").write_text('{"version": 3, "run"')
    assert read_manifest(spark, root) == second and publish_bundle(small_report, root)["version"] == 4
    with pytest.raises(BundleMissing):
        read_bundle(spark, root, "absent")


@pytest.mark.parametrize("fails_at", [0, 1, 5, 9, "summary"])
def test_a_run_that_dies_leaves_the_version_before(spark, tmp_path, small_report, monkeypatch, fails_at):
    from alertlake.plans import publish as module

    root, calls, real = str(tmp_path / "out"), [], module.write_csv
    tables = module.bundle_tables(small_report)
    monkeypatch.setattr(module, "bundle_tables", lambda _: {n: (spark.range(1).select(*[F.lit(n).alias(c) for c in cols]), cols) for n, (_, cols) in tables.items()})
    before = publish_bundle(small_report, root)

    def dying(df, columns, path):
        calls.append(path)
        if len(calls) - 1 == fails_at:
            raise RuntimeError("died")
        real(df, columns, path)

    def no_summary(*_):
        raise RuntimeError("died")

    monkeypatch.setattr(module, "write_csv", dying)
    if fails_at == "summary":
        monkeypatch.setattr(module, "summary_json", no_summary)
    with pytest.raises(RuntimeError):
        publish_bundle(small_report, root)
    assert read_manifest(spark, root) == before and read_bundle(spark, root, "incidents").count() == 1
