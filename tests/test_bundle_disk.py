"""What a bundle leaves on disk: packed tables, no files of shuffles that are over, no tables that nobody reads."""

import glob
import gzip
import json
import os
import time

import pytest
from pyspark.sql import functions as F

from alertlake import dims
from alertlake.operators import incidents
from alertlake.plans.analysis import report
from alertlake.plans.publish import _sealed, publish, publish_bundle, read_bundle, read_manifest
from alertlake.session import _written, passing, remove, work_dir, written
from tests.conftest import alerts_of, attack, make_alert, success


def shuffle_files(spark):
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks()
    return {name for name in blocks.mkString(",").split(",") if name.startswith("shuffle_")}


def left_of(spark, before, most=0):
    """Numbers of the shuffles with new files, once those that are being deleted are gone."""
    for _ in range(50):
        left = {name.split("_")[1] for name in shuffle_files(spark) - before}
        if len(left) <= most:
            break
        time.sleep(0.2)
    return left


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    source = tmp_path_factory.mktemp("bundle") / "alerts.json"
    alerts = [make_alert(str(i), f"2026-07-{1 + i % 28:02d}T00:00:00Z", full_log=f'a,\n"{i}" ' + "failed " * 40) for i in range(500)]
    alerts += [attack("a", "2026-07-26T00:00:00Z"), success("s", "2026-07-26T00:02:00Z")]
    source.write_text("".join(json.dumps(a) + "\n" for a in alerts))
    return report(spark, str(source))


def test_tables_of_a_bundle_are_packed_and_read_like_plain_ones(spark, tmp_path, made):
    root, plain = str(tmp_path / "bundle"), str(tmp_path / "plain")
    manifest = publish_bundle(made, root)
    publish(made, plain)
    for name, n in manifest["rows"].items():
        parts = glob.glob(f"{root}/runs/{manifest['run']}/{name}.csv*/part-*")
        assert parts and all(p.endswith(".csv.gz") for p in parts)
        # The same lines as in the plain folder, which stays plain.
        packed = sorted(line for p in parts for line in gzip.open(p, "rt", encoding="utf-8", newline=""))
        assert packed == sorted(line for p in glob.glob(f"{plain}/{name}.csv/part-*.csv") for line in open(p, encoding="utf-8", newline=""))
        assert read_bundle(spark, root, name).count() == n
    size = sum(os.path.getsize(p) for p in glob.glob(f"{root}/runs/*/cleaned_alerts.csv*/part-*"))
    assert size * 5 < sum(os.path.getsize(p) for p in glob.glob(f"{plain}/cleaned_alerts.csv/part-*"))
    rows = read_bundle(spark, root, "cleaned_alerts").collect()
    assert [r["event_id"] for r in rows] == [*map(str, range(500)), "a", "s"] and list(rows[0].asDict()) == dims.ALERT_COLUMNS


def test_versions_from_before_tables_were_packed_are_still_read(spark, tmp_path, made):
    root = tmp_path / "bundle"
    publish(made, str(root / "runs" / "old"))
    (root / "manifests").mkdir()
    body = {"version": 1, "run": "old", "created_at": "2026-07-26T00:00:00+00:00", "rows": {"incidents": 3}}
    (root / "manifests" / "000000000001.json").write_text(_sealed(body))
    before = read_bundle(spark, str(root), "incidents")
    new = publish_bundle(made, str(root))
    assert new["version"] == 2 and read_manifest(spark, str(root)) == new
    assert sorted(before.collect()) == sorted(read_bundle(spark, str(root), "incidents").collect())
    assert read_bundle(spark, str(root), "incidents", body).count() == new["rows"]["incidents"]


def test_no_files_of_shuffles_that_are_over_stay(spark, tmp_path, made):
    before = shuffle_files(spark)
    publish_bundle(made, str(tmp_path / "bundle"))
    # Only the top ten of the summary stay, ten rows of each task: Spark does not list that shuffle.
    assert len(left_of(spark, before, 1)) <= 1
    before = shuffle_files(spark)
    # A frame that is not written keeps its files and can be read again, before and after it is written.
    base = spark.range(1000).repartition(4)
    frame = base.groupBy((F.col("id") % 7).alias("k")).agg(F.count("*").alias("n")).withColumn("all", base.agg(F.count("*")).scalar())
    rows = sorted(frame.collect())
    kept = left_of(spark, before, 9)
    table = written(frame, "again")
    assert kept and left_of(spark, before, len(kept)) == kept
    assert sorted(frame.collect()) == sorted(table.collect()) == rows and len(rows) == 7


def test_the_setting_of_the_session_comes_back(spark, tmp_path):
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    with pytest.raises(Exception, match="boom"):
        written(spark.range(3).select(F.raise_error(F.lit("boom")).cast("string").alias("x")), "broken")
    assert spark.conf.get(name) == before
    spark.conf.set(name, "true")
    try:
        written(spark.range(3), "whole")
        assert spark.conf.get(name) == "true"
    finally:
        spark.conf.set(name, before)


def folders(spark, name):
    return set(glob.glob(f"{work_dir(spark).removeprefix('file:')}/{name}-*"))


def test_tables_that_only_the_incidents_read_are_deleted(spark):
    rows = [attack("a", "2026-07-26T00:00:00Z"), success("s", "2026-07-26T00:02:00Z"), make_alert("m", "2026-07-26T05:00:00Z")]
    run = incidents.correlate(alerts_of(spark, rows)[0], 10)
    lazy = incidents.build_incidents(run)
    names = ["session-alerts", "session-lists"]
    before = {n: folders(spark, n) for n in names}
    assert all(before.values())
    found = incidents.written_incidents(run)
    # Those of another run, which is still to be read, stay.
    assert {n: folders(spark, n) for n in names} == before
    assert sorted(map(repr, found.collect())) == sorted(map(repr, lazy.collect())) and found.count() == 2


def test_passing_tables_go_even_if_what_reads_them_fails(spark):
    before = folders(spark, "short")
    listed = list(_written[spark.sparkContext.applicationId])
    with pytest.raises(RuntimeError), passing(spark, "short"):
        written(spark.range(3), "short")
        kept = written(spark.range(3), "long")
        raise RuntimeError
    assert folders(spark, "short") == before and kept.count() == 3
    entry = _written[spark.sparkContext.applicationId].pop()
    assert entry[0] == "long" and _written[spark.sparkContext.applicationId] == listed
    remove(spark, entry[1])


def test_lists_move_a_cell_s_equal_alerts_as_one_row(spark):
    """Two hundred alerts of one cell, of two kinds, are two rows once they leave the tasks that read them."""
    rows = [
        make_alert(str(i), f"2026-07-26T00:00:{i % 60:02d}Z", mitre={"id": ["T1110", "T1078", "T1110"] if i % 2 else ["T1078"]})
        for i in range(200)
    ]
    run = incidents.correlate(alerts_of(spark, rows)[0], 10)
    lists = incidents.session_lists(run, incidents.session_facts(run)).collect()
    assert len(lists) == 1 and lists[0]["mitre_ids_list"] == ["T1078", "T1110"] and lists[0]["rule_ids_list"] == ["5760"]
    assert len(lists[0]["alert_types_list"]) == 1 and lists[0]["commands_list"] == []
