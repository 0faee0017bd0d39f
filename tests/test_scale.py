"""Even tasks and bounded reports to the driver on larger event tables."""

from pyspark.sql import functions as F

from alertlake.plans import catalog
from alertlake.session import prepare
from alertlake.sources import event_alerts

KINDS = ["error", "view", "signup", "click", "purchase"]


def events_file(spark, folder, n):
    """n events in one file of one row group."""
    e = F.col("event_id")
    spark.range(n).select(
        F.col("id").alias("event_id"), F.timestamp_micros(F.lit(1_704_067_200_000_000) + F.col("id") * 20_000_000).alias("ts"),
        (F.col("id") * 7919 % 2000).alias("user_id"),
    ).select(
        "*", F.get(F.array(*[F.lit(k) for k in KINDS]), (e % 5).cast("int")).alias("event_type"), (e % 500).cast("double").alias("value"), F.lit('{"k": 3}').alias("props"),
    ).coalesce(1).write.parquet(f"{folder}/events.parquet")
    return str(folder)


def test_events_of_one_row_group_become_even_tasks(spark, tmp_path):
    folder = events_file(spark, tmp_path, 20_000)
    cores = spark.sparkContext.defaultParallelism
    names = {"spark.sql.files.maxPartitionBytes": "8k", "spark.sql.files.openCostInBytes": "1k"}
    before = {name: spark.conf.get(name) for name in names}
    for name, value in names.items():
        spark.conf.set(name, value)
    try:
        # There are splits enough, but all rows are in one of them.
        assert spark.read.parquet(f"{folder}/events.parquet").rdd.getNumPartitions() >= cores
        for made in (event_alerts.alert_lines, event_alerts.damaged_lines, event_alerts.rule_cycle_lines):
            sizes = [r["count"] for r in made(spark, folder).groupBy(F.spark_partition_id()).count().collect()]
            assert len(sizes) >= cores and max(sizes) < 2 * sum(sizes) / len(sizes)
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def test_lines_are_parsed_once_for_the_normalised_alerts(spark):
    plan = catalog.registered()["normalize_alerts"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "/records-" in plan and "from_json" not in plan


def test_blocks_of_alert_files_grow_with_the_lines(spark, tmp_path, monkeypatch):
    seen = []
    monkeypatch.setattr(catalog.lines, "numbered_lines", lambda spark, files: seen.append(spark.conf.get("spark.sql.files.maxPartitionBytes")))
    for n in (2_000, 200_000):
        catalog._numbered(spark, events_file(spark, tmp_path / str(n), n))
    assert seen == ["64k", "200k"]


def test_statuses_of_lines_need_no_alerts(spark, tmp_path, monkeypatch):
    def refuse(*_):
        raise AssertionError("alerts were made")

    folder = events_file(spark, tmp_path, 500)
    monkeypatch.setattr(catalog, "load_records", refuse)
    counts = catalog.registered()["ingest_strict"](spark, folder).first().asDict()
    samples = dict(catalog.registered()["ingest_reject_samples"](spark, folder).collect())
    assert counts == {"n_malformed": 10, "n_non_object": 10, "n_oversized": 10, "n_encoding": 0, "refused": True}
    assert samples["malformed"] == ",".join(str(i) for i in range(2, 500, 50))
    monkeypatch.undo()
    # Where the alerts are there anyway, their statuses are the same.
    made = catalog.damaged(spark, folder).select("record_number", "line_status")
    assert sorted(made.collect()) == sorted(catalog._tables["judged"].collect())


def test_few_fields_are_made_without_the_others(spark, tmp_path):
    folder = events_file(spark, tmp_path, 500)
    made = catalog.registered()["mitre_enrich"](spark, folder)
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "/records-" not in plan and "records" not in catalog._made(spark, folder)
    # Parts of the advice, of address scopes and of log accounts are not in the plan.
    assert "Public/External" not in plan and "response_suggestion" not in plan
    rows = sorted(made.collect())
    assert len(rows) == 520
    catalog.records(spark, folder)
    assert sorted(catalog.registered()["mitre_enrich"](spark, folder).collect()) == rows


def test_wide_projections_stay_compilable(spark):
    """The JVM interprets methods of more than 8,000 bytes for ever."""
    assert int(prepare(spark).conf.get("spark.sql.codegen.hugeMethodLimit")) <= 8000


def test_records_that_are_only_counted_have_no_advice(spark, tmp_path):
    folder = events_file(spark, tmp_path, 500)
    stats = catalog.registered()["quality_stats"](spark, folder).first()
    assert stats["total_lines"] == 520 and stats["rejected_records"] == 30 and stats["filtered_by_time"] > 0
    assert not {"response_suggestion", "mitre_ids", "agent_ip"} & set(catalog.damaged(spark, folder).columns)
