"""Files: numbering, gates, statuses."""

import gzip
import json

import pytest
from pyspark.sql import functions as F

from alertlake.operators.quality import InputRejected
from alertlake.plans.analysis import Options, report
from alertlake.sources.lines import counted_lines, first_files, numbered_lines
from tests.conftest import attack, make_alert


def write(path, rows, opener=open):
    with opener(path, "wb") as handle:
        for row in rows:
            handle.write((row if isinstance(row, bytes) else json.dumps(row).encode()) + b"\n")
    return str(path)


def test_numbers_follow_the_files_across_blocks(spark, tmp_path):
    texts = [b"line %d " % i + b"x" * (i % 97) for i in range(5000)]
    first, second = write(tmp_path / "a.json", texts[:3000]), write(tmp_path / "b.json", texts[3000:])
    packed = write(tmp_path / "c.json.gz", texts[:500], gzip.open)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        lines = numbered_lines(spark, [first, second, packed], partitions=5)
        rows = {r.record_number: r.value for r in lines.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert rows == {i: t.decode() for i, t in enumerate(texts + texts[:500], 1)}


def test_bad_lines_are_counted_once_and_kept_out(spark, tmp_path):
    good = make_alert("same")
    path = write(tmp_path / "alerts.json", [
        good, good, b"{not-json", ["not", "an", "object"], b"", b'{"id":"bad-\xff"}',
        make_alert("large", full_log="x" * 2000), b"\xef\xbb\xbf" + json.dumps(make_alert("bom")).encode(),
        b'{"id":"cr"}\r', b'{"id":1} trailing',
    ])
    stats = report(spark, path, Options(max_line_bytes=1500)).stats.first().asDict()
    assert {k: stats[k] for k in (
        "total_lines", "parsed_records", "duplicate_records", "malformed_json", "non_object_records",
        "blank_lines", "encoding_errors", "oversized_lines", "included_alerts", "rejected_records",
    )} == {
        "total_lines": 10, "parsed_records": 4, "duplicate_records": 1, "malformed_json": 2,
        "non_object_records": 1, "blank_lines": 1, "encoding_errors": 1, "oversized_lines": 1,
        "included_alerts": 3, "rejected_records": 5,
    }
    assert stats["malformed_line_samples"] == [3, 10]
    assert stats["parse_success_rate"] == 44.44
    with open(path, "rb") as handle:
        assert stats["input_bytes"] == len(handle.read())
    with pytest.raises(InputRejected):
        report(spark, path, Options(max_line_bytes=1500, strict=True))


def test_gzip_budget_limit_and_scope(spark, tmp_path):
    path = write(tmp_path / "alerts.json.gz", [attack(str(i), "2026-07-26T00:00:00Z") for i in range(10)], gzip.open)
    with pytest.raises(InputRejected):
        report(spark, path, Options(max_input_bytes=512))
    limited = report(spark, path, Options(line_limit=4, scope_only=True))
    stats = limited.stats.first()
    assert (stats.total_lines, stats.line_limit_reached, stats.included_alerts) == (4, True, 4)
    assert {r.alert_type for r in limited.result.alerts.collect()} == {"SSH Brute Force"}


def test_bounds_must_be_in_order():
    with pytest.raises(ValueError):
        Options(since="2026-02-01", until="2026-01-01").bounds()


def test_one_packed_file_is_normalised_by_all_cores(spark, tmp_path):
    texts = [json.dumps(make_alert(str(i), full_log="x" * 3000 + str(i * 7919))).encode() for i in range(20_000)]
    path = write(tmp_path / "alerts.json.gz", texts, gzip.open)
    lines, counts = counted_lines(spark, path)
    cores = spark.sparkContext.defaultParallelism
    assert counts == {"lines": 20_000, "bytes": sum(len(t) + 1 for t in texts)}
    assert lines.rdd.getNumPartitions() >= cores
    sizes = [r["count"] for r in lines.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) >= cores and max(sizes) < 3 * sum(sizes) / len(sizes)
    assert {r.record_number: len(r.value) for r in lines.collect()} == {i: len(t) for i, t in enumerate(texts, 1)}


def test_a_line_limit_opens_few_files(spark, tmp_path):
    for i in range(100):
        # From the eighth file on no file can be read.
        rows = [make_alert(f"{i}-{k}") for k in range(300)]
        if i < 7:
            write(tmp_path / f"a {i:03d} [x].json.gz", rows, gzip.open)
        else:
            (tmp_path / f"a {i:03d} [x].json.gz").write_bytes(b"not packed")
    folder = str(tmp_path)
    assert len(first_files(spark, folder, 1000)) == 7 and len(first_files(spark, folder, 299)) == 1
    assert numbered_lines(spark, folder, limit=1000).count() == 1001
    stats = report(spark, folder, Options(line_limit=1000)).stats.first()
    assert (stats.total_lines, stats.line_limit_reached, stats.included_alerts) == (1000, True, 1000)
    short = [str(tmp_path / f"a {i:03d} \\[x\\].json.gz") for i in range(2)]
    assert numbered_lines(spark, short, limit=600).count() == 600 and len(first_files(spark, short, 5000)) == 2


def test_counters_come_from_the_writing_itself(spark, tmp_path, monkeypatch):
    path = write(tmp_path / "alerts.json", [make_alert(str(i // 2)) for i in range(50)] + [b"{bad", b""])
    from alertlake.operators import quality
    from alertlake.plans import analysis

    seen = []
    monkeypatch.setattr(analysis, "stats_of_counts", lambda counts, records, limit: seen.append((counts, records)) or quality.stats_of_counts(counts, records, limit))
    made = report(spark, path, Options(min_level=1))
    stats = made.stats.first().asDict()
    (counts, records), = seen
    again = quality.quality_stats(records, made.result.alerts).first().asDict()
    assert stats == again and counts["total_lines"] == 52 and stats["duplicate_records"] == 25
    assert stats["malformed_line_samples"] == [51]
