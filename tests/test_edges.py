"""Line breaks at a text's end, strict numbers, wide and deep lines, limits, failed publishing."""

import json
import time

import pytest
from pyspark.sql import functions as F

from alertlake.functions import ip, jsontext, text
from alertlake.operators import summaries
from alertlake.operators.ranges import ranked, running_total
from alertlake.plans import publish as publishing
from alertlake.plans.analysis import Options, report
from alertlake.sources.lines import numbered_lines
from tests.conftest import alerts_of, make_alert

BREAKS = ["\n", "\r\n", "\r", "\x85", " ", ""]


def one(spark, value, expression, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(expression(F.col("v")).alias("r")).first()["r"]


@pytest.mark.parametrize("end", BREAKS)
def test_a_break_at_the_end_is_no_plain_text(spark, end):
    quick = one(spark, f"abc{end}", text.clean_text)
    # The same text behind a character that no quick path takes.
    slow = one(spark, f"é abc{end}", text.clean_text)
    assert quick == slow.removeprefix("é ") and not any(ch in quick for ch in "\r\n\x85 ")
    assert one(spark, f"8.8.8.8{end}", ip.is_quad) is (end == "")
    assert one(spark, f"8.8.8.8{end}", ip.normalize_ip) == "8.8.8.8"


def test_breaks_make_no_second_source(spark):
    rows = [make_alert(str(i), data={"srcip": f"8.8.8.8{end}"}, agent_name=f"web-1{end}", full_log=f"x{end}") for i, end in enumerate(BREAKS)]
    alerts, _ = alerts_of(spark, rows)
    found = alerts.collect()
    assert {r.source_ip for r in found} == {"8.8.8.8"}
    assert not any(ch in r[n] for r in found for n in ("agent_name", "affected_asset", "full_log") for ch in "\r\n\x85 ")


def test_numbers_only_spark_reads_are_malformed(spark, tmp_path):
    path = tmp_path / "a.json"
    texts = ['{"a":+INF}', '{"a":-INF}', '{"a":+Infinity}', '{"a":-Infinity}', '{"a":NaN}', '{"a":"+INF"}', '[-INF]', '{"INF":1}']
    path.write_text("\n".join(texts) + "\n")
    stats = report(spark, str(path)).stats.first()
    assert (stats.parsed_records, stats.malformed_json) == (4, 4)


def test_wide_and_deep_lines_cost_in_proportion(spark):
    wide = json.dumps({"list": [{"k": i} for i in range(100_000)], "last": "x", "brackets": "[{" * 1000})
    deep = {"a": 1}
    for i in range(60):
        deep = {f"n{i}": deep, "a": i}

    def found(value):
        marked = jsontext.mark_strings(F.lit(value))
        return spark.range(1).select(jsontext.leaves(marked).alias("f")).select(
            F.size("f"), jsontext.first_leaf(F.col("f"), ["last"]), jsontext.first_leaf(F.col("f"), ["a"])).first()

    found(json.dumps(deep))
    began = time.perf_counter()
    assert tuple(found(wide)) == (100_002, "x", "-")
    assert time.perf_counter() - began < 20
    assert tuple(found(json.dumps(deep))) == (61, "-", "59")


def test_repeated_names_keep_the_last_value_in_the_first_place(spark):
    line = '{"b":1,"a":2,"b":{"c":3},"a":4,"d":5}'
    rows = spark.range(1).select(F.inline(jsontext.leaves(jsontext.mark_strings(F.lit(line))))).collect()
    assert [tuple(r) for r in rows] == [("a", "4"), ("d", "5"), ("c", "3")]


def test_no_line_is_lost_when_splits_change(spark, tmp_path):
    texts = [f"line {i} " + "x" * (i % 50) for i in range(20_000)]
    (tmp_path / "a.log").write_text("\n".join(texts[:15_000]) + "\n")
    (tmp_path / "b.log").write_text("\n".join(texts[15_000:]) + "\n")
    setting = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(setting)
    try:
        spark.conf.set(setting, "33000")
        lines = numbered_lines(spark, str(tmp_path / "*.log"))
        spark.conf.set(setting, "20000")
        assert {r.record_number: r.value for r in lines.collect()} == dict(enumerate(texts, 1))
    finally:
        spark.conf.set(setting, before)


def test_limits_are_not_negative_and_off_by_default(spark, tmp_path):
    for name in ("line_limit", "max_line_bytes", "max_input_bytes"):
        with pytest.raises(ValueError):
            Options(**{name: -1})
    path = tmp_path / "long.json"
    path.write_text(json.dumps(make_alert("long", full_log="x" * (2 << 20))) + "\n")
    assert report(spark, str(path)).stats.first().included_alerts == 1


def test_a_failed_table_leaves_no_target(spark, tmp_path, monkeypatch):
    path = tmp_path / "a.json"
    path.write_text(json.dumps(make_alert("1")) + "\n")
    made = report(spark, str(path))
    done, real = [], publishing.write_csv

    def failing(df, columns, target):
        if len(done) == 5:
            raise OSError("disk full")
        done.append(target)
        real(df, columns, target)

    monkeypatch.setattr(publishing, "write_csv", failing)
    with pytest.raises(OSError):
        publishing.publish(made, str(tmp_path / "out"))
    assert [p.name for p in tmp_path.iterdir()] == ["a.json"]
    monkeypatch.undo()
    assert len(publishing.publish(made, str(tmp_path / "out"))) == 11


def test_positions_and_running_totals_over_ranges(spark):
    df = spark.range(5000).select((F.col("id") * 37 % 5000).alias("k"), (F.col("id") % 3).alias("n"))
    places = ranked(df, F.col("k")).collect()
    assert all(r.priority == r.k + 1 for r in places) and len(places) == 5000
    totals = {r.k: (r.n, r.before) for r in running_total(df, "n", "before", "k").collect()}
    total = 0
    for k in range(5000):
        assert totals[k][1] == total
        total += totals[k][0]


def test_a_key_with_a_million_values_is_rows(spark):
    df = spark.range(1_000_000).select(F.lit("a").alias("k"), F.concat(F.lit("user"), F.col("id")).alias("v"), F.col("id").alias("pos"))
    rows = summaries.first_places(df.unionByName(df), ["k"], "v")
    assert rows.agg(F.count("*"), F.sum("pos")).first()[:] == (1_000_000, 499_999_500_000)
    few = df.filter("pos < 50")
    assert summaries.ordered_values(few, ["k"], "v", "vs").first()["vs"] == ", ".join(f"user{i}" for i in range(50))
