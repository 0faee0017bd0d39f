"""The registered queries: every operator over the given tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from alertlake import dims
from alertlake.functions import clock, ip, jsontext, scoring, text
from alertlake.operators import filters, incidents, networks, normalize, quality, sessions, summaries, views
from alertlake.operators.compromise import is_chain
from alertlake.operators.outages import agent_outages
from alertlake.operators.ranges import ranked
from alertlake.plans import publish as bundles
from alertlake.plans.analysis import Options, Report, accepted, load_records, tables_of
from alertlake.plans.publish import JSON_INCIDENTS, summary_text, write_csv
from alertlake.session import discard_written, prepare, work_dir, written
from alertlake.sources import event_alerts, lines

WINDOW = 1440
FILTERS = Options(
    min_level=3, since="2024-01-05T00:00:00+00:00", until="2024-01-25T00:00:00+00:00", scope_only=True
)
LINE_LIMIT = 500
# Names of the tables that several queries share.
SHARED = [
    "lines", "judged", "damaged", "records", "alerts", "cells", "matches", "session-facts", "shared-lines", "session-alerts",
    "session-lists", "urgent-incidents", "incidents",
]
Query = Callable[[SparkSession, str], DataFrame]
_registry: dict[str, Query] = {}
_tables: dict[str, object] = {}
_tables_of: list[tuple] = []


def query(function: Query, name: str | None = None) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return function(prepare(spark), sf_dir)

    _registry[name or function.__name__] = run
    return function


def registered() -> dict[str, Query]:
    return dict(_registry)


def _made(spark: SparkSession, sf_dir: str) -> dict[str, object]:
    """The shared tables that were built so far for this input.

    An input is its path with sizes and times of its files; another one starts afresh, and the
    tables of the one before are deleted.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{sf_dir}/events.parquet")
    state = tuple(map(tuple, files.select("path", "length", "modificationTime").orderBy("path").collect()))
    now = (spark.sparkContext.applicationId, sf_dir, state)
    if _tables_of != [now]:
        if _tables_of and _tables_of[0][0] == now[0]:
            discard_written(spark, *SHARED)
        _tables.clear()
        _tables_of[:] = [now]
    return _tables


def _shared(name: str, spark: SparkSession, sf_dir: str, build: Callable[[], object]):
    """Tables many queries start from are built once for the latest input."""
    made = _made(spark, sf_dir)
    if name not in made:
        made[name] = build()
    return made[name]


def damaged_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shared("damaged_lines", spark, sf_dir, lambda: written(
        event_alerts.damaged_lines(spark, sf_dir), "lines"))


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers and statuses of the damaged lines: their alerts are not made for these alone."""
    made = _made(spark, sf_dir)
    if "damaged" in made:
        return made["damaged"].select("record_number", "line_status")
    statuses = lines.judged_lines(event_alerts.damaged_lines(spark, sf_dir), event_alerts.LINE_CAP)
    return _shared("judged", spark, sf_dir, lambda: written(statuses.select("record_number", "line_status"), "judged"))


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shared("records", spark, sf_dir, lambda: written(
        load_records(event_alerts.alert_lines(spark, sf_dir)), "records"))


# What the counters of lines, filters, copies and kept alerts are taken from.
COUNTED = [
    "record_number", "n_bytes", "line_status", "drop_reason", "event_us", "manager_name", "agent_id", "event_id",
    "rule_level", "risk_score", "source_ip", "target_user", "full_log", "classification_confidence",
]


def damaged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of the damaged lines, as far as they are counted."""
    options = Options(**{**FILTERS.__dict__, "max_line_bytes": event_alerts.LINE_CAP})
    return _shared("damaged", spark, sf_dir, lambda: written(
        load_records(event_alerts.damaged_lines(spark, sf_dir), options).select(*COUNTED), "damaged"))


def alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shared("alerts", spark, sf_dir, lambda: written(accepted(records(spark, sf_dir)), "alerts"))


def correlation(spark: SparkSession, sf_dir: str) -> incidents.Correlation:
    return _shared("correlation", spark, sf_dir, lambda: incidents.correlate(alerts(spark, sf_dir), WINDOW))


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shared("incidents", spark, sf_dir, lambda: incidents.written_incidents(
        correlation(spark, sf_dir), facts(spark, sf_dir)))


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The numbers of all incidents, without the texts of their alerts."""
    return _shared("facts", spark, sf_dir, lambda: incidents.session_facts(correlation(spark, sf_dir)))


def counted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Incidents for those who count them by key, score or risk: their texts are not made for these alone."""
    made = _made(spark, sf_dir)
    return made["incidents"] if "incidents" in made else _shared("listed", spark, sf_dir, lambda: incidents.listed(
        correlation(spark, sf_dir), facts(spark, sf_dir)))


def described(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Some columns of all incidents: of the written incidents if they are there, or if lists have to be
    made for them, else only these are made."""
    if "incidents" in _made(spark, sf_dir) or not incidents.LISTED.isdisjoint(columns):
        return found(spark, sf_dir).select(*columns)
    return incidents.build_incidents(correlation(spark, sf_dir), list(columns), facts(spark, sf_dir))


def urgent(spark: SparkSession, sf_dir: str, n: int) -> DataFrame:
    """Incidents among which the n most urgent are."""
    made = _made(spark, sf_dir)
    return made["incidents"] if "incidents" in made else incidents.most_urgent(correlation(spark, sf_dir), facts(spark, sf_dir), n)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(
        F.col("event_id").alias("e"), F.col("user_id").alias("u"), "value", "event_type",
        F.unix_micros(F.date_trunc("millisecond", F.col("ts").cast("timestamp"))).alias("event_us"),
    )


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")


def pick(selector: Column, *choices: Column | str) -> Column:
    """The choice with the selector's value."""
    return F.get(F.array(*[c if isinstance(c, Column) else F.lit(c) for c in choices]), selector.cast("int"))


# ------------------------------------------------------------------ input


# Lines of one written alert file, and how many kilobytes of text one block of it has for a million lines.
FILE_LINES = 250_000
BLOCK_KB = 1000


def _alert_files(spark: SparkSession, sf_dir: str) -> tuple[list[str], int]:
    """The alert lines as files in order, a folder of plain parts, then one of packed parts, and how many lines there are.

    The number of files grows with the lines.
    """
    rows = event_alerts.alert_lines(spark, sf_dir).filter(F.col("record_number") < event_alerts.DUPLICATE_BASE)
    root = f"{work_dir(spark).rstrip('/')}/alert-files-{uuid.uuid4().hex}"
    n, middle = rows.agg(F.count("*"), F.coalesce(F.percentile_approx("record_number", 0.5), F.lit(0))).first()
    files = max(4, n // (2 * FILE_LINES))
    parts = {"a-plain": F.col("record_number") <= middle, "b-packed": F.col("record_number") > middle}
    for name, mine in parts.items():
        dealt = rows.filter(mine).repartitionByRange(files, "record_number").sortWithinPartitions("record_number")
        codec = {"compression": "gzip"} if name == "b-packed" else {}
        dealt.select("value").write.options(**codec).text(f"{root}/{name}")
    return [f"{root}/{name}" for name in parts], n


def _numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of the files, scanned in small splits, so that most files are several blocks.

    Splits grow with the lines, so that the tasks, each of which reports to the driver, stay a few hundred.
    """
    files, n = _alert_files(spark, sf_dir)
    setting = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(setting)
    spark.conf.set(setting, f"{max(64, n * BLOCK_KB // 1_000_000)}k")
    try:
        return lines.numbered_lines(spark, files)
    finally:
        spark.conf.set(setting, before)


@query
def src_lines(spark, sf_dir):
    scanned = _numbered(spark, sf_dir)
    return scanned.agg(F.count("*").alias("n_lines"), F.sum(F.octet_length("value")).alias("n_bytes"))


@query
def src_line_number(spark, sf_dir):
    return _numbered(spark, sf_dir).select("record_number", F.md5("value").alias("line_md5"))


@query
def ingest_strict(spark, sf_dir):
    """What the strict gate decides on: rejected lines by kind, and whether the run is refused."""
    counts = judged(spark, sf_dir).agg(*[
        F.count_if(F.col("line_status") == status).alias(f"n_{status}") for status in lines.REJECTED
    ])
    return counts.withColumn("refused", sum(F.col(f"n_{status}") for status in lines.REJECTED) > 0)


@query
def normalize_all_rules(spark, sf_dir):
    """Every known rule, deep data, IPv6 sources, line breaks at text ends."""
    return load_records(event_alerts.rule_cycle_lines(spark, sf_dir)).select(
        "event_id", "rule_id", "alert_type", "event_category", "outcome", "classification_confidence", "rule_level",
        "risk_score", "source_ip", "source_scope", "full_log",
    )


@query
def sink_csv(spark, sf_dir):
    """Alerts written as CSV and read back."""
    path = f"{work_dir(spark).rstrip('/')}/csv-{uuid.uuid4().hex}"
    columns = ["event_id", "rule_id", "source_ip", "target_user", "full_log"]
    write_csv(alerts(spark, sf_dir), ["pos", *columns], path)
    schema = "pos bigint, " + ", ".join(f"{name} string" for name in columns)
    read = spark.read.schema(schema).csv(path, header=True, escape='"', multiLine=True, emptyValue="", nullValue="")
    return read.fillna("", columns)


def _report_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return written(quality.quality_stats(records(spark, sf_dir), alerts(spark, sf_dir)), "stats")


def _report(spark: SparkSession, sf_dir: str) -> Report:
    stats = _report_stats(spark, sf_dir)
    return Report(tables_of(alerts(spark, sf_dir), found(spark, sf_dir)), stats, Options(incident_window_minutes=WINDOW))


@query
def sink_json(spark, sf_dir):
    """The summary written as one JSON text; its headline numbers read back."""
    path = f"{work_dir(spark).rstrip('/')}/json-{uuid.uuid4().hex}"
    numbers = summaries.metrics(alerts(spark, sf_dir), counted(spark, sf_dir))
    top = urgent(spark, sf_dir, JSON_INCIDENTS)
    summary_text(numbers, _report_stats(spark, sf_dir), top, {"title": sf_dir}).write.text(path)
    value = spark.read.text(path, wholetext=True)
    names = ["total_alerts", "total_incidents", "source_ip_count", "asset_count", "highest_risk_score"]
    numbers = ", ".join(f"{n}: bigint" for n in names)
    kinds = f"metrics struct<{numbers}>, data_quality struct<included_alerts: bigint>, priority_incidents array<struct<risk_score: bigint>>"
    read = value.select(F.from_json("value", kinds).alias("s"))
    return read.select("s.metrics.*", F.col("s.data_quality.included_alerts").alias("included_alerts"), F.size("s.priority_incidents").alias("n_priority"))


@query
def publish_bundle(spark, sf_dir):
    """A report published, published again, and read back through the newest manifest."""
    root = f"{work_dir(spark).rstrip('/')}/bundle-{uuid.uuid4().hex}"
    made = _report(spark, sf_dir)
    bundles.publish_bundle(made, root)
    bundles.publish_bundle(made, root)
    manifest = bundles.read_manifest(spark, root)
    tables = []
    for name, n in sorted(manifest["rows"].items()):
        table = bundles.read_bundle(spark, root, name, manifest)
        head = [F.lit(manifest["version"]).alias("version"), F.lit(name).alias("table_name"), F.lit(n).cast("bigint").alias("n_written"), F.lit(len(table.columns)).alias("n_columns")]
        tables.append(table.agg(F.count("*").alias("n_read")).select(*head, "n_read"))
    return reduce(DataFrame.unionByName, tables)


@query
def ingest_line_status(spark, sf_dir):
    judged = lines.judged_lines(event_alerts.damaged_lines(spark, sf_dir), event_alerts.LINE_CAP)
    return judged.select("record_number", "line_status", "n_bytes")


@query
def ingest_quarantine(spark, sf_dir):
    judged = lines.judged_lines(damaged_lines(spark, sf_dir), event_alerts.LINE_CAP)
    return judged.filter(lines.is_status(*lines.REJECTED)).select(
        "record_number", "line_status", F.md5("value").alias("line_md5")
    )


@query
def ingest_reject_samples(spark, sf_dir):
    samples = lines.reject_samples(judged(spark, sf_dir))
    return samples.select("line_status", F.array_join(F.col("samples").cast("array<string>"), ",").alias("samples"))


@query
def ingest_line_limit(spark, sf_dir):
    numbered = damaged_lines(spark, sf_dir)
    reached = numbered.agg(F.max(F.col("record_number") > LINE_LIMIT)).scalar()
    return lines.line_prefix(numbered, LINE_LIMIT).select(
        "record_number", reached.alias("line_limit_reached")
    )


@query
def ingest_byte_budget(spark, sf_dir):
    numbered = damaged_lines(spark, sf_dir)
    total = numbered.agg(F.sum(F.octet_length("value") + 1).cast("bigint").alias("input_bytes"))
    return total.withColumn("over_budget", F.col("input_bytes") > 256 * 1024)


def _stats(spark, sf_dir) -> DataFrame:
    judged = damaged(spark, sf_dir)
    return quality.quality_stats(judged, accepted(judged))


@query
def quality_stats(spark, sf_dir):
    stats = _stats(spark, sf_dir)
    return stats.withColumns({
        n: F.array_join(F.col(n).cast("array<string>"), ",") for n in stats.columns if n.endswith("samples")
    })


@query
def quality_table(spark, sf_dir):
    judged = damaged(spark, sf_dir)
    kept = accepted(judged)
    numbers = kept.agg(
        F.count_if(F.col("source_ip") == dims.MISSING).alias("unknown_source_alerts"),
        F.count_if(F.col("classification_confidence") == "Low").alias("low_confidence_classifications"),
    )
    return quality.quality_table(quality.quality_stats(judged, kept), numbers)


# ------------------------------------------------------- scalar functions


@query
def fn_clean_text(spark, sf_dir):
    cleaned = text.clean_text(F.col("text"))
    return documents(spark, sf_dir).select(
        "doc_id", F.length(cleaned).alias("n"), F.md5(cleaned).alias("cleaned_md5")
    )


@query
def fn_unique(spark, sf_dir):
    words = documents(spark, sf_dir).select(
        "doc_id", text.distinct_texts(F.split("text", " ")).alias("words")
    )
    return words.select("doc_id", F.size("words").alias("n"), F.md5(F.array_join("words", " ")).alias("words_md5"))


@query
def csv_safe(spark, sf_dir):
    prefix = pick(F.col("doc_id") % 6, "", "=", " +", "\ufeff-", "\u200b@", "x")
    cell = F.when(F.col("doc_id") % 7 == 0, "-").otherwise(F.concat(prefix, "text"))
    return documents(spark, sf_dir).select("doc_id", F.md5(text.formula_safe(cell)).alias("cell_md5"))


@query
def fn_log_source_ip(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", ip.log_ip(F.col("text")).alias("source_ip"))


@query
def fn_log_username(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", text.log_user(F.col("text")).alias("username"))


def _json_value(json: Column) -> Column:
    """The marked value of member v of a one-member object."""
    line = F.concat(F.lit('{"v":'), json, F.lit("}"))
    return jsontext.sealed_object(line, "v")["_"]["_v"]


@query
def fn_normalize_list(spark, sf_dir):
    u = F.col("u").cast("string")
    json = pick(
        F.col("e") % 6,
        F.concat(F.lit('["b'), u, F.lit('","a","b'), u, F.lit('",""," c ","-",null]')),
        F.concat(F.lit('"  s'), u, F.lit('"')), "null", '""', u, '[1,true,"\\"q\\""]',
    )
    return events(spark, sf_dir).withColumn("v", _json_value(json)).select(
        "e", F.array_join(jsontext.text_list(F.col("v")), "|").alias("items")
    )


@query
def fn_coerce_int(spark, sf_dir):
    u = F.col("u").cast("string")
    json = pick(
        F.col("e") % 9, u, F.concat(F.lit('"'), u, F.lit('"')), F.concat(F.lit('" -'), u, F.lit(' "')),
        '"5.7"', "5.7", '"x"', "null", "true", '"1_0"',
    )
    return events(spark, sf_dir).withColumn("v", _json_value(json)).select(
        "e", jsontext.number(F.col("v"), 42).alias("n")
    )


@query
def fn_level_clamp(spark, sf_dir):
    return events(spark, sf_dir).select("e", text.clamp_level(F.floor("value") - 5).alias("level"))


@query
def fn_parse_timestamp(spark, sf_dir):
    at = F.timestamp_micros("event_us")

    def shaped(pattern: str, suffix: str = "") -> Column:
        return F.concat(F.date_format(at, pattern), F.lit(suffix))

    stamp = pick(
        F.col("e") % 11,
        shaped("yyyy-MM-dd'T'HH:mm:ss.SSS", "+0800"), shaped("yyyy-MM-dd'T'HH:mm:ss.SSS", "Z"),
        shaped("yyyy-MM-dd HH:mm:ss"), shaped("yyyy-MM-dd"), shaped("yyyyMMdd'T'HHmmss", "-05:30"),
        shaped("yyyy-MM-dd'T'HH:mm", "+01"), "2024", "not-a-time", "", "2024-02-30T00:00:00Z",
        "2024-W05-3T10:00",
    )
    return events(spark, sf_dir).select("e", clock.parse_time(stamp).alias("t")).select("e", "t.event_us", "t.offset_s")


@query
def fn_display_tz(spark, sf_dir):
    base = events(spark, sf_dir).select(
        "e", F.col("e").alias("record_number"), "event_us", F.lit(0).alias("offset_s"),
        F.lit("-").alias("timestamp"),
    )
    zones = {"shanghai": "Asia/Shanghai", "new_york": "America/New_York", "fixed": "+05:30", "utc": "UTC"}
    shown = [
        clock.iso_text(F.col("event_us"), clock.zone_offset(F.col("event_us"), z), "yyyy-MM-dd'T'HH:mm:ss.SSS").alias(n)
        for n, z in zones.items()
    ]
    moved = normalize.in_display_zone(base, "Asia/Shanghai")
    return moved.select("e", "timestamp", "offset_s", *shown)


@query
def json_find_value(spark, sf_dir):
    u = F.col("u").cast("string")

    def around(before: str, after: str) -> Column:
        return F.concat(F.lit(before), u, F.lit(after))

    json = pick(
        F.col("e") % 8,
        around('{"x":1,"SrcIP":"10.0.0.', '"}'),
        around('{"a":{"remote_ip":"deep"},"src_ip":"top', '"}'),
        around('{"a":[{"b":{"c":[{"clientip":"d', '"}]}}]}'),
        around('{"srcip":null,"z":{"src_ip":""},"y":{"sourceip":', "}}"),
        around('{"source_ip":["', '"],"k":"{\\"srcip\\":\\"fake\\"}"}'),
        around('{"a":{"srcip":"first"},"b":{"srcip":"second', '"}}'),
        around('{"srcip":"x","n":"', '","srcip":"last"}'),
        "{}",
    )
    found_value = jsontext.first_leaf(F.col("leaves"), dims.SOURCE_KEYS)
    return (
        events(spark, sf_dir).withColumn("v", _json_value(json))
        .withColumn("leaves", jsontext.leaves(F.col("v")))
        .select("e", found_value.alias("found"), F.size("leaves").alias("n_leaves"))
    )


def _address(selector: Column) -> Column:
    host = (F.col("u") % 250).cast("string")
    return pick(
        selector % 12,
        F.concat(F.lit("8.8.8."), host), F.concat(F.lit("[10.0.0."), host, F.lit("]")),
        F.concat(F.lit("192.168.1."), host, F.lit(":8080")), F.concat(F.lit("127.0.0."), host, F.lit("%lo")),
        F.concat(F.lit("169.254.0."), host), F.concat(F.lit("224.0.0."), host),
        F.concat(F.lit("172.16.0."), host), F.concat(F.lit("203.0.113."), host),
        F.concat(F.lit("256.1.1."), host), F.concat(F.lit("1.2.3.0"), host),
        F.concat(F.lit("100.64.0."), host, F.lit(":x")), "-",
    )


@query
def fn_normalize_ip(spark, sf_dir):
    return events(spark, sf_dir).select("e", ip.normalize_ip(_address(F.col("e"))).alias("address"))


@query
def fn_first_valid_ip(spark, sf_dir):
    e = F.col("e")
    return events(spark, sf_dir).select(
        "e", ip.first_ip(_address(e + 8), _address(e + 10), _address(e)).alias("address")
    )


@query
def fn_ip_scope(spark, sf_dir):
    return events(spark, sf_dir).select("e", ip.ip_scope(ip.normalize_ip(_address(F.col("e")))).alias("scope"))


def _address6() -> Column:
    """IPv6 texts in many spellings, one with a line break behind it."""
    tail = F.hex(F.col("u") + 1)
    return pick(
        F.col("e") % 6, F.concat(F.lit("2001:DB8:0:0:0:0:0:"), tail), F.concat(F.lit("[FE80::"), tail, F.lit("%eth0]")), "0:0:0:0:0:0:0:1",
        F.concat(F.lit("ff02:0::"), tail), F.concat(F.lit("fd00:0:0:1:0:0:0:"), tail), F.concat(F.lit("2606:4700::00"), F.lpad(tail, 2, "0"), F.lit("\n")),
    )


@query
def fn_normalize_ip6(spark, sf_dir):
    return events(spark, sf_dir).filter("u < 255").select("e", ip.normalize_ip(_address6()).alias("address"))


@query
def fn_ip6_scope(spark, sf_dir):
    return events(spark, sf_dir).filter("u < 255").select("e", ip.ip_scope(ip.normalize_ip(_address6())).alias("scope"))


@query
def scope_by_networks(spark, sf_dir):
    """Addresses of events against one network per user, four lengths, ranks with ties."""
    u = F.col("u")
    second, third = (u % 20).cast("string"), (u % 7).cast("string")
    network = pick(
        u % 4, F.concat(F.lit("10."), second, F.lit("."), third, F.lit(".77/24")), F.concat(F.lit("10."), second, F.lit(".0.0/16")),
        F.concat(F.lit("10."), second, F.lit("."), third, F.lit("."), (u % 250).cast("string")), F.concat(F.lit("10."), second, F.lit(".4.0/22")),
    )
    users = events(spark, sf_dir).select("u").distinct()
    table = networks.network_table(users.select(network.alias("network"), F.concat(F.lit("site "), (u % 9).cast("string")).alias("label"), (u % 5).alias("rank")))
    e = F.col("e")
    parts = [(e % n).cast("string") for n in (25, 7, 250)]
    address = pick(e % 10, *[F.concat(F.lit("10."), F.concat_ws(".", *parts))] * 8, "-", F.concat(F.lit("::ffff:10."), F.concat_ws(".", *parts)))
    return networks.with_network(events(spark, sf_dir).select("e", address.alias("address")), "address", table)


@query
def fn_normalize_username(spark, sf_dir):
    u = F.concat(F.lit("User"), F.col("u").cast("string"))
    name = pick(
        F.col("e") % 8, u, "By", "(null)", "N/A", "", F.concat(F.lit(" "), u, F.lit("\n")), "unknown", "Nonesuch"
    )
    return events(spark, sf_dir).select(
        "e", text.known_user(text.clean_text(name)).alias("username")
    )


@query
def fn_severity(spark, sf_dir):
    return events(spark, sf_dir).select("e", scoring.severity(F.floor("value") % 17).alias("severity"))


@query
def fn_risk_level(spark, sf_dir):
    return events(spark, sf_dir).select("e", scoring.risk_level(F.floor("value") % 101).alias("risk_level"))


@query
def fn_format_time(spark, sf_dir):
    shift = pick(F.col("u") % 3, F.lit(28800), F.lit(0), F.lit(-19800))
    return events(spark, sf_dir).select(
        "e", clock.iso_text(F.col("event_us"), shift).alias("seconds"),
        clock.iso_text(F.col("event_us"), shift, "yyyy-MM-dd'T'HH:mm").alias("minutes"),
    )


@query
def fn_duration(spark, sf_dir):
    return events(spark, sf_dir).select("e", text.duration_text(F.floor(F.col("value") * 37) - 50).alias("duration"))


# ---------------------------------------------------------- normalisation


@query
def normalize_alerts(spark, sf_dir):
    # Of the written records: a filter on lines still to be parsed would parse each of them twice.
    return records(spark, sf_dir).filter(lines.is_status("ok")).select(*dims.ALERT_COLUMNS)


def _record_fields(name: str, *columns: str) -> None:
    """A few fields of every record: of the written records if they are there, else only these are made."""
    def run(spark, sf_dir):
        made = _made(spark, sf_dir).get("records")
        rows = load_records(event_alerts.alert_lines(spark, sf_dir)) if made is None else made
        return rows.select("record_number", *columns)

    query(run, name)


_record_fields("source_attribution", "source_ip", "source_scope", "source_confidence", "destination_ip")
_record_fields("user_attribution", "username", "actor_user", "target_user", "command")
_record_fields("affected_asset", "affected_asset", "agent_name", "agent_ip", "manager_name")
_record_fields("alert_risk_score", "rule_level", "rule_severity", "risk_score", "risk_level")
_record_fields("mitre_enrich", "mitre_ids", "mitre_tactics", "mitre_techniques", "attack_stage")
_record_fields("response_text", "response_suggestion")

CLASS_COLUMNS = [
    "alert_type", "event_category", "outcome", "classification_confidence", "classification_reason",
]


@query
def classify_exact(spark, sf_dir):
    rule = pick(F.col("e") % (len(dims.RULES) + 2), *sorted(dims.RULES), "1", "-")
    rules = events(spark, sf_dir).select("e", rule.alias("rule"))
    entries = rules.withColumn("entry", normalize.rule_entry(F.col("rule")))
    found_class = normalize.classify_exact(F.col("entry"), F.col("rule"))
    return entries.select("e", found_class.alias("c")).select("e", "c.*")


CONTEXT_GROUPS = [
    "sshd", "ssh,ssh_bruteforce", "ssh_invalid_user", "ssh_user_enum", "authentication_failed", "pam",
    "authentication_success", "sudo", "syscheck", "fim", "vulnerability-detector", "rootcheck", "trojan",
    "port_scan", "network_scan", "web", "accesslog", "web_scan", "web_dir_bruteforce", "syslog", "ssh,web",
]
CONTEXT_TEXTS = [
    "plain", "Brute Force seen", "Invalid User x", "username enumeration", "Authentication Failure", "was denied",
    "it FAILED", "agent sqlmap/1.0", "GET /a 404 9",
]


@query
def classify_context(spark, sf_dir):
    e = F.col("e")
    groups = F.split(pick(e % len(CONTEXT_GROUPS), *CONTEXT_GROUPS), ",")
    found_class = normalize.classify_context(
        groups, pick(e % len(CONTEXT_TEXTS), *CONTEXT_TEXTS), F.concat(F.lit("log "), e.cast("string"))
    )
    return events(spark, sf_dir).select("e", found_class.alias("c")).select("e", "c.*")


# ---------------------------------------------------------------- filters


@query
def filter_min_level(spark, sf_dir):
    return records(spark, sf_dir).filter(filters.above_level(FILTERS.min_level)).select("record_number", "rule_level")


@query
def filter_time_range(spark, sf_dir):
    return records(spark, sf_dir).filter(filters.in_time_range(*FILTERS.bounds())).select("record_number", "event_us")


@query
def filter_scope(spark, sf_dir):
    return records(spark, sf_dir).filter(filters.in_scope()).select("record_number", "event_category")


@query
def filter_counts(spark, sf_dir):
    reason = filters.drop_reason(FILTERS.min_level, *FILTERS.bounds(), FILTERS.scope_only)
    return records(spark, sf_dir).groupBy(F.coalesce(reason, F.lit("kept")).alias("reason")).agg(
        F.count("*").alias("n")
    )


@query
def dedup_best(spark, sf_dir):
    return alerts(spark, sf_dir).select("record_number", "pos", "copies", "event_id", "rule_level", "risk_score")


@query
def dedup_count(spark, sf_dir):
    return alerts(spark, sf_dir).agg(F.sum(F.col("copies") - 1).alias("duplicates"), F.count("*").alias("kept"))


@query
def export_alerts(spark, sf_dir):
    return alerts(spark, sf_dir).select(*dims.ALERT_COLUMNS)


# -------------------------------------------------------------- incidents


@query
def correlation_key(spark, sf_dir):
    return correlation(spark, sf_dir).alerts.select("record_number", *sessions.KEY_TEXTS)


@query
def sessionize(spark, sf_dir):
    run = correlation(spark, sf_dir)
    return sessions.with_sessions(run.alerts, run.cells).select("record_number", "session_us", "solo")


@query
def failure_chain(spark, sf_dir):
    cells = correlation(spark, sf_dir).cells.filter(F.col("event_category") == "Credential Attack")
    return sessions.session_totals(cells).withColumn("is_chain", is_chain()).drop("key_hash", "event_category", "solo")


@query
def compromise_match(spark, sf_dir):
    return correlation(spark, sf_dir).matches.select(
        *[n for n in sessions.KEY_TEXTS if n != "event_category"], "session_us", "record_number", "success_us"
    )


@query
def compromise_consume(spark, sf_dir):
    members = correlation(spark, sf_dir).members
    return members.filter(F.col("alert_type") == "SSH Authentication Success").select(
        "record_number", "event_category", "identity", "matched"
    )


def _outages(spark, sf_dir):
    run = correlation(spark, sf_dir)
    visible = run.alerts.filter(F.col("event_category") == "Agent Visibility")
    return agent_outages(sessions.with_sessions(visible, run.cells)).select(
        "manager_name", "agent_id", "affected_asset", "session_us", "solo", "stop_count", "start_count",
        "recovered_count", "recovered_seconds", "outstanding",
    )


query(_outages, "agent_outages")


def _incident_fields(name: str, *columns: str) -> None:
    def run(spark, sf_dir):
        return described(spark, sf_dir, *columns)

    query(run, name)


def _incidents(spark, sf_dir):
    return incidents.build_incidents(correlation(spark, sf_dir), dims.INCIDENT_COLUMNS, facts(spark, sf_dir))


query(_incidents, "incidents")
_incident_fields("export_incidents", *dims.INCIDENT_COLUMNS)
_incident_fields("incident_score", "incident_id", "event_count", "risk_score", "risk_level", "status")
_incident_fields("incident_confidence", "incident_id", "event_count", "max_rule_level", "source_ip", "confidence")
_incident_fields("incident_id", "incident_id", "manager_name", "agent_id", "first_seen", "event_category")
_incident_fields("incident_evidence", "incident_id", "evidence", "summary")


@query
def compromise_incidents(spark, sf_dir):
    made = _made(spark, sf_dir)
    if "incidents" in made:
        return made["incidents"].filter("compromised").select(*dims.INCIDENT_COLUMNS)
    return incidents.build_incidents(
        correlation(spark, sf_dir), dims.INCIDENT_COLUMNS, facts(spark, sf_dir).filter("compromised"), part=True
    )


@query
def incident_queue(spark, sf_dir):
    rows = described(spark, sf_dir, "incident_id", "title", "risk_level", *incidents.ORDER)
    queue = ranked(rows, *incidents.queue_order())
    return queue.select("priority", "incident_id", "title", "risk_score", "risk_level", "event_count", "last_seen")


# -------------------------------------------------------------- summaries


@query
def summary_by_source(spark, sf_dir):
    return summaries.by_source(alerts(spark, sf_dir), counted(spark, sf_dir))


@query
def summary_by_type(spark, sf_dir):
    return summaries.by_type(alerts(spark, sf_dir))


@query
def summary_by_asset(spark, sf_dir):
    return summaries.by_asset(alerts(spark, sf_dir), counted(spark, sf_dir))


@query
def summary_by_rule(spark, sf_dir):
    return summaries.by_rule(alerts(spark, sf_dir))


@query
def mitre_summary(spark, sf_dir):
    return summaries.by_mitre(alerts(spark, sf_dir))


@query
def metrics(spark, sf_dir):
    return summaries.metrics(alerts(spark, sf_dir), counted(spark, sf_dir))


@query
def timeline(spark, sf_dir):
    return summaries.timeline(alerts(spark, sf_dir))


@query
def top5_values(spark, sf_dir):
    return summaries.top_values(
        alerts(spark, sf_dir), ["alert_type"], {"top_users": F.col("target_user"), "top_sources": F.col("source_ip")}
    )


@query
def ordered_distinct(spark, sf_dir):
    return summaries.ordered_values(alerts(spark, sf_dir), ["manager_name", "agent_id"], "target_user", "target_users")


@query
def ordered_distinct_rows(spark, sf_dir):
    return summaries.first_places(alerts(spark, sf_dir), ["manager_name", "agent_id"], "target_user")


@query
def incident_counts(spark, sf_dir):
    return summaries.incident_counts(counted(spark, sf_dir), summaries.ASSET_KEYS)


@query
def recommendations(spark, sf_dir):
    return summaries.recommendations(described(spark, sf_dir, *dims.RECOMMENDATION_COLUMNS))


# ------------------------------------------------------------------ views


@query
def report_privilege(spark, sf_dir):
    return views.privilege(alerts(spark, sf_dir))


@query
def report_authentication(spark, sf_dir):
    return views.authentication(alerts(spark, sf_dir))


@query
def report_agent_health(spark, sf_dir):
    return views.agent_health(alerts(spark, sf_dir))


def _shown(name: str, table: str, build: Query) -> None:
    def run(spark, sf_dir):
        return views.shown(build(spark, sf_dir), table)

    query(run, name)


_shown("report_top_sources", "by_source", summary_by_source)
_shown("report_top_assets", "by_asset", summary_by_asset)
_shown("report_top_types", "by_type", summary_by_type)
_shown("report_top_rules", "by_rule", summary_by_rule)
_shown("report_top_mitre", "by_mitre", mitre_summary)


@query
def report_priority_incidents(spark, sf_dir):
    return views.priority_incidents(urgent(spark, sf_dir, 12))


@query
def report_risk_distribution(spark, sf_dir):
    return views.risk_distribution(metrics(spark, sf_dir))


@query
def report_timeline_share(spark, sf_dir):
    return views.timeline_share(timeline(spark, sf_dir))


@query
def report_posture(spark, sf_dir):
    return views.posture(metrics(spark, sf_dir), urgent(spark, sf_dir, 1))
