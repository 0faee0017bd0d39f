"""Report outputs: one CSV folder per table and a JSON summary, in a fresh folder or as a versioned bundle."""

from __future__ import annotations

import hashlib
import json
import uuid
from dataclasses import asdict
from datetime import datetime, timezone

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from alertlake import dims
from alertlake.functions.text import formula_safe
from alertlake.operators.quality import quality_table
from alertlake.operators.views import priority_incidents
from alertlake.plans.analysis import Report
from alertlake.session import remove, shuffles_dropped

JSON_INCIDENTS = 10
# Ending of the tables of a bundle, which are packed. Files of several lines a cell are read whole, packed or not.
PACKED = ".gz"


def csv_table(df: DataFrame, columns: list[str]) -> DataFrame:
    """The columns in order, missing ones and nulls empty, formulas quoted."""
    types = dict(df.dtypes)
    cells = []
    for name in columns:
        if name not in types:
            cells.append(F.lit("").alias(name))
        elif types[name] == "string":
            cells.append(F.coalesce(formula_safe(F.col(name)), F.lit("")).alias(name))
        else:
            cells.append(F.col(name))
    return df.select(*cells)


def write_csv(df: DataFrame, columns: list[str], path: str) -> None:
    """A folder of CSV files, packed if its name says so."""
    with shuffles_dropped(df.sparkSession):
        csv_table(df, columns).write.csv(
            path, header=True, escape='"', emptyValue="", nullValue="",
            ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False,
            compression="gzip" if path.endswith(PACKED) else None,
        )


def summary_json(report: Report, context: dict) -> DataFrame:
    """One JSON text: context, headline numbers, data quality, most urgent incidents."""
    return summary_text(report.result.metrics, report.stats, report.result.incidents, context)


def summary_text(metrics: DataFrame, stats: DataFrame, incidents: DataFrame, context: dict) -> DataFrame:
    """The summary of its parts; of the incidents only the most urgent ones need be there."""
    top = priority_incidents(incidents, JSON_INCIDENTS)
    ranked = F.collect_list(F.struct(*dims.INCIDENT_COLUMNS)).alias("top")
    base = stats.sparkSession.range(1).select(F.lit(json.dumps(context, ensure_ascii=False)).alias("context"))
    return base.select(
        F.concat(
            F.lit('{"report":'), F.col("context"),
            F.lit(',"metrics":'), metrics.select(F.to_json(F.struct("*"))).scalar(),
            F.lit(',"data_quality":'), stats.select(F.to_json(F.struct("*"))).scalar(),
            F.lit(',"priority_incidents":'), top.agg(F.to_json(ranked)).scalar(),
            F.lit("}"),
        ).alias("value")
    )


def publish(report: Report, target: str, context: dict | None = None) -> list[str]:
    """Writes all tables as `target`, which must not exist.

    Tables go to a staging folder beside it, which takes the target's name once all are complete;
    if one fails, the staging folder is deleted and there is no target. Parts of the alert table
    follow the line order; a part is sorted, the whole is not.
    """
    spark = report.stats.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(target)
    store = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if store.exists(path):
        raise ValueError(f"report target exists: {target}")
    staging = f"{target.rstrip('/')}.staging-{uuid.uuid4().hex}"
    try:
        names = _write_tables(report, staging, context)
        if not store.rename(spark._jvm.org.apache.hadoop.fs.Path(staging), path):
            raise OSError(f"could not move {staging} to {target}")
    except BaseException:
        remove(spark, staging)
        raise
    return names


def bundle_tables(report: Report) -> dict[str, tuple[DataFrame, list[str]]]:
    """The tables of a report by name, each with the columns it is written with."""
    result = report.result
    return {
        "cleaned_alerts": (result.alerts.repartitionByRange("pos").sortWithinPartitions("pos"), dims.ALERT_COLUMNS),
        "incidents": (result.incidents, dims.INCIDENT_COLUMNS),
        "summary_by_source_ip": (result.by_source, dims.SOURCE_SUMMARY_COLUMNS),
        "summary_by_alert_type": (result.by_type, dims.TYPE_SUMMARY_COLUMNS),
        "summary_by_asset": (result.by_asset, dims.ASSET_SUMMARY_COLUMNS),
        "summary_by_rule": (result.by_rule, dims.RULE_SUMMARY_COLUMNS),
        "mitre_attack_summary": (result.mitre, dims.MITRE_SUMMARY_COLUMNS),
        "response_recommendations": (result.recommendations, dims.RECOMMENDATION_COLUMNS),
        "alert_timeline": (result.timeline, dims.TIMELINE_COLUMNS),
        "data_quality": (
            quality_table(report.stats, result.metrics).orderBy("row"), ["metric", "value", "note"]
        ),
    }


def _write_summary(report: Report, target: str, context: dict | None) -> None:
    filled = {
        "generated_at": datetime.now(timezone.utc).isoformat(timespec="seconds"),
        "options": asdict(report.options), **(context or {}),
    }
    with shuffles_dropped(report.stats.sparkSession):
        summary_json(report, filled).coalesce(1).write.text(f"{target}/report_summary.json")


def _write_tables(report: Report, target: str, context: dict | None) -> list[str]:
    tables = bundle_tables(report)
    for name, (df, columns) in tables.items():
        write_csv(df, columns, f"{target}/{name}.csv")
    _write_summary(report, target, context)
    return [*[f"{n}.csv" for n in tables], "report_summary.json"]


class BundleMissing(LookupError):
    """There is no whole bundle at the place."""


def publish_bundle(report: Report, root: str, context: dict | None = None) -> dict:
    """Publishes a version of a report below `root` and returns its manifest.

    Tables are written under a run's own id, which nobody reads yet. The manifest, one small file
    that names the run and the rows of each table, is created last; with it the version is there,
    whole. Nothing is renamed, so object stores do as well. A run that dies leaves files that no
    manifest names; readers go on with the version before. Two publishers at once get a version each.
    The tables are packed, as all versions are kept; the manifest names their ending.
    """
    spark = report.stats.sparkSession
    run, rows = uuid.uuid4().hex, {}
    for name, (df, columns) in bundle_tables(report).items():
        seen = Observation(f"{name}-{run}")
        write_csv(df.observe(seen, F.count("*").alias("rows")), columns, f"{root}/runs/{run}/{name}.csv{PACKED}")
        rows[name] = seen.get["rows"]
    _write_summary(report, f"{root}/runs/{run}", context)
    made = {"run": run, "ending": f".csv{PACKED}", "created_at": datetime.now(timezone.utc).isoformat(timespec="seconds"), "rows": rows}
    version = max(_versions(spark, root), default=0) + 1
    while not _create(spark, _manifest_path(root, version), _sealed({"version": version, **made})):
        version += 1
    return {"version": version, **made}


def read_manifest(spark: SparkSession, root: str) -> dict:
    """The manifest of the newest version that was completely written."""
    for version in sorted(_versions(spark, root), reverse=True):
        text = spark.read.text(_manifest_path(root, version), wholetext=True).first()
        found = _unsealed(text["value"] if text else "")
        if found:
            return found
    raise BundleMissing(f"no published report at {root}")


def read_bundle(spark: SparkSession, root: str, table: str, manifest: dict | None = None) -> DataFrame:
    """A table of the newest version, or of the one whose manifest is given, as text columns."""
    found = manifest or read_manifest(spark, root)
    if table not in found["rows"]:
        raise BundleMissing(f"no table {table} in version {found['version']} at {root}")
    return spark.read.csv(
        f"{root}/runs/{found['run']}/{table}{found.get('ending', '.csv')}", header=True, escape='"', multiLine=True, emptyValue="", nullValue="",
    )


def _manifest_path(root: str, version: int) -> str:
    return f"{root}/manifests/{version:012d}.json"


def _sealed(manifest: dict) -> str:
    body = json.dumps(manifest, sort_keys=True)
    return f"{body}\n{hashlib.sha256(body.encode()).hexdigest()}\n"


def _unsealed(text: str) -> dict | None:
    """None for a manifest that was cut off while it was written."""
    body, _, seal = text.rstrip("\n").rpartition("\n")
    return json.loads(body) if body and hashlib.sha256(body.encode()).hexdigest() == seal else None


def _store(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def _versions(spark: SparkSession, root: str) -> list[int]:
    where, store = _store(spark, f"{root}/manifests")
    if not store.exists(where):
        return []
    names = [status.getPath().getName() for status in store.listStatus(where)]
    return [int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[0].isdigit()]


def _create(spark: SparkSession, path: str, text: str) -> bool:
    """Whether the file is new; one that is there already stays as it is."""
    where, store = _store(spark, path)
    if store.exists(where):
        return False
    try:
        out = store.create(where, False)
    except Py4JJavaError:
        if store.exists(where):
            return False
        raise
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    return True
