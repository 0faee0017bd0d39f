"""Input quality: counters, gates and the long-form table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alertlake import dims
from alertlake.sources.lines import REJECTED, reject_samples

COUNTED = {
    "parsed_records": "ok", "blank_lines": "blank", "malformed_json": "malformed",
    "non_object_records": "non_object", "oversized_lines": "oversized", "encoding_errors": "encoding",
}
DROPPED = ["level", "time", "scope"]


class InputRejected(ValueError):
    """The input must not be reported on."""


def line_counts(line_limit: int = 0) -> dict[str, Column]:
    """Aggregates over judged lines (record_number, n_bytes, line_status, event_us, drop_reason).

    With a line limit the lines may hold later ones too: they only show that the limit was reached.
    """
    c = F.col
    within = c("record_number") <= (line_limit or 2**62)
    good = within & (c("line_status") == "ok")
    return {
        "total_lines": F.count_if(within),
        "input_bytes": F.coalesce(F.sum(F.when(within, c("n_bytes"))), F.lit(0)),
        "line_limit_reached": F.coalesce(F.max(~within), F.lit(False)),
        **{n: F.count_if(within & (c("line_status") == s)) for n, s in COUNTED.items()},
        "invalid_timestamps": F.count_if(good & c("event_us").isNull()),
        **{f"filtered_by_{r}": F.count_if(good & (c("drop_reason") == r)) for r in DROPPED},
    }


def alert_counts() -> dict[str, Column]:
    """Aggregates over the alerts that are left."""
    return {"included_alerts": F.count("*"), "duplicate_records": F.coalesce(F.sum(F.col("copies") - 1), F.lit(0))}


def _named(aggregates: dict[str, Column]) -> list[Column]:
    return [column.alias(name) for name, column in aggregates.items()]


def quality_stats(records: DataFrame, alerts: DataFrame, line_limit: int = 0) -> DataFrame:
    """One row of counters over all judged lines and the alerts left of them."""
    kept = alerts.agg(F.struct(*_named(alert_counts())).alias("k")).scalar()
    counted = records.agg(*_named(line_counts(line_limit))).withColumn("kept", kept)
    counted = counted.withColumns({n: F.col(f"kept.{n}") for n in alert_counts()}).drop("kept")
    return _with_samples(counted, records, line_limit)


def stats_of_counts(counts: dict, records: DataFrame, line_limit: int = 0) -> DataFrame:
    """quality_stats from `line_counts` and `alert_counts` that were taken while tables were written.

    Only where lines were rejected are their first numbers looked up.
    """
    spark = records.sparkSession
    rejected = sum(counts[n] for n, s in COUNTED.items() if s in REJECTED)
    kinds = {"line_limit_reached": "boolean"}
    row = spark.createDataFrame([tuple(counts.values())], ", ".join(f"{n} {kinds.get(n, 'bigint')}" for n in counts))
    return _with_samples(row, records if rejected else records.limit(0), line_limit)


def _with_samples(counted: DataFrame, records: DataFrame, line_limit: int) -> DataFrame:
    c = F.col
    samples = reject_samples(records.filter(c("record_number") <= (line_limit or 2**62))).agg(
        F.map_from_entries(F.collect_list(F.struct("line_status", "samples"))).alias("m")
    ).scalar()
    none = F.array().cast("array<bigint>")
    rejected = sum(c(n) for n, s in COUNTED.items() if s in REJECTED)
    judged = c("parsed_records") + c("rejected_records")
    rate = F.bround(F.try_divide(c("parsed_records"), judged) * 100, 2)
    return (
        counted.withColumns({"samples": samples, "rejected_records": rejected})
        .withColumns({
            "malformed_line_samples": F.coalesce(F.try_element_at("samples", F.lit("malformed")), none),
            "oversized_line_samples": F.coalesce(F.try_element_at("samples", F.lit("oversized")), none),
            "encoding_error_samples": F.coalesce(F.try_element_at("samples", F.lit("encoding")), none),
            "parse_success_rate": F.coalesce(rate, F.lit(100.0)),
        })
        .drop("samples")
    )


def check_byte_budget(stats: dict, max_input_bytes: int) -> None:
    if max_input_bytes and (stats["input_bytes"] or 0) > max_input_bytes:
        raise InputRejected(
            f"input has {stats['input_bytes']} bytes, more than max_input_bytes ({max_input_bytes})"
        )


def check_strict(stats: dict) -> None:
    if stats["rejected_records"]:
        raise InputRejected(
            "strict mode: "
            + ", ".join(f"{stats[n]} {s}" for n, s in COUNTED.items() if s in REJECTED)
        )


def _list_text(samples: str) -> Column:
    listed = F.concat(F.lit("["), F.array_join(F.transform(samples, lambda x: x.cast("string")), ", "), F.lit("]"))
    return F.when(F.size(samples) > 0, listed).otherwise(dims.MISSING)


def quality_table(stats: DataFrame, metrics: DataFrame) -> DataFrame:
    """Sixteen rows: what was counted, how much, and what it means."""
    c = F.col
    extra = metrics.select(
        F.struct("unknown_source_alerts", "low_confidence_classifications").alias("m")
    ).scalar()
    sample = "样例行号："
    # fixed values: labels and notes of the table
    rows = [
        ("读取物理行", c("total_lines"), "输入文件实际读取行数"),
        ("读取字节", c("input_bytes"), "压缩文件按解压后字节统计"),
        ("达到行数上限", F.when(c("line_limit_reached"), "是").otherwise("否"), "为“是”时报告仅覆盖输入前缀"),
        ("有效 JSON 对象", c("parsed_records"), F.format_string("解析成功率 %.2f%%", c("parse_success_rate"))),
        ("损坏 JSON", c("malformed_json"), F.concat(F.lit(sample), _list_text("malformed_line_samples"))),
        ("非对象 JSON", c("non_object_records"), "数组或标量不会作为告警处理"),
        ("超长输入行", c("oversized_lines"), F.concat(F.lit(f"超过 max_line_bytes；{sample}"), _list_text("oversized_line_samples"))),
        ("编码错误", c("encoding_errors"), F.concat(F.lit(f"非 UTF-8 输入已拒绝；{sample}"), _list_text("encoding_error_samples"))),
        ("重复事件 ID", c("duplicate_records"), "重复记录已排除"),
        ("无效时间戳", c("invalid_timestamps"), "使用时间筛选时会被排除"),
        ("等级过滤", c("filtered_by_level"), "低于 min_level"),
        ("时间过滤", c("filtered_by_time"), "不在 since/until 范围"),
        ("场景过滤", c("filtered_by_scope"), "scope_only 排除"),
        ("最终纳入", c("included_alerts"), "用于本报告"),
        ("来源未知", c("m.unknown_source_alerts"), "不会回退为 Agent/资产 IP"),
        ("低置信度分类", c("m.low_confidence_classifications"), "建议补充精确规则映射"),
    ]
    # end fixed values
    entries = [
        F.struct(
            F.lit(i).alias("row"), F.lit(label).alias("metric"), value.cast("string").alias("value"),
            (note if isinstance(note, Column) else F.lit(note)).alias("note"),
        )
        for i, (label, value, note) in enumerate(rows, 1)
    ]
    return stats.withColumn("m", extra).select(F.inline(F.array(*entries)))
