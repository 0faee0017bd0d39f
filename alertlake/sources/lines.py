"""Alert files: physical lines with stable numbers, judged one by one."""

from __future__ import annotations

import re
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from alertlake.functions import jsontext
from alertlake.functions.text import strip
from alertlake.operators.ranges import running_total
from alertlake.session import spread, written

SAMPLE_SIZE = 10
REJECTED = ["malformed", "non_object", "oversized", "encoding"]
ALERT_FIELDS = [
    "timestamp", "id", "rule", "agent", "manager", "decoder", "data", "location", "full_log",
]


def first_files(spark: SparkSession, paths: str | list[str], limit: int) -> list[str]:
    """The files, in name order, that hold the first `limit` lines and one more, if there are so many.

    Files are counted in growing batches, so a small limit opens few of many files.
    """
    def literal(uri: str) -> str:
        return re.sub(r"([\[\]{}*?\\])", r"\\\1", unquote(uri))

    files = sorted(spark.read.text(paths).inputFiles())
    taken, counted, step = 0, 0, 1
    while taken < len(files) and counted <= limit:
        batch = [literal(f) for f in files[taken:taken + step]]
        counted += spark.read.option("lineSep", "\n").text(batch).count()
        taken, step = taken + step, 2 * step
    return [literal(f) for f in files[:taken]]


def scan_lines(spark: SparkSession, paths: str | list[str]) -> tuple[DataFrame, dict]:
    """Lines of plain or .gz files as raw text, written once; only a newline ends a line.

    `seq` rises along every block of a file. All later steps read the written rows, so a line's
    block and place do not depend on how a second scan would split the files. Also how many lines
    and bytes there are, counted while they are written.
    """
    scanned = spark.read.option("lineSep", "\n").text(paths).select(
        "value",
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("seq"),
    )
    counts = {"lines": F.count("*"), "bytes": F.coalesce(F.sum(F.octet_length("value").cast("bigint") + 1), F.lit(0))}
    return written(spread(scanned, "seq"), "scanned", counts)


def block_offsets(lines: DataFrame) -> DataFrame:
    """How many lines precede each file block, files in name order: running sums over one row per
    block, dealt out by range, so that many files or blocks are many tasks."""
    blocks = lines.groupBy("path", "block").agg(
        F.count("*").alias("n"), F.min("seq").alias("first_seq")
    )
    return running_total(blocks, "n", "base", "path", "block").select("path", "block", "n", "first_seq", "base")


def numbered_lines(
    spark: SparkSession, paths: str | list[str], partitions: int | None = None, limit: int = 0
) -> DataFrame:
    """Lines with their position in the input, without a global sort: `counted_lines` without counts."""
    return counted_lines(spark, paths, partitions, limit)[0]


def counted_lines(
    spark: SparkSession, paths: str | list[str], partitions: int | None = None, limit: int = 0
) -> tuple[DataFrame, dict]:
    """(lines with their position in the input, how many lines and bytes were scanned).

    The offsets come from the written lines themselves, and every line must get a number. With a
    limit only the files that hold so many lines and one more are read, and only these lines are
    returned. `partitions` sets how many parts the lines are dealt out to.
    """
    lines, counts = scan_lines(spark, first_files(spark, paths, limit) if limit else paths)
    offsets, ends = written(
        block_offsets(lines), "blocks", {"n": F.coalesce(F.sum("n"), F.lit(0)), "top": F.coalesce(F.max(F.col("base") + F.col("n")), F.lit(0))}
    )
    if not counts["lines"] == ends["n"] == ends["top"]:
        raise RuntimeError(f"numbered {ends['n']} lines up to {ends['top']}, read {counts['lines']}")
    numbered = lines.join(offsets, ["path", "block"]).select(
        (F.col("base") + F.col("seq") - F.col("first_seq") + 1).alias("record_number"), "value"
    )
    numbered = line_prefix(numbered, limit + 1 if limit else 0)
    return numbered.repartition(partitions) if partitions else numbered, counts


def judged_lines(lines: DataFrame, max_line_bytes: int = 0) -> DataFrame:
    """Adds n_bytes (with the newline), line_status and the fields of the JSON object.

    The tests run in a fixed order and each line gets exactly one status.
    """
    value = F.col("value")
    n_bytes = (F.octet_length(value) + 1).cast("bigint")
    oversized = n_bytes > (max_line_bytes or 2**62)
    unmarked = F.when(value.startswith("\ufeff"), F.substr(value, F.lit(2))).otherwise(value)
    text = F.when(F.is_valid_utf8(value) & ~oversized, unmarked)
    c = F.col
    opened = F.btrim(c("text"), F.lit(" \t\r\n")).startswith("{")
    strict = ~jsontext.has_foreign_number(c("text"))
    is_object = c("opened") & jsontext.is_sound(c("parsed")) & strict
    is_other = ~c("opened") & jsontext.is_sound(jsontext.sealed_value(c("text"))) & strict
    status = (
        F.when(is_object, "ok")
        .when(c("oversized"), "oversized")
        .when(c("text").isNull(), "encoding")
        .when(strip(c("text")) == "", "blank")
        .when(is_other, "non_object")
        .otherwise("malformed")
    )
    return (
        lines.select("*", n_bytes.alias("n_bytes"), oversized.alias("oversized"), text.alias("text"))
        .withColumn("opened", F.coalesce(opened, F.lit(False)))
        .withColumn(
            "parsed", F.when(c("opened"), jsontext.sealed_object(c("text"), *ALERT_FIELDS))
        )
        .withColumn("line_status", status)
        .withColumn("fields", F.when(c("line_status") == "ok", c("parsed._")))
        .drop("oversized", "text", "opened", "parsed")
    )


def line_prefix(lines: DataFrame, limit: int) -> DataFrame:
    """The first `limit` lines by number; 0 keeps all."""
    return lines.filter(F.col("record_number") <= limit) if limit else lines


def reject_samples(judged: DataFrame) -> DataFrame:
    """Up to ten smallest line numbers per kind of rejected line."""
    rank = F.row_number().over(Window.partitionBy("line_status").orderBy("record_number"))
    return (
        judged.filter(F.col("line_status").isin(REJECTED))
        .select("line_status", "record_number")
        .withColumn("rank", rank)
        .filter(F.col("rank") <= SAMPLE_SIZE)
        .groupBy("line_status")
        .agg(F.sort_array(F.collect_list("record_number")).alias("samples"))
    )


def is_status(*names: str) -> Column:
    return F.col("line_status").isin(*names)
