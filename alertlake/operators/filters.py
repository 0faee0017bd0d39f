"""Alert filters and the choice of the best copy of a duplicated event."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alertlake import dims


def above_level(min_level: int) -> Column:
    return F.col("rule_level") >= min_level


def in_time_range(since: int | None, until: int | None) -> Column:
    """Both ends count; an alert without a time fails as soon as a bound is set."""
    test = F.lit(True)
    if since is not None:
        test = test & (F.col("event_us") >= since)
    if until is not None:
        test = test & (F.col("event_us") <= until)
    return F.coalesce(test, F.lit(False))


def in_scope() -> Column:
    return F.col("event_category").isin(dims.SCOPE_CATEGORIES)


def drop_reason(
    min_level: int = 0, since: int | None = None, until: int | None = None, scope_only: bool = False
) -> Column:
    """The first filter an alert fails: level, time or scope; null if it passes."""
    reason = F.when(~above_level(min_level), "level").when(~in_time_range(since, until), "time")
    return reason.when(~in_scope(), "scope") if scope_only else reason


_KEYS = ["manager_name", "agent_id", "event_id"]
# Line numbers stay below 2^48, so that rank and line are one number.
_LINE_BITS = 48
# Hashes are marked in as many words of 64 bits: 2^24 bits, whatever the number of alerts.
_WORD_BITS = 18


def _word(key_hash: Column) -> Column:
    return F.shiftrightunsigned(key_hash, 64 - _WORD_BITS)


def _bit(key_hash: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), key_hash.bitwiseAND(F.lit(63)).cast("int"))


def repeated_hashes(hashes: DataFrame) -> DataFrame:
    """Marks of all hashes that occur more than once: at most 2^18 words, small enough for every task."""
    c = F.col
    repeated = hashes.groupBy("key_hash").agg(F.count("*").alias("n")).filter(c("n") > 1)
    return repeated.groupBy(_word(c("key_hash")).alias("word")).agg(F.bit_or(_bit(c("key_hash"))).alias("marks"))


def dedup_best(alerts: DataFrame) -> DataFrame:
    """Best copy per (manager, agent, event id), in the place of the first copy.

    Hashes of the ids tell which alerts may have copies. Only these, and the few whose hash shares a
    mark with them, are compared by their ids and meet the winners; all other alerts, and those
    without an id, stay in the task that reads them.
    Adds pos (line of the first copy) and copies.
    """
    c = F.col
    extra = sum(test.cast("bigint") for test in [
        c("source_ip") != dims.MISSING, c("target_user") != dims.MISSING, c("full_log") != dims.MISSING
    ])
    severity = (c("rule_level").cast("bigint") * 128 + c("risk_score")) * 4 + extra
    last_line = F.lit((1 << _LINE_BITS) - 1)
    rank = F.shiftleft(severity, _LINE_BITS) + (last_line - c("record_number"))
    has_id = c("event_id") != dims.MISSING
    hashed = alerts.withColumn("key_hash", F.xxhash64(*_KEYS))
    marks = F.broadcast(repeated_hashes(hashed.filter(has_id).select("key_hash")))
    marked = hashed.withColumn("word", _word(c("key_hash"))).join(marks, "word", "left").withColumn(
        "doubtful", F.coalesce(c("marks").bitwiseAND(_bit(c("key_hash"))) != 0, F.lit(False))
    )
    doubtful = marked.filter(has_id & c("doubtful"))
    # The hash comes first so that sorts compare one number; the texts keep keys exact.
    copied = (
        doubtful.groupBy("key_hash", *_KEYS)
        .agg(F.max(rank).alias("best"), F.min("record_number").alias("pos"), F.count("*").alias("copies"))
        .filter(c("copies") > 1)
        .select(*_KEYS, "key_hash", (last_line - c("best").bitwiseAND(last_line)).alias("winner"), "pos", "copies")
    )
    met = doubtful.join(copied, ["key_hash", *_KEYS], "left")
    alone = marked.filter(~has_id | (has_id & ~c("doubtful")))
    return (
        met.filter(c("winner").isNull() | (c("winner") == c("record_number")))
        .select(*alerts.columns, F.coalesce("pos", "record_number").alias("pos"), F.coalesce("copies", F.lit(1)).alias("copies"))
        .unionByName(alone.select(*alerts.columns, c("record_number").alias("pos"), F.lit(1).cast("bigint").alias("copies")))
    )
