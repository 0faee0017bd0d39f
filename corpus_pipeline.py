"""A training corpus from raw documents: five stages, each written and read again by the next.

Every stage takes (spark, docs, sf_dir) and returns the rows it keeps, with the columns of the
documents; the last adds topic, n_tokens and probability.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alertlake.llm.common import table
from alertlake.llm.decontaminate import decontaminate
from alertlake.llm.line_dedup import line_dedup
from alertlake.llm.mix_sources import mix_sources
from alertlake.llm.quality_rules import quality_rules
from alertlake.llm.simhash import near_dedup
from alertlake.session import written


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base test and every quality rule."""
    judged = quality_rules(docs.select(F.struct("*").alias("document"), F.col("text")))
    return judged.filter("kept").select("document.*")


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that an earlier one holds; n_chars follows the text."""
    rest = F.struct(*[F.col(f"`{name}`") for name in docs.columns if name not in ("doc_id", "text")]).alias("rest")
    left = line_dedup(docs.select("doc_id", "text", rest))
    made = {"doc_id": F.col("doc_id"), "text": F.col("text"), "n_chars": F.length("text").cast("bigint")}
    return left.select(*[made.get(name, F.col("rest").getField(name)).alias(name) for name in docs.columns])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts whose fingerprints are linked, as op5_simhash has them."""
    return near_dedup(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a copy of a benchmark item."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled so that sources, languages and topics meet their target weights."""
    return mix_sources(docs)


STAGES = [
    ("quality_rules", keep_good),
    ("line_dedup", drop_repeated_lines),
    ("simhash_near_dedup", drop_near_copies),
    ("decontamination", drop_benchmark_leaks),
    ("source_mixing", mix),
]

# Fingerprints, alignment and topics are beyond SQL; the tests run a plain version beside it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
