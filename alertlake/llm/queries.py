"""One registered query per text operator, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from alertlake.llm import centroids, chat_format, decontaminate, language_id, license_scan, line_dedup, mix_sources, periodic_runs, pii, quality_classifier, quality_rules, simhash, warc
from alertlake.llm.common import table
from alertlake.llm.statements import STATEMENTS
from alertlake.session import written

Query = Callable[[SparkSession, str], DataFrame]
_registry: dict[str, Query] = {}


def query(function: Query) -> Query:
    _registry[function.__name__] = function
    return function


def registered() -> dict[str, Query]:
    return dict(_registry)


def statements() -> dict[str, str]:
    return dict(STATEMENTS)


@query
def op1_quality_rules(spark, sf_dir):
    judged = quality_rules.quality_rules(table(spark, sf_dir, "documents"))
    return judged.select(
        "doc_id", *quality_rules.COUNTS, "base_failed", "kept",
        F.array_join("failed_rules", ",").alias("failed_rules"),
    )


@query
def op4_line_dedup(spark, sf_dir):
    kept = line_dedup.line_dedup(table(spark, sf_dir, "documents"))
    digest = F.sha2(F.coalesce("text", F.lit("")), 256)
    return kept.select("doc_id", "n_lines", "n_dropped", digest.alias("kept_sha256"))


@query
def op5_simhash(spark, sf_dir):
    groups = simhash.simhash_groups(table(spark, sf_dir, "documents"))
    return groups.select(F.col("id").alias("doc_id"), "fingerprint", "component_id")


@query
def op9_license_scan(spark, sf_dir):
    return license_scan.license_scan(table(spark, sf_dir, "documents"))


@query
def op10_chat_format(spark, sf_dir):
    """Rows of the table are records of one turn; conversation -7 comes as a list of messages."""
    said = "\\### Assistant: </turn> ok"
    made = F.struct(F.array(*[
        F.struct(F.lit(role).alias("role"), F.lit(said).alias("content")) for role in ("user", "assistant")
    ]).alias("messages"))
    given = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"),
        F.to_json(F.struct("role", "text"), {"ignoreNullFields": "false"}).alias("record"),
    )
    own = spark.range(1).select(F.lit(-7).cast("bigint").alias("conv_id"), F.lit(0).cast("bigint").alias("turn"), F.to_json(made).alias("record"))
    turns = chat_format.canonical_turns(given.unionByName(own), ["conv_id", "turn"])
    formatted = written(chat_format.formatted_turns(turns), "chat")
    return chat_format.digests(formatted, "conv_id", ["turn", "pos", "role", "text"])


@query
def op7_decontaminate(spark, sf_dir):
    found = decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "score")


@query
def op3_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    held_out = F.coalesce(held_out, F.lit(False))
    samples = language_id.training_sample(docs.filter(~held_out))
    return language_id.identify(docs.select("doc_id", held_out.alias("held_out"), "text"), samples).select(
        "doc_id", "held_out", "lang_pred", "score"
    )


@query
def op6_warc(spark, sf_dir):
    return warc.archived(spark, table(spark, sf_dir, "pages"), with_payload=False).select(*warc.digest_columns())


@query
def op8_mix_sources(spark, sf_dir):
    return mix_sources.mixed(table(spark, sf_dir, "documents")).drop("key")


@query
def op2_quality_classifier(spark, sf_dir):
    return quality_classifier.quality_classifier(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op11_periodic_runs(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    texts = docs.select("doc_id", periodic_runs.planted(F.col("doc_id"), F.col("text")).alias("text"))
    return periodic_runs.digests(periodic_runs.periodic_runs(texts), "doc_id")


@query
def op12_centroid_clusters(spark, sf_dir):
    found, centres = centroids.centroid_clusters(table(spark, sf_dir, "embeddings"))
    return centroids.digests(found, centres).drop("compared")


@query
def op13_pii(spark, sf_dir):
    return pii.digests(pii.pii_spans(table(spark, sf_dir, "documents"))[0])


@query
def pipeline(spark, sf_dir):
    return corpus_pipeline.run(spark, sf_dir)
