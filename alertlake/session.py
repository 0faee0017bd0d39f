"""Session settings the jobs rely on, and the shared place for intermediate tables."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from urllib.parse import urlparse

from pyspark.sql import Column, DataFrame, Observation, SparkSession


def prepare(spark: SparkSession) -> SparkSession:
    """Pin the settings that results or skew handling depend on."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    # Rank limits are applied in every task before ranks of a key meet.
    spark.conf.set("spark.sql.optimizer.windowGroupLimitThreshold", "1000")
    # Plain lower-casing; the ICU tables only matter for locale rules that are not used here.
    spark.conf.set("spark.sql.icu.caseMappings.enabled", "false")
    # Recording the Python call site of every expression costs more than planning them. (The
    # static spark.python.sql.dataFrameDebugging.enabled=false at session start saves more.)
    spark.conf.set("spark.sql.dataFrameQueryContext.enabled", "false")
    # The JVM never compiles a method of more than 8,000 bytes: wide projections fused into one such
    # method are interpreted for every line. Past that size Spark is to run them as several.
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
    # A union that keeps the partitioning of its parts keeps their hundreds of near-empty partitions too.
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")
    return spark


def work_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables that driver and executors share.

    It is the one the session names in spark.checkpoint.dir. Where none is named, a folder below
    the warehouse is set; on a cluster, a warehouse on the driver's own disk is refused.
    """
    sc = spark.sparkContext
    configured = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not configured:
        warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
        if not sc.master.startswith("local") and urlparse(warehouse).scheme in ("", "file"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(f"{warehouse}/alertlake-work")
        configured = sc.getCheckpointDir()
    return configured


def remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


_written: dict[str, list[tuple[str, str]]] = {}


def discard_written(spark: SparkSession, *names: str) -> None:
    """Deletes intermediate tables of this application, all or those of the given names, once
    nothing reads them any more."""
    mine = _written.get(spark.sparkContext.applicationId, [])
    for entry in [e for e in mine if not names or e[0] in names]:
        remove(spark, entry[1])
        mine.remove(entry)


@contextmanager
def passing(spark: SparkSession, *names: str) -> Iterator[None]:
    """Tables of these names that are written within are deleted at the end: nothing made there reads them later."""
    mine = _written.setdefault(spark.sparkContext.applicationId, [])
    before = set(mine)
    try:
        yield
    finally:
        for entry in [e for e in mine if e[0] in names and e not in before]:
            remove(spark, entry[1])
            mine.remove(entry)


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """What a write within this shuffles is deleted when the write has ended.

    Otherwise these files stay until the driver happens to collect garbage, and those of all steps
    lie on the executors' disks at once. A written table does not need them; frames that are not
    written within keep theirs.
    """
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, which `discard_written` deletes under its name."""
    path = f"{work_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _written.setdefault(spark.sparkContext.applicationId, []).append((name, path))
    return path


# Bytes of input files for one part; packed text grows about tenfold.
_PART_BYTES = 32 << 20


def spread(df: DataFrame, key: str) -> DataFrame:
    """Rows dealt out by a key without equal values where reading them is fewer tasks than cores.

    A packed file is read by one task, and so are a few small files; what follows shall not be.
    The hash of the key deals evenly whatever the rows compress to, and again alike on a retry.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    known = size if size < 1 << 60 else 0
    return df.repartition(max(cores, known // _PART_BYTES), key)


# Bytes of a columnar input for one part of what is made of it: some fifty thousand events.
_COLUMN_BYTES = 512 << 10


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """Rows of a columnar input dealt out by the hash of some columns, in parts that grow in number with its size.

    The splits of such a file say nothing about its rows: a row group is read by one task, and the other
    splits of it are empty. Few narrow columns are cheap to deal out before wide rows are made of them.
    """
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    known = size if size < 1 << 60 else 0
    cores = df.sparkSession.sparkContext.defaultParallelism
    # As many parts for every core.
    return df.repartition(cores * max(1, -(-known // (cores * _COLUMN_BYTES))), *keys)


def written(df: DataFrame, name: str, counts: dict[str, Column] | None = None) -> DataFrame | tuple[DataFrame, dict]:
    """Write a result that several later steps read, and read it back.

    The table cuts the lineage, outlives executors, is read column by column, and gives the
    optimiser the true size, so a later join is broadcast only when that size allows it. `counts`
    are aggregates of the rows that are taken while they are written, without another scan, and
    returned beside the table. Only the try of a task that is kept counts.
    """
    spark = df.sparkSession
    seen = Observation(f"{name}-{uuid.uuid4().hex}") if counts else None
    if seen:
        df = df.observe(seen, *[column.alias(key) for key, column in counts.items()])
    path = shared_path(spark, name)
    with shuffles_dropped(spark):
        df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    return (table, seen.get) if seen else table
