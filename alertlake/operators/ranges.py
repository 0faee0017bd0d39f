"""Ordered computations over groups of any size: sorted chunks and running totals across them.

A window over a whole group would put a hot group into one task. Here the rows are split by range
over the complete order, so a hot group spans many chunks of even size; windows run inside a chunk
and one small row per chunk carries the totals over.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from alertlake.session import written


def range_chunks(df: DataFrame, *order: Column | str) -> DataFrame:
    """Adds `chunk`, ascending with the order, and `place`, the row's position in its chunk.

    Rows are dealt out and sorted once; the position comes from the running row number of the
    sorted task. Written, so all readers see the same split.
    """
    split = df.repartitionByRange(*order).sortWithinPartitions(*order)
    # The upper 31 bits of the number are the partition, the lower 33 the row in it.
    number = F.monotonically_increasing_id()
    placed = split.withColumn("number", number).withColumns({
        "chunk": F.shiftright("number", 33).cast("int"),
        "place": F.col("number").bitwiseAND(F.lit((1 << 33) - 1)) + 1,
    })
    return written(placed.drop("number"), "chunks")


def before_chunk(sizes: DataFrame, value: str) -> DataFrame:
    """(chunk, chunk_base): the sum of the value over all earlier chunks.

    One row per chunk: as many as there are shuffle partitions.
    """
    earlier = Window.orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select("chunk", F.coalesce(F.sum(value).over(earlier), F.lit(0)).alias("chunk_base"))


def ranked(df: DataFrame, *order: Column, name: str = "priority") -> DataFrame:
    """Position of each row in a total order, starting at 1, without a global window."""
    chunks = range_chunks(df, *order)
    bases = before_chunk(chunks.groupBy("chunk").agg(F.count("*").alias("n")), "n")
    return (
        chunks.join(F.broadcast(bases), "chunk")
        .withColumn(name, (F.col("place") + F.col("chunk_base")).cast("bigint"))
        .drop("chunk", "place", "chunk_base")
    )


def running_total(df: DataFrame, value: str, name: str, *order: Column | str) -> DataFrame:
    """Adds the sum of the value over all earlier rows of a total order, without a global window."""
    chunks = range_chunks(df, *order)
    bases = before_chunk(chunks.groupBy("chunk").agg(F.sum(value).alias("n")), "n")
    earlier = Window.partitionBy("chunk").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    return (
        chunks.withColumn(name, F.coalesce(F.sum(value).over(earlier), F.lit(0)))
        .join(F.broadcast(bases), "chunk")
        .withColumn(name, F.col(name) + F.col("chunk_base"))
        .drop("chunk", "place", "chunk_base")
    )
