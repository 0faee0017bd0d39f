"""Centroid clustering over whole-number vectors, with zone maps along a Hilbert curve.

Vectors are ordered along a Hilbert curve through all their components, so neighbours stand
together, and cut into blocks that carry the least and the greatest value of each component. The
squared distance of a centroid to a block's box, at its nearest and its farthest, tells which
centroids can be nearest to any vector of the block; only those are compared with all of them,
exactly. Blocks are written once; a round reads them, and only sums of a cluster leave a task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alertlake.session import discard_written, written

SIZE = 64
SCALE = 256
CLUSTERS = 40
ROUNDS = 5
BLOCK = 128
BITS = 4
# Components up to this size keep every squared distance within 64 bits.
LIMIT = 1 << 27
# Below this bound sums of products are exact in doubles, which numpy multiplies faster.
EXACT = 1 << 53


def hilbert_keys(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Places along the curve (bytes that sort like them) of rows of cell numbers below 2^bits.

    Each bit plane, highest first, swaps or flips the lower bits of the first component, which turns
    the sub-cube so that the curve stays connected; a Gray code over the components comes last.
    """
    x = cells.T.astype(np.int64).copy()
    n = len(x)
    for plane in range(bits - 1, 0, -1):
        bit, low = 1 << plane, (1 << plane) - 1
        for i in range(n):
            flipped = (x[i] & bit) != 0
            swapped = np.where(flipped, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(flipped, low, swapped)
            x[i] ^= swapped
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turned = np.zeros_like(x[0])
    for plane in range(bits - 1, 0, -1):
        turned ^= np.where(x[n - 1] & (1 << plane), (1 << plane) - 1, 0)
    x ^= turned
    planes = [(x[i] >> plane) & 1 for plane in range(bits - 1, -1, -1) for i in range(n)]
    return np.packbits(np.array(planes, np.uint8).T, axis=1)


def nearest(block: np.ndarray, low: np.ndarray, high: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(cluster, squared distance) of each vector of a block, and the number of centroids compared.

    A centroid farther from the box at its nearest than another is at its farthest is nearest to
    none. Of equally near centroids the first counts.
    """
    below, above = low - centres, centres - high
    gap = np.maximum(np.maximum(below, above), 0)
    reach = np.maximum(high - centres, centres - low)
    at_least, at_most = (gap * gap).sum(axis=1), (reach * reach).sum(axis=1)
    picked = np.flatnonzero(at_least <= at_most.min())
    some = centres[picked]
    most = max(int(np.abs(some).max()), int(max(abs(int(low.min())), abs(int(high.max())))))
    if 4 * most * most * block.shape[1] < EXACT:
        v, c = block.astype(np.float64), some.astype(np.float64)
        far = (v * v).sum(axis=1)[:, None] - 2 * (v @ c.T) + (c * c).sum(axis=1)[None, :]
        far = far.astype(np.int64)
    else:
        far = np.stack([((block - c) ** 2).sum(axis=1) for c in some], axis=1)
    best = far.argmin(axis=1)
    return picked[best], far[np.arange(len(block)), best], len(picked)


def whole_vectors(vectors: DataFrame, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, v): vectors of SIZE finite components as floor(256 * x), the others are left out.

    So are vectors with a component past LIMIT, whose distances would not fit 64 bits.
    """
    x = F.transform(F.col(f"`{vector}`"), lambda x: F.floor(SCALE * x.cast("double")))
    fits = lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) <= LIMIT / SCALE)
    good = vectors.filter((F.size(F.col(f"`{vector}`")) == SIZE) & F.forall(F.col(f"`{vector}`"), fits))
    return good.select(F.col(f"`{id}`").cast("bigint").alias("id"), x.cast("array<bigint>").alias("v"))


def first_centres(kept: DataFrame, clusters: int = CLUSTERS) -> np.ndarray:
    """The vectors with the smallest hashes of their ids; rows of one id come by their components."""
    hashed = F.sha2(F.concat(F.lit("2:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    rows = kept.select(hashed.alias("h"), "v").orderBy("h", "v").limit(clusters).collect()
    return np.array([r["v"] for r in rows], np.int64).reshape(-1, SIZE)


def _lists(column, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def hilbert_blocks(kept: DataFrame, block: int = BLOCK) -> DataFrame:
    """(ids, vectors, low, high): blocks of vectors along the curve, with their boxes.

    A cell is a sixteenth of four standard deviations around the mean component. Rows are dealt out
    by ranges of the key and a row number, so any number of equal vectors spreads over tasks.
    """
    x = lambda power: F.aggregate("v", F.lit(0.0), lambda total, x: total + F.pow(x.cast("double"), F.lit(power)))
    flat = kept.select(x(1.0).alias("x"), x(2.0).alias("xx")).agg(F.avg(F.col("x") / SIZE).alias("m"), F.avg(F.col("xx") / SIZE).alias("mm")).first()
    mean = flat["m"] or 0.0
    step = max(4 * max((flat["mm"] or 0.0) - mean * mean, 0.0) ** 0.5 / (1 << BITS), 1e-9)

    def keyed(batches):
        for batch in batches:
            if batch.num_rows:
                v = _lists(batch.column("v"), SIZE)
                cells = np.clip(np.floor((v - mean) / step) + (1 << (BITS - 1)), 0, (1 << BITS) - 1)
                key = hilbert_keys(cells.astype(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id"), pa.array([k.tobytes() for k in v.astype(np.int32)], pa.binary()), pa.array([k.tobytes() for k in key], pa.binary())],
                    ["id", "v", "key"],
                )

    # Written, so that the row numbers stay what they are when a task is repeated.
    rows = kept.mapInArrow(keyed, "id bigint, v binary, key binary").withColumn("n", F.monotonically_increasing_id())
    rows = written(rows, "hilbert-keys")
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(parts, "key", "n").sortWithinPartitions("key", "n")

    def cut(batches):
        ids, vs = [], []

        def blocks(least: int) -> Iterator[pa.RecordBatch]:
            while len(ids) >= least and ids:
                v = np.frombuffer(b"".join(vs[:block]), np.int32).reshape(-1, SIZE)
                made = [[ids[:block]], [v.tobytes()], [v.min(axis=0).tobytes()], [v.max(axis=0).tobytes()]]
                del ids[:block], vs[:block]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(made[0], pa.list_(pa.int64())), *[pa.array(m, pa.binary()) for m in made[1:]]], ["ids", "vectors", "low", "high"]
                )

        for batch in batches:
            ids += batch.column("id").to_pylist()
            vs += batch.column("v").to_pylist()
            yield from blocks(block)
        yield from blocks(1)

    return ordered.select("id", "v").mapInArrow(cut, "ids array<bigint>, vectors binary, low binary, high binary")


def _judged(batch: pa.RecordBatch, centres: np.ndarray) -> Iterator[tuple]:
    for i in range(batch.num_rows):
        v, low, high = (np.frombuffer(batch.column(n)[i].as_py(), np.int32).astype(np.int64).reshape(-1, SIZE) for n in ("vectors", "low", "high"))
        yield batch.column("ids")[i].as_py(), v, *nearest(v, low[0], high[0], centres)


def moved(blocks: DataFrame, centres: np.ndarray) -> np.ndarray:
    """The centroids after one round: componentwise floor of sum / count, empty ones as they were.

    A task gives one row per cluster and component; the driver gets one row per cluster.
    """
    k = len(centres)

    def sums(batches):
        total, n = np.zeros((k, SIZE), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            for _, v, cluster, _, _ in _judged(batch, centres):
                n += np.bincount(cluster, minlength=k)
                for c in np.unique(cluster):
                    total[c] += v[cluster == c].sum(axis=0)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays(
            [pa.array(some, pa.int64()), pa.array(n[some], pa.int64()), pa.array(list(total[some]), pa.list_(pa.int64()))], ["cluster", "n", "total"]
        )

    made = blocks.mapInArrow(sums, "cluster bigint, n bigint, total array<bigint>")
    whole = made.groupBy("cluster").agg(F.sum("n").alias("n"), *[F.sum(F.col("total")[i].cast("decimal(28,0)")).alias(f"s{i}") for i in range(SIZE)])
    out = centres.copy()
    for r in whole.collect():
        out[r["cluster"]] = [int(r[f"s{i}"]) // r["n"] for i in range(SIZE)]
    return out


def assigned(blocks: DataFrame, centres: np.ndarray) -> DataFrame:
    """(id, cluster, distance, compared) of every vector; compared: centroids its block was held against."""
    def run(batches):
        for batch in batches:
            for ids, _, cluster, far, compared in _judged(batch, centres):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(cluster, pa.int32()), pa.array(far, pa.int64()), pa.array(np.full(len(ids), compared), pa.int32())],
                    ["id", "cluster", "distance", "compared"],
                )

    return blocks.mapInArrow(run, "id bigint, cluster int, distance bigint, compared int")


def centroid_clusters(vectors: DataFrame, id: str = "vec_id", vector: str = "embedding", clusters: int = CLUSTERS, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """((id, cluster, distance, compared) of every kept vector, final centroids).

    Kept are vectors of SIZE components, none null or non-finite, as whole numbers floor(256 * x);
    vectors with a component past 2^19 are left out, as their distances pass 64 bits. Fewer kept
    vectors than clusters make fewer clusters; none make an empty result. Repeated rows and rows
    that share an id, or have none, are vectors of their own; ties go to the smaller cluster.
    Other columns are not passed on.
    """
    kept = written(whole_vectors(vectors, id, vector), "whole-vectors")
    centres = first_centres(kept, clusters)
    if not len(centres):
        return kept.select("id", F.lit(0).alias("cluster"), F.lit(0).cast("bigint").alias("distance"), F.lit(0).alias("compared")), centres
    blocks = written(hilbert_blocks(kept), "hilbert-blocks")
    discard_written(kept.sparkSession, "whole-vectors", "hilbert-keys")
    for _ in range(rounds):
        centres = moved(blocks, centres)
    return assigned(blocks, centres), centres


def digests(found: DataFrame, centres: np.ndarray) -> DataFrame:
    """One row per vector with its cluster's inertia, the whole inertia (null past 64 bits) and the centroid's digest."""
    spark, c = found.sparkSession, F.col
    rows = written(found, "cluster-rows")
    shas = [hashlib.sha256(",".join(map(str, x)).encode()).hexdigest() for x in centres.tolist()]
    by_cluster = rows.groupBy("cluster").agg(F.sum(c("distance").cast("decimal(38,0)")).alias("s")).collect()
    inertia = {r["cluster"]: int(r["s"]) for r in by_cluster}
    whole = sum(inertia.values())
    # One row per cluster, whose number is a parameter.
    known = spark.createDataFrame([(k, _long(s), shas[k]) for k, s in inertia.items()], "cluster int, cluster_inertia bigint, centroid_sha256 string")
    return rows.join(F.broadcast(known), "cluster").select(
        c("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", F.lit(_long(whole)).cast("bigint").alias("inertia"), "centroid_sha256", "compared"
    )


def _long(x: int) -> int | None:
    """Sums past 64 bits are null."""
    return x if x < 1 << 63 else None
