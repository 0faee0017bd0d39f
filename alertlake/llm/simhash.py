"""SimHash near-dedup: 64-bit fingerprints compared exactly, tile by tile.

Distinct fingerprints are tiled by the population counts of their four 16-bit parts. The bits in
which two fingerprints differ are at least the sum of the differences of these counts, so only
tiles whose counts differ by the radius or less in sum are compared, with numpy exclusive-or and
bit counts. A pair of blocks yields a spanning forest of its links, never all links of a group of
copies; components come from these.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice, product
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alertlake.llm.common import carried
from alertlake.llm.components import components
from alertlake.session import written

SHINGLE_WORDS = 3
RADIUS = 3
SEED = 42
PARTS = 4
BLOCK = 512
CHUNK_WORDS = 200_000
LONG_TEXT = 4_000_000
MADE = ["fingerprint", "component_id"]
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def word_chunks(data: bytes, width: int) -> Iterator[list[bytes]]:
    """Words of a text in lists that overlap by width - 1, so that long texts need little memory."""
    if len(data) < LONG_TEXT:
        yield data.split()
        return
    words = (m.group() for m in _WORD.finditer(data))
    held: list[bytes] = []
    while more := list(islice(words, CHUNK_WORDS)):
        held += more
        yield held
        held = held[-(width - 1):] if width > 1 else []


def fingerprint(text: str | None, width: int = SHINGLE_WORDS) -> bytes:
    """Eight bytes, highest bit first; zero without words."""
    ones, n = np.zeros(64, np.int64), 0
    for words in word_chunks((text or "").encode("utf-8", "surrogatepass").lower(), width):
        if not words:
            continue
        if len(words) < width:
            # The overlap of a longer text is no shingle of its own.
            shingles = [b" ".join(words)] if n == 0 else []
        else:
            shingles = map(b" ".join, zip(*[words[i:] for i in range(width)]))
        digests = b"".join([xxhash.xxh64_digest(s, SEED) for s in shingles])
        bits = np.unpackbits(np.frombuffer(digests, np.uint8)).reshape(-1, 64)
        ones += bits.sum(axis=0, dtype=np.int64)
        n += len(bits)
    return np.packbits(2 * ones > n).tobytes()


def fingerprints(docs: DataFrame, text: str = "text", id: str = "doc_id", width: int = SHINGLE_WORDS) -> DataFrame:
    """(id, key, fp) of every row; key stands in for a missing id and sorts after all ids."""
    def run(batches):
        for batch in batches:
            made = b"".join([fingerprint(t, width) for t in batch.column("t").to_pylist()])
            fps = np.frombuffer(made, ">i8").astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("key"), pa.array(fps)], ["id", "key", "fp"])

    t = F.col(f"`{text}`").cast("string")
    rows = docs.select(F.col(f"`{id}`").cast("bigint").alias("id"), row_key(id, text).alias("key"), t.alias("t"))
    return rows.mapInArrow(run, "id bigint, key bigint, fp bigint")


_NO_ID = 1 << 62


def row_key(id: str, text: str) -> Column:
    """The id, or a number past all ids made of the text's hash."""
    made = F.xxhash64(F.col(f"`{text}`").cast("string")).bitwiseAND(F.lit(_NO_ID - 1)).bitwiseOR(F.lit(_NO_ID))
    return F.coalesce(F.col(f"`{id}`").cast("bigint"), made)


def _tile(fp: Column) -> Column:
    """Population counts of the parts as one number in base 32."""
    width = 64 // PARTS
    counts = [F.bit_count(F.shiftrightunsigned(fp, width * i).bitwiseAND(F.lit((1 << width) - 1))) for i in range(PARTS)]
    return sum((n.cast("int") * 32**i for i, n in enumerate(counts)), F.lit(0))


def _neighbours(radius: int) -> list[int]:
    """One of each two opposite offsets between tiles that may hold links, and zero."""
    steps = [d for d in product(range(-radius, radius + 1), repeat=PARTS) if sum(map(abs, d)) <= radius]
    return [sum(x * 32**i for i, x in enumerate(d)) for d in steps if d >= (0,) * PARTS]


def _forest(near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cells of a true/false matrix that join the same rows and columns as all its true cells."""
    rows, cols = np.nonzero(near)
    if len(rows) < sum(near.shape):
        return rows, cols
    out: list[tuple[int, int]] = []
    row_left, col_left = near.any(axis=1), near.any(axis=0)
    while row_left.any():
        todo = [(0, int(np.argmax(row_left)))]
        row_left[todo[0][1]] = False
        while todo:
            side, at = todo.pop()
            left = col_left if side == 0 else row_left
            new = np.nonzero((near[at] if side == 0 else near[:, at]) & left)[0]
            left[new] = False
            out += [(at, int(x)) if side == 0 else (int(x), at) for x in new]
            todo += [(1 - side, int(x)) for x in new]
    found = np.array(out, dtype=np.int64).reshape(-1, 2)
    return found[:, 0], found[:, 1]


def links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Edges (u, v) that join exactly the fingerprints `fps` (fp, distinct) within the radius.

    Tiles are cut into blocks of about 512 by a hash, so the rows of a crowded tile are many small
    arrays. A block is sent once to every tile that may hold links of it.
    """
    tiled = fps.select("fp", _tile(F.col("fp")).alias("tile"))
    sizes = tiled.groupBy("tile").agg(F.count("*").alias("n"))
    block = F.pmod(F.xxhash64("fp"), F.ceil(F.col("n") / BLOCK)).cast("int")
    blocks = written(
        tiled.join(sizes, "tile").select("tile", block.alias("block"), "fp")
        .groupBy("tile", "block").agg(F.collect_list("fp").alias("fps")),
        "simhash-blocks",
    )
    offsets = F.explode(F.array(*[F.lit(x) for x in _neighbours(radius)]))
    left = blocks.select("tile", "block", F.col("fps").alias("a"), offsets.alias("offset"))
    right = blocks.select(F.col("tile").alias("to"), F.col("block").alias("to_block"), F.col("fps").alias("b"))
    pairs = left.withColumn("to", F.col("tile") + F.col("offset")).join(right, "to")
    pairs = pairs.filter((F.col("offset") != 0) | (F.col("block") <= F.col("to_block")))

    def run(batches):
        for batch in batches:
            arrays = []
            for name in ("a", "b"):
                lists = batch.column(name)
                arrays.append((lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False).view(np.uint64)))
            (a_at, a_all), (b_at, b_all) = arrays
            us, vs = [], []
            for i in range(batch.num_rows):
                a, b = a_all[a_at[i]:a_at[i + 1]], b_all[b_at[i]:b_at[i + 1]]
                near = np.bitwise_count(a[:, None] ^ b[None, :]) <= radius
                if near.any():
                    x, y = _forest(near)
                    us.append(a[x])
                    vs.append(b[y])
            if us:
                u, v = np.concatenate(us).view(np.int64), np.concatenate(vs).view(np.int64)
                apart = u != v
                yield pa.RecordBatch.from_arrays([pa.array(u[apart]), pa.array(v[apart])], ["u", "v"])

    return pairs.select("a", "b").mapInArrow(run, "u bigint, v bigint")


def simhash_groups(docs: DataFrame, text: str = "text", id: str = "doc_id", width: int = SHINGLE_WORDS, radius: int = RADIUS) -> DataFrame:
    """(id, key, fingerprint, component_id) for every row.

    Words are runs without ASCII blanks, A-Z lower-cased; a text of fewer words than a shingle is
    one shingle, and a null, empty or blank text has the fingerprint zero and is linked like any
    other. component_id is the smallest id reachable over links of `radius` or fewer bits, null if
    no row of the component has an id. Rows that repeat or share an id each get their own result.
    """
    made = written(fingerprints(docs, text, id, width), "fingerprints")
    distinct = written(made.groupBy("fp").agg(F.min("key").alias("least")), "distinct-fingerprints")
    roots = components(links(distinct.select("fp"), radius))
    c = F.col
    joined = distinct.join(roots, c("fp") == c("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = joined.groupBy("root").agg(F.min("least").alias("least"))
    # One row per fingerprint; the join with the rows is the only one a crowded fingerprint meets.
    labelled = joined.select("fp", "root").join(least, "root").select("fp", "least")
    return made.join(labelled, "fp").select(
        "id", "key", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.when(c("least") < _NO_ID, c("least")).alias("component_id"), c("least").alias("group_key"),
    )


def near_dedup(docs: DataFrame, text: str = "text", id: str = "doc_id", width: int = SHINGLE_WORDS, radius: int = RADIUS) -> DataFrame:
    """One row of each component stays: the one with the smallest id; rows that share it leave one.

    Rows without an id are only kept if their component has none with an id, one per component.
    """
    return first_of_groups(docs, simhash_groups(docs, text, id, width, radius), text, id)


def first_of_groups(docs: DataFrame, groups: DataFrame, text: str = "text", id: str = "doc_id") -> DataFrame:
    """One row for each row_key that is the group_key of its own group, from groups (key, group_key)."""
    keep = groups.filter(F.col("key") == F.col("group_key")).select("key").distinct()
    rows = docs.select(F.struct(*[F.col(f"`{n}`") for n in carried(docs)]).alias("row"), row_key(id, text).alias("key"))
    # Both steps deal rows out by key, so whole texts move once.
    return rows.join(keep, "key", "left_semi").dropDuplicates(["key"]).select("row.*")
