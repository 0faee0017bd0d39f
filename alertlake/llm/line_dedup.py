"""Line dedup against levelled sorted runs of line hashes.

A store is a list of runs, each a written table of (hash, owner) sorted by hash, on levels. Every
batch of documents is merge-joined with the runs: a line whose hash some run holds under a smaller
document goes, new hashes become a run of level 0, and `FANOUT` runs of a level are merged into
one of the next. So each new batch reads few runs, and each hash is rewritten once per level.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from alertlake.llm.common import BLANKS, ascii_lower, carried, shared_folder
from alertlake.session import written

MIN_KEY_CHARS = 10
FANOUT = 3
BATCHES = 4
# Documents without an id count as one document after all others.
NO_ID = 2**63 - 1
MADE = ["n_lines", "n_dropped"]


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def hashed_keys(text: Column) -> Column:
    """128 bits per line of a text, as two hashes; null where the key is too short to count."""
    def hashed(line: Column) -> Column:
        key = line_key(line)
        return F.when(F.length(key) >= MIN_KEY_CHARS, F.struct(F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(1), key).alias("h2")))

    return F.transform(split_lines(text), hashed)


@dataclass
class RunStore:
    """Runs by level; `root` lies in the shared folder."""

    spark: SparkSession
    root: str
    fanout: int = FANOUT
    levels: list[list[str]] = field(default_factory=lambda: [[]])
    made: int = 0

    def _write(self, entries: DataFrame, level: int) -> None:
        path = f"{self.root}/level{level}-run{self.made}"
        self.made += 1
        # The aggregation that made the entries has dealt them out by hash; each file is sorted.
        entries.sortWithinPartitions("h1", "h2").write.parquet(path)
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(path)

    def _read(self, path: str) -> DataFrame:
        return self.spark.read.schema("h1 bigint, h2 bigint, owner bigint").parquet(path)

    def runs(self) -> list[DataFrame]:
        return [self._read(path) for level in self.levels for path in level]

    def add(self, entries: DataFrame) -> None:
        """A new run; full levels are merged upwards, keeping the smallest owner of a hash."""
        self._write(entries, 0)
        level = 0
        while level < len(self.levels) and len(self.levels[level]) >= self.fanout:
            merged = owners(self._union(self.levels[level]))
            self.levels[level] = []
            self._write(merged, level + 1)
            level += 1

    def _union(self, paths: list[str]) -> DataFrame:
        return self.spark.read.schema("h1 bigint, h2 bigint, owner bigint").parquet(*paths)

    def known(self, entries: DataFrame) -> DataFrame:
        """The entries whose hash some run holds, with the smallest owner on record."""
        found = None
        for run in self.runs():
            hits = entries.select("h1", "h2").join(run.hint("merge"), ["h1", "h2"])
            found = hits if found is None else found.unionByName(hits)
        return owners(found) if found is not None else None


def owners(entries: DataFrame) -> DataFrame:
    return entries.groupBy("h1", "h2").agg(F.min("owner").alias("owner"))


def batch_verdicts(lines: DataFrame, store: RunStore) -> DataFrame:
    """Hashes of a batch that make lines go, with their owner; the batch's own go into the store.

    `lines` has one row (h1, h2, id) per counted line. A hash matters if an earlier run knows it or
    two documents of the batch hold it.
    """
    spark = lines.sparkSession
    firsts = written(
        lines.groupBy("h1", "h2").agg(F.min("id").alias("owner"), F.max("id").alias("last")), "line-firsts"
    )
    known = store.known(firsts)
    if known is not None:
        seen = firsts.join(known.withColumnRenamed("owner", "before"), ["h1", "h2"], "left")
    else:
        seen = firsts.withColumn("before", F.lit(None).cast("bigint"))
    shared = seen.select(
        "h1", "h2", F.least("owner", "before").alias("owner"), "last", F.col("before").isNull().alias("is_new"),
        (F.coalesce(F.col("before"), F.lit(NO_ID)) > F.col("owner")).alias("leads"),
    )
    seen = written(shared, "line-seen")
    # An owner larger than this batch's is replaced as well, so batches may come in any order.
    store.add(seen.filter(F.col("is_new") | F.col("leads")).select("h1", "h2", "owner"))
    return seen.filter(F.col("owner") < F.col("last")).select("h1", "h2", "owner")


def dropped_lines(docs: DataFrame, store: RunStore | None = None, batches: int = BATCHES, text: str = "text", id: str = "doc_id") -> DataFrame:
    """(id, digest, gone): the positions of the lines that go, for texts that lose any.

    The hashes of all lines are written once, dealt out by batch: ranges of ids in rising order.
    """
    spark = docs.sparkSession
    store = store or RunStore(spark, shared_folder(spark, "line-runs"))
    whole = docs.select(
        F.coalesce(F.col(f"`{id}`").cast("bigint"), F.lit(NO_ID)).alias("id"),
        F.col(f"`{text}`").cast("string").alias("t"),
    )
    cuts = _cuts(whole, batches)
    batch = sum(((F.col("id") > cut).cast("int") for cut in cuts), F.lit(0))
    lines = (
        whole.select("id", F.xxhash64("t").alias("digest"), batch.alias("batch"), F.posexplode(hashed_keys(F.col("t"))).alias("pos", "h"))
        .filter(F.col("h").isNotNull())
        .select("id", "digest", "pos", "h.h1", "h.h2", "batch")
    )
    path = shared_folder(spark, "line-hashes")
    lines.write.partitionBy("batch").parquet(path)
    read = spark.read.schema("id bigint, digest bigint, pos int, h1 bigint, h2 bigint, batch int").parquet(path)
    out = None
    for k in range(len(cuts) + 1):
        mine = read.filter(F.col("batch") == k)
        shared = batch_verdicts(mine.select("h1", "h2", "id"), store)
        gone = mine.join(shared, ["h1", "h2"]).filter(F.col("id") > F.col("owner")).select("id", "digest", "pos")
        out = gone if out is None else out.unionByName(gone)
    # Positions of one text only, so a list is never longer than the text. Rows that repeat both
    # id and text give their positions twice.
    return out.groupBy("id", "digest").agg(F.collect_set("pos").alias("gone"))


def _cuts(docs: DataFrame, batches: int) -> list[int]:
    """Ids that part the documents into ranges of about equal size; any cuts give the same result."""
    if batches < 2:
        return []
    shares = [i / batches for i in range(1, batches)]
    found = docs.agg(F.percentile_approx("id", shares, 1000).alias("cuts")).first()["cuts"]
    return sorted(set(found or []))


def line_dedup(docs: DataFrame, batches: int = BATCHES, text: str = "text", id: str = "doc_id", store: RunStore | None = None) -> DataFrame:
    """Every input row with the text that stays, n_lines (before) and n_dropped.

    A line's key is the line without outer ASCII blanks, A-Z lower-cased. Keys of 10 or more code
    points in two or more documents lose their lines everywhere but in the smallest id, where all
    of them stay. Null and empty texts are one empty line and come back as they are. Documents
    without an id count as one document after all others, as do rows that share an id. Lines are
    split at \\n only. Input columns called n_lines or n_dropped give way to the results.
    """
    gone = dropped_lines(docs, store, batches, text, id)
    c = F.col
    rows = docs.select(
        F.struct(*[c(f"`{name}`") for name in carried(docs, *MADE)]).alias("row"),
        F.coalesce(c(f"`{id}`").cast("bigint"), F.lit(NO_ID)).alias("id"),
        c(f"`{text}`").cast("string").alias("t"),
    ).withColumn("digest", F.xxhash64("t"))
    joined = rows.join(gone, ["id", "digest"], "left")
    pieces = split_lines(c("t"))
    # Built on a hash set, so long texts cost in proportion.
    stays = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "gone")
    split = joined.withColumn("lines", pieces).withColumn("stays", F.when(c("gone").isNotNull(), stays))
    kept = F.transform("stays", lambda i: F.get("lines", i))
    result = F.when(c("gone").isNull(), c("t")).otherwise(F.array_join(kept, "\n"))
    return split.select(
        *[result.alias(text) if name == text else c("row").getField(name).alias(name) for name in carried(docs, *MADE)],
        F.size("lines").cast("bigint").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("bigint").alias("n_dropped"),
    )
