"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment of words.

One scan counts in how many documents each benchmark n-gram occurs; the rarest n-grams of every
item become its seeds. A second scan cuts the passages around seeds out of the documents, an
equality join on the seed pairs passages with items, and each pair is aligned, so that edited and
paraphrased copies score by what is left of the item. Scans test n-grams against a bitmap of fixed
size, whatever the size of the benchmark.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from alertlake.llm.simhash import row_key
from alertlake.session import written

NGRAM = 3
MIN_SEEDS = 16
SEED_SHARE = 0.5
MIN_SCORE = 0.6
MIN_WORDS = 8
SLACK = 8
# A copy of so many words is a hit in an item of any length. Of so many successive n-grams one is a
# seed, so that any nine successive words of it hold one.
LONG_COPY = 30
STRETCH = 4
MATCH, MISMATCH, GAP = 2, -1, 1
# 4 MiB of bits; a benchmark of a million n-grams still lets only three of a hundred others pass.
BITMAP_BITS = 1 << 25
_BASE = np.uint64(0x9E3779B97F4A7C15)
_WORD = re.compile(r"\w+")
# Thai, Lao, Burmese, Khmer, kana and Han are written without blanks: a character is a word.
_UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
_ANY_WORD = re.compile(rf"(?=\w)[{_UNSPACED}]|[^\W{_UNSPACED}]+")


def words_of(text: str | None) -> list[str]:
    lower = (text or "").lower()
    return (_WORD if lower.isascii() else _ANY_WORD).findall(lower)


def gram_hashes(words: list[str], n: int = NGRAM) -> np.ndarray:
    """A 64-bit hash for each n-gram, in order: the hashes of its words as digits of one number.

    Two n-grams that meet by chance only make a pair that the alignment turns down.
    """
    each = np.array([xxhash.xxh64_intdigest(w) for w in words], np.uint64)
    if len(each) < n:
        return np.zeros(0, np.int64)
    mixed = np.zeros(len(each) - n + 1, np.uint64)
    for i in range(n):
        mixed = mixed * _BASE + each[i:len(each) - n + 1 + i]
    # The upper half is stirred into the lower bits, which choose the place in the bitmap.
    return (mixed ^ (mixed >> np.uint64(29))).view(np.int64)


def _bitmap(grams: DataFrame) -> np.ndarray:
    """The hashes as bits: at most BITMAP_BITS / 8 bytes reach the driver."""
    slot = F.pmod(F.col("h"), F.lit(BITMAP_BITS)) + 1
    rows = grams.select(slot.alias("slot")).groupBy(F.bitmap_bucket_number("slot").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits")
    )
    bits = np.zeros(BITMAP_BITS // 8, np.uint8)
    for row in rows.collect():
        part = np.frombuffer(row["bits"], np.uint8)
        at = (row["bucket"] - 1) * len(part)
        bits[at:at + len(part)] = part
    return bits


def _in_bitmap(hashes: np.ndarray, bits: np.ndarray) -> np.ndarray:
    slot = hashes & (BITMAP_BITS - 1)
    return (bits[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1


def item_grams(items: DataFrame, n: int = NGRAM) -> DataFrame:
    """(item, pos, h, n_words) for items (item, t)."""
    def run(batches):
        for batch in batches:
            out = [[], [], [], []]
            for item, t in zip(batch.column("item").to_pylist(), batch.column("t").to_pylist()):
                words = words_of(t)
                hashes = gram_hashes(words, n)
                for column, values in zip(out, ([item] * len(hashes), range(len(hashes)), hashes, [len(words)] * len(hashes))):
                    column.extend(values)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["item", "pos", "h", "n_words"])

    return items.select("item", "t").mapInArrow(run, "item bigint, pos bigint, h bigint, n_words bigint")


def document_counts(rows: DataFrame, bits, n: int = NGRAM) -> DataFrame:
    """(h, df): in how many of the rows (t) each n-gram of the bitmap occurs; batches count first."""
    def run(batches):
        flags = bits.value
        for batch in batches:
            found = []
            for t in batch.column("t").to_pylist():
                hashes = gram_hashes(words_of(t), n)
                found.append(np.unique(hashes[_in_bitmap(hashes, flags)]))
            h, counts = np.unique(np.concatenate(found) if found else np.zeros(0, np.int64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(counts.astype(np.int64))], ["h", "df"])

    return rows.select("t").mapInArrow(run, "h bigint, df bigint").groupBy("h").agg(F.sum("df").alias("df"))


def seeds_of(grams: DataFrame, counts: DataFrame, share: float = SEED_SHARE, least: int = MIN_SEEDS) -> DataFrame:
    """The n-grams of each item found in the fewest documents: a share of them, 16 at least.

    A document that copies only a part of a long item may hold none of these, as what it copies is
    more frequent than what nobody does. So items that a long copy need not cover also have the
    rarest n-gram that any document holds of each stretch of four.
    """
    c = F.col
    ranked = grams.join(counts, "h", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    order = Window.partitionBy("item").orderBy("df", "pos")
    n = F.count("*").over(Window.partitionBy("item"))
    rarest = ranked.select("item", "pos", "h", F.row_number().over(order).alias("place"), n.alias("n")).filter(
        c("place") <= F.greatest(F.lit(least), F.ceil(c("n") * share))
    ).select("item", "h")
    part = ranked.filter((c("df") > 0) & (c("n_words") * MIN_SCORE > LONG_COPY)).groupBy("item", F.floor(c("pos") / STRETCH))
    spread = part.agg(F.min(F.struct("df", "pos", "h")).alias("least")).select("item", "least.h")
    return rarest.unionByName(spread).distinct()


def passages(rows: DataFrame, bits, reach: int, n: int = NGRAM) -> DataFrame:
    """(key, start, words, hs): stretches of a document around seeds, with the seeds in them.

    Stretches reach as far as the longest item on both sides of a seed; those that touch are one.
    """
    def run(batches):
        flags = bits.value
        for batch in batches:
            keys, starts, texts, seeds = [], [], [], []
            for key, t in zip(batch.column("key").to_pylist(), batch.column("t").to_pylist()):
                words = words_of(t)
                hashes = gram_hashes(words, n)
                at = np.nonzero(_in_bitmap(hashes, flags))[0]
                if not len(at):
                    continue
                breaks = np.nonzero(np.diff(at) > 2 * reach + n)[0] + 1
                for group in np.split(at, breaks):
                    start, end = max(0, int(group[0]) - reach), int(group[-1]) + n + reach
                    keys.append(key)
                    starts.append(start)
                    texts.append(" ".join(words[start:end]))
                    seeds.append(np.unique(hashes[group]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.int64()), pa.array(starts, pa.int64()), pa.array(texts, pa.string()), pa.array(seeds, pa.list_(pa.int64()))],
                ["key", "start", "words", "hs"],
            )

    return rows.select("key", "t").mapInArrow(run, "key bigint, start bigint, words string, hs array<bigint>")


def smith_waterman(item: list[str], passage: list[str]) -> tuple[int, int]:
    """Best local score of the item's words in the passage, and where the alignment ends."""
    codes: dict[str, int] = {}
    a, b = (np.array([codes.setdefault(w, len(codes)) for w in words], np.int64) for words in (item, passage))
    ramp = GAP * np.arange(len(b) + 1, dtype=np.int64)
    above, best, end = np.zeros(len(b) + 1, np.int64), 0, 0
    for word in a:
        row = np.maximum(above - GAP, 0)
        row[1:] = np.maximum(row[1:], above[:-1] + np.where(b == word, MATCH, MISMATCH))
        above = np.maximum.accumulate(row + ramp) - ramp
        top = int(above.argmax())
        if above[top] > best:
            best, end = int(above[top]), top
    return best, end


def aligned(pairs: DataFrame) -> DataFrame:
    """(key, item, score, n_same, end_word) of pairs (key, item, start, words, item_text).

    n_same is the number of matching words that alone give the alignment's score.
    """
    def run(batches):
        for batch in batches:
            names = ("key", "item", "start", "words", "item_text")
            out = [[], [], [], [], []]
            for key, item, start, words, text in zip(*[batch.column(x).to_pylist() for x in names]):
                wanted = words_of(text)
                score, end = smith_waterman(wanted, words.split(" "))
                enough = MATCH * min(len(wanted), MIN_WORDS)
                share = score / (MATCH * len(wanted)) if score >= enough else 0.0
                for column, x in zip(out, (key, item, share, score // MATCH, start + end)):
                    column.append(x)
            kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds)], ["key", "item", "score", "n_same", "end_word"])

    return pairs.select("key", "item", "start", "words", "item_text").mapInArrow(run, "key bigint, item bigint, score double, n_same bigint, end_word bigint")


def leaks(docs: DataFrame, benchmark: DataFrame, min_score: float = MIN_SCORE, n: int = NGRAM, text: str = "text", id: str = "doc_id", item_text: str = "text", item_id: str = "item_id") -> DataFrame:
    """(key, id, item_id, score, end_word): items of the benchmark that documents hold copies of.

    Words are runs of word characters, lower-cased. The score is the Smith-Waterman score over that
    of the whole item; a hit needs `min_score` and eight matching words, or the whole of a shorter
    item, or the score of 30 matching words whatever the item's length. Characters of scripts
    without blanks are words. Null and empty texts, and items of under three words, are never hits. Rows that share an
    id are one document; those without one are told apart by their text. Repeated items count once.
    """
    spark = docs.sparkSession
    c = F.col
    t = c(f"`{item_text}`").cast("string")
    items = written(benchmark.select(c(f"`{item_id}`").alias("item_id"), t.alias("t")).filter("t is not null").distinct()
                    .withColumn("item", F.xxhash64("item_id", "t")), "benchmark-items")
    grams = written(item_grams(items, n), "benchmark-grams")
    rows = docs.select(row_key(id, text).alias("key"), c(f"`{text}`").cast("string").alias("t"))
    every = spark.sparkContext.broadcast(_bitmap(grams))
    counts = written(document_counts(rows, every, n), "gram-counts")
    seeds = written(seeds_of(grams, counts), "benchmark-seeds")
    longest = grams.agg(F.max("n_words")).first()[0]
    chosen = spark.sparkContext.broadcast(_bitmap(seeds))
    cut = written(passages(rows, chosen, (longest or 0) + SLACK, n), "passages")
    met = cut.select("key", "start", F.explode("hs").alias("h")).join(seeds, "h").select("key", "start", "item").distinct()
    pairs = met.join(cut.select("key", "start", "words"), ["key", "start"]).join(items.select("item", c("t").alias("item_text")), "item")
    best = aligned(pairs).filter((c("score") >= min_score) | (c("n_same") >= LONG_COPY)).groupBy("key", "item").agg(F.max(F.struct("score", "end_word")).alias("best"))
    return best.join(items.select("item", "item_id"), "item").select(
        "key", F.when(c("key") < (1 << 62), c("key")).alias(id), "item_id", "best.score", "best.end_word"
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", id: str = "doc_id", **more) -> DataFrame:
    """The rows of documents that hold no copy of a benchmark item, with all their columns."""
    found = written(leaks(docs, benchmark, text=text, id=id, **more).select("key").distinct(), "leaking")
    boxed = docs.select(F.struct(*[F.col(f"`{x}`") for x in docs.columns]).alias("row"), row_key(id, text).alias("key"))
    return boxed.join(found, "key", "left_anti").select("row.*")
