"""Mixing sources to target weights by iterative proportional fitting.

Token counts by (source, language, topic) are raked until the weighted marginals meet the targets of
all three, no cell getting more than all of its tokens. The factors of languages and topics are
short vectors; those of sources, which may be many, are worked out in the job that sums each round,
from one row per source. Documents are then sampled by these calibrated probabilities, decided by a
hash of the id alone.
"""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import HashingTF, Normalizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alertlake.llm.common import carried, words_of
from alertlake.llm.simhash import row_key
from alertlake.session import written

TOPICS = 8
TOPIC_DIMENSIONS = 64
FRACTION = 0.3
EXPONENTS = {"source": 0.5, "lang": 0.7, "topic": 0.7}
TOLERANCE = 1e-6
MAX_ROUNDS = 60
# Rounds without a better fit after which the targets count as out of reach.
PATIENCE = 8
MAX_LEVELS = 10_000
SEED = 42
MISSING = "(none)"
MADE = ["topic", "n_tokens", "probability", "kept"]


def with_topics(rows: DataFrame, topics: int = TOPICS) -> DataFrame:
    """Rows (..., t) with `topic`, the nearest centre of hashed word counts, in place of the text t.

    Centres are fitted on all rows. Their counts are worked out once and written without the text;
    the rounds of the fit and the choice of the nearest centre read these.
    """
    # Long words carry the subject; short ones are mostly grammar.
    words = F.filter(words_of(F.lower("t")), lambda w: F.length(w) >= 4)
    counts = HashingTF(numFeatures=TOPIC_DIMENSIONS, inputCol="__words", outputCol="__counts")
    scaled = Normalizer(inputCol="__counts", outputCol="__features")
    features = scaled.transform(counts.transform(rows.withColumn("__words", words)))
    table = written(features.drop("t", "__words", "__counts"), "topic-features")
    if table.isEmpty():
        return table.drop("__features").withColumn("topic", F.lit(0))
    model = KMeans(k=topics, seed=SEED, maxIter=10, featuresCol="__features", predictionCol="topic").fit(table.select("__features"))
    return model.transform(table).drop("__features")


def _target(levels: DataFrame, name: str, given: Mapping | None, exponent: float) -> dict:
    """Target share by level: as given, or the natural share to the exponent, brought to sum one."""
    natural = {r[name]: float(r["tokens"] or 0) for r in levels.collect()}
    raw = {k: float(given.get(k, 0.0)) if given is not None else v**exponent if v else 0.0 for k, v in natural.items()}
    total = sum(raw.values())
    return {k: v / total if total else 0.0 for k, v in raw.items()}


def rake(cells: DataFrame, targets: Mapping[str, Mapping] | None = None, exponents: Mapping[str, float] = EXPONENTS, fraction: float | None = None) -> DataFrame:
    """Adds `rate`: the raked weight of a token of each cell (source, lang, topic, tokens).

    The weights tokens * rate sum to one and meet the target shares of all dimensions, as far as
    the cells with tokens allow it. With a fraction, no cell weighs more than its tokens are of
    that fraction of all tokens, so that none would have to be drawn twice. At most 10,000
    languages and topics are expected; sources may be any number.
    """
    targets, c = targets or {}, F.col
    levels = {}
    for name in ("lang", "topic"):
        found = cells.groupBy(name).agg(F.sum("tokens").alias("tokens"))
        if found.count() > MAX_LEVELS:
            raise ValueError(f"more than {MAX_LEVELS} values of {name}")
        levels[name] = _target(found, name, targets.get(name), exponents[name])
    names = {name: sorted(shares) for name, shares in levels.items()}
    place = {name: {x: i for i, x in enumerate(names[name])} for name in names}
    b_target, c_target = (np.array([levels[n][x] for x in names[n]]) for n in ("lang", "topic"))
    # Codes by join with the short level tables, one row per source with its cells.
    spark = cells.sparkSession
    coded = cells
    for name, code in (("lang", "l"), ("topic", "k")):
        pairs = F.explode(F.array(*[F.struct(F.lit(x).alias(name), F.lit(i).alias(code)) for x, i in place[name].items()]))
        coded = coded.join(F.broadcast(spark.range(1).select(pairs.alias("p")).select("p.*")), name) if place[name] else coded.withColumn(code, F.lit(0))
    by_source = coded.groupBy("source").agg(
        F.sum("tokens").cast("double").alias("tokens"), F.collect_list(F.struct("l", "k", c("tokens").cast("double").alias("t"))).alias("cells")
    )
    if targets.get("source") is not None:
        given = F.create_map(*[F.lit(x) for pair in targets["source"].items() for x in pair])
        wanted = F.coalesce(F.element_at(given, c("source")), F.lit(0.0))
    else:
        wanted = F.when(c("tokens") > 0, F.pow("tokens", F.lit(exponents["source"]))).otherwise(0.0)
    table = written(by_source.withColumn("raw", wanted.cast("double")).drop("tokens"), "mix-sources")
    total = table.agg(F.sum("raw")).first()[0] or 0.0
    tokens = float(cells.agg(F.sum("tokens")).first()[0] or 0)
    most = 1 / (fraction * tokens) if fraction and tokens else None
    b, k = np.ones(len(b_target)), np.ones(len(c_target))

    def rated() -> DataFrame:
        """Cells with the rates that bring every source to its target, given the other factors."""
        pull = lambda x: F.get(_array(b), x["l"]) * F.get(_array(k), x["k"])
        pulled = F.transform("cells", lambda x: F.struct(pull(x).alias("pull"), x["t"].alias("t"), x["l"].alias("l"), x["k"].alias("k")))
        rows = table.select("source", (c("raw") / F.lit(total or 1.0)).alias("wanted"), F.sort_array(pulled, asc=False).alias("cells"))
        rows = rows.withColumn("a", _source_factor(most)).select("source", "a", F.explode("cells").alias("x"))
        rate = c("a") * c("x.pull")
        return rows.select("source", "x.l", "x.k", c("x.t").alias("tokens"), (F.least(rate, F.lit(most)) if most else rate).alias("rate"))

    best, stale, kept = np.inf, 0, (b, k)
    for _ in range(MAX_ROUNDS):
        matrix = np.zeros((len(b), len(k)))
        for row in rated().groupBy("l", "k").agg(F.sum(c("tokens") * c("rate")).alias("w")).collect():
            matrix[row["l"], row["k"]] = row["w"]
        off = max(np.abs(matrix.sum(1) - b_target).max(initial=0), np.abs(matrix.sum(0) - c_target).max(initial=0))
        stale = 0 if off < 0.99 * best else stale + 1
        if off < best:
            best, kept = off, (b, k)
        if best < TOLERANCE or stale >= PATIENCE:
            break
        grow = _ratio(b_target, matrix.sum(1))
        b = b * grow
        k = k * _ratio(c_target, grow @ matrix)
    b, k = kept
    return written(rated().select(
        "source", F.get(_texts(names["lang"]), c("l")).alias("lang"), F.get(_array(names["topic"], "int"), c("k")).alias("topic"), "tokens", "rate",
    ), "mix-cells")


def _source_factor(most: float | None) -> Column:
    """What the pulls of a source's cells (largest first) are multiplied by to reach its target.

    Cells that would pass the highest rate are taken at that rate, and the rest make up for it.
    """
    c = F.col
    weight = F.aggregate("cells", F.lit(0.0), lambda s, x: s + x["t"] * x["pull"])
    even = F.when(weight > 0, c("wanted") / weight).otherwise(0.0)
    if most is None:
        return even
    start = F.struct(even.alias("a"), c("wanted").alias("open"), weight.alias("rest"), weight.alias("whole"))

    def step(s: Column, x: Column) -> Column:
        left, rest = s["open"] - x["t"] * most, s["rest"] - x["t"] * x["pull"]
        # Nothing left to draw from: all cells are taken at the highest rate.
        a = F.when(rest > 1e-12 * s["whole"], F.greatest(left, F.lit(0.0)) / rest).otherwise(F.lit(1e300))
        capped = F.struct(a.alias("a"), left.alias("open"), rest.alias("rest"), s["whole"].alias("whole"))
        return F.when((s["a"] * x["pull"] > most) & (s["a"] < 1e300), capped).otherwise(s)

    return F.aggregate("cells", start, step, lambda s: s["a"])


def _array(values, kind: str = "double") -> Column:
    return F.array(*[F.lit(v.item() if hasattr(v, "item") else v).cast(kind) for v in values])


def _texts(values) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def _ratio(wanted: np.ndarray, got: np.ndarray) -> np.ndarray:
    return np.divide(wanted, got, out=np.zeros(len(wanted)), where=got > 0)


def probabilities(cells: DataFrame, fraction: float = FRACTION) -> DataFrame:
    """Adds `probability`, at most one, such that the expected tokens are the fraction of all.

    Rates that were raked for the fraction only need this scale. Others are scaled alike; a cell
    that would pass one is taken whole, and the rest make up for it.
    """
    c = F.col
    total = cells.agg(F.sum("tokens")).first()[0] or 0.0
    scale, capped = 0.0, -1
    while True:
        full = (c("rate") * scale >= 1) & (c("rate") > 0)
        whole, open_, n = cells.agg(
            F.coalesce(F.sum(F.when(full, c("tokens"))), F.lit(0.0)), F.coalesce(F.sum(F.when(~full, c("tokens") * c("rate"))), F.lit(0.0)),
            F.count(F.when(full, 1)),
        ).first()
        if n == capped or open_ <= 0:
            break
        scale, capped = max(scale, (fraction * total - whole) / open_), n
    return cells.withColumn("probability", F.least(F.lit(1.0), c("rate") * scale))


def mixed(docs: DataFrame, fraction: float = FRACTION, targets: Mapping[str, Mapping] | None = None, topics: int = TOPICS, text: str = "text", id: str = "doc_id", source: str = "source", lang: str = "lang") -> DataFrame:
    """(key, id, source, lang, topic, n_tokens, probability, kept) for every row.

    Tokens are words without ASCII blanks. Null sources and languages are the level "(none)".
    A row is kept if its id's hash, as a share of all hashes, lies below its probability, so rows
    that share an id and cell stay or go together. Null and empty texts have no tokens and take
    the probability of their cell, zero where the cell has no token.
    """
    c = F.col
    t = F.coalesce(c(f"`{text}`").cast("string"), F.lit(""))
    level = lambda name: F.coalesce(c(f"`{name}`").cast("string"), F.lit(MISSING))
    rows = docs.select(row_key(id, text).alias("key"), c(f"`{id}`").alias("id"), level(source).alias("source"), level(lang).alias("lang"), F.size(words_of(t)).cast("bigint").alias("n_tokens"), t.alias("t"))
    narrow = with_topics(rows, topics).select("key", "id", "source", "lang", "topic", "n_tokens")
    narrow = written(narrow, "mix-rows")
    cells = written(narrow.groupBy("source", "lang", "topic").agg(F.sum("n_tokens").alias("tokens")), "mix-counts")
    rated = probabilities(rake(cells, targets, fraction=fraction), fraction).select("source", "lang", "topic", "probability")
    share = (F.xxhash64(F.lit(SEED + 1), "key") / F.lit(2.0**64)) + 0.5
    return narrow.join(rated, ["source", "lang", "topic"]).select(
        "key", c("id").alias(id), "source", "lang", "topic", "n_tokens", "probability", (share < c("probability")).alias("kept")
    )


def mix_sources(docs: DataFrame, **options) -> DataFrame:
    """The rows that the mix keeps, with their columns and topic, n_tokens and probability."""
    text, id = options.get("text", "text"), options.get("id", "doc_id")
    kept = mixed(docs, **options).filter("kept").select("key", *MADE[:3]).dropDuplicates(["key"])
    names = carried(docs, *MADE[:3])
    boxed = docs.select(F.struct(*[F.col(f"`{n}`") for n in names]).alias("row"), row_key(id, text).alias("key"))
    return boxed.join(kept, "key").select("row.*", *MADE[:3])
