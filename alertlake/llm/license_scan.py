"""Licence scan: passages of a text against licence templates, by Dice over word bigrams.

All of it is DataFrame expressions. A text is cut into sentences, lines, paragraphs and itself,
and into windows of successive sentences or lines that begin and end like a template; a passage is compared only with templates of two thirds to three halves of its words, found by an
equality join on the word count with the fixed template table. Before that, passages go whose
bigrams known to any template are too few for the coefficient, which loses nothing.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from alertlake.llm.license_texts import TEMPLATES

MIN_DICE = 0.8
SENTENCE = r"(?<=[.!?;]) +|\n"


def _plain(text: Column) -> Column:
    """Lower case; letters, digits, line breaks and sentence ends stay, the rest is one blank."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}\n.!?;]+", " ")


def _words(passage: Column) -> Column:
    return F.array_remove(F.split(passage, r"[ \n.!?;]+"), "")


def _pairs(words: str) -> Column:
    """One hash for each word of a column and the word after it."""
    return F.transform(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), lambda w, i: F.xxhash64(w, F.get(words, i + 1)))


def _bigrams(words: str) -> Column:
    return F.array_distinct(_pairs(words))


def passages(text: Column) -> Column:
    """Distinct pieces of a plain text: itself, its paragraphs, its lines, its sentences."""
    return F.array_distinct(F.concat(
        F.array(text), F.split(text, r"\n *\n"), F.split(text, "\n"), F.split(text, SENTENCE)
    ))


def promising(texts: DataFrame, known: list[tuple[int, list[int]]], min_dice: float = MIN_DICE) -> DataFrame:
    """The texts (id, t) that hold the share d / (2 - d) of some template's bigrams; no other can name one.

    One hash of each pair of words decides this, so that only texts near a licence are cut up.
    """
    c = F.col
    named = sorted({h for _, grams in known for h in grams})
    need = lambda n: math.ceil(n * min_dice / (2 - min_dice) - 1e-9)
    worded = texts.select("id", "t", F.inline(F.array(F.struct(_words(c("t")).alias("w")))))
    hit = worded.select("id", "t", F.inline(F.array(F.struct(F.array_distinct(F.filter(_pairs("w"), lambda h: h.isin(named))).alias("hits")))))
    least = min((need(len(grams)) for _, grams in known), default=1)
    some = F.lit(False)
    for grams in {tuple(grams) for _, grams in known}:
        some = some | (F.size(F.array_intersect("hits", F.lit(list(grams)))) >= need(len(grams)))
    return hit.filter(F.size("hits") >= least).filter(some).select("id", "t")


def windows(docs: DataFrame, named: list[int], longest: int, density: float, min_dice: float = MIN_DICE) -> DataFrame:
    """(id, of, first, last, w): windows of two or more sentences or lines of distinct texts (id, t).

    Dropping a first or last piece raises a window's coefficient d if less than d / 2 of its bigrams,
    with the one that leads into the window, are in the template. So the best windows begin and end
    with pieces of which min_dice / 2 are known to some template, which few pieces of other texts are.
    A window also needs `density` distinct bigrams a word; pieces it repeats, with what follows them,
    bring none. Until then windows are places in a list of piece sizes, without words.
    """
    c = F.col
    known = lambda a, b: F.coalesce(F.xxhash64(a, b).isin(named), F.lit(False))

    def piece(p: Column, i: Column) -> Column:
        after = F.get(F.get("ps", i + 1), F.lit(0))
        inside = F.filter(F.transform(p, lambda w, k: (k + 1 < F.size(p)) & known(w, F.get(p, k + 1))), lambda x: x)
        across = after.isNotNull() & known(F.element_at(p, -1), after)
        return F.struct(i.alias("i"), F.size(p).alias("n"), F.size(inside).alias("k"), across.cast("int").alias("x"), F.xxhash64(p, after).alias("u"))

    cut = F.filter(F.transform(F.split(c("t"), SENTENCE), _words), lambda p: F.size(p) > 0)
    whole = docs.select("id", F.xxhash64("t").alias("of"), F.explode(F.array(cut)).alias("ps")).filter(F.size("ps") > 1)
    listed = whole.select("id", "of", F.inline(F.transform("ps", piece)))
    # The place before which the same piece stood last; a text's pieces meet as five numbers each.
    before = F.lag("i").over(Window.partitionBy("id", "of", "u").orderBy("i"))
    numbers = listed.select("id", "of", F.struct("i", "n", "k", "x", F.coalesce(before, F.lit(-1)).alias("seen")).alias("s"))
    judged = numbers.groupBy("id", "of").agg(F.array_sort(F.collect_list("s")).alias("st"))
    share = min_dice / 2
    begins = F.array_compact(F.transform("st", lambda s: F.when(s.k + s.x >= s.n * share, s.i)))
    at = judged.select("id", "of", "st", F.explode(begins).alias("first")).filter(c("first") < F.size("st") - 1)
    none = F.struct(F.lit(0).alias("words"), F.lit(0).alias("new"), F.lit(0).alias("x"), F.array().cast("array<int>").alias("ends"))

    def grown(w: Column, s: Column) -> Column:
        words, new = w["words"] + s.n, w["new"] + F.when(s.seen < c("first"), s.n).otherwise(0)
        ends = (s.i > c("first")) & (s.k + w["x"] >= s.n * share) & (words <= longest) & (new >= density * words)
        return F.struct(words.alias("words"), new.alias("new"), s.x.alias("x"), F.when(ends, F.concat(w["ends"], F.array(s.i))).otherwise(w["ends"]).alias("ends"))

    ends = F.aggregate(F.slice("st", c("first") + 1, F.lit(longest)), none, grown, lambda w: w["ends"])
    both = at.select("id", "of", "first", F.explode(ends).alias("last"))
    span = F.slice("ps", c("first") + 1, c("last") - c("first") + 1)
    same = (c("a.of") == c("b.of")) & c("a.id").eqNullSafe(c("b.id"))
    return both.alias("a").join(whole.alias("b"), same).select("a.id", "a.of", "first", "last", F.flatten(span).alias("w"))


def templates(spark: SparkSession, min_dice: float = MIN_DICE, texts: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """(n_words, licence, t_bigrams) for every word count a template can meet: some thousand rows."""
    rows = F.array(*[F.struct(F.lit(name).alias("licence"), F.lit(text).alias("text")) for name, text in texts])
    cut = spark.range(1).select(F.explode(rows).alias("r")).select("r.licence", _words(_plain(F.col("r.text"))).alias("w"))
    n = F.size("w")
    low, high = F.ceil(n * min_dice / (2 - min_dice)), F.floor(n * (2 - min_dice) / min_dice)
    return cut.select(
        F.explode(F.sequence(low.cast("int"), high.cast("int"))).alias("n_words"), "licence", _bigrams("w").alias("t_bigrams")
    )


def license_scan(docs: DataFrame, min_dice: float = MIN_DICE, text: str = "text", id: str = "doc_id", texts: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """(id, licence, dice, n_passages): the licences each document names, by the best passage.

    A passage counts if it has two thirds to three halves (at 0.8) of a template's words and the
    sets of word bigrams have a Dice coefficient of min_dice or more; if several licences fit it,
    the best does, then the first by name. n_passages counts the distinct passages of a text; of
    windows that share half of the shorter one's pieces only the best counts.
    Null, empty and one-word texts name none. Rows that share an id, or have none, are one
    document. Other columns are not read.
    """
    c = F.col
    known = templates(docs.sparkSession, min_dice, texts)
    # The fixed table of texts bounds all of these: some dozens of texts, some thousand bigrams and rows.
    grams = [(r["n"], r["t_bigrams"]) for r in known.groupBy("licence", "t_bigrams").agg(F.max("n_words").alias("n")).collect()]
    named = sorted({h for _, g in grams for h in g})
    longest = max((n for n, _ in grams), default=0)
    # A window shares d / (2 - d) of the bigrams of a template that has at least that share of its words.
    share = min_dice / (2 - min_dice)
    density = min((share * len(g) / (n + 1) for n, g in grams), default=0.0)
    given = docs.select(c(f"`{id}`").alias("id"), _plain(c(f"`{text}`").cast("string")).alias("t"))
    rows = promising(given, grams, min_dice).distinct()
    pieces = rows.select("id", F.explode(passages(c("t"))).alias("passage")).select("id", _words(c("passage")).alias("w"))

    def close(some: DataFrame, *more: str) -> DataFrame:
        short = some.withColumn("n_words", F.size("w")).filter((c("n_words") > 1) & (c("n_words") <= longest))
        # One generated row per passage, so that no filter works the bigrams out again.
        cut = short.select("id", *more, "n_words", F.md5(F.array_join("w", " ")).alias("passage"), F.explode(F.array(_bigrams("w"))).alias("p_bigrams"))
        # No template can share more bigrams than all templates have, and a Dice of d needs the share d / (2 - d).
        shared = F.size(F.filter("p_bigrams", lambda x: x.isin(named)))
        met = cut.filter(shared * (2 - min_dice) >= F.size("p_bigrams") * min_dice).join(F.broadcast(known), "n_words")
        mine = met.select("id", *more, "licence", "t_bigrams", "n_words", "passage", "p_bigrams")
        dice = 2 * F.size(F.array_intersect("p_bigrams", "t_bigrams")) / (F.size("p_bigrams") + F.size("t_bigrams"))
        return mine.withColumn("dice", dice).filter(c("dice") >= min_dice).select("id", *more, "licence", "dice", "n_words", "passage")

    runs = close(windows(rows, named, longest, density, min_dice), "of", "first", "last")
    names = ("order", "n", "first", "last", "licence", "dice", "passage")
    order = F.struct((-c("dice")).alias("order"), c("n_words").alias("n"), "first", "last", "licence", "dice", "passage")
    for end in ("first", "last"):
        runs = runs.groupBy("id", "of", end).agg(F.min(order).alias("best")).select("id", "of", *[f"best.{x}" for x in names[2:]], c("best.n").alias("n_words"))
    rank = lambda x: F.struct(*[x.getField(name) for name in names[:5]])
    shared = lambda x, y: F.least(x['last'], y['last']) - F.greatest(x['first'], y['first']) + 1
    half = lambda x, y: 2 * shared(x, y) >= F.least(x['last'] - x['first'], y['last'] - y['first']) + 1
    by_place = lambda a, b: F.when(a["first"] < b["first"], -1).when(a["first"] > b["first"], 1).otherwise(0)
    runs = runs.groupBy("id", "of").agg(F.array_sort(F.collect_list(order), by_place).alias("all"))
    # Each place begins one window of at most `longest` pieces, so what overlaps it stands that near.
    near = lambda i: F.slice("all", F.greatest(i - longest, F.lit(0)) + 1, F.lit(2 * longest + 1))
    alone = F.transform("all", lambda x, i: F.when(~F.exists(near(i), lambda y: (rank(y) < rank(x)) & half(x, y)), x))
    runs = runs.select("id", F.explode(F.array_compact(alone)).alias("x")).select("id", "x.licence", "x.dice", "x.passage")
    close = close(pieces).select("id", "licence", "dice", "passage").unionByName(runs)
    fits = close.groupBy("id", "passage").agg(
        F.min(F.struct((-c("dice")).alias("order"), "licence")).alias("best")
    )
    return fits.groupBy("id", c("best.licence").alias("licence")).agg(
        F.max(-c("best.order")).alias("dice"), F.count("*").alias("n_passages")
    ).withColumnRenamed("id", id)
