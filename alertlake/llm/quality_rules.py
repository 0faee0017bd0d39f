"""Quality rules: a threshold table compiled into one projection of text ratios.

Every figure is a built-in expression over the whole text; no user function runs and no row
moves. Repeated 8-word windows are found by their 64-bit hashes, and only texts in which two
hashes agree sort them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alertlake.llm.common import BLANKS, boxed, carried, words_of

WINDOW_WORDS = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30

# Frequent function words of the languages the corpus holds.
STOP_WORDS = [
    "the", "of", "and", "to", "in", "a", "is", "that", "for", "it", "on", "with", "as", "was", "be", "by", "this", "are",
    "der", "die", "und", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "für", "ist", "im", "dem", "nicht", "ein",
    "de", "la", "le", "et", "les", "un", "une", "est", "que", "dans", "qui", "du", "par", "pour", "sur", "pas", "au",
    "el", "en", "y", "los", "se", "del", "las", "por", "con", "para", "una", "su", "al", "lo", "como",
]


@dataclass(frozen=True)
class Rule:
    """A text passes while low <= figure <= high; a bound of None is open."""

    name: str
    figure: str
    low: float | None = None
    high: float | None = None


RULES = (
    Rule("word_length", "mean_word_chars", 1.5, 40.0),
    Rule("symbols", "symbol_ratio", None, 0.2),
    Rule("capitals", "capital_ratio", None, 0.6),
    Rule("stop_words", "stop_word_ratio", 0.01, None),
    Rule("duplicate_lines", "dup_line_ratio", None, 0.5),
)
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
FIGURES = ["mean_word_chars", "symbol_ratio", "capital_ratio", "stop_word_ratio", "dup_line_ratio"]
MADE = [*COUNTS, *FIGURES, "base_failed", "failed_rules", "kept"]


def _n_chars(text: Column, others: str) -> Column:
    """Code points left once runs of other characters are gone."""
    return F.length(F.regexp_replace(text, others, "")).cast("bigint")


def _covered(positions: Column) -> Column:
    """Words inside windows that start at the sorted positions."""
    start = F.struct(F.lit(-WINDOW_WORDS).alias("last"), F.lit(0).cast("bigint").alias("n"))
    step = lambda s, p: F.struct(p.alias("last"), (s["n"] + F.least(F.lit(WINDOW_WORDS), p - s["last"])).alias("n"))
    return F.aggregate(positions, start, step, lambda s: s["n"])


def text_figures(docs: DataFrame, text: str = "text") -> DataFrame:
    """`row` (the input columns), the counts and the figures of every whole text."""
    whole = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    c = F.col
    split = docs.select(boxed(docs, *MADE).alias("row"), whole.alias("t"), words_of(whole).alias("words")).withColumns({
        "lines": F.filter(F.split("t", "\n"), lambda line: F.btrim(line, F.lit(BLANKS)) != ""),
        "n": F.size("words"),
    })
    starts = F.sequence(F.lit(1), F.col("n") - (WINDOW_WORDS - 1))
    hashed = split.withColumn("hashes", F.when(
        c("n") >= WINDOW_WORDS, F.transform(starts, lambda i: F.xxhash64(F.slice("words", i, WINDOW_WORDS)))
    ))
    # Only texts with equal hashes pay for sorting them with their positions.
    ordered = hashed.withColumn("placed", F.when(
        F.size(F.array_distinct("hashes")) < F.size("hashes"),
        F.sort_array(F.transform("hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
    ))
    same = lambda x, k, step: F.get("placed", k + step)["h"] == x["h"]
    twice = F.filter("placed", lambda x, k: F.coalesce(same(x, k, -1), F.lit(False)) | F.coalesce(same(x, k, 1), F.lit(False)))
    counted = ordered.withColumn("again", F.sort_array(F.transform(twice, lambda x: x["i"])))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    # The generated row keeps later filters on the figures from being worked out further down.
    figures = F.struct(
        c("n").cast("bigint").alias("n_words"),
        F.length(F.array_join("words", "")).cast("bigint").alias("word_chars"),
        _n_chars(c("t"), r"[^#*$%&|<>]+").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        F.coalesce(_covered(c("again")), F.lit(0).cast("bigint")).alias("n_repeat_words"),
        F.size("lines").alias("n_lines"),
        F.size(F.filter("words", lambda w: F.lower(w).isin(STOP_WORDS))).alias("n_stop"),
        _n_chars(c("t"), r"[^\p{Lu}]+").alias("n_upper"),
        _n_chars(c("t"), r"[^\p{L}]+").alias("n_letters"),
    )
    return counted.select("row", "t", F.inline(F.array(figures))).select(
        "row", "t", *COUNTS,
        ratio(c("word_chars"), c("n_words")).alias("mean_word_chars"),
        ratio(c("n_symbols"), c("n_words")).alias("symbol_ratio"),
        ratio(c("n_upper"), c("n_letters")).alias("capital_ratio"),
        ratio(c("n_stop"), c("n_words")).alias("stop_word_ratio"),
        ratio(c("n_dup_lines"), c("n_lines")).alias("dup_line_ratio"),
    )


def compiled(rules: tuple[Rule, ...] = RULES) -> Column:
    """Names of the rules a row breaks, as one array expression."""
    def broken(rule: Rule) -> Column:
        tests = [F.lit(False)]
        if rule.low is not None:
            tests.append(F.col(rule.figure) < rule.low)
        if rule.high is not None:
            tests.append(F.col(rule.figure) > rule.high)
        return F.when(tests[0] if len(tests) == 1 else tests[1] if len(tests) == 2 else tests[1] | tests[2], rule.name)

    return F.filter(F.array(*[broken(rule) for rule in rules], F.lit(None).cast("string")), lambda name: name.isNotNull())


def quality_rules(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Every input row with its counts, figures, broken rules and the verdict `kept`.

    The base test fails texts under 20 words and those with over 30 percent of their words in
    repeated 8-word windows; the threshold table judges the rest. A null or empty text has no
    words, so it fails the base test. Repeated rows are judged alike. Input columns named like a
    result column give way to it; all others are passed on.
    """
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    judged = text_figures(docs, text).withColumns({"base_failed": base, "failed_rules": compiled(rules)})
    kept = ~F.col("base_failed") & (F.size("failed_rules") == 0)
    return judged.withColumn("kept", kept).select(
        *[F.col("row").getField(name).alias(name) for name in carried(docs, *MADE)], *MADE
    )
