"""Periodic runs of words, found by recompression.

The texts of a chunk stand one after the other as word numbers, parted by numbers that occur once.
Alternating rounds turn blocks of one symbol into (symbol, length) and chosen neighbours into pairs,
so each level is a shorter spelling of the same words: a run-length grammar. Equal stretches are
cut alike but for their ends. An extension query climbs while both places begin a node, compares
what lies before that, and descends where they differ, a constant number of steps a level.

A run of period q that is four periods long matches itself, moved by q, over three periods. So some
place of the grid 0, 2q, 4q, ... matches over a period, and three words there are compared before
the grammar is asked how far the match reaches to both sides. Grids of all q have n log n places.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import count
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from alertlake.llm.common import carried, words_of

MIN_WORDS = 6
MIN_PERIODS = 4
CHUNK_WORDS = 300_000
LONG_TEXT = 4_000_000
QUERIES = 100_000
PIECE = 1 << 16
MADE = ["n_words", "runs", "collapsed"]
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


class Grammar:
    """Levels of symbols; level h + 1 is level h with blocks or pairs as one symbol.

    Levels are made when a query first climbs to them: texts without repeats need few.
    """

    def __init__(self, symbols: np.ndarray):
        self.levels = [symbols]
        self.parents: list[np.ndarray] = []
        self.firsts: list[np.ndarray] = []
        self.blocks: list[bool] = []
        self._next = int(symbols.max()) + 1
        self._rng = np.random.default_rng(1)

    def climb(self, h: int) -> None:
        """Level h + 1 exists afterwards."""
        while len(self.levels) < h + 2:
            now = self.levels[-1]
            same = now[1:] == now[:-1]
            block = bool(same.any())
            self._join(now, same if block else self._pairs(now), block)

    def _pairs(self, now: np.ndarray) -> np.ndarray:
        """Places where a left symbol meets a right one; sides are drawn anew for each level."""
        while True:
            left = self._rng.integers(0, 2, self._next, dtype=np.int8)[now].astype(bool)
            met = left[:-1] & ~left[1:]
            if met.any():
                return met

    def _join(self, now: np.ndarray, joined: np.ndarray, block: bool) -> None:
        starts = np.concatenate([[True], ~joined])
        first = np.append(np.flatnonzero(starts), len(now)).astype(np.int32)
        size = np.diff(first)
        made = now[first[:-1]].copy()
        many = np.flatnonzero(size > 1)
        lead = made[many].astype(np.int64)
        key = lead * (len(now) + 1) + size[many] if block else lead * self._next + now[first[many] + 1]
        _, named = np.unique(key, return_inverse=True)
        made[many] = named + self._next
        self._next += int(named.max()) + 1
        self.levels.append(made)
        self.parents.append((np.cumsum(starts) - 1).astype(np.int32))
        self.firsts.append(first)
        self.blocks.append(block)

    def extension(self, a: np.ndarray, b: np.ndarray, step: int) -> np.ndarray:
        """Words that match from places a < b on, to the right (step 1) or left (step -1).

        The first and the last symbol occur once, so that no match leaves the text.
        """
        at, to, top = a.astype(np.int64), b.astype(np.int64), np.zeros(len(a), np.int64)
        alive, h = np.arange(len(a)), 0
        while len(alive):
            self.climb(h)
            now, todo = self.levels[h], alive
            climbing = []
            while len(todo):
                x, y = at[todo], to[todo]
                edge = self._at_edge(h, x, step) & self._at_edge(h, y, step)
                climbing.append(todo[edge])
                same = ~edge & (now[x] == now[y])
                stop = todo[~edge & ~same]
                top[stop] = h
                todo = todo[same]
                self._advance(h, at, to, todo, step)
            alive = np.concatenate(climbing)
            at[alive], to[alive] = self.parents[h][at[alive]], self.parents[h][to[alive]]
            h += 1
        for h in range(int(top.max(initial=0)), 0, -1):
            todo = np.flatnonzero(top >= h)
            first, now = self.firsts[h - 1], self.levels[h - 1]
            down = first[:-1] if step > 0 else first[1:] - 1
            at[todo], to[todo] = down[at[todo]], down[to[todo]]
            while len(todo := todo[now[at[todo]] == now[to[todo]]]):
                self._advance(h - 1, at, to, todo, step)
        return np.abs(at - a)

    def _at_edge(self, h: int, x: np.ndarray, step: int) -> np.ndarray:
        up = self.parents[h][x]
        return self.firsts[h][up] == x if step > 0 else self.firsts[h][up + 1] - 1 == x

    def _advance(self, h: int, at: np.ndarray, to: np.ndarray, todo: np.ndarray, step: int) -> None:
        """Past the symbol that both places hold; in blocks past what is left of the shorter one."""
        move = 1
        if self.blocks[h]:
            def left(x):
                up = self.parents[h][x]
                return self.firsts[h][up + 1] - x if step > 0 else x - self.firsts[h][up] + 1

            move = np.minimum(left(at[todo]), left(to[todo]))
        at[todo] += step * move
        to[todo] += step * move


def _grid(symbols: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, period) where three words match at a grid place, for periods low to high - 1."""
    places, periods = [], []
    for q in range(low, high):
        step, stop = 2 * q, len(symbols) - q - 2
        if stop <= 0:
            break
        at = np.flatnonzero(symbols[:stop:step] == symbols[q:q + stop:step])
        if len(at):
            at *= step
            at = at[(symbols[at + 1] == symbols[at + q + 1]) & (symbols[at + 2] == symbols[at + q + 2])]
            places.append(at)
            periods.append(np.full(len(at), q))
    return (np.concatenate(places), np.concatenate(periods)) if places else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def runs_of(symbols: np.ndarray, longest: int) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs, by start and period; longest: words of the longest text."""
    grammar, found = Grammar(symbols), {}
    # Of every place: where the run known to hold it ends, and that run's period.
    end, period = np.zeros(len(symbols), np.int64), np.ones(len(symbols), np.int64)
    low = 1
    while low <= longest // MIN_PERIODS:
        places, periods = _grid(symbols, low, min(2 * low, longest // MIN_PERIODS + 1))
        for at in range(0, len(places), QUERIES):
            i, q = places[at:at + QUERIES], periods[at:at + QUERIES]
            # Within a run whose period divides q, the match by q is that run again.
            new = (i + q >= end[i]) | (q % period[i] != 0)
            i, q = i[new], q[new]
            if not len(i):
                continue
            start = i - grammar.extension(i - 1, i + q - 1, -1)
            stop = i + q + grammar.extension(i, i + q, 1)
            whole = stop - start >= np.maximum(MIN_WORDS, MIN_PERIODS * q)
            for s, e, p in zip(start[whole].tolist(), stop[whole].tolist(), q[whole].tolist()):
                if p < found.get((s, e), p + 1):
                    found[s, e] = p
                    end[s:e], period[s:e] = e, p
        low *= 2
    return sorted((s, e - s, p) for (s, e), p in found.items())


def _numbers(data: bytes, number) -> np.ndarray:
    if len(data) < LONG_TEXT:
        return np.array([number[w] for w in data.split()], np.int32)
    return np.fromiter((number[m.group()] for m in _WORD.finditer(data)), np.int32)


def _joined(vocabulary: list[bytes], words: np.ndarray) -> str:
    pieces = [b" ".join([vocabulary[w] for w in words[at:at + PIECE].tolist()]) for at in range(0, len(words), PIECE)]
    return b" ".join(pieces).decode("utf-8", "replace")


def _chunk(texts: list[np.ndarray], vocabulary: list[bytes]) -> list[tuple[int, list, str]]:
    """(words, runs, collapsed text) of each text of a chunk."""
    sizes = [len(t) for t in texts]
    starts = np.cumsum([1, *[n + 1 for n in sizes[:-1]]]).tolist()
    parts = []
    for k, text in enumerate(texts):
        parts += [np.array([len(vocabulary) + k], np.int32), text]
    symbols = np.concatenate([*parts, np.array([len(vocabulary) + len(texts)], np.int32)])
    found, k = [[] for _ in texts], 0
    for start, length, period in runs_of(symbols, max(sizes)):
        while start >= starts[k] + sizes[k]:
            k += 1
        found[k].append((start - starts[k], length, period))
    out = []
    for text, runs in zip(texts, found):
        gone = np.zeros(len(text) + 1, np.int32)
        for start, length, period in runs:
            gone[start + period] += 1
            gone[start + length] -= 1
        out.append((len(text), runs, _joined(vocabulary, text[np.cumsum(gone[:-1]) == 0] if runs else text)))
    return out


def _of_texts(texts: list[str | None]) -> list[tuple[int, list, str]]:
    """Texts of like length share a chunk, so that short ones are not searched for long periods."""
    order = sorted(range(len(texts)), key=lambda i: len(texts[i] or ""))
    out: list = [None] * len(texts)
    at = 0
    while at < len(order):
        number = defaultdict(count().__next__)
        held, words, begin = [], 0, at
        while at < len(order) and words < CHUNK_WORDS:
            held.append(_numbers((texts[order[at]] or "").encode("utf-8", "surrogatepass"), number))
            words += len(held[-1]) + 1
            at += 1
        for i, made in zip(order[begin:at], _chunk(held, list(number))):
            out[i] = made
    return out


_RUN = StructType([StructField(name, LongType()) for name in ("start", "length", "period")])


def periodic_runs(docs: DataFrame, text: str = "text") -> DataFrame:
    """The input columns and n_words, runs (start, length, period) and the collapsed text.

    Words are runs without ASCII blanks. A run is a longest stretch of words with smallest period q
    that is at least six words and four periods long; runs come by start, then period. The collapsed
    text has every run's first q words and all words outside runs, joined by one blank; a word goes
    if any run drops it. Null, empty and blank texts have no words, no runs and an empty collapsed
    text. Repeated rows get equal results; input columns named like a result (in any case) are left
    out. Texts are searched whole, within one task each; memory grows with the longest single text,
    by about 60 bytes a word.
    """
    kept = carried(docs, *MADE)
    fields = {f.name: f for f in docs.schema.fields}
    schema = StructType([
        StructField("row", StructType([fields[n] for n in kept])), StructField("n_words", LongType()),
        StructField("runs", ArrayType(_RUN)), StructField("collapsed", StringType()),
    ])

    def run(batches):
        kind = pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "length", "period")]))
        for batch in batches:
            made = _of_texts(batch.column("t").to_pylist())
            runs = [[dict(zip(("start", "length", "period"), r)) for r in m[1]] for m in made]
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array([m[0] for m in made], pa.int64()), pa.array(runs, kind), pa.array([m[2] for m in made], pa.string())],
                ["row", *MADE],
            )

    rows = docs.select(F.struct(*[F.col(f"`{n}`") for n in kept]).alias("row"), F.col(f"`{text}`").cast("string").alias("t"))
    return rows.mapInArrow(run, schema).select("row.*", *MADE)


def planted(id: Column, text: Column) -> Column:
    """Texts of ids whose hash ends in 0 become periodic from some word on; others stay as they are."""
    hashed = F.crc32(id.cast("string"))
    g, words = F.floor(hashed / 10), words_of(text)
    n = F.size(words)
    a = g % n
    p = 1 + F.floor((n - a) / (3 + g % 8))
    # The struct is generated, so that words and places are worked out once.
    found = F.struct(words.alias("w"), a.cast("int").alias("a"), p.cast("int").alias("p"))
    made = F.transform(F.array(found), lambda x: F.array_join(
        F.transform(x["w"], lambda w, i: F.when(i < x["a"], w).otherwise(F.get(x["w"], x["a"] + (i - x["a"]) % x["p"]))), " "
    ))
    return F.when((hashed % 10 == 0) & (n > 0), made[0]).otherwise(text)


def best_run(runs: Column) -> Column:
    """The run with the greatest length / period, compared exactly; ties: smallest start, then period."""
    def better(best: Column, x: Column) -> Column:
        lead = x["length"] * best["period"] - best["length"] * x["period"]
        earlier = (x["start"] < best["start"]) | ((x["start"] == best["start"]) & (x["period"] < best["period"]))
        return F.when(best.isNull() | (lead > 0) | ((lead == 0) & earlier), x).otherwise(best)

    return F.aggregate(runs, F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>"), better)


def digests(found: DataFrame, id: str) -> DataFrame:
    """One row of numbers and digests for each row of periodic_runs."""
    c = F.col
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    text = F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    rows = found.select(c(f"`{id}`").alias("doc_id"), "runs", "collapsed", best_run(c("runs")).alias("best"), text.alias("listed"))
    return rows.select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), "best.start", "best.length", "best.period",
        F.floor(F.lit(1000) * c("best.length") / c("best.period")).alias("exponent_milli"),
        F.sha2("listed", 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
