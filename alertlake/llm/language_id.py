"""Language identification by cross-parsing against suffix automata.

For each language a suffix automaton of labelled text knows every substring of it. A text is read
left to right in phrases, each the longest match from where it starts; the language whose text
needs the fewest phrases, normalised by the logarithm of the model's size, is the prediction.
Phrases are greedy within stretches of 1,024 characters, which start afresh. The automata are made
dense tables once, on the driver, and broadcast; many stretches are parsed side by side with numpy,
one character a step.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from alertlake.llm.common import carried

# Bounds of the training sample: rows and characters per language, and characters of one row.
ROWS_PER_LANGUAGE = 64
CHARS_PER_LANGUAGE = 40_000
CHARS_PER_ROW = 20_000
STRETCH = 1024
CELLS = 4_000_000
SLICE = 1_000_000
UNKNOWN = "und"
MADE = ["lang_pred", "score"]
_letters: np.ndarray | None = None


def letters() -> np.ndarray:
    """For each code point whether it is a letter."""
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _letters


def code_points(text: str) -> np.ndarray:
    """Lower-case letters of a text, runs of anything else as one blank, a blank at either end."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    points = np.where(letters()[points], points, 32)
    points = np.concatenate(([32], points, [32])).astype(np.uint32)
    keep = np.ones(len(points), bool)
    keep[1:] = (points[1:] != 32) | (points[:-1] != 32)
    return points[keep]


def suffix_automaton(codes: list[int]) -> list[dict[int, int]]:
    """Transitions of the smallest automaton that reads every substring; state 0 is the start."""
    nexts: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in codes:
        new = len(nexts)
        nexts.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in nexts[p]:
            nexts[p][c] = new
            p = link[p]
        if p >= 0:
            q = nexts[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                twin = len(nexts)
                nexts.append(dict(nexts[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                link[q] = link[new] = twin
                while p >= 0 and nexts[p].get(c) == q:
                    nexts[p][c] = twin
                    p = link[p]
        last = new
    return nexts


class Model:
    """Dense parsing tables of all languages over one alphabet."""

    def __init__(self, samples: dict[str, str]):
        self.languages = sorted(samples)
        points = {name: code_points(samples[name]) for name in self.languages}
        seen = np.unique(np.concatenate([*points.values(), np.array([32], np.uint32)]))
        # Code 0 stands for every character that no language's sample has.
        self.alphabet, self.width = seen, len(seen) + 1
        self.tables, self.bits = [], []
        for name in self.languages:
            codes = self.encode(points[name])
            self.tables.append(self._table(suffix_automaton(codes.tolist())))
            self.bits.append(math.log2(len(codes) + 1))

    def encode(self, points: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.alphabet, points), len(self.alphabet) - 1)
        return np.where(self.alphabet[at] == points, at + 1, 0).astype(np.int32)

    def _table(self, nexts: list[dict[int, int]]) -> np.ndarray:
        """Cell (state, code): twice the next row's offset, plus one where a phrase ends before.

        Where no match goes on, a new phrase starts with the character itself.
        """
        start = np.zeros(self.width, np.int64)
        for code, to in nexts[0].items():
            start[code] = to
        table = np.tile(start * 2 * self.width + 1, (len(nexts), 1))
        for state, moves in enumerate(nexts):
            for code, to in moves.items():
                table[state, code] = to * 2 * self.width
        # A phrase also ends at the start of a text.
        table[0] = start * 2 * self.width + 1
        return table.astype(np.int32 if table.max() < 2**31 else np.int64).ravel()

    def phrases(self, texts: list[np.ndarray]) -> np.ndarray:
        """Phrases by (text, language). Long texts are parsed in stretches that start afresh."""
        codes = [self.encode(t) for t in texts]
        owner = np.repeat(np.arange(len(codes)), [-(-len(c) // STRETCH) for c in codes])
        pieces = [c[i:i + STRETCH] for c in codes for i in range(0, len(c), STRETCH)]
        order = sorted(range(len(pieces)), key=lambda i: -len(pieces[i]))
        out = np.zeros((len(texts), len(self.languages)), np.int64)
        for low in range(0, len(order), CELLS // STRETCH):
            part = order[low:low + CELLS // STRETCH]
            lengths = np.array([len(pieces[i]) for i in part])
            grid = np.zeros((lengths[0], len(part)), np.int32)
            for column, i in enumerate(part):
                grid[:lengths[column], column] = pieces[i]
            # Columns get shorter to the right, so each step works on the first ones.
            active = np.searchsorted(-lengths, -np.arange(lengths[0]), side="left")
            for k, table in enumerate(self.tables):
                state, count = np.zeros(len(part), table.dtype), np.zeros(len(part), np.int64)
                for step, n in enumerate(active):
                    cell = table[state[:n] + grid[step, :n]]
                    count[:n] += cell & 1
                    state[:n] = cell >> 1
                np.add.at(out[:, k], owner[part], count)
        return out

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """(language, margin): how much less the best needs than the next, as a share of the next."""
        count, worded = np.zeros((len(texts), len(self.languages)), np.int64), np.zeros(len(texts), bool)
        for owners, slices in _slices(texts):
            points = [code_points(t) for t in slices]
            with_letters = [i for i, p in enumerate(points) if len(p) > 1]
            if with_letters and self.languages:
                at = np.array([owners[i] for i in with_letters])
                worded[at] = True
                np.add.at(count, at, self.phrases([points[i] for i in with_letters]))
        out = [(UNKNOWN, 0.0)] * len(texts)
        cost = count * np.array(self.bits)
        for i in np.nonzero(worded)[0]:
            best = int(cost[i].argmin())
            rest = np.delete(cost[i], best)
            out[i] = (self.languages[best], float(1 - cost[i, best] / rest.min()) if len(rest) else 1.0)
        return out


def _slices(texts: list[str | None]):
    """Whole texts in groups of about SLICE characters: (owners, slices); longer texts are several."""
    owners, slices, size = [], [], 0
    for i, text in enumerate(texts):
        for low in range(0, len(text or ""), SLICE):
            owners.append(i)
            slices.append(text[low:low + SLICE])
            size += len(slices[-1])
            if size >= SLICE:
                yield owners, slices
                owners, slices, size = [], [], 0
    if slices:
        yield owners, slices


def training_sample(labelled: DataFrame, text: str = "text", lang: str = "lang", id: str = "doc_id") -> dict[str, str]:
    """At most 40,000 characters of each language, from at most 64 rows in order of the id's hash.

    Rows longer than 20,000 characters come last and are cut there. Samples may differ in size: a
    phrase costs the logarithm of its language's sample.
    """
    c = F.col
    t = c(f"`{text}`").cast("string")
    rows = labelled.select(c(f"`{lang}`").cast("string").alias("lang"), t.alias("t"), c(f"`{id}`").alias("id")).filter("lang is not null and t is not null")
    order = Window.partitionBy("lang").orderBy(F.length("t") > CHARS_PER_ROW, F.xxhash64("id"), "id", F.xxhash64("t"))
    picked = rows.withColumn("place", F.row_number().over(order)).filter(c("place") <= ROWS_PER_LANGUAGE)
    texts: dict[str, list] = {}
    for row in picked.select("lang", "place", F.substring("t", 1, CHARS_PER_ROW).alias("t")).collect():
        texts.setdefault(row["lang"], []).append((row["place"], row["t"]))
    joined = {name: "\n".join(t for _, t in sorted(found))[:CHARS_PER_LANGUAGE] for name, found in texts.items()}
    return {name: t for name, t in joined.items() if t.strip()}


def identify(docs: DataFrame, samples: dict[str, str], text: str = "text") -> DataFrame:
    """Every input row with lang_pred and score (0 to 1, the margin over the next language).

    A null text or one without a letter is `und` with score 0, as is every text if nothing was
    learned. Ties go to the first language by name. Repeated rows get equal results; input columns
    called lang_pred or score give way.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Model(samples))

    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index("__text")
            predicted = shared.value.predict(batch.column(at).to_pylist())
            kept = [batch.column(i) for i in range(batch.num_columns) if i != at]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array([p for p, _ in predicted], pa.string()), pa.array([s for _, s in predicted], pa.float64())],
                [*[n for n in batch.schema.names if n != "__text"], *MADE],
            )

    names = carried(docs, *MADE)
    types = dict(docs.dtypes)
    given = docs.select(*[F.col(f"`{n}`") for n in names], F.col(f"`{text}`").cast("string").alias("__text"))
    schema = ", ".join([f"`{n}` {types[n]}" for n in names] + ["lang_pred string", "score double"])
    return given.mapInArrow(run, schema)
