"""Quality classifier by co-training of two views.

One view sees the text's content (character classes and hashed words), the other the page's
metadata (source, language, length and layout). Both are ridge logistic regressions. In each round
the unlabelled documents that one view is most sure of become pseudo-labels of the other, class by
class by its share: a view is sure of a class down to the chance where 95 of 100 held-out labels
agree with it. A view that is never sure of one of the classes gives none, as labels of one class
alone bend the other view; what was exchanged is kept with the model. Held-out labels calibrate both views and their combination, which scores all
documents. Models are fitted on samples of documented size; scoring reads every whole text.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alertlake.llm.simhash import row_key
from alertlake.session import written

# Bounds of the samples that reach the driver: rows of 8 * (WORDS + METAS + 16) bytes.
MAX_LABELLED = 12_000
MAX_UNLABELLED = 12_000
ROUNDS = 4
PER_ROUND = 1_000
SURE = 0.95
LEAST_SURE = 20
THRESHOLD = 0.5
WORDS = 64
METAS = 32
RIDGE = 1.0
SEED = 42
_SYMBOLS = "#*$%&|<>"
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
SLICE = 1_000_000
N_CLASSES = 8
_classes: np.ndarray | None = None


def char_classes() -> np.ndarray:
    """Class of each code point: other, upper, lower, digit, blank, symbol, bar or mark, comma or stop."""
    global _classes
    if _classes is None:
        table = np.zeros(0x110000, np.uint8)
        for i in range(0x110000):
            ch = chr(i)
            table[i] = 1 if ch.isupper() else 2 if ch.isalpha() else 3 if ch.isdigit() else 4 if ch.isspace() else 0
        for chars, kind in ((_SYMBOLS, 5), ("!?=_~^", 6), (",.;:'\"()-", 7)):
            table[[ord(ch) for ch in chars]] = kind
        _classes = table
    return _classes


def _bucket(text: str, n: int) -> int:
    return zlib.crc32(text.encode("utf-8", "surrogatepass")) % n


def text_view(text: str | None) -> np.ndarray:
    """Ratios of the whole text and its hashed words, as shares of all words."""
    text = text or ""
    classes = np.zeros(N_CLASSES, np.int64)
    words: Counter[str] = Counter()
    chars = repeats = 0
    for low in range(0, len(text), SLICE):
        part = text[low:low + SLICE]
        points = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32)
        classes += np.bincount(char_classes()[points], minlength=N_CLASSES)
        found = _WORD.findall(part)
        words.update(found)
        chars += sum(map(len, found))
        repeats += sum(map(str.__eq__, found, found[1:]))
    n = words.total()
    hashed = np.zeros(WORDS)
    for word, times in words.items():
        hashed[_bucket(word.lower(), WORDS)] += times
    shares = classes / max(1, len(text))
    letters = max(1, classes[1] + classes[2])
    more = [classes[1] / letters, classes[5] / max(1, n), classes[6] / max(1, n), repeats / max(1, n), len(words) / max(1, n), chars / max(1, n) / 10, np.log1p(n) / 10]
    return np.concatenate([shares, more, 4 * hashed / max(1, n)])


def meta_view(source: str | None, lang: str | None, n_chars: int, n_lines: int, n_blank: int) -> np.ndarray:
    """Source and language hashed, length and layout of the page."""
    hashed = np.zeros(METAS)
    hashed[_bucket(f"source={source}", METAS // 2)] = 1
    hashed[METAS // 2 + _bucket(f"lang={lang}", METAS // 2)] = 1
    per_line = n_chars / max(1, n_lines)
    return np.concatenate([hashed, [np.log1p(n_chars) / 10, np.log1p(n_lines) / 5, np.log1p(per_line) / 10, n_blank / max(1, n_lines), n_chars < 100]])


@dataclass
class Logistic:
    """Ridge logistic regression, fitted by Newton steps; columns are brought to unit spread."""

    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray

    @staticmethod
    def fit(x: np.ndarray, y: np.ndarray, ridge: float = RIDGE) -> Logistic:
        mean, spread = x.mean(0), x.std(0)
        spread[spread < 1e-9] = 1.0
        z = np.hstack([(x - mean) / spread, np.ones((len(x), 1))])
        w, penalty = np.zeros(z.shape[1]), np.full(z.shape[1], ridge)
        penalty[-1] = 1e-6
        for _ in range(25):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            slope = z.T @ (p - y) + penalty * w
            bend = (z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty + 1e-9)
            step = np.linalg.solve(bend, slope)
            w = w - step * min(1.0, 5 / max(1e-9, np.abs(step).max()))
            if np.abs(step).max() < 1e-6:
                break
        return Logistic(mean, spread, w)

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.clip(((x - self.mean) / self.spread) @ self.weights[:-1] + self.weights[-1], -30, 30)


def _chance(logit: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-logit))


@dataclass
class CoTrained:
    """Both views, their calibrations and the combination of the calibrated logits."""

    text: Logistic
    meta: Logistic
    calibrations: tuple[Logistic, Logistic]
    combined: Logistic
    # Per round: pseudo-labels (bad, good) from text to metadata, then from metadata to text.
    exchanged: list[tuple[tuple[int, int], tuple[int, int]]]

    def score(self, xt: np.ndarray, xm: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Chances of good quality: combined, by text, by metadata."""
        views = [c.logit(v.logit(x)[:, None]) for c, v, x in zip(self.calibrations, (self.text, self.meta), (xt, xm))]
        return _chance(self.combined.logit(np.column_stack(views))), _chance(views[0]), _chance(views[1])


def sure_from(chance: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Chances from which a view is sure: (at most, bad; at least, good); -1 and 2 if it never is.

    The loosest bound at which SURE of the labelled rows beyond it, 20 or more, are of the class.
    """
    bounds = []
    for label, sign in ((0, 1), (1, -1)):
        order = np.argsort(sign * chance, kind="stable")
        agree = np.cumsum(y[order] == label) / np.arange(1, len(y) + 1)
        # Rows of one chance stand or fall together.
        last = np.append(np.diff(chance[order]) != 0, True)
        ends = np.nonzero((agree >= SURE) & last & (np.arange(1, len(y) + 1) >= LEAST_SURE))[0]
        bounds.append(float(chance[order][ends[-1]]) if len(ends) else (-1.0, 2.0)[label])
    return bounds[0], bounds[1]


def confident(chance: np.ndarray, free: np.ndarray, bounds: tuple[float, float], share: float, n: int = PER_ROUND) -> tuple[np.ndarray, np.ndarray]:
    """Places of the free rows a view is surest of: (bad, good), of each class at most n times its share.

    Ties go to the earlier row; a row beyond both bounds counts for neither class. A view without
    a bound for one class gives nothing.
    """
    if bounds[0] < 0 or bounds[1] > 1:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    bad, good = chance <= bounds[0], chance >= bounds[1]
    n_good = round(n * share)
    sides = np.nonzero(free & bad & ~good)[0], np.nonzero(free & good & ~bad)[0]
    return tuple(side[np.argsort(sign * chance[side], kind="stable")[:k]] for side, sign, k in zip(sides, (1, -1), (n - n_good, n_good)))


def co_train(xt: np.ndarray, xm: np.ndarray, y: np.ndarray, ut: np.ndarray, um: np.ndarray, rounds: int = ROUNDS) -> CoTrained:
    """Fits on three quarters of the labelled rows and calibrates on the others."""
    held = np.arange(len(y)) % 4 == 3
    if len(set(y[held])) < 2 or len(set(y[~held])) < 2:
        held = np.zeros(len(y), bool)
    fitted, known = ~held, [(xt[~held], y[~held]), (xm[~held], y[~held])]
    test = held if held.any() else fitted
    views, pools = [None, None], [ut, um]
    free = [np.ones(len(ut), bool), np.ones(len(ut), bool)]
    exchanged = []
    for turn in range(rounds + 1):
        views = [Logistic.fit(*rows) for rows in known]
        if turn == rounds or not len(ut):
            break
        given = []
        for me, other in ((0, 1), (1, 0)):
            bounds = sure_from(_chance(views[me].logit((xt, xm)[me][test])), y[test])
            chosen = confident(_chance(views[me].logit(pools[me])), free[other], bounds, float(y[fitted].mean()))
            for label, rows in enumerate(chosen):
                free[other][rows] = False
                known[other] = (np.vstack([known[other][0], pools[other][rows]]), np.concatenate([known[other][1], np.full(len(rows), float(label))]))
            given.append(tuple(map(len, chosen)))
        exchanged.append(tuple(given))
    logits = [v.logit(x[test])[:, None] for v, x in zip(views, (xt, xm))]
    calibrations = tuple(Logistic.fit(x, y[test]) for x in logits)
    both = np.column_stack([c.logit(x) for c, x in zip(calibrations, logits)])
    return CoTrained(views[0], views[1], calibrations, Logistic.fit(both, y[test]), exchanged)


def _rows(docs: DataFrame, text: str, id: str, source: str, lang: str) -> DataFrame:
    t = F.col(f"`{text}`").cast("string")
    return docs.select(
        F.col(f"`{id}`").cast("bigint").alias("id"), row_key(id, text).alias("key"), t.alias("t"),
        F.col(f"`{source}`").cast("string").alias("source"), F.col(f"`{lang}`").cast("string").alias("lang"),
    )


def _features(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    texts = batch.column("t").to_pylist()
    xt = np.array([text_view(t) for t in texts])
    lines = [(t or "").split("\n") for t in texts]
    xm = np.array([
        meta_view(s, g, len(t or ""), len(ls), sum(not x.strip() for x in ls))
        for t, s, g, ls in zip(texts, batch.column("source").to_pylist(), batch.column("lang").to_pylist(), lines)
    ])
    return xt, xm


def _sampled(rows: DataFrame, labels: DataFrame, max_labelled: int, max_unlabelled: int):
    """Features of the ids with the smallest hashes: labelled, then without a label.

    An id that many rows share gives one of them, the one whose text has the smallest hash.
    """
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                xt, xm = _features(batch)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("place"), batch.column("y"), pa.array(list(xt), pa.list_(pa.float64())), pa.array(list(xm), pa.list_(pa.float64()))],
                    ["place", "y", "xt", "xm"],
                )

    place = F.xxhash64(F.lit(SEED), F.col("id"))
    keys = rows.select("id").distinct().join(labels, "id", "left").select(place.alias("place"), "id", "y")
    parts = [keys.filter("y is not null").orderBy("place", "id").limit(max_labelled), keys.filter("y is null and id is not null").orderBy("place", "id").limit(max_unlabelled)]
    # At most 24,000 short rows, so the texts are filtered where they are read.
    chosen = F.broadcast(written(parts[0].unionByName(parts[1]), "quality-sample"))
    one = F.min_by(F.struct("place", "y", "t", "source", "lang"), F.xxhash64("t", "source", "lang"))
    picked = rows.join(chosen, "id").groupBy("id").agg(one.alias("row")).select("row.*")
    found = written(picked.mapInArrow(run, "place bigint, y double, xt array<double>, xm array<double>"), "quality-features").toArrow()
    order = np.argsort(found.column("place").to_numpy(), kind="stable")
    y = found.column("y").to_numpy(zero_copy_only=False)[order]
    made = []
    for name in ("xt", "xm"):
        flat = found.column(name).combine_chunks().flatten().to_numpy()
        made.append(flat.reshape(len(order), -1)[order] if len(order) else np.zeros((0, 1)))
    known = ~np.isnan(y)
    return made[0][known], made[1][known], y[known], made[0][~known], made[1][~known]


def quality_classifier(docs: DataFrame, labels: DataFrame, text: str = "text", id: str = "doc_id", source: str = "source", lang: str = "lang", label: str = "quality", threshold: float = THRESHOLD, max_labelled: int = MAX_LABELLED, max_unlabelled: int = MAX_UNLABELLED) -> DataFrame:
    """(id, score, text_score, meta_score, kept) for every row.

    Scores are chances of quality 1. A document with several labels counts with their majority,
    ties as good; null labels do not count. Null and empty texts are scored like any other, by
    their metadata and a text view of zeros. Rows that share an id are scored one by one. Without
    labels of both classes every score is the share of good labels, or one half without labels.
    """
    c = F.col
    rows = _rows(docs, text, id, source, lang)
    given = labels.select(c(f"`{id}`").cast("bigint").alias("id"), c(f"`{label}`").cast("double").alias("y")).filter("id is not null and y is not null")
    given = given.groupBy("id").agg((F.avg("y") >= 0.5).cast("double").alias("y"))
    xt, xm, y, ut, um = _sampled(rows, given, max_labelled, max_unlabelled)
    model = co_train(xt, xm, y, ut, um) if len(set(y)) == 2 else None
    base = float(y.mean()) if len(y) else 0.5

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            scores = model.score(*_features(batch)) if model is not None and n else [np.full(n, base)] * 3
            yield pa.RecordBatch.from_arrays([batch.column("id"), *[pa.array(s) for s in scores]], ["id", "score", "text_score", "meta_score"])

    scored = rows.select("id", "t", "source", "lang").mapInArrow(run, "id bigint, score double, text_score double, meta_score double")
    return scored.withColumn("kept", c("score") >= threshold).withColumnRenamed("id", id)
