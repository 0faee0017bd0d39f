"""Periodic runs and centroid clusters: edge rows and plain versions."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from alertlake.llm import centroids, periodic_runs


def plain_runs(words):
    found = {}
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i < len(words) - q:
            start = i
            while i < len(words) - q and words[i] == words[i + q]:
                i += 1
            if i - start + q >= max(6, 4 * q):
                found.setdefault((start, i + q), q)
            i += i == start
    return sorted((s, e - s, p) for (s, e), p in found.items())


def plain_collapsed(words, runs):
    gone = {i for s, n, p in runs for i in range(s + p, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def repetitive_texts(n):
    rng = random.Random(11)
    for _ in range(n):
        size, letters = rng.randint(0, rng.choice([8, 40, 150])), rng.choice([1, 2, 2, 3, 40])
        words = [f"w{rng.randrange(letters)}" for _ in range(size)]
        if size > 4 and rng.random() < 0.6:
            at, p = rng.randrange(size - 1), rng.randint(1, 9)
            unit = words[at:at + p]
            words = words[:at] + (unit * size)[:size] + words[at:]
        yield " ".join(words)


@pytest.mark.parametrize("chunk_words", [50, 100_000])
def test_runs_match_a_plain_search(monkeypatch, chunk_words):
    monkeypatch.setattr(periodic_runs, "CHUNK_WORDS", chunk_words)
    texts = [*repetitive_texts(600), "a b " * 3000, "a " * 5000, " ".join("ab"[bin(i).count("1") % 2] for i in range(1000))]
    some = 0
    for text, (n, runs, collapsed) in zip(texts, periodic_runs._of_texts(texts)):
        words = text.split()
        assert n == len(words) and runs == plain_runs(words)
        assert collapsed == plain_collapsed(words, runs)
        some += len(runs)
    assert some > 300


def test_extensions_match_a_plain_comparison():
    rng = np.random.default_rng(2)
    inner = np.concatenate([rng.integers(0, 2, 200), np.tile(rng.integers(0, 3, 7), 30), np.zeros(40, int)])
    symbols = np.concatenate([[5], inner, [6]]).astype(np.int32)
    a, b = (x.ravel() for x in np.meshgrid(np.arange(1, len(symbols) - 1, 3), np.arange(1, len(symbols) - 1, 2)))
    a, b = np.minimum(a, b)[a != b], np.maximum(a, b)[a != b]
    grammar = periodic_runs.Grammar(symbols)
    for step in (1, -1):
        for x, y, n in zip(a.tolist(), b.tolist(), grammar.extension(a, b, step).tolist()):
            want = 0
            while symbols[x] == symbols[y]:
                x, y, want = x + step, y + step, want + 1
            assert n == want
    assert any(grammar.blocks) and not all(grammar.blocks)


def test_periodic_runs_of_rows(spark):
    rows = [(1, None, "x", 7), (2, "", "x", 7), (3, " \t\n", "x", 7), (4, "a a a a a a", "x", 7), (4, "a a a a a a", "x", 7), (None, "x\ty\nx y x y x y z", None, None),
            (5, "A a A a A a A a", "é", 7), (6, "ä ö " * 20 + "ü", "x", 7), (7, "word", "x", 7)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, row string, RUNS bigint")
    found = periodic_runs.periodic_runs(docs)
    assert found.columns == ["doc_id", "text", "row", "n_words", "runs", "collapsed"]
    out = found.collect()
    assert len(out) == len(rows) and sorted((r.row or "") for r in out) == sorted((r[2] or "") for r in rows)
    for r in out:
        words = (r.text or "").split()
        assert [tuple(x) for x in r.runs] == plain_runs(words) and r.collapsed == plain_collapsed(words, plain_runs(words))
    digests = {r.doc_id: r for r in periodic_runs.digests(found, "doc_id").collect()}
    assert digests[1].n_runs == 0 and digests[1].start is None and digests[1].runs_sha256 == hashlib.sha256(b"").hexdigest()
    assert tuple(digests[6])[1:6] == (1, 0, 40, 2, 20000) and digests[6].runs_sha256 == hashlib.sha256(b"0,40,2\n").hexdigest()
    assert periodic_runs.periodic_runs(docs.limit(0)).count() == 0


def test_the_best_run_is_chosen_exactly(spark):
    runs = [(30, 12, 3), (5, 8, 2), (0, 16, 4), (50, 3999, 1000)]
    df = spark.createDataFrame([([dict(zip(("start", "length", "period"), r)) for r in runs],), ([],)], "runs array<struct<start:bigint,length:bigint,period:bigint>>")
    assert [r[0] and tuple(r[0]) for r in df.select(periodic_runs.best_run(F.col("runs"))).collect()] == [(0, 16, 4), None]


def plain_clusters(vectors, clusters, rounds):
    kept = [(i, [math.floor(256 * x) for x in v]) for i, v in vectors]
    order = sorted(range(len(kept)), key=lambda k: (hashlib.sha256(f"2:{kept[k][0]}".encode()).hexdigest(), kept[k][1]))
    centres = [kept[k][1] for k in order[:clusters]]
    for step in range(rounds + 1):
        far = [[sum((a - b) ** 2 for a, b in zip(v, c)) for c in centres] for _, v in kept]
        near = [(min(range(len(centres)), key=lambda k: (d[k], k)), min(d)) for d in far]
        if step < rounds:
            for k in range(len(centres)):
                mine = [v for (_, v), (c, _) in zip(kept, near) if c == k]
                if mine:
                    centres[k] = [sum(x) // len(mine) for x in zip(*mine)]
    return [(i, *n) for (i, _), n in zip(kept, near)], centres


@pytest.mark.parametrize("scale", [1.0, 3000.0, 400_000.0])
def test_clusters_match_a_plain_version(spark, scale):
    rng = np.random.default_rng(4)
    at = rng.normal(size=(6, 64))
    vectors = [(i, [float(x) for x in scale * (at[i % 6] + 0.05 * rng.normal(size=64)).clip(-1, 1)]) for i in range(240)]
    vectors += [(1000 + i, vectors[0][1]) for i in range(300)] + [(3, vectors[3][1]), (3, vectors[3][1])]
    bad = [(2000, None), (2001, []), (2002, [0.0] * 63), (2003, [None] + [0.0] * 63), (2004, [float("nan")] * 64), (2005, [float("inf")] + [0.0] * 63), (2006, [1e300] * 64)]
    df = spark.createDataFrame(vectors + bad, "vec_id bigint, embedding array<double>")
    found, centres = centroids.centroid_clusters(df.withColumn("cluster", F.lit("x")), clusters=9, rounds=3)
    want, want_centres = plain_clusters(vectors, 9, 3)
    rows = found.collect()
    assert sorted((r.id, r.cluster, r.distance) for r in rows) == sorted(want) and centres.tolist() == want_centres
    # Blocks of one group are held against few centroids.
    assert min(r.compared for r in rows) < 9
    summed = centroids.digests(found, centres).collect()
    whole = sum(d for _, _, d in want)
    assert {r.inertia for r in summed} == {whole if whole < 1 << 63 else None}
    assert all(r.centroid_sha256 == hashlib.sha256(",".join(map(str, want_centres[r.cluster])).encode()).hexdigest() for r in summed)


def test_clusters_of_few_or_no_vectors(spark):
    schema = "vec_id bigint, embedding array<float>, x string"
    none, centres = centroids.centroid_clusters(spark.createDataFrame([(1, None, "a")], schema))
    assert none.count() == 0 and len(centres) == 0 and centroids.digests(none, centres).count() == 0
    few, centres = centroids.centroid_clusters(spark.createDataFrame([(None, [0.5] * 64, "a"), (None, [0.5] * 64, "a")], schema))
    assert [(r.id, r.cluster, r.distance) for r in few.collect()] == [(None, 0, 0)] * 2 and len(centres) == 2


@pytest.mark.parametrize("components,bits", [(2, 3), (3, 2), (3, 3), (4, 2)])
def test_neighbours_on_the_curve_touch(components, bits):
    cells = np.array(np.meshgrid(*[np.arange(1 << bits)] * components)).reshape(components, -1).T
    keys = [k.tobytes() for k in centroids.hilbert_keys(cells, bits)]
    assert len(set(keys)) == len(keys)
    ordered = cells[sorted(range(len(keys)), key=keys.__getitem__)]
    assert (np.abs(np.diff(ordered, axis=0)).sum(axis=1) == 1).all()
