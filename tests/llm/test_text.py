"""Quality rules, line dedup, licences, language: edge rows and plain versions."""

import hashlib
import math
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from alertlake.llm import language_id, license_scan, line_dedup, quality_classifier, quality_rules

SCHEMA = "doc_id bigint, text string, lang string, source string, n_words string"
PROSE = "the quick brown fox jumps over the lazy dog and runs to the river for a drink of the water in the sun"
ROWS = [
    (1, None, "en", "a", "x"), (2, "", None, None, None), (3, PROSE, "en", "a", None), (3, PROSE, "en", "a", None),
    (None, PROSE + " again", "en", "a", None), (5, " \t\r\n", "de", "b", None), (6, "#$% " * 40, "en", "a", None),
    (7, "one two three four five six seven eight " * 9, "en", "a", None), (8, PROSE.upper(), "en", "a", None),
    (9, f"{PROSE}\r\n{PROSE}\n{PROSE}", "en", "a", None), (10, (PROSE + "\n") * 4000, "en", "a", None),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).cache()


def plain_figures(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    seen = {}
    for w in windows:
        seen[w] = seen.get(w, 0) + 1
    covered = {i + k for i, w in enumerate(windows) if seen[w] > 1 for k in range(8)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), sum(ch in "#*$%&|<>" for ch in text or ""), len(lines) - len(set(lines)), len(covered))


def test_quality_rules_match_a_plain_count(docs):
    out = quality_rules.quality_rules(docs)
    assert out.columns == ["doc_id", "text", "lang", "source", *quality_rules.MADE]
    rows = out.collect()
    assert len(rows) == len(ROWS)
    for r in rows:
        assert tuple(r[n] for n in quality_rules.COUNTS) == plain_figures(r["text"])
        assert r["base_failed"] == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
    kept = {r.doc_id for r in rows if r.kept}
    assert kept == {3, None} and {r.doc_id for r in rows if "capitals" in r.failed_rules} == {8}
    # A filter on the verdict alone must not change it or the cost.
    assert out.filter("kept").select("text").count() == 3
    assert quality_rules.quality_rules(docs.limit(0)).count() == 0


def plain_line_dedup(rows):
    key = lambda line: "".join(ch.lower() if "A" <= ch <= "Z" else ch for ch in line.strip(" \t\n\x0b\x0c\r"))
    number = lambda i: 2**63 - 1 if i is None else i
    holders = {}
    for i, text in rows:
        for line in (text or "").split("\n"):
            holders.setdefault(key(line), set()).add(number(i))
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        stay = [x for x in lines if len(key(x)) < 10 or len(holders[key(x)]) < 2 or min(holders[key(x)]) == number(i)]
        out.append((i, len(lines), len(lines) - len(stay), hashlib.sha256("\n".join(stay).encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("batches", [1, 5])
def test_line_dedup_matches_a_plain_version(spark, batches):
    lines = ["Short", "a shared line of text", " A Shared LINE of text\t", "own line number {}", "", "hot line in all of them", "Ärger im Üb", "ärger im üb"]
    rows = [(i * 7 % 40, "\n".join(lines[(i + k) % 8].format(i) for k in range(i % 6))) for i in range(40)]
    rows += [(i, text) for i, text in rows[:3]] + [(None, lines[1]), (None, "own line number 3"), (50, None), (51, lines[5])]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id bigint, text string, n_lines string")
    out = line_dedup.line_dedup(docs, batches=batches)
    assert out.columns == ["doc_id", "text", "n_lines", "n_dropped"]
    digest = F.sha2(F.coalesce("text", F.lit("")), 256)
    got = sorted(map(tuple, out.select("doc_id", "n_lines", "n_dropped", digest).collect()), key=repr)
    assert got == plain_line_dedup(rows)
    assert line_dedup.line_dedup(docs.limit(0)).count() == 0


def test_runs_are_compacted_and_give_the_smallest_owner(spark, tmp_path):
    store = line_dedup.RunStore(spark, str(tmp_path / "runs"), fanout=2)
    for owner in (9, 4, 6, 2, 8):
        store.add(spark.range(owner, owner + 3).select(F.col("id").alias("h1"), F.col("id").alias("h2"), F.lit(owner).cast("bigint").alias("owner")))
    assert sum(map(len, store.levels)) < 5 and len(store.levels) > 1
    known = store.known(spark.range(20).select(F.col("id").alias("h1"), F.col("id").alias("h2")))
    assert {r.h1: r.owner for r in known.collect()} == {2: 2, 3: 2, 4: 2, 5: 4, 6: 4, 7: 6, 8: 6, 9: 8, 10: 8, 11: 9}


def test_licences(spark):
    mit = next(t for n, t in license_scan.TEMPLATES if n == "MIT" and len(t) > 300)
    rows = [
        (1, "Some text.\nLicensed under the Apache License, Version 2.0. More words follow here."), (2, None), (3, ""), (4, "licensed"),
        (5, mit.replace("copies", "pieces", 1) + "\n\nOther paragraph."), (6, "Released under the MIT License.\nReleased under the MIT License."),
        (6, "Released under the MIT License."), (7, "All rights reserved by the authors of this long text. " * 500),
        (None, "This work is licensed under the GNU General Public License, version 3."),
    ]
    docs = spark.createDataFrame([(i, t, 1.0) for i, t in rows], "doc_id bigint, text string, dice double")
    found = {(r.doc_id, r.licence): (round(r.dice, 3), r.n_passages) for r in license_scan.license_scan(docs).collect()}
    assert found.keys() == {(1, "Apache-2.0"), (5, "MIT"), (6, "MIT"), (None, "GPL-3.0")}
    assert found[(1, "Apache-2.0")] == (1.0, 1) and found[(6, "MIT")] == (1.0, 1) and 0.95 < found[(5, "MIT")][0] < 1
    assert license_scan.license_scan(docs.limit(0)).count() == 0


def plain_phrases(text, model):
    """Greedy longest matches in the model's normalised text."""
    n = at = 0
    while at < len(text):
        n += 1
        size = 1
        while at + size <= len(text) and text[at:at + size] in model:
            size += 1
        at += max(1, size - 1)
    return n


def test_phrases_are_longest_matches():
    samples = {"x": "abra kadabra simsala bim", "y": "hokus pokus fidibus dreimal schwarzer kater"}
    model = language_id.Model(samples)
    plain = {k: "".join(map(chr, language_id.code_points(v))) for k, v in samples.items()}
    texts = ["abra simsala", "pokus kater bim", "zzz qq", "a", "kadabrakadabra"]
    points = [language_id.code_points(t) for t in texts]
    got = model.phrases(points).tolist()
    assert got == [[plain_phrases("".join(map(chr, p)), plain[k]) for k in ("x", "y")] for p in points]


def test_long_texts_are_parsed_in_stretches():
    """Texts beyond one stretch, among shorter ones, against a plain parse of each stretch."""
    draw = random.Random(3)
    samples = {"x": "".join(draw.choice("abcd ") for _ in range(3000)), "y": "".join(draw.choice("abe ") for _ in range(700))}
    model = language_id.Model(samples)
    plain = {k: "".join(map(chr, language_id.code_points(v))) for k, v in samples.items()}
    texts = ["".join(draw.choice("abcdez ") for _ in range(n)) for n in (5, 1022, 1500, 4100, 2048)]
    points = [language_id.code_points(t) for t in texts]
    size = language_id.STRETCH

    def parsed(text, k):
        return sum(plain_phrases(text[i:i + size], plain[k]) for i in range(0, len(text), size))

    assert model.phrases(points).tolist() == [[parsed("".join(map(chr, p)), k) for k in ("x", "y")] for p in points]


def test_small_languages_leave_others_their_sample(spark):
    rows = [(i, "das haus am see " * 400, "de") for i in range(8)] + [(90, "een huis " * 500, "nl"), (91, "hus " * 9, "da")]
    samples = language_id.training_sample(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))
    assert {k: len(v) for k, v in samples.items()} == {"de": language_id.CHARS_PER_LANGUAGE, "nl": 4500, "da": 36}


def plain_bounds(chance, y):
    """Every chance tried as a bound, the loosest that holds wins."""
    low, high = -1.0, 2.0
    for bound in sorted(set(chance)):
        below = [label for x, label in zip(chance, y) if x <= bound]
        if len(below) >= quality_classifier.LEAST_SURE and below.count(0) / len(below) >= quality_classifier.SURE:
            low = bound
    for bound in sorted(set(chance), reverse=True):
        above = [label for x, label in zip(chance, y) if x >= bound]
        if len(above) >= quality_classifier.LEAST_SURE and above.count(1) / len(above) >= quality_classifier.SURE:
            high = bound
    return low, high


def test_pseudo_labels_against_a_plain_round():
    draw = np.random.default_rng(5)
    for spread in (0.02, 0.2, 3.0):
        y = (draw.random(400) < 0.7).astype(float)
        chance = np.round(np.clip(y * 0.8 + 0.1 + draw.normal(0, spread, 400), 0, 1), 2)
        bounds = quality_classifier.sure_from(chance, y)
        assert bounds == plain_bounds(chance.tolist(), y.tolist())
        pool, free = np.round(draw.random(900), 2), draw.random(900) < 0.8
        got = quality_classifier.confident(pool, free, bounds, 0.7, n=100)
        if bounds[0] < 0 or bounds[1] > 1:
            assert [len(g) for g in got] == [0, 0]
            continue
        both = (pool <= bounds[0]) & (pool >= bounds[1])
        bad = sorted((p, i) for i, p in enumerate(pool) if free[i] and p <= bounds[0] and not both[i])[:30]
        good = sorted((-p, i) for i, p in enumerate(pool) if free[i] and p >= bounds[1] and not both[i])[:70]
        assert [list(g) for g in got] == [[i for _, i in bad], [i for _, i in good]]


def test_exchange_helps_the_view_with_few_features_known():
    """Two views that each tell the class: both give labels, and scores of unseen rows get no worse."""
    draw = np.random.default_rng(9)
    n = 6000
    y = (draw.random(n) < 0.6).astype(float)
    views = [np.column_stack([y + draw.normal(0, 0.45, n), draw.normal(0, 1, (n, 30))]) for _ in range(2)]
    known, pool, unseen = slice(0, 160), slice(160, 4000), slice(4000, n)
    right = []
    for rounds in (0, quality_classifier.ROUNDS):
        model = quality_classifier.co_train(views[0][known], views[1][known], y[known], views[0][pool], views[1][pool], rounds)
        right.append(((model.score(views[0][unseen], views[1][unseen])[0] >= 0.5) == y[unseen]).mean())
    assert len(model.exchanged) == quality_classifier.ROUNDS and sum(map(sum, model.exchanged[0])) > 100
    assert right[1] >= right[0]


def test_languages(spark):
    german = "der hund und die katze sind im garten und spielen mit dem ball auf der wiese"
    rows = [(1, PROSE, "en", 1), (2, german, "de", 1), (3, None, "en", 1), (4, "123 !", "en", 1), (5, PROSE + german[:10], "en", 1),
            (6, german * 3000, "de", 1), (6, german * 3000, "de", 1), (None, "", None, 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, score int")
    samples = language_id.training_sample(docs)
    assert set(samples) == {"en", "de"}
    out = language_id.identify(docs, samples)
    assert out.columns == ["doc_id", "text", "lang", "lang_pred", "score"]
    got = [(r.doc_id, r.lang_pred) for r in out.collect()]
    assert sorted(got, key=repr) == sorted([(1, "en"), (2, "de"), (3, "und"), (4, "und"), (5, "en"), (6, "de"), (6, "de"), (None, "und")], key=repr)
    assert all(0 <= r.score <= 1 for r in out.collect())
    assert language_id.training_sample(docs.limit(0)) == {}
    assert {r.lang_pred for r in language_id.identify(docs, {}).collect()} == {"und"}


def test_quality_classifier(spark):
    good = [(i, f"{PROSE} number {i}. " * (1 + i % 5), "en", f"s{i % 3}") for i in range(200)]
    bad = [(1000 + i, "buy$$$ now*** cheap### " * (5 + i % 7), "en", f"s{i % 3}") for i in range(200)]
    edge = [(5000, None, None, None), (5001, "", "en", None), (5002, "x " * 100_000, "en", "s1"), (None, PROSE, "en", "s1"), (7, PROSE, "en", "s1")]
    docs = spark.createDataFrame([(*r, 0.5) for r in good + bad + edge], "doc_id bigint, text string, lang string, source string, score double")
    labels = spark.createDataFrame([(i, 1) for i in range(0, 200, 2)] + [(1000 + i, 0) for i in range(0, 200, 2)] + [(4, None), (6, 1), (None, 1)], "doc_id bigint, quality int")
    out = quality_classifier.quality_classifier(docs, labels).collect()
    assert len(out) == 405 and all(0 <= r.score <= 1 for r in out)
    kept = {r.doc_id: r.kept for r in out}
    held = [i for i in range(1, 200, 2)]
    assert all(kept[i] for i in held) and not any(kept[1000 + i] for i in held)
    # An id shared by many rows is one row of the sample.
    many = docs.unionByName(spark.range(3000).select(F.lit(8).alias("doc_id"), F.lit(PROSE).alias("text"), F.lit("en").alias("lang"), F.lit("s1").alias("source"), F.lit(0.5).alias("score")))
    assert quality_classifier.quality_classifier(many, labels).count() == 3405
    one = quality_classifier.quality_classifier(docs, labels.filter("quality = 1")).collect()
    assert {r.score for r in one} == {1.0}
    assert {r.score for r in quality_classifier.quality_classifier(docs, labels.limit(0)).collect()} == {0.5}
    assert quality_classifier.quality_classifier(docs.limit(0), labels).count() == 0


def licence_rows(texts):
    """Each text in paragraphs and lines of about ten words, inside a longer document."""
    rows = []
    for i, (paragraphs, mark) in enumerate(texts):
        lines = []
        for paragraph in paragraphs:
            words = paragraph.split()
            lines += [mark + " ".join(words[k:k + 10]) for k in range(0, len(words), 10)] + [mark.rstrip()]
        rows.append((i, "#!/usr/bin/env python\nCopyright (c) 2020 Somebody Else\n\n" + "\n".join(lines) + "\nimport os\n" + (PROSE + ".\n") * 30))
    return rows


def test_licences_of_several_paragraphs(spark):
    longest = {}
    for name, text in license_scan.TEMPLATES:
        longest[name] = max(longest.get(name, ""), text, key=len)
    mit, gpl = longest["MIT"], longest["GPL-3.0"]
    cut = lambda text, *marks: re.split("|".join(f"(?={re.escape(m)})" for m in marks), text)
    three = cut(mit, "The above copyright", "THE SOFTWARE IS"), cut(gpl, "This program is distributed", "You should have")
    assert all(len(x) == 3 for x in three)
    rows = licence_rows([(three[0], ""), (three[1], ""), (three[0], "// "), (three[1], "# ")])
    rows.append((4, (PROSE + ".\n\n") * 9 + "\n\n".join(x.replace("\n", " ") for x in three[0]) + "\n\n" + PROSE))
    rows += [(5, three[0][0]), (6, "\n".join(["of", "the", "software"] * 300))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = {(r.doc_id, r.licence): r for r in license_scan.license_scan(docs).collect()}
    assert found.keys() == {(0, "MIT"), (1, "GPL-3.0"), (2, "MIT"), (3, "GPL-3.0"), (4, "MIT")}
    assert all(r.dice > 0.97 and r.n_passages == 1 for r in found.values())


def test_complete_licences_have_their_own_name(spark):
    short = lambda text: len(text.split()) < 60
    whole = [(name, text) for name, text in license_scan.TEMPLATES if not short(text)]
    assert {name for name, _ in whole} >= {"BSD-2-Clause", "BSD-3-Clause", "ISC", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0", "MIT"}
    assert all("WARRANT" in text.upper() for _, text in whole)
    docs = spark.createDataFrame(licence_rows([([text], "// ") for _, text in whole]), "doc_id bigint, text string")
    found = [(r.doc_id, r.licence) for r in license_scan.license_scan(docs).collect()]
    assert sorted(found) == [(i, name) for i, (name, _) in enumerate(whole)]


def plain_licences(text, templates=license_scan.TEMPLATES):
    """(licence, dice, passages) of a text, by comparing every passage and window with every template."""
    plain = lambda t: re.sub(r"[^\w\n.!?;]+|_", " ", t.lower())
    words = lambda t: [w for w in re.split(r"[ \n.!?;]+", t) if w]
    grams = lambda w: set(zip(w, w[1:]))
    known = [(name, words(plain(t))) for name, t in templates]

    def best(w):
        fits = []
        for name, t in known:
            if len(w) > 1 and math.ceil(len(t) * 0.8 / 1.2 - 1e-9) <= len(w) <= math.floor(len(t) * 1.2 / 0.8 + 1e-9):
                a, b = grams(w), grams(t)
                fits.append((-2 * len(a & b) / (len(a) + len(b)), name))
        return min((f for f in fits if f[0] <= -0.8), default=None)

    t = plain(text)
    pieces = [t, *re.split(r"\n *\n", t), *t.split("\n"), *re.split(license_scan.SENTENCE, t)]
    found = {tuple(words(p)): best(words(p)) for p in pieces}
    parts = [w for w in map(words, re.split(license_scan.SENTENCE, t)) if w]
    named = {g for _, w in known for g in zip(w, w[1:])}
    inside = [sum(g in named for g in zip(p, p[1:])) for p in parts]
    leads = [(p[-1], q[0]) in named for p, q in zip(parts, parts[1:])] + [False]
    runs = []
    for first in range(len(parts)):
        if inside[first] + leads[first] < 0.4 * len(parts[first]):
            continue
        for last in range(first + 1, len(parts)):
            w = [x for p in parts[first:last + 1] for x in p]
            if len(w) > 600:
                break
            if inside[last] + leads[last - 1] >= 0.4 * len(parts[last]) and (hit := best(w)):
                runs.append((hit[0], len(w), first, last, hit[1], tuple(w)))
    for end in (2, 3):
        runs = [min(r for r in runs if r[end] == at) for at in {r[end] for r in runs}]
    half = lambda x, y: 2 * (min(x[3], y[3]) - max(x[2], y[2]) + 1) >= min(x[3] - x[2], y[3] - y[2]) + 1
    for r in runs:
        if not any(y[:5] < r[:5] and half(r, y) for y in runs):
            found[r[5]] = min(found.get(r[5]) or (0, ""), (r[0], r[4]))
    out = {}
    for hit in found.values():
        if hit:
            out.setdefault(hit[1], []).append(-hit[0])
    return {name: (round(max(d), 9), len(d)) for name, d in out.items()}


def test_licences_match_a_plain_search(spark):
    rng = random.Random(8)
    sentences = [x for _, t in license_scan.TEMPLATES for x in re.split(r"(?<=[.;:]) +", t)]
    texts = []
    for _ in range(60):
        lines = [PROSE + "." for _ in range(rng.randint(0, 3))]
        for _ in range(rng.randint(1, 3)):
            _, t = rng.choice(license_scan.TEMPLATES)
            cut = re.split(r"(?<=[.;]) +", t)
            if rng.random() < 0.5 and len(cut) > 2:
                cut.pop(rng.randrange(len(cut)))
            at = rng.randint(0, len(lines))
            lines[at:at] = cut
        if rng.random() < 0.5:
            lines.insert(rng.randint(0, len(lines)), rng.choice(sentences))
        texts.append(rng.choice(["\n", "\n\n", " "]).join(lines))
    texts += ["Released under the MIT License.\n" * 12, "Licensed under the Apache License, Version 2.0. " * 5 + PROSE]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {}
    for r in license_scan.license_scan(docs).collect():
        got.setdefault(r.doc_id, {})[r.licence] = (round(r.dice, 9), r.n_passages)
    for i, text in enumerate(texts):
        assert got.get(i, {}) == plain_licences(text), text


def test_many_licence_lines_take_linear_time(spark):
    texts = ["Released under the MIT License.\n" * n for n in (1600, 6400)]
    license_scan.license_scan(spark.createDataFrame([(0, texts[0])], "doc_id bigint, text string")).collect()
    took = []
    for text in texts:
        began = time.perf_counter()
        rows = license_scan.license_scan(spark.createDataFrame([(0, text)], "doc_id bigint, text string")).collect()
        took.append(time.perf_counter() - began)
        assert [(r.licence, r.dice) for r in rows] == [("MIT", 1.0)]
    print(took)
    assert took[1] < 4 * took[0] + 10
