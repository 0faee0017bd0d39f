"""Personal data: base spans against Python's regular expressions, loose spans, votes and long texts."""

import hashlib
import random
import re
import time

import numpy as np
import pytest

from alertlake.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_luhn(digits):
    twice = [2 * int(d) for d in digits[-2::-2]]
    return (sum(map(int, digits[-1::-2])) + sum(x - 9 if x > 9 else x for x in twice)) % 10 == 0


def plain_base(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == "email" or kind == "ip" and all(int(x) <= 255 for x in m.group().split(".")) or kind == "phone" and 9 <= len(digits) <= 15 or (
                kind == "card" and 13 <= len(digits) <= 19 and plain_luhn(digits)
            ):
                out.append((kind, m.start(), m.end()))
    return out


def places(row, base):
    return [(s.kind, s.start, s.end) for s in row.spans if s.base == base]


ROWS = [
    (1, None), (2, ""), (3, " \n"), (4, "mail a@b.c_d@e.f and x@y@z.de, a..b@c--d.e.f.g"), (5, "1.2.3.4.5.6.7.8 256.1.1.1 0001.2.3.0255 é1.1.1.1"),
    (6, "4465758382889437 4465758382889437 and 4465-7583-8288-9437, 4465 7583 8288 9438"), (7, "+1 (743) 555-3824, +12, +1-2 +49 30 901820-"),
    (7, "+1 (743) 555-3824"), (None, "x@y.zz"), (None, "x@y.zz"), (8, "😀é a@b.cc 😀 192.168.0.1 \U0001f600 +4930901820555"),
    (9, "write to jane.doe (at) mail.example [dot] org or (843) 555-7672 today"), (10, "card: 4465.7583.8288.9437 or 4465.7583.8288.9438"),
    (11, "the ssn 123-45-6789, the isbn 000-45-6789"), (12, "IBAN: DE89 3704 0044 0532 0130 00 or DE88 3704 0044 0532 0130 00"),
    (13, "Dear Dr. Maria Schmidt, host 2001:db8:0:0:0:0:0:1 at 12:34:56"), (14, "plain words only, in 1999 and 3.14"),
]


@pytest.fixture(scope="module")
def found(spark):
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in ROWS], "doc_id bigint, text string, found string, N int")
    spans, model = pii.pii_spans(docs)
    return spans.collect(), model


def test_base_spans_are_those_of_the_patterns(found):
    rows, _ = found
    key = lambda r: (r[0] is None, r[0] or 0, str(r[1]))
    assert sorted([(r.id, places(r, True)) for r in rows], key=key) == sorted([(i, plain_base(t or "")) for i, t in ROWS], key=key)
    texts = {i: t for i, t in ROWS if i != 7}
    for r in rows:
        assert r.id == 7 or all(texts[r.id][s.start:s.end] == s.text for s in r.spans)


def test_loose_spans_are_added_apart_from_base_spans(found):
    rows, model = found
    added = {r.id: [s.text for s in r.spans if not s.base] for r in rows}
    assert added[9] == ["jane.doe (at) mail.example [dot] org", "(843) 555-7672"] and added[14] == []
    assert added[6] == ["4465758382889437"] * 2 and added[10] == ["4465.7583.8288.9437"]
    assert added[12] == ["DE89 3704 0044 0532 0130 00"] and "000-45-6789" not in added[11]
    for r in rows:
        spans = [(s.start, s.end) for s in r.spans]
        assert all(s.score >= pii.MIN_SCORE for s in r.spans if not s.base)
        assert not any(a < d and c < b for s, (a, b) in zip(r.spans, spans) if not s.base for c, d in spans if (a, b) != (c, d))
    assert model.reliability["check"] > 0.8


def test_random_texts(spark):
    rng = random.Random(3)
    parts = ["a", "@", ".", "b-", "1", "25", "256", "+", " ", "(", ")", "-", "4465758382889437", "é", "😀", "_", "x@y.z", "1.2.3.4", "\n"]
    texts = ["".join(rng.choices(parts, k=rng.randint(1, 60))) for _ in range(1500)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.id: places(r, True) for r in pii.pii_spans(docs)[0].collect()}
    assert got == {i: plain_base(t) for i, t in enumerate(texts)}


def test_long_texts_take_linear_time(spark):
    texts = ["a" * 1_000_000, "1" * 1_000_000, "1." * 300_000, "1 " * 300_000, "+1" + "(" * 500_000, "a@" * 300_000, "a@b." * 200_000, "x@y.zz +4930901820555 " * 20_000, "1:" * 200_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(len(texts))
    began = time.perf_counter()
    rows = {r.doc_id: r for r in pii.digests(pii.pii_spans(docs)[0]).collect()}
    assert time.perf_counter() - began < 120
    assert rows[7].n_email == rows[7].n_phone == 20_000 and rows[0].spans == ""
    listed = ",".join(f"{k}:{s}:{e}" for k, s, e in plain_base(texts[7]))
    assert rows[7].base_sha256 == hashlib.sha256(listed.encode()).hexdigest()


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert pii.digests(pii.pii_spans(docs)[0]).count() == 0
    none, model = pii.pii_spans(spark.createDataFrame([(1, "no data")], "doc_id bigint, text string"))
    assert [tuple(r) for r in pii.digests(none).collect()] == [(1, 0, 0, 0, 0, hashlib.sha256(b"").hexdigest(), "")] and model.reliability == {}


def test_reliabilities_are_recovered():
    rng = np.random.default_rng(9)
    right = (0.95, 0.9, 0.8, 0.7, 0.6, 0.85)
    truth = rng.random(40_000) < 0.4
    votes = np.stack([np.where(rng.random(len(truth)) < r, truth, ~truth) for r in right], axis=1) * 2 - 1
    patterns, index, n = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    true, said = pii.likelihoods([("card", ",".join(map(str, p)), int(c)) for p, c in zip(patterns, n)])
    assert all(abs(said[name] - r) < 0.02 for name, r in zip(pii.LABELERS, right))
    assert ((true[index.ravel()] > 0.5) == truth).mean() > 0.95


def test_running_sums(spark):
    rng = random.Random(1)
    lists = [[], [5], *[[rng.randint(0, 9) for _ in range(n)] for n in (2, 3, 4, 9, 10, 1000)]]
    df = spark.createDataFrame([(x,) for x in lists], "x array<int>")
    assert [r[0] for r in df.select(pii.running(df.x)).collect()] == [[sum(x[:i]) for i in range(len(x))] for x in lists]
