"""SimHash, WARC, decontamination, mixing, chat, pipeline: edge rows and plain versions."""

import hashlib
import json
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from alertlake.llm import chat_format, components, decontaminate, mix_sources, queries, simhash, warc
from alertlake.session import written

RNG = random.Random(7)
VOCABULARY = [f"w{i}" for i in range(400)]


def prose(n):
    return " ".join(RNG.choice(VOCABULARY) for _ in range(n))


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(n, edges):
    root = list(range(n))
    for _ in range(n):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    return root


def test_simhash_matches_a_plain_version(spark):
    base = [prose(60) for _ in range(8)]
    texts = base + [b + " end" for b in base] + [b.upper().replace(" ", "\r\n\t") for b in base[:3]]
    rows = [(100 - i, t) for i, t in enumerate(texts)] + [(200, None), (201, ""), (202, " \n"), (203, "one"), (204, "ONE"), (205, "É"), (100, texts[0]), (None, base[1]), (None, "lonely words here")]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id bigint, text string, fp string")
    out = simhash.simhash_groups(docs).collect()
    assert len(out) == len(rows)
    prints = [plain_fingerprint(t) for _, t in rows]
    edges = [(i, j) for i in range(len(rows)) for j in range(i) if bin(prints[i] ^ prints[j]).count("1") <= 3]
    roots = plain_components(len(rows), edges)
    least = {r: min((rows[i][0] for i in range(len(rows)) if roots[i] == r and rows[i][0] is not None), default=None) for r in set(roots)}
    want = sorted([(i, f"{p:016x}", least[r]) for (i, _), p, r in zip(rows, prints, roots)], key=repr)
    assert sorted([(r.id, r.fingerprint, r.component_id) for r in out], key=repr) == want
    left = simhash.near_dedup(docs)
    assert left.columns == docs.columns and left.count() == len(set(roots))
    assert simhash.simhash_groups(docs.limit(0)).count() == 0 and simhash.near_dedup(docs.limit(0)).count() == 0


def test_links_of_close_fingerprints_are_all_joined(spark):
    rng = np.random.default_rng(3)
    start = rng.integers(-2**63, 2**63, 30, dtype=np.int64)
    near = {int(x) for x in start}
    for x in start:
        for _ in range(40):
            flipped = int(np.uint64(np.int64(x).view(np.uint64) ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, int(rng.integers(1, 4)), replace=False)))).view(np.int64))
            near.add(flipped)
    values = sorted(near)
    found = components.components(simhash.links(spark.createDataFrame([(v,) for v in values], "fp bigint"))).collect()
    unsigned = np.array(values, np.int64).view(np.uint64)
    edges = [(int(i), int(j)) for i, j in zip(*np.nonzero(np.triu(np.bitwise_count(unsigned[:, None] ^ unsigned[None, :]) <= 3, 1)))]
    # Signed order is the order of the sorted values, so the smallest index is the smallest value.
    roots = list(range(len(values)))
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            if roots[a] != roots[b]:
                roots[a] = roots[b] = min(roots[a], roots[b])
                changed = True
    got = {r.node: r.root for r in found}
    assert all(got.get(v, v) == values[r] for v, r in zip(values, roots))


def test_components_of_long_chains_and_hubs(spark):
    rows = [(i, i + 1) for i in range(60)] + [(100, 200 + i) for i in range(300)] + [(7, 7), (700, 600), (600, 700)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(rows, "u bigint, v bigint")).collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, **{200 + i: 100 for i in range(300)}, 700: 600}


def test_forest_joins_what_the_matrix_joins():
    rng = np.random.default_rng(1)
    for density in (0.02, 0.2, 0.9):
        near = rng.random((30, 40)) < density
        x, y = simhash._forest(near)
        assert near[x, y].all() and len(x) < 70 or len(x) == near.sum()

        def roots(cells):
            return plain_components(70, [(int(a), 30 + int(b)) for a, b in cells])

        assert roots(zip(x, y)) == roots(zip(*np.nonzero(near)))


def test_long_texts_have_the_same_fingerprint(monkeypatch):
    text = prose(5000)
    whole = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "LONG_TEXT", 10)
    monkeypatch.setattr(simhash, "CHUNK_WORDS", 7)
    assert simhash.fingerprint(text) == whole and simhash.fingerprint("a b") == simhash.fingerprint(" a  b ")


def test_warc(spark, monkeypatch):
    big, other = "<p>" + prose(400) + "é", "<p>" + prose(300)
    rows = [(i, f"http://www.Host{i % 3}.example.org/p{i % 5}?q={i}#f", f"<p>{i}") for i in range(40)]
    rows += [(100 + i, "http://same.example.com/", big) for i in range(30)] + [(50, None, big), (51, "not a url\r\nX: y", other), (52, "http://[bad", other)]
    rows += [(60, "http://a.example/", None), (60, "http://a.example/", None), (129, "http://same.example.com/", big), (None, "http://b.example/", big), (70, "", "x" * 999), (71, "", "x" * 999), (72, "u", "x" * 1000), (73, "u", "x" * 1000)]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id bigint, url string, html string, key int")
    root = warc.shared_folder(spark, "warc")
    index = warc.build_index(warc.write_archives(warc.with_revisits(pages), root), root, block_lines=7)
    assert index.directory.count() > 5
    got = warc.read_records(warc.lookup(index, warc.url_keys(pages)), root).collect()
    last = {}
    for i, _, html in rows:
        body = (html or "").encode()
        if len(body) >= 1000 and i is not None:
            last[body] = max(last.get(body, i), i)
    want = []
    for i, _, html in rows:
        body = (html or "").encode()
        again = body in last and (i is None or i < last[body])
        want.append((i, len(body), hashlib.sha1(body).hexdigest(), "revisit" if again else "response", last[body] if again else None))
    assert sorted([(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got], key=repr) == sorted(want, key=repr)
    bodies = {r.page_id: bytes(r.payload) for r in got if r.payload is not None}
    assert all(bodies[i] == (html or "").encode() for i, _, html in rows if i in bodies)
    keys = spark.createDataFrame([("com,example,same)/",), ("org,example,none)/",), (None,), ("com,example,same)/",)], "key string")
    assert warc.lookup(index, keys).count() == 31
    empty = warc.archive_pages(pages.limit(0))
    assert empty.directory.count() == 0 and warc.lookup(empty, keys).count() == 0
    assert warc.surt_key("https://www.example.com:8080/a?b=1#c") == "com,example,www:8080)/a?b=1"


def test_decontamination(spark):
    items = [(1, prose(30)), (2, prose(24)), (2, prose(40)), (3, None), (4, ""), (5, "two words"), (6, "three little words"), (7, prose(12))]
    items.append(items[0])
    words = items[0][1].split()
    edited = " ".join(w if i % 8 else "changed" for i, w in enumerate(words))
    gapped = " ".join(words[:14] + ["more", "words"] + words[15:])
    rows = [
        (10, prose(200) + " " + items[0][1].upper().replace(" ", ", ") + " " + prose(50)), (11, prose(20) + " " + edited + " " + prose(3000)), (12, gapped),
        (13, prose(500)), (14, None), (15, ""), (16, " ".join(words[:9]) + " " + prose(50)), (17, items[1][1] + " " + items[2][1]), (17, "nothing here"),
        (None, items[7][1]), (18, "so three little words come here"), (19, "two words"),
    ]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id bigint, text string, item_id int")
    benchmark = spark.createDataFrame([(*r, "x") for r in items], "item_id bigint, text string, doc_id string")
    found = decontaminate.leaks(docs, benchmark).collect()
    hits = sorted([(r.doc_id, r.item_id) for r in found], key=repr)
    assert hits == sorted([(10, 1), (11, 1), (12, 1), (17, 2), (17, 2), (None, 7), (18, 6)], key=repr)
    assert {r.score for r in found if r.doc_id == 10} == {1.0}
    clean = decontaminate.decontaminate(docs, benchmark)
    assert clean.columns == docs.columns and {r.doc_id for r in clean.collect()} == {13, 14, 15, 16, 19}
    assert decontaminate.decontaminate(docs, benchmark.limit(0)).count() == len(rows)
    assert decontaminate.leaks(docs.limit(0), benchmark).count() == 0


def test_alignment_matches_a_plain_table():
    for _ in range(30):
        a, b = [[RNG.choice("abcd") for _ in range(RNG.randint(1, 12))] for _ in range(2)]
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                table[i][j] = max(0, table[i - 1][j - 1] + (2 if a[i - 1] == b[j - 1] else -1), table[i - 1][j] - 1, table[i][j - 1] - 1)
        assert decontaminate.smith_waterman(a, b)[0] == max(map(max, table))


def test_raking_meets_all_targets(spark):
    rng = np.random.default_rng(5)
    cells = [(f"s{s}" if s else mix_sources.MISSING, g, t, int(rng.integers(0, 5000))) for s in range(6) for g in ("de", "en") for t in range(3)]
    table = spark.createDataFrame(cells, "source string, lang string, topic int, tokens bigint")
    targets = {"lang": {"de": 3, "en": 1}, "topic": {0: 1, 1: 1, 2: 2}}
    rated = mix_sources.rake(table, targets)
    out = mix_sources.probabilities(rated, 0.2).toPandas()
    weight = out.tokens * out.rate
    assert abs(weight.sum() - 1) < 1e-6
    natural = out.groupby("source").tokens.sum() ** 0.5
    for name, want in (("lang", {"de": 0.75, "en": 0.25}), ("topic", {0: 0.25, 1: 0.25, 2: 0.5}), ("source", dict(natural / natural.sum()))):
        got = weight.groupby(out[name]).sum()
        assert all(abs(got[k] - v) < 1e-4 for k, v in want.items()), name
    # The plain loop on a full array gives the same weights.
    full = out.pivot_table(index="source", columns=["lang", "topic"], values="tokens", fill_value=0).to_numpy(float).reshape(6, 2, 3)
    plain = full.copy()
    goals = [(natural / natural.sum()).to_numpy(), np.array([0.75, 0.25]), np.array([0.25, 0.25, 0.5])]
    for _ in range(400):
        for axis, goal in enumerate(goals):
            shape = [1, 1, 1]
            shape[axis] = -1
            plain *= (goal / plain.sum(axis=tuple(x for x in range(3) if x != axis))).reshape(shape)
    mine = (out.assign(w=weight).pivot_table(index="source", columns=["lang", "topic"], values="w", fill_value=0).to_numpy()).reshape(6, 2, 3)
    assert np.allclose(mine, plain, atol=1e-4)
    assert out.probability.max() <= 1 and abs((out.tokens * out.probability).sum() / out.tokens.sum() - 0.2) < 1e-6


def test_mixing_rows(spark):
    rows = [(i, prose(5 + i % 40), "en" if i % 3 else None, "big" if i % 2 else f"s{i % 5}") for i in range(400)]
    rows += [(1, rows[1][1], "en", "big"), (900, None, "en", "big"), (901, "", None, None), (None, prose(9), "de", "s1")]
    docs = spark.createDataFrame([(*r, "old") for r in rows], "doc_id bigint, text string, lang string, source string, topic string")
    every = mix_sources.mixed(docs, topics=3).collect()
    assert len(every) == len(rows) and all(0 <= r.probability <= 1 for r in every)
    assert {r.n_tokens for r in every if r.doc_id in (900, 901)} == {0}
    total = sum(r.n_tokens for r in every)
    assert abs(sum(r.n_tokens * r.probability for r in every) / total - mix_sources.FRACTION) < 1e-6
    kept = mix_sources.mix_sources(docs, topics=3)
    assert kept.columns == ["doc_id", "text", "lang", "source", "topic", "n_tokens", "probability"]
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted((r.doc_id for r in every if r.kept), key=repr)
    assert mix_sources.mix_sources(docs.limit(0)).count() == 0


CHATS = [
    ("messages", {"messages": [{"role": "system", "content": "s"}, {"role": "human", "content": "hi"}, {"role": "assistant", "content": None}]}, [("system", "s"), ("user", "hi"), ("assistant", "")]),
    ("conversations", {"id": 4, "conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": "b"}]}, [("user", "a"), ("assistant", "b")]),
    ("instruction", {"instruction": "do", "input": "this", "output": "done"}, [("user", "do\n\nthis"), ("assistant", "done")]),
    ("instruction", {"instruction": "do", "output": ""}, [("user", "do"), ("assistant", "")]),
    ("prompt_completion", {"prompt": "p", "completion": "c", "system": "x", "score": [1, 2]}, [("system", "x"), ("user", "p"), ("assistant", "c")]),
    ("nested_messages", {"data": {"messages": [{"role": "user", "content": "n"}]}}, [("user", "n")]),
    (None, {"unknown": 1}, [(None, None)]), (None, [1, 2], [(None, None)]),
]


def test_layouts_become_turns(spark):
    rows = [(i, json.dumps(c[1]), "x") for i, c in enumerate(CHATS)] + [(100, None, "x"), (101, "{bad", "x"), (102, json.dumps(CHATS[0][1]), "x"), (102, json.dumps(CHATS[0][1]), "x")]
    records = spark.createDataFrame(rows, "id bigint, record string, role string")
    turns = chat_format.canonical_turns(records, ["id"]).collect()
    for i, (layout, _, want) in enumerate(CHATS):
        mine = sorted((r for r in turns if r.id == i), key=lambda r: r.pos)
        assert [(r.role, r.text) for r in mine] == want and {r.layout for r in mine} == {layout}
    assert [r.layout for r in turns if r.id in (100, 101)] == [None, None] and sum(r.id == 102 for r in turns) == 6
    same = {r.fingerprint for r in turns if r.id in (0, 102)}
    assert len(same) == 1 and chat_format.canonical_turns(records.limit(0), ["id"]).count() == 0


def test_marks_are_reversible(spark):
    parts = ["#", "##", "###", "\\", "</turn>", "<\\/turn>", ": ", "### Assistant: ", "\n", "é", "x", "\\#", "\U0001f600"]
    texts = ["".join(RNG.choice(parts) for _ in range(RNG.randint(0, 9))) for _ in range(300)] + ["", None, "#" * 50, "<" * 3 + "/turn>" * 2]
    rows = [(i, t, RNG.choice(["assistant", "user", "", "a: b\\", "### x:", None]), 0) for i, t in enumerate(texts)]
    formatted = chat_format.formatted_turns(spark.createDataFrame(rows, "id bigint, text string, role string, piece int")).collect()
    assert len(formatted) == len(rows)
    for r in formatted:
        assert chat_format.parse_piece(r.piece) == (r.role or "", r.text or "")
        assert r.piece.count("</turn>") == 1 and r.piece.count("###") == 1
        assert (r.loss_start is not None) == (r.role == "assistant")
        if r.role == "assistant":
            assert chat_format.unescaped(r.piece[r.loss_start:r.loss_end]) == (r.text or "")


def test_long_conversations_stream(spark):
    rows = [(1, i, "assistant" if i % 2 else "user", f"turn {i} #### ") for i in range(5000)] + [(None, 0, "assistant", "x"), (2, None, "user", None)]
    turns = spark.createDataFrame([(*r, 0) for r in rows], "conv_id bigint, turn bigint, role string, text string, pos bigint")
    got = {r.conv_id: r for r in chat_format.digests(chat_format.formatted_turns(turns), "conv_id", ["turn", "pos"]).collect()}
    said = "".join(f"{r}\n{t}\n" for c, _, r, t in rows if c == 1)
    assert got[1].n_turns == 5000 and got[1].turns_sha256 == hashlib.sha256(said.encode()).hexdigest()
    assert got[None].loss_chars == 1 and got[2].loss_sha256 == hashlib.sha256(b"").hexdigest()


def test_records_no_reader_expects(spark):
    deep, free = "[" * 200_000, [json.dumps({f"key{k}": k}) for k in range(50)]
    nested = '{"prompt": ' + "[" * 900 + "]" * 900 + ', "completion": "x"}'
    cut = ['{"role": "user", "text": "\\ud83d"}', '{"role": "a\\udc00", "text": "\\ud83d\\ude00 \\ude00"}', '{"role": "user", "text": "x", "\\ud800": 1}']
    given = [None, "", "{", deep, '{"a":' * 100_000, nested, "1" * 10_000, "NaN", *cut, *free]
    records = spark.createDataFrame(list(enumerate(given)), "conv_id bigint, record string")
    chat_format.KNOWN, before = 20, chat_format.KNOWN
    try:
        rows = chat_format.canonical_turns(records, ["conv_id"]).collect()
    finally:
        chat_format.KNOWN = before
    got = {r.conv_id: (r.layout, r.role, r.text) for r in rows}
    assert len(rows) == len(given) and all(got[i] == (None, None, None) for i in (*range(5), 6, 7, *range(11, len(given))))
    assert [got[i] for i in (8, 9, 10)] == [("turn", "user", "\ufffd"), ("turn", "a\ufffd", "\U0001f600 \ufffd"), ("turn", "user", "x")]
    assert got[5][0] in (None, "prompt_completion")


def test_pipeline_stages(spark, tmp_path):
    shared = "this line of many words stands in all of the documents that are here"
    base = [f"{prose(40)} the of and to in\n{shared}\n{prose(30)} the of and" for _ in range(30)]
    item = prose(25)
    rows = [(i, t, "en", f"s{i % 3}") for i, t in enumerate(base)]
    rows += [(100, base[3], "en", "s0"), (101, base[4].replace(" ", "  "), "en", "s1"), (102, f"{prose(30)} the of and {item} the of", "en", "s1"), (103, "too short", "en", "s1"), (104, None, None, None), (105, "# $ % & " * 50, "en", "s2"), (106, "", "en", "s2"), (3, base[3], "en", "s0")]
    columns = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], columns).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, str(tmp_path)), name)
        kept.append({r.doc_id for r in docs.collect()})
        if name != "source_mixing":
            assert docs.columns == [c.split()[0] for c in columns.split(", ")]
    whole = set(range(30))
    assert kept[0] == whole | {100, 101, 102} and kept[1] == kept[0]
    assert kept[2] & (whole | {102}) == whole | {102} and len(kept[2]) <= 33
    assert kept[3] == kept[2] - {102} and kept[4] <= kept[3] and kept[4]
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == kept[4]
    empty = spark.read.parquet(f"{tmp_path}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0


def test_every_operator_has_its_query():
    names = queries.registered()
    assert {int(n[2:].split("_")[0]) for n in names if n.startswith("op")} == set(range(1, 14)) and "pipeline" in names
    assert set(queries.statements()) <= set(names)


@pytest.mark.parametrize("name", sorted(queries.statements()))
def test_queries_match_their_statements(spark, name):
    import duckdb

    database = duckdb.connect()
    for t in ("documents", "pages", "conversations", "embeddings"):
        database.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    df = queries.registered()[name](spark, "/root/testdata/sf0.001")
    cursor = database.execute(queries.statements()[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    plain = lambda row: tuple(round(x, 9) if isinstance(x, float) else x for x in row)
    assert sorted((plain(r[c] for c in columns) for r in df.collect()), key=repr) == sorted(map(plain, cursor.fetchall()), key=repr)


def test_held_out_languages(spark):
    found = queries.registered()["op3_language_id"](spark, "/root/testdata/sf0.01").filter("held_out")
    given = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    right = found.join(given, "doc_id").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0]
    assert right > 0.97


def test_pipeline_keeps_one_of_each_linked_group(spark):
    rows, edits = [], (0, 1, 2, 5, 20)
    for i in range(50):
        words = [f"{i}x{RNG.randint(0, 10**6)}" for _ in range((100, 300, 1000)[i % 3])]
        edited = list(words)
        for at in RNG.sample(range(len(words)), edits[i % 5]):
            edited[at] = "changed"
        rows += [(i, " ".join(words)), (1000 + i, " ".join(edited))]
    rows += [(3000, None), (3001, " "), (3002, ""), (3003, "one"), (3004, "ONE"), (None, "two"), (None, "two")]
    prints = [plain_fingerprint(t) for _, t in rows]
    edges = [(a, b) for a in range(len(rows)) for b in range(a) if bin(prints[a] ^ prints[b]).count("1") <= 3]
    roots = plain_components(len(rows), edges)
    # Of equal ids the first row stands for all; here only rows without an id share one.
    want = sorted(min((rows[k][0] for k in range(len(rows)) if roots[k] == r and rows[k][0] is not None), default=-1) for r in set(roots))
    assert 50 < len(want) < 90
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id bigint, text string, fp string")
    left = corpus_pipeline.drop_near_copies(spark, docs, "")
    assert left.columns == docs.columns and sorted(-1 if r.doc_id is None else r.doc_id for r in left.collect()) == want


def test_parts_of_long_items_are_leaks(spark):
    long, longer = [f"a{k}" for k in range(200)], [f"b{k}" for k in range(1000)]
    edited = [w if k % 10 else "changed" for k, w in enumerate(longer[400:460])]
    chinese = "水的沸点在标准大气压下是一百摄氏度"
    rows = [(1, prose(100) + " " + " ".join(long[100:]) + " " + prose(100)), (2, " ".join(long[:20]) + " " + prose(80)), (3, " ".join(longer[613:643])),
            (4, prose(50) + " " + " ".join(edited)), (5, f"前文。{chinese}。后文"), (6, "水是一种液体"), (7, prose(300))]
    # What others copy must not keep a document's own part from being found.
    rows += [(100 + k, " ".join(longer[:600])) for k in range(3)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    benchmark = spark.createDataFrame([(1, " ".join(long)), (2, " ".join(longer)), (3, chinese + "。")], "item_id bigint, text string")
    found = {(r.doc_id, r.item_id): r.score for r in decontaminate.leaks(docs, benchmark).collect()}
    assert found.keys() == {(1, 1), (3, 2), (4, 2), (5, 3), (100, 2), (101, 2), (102, 2)}
    assert found[(1, 1)] == 0.5 and found[(5, 3)] == 1.0


def test_raw_and_escaped_urls_are_one_key(spark):
    # Raw, "a b" sorts before "a!b"; stored as a%20b it comes after.
    urls = ["http://x/a b", "http://x/a%20b", "http://x/a!b", "http://x/a\x7fb", "http://x/a%7Fb", "http://x/a#", "http://x/a$b", "http://[x/a b", "http://[x/a%20b"]
    rows = [(i, url, f"<p>{i}") for i, url in enumerate(urls)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    root = warc.shared_folder(spark, "warc")
    for block_lines in (1, 2, 100):
        index = warc.build_index(warc.write_archives(warc.with_revisits(pages), root), root, block_lines=block_lines)
        got = warc.read_records(warc.lookup(index, warc.url_keys(pages)), root).collect()
        assert sorted(r.page_id for r in got) == list(range(len(urls)))
        raw = spark.createDataFrame([("x)/a b",), ("x)/a%20b",), ("x)/a!b",)], "key string")
        assert sorted(r.page_id for r in warc.lookup(index, raw).collect()) == [0, 1, 2]
