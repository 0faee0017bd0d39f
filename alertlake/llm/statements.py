"""DuckDB counterparts of the queries that SQL can express."""

from __future__ import annotations

from alertlake.llm.license_texts import TEMPLATES

STOP_WORDS = (
    "the of and to in a is that for it on with as was be by this are "
    "der die und den von zu das mit sich des auf für ist im dem nicht ein "
    "de la le et les un une est que dans qui du par pour sur pas au "
    "el en y los se del las por con para una su al lo como"
)

QUALITY_RULES = rf"""
WITH split AS (
  SELECT doc_id, coalesce(text, '') AS t,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls
  FROM documents
), grams AS (
  SELECT doc_id, i, array_to_string(ws[i:i + 7], ' ') AS g FROM split, unnest(range(1, len(ws) - 6)) AS u(i)
), twice AS (
  SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS n FROM grams) WHERE n > 1
), covered AS (
  SELECT doc_id, sum(k) AS n_repeat FROM (
    SELECT doc_id, least(8, i - lag(i, 1, -8) OVER (PARTITION BY doc_id ORDER BY i)) AS k FROM twice
  ) GROUP BY doc_id
), counts AS (
  SELECT doc_id, t, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
    (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
    coalesce(n_repeat, 0)::BIGINT AS n_repeat_words, len(ls) AS n_lines,
    len(list_filter(ws, lambda w: lower(w) IN ('{"','".join(STOP_WORDS.split())}'))) AS n_stop,
    length(regexp_replace(t, '[^\p{{Lu}}]+', '', 'g')) AS n_upper,
    length(regexp_replace(t, '[^\p{{L}}]+', '', 'g')) AS n_letters
  FROM split LEFT JOIN covered USING (doc_id)
), judged AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, concat_ws(',',
    CASE WHEN n_words = 0 OR word_chars < 1.5 * n_words OR word_chars > 40.0 * n_words THEN 'word_length' END,
    CASE WHEN n_symbols > 0 AND n_symbols / n_words > 0.2 THEN 'symbols' END,
    CASE WHEN n_letters > 0 AND n_upper / n_letters > 0.6 THEN 'capitals' END,
    CASE WHEN n_words = 0 OR n_stop / n_words < 0.01 THEN 'stop_words' END,
    CASE WHEN n_lines > 0 AND n_dup_lines / n_lines > 0.5 THEN 'duplicate_lines' END) AS failed_rules
  FROM counts
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND failed_rules = '' AS kept, failed_rules
FROM judged
"""

LINE_DEDUP = """
WITH lines AS (
  SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)
), keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
), owners AS (
  SELECT key, min(doc_id) AS owner FROM keyed WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (doc_id > owner) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (owner IS NULL OR doc_id = owner), '')) AS kept_sha256
FROM keyed LEFT JOIN owners USING (key)
GROUP BY doc_id
"""

_TEMPLATE_ROWS = ", ".join("('{}', '{}')".format(name, text.replace("'", "''")) for name, text in TEMPLATES)
_PLAIN = r"regexp_replace(lower({}), '[^\p{{L}}\p{{N}}\n.!?;]+', ' ', 'g')"
_WORDS = "list_filter(string_split(translate({}, chr(10) || '.!?;', '     '), ' '), lambda w: w <> '')"

LICENSE_SCAN = rf"""
WITH plain AS (SELECT doc_id, {_PLAIN.format("text")} AS t FROM documents WHERE text IS NOT NULL),
pieces AS (
  SELECT doc_id, t AS piece FROM plain
  UNION SELECT doc_id, unnest(regexp_split_to_array(t, '\n *\n')) FROM plain
  UNION SELECT doc_id, unnest(string_split(t, chr(10))) FROM plain
  UNION SELECT doc_id, unnest(string_split(regexp_replace(t, '([.!?;]) +', '\1' || chr(10), 'g'), chr(10))) FROM plain
), passages AS (
  SELECT DISTINCT doc_id, array_to_string({_WORDS.format("piece")}, ' ') AS passage FROM pieces
), worded AS (
  SELECT doc_id, passage, string_split(passage, ' ') AS w FROM passages
), t_words AS (
  SELECT row_number() OVER () AS tid, licence, {_WORDS.format(_PLAIN.format("txt"))} AS w FROM (VALUES {_TEMPLATE_ROWS}) AS v(licence, txt)
), t_grams AS (
  SELECT DISTINCT tid, w[i] || ' ' || w[i + 1] AS g FROM t_words, unnest(range(1, len(w))) AS u(i)
), met AS (
  SELECT doc_id, passage, d.w AS w, tid, licence FROM worded AS d JOIN t_words AS t
  ON len(d.w) BETWEEN ceil(len(t.w) * 0.8 / 1.2) AND floor(len(t.w) * 1.2 / 0.8)
), grams AS (
  SELECT DISTINCT doc_id, passage, tid, licence, w[i] || ' ' || w[i + 1] AS g FROM met, unnest(range(1, len(w))) AS u(i)
), sizes AS (SELECT tid, count(*) AS n FROM t_grams GROUP BY tid),
scored AS (
  SELECT doc_id, passage, licence, 2 * count(t.g) / (count(*) + any_value(n)) AS dice
  FROM grams AS g JOIN sizes USING (tid) LEFT JOIN t_grams AS t ON t.tid = g.tid AND t.g = g.g
  GROUP BY doc_id, passage, g.tid, licence
), best AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id, passage ORDER BY dice DESC, licence) AS place FROM scored WHERE dice >= 0.8
)
SELECT doc_id, licence, max(dice) AS dice, count(*) AS n_passages FROM best WHERE place = 1 GROUP BY doc_id, licence
"""

_ESCAPED_CHARS = (
    "length({0}) + length(regexp_replace({0}, '[^\\\\]+', '', 'g')) + len(regexp_extract_all({0}, '</turn>'))"
    " + coalesce(list_sum(list_transform(regexp_extract_all({0}, '#{{3,}}'), lambda r: length(r) - 2)), 0)"
)
_SAID = r"\### Assistant: </turn> ok"

CHAT_FORMAT = f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{_SAID}' UNION ALL SELECT -7, 1, 'assistant', '{_SAID}'
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(14 + {_ESCAPED_CHARS.format("role")} + length(regexp_replace(role, '[^:]+', '', 'g')) + {_ESCAPED_CHARS.format("text")})::BIGINT
    AS formatted_chars
FROM turns GROUP BY conv_id
"""

WARC = """
WITH payloads AS (
  SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), latest AS (
  SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS last FROM payloads
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id < last THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id < last THEN last END AS refers_to
FROM latest
"""

_CRC = (
    "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),"
    " lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)),"
    " lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295::BIGINT)"
)

# Three words that match a period apart are one pair; pairs at successive places are one stretch.
PERIODIC_RUNS = rf"""
WITH given AS (
  SELECT row_number() OVER () AS rid, doc_id, {_CRC} AS h, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), cut AS (
  SELECT *, len(w) AS n, CASE WHEN len(w) > 0 THEN (h // 10) % len(w) ELSE 0 END AS a FROM given
), texts AS (
  SELECT rid, doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i:
    CASE WHEN i < a THEN w[i + 1] ELSE w[a + (i - a) % (1 + (n - a) // (3 + (h // 10) % 8)) + 1] END) ELSE w END AS w
  FROM cut
), threes AS (
  SELECT rid, n, i, w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] AS g FROM texts, unnest(range(n - 2)) AS u(i)
), pairs AS (
  SELECT x.rid, x.i, y.i - x.i AS q FROM threes AS x JOIN threes AS y ON x.rid = y.rid AND x.g = y.g AND y.i > x.i AND 4 * (y.i - x.i) <= x.n
), stretches AS (
  SELECT rid, q, min(i) AS start, max(i) + 3 + q - min(i) AS length
  FROM (SELECT *, i - row_number() OVER (PARTITION BY rid, q ORDER BY i) AS k FROM pairs) GROUP BY rid, q, k
), runs AS (
  SELECT rid, start, length, min(q) AS period FROM stretches WHERE length >= greatest(6, 4 * q) GROUP BY rid, start, length
), best AS (
  SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY rid ORDER BY length / period DESC, start, period) = 1
), listed AS (
  SELECT rid, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS t FROM runs GROUP BY rid
), gone AS (
  SELECT DISTINCT rid, i FROM runs, unnest(range(start + period, start + length)) AS u(i)
), dropped AS (SELECT rid, list(i) AS g FROM gone GROUP BY rid)
SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, start::BIGINT AS start, length::BIGINT AS length, period::BIGINT AS period,
  (1000 * length // period)::BIGINT AS exponent_milli, sha256(coalesce(t, '')) AS runs_sha256,
  sha256(array_to_string(CASE WHEN g IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(g, i - 1)) END, ' ')) AS collapsed_sha256
FROM texts LEFT JOIN best USING (rid) LEFT JOIN listed USING (rid) LEFT JOIN dropped USING (rid)
"""


def _centroid_clusters(clusters: int = 40, rounds: int = 5) -> str:
    """One nearest-centroid step and one step of means per round, spelled out."""
    nearest = """near{0} AS MATERIALIZED (
  SELECT v.rid, v.vec_id, v.v, c.k, list_sum(list_transform(list_zip(v.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d
  FROM kept AS v, centres{0} AS c QUALIFY row_number() OVER (PARTITION BY v.rid ORDER BY d, c.k) = 1
)"""
    means = """parts{0} AS (
  SELECT k, i, sum(v[i])::HUGEINT AS s, count(*)::HUGEINT AS n FROM near{0}, unnest(range(1, 65)) AS u(i) GROUP BY k, i
), means{0} AS (
  SELECT k, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS v FROM parts{0} GROUP BY k
), centres{1} AS MATERIALIZED (SELECT c.k, coalesce(m.v, c.v) AS v FROM centres{0} AS c LEFT JOIN means{0} AS m USING (k))"""
    steps = [f"{nearest.format(r)}, {means.format(r, r + 1)}" for r in range(rounds)]
    return f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE len(embedding) = 64 AND list_aggregate(list_transform(embedding, lambda x: (x IS NOT NULL AND isfinite(x))::INT), 'min') = 1
), centres0 AS MATERIALIZED (
  SELECT (row_number() OVER (ORDER BY sha256('2:' || vec_id), v) - 1)::INT AS k, v FROM kept ORDER BY sha256('2:' || vec_id), v LIMIT {clusters}
), {", ".join(steps)}, {nearest.format(rounds)}
SELECT vec_id, near{rounds}.k AS cluster, d AS distance, (sum(d) OVER (PARTITION BY near{rounds}.k))::BIGINT AS cluster_inertia,
  (sum(d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM near{rounds} JOIN centres{rounds} AS c ON near{rounds}.k = c.k
"""


STATEMENTS = {
    "op1_quality_rules": QUALITY_RULES,
    "op4_line_dedup": LINE_DEDUP,
    "op6_warc": WARC,
    "op9_license_scan": LICENSE_SCAN,
    "op10_chat_format": CHAT_FORMAT,
    "op11_periodic_runs": PERIODIC_RUNS,
    "op12_centroid_clusters": _centroid_clusters(),
}
