"""DuckDB statement per registered query."""

from __future__ import annotations

from oracle import fixed
from alertlake.plans.catalog import CLASS_COLUMNS, CONTEXT_GROUPS, CONTEXT_TEXTS, FILTERS, LINE_LIMIT
from oracle.base import band, iso, query, severity

ALERT = ", ".join(fixed.ALERT_COLUMNS)
INCIDENT = ", ".join(fixed.INCIDENT_COLUMNS)
KEY = "manager_name, agent_id, affected_asset, source_ip, event_category, identity"

# Character classes spelled out, because RE2 only knows the ASCII ones.
SPACE = r"[\s\x1c-\x1f\x{85}\pZ]"
EDGE = r"(?:^|[^\pL\pM\pN_])"
TRIM = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
HIDDEN = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f\x{061c}\x{200e}\x{200f}\x{202a}-\x{202e}\x{2066}-\x{2069}]"
V4 = r"^((25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])\.){3}(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])$"


def clean(x: str) -> str:
    shown = f"replace(replace(replace({x}, chr(13), '\\r'), chr(10), '\\n'), chr(9), '\\t')"
    return f"regexp_replace(regexp_replace({shown}, '{HIDDEN}', ' ', 'g'), '^{TRIM}|{TRIM}$', '', 'g')"


def clean_or(x: str, default: str = "-") -> str:
    return f"coalesce(nullif({clean(x)}, ''), '{default}')"


def address(x: str) -> str:
    """IPv4 text from a candidate; the data holds no IPv6 addresses."""
    host = rf"regexp_extract({x}, '^([0-9.]+)(:[0-9]+)?$', 1)"
    return f"CASE WHEN regexp_matches({host}, '{V4}') THEN {host} END"


EV = """SELECT event_id AS e, user_id AS u, value, event_type, date_trunc('milliseconds', ts) AS moment,
  epoch_us(date_trunc('milliseconds', ts)) AS event_us FROM events"""


def over_events(columns: str) -> str:
    return query(f"SELECT e, {columns} FROM source_events", source_events=EV)


def choose(selector: str, *values: str) -> str:
    arms = " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values))
    return f"CASE {selector} {arms} END"


JSON_LINE = """
  SELECT record_number, e, '{"timestamp":"' || stamp || '","id":"' || raw_id || '","rule":{"id":"' || rule_id
    || '","level":' || level || ',"description":"rule ' || rule_id || '","groups":'
    || CASE rule_id WHEN '5715' THEN '["sshd","authentication_success"]' WHEN '5402' THEN '["sudo"]'
         WHEN '503' THEN '["agent_health"]' WHEN '504' THEN '["agent_health"]' WHEN '100030' THEN '["firewall","port_scan"]'
         WHEN '31101' THEN '["web","accesslog"]' ELSE '["sshd","authentication_failed"]' END
    || ',"firedtimes":' || e % 4
    || CASE rule_id WHEN '5712' THEN ',"mitre":{"id":["T1110"]}'
         WHEN '5760' THEN ',"mitre":{"id":["T1110.001","T1021.004"]}' WHEN '5710' THEN ',"mitre":{"id":["T1110.001","T1021.004"]}'
         WHEN '5715' THEN ',"mitre":{"id":["T1078"],"tactic":["Initial Access","Persistence"]}'
         WHEN '5402' THEN ',"mitre":{"id":["T1548.003"]}'
         WHEN '31101' THEN ',"mitre":{"id":["T9999"],"technique":["Unlisted"]}' ELSE '' END
    || '},"agent":{"id":"' || lpad(CAST(u % 10 AS VARCHAR), 3, '0') || '"'
    || CASE WHEN u % 10 = 9 THEN '' ELSE ',"name":"host-' || u % 10 || '"' END
    || CASE WHEN u % 10 = 8 THEN '' ELSE ',"ip":"10.1.0.' || u % 10 || '"' END
    || '},"manager":{"name":"mgr-' || u % 3 || '"},"data":{' || concat_ws(',',
         '"srcip":"' || raw_src || '"', '"net":{"srcip":"' || nested_src || '"}', '"dstuser":"' || raw_target || '"',
         CASE WHEN rule_id = '5402' THEN '"srcuser":"user' || u || '"' END,
         CASE WHEN rule_id = '5402' THEN '"command":"/usr/bin/id -u ' || k || '"' END)
    || '},"decoder":{"name":"' || CASE WHEN ssh THEN 'sshd' ELSE 'json' END || '"},"location":"events","full_log":"' || log || '"}' AS line
  FROM raw"""
DAMAGED = """
  SELECT record_number, e, CASE e % 50 WHEN 1 THEN '{not-json' WHEN 2 THEN '["x"]' WHEN 3 THEN ''
    WHEN 4 THEN line || repeat(' ', 2000) ELSE line END AS value,
    CASE e % 50 WHEN 1 THEN 'malformed' WHEN 2 THEN 'non_object' WHEN 3 THEN 'blank' WHEN 4 THEN 'oversized' ELSE 'ok' END AS line_status
  FROM json_line"""
SINCE, UNTIL = FILTERS.bounds()
REASON = f"""CASE WHEN rule_level < {FILTERS.min_level} THEN 'level'
  WHEN event_us IS NULL OR event_us < {SINCE} OR event_us > {UNTIL} THEN 'time'
  WHEN event_category NOT IN ({", ".join(f"'{c}'" for c in fixed.SCOPE_CATEGORIES)}) THEN 'scope' END"""
KEPT = f"""
  SELECT n.*, d.line_status, {REASON} AS drop_reason FROM norm n JOIN damaged d ON n.record_number = d.record_number
  WHERE d.line_status = 'ok'"""
KEPT_COPIES = """
  SELECT count(*) AS copies, any_value(classification_confidence) AS confidence,
    arg_max(source_ip, (rule_level, risk_score, CAST(source_ip <> '-' AS INT) + CAST(target_user <> '-' AS INT), -record_number)) AS source_ip
  FROM kept WHERE drop_reason IS NULL
  GROUP BY manager_name, agent_id, event_id, CASE WHEN event_id = '-' THEN record_number ELSE 0 END"""
STATS = """
  SELECT count(*) AS total_lines, CAST(sum(strlen(value) + 1) AS BIGINT) AS input_bytes, false AS line_limit_reached,
    count(*) FILTER (line_status = 'ok') AS parsed_records, count(*) FILTER (line_status = 'blank') AS blank_lines,
    count(*) FILTER (line_status = 'malformed') AS malformed_json, count(*) FILTER (line_status = 'non_object') AS non_object_records,
    count(*) FILTER (line_status = 'oversized') AS oversized_lines, 0 AS encoding_errors,
    (SELECT count(*) FROM kept WHERE event_us IS NULL) AS invalid_timestamps,
    (SELECT count(*) FROM kept WHERE drop_reason = 'level') AS filtered_by_level,
    (SELECT count(*) FROM kept WHERE drop_reason = 'time') AS filtered_by_time,
    (SELECT count(*) FROM kept WHERE drop_reason = 'scope') AS filtered_by_scope,
    (SELECT count(*) FROM kept_copies) AS included_alerts,
    (SELECT CAST(sum(copies) - count(*) AS BIGINT) FROM kept_copies) AS duplicate_records,
    count(*) FILTER (line_status IN ('malformed', 'non_object', 'oversized')) AS rejected_records
  FROM damaged"""
SAMPLES = """
  SELECT line_status, string_agg(record_number, ',' ORDER BY record_number) AS samples
  FROM (SELECT *, row_number() OVER (PARTITION BY line_status ORDER BY record_number) AS place FROM damaged
        WHERE line_status IN ('malformed', 'non_object', 'oversized'))
  WHERE place <= 10 GROUP BY line_status"""
FULL_STATS = """
  SELECT *, round(parsed_records * 100.0 / (parsed_records + rejected_records), 2) AS parse_success_rate,
    coalesce((SELECT samples FROM samples WHERE line_status = 'malformed'), '') AS malformed_line_samples,
    coalesce((SELECT samples FROM samples WHERE line_status = 'oversized'), '') AS oversized_line_samples,
    '' AS encoding_error_samples
  FROM stats"""


def ingest(select: str) -> str:
    return query(
        select, json_line=JSON_LINE, damaged=DAMAGED, kept=KEPT, kept_copies=KEPT_COPIES, stats=STATS,
        samples=SAMPLES, full_stats=FULL_STATS,
    )


def _quality_table() -> str:
    sample = "样例行号："

    def listed(name: str) -> str:
        return f"CASE WHEN {name} = '' THEN '-' ELSE '[' || replace({name}, ',', ', ') || ']' END"

    rows = [
        ("读取物理行", "total_lines", "'输入文件实际读取行数'"), ("读取字节", "input_bytes", "'压缩文件按解压后字节统计'"),
        ("达到行数上限", "'否'", "'为“是”时报告仅覆盖输入前缀'"),
        ("有效 JSON 对象", "parsed_records", "'解析成功率 ' || printf('%.2f', parse_success_rate) || '%'"),
        ("损坏 JSON", "malformed_json", f"'{sample}' || {listed('malformed_line_samples')}"),
        ("非对象 JSON", "non_object_records", "'数组或标量不会作为告警处理'"),
        ("超长输入行", "oversized_lines", f"'超过 max_line_bytes；{sample}' || {listed('oversized_line_samples')}"),
        ("编码错误", "encoding_errors", f"'非 UTF-8 输入已拒绝；{sample}-'"),
        ("重复事件 ID", "duplicate_records", "'重复记录已排除'"), ("无效时间戳", "invalid_timestamps", "'使用时间筛选时会被排除'"),
        ("等级过滤", "filtered_by_level", "'低于 min_level'"), ("时间过滤", "filtered_by_time", "'不在 since/until 范围'"),
        ("场景过滤", "filtered_by_scope", "'scope_only 排除'"), ("最终纳入", "included_alerts", "'用于本报告'"),
        ("来源未知", "(SELECT count(*) FROM kept_copies WHERE source_ip = '-')", "'不会回退为 Agent/资产 IP'"),
        ("低置信度分类", "0", "'建议补充精确规则映射'"),
    ]
    return " UNION ALL ".join(
        f"SELECT {i} AS row, '{m}' AS metric, CAST({v} AS VARCHAR) AS value, {n} AS note FROM full_stats"
        for i, (m, v, n) in enumerate(rows, 1)
    )


# Networks as ranges of numbers, every address compared with all of them.
SCOPE_BY_NETWORKS = f"""WITH ev AS ({EV}),
  given AS (SELECT DISTINCT u % 5 AS rank, 'site ' || u % 9 AS label, [24, 16, 32, 22][u % 4 + 1] AS bits,
      10 * 16777216 + (u % 20) * 65536 + [(u % 7) * 256 + 77, 0, (u % 7) * 256 + u % 250, 1024][u % 4 + 1] AS host FROM ev),
  nets AS (SELECT *, (host >> (32 - bits)) << (32 - bits) AS low, 1 << (32 - bits) AS width FROM given),
  asked AS (SELECT e, CASE WHEN e % 10 <> 8 THEN 10 * 16777216 + (e % 25) * 65536 + (e % 7) * 256 + e % 250 END AS n,
      (e % 25) || '.' || (e % 7) || '.' || (e % 250) AS parts FROM ev)
SELECT e, CASE e % 10 WHEN 8 THEN '-' WHEN 9 THEN '::ffff:10.' || parts ELSE '10.' || parts END AS address,
  CASE WHEN n IS NULL THEN 'Unknown' ELSE coalesce(hit, 'Public/External') END AS scope
FROM asked LEFT JOIN (SELECT e, arg_min(label, struct_pack(rank, shorter := -bits, label)) AS hit
  FROM asked JOIN nets ON n >= low AND n < low + width GROUP BY e) USING (e)"""


def _functions() -> dict[str, str]:
    u = "CAST(u AS VARCHAR)"
    host = "(u % 250)"
    words = f"""SELECT doc_id, word, min(place) AS place FROM (
        SELECT doc_id, {clean('w[i]')} AS word, i AS place FROM (
          SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM (SELECT doc_id, string_split(text, ' ') AS w FROM documents)))
      WHERE word NOT IN ('', '-') GROUP BY doc_id, word"""
    cell = f"""CASE WHEN doc_id % 7 = 0 THEN '-' ELSE {choose('doc_id % 6', "''", "'='", "' +'", "chr(65279) || '-'", "chr(8203) || '@'", "'x'")} || text END"""
    groups = [f"'{g}'" for g in CONTEXT_GROUPS]
    texts = [f"'{t}'" for t in CONTEXT_TEXTS]
    rules = sorted(fixed.RULES)
    exact = ", ".join(f"({i}, '{r}', '{fixed.RULES[r][0]}', '{fixed.RULES[r][1]}', '{fixed.RULES[r][2]}')" for i, r in enumerate(rules))

    def stamped(shape: str, suffix: str = "") -> str:
        return f"strptime(strftime(moment, '{shape}'), '{shape}')"

    ips = [
        f"'8.8.8.' || {host}", f"'10.0.0.' || {host}", f"'192.168.1.' || {host}", f"'127.0.0.' || {host}",
        f"'169.254.0.' || {host}", f"'224.0.0.' || {host}", f"'172.16.0.' || {host}", f"'203.0.113.' || {host}",
        "'-'", "'-'", "'-'", "'-'",
    ]

    def ip_at(shift: int) -> str:
        return choose(f"(e + {shift}) % 12", *ips)

    def first_of(*shifts: int) -> str:
        return "coalesce(" + ", ".join(f"nullif({ip_at(s)}, '-')" for s in shifts) + ", '-')"

    log_ips = ", ".join(
        address(f"regexp_extract(text, '{p}', 1)") for p in (
            rf"(?i){EDGE}from{SPACE}+([0-9a-f:.]+)", rf"(?i){EDGE}rhost=([0-9a-f:.]+)",
            rf"(?i){EDGE}(?:src|source|client(?:ip)?){SPACE}*[=:]{SPACE}*([0-9a-f:.]+)",
        )
    )
    name = r"([^\s\x1c-\x1f\x{85}\pZ:;]+)"
    log_users = ", ".join(
        f"nullif(regexp_extract(text, '{p}', 1), '')" for p in (
            rf"(?i){EDGE}for{SPACE}+(?:invalid user{SPACE}+)?{name}{SPACE}+from(?:$|[^\pL\pM\pN_])",
            rf"(?i){EDGE}user(?:name)?[=:]{SPACE}*{name}",
        )
    )
    in_groups = lambda *names: "(" + " OR ".join(f"list_contains(g, '{n}')" for n in names) + ")"
    ssh, web = in_groups("sshd", "ssh"), in_groups("web", "accesslog", "web_log")
    scanners = " OR ".join(f"contains(x, '{t}')" for t in fixed.SCANNER_TERMS)
    context = [
        (f"{in_groups('ssh_bruteforce')} OR ({ssh} AND contains(x, 'brute force'))", "SSH Brute Force", "Credential Attack", "'failure'", "rule_group_or_context"),
        (f"{in_groups('ssh_invalid_user')} OR ({ssh} AND contains(x, 'invalid user'))", "SSH Invalid Username", "Credential Attack", "'failure'", "rule_group_or_context"),
        (f"{in_groups('ssh_user_enum')} OR ({ssh} AND contains(x, 'username enumeration'))", "SSH Username Enumeration", "Credential Attack", "'failure'", "rule_group_or_context"),
        (f"{in_groups('authentication_failed')} OR ({in_groups('sshd', 'ssh', 'pam')} AND contains(x, 'authentication failure'))", "Authentication Failure", "Credential Attack", "'failure'", "authentication_failed_group"),
        (in_groups("authentication_success"), "Authentication Success", "Authentication Success", "'success'", "authentication_success_group"),
        (in_groups("sudo"), "Privilege Escalation / Sudo Activity", "Privilege Activity", "CASE WHEN contains(x, 'fail') OR contains(x, 'denied') THEN 'failure' ELSE 'success' END", "sudo_group"),
        (in_groups("syscheck", "fim"), "File Integrity Change", "File Integrity", "'change'", "fim_group"),
        ("contains(array_to_string(g, ','), 'vulnerab')", "Vulnerability Detection", "Vulnerability", "'failure'", "vulnerability_group"),
        (in_groups("rootcheck", "malware", "virus", "trojan"), "Malware / Rootkit Detection", "Malware", "'failure'", "malware_group"),
        (in_groups("port_scan", "network_scan"), "Port Scan", "Reconnaissance", "'failure'", "network_scan_group"),
        (f"{in_groups('web_scan')} OR ({web} AND ({scanners}))", "Web Scanner Activity", "Reconnaissance", "'failure'", "web_scanner_context"),
        (f"{in_groups('web_dir_bruteforce')} OR ({web} AND contains(' ' || x || ' ', ' 404 '))", "Web Directory Brute Force", "Reconnaissance", "'failure'", "web_404_context"),
        (web, "Web Access Event", "Web Activity", "'unknown'", "web_group"),
        (in_groups("pam"), "PAM Activity", "Session Activity", "'unknown'", "pam_group"),
        ("true", "Other Security Event", "Other Security Event", "'unknown'", "fallback"),
    ]

    def ladder(i: int, quoted: bool = True) -> str:
        arms = " ".join(f"WHEN {t[0]} THEN " + (f"'{t[i]}'" if quoted else t[i]) for t in context)
        return f"CASE {arms} END"

    seconds = "greatest(CAST(floor(value * 37) AS BIGINT) - 50, 0)"
    return {
        "fn_clean_text": f"SELECT doc_id, length({clean_or('text')}) AS n, md5({clean_or('text')}) AS cleaned_md5 FROM documents",
        "fn_unique": query(
            "SELECT d.doc_id, count(w.word) AS n, md5(coalesce(string_agg(w.word, ' ' ORDER BY w.place), '')) AS words_md5 "
            "FROM documents d LEFT JOIN words w ON w.doc_id = d.doc_id GROUP BY d.doc_id", words=words),
        "csv_safe": rf"""SELECT doc_id, md5(CASE WHEN regexp_matches(cell, '^[ \t\r\n\x0b\x0c\x{{feff}}\x{{200b}}\x{{2060}}]*[=+@-]')
            AND cell <> '-' THEN '''' || cell ELSE cell END) AS cell_md5 FROM (SELECT doc_id, {cell} AS cell FROM documents)""",
        "fn_log_source_ip": f"SELECT doc_id, coalesce({log_ips}, '-') AS source_ip FROM documents",
        "fn_log_username": f"SELECT doc_id, coalesce({log_users}, '-') AS username FROM documents",
        "fn_normalize_list": over_events(choose(
            "e % 6", f"'b' || u || '|a|c'", "'  s' || u", "''", "''", u, "'1|True|\"q\"'") + " AS items"),
        "fn_coerce_int": over_events(choose(
            "e % 9", "u", "u", "-u", "42", "5", "42", "42", "1", "10") + " AS n"),
        "fn_level_clamp": over_events("least(greatest(CAST(floor(value) AS INT) - 5, 0), 16) AS level"),
        "fn_parse_timestamp": over_events(
            choose("e % 11", "event_us - 28800000000", "event_us", "event_us // 1000000 * 1000000",
                   "event_us // 86400000000 * 86400000000", "event_us // 1000000 * 1000000 + 19800000000",
                   "event_us // 60000000 * 60000000 - 3600000000", "NULL", "NULL", "NULL", "NULL",
                   "epoch_us(TIMESTAMP '2024-01-31 10:00:00')") + " AS event_us, "
            + choose("e % 11", "28800", "0", "0", "0", "-19800", "3600", "NULL", "NULL", "NULL", "NULL", "0") + " AS offset_s"),
        "fn_display_tz": over_events(
            ", ".join(
                f"{iso('event_us', str(off), '%Y-%m-%dT%H:%M:%S.%g')} AS {n}"
                for n, off in (("timestamp", 28800), ("shanghai", 28800), ("new_york", -18000), ("fixed", 19800), ("utc", 0))
            ) + ", 28800 AS offset_s"),
        "json_find_value": over_events(
            choose("e % 8", "'10.0.0.' || u", "'top' || u", "'d' || u", u, "'-'", "'first'", "'last'", "'-'") + " AS found, "
            + choose("e % 8", "2", "2", "1", "1", "1", "2", "2", "0") + " AS n_leaves"),
        "fn_normalize_ip": over_events(f"{ip_at(0)} AS address"),
        "fn_first_valid_ip": over_events(f"{first_of(8, 10, 0)} AS address"),
        "fn_ip_scope": over_events(choose(
            "e % 12", "'Public/External'", "'Private/Internal'", "'Private/Internal'", "'Loopback'", "'Link-local'", "'Multicast'",
            "'Private/Internal'", "'Reserved'", "'Unknown'", "'Unknown'", "'Unknown'", "'Unknown'") + " AS scope"),
        "fn_normalize_ip6": over_events(choose(
            "e % 6", *[f"'{p}' || lower(to_hex(u + 1))" for p in ("2001:db8::", "fe80::")], "'::1'",
            *[f"'{p}' || lower(to_hex(u + 1))" for p in ("ff02::", "fd00:0:0:1::", "2606:4700::")]) + " AS address") + " WHERE u < 255",
        "fn_ip6_scope": over_events(choose(
            "e % 6", "'Reserved'", "'Link-local'", "'Loopback'", "'Multicast'", "'Private/Internal'", "'Public/External'") + " AS scope") + " WHERE u < 255",
        "scope_by_networks": SCOPE_BY_NETWORKS,
        "fn_normalize_username": over_events(choose(
            "e % 8", "'User' || u", "'-'", "'-'", "'-'", "'-'", "'User' || u || '\\n'", "'-'", "'Nonesuch'") + " AS username"),
        "fn_severity": over_events(severity("CAST(floor(value) AS INT) % 17") + " AS severity"),
        "fn_risk_level": over_events(band("CAST(floor(value) AS INT) % 101") + " AS risk_level"),
        "fn_format_time": over_events(
            f"{iso('event_us', choose('u % 3', '28800', '0', '-19800'))} AS seconds, "
            f"{iso('event_us', choose('u % 3', '28800', '0', '-19800'), '%Y-%m-%dT%H:%M')} AS minutes"),
        "fn_duration": over_events(
            f"CASE WHEN {seconds} < 60 THEN {seconds} || ' 秒' WHEN {seconds} < 3600 THEN {seconds} // 60 || ' 分 ' || {seconds} % 60 || ' 秒' "
            f"ELSE {seconds} // 3600 || ' 小时 ' || {seconds} // 60 % 60 || ' 分' END AS duration"),
        "classify_exact": query(
            f"""SELECT e, alert_type, event_category, outcome, CASE WHEN alert_type IS NOT NULL THEN 'High' END AS classification_confidence,
              'exact_rule_id:' || rule AS classification_reason FROM source_events
              LEFT JOIN (VALUES {exact}) AS t(slot, rule, alert_type, event_category, outcome) ON slot = e % {len(rules) + 2}""",
            source_events=EV),
        "classify_context": query(
            f"""SELECT e, {ladder(1)} AS alert_type, {ladder(2)} AS event_category, {ladder(3, False)} AS outcome,
              CASE WHEN {ladder(4)} = 'fallback' THEN 'Low' ELSE 'Medium' END AS classification_confidence, {ladder(4)} AS classification_reason
              FROM (SELECT e, string_split({choose(f'e % {len(groups)}', *groups)}, ',') AS g,
                lower({choose(f'e % {len(texts)}', *texts)} || ' log ' || e) AS x FROM source_events)""",
            source_events=EV),
    }


def _all_rules() -> str:
    rows = ", ".join(
        f"({i}, '{r}', '{kind}', '{category}', '{outcome}', {fixed.TYPE_BONUS.get(kind, 0)}, {5 if r in fixed.CUSTOM_RULES else 0})"
        for i, (r, (kind, category, outcome)) in enumerate(sorted(fixed.RULES.items()))
    )
    n = len(fixed.RULES)
    score = f"""least(100, greatest(least(rule_level * 6, 75) + bonus + custom + CASE WHEN e % 2 = 0 THEN 7 ELSE 0 END,
      CASE WHEN rule_level >= 12 THEN 85 WHEN rule_level >= 8 THEN 65 WHEN rule_level >= 4 THEN 40 ELSE 0 END))"""
    return query(f"""SELECT 'R' || e AS event_id, rule_id, alert_type, event_category, outcome, 'High' AS classification_confidence,
      rule_level, CAST({score} AS INT) AS risk_score,
      CASE WHEN e % 2 = 0 THEN '2606:4700::' || lower(to_hex(u % 250 + 1)) ELSE '-' END AS source_ip,
      CASE WHEN e % 2 = 0 THEN 'Public/External' ELSE 'Unknown' END AS source_scope, 'event ' || e || '\\n' AS full_log
    FROM (SELECT *, CAST(floor(value) AS INT) % 17 AS rule_level FROM source_events) JOIN all_rules ON place = e % {n}""",
        source_events=EV, all_rules=f"SELECT * FROM (VALUES {rows}) AS t(place, rule_id, alert_type, event_category, outcome, bonus, custom)")


def _ingest() -> dict[str, str]:
    return {
        "normalize_all_rules": _all_rules(),
        "src_lines": ingest(
            "SELECT count(*) AS n_lines, CAST(sum(strlen(line)) AS BIGINT) AS n_bytes FROM json_line WHERE record_number < 10000000"),
        "src_line_number": ingest(
            "SELECT row_number() OVER (ORDER BY record_number) AS record_number, md5(line) AS line_md5 FROM json_line WHERE record_number < 10000000"),
        "ingest_strict": ingest(
            "SELECT " + ", ".join(f"count(*) FILTER (line_status = '{s}') AS n_{s}" for s in ("malformed", "non_object", "oversized", "encoding"))
            + ", count(*) FILTER (line_status IN ('malformed', 'non_object', 'oversized')) > 0 AS refused FROM damaged"),
        "ingest_line_status": ingest("SELECT record_number, line_status, strlen(value) + 1 AS n_bytes FROM damaged"),
        "ingest_quarantine": ingest(
            "SELECT record_number, line_status, md5(value) AS line_md5 FROM damaged WHERE line_status IN ('malformed', 'non_object', 'oversized')"),
        "ingest_reject_samples": ingest("SELECT line_status, samples FROM samples"),
        "ingest_line_limit": ingest(
            f"SELECT record_number, (SELECT max(record_number) > {LINE_LIMIT} FROM damaged) AS line_limit_reached FROM damaged WHERE record_number <= {LINE_LIMIT}"),
        "ingest_byte_budget": ingest(
            "SELECT CAST(sum(strlen(value) + 1) AS BIGINT) AS input_bytes, sum(strlen(value) + 1) > 262144 AS over_budget FROM damaged"),
        "quality_stats": ingest("SELECT * FROM full_stats"),
        "quality_table": ingest(_quality_table()),
        "filter_counts": ingest(f"SELECT coalesce(reason, 'kept') AS reason, count(*) AS n FROM (SELECT {REASON} AS reason FROM norm) GROUP BY 1"),
    }


def _alerts() -> dict[str, str]:
    fields = {
        "source_attribution": "source_ip, source_scope, source_confidence, destination_ip",
        "user_attribution": "username, actor_user, target_user, command",
        "affected_asset": "affected_asset, agent_name, agent_ip, manager_name",
        "alert_risk_score": "rule_level, rule_severity, risk_score, risk_level",
        "mitre_enrich": "mitre_ids, mitre_tactics, mitre_techniques, attack_stage",
        "response_text": "response_suggestion",
    }
    scope = ", ".join(f"'{c}'" for c in fixed.SCOPE_CATEGORIES)
    return {
        **{n: query(f"SELECT record_number, {c} FROM norm") for n, c in fields.items()},
        "normalize_alerts": query(f"SELECT {ALERT} FROM norm"),
        "filter_min_level": query(f"SELECT record_number, rule_level FROM norm WHERE rule_level >= {FILTERS.min_level}"),
        "filter_time_range": query(f"SELECT record_number, event_us FROM norm WHERE event_us BETWEEN {SINCE} AND {UNTIL}"),
        "filter_scope": query(f"SELECT record_number, event_category FROM norm WHERE event_category IN ({scope})"),
        "dedup_best": query("SELECT record_number, pos, copies, event_id, rule_level, risk_score FROM alerts"),
        "dedup_count": query("SELECT CAST(sum(copies - 1) AS BIGINT) AS duplicates, count(*) AS kept FROM alerts"),
        "export_alerts": query(f"SELECT {ALERT} FROM alerts"),
        "correlation_key": query(f"SELECT record_number, {KEY} FROM keyed"),
    }


def _incidents() -> dict[str, str]:
    chain_key = "manager_name, agent_id, affected_asset, source_ip, identity"
    return {
        "sessionize": query(
            "SELECT record_number, coalesce(min(event_us) OVER (PARTITION BY sid), 0) AS session_us, "
            "CASE WHEN event_us IS NULL THEN record_number ELSE 0 END AS solo FROM sessions"),
        "failure_chain": query(
            f"SELECT {chain_key}, start_us AS session_us, event_count, end_us, explicit, explicit OR event_count >= 3 AS is_chain FROM chains"),
        "compromise_match": query(
            f"SELECT {chain_key}, m.start_us AS session_us, record_number, success_us FROM matches m JOIN chains USING (sid)"),
        "compromise_consume": query(
            "SELECT record_number, event_category, CASE WHEN matched THEN '-' ELSE identity END AS identity, matched "
            "FROM members WHERE alert_type = 'SSH Authentication Success'"),
        "agent_outages": query(
            "SELECT manager_name, agent_id, affected_asset, session_us, solo, stop_count, start_count, recovered_count, "
            "recovered_seconds, outstanding FROM outages JOIN (SELECT sid, any_value(manager_name) AS manager_name, "
            "any_value(agent_id) AS agent_id, any_value(affected_asset) AS affected_asset, coalesce(min(event_us), 0) AS session_us, "
            "max(CASE WHEN event_us IS NULL THEN record_number ELSE 0 END) AS solo FROM members GROUP BY sid) USING (sid)"),
        "incidents": query(f"SELECT {INCIDENT} FROM incidents"),
        "export_incidents": query(f"SELECT {INCIDENT} FROM incidents"),
        "incident_score": query("SELECT incident_id, event_count, risk_score, risk_level, status FROM incidents"),
        "incident_confidence": query("SELECT incident_id, event_count, max_rule_level, source_ip, confidence FROM incidents"),
        "incident_id": query("SELECT incident_id, manager_name, agent_id, first_seen, event_category FROM incidents"),
        "incident_evidence": query("SELECT incident_id, evidence, summary FROM incidents"),
        "compromise_incidents": query(f"SELECT {INCIDENT} FROM incidents WHERE compromised"),
        "incident_queue": query("SELECT priority, incident_id, title, risk_score, risk_level, event_count, last_seen FROM incidents"),
        "recommendations": query(f"SELECT {', '.join(fixed.RECOMMENDATION_COLUMNS)} FROM incidents"),
        "incident_counts": query("SELECT manager_name, agent_id, affected_asset, count(*) AS incident_count FROM incidents GROUP BY ALL"),
        "report_priority_incidents": query(f"SELECT {INCIDENT} FROM incidents WHERE priority <= 12"),
    }


COMMON = f"""count(*) AS alert_count, max(risk_score) AS max_risk_score, {band('max(risk_score)')} AS max_risk_level,
  count(*) FILTER (risk_level = 'Critical') AS critical_count, count(*) FILTER (risk_level = 'High') AS high_count,
  count(*) FILTER (risk_level = 'Medium') AS medium_count, count(*) FILTER (risk_level = 'Low') AS low_count,
  coalesce({iso('min(event_us)', 'arg_min(offset_s, (event_us, pos)) FILTER (event_us IS NOT NULL)')}, min(nullif(timestamp, '-')), '-') AS first_seen,
  coalesce({iso('max(event_us)', 'arg_max(offset_s, (event_us, pos)) FILTER (event_us IS NOT NULL)')}, max(nullif(timestamp, '-')), '-') AS last_seen,
  min(pos) AS first_pos"""


def top(keys: str, value: str, name: str, source: str = "alerts") -> str:
    return f"""SELECT {keys}, string_agg(v || '(' || n || ')', '; ' ORDER BY place) AS {name} FROM (
      SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY n DESC, pos) AS place FROM (
        SELECT {keys}, {value} AS v, count(*) AS n, min(pos) AS pos FROM {source} WHERE {value} IS NOT NULL GROUP BY {keys}, v))
      WHERE place <= 5 GROUP BY {keys}"""


def distinct(keys: str, value: str, name: str) -> str:
    return f"""SELECT {keys}, string_agg(v, ', ' ORDER BY pos) AS {name} FROM (
      SELECT {keys}, {value} AS v, min(pos) AS pos FROM alerts WHERE {value} <> '-' GROUP BY {keys}, v) GROUP BY {keys}"""


def _summaries() -> dict[str, str]:
    src = "nullif(source_ip, '-')"
    asset = "manager_name, agent_id, affected_asset"
    by_source = f"""SELECT source_ip, source_scope, coalesce(incident_count, 0) AS incident_count, c.* EXCLUDE (source_ip, source_scope),
        top_alert_types, affected_assets, coalesce(usernames, '-') AS usernames
      FROM (SELECT source_ip, any_value(source_scope) AS source_scope, {COMMON} FROM alerts WHERE source_ip <> '-' GROUP BY source_ip) c
      LEFT JOIN ({top('source_ip', 'alert_type', 'top_alert_types')}) USING (source_ip)
      LEFT JOIN ({top('source_ip', 'affected_asset', 'affected_assets')}) USING (source_ip)
      LEFT JOIN ({distinct('source_ip', 'username', 'usernames')}) USING (source_ip)
      LEFT JOIN (SELECT source_ip, count(*) AS incident_count FROM incidents GROUP BY source_ip) USING (source_ip)"""
    by_type = f"""SELECT c.*, coalesce(source_ips, '-') AS source_ips, affected_assets
      FROM (SELECT alert_type, arg_min(event_category, pos) AS event_category, {COMMON} FROM alerts GROUP BY alert_type) c
      LEFT JOIN ({top('alert_type', src, 'source_ips')}) USING (alert_type)
      LEFT JOIN ({top('alert_type', 'affected_asset', 'affected_assets')}) USING (alert_type)"""
    by_asset = f"""SELECT c.*, coalesce(incident_count, 0) AS incident_count, top_alert_types, coalesce(source_ips, '-') AS source_ips
      FROM (SELECT {asset}, arg_min(agent_ip, pos) AS agent_ip, {COMMON} FROM alerts GROUP BY {asset}) c
      LEFT JOIN ({top(asset, 'alert_type', 'top_alert_types')}) USING ({asset})
      LEFT JOIN ({top(asset, src, 'source_ips')}) USING ({asset})
      LEFT JOIN (SELECT {asset}, count(*) AS incident_count FROM incidents GROUP BY {asset}) USING ({asset})"""
    by_rule = f"""SELECT c.*, {severity('rule_level')} AS rule_severity, coalesce(affected_assets, '') AS affected_assets
      FROM (SELECT rule_id, description, count(*) AS alert_count, max(rule_level) AS rule_level, max(risk_score) AS max_risk_score,
          {band('max(risk_score)')} AS max_risk_level, min(pos) AS first_pos FROM alerts GROUP BY rule_id, description) c
      LEFT JOIN ({distinct('rule_id, description', 'affected_asset', 'affected_assets')}) USING (rule_id, description)"""
    attack = ", ".join(f"('{k}', '{a}', '{b}')" for k, (a, b) in fixed.ATTACK.items())
    # Tactics come before ids; `place` keeps their order inside an alert.
    base = "pos, risk_score, source_ip, affected_asset"
    buckets = f"""
      SELECT {base}, 0 AS place, 'Unmapped' AS mapping_type, 'Unmapped' AS attack_stage, '-' AS mitre_id, '-' AS technique
      FROM alerts WHERE mitre_ids = '-' AND mitre_tactics = '-'
      UNION ALL
      SELECT {base}, i - 1, 'Tactic', t[i], '-', '-' FROM (
        SELECT *, unnest(range(1, len(t) + 1)) AS i FROM (SELECT *, string_split(mitre_tactics, ', ') AS t FROM alerts WHERE mitre_tactics <> '-'))
      UNION ALL
      SELECT {base}, 100 + i, 'Technique', coalesce(tactic, '-'), x,
        coalesce(name, string_split(nullif(mitre_techniques, '-'), ', ')[i], '-') FROM (
          SELECT *, t[i] AS x FROM (
            SELECT *, unnest(range(1, len(t) + 1)) AS i FROM (SELECT *, string_split(mitre_ids, ', ') AS t FROM alerts WHERE mitre_ids <> '-')))
        LEFT JOIN (VALUES {attack}) AS a(known_id, tactic, name) ON x = known_id"""
    mkeys = "mapping_type, attack_stage, mitre_id, technique"
    mitre = f"""SELECT c.*, coalesce(top_source_ips, '-') AS top_source_ips, affected_assets
      FROM (SELECT {mkeys}, count(*) AS alert_count, {band('max(risk_score)')} AS max_risk_level, min((pos, place)) AS first_at FROM buckets GROUP BY {mkeys}) c
      LEFT JOIN ({top(mkeys, src, 'top_source_ips', 'buckets')}) USING ({mkeys})
      LEFT JOIN ({top(mkeys, 'affected_asset', 'affected_assets', 'buckets')}) USING ({mkeys})"""
    timeline = f"""SELECT {iso('bucket * 1000000', 'offset_s', '%Y-%m-%dT%H:%M')} AS period_start, * EXCLUDE (offset_s) FROM (
        SELECT event_us // 1000000 // size * size AS bucket, arg_min(offset_s, (event_us, pos)) AS offset_s, count(*) AS alert_count,
          count(*) FILTER (risk_level IN ('High', 'Critical')) AS high_or_critical_count,
          count(*) FILTER (event_category = 'Credential Attack') AS credential_attack_count
        FROM alerts, (SELECT CASE WHEN max(event_us) - min(event_us) <= 7200000000 THEN 600
            WHEN max(event_us) - min(event_us) <= 86400000000 THEN 3600 WHEN max(event_us) - min(event_us) <= 604800000000 THEN 21600
            ELSE 86400 END AS size FROM alerts)
        WHERE event_us IS NOT NULL GROUP BY bucket)"""
    metrics = f"""SELECT count(*) AS total_alerts, any_value(total_incidents) AS total_incidents,
        count(*) FILTER (risk_level = 'Critical') AS critical_alerts, count(*) FILTER (risk_level = 'High') AS high_alerts,
        count(*) FILTER (risk_level = 'Medium') AS medium_alerts, count(*) FILTER (risk_level = 'Low') AS low_alerts,
        any_value(critical_incidents) AS critical_incidents, any_value(high_incidents) AS high_incidents,
        any_value(medium_incidents) AS medium_incidents, any_value(low_incidents) AS low_incidents,
        count(DISTINCT {src}) AS source_ip_count, count(DISTINCT source_ip) FILTER (source_scope = 'Public/External') AS external_source_count,
        count(*) FILTER (source_ip = '-') AS unknown_source_alerts, count(DISTINCT ({asset})) AS asset_count,
        count(DISTINCT rule_id) AS rule_count, count(*) FILTER (event_category = 'Credential Attack') AS credential_attack_alerts,
        count(*) FILTER (event_category = 'Privilege Activity') AS privilege_alerts,
        count(*) FILTER (event_category = 'Agent Visibility') AS agent_visibility_alerts,
        count(*) FILTER (mitre_ids <> '-' OR mitre_tactics <> '-') AS mitre_mapped_alerts,
        count(*) FILTER (mitre_ids = '-' AND mitre_tactics = '-') AS mitre_unmapped_alerts,
        round(count(*) FILTER (mitre_ids <> '-' OR mitre_tactics <> '-') * 100.0 / count(*), 1) AS mitre_coverage_percent,
        count(*) FILTER (classification_confidence = 'Low') AS low_confidence_classifications,
        {iso('min(event_us)', 'arg_min(offset_s, (event_us, pos)) FILTER (event_us IS NOT NULL)')} AS first_seen,
        {iso('max(event_us)', 'arg_max(offset_s, (event_us, pos)) FILTER (event_us IS NOT NULL)')} AS last_seen,
        (max(event_us) - min(event_us)) // 1000000 AS duration_seconds,
        any_value(highest) AS highest_risk_score, {band('any_value(highest)')} AS highest_risk_level
      FROM alerts, (SELECT count(*) AS total_incidents, count(*) FILTER (risk_level = 'Critical') AS critical_incidents,
          count(*) FILTER (risk_level = 'High') AS high_incidents, count(*) FILTER (risk_level = 'Medium') AS medium_incidents,
          count(*) FILTER (risk_level = 'Low') AS low_incidents, max(risk_score) AS highest FROM incidents)"""
    ctes = {
        "by_source": by_source, "by_type": by_type, "by_asset": by_asset, "by_rule": by_rule,
        "buckets": buckets, "mitre": mitre, "times": timeline, "numbers": metrics,
    }

    def full(columns: list[str], table: str) -> str:
        return query(f"SELECT {', '.join(columns)} FROM {table}", **ctes)

    def shown(table: str, rows: int, columns: str, order: str = "max_risk_score DESC, alert_count DESC, first_pos") -> str:
        return query(
            f"SELECT {columns}, total_rows FROM (SELECT *, count(*) OVER () AS total_rows, row_number() OVER (ORDER BY {order}) AS place FROM {table}) WHERE place <= {rows}",
            **ctes)

    def newest(where: str, columns: str) -> str:
        return query(f"SELECT pos, {columns} FROM alerts WHERE {where} ORDER BY event_us DESC NULLS LAST, pos LIMIT 30")

    posture = _posture()
    return {
        "summary_by_source": full(fixed.SOURCE_SUMMARY_COLUMNS, "by_source"),
        "summary_by_type": full(fixed.TYPE_SUMMARY_COLUMNS, "by_type"),
        "summary_by_asset": full(fixed.ASSET_SUMMARY_COLUMNS, "by_asset"),
        "summary_by_rule": full(fixed.RULE_SUMMARY_COLUMNS, "by_rule"),
        "mitre_summary": full(fixed.MITRE_SUMMARY_COLUMNS, "mitre"),
        "metrics": query("SELECT * FROM numbers", **ctes),
        "timeline": full(fixed.TIMELINE_COLUMNS, "times"),
        "top5_values": query(
            f"SELECT alert_type, top_users, top_sources FROM ({top('alert_type', 'target_user', 'top_users')}) "
            f"JOIN ({top('alert_type', 'source_ip', 'top_sources')}) USING (alert_type)"),
        "ordered_distinct": query(distinct("manager_name, agent_id", "target_user", "target_users")),
        "ordered_distinct_rows": query(
            "SELECT manager_name, agent_id, target_user, min(pos) AS pos FROM alerts WHERE target_user <> '-' GROUP BY ALL"),
        "report_privilege": newest(
            "event_category = 'Privilege Activity'", "timestamp, affected_asset, actor_user, target_user, command, rule_id, risk_level"),
        "report_authentication": newest(
            "event_category IN ('Credential Attack', 'Authentication Success')",
            "timestamp, affected_asset, source_ip, target_user, alert_type, rule_id, rule_level, risk_level"),
        "report_agent_health": newest(
            "event_category = 'Agent Visibility'", "timestamp, affected_asset, alert_type, rule_id, rule_level, risk_level"),
        "report_top_sources": shown("by_source", 15, "source_ip, source_scope, alert_count, incident_count, max_risk_level, top_alert_types, affected_assets"),
        "report_top_assets": shown("by_asset", 15, "affected_asset, manager_name, agent_id, agent_ip, alert_count, incident_count, max_risk_level, top_alert_types"),
        "report_top_types": shown("by_type", 20, "alert_type, event_category, alert_count, max_risk_level, source_ips, affected_assets"),
        "report_top_rules": shown("by_rule", 20, "rule_id, rule_level, alert_count, max_risk_level, description, affected_assets"),
        "report_top_mitre": shown(
            "mitre", 30, "mapping_type, attack_stage, mitre_id, technique, alert_count, max_risk_level, top_source_ips, affected_assets",
            "mapping_type = 'Technique' DESC, max_risk_level = 'Critical' DESC, alert_count DESC, first_at"),
        "report_risk_distribution": query(
            " UNION ALL ".join(
                f"SELECT '{b}' AS risk_level, {b.lower()}_incidents AS incident_count, "
                f"printf('%.2f', {b.lower()}_incidents / greatest(total_incidents, 1) * 100) AS share_percent FROM numbers"
                for b in ("Critical", "High", "Medium", "Low")), **ctes),
        "report_timeline_share": query(
            "SELECT period_start, substr(period_start, 12, 5) AS label, alert_count, "
            "printf('%.4f', alert_count / max(alert_count) OVER ()) AS alert_share, "
            "printf('%.4f', high_or_critical_count / max(alert_count) OVER ()) AS high_share FROM times", **ctes),
        "report_posture": query(posture, **ctes),
    }


def _posture() -> str:
    level = (
        "CASE WHEN critical_incidents > 0 THEN 'critical' WHEN high_incidents > 0 THEN 'high' "
        "WHEN medium_incidents > 0 THEN 'medium' ELSE 'none' END"
    )
    texts = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in fixed.POSTURES.items())
    return f"""SELECT {level} AS posture, critical_incidents + high_incidents AS high_priority_incidents,
        CASE {level} {texts} END || ' 本次共纳入 ' || total_alerts || ' 条告警，关联形成 ' || total_incidents || ' 个事件，覆盖 '
        || asset_count || ' 台资产和 ' || source_ip_count || ' 个已知来源地址；其中高危及以上事件 '
        || critical_incidents + high_incidents || ' 个。最高优先事件为“' || title || '”（' || risk_score || '/100，'
        || event_count || ' 条证据）。' AS text
      FROM numbers, (SELECT title, risk_score, event_count FROM incidents WHERE priority = 1)"""


def all_statements() -> dict[str, str]:
    made = {**_ingest(), **_functions(), **_alerts(), **_incidents(), **_summaries()}
    headline = "total_alerts, total_incidents, source_ip_count, asset_count, highest_risk_score"
    return made | {
        "sink_csv": query("SELECT pos, event_id, rule_id, source_ip, target_user, full_log FROM alerts"),
        "sink_json": f"SELECT {headline}, total_alerts AS included_alerts, least(10, total_incidents)::INT AS n_priority FROM ({made['metrics']})",
        "publish_bundle": " UNION ALL ".join(
            f"SELECT 2 AS version, '{name}' AS table_name, n AS n_written, n AS n_read, {columns} AS n_columns FROM (SELECT count(*) AS n FROM ({sql}))"
            for name, (columns, sql) in {
                "cleaned_alerts": (len(fixed.ALERT_COLUMNS), made["dedup_best"]), "incidents": (len(fixed.INCIDENT_COLUMNS), made["incident_queue"]),
                "summary_by_source_ip": (len(fixed.SOURCE_SUMMARY_COLUMNS), made["summary_by_source"]),
                "summary_by_alert_type": (len(fixed.TYPE_SUMMARY_COLUMNS), made["summary_by_type"]),
                "summary_by_asset": (len(fixed.ASSET_SUMMARY_COLUMNS), made["summary_by_asset"]),
                "summary_by_rule": (len(fixed.RULE_SUMMARY_COLUMNS), made["summary_by_rule"]),
                "mitre_attack_summary": (len(fixed.MITRE_SUMMARY_COLUMNS), made["mitre_summary"]),
                "response_recommendations": (len(fixed.RECOMMENDATION_COLUMNS), made["recommendations"]),
                "alert_timeline": (len(fixed.TIMELINE_COLUMNS), made["timeline"]), "data_quality": (3, "SELECT unnest(range(16))"),
            }.items()),
    }
