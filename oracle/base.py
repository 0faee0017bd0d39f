"""DuckDB statements of the same alerts, written independently of the Spark code.

Common table expressions build on each other; `query` prefixes a statement with those it needs.
"""

from __future__ import annotations

import re

from oracle import fixed

MINUTES = 1440
WIDTH = MINUTES * 60_000_000


def _values(rows) -> str:
    return ", ".join("(" + ", ".join("'" + str(x).replace("'", "''") + "'" for x in r) + ")" for r in rows)


def _case(key: str, table: dict, default: str) -> str:
    arms = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items())
    return f"CASE {key} {arms} ELSE {default} END"


ADVICE_ARMS = _case("event_category", fixed.ADVICE, f"'{fixed.OTHER_ADVICE}'")
TITLE_ARMS = _case("event_category", fixed.INCIDENT_TITLES, "event_category")
STATUS_ARMS = _case("risk_level", fixed.STATUSES, "NULL")


def severity(x: str) -> str:
    return f"CASE WHEN {x} >= 12 THEN 'Critical' WHEN {x} >= 8 THEN 'High' WHEN {x} >= 4 THEN 'Medium' ELSE 'Informational' END"


def band(x: str) -> str:
    return f"CASE WHEN {x} >= 85 THEN 'Critical' WHEN {x} >= 65 THEN 'High' WHEN {x} >= 40 THEN 'Medium' ELSE 'Low' END"


def iso(us: str, off: str, fmt: str = "%Y-%m-%dT%H:%M:%S") -> str:
    return f"(strftime(make_timestamp({us} + CAST({off} AS BIGINT) * 1000000), '{fmt}') || {offset_text(off)})"


def offset_text(off: str) -> str:
    return f"printf('%s%02d:%02d', CASE WHEN {off} < 0 THEN '-' ELSE '+' END, abs({off}) // 3600, abs({off}) // 60 % 60)"


def advice(category: str, kind: str, source: str, user: str, risk: str) -> str:
    arms = _case(category, fixed.ADVICE, f"'{fixed.OTHER_ADVICE}'")
    return (
        f"(CASE WHEN {risk} IN ('Critical', 'High') THEN '{fixed.PRIORITY_PREFIX}' ELSE '' END || "
        f"replace(replace(CASE WHEN {category} = 'Reconnaissance' AND {kind} = 'Port Scan' "
        f"THEN '{fixed.PORT_SCAN_ADVICE}' ELSE {arms} END, "
        f"'{{source}}', CASE WHEN {source} = '-' THEN '{fixed.UNKNOWN_SOURCE_LABEL}' ELSE {source} END), "
        f"'{{user}}', CASE WHEN {user} = '-' THEN '{fixed.UNKNOWN_USER_LABEL}' ELSE {user} END))"
    )


CTES = {
    "ev": """
        SELECT event_id AS e, user_id AS u, event_type, value, date_trunc('milliseconds', ts) AS moment,
          json_extract_string(props, '$.k') AS k, copy, event_id + 1 + copy * 10000000 AS record_number,
          CASE WHEN event_type = 'error' THEN CASE WHEN event_id % 7 = 0 THEN '5712' ELSE '5760' END
            WHEN event_type = 'view' THEN '5710' WHEN event_type = 'signup' THEN '5715'
            WHEN event_type = 'click' THEN '5402'
            ELSE CASE event_id % 4 WHEN 0 THEN '503' WHEN 1 THEN '504' WHEN 2 THEN '100030' ELSE '31101' END
          END AS rule_id,
          CASE user_id % 3 WHEN 0 THEN 28800 WHEN 1 THEN 0 ELSE -18000 END AS off,
          CASE user_id % 3 WHEN 0 THEN '+0800' WHEN 1 THEN 'Z' ELSE '-05:00' END AS zone
        FROM events, (VALUES (0), (1)) AS c(copy)
        WHERE copy = 0 OR event_id % 25 = 0""",
    "raw": """
        SELECT *, rule_id IN ('5712', '5760', '5710', '5715') AS ssh,
          CASE WHEN e % 97 = 0 THEN 'not-a-time'
            ELSE strftime(moment + to_seconds(off), '%Y-%m-%dT%H:%M:%S.%g') || zone END AS stamp,
          CASE WHEN e % 40 = 39 THEN '' ELSE 'E' || e END AS raw_id,
          CASE WHEN copy = 1 AND e % 50 = 0 THEN 16 ELSE CAST(floor(value) AS INT) % 17 END AS level,
          CASE WHEN rule_id IN ('503', '504', '5402') THEN NULL
            WHEN u % 6 = 0 THEN '203.0.113.' || u % 250 WHEN u % 6 = 1 THEN '8.8.8.' || u % 250
            WHEN u % 6 = 2 THEN '10.0.0.' || u % 250
            WHEN u % 6 = 3 AND rule_id NOT IN ('5712', '5760', '5710', '5715')
              THEN '[192.168.38.' || u % 250 || ']:22' END AS raw_src,
          CASE WHEN rule_id NOT IN ('503', '504', '5402') AND u % 6 = 4 THEN '172.16.0.' || u % 250 END AS nested_src,
          CASE WHEN rule_id = '5402' THEN 'root' WHEN e % 31 = 0 THEN 'by'
            WHEN e % 11 <> 0 THEN 'user' || u END AS raw_target,
          CASE WHEN rule_id IN ('5712', '5760', '5710', '5715')
            THEN CASE WHEN rule_id = '5715' THEN 'Accepted' ELSE 'Failed' END || ' password for user' || u
              || CASE WHEN u % 6 = 3 THEN ' from 192.168.38.' || u % 250 ELSE '' END || ' port 22 ssh2'
            WHEN rule_id = '31101' THEN 'GET /from/8.8.8.8?user=admin 404 x'
            ELSE 'event ' || e END AS log
        FROM ev""",
    "class": """
        SELECT * FROM (VALUES
          ('5712', 'SSH Brute Force', 'Credential Attack', 'failure', 'High', 18, 'T1110', 'Credential Access', 'Brute Force'),
          ('5760', 'SSH Authentication Failure', 'Credential Attack', 'failure', 'High', 12, 'T1110.001, T1021.004', 'Credential Access, Lateral Movement', 'Password Guessing, SSH'),
          ('5710', 'SSH Invalid Username', 'Credential Attack', 'failure', 'High', 12, 'T1110.001, T1021.004', 'Credential Access, Lateral Movement', 'Password Guessing, SSH'),
          ('5715', 'SSH Authentication Success', 'Authentication Success', 'success', 'High', 0, 'T1078', 'Initial Access, Persistence', 'Valid Accounts'),
          ('5402', 'Privilege Escalation / Sudo Activity', 'Privilege Activity', 'success', 'High', 22, 'T1548.003', 'Privilege Escalation', 'Sudo and Sudo Caching'),
          ('503', 'Agent Started', 'Agent Visibility', 'change', 'High', 0, '-', '-', '-'),
          ('504', 'Agent Disconnected', 'Agent Visibility', 'failure', 'High', 25, '-', '-', '-'),
          ('100030', 'Port Scan', 'Reconnaissance', 'failure', 'High', 18, '-', '-', '-'),
          ('31101', 'Web Directory Brute Force', 'Reconnaissance', 'failure', 'Medium', 16, 'T9999', '-', 'Unlisted')
        ) AS t(rule_id, alert_type, event_category, outcome, classification_confidence, bonus, mitre_ids, mitre_tactics, mitre_techniques)""",
    "facts": """
        SELECT record_number, CASE WHEN raw_id = '' THEN '-' ELSE raw_id END AS event_id,
          stamp AS timestamp, CASE WHEN e % 97 <> 0 THEN epoch_us(moment) END AS event_us,
          CASE WHEN e % 97 <> 0 THEN off END AS offset_s,
          lpad(CAST(u % 10 AS VARCHAR), 3, '0') AS agent_id,
          CASE WHEN u % 10 = 9 THEN '-' ELSE 'host-' || u % 10 END AS agent_name,
          CASE WHEN u % 10 = 8 THEN '-' ELSE '10.1.0.' || u % 10 END AS agent_ip,
          'mgr-' || u % 3 AS manager_name,
          CASE WHEN raw_src IS NOT NULL AND raw_src NOT LIKE '[%' THEN raw_src
            WHEN nested_src IS NOT NULL THEN nested_src
            WHEN ssh AND u % 6 = 3 THEN '192.168.38.' || u % 250 ELSE '-' END AS source_ip,
          CASE WHEN (raw_src IS NOT NULL AND raw_src NOT LIKE '[%') OR nested_src IS NOT NULL THEN 'High'
            WHEN ssh AND u % 6 = 3 THEN 'Medium' ELSE 'Unknown' END AS source_confidence,
          CASE WHEN rule_id = '5402' THEN 'user' || u ELSE '-' END AS actor_user,
          CASE WHEN ssh AND u % 6 = 3 THEN 'user' || u
            WHEN raw_target IS NULL OR raw_target = 'by' THEN '-' ELSE raw_target END AS target_user,
          CASE WHEN rule_id = '5402' THEN '/usr/bin/id -u ' || k ELSE '-' END AS command,
          rule_id, level AS rule_level, 'rule ' || rule_id AS description,
          greatest(e % 4, 1) AS fired_times, log AS full_log,
          CASE WHEN ssh THEN 'sshd' ELSE 'json' END AS decoder,
          alert_type, event_category, outcome, classification_confidence, bonus,
          mitre_ids, mitre_tactics, mitre_techniques
        FROM raw JOIN class USING (rule_id)""",
    "scored": """
        SELECT *, agent_ip AS destination_ip,
          CASE WHEN agent_name <> '-' THEN agent_name WHEN agent_ip <> '-' THEN agent_ip ELSE manager_name END AS affected_asset,
          CASE WHEN actor_user <> '-' THEN actor_user ELSE target_user END AS username,
          CASE WHEN source_ip = '-' THEN 'Unknown' WHEN source_ip LIKE '8.8.8.%' THEN 'Public/External'
            WHEN source_ip LIKE '203.0.113.%' THEN 'Reserved' ELSE 'Private/Internal' END AS source_scope,
          least(100, greatest(
            least(rule_level * 6, 75) + bonus + CASE WHEN source_ip LIKE '8.8.8.%' THEN 7 ELSE 0 END
              + CASE WHEN rule_id = '100030' THEN 5 ELSE 0 END,
            CASE WHEN rule_level >= 12 THEN 85 WHEN rule_level >= 8 THEN 65 WHEN rule_level >= 4 THEN 40 ELSE 0 END
          )) AS risk_score,
          CASE WHEN mitre_tactics = '-' THEN 'Unmapped' ELSE mitre_tactics END AS attack_stage,
          CASE WHEN rule_id = '31101' THEN 'web_404_context' ELSE 'exact_rule_id:' || rule_id END AS classification_reason,
          'events' AS location
        FROM facts""",
    "norm": f"""
        SELECT *, {severity('rule_level')} AS rule_severity, {band('risk_score')} AS risk_level,
          {advice('event_category', 'alert_type', 'source_ip', "CASE WHEN event_category = 'Privilege Activity' THEN actor_user ELSE target_user END", band('risk_score'))} AS response_suggestion
        FROM scored""",
    "best": """
        SELECT *, min(record_number) OVER same AS pos, count(*) OVER same AS copies,
          row_number() OVER (PARTITION BY manager_name, agent_id, event_id, apart
            ORDER BY rule_level DESC, risk_score DESC, quality DESC, record_number) AS choice
        FROM (SELECT *, CASE WHEN event_id = '-' THEN record_number ELSE 0 END AS apart,
                CAST(source_ip <> '-' AS INT) + CAST(target_user <> '-' AS INT) + CAST(full_log <> '-' AS INT) AS quality
              FROM norm)
        WINDOW same AS (PARTITION BY manager_name, agent_id, event_id, apart)""",
    "alerts": "SELECT * EXCLUDE (choice, apart, quality) FROM best WHERE choice = 1",
    "keyed": """
        SELECT *, CASE
            WHEN event_category IN ('Authentication Success', 'Session Activity') THEN target_user
            WHEN event_category = 'Privilege Activity' THEN actor_user
            WHEN event_category = 'Credential Attack' AND source_ip = '-'
              THEN CASE WHEN target_user <> '-' THEN target_user ELSE 'record:' || record_number END
            ELSE '-' END AS identity
        FROM alerts""",
    "gaps": """
        SELECT *, lag(event_us) OVER per_key AS before_us FROM keyed
        WINDOW per_key AS (PARTITION BY manager_name, agent_id, affected_asset, source_ip, event_category, identity
          ORDER BY event_us NULLS LAST, record_number)""",
    "sessions": f"""
        SELECT * EXCLUDE (before_us),
          concat_ws('|', manager_name, agent_id, affected_asset, source_ip, event_category, identity) AS key_text,
          concat_ws('|', manager_name, agent_id, affected_asset, source_ip, event_category, identity, sum(
            CASE WHEN before_us IS NULL OR event_us IS NULL OR event_us - before_us > {WIDTH} THEN 1 ELSE 0 END
          ) OVER (PARTITION BY manager_name, agent_id, affected_asset, source_ip, event_category, identity
            ORDER BY event_us NULLS LAST, record_number)) AS sid
        FROM gaps""",
    "chains": """
        SELECT sid, any_value(manager_name) AS manager_name, any_value(agent_id) AS agent_id,
          any_value(affected_asset) AS affected_asset, any_value(source_ip) AS source_ip,
          any_value(identity) AS identity, count(*) AS event_count, min(event_us) AS start_us,
          max(event_us) AS end_us, bool_or(rule_id IN ('2502', '5712', '100010', '100012')) AS explicit
        FROM sessions WHERE event_category = 'Credential Attack' AND event_us IS NOT NULL GROUP BY sid""",
    "hits": f"""
        SELECT c.sid, s.record_number, s.event_us AS success_us, c.end_us, c.start_us,
          row_number() OVER (PARTITION BY c.sid ORDER BY s.event_us, s.record_number) AS choice
        FROM chains c JOIN sessions s ON s.event_category = 'Authentication Success'
          AND s.manager_name = c.manager_name AND s.agent_id = c.agent_id
          AND s.affected_asset = c.affected_asset AND s.source_ip = c.source_ip
          AND s.event_us > c.end_us AND s.event_us - c.end_us <= {WIDTH}
        WHERE (c.explicit OR c.event_count >= 3) AND c.source_ip <> '-' AND s.target_user <> '-'
          AND EXISTS (SELECT 1 FROM sessions f WHERE f.sid = c.sid AND f.target_user = s.target_user)""",
    "matches": "SELECT * FROM hits WHERE choice = 1",
    "members": """
        SELECT s.* EXCLUDE (sid, event_category), coalesce(m.sid, s.sid) AS sid,
          CASE WHEN m.sid IS NULL THEN s.event_category ELSE 'Credential Attack' END AS event_category,
          m.sid IS NOT NULL AS matched
        FROM sessions s LEFT JOIN matches m ON s.record_number = m.record_number""",
    "listed": """
        SELECT sid, field, value, min(place) AS place FROM (
          SELECT sid, 'alert_types' AS field, alert_type AS value, (event_us, record_number, 0) AS place FROM members
          UNION ALL SELECT sid, 'rule_ids', rule_id, (event_us, record_number, 0) FROM members
          UNION ALL SELECT sid, 'actor_users', actor_user, (event_us, record_number, 0) FROM members
          UNION ALL SELECT sid, 'target_users', target_user, (event_us, record_number, 0) FROM members
          UNION ALL SELECT sid, 'commands', command, (event_us, record_number, 0) FROM members
          UNION ALL SELECT sid, 'mitre_ids', p[i], (event_us, record_number, CAST(i AS INT)) FROM (
            SELECT *, unnest(range(1, len(p) + 1)) AS i FROM (SELECT *, string_split(mitre_ids, ', ') AS p FROM members))
        ) WHERE value <> '-' GROUP BY sid, field, value""",
    "lists": """
        SELECT sid, """ + ", ".join(
        f"string_agg(value, '{'; ' if f == 'commands' else ', '}' ORDER BY place) FILTER (field = '{f}') AS {f}"
        for f in ("alert_types", "rule_ids", "actor_users", "target_users", "commands", "mitre_ids")
    ) + """,
          arg_min(value, place) FILTER (field = 'actor_users') AS first_actor,
          arg_min(value, place) FILTER (field = 'target_users') AS first_target
        FROM listed GROUP BY sid""",
    "walk": """
        SELECT *, stops - starts AS total,
          least(0, min(stops - starts) OVER (PARTITION BY sid ORDER BY event_us, record_number)) AS lowest
        FROM (SELECT sid, event_us, record_number, rule_id = '504' AS is_stop,
            sum(CAST(rule_id = '504' AS INT)) OVER w AS stops, sum(CAST(rule_id = '503' AS INT)) OVER w AS starts
          FROM members WHERE event_category = 'Agent Visibility' AND event_us IS NOT NULL
          WINDOW w AS (PARTITION BY sid ORDER BY event_us, record_number))""",
    "pairs": """
        SELECT a.sid, count(*) AS recovered_count, CAST(sum((b.event_us - a.event_us) // 1000000) AS BIGINT) AS recovered_seconds
        FROM (SELECT * FROM walk WHERE is_stop) a
        JOIN (SELECT *, starts + lowest AS k,
                coalesce(lag(lowest) OVER (PARTITION BY sid ORDER BY event_us, record_number), 0) AS lowest_before
              FROM walk) b ON a.sid = b.sid AND NOT b.is_stop AND b.total >= b.lowest_before AND a.stops = b.k
        GROUP BY a.sid""",
    "outages": """
        SELECT s.sid, stop_count, start_count, coalesce(recovered_count, 0) AS recovered_count,
          coalesce(recovered_seconds, 0) AS recovered_seconds, timed - coalesce(recovered_count, 0) AS outstanding
        FROM (SELECT sid, count(*) FILTER (rule_id = '504') AS stop_count, count(*) FILTER (rule_id = '503') AS start_count,
            count(*) FILTER (rule_id = '504' AND event_us IS NOT NULL) AS timed
          FROM members WHERE event_category = 'Agent Visibility' GROUP BY sid) s
        LEFT JOIN pairs p ON s.sid = p.sid""",
    "key_first": """
        SELECT key_text, min((event_us IS NULL, coalesce(event_us, 0), record_number)) AS key_start FROM sessions GROUP BY key_text""",
    "grouped": """
        SELECT sid, any_value(manager_name) AS manager_name, any_value(agent_id) AS agent_id,
          any_value(affected_asset) AS affected_asset, any_value(source_ip) AS source_ip,
          any_value(event_category) AS event_category, count(*) AS event_count, bool_or(matched) AS compromised,
          any_value(key_text) FILTER (NOT matched) AS key_text,
          max(rule_level) AS max_rule_level, count(DISTINCT rule_id) AS rules,
          bool_or(rule_id = '100030') AS custom, max(risk_score) AS top_score,
          arg_min(struct_pack(event_id, timestamp, offset_s, event_us, record_number, source_scope, rule_id, full_log), (event_us, record_number)) AS f,
          arg_max(struct_pack(timestamp, offset_s, event_us), (event_us, record_number)) AS l,
          arg_max(struct_pack(full_log, alert_type), (risk_score, rule_level, -coalesce(event_us, 0), -record_number)) AS w
        FROM members GROUP BY sid""",
    "rated": """
        SELECT *, CASE WHEN compromised THEN greatest(base, 95) ELSE base END AS risk_score,
          CASE WHEN f.event_us IS NULL THEN 0 ELSE (l.event_us - f.event_us) // 1000000 END AS duration_seconds
        FROM (SELECT *, least(100, top_score
            + CASE WHEN event_category IN ('Session Activity', 'Authentication Success') THEN least(3, event_count - 1)
                ELSE least(15, CAST(round(log2(event_count + 1) * 4) AS INT)) END
            + CASE WHEN rules >= 2 THEN 5 ELSE 0 END
            + CASE WHEN event_category = 'Credential Attack' AND event_count >= 3 THEN 5 ELSE 0 END) AS base
          FROM grouped)""",
    "banded": f"SELECT *, {band('risk_score')} AS risk_level FROM rated",
    "incidents_all": f"""
        SELECT 'INC-' || coalesce(strftime(make_timestamp(f.event_us), '%Y%m%d'), 'UNKNOWN') || '-' || upper(substr(sha256(concat_ws(chr(31),
            manager_name, agent_id,
            CASE WHEN f.event_id <> '-' THEN f.event_id ELSE 'record:' || f.record_number || ':' || f.rule_id || ':' || f.full_log END,
            coalesce(strftime(make_timestamp(f.event_us), '%Y-%m-%dT%H:%M:%S.%g') || '+00:00', f.timestamp),
            affected_asset, source_ip, event_category)), 1, 10)) AS incident_id,
          CASE WHEN compromised THEN '{fixed.COMPROMISE_TITLE}' ELSE {TITLE_ARMS} || ' · ' END || affected_asset AS title,
          {STATUS_ARMS} AS status,
          CASE WHEN compromised OR custom OR max_rule_level >= 10 OR (event_count >= 3 AND source_ip <> '-') THEN 'High'
            WHEN event_count >= 2 OR source_ip <> '-' THEN 'Medium' ELSE 'Low' END AS confidence,
          coalesce({iso('f.event_us', 'f.offset_s')}, f.timestamp) AS first_seen,
          coalesce({iso('l.event_us', 'l.offset_s')}, l.timestamp) AS last_seen,
          duration_seconds, event_count, risk_score, risk_level, max_rule_level,
          CASE WHEN compromised THEN '{fixed.COMPROMISE_CATEGORY}' ELSE event_category END AS event_category,
          source_ip, f.source_scope AS source_scope, affected_asset, agent_id, manager_name,
          alert_types, rule_ids, coalesce(actor_users, '-') AS actor_users, coalesce(target_users, '-') AS target_users,
          coalesce(commands, '-') AS commands, coalesce(mitre_ids, '-') AS mitre_ids,
          CASE WHEN event_category = 'Agent Visibility' THEN
              '资产 ' || affected_asset || ' 的监控覆盖发生变化：检测到 ' || stop_count || ' 次停止/断连与 ' || start_count || ' 次启动/恢复；'
              || CASE WHEN recovered_count > 0 THEN '已匹配 ' || recovered_count || ' 个恢复周期，累计中断约 ' || recovered_seconds || ' 秒。'
                   ELSE '未匹配到完整的停止—恢复周期。' END
              || CASE WHEN outstanding > 0 THEN '仍有 ' || outstanding || ' 次停止未见恢复。 ' ELSE '' END
            ELSE '资产 ' || affected_asset || ' 在 ' || duration_seconds || ' 秒内出现 ' || event_count || ' 条相关告警，来源 '
              || CASE WHEN source_ip = '-' THEN '{fixed.UNKNOWN_INCIDENT_SOURCE}' ELSE source_ip END || '，涉及规则 ' || rule_ids
              || '；最高规则等级 ' || max_rule_level || '。' END
            || CASE WHEN compromised THEN '{fixed.COMPROMISE_SUMMARY}' ELSE '' END AS summary,
          CASE WHEN compromised THEN '{fixed.COMPROMISE_ADVICE}' ELSE
            {advice('event_category', 'w.alert_type', 'source_ip', "coalesce(CASE WHEN event_category = 'Privilege Activity' THEN first_actor END, first_target, '-')", 'risk_level')} END AS recommendation,
          CASE WHEN length(w.full_log) > 320 THEN substr(w.full_log, 1, 317) || '...' ELSE w.full_log END AS evidence,
          compromised, sid, key_start, f.event_us AS first_us, f.record_number AS first_record
        FROM banded LEFT JOIN lists USING (sid) LEFT JOIN outages USING (sid) LEFT JOIN key_first USING (key_text)""",
    "incidents": """
        SELECT *, row_number() OVER (ORDER BY risk_score DESC, max_rule_level DESC, event_count DESC, last_seen DESC,
          key_start, first_us NULLS LAST, first_record) AS priority FROM incidents_all""",
}


def query(select: str, **more: str) -> str:
    """The statement with all table expressions it needs, directly or not."""
    known = {**CTES, **more}
    needed: set[str] = set()

    def visit(text: str) -> None:
        for name in re.findall(r"(?:FROM|JOIN)\s+([a-z_]+)", text):
            if name in known and name not in needed:
                needed.add(name)
                visit(known[name])

    visit(select)
    parts = [f"{n} AS ({known[n].strip()})" for n in known if n in needed]
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + select.strip()
