"""One alert line in, one flat, classified and scored alert out; built-in expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alertlake import dims
from alertlake.functions import clock, ip, jsontext, scoring
from alertlake.functions.text import (
    clamp_level, clean_text, distinct_texts, first_known, joined, known, known_user, let, log_user,
)

MITRE_LISTS = ["id", "tactic", "technique"]
# Column: names searched for in the data object
LEAVES = {
    "data_source": dims.SOURCE_KEYS, "data_destination": dims.DESTINATION_KEYS,
    "actor_user": dims.ACTOR_KEYS, "data_target": dims.TARGET_KEYS, "command": dims.COMMAND_KEYS,
}


def _result(alert_type, category, outcome, confidence, reason) -> Column:
    parts = {
        "alert_type": alert_type, "event_category": category, "outcome": outcome,
        "classification_confidence": confidence, "classification_reason": reason,
    }
    return F.struct(
        *[(v if isinstance(v, Column) else F.lit(v)).alias(k) for k, v in parts.items()]
    )


def rule_entry(rule_id: Column) -> Column:
    """Row of the rule table: struct(alert type, category, outcome); null for an unknown id."""
    return dims.lookup(dims.RULES, rule_id)


def classify_exact(entry: Column, rule_id: Column) -> Column:
    """Classification by rule id, given its row of the rule table."""
    reason = F.concat(F.lit("exact_rule_id:"), rule_id)
    return F.when(
        entry.isNotNull(), _result(entry["col1"], entry["col2"], entry["col3"], "High", reason)
    )


def classify_context(groups: Column, description: Column, log: Column) -> Column:
    """Classification by rule groups (lower case) and limited text context; first hit wins."""
    text = F.lower(F.concat_ws(" ", description, log))

    def has(*names: str) -> Column:
        return F.arrays_overlap(groups, dims.literal_array(list(names)))

    def says(phrase: str) -> Column:
        return F.contains(text, F.lit(phrase))

    web, ssh = has("web", "accesslog", "web_log"), has("sshd", "ssh")
    auth = has("sshd", "ssh", "pam")
    scanner = says(dims.SCANNER_TERMS[0])
    for term in dims.SCANNER_TERMS[1:]:
        scanner = scanner | says(term)
    not_found = F.contains(F.concat(F.lit(" "), text, F.lit(" ")), F.lit(" 404 "))
    sudo_outcome = F.when(says("fail") | says("denied"), "failure").otherwise("success")
    context = "rule_group_or_context"
    credential, recon = "Credential Attack", "Reconnaissance"
    ladder = [
        (has("ssh_bruteforce") | (ssh & says("brute force")),
         ("SSH Brute Force", credential, "failure", context)),
        (has("ssh_invalid_user") | (ssh & says("invalid user")),
         ("SSH Invalid Username", credential, "failure", context)),
        (has("ssh_user_enum") | (ssh & says("username enumeration")),
         ("SSH Username Enumeration", credential, "failure", context)),
        (has("authentication_failed") | (auth & says("authentication failure")),
         ("Authentication Failure", credential, "failure", "authentication_failed_group")),
        (has("authentication_success"),
         ("Authentication Success", "Authentication Success", "success", "authentication_success_group")),
        (has("sudo"),
         ("Privilege Escalation / Sudo Activity", "Privilege Activity", sudo_outcome, "sudo_group")),
        (has("syscheck", "fim"),
         ("File Integrity Change", "File Integrity", "change", "fim_group")),
        (F.exists(groups, lambda g: F.contains(g, F.lit("vulnerab"))),
         ("Vulnerability Detection", "Vulnerability", "failure", "vulnerability_group")),
        (has("rootcheck", "malware", "virus", "trojan"),
         ("Malware / Rootkit Detection", "Malware", "failure", "malware_group")),
        (has("port_scan", "network_scan"),
         ("Port Scan", recon, "failure", "network_scan_group")),
        (has("web_scan") | (web & scanner),
         ("Web Scanner Activity", recon, "failure", "web_scanner_context")),
        (has("web_dir_bruteforce") | (web & not_found),
         ("Web Directory Brute Force", recon, "failure", "web_404_context")),
        (web, ("Web Access Event", "Web Activity", "unknown", "web_group")),
        (has("pam"), ("PAM Activity", "Session Activity", "unknown", "pam_group")),
    ]
    case = F
    for test, (kind, category, outcome, reason) in ladder:
        case = case.when(test, _result(kind, category, outcome, "Medium", reason))
    other = "Other Security Event"
    return case.otherwise(_result(other, other, "unknown", "Low", "fallback"))


CANDIDATES = ["agent_ip_text", "data_source", "data_destination", *ip.LOG_CANDIDATES]


def canonical_addresses() -> Column:
    """Struct of the candidate columns as canonical addresses, "-" where there is none.

    Dotted quads, the common case, need no further work and are told by one test per column.
    """
    c = F.col
    plain = F.lit(True)
    for n in CANDIDATES:
        plain = plain & (c(n).isNull() | c(n).isin("", dims.MISSING) | ip.is_quad(c(n)))
    as_is = [F.coalesce(F.nullif(c(n), F.lit("")), F.lit(dims.MISSING)).alias(n) for n in CANDIDATES]
    found = F.transform(F.array(*CANDIDATES), ip.normalize_ip)
    other = let(found, lambda a: F.struct(*[F.get(a, F.lit(i)).alias(n) for i, n in enumerate(CANDIDATES)]))
    return F.when(plain, F.struct(*as_is)).otherwise(other)


def mitre_fields(ids: Column, tactics: Column, techniques: Column) -> Column:
    """Given tactics and techniques, else those of the known technique ids."""

    def derived(part: int) -> Column:
        table = {k: v[part] for k, v in dims.ATTACK.items()}
        names = F.transform(ids, lambda x: dims.lookup(table, x))
        return F.array_distinct(F.filter(names, lambda x: x.isNotNull()))

    given = F.size(tactics) > 0
    tactic = F.when(given, tactics).otherwise(derived(0))
    technique = F.when(F.size(techniques) > 0, techniques).otherwise(derived(1))
    stages = F.when(given, distinct_texts(tactics)).otherwise(derived(0))
    return F.struct(
        joined(ids).alias("mitre_ids"),
        joined(tactic).alias("mitre_tactics"),
        joined(technique).alias("mitre_techniques"),
        joined(stages, default="Unmapped").alias("attack_stage"),
    )


def normalize_alerts(judged: DataFrame, *keep: str) -> DataFrame:
    """Flat alerts from judged lines; `keep` names further input columns to carry along."""
    c = F.col
    raw = c("fields")
    kept = ["record_number", *keep]
    sections = judged.select(
        *kept,
        *[raw[f"_{n}"].alias(f"raw_{n}") for n in ("timestamp", "id", "location", "full_log", "data")],
        jsontext.child_object(raw["_rule"], "id", "level", "description", "groups", "firedtimes", "mitre").alias("rule"),
        jsontext.child_object(raw["_agent"], "id", "name", "ip").alias("agent"),
        jsontext.child_object(raw["_manager"], "name").alias("manager"),
        jsontext.child_object(raw["_decoder"], "name").alias("decoder_fields"),
    )

    texts = {
        "event_id": c("raw_id"), "timestamp": c("raw_timestamp"), "agent_id": c("agent._id"),
        "agent_name": c("agent._name"), "manager_name": c("manager._name"), "rule_id": c("rule._id"),
        "description": c("rule._description"), "location": c("raw_location"),
        "decoder": c("decoder_fields._name"), "full_log": c("raw_full_log"),
    }
    plain = sections.select(
        *kept,
        *[jsontext.scalar_text(col).alias(n) for n, col in texts.items()],
        jsontext.scalar_text(c("agent._ip")).alias("agent_ip_text"),
        c("rule._level").alias("level"), c("rule._firedtimes").alias("fired"),
        jsontext.text_list(c("rule._groups")).alias("groups"),
        jsontext.child_object(c("rule._mitre"), *MITRE_LISTS).alias("mitre"),
        jsontext.leaves(c("raw_data")).alias("found"),
    )
    flat = plain.select(
        *kept,
        *[clean_text(c(n)).alias(n) for n in texts],
        clock.parse_time(c("timestamp")).alias("time"),
        clamp_level(jsontext.number(c("level"), 0)).alias("rule_level"),
        F.greatest(jsontext.number(c("fired"), 1), F.lit(1)).alias("fired_times"),
        F.transform("groups", F.lower).alias("groups"),
        "agent_ip_text", "mitre",
        *[jsontext.first_leaf(c("found"), names).alias(n) for n, names in LEAVES.items()],
    )
    # Log text is open to outsiders: it names a source only in ssh and pam authentication.
    log_text = F.when(
        c("event_category").isin(dims.AUTH_CATEGORIES) & c("auth_context"), c("full_log")
    )
    from_log = [c(f"address.{n}") for n in ip.LOG_CANDIDATES]
    lists = flat.withColumns({
        **{n: jsontext.text_list(c(f"mitre._{n}")) for n in MITRE_LISTS},
        "rule_entry": rule_entry(c("rule_id")),
        **{n: clean_text(c(n)) for n in ("actor_user", "data_target", "command")},
        "log_target": F.when(
            F.arrays_overlap(c("groups"), dims.literal_array(dims.AUTH_GROUPS)), log_user(c("full_log"))
        ),
    })
    enriched = (
        lists.withColumns({
            "class": F.coalesce(
                classify_exact(c("rule_entry"), c("rule_id")),
                classify_context(c("groups"), c("description"), c("full_log")),
            ),
            "auth_context": F.arrays_overlap(c("groups"), dims.literal_array(dims.AUTH_GROUPS)),
            "attack": mitre_fields(*[c(n) for n in MITRE_LISTS]),
        })
        .select("*", "class.*", "attack.*").drop("class", "attack", "mitre", "rule_entry", *MITRE_LISTS)
        .withColumns({
            **ip.log_candidates(log_text),
            **{n: known_user(c(n)) for n in ("actor_user", "data_target", "log_target")},
        })
        .withColumn("address", canonical_addresses())
        .withColumns({
            "agent_ip": c("address.agent_ip_text"),
            "source_ip": first_known(c("address.data_source"), *from_log),
            "source_confidence": F.when(known(c("address.data_source")), "High")
            .when(known(first_known(*from_log)), "Medium").otherwise("Unknown"),
            "destination_ip": first_known(c("address.data_destination"), c("address.agent_ip_text")),
            "target_user": F.when(
                c("event_category").isin(dims.AUTH_CATEGORIES),
                first_known(c("log_target"), c("data_target")),
            ).otherwise(first_known(c("data_target"), c("log_target"))),
        })
        .withColumns({
            "username": F.when(
                c("event_category") == "Privilege Activity",
                first_known(c("actor_user"), c("target_user")),
            ).otherwise(first_known(c("target_user"), c("actor_user"))),
            "affected_asset": first_known(c("agent_name"), c("destination_ip"), c("manager_name")),
            "source_scope": ip.ip_scope(c("source_ip")),
        })
        .withColumn(
            "risk_score",
            scoring.alert_score(c("rule_id"), c("rule_level"), c("alert_type"), c("source_scope")),
        )
        .withColumns({
            "rule_severity": scoring.severity(c("rule_level")),
            "risk_level": scoring.risk_level(c("risk_score")),
        })
        .withColumn(
            "response_suggestion",
            scoring.advice(
                c("event_category"), c("alert_type"), c("source_ip"),
                F.when(c("event_category") == "Privilege Activity", c("actor_user"))
                .otherwise(c("target_user")),
                c("risk_level"),
            ),
        )
    )
    return enriched.select(
        *dims.ALERT_COLUMNS, c("time.event_us").alias("event_us"),
        c("time.offset_s").alias("offset_s"), *keep,
    )


def in_display_zone(alerts: DataFrame, zone: str) -> DataFrame:
    """Times and their text in a display zone; "input" leaves alerts as they are."""
    offset = clock.zone_offset(F.col("event_us"), zone)
    if offset is None:
        return alerts
    moved = clock.iso_text(F.col("event_us"), offset, "yyyy-MM-dd'T'HH:mm:ss.SSS")
    return alerts.withColumns({
        "timestamp": F.coalesce(moved, F.col("timestamp")),
        "offset_s": F.when(F.col("event_us").isNotNull(), offset),
    })
