"""Fixed values of the alert model: lookup tables, word lists, patterns, texts.

Every value here is data the results depend on, so it is stated plainly and in one place.
The Columns at the bottom turn the tables into literal maps: they have a fixed, tiny size,
are folded by the optimiser and need no join.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------- fixed values
MISSING = "-"

# Field names searched for in an alert's free-form data object.
SOURCE_KEYS = [
    "srcip", "src_ip", "sourceip", "source_ip", "clientip", "client_ip", "remote_addr", "remote_ip",
]
DESTINATION_KEYS = ["dstip", "dst_ip", "destinationip", "destination_ip", "server_ip"]
ACTOR_KEYS = ["srcuser", "src_user", "actor_user", "subject_user", "initiating_user"]
TARGET_KEYS = ["dstuser", "dst_user", "target_user", "user", "username"]
COMMAND_KEYS = ["command", "cmd", "process_command_line"]

# rule id: (alert type, event category, outcome)
RULES = {
    "503": ("Agent Started", "Agent Visibility", "change"),
    "504": ("Agent Disconnected", "Agent Visibility", "failure"),
    "505": ("Agent Removed", "Agent Visibility", "failure"),
    "506": ("Agent Stopped", "Agent Visibility", "failure"),
    "533": ("Network Service Change", "Network Exposure", "change"),
    "550": ("File Integrity Modified", "File Integrity", "change"),
    "553": ("File Integrity Deleted", "File Integrity", "change"),
    "554": ("File Integrity Added", "File Integrity", "change"),
    "2502": ("SSH Brute Force", "Credential Attack", "failure"),
    "5402": ("Privilege Escalation / Sudo Activity", "Privilege Activity", "success"),
    "5403": ("Failed Sudo Activity", "Privilege Activity", "failure"),
    "5501": ("PAM Session Opened", "Session Activity", "success"),
    "5502": ("PAM Session Closed", "Session Activity", "success"),
    "5503": ("PAM Authentication Failure", "Credential Attack", "failure"),
    "5710": ("SSH Invalid Username", "Credential Attack", "failure"),
    "5711": ("SSH Authentication Failure", "Credential Attack", "failure"),
    "5712": ("SSH Brute Force", "Credential Attack", "failure"),
    "5715": ("SSH Authentication Success", "Authentication Success", "success"),
    "5760": ("SSH Authentication Failure", "Credential Attack", "failure"),
    "5761": ("SSH Authentication Failure", "Credential Attack", "failure"),
    "5762": ("SSH Connection Reset", "Credential Attack", "failure"),
    "5763": ("SSH Authentication Failure", "Credential Attack", "failure"),
    "40705": ("System Time Changed", "System Integrity", "change"),
    "100010": ("SSH Brute Force", "Credential Attack", "failure"),
    "100011": ("SSH Invalid Username", "Credential Attack", "failure"),
    "100012": ("SSH Username Enumeration", "Credential Attack", "failure"),
    "100020": ("Web Scanner Activity", "Reconnaissance", "failure"),
    "100021": ("Web Directory Brute Force", "Reconnaissance", "failure"),
    "100030": ("Port Scan", "Reconnaissance", "failure"),
}
CUSTOM_RULES = ["100010", "100011", "100012", "100020", "100021", "100030"]
EXPLICIT_ATTACK_RULES = ["2502", "5712", "100010", "100012"]
STOP_RULES = ["504", "505", "506"]
START_RULE = "503"

SCANNER_TERMS = ["nikto", "sqlmap", "dirbuster", "gobuster", "acunetix", "nessus", "nmap", "masscan"]
PLACEHOLDER_USERS = ["-", "by", "from", "unknown", "none", "null", "(null)", "n/a"]

AUTH_GROUPS = ["sshd", "ssh", "pam"]
AUTH_CATEGORIES = ["Credential Attack", "Authentication Success"]
SCOPE_CATEGORIES = [
    "Credential Attack", "Authentication Success", "Privilege Activity", "Reconnaissance",
    "File Integrity", "Vulnerability", "Malware", "Agent Visibility", "Network Exposure",
    "System Integrity",
]

# alert type: points added to the risk score
TYPE_BONUS = {
    "Agent Removed": 30,
    "Malware / Rootkit Detection": 30,
    "Agent Disconnected": 25,
    "Agent Stopped": 25,
    "Privilege Escalation / Sudo Activity": 22,
    "Vulnerability Detection": 22,
    "SSH Brute Force": 18,
    "SSH Username Enumeration": 18,
    "Port Scan": 18,
    "Failed Sudo Activity": 18,
    "File Integrity Modified": 18,
    "File Integrity Deleted": 18,
    "File Integrity Added": 18,
    "File Integrity Change": 18,
    "Web Scanner Activity": 16,
    "Web Directory Brute Force": 16,
    "Network Service Change": 15,
    "System Time Changed": 15,
    "SSH Invalid Username": 12,
    "SSH Authentication Failure": 12,
    "PAM Authentication Failure": 12,
    "Authentication Failure": 12,
    "SSH Connection Reset": 8,
}

# ATT&CK technique id: (tactic, technique)
ATTACK = {
    "T1021": ("Lateral Movement", "Remote Services"),
    "T1021.004": ("Lateral Movement", "SSH"),
    "T1046": ("Discovery", "Network Service Discovery"),
    "T1070.006": ("Defense Evasion", "Timestomp"),
    "T1078": ("Defense Evasion", "Valid Accounts"),
    "T1110": ("Credential Access", "Brute Force"),
    "T1110.001": ("Credential Access", "Password Guessing"),
    "T1548": ("Privilege Escalation", "Abuse Elevation Control Mechanism"),
    "T1548.003": ("Privilege Escalation", "Sudo and Sudo Caching"),
    "T1562.001": ("Defense Evasion", "Impair Defenses"),
    "T1595": ("Reconnaissance", "Active Scanning"),
    "T1595.002": ("Reconnaissance", "Vulnerability Scanning"),
}

# Patterns searched for in log text. (?iU): ignore case, Unicode classes.
LOG_IP_PATTERNS = [
    r"(?iU)\bfrom\s+([0-9a-f:.]+)",
    r"(?iU)\brhost=([0-9a-f:.]+)",
    r"(?iU)\b(?:src|source|client(?:ip)?)\s*[=:]\s*([0-9a-f:.]+)",
]
LOG_USER_PATTERNS = [
    r"(?iU)\bfor\s+(?:invalid user\s+)?([^\s:;]+)\s+from\b",
    r"(?iU)\buser(?:name)?[=:]\s*([^\s:;]+)",
]
# Control characters and bidirectional marks that are shown as a space.
HIDDEN_CHARS = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f\u061c\u200e\u200f\u202a-\u202e\u2066-\u2069]"
# Characters trimmed from both ends of a text.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
# Characters skipped before a cell is tested for a spreadsheet formula.
FORMULA_SKIP = " \t\r\n\x0b\x0c\ufeff\u200b\u2060"
FORMULA_START = r"^[=+\-@]"
IP_WRAPPERS = "[](),;'\""

# Address scopes, first hit wins; everything else is Public/External.
SCOPES_V4 = [
    ("Loopback", ["127.0.0.0/8"]),
    ("Link-local", ["169.254.0.0/16"]),
    ("Multicast", ["224.0.0.0/4"]),
    ("Private/Internal", ["10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16"]),
    ("Public/External", ["192.0.0.9/32", "192.0.0.10/32"]),
    ("Reserved", [
        "0.0.0.0/8", "100.64.0.0/10", "192.0.0.0/24", "192.0.2.0/24", "198.18.0.0/15",
        "198.51.100.0/24", "203.0.113.0/24", "240.0.0.0/4",
    ]),
]
SCOPES_V6 = [
    ("Loopback", ["::1/128"]),
    ("Link-local", ["fe80::/10"]),
    ("Multicast", ["ff00::/8"]),
    ("Private/Internal", ["fc00::/7"]),
    ("Public/External", [
        "2001:1::1/128", "2001:1::2/128", "2001:3::/32", "2001:4:112::/48", "2001:20::/28",
        "2001:30::/28",
    ]),
    ("Reserved", [
        "::/128", "64:ff9b:1::/48", "100::/64", "2001::/23", "2001:db8::/32", "2002::/16",
    ]),
]

# Report texts.
INCIDENT_TITLES = {
    "Credential Attack": "凭据攻击与认证失败",
    "Authentication Success": "远程认证成功",
    "Session Activity": "登录会话活动",
    "Privilege Activity": "特权操作活动",
    "Reconnaissance": "侦察与扫描活动",
    "File Integrity": "文件完整性变更",
    "Vulnerability": "漏洞风险",
    "Malware": "恶意代码活动",
    "Agent Visibility": "监控覆盖状态变化",
    "Network Exposure": "网络暴露面变化",
    "System Integrity": "系统完整性变化",
    "Web Activity": "Web 安全活动",
    "Other Security Event": "其他安全事件",
}
COMPROMISE_CATEGORY = "Suspected Compromise"
COMPROMISE_TITLE = "疑似凭据攻陷：失败后成功登录 · "
COMPROMISE_SUMMARY = " 同一来源在失败链之后成功完成认证，需优先排查账户是否失陷。"
COMPROMISE_ADVICE = (
    "立即验证成功登录是否获得授权；隔离可疑会话，轮换相关凭据，"
    "检查登录后的 sudo、进程、文件和网络活动，并保全完整时间线。"
)
INCIDENT_SUMMARY = "资产 %s 在 %d 秒内出现 %d 条相关告警，来源 %s，涉及规则 %s；最高规则等级 %d。"
HEALTH_SUMMARY = "资产 %s 的监控覆盖发生变化：%s"
HEALTH_COUNTS = "检测到 %d 次停止/断连与 %d 次启动/恢复；"
HEALTH_RECOVERED = "已匹配 %d 个恢复周期，累计中断约 %d 秒。"
HEALTH_NOT_RECOVERED = "未匹配到完整的停止—恢复周期。"
HEALTH_OUTSTANDING = "仍有 %d 次停止未见恢复。 "
POSTURE_COUNTS = " 本次共纳入 %d 条告警，关联形成 %d 个事件，覆盖 %d 台资产和 %d 个已知来源地址；其中高危及以上事件 %d 个。"
POSTURE_TOP = "最高优先事件为“%s”（%d/100，%d 条证据）。"
DURATION_SECONDS = "%d 秒"
DURATION_MINUTES = "%d 分 %d 秒"
DURATION_HOURS = "%d 小时 %d 分"
STATUSES = {"Critical": "立即处置", "High": "优先调查", "Medium": "待调查", "Low": "记录观察"}
UNKNOWN_SOURCE_LABEL = "未知来源"
UNKNOWN_USER_LABEL = "相关账户"
UNKNOWN_INCIDENT_SOURCE = "来源未知"
PRIORITY_PREFIX = "按高优先级事件处置并指定负责人。"
ADVICE = {
    "Credential Attack": "核查来源 {source} 的认证失败频率与目标账户 {user}；检查失败后是否出现成功登录；按授权流程实施限速、封禁或 MFA，并保全认证日志。",
    "Authentication Success": "确认来源 {source} 与账户 {user} 是否符合运维基线；关联前序失败登录、登录后 sudo、进程和网络连接记录。",
    "Privilege Activity": "核验账户 {user} 的提权理由、执行命令与变更工单；检查 sudoers 和特权组成员，确认最小权限。",
    "Reconnaissance": "在防火墙、WAF 或反向代理核查并限制来源 {source}；复核扫描路径、User-Agent、响应码与同源后续利用行为。",
    "Agent Visibility": "确认 Agent 停止或断连是否为计划维护；检查服务日志、网络连通性和篡改迹象，尽快恢复监控覆盖。",
    "File Integrity": "核对文件变更人与变更窗口，比较哈希、权限和内容差异；未经授权的变更应隔离主机并保全证据。",
    "Network Exposure": "确认端口或监听服务变化是否经过审批；识别关联进程、启动参数和外部可达性。",
    "System Integrity": "核查系统时间、审计链和 NTP 状态；排除日志时间线被干扰或人为篡改。",
    "Vulnerability": "核实漏洞适用性、资产暴露面和可利用条件，按风险窗口修补并复测。",
    "Malware": "立即隔离受影响资产，保全内存与磁盘证据，执行恶意代码排查和凭据轮换。",
}
PORT_SCAN_ADVICE = "在防火墙核查来源 {source} 的目标 IP、目标端口、协议和阻断结果；关联同源连接并按授权流程实施 ACL、限速或临时封禁。"
OTHER_ADVICE = "复核原始日志、资产负责人和相邻时间告警；确认是安全事件还是需要调优的预期行为。"
POSTURES = {
    "critical": "报告周期内存在严重事件，需要立即确认处置。",
    "high": "报告周期内存在高危事件，需要优先调查。",
    "medium": "未发现严重事件，但存在需要核查的中危活动。",
    "none": "未发现中高危关联事件，建议继续监控并维护检测基线。",
}

ALERT_COLUMNS = [
    "record_number", "event_id", "timestamp", "agent_id", "agent_name", "agent_ip", "manager_name",
    "source_ip", "source_scope", "source_confidence", "destination_ip", "username", "actor_user",
    "target_user", "command", "rule_id", "rule_level", "rule_severity", "alert_type",
    "event_category", "outcome", "classification_confidence", "classification_reason",
    "description", "fired_times", "affected_asset", "mitre_ids", "mitre_tactics",
    "mitre_techniques", "attack_stage", "risk_score", "risk_level", "response_suggestion",
    "location", "decoder", "full_log",
]
INCIDENT_COLUMNS = [
    "incident_id", "title", "status", "confidence", "first_seen", "last_seen", "duration_seconds",
    "event_count", "risk_score", "risk_level", "max_rule_level", "event_category", "source_ip",
    "source_scope", "affected_asset", "agent_id", "manager_name", "alert_types", "rule_ids",
    "actor_users", "target_users", "commands", "mitre_ids", "summary", "recommendation", "evidence",
]
SOURCE_SUMMARY_COLUMNS = [
    "source_ip", "source_scope", "alert_count", "incident_count", "max_risk_score",
    "max_risk_level", "critical_count", "high_count", "medium_count", "low_count", "first_seen",
    "last_seen", "top_alert_types", "affected_assets", "usernames",
]
TYPE_SUMMARY_COLUMNS = [
    "alert_type", "event_category", "alert_count", "max_risk_score", "max_risk_level",
    "critical_count", "high_count", "medium_count", "low_count", "first_seen", "last_seen",
    "source_ips", "affected_assets",
]
ASSET_SUMMARY_COLUMNS = [
    "affected_asset", "manager_name", "agent_id", "agent_ip", "alert_count", "incident_count",
    "max_risk_score", "max_risk_level", "critical_count", "high_count", "medium_count",
    "low_count", "first_seen", "last_seen", "top_alert_types", "source_ips",
]
RULE_SUMMARY_COLUMNS = [
    "rule_id", "description", "alert_count", "rule_level", "rule_severity", "max_risk_score",
    "max_risk_level", "affected_assets",
]
MITRE_SUMMARY_COLUMNS = [
    "mapping_type", "attack_stage", "mitre_id", "technique", "alert_count", "max_risk_level",
    "top_source_ips", "affected_assets",
]
RECOMMENDATION_COLUMNS = [
    "incident_id", "risk_level", "risk_score", "source_ip", "affected_asset", "event_category",
    "event_count", "recommendation",
]
TIMELINE_COLUMNS = [
    "period_start", "alert_count", "high_or_critical_count", "credential_attack_count",
]
AUDIT_ROWS = 30
AUTHENTICATION_COLUMNS = [
    "timestamp", "affected_asset", "source_ip", "target_user", "alert_type", "rule_id", "rule_level",
    "risk_level",
]
PRIVILEGE_COLUMNS = [
    "timestamp", "affected_asset", "actor_user", "target_user", "command", "rule_id", "risk_level",
]
HEALTH_COLUMNS = ["timestamp", "affected_asset", "alert_type", "rule_id", "rule_level", "risk_level"]
# Report table: rows shown, columns
REPORT_TABLES = {
    "by_source": (15, [
        "source_ip", "source_scope", "alert_count", "incident_count", "max_risk_level",
        "top_alert_types", "affected_assets",
    ]),
    "by_asset": (15, [
        "affected_asset", "manager_name", "agent_id", "agent_ip", "alert_count", "incident_count",
        "max_risk_level", "top_alert_types",
    ]),
    "by_type": (20, [
        "alert_type", "event_category", "alert_count", "max_risk_level", "source_ips", "affected_assets",
    ]),
    "by_rule": (20, [
        "rule_id", "rule_level", "alert_count", "max_risk_level", "description", "affected_assets",
    ]),
    "by_mitre": (30, [
        "mapping_type", "attack_stage", "mitre_id", "technique", "alert_count", "max_risk_level",
        "top_source_ips", "affected_assets",
    ]),
}

# ------------------------------------------------------------ end fixed values


def sql_text(value: object) -> str:
    """A fixed value as a SQL literal."""
    if isinstance(value, str):
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    if isinstance(value, tuple):
        return "struct(" + ", ".join(map(sql_text, value)) + ")"
    return str(value)


def literal_map(table: Mapping[str, object]) -> Column:
    return F.expr("map(" + ", ".join(sql_text(x) for pair in table.items() for x in pair) + ")")


def literal_array(values: list[str]) -> Column:
    return F.expr("array(" + ", ".join(map(sql_text, values)) + ")")


def lookup(table: Mapping[str, object], key: Column) -> Column:
    """Value of a fixed table, null where the key is not in it."""
    return F.try_element_at(literal_map(table), key)
