"""IP addresses as Column expressions: canonical text and address scope."""

from __future__ import annotations

import ipaddress

from pyspark.sql import Column
from pyspark.sql import functions as F

from alertlake import dims
from alertlake.functions.text import let, strip

_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_V4 = rf"{_OCTET}(?:\.{_OCTET}){{3}}"
_GROUP = "[0-9a-f]{1,4}"
_GROUPS = f"{_GROUP}(?::{_GROUP})*"
_V6 = rf"^(?:{_GROUP}(?::{_GROUP}){{7}}|(?:{_GROUPS})?::(?:{_GROUPS})?)\z"


def v4_number(text: Column) -> Column:
    """Dotted quad as a number; null for other text."""
    parts = F.split(text, r"\.")
    total = F.lit(0).cast("bigint")
    for i in range(4):
        total = total * 256 + F.get(parts, F.lit(i)).try_cast("bigint")
    return F.when(text.rlike(rf"^{_V4}\z"), total)


def _quad_as_groups(text: Column) -> Column:
    """IPv6 text whose tail is a dotted quad, with that tail as two hexadecimal groups."""
    number = v4_number(F.regexp_extract(text, rf"^.*:({_V4})\z", 1))
    return F.when(
        F.contains(text, F.lit(".")),
        let(number, lambda n: F.concat(
            F.regexp_extract(text, "^(.*:)", 1),
            F.lower(F.hex(F.shiftright(n, 16))), F.lit(":"), F.lower(F.hex(n % 65536)),
        )),
    ).otherwise(text)


def v6_hex(text: Column) -> Column:
    """IPv6 text as 32 hexadecimal digits; null for other text."""

    def groups(part: Column) -> Column:
        return F.filter(F.split(part, ":"), lambda g: g != "")

    def expand(low: Column) -> Column:
        left = groups(F.substring_index(low, "::", 1))
        right = F.when(
            F.contains(low, F.lit("::")), groups(F.substring_index(low, "::", -1))
        ).otherwise(F.array().cast("array<string>"))
        missing = 8 - F.size(left) - F.size(right)
        whole = F.concat(left, F.array_repeat(F.lit("0"), missing), right)
        fits = F.when(F.contains(low, F.lit("::")), missing >= 1).otherwise(missing == 0)
        return F.when(
            low.rlike(_V6) & fits,
            F.array_join(F.transform(whole, lambda g: F.lpad(g, 4, "0")), ""),
        )

    return let(_quad_as_groups(F.lower(text)), expand)


def v6_text(digits: Column) -> Column:
    """Shortest form of 32 hexadecimal digits: the first longest run of zero groups folded."""

    def fold(plain: Column) -> Column:
        case = F
        for n in range(8, 1, -1):
            run = rf"^(.*?)(?:^|:)0(?::0){{{n - 1}}}(?::|\z)(.*)\z"
            case = case.when(plain.rlike(run), F.regexp_replace(plain, run, "$1::$2"))
        return case.otherwise(plain)

    def groups(d: Column) -> Column:
        parts = [F.regexp_replace(F.substr(d, F.lit(i), F.lit(4)), "^0{1,3}", "") for i in range(1, 33, 4)]
        quad = [F.conv(F.substr(d, F.lit(i), F.lit(2)), 16, 10) for i in (25, 27, 29, 31)]
        return F.when(
            d.startswith("0" * 20 + "ffff"), F.concat(F.lit("::ffff:"), F.concat_ws(".", *quad))
        ).otherwise(let(F.concat_ws(":", *parts), fold))

    return let(digits, lambda d: F.when(d.isNotNull(), groups(d)))


def normalize_ip(c: Column) -> Column:
    """Canonical address text: wrappers, zone and an IPv4 port removed; "-" if not an address."""

    def canonical(bare: Column) -> Column:
        host = F.regexp_extract(bare, r"^([0-9.]+)(?::[0-9]+)?\z", 1)
        return (
            F.when(bare.rlike(rf"^{_V4}(?::[0-9]+)?\z"), host)
            .when(bare.rlike("^[^:]*:[^:]*:"), v6_text(v6_hex(bare)))
        )

    bare = F.substring_index(F.btrim(strip(c), F.lit(dims.IP_WRAPPERS)), "%", 1)
    return F.coalesce(let(bare, canonical), F.lit(dims.MISSING))


def is_quad(c: Column) -> Column:
    return c.rlike(rf"^{_V4}\z")


def first_ip(*cols: Column) -> Column:
    """First of several texts that is an address."""
    found = F.filter(F.transform(F.array(*cols), normalize_ip), lambda x: x != dims.MISSING)
    return F.coalesce(F.get(found, F.lit(0)), F.lit(dims.MISSING))


LOG_CANDIDATES = [f"log{i}" for i in range(len(dims.LOG_IP_PATTERNS))]


def log_candidates(log: Column) -> dict[str, Column]:
    """What the address patterns find in log text; only their first match counts."""
    return {
        n: F.regexp_extract(log, p, 1) for n, p in zip(LOG_CANDIDATES, dims.LOG_IP_PATTERNS)
    }


def log_ip(log: Column) -> Column:
    """Address named in log text, patterns in order."""
    return first_ip(*log_candidates(log).values())


def _scope_case(value: Column, table, low, high) -> Column:
    case = None
    for label, networks in table:
        hit = None
        for net in map(ipaddress.ip_network, networks):
            inside = value.between(low(net), high(net))
            hit = inside if hit is None else hit | inside
        case = F.when(hit, label) if case is None else case.when(hit, label)
    return case.otherwise("Public/External")


def _v4_scope(number: Column) -> Column:
    return _scope_case(number, dims.SCOPES_V4, lambda n: int(n[0]), lambda n: int(n[-1]))


def _v6_scope(digits: Column) -> Column:
    return _scope_case(
        digits, dims.SCOPES_V6, lambda n: f"{int(n[0]):032x}", lambda n: f"{int(n[-1]):032x}"
    )


def ip_scope(c: Column) -> Column:
    """Scope of an address text; an IPv4-mapped IPv6 address is judged as IPv4."""
    four = v4_number(F.regexp_replace(c, "^::ffff:(?=.*[.])", ""))
    v6 = let(v6_hex(c), lambda d: F.when(d.isNotNull(), _v6_scope(d)))
    scope = let(four, lambda n: F.when(n.isNotNull(), _v4_scope(n)))
    return F.coalesce(scope, F.when(F.contains(c, F.lit(":")), v6), F.lit("Unknown"))
