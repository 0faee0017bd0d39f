"""Scalar expressions against the Python standard library."""

import ipaddress
import json
import random
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from alertlake.functions import clock, ip, jsontext, text
from alertlake.operators import networks
from alertlake.operators.normalize import in_display_zone
from alertlake.sources.lines import judged_lines

ADDRESSES = [
    "::1", "::", "1::", "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8", "1:2:3:4:5:6:7:8", "1:0:0:2:0:0:0:3",
    "1:0:0:2:3:0:0:4", "::ffff:1.2.3.4", "::FFFF:0102:0304", "64:ff9b::1.2.3.4", "2001:DB8::0001",
    "fe80::1%eth0", "[fe80::1]", "1::2::3", "12345::", "::1.2.3", "1:2:3:4:5:6:7", "1:2:3:4:5:6:7:8:9",
    "::g", ":1", ":::", "1:::2", "1.2.3.4:80", "1.2.3.04", "256.1.1.1", "0.0.0.0", "1.2.3.4", " 1.2.3.4 ",
    "fd00::1", "ff02::1", "2001::1", "2001:4:112::5", "3fff::1", "1:2:3:4:5:6:1.2.3.4",
    "::1:2:3:4:5:6:7:8", "(1.2.3.4),", "1.2.3.4:x", "[1.2.3.4]:22", "-", "",
]


def expected_ip(value):
    bare = value.strip().strip("[](),;'\"").split("%")[0]
    host, _, port = bare.rpartition(":")
    for candidate in (bare, host if port.isdigit() and bare.count(":") == 1 else ""):
        try:
            return str(ipaddress.ip_address(candidate))
        except ValueError:
            continue
    return "-"


def test_addresses_match_the_standard_library(spark):
    df = spark.createDataFrame([(a,) for a in ADDRESSES], "a string")
    found = {r.a: r.n for r in df.select("a", ip.normalize_ip(F.col("a")).alias("n")).collect()}
    assert found == {a: expected_ip(a) for a in ADDRESSES}


@pytest.mark.parametrize("address,scope", [
    ("8.8.8.8", "Public/External"), ("10.0.0.1", "Private/Internal"), ("100.64.0.1", "Reserved"),
    ("192.0.2.1", "Reserved"), ("0.0.0.0", "Reserved"), ("::ffff:192.168.0.10", "Private/Internal"),
    ("127.1.2.3", "Loopback"), ("169.254.9.9", "Link-local"), ("239.1.1.1", "Multicast"), ("-", "Unknown"),
    ("::1", "Loopback"), ("fe80::1", "Link-local"), ("ff02::1", "Multicast"), ("fd00::1", "Private/Internal"),
    ("2001:db8::1", "Reserved"), ("2606:4700::1", "Public/External"), ("192.0.0.9", "Public/External"),
    ("192.0.0.8", "Reserved"), ("172.31.255.255", "Private/Internal"), ("172.32.0.0", "Public/External"),
])
def test_scope(spark, address, scope):
    assert spark.range(1).select(ip.ip_scope(F.lit(address)).alias("s")).first().s == scope


def test_network_table_matches_the_standard_library(spark):
    """10,000 networks of both families; every address is compared with all of them."""
    draw = random.Random(7)
    nets = []
    for i in range(10_000):
        if i % 3:
            text = f"{ipaddress.ip_address((10 << 24) + draw.randrange(1 << 18))}/{draw.randint(9, 32)}"
        else:
            text = f"{ipaddress.ip_address((0xfd << 120) + (draw.randrange(1 << 12) << 100))}/{draw.randint(20, 128)}"
        nets.append((text, f"net {i}", draw.randrange(50)))
    nets += [("::ffff:10.9.0.0/112", "mapped", 60), ("2001:db8::1", "one", 0), ("10.0.0.0/8", "rest", 99)]
    asked = [str(ipaddress.ip_address((10 << 24) + draw.randrange(1 << 19))) for _ in range(60)]
    asked += [str(ipaddress.ip_address((0xfd << 120) + (draw.randrange(1 << 13) << 100))) for _ in range(60)]
    asked += ["2001:db8::1", "2001:db8::2", "10.9.3.3", "::ffff:10.9.3.3", "11.0.0.1", "-", "x", None, "", asked[0]]

    def plain(address):
        try:
            one = ipaddress.ip_address(address.removeprefix("::ffff:"))
        except (ValueError, AttributeError):
            return "Unknown"
        hits = [(rank, -net.prefixlen, label) for net, label, rank in parsed if one in net]
        return min(hits)[2] if hits else "Public/External"

    parsed = [(ipaddress.ip_network("10.9.0.0/16" if "ffff" in t else t, strict=False), label, rank) for t, label, rank in nets]
    table = networks.network_table(spark.createDataFrame(nets, "network string, label string, rank int"))
    rows = spark.createDataFrame([(i, a, "old") for i, a in enumerate(asked)], "i int, label string, scope string")
    found = networks.with_network(rows, "label", table).collect()
    assert {r.i: (r.label, r.scope) for r in found} == {i: (a, plain(a)) for i, a in enumerate(asked)} and len(found) == len(asked)
    assert networks.with_network(rows.limit(0), "label", table).count() == 0
    assert {r.scope for r in networks.with_network(rows.limit(3), "label", table.limit(0)).collect()} == {"Public/External"}
    for wrong in ("10.0.0.0/33", "10.0.0/8", "nonsense"):
        with pytest.raises(ValueError, match="not a network"):
            networks.network_table(spark.createDataFrame([(wrong, "x", 1)], "network string, label string, rank int"))


TIMES = [
    "2026-07-26T00:00:00.000+0800", "2026-07-26T00:00:00Z", "2026-07-26", "20260726T000000", "2026-W30-7",
    "2026-W30", "2026W307T10", "2026-W54-1", "2020-W53-1", "2026", "2026-07", "2026-02-30",
    "2026-07-26 10:30", "2026-07-26T10:3000", "2026-07-26T10", "2026-07-26T10:30:15.1234567-05:30",
    "2026-07-26T10:30:15,5+05", "0000-01-01", "0001-01-01", "9999-12-31T23:59:59.999999+00:00", "x", "",
    "2026-07-26T10:30:15+0530", "2026-07-26T10:30:15+05:30:15", "2026-07-26T10:30+25:00",
    " 2026-07-26T10:30 ", "1969-12-31T23:59:59.5", "2026-07-26T10:30:60", "20260726T1030", "2026-07-26T",
    "2026-07-26T10:30:15.", "2026-07-26T103015.25Z", "2026-07-26T10:30Z+1", "1900-02-29",
    "2026-07-26T10:30:15.123-14:45", "2026-02-29T10:30:15.123Z", "2024-02-29T10:30:15.123Z",
]


def expected_time(value):
    value = value.strip()
    try:
        parsed = datetime.fromisoformat(value[:-1] + "+00:00" if value.endswith("Z") else value)
    except ValueError:
        return None
    parsed = parsed if parsed.tzinfo else parsed.replace(tzinfo=timezone.utc)
    span = parsed - datetime(1970, 1, 1, tzinfo=timezone.utc)
    us = (span.days * 86_400 + span.seconds) * 1_000_000 + span.microseconds
    return us, int(parsed.utcoffset().total_seconds()), parsed.isoformat(timespec="seconds")


def test_times_match_the_standard_library(spark):
    df = spark.createDataFrame([(t,) for t in TIMES], "v string").select("v", clock.parse_time(F.col("v")).alias("t"))
    shown = df.withColumn("iso", clock.iso_text(F.col("t.event_us"), F.col("t.offset_s")))
    found = {r.v: (r.t.event_us, r.t.offset_s, r.iso) if r.t else None for r in shown.collect()}
    assert found == {t: expected_time(t) for t in TIMES}


def test_filter_bounds():
    assert clock.filter_bound("2026-07-26T00:00:00+08:00") == clock.filter_bound("2026-07-25T16:00:00Z")
    assert clock.filter_bound(None) is None
    with pytest.raises(ValueError):
        clock.filter_bound("yesterday")


def test_display_zone_keeps_the_instant_and_unparsed_text(spark):
    us = 1_700_000_000_123_456
    df = spark.createDataFrame([("a", us, 0), ("raw", None, None)], "timestamp string, event_us bigint, offset_s int")
    rows = in_display_zone(df, "America/New_York").collect()
    assert (rows[0].timestamp, rows[0].event_us, rows[0].offset_s) == ("2023-11-14T17:13:20.123-05:00", us, -18000)
    assert rows[1].timestamp == "raw"
    assert in_display_zone(df, "+08:00").first().timestamp == "2023-11-15T06:13:20.123+08:00"
    for wrong in ("+25:00", "Nowhere/Land"):
        with pytest.raises(ValueError):
            in_display_zone(df, wrong)


JSON_LINES = [
    '{"id":1} trailing', '{"id":1}', "[1,2]", "5", '"x"', '{"a":NaN}', '{"a":1,"a":2}', '{"id":1},"seal":1}',
    "{bad", '{"id":1', '{"id":1}}', "{'id':1}", '{"id":"a\tb"}', '{"a":01}', "null", '{"id":"\\q"}', '{"id":1.}',
    '{"id":INF}', '{"id":-Infinity}', '{"id":1} {"id":2}', '  {"id":[1,{"a":"b"}]}  ', '{"a":"\\"}', '{"a":"\\\\"}',
    '{"a":"\\\\\\""}', '{"id":1}\r', '{"a":"x', '{"a":1},"x', '{"id":"\\u0041"}', "{}", '{"a":1,}', '{"a" 1}', "﻿{}",
    "   ", "", '{"a":{"b":1,}}', '{"id":{"b":1,}}', '{"id":[1,]}', '{"data":{"x":{"y":[}}}', "[1,]", '[{"a":1,}]', '{"id":{"b":1}]}',
    '{"id":{"a":tru}}', '["a":1]', '{"id":{"a":1}} {', '"a" "b"', '{"id":{"a":"b\\x"}}', '{"data":{"a":"{\\"b\\":1}"}}', "[1", "true", "{\"a\":1}//c", '{"a":.5}', '{"a":+1}',
]


def expected_status(line):
    line = line.removeprefix("﻿")
    if not line.strip():
        return "blank"
    try:
        return "ok" if isinstance(json.loads(line), dict) else "non_object"
    except ValueError:
        return "malformed"


def test_json_is_judged_as_strictly_as_the_standard_library(spark):
    df = spark.createDataFrame(list(enumerate(JSON_LINES)), "record_number bigint, value string")
    found = {r.record_number: r.line_status for r in judged_lines(df).collect()}
    assert found == {i: expected_status(v) for i, v in enumerate(JSON_LINES)}


def test_line_limits_count_the_newline(spark):
    df = spark.createDataFrame([(1, "{}" + " " * 7), (2, "{}" + " " * 8)], "record_number bigint, value string")
    assert [r.line_status for r in judged_lines(df, 10).orderBy("record_number").collect()] == ["ok", "oversized"]


def found_in(spark, data, names):
    df = spark.createDataFrame([(json.dumps({"v": data}),)], "line string")
    value = jsontext.sealed_object(F.col("line"), "v")["_"]["_v"]
    return df.select(jsontext.first_leaf(jsontext.leaves(value), names).alias("f")).first().f


@pytest.mark.parametrize("data,expected", [
    ({"srcip": "a"}, "a"), ({"SRCIP": "a"}, "a"), ({"x": {"srcip": "deep"}, "src_ip": "top"}, "top"),
    ({"a": [{"b": {"c": [[{"d": {"e": {"srcip": "far"}}}]]}}]}, "far"), ({"srcip": {"srcip": "in"}}, "in"),
    ({"srcip": None, "src_ip": "", "x": {"srcip": 7}}, "7"), ({"srcip": True}, "True"), ({"srcip": "{a}"}, "{a}"),
    ({"src_ip": "second", "srcip": "third"}, "second"), ({"k": '{"srcip":"quoted"}'}, "-"), ([{"srcip": "x"}], "-"),
    ({"a": {"srcip": "1"}, "b": {"srcip": "2"}}, "1"), ({"srcip": 'q"\\'}, 'q"\\'), ("srcip", "-"),
])
def test_search_is_breadth_first_in_document_order(spark, data, expected):
    assert found_in(spark, data, ["srcip", "src_ip"]) == expected


def test_texts(spark):
    def one(column):
        return spark.range(1).select(column.alias("v")).first().v

    assert one(text.clean_text(F.lit(" a\nb\t‮c\x00 "))) == "a\\nb\\t c"
    assert one(text.clean_text(F.lit("　 "))) == "-"
    assert one(text.known_user(F.lit("(NULL)"))) == "-"
    assert one(text.log_user(F.lit("Invalid for invalid user bob from 1.2.3.4"))) == "bob"
    assert one(text.log_user(F.lit("USER=root ; x"))) == "root"
    assert one(ip.log_ip(F.lit("from 1.2.3.4: rhost=5.6.7.8"))) == "5.6.7.8"
    assert [one(text.duration_text(F.lit(s))) for s in (-1, 59, 61, 3661)] == ["0 秒", "59 秒", "1 分 1 秒", "1 小时 1 分"]
    for cell in ("=1", " +1", "﻿-1", "​@SUM(A1:A2)", "\t=x"):
        assert one(text.formula_safe(F.lit(cell))) == "'" + cell
    assert one(text.formula_safe(F.lit("-"))) == "-"
    assert one(text.formula_safe(F.lit("a=1"))) == "a=1"
