"""Addresses parsed and judged by column functions against the standard library."""

from __future__ import annotations

import ipaddress
import random

import pytest
from pyspark.sql import functions as F

from modsieve.functions import admission as A
from modsieve.plans import moderation as M


def parsed(text):
    try:
        ip = ipaddress.ip_address(text)
    except ValueError:
        return None
    return getattr(ip, "ipv4_mapped", None) or ip


def why(text, policy):
    ip = parsed(text)
    if ip is None:
        return "invalid"
    net = lambda n: ip.version == ipaddress.ip_network(n).version and ip in ipaddress.ip_network(n)
    if policy == "strict" and ip.is_loopback:
        return "loopback"
    if policy == "strict" and any(map(net, ("10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16", "fc00::/7"))):
        return "private"
    if any(map(net, ("169.254.0.0/16", "224.0.0.0/24", "fe80::/10", "ff02::/16"))):
        return "link-local"
    if policy != "strict" and net("fd00:ec2::/32"):
        return "metadata"
    return "unspecified" if ip.is_unspecified else "multicast" if ip.is_multicast else "CGNAT" if net("100.64.0.0/10") else None


def texts():
    g = random.Random(4)
    out = [None, "", ":", "::", ":::", "1", "::1", "1::", "::1%eth0", "fe80::1%", "::ffff:10.1.2.3", "::ffff:10.1.2.300", "::10.1.2.3", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7::", "1:2:3:4:5:6:7:8::", "::2:3:4:5:6:7:8", "1:2:3:4:5:6:7", "1::2::3", "12345::", "g::", ":1::", "1:", "1.2.3", "1.2.3.4.5", "01.2.3.4", "1.2.3.4 ", " 1.2.3.4", "1.2.3.4\n", "::\n", "1:2:3:4:5:6:1.2.3.4", "1:2:3:4:5:6:7:1.2.3.4", "::ffff:0:0", "::FFFF:127.0.0.1", "1.2.3.4::", "0.0.0.0", "255.255.255.255", "100.64.0.0", "100.128.0.0", "fd00:ec2::254", "FF05::1"]
    for _ in range(600):
        n = g.getrandbits(128) if g.random() < 0.5 else (g.choice([0xFC, 0xFD, 0xFE, 0xFF, 0x20, 0]) << 120) + g.getrandbits(g.choice([0, 8, 100]))
        ip = ipaddress.ip_address(n) if n >> 32 else ipaddress.IPv6Address(n)
        out += [str(ip), ip.exploded.upper(), str(ipaddress.ip_address(g.getrandbits(32))), f"::ffff:{ipaddress.ip_address(g.getrandbits(32))}"]
        t = list(str(ip))
        t.insert(g.randint(0, len(t)), g.choice(":.0fg%"))
        out.append("".join(t))
    return out


@pytest.mark.parametrize("policy", ["strict", "relaxed"])
def test_any_text_is_judged_as_by_the_standard_library(spark, policy):
    rows = spark.createDataFrame([(t,) for t in texts()], "a string").select("a", A.ip6_reason(policy)("a").alias("r"), A.ip_hex(F.col("a")).alias("h")).collect()
    assert [(r.a, r.r) for r in rows if r.r != why(r.a, policy)] == []
    for r in rows:
        ip = parsed(r.a)
        assert r.h == (None if ip is None else ("0" * 20 + "ffff" if ip.version == 4 else "") + ip.packed.hex()), r.a


def test_no_python_node(spark):
    plan = M.p13_ip6_policy(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
