"""Admission of jobs: URLs, addresses, media types, metadata, overrides."""

from __future__ import annotations

import ipaddress
import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .. import schemas as S

_URL = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)"


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, _URL, 1))


def authority(url: Column) -> Column:
    return F.regexp_extract(url, _URL, 2)


def host(url: Column) -> Column:
    """The host in lower case, without user info and port; empty if there is none."""
    bare = F.regexp_replace(authority(url), r"^.*@", "")
    return F.lower(F.regexp_replace(F.regexp_replace(bare, r":[0-9]*$", ""), r"[\[\]]", ""))


def parseable(url: Column) -> Column:
    """No control characters, no bad escapes, no blank in the host, a numeric port."""
    bad = F.regexp_like(url, F.lit(r"[\x00-\x1f\x7f]")) | F.regexp_like(url, F.lit(r"%(?![0-9A-Fa-f]{2})")) | F.regexp_like(url, F.lit("^:"))
    bad = bad | F.regexp_like(authority(url), F.lit(r"[ <>\"]")) | F.regexp_like(authority(url), F.lit(r":[^:\]]*[^0-9:\]][^:\]]*$") ) & ~F.contains(authority(url), F.lit("@"))
    return ~bad


def reject_reason(url: Column, allowed: Column, private: Column) -> Column:
    """The first rule a URL breaks, or NULL. ``allowed``, ``private``: arrays of hosts; an
    empty allow-list permits any host, private hosts are permitted too and may use http."""
    u = F.trim(url)
    known = (F.size(allowed) == 0) | F.array_contains(allowed, host(u)) | F.array_contains(private, host(u))
    secure = (scheme(u) == "https") | ((scheme(u) == "http") & F.array_contains(private, host(u)))
    return F.when(~parseable(u), "unparseable").when(F.contains(authority(u), F.lit("@")), "userinfo").when(host(u) == "", "no_host").when(~known, "host").when(~secure, "scheme")


def redact(url: Column) -> tuple[Column, Column]:
    """The URL without query, fragment and user info (empty if unparseable), and the SHA-256
    of the whole."""
    u = F.trim(url)
    bare = F.regexp_replace(F.regexp_replace(u, r"[?#].*$", ""), r"^([A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*@", "$1//")
    return F.when(parseable(u), bare).otherwise(F.lit("")), F.sha2(url, 256)


def media_type(ref: Column) -> Column:
    """Video by extension, else image."""
    return F.when(F.lower(F.regexp_extract(ref, r"\.[^./]*$", 0)).isin(*S.VIDEO_EXTENSIONS), "video").otherwise("image")


def mime(content: Column) -> Column:
    """P10: type by the first bytes."""
    head = F.hex(F.substring(content, 1, 16))
    return (
        F.when(F.startswith(head, F.lit("89504E470D0A1A0A")), "image/png").when(F.startswith(head, F.lit("FFD8FF")), "image/jpeg").when(F.regexp_like(head, F.lit("^47494638(37|39)61")), "image/gif")
        .when(F.regexp_like(head, F.lit("^52494646.{8}57454250")), "image/webp").when(F.regexp_like(head, F.lit("^.{8}66747970")), "video/mp4").when(F.startswith(head, F.lit("1A45DFA3")), "video/webm").otherwise("application/octet-stream")
    )


def permitted(urls: DataFrame, hosts: DataFrame) -> DataFrame:
    """Rows whose URL has a listed host; exact, any case, any port."""
    return urls.join(hosts.select(F.lower("host").alias("_host")).distinct(), host(F.trim("url")) == F.col("_host"), "left_semi")


def ip_reason(addr: Column, policy: str = "strict") -> Column:
    """P13 for dotted quads: why an address is denied, or NULL; ``relaxed`` permits loopback and
    private ranges."""
    part = F.split(addr, r"\.")
    o = [F.get(part, F.lit(i)).cast("int") for i in range(4)]
    valid = F.regexp_like(addr, F.lit(r"^(?:(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(?:\.(?!$)|$)){4}$"))
    private = (o[0] == 10) | ((o[0] == 172) & o[1].between(16, 31)) | ((o[0] == 192) & (o[1] == 168))
    local = ((o[0] == 169) & (o[1] == 254)) | ((o[0] == 224) & (o[1] == 0) & (o[2] == 0))
    r = F.when(~valid, "invalid")
    if policy == "strict":
        r = r.when(o[0] == 127, "loopback").when(private, "private")
    return r.when(local, "link-local").when(addr == "0.0.0.0", "unspecified").when(o[0].between(224, 239), "multicast").when((o[0] == 100) & o[1].between(64, 127), "CGNAT")


#: Networks by the reason to deny them, in the order in which reasons are looked for.
NETWORKS = [
    ("loopback", "127.0.0.0/8 ::1/128"), ("private", "10.0.0.0/8 172.16.0.0/12 192.168.0.0/16 fc00::/7"), ("link-local", "169.254.0.0/16 224.0.0.0/24 fe80::/10 ff02::/16"), ("metadata", "fd00:ec2::/32"),
    ("unspecified", "0.0.0.0/32 ::/128"), ("multicast", "224.0.0.0/4 ff00::/8"), ("CGNAT", "100.64.0.0/10"),
]
_MAPPED = "0" * 20 + "ffff"
_QUAD = r"(?:(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(?:\.(?!\z)|\z)){4}\z"


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, which is evaluated once however often ``body`` names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def ip_hex(addr: Column) -> Column:
    """The 16 bytes of an address as 32 hexadecimal digits, whose order is that of the addresses; dotted
    quads are v4-mapped ones; NULL if it is no address."""
    part = lambda quad: F.array_join(F.transform(F.split(quad, r"\."), lambda o: F.lpad(F.lower(F.hex(o.cast("int"))), 2, "0")), "")
    plain = F.regexp_replace(F.lower(addr), r"%[^%]+\z", "")  # a scope names an interface
    quad = F.regexp_extract(plain, r"\A(.*:)?([0-9.]+)\z", 2)
    # a dotted end is two groups
    text = F.when(quad.contains("."), F.concat(F.regexp_extract(plain, r"\A(.*:)", 1), F.regexp_replace(part(quad), r"\A(....)(....)\z", "$1:$2"))).otherwise(plain)
    fits = ~quad.contains(".") | F.regexp_like(quad, F.lit(rf"\A{_QUAD}"))

    def groups(t: Column) -> Column:
        at = F.instr(t, "::")
        left = F.when(at > 0, F.substring(t, F.lit(1), at - 1)).otherwise(t)
        right = F.when(at > 0, F.substring(t, at + 2, F.length(t))).otherwise(F.lit(""))
        some = lambda x: F.when(x == "", F.array().cast("array<string>")).otherwise(F.split(x, ":", -1))
        both = F.concat(some(left), some(right))
        whole = F.forall(both, lambda g: F.regexp_like(g, F.lit(r"\A[0-9a-f]{1,4}\z"))) & F.when(at > 0, F.size(both) <= 7).otherwise(F.size(both) == 8)
        wide = lambda x: F.array_join(F.transform(some(x), lambda g: F.lpad(g, 4, "0")), "")
        return F.when(whole, F.concat(wide(left), F.repeat(F.lit("0000"), 8 - F.size(both)), wide(right)))

    v4 = F.regexp_like(addr, F.lit(rf"\A{_QUAD}"))
    return F.when(v4, F.concat(F.lit(_MAPPED), part(addr))).when(fits & plain.contains(":"), _let(text, groups))


def _range(network: str) -> tuple[str, str]:
    n = ipaddress.ip_network(network)
    head = _MAPPED if n.version == 4 else ""
    return tuple(head + a.packed.hex() for a in (n[0], n[-1]))


def ip6_reason(policy: str = "strict"):
    """P13 for any address, with column functions only; v4-mapped ones count as v4."""
    left_out = ("metadata",) if policy == "strict" else ("loopback", "private")
    ranges = [(*_range(n), why) for why, networks in NETWORKS if why not in left_out for n in networks.split()]

    def reason(h: Column) -> Column:
        found = F.when(h.isNull(), "invalid")
        for low, high, why in ranges:
            found = found.when(h.between(low, high), why)
        return found

    return lambda addr: _let(ip_hex(F.col(addr) if isinstance(addr, str) else addr), reason)


def fetch_reason(error: Column) -> Column:
    """A bounded reason for a fetch error; the order of the rules matters."""
    # fixed values: fragments of error texts, in the order of the rules
    has = lambda *words: F.regexp_like(error, F.lit("|".join(words)))
    return (
        F.when(error.isNull() | (error == ""), "").when(has("deadline exceeded", "context canceled"), "timeout").when(has("allow_hosts", "scheme", "userinfo", "no host", "not parseable"), "rejected_url")
        .when(has("loopback", "private", "link-local", "multicast", "CGNAT", "unspecified"), "denied_address").when(has("redirect"), "redirect").when(has("max_bytes"), "oversize").when(has("Content-Type"), "media_type").when(has("returned "), "http_status").otherwise("other")
    )


def media_gate(content_type: Column, size: Column, allowed: list[str], cap: int) -> Column:
    """NULL if a body may pass, else media_type or oversize; an empty set allows any type,
    a body of exactly the cap passes."""
    kind = F.lower(F.trim(F.get(F.split(content_type, ";"), F.lit(0))))
    wrong = ~F.coalesce(kind, F.lit("")).isin(*allowed) if allowed else F.lit(False)
    return F.when(wrong, "media_type").when(size > cap, "oversize")


def oversize(frames: DataFrame, caps: DataFrame) -> DataFrame:
    """Frames (adapter, n_bytes) with ``preflight_error`` where they exceed the adapter's cap (0: none)."""
    over = (F.col("max_bytes") > 0) & (F.col("n_bytes") > F.col("max_bytes"))
    return frames.join(caps.select("adapter", "max_bytes"), "adapter", "left").withColumn("preflight_error", F.when(F.coalesce(over, F.lit(False)), F.concat(F.lit("image is "), F.col("n_bytes").cast("string"), F.lit(" bytes, over the limit of "), F.col("max_bytes").cast("string")))).drop("max_bytes")


MAX_METADATA = 4096


_STRING_OR_SPACE = re.compile(r'("(?:[^"\\]|\\.)*")|[ \t\r\n]+')


def _compact(text: str) -> str:
    """JSON text without white space between tokens; strings stay as they are."""
    return _STRING_OR_SPACE.sub(r"\1", text)


def _no_constant(name: str):
    raise ValueError(name)


@F.pandas_udf(StructType([StructField("metadata", StringType()), StructField("reason", StringType())]))
def metadata(texts: pd.Series) -> pd.DataFrame:
    """Compacted metadata, or why it is rejected. Absent is fine; JSON parsing is strict."""
    rows = []
    for t in texts:
        if t is None:
            rows.append((None, None))
            continue
        try:
            value = json.loads(t, parse_constant=_no_constant)
        except ValueError:
            rows.append((None, "invalid"))
            continue
        small = _compact(t)
        rows.append((None, "not_object") if not isinstance(value, dict) else (None, "too_large") if len(small.encode()) > MAX_METADATA else (small, None))
    return pd.DataFrame(rows, columns=["metadata", "reason"])


def workflows(selected: Column, known: list[str], default: str = "interval") -> tuple[Column, Column]:
    """The workflows to run (the default for none) and the names that are unknown."""
    chosen = F.when(F.coalesce(F.size(selected), F.lit(0)) <= 0, F.array(F.lit(default))).otherwise(selected)
    return chosen, F.array_except(F.coalesce(selected, F.array().cast("array<string>")), F.array(*map(F.lit, known)))


def dedup_override(value: Column, ceiling: int) -> tuple[Column, Column, Column]:
    """(threshold, enabled, intake accepts): NULL inherits, below 0 disables, capped."""
    return F.when(value.isNull(), F.lit(ceiling)).when(value < 0, F.lit(-1)).otherwise(F.least(value, F.lit(ceiling))), F.coalesce(value >= 0, F.lit(True)), F.coalesce((value >= -1) & (value <= ceiling), F.lit(True))


def status_class(status: Column) -> Column:
    """P20: ok, retryable or terminal."""
    return F.when(status.between(200, 299), "ok").when((status == 429) | (status >= 500) | status.isNull(), "retryable").otherwise("terminal")


def error_code(status: Column) -> Column:
    """P20: the status as a label; without one, the class."""
    return F.when(status_class(status) == "ok", F.lit(None)).otherwise(F.coalesce(status.cast("string"), F.lit("retryable")))


def retry_after(seconds: Column) -> Column:
    """P20: a usable Retry-After, 1 to 120 seconds."""
    return F.when(seconds.between(1, 120), seconds)


def backoff(status: Column, header: Column, attempt: Column, attempts: int = 3, base: float = 0.5) -> Column:
    """Seconds an attempt waits before the next: the header wins, 429 has a floor of 2 s."""
    step = F.pow(F.lit(2.0), attempt - 1)
    wait = F.when(status_class(status) != "retryable", 0.0).when(attempt >= attempts, 0.0)
    return wait.when(status.isNotNull() & retry_after(header).isNotNull(), retry_after(header).cast("double")).when(status == 429, 2.0 * step).otherwise(base * step)
