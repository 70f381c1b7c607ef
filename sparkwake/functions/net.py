"""Column helpers for addresses, ports, domains and byte counts."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Prefixes of addresses that count as internal (fixed values).
PRIVATE = ("10.", *(f"172.{n}." for n in range(16, 32)), "192.168.", "127.", "0.0.0.0", "::1", "fe80:")
PRIVATE_PATTERN = "^(?:" + "|".join(re.escape(p).replace("\\.", "[.]") for p in PRIVATE) + ")"
#: Well-known ports (fixed values): transport, port, application.
PORTS = (
    ("tcp", (80, 8080, 8443, 8000, 3000), "Http"), ("tcp", (443,), "Tls"), ("tcp", (53,), "Dns"), ("udp", (53,), "Dns"), ("tcp", (21,), "Ftp"), ("tcp", (20,), "FtpData"),
    ("tcp", (25, 587, 465), "Smtp"), ("tcp", (110, 995), "Pop3"), ("tcp", (143, 993), "Imap"), ("tcp", (22,), "Ssh"), ("tcp", (23,), "Telnet"), ("tcp", (445, 139), "Smb"),
    ("udp", (67, 68), "Dhcp"), ("tcp", (1883,), "Mqtt"), ("udp", (1883,), "Mqtt"),
)
DNS_TYPES = {1: "A", 2: "NS", 5: "CNAME", 6: "SOA", 12: "PTR", 15: "MX", 16: "TXT", 28: "AAAA", 33: "SRV", 255: "ANY"}
RCODES = {0: "NOERROR", 1: "FORMERR", 2: "SERVFAIL", 3: "NXDOMAIN", 4: "NOTIMP", 5: "REFUSED"}
ICMP_TYPES = {0: "Echo Reply", 3: "Destination Unreachable", 4: "Source Quench", 5: "Redirect", 8: "Echo Request", 9: "Router Advertisement", 10: "Router Solicitation", 11: "Time Exceeded", 12: "Parameter Problem", 13: "Timestamp Request", 14: "Timestamp Reply"}


def is_internal(ip: Column) -> Column:
    """Whether an address begins with one of PRIVATE, as one expression."""
    return ip.rlike(PRIVATE_PATTERN)


def is_external(ip: Column) -> Column:
    return ~is_internal(ip)


def _is_v4(ip: Column) -> Column:
    return ip.rlike(r"^\d+\.\d+\.\d+\.\d+$")


def _v4_number(ip: Column) -> Column:
    return reduce(lambda a, b: a * 256 + b, (F.split_part(ip, F.lit("."), F.lit(k)).try_cast("long") for k in range(1, 5)))


def _let(value: Column, then) -> Column:
    """then(value), with value worked out once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _v6_digits(ip: Column) -> Column:
    """The 32 hexadecimal digits of an IPv6 address: `::` filled up, a dotted end as two groups, a zone dropped."""
    dotted = r"\d+\.\d+\.\d+\.\d+$"
    number = lambda t: F.lpad(F.hex(_v4_number(F.regexp_substr(t, F.lit(dotted)))), 8, "0")
    spelled = lambda t: F.when(F.contains(t, F.lit(".")), F.concat(F.regexp_replace(t, dotted, ""), F.regexp_replace(number(t), "(....)$", ":$1"))).otherwise(t)
    groups = lambda part: F.transform(F.filter(F.split(part, ":"), lambda g: g != ""), lambda g: F.lpad(g, 4, "0"))
    sides = _let(spelled(F.split_part(F.lower(ip), F.lit("%"), F.lit(1))), lambda t: F.struct(groups(F.split_part(t, F.lit("::"), F.lit(1))).alias("l"), groups(F.split_part(t, F.lit("::"), F.lit(2))).alias("r")))
    filled = lambda x: F.concat(x["l"], F.array_repeat(F.lit("0000"), F.greatest(8 - F.size(x["l"]) - F.size(x["r"]), F.lit(0))), x["r"])
    return F.array_join(_let(sides, filled), "")


def ip_key(ip: Column) -> Column:
    """An address as bytes that sort as addresses do: 04 and 4 bytes, or 06 and 16 bytes; spellings don't matter."""
    v4 = F.concat(F.lit("04"), F.lpad(F.hex(_v4_number(ip)), 8, "0"))
    return F.unhex(F.when(_is_v4(ip), v4).otherwise(F.concat(F.lit("06"), _v6_digits(ip))))


def address_text(ip: Column, key: Column) -> Column:
    """One spelling of an address with its ip_key: IPv4 as it is, IPv6 as 32 hexadecimal digits."""
    return F.when(F.octet_length(key) == 5, ip).otherwise(F.lower(F.substring(F.hex(key), 3, 32)))


def canonical(src_ip: str = "src_ip", src_port: str = "src_port", dst_ip: str = "dst_ip", dst_port: str = "dst_port") -> Column:
    """struct(lo_ip, lo_port, hi_ip, hi_port, forward): the lower endpoint first; forward if the source is the lower."""
    a = F.struct(ip_key(F.col(src_ip)), F.col(src_port))
    b = F.struct(ip_key(F.col(dst_ip)), F.col(dst_port))
    fwd = a <= b
    pick = lambda x, y: F.when(fwd, F.col(x)).otherwise(F.col(y))
    return F.struct(pick(src_ip, dst_ip).alias("lo_ip"), pick(src_port, dst_port).alias("lo_port"), pick(dst_ip, src_ip).alias("hi_ip"), pick(dst_port, src_port).alias("hi_port"), fwd.alias("forward"))


def application(transport: Column, src_port: Column, dst_port: Column) -> Column:
    """The application by the smaller port; null where unknown."""
    port, out = F.least(src_port, dst_port), F.when(transport == "icmp", F.lit("Icmp"))
    for kind, ports, name in PORTS:
        out = out.when((transport == kind) & port.isin(*ports), F.lit(name))
    return out


def root_domain(name: Column) -> Column:
    """The last two labels, without a closing dot."""
    return F.substring_index(F.regexp_replace(name, r"\.+$", ""), ".", -2)


def host_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^[a-z]+://([^/:?#]+)", 1)


def looks_generated(domain: Column) -> Column:
    """The first of at least two labels is long and has no lower-case vowels, too few of them, or many digits."""
    label = F.substring_index(domain, ".", 1)
    vowels, consonants, digits = (F.regexp_count(label, F.lit(p)) for p in ("[aeiou]", "[bcdfghjklmnpqrstvwxyz]", "[0-9]"))
    size = F.octet_length(label)
    odd = (vowels == 0) | (consonants > 5 * vowels) | (digits >= F.floor(size / 2))
    return F.contains(domain, F.lit(".")) & (size >= 8) & odd


def readable_bytes(n: Column) -> Column:
    out = F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B")))
    for power, unit in ((1, "KB"), (2, "MB")):
        out = out.when(n < 1024 ** (power + 1), F.concat(F.format_string("%.1f", n / 1024**power), F.lit(f" {unit}")))
    return out.otherwise(F.concat(F.format_string("%.1f", n / 1024**3), F.lit(" GB")))


#: TCP flags by name (fixed values).
TCP_FLAGS = {"FIN": 1, "SYN": 2, "RST": 4, "PSH": 8, "ACK": 16, "URG": 32, "ECE": 64, "CWR": 128}


def flag_set(flags: Column, name: str) -> Column:
    return flags.bitwiseAND(F.lit(TCP_FLAGS[name])) != 0


def is_syn_only(flags: Column) -> Column:
    return flag_set(flags, "SYN") & ~flag_set(flags, "ACK")


def is_syn_ack(flags: Column) -> Column:
    return flag_set(flags, "SYN") & flag_set(flags, "ACK")


def seq_before(a: Column, b: Column) -> Column:
    """Whether a TCP sequence number comes before another, modulo 2 ** 32."""
    return F.pmod(a - b, F.lit(1 << 32)) >= (1 << 31)


def without_grease(values: Column) -> Column:
    return F.filter(values, lambda v: v.bitwiseAND(F.lit(0x0F0F)) != 0x0A0A)


def masked(secret: Column) -> Column:
    """First and last four characters; up to eight characters are masked whole."""
    return F.when(F.char_length(secret) <= 8, F.lit("****")).otherwise(F.concat(F.substring(secret, 1, 4), F.lit("..."), F.right(secret, F.lit(4))))


def named(value: Column, names: dict[int, str], other: str = "UNKNOWN") -> Column:
    table = F.create_map(*[x for k, v in names.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.try_element_at(table, value.cast("int")), F.lit(other))
