"""Protocol names, endpoint keys, address classes and light payload parsing."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

TCP, UDP, ICMP, ICMP6 = 6, 17, 1, 58

# Names shown in reports.
IPV4_PROTOCOLS = {1: "ICMP", 6: "TCP", 17: "UDP"}
IPV6_PROTOCOLS = {58: "ICMPv6", 6: "TCP", 17: "UDP"}
ETHER_TYPES = {0x0800: "IPv4", 0x86DD: "IPv6", 0x0806: "ARP", 0x8847: "MPLS", 0x8100: "802.1Q"}
IP_PROTOCOLS = {
    1: "ICMP", 6: "TCP", 17: "UDP", 41: "ENCAP-IPv6", 47: "GRE", 50: "ESP", 51: "AH", 58: "ICMPv6",
}
# Service ports, first match wins after port 443.
SERVICE_PORTS = (
    ((80,), "HTTP"),
    ((53,), "DNS"),
    ((123,), "NTP"),
    ((22,), "SSH"),
    ((25, 587), "SMTP"),
    ((110, 995), "POP3"),
    ((143, 993), "IMAP"),
    ((3389,), "RDP"),
)
# Request words looked for at the start of a payload.
SNIFFED_METHODS = ("GET ", "POST", "HEAD", "PUT ")
PARSED_METHODS = ("GET ", "POST", "HEAD", "PUT ", "DELETE", "OPTIONS")
# Flag letters in bit order.
TCP_FLAG_LETTERS = "FSRPAUECN"


def _named(number: Column, names: dict[int, str], default: Column) -> Column:
    pairs = [F.lit(x) for kv in names.items() for x in kv]
    return F.coalesce(F.create_map(*pairs)[number.cast("int")], default)


def proto_name(ip_version: Column, number: Column) -> Column:
    text = F.coalesce(number.cast("string"), F.lit("None"))
    return (
        F.when(ip_version == "IPv4", _named(number, IPV4_PROTOCOLS, F.concat(F.lit("IPv4_"), text)))
        .when(ip_version == "IPv6", _named(number, IPV6_PROTOCOLS, F.concat(F.lit("IPv6_"), text)))
        .otherwise("UNKNOWN")
    )


def ether_type_name(number: Column) -> Column:
    return _named(number, ETHER_TYPES, F.concat(F.lit("0x"), F.lower(F.hex(number.cast("bigint")))))


def ip_protocol_name(number: Column) -> Column:
    return _named(number, IP_PROTOCOLS, number.cast("string"))


def endpoint(ip: str, port: str) -> Column:
    return F.struct(F.col(ip).alias("ip"), F.col(port).cast("int").alias("port"))


def bidir_key() -> list[Column]:
    """The order-free endpoint pair as four columns: address text first, then port."""
    a, b = endpoint("src", "sport"), endpoint("dst", "dport")
    low, high = F.least(a, b), F.greatest(a, b)
    return [
        low["ip"].alias("ip1"), low["port"].alias("port1"),
        high["ip"].alias("ip2"), high["port"].alias("port2"),
    ]


def directional_flow_label(proto_num: Column) -> Column:
    """Layer-4 part of a directional key; ``IP-n`` without ports, ``L2`` without addresses."""
    return (
        F.when(F.col("src").isNull() | F.col("dst").isNull(), "L2")
        .when(F.col("is_tcp"), "TCP")
        .when(F.col("is_udp"), "UDP")
        .otherwise(F.concat(F.lit("IP-"), proto_num.cast("string")))
    )


def app_protocol(is_udp: Column, sport: Column, dport: Column, payload: Column | None = None) -> Column:
    """Application guess by port on either side, then by the first payload bytes."""

    def uses(*ports: int) -> Column:
        hit = sport.isin(*ports) | dport.isin(*ports)
        return F.coalesce(hit, F.lit(False))

    out = F.when(uses(443) & is_udp, "QUIC/HTTP3").when(uses(443), "HTTPS")
    for ports, name in SERVICE_PORTS:
        out = out.when(uses(*ports), name)
    if payload is not None:
        head = F.substring(payload, 1, 4)
        out = out.when(head.isin(*[F.lit(m.encode()) for m in SNIFFED_METHODS]), "HTTP")
    return out.otherwise("UNKNOWN")


def payload_text(payload: Column) -> Column:
    """UTF-8 text of a payload without its undecodable bytes."""
    return F.replace(F.make_valid_utf8(payload.cast("string")), F.lit("�"), F.lit(""))


def _strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def http_method(text: Column) -> Column:
    first = _strip(F.split_part(text, F.lit("\r\n"), F.lit(1)))
    known = reduce(lambda a, b: a | b, [first.startswith(m) for m in PARSED_METHODS])
    return F.when(known, F.regexp_extract(first, r"^(\S+)", 1))


def http_host(text: Column) -> Column:
    """Value of the first host header among the 24 lines after the request line."""
    lines = F.slice(F.split(text, "\r\n"), 2, 24)
    hosts = F.filter(lines, lambda s: F.lower(s).startswith("host:"))
    value = F.try_element_at(hosts, F.lit(1))
    return _strip(F.substring(value, 6, 2147483647))


def quic_form(payload: Column) -> Column:
    """``LONG_HDR`` when the two top bits of a payload of at least 6 bytes are set."""
    first = F.conv(F.hex(F.substring(payload, 1, 1)), 16, 10).cast("int")
    return F.when((F.octet_length(payload) >= 6) & (first >= 0xC0), "LONG_HDR")


def dns_name(qname: Column) -> Column:
    return F.trim(qname, F.lit("."))


def dns_base_domain(qname: Column) -> Column:
    """Last two labels of a query name."""
    return F.substring_index(dns_name(qname), ".", -2)


_OCTET = r"(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_IPV4 = rf"^{_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET}$"

# Address blocks that are not globally routed, as text patterns.
PRIVATE_IPV4 = (
    r"^(?:0|10|127|24[0-9]|25[0-5])\.|^169\.254\.|^172\.(?:1[6-9]|2[0-9]|3[01])\.|^192\.168\."
    r"|^192\.0\.0\.(?!(?:9|10)$)|^192\.0\.2\.|^198\.1[89]\.|^198\.51\.100\.|^203\.0\.113\."
)
# The same for 128-bit addresses, as (first address, prefix length) of the blocks and of the routed parts in them.
PRIVATE_IPV6 = (
    ("00000000000000000000000000000001", 128), ("00000000000000000000000000000000", 128), ("0064ff9b000100000000000000000000", 48),
    ("01000000000000000000000000000000", 64), ("20010000000000000000000000000000", 23), ("20010db8000000000000000000000000", 32),
    ("20020000000000000000000000000000", 16), ("fc000000000000000000000000000000", 7),
    ("fe800000000000000000000000000000", 10),
)
ROUTED_IPV6 = (
    ("20010001000000000000000000000001", 128), ("20010001000000000000000000000002", 128), ("20010003000000000000000000000000", 32),
    ("20010004011200000000000000000000", 48), ("20010020000000000000000000000000", 28), ("20010030000000000000000000000000", 28),
)
_MAPPED = "0" * 20 + "ffff"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), body), 0)


def expanded_ipv6(ip: Column) -> Column:
    """A 128-bit address as 32 hexadecimal digits; null for text that is none."""
    none = F.array().cast("array<string>")

    def undotted(low: Column) -> Column:
        """A dotted end as the two groups it stands for."""
        dotted = F.regexp_extract(low, r":([0-9.]+)$", 1)
        tail = let(
            F.transform(F.split(dotted, r"\."), lambda o: F.lpad(F.hex(o.try_cast("bigint")), 2, "0")),
            lambda o: F.lower(F.concat(F.get(o, 0), F.get(o, 1), F.lit(":"), F.get(o, 2), F.get(o, 3))),
        )
        return F.when(~dotted.contains("."), low).when(dotted.rlike(_IPV4), F.concat(F.regexp_replace(low, r"[0-9.]+$", ""), tail))

    def groups(half: Column) -> Column:
        return F.when(half == "", none).otherwise(F.split(half, ":", -1))

    def joined(halves: Column, left: Column, right: Column) -> Column:
        told = F.size(left) + F.size(right)
        gap = F.array_repeat(F.lit("0"), F.greatest(8 - told, F.lit(0)))
        fits = ((F.size(halves) == 1) & (told == 8)) | ((F.size(halves) == 2) & (told <= 7))
        return F.when(fits, F.concat(left, F.when(F.size(halves) == 2, gap).otherwise(none), right))

    low = F.regexp_replace(F.lower(ip), "%[^%]+$", "")
    whole = let(
        F.split(let(low, undotted), "::", -1),
        lambda halves: let(
            groups(F.get(halves, 0)),
            lambda left: let(groups(F.coalesce(F.get(halves, 1), F.lit(""))), lambda right: joined(halves, left, right)),
        ),
    )
    return let(
        whole,
        lambda w: F.when(
            F.forall(w, lambda g: g.rlike("^[0-9a-f]{1,4}$")), F.array_join(F.transform(w, lambda g: F.lpad(g, 4, "0")), "")
        ),
    )


def _in_block(digits: Column, first: str, bits: int) -> Column:
    """Whether 32 digits lie in a block: its whole digits are equal, and the next one is in range."""
    whole, rest = divmod(bits, 4)
    found = digits.startswith(first[:whole])
    if rest:
        low = int(first[whole], 16)
        allowed = [f"{x:x}" for x in range(low, low + (1 << (4 - rest)))]
        found = found & F.substring(digits, whole + 1, 1).isin(*allowed)
    return found


def is_private_ip(ip: Column) -> Column:
    """Address outside the globally routed space; text that is no address gives false.

    An IPv4 address written as a 128-bit one is judged as what it is.
    """
    v4 = ip.rlike(_IPV4) & ip.rlike(PRIVATE_IPV4)

    def judge(digits: Column) -> Column:
        octets = [F.conv(F.substring(digits, k, 2), 16, 10) for k in (25, 27, 29, 31)]
        private, routed = (reduce(lambda a, b: a | b, (_in_block(digits, *x) for x in blocks)) for blocks in (PRIVATE_IPV6, ROUTED_IPV6))
        return F.when(digits.startswith(_MAPPED), F.concat_ws(".", *octets).rlike(PRIVATE_IPV4)).otherwise(private & ~routed)

    v6 = F.when(ip.contains(":"), let(expanded_ipv6(ip), judge))
    return F.coalesce(v4, F.lit(False)) | F.coalesce(v6, F.lit(False))


def tcp_segment_length(payload_len: Column, flags: Column) -> Column:
    """Sequence space a segment uses: its payload, or 1 for a bare SYN or FIN."""
    n = F.coalesce(payload_len, F.lit(0)).cast("bigint")
    syn_fin = F.coalesce(flags, F.lit(0)).bitwiseAND(3) != 0
    return F.when((n == 0) & syn_fin, F.lit(1).cast("bigint")).otherwise(n)


def tcp_flag_label(flags: Column) -> Column:
    return F.concat(
        *[
            F.when(flags.bitwiseAND(1 << i) != 0, letter).otherwise("")
            for i, letter in enumerate(TCP_FLAG_LETTERS)
        ]
    )


def epoch_micros(sec: Column, usec: Column, high: Column, low: Column, resolution: Column) -> Column:
    """Microseconds from seconds plus fraction, else from a 64-bit tick pair; invalid is 0.

    ``resolution`` is ticks per second and defaults to one million.
    """
    classic = sec.cast("bigint") * 1_000_000 + usec.cast("bigint")
    ticks = F.shiftleft(high.cast("bigint"), 32).bitwiseOR(low.cast("bigint"))
    per = F.coalesce(resolution.cast("bigint"), F.lit(1_000_000).cast("bigint"))
    whole = F.floor(ticks.cast("decimal(38,0)") * F.lit(1_000_000).cast("decimal(8,0)")
                    / F.when(per != 0, per).cast("decimal(20,0)"))
    return F.coalesce(
        F.when(sec.isNotNull() & usec.isNotNull(), classic)
        .when(high.isNotNull() & low.isNotNull(), whole.try_cast("bigint")),
        F.lit(0).cast("bigint"),
    )
