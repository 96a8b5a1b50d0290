"""Dissection: packet bytes to an ordered table of layers, in Arrow batches.

    dissect(packets)                       # adds layers and dissect_error
    dissect(packets, max_depth=3)          # stops at the transport layer

Layers carry offsets and lengths only; fields are read from the bytes by expressions when
they are asked for (flowlake.functions.fields), through the accessors below.

Protocols are a dictionary of parse functions.  `Registry` adds functions for a parent and
a code; they run after the built-in children.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlake.functions import fields

LAYERS = "array<struct<protocol:string,offset:int,len:int>>"
ERROR = "struct<kind:string,protocol:string,offset:int,needed:int,available:int>"


class Failure(Exception):
    """kind: Truncated, Malformed or UnsupportedLinkType."""

    def __init__(self, kind: str, protocol: str, offset: int = 0, needed: int = 0, available: int = 0):
        super().__init__(f"{kind}: {protocol} at {offset}")
        self.kind, self.protocol, self.offset, self.needed, self.available = kind, protocol, offset, needed, available


class Layer(NamedTuple):
    protocol: str
    offset: int
    len: int


class Registry:
    """Parse functions of the caller's by (parent protocol, code): parse(ctx, offset) like the built-in ones."""

    def __init__(self):
        self.parsers: dict[tuple[str, int], Callable[[Context, int], None]] = {}

    def register(self, parent: str, code: int, parse: Callable[[Context, int], None]) -> Registry:
        self.parsers[parent, code] = parse
        return self


class Context:
    """What a parse function works with."""

    def __init__(self, data: bytes, registry: Registry | None = None, max_depth: int | None = None, fallback: bool = True):
        self.data, self.registry, self.max_depth, self.fallback = data, registry, max_depth, fallback
        self.layers: list[Layer] = []

    def u(self, at: int, width: int) -> int:
        return int.from_bytes(self.data[at : at + width], "big")

    def require(self, protocol: str, offset: int, needed: int) -> None:
        have = max(0, len(self.data) - offset)
        if have < needed:
            raise Failure("Truncated", protocol, offset, needed, have)

    def can_push(self) -> bool:
        return self.max_depth is None or len(self.layers) < self.max_depth

    def push_layer(self, protocol: str, offset: int, size: int) -> bool:
        if self.can_push():
            self.layers.append(Layer(protocol, offset, size))
            return True
        return False

    def parse_raw(self, offset: int) -> None:
        """The bytes from offset as Raw, if there are any and they aren't the last layer already.  Not bound by the depth limit."""
        size = len(self.data) - offset
        if size > 0 and (not self.layers or self.layers[-1] != Layer("Raw", offset, size)):
            self.layers.append(Layer("Raw", offset, size))

    def parse_child(self, parse: Callable[[Context, int], None] | str | None, offset: int) -> None:
        """Raw where the depth limit is reached; a child that fails leaves Raw in its place, unless fallback is off."""
        if parse is None or not self.can_push():
            self.parse_raw(offset)
            return
        kept = len(self.layers)
        try:
            (PARSERS[parse] if isinstance(parse, str) else parse)(self, offset)
        except Failure:
            if not self.fallback:
                raise
            del self.layers[kept:]
            self.parse_raw(offset)

    def custom(self, parent: str, *codes: int):
        """The first registered parser of the parent for one of the codes."""
        if self.registry:
            for c in codes:
                if (parent, c) in self.registry.parsers:
                    return self.registry.parsers[parent, c]
        return None


# Protocols.  Each pushes its layer and hands on to a child.

NETWORK = {0x0800: "Ipv4", 0x0806: "Arp", 0x86DD: "Ipv6", 0x8847: "Mpls", 0x8848: "Mpls"}


def _eth(ctx: Context, at: int) -> None:
    ctx.require("Eth", at, 14)
    if ctx.push_layer("Eth", at, 14):
        kind = ctx.u(at + 12, 2)
        child = NETWORK.get(kind) or ("Vlan" if kind == 0x8100 else "Llc" if kind <= 1500 else ctx.custom("Eth", kind))
        ctx.parse_child(child, at + 14)


def _vlan(ctx: Context, at: int) -> None:
    ctx.require("Vlan", at, 4)
    if ctx.push_layer("Vlan", at, 4):
        kind = ctx.u(at + 2, 2)
        ctx.parse_child(NETWORK.get(kind) or ("Llc" if kind <= 1500 else ctx.custom("Vlan", kind)), at + 4)


def _llc(ctx: Context, at: int) -> None:
    """Only SNAP is a layer; other frames have neither a layer nor Raw."""
    ctx.require("Llc", at, 3)
    one = ctx.data[at + 2] & 3 == 3
    if one and ctx.data[at] == ctx.data[at + 1] == 0xAA:
        ctx.require("Llc", at, 8)
        if ctx.push_layer("Llc", at, 8):
            ctx.parse_child(NETWORK.get(ctx.u(at + 6, 2)), at + 8)


def _sll(ctx: Context, at: int) -> None:
    ctx.require("Sll", at, 16)
    if ctx.push_layer("Sll", at, 16):
        kind = ctx.u(at + 14, 2)
        ctx.parse_child((NETWORK.get(kind) or ctx.custom("Sll", kind)) if ctx.u(at + 2, 2) == 1 else None, at + 16)


def _by_nibble(ctx: Context, at: int) -> str | None:
    return {4: "Ipv4", 6: "Ipv6"}.get(ctx.data[at] >> 4) if at < len(ctx.data) else None


def _mpls(ctx: Context, at: int) -> None:
    size = 0
    while True:
        ctx.require("Mpls", at, size + 4)
        size += 4
        if ctx.data[at + size - 2] & 1:
            break
    if ctx.push_layer("Mpls", at, size):
        ctx.parse_child(_by_nibble(ctx, at + size), at + size)


def _gre(ctx: Context, at: int) -> None:
    ctx.require("Gre", at, 4)
    flags = ctx.u(at, 2)
    size = 4 + 4 * sum(bool(flags & f) for f in (0x8000, 0x2000, 0x1000))
    ctx.require("Gre", at, size)
    if ctx.push_layer("Gre", at, size):
        kind = ctx.u(at + 2, 2)
        ctx.parse_child({0x0800: "Ipv4", 0x86DD: "Ipv6"}.get(kind) or ctx.custom("Gre", kind), at + size)


def _vxlan(ctx: Context, at: int) -> None:
    ctx.require("Vxlan", at, 8)
    if ctx.push_layer("Vxlan", at, 8):
        ctx.parse_child("Eth", at + 8)


def _arp(ctx: Context, at: int) -> None:
    ctx.require("Arp", at, 8)
    size = 8 + 2 * (ctx.data[at + 4] + ctx.data[at + 5])
    ctx.require("Arp", at, size)
    ctx.push_layer("Arp", at, size)


OVER_IPV4 = {1: "Icmp", 2: "Igmp", 6: "Tcp", 17: "Udp", 47: "Gre", 132: "Sctp"}
OVER_IPV6 = {6: "Tcp", 17: "Udp", 47: "Gre", 58: "Icmpv6", 132: "Sctp"}


def _ipv4(ctx: Context, at: int) -> None:
    ctx.require("Ipv4", at, 20)
    size = (ctx.data[at] & 15) * 4
    if size < 20:
        raise Failure("Malformed", "Ipv4", at)
    ctx.require("Ipv4", at, size)
    if ctx.push_layer("Ipv4", at, size):
        proto = ctx.data[at + 9]
        fragment = ctx.u(at + 6, 2) & 0x1FFF
        ctx.parse_child(None if fragment else OVER_IPV4.get(proto) or ctx.custom("Ipv4", proto), at + size)


def _ipv6(ctx: Context, at: int) -> None:
    ctx.require("Ipv6", at, 40)
    if not ctx.push_layer("Ipv6", at, 40):
        return
    proto, here = ctx.data[at + 6], at + 40
    while proto in (0, 43, 44, 51, 60):
        ctx.require("Ipv6", here, 8)
        following = ctx.data[here]
        if proto == 44:
            size, later = 8, ctx.u(here + 2, 2) & 0xFFF8
        else:
            size, later = ((ctx.data[here + 1] + 2) * 4 if proto == 51 else (ctx.data[here + 1] + 1) * 8), 0
        ctx.require("Ipv6", here, size)
        here += size
        proto = following
        if later:
            ctx.parse_raw(here)
            return
    ctx.parse_child(None if proto == 50 else OVER_IPV6.get(proto) or ctx.custom("Ipv6", proto), here)


# Ports that decide about a child.
TLS_PORTS = frozenset((443, 465, 636, 853, 990, 993, 995, 8443))
UDP_PORTS = ((53, "Dns"), (67, "Dhcp"), (68, "Dhcp"), (123, "Ntp"))


def _tcp(ctx: Context, at: int) -> None:
    ctx.require("Tcp", at, 20)
    size = (ctx.data[at + 12] >> 4) * 4
    if size < 20:
        raise Failure("Malformed", "Tcp", at)
    ctx.require("Tcp", at, size)
    if ctx.push_layer("Tcp", at, size):
        src, dst = ctx.u(at, 2), ctx.u(at + 2, 2)
        here = at + size
        tls = (src in TLS_PORTS or dst in TLS_PORTS) and _looks_like_tls(ctx, here)
        ctx.parse_child("Tls" if tls else ctx.custom("Tcp", dst, src), here)


def _looks_like_tls(ctx: Context, at: int) -> bool:
    d = ctx.data
    return len(d) >= at + 5 and 20 <= d[at] <= 24 and d[at + 1] == 3 and d[at + 2] <= 4


def _udp(ctx: Context, at: int) -> None:
    ctx.require("Udp", at, 8)
    if ctx.push_layer("Udp", at, 8):
        src, dst = ctx.u(at, 2), ctx.u(at + 2, 2)
        child = next((p for port, p in UDP_PORTS if port in (src, dst)), None) or ("Vxlan" if dst == 4789 else ctx.custom("Udp", dst, src))
        ctx.parse_child(child, at + 8)


def _leaf(protocol: str, needed: int, size: int | None = None) -> Callable[[Context, int], None]:
    """A protocol without children; without a size it takes the rest."""

    def parse(ctx: Context, at: int) -> None:
        ctx.require(protocol, at, needed)
        ctx.push_layer(protocol, at, len(ctx.data) - at if size is None else size)

    return parse


def _tls(ctx: Context, at: int) -> None:
    ctx.require("Tls", at, 5)
    size = 5 + ctx.u(at + 3, 2)
    ctx.require("Tls", at, size)
    ctx.push_layer("Tls", at, size)


PARSERS: dict[str, Callable[[Context, int], None]] = {
    "Eth": _eth,
    "Vlan": _vlan,
    "Llc": _llc,
    "Sll": _sll,
    "Mpls": _mpls,
    "Gre": _gre,
    "Vxlan": _vxlan,
    "Arp": _arp,
    "Ipv4": _ipv4,
    "Ipv6": _ipv6,
    "Tcp": _tcp,
    "Udp": _udp,
    "Sctp": _leaf("Sctp", 12),
    "Icmp": _leaf("Icmp", 8),
    "Icmpv6": _leaf("Icmpv6", 4),
    "Igmp": _leaf("Igmp", 8, 8),
    "Dhcp": _leaf("Dhcp", 240),
    "Dns": _leaf("Dns", 12),
    "Ntp": _leaf("Ntp", 48),
    "Tls": _tls,
    "Raw": lambda ctx, at: ctx.parse_raw(at),
}

LINKS = {1: "Eth", 113: "Sll", 228: "Ipv4", 229: "Ipv6"}


def parse(data: bytes, root: str | None = None, link_type: int | None = 1, registry: Registry | None = None, max_depth: int | None = None, fallback: bool = True) -> tuple[list[Layer], Failure | None]:
    """Layers of one packet, and what ended the parse; layers found before a failure are kept."""
    ctx = Context(data, registry, max_depth, fallback)
    try:
        if max_depth == 0:
            return [], None
        if root is None:
            if link_type == 101:
                root = _by_nibble(ctx, 0) or "Raw"
            elif link_type in LINKS:
                root = LINKS[link_type]
            else:
                raise Failure("UnsupportedLinkType", str(link_type))
        PARSERS[root](ctx, 0)
    except Failure as e:
        return ctx.layers, e
    return ctx.layers, None


NAMES = tuple(PARSERS)
CODES = {n: i for i, n in enumerate(NAMES)}


class Common(NamedTuple):
    """Layers of a batch's usual packets, found on whole columns: Ethernet, whole IPv4, TCP or UDP, then DNS, Raw or nothing.

    rows: which packets these are; starts and sizes: of the IPv4, transport and last layers.
    """

    rows: np.ndarray
    transport: np.ndarray
    transport_at: np.ndarray
    rest_at: np.ndarray
    rest: np.ndarray
    last: np.ndarray


def common(data: pa.Array, link: np.ndarray, max_depth: int | None) -> Common:
    """What parse() gives without a registry and with fallback, for the packets whose layers follow from a few bytes."""
    data = data.cast(pa.large_binary())
    ends = np.frombuffer(data.buffers()[1], np.int64)[data.offset : data.offset + len(data) + 1]
    buf = np.concatenate([np.frombuffer(data.buffers()[2] or b"", np.uint8), np.zeros(64, np.uint8)])
    size = np.diff(ends)
    rows = np.flatnonzero((link == 1) & (size >= 34))
    start, size = ends[:-1][rows], size[rows]
    byte = lambda at: buf[np.minimum(start + at, len(buf) - 1)].astype(np.int64)
    word = lambda at: byte(at) << 8 | byte(at + 1)
    at = 14 + 4 * (byte(14) & 15)
    proto = byte(23)
    good = (word(12) == 0x0800) & (at >= 34) & (word(20) & 0x1FFF == 0) & ((proto == 6) | (proto == 17))
    tcp = proto == 6
    header = np.where(tcp, 4 * (byte(at + 12) >> 4), 8)
    good &= (size >= at + np.where(tcp, 20, 8)) & (header >= np.where(tcp, 20, 8)) & (size >= at + header)
    src, dst = word(at), word(at + 2)
    rest_at = at + header
    rest = size - rest_at
    has = lambda ports: np.isin(src, ports) | np.isin(dst, ports)
    deep = max_depth is None or max_depth > 3
    tls = tcp & has([*TLS_PORTS]) & (rest >= 5) & (byte(rest_at) >= 20) & (byte(rest_at) <= 24) & (byte(rest_at + 1) == 3) & (byte(rest_at + 2) <= 4)
    other = ~tcp & ((dst == 4789) | has([p for p, n in UDP_PORTS if n != "Dns"]))
    if deep:
        good &= ~tls & ~other
    dns = ~tcp & has([53]) & (rest >= 12) & deep
    last = np.where(dns, CODES["Dns"], CODES["Raw"])
    return Common(*(x[good] for x in (rows, np.where(tcp, CODES["Tcp"], CODES["Udp"]), at, rest_at, rest, last)))


def dissect(packets: DataFrame, root: str | None = None, registry: Registry | None = None, max_depth: int | None = None, fallback: bool = True) -> DataFrame:
    """Adds layers and dissect_error (null where the whole packet was parsed); packets: data, link_type (unless root is given).

    Usual packets are taken on whole columns, the others one by one.
    """
    columns = packets.columns
    whole = root is None and not (registry and registry.parsers) and fallback and (max_depth is None or max_depth >= 3)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        error = pa.struct([("kind", pa.string()), ("protocol", pa.string()), ("offset", pa.int32()), ("needed", pa.int32()), ("available", pa.int32())])
        for batch in it:
            n, data = batch.num_rows, batch.column("data")
            found, errors = [None] * n, [None] * n
            count = np.zeros(n, np.int64)
            easy = None
            if whole and n and pa.types.is_binary(data.type):
                link = batch.column("link_type").fill_null(-1).to_numpy(zero_copy_only=False)
                easy = common(data.fill_null(b""), link, max_depth)
                count[easy.rows] = 3 + (easy.rest > 0)
            for i in np.flatnonzero(count == 0).tolist():
                layers, e = parse(data[i].as_py() or b"", root, batch.column("link_type")[i].as_py() if root is None else None, registry, max_depth, fallback)
                found[i], count[i] = layers, len(layers)
                errors[i] = e and {"kind": e.kind, "protocol": e.protocol, "offset": e.offset, "needed": e.needed, "available": e.available}
            ends = np.concatenate([[0], np.cumsum(count)])
            names, offsets, sizes = (np.empty(ends[-1], t) for t in (object, np.int32, np.int32))
            if easy is not None and len(easy.rows):
                first = ends[:-1][easy.rows]
                known = np.array(NAMES, object)
                zero = np.zeros(len(first), np.int64)
                for k, (name, at, size) in enumerate(((np.full(len(first), CODES["Eth"]), zero, zero + 14), (np.full(len(first), CODES["Ipv4"]), zero + 14, easy.transport_at - 14), (easy.transport, easy.transport_at, easy.rest_at - easy.transport_at))):
                    names[first + k], offsets[first + k], sizes[first + k] = known[name], at, size
                more = easy.rest > 0
                names[first[more] + 3], offsets[first[more] + 3], sizes[first[more] + 3] = known[easy.last[more]], easy.rest_at[more], easy.rest[more]
            for i, layers in enumerate(found):
                for k, layer in enumerate(layers or ()):
                    names[ends[i] + k], offsets[ends[i] + k], sizes[ends[i] + k] = layer
            items = pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(offsets), pa.array(sizes)], ["protocol", "offset", "len"])
            layers = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), items)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in columns], layers, pa.array(errors, error)], [*columns, "layers", "dissect_error"])

    kind = ", ".join(f"`{n}` {t}" for n, t in packets.dtypes)
    return packets.mapInArrow(run, f"{kind}, layers {LAYERS}, dissect_error {ERROR}")


# Accessors of dissected rows.


def nth_layer(protocol: str, n: int = 0) -> Column:
    """The n-th latest layer of a protocol: 0 is the innermost."""
    return F.try_element_at(F.filter("layers", lambda x: x["protocol"] == protocol), F.lit(-(n + 1)))


def layer_bytes(protocol: str, n: int = 0) -> Column:
    at = nth_layer(protocol, n)
    return F.when(at.isNotNull(), F.substring(F.col("data"), at["offset"] + 1, at["len"]))


def field(name: str, n: int = 0) -> Column:
    return fields.read(layer_bytes(name.split(".")[0], n), name)


def view(protocol: str, n: int = 0) -> Column:
    return fields.view(layer_bytes(protocol, n), protocol)


def with_field(name: str, value: Column, n: int = 0) -> Column:
    """The packet's bytes with one field of a layer replaced; unchanged without the layer."""
    protocol = name.split(".")[0]
    at = nth_layer(protocol, n)
    d = F.col("data")
    new = F.concat(F.substring(d, F.lit(1), at["offset"]), fields.write(layer_bytes(protocol, n), name, value), fields.rest(d, at["offset"] + at["len"]))
    return F.when(at.isNotNull(), new).otherwise(d)


def display() -> Column:
    """Layers joined by ' | ', each by name with what identifies it; codes by name where they have one."""
    return F.concat_ws(" | ", F.transform("layers", lambda x: fields.bind(F.substring(F.col("data"), x["offset"] + 1, x["len"]), lambda h: _line(x["protocol"], h))))


def _line(protocol: Column, h: Column) -> Column:
    from flowlake.functions import codes
    from flowlake.functions.net import address_text, ipv4_text, mac_text

    r = lambda name: fields.read(h, name)
    text = lambda c: c.cast("string")
    named = lambda name, table: F.coalesce(codes.name_of(r(name), table), text(r(name)))
    pad = lambda c, n: F.rpad(text(c), F.greatest(F.length(text(c)), F.lit(n)), F.lit(" "))
    size = F.concat(text(F.length(h)), F.lit(" bytes"))
    hexed = lambda c, n: F.concat(F.lit("0x"), F.lower(F.lpad(F.hex(c), n, "0")))

    def ends(p: str) -> list:
        return [pad(r(f"{p}.src_port"), 5), F.lit(" -> "), pad(r(f"{p}.dst_port"), 5)]

    lines = {
        "Eth": [mac_text(r("Eth.dst")), F.lit(" -> "), mac_text(r("Eth.src"))],
        "Vlan": [text(r("Vlan.vid"))],
        "Sll": [named("Sll.packet_type", codes.SLL_PACKET), F.lit(" "), named("Sll.arphrd_type", codes.ARPHRD), F.lit(" "), F.hex(F.substring(r("Sll.link_layer_addr"), F.lit(1), F.least(r("Sll.link_layer_addr_len"), F.lit(8)).cast("int")))],
        "Mpls": [F.lit("label "), text(F.shiftright(fields.u(h, 0, 4), 12))],
        "Gre": [named("Gre.protocol_type", codes.ETH_TYPE), F.lit(" "), hexed(r("Gre.flags"), 4)],
        "Vxlan": [F.lit("vni "), text(r("Vxlan.vni_id"))],
        "Arp": [named("Arp.operation", codes.ARP_OPERATION), F.when(r("Arp.is_ethernet_ipv4"), F.concat(F.lit(" "), ipv4_text(r("Arp.sender_protocol_addr")), F.lit(" -> "), ipv4_text(r("Arp.target_protocol_addr")))).otherwise("")],
        "Ipv4": [pad(ipv4_text(r("Ipv4.src")), 15), F.lit(" -> "), pad(ipv4_text(r("Ipv4.dst")), 15), F.lit(" "), pad(r("Ipv4.total_length"), 4)],
        "Ipv6": [pad(address_text(r("Ipv6.src")), 39), F.lit(" -> "), pad(address_text(r("Ipv6.dst")), 39), F.lit(" "), pad(r("Ipv6.payload_length"), 5)],
        "Tcp": [*ends("Tcp"), F.lit(" "), codes.tcp_flags_text(r("Tcp.flags"))],
        "Udp": ends("Udp"),
        "Sctp": ends("Sctp"),
        "Icmp": [named("Icmp.message_type", codes.ICMP_TYPE), F.lit(" code "), text(r("Icmp.code"))],
        "Icmpv6": [named("Icmpv6.message_type", codes.ICMPV6_TYPE), F.lit(" code "), text(r("Icmpv6.code"))],
        "Igmp": [named("Igmp.message_type", codes.IGMP_TYPE), F.lit(" "), ipv4_text(r("Igmp.group_addr"))],
        "Dhcp": [named("Dhcp.op", codes.DHCP_OP), F.lit(" xid "), hexed(r("Dhcp.xid"), 8), F.lit(" "), ipv4_text(r("Dhcp.yiaddr"))],
        "Dns": [F.lit("id "), text(r("Dns.id")), F.lit(" "), named("Dns.opcode", codes.DNS_OPCODE), F.lit(" qd "), text(r("Dns.qdcount")), F.lit(" an "), text(r("Dns.ancount"))],
        "Ntp": [F.lit("v"), text(r("Ntp.version")), F.lit(" "), named("Ntp.mode", codes.NTP_MODE), F.lit(" stratum "), text(r("Ntp.stratum"))],
        "Tls": [named("Tls.content_type", codes.TLS_CONTENT), F.coalesce(F.concat(F.lit(" "), F.coalesce(codes.name_of(r("Tls.handshake_type"), codes.TLS_HANDSHAKE), text(r("Tls.handshake_type")))), F.lit("")), F.lit(" v"), hexed(r("Tls.legacy_version"), 4), F.lit(" len "), text(r("Tls.length"))],
    }
    chosen = F.coalesce(*[F.when(protocol == k, F.concat(*v)) for k, v in lines.items()], size)
    return F.concat(F.lit("["), protocol, F.lit("] "), chosen)


# Projections.


def metadata(dissected: DataFrame, *more: Column) -> DataFrame:
    """One row of report columns for each packet, and the columns in more: nulls where a packet has no such layer.

    IPv4 counts before IPv6 and TCP before UDP where a packet has both.
    """
    v4, v6 = nth_layer("Ipv4").isNotNull(), nth_layer("Ipv6").isNotNull()
    tcp, udp = nth_layer("Tcp").isNotNull(), nth_layer("Udp").isNotNull()
    f = lambda name: field(name)
    keep = [c for c in ("path", "frame_no", "ts_ns", "orig_len") if c in dissected.columns]
    from flowlake.functions.fields import to_bytes

    return dissected.select(
        *keep,
        F.coalesce(f("Eth.eth_type"), f("Sll.protocol_type")).alias("eth_type"),
        F.when(v4, to_bytes(f("Ipv4.src"), 4)).otherwise(f("Ipv6.src")).alias("src_addr"),
        F.when(v4, to_bytes(f("Ipv4.dst"), 4)).otherwise(f("Ipv6.dst")).alias("dst_addr"),
        F.when(tcp, 6).when(udp, 17).when(v4, f("Ipv4.protocol")).otherwise(f("Ipv6.next_header")).cast("bigint").alias("ip_proto"),
        F.when(v4, f("Ipv4.tos")).otherwise(f("Ipv6.traffic_class")).alias("tos"),
        F.when(v4, f("Ipv4.ttl")).otherwise(f("Ipv6.hop_limit")).alias("ttl"),
        f("Ipv4.total_length").alias("total_length"),
        F.when(tcp, f("Tcp.src_port")).otherwise(f("Udp.src_port")).alias("src_port"),
        F.when(tcp, f("Tcp.dst_port")).otherwise(f("Udp.dst_port")).alias("dst_port"),
        f("Tcp.flags").alias("tcp_flags"),
        f("Tcp.window_size").alias("tcp_window"),
        f("Tcp.data_offset").alias("tcp_data_offset"),
        F.when(~tcp, f("Udp.length")).alias("udp_length"),
        F.when(~v4 & v6, f("Ipv6.payload_length")).alias("ipv6_payload_length"),
        F.when(v4, f("Ipv4.total_length")).when(v6, f("Ipv6.payload_length") + 40).alias("l3_len"),
        ((F.length("data") > 0) & F.col("dissect_error").isNull()).alias("parsed"),
        (F.length("data") == 0).alias("empty"),
        *(["error"] if "error" in dissected.columns else []),
        *more,
    )


def dump(meta: DataFrame, numeric_ip: bool = False) -> DataFrame:
    """The export's columns in order: what is missing is 0, except for addresses."""
    from flowlake.functions.net import address_text

    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    number = lambda c, n: F.when(F.length(c) == n, F.conv(F.hex(c), 16, 10).cast("bigint") if n == 4 else F.col(c))
    more = [number(f"{s}_addr", n).alias(f"{s}_ip{v}") for v, n in ((4, 4), (6, 16)) for s in ("src", "dst")] if numeric_ip else []
    return meta.select(F.col("ts_ns").alias("timestamp"), F.col("orig_len").alias("length"), zero("eth_type"), address_text(F.col("src_addr")).alias("src_ip"), address_text(F.col("dst_addr")).alias("dst_ip"), *[zero(c) for c in ("ip_proto", "tos", "ttl", "total_length", "src_port", "dst_port", "tcp_flags", "tcp_window", "tcp_data_offset", "udp_length", "ipv6_payload_length")], *more)


def flow_packets(dissected: DataFrame) -> DataFrame:
    """TCP and UDP packets for the flow features: the last transport layer and the IP layer right around it.

    path, frame_no, ts_ns, src_addr, dst_addr (bytes), src_port, dst_port, proto, payload, header_len, tcp_flags, window.
    """
    at = F.col("_at")
    rows = dissected.select("*", F.expr("aggregate(sequence(1, size(layers)), 0, (a, i) -> if(layers[i - 1].protocol in ('Tcp', 'Udp'), i, a))").alias("_at")).where("size(layers) > 0 and _at > 0")
    rows = rows.withColumn("_ip", F.expr("aggregate(sequence(1, _at), 0, (a, i) -> if(layers[i - 1].protocol in ('Ipv4', 'Ipv6'), i, a))")).where("_ip > 0")
    rows = rows.select("*", F.get("layers", at - 1).alias("_t"), F.get("layers", F.col("_ip") - 1).alias("_n"))
    cut = lambda x, n=None: F.substring(F.col("data"), x["offset"] + 1, x["len"] if n is None else F.lit(n))
    t, ip = cut(F.col("_t")), cut(F.col("_n"))
    tcp, v4 = F.col("_t.protocol") == "Tcp", F.col("_n.protocol") == "Ipv4"
    end = F.when(v4, F.col("_n.offset") + fields.read(ip, "Ipv4.total_length")).otherwise(F.col("_n.offset") + 40 + fields.read(ip, "Ipv6.payload_length"))
    tcp_body = F.least(end, F.length("data").cast("bigint")) - (F.col("_t.offset") + F.col("_t.len"))
    udp_body = F.least(fields.read(t, "Udp.length"), end - F.col("_t.offset")) - 8
    from flowlake.functions.fields import to_bytes

    return rows.select(
        *[c for c in ("path", "frame_no", "ts_ns", "orig_len") if c in dissected.columns],
        F.when(v4, to_bytes(fields.read(ip, "Ipv4.src"), 4)).otherwise(fields.read(ip, "Ipv6.src")).alias("src_addr"),
        F.when(v4, to_bytes(fields.read(ip, "Ipv4.dst"), 4)).otherwise(fields.read(ip, "Ipv6.dst")).alias("dst_addr"),
        F.when(tcp, fields.read(t, "Tcp.src_port")).otherwise(fields.read(t, "Udp.src_port")).alias("src_port"),
        F.when(tcp, fields.read(t, "Tcp.dst_port")).otherwise(fields.read(t, "Udp.dst_port")).alias("dst_port"),
        F.when(tcp, 6).otherwise(17).cast("bigint").alias("proto"),
        F.greatest(F.lit(0), F.when(tcp, tcp_body).otherwise(udp_body)).cast("bigint").alias("payload"),
        F.when(tcp, F.col("_t.len")).otherwise(8).cast("bigint").alias("header_len"),
        F.when(tcp, fields.read(t, "Tcp.flags")).otherwise(0).cast("bigint").alias("tcp_flags"),
        F.when(tcp, fields.read(t, "Tcp.window_size")).otherwise(0).cast("bigint").alias("window"),
    )


def split_packets(dissected: DataFrame) -> DataFrame:
    """IPv4 packets with the integer addresses, ports (0 where there are none) and protocol that splitting keys on."""
    #: Layers are looked for once and their headers cut once; the names stay apart, so that projections aren't merged.
    found = dissected.select("*", *[nth_layer(n).alias(f"_{n}") for n in ("Ipv4", "Tcp", "Udp")]).where("_Ipv4 is not null")
    cut = lambda n, size: F.substring(F.col("data"), F.col(f"_{n}.offset") + 1, F.least(F.col(f"_{n}.len"), F.lit(size)))
    rows = found.select(*dissected.columns, cut("Ipv4", 20).alias("_ip"), F.when(F.col("_Tcp").isNotNull(), cut("Tcp", 4)).otherwise(cut("Udp", 4)).alias("_ports"))
    #: TCP's and UDP's ports lie alike.
    port = lambda p: F.coalesce(fields.read(F.col("_ports"), f"Udp.{p}"), F.lit(0).cast("bigint"))
    ip = lambda n: fields.read(F.col("_ip"), f"Ipv4.{n}")
    return rows.select(*dissected.columns, ip("src").alias("src_ip"), ip("dst").alias("dst_ip"), port("src_port").alias("src_port"), port("dst_port").alias("dst_port"), ip("protocol").alias("proto"))
