"""Protocol fields as Spark expressions over a layer's bytes.

A field is (offset, width, mask, shift, kind) and reads as a big-endian integer, a flag or
bytes, inside whole-stage codegen.  `read(h, "Tcp.src_port")` gives the column, `write`
gives the bytes with one field replaced, `view(h, "Tcp")` a struct of all fields.
A field that the bytes don't reach is null.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F


class Field(NamedTuple):
    offset: int
    width: int
    mask: int | None = None
    shift: int = 0
    kind: str = "int"  # int, bool, signed, wide (unsigned 64 bits as decimal), bytes

    def read(self, h: Column) -> Column:
        return F.when(F.length(h) >= self.offset + self.width, self._value(h))

    def _value(self, h: Column) -> Column:
        part = F.substring(h, self.offset + 1, self.width)
        if self.kind == "bytes":
            return part
        if self.kind == "wide":
            return F.conv(F.hex(part), 16, 10).cast("decimal(20,0)")
        value = unsigned(part)
        if self.mask is not None:
            value = value.bitwiseAND(F.lit(self.mask).cast("bigint"))
        if self.shift:
            value = F.shiftright(value, self.shift)
        if self.kind == "bool":
            return value != 0
        if self.kind == "signed":
            return F.when(value > 127, value - 256).otherwise(value)
        return value


def unsigned(part: Column) -> Column:
    """All bytes of a short binary column as one big-endian integer."""
    return F.conv(F.hex(part), 16, 10).cast("bigint")


def u(h: Column, offset: int | Column, width: int) -> Column:
    """Unsigned big-endian integer at an offset that may be a column; null where the bytes end before."""
    at = offset if isinstance(offset, Column) else F.lit(offset)
    return F.when(F.length(h) >= at + width, unsigned(F.substring(h, at + 1, F.lit(width))))


def bind(value: Column, body) -> Column:
    """body(value) with the value computed once; an expression that names a value many times doesn't grow with it."""
    return F.transform(F.array(value), body)[0]


def to_bytes(value: Column, width: int) -> Column:
    """The low bytes of an integer, big-endian."""
    low = value.cast("bigint") if width >= 8 else value.cast("bigint").bitwiseAND(F.lit((1 << 8 * width) - 1).cast("bigint"))
    return F.unhex(F.lpad(F.hex(low), F.lit(2 * width), F.lit("0")))


# Offset, width, mask, shift and kind of every fixed-offset field.
_TABLE = """
Eth.dst 0 6 bytes
Eth.src 6 6 bytes
Eth.eth_type 12 2
Vlan.tci 0 2
Vlan.pcp 0 1 e0 5
Vlan.dei 0 1 10 4 bool
Vlan.vid 0 2 0fff 0
Vlan.eth_type 2 2
Llc.dsap 0 1
Llc.ssap 1 1 fe 0
Llc.control_u 2 1
Llc.control_is 2 2
Llc.oui 3 3 bytes
Llc.protocol_id 6 2
Sll.packet_type 0 2
Sll.arphrd_type 2 2
Sll.link_layer_addr_len 4 2
Sll.link_layer_addr 6 8 bytes
Sll.protocol_type 14 2
MplsEntry.label 0 4 fffff000 12
MplsEntry.traffic_class 0 4 e00 9
MplsEntry.bottom_of_stack 0 4 100 8
MplsEntry.ttl 0 4 ff 0
Gre.flags 0 2 b000 0
Gre.version 0 2 7 0
Gre.protocol_type 2 2
Vxlan.flags 0 2
Vxlan.vni_is_valid 0 2 800 0 bool
Vxlan.reserved_1 2 2
Vxlan.vni 4 3 bytes
Vxlan.vni_id 4 3
Vxlan.reserved_2 7 1
Arp.hardware_type 0 2
Arp.protocol_type 2 2
Arp.hardware_len 4 1
Arp.protocol_len 5 1
Arp.operation 6 2
Arp.sender_hardware_addr 8 6 bytes
Arp.sender_protocol_addr 14 4
Arp.target_hardware_addr 18 6 bytes
Arp.target_protocol_addr 24 4
Ipv4.version 0 1 f0 4
Ipv4.ihl 0 1 0f 0
Ipv4.dscp 1 1 fc 2
Ipv4.ecn 1 1 03 0
Ipv4.tos 1 1
Ipv4.total_length 2 2
Ipv4.identification 4 2
Ipv4.flags 6 1 e0 5
Ipv4.fragment_offset 6 2 1fff 0
Ipv4.ttl 8 1
Ipv4.protocol 9 1
Ipv4.checksum 10 2
Ipv4.src 12 4
Ipv4.dst 16 4
Ipv6.version 0 1 f0 4
Ipv6.traffic_class 0 2 0ff0 4
Ipv6.flow_label 0 4 fffff 0
Ipv6.payload_length 4 2
Ipv6.next_header 6 1
Ipv6.hop_limit 7 1
Ipv6.src 8 16 bytes
Ipv6.dst 24 16 bytes
Tcp.src_port 0 2
Tcp.dst_port 2 2
Tcp.seq_num 4 4
Tcp.ack_num 8 4
Tcp.data_offset 12 1 f0 4
Tcp.flags 13 1
Tcp.window_size 14 2
Tcp.checksum 16 2
Tcp.urgent_pointer 18 2
Udp.src_port 0 2
Udp.dst_port 2 2
Udp.length 4 2
Udp.checksum 6 2
Sctp.src_port 0 2
Sctp.dst_port 2 2
Sctp.verification_tag 4 4
Sctp.checksum 8 4
Icmp.message_type 0 1
Icmp.code 1 1
Icmp.checksum 2 2
Icmp.rest_of_header 4 4
Icmp.identifier 4 2
Icmp.sequence 6 2
IcmpEcho.identifier 0 2
IcmpEcho.sequence 2 2
IcmpQuoted.rest_of_header 0 4
IcmpQuoted.next_hop_mtu 2 2
IcmpQuoted.pointer 0 1
IcmpRedirect.gateway_addr 0 4
IcmpTimestamp.identifier 0 2
IcmpTimestamp.sequence 2 2
IcmpTimestamp.originate_timestamp 4 4
IcmpTimestamp.receive_timestamp 8 4
IcmpTimestamp.transmit_timestamp 12 4
IcmpAddressMask.identifier 0 2
IcmpAddressMask.sequence 2 2
IcmpAddressMask.address_mask 4 4
Icmpv6.message_type 0 1
Icmpv6.code 1 1
Icmpv6.checksum 2 2
Icmpv6.rest_of_header 4 4
Icmpv6.identifier 4 2
Icmpv6.sequence 6 2
Icmpv6Echo.identifier 0 2
Icmpv6Echo.sequence 2 2
Icmpv6Quoted.message_specific 0 4
Icmpv6Quoted.mtu 0 4
Icmpv6Quoted.pointer 0 4
NdpRouterSolicitation.reserved 0 4
NdpRouterAdvertisement.current_hop_limit 0 1
NdpRouterAdvertisement.flags 1 1
NdpRouterAdvertisement.router_lifetime 2 2
NdpRouterAdvertisement.reachable_time 4 4
NdpRouterAdvertisement.retrans_timer 8 4
NdpNeighborSolicitation.reserved 0 4
NdpNeighborSolicitation.target_addr 4 16 bytes
NdpNeighborAdvertisement.flags_reserved 0 4
NdpNeighborAdvertisement.router 0 1 80 0 bool
NdpNeighborAdvertisement.solicited 0 1 40 0 bool
NdpNeighborAdvertisement.override_flag 0 1 20 0 bool
NdpNeighborAdvertisement.target_addr 4 16 bytes
NdpRedirect.reserved 0 4
NdpRedirect.target_addr 4 16 bytes
NdpRedirect.destination_addr 20 16 bytes
Igmp.message_type 0 1
Igmp.max_resp_time 1 1
Igmp.checksum 2 2
Igmp.group_addr 4 4
Dhcp.op 0 1
Dhcp.htype 1 1
Dhcp.hlen 2 1
Dhcp.hops 3 1
Dhcp.xid 4 4
Dhcp.secs 8 2
Dhcp.flags 10 2
Dhcp.ciaddr 12 4
Dhcp.yiaddr 16 4
Dhcp.siaddr 20 4
Dhcp.giaddr 24 4
Dhcp.chaddr 28 16 bytes
Dhcp.sname 44 64 bytes
Dhcp.boot_file 108 128 bytes
Dhcp.magic_cookie 236 4 bytes
Dns.id 0 2
Dns.qr 2 1 80 0 bool
Dns.opcode 2 1 78 3
Dns.aa 2 1 04 0 bool
Dns.tc 2 1 02 0 bool
Dns.rd 2 1 01 0 bool
Dns.ra 3 1 80 0 bool
Dns.z 3 1 40 0 bool
Dns.ad 3 1 20 0 bool
Dns.cd 3 1 10 0 bool
Dns.rcode 3 1 0f 0
Dns.qdcount 4 2
Dns.ancount 6 2
Dns.nscount 8 2
Dns.arcount 10 2
Ntp.leap_indicator 0 1 c0 6
Ntp.version 0 1 38 3
Ntp.mode 0 1 07 0
Ntp.stratum 1 1
Ntp.poll 2 1 signed
Ntp.precision 3 1 signed
Ntp.root_delay 4 4
Ntp.root_dispersion 8 4
Ntp.reference_id 12 4 bytes
Ntp.reference_timestamp 16 8 wide
Ntp.originate_timestamp 24 8 wide
Ntp.receive_timestamp 32 8 wide
Ntp.transmit_timestamp 40 8 wide
Tls.content_type 0 1
Tls.legacy_version 1 2
Tls.length 3 2
"""


def _parse(line: str) -> tuple[str, Field]:
    name, offset, width, *rest = line.split()
    kind = rest.pop() if rest and rest[-1] in ("bytes", "bool", "signed", "wide") else "int"
    mask, shift = (int(rest[0], 16), int(rest[1])) if rest else (None, 0)
    return name, Field(int(offset), int(width), mask, shift, kind)


FIELDS: dict[str, Field] = dict(map(_parse, _TABLE.strip().splitlines()))


def _gre_at(h: Column, *flags: int) -> Column:
    """Where the word after those of the given flags stands."""
    at = F.lit(4)
    for f in flags:
        at = at + F.when(u(h, 0, 2).bitwiseAND(f) != 0, 4).otherwise(0)
    return at


def _gre(h: Column, flag: int, before: tuple[int, ...], skip: int, width: int) -> Column:
    return F.when(u(h, 0, 2).bitwiseAND(flag) != 0, u(h, _gre_at(h, *before) + skip, width))


def rest(h: Column, offset: int | Column) -> Column:
    """Bytes from an offset to the end; empty where there are none."""
    at = offset if isinstance(offset, Column) else F.lit(offset)
    return F.substring(h, at + 1, F.greatest(F.lit(0), F.length(h) - at))


def _arp_part(which: int):
    def part(h: Column) -> Column:
        hardware, protocol = u(h, 4, 1), u(h, 5, 1)
        at = F.lit(8) + (hardware if which else F.lit(0)) + (protocol if which >= 2 else F.lit(0)) + (hardware if which == 3 else F.lit(0))
        return F.substring(h, (at + 1).cast("int"), (protocol if which % 2 else hardware).cast("int"))

    return part


#: Fields whose place depends on other fields.
DERIVED = {
    "Gre.header_len": lambda h: _gre_at(h, 0x8000, 0x2000, 0x1000),
    "Gre.checksum": lambda h: _gre(h, 0x8000, (), 0, 2),
    "Gre.reserved": lambda h: _gre(h, 0x8000, (), 2, 2),
    "Gre.key": lambda h: _gre(h, 0x2000, (0x8000,), 0, 4),
    "Gre.sequence": lambda h: _gre(h, 0x1000, (0x8000, 0x2000), 0, 4),
    "Arp.header_len": lambda h: 8 + 2 * (u(h, 4, 1) + u(h, 5, 1)),
    "Arp.is_ethernet_ipv4": lambda h: (F.length(h) >= 28) & (u(h, 0, 2) == 1) & (u(h, 2, 2) == 0x0800) & (u(h, 4, 1) == 6) & (u(h, 5, 1) == 4),
    "Arp.sender_hardware_addr_bytes": _arp_part(0),
    "Arp.sender_protocol_addr_bytes": _arp_part(1),
    "Arp.target_hardware_addr_bytes": _arp_part(2),
    "Arp.target_protocol_addr_bytes": _arp_part(3),
    "Ipv4.header_len": lambda h: FIELDS["Ipv4.ihl"].read(h) * 4,
    "Ipv4.options": lambda h: F.substring(h, F.lit(21), F.greatest(F.lit(0), (FIELDS["Ipv4.ihl"].read(h) * 4 - 20).cast("int"))),
    "Tcp.header_len": lambda h: FIELDS["Tcp.data_offset"].read(h) * 4,
    "Tcp.options": lambda h: F.substring(h, F.lit(21), F.greatest(F.lit(0), (FIELDS["Tcp.data_offset"].read(h) * 4 - 20).cast("int"))),
    "Sctp.chunks": lambda h: rest(h, 12),
    "Icmp.body": lambda h: rest(h, 4),
    "IcmpEcho.payload": lambda h: rest(h, 4),
    "IcmpQuoted.quoted_packet": lambda h: rest(h, 4),
    "IcmpRedirect.quoted_packet": lambda h: rest(h, 4),
    "Icmpv6.body": lambda h: rest(h, 4),
    "Icmpv6Echo.payload": lambda h: rest(h, 4),
    "Icmpv6Quoted.quoted_packet": lambda h: rest(h, 4),
    "NdpRouterSolicitation.options": lambda h: rest(h, 4),
    "NdpRouterAdvertisement.options": lambda h: rest(h, 12),
    "NdpNeighborSolicitation.options": lambda h: rest(h, 20),
    "NdpNeighborAdvertisement.options": lambda h: rest(h, 20),
    "NdpRedirect.options": lambda h: rest(h, 36),
    "Dhcp.has_magic_cookie": lambda h: F.coalesce(F.substring(h, 237, 4) == F.unhex(F.lit("63825363")), F.lit(False)),
    "Dhcp.options_bytes": lambda h: rest(h, 240),
    "Dhcp.client_hardware_addr": lambda h: F.substring(h, F.lit(29), F.least(u(h, 2, 1), F.lit(16)).cast("int")),
    "Dns.payload": lambda h: rest(h, 12),
    "Ntp.extension_bytes": lambda h: rest(h, 48),
    "Tls.payload": lambda h: F.substring(h, F.lit(6), u(h, 3, 2).cast("int")),
    "Tls.handshake_type": lambda h: F.when(u(h, 0, 1) == 22, u(h, 5, 1)),
    "Tls.handshake_len_raw": lambda h: F.when((u(h, 0, 1) == 22) & (F.length(h) >= 9), F.substring(h, 7, 3)),
    "Tls.handshake_len": lambda h: F.when(u(h, 0, 1) == 22, u(h, 6, 3)),
    "Raw.len": lambda h: F.length(h).cast("bigint"),
    "Raw.is_empty": lambda h: F.length(h) == 0,
    **{f"{p}.bytes": (lambda h: h) for p in ("Raw", "Vlan", "Llc", "Sll")},
}


def read(h: Column, name: str) -> Column:
    return DERIVED[name](h) if name in DERIVED else FIELDS[name].read(h)


def equals(h: Column, name: str, value) -> Column:
    return read(h, name) == F.lit(value)


def write(h: Column, name: str, value: Column) -> Column:
    """The bytes with one fixed-offset field replaced; bits outside the field stay, and a flag is set by true or any number but 0."""
    f = FIELDS[name]
    if f.kind == "bytes":
        new = value
    else:
        number = value.cast("bigint")
        if f.kind == "bool":
            number = F.when(number != 0, F.lit(f.mask)).otherwise(0)
        elif f.shift:
            number = F.shiftleft(number, f.shift)
        if f.mask is not None:
            old = unsigned(F.substring(h, f.offset + 1, f.width))
            number = old.bitwiseAND(F.lit(~f.mask & (1 << 8 * f.width) - 1).cast("bigint")).bitwiseOR(number.bitwiseAND(F.lit(f.mask).cast("bigint")))
        new = to_bytes(number, f.width)
    return F.concat(F.substring(h, 1, f.offset), new, rest(h, f.offset + f.width))


def names(protocol: str) -> list[str]:
    return [n for n in (*FIELDS, *DERIVED) if n.startswith(protocol + ".")]


def view(h: Column, protocol: str) -> Column:
    return F.struct(*[read(h, n).alias(n.split(".")[1]) for n in names(protocol)])


def mpls_entries(h: Column) -> Column:
    """Label stack: array of (label, traffic_class, bottom_of_stack, ttl)."""
    at = F.filter(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor(F.length(h) / 4).cast("int") - 1)), lambda i: (i + 1) * 4 <= F.length(h))
    return F.transform(at, lambda i: view(F.substring(h, i * 4 + 1, F.lit(4)), "MplsEntry"))
