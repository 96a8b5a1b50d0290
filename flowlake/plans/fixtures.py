"""Frames and headers whose layers, fields and options are known, and the rows that they give.

The expected values stand beside the bytes as text and are all that the SQL holds.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlake.functions import fields, options

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

# Frames (link type, hex) and their layers as protocol@offset+length.
FRAMES = {
    "udp": (1, "0102030405060b0c0d0e0f1008004500002000000000401100000a0001010a00010204d204d3000c000001020304", "Eth@0+14 Ipv4@14+20 Udp@34+8 Raw@42+4"),
    "vxlan": (1, "0001020304051011121314150800450000460000000040110000c0000201c0000202c00012b5003200000800000000002a000200000000020200000000010800450000140000000040ff00000a0000010a000002", "Eth@0+14 Ipv4@14+20 Udp@34+8 Vxlan@42+8 Eth@50+14 Ipv4@64+20"),
    "gre": (1, "0102030405060b0c0d0e0f1008004500002c00000000402f00000a0001010a00010200000800450000140000000040110000c0000201c0000202", "Eth@0+14 Ipv4@14+20 Gre@34+4 Ipv4@38+20"),
    "mpls": (1, "0102030405060b0c0d0e0f108847001001404500001400000000401100000a0001010a000102", "Eth@0+14 Mpls@14+4 Ipv4@18+20"),
    "icmpv6": (1, "33330000000200112233445586dd6000000000083a4020010db800000000000000000000000120010db80000000000000000000000028000000012340001", "Eth@0+14 Ipv6@14+40 Icmpv6@54+8"),
    "tls": (1, "0102030405060b0c0d0e0f1008004500003100000000400600000a0001010a00010201bb303900000001000000005018200000000000160303000401000000", "Eth@0+14 Ipv4@14+20 Tcp@34+20 Tls@54+9"),
    "dns": (1, "0102030405060b0c0d0e0f1008004500002800000000401100000a0001010a0001023039003500140000123401000001000000000000", "Eth@0+14 Ipv4@14+20 Udp@34+8 Dns@42+12"),
    "bare ipv4": (228, "4500001400000000400600000a0001010a000102", "Ipv4@0+20"),
    "raw link": (101, "4500001400000000400100000a0001010a00010208000000", "Ipv4@0+20 Raw@20+4"),
    "fragment": (228, "4500001c00000001401100000a0001010a000102003500350008aaaa", "Ipv4@0+20 Raw@20+8"),
    "ipv4 options": (228, "4700001c00000000400100007f0000017f0000020194040000000000", "Ipv4@0+28"),
    "bad header length": (1, "0102030405060b0c0d0e0f1008004400001400000000401100000a0001010a000102", "Eth@0+14 Raw@14+20"),
    "vlan": (1, "0102030405060b0c0d0e0f108100fabc0806" + "0001080006040001001122334455c0a8010a000000000000c0a80101", "Eth@0+14 Vlan@14+4 Arp@18+28"),
    "snap": (1, "0102030405060b0c0d0e0f100008aaaa030000000806" + "0001080006040001001122334455c0a8010a000000000000c0a80101", "Eth@0+14 Llc@14+8 Arp@22+28"),
    "cooked": (113, "0000000100060011223344550000" + "0800" + "4500001400000000400100000a0001010a000102", "Sll@0+16 Ipv4@16+20"),
    "label stack": (1, "0102030405060b0c0d0e0f108847" + "0001004000020140" + "6000000000003b4000000000000000000000000000000001" + "00000000000000000000000000000002", "Eth@0+14 Mpls@14+8 Ipv6@22+40"),
    "extension header": (229, "6000000000100040" + "00" * 32 + "1100000000000000" + "0035003500080000", "Ipv6@0+40 Udp@48+8"),
    "sctp": (228, "4500003800000000408400000a0001010a000102" + "1388138901020304aabbccdd0003001000000001000200030000000406000005ff000000", "Ipv4@0+20 Sctp@20+36"),
    "igmp": (228, "4500001c00000000010200000a000101e0000001" + "16000000e0000001", "Ipv4@0+20 Igmp@20+8"),
    "ntp": (228, "4500004c00000000401100000a0001010a000102" + "007b007b00380000" + "240206ec00010000000200004c4f434c0102030405060708111213141516171821222324252627283132333435363738", "Ipv4@0+20 Udp@20+8 Ntp@28+48"),
    "unknown type": (1, "0102030405060b0c0d0e0f10eeee0102", "Eth@0+14 Raw@14+2"),
    "unknown link": (77, "0102", "UnsupportedLinkType"),
    "too short": (1, "0102", "Truncated"),
}

# Header bytes, and fields as text.
FIELDS = {
    "Ipv4": ("4700001c1234a00f40010bb87f0000017f0000020194040000000000", {"version": "4", "ihl": "7", "header_len": "28", "tos": "0", "total_length": "28", "identification": "4660", "flags": "5", "fragment_offset": "15", "ttl": "64", "protocol": "1", "checksum": "3000", "src": "2130706433", "dst": "2130706434", "options": "0194040000000000"}),
    "Ipv6": ("6ab12345000c3a4020010db800000000000000000000000120010db8000000000000000000000002", {"version": "6", "traffic_class": "171", "flow_label": "74565", "payload_length": "12", "next_header": "58", "hop_limit": "64", "src": "20010DB8000000000000000000000001", "dst": "20010DB8000000000000000000000002"}),
    "Tcp": ("0050006001020304050607088002200000ff0009020405b40103030704020000", {"src_port": "80", "dst_port": "96", "seq_num": "16909060", "ack_num": "84281096", "data_offset": "8", "header_len": "32", "flags": "2", "window_size": "8192", "checksum": "255", "urgent_pointer": "9", "options": "020405B40103030704020000"}),
    "Udp": ("04d2162e000d8cff", {"src_port": "1234", "dst_port": "5678", "length": "13", "checksum": "36095"}),
    "Eth": ("66778899aabb0011223344550800", {"dst": "66778899AABB", "src": "001122334455", "eth_type": "2048"}),
    "Vlan": ("fabc0800", {"tci": "64188", "pcp": "7", "dei": "true", "vid": "2748", "eth_type": "2048"}),
    "Llc": ("aaab03000001080600", {"dsap": "170", "ssap": "170", "control_u": "3", "control_is": "768", "oui": "000001", "protocol_id": "2054"}),
    "Sll": ("000300010006001122334455000086dd", {"packet_type": "3", "arphrd_type": "1", "link_layer_addr_len": "6", "link_layer_addr": "0011223344550000", "protocol_type": "34525"}),
    "Gre": ("b005080012340000000000aa00000007", {"flags": "45056", "version": "5", "protocol_type": "2048", "header_len": "16", "checksum": "4660", "reserved": "0", "key": "170", "sequence": "7"}),
    "Vxlan": ("0800000000002a07", {"flags": "2048", "vni_is_valid": "true", "reserved_1": "0", "vni": "00002A", "vni_id": "42", "reserved_2": "7"}),
    "Arp": ("0001080006040001001122334455c0a8010a000000000000c0a80101", {"hardware_type": "1", "protocol_type": "2048", "hardware_len": "6", "protocol_len": "4", "operation": "1", "header_len": "28", "is_ethernet_ipv4": "true", "sender_hardware_addr": "001122334455", "sender_protocol_addr": "3232235786", "target_hardware_addr": "000000000000", "target_protocol_addr": "3232235777", "sender_protocol_addr_bytes": "C0A8010A", "target_hardware_addr_bytes": "000000000000"}),
    "Sctp": ("1388138901020304aabbccdd0003001000000001000200030000000406000005ff000000", {"src_port": "5000", "dst_port": "5001", "verification_tag": "16909060", "checksum": "2864434397"}),
    "Icmp": ("0b01f7fe00000000", {"message_type": "11", "code": "1", "checksum": "63486", "rest_of_header": "0", "body": "00000000"}),
    "IcmpQuoted": ("000005dc45000014", {"rest_of_header": "1500", "next_hop_mtu": "1500", "pointer": "0", "quoted_packet": "45000014"}),
    "IcmpRedirect": ("0a00000145000014", {"gateway_addr": "167772161", "quoted_packet": "45000014"}),
    "IcmpTimestamp": ("00070009000000010000000200000003", {"identifier": "7", "sequence": "9", "originate_timestamp": "1", "receive_timestamp": "2", "transmit_timestamp": "3"}),
    "IcmpAddressMask": ("00070009ffffff00", {"identifier": "7", "sequence": "9", "address_mask": "4294967040"}),
    "IcmpEcho": ("000700096869", {"identifier": "7", "sequence": "9", "payload": "6869"}),
    "Icmpv6Quoted": ("000005006000", {"message_specific": "1280", "mtu": "1280", "pointer": "1280", "quoted_packet": "6000"}),
    "NdpRouterAdvertisement": ("40c007080000000100000002" + "0101", {"current_hop_limit": "64", "flags": "192", "router_lifetime": "1800", "reachable_time": "1", "retrans_timer": "2", "options": "0101"}),
    "NdpNeighborAdvertisement": ("6000000020010db80000000000000000000000010201", {"router": "false", "solicited": "true", "override_flag": "true", "target_addr": "20010DB8000000000000000000000001", "options": "0201"}),
    "NdpRedirect": ("00000000" + "fe800000000000000000000000000001" + "20010db8000000000000000000000002", {"reserved": "0", "target_addr": "FE800000000000000000000000000001", "destination_addr": "20010DB8000000000000000000000002", "options": ""}),
    "Igmp": ("160a0102e0000001", {"message_type": "22", "max_resp_time": "10", "checksum": "258", "group_addr": "3758096385"}),
    "Dhcp": ("01010600" + "3903f326" + "00058000" + "0a00000b0a00000c0a00000d0a00000e" + "00112233445500000000000000000000" + "73" + "00" * 63 + "62" + "00" * 127 + "63825363" + "350101ff", {"op": "1", "htype": "1", "hlen": "6", "hops": "0", "xid": "956560166", "secs": "5", "flags": "32768", "ciaddr": "167772171", "yiaddr": "167772172", "siaddr": "167772173", "giaddr": "167772174", "client_hardware_addr": "001122334455", "magic_cookie": "63825363", "has_magic_cookie": "true", "options_bytes": "350101FF"}),
    "Dns": ("1234ad930001000200030004", {"id": "4660", "qr": "true", "opcode": "5", "aa": "true", "tc": "false", "rd": "true", "ra": "true", "z": "false", "ad": "false", "cd": "true", "rcode": "3", "qdcount": "1", "ancount": "2", "nscount": "3", "arcount": "4"}),
    "Ntp": ("e40206ec00010000000200004c4f434c0102030405060708111213141516171821222324252627283132333435363738", {"leap_indicator": "3", "version": "4", "mode": "4", "stratum": "2", "poll": "6", "precision": "-20", "root_delay": "65536", "root_dispersion": "131072", "reference_id": "4C4F434C", "reference_timestamp": "72623859790382856", "originate_timestamp": "1230066625199609624", "receive_timestamp": "2387509390608836392", "transmit_timestamp": "3544952156018063160"}),
    "Tls": ("160303000401000000", {"content_type": "22", "legacy_version": "771", "length": "4", "payload": "01000000", "handshake_type": "1", "handshake_len": "0", "handshake_len_raw": "000000"}),
    "MplsEntry": ("00100140", {"label": "256", "traffic_class": "0", "bottom_of_stack": "1", "ttl": "64"}),
}




def _literal(v: str) -> str:
    return "'" + v.replace("'", "''") + "'"


def expected(rows: list[tuple], names: str) -> str:
    return "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(_literal, r)) + ")" for r in rows) + f") AS t({names})"


SQL["fixture_frames"] = expected([(n, layers) for n, (_, _, layers) in FRAMES.items()], "name, layers")


def fixture_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layers of known frames, or what kept them from being parsed."""
    from flowlake.operators import dissect

    rows = spark.createDataFrame([(n, link, bytearray.fromhex(h)) for n, (link, h, _) in FRAMES.items()], "name string, link_type int, data binary")
    found = dissect.dissect(rows)
    text = F.array_join(F.transform("layers", lambda x: F.concat(x["protocol"], F.lit("@"), x["offset"].cast("string"), F.lit("+"), x["len"].cast("string"))), " ")
    return found.select("name", F.when(F.size("layers") > 0, text).otherwise(F.col("dissect_error.kind")).alias("layers"))


SQL["fixture_fields"] = expected([(p, f, v) for p, (_, values) in FIELDS.items() for f, v in values.items()], "protocol, field, value")


def fixture_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of known headers."""
    parts = []
    for protocol, (hexed, values) in FIELDS.items():
        row = spark.createDataFrame([(protocol, bytearray.fromhex(hexed))], "protocol string, h binary")
        kinds = dict(row.select(*[fields.read(F.col("h"), f"{protocol}.{f}").alias(f) for f in values]).dtypes)
        read = lambda f: F.hex(fields.read(F.col("h"), f"{protocol}.{f}")) if kinds[f] == "binary" else fields.read(F.col("h"), f"{protocol}.{f}").cast("string")  # noqa: B023, E731
        parts.append(row.select("protocol", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), read(f).alias("value")) for f in values])).alias("x")).select("protocol", "x.field", "x.value"))
    return reduce(DataFrame.unionByName, parts)


_V4 = "4700001c00000000400100007f0000017f0000020194040000000000"
_TCP = "0050006000000000000000008002200000000000020405b40103030704020000"
_SCTP = "1388138901020304aabbccdd0003001000000001000200030000000406000005ff000000"


def _kinds(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda o: F.concat(o["kind"].cast("string"), F.lit(":"), o["len"].cast("string"), F.when(o["malformed"], F.lit("!")).otherwise(""))), " ")


def _json(value: Column) -> Column:
    return F.to_json(value)


# Option areas and single options: bytes, what reads them, and the text of what is read.
OPTIONS: dict[str, tuple[str, Callable[[Column], Column], str]] = {
    "ipv4 options": (_V4, lambda h: _kinds(options.ipv4_options(h)), "1:1 148:4 0:1"),
    "tcp options": (_TCP, lambda h: _kinds(options.tcp_options(h)), "2:4 1:1 3:3 4:2 0:1"),
    "tcp options cut": ("0050006000000000000000006002200000000000" + "02090000", lambda h: _kinds(options.tcp_options(h)), "2:4!"),
    "dhcp options": ("00" * 240 + "3501010032040a00000bff", lambda h: _kinds(options.dhcp_options(h)), "53:1 0:1 50:4 255:1"),
    "sctp chunks": (_SCTP, lambda h: _kinds(options.sctp_chunks(h)), "0:16 6:5"),
    "segment size": ("05b4", lambda d: options.maximum_segment_size(d).cast("string"), "1460"),
    "segment size cut": ("05", lambda d: options.maximum_segment_size(d).cast("string"), "none"),
    "window scale": ("07", lambda d: options.window_scale(d).cast("string"), "7"),
    "sack": ("00000001000000020000000300000004", lambda d: _json(options.sack_blocks(d)), '[{"left":1,"right":2},{"left":3,"right":4}]'),
    "timestamp": ("0000000100000002", lambda d: _json(options.tcp_timestamp(d)), '{"value":1,"echo":2}'),
    "user timeout": ("8005", lambda d: _json(options.user_timeout(d)), '{"minutes":true,"value":5}'),
    "authentication": ("0102aabbccdd", lambda d: F.concat_ws("/", options.tcp_authentication(d)["key_id"].cast("string"), options.tcp_authentication(d)["next_key_id"].cast("string"), F.hex(options.tcp_authentication(d)["mac"])), "1/2/AABBCCDD"),
    "multipath": ("1001", lambda d: F.concat_ws("/", options.multipath(d)["subtype"].cast("string"), options.multipath(d)["low"].cast("string"), F.hex(options.multipath(d)["body"])), "1/0/01"),
    "fast open": ("01020304", lambda d: F.hex(options.fast_open_cookie(d)), "01020304"),
    "fast open odd": ("0102030405", lambda d: F.hex(options.fast_open_cookie(d)), "none"),
    "router alert": ("0000", lambda d: options.router_alert(d).cast("string"), "0"),
    "stream id": ("002a", lambda d: options.stream_id(d).cast("string"), "42"),
    "mtu": ("05dc", lambda d: options.mtu(d).cast("string"), "1500"),
    "route": ("040a0000010a0000020b", lambda d: _json(options.ipv4_route(d).dropFields("trailing")), '{"pointer":4,"addresses":[167772161,167772162]}'),
    "time stamps": ("05130a00000100000001", lambda d: _json(options.ipv4_timestamp(d).dropFields("entries")), '{"pointer":5,"overflow":1,"flag":3,"entry_width":8}'),
    "traceroute": ("0001000200030a000001", lambda d: _json(options.ipv4_traceroute(d)), '{"id":1,"outbound_hops":2,"return_hops":3,"originator":167772161}'),
    "echo": ("0800000000010002", options.icmp_message, "echo"),
    "echo cut": ("08000000", options.icmp_message, "raw"),
    "unreachable": ("03040000000005dc45", options.icmp_message, "quoted"),
    "redirect": ("050000000a000001", options.icmp_message, "redirect"),
    "mask": ("1100000000010002ffffff00", options.icmp_message, "address_mask"),
    "solicitation": ("87000000" + "00" * 20, options.icmpv6_message, "neighbor_solicitation"),
    "advertisement": ("86000000" + "00" * 12, options.icmpv6_message, "router_advertisement"),
    "too big": ("020000000000050060", options.icmpv6_message, "quoted"),
    "label stack": ("0010004000200140", lambda h: F.array_join(F.transform(fields.mpls_entries(h), lambda e: e["label"].cast("string")), " "), "256 512"),
}

SQL["fixture_options"] = expected([(n, v) for n, (_, _, v) in OPTIONS.items()], "name, value")


def fixture_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Options, chunks and messages of known bytes."""
    parts = [spark.createDataFrame([(n, bytearray.fromhex(h))], "name string, h binary").select("name", F.coalesce(f(F.col("h")), F.lit("none")).alias("value")) for n, (h, f, _) in OPTIONS.items()]
    return reduce(DataFrame.unionByName, parts)


QUERIES.update(fixture_frames=fixture_frames, fixture_fields=fixture_fields, fixture_options=fixture_options)
