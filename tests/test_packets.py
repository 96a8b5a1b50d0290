"""Frames, headers, checksums, crafting and dissection on known bytes."""

import pytest
from pyspark.sql import functions as F

from flowlake.functions import checksum, codes, fields, net, options
from flowlake.operators import craft, dissect

UDP = "0102030405060b0c0d0e0f1008004500002000000000401100000a0001010a00010204d204d3000c000001020304"
VXLAN = "0001020304051011121314150800450000460000000040110000c0000201c0000202c00012b5003200000800000000002a000200000000020200000000010800450000140000000040ff00000a0000010a000002"
GRE = "0102030405060b0c0d0e0f1008004500002c00000000402f00000a0001010a00010200000800450000140000000040110000c0000201c0000202"
MPLS = "0102030405060b0c0d0e0f108847001001404500001400000000401100000a0001010a000102"
ICMPV6 = "33330000000200112233445586dd6000000000083a4020010db800000000000000000000000120010db80000000000000000000000028000000012340001"
TLS = "0102030405060b0c0d0e0f1008004500003100000000400600000a0001010a00010201bb303900000001000000005018200000000000160303000401000000"
DNS = "0102030405060b0c0d0e0f1008004500002800000000401100000a0001010a0001023039003500140000123401000001000000000000"


def names(data, **k):
    return [x.protocol for x in dissect.parse(bytes.fromhex(data) if isinstance(data, str) else data, **k)[0]]


@pytest.mark.parametrize(
    "data, want",
    [
        (UDP, "Eth Ipv4 Udp Raw"),
        (VXLAN, "Eth Ipv4 Udp Vxlan Eth Ipv4"),
        (GRE, "Eth Ipv4 Gre Ipv4"),
        (MPLS, "Eth Mpls Ipv4"),
        (ICMPV6, "Eth Ipv6 Icmpv6"),
        (TLS, "Eth Ipv4 Tcp Tls"),
        (DNS, "Eth Ipv4 Udp Dns"),
    ],
)
def test_layers(data, want):
    assert names(data) == want.split()


def test_every_prefix_parses():
    for data in (UDP, VXLAN, GRE, MPLS, ICMPV6, TLS, DNS):
        raw = bytes.fromhex(data)
        for n in range(len(raw)):
            layers, error = dissect.parse(raw[:n])
            assert (error is None) == (n >= 14)
            assert all(x.offset + x.len <= n for x in layers)


def test_depth_and_fallback():
    assert names(UDP, max_depth=0) == []
    assert names(UDP, max_depth=1) == ["Eth", "Raw"]
    assert names(UDP, max_depth=3) == ["Eth", "Ipv4", "Udp", "Raw"]
    cut = bytes.fromhex(UDP)[:30]
    assert names(cut) == ["Eth", "Raw"]
    layers, error = dissect.parse(cut, fallback=False)
    assert [x.protocol for x in layers] == ["Eth"] and (error.kind, error.protocol, error.offset, error.needed, error.available) == ("Truncated", "Ipv4", 14, 20, 16)
    bad = bytearray(bytes.fromhex(UDP))
    bad[14] = 0x44
    assert dissect.parse(bytes(bad), fallback=False)[1].kind == "Malformed"
    assert dissect.parse(b"\x45", link_type=77)[1].kind == "UnsupportedLinkType"


def test_links_and_special_cases():
    ip = bytes.fromhex(UDP)[14:]
    assert names(ip, link_type=101) == names(ip, link_type=228) == ["Ipv4", "Udp", "Raw"]
    fragment = bytearray(ip)
    fragment[7] = 1
    assert names(bytes(fragment), link_type=228) == ["Ipv4", "Raw"]
    llc = bytes(12) + b"\x00\x08" + b"\xaa\xaa\x03\x00\x00\x00\x08\x06" + bytes(28)
    assert names(llc)[:3] == ["Eth", "Llc", "Arp"]
    assert names(bytes(12) + b"\x00\x04\x42\x42\x03\x00") == ["Eth"]
    vlan = bytes(12) + b"\x81\x00\xfa\xbc\x81\x00" + bytes(10)
    assert names(vlan) == ["Eth", "Vlan", "Raw"]
    chain = bytes.fromhex("6000000000102b40") + bytes(32) + bytes.fromhex("1100000000000000") + bytes.fromhex("0035003500080000")
    assert names(chain, link_type=229) == ["Ipv6", "Udp"]


def test_columns_and_packets_agree():
    """What is found on whole columns is what single packets give, for frames with any byte changed and any length."""
    import random

    import numpy as np
    import pyarrow as pa

    rng = random.Random(5)
    frames = []
    for data in (UDP, VXLAN, TLS, DNS, GRE, MPLS, ICMPV6):
        raw = bytes.fromhex(data)
        for _ in range(400):
            changed = bytearray(raw + bytes(rng.randrange(256) for _ in range(rng.choice([0, 0, 3, 20]))))
            for _ in range(rng.randint(0, 3)):
                changed[rng.randrange(12, len(changed))] = rng.choice([0, 1, 3, 5, 6, 8, 17, 22, 53, 0x45, 0x50, 0x60, 0xBB, rng.randrange(256)])
            frames.append(bytes(changed[: rng.choice([len(changed), len(changed), rng.randint(0, len(changed))])]))
    column = pa.array(frames, pa.binary())
    for depth in (None, 3, 4):
        easy = dissect.common(column, np.ones(len(frames), np.int64), depth)
        assert len(easy.rows) > 300
        for i, name, at, rest_at, rest, last in zip(*(x.tolist() for x in easy), strict=True):
            want = [("Eth", 0, 14), ("Ipv4", 14, at - 14), (dissect.NAMES[name], at, rest_at - at)] + [(dissect.NAMES[last], rest_at, rest)] * (rest > 0)
            layers, error = dissect.parse(frames[i], max_depth=depth)
            assert error is None and [tuple(x) for x in layers] == want, frames[i].hex()


def test_registry():
    def clock(ctx, at):
        ctx.require("Clock", at, 8)
        if ctx.push_layer("Clock", at, 8):
            ctx.parse_child("Ipv4", at + 8)

    frame = bytes(12) + b"\xee\xee" + bytes(8) + bytes.fromhex(UDP)[14:]
    assert names(frame) == ["Eth", "Raw"]
    assert names(frame, registry=dissect.Registry().register("Eth", 0xEEEE, clock)) == ["Eth", "Clock", "Ipv4", "Udp", "Raw"]


@pytest.fixture(scope="module")
def rows(spark):
    data = [("udp", UDP), ("vxlan", VXLAN), ("gre", GRE), ("mpls", MPLS), ("icmpv6", ICMPV6), ("tls", TLS), ("dns", DNS)]
    df = spark.createDataFrame([(n, bytearray.fromhex(h), 1, k, k, len(h) // 2) for k, (n, h) in enumerate(data)], "path string, data binary, link_type int, frame_no long, ts_ns long, orig_len long")
    return dissect.dissect(df).cache()


def value(rows, name, column):
    return rows.where(F.col("path") == name).select(column).first()[0]


def test_fields_of_layers(rows):
    assert value(rows, "vxlan", dissect.field("Vxlan.vni_id")) == 42
    assert value(rows, "vxlan", net.mac_text(dissect.field("Eth.src"))) == "02:00:00:00:00:01"
    assert value(rows, "vxlan", net.mac_text(dissect.field("Eth.src", 1))) == "10:11:12:13:14:15"
    assert value(rows, "vxlan", dissect.nth_layer("Ipv4")["offset"]) == 64
    assert value(rows, "gre", net.ipv4_text(dissect.field("Ipv4.src"))) == "192.0.2.1"
    assert value(rows, "mpls", fields.mpls_entries(dissect.layer_bytes("Mpls")))[0]["label"] == 256
    assert value(rows, "icmpv6", codes.name_of(dissect.field("Icmpv6.message_type"), codes.ICMPV6_TYPE)) == "EchoRequest"
    assert value(rows, "tls", dissect.field("Tls.handshake_len")) == 0
    assert value(rows, "dns", dissect.field("Dns.id")) == 0x1234
    assert value(rows, "udp", dissect.field("Tcp.flags")) is None
    assert value(rows, "udp", dissect.display()) == "[Eth] 01:02:03:04:05:06 -> 0B:0C:0D:0E:0F:10 | [Ipv4] 10.0.1.1        -> 10.0.1.2        32   | [Udp] 1234  -> 1235  | [Raw] 4 bytes"


def test_display_lines(rows):
    shown = {r[0]: r[1].split(" | ") for r in rows.select("path", dissect.display()).collect()}
    assert shown["vxlan"][3] == "[Vxlan] vni 42" and shown["mpls"][1] == "[Mpls] label 256" and shown["gre"][2] == "[Gre] Ipv4 0x0000"
    assert shown["tls"][2:] == ["[Tcp] 443   -> 12345 ACK|PSH", "[Tls] Handshake ClientHello v0x0303 len 4"]
    assert shown["dns"][3] == "[Dns] id 4660 Query qd 1 an 0" and shown["icmpv6"][2] == "[Icmpv6] EchoRequest code 0"
    assert shown["icmpv6"][1].startswith("[Ipv6] 2001:db8::1 ")


def test_writing_a_field(rows):
    new = value(rows, "udp", fields.read(F.substring(dissect.with_field("Ipv4.ttl", F.lit(9)), 15, 20), "Ipv4.ttl"))
    assert new == 9
    assert value(rows, "mpls", dissect.with_field("Udp.length", F.lit(1))) == bytes.fromhex(MPLS)


def test_metadata_and_flow_packets(rows):
    meta = {r["path"]: r for r in dissect.metadata(rows).collect()}
    assert (meta["udp"]["src_port"], meta["udp"]["ip_proto"], meta["udp"]["l3_len"], meta["udp"]["tcp_flags"]) == (1234, 17, 32, None)
    assert (meta["icmpv6"]["ttl"], meta["icmpv6"]["l3_len"], meta["icmpv6"]["ip_proto"]) == (64, 48, 58)
    flows = {r["path"]: r for r in dissect.flow_packets(rows).collect()}
    assert set(flows) == {"udp", "vxlan", "tls", "dns"}
    assert (flows["udp"]["payload"], flows["tls"]["payload"], flows["tls"]["header_len"]) == (4, 9, 20)
    out = dissect.dump(dissect.metadata(rows), numeric_ip=True).collect()
    assert out[0]["src_ip"] == "10.0.1.1" and out[0]["src_ip4"] == 0x0A000101 and out[0]["tcp_window"] == 0 and out[0]["src_ip6"] is None
    assert out[4]["src_ip"] == "2001:db8::1" and out[4]["src_ip4"] is None and len(out[4]["src_ip6"]) == 16


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def binary(hexed):
    return F.unhex(F.lit(hexed))


def test_craft_known_frame(spark):
    stack = craft.eth(src=bytes.fromhex("001122334455"), dst=bytes.fromhex("66778899aabb")) / craft.ipv4(src=0x0A000001, dst=0x0A000002) / craft.udp(src_port=1234, dst_port=5678) / craft.raw(b"hello")
    assert one(spark, stack.build()).hex() == "66778899aabb00112233445508004500002100000000401166ca0a0000010a00000204d2162e000d8cff68656c6c6f"
    syn = craft.ipv4(src=0xC633640A, dst=0xC6336414, ttl=128, identification=7) / craft.tcp(src_port=44444, dst_port=80, flags=2, window=64240)
    data = bytes(one(spark, syn.build()))
    assert len(data) == 40
    h = F.lit(data)
    assert one(spark, checksum.ipv4_valid(F.substring(h, 1, 20))) and one(spark, checksum.tcp_valid(F.lit(0xC633640A), F.lit(0xC6336414), F.substring(h, 21, 20)))
    echo = craft.icmp_echo(identifier=1, sequence=2) / craft.raw(b"abc")
    assert one(spark, checksum.icmp_valid(F.lit(bytes(one(spark, echo.build())))))


def test_craft_errors(spark):
    for kind, make in {
        "EmptyStack": lambda: craft.Stack().build(),
        "RawMustBeTerminal": lambda: (craft.raw(b"x") / craft.udp()).build(),
        "InvalidField": lambda: (craft.ipv4(ttl=300) / craft.raw(b"")).build(),
        "InvalidLength": lambda: craft.ipv4(ihl=4).build(),
    }.items():
        with pytest.raises(craft.CraftError) as e:
            make()
        assert e.value.kind == kind
    for kind, make in {"InvalidLength": craft.udp(length=9) / craft.raw(b"abc"), "LengthOverflow": craft.ipv4() / craft.raw(F.repeat(F.lit("x"), 65536).cast("binary"))}.items():
        with pytest.raises(Exception, match=kind):
            one(spark, make.build())
    assert len(one(spark, (craft.ipv4() / craft.raw(F.repeat(F.lit("x"), 65515).cast("binary"))).build())) == 65535
    assert one(spark, (craft.custom(name="X", head=b"\x01\x02") / craft.raw(b"a")).build()) == b"\x01\x02a"


def test_checksums(spark):
    assert one(spark, checksum.internet(binary("0001f203f4f5f6f7"))) == 0xFFFF - 0xDDF2
    assert one(spark, checksum.internet(binary("01"))) == 0xFFFF - 0x0100
    assert one(spark, checksum.internet(binary("00000000"))) == 0xFFFF
    assert one(spark, checksum.internet(binary("ffffffff"))) == 0
    assert one(spark, checksum.udp_valid(F.lit(1), F.lit(2), binary("0035003500080000")))


def test_headers(spark):
    r = lambda h, n: one(spark, fields.read(binary(h), n))
    ntp = "240206ec00010000000200004c4f434c0102030405060708111213141516171821222324252627283132333435363738"
    assert [r(ntp, f"Ntp.{n}") for n in ("version", "mode", "stratum", "poll", "precision")] == [4, 4, 2, 6, -20]
    assert int(r(ntp, "Ntp.transmit_timestamp")) == 0x3132333435363738
    assert (r("fabc0800", "Vlan.pcp"), r("fabc0800", "Vlan.dei"), r("fabc0800", "Vlan.vid")) == (7, True, 0xABC)
    arp = "0001080006040001001122334455c0a8010a000000000000c0a80101"
    assert r(arp, "Arp.is_ethernet_ipv4") and r(arp, "Arp.header_len") == 28 and r(arp, "Arp.sender_protocol_addr_bytes") == bytes([192, 168, 1, 10])
    dns = "123481800001000100000000"
    assert [r(dns, f"Dns.{n}") for n in ("id", "qr", "rd", "ra", "qdcount", "ancount")] == [0x1234, True, True, True, 1, 1]
    assert r("16000000e0000001", "Igmp.group_addr") == 0xE0000001
    gre = "b000080012340000000000aa00000007"
    assert [r(gre, f"Gre.{n}") for n in ("header_len", "checksum", "key", "sequence")] == [16, 0x1234, 0xAA, 7]
    assert r("1234", "Udp.dst_port") is None


def test_options(spark):
    v4, tcp = "4700001c00000000400100007f0000017f0000020194040000000000", "0050006000000000000000008002200000000000020405b40103030704020000"
    kinds = lambda c: [o["kind"] for o in one(spark, c)]
    assert kinds(options.ipv4_options(binary(v4))) == [1, 148, 0]
    assert kinds(options.tcp_options(binary(tcp))) == [2, 1, 3, 4, 0]
    found = options.tcp_options(binary(tcp))
    assert one(spark, options.maximum_segment_size(options.of_kind(found, 2)["data"])) == 1460
    assert one(spark, options.window_scale(options.of_kind(found, 3)["data"])) == 7
    sctp = "1388138901020304aabbccdd0003001000000001000200030000000406000005ff000000"
    assert [(c["kind"], c["len"]) for c in one(spark, options.sctp_chunks(binary(sctp)))] == [(0, 16), (6, 5)]
    assert [o["malformed"] for o in options.tlv(b"\x02\x09\x00", 0, 1, True)] == [True]
    assert one(spark, options.sack_blocks(binary("0000000100000002")))[0]["right"] == 2
    assert one(spark, options.ipv4_route(binary("040a0000010a0000020b")))["addresses"] == [0x0A000001, 0x0A000002]
    assert one(spark, options.icmp_message(binary("08000000"))) == "raw" and one(spark, options.icmp_message(binary("0800000000010002"))) == "echo"
    assert one(spark, options.icmpv6_message(binary("87000000" + "00" * 20))) == "neighbor_solicitation"


def test_texts(spark):
    assert one(spark, net.seconds_text(F.lit(-1))) == "-1.999999999"
    assert one(spark, net.iso_text(F.lit(1_234_567_890))) == "1970-01-01T00:00:01.23456789Z"
    assert one(spark, net.iso_text(F.lit(2_000_000_000))) == "1970-01-01T00:00:02Z"
    assert one(spark, net.ipv4_number(F.lit("1.2.3.4"))) == 0x01020304 and one(spark, net.ipv4_number(F.lit("1.2.3"))) is None
    v6 = lambda h: one(spark, net.ipv6_text(binary(h)))
    assert v6("0" * 32) == "::" and v6("0" * 31 + "1") == "::1" and v6("20010db8000000000001000000000001") == "2001:db8::1:0:0:1"
    assert v6("00010000000200000003000000040000") == "1:0:2:0:3:0:4:0"
    assert one(spark, net.mac_bytes(F.lit("00:1a:2B:00:00:01"))) == bytes.fromhex("001a2b000001")
    assert one(spark, codes.tcp_flags_text(F.lit(0x12))) == "ACK|SYN"
