"""Queries over bytes of every protocol and over capture files, with SQL that writes the bytes out itself.

Headers are written field by field from a packet's columns into frames, dissected, and read
through the dissector's layers; the SQL gives the header's bytes by its own layout, so an
offset, a width or a mask that is wrong on both sides of Spark still shows.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowlake.functions import fields
from flowlake.plans.packets import FRAMES_SQL, PACKETS_SQL, crafted, frames, hexed, packets
from flowlake.scratch import scratch

HOUR = 3_600_000_000_000
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str, tables: str = PACKETS_SQL):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, tables + sql
        return f

    return add


# Headers of single protocols.


class Header(NamedTuple):
    """before: the outer layers' bytes in hex; size: bytes of the header; writes and reads: fields with expressions both of Spark and of DuckDB; layout: SQL for the header's hex; layers: what the frame dissects to."""

    before: str
    size: int
    writes: dict[str, str]
    layout: str
    layers: str
    reads: dict[str, str] = {}
    link: int = 1
    #: Zero bytes after the header, and SQL or Spark for the bytes written before the fields are.
    after: str = "0"
    base: str = ""


def eth(kind: str) -> str:
    return f"0200000000020200000000 01{kind}".replace(" ", "")


def ipv4(proto: int) -> str:
    return eth("0800") + f"450000000000000040{proto:02x}00000a0000010a000002"


def udp(src: int, dst: int) -> str:
    return ipv4(17) + f"{src:04x}{dst:04x}00000000"


def zeros(n: int) -> str:
    return f"'{'00' * n}'"


def layout(*parts: str | tuple[str, int]) -> str:
    """SQL for hex digits: literals, and (expression, digits)."""
    return " || ".join(p if isinstance(p, str) else hexed(*p) for p in parts)


FLAGS = "(frame_no % 2) * 32768"
HEADERS = {
    "vlan": Header(
        eth("8100"), 4, {"Vlan.pcp": "frame_no % 8", "Vlan.dei": "frame_no % 2", "Vlan.vid": "frame_no % 4096", "Vlan.eth_type": "2048"},
        layout(("frame_no % 8 * 8192 + frame_no % 2 * 4096 + frame_no % 4096", 4), "'0800'"), "Eth,Vlan", {"Vlan.tci": "frame_no % 8 * 8192 + frame_no % 2 * 4096 + frame_no % 4096"},
    ),
    "llc": Header(eth("0008"), 8, {"Llc.dsap": "170", "Llc.ssap": "170", "Llc.control_u": "3", "Llc.protocol_id": "frame_no % 65536"}, layout("'AAAA03000000'", ("frame_no % 65536", 4)), "Eth,Llc"),
    "sll": Header(
        "", 16, {"Sll.packet_type": "frame_no % 5", "Sll.arphrd_type": "1", "Sll.link_layer_addr_len": "6", "Sll.protocol_type": "2048"},
        layout(("frame_no % 5", 4), "'00010006'", zeros(8), "'0800'"), "Sll", link=113,
    ),
    "mpls": Header(
        eth("8847"), 4, {"MplsEntry.label": "frame_no % 1048576", "MplsEntry.traffic_class": "frame_no % 8", "MplsEntry.bottom_of_stack": "1", "MplsEntry.ttl": "frame_no % 256"},
        layout(("frame_no % 1048576 * 4096 + frame_no % 8 * 512 + 256 + frame_no % 256", 8)), "Eth,Mpls",
    ),
    "gre": Header(
        ipv4(47), 8, {"Gre.flags": "8192", "Gre.version": "frame_no % 8", "Gre.protocol_type": "2048"}, layout(("8192 + frame_no % 8", 4), "'0800'", ("frame_no", 8)), "Eth,Ipv4,Gre",
        {"Gre.key": "frame_no", "Gre.header_len": "8"}, base="concat(unhex('00000000'), unhex(lpad(hex(frame_no), 8, '0')))",
    ),
    "vxlan": Header(
        udp(5000, 4789), 8, {"Vxlan.flags": "2048", "Vxlan.reserved_1": "frame_no % 65536", "Vxlan.vni_id": "frame_no % 16777216", "Vxlan.reserved_2": "frame_no % 256"},
        layout("'0800'", ("frame_no % 65536", 4), ("frame_no % 16777216", 6), ("frame_no % 256", 2)), "Eth,Ipv4,Udp,Vxlan", {"Vxlan.vni_is_valid": "1"},
    ),
    "arp": Header(
        eth("0806"), 28, {"Arp.hardware_type": "1", "Arp.protocol_type": "2048", "Arp.hardware_len": "6", "Arp.protocol_len": "4", "Arp.operation": "1 + frame_no % 2", "Arp.sender_protocol_addr": "src_ip", "Arp.target_protocol_addr": "dst_ip"},
        layout("'000108000604'", ("1 + frame_no % 2", 4), zeros(6), ("src_ip", 8), zeros(6), ("dst_ip", 8)), "Eth,Arp", {"Arp.header_len": "28", "Arp.is_ethernet_ipv4": "1"},
    ),
    "ipv6": Header(
        eth("86dd"), 40, {"Ipv6.version": "6", "Ipv6.traffic_class": "frame_no % 256", "Ipv6.flow_label": "frame_no % 1048576", "Ipv6.payload_length": "payload % 65536", "Ipv6.next_header": "proto", "Ipv6.hop_limit": "64"},
        layout(("6 * 268435456 + frame_no % 256 * 1048576 + frame_no % 1048576", 8), ("payload % 65536", 4), ("proto", 2), "'40'", zeros(32)), "Eth,Ipv6",
    ),
    "icmp": Header(
        ipv4(1), 8, {"Icmp.message_type": "frame_no % 19", "Icmp.code": "frame_no % 16", "Icmp.checksum": "frame_no % 65536", "Icmp.identifier": "src_port", "Icmp.sequence": "dst_port"},
        layout(("frame_no % 19", 2), ("frame_no % 16", 2), ("frame_no % 65536", 4), ("src_port", 4), ("dst_port", 4)), "Eth,Ipv4,Icmp", {"Icmp.rest_of_header": "src_port * 65536 + dst_port"},
    ),
    "icmpv6": Header(
        eth("86dd") + "6000000000083a40" + "00" * 32, 8, {"Icmpv6.message_type": "128 + frame_no % 10", "Icmpv6.code": "frame_no % 7", "Icmpv6.checksum": "frame_no % 65536", "Icmpv6.identifier": "src_port", "Icmpv6.sequence": "dst_port"},
        layout(("128 + frame_no % 10", 2), ("frame_no % 7", 2), ("frame_no % 65536", 4), ("src_port", 4), ("dst_port", 4)), "Eth,Ipv6,Icmpv6", {"Icmpv6.rest_of_header": "src_port * 65536 + dst_port"},
    ),
    "igmp": Header(
        ipv4(2), 8, {"Igmp.message_type": "22", "Igmp.max_resp_time": "frame_no % 256", "Igmp.checksum": "frame_no % 65536", "Igmp.group_addr": "3758096385 + frame_no % 100"},
        layout("'16'", ("frame_no % 256", 2), ("frame_no % 65536", 4), ("3758096385 + frame_no % 100", 8)), "Eth,Ipv4,Igmp",
    ),
    "sctp": Header(
        ipv4(132), 12, {"Sctp.src_port": "src_port", "Sctp.dst_port": "dst_port", "Sctp.verification_tag": "frame_no * 1000 % 4294967296", "Sctp.checksum": "frame_no"},
        layout(("src_port", 4), ("dst_port", 4), ("frame_no * 1000 % 4294967296", 8), ("frame_no", 8)), "Eth,Ipv4,Sctp",
    ),
    "dhcp": Header(
        udp(68, 67), 240, {"Dhcp.op": "1 + frame_no % 2", "Dhcp.htype": "1", "Dhcp.hlen": "6", "Dhcp.hops": "frame_no % 4", "Dhcp.xid": "frame_no * 1000 % 4294967296", "Dhcp.secs": "frame_no % 60", "Dhcp.flags": FLAGS, "Dhcp.ciaddr": "src_ip", "Dhcp.yiaddr": "dst_ip", "Dhcp.siaddr": "dst_ip", "Dhcp.giaddr": "src_ip"},
        layout(("1 + frame_no % 2", 2), "'0106'", ("frame_no % 4", 2), ("frame_no * 1000 % 4294967296", 8), ("frame_no % 60", 4), (FLAGS, 4), ("src_ip", 8), ("dst_ip", 8), ("dst_ip", 8), ("src_ip", 8), zeros(212)), "Eth,Ipv4,Udp,Dhcp",
    ),
    "dns": Header(
        udp(53, 5000), 12, {"Dns.id": "frame_no % 65536", "Dns.qr": "frame_no % 2", "Dns.opcode": "frame_no % 7", "Dns.rcode": "frame_no % 6", "Dns.qdcount": "1", "Dns.ancount": "frame_no % 5", "Dns.nscount": "frame_no % 3", "Dns.arcount": "frame_no % 2"},
        layout(("frame_no % 65536", 4), ("frame_no % 2 * 128 + frame_no % 7 * 8", 2), ("frame_no % 6", 2), "'0001'", ("frame_no % 5", 4), ("frame_no % 3", 4), ("frame_no % 2", 4)), "Eth,Ipv4,Udp,Dns",
        {"Dns.aa": "0", "Dns.tc": "0", "Dns.rd": "0", "Dns.ra": "0", "Dns.z": "0", "Dns.ad": "0", "Dns.cd": "0"},
    ),
    "ntp": Header(
        udp(123, 123), 48, {"Ntp.leap_indicator": "frame_no % 4", "Ntp.version": "4", "Ntp.mode": "frame_no % 8", "Ntp.stratum": "frame_no % 16", "Ntp.poll": "frame_no % 100", "Ntp.precision": "frame_no % 100", "Ntp.root_delay": "frame_no", "Ntp.root_dispersion": "frame_no * 3"},
        layout(("frame_no % 4 * 64 + 32 + frame_no % 8", 2), ("frame_no % 16", 2), ("frame_no % 100", 2), ("frame_no % 100", 2), ("frame_no", 8), ("frame_no * 3", 8), zeros(36)), "Eth,Ipv4,Udp,Ntp",
    ),
    "tls": Header(
        ipv4(6) + "01bb1388" + "00" * 8 + "5018" + "00" * 6, 5, {"Tls.content_type": "20 + frame_no % 5", "Tls.legacy_version": "771", "Tls.length": "frame_no % 16"},
        layout(("20 + frame_no % 5", 2), "'0303'", ("frame_no % 16", 4)), "Eth,Ipv4,Tcp,Tls", after="frame_no % 16",
    ),
}


def decoded(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """frame_no, layers, header (hex of the innermost layer's first bytes) and its fields, read through the dissector."""
    from flowlake.operators import dissect

    h = HEADERS[name]
    layer = h.layers.rpartition(",")[2]
    rows = packets(spark, sf_dir).withColumn("h", F.expr(h.base) if h.base else F.lit(bytes(h.size)))
    for f, value in h.writes.items():
        rows = rows.withColumn("h", fields.write(F.col("h"), f, F.expr(value)))
    tail = F.unhex(F.expr(f"repeat('00', cast({h.after} as int))"))
    data = F.concat(F.unhex(F.lit(h.before)), F.col("h"), tail) if h.before else F.concat(F.col("h"), tail)
    found = dissect.dissect(rows.select("frame_no", data.alias("data"), F.lit(h.link).alias("link_type")))
    found = found.select("frame_no", F.array_join("layers.protocol", ",").alias("layers"), dissect.layer_bytes(layer).alias("own"))
    return found.select("frame_no", "layers", F.hex(F.substring("own", 1, h.size)).alias("header"), *[fields.read(F.col("own"), f).cast("bigint").alias(f.split(".")[1]) for f in (*h.writes, *h.reads)])


for _name, _h in HEADERS.items():
    QUERIES[f"decode_{_name}"] = lambda spark, sf_dir, n=_name: decoded(spark, sf_dir, n)
    SQL[f"decode_{_name}"] = PACKETS_SQL + f" SELECT frame_no, '{_h.layers}' AS layers, {_h.layout} AS header, " + ", ".join(f"CAST({v} AS BIGINT) AS {f.split('.')[1]}" for f, v in (_h.writes | _h.reads).items()) + " FROM pk"


# Capture files.


def registered(spark: SparkSession) -> SparkSession:
    from flowlake.sources.capture import CaptureSource

    spark.dataSource.register(CaptureSource)
    return spark


#: Fractions of a microsecond, so that nanoseconds show.
NANOS = "ts_ns + frame_no % 1000"


def nanos_files(spark: SparkSession, sf_dir: str) -> str:
    """The frames as pcap files with nanoseconds, written through the data source in two appends; returns their folder."""
    root = scratch(registered(spark), "captures")
    rows = packets(spark, sf_dir).withColumn("ts_ns", F.expr(NANOS))
    #: A file is one task when it is read, so there are as many as can be read at once.
    files = max(4, spark.sparkContext.defaultParallelism)
    for part in (0, 1):
        #: Frames are crafted once they are dealt, so the sample that finds the ranges doesn't craft them too.
        own = frames(rows.where(F.col("frame_no") % 2 == part).repartitionByRange(files, "frame_no").sortWithinPartitions("frame_no"))
        own.select("ts_ns", "orig_len", "link_type", "data").write.format("capture").mode("append").option("nanos", "true").option("endian", "little" if part else "big").save(root)
    return root


@query(f" SELECT {NANOS} AS ts_ns, orig_len, CAST(length(frame) // 2 AS INTEGER) AS cap_len, 1 AS link_type, sha256(unhex(frame)) AS data_sha256, false AS truncated, 0 AS section, 0 AS interface_id FROM fr", FRAMES_SQL)
def capture_roundtrip(spark, sf_dir):
    """Frames through the capture sink and source."""
    from flowlake.sources import capture

    rows = registered(spark).read.format("capture").load(nanos_files(spark, sf_dir)).where("error is null")
    return rows.select("ts_ns", "orig_len", "cap_len", "link_type", F.sha2("data", 256).alias("data_sha256"), capture.truncated().alias("truncated"), "section", "interface_id")


@query(" SELECT frame_no, ts_ns // 1000 * 1000 AS ts_ns, orig_len, CAST(length(frame) // 2 AS BIGINT) AS cap_len, sha256(unhex(frame)) AS data_sha256 FROM fr", FRAMES_SQL)
def pcap_roundtrip(spark, sf_dir):
    """Packets to one pcap file for each hour, and back."""
    from flowlake.sources import capture

    hours = crafted(spark, sf_dir).withColumn("path", F.concat(F.expr(f"ts_ns div {HOUR}").cast("string"), F.lit(".pcap")))
    root = scratch(spark, "hours")
    capture.write_pcaps(hours, root).count()
    #: Frames are numbered within captures, where an hour's frames lie in order; they needn't follow each other in the table.
    place = F.row_number().over(Window.partitionBy("path").orderBy("frame_no")).cast("bigint")
    numbers = hours.select(F.col("path").alias("name"), place.alias("place"), "frame_no")
    back = registered(spark).read.format("capture").load(root)
    back = back.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("frame_no").alias("place"), "ts_ns", "orig_len", F.col("cap_len").cast("bigint").alias("cap_len"), F.sha2("data", 256).alias("data_sha256"))
    return back.join(numbers, ["name", "place"]).select("frame_no", "ts_ns", "orig_len", "cap_len", "data_sha256")


_PCAP = f"'A1B2C3D40002000400000000000000000000FFFF00000001' || string_agg({hexed('ts_ns // 1000000000', 8)} || {hexed('ts_ns % 1000000000 // 1000', 8)} || {hexed('length(frame) // 2', 8)} || {hexed('orig_len', 8)} || frame, '' ORDER BY frame_no)"


@query(f" SELECT CAST(ts_ns // {HOUR} AS VARCHAR) || '.pcap' AS file, md5(unhex({_PCAP})) AS md5, sha256(unhex({_PCAP})) AS sha256, CAST(length({_PCAP}) // 2 AS BIGINT) AS length FROM fr GROUP BY ts_ns // {HOUR}", FRAMES_SQL)
def pcap_digests(spark, sf_dir):
    """Every byte of the pcap files that are written."""
    from flowlake.sources import capture

    hours = crafted(spark, sf_dir).withColumn("path", F.concat(F.expr(f"ts_ns div {HOUR}").cast("string"), F.lit(".pcap")))
    root = scratch(spark, "hours")
    capture.write_pcaps(hours, root).count()
    found = capture.file_digests(spark, root)
    return found.select(F.element_at(F.split("path", "/"), -1).alias("file"), "md5", "sha256", "length")


def option(code: int, value: bytes) -> bytes:
    return code.to_bytes(2, "big") + len(value).to_bytes(2, "big") + value + bytes(-len(value) % 4)


def block(kind: int, body: bytes) -> bytes:
    size = (12 + len(body)).to_bytes(4, "big")
    return kind.to_bytes(4, "big") + size + body + size


def pcapng_head() -> bytes:
    """A section with two interfaces, nanoseconds and microseconds, and a block of a kind that isn't known."""
    section = block(0x0A0D0D0A, bytes.fromhex("1a2b3c4d00010000ffffffffffffffff") + option(2, b"bench") + option(0, b""))
    nanos = block(1, bytes.fromhex("0001000000001000") + option(2, b"eth0") + option(9, b"\x09") + option(0, b""))
    micros = block(1, bytes.fromhex("0001000000002000") + option(2, b"eth1") + option(0, b""))
    return section + nanos + micros + block(0x0BAD, b"some")


def pcapng_files(spark: SparkSession, sf_dir: str) -> str:
    """The frames as one pcapng file for each of five parts, odd ones on the microsecond interface; returns the folder."""
    from flowlake.functions.fields import to_bytes
    from flowlake.sources import capture

    link = F.col("frame_no") % 2
    ticks = F.when(link == 0, F.expr(NANOS)).otherwise(F.expr(f"({NANOS}) div 1000"))
    size, pad = F.length("data"), F.pmod(-F.length("data"), F.lit(4))
    flags = F.concat(F.unhex(F.lit("00020004")), to_bytes(F.col("frame_no") % 4, 4), F.unhex(F.lit("00000000")))
    body = F.concat(to_bytes(link, 4), to_bytes(F.shiftright(ticks, 32), 4), to_bytes(ticks, 4), to_bytes(size, 4), to_bytes(F.col("orig_len"), 4), F.col("data"), F.unhex(F.repeat(F.lit("00"), pad)), flags)
    whole = to_bytes(F.length("_body") + 12, 4)
    rows = crafted(spark, sf_dir).withColumn("_body", body).select(F.concat(F.lit("part"), (F.col("frame_no") % 5).cast("string"), F.lit(".pcapng")).alias("file"), "frame_no", F.concat(F.unhex(F.lit("00000006")), whole, F.col("_body"), whole).alias("part"))
    root = scratch(spark, "pcapng")
    capture.write_parts(rows, root, ("frame_no",), pcapng_head()).count()
    return root


def file_of(path: str = "path"):
    return F.element_at(F.split(path, "/"), -1)


_PART = "'part' || (frame_no % 5) || '.pcapng'"


@query(
    f""" SELECT {_PART} AS file, row_number() OVER (PARTITION BY frame_no % 5 ORDER BY frame_no) AS frame_no, 0 AS section, CAST(frame_no % 2 AS INTEGER) AS interface_id,
  CASE WHEN frame_no % 2 = 0 THEN {NANOS} ELSE ({NANOS}) // 1000 * 1000 END AS ts_ns, orig_len, CAST(length(frame) // 2 AS INTEGER) AS cap_len, 1 AS link_type, sha256(unhex(frame)) AS data_sha256 FROM fr""",
    FRAMES_SQL,
)
def pcapng_packets(spark, sf_dir):
    rows = registered(spark).read.format("capture").load(pcapng_files(spark, sf_dir) + "/part[0-4].pcapn?")
    return rows.select(file_of().alias("file"), "frame_no", "section", "interface_id", "ts_ns", "orig_len", "cap_len", "link_type", F.sha2("data", 256).alias("data_sha256"))


@query(
    f""" , p AS (SELECT {_PART} AS file, count(*) AS n, CAST(sum(frame_no % 4) AS BIGINT) AS flags, CAST(sum(44 + length(frame) // 2 + (-(length(frame) // 2)) % 4 + CASE WHEN length(frame) // 2 % 4 > 0 THEN 4 ELSE 0 END) AS BIGINT) AS bytes FROM fr GROUP BY 1)
  SELECT file, 'packet' AS role, CAST(6 AS BIGINT) AS block_type, n AS blocks, flags, bytes, '' AS name FROM p
  UNION ALL SELECT file, role, CAST(kind AS BIGINT), CAST(1 AS BIGINT), CAST(0 AS BIGINT), CAST(size AS BIGINT), name FROM p, (VALUES ('section', 168627466, 44, 'bench'), ('interface', 1, 40, 'eth0'), ('interface', 1, 32, 'eth1'), ('other', 2989, 16, '')) AS t(role, kind, size, name)""",
    FRAMES_SQL,
)
def pcapng_blocks(spark, sf_dir):
    """Blocks by kind, their bytes and what their options hold."""
    from flowlake.sources import capture

    files = capture.listed(spark, pcapng_files(spark, sf_dir))
    rows = capture.read_blocks(files).where("error is null")
    first = lambda k: F.try_element_at("options", F.lit(k))[0]
    rows = rows.select(file_of().alias("file"), "role", "block_type", F.length("raw").cast("bigint").alias("size"), fields.unsigned(first("flags")).alias("flag"), F.coalesce(first("name").cast("string"), first("hardware").cast("string"), F.lit("")).alias("name"))
    return rows.groupBy("file", "role", "block_type", "name").agg(F.count(F.lit(1)).alias("blocks"), F.coalesce(F.sum("flag"), F.lit(0)).alias("flags"), F.sum("size").alias("bytes")).select("file", "role", "block_type", "blocks", "flags", "bytes", "name")


@query(f" SELECT DISTINCT {_PART} AS file, 0 AS section, i AS interface_id, 1 AS link_type, s AS snap_len, 10 AS res_base, r AS res_exp, CAST(1 AS INTEGER) AS major, CAST(0 AS INTEGER) AS minor, CAST(-1 AS BIGINT) AS length, 'bench' AS hardware FROM fr, (VALUES (0, CAST(4096 AS BIGINT), 9), (1, CAST(8192 AS BIGINT), 6)) AS t(i, s, r)", FRAMES_SQL)
def pcapng_interfaces(spark, sf_dir):
    """Interfaces, with the section that they are in."""
    from flowlake.sources import capture

    files = capture.listed(spark, pcapng_files(spark, sf_dir))
    sections = capture.read_sections(files).select("path", "section", "major", "minor", "length", "hardware")
    return capture.read_interfaces(files).join(sections, ["path", "section"]).select(file_of().alias("file"), "section", "interface_id", "link_type", "snap_len", "res_base", "res_exp", "major", "minor", "length", "hardware")


# Damage: a file is cut or changed at one place, and the rows before it stay.

_WHOLE = "a1b2c3d40002000400000000000000000000ffff00000001" + "43b827a50001e2400000000400000004" + "01020304" + "43b827a60001e2400000000400000008" + "05060708"
_NG = pcapng_head().hex()
_EPB = "000000060000002400000000000000000000000700000004000000046162636400000024"
_HUGE = block(0x0A0D0D0A, bytes.fromhex("1a2b3c4d00010000ffffffffffffffff")) + block(1, bytes.fromhex("0001000000001000") + option(9, b"\x00") + option(0, b""))
_LATE = "000000060000002400000000ffffffffffffffff00000004000000046162636400000024"
# Bytes, and (packets, their last time, the error's kind) that reading them gives.
DAMAGED = {
    "whole": (_WHOLE, 2, 1136142246123456000, None),
    "no magic": ("00" + _WHOLE[2:], 0, None, "InvalidMagicNumber"),
    "short header": (_WHOLE[:40], 0, None, "TruncatedCapture"),
    "record cut": (_WHOLE[:-2], 1, 1136142245123456000, "TruncatedCapture"),
    "record header cut": (_WHOLE[: 2 * 24 + 40 + 10], 1, 1136142245123456000, "TruncatedCapture"),
    "empty": ("", 0, None, "InvalidMagicNumber"),
    "pcapng": (_NG + _EPB + _EPB, 2, 7, None),
    "pcapng trailer": (_NG + _EPB + _EPB[:-2] + "25", 1, 7, "BlockTotalLengthMismatch"),
    "pcapng cut": (_NG + _EPB + _EPB[:-8], 1, 7, "TruncatedCapture"),
    "pcapng odd length": (_NG + _EPB + "000000060000002500000000", 1, 7, "InvalidBlockTotalLength"),
    "pcapng interface": (_NG + _EPB.replace("0000002400000000", "0000002400000009", 1), 0, None, "InvalidInterfaceId"),
    "pcapng no interface": (_NG[:88] + _EPB, 0, None, "MissingPcapngIDB"),
    "pcapng late": (_HUGE.hex() + _EPB + _LATE, 1, 7_000_000_000, "TimestampOutOfRange"),
    "pcapng byte order": ("0a0d0d0a0000001c11111111" + "00" * 16, 0, None, "InvalidMagicNumber"),
}


SQL["damaged_captures"] = "SELECT name, CAST(packets AS BIGINT) AS packets, CAST(last_ns AS BIGINT) AS last_ns, error FROM (VALUES " + ", ".join(f"('{n}', {p}, {-1 if t is None else t}, '{e or ''}')" for n, (_, p, t, e) in DAMAGED.items()) + ") AS t(name, packets, last_ns, error)"


def damaged_captures(spark, sf_dir):
    from flowlake.sources import capture

    files = spark.createDataFrame([(n, bytearray.fromhex(h)) for n, (h, *_) in DAMAGED.items()], "path string, content binary")
    rows = capture.read_packets(files)
    bad = F.col("error").isNotNull()
    counts = rows.groupBy(F.col("path").alias("name")).agg(F.count_if(~bad).alias("packets"), F.max(F.when(~bad, F.col("ts_ns"))).alias("last_ns"), F.max(F.split_part("error", F.lit(":"), F.lit(1))).alias("error"))
    return files.select(F.col("path").alias("name")).join(counts, "name", "left").select("name", F.coalesce("packets", F.lit(0)).alias("packets"), F.coalesce("last_ns", F.lit(-1)).alias("last_ns"), F.coalesce("error", F.lit("")).alias("error"))


QUERIES["damaged_captures"] = damaged_captures


# Tools over files.


@query(
    """ , k AS (SELECT src_ip AS ip, count(*) AS packets, CAST(24 + sum(16 + length(frame) // 2) AS BIGINT) AS bytes, CAST(sum(length(frame) // 2) AS BIGINT) AS data, min(ts_ns // 1000 * 1000) AS first_ns, max(ts_ns // 1000 * 1000) AS last_ns FROM fr GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20)
  SELECT concat_ws('.', ip >> 24 & 255, ip >> 16 & 255, ip >> 8 & 255, ip & 255) || '.pcap' AS file, packets, bytes, data, first_ns, last_ns FROM k""",
    FRAMES_SQL,
)
def split_pcap_files(spark, sf_dir):
    """One pcap for each of the 20 sources with most packets, read back."""
    from flowlake.operators import dissect
    from flowlake.plans import tools

    rows = dissect.dissect(crafted(spark, sf_dir).select("path", "frame_no", "ts_ns", "orig_len", "data", "link_type"), max_depth=3)
    root = scratch(spark, "split")
    done = spark.createDataFrame(tools.split_files(rows, root, "src-ip", top=20).collect(), "file string, parts long, bytes long")
    back = registered(spark).read.format("capture").load(root).groupBy(file_of().alias("file")).agg(F.count(F.lit(1)).alias("packets"), F.sum("cap_len").alias("data"), F.min("ts_ns").alias("first_ns"), F.max("ts_ns").alias("last_ns"))
    return back.join(done, "file").where("packets = parts").select("file", "packets", "bytes", "data", "first_ns", "last_ns")


_TEXT_IP = "concat_ws('.', {0} >> 24 & 255, {0} >> 16 & 255, {0} >> 8 & 255, {0} & 255)"


@query(
    f""" SELECT ts_ns AS timestamp, orig_len AS length, CAST(2048 AS BIGINT) AS eth_type, {_TEXT_IP.format('src_ip')} AS src_ip, {_TEXT_IP.format('dst_ip')} AS dst_ip, proto AS ip_proto, CAST(0 AS BIGINT) AS tos, CAST(frame_no % 200 + 20 AS BIGINT) AS ttl,
  CAST(payload + header_len + 20 AS BIGINT) AS total_length, src_port, dst_port, tcp_flags, CAST(CASE WHEN proto = 6 THEN 4096 ELSE 0 END AS BIGINT) AS tcp_window, CAST(CASE WHEN proto = 6 THEN 5 ELSE 0 END AS BIGINT) AS tcp_data_offset,
  CAST(CASE WHEN proto = 17 THEN payload + 8 ELSE 0 END AS BIGINT) AS udp_length, CAST(0 AS BIGINT) AS ipv6_payload_length FROM pk"""
)
def metadata_dump(spark, sf_dir):
    """The metadata dump as CSV, read back with its header."""
    from flowlake.operators import dissect
    from flowlake.plans import tools

    root = scratch(spark, "dump")
    tools.dump_csv(dissect.metadata(dissect.dissect(crafted(spark, sf_dir))), root)
    kinds = ", ".join(f"{c} {'string' if c in ('src_ip', 'dst_ip') else 'long'}" for c in ("timestamp", "length", "eth_type", "src_ip", "dst_ip", "ip_proto", "tos", "ttl", "total_length", "src_port", "dst_port", "tcp_flags", "tcp_window", "tcp_data_offset", "udp_length", "ipv6_payload_length"))
    return spark.read.schema(kinds).option("header", True).option("enforceSchema", False).csv(root)


# Streams, run once over what is there; intervals and flows that the watermark hasn't passed stay in state.


#: State on disk and in a bounded cache instead of the executors' heaps, which it would fill: it has a row for each interval and key.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": "false",
}


def once(stream: DataFrame, spark: SparkSession, label: str) -> DataFrame:
    root = scratch(spark, label)
    before = {k: spark.conf.get(k, None) for k in STATE}
    for k, v in STATE.items():
        spark.conf.set(k, v)
    try:
        q = stream.writeStream.format("parquet").option("path", f"{root}/rows").option("checkpointLocation", f"{root}/state").start()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return spark.read.schema(stream.schema).parquet(f"{root}/rows")


_SYM = "CASE WHEN src_ip < dst_ip OR (src_ip = dst_ip AND src_port <= dst_port) THEN {} ELSE {} END"
_FLOW = "(" + ", ".join(_SYM.format(a, b) for a, b in (("src_ip", "dst_ip"), ("src_port", "dst_port"), ("dst_ip", "src_ip"), ("dst_port", "src_port"))) + ", proto)"


@query(
    f""" , t AS (SELECT *, {NANOS} AS tn FROM pk)
  SELECT tn - tn % {HOUR} AS start_timestamp_ns, tn - tn % {HOUR} + {HOUR} AS end_timestamp_ns_exclusive, count(*) AS total_packets, CAST(sum(orig_len) AS BIGINT) AS total_l2_bytes, round(count(*) / 3600.0::DOUBLE, 6) AS packets_per_second,
    round(CAST(sum(orig_len) AS BIGINT) / 3600.0::DOUBLE, 6) AS bytes_per_second, count(DISTINCT src_ip) AS unique_src_ips, count(DISTINCT dst_ip) AS unique_dst_ips, count(DISTINCT {_FLOW}) AS unique_flows
  FROM t GROUP BY 1, 2 HAVING tn - tn % {HOUR} + {HOUR} <= (SELECT max(tn) // 1000000 * 1000000 FROM t)"""
)
def stream_intervals(spark, sf_dir):
    """Interval statistics of a stream of capture files, with distinct counts."""
    from flowlake.operators import dissect
    from flowlake.streaming import captures

    root = nanos_files(spark, sf_dir)
    stream = spark.readStream.format("capture").load(root)
    rows = dissect.split_packets(dissect.dissect(stream.select("path", "frame_no", "ts_ns", "orig_len", "data", "link_type"), max_depth=3)).withColumn("parsed", F.lit(True))
    found = once(captures.interval_stream(rows, HOUR // 1000, "0 seconds", unique=True), spark, "stream-intervals")
    return found.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in found.dtypes])


@query(
    f""" SELECT ts_ns - ts_ns % {HOUR} AS start_timestamp_ns, ts_ns - ts_ns % {HOUR} + {HOUR} AS end_timestamp_ns_exclusive, count(*) AS total_packets, CAST(sum(orig_len) AS BIGINT) AS total_l2_bytes,
  round(count(*) / 3600.0::DOUBLE, 6) AS packets_per_second, round(CAST(sum(orig_len) AS BIGINT) / 3600.0::DOUBLE, 6) AS bytes_per_second, count(DISTINCT src_ip) AS unique_src_ips, count(DISTINCT dst_ip) AS unique_dst_ips, count(DISTINCT {_FLOW}) AS unique_flows
  FROM pk GROUP BY 1, 2"""
)
def interval_csv(spark, sf_dir):
    """Interval statistics through their CSV sink."""
    from flowlake.operators import summary
    from flowlake.plans import tools

    root = scratch(spark, "interval-csv")
    tools.write_intervals(summary.intervals(packets(spark, sf_dir), HOUR), root)
    kinds = ", ".join(f"{c} {'double' if c.endswith('second') else 'long'}" for c in ("start_timestamp_ns", "end_timestamp_ns_exclusive", "total_packets", "total_l2_bytes", "packets_per_second", "bytes_per_second", "unique_src_ips", "unique_dst_ips", "unique_flows"))
    found = spark.read.schema(kinds).option("header", True).option("enforceSchema", False).csv(root)
    return found.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in found.dtypes])


#: A packet without data, one that is no Ethernet frame, and a record that is cut.
_BAD = "a1b2c3d40002000400000000000000000000ffff00000001" + "43b827a50001e240000000000000003c" + "43b827a50001e2400000000400000004" + "01020304" + "43b827a6"


@query(
    " SELECT count(*) + 2 AS packets, CAST(sum(orig_len) + 64 AS BIGINT) AS l2_bytes, CAST(sum(l3_len) AS BIGINT) AS l3_bytes, count(*) FILTER (proto = 6) AS tcp_packets, count(*) FILTER (proto = 17) AS udp_packets, CAST(2 AS BIGINT) AS unparsed, CAST(1 AS BIGINT) AS empty_packets, CAST(1 AS BIGINT) AS read_errors,"
    f" min(orig_len) AS min_len, max(orig_len) AS max_len, count(DISTINCT src_ip) AS unique_src_ips, count(DISTINCT {_FLOW}) AS unique_flows FROM pk"
)
def capture_report(spark, sf_dir):
    """The report's totals over whole files, one of them with an empty packet, one that can't be parsed, and damage."""
    from flowlake.operators import dissect, summary
    from flowlake.sources import capture

    root = nanos_files(spark, sf_dir)
    capture.write_files(spark.createDataFrame([("bad.pcap", bytearray.fromhex(_BAD))], "file string, content binary"), root).count()
    read = spark.read.format("capture").load(root).withColumn("path", F.lit("all"))
    meta = dissect.metadata(dissect.dissect(read, max_depth=3))
    ip = lambda c: fields.unsigned(F.col(c))
    rows = meta.withColumn("src_ip", ip("src_addr")).withColumn("dst_ip", ip("dst_addr")).withColumn("proto", F.col("ip_proto"))
    return summary.totals(rows).select("packets", "l2_bytes", "l3_bytes", "tcp_packets", "udp_packets", "unparsed", "empty_packets", "read_errors", "min_len", "max_len", "unique_src_ips", "unique_flows")


@query(f"""{" , sh AS (SELECT * REPLACE (ts_ns + (frame_no * 7919) % 11 * 60000000000 AS ts_ns) FROM fr)"} SELECT frame_no % 3 AS file, ts_ns // 1000 * 1000 AS ts_ns, sha256(unhex(frame)) AS data_sha256, row_number() OVER (PARTITION BY frame_no % 3 ORDER BY ts_ns // 1000, frame_no) AS place FROM sh""", FRAMES_SQL)
def reordered_files(spark, sf_dir):
    """Three pcap files whose times go backwards, written again in the order of time."""
    from flowlake.plans import tools
    from flowlake.sources import capture

    rows = crafted(spark, sf_dir).withColumn("ts_ns", F.col("ts_ns") + F.pmod(F.col("frame_no") * 7919, F.lit(11)) * 60_000_000_000)
    source, target = scratch(spark, "unordered"), scratch(spark, "ordered")
    capture.write_pcaps(rows.withColumn("path", F.concat((F.col("frame_no") % 3).cast("string"), F.lit(".pcap"))), source).count()
    tools.reorder_files(spark, source, target).count()
    back = registered(spark).read.format("capture").load(target)
    return back.select(F.substring(file_of(), 1, 1).cast("bigint").alias("file"), "ts_ns", F.sha2("data", 256).alias("data_sha256"), F.col("frame_no").alias("place"))
