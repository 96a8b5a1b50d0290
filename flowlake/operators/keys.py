"""Flow keys, symmetric and not, from one to five parts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from flowlake.functions.net import ipv4_text, same_endpoint_order

GRANULARITIES = ("src-ip", "dst-ip", "tuple2", "tuple2-sym", "tuple3", "tuple3-sym", "tuple4", "tuple4-sym", "tuple5", "tuple5-sym")


def ends(symmetric: bool, ports: bool) -> tuple[Column, Column, Column, Column]:
    """Columns (src, sport, dst, dport) in key order."""
    src, dst, sport, dport = (F.col(c) for c in ("src_ip", "dst_ip", "src_port", "dst_port"))
    if not symmetric:
        return src, sport, dst, dport
    first = same_endpoint_order(src, sport, dst, dport) if ports else src <= dst
    return tuple(F.when(first, a).otherwise(b) for a, b in ((src, dst), (sport, dport), (dst, src), (dport, sport)))


def parts(granularity: str) -> list[Column]:
    """The key's columns: ip | a, b | a, b, proto | a, a_port, b, b_port | a, a_port, b, b_port, proto."""
    if granularity in ("src-ip", "dst-ip"):
        return [F.col(granularity.replace("-", "_")).alias("ip")]
    if granularity not in GRANULARITIES:
        raise ValueError(f"unknown granularity {granularity}")
    size = int(granularity[5])
    a, sport, b, dport = ends(granularity.endswith("-sym"), size >= 4)
    out = [a.alias("a"), b.alias("b")] if size < 4 else [a.alias("a"), sport.alias("a_port"), b.alias("b"), dport.alias("b_port")]
    return out + ([F.col("proto").alias("proto")] if size in (3, 5) else [])


def key(granularity: str) -> Column:
    return F.struct(*parts(granularity))


def summary_key() -> Column:
    """The report's flow: five parts for TCP and UDP with ports, three parts for other protocols, else null."""
    five, three = ends(True, True), ends(True, False)
    tcp_udp = F.col("proto").isin(6, 17)
    none = F.lit(None).cast("bigint")
    return F.when(
        F.col("src_ip").isNotNull() & F.col("dst_ip").isNotNull() & F.col("proto").isNotNull() & (~tcp_udp | (F.col("src_port").isNotNull() & F.col("dst_port").isNotNull())),
        F.struct(
            F.when(tcp_udp, five[0]).otherwise(three[0]).alias("a"),
            F.when(tcp_udp, five[1].cast("bigint")).otherwise(none).alias("a_port"),
            F.when(tcp_udp, five[2]).otherwise(three[2]).alias("b"),
            F.when(tcp_udp, five[3].cast("bigint")).otherwise(none).alias("b_port"),
            F.col("proto").alias("proto"),
        ),
    )


def file_name(granularity: str) -> Column:
    """Name of a key's capture file; takes the columns of parts()."""
    ip = lambda c: ipv4_text(F.col(c))
    if granularity in ("src-ip", "dst-ip"):
        return F.concat(ip("ip"), F.lit(".pcap"))
    size = int(granularity[5])
    left, right = (F.concat_ws(":", ip(c), F.col(f"{c}_port").cast("string")) if size >= 4 else ip(c) for c in ("a", "b"))
    return F.concat(F.concat_ws("_", left, right, *([F.col("proto").cast("string")] if size in (3, 5) else [])), F.lit(".pcap"))
