"""Option and message walks: variable-length parts of headers as arrays, in Arrow batches, and decoders of single options as expressions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from flowlake.functions.fields import bind, read, rest, u

OPTION = "array<struct<kind:int,len:int,data:binary,malformed:boolean>>"


def tlv(buf: bytes, end: int | None, pad: int | None, own_header: bool) -> list[dict]:
    """end and pad are single bytes; own_header: the length counts kind and length too.  What can't be read ends the walk as malformed."""
    out, at = [], 0
    while at < len(buf):
        kind = buf[at]
        if kind in (end, pad):
            out.append({"kind": kind, "len": 1, "data": b"", "malformed": False})
            at += 1
            if kind == end:
                break
            continue
        size = buf[at + 1] if at + 1 < len(buf) else -1
        whole = size if own_header else size + 2
        if size < (2 if own_header else 0) or at + whole > len(buf):
            out.append({"kind": kind, "len": len(buf) - at, "data": buf[at + 1 :], "malformed": True})
            break
        out.append({"kind": kind, "len": size, "data": buf[at + 2 : at + whole], "malformed": False})
        at += whole
    return out


def chunks(buf: bytes) -> list[dict]:
    """SCTP chunks, padded to 4 bytes: kind, flags in the first data byte's place are left out of data."""
    out, at = [], 0
    while at < len(buf):
        size = int.from_bytes(buf[at + 2 : at + 4], "big") if at + 4 <= len(buf) else 0
        if size < 4 or at + size > len(buf):
            out.append({"kind": buf[at], "len": len(buf) - at, "data": buf[at:], "malformed": True})
            break
        out.append({"kind": buf[at], "len": size, "data": buf[at + 4 : at + size], "malformed": False})
        at += size + -size % 4
    return out


def _walk(f):
    @F.pandas_udf(OPTION)
    def walk(s: pd.Series) -> pd.Series:
        return s.map(lambda b: None if b is None else f(bytes(b)))

    return walk


def ipv4_options(header: Column) -> Column:
    return _walk(lambda b: tlv(b, 0, 1, True))(read(header, "Ipv4.options"))


def tcp_options(header: Column) -> Column:
    return _walk(lambda b: tlv(b, 0, 1, True))(read(header, "Tcp.options"))


def dhcp_options(message: Column) -> Column:
    return _walk(lambda b: tlv(b, 255, 0, False))(read(message, "Dhcp.options_bytes"))


def sctp_chunks(message: Column) -> Column:
    return _walk(chunks)(read(message, "Sctp.chunks"))


def of_kind(options: Column, kind: int) -> Column:
    """The first whole option of a kind."""
    return F.get(F.filter(options, lambda o: (o["kind"] == kind) & ~o["malformed"]), F.lit(0))


# Decoders take an option's data; what has the wrong length is null.


def fixed(data: Column, width: int) -> Column:
    return F.when(F.length(data) == width, u(data, 0, width))


def maximum_segment_size(data: Column) -> Column:
    return fixed(data, 2)


def window_scale(data: Column) -> Column:
    return fixed(data, 1)


def sack_blocks(data: Column) -> Column:
    """(left, right) pairs; the length must be a multiple of 8."""
    at = F.sequence(F.lit(0), F.floor(F.length(data) / 8).cast("int") - 1)
    return F.when((F.length(data) > 0) & (F.length(data) % 8 == 0), F.transform(at, lambda i: F.struct(u(data, i * 8, 4).alias("left"), u(data, i * 8 + 4, 4).alias("right"))))


def tcp_timestamp(data: Column) -> Column:
    return F.when(F.length(data) == 8, F.struct(u(data, 0, 4).alias("value"), u(data, 4, 4).alias("echo")))


def user_timeout(data: Column) -> Column:
    """Minutes or seconds by the granularity bit, and the 15-bit value."""
    return F.when(F.length(data) == 2, F.struct((u(data, 0, 2) >= 0x8000).alias("minutes"), u(data, 0, 2).bitwiseAND(0x7FFF).alias("value")))


def tcp_authentication(data: Column) -> Column:
    """TCP-AO: key id, next key id and the code."""
    return F.when(F.length(data) >= 2, F.struct(u(data, 0, 1).alias("key_id"), u(data, 1, 1).alias("next_key_id"), rest(data, 2).alias("mac")))


def multipath(data: Column) -> Column:
    """MPTCP: subtype, the low bits of its byte, and the rest."""
    return F.when(F.length(data) >= 1, F.struct(F.shiftright(u(data, 0, 1), 4).alias("subtype"), u(data, 0, 1).bitwiseAND(15).alias("low"), rest(data, 1).alias("body")))


def fast_open_cookie(data: Column) -> Column:
    """TFO: the cookie, empty for a request; an even number of 4 to 16 bytes."""
    n = F.length(data)
    return F.when((n == 0) | (n.between(4, 16) & (n % 2 == 0)), data)


def router_alert(data: Column) -> Column:
    return fixed(data, 2)


def stream_id(data: Column) -> Column:
    return fixed(data, 2)


def mtu(data: Column) -> Column:
    """Of an MTU probe or reply."""
    return fixed(data, 2)


def ipv4_route(data: Column) -> Column:
    """Pointer, addresses and bytes that aren't a whole one."""

    def parse(d: Column) -> Column:
        n = F.floor((F.length(d) - 1) / 4).cast("int")
        at = F.filter(F.sequence(F.lit(0), F.greatest(F.lit(0), n - 1)), lambda i: i < n)
        return F.when(F.length(d) >= 1, F.struct(u(d, 0, 1).alias("pointer"), F.transform(at, lambda i: u(d, i * 4 + 1, 4)).alias("addresses"), rest(d, 1 + n * 4).alias("trailing")))

    return bind(data, parse)


def ipv4_timestamp(data: Column) -> Column:
    """Pointer, overflow, flag and entry width: 4 bytes for times alone (flag 0), 8 with addresses."""
    flag = u(data, 1, 1).bitwiseAND(15)
    return F.when(F.length(data) >= 2, F.struct(u(data, 0, 1).alias("pointer"), F.shiftright(u(data, 1, 1), 4).alias("overflow"), flag.alias("flag"), F.when(flag == 0, 4).when(flag.isin(1, 3), 8).alias("entry_width"), rest(data, 2).alias("entries")))


def ipv4_traceroute(data: Column) -> Column:
    return F.when(F.length(data) == 10, F.struct(u(data, 0, 2).alias("id"), u(data, 2, 2).alias("outbound_hops"), u(data, 4, 2).alias("return_hops"), u(data, 6, 4).alias("originator")))


# Message kinds.


def icmp_message(message: Column) -> Column:
    """echo, quoted, redirect, timestamp, address_mask or raw: by type, raw where the body is too short."""
    kind, size = read(message, "Icmp.message_type"), F.length(message) - 4
    return (
        F.when(kind.isin(0, 8) & (size >= 4), "echo")
        .when(kind.isin(3, 4, 11, 12) & (size >= 4), "quoted")
        .when((kind == 5) & (size >= 4), "redirect")
        .when(kind.isin(13, 14) & (size >= 16), "timestamp")
        .when(kind.isin(17, 18) & (size >= 8), "address_mask")
        .otherwise("raw")
    )


def icmpv6_message(message: Column) -> Column:
    kind, size = read(message, "Icmpv6.message_type"), F.length(message) - 4
    ndp = {133: ("router_solicitation", 4), 134: ("router_advertisement", 12), 135: ("neighbor_solicitation", 20), 136: ("neighbor_advertisement", 20), 137: ("redirect", 36)}
    out = F.when(kind.isin(128, 129) & (size >= 4), "echo").when(kind.isin(1, 2, 3, 4) & (size >= 4), "quoted")
    for code, (name, least) in ndp.items():
        out = out.when((kind == code) & (size >= least), name)
    return out.otherwise("raw")
