"""Internet checksums as higher-order expressions over binary columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from flowlake.functions.fields import bind, to_bytes, u, unsigned


def word_sum(data: Column) -> Column:
    """A number congruent modulo 65535 to the sum of 16-bit big-endian words, 0 only for zeros; a last odd byte is the high byte of a word.

    Six bytes are read at once, as 65536 is 1 modulo 65535.
    """

    def total(d: Column) -> Column:
        parts = F.sequence(F.lit(0), F.floor((F.length(d) - 1) / 6).cast("int"))

        def value(i: Column) -> Column:
            return bind(F.substring(d, i * 6 + 1, F.lit(6)), lambda p: unsigned(p) * F.when(F.length(p) % 2 == 1, 256).otherwise(1))

        return F.when(F.length(d) > 0, F.aggregate(parts, F.lit(0).cast("bigint"), lambda a, i: a + value(i))).otherwise(F.lit(0).cast("bigint"))

    return bind(data, total)


def fold(total: Column) -> Column:
    """One's complement of the end-around sum: sums that aren't 0 count modulo 65535, from 1 to 65535."""
    return bind(total, lambda t: F.when(t == 0, F.lit(0xFFFF).cast("bigint")).otherwise(F.lit(0xFFFE).cast("bigint") - F.pmod(t - 1, F.lit(0xFFFF))))


def zeroed(data: Column, offset: int, width: int) -> Column:
    return bind(data, lambda d: F.concat(F.substring(d, 1, offset), to_bytes(F.lit(0), width), F.substring(d, F.lit(offset + width + 1), F.length(d))))


def internet(data: Column) -> Column:
    return fold(word_sum(data))


def ipv4(header: Column) -> Column:
    return internet(zeroed(header, 10, 2))


def ipv4_valid(header: Column) -> Column:
    return u(header, 10, 2) == ipv4(header)


def icmp(message: Column) -> Column:
    return internet(zeroed(message, 2, 2))


def icmp_valid(message: Column) -> Column:
    return u(message, 2, 2) == icmp(message)


def transport(source: Column, target: Column, protocol: int, segment: Column) -> Column:
    """Checksum of a segment under an IPv4 pseudo-header; addresses are integers."""
    pseudo = sum((F.shiftright(x, 16) + x.bitwiseAND(0xFFFF) for x in (source, target)), F.lit(protocol).cast("bigint")) + F.length(segment)
    return fold(pseudo + word_sum(segment))


def tcp(source: Column, target: Column, segment: Column) -> Column:
    return transport(source, target, 6, zeroed(segment, 16, 2))


def tcp_valid(source: Column, target: Column, segment: Column) -> Column:
    return u(segment, 16, 2) == tcp(source, target, segment)


def udp(source: Column, target: Column, datagram: Column) -> Column:
    """A sum of 0 is sent as 0xFFFF."""
    value = transport(source, target, 17, zeroed(datagram, 6, 2))
    return bind(value, lambda v: F.when(v == 0, F.lit(0xFFFF).cast("bigint")).otherwise(v))


def udp_valid(source: Column, target: Column, datagram: Column) -> Column:
    """A stored 0 means that there is none."""
    return (u(datagram, 6, 2) == 0) | (u(datagram, 6, 2) == udp(source, target, datagram))
