"""Addresses, times and names as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SECOND = 1_000_000_000


def ipv4_text(ip: Column) -> Column:
    return F.concat_ws(".", *[F.shiftright(ip, s).bitwiseAND(255).cast("string") for s in (24, 16, 8, 0)])


def ipv4_number(text: Column) -> Column:
    """The integer of a dotted address, null for anything else."""
    parts = F.split(text, r"\.")
    total = sum((F.try_element_at(parts, F.lit(i + 1)).try_cast("bigint") * (1 << 24 - 8 * i) for i in range(4)), F.lit(0).cast("bigint"))
    return F.when(text.rlike(r"^(25[0-5]|2[0-4]\d|1?\d?\d)(\.(25[0-5]|2[0-4]\d|1?\d?\d)){3}$"), total)


def ipv6_text(addr: Column) -> Column:
    """Eight groups in lower case, the longest run of two or more zero groups (the first such) shortened."""
    groups = [F.lower(F.conv(F.hex(F.substring(addr, 2 * i + 1, 2)), 16, 16)) for i in range(8)]
    plain = F.concat_ws(":", *groups)
    out = plain
    for n in range(2, 9):
        hole = r"(^|:)0(:0){" + str(n - 1) + r"}(?=:|$)"
        out = F.when(plain.rlike(hole), F.regexp_replace(F.regexp_replace(plain, "^(.*?)" + hole, "$1::"), ":::+", "::")).otherwise(out)
    return out


def address_text(addr: Column) -> Column:
    """Text of a 4- or 16-byte address."""
    return F.when(F.length(addr) == 4, ipv4_text(F.conv(F.hex(addr), 16, 10).cast("bigint"))).when(F.length(addr) == 16, ipv6_text(addr))


def mac_text(addr: Column) -> Column:
    return F.concat_ws(":", *[F.hex(F.substring(addr, i, 1)) for i in range(1, 7)])


def mac_bytes(text: Column) -> Column:
    return F.when(text.rlike("^([0-9A-Fa-f]{2}:){5}[0-9A-Fa-f]{2}$"), F.unhex(F.regexp_replace(text, ":", "")))


def seconds_text(ns: Column) -> Column:
    """sec.nnnnnnnnn, with the floor for times before the epoch."""
    return F.concat(F.floor(ns / F.lit(SECOND).cast("decimal(20,0)")).cast("string"), F.lit("."), F.lpad(F.pmod(ns, F.lit(SECOND)).cast("string"), 9, "0"))


def iso_text(ns: Column) -> Column:
    """ISO 8601 in UTC with as many digits of the second as are needed."""
    fraction = F.pmod(ns, F.lit(SECOND))
    whole = F.date_format(F.timestamp_seconds((ns - fraction) / SECOND), "yyyy-MM-dd'T'HH:mm:ss")
    digits = F.regexp_replace(F.lpad(fraction.cast("string"), 9, "0"), "0+$", "")
    return F.concat(whole, F.when(fraction != 0, F.concat(F.lit("."), digits)).otherwise(""), F.lit("Z"))


def same_endpoint_order(src: Column, sport: Column, dst: Column, dport: Column) -> Column:
    """Whether (src, sport) comes first; the pair moves as one."""
    return (src < dst) | ((src == dst) & (sport <= dport))
