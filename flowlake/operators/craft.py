"""Packets built from columns: layers compose with `/` and give one binary expression.

    (eth(src=..., dst=...) / ipv4(src=..., dst=...) / udp(src_port=..., dst_port=...) / raw(F.col("payload"))).build()

Lengths are measured from the innermost layer outwards, then bytes are written with the
checksums of inner bytes already final.  Values may be columns or Python numbers.  Fixed
values are checked when the stack is built (CraftError); lengths of columns that don't fit end
the query with the error's kind.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from flowlake.functions import checksum
from flowlake.functions.fields import bind, to_bytes


class CraftError(ValueError):
    """kind: EmptyStack, RawMustBeTerminal, InvalidField, InvalidLength or LengthOverflow."""

    def __init__(self, kind: str, detail: str = ""):
        super().__init__(f"{kind}: {detail}" if detail else kind)
        self.kind = kind


def col(value: Any) -> Column:
    if isinstance(value, Column):
        return value
    if isinstance(value, (bytes, bytearray)):
        return F.unhex(F.lit(value.hex())) if value else F.lit(b"")
    return F.lit(value).cast("bigint")


def number(value: Any, width: int, name: str, bits: int | None = None) -> Column:
    top = (1 << (bits or 8 * width)) - 1
    if not isinstance(value, Column) and not 0 <= value <= top:
        raise CraftError("InvalidField", f"{name}={value} doesn't fit {bits or 8 * width} bits")
    return col(value)


def checked(length: Column, given: Any, name: str) -> Column:
    """A length that fits 16 bits and is the given one, if one is given; else the query ends."""

    def fail(kind: str, n: Column) -> Column:
        return F.raise_error(F.concat(F.lit(f"{kind}: {name} of "), n.cast("string"), F.lit(" bytes"))).cast("bigint")

    def fits(n: Column) -> Column:
        out = F.when(n > 0xFFFF, fail("LengthOverflow", n))
        if given is not None:
            out = out.when(number(given, 2, name) != n, fail("InvalidLength", n))
        return out.otherwise(n)

    return bind(length, fits)


@dataclass
class Layer:
    """One layer; `protocol` is what a parent infers its next-protocol field from."""

    protocol: str = field(default="", init=False)

    def __truediv__(self, other: Layer | Stack) -> Stack:
        return Stack([self]) / other

    def build(self) -> Column:
        return Stack([self]).build()

    def write(self, child: Layer | None, body: Column | None, parent: Layer | None) -> Column:
        """All bytes from this layer on; body: the child's bytes, null without a child."""
        raise NotImplementedError

    @staticmethod
    def size(body: Column | None) -> Column:
        return F.length(body).cast("bigint") if body is not None else F.lit(0).cast("bigint")


@dataclass
class Stack:
    layers: list[Layer] = field(default_factory=list)

    def __truediv__(self, other: Layer | Stack) -> Stack:
        return Stack(self.layers + (other.layers if isinstance(other, Stack) else [other]))

    def validate(self) -> None:
        if not self.layers:
            raise CraftError("EmptyStack")
        for x in self.layers[:-1]:
            if x.protocol == "Raw":
                raise CraftError("RawMustBeTerminal")

    def build(self) -> Column:
        self.validate()
        body = None
        for i in range(len(self.layers) - 1, -1, -1):
            child = self.layers[i + 1] if i + 1 < len(self.layers) else None
            parent = self.layers[i - 1] if i else None
            body = self.layers[i].write(child, None, parent) if body is None else bind(body, writer(self.layers[i], child, parent))
        return body


def writer(layer: Layer, child: Layer | None, parent: Layer | None):
    return lambda body: layer.write(child, body, parent)


def joined(*parts: Column | None) -> Column:
    return F.concat(*[p for p in parts if p is not None])


@dataclass
class raw(Layer):  # noqa: N801
    payload: Any = b""

    def __post_init__(self):
        self.protocol = "Raw"

    def write(self, child, body, parent):
        if child is not None:
            raise CraftError("RawMustBeTerminal")
        return col(self.payload)


@dataclass
class eth(Layer):  # noqa: N801
    """eth_type is inferred for an IPv4 child, else 0."""

    src: Any = bytes(6)
    dst: Any = bytes(6)
    eth_type: Any = None

    def __post_init__(self):
        self.protocol = "Eth"
        for name in ("src", "dst"):
            v = getattr(self, name)
            if not isinstance(v, Column) and len(v) != 6:
                raise CraftError("InvalidField", f"{name} has {len(v)} bytes")

    def write(self, child, body, parent):
        kind = self.eth_type if self.eth_type is not None else 0x0800 if child and child.protocol == "Ipv4" else 0
        return joined(col(self.dst), col(self.src), to_bytes(number(kind, 2, "eth_type"), 2), body)


def padded(options: bytes, most: int) -> bytes:
    if len(options) > most:
        raise CraftError("InvalidLength", f"options of {len(options)} bytes")
    return options + bytes(-len(options) % 4)


@dataclass
class ipv4(Layer):  # noqa: N801
    """Length, header length, protocol (ICMP, TCP, UDP, else 255) and checksum are filled in where not given."""

    src: Any = 0
    dst: Any = 0
    ttl: Any = 64
    dscp: Any = 0
    ecn: Any = 0
    identification: Any = 0
    flags: Any = 0
    fragment_offset: Any = 0
    next_protocol: Any = None
    total_length: Any = None
    ihl: int | None = None
    checksum: Any = None
    options: bytes = b""

    def __post_init__(self):
        self.protocol = "Ipv4"

    def write(self, child, body, parent):
        options = padded(self.options, 40)
        ihl = 5 + len(options) // 4
        if self.ihl is not None:
            if not ihl <= self.ihl <= 15:
                raise CraftError("InvalidLength", f"ihl {self.ihl}, {ihl} words needed")
            options += bytes(4 * (self.ihl - ihl))
            ihl = self.ihl
        inferred = {"Icmp": 1, "Tcp": 6, "Udp": 17}.get(child.protocol if child else "", 255)
        proto = number(inferred if self.next_protocol is None else self.next_protocol, 1, "protocol")
        length = checked(self.size(body) + 4 * ihl, self.total_length, "total_length")
        head = F.concat(
            to_bytes(F.lit(0x40 + ihl), 1),
            to_bytes(F.shiftleft(number(self.dscp, 1, "dscp", 6), 2) + number(self.ecn, 1, "ecn", 2), 1),
            to_bytes(length, 2),
            to_bytes(number(self.identification, 2, "identification"), 2),
            to_bytes(F.shiftleft(number(self.flags, 1, "flags", 3), 13) + number(self.fragment_offset, 2, "fragment_offset", 13), 2),
            to_bytes(number(self.ttl, 1, "ttl"), 1),
            to_bytes(proto, 1),
        )
        tail = F.concat(to_bytes(number(self.src, 4, "src"), 4), to_bytes(number(self.dst, 4, "dst"), 4), col(options))
        value = number(self.checksum, 2, "checksum") if self.checksum is not None else checksum.internet(F.concat(head, tail))
        return joined(head, to_bytes(value, 2), tail, body)


@dataclass
class tcp(Layer):  # noqa: N801
    """The checksum is filled in under an IPv4 parent, else 0."""

    src_port: Any = 0
    dst_port: Any = 0
    seq: Any = 0
    ack: Any = 0
    flags: Any = 0
    window: Any = 64
    urgent_pointer: Any = 0
    data_offset: int | None = None
    checksum: Any = None
    options: bytes = b""

    def __post_init__(self):
        self.protocol = "Tcp"

    def write(self, child, body, parent):
        options = padded(self.options, 40)
        words = 5 + len(options) // 4
        if self.data_offset is not None:
            if not words <= self.data_offset <= 15:
                raise CraftError("InvalidLength", f"data offset {self.data_offset}, {words} words needed")
            options += bytes(4 * (self.data_offset - words))
            words = self.data_offset
        head = F.concat(
            to_bytes(number(self.src_port, 2, "src_port"), 2),
            to_bytes(number(self.dst_port, 2, "dst_port"), 2),
            to_bytes(number(self.seq, 4, "seq"), 4),
            to_bytes(number(self.ack, 4, "ack"), 4),
            to_bytes(F.lit(words << 4), 1),
            to_bytes(number(self.flags, 1, "flags"), 1),
            to_bytes(number(self.window, 2, "window"), 2),
        )
        tail = joined(to_bytes(number(self.urgent_pointer, 2, "urgent_pointer"), 2), col(options), body)
        value = col(0)
        if self.checksum is not None:
            value = number(self.checksum, 2, "checksum")
        elif isinstance(parent, ipv4):
            value = checksum.transport(col(parent.src), col(parent.dst), 6, F.concat(head, to_bytes(F.lit(0), 2), tail))
        return F.concat(head, to_bytes(value, 2), tail)


@dataclass
class udp(Layer):  # noqa: N801
    """A given length must be right; the checksum is filled in under an IPv4 parent, else 0."""

    src_port: Any = 0
    dst_port: Any = 0
    length: Any = None
    checksum: Any = None

    def __post_init__(self):
        self.protocol = "Udp"

    def write(self, child, body, parent):
        size = checked(self.size(body) + 8, self.length, "length")
        head = F.concat(to_bytes(number(self.src_port, 2, "src_port"), 2), to_bytes(number(self.dst_port, 2, "dst_port"), 2), to_bytes(size, 2))
        value = col(0)
        if self.checksum is not None:
            value = number(self.checksum, 2, "checksum")
        elif isinstance(parent, ipv4):
            value = checksum.udp(col(parent.src), col(parent.dst), joined(head, to_bytes(F.lit(0), 2), body))
        return joined(head, to_bytes(value, 2), body)


@dataclass
class icmp_echo(Layer):  # noqa: N801
    """message_type: 8 (request) or 0 (reply)."""

    message_type: int = 8
    code: Any = 0
    identifier: Any = 0
    sequence: Any = 0
    checksum: Any = None

    def __post_init__(self):
        self.protocol = "Icmp"
        if self.message_type not in (0, 8):
            raise CraftError("InvalidField", f"message_type {self.message_type}")

    def write(self, child, body, parent):
        head = F.concat(to_bytes(F.lit(self.message_type), 1), to_bytes(number(self.code, 1, "code"), 1))
        tail = joined(to_bytes(number(self.identifier, 2, "identifier"), 2), to_bytes(number(self.sequence, 2, "sequence"), 2), body)
        value = number(self.checksum, 2, "checksum") if self.checksum is not None else checksum.internet(F.concat(head, to_bytes(F.lit(0), 2), tail))
        return F.concat(head, to_bytes(value, 2), tail)


@dataclass
class custom(Layer):  # noqa: N801
    """A layer of the caller's: `head` may be bytes, a column or a function of the child's bytes; `name` is its protocol."""

    name: str = "Custom"
    head: Any = b""

    def __post_init__(self):
        self.protocol = self.name

    def write(self, child, body, parent):
        head = self.head(body) if callable(self.head) and not isinstance(self.head, Column) else col(self.head)
        return joined(head, body)


def with_fields(layer: Layer, **changes) -> Layer:
    return replace(layer, **changes)
