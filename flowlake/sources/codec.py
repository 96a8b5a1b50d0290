"""Capture files as bytes: pcap and pcapng records, blocks and interfaces, and a pcap writer.

Parsers walk a Feed, which reads a file of any size block by block, and yield rows; damage ends
the walk with an error row (`error` filled, no data) instead of raising, unless the caller asks
for it.
"""

from __future__ import annotations

import io
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

# Magic numbers, block types and option codes of the formats.
PCAP_MAGIC = {b"\xa1\xb2\xc3\xd4": (">", 1000), b"\xd4\xc3\xb2\xa1": ("<", 1000), b"\xa1\xb2\x3c\x4d": (">", 1), b"\x4d\x3c\xb2\xa1": ("<", 1)}
SECTION_BLOCK = b"\x0a\x0d\x0d\x0a"
SHB, IDB, SPB, NRB, ISB, EPB, DSB = 0x0A0D0D0A, 1, 3, 4, 5, 6, 10
IF_OPTIONS = {2: "name", 3: "description", 4: "ipv4", 5: "ipv6", 6: "mac", 7: "eui", 8: "speed", 9: "tsresol", 10: "tzone", 11: "filter", 12: "os", 13: "fcslen", 14: "tsoffset", 15: "hardware", 16: "txspeed", 17: "rxspeed", 18: "iana_tzname"}
SECTION_OPTIONS = {2: "hardware", 3: "os", 4: "application"}
PACKET_OPTIONS = {2: "flags", 3: "hash", 4: "dropcount", 5: "packetid", 6: "queue", 7: "verdict", 8: "pid_tid"}


class CaptureError(ValueError):
    """kind: InvalidMagicNumber, TruncatedCapture, MissingPcapngIDB, InvalidInterfaceId, InvalidBlockTotalLength, BlockTotalLengthMismatch, TimestampOutOfRange, FromUtf8 or Io."""

    def __init__(self, kind: str, detail: str = ""):
        super().__init__(f"{kind}: {detail}" if detail else kind)
        self.kind = kind


class Feed:
    """Bytes of a file in order, held one block at a time: from bytes, or from a stream of `size` bytes."""

    def __init__(self, source, size: int | None = None, block: int = 1 << 20):
        self.source = io.BytesIO(source) if size is None else source
        self.size = len(source) if size is None else size
        self.block, self.held, self.from_, self.at = block, b"", 0, 0

    @property
    def left(self) -> int:
        return self.size - self.at

    def peek(self, n: int) -> bytes:
        """The next n bytes, fewer at the end."""
        n = min(n, self.left)
        while len(self.held) - self.from_ < n:
            more = self.source.read(max(self.block, n - (len(self.held) - self.from_)))
            if not more:
                self.size = self.at + len(self.held) - self.from_
                break
            self.held, self.from_ = self.held[self.from_ :] + bytes(more), 0
        return self.held[self.from_ : self.from_ + n]

    def take(self, n: int) -> bytes:
        found = self.peek(n)
        self.from_ += len(found)
        self.at += len(found)
        return found


def feed_of(source: bytes | Feed) -> Feed:
    return source if isinstance(source, Feed) else Feed(source)


INT32, INT64 = (1 << 31) - 1, (1 << 63) - 1


@dataclass
class Interface:
    link_type: int = 1
    snap_len: int = 0
    res_base: int = 10
    res_exp: int = 6
    ts_offset: int = 0
    section: int = 0
    interface_id: int = 0
    options: dict = field(default_factory=dict)

    def nanoseconds(self, ticks: int) -> int:
        if self.res_base == 10:
            ns = ticks * 10 ** (9 - self.res_exp) if self.res_exp <= 9 else ticks // 10 ** (self.res_exp - 9)
        elif self.res_exp <= 30:
            ns = ticks << 30 - self.res_exp  # 2^30 stands for 10^9
        else:
            ns = ticks >> self.res_exp - 30
        ns += self.ts_offset * 1_000_000_000
        if not -INT64 <= ns <= INT64:
            raise CaptureError("TimestampOutOfRange", f"{ticks} ticks of {self.res_base}^-{self.res_exp} s")
        return ns


@dataclass
class Record:
    frame_no: int
    section: int
    interface_id: int
    ts_ns: int | None
    orig_len: int | None
    link_type: int | None
    data: bytes | None
    rec_offset: int
    rec_len: int
    error: str | None = None


@dataclass
class Block:
    """A pcapng block; role: section, interface, packet or other."""

    index: int
    section: int
    block_type: int
    role: str
    rec_offset: int
    raw: bytes
    interface_id: int | None = None
    ts_ns: int | None = None
    frame_no: int | None = None
    error: str | None = None
    options: dict = field(default_factory=dict)


def sniff(head: bytes) -> str:
    if head[:4] in PCAP_MAGIC:
        return "pcap"
    if head[:4] == SECTION_BLOCK:
        return "pcapng"
    raise CaptureError("InvalidMagicNumber", head[:4].hex())


def pcap_header(buf: bytes) -> dict:
    if len(buf) < 24:
        raise CaptureError("TruncatedCapture", f"header of {len(buf)} bytes")
    if buf[:4] not in PCAP_MAGIC:
        raise CaptureError("InvalidMagicNumber", buf[:4].hex())
    endian, scale = PCAP_MAGIC[buf[:4]]
    major, minor, r1, r2, snap, link = struct.unpack(endian + "HHIIII", buf[4:24])
    return {"endian": endian, "scale": scale, "major": major, "minor": minor, "reserved": (r1, r2), "snap_len": snap, "link_type": link & 0xFFFF}


def pcap_records(source: bytes | Feed, truncation: str = "error") -> Iterator[Record]:
    """truncation: 'eof' ends quietly at a partial record header, 'error' reports it."""
    feed = feed_of(source)
    head = pcap_header(feed.take(24))
    n = 0
    while feed.left:
        at = feed.at
        mark = feed.peek(16)
        if len(mark) < 16:
            if truncation == "error":
                yield Record(n + 1, 0, 0, None, None, None, None, at, len(mark), "TruncatedCapture")
            return
        sec, frac, size, orig = struct.unpack(head["endian"] + "IIII", mark)
        if feed.left - 16 < size or len(whole := feed.take(16 + size)) < 16 + size:
            yield Record(n + 1, 0, 0, None, None, None, None, at, min(INT32, feed.size - at), "TruncatedCapture")
            return
        n += 1
        yield Record(n, 0, 0, sec * 1_000_000_000 + frac * head["scale"], orig, head["link_type"], whole[16:], at, 16 + size)


def options(buf: bytes, endian: str, names: dict[int, str]) -> dict:
    """Options by name; values of one that repeats are a list."""
    out: dict = {}
    at = 0
    while at + 4 <= len(buf):
        code, size = struct.unpack(endian + "HH", buf[at : at + 4])
        if code == 0:
            break
        value = buf[at + 4 : at + 4 + size]
        if len(value) < size:
            raise CaptureError("TruncatedCapture", "option")
        name = names.get(code, "comment" if code == 1 else f"option_{code}")
        out.setdefault(name, []).append(value)
        at += 4 + size + -size % 4
    return out


def text_option(opts: dict, name: str) -> str | None:
    if name not in opts:
        return None
    try:
        return opts[name][0].decode()
    except UnicodeDecodeError as e:
        raise CaptureError("FromUtf8", name) from e


class PcapngWalk:
    """Blocks in file order.  interface_scope: 'section' restarts interface ids with each section, 'global' goes on counting."""

    def __init__(self, source: bytes | Feed, interface_scope: str = "section"):
        self.feed, self.scope = feed_of(source), interface_scope
        self.endian = "<"
        self.section = -1
        self.all: list[Interface] = []
        self.own: list[Interface] = []
        self.sections: list[dict] = []

    def interface(self, number: int) -> Interface:
        known = self.own if self.scope == "section" else self.all
        if not known:
            raise CaptureError("MissingPcapngIDB")
        if number >= len(known):
            raise CaptureError("InvalidInterfaceId", str(number))
        return known[number]

    def blocks(self) -> Iterator[tuple[int, int, bytes, bytes]]:
        """(offset, type, body, raw)."""
        feed = self.feed
        while feed.left:
            at, head = feed.at, feed.peek(12)
            if len(head) < 12:
                raise CaptureError("TruncatedCapture", f"block at {at}")
            if head[:4] == SECTION_BLOCK:
                if head[8:12] not in (b"\x1a\x2b\x3c\x4d", b"\x4d\x3c\x2b\x1a"):
                    raise CaptureError("InvalidMagicNumber", head[8:12].hex())
                self.endian = ">" if head[8:12] == b"\x1a\x2b\x3c\x4d" else "<"
            kind, size = struct.unpack(self.endian + "II", head[:8])
            if size < 12 or size % 4:
                raise CaptureError("InvalidBlockTotalLength", str(size))
            if feed.left < size or len(raw := feed.peek(size)) < size:
                raise CaptureError("TruncatedCapture", f"block at {at}")
            (tail,) = struct.unpack(self.endian + "I", raw[-4:])
            if tail != size:
                raise CaptureError("BlockTotalLengthMismatch", f"{size} and {tail}")
            feed.take(size)
            yield at, kind, raw[8:-4], raw

    def start_section(self, body: bytes) -> None:
        if len(body) < 16:
            raise CaptureError("TruncatedCapture", "section header")
        major, minor, length = struct.unpack(self.endian + "HHq", body[4:16])
        opts = options(body[16:], self.endian, SECTION_OPTIONS)
        self.section += 1
        self.own = []
        self.sections.append({"major": major, "minor": minor, "length": length} | {k: text_option(opts, k) for k in SECTION_OPTIONS.values()})

    def add_interface(self, body: bytes) -> None:
        if len(body) < 8:
            raise CaptureError("TruncatedCapture", "interface")
        link, _, snap = struct.unpack(self.endian + "HHI", body[:8])
        opts = options(body[8:], self.endian, IF_OPTIONS)
        got = Interface(link, snap, section=self.section, interface_id=len(self.own), options=opts)
        if opts.get("tsresol", [b""])[0]:
            value = opts["tsresol"][0][0]
            got.res_base, got.res_exp = (2, value & 0x7F) if value & 0x80 else (10, value)
        if len(opts.get("tsoffset", [b""])[0]) == 8:
            (got.ts_offset,) = struct.unpack(self.endian + "q", opts["tsoffset"][0])
        for name in ("name", "description", "filter", "os", "hardware", "iana_tzname"):
            value = opts.get(name)
            if value and name != "filter":
                text_option(opts, name)
        self.own.append(got)
        self.all.append(got)

    def packet(self, kind: int, body: bytes) -> tuple[int, int, int, int, bytes]:
        """(interface id, ns, original length, link type, data)."""
        if kind == SPB:
            if len(body) < 4:
                raise CaptureError("TruncatedCapture", "simple packet")
            link = self.interface(0)
            (orig,) = struct.unpack(self.endian + "I", body[:4])
            return 0, 0, orig, link.link_type, body[4:]  # padding can't be told from data
        if len(body) < 20:
            raise CaptureError("TruncatedCapture", "packet")
        number, high, low, size, orig = struct.unpack(self.endian + "IIIII", body[:20])
        link = self.interface(number)
        if len(body) - 20 < size:
            raise CaptureError("TruncatedCapture", "packet")
        return number, link.nanoseconds(high << 32 | low), orig, link.link_type, body[20 : 20 + size]

    def packet_options(self, body: bytes) -> dict:
        (size,) = struct.unpack(self.endian + "I", body[12:16])
        return options(body[20 + size + -size % 4 :], self.endian, PACKET_OPTIONS)

    def walk(self) -> Iterator[tuple[Block, Record | None]]:
        index = frames = 0
        inside: int | None = None
        try:
            for at, kind, body, raw in self.blocks():
                inside = at
                block = Block(index, self.section, kind, "other", at, raw)
                index += 1
                record = None
                if kind == SHB:
                    self.start_section(body)
                    block.section, block.role, block.options = self.section, "section", options(body[16:], self.endian, SECTION_OPTIONS)
                elif self.section < 0:
                    raise CaptureError("InvalidMagicNumber", "no section header")
                elif kind == IDB:
                    self.add_interface(body)
                    block.role, block.interface_id, block.options = "interface", len(self.own) - 1, self.own[-1].options
                elif kind in (EPB, SPB):
                    number, ns, orig, link, data = self.packet(kind, body)
                    frames += 1
                    record = Record(frames, self.section, number, ns, orig, link, data, at, len(raw))
                    block.role, block.interface_id, block.ts_ns, block.frame_no = "packet", number, ns, frames
                    block.options = self.packet_options(body) if kind == EPB else {}
                yield block, record
                inside = None
        except CaptureError as e:
            at = self.feed.at if inside is None else inside
            rest = min(INT32, self.feed.size - at)
            yield Block(index, max(0, self.section), -1, "other", at, b"", error=str(e)), Record(frames + 1, max(0, self.section), 0, None, None, None, None, at, rest, str(e))


def records(source: bytes | Feed, truncation: str = "error", interface_scope: str = "section") -> Iterator[Record]:
    """All packets of a capture file of either format; a last row with `error` where it is damaged."""
    feed = feed_of(source)
    try:
        kind = sniff(feed.peek(4))
        if kind == "pcap":
            yield from pcap_records(feed, truncation)
            return
    except CaptureError as e:
        yield Record(1, 0, 0, None, None, None, None, 0, min(INT32, feed.size), str(e))
        return
    yield from (r for _, r in PcapngWalk(feed, interface_scope).walk() if r is not None)


def interfaces(source: bytes | Feed) -> list[Interface]:
    """The interfaces up to where the file is damaged; none where it isn't a capture."""
    feed = feed_of(source)
    try:
        if sniff(feed.peek(4)) == "pcap":
            head = pcap_header(feed.peek(24))
            return [Interface(head["link_type"], head["snap_len"], 10, 9 if head["scale"] == 1 else 6)]
    except CaptureError:
        return []
    walk = PcapngWalk(feed)
    for _ in walk.walk():
        pass
    return walk.all


# Writing.


def pcap_file_header(link_type: int = 1, snap_len: int = 65535, nanos: bool = False, big: bool = True) -> bytes:
    e = ">" if big else "<"
    return struct.pack(e + "IHHIIII", 0xA1B23C4D if nanos else 0xA1B2C3D4, 2, 4, 0, 0, snap_len, link_type)


def pcap_record(ts_ns: int, orig_len: int, data: bytes, snap_len: int = 65535, nanos: bool = False, big: bool = True) -> bytes:
    if ts_ns < 0 or ts_ns >= 1_000_000_000 << 32:
        raise CaptureError("Io", f"the time {ts_ns} ns has no place in a pcap record")
    data = data[:snap_len]
    return struct.pack((">" if big else "<") + "IIII", ts_ns // 1_000_000_000, ts_ns % 1_000_000_000 // (1 if nanos else 1000), len(data), orig_len) + data
