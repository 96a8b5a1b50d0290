"""Bidirectional flow features: 85 columns for every TCP or UDP flow of two packets or more.

Packets of a key are read in capture order.  A flow ends before a packet that comes more
than the idle timeout after the last one, or with a packet that resets it or completes FINs
from both sides (the first packet of a flow never ends it); what is open at the end of a
capture is emitted then.

That order makes the state machine sequential per key, and only that: packets are dealt by
(path, key), sorted within partitions and streamed through Arrow batches.  A task holds one
open flow of running sums, so a key of any size needs no memory and no group is gathered.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlake.functions.net import address_text, iso_text, same_endpoint_order

SECOND = 1_000_000_000
FIN, SYN, RST, PSH, ACK, URG, ECE, CWR = 1, 2, 4, 8, 16, 32, 64, 128
FLAG_ORDER = (FIN, SYN, RST, PSH, ACK, URG, CWR, ECE)

# Names and order of the exported columns.
HEADER = [
    "Flow ID", "Src IP", "Src Port", "Dst IP", "Dst Port", "Protocol", "Timestamp", "Flow Duration", "Total Fwd Packet", "Total Bwd packets", "Total Length of Fwd Packet",
    "Total Length of Bwd Packet", "Fwd Packet Length Max", "Fwd Packet Length Min", "Fwd Packet Length Mean", "Fwd Packet Length Std", "Bwd Packet Length Max", "Bwd Packet Length Min",
    "Bwd Packet Length Mean", "Bwd Packet Length Std", "Flow Bytes/s", "Flow Packets/s", "Flow IAT Mean", "Flow IAT Std", "Flow IAT Max", "Flow IAT Min", "Fwd IAT Total", "Fwd IAT Mean",
    "Fwd IAT Std", "Fwd IAT Max", "Fwd IAT Min", "Bwd IAT Total", "Bwd IAT Mean", "Bwd IAT Std", "Bwd IAT Max", "Bwd IAT Min", "Fwd PSH Flags", "Bwd PSH Flags", "Fwd URG Flags", "Bwd URG Flags",
    "Fwd Header Length", "Bwd Header Length", "Fwd Packets/s", "Bwd Packets/s", "Packet Length Min", "Packet Length Max", "Packet Length Mean", "Packet Length Std", "Packet Length Variance",
    "FIN Flag Count", "SYN Flag Count", "RST Flag Count", "PSH Flag Count", "ACK Flag Count", "URG Flag Count", "CWR Flag Count", "ECE Flag Count", "Down/Up Ratio", "Average Packet Size",
    "Fwd Segment Size Avg", "Bwd Segment Size Avg", "Fwd Header Length.1", "Fwd Bytes/Bulk Avg", "Fwd Packet/Bulk Avg", "Fwd Bulk Rate Avg", "Bwd Bytes/Bulk Avg", "Bwd Packet/Bulk Avg",
    "Bwd Bulk Rate Avg", "Subflow Fwd Packets", "Subflow Fwd Bytes", "Subflow Bwd Packets", "Subflow Bwd Bytes", "FWD Init Win Bytes", "Bwd Init Win Bytes", "Fwd Act Data Pkts", "Fwd Seg Size Min",
    "Active Mean", "Active Std", "Active Max", "Active Min", "Idle Mean", "Idle Std", "Idle Max", "Idle Min", "Label",
]
#: Columns that are whole numbers; the others after Timestamp are doubles.
WHOLE = {n for n in HEADER if n in ("Src Port", "Dst Port", "Protocol", "Flow Duration", "Total Fwd Packet", "Total Bwd packets", "FWD Init Win Bytes", "Bwd Init Win Bytes", "Fwd Act Data Pkts", "Fwd Seg Size Min", "Fwd Header Length.1") or n.endswith(("Header Length", "Flags", "Flag Count"))}
TEXT = ("Flow ID", "Src IP", "Dst IP", "Timestamp", "Label")


class Stat:
    """Count, sum, extremes and spread of a series, updated one value at a time."""

    __slots__ = ("n", "total", "low", "high", "mean", "square")

    def __init__(self):
        self.n, self.total, self.low, self.high, self.mean, self.square = 0, 0.0, 0.0, 0.0, 0.0, 0.0

    def add(self, x: float) -> None:
        self.n += 1
        self.total += x
        self.low = x if self.n == 1 else min(self.low, x)
        self.high = x if self.n == 1 else max(self.high, x)
        d = x - self.mean
        self.mean += d / self.n
        self.square += d * (x - self.mean)

    @property
    def average(self) -> float:
        return self.total / self.n if self.n else 0.0

    @property
    def variance(self) -> float:
        return self.square / (self.n - 1) if self.n > 1 else 0.0

    @property
    def spread(self) -> float:
        return math.sqrt(self.variance)


class Bulk:
    """Runs of four or more data packets of one direction without a second's pause and without the other side speaking."""

    __slots__ = ("start", "last", "run", "size", "bulks", "packets", "bytes", "ns")

    def __init__(self):
        self.start = self.last = None
        self.run = self.size = self.bulks = self.packets = self.bytes = self.ns = 0

    def add(self, ts: int, size: int, other_last: int | None) -> None:
        if size <= 0:
            return
        interrupted = self.start is not None and other_last is not None and other_last > self.start
        paused = self.last is not None and ts - self.last > SECOND
        if self.start is None or interrupted or paused:
            self.start, self.run, self.size = ts, 1, size
        else:
            self.run += 1
            self.size += size
            if self.run == 4:
                self.bulks += 1
                new = (4, self.size, ts - self.start)
            elif self.run > 4:
                new = (1, size, ts - self.last)
            else:
                new = (0, 0, 0)
            self.packets, self.bytes, self.ns = self.packets + new[0], self.bytes + new[1], self.ns + new[2]
        self.last = ts

    def averages(self) -> tuple[float, float, float]:
        each = (self.bytes / self.bulks, self.packets / self.bulks) if self.bulks else (0.0, 0.0)
        return *each, self.bytes * SECOND / self.ns if self.ns > 0 else 0.0


class Side:
    """One direction of a flow."""

    __slots__ = ("lengths", "iat", "last", "headers", "psh", "urg", "window", "data", "segment", "fin", "bulk")

    def __init__(self):
        self.lengths, self.iat, self.last, self.bulk = Stat(), Stat(), None, Bulk()
        self.headers = self.psh = self.urg = self.window = self.data = self.segment = 0
        self.fin = False

    def add(self, p: dict, other_last: int | None) -> None:
        ts, size, flags = p["ts_ns"], p["payload"], p["tcp_flags"]
        if self.last is None:
            self.window = p["window"]
        else:
            self.iat.add(micros(ts - self.last))
        self.segment = min(self.segment, p["header_len"]) if self.segment else p["header_len"]
        self.last = ts
        self.headers += p["header_len"]
        self.data += size > 0
        self.psh += bool(flags & PSH)
        self.urg += bool(flags & URG)
        self.fin |= bool(flags & FIN)
        self.bulk.add(ts, size, other_last)
        self.lengths.add(float(size))


def micros(ns: int) -> float:
    return max(0, ns) / 1000.0


class Flow:
    """An open flow; packets are dicts of the columns of PACKET."""

    def __init__(self, first: dict, activity_ns: int):
        self.first, self.activity_ns = first, activity_ns
        self.fwd, self.bwd, self.lengths, self.iat = Side(), Side(), Stat(), Stat()
        self.active, self.idle = Stat(), Stat()
        self.subflows, self.flags, self.packets = 1, [0] * 8, 0
        self.active_start = self.active_end = self.last = first["ts_ns"]
        self.add(first)

    def add(self, p: dict) -> None:
        ts = p["ts_ns"]
        if self.packets:
            gap = ts - self.last
            self.iat.add(micros(gap))
            self.subflows += gap > SECOND
            if gap > self.activity_ns:
                self._end_activity()
                self.idle.add(micros(gap))
                self.active_start = ts
        self.active_end = self.last = ts
        self.packets += 1
        self.lengths.add(float(p["payload"]))
        for i, bit in enumerate(FLAG_ORDER):
            self.flags[i] += bool(p["tcp_flags"] & bit)
        ahead = all(p[c] == self.first[c] for c in ("src_addr", "dst_addr", "src_port", "dst_port"))
        mine, other = (self.fwd, self.bwd) if ahead else (self.bwd, self.fwd)
        mine.add(p, other.last)

    def _end_activity(self) -> None:
        if self.active_end > self.active_start:
            self.active.add(micros(self.active_end - self.active_start))

    @property
    def finished(self) -> bool:
        return self.fwd.fin and self.bwd.fin

    def features(self) -> dict:
        """The numeric columns; call once, when the flow is over."""
        self._end_activity()
        span = self.last - self.first["ts_ns"]
        f, b, n = self.fwd, self.bwd, self.packets
        rate = lambda x: x * SECOND / span if span > 0 else 0.0
        per = lambda x, k: x / k if k else 0.0
        lengths = lambda s: (s.high, s.low, s.average, s.spread)
        times = lambda s: (s.average, s.spread, s.high, s.low)
        total = self.lengths.total
        values = [
            max(0, span) // 1000, f.lengths.n, b.lengths.n, f.lengths.total, b.lengths.total, *lengths(f.lengths), *lengths(b.lengths), rate(total), rate(n),
            *times(self.iat), f.iat.total, *times(f.iat), b.iat.total, *times(b.iat),
            f.psh, b.psh, f.urg, b.urg, f.headers, b.headers, rate(f.lengths.n), rate(b.lengths.n),
            self.lengths.low, self.lengths.high, self.lengths.average, self.lengths.spread, self.lengths.variance, *self.flags,
            per(b.lengths.n, f.lengths.n), per(total, n), f.lengths.average, b.lengths.average, f.headers, *f.bulk.averages(), *b.bulk.averages(),
            f.lengths.n / self.subflows, f.lengths.total / self.subflows, b.lengths.n / self.subflows, b.lengths.total / self.subflows,
            f.window, b.window, f.data, f.segment, *times(self.active), *times(self.idle),
        ]
        return dict(zip(HEADER[7:-1], values, strict=True))


PACKET = ("path", "frame_no", "ts_ns", "src_addr", "dst_addr", "src_port", "dst_port", "proto", "payload", "header_len", "tcp_flags", "window")


class Machine:
    """Flows of one key after another; add() and end() give finished flows of two packets or more."""

    def __init__(self, timeout_ns: int, activity_ns: int):
        self.timeout_ns, self.activity_ns, self.open = timeout_ns, activity_ns, None

    def add(self, p: dict) -> list[Flow]:
        done = []
        if self.open and p["ts_ns"] - self.open.last > self.timeout_ns:
            done = self.end()
        if self.open is None:
            self.open = Flow(p, self.activity_ns)
            return done
        self.open.add(p)
        if p["tcp_flags"] & RST or self.open.finished:
            done += self.end()
        return done

    def end(self) -> list[Flow]:
        done, self.open = [self.open] if self.open and self.open.packets > 1 else [], None
        return done


NUMBERS = [(n, pa.int64() if n in WHOLE else pa.float64()) for n in HEADER[7:-1]]
ROW = pa.schema([("path", pa.string()), ("closed_at", pa.int64()), ("first_ns", pa.int64()), ("src_addr", pa.binary()), ("src_port", pa.int64()), ("dst_addr", pa.binary()), ("dst_port", pa.int64()), ("proto", pa.int64()), *NUMBERS])
ROW_DDL = "path string, closed_at long, first_ns long, src_addr binary, src_port long, dst_addr binary, dst_port long, proto long, " + ", ".join(f"`{n}` {'long' if t == pa.int64() else 'double'}" for n, t in NUMBERS)


def row_of(flow: Flow, closed_at: int | None) -> dict:
    p = flow.first
    return {"path": p["path"], "closed_at": closed_at, "first_ns": p["ts_ns"], "src_addr": p["src_addr"], "src_port": p["src_port"], "dst_addr": p["dst_addr"], "dst_port": p["dst_port"], "proto": p["proto"]} | flow.features()


def key_columns() -> list[Column]:
    first = same_endpoint_order(F.col("src_addr"), F.col("src_port"), F.col("dst_addr"), F.col("dst_port"))
    #: IPv4 addresses come before IPv6 ones; keys only have to be equal for both directions, which any order gives.
    pairs = (("src_addr", "dst_addr"), ("src_port", "dst_port"), ("dst_addr", "src_addr"), ("dst_port", "src_port"))
    return [F.when(first, F.col(a)).otherwise(F.col(b)).alias(f"_k{i}") for i, (a, b) in enumerate(pairs)] + [F.col("proto").alias("_k4")]


def flow_rows(packets: DataFrame, timeout_ns: int = 120 * SECOND, activity_ns: int = 5 * SECOND) -> DataFrame:
    """Numeric feature rows; closed_at is the frame that ended the flow, null at the end of the capture.  packets: the columns of PACKET."""
    keyed = packets.select(*PACKET, *key_columns())
    names = [f"_k{i}" for i in range(5)]
    dealt = keyed.repartition("path", *names).sortWithinPartitions("path", *names, "frame_no")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, key, out = Machine(timeout_ns, activity_ns), None, []
        for batch in it:
            for p in batch.to_pylist():
                now = (p["path"], *[p[n] for n in names])
                if now != key:
                    out += [row_of(f, None) for f in machine.end()]
                    key = now
                out += [row_of(f, p["frame_no"]) for f in machine.add(p)]
            if len(out) >= 4096:
                yield pa.RecordBatch.from_pylist(out, ROW)
                out = []
        out += [row_of(f, None) for f in machine.end()]
        if out:
            yield pa.RecordBatch.from_pylist(out, ROW)

    return dealt.mapInArrow(run, ROW_DDL)


def flow_features(packets: DataFrame, timeout_ns: int = 120 * SECOND, activity_ns: int = 5 * SECOND, label: str = "NeedManualLabel") -> DataFrame:
    """The 85 columns, with path and closed_at for ordering: closed flows in the order of closed_at, then the others by Timestamp and Flow ID."""
    rows = flow_rows(packets, timeout_ns, activity_ns)
    src, dst = address_text(F.col("src_addr")), address_text(F.col("dst_addr"))
    flow_id = F.concat_ws("-", src, dst, F.col("src_port").cast("string"), F.col("dst_port").cast("string"), F.col("proto").cast("string"))
    head = [flow_id, src, F.col("src_port"), dst, F.col("dst_port"), F.col("proto"), iso_text(F.col("first_ns"))]
    return rows.select("path", "closed_at", *[c.alias(n) for n, c in zip(HEADER, head, strict=False)], *[F.col(f"`{n}`") for n in HEADER[7:-1]], F.lit(label).alias("Label"))


def emitted_order(features: DataFrame) -> DataFrame:
    return features.orderBy("path", F.col("closed_at").asc_nulls_last(), "Timestamp", "`Flow ID`")


def as_text(features: DataFrame) -> DataFrame:
    """All columns as the CSV has them: no exponents, 0 for what isn't finite, whole doubles without a point."""

    def text(name: str) -> Column:
        c = F.col(f"`{name}`")
        if name in TEXT:
            return c
        if name in WHOLE:
            return c.cast("string")
        shown = c.cast("string")
        part = lambda k: F.regexp_extract(shown, r"^(-?)(\d)\.(\d+)E(-?\d+)$", k)
        more, power = F.regexp_replace(part(3), "^0$", ""), part(4).cast("int")
        large = F.concat(part(1), part(2), F.rpad(F.substring(more, F.lit(1), power), power, F.lit("0")), F.when(F.length(more) > power, F.concat(F.lit("."), F.substring(more, power + 1, F.length(more)))).otherwise(""))
        small = F.concat(part(1), F.lit("0."), F.repeat(F.lit("0"), -power - 1), part(2), more)
        short = F.when(shown.contains("E-"), small).when(shown.contains("E"), large).otherwise(F.regexp_replace(shown, r"\.0$", ""))
        return F.when((c == 0) | F.isnan(c) | (F.abs(c) == float("inf")), F.lit("0")).otherwise(short)

    return features.select(*[text(n).alias(n) for n in HEADER])


def write_csv(features: DataFrame, path: str, overwrite: bool = False) -> None:
    """The features as CSV files with a header, in the order of emission within and across files."""
    as_text(emitted_order(features)).write.mode("overwrite" if overwrite else "errorifexists").option("header", True).option("quote", '"').option("escape", '"').csv(path)


def totals(packets: DataFrame, features: DataFrame) -> dict:
    """packets (TCP and UDP), skipped (others) and flows; packets: rows with proto, null where it isn't known."""
    tcp_udp = F.coalesce(F.col("proto").isin(6, 17), F.lit(False))
    n = packets.agg(F.count_if(tcp_udp), F.count_if(~tcp_udp)).first()
    return {"packets": n[0], "skipped": n[1], "flows": features.count()}


def from_ipv4_rows(packets: DataFrame) -> DataFrame:
    """Packet rows with integer addresses (plans.packets) as PACKET rows."""
    from flowlake.functions.fields import to_bytes

    return packets.select("path", "frame_no", "ts_ns", to_bytes(F.col("src_ip"), 4).alias("src_addr"), to_bytes(F.col("dst_ip"), 4).alias("dst_addr"), "src_port", "dst_port", "proto", "payload", F.col("header_len").cast("bigint").alias("header_len"), "tcp_flags", F.lit(4096).cast("bigint").alias("window"))
