"""Reordering by timestamp, merging of captures, and splitting by flow key."""

from __future__ import annotations

import ipaddress
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlake.functions.fields import to_bytes
from flowlake.operators.keys import parts
from flowlake.scratch import written

SECOND = 1_000_000_000

# Reordering.


def misplaced(packets: DataFrame, by: tuple[str, ...] = ("path",), span: int = 65_536) -> DataFrame:
    """by, frame_no, ts_ns, latest_frame, backward_ns of packets that are earlier than one before them.

    latest_frame is the last of the frames before with the latest time.  The running maximum
    is taken within ranges of `span` frames and over the ranges' maxima, so no capture has to
    fit one task.
    """
    mark = F.struct("ts_ns", "frame_no")
    rows = packets.select(*by, "frame_no", "ts_ns", F.floor(F.col("frame_no") / span).alias("_range"))
    heads = rows.groupBy(*by, "_range").agg(F.max(mark).alias("_top"))
    before = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    heads = heads.select(*by, "_range", F.max("_top").over(before).alias("_before"))
    inside = Window.partitionBy(*by, "_range").orderBy("frame_no").rowsBetween(Window.unboundedPreceding, -1)
    joined = rows.withColumn("_here", F.max(mark).over(inside)).join(heads, [*by, "_range"])
    latest = joined.withColumn("_latest", F.greatest(F.col("_here"), F.col("_before")))
    late = latest.where(F.col("ts_ns") < F.col("_latest.ts_ns"))
    return late.select(*by, "frame_no", "ts_ns", F.col("_latest.frame_no").alias("latest_frame"), (F.col("_latest.ts_ns") - F.col("ts_ns")).alias("backward_ns"))


def reordered(packets: DataFrame, by: tuple[str, ...] = ("path",)) -> DataFrame:
    """A stable sort by time within each section; place counts from 1 in the new order.  Writes the sorted packets once."""
    return ranked(packets, ["ts_ns", "frame_no"], "place", by)


def reorder_report(packets: DataFrame, by: tuple[str, ...] = ("path",)) -> DataFrame:
    """by, packets, misplaced (their number), ordered: what a dry run tells; a capture that is in order needs no reordering."""
    late = misplaced(packets, by).groupBy(*by).agg(F.count(F.lit(1)).alias("misplaced"))
    counts = packets.groupBy(*by).agg(F.count(F.lit(1)).alias("packets"))
    n = F.coalesce("misplaced", F.lit(0))
    return counts.join(late, list(by), "left").select(*by, "packets", n.alias("misplaced"), (n == 0).alias("ordered"))


def ranked(rows: DataFrame, order: list[str], name: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Rows with their place (from 1, within each section of `by`) in a global order.

    Rows are dealt by ranges and sorted once, numbered as they lie, and written to the shared
    folder; a row's place is its number and the sizes of the partitions before, which are read
    from what was written, so nothing depends on partitions being cut alike twice.
    """
    keys = [*by, *order]
    dealt = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_lies", F.monotonically_increasing_id())
    held = written(dealt, "ranked").withColumn("_part", F.shiftright("_lies", 33))
    sizes = held.groupBy("_part", *by).agg(F.count(F.lit(1)).alias("_n"), F.min("_lies").alias("_first"))
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(F.col("_part").alias("_in"), *[F.col(c).alias(f"_by{i}") for i, c in enumerate(by)], (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first") + 1).alias("_shift"))
    same = F.col("_part") == F.col("_in")
    for i, c in enumerate(by):
        same &= F.col(c).eqNullSafe(F.col(f"_by{i}"))
    return held.join(starts, same).select(*rows.columns, (F.col("_lies") + F.col("_shift")).alias(name))


# Merging.


@dataclass
class MergeInput:
    """One input of a merge.

    start: seconds added to timestamps, or the new start of the capture with erase.
    starts: one group of passes for each start time (overrides start).
    repeat: passes in each group, each 1 s after the last packet of the one before.
    parallel: copies of every packet.
    ips: (from network, to network) pairs; sources, targets: pools for addresses that no pair matched.
    """

    packets: DataFrame
    start: int = 0
    starts: list[int] | None = None
    erase: bool = False
    keep_subsecond: bool = False
    repeat: int = 1
    parallel: int = 1
    ips: list[tuple[str, str]] = field(default_factory=list)
    sources: list[str] = field(default_factory=list)
    targets: list[str] = field(default_factory=list)


def mapped(ip: Column, pairs: list[tuple[str, str]]) -> Column:
    """Addresses moved between networks; the longest prefix is tried first, host bits stay.  Null if none matches."""
    out = None
    nets = sorted(((ipaddress.ip_network(a, strict=False), ipaddress.ip_network(b, strict=False)) for a, b in pairs), key=lambda p: -p[0].prefixlen)
    for a, b in nets:
        if a.version != 4 or b.version != 4:
            raise ValueError("only IPv4 networks can be mapped")
        inside = ip.bitwiseAND(int(a.netmask)) == int(a.network_address)
        moved = F.lit(int(b.network_address)).cast("bigint").bitwiseOR(ip.bitwiseAND(int(b.hostmask)))
        out = F.when(inside, moved) if out is None else out.when(inside, moved)
    return out if out is not None else F.lit(None).cast("bigint")


def pool(addresses: list[str]) -> list[int]:
    """Host addresses of networks, and single addresses."""
    out: list[int] = []
    for text in addresses:
        net = ipaddress.ip_network(text, strict=False)
        out += [int(net.network_address)] if net.num_addresses == 1 else [int(h) for h in net.hosts()]
    return out


def from_pool(addresses: list[str], seed: int, side: str) -> Column:
    """A pseudo-random address of a pool, the same for the same packet, copy and seed; null without a pool.

    A network is drawn by its share of hosts and the host by its number, so pools of any size take one expression.
    """
    nets = [ipaddress.ip_network(t, strict=False) for t in addresses]
    if not nets:
        return F.lit(None).cast("bigint")
    spans = [(int(n.network_address), 1) if n.num_addresses == 1 else (int(n.network_address) + (n.num_addresses > 2), n.num_addresses - 2 * (n.num_addresses > 2)) for n in nets]
    total = sum(s for _, s in spans)
    draw = F.pmod(F.xxhash64(F.lit(seed), F.lit(side), "frame_no", "repetition", "copy"), F.lit(total))
    out, before = None, 0
    for first, size in spans:
        hit, value = draw < before + size, draw - before + first
        out = F.when(hit, value) if out is None else out.when(hit, value)
        before += size
    return out


def passes(inp: MergeInput, index: int, seed: int) -> DataFrame:
    rows = inp.packets
    first, last = (v or 0 for v in rows.agg(F.min_by("ts_ns", "frame_no"), F.max_by("ts_ns", "frame_no")).first())
    starts = inp.starts if inp.starts is not None else [inp.start]
    length = last - first
    groups = F.array(*[F.lit(s * SECOND).cast("bigint") for s in starts])
    rows = rows.select("*", F.posexplode(groups).alias("_group", "_start"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(inp.repeat - 1))).alias("repetition"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(inp.parallel - 1))).alias("copy"))
    base = F.col("ts_ns") + F.col("_start")
    if inp.erase:
        base = F.col("ts_ns") - first + F.col("_start") + (first % SECOND if inp.keep_subsecond else 0)
    rows = rows.withColumn("ts_ns", base + F.col("repetition") * (length + SECOND))
    rows = rows.withColumn("repetition", F.col("_group") * inp.repeat + F.col("repetition"))
    if inp.ips or inp.sources or inp.targets:
        for name, addresses in (("src_ip", inp.sources), ("dst_ip", inp.targets)):
            rows = rows.withColumn(name, F.coalesce(mapped(F.col(name), inp.ips), from_pool(addresses, seed, name), F.col(name)))
    return rows.drop("_group", "_start").withColumn("input", F.lit(index))


def merged(inputs: list[MergeInput], seed: int = 0) -> DataFrame:
    """All packets of all passes in time order: ties by input, pass, frame and copy; `place` counts from 1.

    The order is global, whatever the order within inputs.  Addresses change in the rows; rewrite() puts them into data.
    """
    out = None
    for i, x in enumerate(inputs):
        part = passes(x, i, seed)
        out = part if out is None else out.unionByName(part)
    return ranked(out, ["ts_ns", "input", "repetition", "frame_no", "copy"], "place")


def rewrite(packets: DataFrame, ip_offset: Column | int = 14, fix_checksum: bool = False) -> DataFrame:
    """Puts src_ip and dst_ip into the IPv4 header of data that begins at ip_offset; checksums stay unless fix_checksum."""
    from flowlake.functions.checksum import internet

    at = F.lit(ip_offset) if isinstance(ip_offset, int) else ip_offset
    d = F.col("data")
    cut = lambda a, n: F.substring(d, (at + a + 1).cast("int"), n if isinstance(n, Column) else F.lit(n))
    addresses = F.concat(to_bytes(F.col("src_ip"), 4), to_bytes(F.col("dst_ip"), 4))
    size = ((F.conv(F.hex(cut(0, 1)), 16, 10).cast("int").bitwiseAND(15)) * 4).cast("int")
    check = cut(10, 2)
    if fix_checksum:
        check = to_bytes(internet(F.concat(cut(0, 10), F.unhex(F.lit("0000")), addresses, cut(20, size - 20))), 2)
    return packets.withColumn("data", F.concat(F.substring(d, F.lit(1), at.cast("int")), cut(0, 10), check, addresses, F.substring(d, (at + 21).cast("int"), F.length(d))))


# Splitting.


def key_counts(packets: DataFrame, granularity: str) -> DataFrame:
    return packets.groupBy(*parts(granularity)).agg(F.count(F.lit(1)).alias("packets"))


def names_of(granularity: str) -> list[str]:
    if granularity in ("src-ip", "dst-ip"):
        return ["ip"]
    size = int(granularity[5])
    return (["a", "b"] if size < 4 else ["a", "a_port", "b", "b_port"]) + (["proto"] if size in (3, 5) else [])


def largest(packets: DataFrame, granularity: str, n: int) -> DataFrame:
    """The n keys with most packets (ties by the smallest key); 0 means all."""
    counts = key_counts(packets, granularity)
    return counts.orderBy(F.desc("packets"), *names_of(granularity)).limit(n) if n else counts


def split_summary(packets: DataFrame, granularity: str = "tuple5-sym", top: int = 0, shown: int = 10) -> DataFrame:
    """One row: flows (keys), selected, written, skipped (packets without a key, such as those that aren't IPv4, and of keys that aren't selected), and the `shown` largest keys' packets.

    packets: as for key_counts, with null addresses where there is no IPv4 layer.
    """
    names = names_of(granularity)
    keyed = F.col("src_ip").isNotNull() & F.col("dst_ip").isNotNull()
    total = packets.agg(F.count(F.lit(1)).alias("packets"))
    counts = key_counts(packets.where(keyed), granularity)
    picked = largest(packets.where(keyed), granularity, top) if top else counts
    best = counts.orderBy(F.desc("packets"), *names).limit(shown)
    sums = counts.agg(F.count(F.lit(1)).alias("flows"))
    chosen = picked.agg(F.count(F.lit(1)).alias("selected"), F.coalesce(F.sum("packets"), F.lit(0)).alias("written"))
    #: Each side is one row.
    rows = total.join(sums).join(chosen).join(best.agg(F.reverse(F.array_sort(F.collect_list("packets"))).alias("largest")))
    return rows.select("flows", "selected", "written", (F.col("packets") - F.col("written")).alias("skipped"), "largest")


def split(packets: DataFrame, granularity: str = "tuple5-sym", top: int = 0) -> DataFrame:
    """Packets of the selected keys with the key's columns (k_...)."""
    names = names_of(granularity)
    rows = packets.select("*", *[c.alias(f"k_{n}") for n, c in zip(names, parts(granularity), strict=True)])
    if not top:
        return rows
    keys = largest(packets, granularity, top).select(*[F.col(n).alias(f"k_{n}") for n in names])
    return rows.join(F.broadcast(keys) if top <= 100_000 else keys, [f"k_{n}" for n in names], "left_semi")
