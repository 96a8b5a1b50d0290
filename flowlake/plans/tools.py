"""The command-line tools' parameters and files: durations, merge inputs, configurations, reports, splits and reordered captures."""

from __future__ import annotations

import json
import re
from decimal import Decimal, InvalidOperation

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlake.functions.net import ipv4_text, iso_text
from flowlake.operators import dissect, keys, reorder, summary
from flowlake.sources import capture, codec

UNITS = {"ns": 1, "us": 1_000, "ms": 1_000_000, "s": 1_000_000_000, "m": 60_000_000_000, "h": 3_600_000_000_000}
INT64 = (1 << 63) - 1


def flow_duration(text: str) -> int:
    """Whole number and unit (ns, us, ms, s, m, h) as ns."""
    m = re.fullmatch(r"(\d+)(ns|us|ms|s|m|h)", text.strip())
    if not m or int(m[1]) * UNITS[m[2]] > INT64:
        raise ValueError(f"not a duration: {text!r}")
    return int(m[1]) * UNITS[m[2]]


def interval_duration(text: str) -> int:
    """Decimal number and unit as ns; must be a whole number of ns, 1 at least."""
    m = re.fullmatch(r"(\d+(?:\.\d+)?)(ns|us|ms|s|m|h)", text.strip())
    try:
        ns = Decimal(m[1]) * UNITS[m[2]] if m else None
    except InvalidOperation:
        ns = None
    if ns is None or ns < 1 or ns != ns.to_integral_value() or ns >= INT64:
        raise ValueError(f"not an interval: {text!r}")
    return int(ns)


# Merging.


def merge_spec(text: str) -> dict:
    """path#s5#r2#p3#ip10.0.0.0/8:11.0.0.0/8#src1.2.3.4#dst5.6.7.0/24 as a dict."""
    path, *marks = text.split("#")
    out: dict = {"path": path, "start": 0, "repeat": 1, "parallel": 1, "ips": [], "sources": [], "targets": []}
    for mark in marks:
        name = next((n for n in ("src", "dst", "ip", "s", "r", "p") if mark.startswith(n)), None)
        if name is None:
            raise ValueError(f"unknown mark {mark!r} in {text!r}")
        value = mark[len(name) :]
        if name in ("s", "r", "p"):
            out[{"s": "start", "r": "repeat", "p": "parallel"}[name]] = int(value)
        elif name == "ip":
            a, sep, b = value.partition(":")
            if not sep:
                raise ValueError(f"{mark!r} has no target")
            out["ips"].append((a, b))
        else:
            out["sources" if name == "src" else "targets"].append(value)
    return out


def overlaid(file: dict, given: dict) -> dict:
    """A configuration file under command-line values; what isn't given (None) comes from the file."""
    return file | {k: v for k, v in given.items() if v is not None}


def jobs(text: str) -> list[dict]:
    """One job or a list of them, as JSON."""
    found = json.loads(text)
    return found if isinstance(found, list) else [found]


# Reports.  A capture's report is a few numbers and short lists; they are formatted on the driver.


def report(packets: DataFrame, k: int = 10, by: str = "path") -> list[dict]:
    """One dict for each capture; packets: the columns of the summaries."""
    captures = {r[by]: r.asDict() for r in summary.summary(packets, by).collect()}
    ranked = summary.traffic(packets, by)
    from pyspark.sql import Window

    order = Window.partitionBy(by, "kind").orderBy(F.desc("packets"), F.desc("bytes"), "key")
    best = ranked.withColumn("_place", F.row_number().over(order)).where(F.col("_place") <= k)
    shown = F.when(F.col("kind").endswith("_ip"), ipv4_text(F.col("key"))).otherwise(F.col("key").cast("string"))
    for r in best.select(by, "kind", shown.alias("key"), "packets", "bytes", "_place").orderBy(by, "kind", "_place").collect():
        captures[r[by]].setdefault(f"top_{r['kind']}", []).append({"key": r["key"], "packets": r["packets"], "bytes": r["bytes"]})
    for r in packets.groupBy(by).agg(iso_text(F.min("ts_ns")).alias("first"), iso_text(F.max("ts_ns")).alias("last")).collect():
        captures[r[by]] |= {"first": r["first"], "last": r["last"]}
    return [captures[p] for p in sorted(captures, key=str)]


def human(n: float) -> str:
    for unit in ("", "k", "M", "G", "T"):
        if abs(n) < 1000 or unit == "T":
            return f"{n:.2f} {unit}".rstrip() if unit else f"{n:g}"
        n /= 1000
    return str(n)


def as_json(reports: list[dict]) -> str:
    """One report indented, several as JSON Lines."""
    return json.dumps(reports[0], indent=2) + "\n" if len(reports) == 1 else "".join(json.dumps(r) + "\n" for r in reports)


def _toml_value(v) -> str:
    return "true" if v is True else "false" if v is False else json.dumps(v) if isinstance(v, str) else repr(v)


def _toml(r: dict, prefix: str) -> str:
    lines = [f"{k} = {_toml_value(v)}" for k, v in r.items() if not isinstance(v, list) and v is not None]
    for k, items in r.items():
        if isinstance(items, list):
            for x in items:
                lines += ["", f"[[{prefix}{k}]]", *[f"{a} = {_toml_value(b)}" for a, b in x.items()]]
    return "\n".join(lines) + "\n"


def as_toml(reports: list[dict]) -> str:
    """One report alone, several as [[reports]]."""
    return _toml(reports[0], "") if len(reports) == 1 else "\n".join("[[reports]]\n" + _toml(r, "reports.") for r in reports)


def as_yaml(reports: list[dict]) -> str:
    out = []
    for r in reports:
        lines = ["---"]
        for k, v in r.items():
            if isinstance(v, list):
                lines.append(f"{k}:")
                for x in v:
                    first, *more = [f"{a}: {json.dumps(b)}" for a, b in x.items()]
                    lines += [f"  - {first}", *[f"    {m}" for m in more]]
            else:
                lines.append(f"{k}: {json.dumps(v)}")
        out.append("\n".join(lines) + "\n")
    return "".join(out)


def as_text(reports: list[dict]) -> str:
    out = []
    for r in reports:
        lines = [f"File: {r.get('path')}", f"Packets: {r['packets']}", f"L2 bytes: {human(r['l2_bytes'])}B", f"L3 bytes: {human(r['l3_bytes'])}B", f"First packet: {r['first']}", f"Last packet: {r['last']}", f"Duration: {r['seconds']:.6f} s", f"In order: {'yes' if r['ordered'] else 'no'}", f"Packets per second: {r['packets_per_second']:.3f}", f"Bytes per second: {human(r['bytes_per_second'])}", f"Packet length: mean {r['mean_len']:.2f}, std {r['std_len']:.2f}, min {r['min_len']}, max {r['max_len']}", f"TCP packets: {r['tcp_packets']}", f"UDP packets: {r['udp_packets']}", f"Unique: {r['unique_src_ips']} sources, {r['unique_dst_ips']} destinations, {r['unique_src_ports']} source ports, {r['unique_dst_ports']} destination ports, {r['unique_flows']} flows"]
        for kind in summary.KEYS:
            rows = r.get(f"top_{kind}", [])
            wide = max((len(x["key"]) for x in rows), default=0)
            lines += [f"Top {kind}:", *[f"  {x['key']:<{wide}}  {x['packets']} packets, {human(x['bytes'])}B" for x in rows]]
        out.append("\n".join(lines) + "\n")
    return "\n".join(out)


FORMATS = {"text": as_text, "json": as_json, "toml": as_toml, "yaml": as_yaml}


# Captures as files.


def split_files(dissected: DataFrame, root: str, granularity: str = "tuple5-sym", top: int = 0, link_type: int = 1, snap_len: int = 65535, overwrite: bool = False) -> DataFrame:
    """Writes one pcap for each selected key, packets in capture order; what isn't IPv4 is skipped.  Returns file, parts (packets), bytes."""
    rows = reorder.split(dissect.split_packets(dissected), granularity, top)
    named = rows.select("*", *[F.col(f"k_{n}").alias(n) for n in reorder.names_of(granularity) if n not in rows.columns])
    parts = named.select(keys.file_name(granularity).alias("file"), "frame_no", capture.pcap_record(snap_len).alias("part"))
    return capture.write_parts(parts, root, ("frame_no",), codec.pcap_file_header(link_type, snap_len), overwrite)


def reordered_places(source: bytes | codec.Feed) -> list[tuple[int, int]]:
    """(offset, bytes) of a capture's parts in their new order: each section's packets in time order, records and blocks as they are.

    pcapng: interfaces of a section come before its packets, other blocks keep their place
    before or after the packets.  Simple packets have no time and are refused.  The file is read
    block by block; what is held is a few numbers a packet.  Parts that follow each other are one,
    so a capture that is in order is one part.
    """
    feed = codec.feed_of(source)
    if codec.sniff(feed.peek(4)) == "pcap":
        records = sorted((r.ts_ns, r.frame_no, r.rec_offset, r.rec_len) for r in codec.pcap_records(feed, "eof") if r.error is None)
        return joined_places([(0, 24), *[r[2:] for r in records]])
    sections: list[dict[str, list]] = []
    for block, record in codec.PcapngWalk(feed).walk():
        if block.error:
            raise codec.CaptureError(block.error.split(":")[0], block.error)
        if block.block_type == codec.SPB:
            raise codec.CaptureError("Io", "simple packets have no time to order by")
        place = (block.rec_offset, len(block.raw))
        if block.role == "section":
            sections.append({"head": [place], "before": [], "packets": [], "after": []})
            continue
        own = sections[-1]
        if record:
            own["packets"].append((record.ts_ns, record.frame_no, *place))
        elif block.role == "interface" or not own["packets"]:
            own["before"].append(place)
        else:
            own["after"].append(place)
    return joined_places([p for s in sections for p in [*s["head"], *s["before"], *[x[2:] for x in sorted(s["packets"])], *s["after"]]])


def joined_places(places: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for at, size in places:
        if out and sum(out[-1]) == at:
            out[-1] = (out[-1][0], out[-1][1] + size)
        else:
            out.append((at, size))
    return out


def reordered_file(buf: bytes) -> bytes:
    """A capture's bytes with its packets in time order."""
    return b"".join(buf[at : at + size] for at, size in reordered_places(buf))


def copied(source, target, places: list[tuple[int, int]], block: int = 1 << 22) -> int:
    """Copies the parts of a random-access file in their order, a block at a time."""
    total = 0
    for at, size in places:
        source.seek(at)
        while size:
            part = source.read(min(size, block))
            target.write(part)
            size, total = size - len(part), total + len(part)
    return total


def reorder_files(spark, path: str, root: str, dry_run: bool = False, overwrite: bool = False) -> DataFrame:
    """Captures at `path` with packets in time order, each below root under its derived name; one that is in order is copied in one piece.  Returns file, bytes.

    dry_run writes nothing: path, section, packets, misplaced, ordered.  A capture is never written over itself.
    A file is one task, which reads it twice, by blocks and then by its parts.
    """
    import uuid

    import pyarrow as pa

    if dry_run:
        spark.dataSource.register(capture.CaptureSource)
        packets = spark.read.format("capture").load(path).where("error is null")
        return reorder.reorder_report(packets, ("path", "section"))
    _, source = capture.store_of(path)
    _, target = capture.store_of(root)
    if source.rstrip("/") == target.rstrip("/") or source.rpartition("/")[0] == target.rstrip("/"):
        raise ValueError(f"{path} can't be reordered in place")
    files = capture.discover(path)

    def run(it):
        from pyarrow import fs

        (store, _), (out_store, base) = capture.store_of(path.rpartition("/")[0] or "/"), capture.store_of(root)
        for batch in it:
            done = []
            for name in batch.column("path").to_pylist():
                own = capture.derived_path(name.rpartition("/")[2], "reordered")
                if not overwrite and out_store.get_file_info(f"{base}/{own}").type != fs.FileType.NotFound:
                    raise FileExistsError(f"{base}/{own}")
                with store.open_input_stream(name, compression=None) as f:
                    places = reordered_places(codec.Feed(f, store.get_file_info(name).size))
                out_store.create_dir(base, recursive=True)
                temp = f"{base}/.{uuid.uuid4().hex}"
                with store.open_input_file(name) as f, out_store.open_output_stream(temp, compression=None) as out:
                    size = copied(f, out, places)
                out_store.move(temp, f"{base}/{own}")
                done.append({"file": own, "bytes": size})
            yield pa.RecordBatch.from_pylist(done, pa.schema([("file", pa.string()), ("bytes", pa.int64())]))

    rows = spark.createDataFrame([(p,) for p in files], "path string").repartition(max(1, len(files)))
    return rows.mapInArrow(run, "file string, bytes long")


def write_intervals(rows: DataFrame, path: str, kind: str = "csv", overwrite: bool = False) -> None:
    """Interval statistics in the order of their starts, as CSV with a header or as Parquet."""
    out = rows.orderBy("start_timestamp_ns").write.mode("overwrite" if overwrite else "errorifexists")
    out.option("header", True).csv(path) if kind == "csv" else out.parquet(path)


def dump_csv(meta: DataFrame, path: str, overwrite: bool = False, numeric_ip: bool = False) -> None:
    dissect.dump(meta, numeric_ip).write.mode("overwrite" if overwrite else "errorifexists").option("header", True).option("escape", '"').csv(path)


def dump_parquet(meta: DataFrame, path: str, overwrite: bool = False, numeric_ip: bool = False) -> None:
    dissect.dump(meta, numeric_ip).write.mode("overwrite" if overwrite else "errorifexists").parquet(path)
