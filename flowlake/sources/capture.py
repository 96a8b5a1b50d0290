"""Spark sources and sinks for capture files.

    spark.dataSource.register(CaptureSource)
    spark.read.format("capture").load("/captures")             # packets
    packets.write.format("capture").mode("overwrite").save(d)  # pcap files, one for each partition

A record's place follows from all records before it, so one file is one task; a folder of
many files is many tasks.  A file of any size is read block by block, and rows leave as they
are found.  Files are opened through pyarrow's file systems, so any store that pyarrow knows
works, and `listed` names them for the readers of blocks, interfaces and sections; `read_binary`
reads whole files through Spark's own (binaryFile, up to 2 GB each), for stores that only Spark
knows and for digests.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, InputPartition, WriterCommitMessage

from flowlake.sources import codec

PACKETS = "path string, frame_no long, section int, interface_id int, ts_ns long, orig_len long, cap_len int, link_type int, data binary, rec_offset long, rec_len int, error string"
BLOCKS = "path string, block_index long, section int, block_type long, role string, interface_id int, ts_ns long, frame_no long, rec_offset long, raw binary, error string, options map<string,array<binary>>"
INTERFACES = "path string, section int, interface_id int, link_type int, snap_len long, res_base int, res_exp int"
ENDINGS = re.compile(r"\.(pcap|pcapng|cap)$", re.IGNORECASE)

ARROW = pa.schema([("path", pa.string()), ("frame_no", pa.int64()), ("section", pa.int32()), ("interface_id", pa.int32()), ("ts_ns", pa.int64()), ("orig_len", pa.int64()), ("cap_len", pa.int32()), ("link_type", pa.int32()), ("data", pa.binary()), ("rec_offset", pa.int64()), ("rec_len", pa.int32()), ("error", pa.string())])
BLOCK_ARROW = pa.schema([("path", pa.string()), ("block_index", pa.int64()), ("section", pa.int32()), ("block_type", pa.int64()), ("role", pa.string()), ("interface_id", pa.int32()), ("ts_ns", pa.int64()), ("frame_no", pa.int64()), ("rec_offset", pa.int64()), ("raw", pa.binary()), ("error", pa.string()), ("options", pa.map_(pa.string(), pa.list_(pa.binary())))])


def row(path: str, r: codec.Record) -> tuple:
    return path, r.frame_no, r.section, r.interface_id, r.ts_ns, r.orig_len, None if r.data is None else len(r.data), r.link_type, r.data, r.rec_offset, r.rec_len, r.error


#: Packets and bytes of one batch of rows.
BATCH_ROWS, BATCH_BYTES = 8192, 16 << 20


def batch_of(rows: list[tuple], schema: pa.Schema = ARROW) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)


def batches(path: str, source: bytes | codec.Feed, options: dict) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for r in codec.records(source, options.get("truncation", "error"), options.get("interfacescope", "section")):
        if r.error and options.get("mode", "permissive").lower() == "failfast":
            raise codec.CaptureError(r.error.split(":")[0], f"{path} at {r.rec_offset}")
        held.append(row(path, r))
        size += r.rec_len
        if len(held) == BATCH_ROWS or size > BATCH_BYTES:
            yield batch_of(held)
            held, size = [], 0
    if held:
        yield batch_of(held)


def store_of(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("/") else f"file://{path}")


def discover(path: str, recursive: bool = False) -> list[str]:
    """Capture files at a path, sorted: a file, a folder's files by their endings, or a glob.

    Any part of a path may hold *, ? or [..]; * and ? stay within a part.
    """
    return [i.path for i in found_files(path, recursive)]


def part_pattern(part: str) -> str:
    """One part of a glob as an expression: *, ?, [abc], [a-z], [!abc]; a bracket that isn't closed stands for itself."""
    out, at = "", 0
    while at < len(part):
        c = part[at]
        end = part.find("]", at + 2) if c == "[" else -1
        if c == "[" and end > 0:
            inside = part[at + 1 : end].replace("\\", "\\\\")
            out += "[" + ("^/" + inside[1:] if inside[0] == "!" else inside) + "]"
            at = end
        else:
            out += "[^/]*" if c == "*" else "[^/]" if c == "?" else re.escape(c)
        at += 1
    return out


def found_files(path: str, recursive: bool = False) -> list:
    from pyarrow import fs

    parts = path.split("/")
    first = next((k for k, p in enumerate(parts) if any(c in p for c in "*?[")), None)
    if first is not None:
        store, base = store_of("/".join(parts[:first]) or "/")
        depth = len(parts) - first
        match = re.compile("/".join(map(part_pattern, parts[first:])) + "$")
        files = [i for i in store.get_file_info(fs.FileSelector(base, recursive=depth > 1)) if i.is_file]
        return sorted((i for i in files if match.match(i.path.removeprefix(base).lstrip("/"))), key=lambda i: i.path)
    store, base = store_of(path)
    info = store.get_file_info(base)
    if info.type == fs.FileType.File:
        return [info]
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    files = [i for i in store.get_file_info(fs.FileSelector(base, recursive=recursive)) if i.is_file]
    return sorted((i for i in files if ENDINGS.search(i.path) and not i.base_name.startswith(".")), key=lambda i: i.path)


class FilePartition(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)
        self.path = path


class CaptureReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = {k.lower(): v for k, v in dict(options).items()}
        self.path = self.options.get("path", "")

    def partitions(self):
        return [FilePartition(p) for p in discover(self.path, self.options.get("recursive", "false").lower() == "true")]

    def read(self, partition):
        store, _ = store_of(self.path.rpartition("/")[0] or "/")
        with store.open_input_stream(partition.path, compression=None) as f:
            yield from batches(partition.path, codec.Feed(f, store.get_file_info(partition.path).size), self.options)


class CaptureStream(CaptureReader, DataSourceStreamReader):
    """Files of a folder, each read once, whatever its name; files must appear whole (by renaming).

    An offset holds the newest modification time seen, and the names of all files seen that are
    at most `maxFileAge` seconds (a week) older than it; files that appear older than that are
    left out, as they can't be told from ones that were read.
    """

    def _files(self):
        return [(i.mtime_ns or 0, i.path) for i in found_files(self.path, self.options.get("recursive", "false").lower() == "true")]

    def initialOffset(self):
        return {"newest": 0, "names": []}

    def latestOffset(self):
        files = self._files()
        newest = max((t for t, _ in files), default=0)
        oldest = newest - int(float(self.options.get("maxfileage", 604_800)) * 1_000_000_000)
        return {"newest": newest, "names": sorted(p for t, p in files if t >= oldest)}

    def partitions(self, start, end):
        seen = set(start["names"])
        return [FilePartition(p) for p in end["names"] if p not in seen]


class FileMessage(WriterCommitMessage):
    def __init__(self, temps: list[str], names: list[str], packets: int):
        self.temps, self.names, self.packets = temps, names, packets


class CaptureWriter(DataSourceArrowWriter):
    """pcap files, one for each partition and link type, in the order of the rows.

    Files get their names when the job commits, and names hold the job's own id, so a job that
    appends takes no file's place.  With overwrite the files that were there before are deleted
    once the new ones have their names.
    """

    def __init__(self, options: dict, overwrite: bool):
        self.options = {k.lower(): v for k, v in dict(options).items()}
        self.path, self.overwrite, self.job = self.options["path"], overwrite, uuid.uuid4().hex
        self.nanos = self.options.get("nanos", "false").lower() == "true"
        self.big = self.options.get("endian", "big").lower() == "big"
        self.snap = int(self.options.get("snaplen", 65535))

    def write(self, iterator):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        store, base = store_of(self.path)
        store.create_dir(base, recursive=True)
        attempt, n, out = uuid.uuid4().hex, 0, {}
        for batch in iterator:
            for ts_ns, orig_len, link, data in zip(*[batch.column(c).to_pylist() for c in ("ts_ns", "orig_len", "link_type", "data")], strict=True):
                link = 1 if link is None else link
                if link not in out:
                    out[link] = store.open_output_stream(f"{base}/.{self.job}-{attempt}-{link}", compression=None)
                    out[link].write(codec.pcap_file_header(link, self.snap, self.nanos, self.big))
                out[link].write(codec.pcap_record(ts_ns, orig_len, data, self.snap, self.nanos, self.big))
            n += batch.num_rows
        for f in out.values():
            f.close()
        return FileMessage([f".{self.job}-{attempt}-{link}" for link in out], [f"part-{part:05d}-{self.job}-{link}.pcap" for link in out], n)

    def commit(self, messages):
        store, base = store_of(self.path)
        before = [i.path for i in found_files(self.path)] if self.overwrite and messages else []
        for m in messages:
            for temp, name in zip(m.temps, m.names, strict=True) if m else ():
                store.move(f"{base}/{temp}", f"{base}/{name}")
        for old in before:
            store.delete_file(old)
        self._sweep(store, base)

    def abort(self, messages):
        self._sweep(*store_of(self.path))

    def _sweep(self, store, base: str) -> None:
        """Deletes what attempts of this job left behind that weren't committed."""
        from pyarrow import fs

        for i in store.get_file_info(fs.FileSelector(base, allow_not_found=True)):
            if i.is_file and i.base_name.startswith(f".{self.job}-"):
                store.delete_file(i.path)


class CaptureSource(DataSource):
    """Options: path; mode permissive (damage is a row with `error`) or failfast; truncation error or eof; interfaceScope section or global; recursive; maxFileAge for streams; for writing snapLen, nanos, endian."""

    @classmethod
    def name(cls):
        return "capture"

    def schema(self):
        return PACKETS

    def reader(self, schema):
        return CaptureReader(self.options)

    def streamReader(self, schema):
        return CaptureStream(self.options)

    def writer(self, schema, overwrite):
        return CaptureWriter(self.options, overwrite)


def read_binary(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """path, content, length of capture files, through Spark's own file systems."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path).where(F.col("path").rlike(r"(?i)\.(pcap|pcapng|cap)$")).select("path", "content", "length")


def read_packets(files: DataFrame, **options) -> DataFrame:
    """Packets of path, content rows."""
    options = {k.lower(): str(v) for k, v in options.items()}

    def run(it):
        for batch in it:
            for path, buf in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                yield from batches(path, buf, options)

    return files.select("path", "content").mapInArrow(run, PACKETS)


def listed(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """path, store of capture files, one a task.  Readers of blocks, interfaces and sections open them and read them block by block, so files of any size need no memory."""
    files = [(p, path.rpartition("/")[0] or "/") for p in discover(path, recursive)]
    return spark.createDataFrame(spark.sparkContext.parallelize(files, max(1, len(files))), "path string, store string")


def sources(files: DataFrame) -> DataFrame:
    return files.select("path", "content" if "content" in files.columns else "store")


def feeds(batch: pa.RecordBatch) -> Iterator[tuple[str, codec.Feed]]:
    """The files of a batch of sources(), one after another."""
    if "content" in batch.schema.names:
        for path, buf in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
            yield path, codec.Feed(buf)
        return
    for path, root in zip(batch.column("path").to_pylist(), batch.column("store").to_pylist(), strict=True):
        store, _ = store_of(root)
        with store.open_input_stream(path, compression=None) as f:
            yield path, codec.Feed(f, store.get_file_info(path).size)


def read_blocks(files: DataFrame, interface_scope: str = "section") -> DataFrame:
    """All pcapng blocks of files (path, content, or listed()), packets or not, with the options of section headers, interfaces and packets by name."""

    def run(it):
        for batch in it:
            for path, feed in feeds(batch):
                held, size = [], 0
                for b, _ in codec.PcapngWalk(feed, interface_scope).walk():
                    held.append((path, b.index, b.section, b.block_type, b.role, b.interface_id, b.ts_ns, b.frame_no, b.rec_offset, b.raw, b.error, list(b.options.items())))
                    size += len(b.raw)
                    if len(held) == BATCH_ROWS or size > BATCH_BYTES:
                        yield batch_of(held, BLOCK_ARROW)
                        held, size = [], 0
                if held:
                    yield batch_of(held, BLOCK_ARROW)

    return sources(files).mapInArrow(run, BLOCKS)


def read_interfaces(files: DataFrame) -> DataFrame:
    """Interfaces of files (path, content, or listed())."""

    def run(it):
        for batch in it:
            rows = [(path, i.section, i.interface_id, i.link_type, i.snap_len, i.res_base, i.res_exp) for path, feed in feeds(batch) for i in codec.interfaces(feed)]
            if rows:
                kinds = (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["path", "section", "interface_id", "link_type", "snap_len", "res_base", "res_exp"])

    return sources(files).mapInArrow(run, INTERFACES)


def read_sections(files: DataFrame) -> DataFrame:
    """path, section, major, minor, length, hardware, os, application of pcapng files (path, content, or listed())."""

    def run(it):
        for batch in it:
            rows = []
            for path, feed in feeds(batch):
                walk = codec.PcapngWalk(feed)
                for _ in walk.walk():
                    pass
                rows += [{"path": path, "section": k} | s for k, s in enumerate(walk.sections)]
            if rows:
                text = {n: pa.string() for n in codec.SECTION_OPTIONS.values()}
                yield pa.RecordBatch.from_pylist(rows, pa.schema({"path": pa.string(), "section": pa.int32(), "major": pa.int32(), "minor": pa.int32(), "length": pa.int64()} | text))

    return sources(files).mapInArrow(run, "path string, section int, major int, minor int, length long, hardware string, os string, application string")


def digests(files: DataFrame) -> DataFrame:
    """path, md5, sha1, sha256, length of whole files."""
    return files.select("path", F.md5("content").alias("md5"), F.sha1("content").alias("sha1"), F.sha2("content", 256).alias("sha256"), F.length("content").alias("length"))


def file_digests(spark: SparkSession, path: str, recursive: bool = False, block: int = 1 << 22) -> DataFrame:
    """As digests(), of files of any size, read block by block through pyarrow's file systems."""
    import hashlib

    files = discover(path, recursive)

    def run(it):
        store, _ = store_of(path.rpartition("/")[0] or "/")
        for batch in it:
            done = []
            for name in batch.column("path").to_pylist():
                sums, size = [hashlib.md5(), hashlib.sha1(), hashlib.sha256()], 0
                with store.open_input_stream(name, compression=None) as f:
                    while part := f.read(block):
                        size += len(part)
                        for s in sums:
                            s.update(part)
                done.append({"path": name, "md5": sums[0].hexdigest(), "sha1": sums[1].hexdigest(), "sha256": sums[2].hexdigest(), "length": size})
            yield pa.RecordBatch.from_pylist(done, pa.schema([("path", pa.string()), ("md5", pa.string()), ("sha1", pa.string()), ("sha256", pa.string()), ("length", pa.int64())]))

    rows = spark.createDataFrame([(p,) for p in files], "path string").repartition(max(1, len(files)))
    return rows.mapInArrow(run, "path string, md5 string, sha1 string, sha256 string, length long")


def pcap_record(snap_len: int = 65535) -> Column:
    """A packet's record, with microseconds; a time that has no place in it is an error."""
    from flowlake.functions.fields import to_bytes

    size = F.least(F.length("data"), F.lit(snap_len))
    fits = (F.col("ts_ns") >= 0) & (F.col("ts_ns") < (1_000_000_000 << 32))
    seconds = F.when(fits, F.expr("ts_ns div 1000000000")).otherwise(F.raise_error(F.concat(F.lit("Io: no place in a pcap record for the time "), F.col("ts_ns").cast("string"))).cast("bigint"))
    micros = F.expr("ts_ns % 1000000000 div 1000")
    return F.concat(to_bytes(seconds, 4), to_bytes(micros, 4), to_bytes(size, 4), to_bytes(F.col("orig_len"), 4), F.substring(F.col("data"), F.lit(1), size))


def truncated() -> Column:
    """Whether a packet was captured in part."""
    return F.length("data") < F.col("orig_len")


def seconds() -> Column:
    """A packet's time in seconds."""
    return F.col("ts_ns") / 1_000_000_000


def write_parts(rows: DataFrame, root: str, order: tuple[str, ...], head: bytes = b"", overwrite: bool = False) -> DataFrame:
    """Files below root, each `head` and the parts of its rows in order: rows have file, part and the order columns.  Returns file, parts, bytes.

    Rows are dealt by file and sorted; a task appends to one open file, so files of any size
    need no memory.  A file gets its name when it is whole; existing files are refused unless overwrite.
    """
    dealt = rows.select("file", *order, "part").repartition("file").sortWithinPartitions("file", *order).select("file", "part")

    def run(it):
        from pyarrow import fs

        store, base = store_of(root)
        now, out, temp, parts, size, done = None, None, "", 0, 0, []

        def close():
            out.close()
            if not overwrite and store.get_file_info(f"{base}/{now}").type != fs.FileType.NotFound:
                store.delete_file(temp)
                raise FileExistsError(f"{base}/{now}")
            store.move(temp, f"{base}/{now}")
            done.append({"file": now, "parts": parts, "bytes": size})

        for batch in it:
            for name, part in zip(batch.column("file").to_pylist(), batch.column("part").to_pylist(), strict=True):
                if name != now:
                    if out is not None:
                        close()
                    now, parts, size = name, 0, len(head)
                    folder = f"{base}/{name}".rpartition("/")[0]
                    store.create_dir(folder, recursive=True)
                    temp = f"{folder}/.{uuid.uuid4().hex}"
                    out = store.open_output_stream(temp, compression=None)
                    out.write(head)
                out.write(part)
                parts, size = parts + 1, size + len(part)
        if out is not None:
            close()
        if done:
            yield pa.RecordBatch.from_pylist(done, pa.schema([("file", pa.string()), ("parts", pa.int64()), ("bytes", pa.int64())]))

    return dealt.mapInArrow(run, "file string, parts long, bytes long")


def write_pcaps(packets: DataFrame, root: str, link_type: int = 1, snap_len: int = 65535, overwrite: bool = False) -> DataFrame:
    """One pcap file for each `path` of the packets, which names it below root, in the order of frame_no.  Returns file, parts, bytes."""
    parts = packets.select(F.col("path").alias("file"), "frame_no", pcap_record(snap_len).alias("part"))
    return write_parts(parts, root, ("frame_no",), codec.pcap_file_header(link_type, snap_len), overwrite)


def write_files(rows: DataFrame, root: str, overwrite: bool = False) -> DataFrame:
    """Writes every row (file, content) as a file below root; returns file, bytes.  Written beside and renamed; refuses existing files unless overwrite."""

    def run(it):
        from pyarrow import fs

        store, base = store_of(root)
        for batch in it:
            done = []
            for name, content in zip(batch.column("file").to_pylist(), batch.column("content").to_pylist(), strict=True):
                target = f"{base}/{name}"
                store.create_dir(target.rpartition("/")[0], recursive=True)
                if not overwrite and store.get_file_info(target).type != fs.FileType.NotFound:
                    raise FileExistsError(target)
                part = f"{target.rpartition('/')[0]}/.{uuid.uuid4().hex}"
                with store.open_output_stream(part, compression=None) as f:
                    f.write(content)
                store.move(part, target)
                done.append({"file": name, "bytes": len(content)})
            yield pa.RecordBatch.from_pylist(done, pa.schema([("file", pa.string()), ("bytes", pa.int64())]))

    return rows.select("file", "content").mapInArrow(run, "file string, bytes long")


def derived_path(path: str, kind: str, ending: str = "") -> str:
    """X.csv, X.intervals.csv, X.capinfo.json, X.reordered.pcap from X.pcap; kind '' for the dump."""
    stem, dot, own = path.rpartition(".")
    if not dot or "/" in own:
        stem, own = path, ""
    parts = [stem] + ([kind] if kind else []) + [ending or own]
    return ".".join(p for p in parts if p)
