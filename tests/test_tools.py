"""Captures, reports, flows, merging, splitting and streaming."""

import os
import struct

import pytest
from pyspark.sql import functions as F

from flowlake.operators import flows, keys, reorder, summary
from flowlake.plans import tools
from flowlake.plans.packets import crafted, packets
from flowlake.sources import capture, codec
from flowlake.streaming import captures

PCAP_BE = bytes.fromhex("a1b2c3d40002000400000000000000000000ffff0000000143b827a50001e240000000040000000401020304")
PCAP_LE = bytes.fromhex("d4c3b2a1020004000000000000000000ffff00000100000001000000f4010000040000000400000001020304")
SHB = bytes.fromhex("0a0d0d0a0000001c1a2b3c4d00010000ffffffffffffffff0000001c")
IDB = bytes.fromhex("0000000100000014000100000000040000000014")
EPB = bytes.fromhex("00000006000000500000000000037c5875e12a940000002e0000002e000102030405060708090a0b08004500002000000000401100000a0001010a00010204d204d3000c000001020304000000000050")


def block(kind, body):
    size = 12 + len(body)
    return struct.pack("<II", kind, size) + body + struct.pack("<I", size)


def section_le():
    return block(codec.SHB, struct.pack("<IHHq", 0x1A2B3C4D, 1, 0, -1))


def interface_le():
    return block(codec.IDB, struct.pack("<HHI", 1, 0, 1024))


def packet_le(us, number=0, data=b"abcd"):
    return block(codec.EPB, struct.pack("<IIIII", number, 0, us, len(data), len(data)) + data)


def test_pcap_records():
    r = list(codec.records(PCAP_BE))
    assert len(r) == 1 and r[0].ts_ns == 1136142245123456000 and r[0].data == b"\1\2\3\4"
    assert [(x.rec_offset, x.ts_ns) for x in codec.records(PCAP_LE)] == [(24, 1000500000)]
    assert codec.interfaces(PCAP_BE)[0].snap_len == 65535


def test_pcapng_records():
    r = list(codec.records(SHB + IDB + EPB))
    assert len(r) == 1 and (r[0].rec_offset, r[0].ts_ns, len(r[0].data)) == (48, 981144306789012000, 46)
    assert list(codec.records(SHB[:-1] + b"\x1d"))[0].error.startswith("BlockTotalLengthMismatch")
    assert list(codec.records(SHB + EPB))[0].error.startswith("MissingPcapngIDB")
    assert codec.Interface(res_base=10, res_exp=9, ts_offset=2).nanoseconds(5) == 2_000_000_005
    with pytest.raises(codec.CaptureError, match="TimestampOutOfRange"):
        codec.Interface(res_base=10, res_exp=0).nanoseconds(1 << 40)
    assert codec.Interface(res_base=2, res_exp=30).nanoseconds(7) == 7 and codec.Interface(res_exp=12).nanoseconds(5_000) == 5


@pytest.mark.parametrize("block", [1, 7, 64, 1 << 20])
def test_blocks_of_any_size_read_alike(block):
    import io

    for whole in (PCAP_BE, PCAP_LE, SHB + IDB + EPB, section_le() + interface_le() + b"".join(packet_le(k) for k in range(50)), b"nonsense", PCAP_BE[:30], (SHB + IDB + EPB)[:-3]):
        assert list(codec.records(codec.Feed(io.BytesIO(whole), len(whole), block))) == list(codec.records(whole))


def test_a_cut_length_reads_nothing_big():
    """A record that claims more bytes than the file has is damage, found without reading them."""
    import io

    class Counting(io.BytesIO):
        most = 0

        def read(self, n=-1):
            Counting.most = max(Counting.most, n)
            return super().read(n)

    bad = PCAP_BE[:32] + b"\xff\xff\xff\xf0" + PCAP_BE[36:]
    found = list(codec.records(codec.Feed(Counting(bad), len(bad), 64)))
    assert found[0].error == "TruncatedCapture" and Counting.most <= 64


def test_every_prefix_reads():
    for whole in (PCAP_BE, PCAP_LE, SHB + IDB + EPB):
        for n in range(len(whole)):
            for r in codec.records(whole[:n]):
                assert r.error or r.data is not None
    assert list(codec.records(PCAP_BE[:30], truncation="eof")) == []
    assert list(codec.records(PCAP_BE[:30]))[0].error == "TruncatedCapture"


def test_sections_and_scope():
    buf = section_le() + interface_le() + packet_le(200) + packet_le(100) + section_le() + interface_le() + packet_le(50) + packet_le(150)
    r = list(codec.records(buf))
    assert [(x.section, x.ts_ns) for x in r] == [(0, 200000), (0, 100000), (1, 50000), (1, 150000)]
    again = list(codec.records(tools.reordered_file(buf)))
    assert [x.ts_ns for x in again] == [100000, 200000, 50000, 150000]
    late = section_le() + interface_le() + packet_le(200) + interface_le() + packet_le(100, 1)
    assert [(x.ts_ns, x.interface_id) for x in codec.records(tools.reordered_file(late))] == [(100000, 1), (200000, 0)]
    assert tools.reordered_file(PCAP_BE) == PCAP_BE and tools.reordered_places(PCAP_BE) == [(0, len(PCAP_BE))]
    bare = section_le() + interface_le() + section_le() + packet_le(1)
    assert list(codec.records(bare))[0].error and list(codec.records(bare, interface_scope="global"))[0].error is None
    with pytest.raises(codec.CaptureError):
        tools.reordered_file(section_le() + interface_le() + block(codec.SPB, struct.pack("<I", 4) + b"abcd"))


def option(code, value):
    return struct.pack("<HH", code, len(value)) + value + bytes(-len(value) % 4)


def test_block_options(spark):
    head = block(codec.SHB, struct.pack("<IHHq", 0x1A2B3C4D, 1, 0, -1) + option(2, b"test") + option(0, b""))
    face = block(codec.IDB, struct.pack("<HHI", 1, 0, 64) + option(2, b"eth0") + option(9, b"\x09") + option(0, b""))
    pkt = block(codec.EPB, struct.pack("<IIIII", 0, 0, 7, 4, 4) + b"abcd" + option(2, b"\1\0\0\0") + option(3, b"\2h1") + option(3, b"\2h2") + option(0, b""))
    other = block(99, b"some")
    files = spark.createDataFrame([("x.pcapng", bytearray(head + face + pkt + other))], "path string, content binary")
    rows = capture.read_blocks(files).orderBy("block_index").collect()
    assert [r["role"] for r in rows] == ["section", "interface", "packet", "other"]
    assert bytes(rows[0]["options"]["hardware"][0]) == b"test" and bytes(rows[1]["options"]["name"][0]) == b"eth0"
    assert [bytes(x) for x in rows[2]["options"]["hash"]] == [b"\2h1", b"\2h2"] and rows[2]["ts_ns"] == 7
    assert capture.read_sections(files).first()["hardware"] == "test"
    assert capture.read_interfaces(files).first()["res_exp"] == 9


def test_flow_csv_and_totals(spark, sf, tmp_path):
    rows = flows.from_ipv4_rows(packets(spark, sf).withColumn("src_port", F.lit(1).cast("bigint")).withColumn("dst_port", F.lit(1).cast("bigint")))
    features = flows.flow_features(rows, 6 * 3_600_000_000_000, 3_600_000_000_000)
    flows.write_csv(features, str(tmp_path / "csv"))
    back = spark.read.option("header", True).csv(str(tmp_path / "csv"))
    assert back.columns == list(flows.HEADER) and back.count() == features.count()
    assert flows.totals(packets(spark, sf), features)["skipped"] == 0
    with pytest.raises(Exception, match="already exists"):
        flows.write_csv(features, str(tmp_path / "csv"))


def test_pcap_writer():
    assert codec.pcap_file_header() + codec.pcap_record(1136142245123456789, 4, b"\1\2\3\4") == PCAP_BE
    with pytest.raises(codec.CaptureError):
        codec.pcap_record(-1, 4, b"")


def pcaps(folder):
    return [n for n in os.listdir(folder) if n.endswith(".pcap")]


def test_appends_and_overwrites(spark, tmp_path):
    """Appending keeps what is there, link types get files of their own, overwriting leaves only the new rows, and a failing job leaves what was there."""
    spark.dataSource.register(capture.CaptureSource)
    out = str(tmp_path / "caps")
    rows = spark.range(20).select((F.col("id") * 1_000_000_000 + 1_704_067_199_999_999_990).alias("ts_ns"), F.lit(4).cast("long").alias("orig_len"), F.when(F.col("id") < 5, 101).otherwise(1).alias("link_type"), F.lit(b"abcd").alias("data")).coalesce(1)
    write = lambda df, mode: df.write.format("capture").mode(mode).option("nanos", "true").save(out)
    write(rows, "append")
    write(rows, "append")
    back = spark.read.format("capture").load(out)
    assert back.count() == 40 and len(pcaps(out)) == 4 and back.where("link_type = 101").count() == 10
    assert back.agg(F.min("ts_ns")).first()[0] == 1_704_067_199_999_999_990
    with pytest.raises(Exception, match="no place in a pcap record"):
        write(rows.withColumn("ts_ns", F.lit(-1).cast("long")), "overwrite")
    assert spark.read.format("capture").load(out).count() == 40 and sorted(os.listdir(out)) == sorted(n for n in os.listdir(out) if not n.startswith(".") or n.endswith(".crc"))
    write(rows, "overwrite")
    assert spark.read.format("capture").load(out).count() == 20


def test_record_expression(spark):
    """Whole seconds of any size are exact, and times without a place are errors."""
    df = lambda t: spark.createDataFrame([(t, 4, b"\1\2\3\4")], "ts_ns long, orig_len long, data binary").select(capture.pcap_record())
    for t in (1_704_067_199_999_999_990, 0, (1 << 32) * 1_000_000_000 - 1):
        assert bytes(df(t).first()[0]) == codec.pcap_record(t, 4, b"\1\2\3\4")
    for t in (-1, (1 << 32) * 1_000_000_000):
        with pytest.raises(Exception, match="no place in a pcap record"):
            df(t).collect()


def test_wide_rows_keep_their_places(spark):
    """Rows of 512 bytes over many partitions, which adaptive execution joins as it likes."""
    rows = spark.range(0, 30_000, 1, 16).select(F.lit("p").alias("path"), (F.col("id") + 1).alias("frame_no"), F.pmod(F.col("id") * 7919, F.lit(10_007)).alias("ts_ns"), F.lit(b"x" * 512).alias("data"))
    kept = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "32")
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "1m")
        got = reorder.reordered(rows).withColumn("size", F.length("data")).drop("data").collect()
        merged = reorder.merged([reorder.MergeInput(rows, parallel=2)]).withColumn("size", F.length("data")).drop("data").collect()
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    want = sorted(((i * 7919) % 10_007, i + 1) for i in range(30_000))
    assert sorted((r["place"], r["ts_ns"], r["frame_no"], r["size"]) for r in got) == [(k + 1, t, f, 512) for k, (t, f) in enumerate(want)]
    assert sorted(r["place"] for r in merged) == list(range(1, 60_001)) and [r["ts_ns"] for r in sorted(merged, key=lambda r: r["place"])] == sorted(t for t, _ in want for _ in range(2))


def test_reorder_sections_apart(spark):
    rows = spark.createDataFrame([("a", 1, 5), ("a", 2, 3), (None, 1, 9), (None, 2, 9), ("b", 1, 1)], "path string, frame_no long, ts_ns long")
    got = {(r["path"], r["frame_no"]): r["place"] for r in reorder.reordered(rows).collect()}
    assert got == {("a", 2): 1, ("a", 1): 2, (None, 1): 1, (None, 2): 2, ("b", 1): 1}
    assert {r["path"]: (r["misplaced"], r["ordered"]) for r in reorder.reorder_report(rows.where("path is not null")).collect()} == {"a": (1, False), "b": (0, True)}


def test_reorder_refuses_its_own_place(spark, tmp_path):
    (tmp_path / "x.pcap").write_bytes(PCAP_BE)
    for target in (tmp_path, tmp_path / "x.pcap"):
        with pytest.raises(ValueError, match="in place"):
            tools.reorder_files(spark, str(tmp_path / "x.pcap"), str(target))
    assert tools.reorder_files(spark, str(tmp_path), str(tmp_path / "out"), dry_run=True).first()["ordered"]
    assert not (tmp_path / "out").exists()


def test_streams_read_late_names(spark, tmp_path):
    """A file whose name sorts before those that were read is read all the same, and none twice."""
    spark.dataSource.register(capture.CaptureSource)
    (tmp_path / "in").mkdir()
    stream = lambda: spark.readStream.format("capture").load(str(tmp_path / "in")).select("path", "ts_ns").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).start()
    for name in ("m", "a", "z", "b"):
        (tmp_path / "in" / f"{name}.pcap").write_bytes(PCAP_BE)
        q = stream()
        q.processAllAvailable()
        q.stop()
    assert sorted(r[0].rpartition("/")[2] for r in spark.read.parquet(str(tmp_path / "out")).select("path").collect()) == ["a.pcap", "b.pcap", "m.pcap", "z.pcap"]


def test_data_source(spark, sf, tmp_path):
    spark.dataSource.register(capture.CaptureSource)
    rows = crafted(spark, sf).repartitionByRange(3, "frame_no").sortWithinPartitions("frame_no")
    out = str(tmp_path / "caps")
    rows.select("ts_ns", "orig_len", "link_type", "data").write.format("capture").mode("append").option("nanos", "true").save(out)
    back = spark.read.format("capture").load(out)
    assert sorted(r[0] for r in back.select("ts_ns").collect()) == sorted(r[0] for r in rows.select("ts_ns").collect())
    assert back.where("error is not null").count() == 0 and len(pcaps(out)) == 3
    files = capture.read_binary(spark, out)
    assert capture.read_packets(files).count() == rows.count()
    key = lambda df: sorted(tuple(r)[1:] for r in df.collect())
    assert capture.digests(files).count() == 3 and key(capture.digests(files)) == key(capture.file_digests(spark, out))
    assert capture.read_interfaces(files).select("res_exp").distinct().collect() == [(9,)]
    (tmp_path / "bad.pcap").write_bytes(b"nonsense")
    assert spark.read.format("capture").load(str(tmp_path / "bad.pcap")).first()["error"].startswith("InvalidMagicNumber")
    with pytest.raises(Exception, match="InvalidMagicNumber"):
        spark.read.format("capture").option("mode", "failfast").load(str(tmp_path / "bad.pcap")).count()


def test_discovery(tmp_path):
    for n in ("b.PCAP", "a.cap", "c.txt"):
        (tmp_path / n).write_bytes(b"")
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "e.pcapng").write_bytes(b"")
    base = str(tmp_path)
    assert [p.rpartition("/")[2] for p in capture.discover(base)] == ["a.cap", "b.PCAP"]
    assert len(capture.discover(base, True)) == 3 and len(capture.discover(base + "/*.cap")) == 1
    assert [p.rpartition("/")[2] for p in capture.discover(base + "/[ab].*")] == ["a.cap", "b.PCAP"] and len(capture.discover(base + "/[!a].*")) == 2
    assert [p.rpartition("/")[2] for p in capture.discover(base + "/?/*.pcapng")] == ["e.pcapng"] and capture.discover(base + "/[x-z]*") == []
    assert capture.derived_path("/x/y.pcap", "intervals", "csv") == "/x/y.intervals.csv" and capture.derived_path("y.pcap", "reordered") == "y.reordered.pcap"


def frame(spark, rows, columns="ts_ns orig_len src_ip dst_ip src_port dst_port proto"):
    names = columns.split()
    df = spark.createDataFrame([("p", k + 1, *r) for k, r in enumerate(rows)], ["path", "frame_no", *names])
    return df.withColumn("l3_len", F.col("orig_len") - 14).withColumn("parsed", F.lit(True))


def test_summary_statistics(spark):
    rows = [(k, n, 1, 2, None, None, 1) for k, n in enumerate((2, 4, 4, 4, 5, 5, 7, 9))]
    df = frame(spark, [(*r[:4], 0, 0, 1) for r in rows])
    s = summary.summary(df).first()
    assert s["mean_len"] == 5 and s["std_len"] == pytest.approx(2.138089935) and (s["min_len"], s["max_len"], s["ordered"]) == (2, 9, True)
    single = summary.summary(df.limit(1)).first()
    assert single["std_len"] == 0 and single["packets_per_second"] == 0
    assert not summary.ordered(frame(spark, [(2, 1, 1, 2, 0, 0, 1), (1, 1, 1, 2, 0, 0, 1)])).first()["ordered"]


def test_ordered_across_ranges(spark):
    rows = spark.createDataFrame([("p", 10, 5), ("p", 70_000, 4), ("q", 10, 4), ("q", 70_000, 4), ("q", 140_000, 9)], "path string, frame_no long, ts_ns long")
    assert {r["path"]: r["ordered"] for r in summary.ordered(rows).collect()} == {"p": False, "q": True}
    assert [tuple(r) for r in reorder.misplaced(rows).collect()] == [("p", 70_000, 4, 10, 1)]


def test_flow_keys(spark):
    both = frame(spark, [(1, 60, 5, 9, 1000, 80, 6), (2, 60, 9, 5, 80, 1000, 6), (3, 60, 5, 9, 0, 0, 1), (4, 60, 9, 5, 0, 0, 1)])
    assert both.select(keys.summary_key()).distinct().count() == 2
    none = both.withColumn("src_port", F.lit(None).cast("long"))
    assert none.where("proto = 6").select(keys.summary_key().isNull().alias("x")).distinct().collect() == [(True,)]
    assert reorder.key_counts(both, "tuple5-sym").count() == 2 and reorder.key_counts(both, "tuple5").count() == 4
    with pytest.raises(ValueError):
        keys.parts("tuple9")


def test_top_ties(spark):
    traffic = {3: (2, 10), 1: (2, 15), 2: (3, 3), 4: (2, 15)}
    rows = [(0, b, ip, 9, 0, 0, 1) for ip, (n, b) in traffic.items() for _ in range(n)]
    assert [r["key"] for r in summary.top(frame(spark, rows), "src_ip", 2).collect()] == [2, 1]


def test_intervals(spark):
    rows = [(3_000_000_000, 300), (1_900_000_000, 128), (1_100_000_000, 64), (-1, 10)]
    df = frame(spark, [(t, n, 1, 2, 0, 0, 1) for t, n in rows])
    got = [tuple(r) for r in summary.intervals(df, 1_000_000_000, unique=False).orderBy("start_timestamp_ns").collect()]
    assert got == [(-1_000_000_000, 0, 1, 10, 1.0, 10.0), (1_000_000_000, 2_000_000_000, 2, 192, 2.0, 192.0), (3_000_000_000, 4_000_000_000, 1, 300, 1.0, 300.0)]


def test_durations():
    assert [tools.interval_duration(x) for x in ("1s", "500ms", "1.5m")] == [10**9, 5 * 10**8, 9 * 10**10]
    for bad in ("0s", "0.5ns", "1fortnight"):
        with pytest.raises(ValueError):
            tools.interval_duration(bad)
    assert tools.flow_duration("2h") == 7200 * 10**9
    for bad in ("1.5s", "s", "99999999999h"):
        with pytest.raises(ValueError):
            tools.flow_duration(bad)


def packet(ts, size=0, flags=0, back=False, k=[0]):
    k[0] += 1
    a, b = (b"\x0a\0\0\1", 1234), (b"\x0a\0\0\2", 80)
    s, d = (b, a) if back else (a, b)
    return {"path": "p", "frame_no": k[0], "ts_ns": ts, "src_addr": s[0], "dst_addr": d[0], "src_port": s[1], "dst_port": d[1], "proto": 6, "payload": size, "header_len": 20, "tcp_flags": flags, "window": 4096}


def finished(ps, timeout=120 * 10**9, activity=5 * 10**9):
    m = flows.Machine(timeout, activity)
    out = [m.add(p) for p in ps]
    return out, m.end()


def test_flow_endings():
    out, rest = finished([packet(0), packet(1), packet(12), packet(12, flags=flows.FIN, back=True), packet(13, flags=flows.FIN)], 10, 5)
    assert [len(o) for o in out] == [0, 0, 1, 0, 1] and not rest
    out, rest = finished([packet(0, flags=flows.RST), packet(1)])
    assert [len(o) for o in out] == [0, 0] and len(rest) == 1
    out, rest = finished([packet(0), packet(1, flags=flows.RST)])
    assert [len(o) for o in out] == [0, 1] and not rest
    assert finished([packet(0)])[1] == []


def test_flow_subflows():
    one = finished([packet(0, 10), packet(10**6, 20)])[1][0].features()
    assert (one["Subflow Fwd Packets"], one["Subflow Fwd Bytes"], one["Subflow Bwd Packets"], one["Subflow Bwd Bytes"]) == (2, 30, 0, 0)
    two = finished([packet(0, 10), packet(1_000_000_001, 20)])[1][0].features()
    assert (two["Subflow Fwd Packets"], two["Subflow Fwd Bytes"]) == (1, 15)


def test_flow_bulk():
    four = finished([packet(k * 1000, 10) for k in range(4)])[1][0].features()
    assert (four["Fwd Bytes/Bulk Avg"], four["Fwd Packet/Bulk Avg"]) == (40, 4) and four["Fwd Bulk Rate Avg"] == pytest.approx(40 / 3e-6)
    broken = finished([packet(0, 10), packet(1, 10), packet(2, 5, back=True), packet(3, 10), packet(4, 10)])[1][0].features()
    assert broken["Fwd Packet/Bulk Avg"] == 0


def test_flow_disorder():
    got = finished([packet(100_000), packet(50_000), packet(60_000)])[1][0].features()
    assert got["Flow Duration"] == 0 and got["Flow IAT Min"] == 0 and got["Flow IAT Max"] == 10


def test_flow_rows(spark):
    df = spark.createDataFrame([packet(10**9 + 234567890, 10, flows.SYN), packet(10**9 + 235567890, 20, flows.ACK, True)], ", ".join(f"{c} {'string' if c == 'path' else 'binary' if c.endswith('addr') else 'long'}" for c in flows.PACKET))
    out = flows.flow_features(df.select(*flows.PACKET), label="x")
    row = flows.as_text(out).first()
    assert len(row) == 85 and row["Label"] == "x" and row["Flow ID"] == "10.0.0.1-10.0.0.2-1234-80-6" and row["Timestamp"] == "1970-01-01T00:00:01.23456789Z"
    assert all(v not in ("NaN", "Infinity") and "E" not in v for k, v in row.asDict().items() if k not in flows.TEXT)
    assert (row["Flow Duration"], row["Down/Up Ratio"], row["Flow Bytes/s"]) == ("1000", "1", "30000")


def test_merge(spark):
    a = frame(spark, [(1_000_000_000, 60, 0x0A000001, 0x0A010203, 1, 2, 6), (5_000_000_000, 60, 0x0B000001, 0x0A000002, 1, 2, 6)])
    got = reorder.merged([reorder.MergeInput(a, starts=[0, 10], repeat=2)]).orderBy("place").select("ts_ns", "repetition").collect()
    assert sorted(r[0] // 10**9 for r in got) == sorted([1, 5, 6, 10, 11, 15, 16, 20]) and len({r[1] for r in got}) == 4
    ips = reorder.MergeInput(a, ips=[("10.0.0.0/8", "172.16.0.0/12"), ("10.1.0.0/16", "1.1.0.0/16")], sources=["9.9.9.9", "8.8.8.0/30"])
    rows = reorder.merged([ips], seed=3).orderBy("frame_no").collect()
    assert rows[0]["dst_ip"] == 0x01010203 and rows[0]["src_ip"] == 0xAC100001 and rows[1]["src_ip"] in reorder.pool(["9.9.9.9", "8.8.8.0/30"])
    assert tools.merge_spec("x.pcap#s5#r2#ip10.0.0.0/8:11.0.0.0/8#src1.2.3.4")["ips"] == [("10.0.0.0/8", "11.0.0.0/8")]
    assert tools.overlaid({"a": 1, "b": True}, {"a": 2, "b": None}) == {"a": 2, "b": True} and len(tools.jobs("[{}, {}]")) == 2


def test_rewrite(spark, sf):
    from flowlake.functions import checksum, fields

    rows = crafted(spark, sf).withColumn("src_ip", F.lit(0x01020304).cast("bigint"))
    h = F.substring("data", 15, 20)
    kept = reorder.rewrite(rows).select(fields.read(h, "Ipv4.src"), checksum.ipv4_valid(h)).distinct().collect()
    assert {r[0] for r in kept} == {0x01020304} and False in {r[1] for r in kept}
    assert reorder.rewrite(rows, fix_checksum=True).where(~checksum.ipv4_valid(h)).count() == 0


def test_split_files(spark, sf, tmp_path):
    from flowlake.operators import dissect

    rows = dissect.dissect(crafted(spark, sf).select("path", "frame_no", "ts_ns", "orig_len", "data", "link_type"))
    done = tools.split_files(rows, str(tmp_path), "src-ip", top=3).collect()
    assert len(done) == 3 == len(os.listdir(tmp_path))
    biggest = summary.top(packets(spark, sf), "src_ip", 1).first()
    for r in done:
        found = list(codec.records((tmp_path / r["file"]).read_bytes()))
        assert len(found) == r["parts"] and [x.ts_ns for x in found] == sorted(x.ts_ns for x in found)
    assert max(r["parts"] for r in done) == biggest["packets"]
    with pytest.raises(Exception, match="FileExists"):
        tools.split_files(rows, str(tmp_path), "src-ip", top=3).collect()
    assert len(tools.split_files(rows, str(tmp_path), "tuple5-sym", top=2, overwrite=True).collect()) == 2


def test_plain_numbers(spark):
    """Doubles without exponents, as they are, however small."""
    values = [1e-20, -2.5e-7, 1.0, 0.1, 1e7, 1.25e10, 123456789.25, 0.0]
    rows = spark.createDataFrame([(v,) for v in values], "x double")
    names = {n: F.lit("t") if n in flows.TEXT else F.lit(1).cast("long") if n in flows.WHOLE else F.col("x") for n in flows.HEADER}
    got = [r[0] for r in flows.as_text(rows.select(*[c.alias(n) for n, c in names.items()])).select("`Flow Bytes/s`").collect()]
    assert got == ["0.00000000000000000001", "-0.00000025", "1", "0.1", "10000000", "12500000000", "123456789.25", "0"]


def test_reports(spark, sf):
    import json
    import tomllib

    one = tools.report(packets(spark, sf), 3)
    assert len(one) == 1 and len(one[0]["top_src_ip"]) == 3
    assert json.loads(tools.as_json(one))["packets"] == 1000 and len(tools.as_json(one * 2).splitlines()) == 2
    assert tomllib.loads(tools.as_toml(one))["top_dst_ip"][0]["packets"] == one[0]["top_dst_ip"][0]["packets"]
    assert len(tomllib.loads(tools.as_toml(one * 2))["reports"]) == 2
    assert tools.as_yaml(one * 2).count("---\n") == 2 and "Packets: 1000" in tools.as_text(one)


def test_streams(spark, sf, tmp_path):
    rows = flows.from_ipv4_rows(packets(spark, sf)).withColumn("orig_len", F.lit(60).cast("bigint"))
    src = str(tmp_path / "in")
    rows.coalesce(1).write.parquet(src)
    stream = spark.readStream.schema(rows.schema).parquet(src)
    q = captures.flow_stream(stream, 6 * 3_600_000_000_000, 3_600_000_000_000).writeStream.format("memory").queryName("flows_out").option("checkpointLocation", str(tmp_path / "c1")).start()
    q.processAllAvailable()
    q.stop()
    want = flows.flow_rows(rows, 6 * 3_600_000_000_000, 3_600_000_000_000)
    assert spark.table("flows_out").where("closed_at is not null").count() == want.where("closed_at is not null").count()
    q = captures.interval_stream(stream, 3_600_000_000, "0 seconds").writeStream.format("memory").queryName("intervals_out").option("checkpointLocation", str(tmp_path / "c2")).start()
    q.processAllAvailable()
    q.stop()
    full = {r["start_timestamp_ns"]: r["total_packets"] for r in summary.intervals(packets(spark, sf), 3_600_000_000_000, unique=False).collect()}
    got = {r["start_timestamp_ns"]: r["total_packets"] for r in spark.table("intervals_out").collect()}
    assert got and all(full[k] == v for k, v in got.items())
