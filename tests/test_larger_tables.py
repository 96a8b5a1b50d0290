"""Queries over tables that are repeated with shifted keys, against their SQL."""

import duckdb
import pytest

from flowlake import registry


def repeated(sf, folder, copies=2, first_user=0):
    """events `copies` times: frames go on counting, each copy has users of its own, and times are the same again."""
    folder.mkdir()
    users = f"user_id + {first_user} + k * (SELECT max(user_id) + 1 FROM '{sf}/events.parquet')"
    duckdb.sql(f"COPY (SELECT event_id + k * 1000 AS event_id, ts, {users} AS user_id, event_type, value, props FROM '{sf}/events.parquet', range({copies}) AS t(k)) TO '{folder}/events.parquet'")
    return str(folder)


def both(spark, folder, name):
    """Rows of a query and of its SQL, sorted."""
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet'")
    got, want = registry.QUERIES[name](spark, folder).toPandas(), con.execute(registry.ORACLE_SQL[name]).df()
    columns = sorted(want.columns)
    return [sorted(map(tuple, df[columns].astype(str).values.tolist())) for df in (got, want)]


@pytest.mark.parametrize("name", ["pcap_roundtrip"])
def test_repeated_hours(spark, sf, tmp_path, name):
    """An hour's frames don't follow each other in the table."""
    got, want = both(spark, repeated(sf, tmp_path / "events"), name)
    assert got == want


def pcapng(packets):
    from flowlake.plans.wire_queries import block, pcapng_head

    body = bytes(8) + (7).to_bytes(4, "big") + (8).to_bytes(4, "big") * 2 + b"abcdefgh"
    return pcapng_head() + block(6, body) * packets


def test_blocks_in_batches(tmp_path, monkeypatch):
    """A file's blocks leave in batches as they are found, so a reader holds few of them whatever the file's size."""
    import pyarrow as pa

    from flowlake.sources import capture

    (tmp_path / "a.pcapng").write_bytes(pcapng(3 * capture.BATCH_ROWS))
    runs, Files = [], type("Files", (), {"columns": ["path", "store"], "select": lambda self, *_: self, "mapInArrow": lambda self, run, _: runs.append(run)})
    capture.read_blocks(Files())
    batches = list(runs[0](iter([pa.RecordBatch.from_pydict({"path": [str(tmp_path / "a.pcapng")], "store": [str(tmp_path)]})])))
    assert [b.num_rows for b in batches] == [capture.BATCH_ROWS] * 3 + [4]


def test_listed_files(spark, tmp_path):
    """Files that are opened by their paths give the rows that their contents give."""
    from flowlake.sources import capture

    for n in range(3):
        (tmp_path / f"{n}.pcapng").write_bytes(pcapng(n) + b"cut"[:n])
    (tmp_path / "3.pcap").write_bytes(b"nonsense")
    read, listed = capture.read_binary(spark, str(tmp_path)), capture.listed(spark, str(tmp_path))
    rows = lambda df: sorted((r[0].rpartition("/")[2], repr(r[1:])) for r in df.collect())
    for f in (capture.read_blocks, capture.read_interfaces, capture.read_sections):
        assert rows(f(read)) == rows(f(listed)) and rows(f(read))
    assert listed.rdd.getNumPartitions() == 4


def test_stream_state_on_disk(spark, sf):
    """A stream's state, a row for each interval and key, is no map in the executors' heaps; the session keeps its own store."""
    from pathlib import Path

    from flowlake import scratch

    provider = "spark.sql.streaming.stateStore.providerClass"
    before, made = spark.conf.get(provider, None), len(scratch.SCRATCH)
    assert registry.QUERIES["stream_intervals"](spark, sf).count() > 0
    assert spark.conf.get(provider, None) == before
    state = next(Path(p.removeprefix("file://")) for p in scratch.SCRATCH[made:] if "stream-intervals" in p) / "state"
    assert list(state.rglob("*.zip")) and not list(state.rglob("*.delta"))


def test_files_are_crafted_after_dealing(spark, sf, monkeypatch):
    """Frames are made of rows that are dealt and sorted already, so the sample that finds the ranges makes none."""
    from flowlake.plans import wire_queries

    plans, real = [], wire_queries.frames
    monkeypatch.setattr(wire_queries, "frames", lambda rows: plans.append(rows._jdf.queryExecution().optimizedPlan().toString()) or real(rows))
    root = wire_queries.nanos_files(spark, sf)
    assert len(plans) == 2 and all("RepartitionByExpression" in p for p in plans)
    assert spark.read.format("capture").load(root).count() == 1000


def test_unique_keys_of_a_stream(spark, tmp_path):
    """Distinct counts leave out what isn't parsed and keys that are missing, and count other protocols' flows without ports."""
    from flowlake.streaming import captures

    kind = "ts_ns long, orig_len long, src_ip long, dst_ip long, src_port long, dst_port long, proto long, parsed boolean"
    second = 1_000_000_000
    rows = [(second, 10, 1, 2, 5, 6, 6, True), (second, 10, 2, 1, 6, 5, 6, True), (second, 10, 1, 2, 5, 6, 17, True), (second, 10, 1, 2, 0, 0, 1, True), (second, 10, 2, 1, 9, 9, 1, True)]
    rows += [(second, 10, 3, 4, 5, 6, 6, False), (second, 10, None, 5, None, None, None, True), (100 * second, 1, 1, 2, 5, 6, 6, True)]
    spark.createDataFrame(rows, kind).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = captures.interval_stream(spark.readStream.schema(kind).parquet(str(tmp_path / "in")), 10_000_000, "0 seconds", unique=True)
    q = stream.writeStream.format("memory").queryName("unique_keys").option("checkpointLocation", str(tmp_path / "state")).start()
    q.processAllAvailable()
    q.stop()
    assert [tuple(r) for r in spark.table("unique_keys").select("total_packets", "total_l2_bytes", "unique_src_ips", "unique_dst_ips", "unique_flows").collect()] == [(7, 70, 2, 3, 3)]


@pytest.mark.parametrize("name", ["crafted_frames", "decode_icmp", "pcap_roundtrip"])
def test_ports_beyond_16_bits(spark, sf, tmp_path, name):
    """Packets whose client port fits a header equal the SQL; no header holds the others'."""
    folder = repeated(sf, tmp_path / "events", first_user=64_500)
    got, want = both(spark, folder, name)
    beyond = duckdb.sql(f"SELECT count(*) FROM '{folder}/events.parquet' WHERE user_id + 1024 > 65535").fetchall()[0][0]
    assert len(got) == len(want) == 2000 and 0 < beyond < 2000
    assert len(set(got) - set(want)) == beyond
