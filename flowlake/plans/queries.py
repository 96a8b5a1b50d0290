"""Registered queries of the packet engine over `events`, and SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlake.functions import checksum, fields
from flowlake.functions.net import ipv4_text, iso_text, seconds_text
from flowlake.operators import keys, reorder, sessions, summary
from flowlake.plans.packets import FRAMES_SQL, PACKETS_SQL, crafted, packets

HOUR = 3_600_000_000_000
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, tables: str = PACKETS_SQL):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = tables + sql
        return f

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


BIG = "CAST({} AS BIGINT)"
SYM5 = "CASE WHEN src_ip < dst_ip OR (src_ip = dst_ip AND src_port <= dst_port) THEN {} ELSE {} END"
FLOW = "(" + ", ".join([SYM5.format(a, b) for a, b in (("src_ip", "dst_ip"), ("src_port", "dst_port"), ("dst_ip", "src_ip"), ("dst_port", "src_port"))]) + ", proto)"


def interval_sql(unique: bool) -> str:
    more = f", count(DISTINCT src_ip) AS unique_src_ips, count(DISTINCT dst_ip) AS unique_dst_ips, count(DISTINCT {FLOW}) AS unique_flows" if unique else ""
    return f""" SELECT ts_ns - ts_ns % {HOUR} AS start_timestamp_ns, ts_ns - ts_ns % {HOUR} + {HOUR} AS end_timestamp_ns_exclusive,
      count(*) AS total_packets, CAST(sum(orig_len) AS BIGINT) AS total_l2_bytes, round(count(*) / 3600.0::DOUBLE, 6) AS packets_per_second,
      round(CAST(sum(orig_len) AS BIGINT) / 3600.0::DOUBLE, 6) AS bytes_per_second{more}
    FROM pk GROUP BY 1, 2"""


@query(interval_sql(False))
def interval_stats(spark, sf_dir):
    return rounded(summary.intervals(packets(spark, sf_dir), HOUR, unique=False))


@query(interval_sql(True))
def interval_unique(spark, sf_dir):
    return rounded(summary.intervals(packets(spark, sf_dir), HOUR))


@query(f""" SELECT path, count(*) AS packets, {BIG.format('sum(orig_len)')} AS l2_bytes, {BIG.format('sum(l3_len)')} AS l3_bytes, min(ts_ns) AS first_ns, max(ts_ns) AS last_ns,
    round(avg(orig_len), 6) AS mean_len, round(stddev_samp(orig_len), 6) AS std_len, min(orig_len) AS min_len, max(orig_len) AS max_len,
    count(*) FILTER (proto = 6) AS tcp_packets, count(*) FILTER (proto = 17) AS udp_packets,
    count(DISTINCT src_ip) AS unique_src_ips, count(DISTINCT dst_ip) AS unique_dst_ips, count(DISTINCT src_port) AS unique_src_ports, count(DISTINCT dst_port) AS unique_dst_ports,
    count(DISTINCT {FLOW}) AS unique_flows, CAST(0 AS BIGINT) AS unparsed, round((max(ts_ns) - min(ts_ns)) / 1e9, 6) AS seconds,
    round(count(*) / ((max(ts_ns) - min(ts_ns)) / 1e9), 6) AS packets_per_second, round({BIG.format('sum(orig_len)')} / ((max(ts_ns) - min(ts_ns)) / 1e9), 6) AS bytes_per_second,
    round({BIG.format('sum(orig_len)')} / count(*), 6) AS avg_l2, round({BIG.format('sum(l3_len)')} / count(*), 6) AS avg_l3,
    (SELECT count(*) = 0 FROM (SELECT ts_ns, max(ts_ns) OVER (ORDER BY frame_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM pk) WHERE ts_ns < m) AS ordered
  FROM pk GROUP BY path""")
def capture_summary(spark, sf_dir):
    return rounded(summary.summary(packets(spark, sf_dir)))


SHUFFLED = " , sh AS (SELECT * REPLACE (ts_ns + (frame_no * 7919) % 11 * 60000000000 AS ts_ns) FROM pk)"


def shuffled(spark, sf_dir) -> DataFrame:
    """The packets with minutes added by frame, so that times go backwards here and there."""
    return packets(spark, sf_dir).withColumn("ts_ns", F.col("ts_ns") + F.pmod(F.col("frame_no") * 7919, F.lit(11)) * 60_000_000_000)


@query(f"{SHUFFLED} SELECT path, count(*) = 0 AS ordered FROM (SELECT 'events' AS path, ts_ns, max(ts_ns) OVER (ORDER BY frame_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM sh) WHERE ts_ns < m GROUP BY path")
def ordered_flag(spark, sf_dir):
    return summary.ordered(shuffled(spark, sf_dir))


for _kind in summary.KEYS:
    QUERIES[f"top_{_kind}"] = lambda spark, sf_dir, k=_kind: summary.top(packets(spark, sf_dir), k, 10)
    SQL[f"top_{_kind}"] = PACKETS_SQL + f" SELECT {_kind} AS key, count(*) AS packets, CAST(sum(orig_len) AS BIGINT) AS bytes FROM pk GROUP BY 1 ORDER BY 2 DESC, 3 DESC, 1 LIMIT 10"


@query(" UNION ALL ".join(f"SELECT path, '{k}' AS kind, {k} AS key, count(*) AS packets, CAST(sum(orig_len) AS BIGINT) AS bytes FROM pk GROUP BY 1, 3" for k in summary.KEYS))
def traffic_by_key(spark, sf_dir):
    return summary.traffic(packets(spark, sf_dir))


def _key_sql(g: str) -> str:
    if g in ("src-ip", "dst-ip"):
        return f"{g.replace('-', '_')} AS ip"
    size, sym = int(g[5]), g.endswith("-sym")
    first = "src_ip < dst_ip OR (src_ip = dst_ip AND src_port <= dst_port)" if size >= 4 else "src_ip <= dst_ip"
    pick = lambda a, b: f"CASE WHEN {first} THEN {a} ELSE {b} END" if sym else a
    cols = [f"{pick('src_ip', 'dst_ip')} AS a"] + ([f"{pick('src_port', 'dst_port')} AS a_port"] if size >= 4 else [])
    cols += [f"{pick('dst_ip', 'src_ip')} AS b"] + ([f"{pick('dst_port', 'src_port')} AS b_port"] if size >= 4 else [])
    return ", ".join(cols + (["proto"] if size in (3, 5) else []))


for _g in keys.GRANULARITIES:
    _name = "flow_key_" + _g.replace("-", "_") + "_counts"
    QUERIES[_name] = lambda spark, sf_dir, g=_g: reorder.key_counts(packets(spark, sf_dir), g)
    SQL[_name] = PACKETS_SQL + f" SELECT {_key_sql(_g)}, count(*) AS packets FROM pk GROUP BY ALL"


@query(f""" , k AS (SELECT *, {_key_sql('tuple5-sym').replace(' AS proto', '').replace(', proto', '')} FROM pk),
  t AS (SELECT a, a_port, b, b_port, proto FROM k GROUP BY ALL ORDER BY count(*) DESC, a, a_port, b, b_port, proto LIMIT 20)
  SELECT frame_no, a AS k_a, a_port AS k_a_port, b AS k_b, b_port AS k_b_port, proto AS k_proto FROM k SEMI JOIN t USING (a, a_port, b, b_port, proto)""")
def split_topn(spark, sf_dir):
    return reorder.split(packets(spark, sf_dir), "tuple5-sym", 20).select("frame_no", "k_a", "k_a_port", "k_b", "k_b_port", "k_proto")


@query(f""" , k AS (SELECT {_key_sql('tuple5-sym')}, count(*) AS packets FROM pk GROUP BY ALL), t AS (SELECT * FROM k ORDER BY packets DESC, a, a_port, b, b_port, proto LIMIT 20)
  SELECT count(*) AS flows, (SELECT count(*) FROM t) AS selected, (SELECT CAST(sum(packets) AS BIGINT) FROM t) AS written, (SELECT count(*) FROM pk) - (SELECT CAST(sum(packets) AS BIGINT) FROM t) AS skipped,
    (SELECT string_agg(packets, ',' ORDER BY packets DESC) FROM (SELECT packets FROM t LIMIT 10)) AS largest FROM k""")
def split_summary(spark, sf_dir):
    return reorder.split_summary(packets(spark, sf_dir), "tuple5-sym", 20).select("flows", "selected", "written", "skipped", F.array_join(F.col("largest").cast("array<string>"), ",").alias("largest"))


_IP = "concat_ws('.', {0} >> 24 & 255, {0} >> 16 & 255, {0} >> 8 & 255, {0} & 255)"


@query(f" , k AS (SELECT {_key_sql('tuple5-sym')}, count(*) AS packets FROM pk GROUP BY ALL) SELECT {_IP.format('a')} || ':' || a_port || '_' || {_IP.format('b')} || ':' || b_port || '_' || proto || '.pcap' AS file, packets FROM k")
def split_files(spark, sf_dir):
    return reorder.key_counts(packets(spark, sf_dir), "tuple5-sym").select(keys.file_name("tuple5-sym").alias("file"), "packets")


@query(f"""{SHUFFLED} , m AS (SELECT path, frame_no, ts_ns, max({{'t': ts_ns, 'f': frame_no}}) OVER (ORDER BY frame_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS l FROM sh)
  SELECT path, frame_no, ts_ns, l.f AS latest_frame, l.t - ts_ns AS backward_ns FROM m WHERE ts_ns < l.t""")
def misplaced_packets(spark, sf_dir):
    return reorder.misplaced(shuffled(spark, sf_dir))


@query(f"{SHUFFLED} SELECT path, count(*) AS packets, (SELECT count(*) FROM (SELECT ts_ns, max(ts_ns) OVER (ORDER BY frame_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM sh) WHERE ts_ns < m) AS misplaced, false AS ordered FROM sh GROUP BY path")
def reorder_dry_run(spark, sf_dir):
    return reorder.reorder_report(shuffled(spark, sf_dir))


@query(f", sh AS (SELECT * REPLACE (ts_ns + (frame_no * 7919) % 11 * 60000000000 AS ts_ns) FROM fr) SELECT frame_no, ts_ns, sha256(unhex(frame)) AS data_sha256, row_number() OVER (ORDER BY ts_ns, frame_no) AS place FROM sh", FRAMES_SQL)
def reorder_packets(spark, sf_dir):
    """Whole packets, with their bytes."""
    later = F.col("ts_ns") + F.pmod(F.col("frame_no") * 7919, F.lit(11)) * 60_000_000_000
    return reorder.reordered(crafted(spark, sf_dir).withColumn("ts_ns", later)).select("frame_no", "ts_ns", F.sha2("data", 256).alias("data_sha256"), "place")


MERGE_SQL = """ , m AS (SELECT *, arg_min(ts_ns, frame_no) OVER () AS f, arg_max(ts_ns, frame_no) OVER () AS l, sha256(unhex(frame)) AS data_sha256 FROM fr),
  m0 AS (SELECT 0 AS input, r AS repetition, frame_no, c AS copy, ts_ns + 5000000000 + r * (l - f + 1000000000) AS ts_ns, data_sha256 FROM m, range(2) AS t(r), range(1) AS u(c)),
  m1 AS (SELECT 1 AS input, 0 AS repetition, frame_no, c AS copy, ts_ns - f + 1704067200000000000 AS ts_ns, data_sha256 FROM m, range(3) AS u(c))
  SELECT data_sha256, CAST(input AS INTEGER) AS input, CAST(repetition AS INTEGER) AS repetition, frame_no, CAST(copy AS INTEGER) AS copy, ts_ns, row_number() OVER (ORDER BY ts_ns, input, repetition, frame_no, copy) AS place
  FROM (SELECT * FROM m0 UNION ALL SELECT * FROM m1)"""


@query(MERGE_SQL, FRAMES_SQL)
def merge_shift_repeat(spark, sf_dir):
    """Whole packets, with their bytes."""
    p = crafted(spark, sf_dir)
    inputs = [reorder.MergeInput(p, start=5, repeat=2), reorder.MergeInput(p, start=1_704_067_200, erase=True, parallel=3)]
    return reorder.merged(inputs).select(F.sha2("data", 256).alias("data_sha256"), F.col("input").cast("int"), F.col("repetition").cast("int"), "frame_no", F.col("copy").cast("int"), "ts_ns", "place")


def _mapped_sql(c: str) -> str:
    return f"CASE WHEN {c} & 4294967040 = 3232235520 THEN 2886729984 | ({c} & 255) WHEN {c} & 4278190080 = 167772160 THEN 184549376 | ({c} & 16777215) ELSE {c} END"


@query(f" SELECT frame_no, {_mapped_sql('src_ip')} AS src_ip, {_mapped_sql('dst_ip')} AS dst_ip FROM pk")
def merge_ip_map(spark, sf_dir):
    inp = reorder.MergeInput(packets(spark, sf_dir), ips=[("10.0.0.0/8", "11.0.0.0/8"), ("192.168.0.0/24", "172.16.1.0/24")])
    return reorder.merged([inp]).select("frame_no", "src_ip", "dst_ip")


def session_sql(columns: str, timeout: int = 6 * HOUR, activity: int = HOUR) -> str:
    zero = "coalesce({}, 0)"
    return f""" , k AS (SELECT *, CASE WHEN src_ip <= dst_ip THEN src_ip ELSE dst_ip END AS k0 FROM pk),
  g AS (SELECT *, ts_ns - lag(ts_ns) OVER (PARTITION BY k0 ORDER BY frame_no) AS step FROM k),
  s AS (SELECT *, CAST(sum(CASE WHEN step > {timeout} THEN 1 ELSE 0 END) OVER (PARTITION BY k0 ORDER BY frame_no) AS BIGINT) AS session FROM g),
  h AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY k0, session ORDER BY frame_no) > 1 THEN greatest(0, step) END AS gap FROM s),
  i AS (SELECT *, sum(CASE WHEN gap > {activity} THEN 1 ELSE 0 END) OVER (PARTITION BY k0, session ORDER BY frame_no) AS island FROM h),
  w AS (SELECT k0, session, island, count(*) AS n, sum(payload) AS bytes, sum(gap) AS gs, count(gap) AS gn, min(gap) AS gmin, max(gap) AS gmax,
      count(*) FILTER (gap > 1000000000) AS cuts, arg_min(ts_ns, frame_no) AS f, arg_max(ts_ns, frame_no) AS l, min(frame_no) AS pos, max(CASE WHEN gap > {activity} THEN gap END) AS idle
    FROM i GROUP BY ALL),
  v AS (SELECT *, CASE WHEN l > f THEN l - f END AS span FROM w),
  o AS (SELECT k0, session, CAST(sum(n) AS BIGINT) AS packets, CAST(sum(bytes) AS BIGINT) AS bytes, arg_min(f, pos) AS first_ns, arg_max(l, pos) AS last_ns,
      round({zero.format('sum(gs) / sum(gn)')}, 3) AS iat_mean, {zero.format('min(gmin)')} AS iat_min, {zero.format('max(gmax)')} AS iat_max, CAST(sum(cuts) + 1 AS BIGINT) AS subflows,
      round({zero.format('avg(span)')}, 3) AS active_mean, {zero.format('max(span)')} AS active_max, {zero.format('min(span)')} AS active_min,
      round({zero.format('avg(idle)')}, 3) AS idle_mean, {zero.format('max(idle)')} AS idle_max, {zero.format('min(idle)')} AS idle_min, count(idle) AS idle_periods
    FROM v GROUP BY ALL HAVING sum(n) > 1)
  SELECT {columns} FROM o"""


def host_sessions(spark, sf_dir) -> DataFrame:
    key = [F.least("src_ip", "dst_ip")]
    return rounded(sessions.sessions(packets(spark, sf_dir), key, 6 * HOUR, HOUR), 3)


for _name, _cols in {
    "flow_timeout_sessions": "k0, session, packets, bytes, first_ns, last_ns",
    "flow_iat": "k0, session, iat_mean, iat_min, iat_max",
    "flow_subflow": "k0, session, packets, subflows",
    "flow_active_idle": "k0, session, active_mean, active_max, active_min, idle_mean, idle_max, idle_min, idle_periods",
}.items():
    QUERIES[_name] = lambda spark, sf_dir, c=_cols: host_sessions(spark, sf_dir).select(*c.split(", "))
    SQL[_name] = PACKETS_SQL + session_sql(_cols)


# Bytes: packets are crafted from columns, read back by field expressions and compared with the columns.


def layer(offset: int, width: int | None = None):
    return F.substring(F.col("data"), offset + 1, width) if width else fields.rest(F.col("data"), offset)


@query(" SELECT frame_no, '02:00:00:00:00:01' AS src, '02:00:00:00:00:02' AS dst, CAST(2048 AS BIGINT) AS eth_type FROM pk")
def decode_eth(spark, sf_dir):
    from flowlake.functions.net import mac_text

    h = layer(0, 14)
    return crafted(spark, sf_dir).select("frame_no", mac_text(fields.read(h, "Eth.src")).alias("src"), mac_text(fields.read(h, "Eth.dst")).alias("dst"), fields.read(h, "Eth.eth_type").alias("eth_type"))


@query(f""" SELECT frame_no, CAST(4 AS BIGINT) AS version, CAST(5 AS BIGINT) AS ihl, CAST(payload + header_len + 20 AS BIGINT) AS total_length, frame_no % 65536 AS identification,
  CAST(frame_no % 200 + 20 AS BIGINT) AS ttl, proto AS protocol, src_ip AS src, dst_ip AS dst, {_IP.format('src_ip')} AS src_text FROM pk""")
def decode_ipv4(spark, sf_dir):
    h = layer(14, 20)
    names = ("version", "ihl", "total_length", "identification", "ttl", "protocol", "src", "dst")
    return crafted(spark, sf_dir).select("frame_no", *[fields.read(h, f"Ipv4.{n}").alias(n) for n in names], ipv4_text(fields.read(h, "Ipv4.src")).alias("src_text"))


@query(f""" SELECT frame_no, src_port, dst_port, (frame_no * 1000) & 4294967295 AS seq_num, payload AS ack_num, CAST(5 AS BIGINT) AS data_offset, tcp_flags AS flags, CAST(4096 AS BIGINT) AS window_size,
  concat_ws('|', CASE WHEN tcp_flags & 16 > 0 THEN 'ACK' END, CASE WHEN tcp_flags & 8 > 0 THEN 'PSH' END, CASE WHEN tcp_flags & 4 > 0 THEN 'RST' END, CASE WHEN tcp_flags & 2 > 0 THEN 'SYN' END, CASE WHEN tcp_flags & 1 > 0 THEN 'FIN' END) AS flags_text FROM pk WHERE proto = 6""")
def decode_tcp(spark, sf_dir):
    from flowlake.functions.codes import tcp_flags_text

    h = layer(34)
    names = ("src_port", "dst_port", "seq_num", "ack_num", "data_offset", "flags", "window_size")
    return crafted(spark, sf_dir).where("proto = 6").select("frame_no", *[fields.read(h, f"Tcp.{n}").alias(n) for n in names], tcp_flags_text(fields.read(h, "Tcp.flags")).alias("flags_text"))


@query(" SELECT frame_no, src_port, dst_port, CAST(payload + 8 AS BIGINT) AS length FROM pk WHERE proto = 17")
def decode_udp(spark, sf_dir):
    h = layer(34)
    return crafted(spark, sf_dir).where("proto = 17").select("frame_no", *[fields.read(h, f"Udp.{n}").alias(n) for n in ("src_port", "dst_port", "length")])


@query(" SELECT frame_no, CAST(length(frame) // 2 AS BIGINT) AS size, sha256(unhex(frame)) AS data_sha256 FROM fr", FRAMES_SQL)
def crafted_frames(spark, sf_dir):
    """Every byte of the crafted frames."""
    return crafted(spark, sf_dir).select("frame_no", F.length("data").cast("bigint").alias("size"), F.sha2("data", 256).alias("data_sha256"))


@query(" SELECT frame_no, ip_checksum AS checksum, true AS valid FROM fr", FRAMES_SQL)
def ipv4_checksum(spark, sf_dir):
    h = layer(14, 20)
    return crafted(spark, sf_dir).select("frame_no", checksum.ipv4(h).alias("checksum"), checksum.ipv4_valid(h).alias("valid"))


@query(" SELECT frame_no, l4_checksum AS checksum, true AS valid, frame_no % 2 = 0 AS valid_when_damaged FROM fr", FRAMES_SQL)
def transport_checksum(spark, sf_dir):
    """The checksum that the header holds, whether it is valid, and whether it still is with odd frames' first port raised by one."""
    ip, body = layer(14, 20), layer(34)
    ends = (fields.read(ip, "Ipv4.src"), fields.read(ip, "Ipv4.dst"))
    tcp = F.col("proto") == 6
    held = F.when(tcp, fields.read(body, "Tcp.checksum")).otherwise(fields.read(body, "Udp.checksum"))
    valid = lambda x: F.when(tcp, checksum.tcp_valid(*ends, x)).otherwise(checksum.udp_valid(*ends, x))
    damaged = F.concat(fields.to_bytes(fields.u(body, 0, 2) + F.col("frame_no") % 2, 2), fields.rest(body, 2))
    return crafted(spark, sf_dir).select("frame_no", held.alias("checksum"), valid(body).alias("valid"), valid(damaged).alias("valid_when_damaged"))


@query(f" SELECT frame_no, src_ip AS src_ip4, dst_ip AS dst_ip4, {_IP.format('src_ip')} AS src_ip, {_IP.format('dst_ip')} AS dst_ip FROM pk")
def numeric_ip(spark, sf_dir):
    from flowlake.functions.net import ipv4_number

    text = {c: ipv4_text(F.col(c)) for c in ("src_ip", "dst_ip")}
    return packets(spark, sf_dir).select("frame_no", *[ipv4_number(v).alias(f"{c}4") for c, v in text.items()], *[v.alias(c) for c, v in text.items()])


@query(f" SELECT frame_no, CAST(ts_ns // 1000000000 AS VARCHAR) || '.' || lpad(CAST(ts_ns % 1000000000 AS VARCHAR), 9, '0') AS seconds, strftime(make_timestamp(ts_ns // 1000), '%Y-%m-%dT%H:%M:%S') || CASE WHEN ts_ns % 1000000000 = 0 THEN '' ELSE '.' || rtrim(lpad(CAST(ts_ns % 1000000000 AS VARCHAR), 9, '0'), '0') END || 'Z' AS iso FROM pk")
def timestamp_text(spark, sf_dir):
    return packets(spark, sf_dir).select("frame_no", seconds_text(F.col("ts_ns")).alias("seconds"), iso_text(F.col("ts_ns")).alias("iso"))


# Whole tools.


@query()
def flow_full_features(spark, sf_dir):
    from flowlake.operators import flows

    return flows.flow_features(flows.from_ipv4_rows(packets(spark, sf_dir)), 6 * HOUR, HOUR)


#: UDP packets here go to or from port 53, so 12 bytes of payload or more read as DNS.
METADATA_SQL = f""" SELECT frame_no, 'Eth,Ipv4,' || CASE WHEN proto = 6 THEN 'Tcp' ELSE 'Udp' END || CASE WHEN payload = 0 THEN '' WHEN proto = 17 AND payload >= 12 THEN ',Dns' ELSE ',Raw' END AS layers,
    CAST(2048 AS BIGINT) AS eth_type, {_IP.format('src_ip')} AS src_ip, {_IP.format('dst_ip')} AS dst_ip, proto AS ip_proto, CAST(0 AS BIGINT) AS tos, CAST(frame_no % 200 + 20 AS BIGINT) AS ttl, src_port, dst_port,
    CASE WHEN proto = 6 THEN tcp_flags ELSE -1 END AS tcp_flags, CAST(CASE WHEN proto = 6 THEN 4096 ELSE -1 END AS BIGINT) AS tcp_window, CAST(CASE WHEN proto = 6 THEN 5 ELSE -1 END AS BIGINT) AS tcp_data_offset,
    CAST(CASE WHEN proto = 17 THEN payload + 8 ELSE -1 END AS BIGINT) AS udp_length, CAST(payload + header_len + 20 AS BIGINT) AS l3_len, true AS parsed
  FROM pk"""


@query(METADATA_SQL)
def dissect_metadata(spark, sf_dir):
    """The report's columns of every packet, TCP and UDP, and the names of its layers; -1 stands for what a packet doesn't have."""
    from flowlake.functions.net import address_text
    from flowlake.operators import dissect

    rows = dissect.dissect(crafted(spark, sf_dir).select("path", "frame_no", "ts_ns", "orig_len", "data", "link_type"))
    names = F.array_join(F.col("layers.protocol"), ",").alias("layers")
    numbers = [F.coalesce(c, F.lit(-1)).alias(c) for c in ("eth_type", "ip_proto", "tos", "ttl", "src_port", "dst_port", "tcp_flags", "tcp_window", "tcp_data_offset", "udp_length", "l3_len")]
    return dissect.metadata(rows, names).select("frame_no", "layers", *[address_text(F.col(f"{s}_addr")).alias(f"{s}_ip") for s in ("src", "dst")], *numbers, "parsed")


# Queries of their own modules.


def _add_modules() -> None:
    from flowlake.plans import fixtures, flow_sql, wire_queries

    QUERIES["flow_timeout_features"], SQL["flow_timeout_features"] = flow_sql.flow_timeout_features, PACKETS_SQL + flow_sql.FLOW_SQL
    for m in (wire_queries, fixtures):
        QUERIES.update(m.QUERIES)
        SQL.update(m.SQL)


_add_modules()
