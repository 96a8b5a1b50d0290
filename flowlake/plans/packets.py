"""The `events` table read as a packet stream.

Every event is a packet between a client (by user) and one of seven servers; types pick the
server's port, and every third packet goes back.  The same arithmetic stands in PACKETS_SQL
for engines that read the table with SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PORTS = {"view": 80, "click": 443, "purchase": 8080, "signup": 22}

PACKETS_SQL = """
WITH e AS (
  SELECT event_id AS frame_no, epoch_us(ts) * 1000 AS ts_ns, event_id % 3 = 2 AS back,
    167772160 + user_id AS client, 3232235520 + event_id % 7 AS server, 1024 + user_id AS cport,
    CASE event_type WHEN 'view' THEN 80 WHEN 'click' THEN 443 WHEN 'purchase' THEN 8080 WHEN 'signup' THEN 22 ELSE 53 END AS sport,
    CASE WHEN event_type = 'error' THEN 17 ELSE 6 END AS proto,
    CAST(floor(value) AS BIGINT) AS payload,
    CASE event_id % 16 WHEN 0 THEN 2 WHEN 14 THEN 17 WHEN 15 THEN 4 ELSE CASE WHEN value > 250 THEN 24 ELSE 16 END END AS flags
  FROM events),
pk AS (
  SELECT 'events' AS path, frame_no, ts_ns, payload, payload + CASE WHEN proto = 6 THEN 54 ELSE 42 END AS orig_len,
    CASE WHEN back THEN server ELSE client END AS src_ip, CASE WHEN back THEN client ELSE server END AS dst_ip,
    CAST(CASE WHEN back THEN sport ELSE cport END AS BIGINT) AS src_port, CAST(CASE WHEN back THEN cport ELSE sport END AS BIGINT) AS dst_port,
    CAST(proto AS BIGINT) AS proto, payload + CASE WHEN proto = 6 THEN 40 ELSE 28 END AS l3_len,
    CAST(CASE WHEN proto = 6 THEN flags ELSE 0 END AS BIGINT) AS tcp_flags, CASE WHEN proto = 6 THEN 20 ELSE 8 END AS header_len
  FROM e)
"""


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, frame_no, ts_ns, payload, orig_len, src_ip, dst_ip, src_port, dst_port, proto, l3_len, tcp_flags, header_len, parsed."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    back = F.col("event_id") % 3 == 2
    client, server = 167772160 + F.col("user_id"), 3232235520 + F.col("event_id") % 7
    cport = 1024 + F.col("user_id")
    sport = F.coalesce(*[F.when(F.col("event_type") == k, F.lit(v)) for k, v in PORTS.items()], F.lit(53)).cast("bigint")
    udp = F.col("event_type") == "error"
    proto = F.when(udp, 17).otherwise(6).cast("bigint")
    payload = F.floor("value").cast("bigint")
    turn = F.col("event_id") % 16
    flags = F.when(turn == 0, 2).when(turn == 14, 17).when(turn == 15, 4).when(F.col("value") > 250, 24).otherwise(16)

    def either(a: Column, b: Column) -> Column:
        return F.when(back, b).otherwise(a)

    return e.select(
        F.lit("events").alias("path"),
        F.col("event_id").alias("frame_no"),
        (F.unix_micros(F.col("ts").cast("timestamp")) * 1000).alias("ts_ns"),
        payload.alias("payload"),
        (payload + F.when(udp, 42).otherwise(54)).alias("orig_len"),
        either(client, server).alias("src_ip"),
        either(server, client).alias("dst_ip"),
        either(cport, sport).alias("src_port"),
        either(sport, cport).alias("dst_port"),
        proto.alias("proto"),
        (payload + F.when(udp, 28).otherwise(40)).alias("l3_len"),
        F.when(udp, 0).otherwise(flags).cast("bigint").alias("tcp_flags"),
        F.when(udp, 8).otherwise(20).cast("int").alias("header_len"),
        F.lit(True).alias("parsed"),
    )


def crafted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packets with their frames."""
    return frames(packets(spark, sf_dir))


def frames(rows: DataFrame) -> DataFrame:
    """Packet rows with `data`, Ethernet frames of these packets with whole payloads, and link_type.

    A payload is the frame's number in eight digits, cut or filled with dots to its length.
    """
    from flowlake.operators.craft import eth, ipv4, raw, tcp, udp

    body = F.encode(F.rpad(F.lpad(F.col("frame_no").cast("string"), 8, "0"), F.col("payload").cast("int"), F.lit(".")), "utf-8")
    ip = ipv4(src=F.col("src_ip"), dst=F.col("dst_ip"), ttl=F.col("frame_no") % 200 + 20, identification=F.col("frame_no") % 65536)
    ends = {"src_port": F.col("src_port"), "dst_port": F.col("dst_port")}
    link = eth(src=bytes.fromhex("020000000001"), dst=bytes.fromhex("020000000002"))
    over = {6: tcp(**ends, seq=F.col("frame_no") * 1000, ack=F.col("payload"), flags=F.col("tcp_flags"), window=4096), 17: udp(**ends)}
    data = F.when(F.col("proto") == 6, (link / ip / over[6] / raw(body)).build()).otherwise((link / ip / over[17] / raw(body)).build())
    return rows.select("*", data.alias("data"), F.lit(1).alias("link_type"))


def hexed(value: str, digits: int) -> str:
    """SQL for an integer as hexadecimal digits."""
    return f"lpad(to_hex(CAST({value} AS BIGINT)), {digits}, '0')"


def folded(value: str) -> str:
    """SQL for the ones' complement of a sum of 16-bit words."""
    once = lambda x: f"(({x} >> 16) + ({x} & 65535))"
    return f"(65535 - {once(once(once(value)))})"


_IP_WORDS = "(17664 + total + ident + (ttl << 8) + proto + (src_ip >> 16) + (src_ip & 65535) + (dst_ip >> 16) + (dst_ip & 65535))"
_L4_WORDS = """((src_ip >> 16) + (src_ip & 65535) + (dst_ip >> 16) + (dst_ip & 65535) + proto + segment + src_port + dst_port
  + CASE WHEN proto = 6 THEN (seq >> 16) + (seq & 65535) + payload + 20480 + tcp_flags + 4096 ELSE segment END
  + coalesce(list_sum(list_transform(range(0, least(8, payload)), lambda i: ascii(body[i + 1]) * CASE WHEN i % 2 = 0 THEN 256 ELSE 1 END)), 0)
  + CASE WHEN payload > 8 THEN 46 * 256 * ((payload - 7) // 2) + 46 * ((payload - 8) // 2) ELSE 0 END)"""

#: PACKETS_SQL with the frames' bytes as hexadecimal digits (table fr): the layouts of Ethernet, IPv4, TCP and UDP and the checksums' arithmetic, written out.
FRAMES_SQL = (
    PACKETS_SQL
    + f""", b AS (SELECT *, payload + header_len + 20 AS total, payload + header_len AS segment, frame_no % 65536 AS ident, frame_no % 200 + 20 AS ttl, (frame_no * 1000) & 4294967295 AS seq,
    rpad(lpad(CAST(frame_no AS VARCHAR), 8, '0'), CAST(payload AS INTEGER), '.') AS body FROM pk),
w AS (SELECT *, CAST({_IP_WORDS} AS BIGINT) AS ip_words, CAST({_L4_WORDS} AS BIGINT) AS l4_words FROM b),
x AS (SELECT *, CAST({folded('ip_words')} AS BIGINT) AS ip_checksum, CAST({folded('l4_words')} AS BIGINT) AS l4_value FROM w),
y AS (SELECT *, CASE WHEN proto = 17 AND l4_value = 0 THEN 65535 ELSE l4_value END AS l4_checksum FROM x),
fr AS (SELECT *, '0200000000020200000000010800' || '4500' || {hexed('total', 4)} || {hexed('ident', 4)} || '0000' || {hexed('ttl', 2)} || {hexed('proto', 2)} || {hexed('ip_checksum', 4)} || {hexed('src_ip', 8)} || {hexed('dst_ip', 8)}
  || {hexed('src_port', 4)} || {hexed('dst_port', 4)} || CASE WHEN proto = 6 THEN {hexed('seq', 8)} || {hexed('payload', 8)} || '50' || {hexed('tcp_flags', 2)} || '1000' || {hexed('l4_checksum', 4)} || '0000' ELSE {hexed('segment', 4)} || {hexed('l4_checksum', 4)} END
  || hex(body) AS frame FROM y)
"""
)
