"""Capture summaries: totals, exact distinct counts, top keys and interval statistics.

Input are packet rows (see plans.packets): path, frame_no, ts_ns, orig_len, src_ip, dst_ip,
src_port, dst_port, proto, l3_len, parsed (false where dissection failed or data was empty).
Nulls stand for what a packet doesn't have.  With a column `empty` packets without data are
counted by themselves, and with `error` rows that tell of damage in a capture, which are no packets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlake.operators.keys import summary_key

SECOND = 1_000_000_000


def zero(c: Column, kind: str = "double") -> Column:
    return F.coalesce(c, F.lit(0)).cast(kind)


def ordered(packets: DataFrame, by: str = "path") -> DataFrame:
    """by, ordered: whether no timestamp is below one before it.

    A running maximum needs a group's packets in one task, so it is taken in two steps:
    within ranges of frames, and over the ranges' maxima.
    """
    step = F.floor(F.col("frame_no") / 65_536)
    inside = Window.partitionBy(by, "_range").orderBy("frame_no").rowsBetween(Window.unboundedPreceding, -1)
    rows = packets.select(by, "frame_no", "ts_ns", step.alias("_range")).withColumn("_before", F.max("ts_ns").over(inside))
    ranges = rows.groupBy(by, "_range").agg(F.bool_and(F.coalesce(F.col("ts_ns") >= F.col("_before"), F.lit(True))).alias("_good"), F.min("ts_ns").alias("_low"), F.max("ts_ns").alias("_high"))
    earlier = F.max("_high").over(Window.partitionBy(by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    return ranges.withColumn("_earlier", earlier).groupBy(by).agg(F.bool_and(F.col("_good") & F.coalesce(F.col("_low") >= F.col("_earlier"), F.lit(True))).alias("ordered"))


def totals(packets: DataFrame, by: str = "path") -> DataFrame:
    """One row for each capture, all counts exact."""
    read = F.col("error").isNull() if "error" in packets.columns else F.lit(True)
    parsed = F.col("parsed") & read
    seen = lambda c: F.when(parsed, c)
    size = seen(F.col("orig_len"))
    n, l2 = F.count_if(read), F.sum("orig_len")
    more = [F.count_if(F.col("empty") & read).alias("empty_packets")] if "empty" in packets.columns else []
    more += [F.count_if(~read).alias("read_errors")] if "error" in packets.columns else []
    aggs = packets.groupBy(by).agg(
        n.alias("packets"),
        zero(l2, "bigint").alias("l2_bytes"),
        zero(F.sum(seen(F.col("l3_len"))), "bigint").alias("l3_bytes"),
        F.min("ts_ns").alias("first_ns"),
        F.max("ts_ns").alias("last_ns"),
        zero(F.avg(size)).alias("mean_len"),
        zero(F.stddev_samp(size)).alias("std_len"),
        zero(F.min(size), "bigint").alias("min_len"),
        zero(F.max(size), "bigint").alias("max_len"),
        F.count_if(parsed & (F.col("proto") == 6)).alias("tcp_packets"),
        F.count_if(parsed & (F.col("proto") == 17)).alias("udp_packets"),
        F.count_distinct(seen(F.col("src_ip"))).alias("unique_src_ips"),
        F.count_distinct(seen(F.col("dst_ip"))).alias("unique_dst_ips"),
        F.count_distinct(seen(F.coalesce("src_port", F.lit(0)))).alias("unique_src_ports"),
        F.count_distinct(seen(F.coalesce("dst_port", F.lit(0)))).alias("unique_dst_ports"),
        F.count_distinct(seen(summary_key())).alias("unique_flows"),
        F.count_if(~parsed & read).alias("unparsed"),
        *more,
    )
    seconds = (F.col("last_ns") - F.col("first_ns")) / SECOND
    rate = lambda c: F.when(F.col("seconds") > 0, F.col(c) / F.col("seconds")).otherwise(0.0)
    mean = lambda c: F.when(F.col("packets") > 0, F.col(c) / F.col("packets")).otherwise(0.0)
    return aggs.withColumn("seconds", zero(seconds)).select("*", rate("packets").alias("packets_per_second"), rate("l2_bytes").alias("bytes_per_second"), mean("l2_bytes").alias("avg_l2"), mean("l3_bytes").alias("avg_l3"))


def summary(packets: DataFrame, by: str = "path") -> DataFrame:
    return totals(packets, by).join(ordered(packets, by), by)


KEYS = ("src_ip", "dst_ip", "src_port", "dst_port")


def traffic(packets: DataFrame, by: str = "path") -> DataFrame:
    """by, kind, key, packets, bytes: the traffic of every address and port, in one pass by grouping sets.  Missing ports are 0, missing addresses have no row."""
    rows = packets.where("parsed").select(by, "orig_len", "src_ip", "dst_ip", F.coalesce("src_port", F.lit(0)).cast("bigint").alias("src_port"), F.coalesce("dst_port", F.lit(0)).cast("bigint").alias("dst_port"))
    sets = rows.groupingSets([[F.col(by), F.col(k)] for k in KEYS], F.col(by), *[F.col(k) for k in KEYS]).agg(F.grouping_id().alias("g"), F.count(F.lit(1)).alias("packets"), F.sum("orig_len").alias("bytes"))
    #: The set that keeps the i-th key has every other key's bit.
    bit = {k: 0b1111 ^ (1 << 3 - i) for i, k in enumerate(KEYS)}
    kind = F.coalesce(*[F.when(F.col("g") == bit[k], F.lit(k)) for k in KEYS])
    value = F.coalesce(*[F.when(F.col("g") == bit[k], F.col(k)) for k in KEYS])
    return sets.select(by, kind.alias("kind"), value.alias("key"), "packets", "bytes").where("key is not null")


def top(packets: DataFrame, kind: str, k: int = 10) -> DataFrame:
    """key, packets, bytes: the k keys with most packets, then most bytes, then the smallest."""
    key = F.col(kind) if kind.endswith("_ip") else F.coalesce(F.col(kind), F.lit(0)).cast("bigint")
    rows = packets.where("parsed").groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("packets"), F.sum("orig_len").alias("bytes"))
    return rows.where("key is not null").orderBy(F.desc("packets"), F.desc("bytes"), "key").limit(k)


def intervals(packets: DataFrame, width_ns: int, unique: bool = True) -> DataFrame:
    """Epoch-aligned intervals that have packets: totals of all packets, exact distinct counts of parsed ones."""
    if width_ns < 1:
        raise ValueError("an interval has at least 1 ns")
    start = F.col("ts_ns") - F.pmod(F.col("ts_ns"), F.lit(width_ns))
    own = [F.count(F.lit(1)).alias("total_packets"), F.sum("orig_len").alias("total_l2_bytes")]
    if unique:
        seen = lambda c: F.when(F.col("parsed"), c)
        own += [F.count_distinct(seen(c)).alias(n) for n, c in (("unique_src_ips", F.col("src_ip")), ("unique_dst_ips", F.col("dst_ip")), ("unique_flows", summary_key()))]
    rows = packets.groupBy(start.alias("start_timestamp_ns")).agg(*own)
    seconds = width_ns / SECOND
    return rows.select("start_timestamp_ns", (F.col("start_timestamp_ns") + width_ns).alias("end_timestamp_ns_exclusive"), "total_packets", "total_l2_bytes", (F.col("total_packets") / seconds).alias("packets_per_second"), (F.col("total_l2_bytes") / seconds).alias("bytes_per_second"), *(["unique_src_ips", "unique_dst_ips", "unique_flows"] if unique else []))
