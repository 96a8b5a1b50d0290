"""Flows as timed sessions, in window expressions: the part of flow assignment that idle timeouts decide.

A key's packets belong to one session until a gap of more than the timeout (in capture
order).  Features that need every gap are window lags, summed by session.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_sessions(packets: DataFrame, key: list[Column], timeout_ns: int) -> DataFrame:
    """Adds the key's columns k0.., gap (ns since the key's last packet, not below 0; null at first) and session (from 0)."""
    names = [f"k{i}" for i in range(len(key))]
    rows = packets.select("*", *[c.alias(n) for n, c in zip(names, key, strict=True)])
    w = Window.partitionBy("path", *names).orderBy("frame_no")
    rows = rows.withColumn("_step", F.col("ts_ns") - F.lag("ts_ns").over(w))
    new = F.coalesce(F.col("_step") > timeout_ns, F.lit(False)).cast("bigint")
    rows = rows.withColumn("session", F.sum(new).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    inner = Window.partitionBy("path", *names, "session").orderBy("frame_no")
    first = F.row_number().over(inner) == 1
    return rows.withColumn("gap", F.when(~first, F.greatest(F.lit(0), F.col("_step")))).drop("_step")


def sessions(packets: DataFrame, key: list[Column], timeout_ns: int, activity_ns: int, least: int = 2) -> DataFrame:
    """One row for each session of `least` packets or more: counts, bytes, gaps, subflows, activity and idle times."""
    names = [f"k{i}" for i in range(len(key))]
    rows = with_sessions(packets, key, timeout_ns)
    inner = Window.partitionBy("path", *names, "session").orderBy("frame_no")
    idle = F.col("gap") > activity_ns
    rows = rows.withColumn("island", F.sum(F.coalesce(idle, F.lit(False)).cast("bigint")).over(inner.rowsBetween(Window.unboundedPreceding, 0)))
    islands = rows.groupBy("path", *names, "session", "island").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("payload").alias("bytes"),
        F.sum("gap").alias("gap_sum"),
        F.sum(F.col("gap").cast("double") * F.col("gap")).alias("gap_sq"),
        F.min("gap").alias("gap_min"),
        F.max("gap").alias("gap_max"),
        F.count("gap").alias("gaps"),
        F.count_if(F.col("gap") > 1_000_000_000).alias("cuts"),
        F.min_by("ts_ns", "frame_no").alias("first"),
        F.max_by("ts_ns", "frame_no").alias("last"),
        F.min("frame_no").alias("at"),
        F.max(F.when(idle, F.col("gap"))).alias("idle"),
    )
    span = F.when(F.col("last") > F.col("first"), F.col("last") - F.col("first"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    out = islands.groupBy("path", *names, "session").agg(
        F.sum("n").alias("packets"),
        F.sum("bytes").alias("bytes"),
        F.min_by("first", "at").alias("first_ns"),
        F.max_by("last", "at").alias("last_ns"),
        zero(F.sum("gap_sum") / F.sum("gaps")).alias("iat_mean"),
        zero(F.min("gap_min")).alias("iat_min"),
        zero(F.max("gap_max")).alias("iat_max"),
        (F.sum("cuts") + 1).alias("subflows"),
        zero(F.avg(span)).alias("active_mean"),
        zero(F.max(span)).alias("active_max"),
        zero(F.min(span)).alias("active_min"),
        zero(F.avg("idle")).alias("idle_mean"),
        zero(F.max("idle")).alias("idle_max"),
        zero(F.min("idle")).alias("idle_min"),
        F.count("idle").alias("idle_periods"),
    )
    return out.where(F.col("packets") >= least)
