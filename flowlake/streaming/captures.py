"""Structured Streaming variants: interval statistics with a watermark, and flows kept in state.

The packet stream comes from `readStream.format("capture")` or any stream with the packet
columns.  Times are in ns; the event-time column is their microseconds.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from flowlake.operators import flows
from flowlake.operators.keys import summary_key
from flowlake.operators.summary import SECOND


def with_event_time(packets: DataFrame, late: str = "1 minute") -> DataFrame:
    return packets.withColumn("event_time", F.timestamp_micros(F.expr("(ts_ns - pmod(ts_ns, 1000)) div 1000"))).withWatermark("event_time", late)


def interval_stream(packets: DataFrame, width_us: int, late: str = "1 minute", unique: bool = False) -> DataFrame:
    """Tumbling intervals of a whole number of microseconds: packets and bytes, emitted once the watermark has passed (append mode).

    unique: also exact distinct counts of parsed packets, by a count for each interval and key
    that is counted again; the state is one row for each interval and key.
    """
    every = with_event_time(packets, late)
    window = F.window("event_time", f"{width_us} microseconds")
    distinct = ("src_ip", "dst_ip", "flow")
    if unique:
        #: Keys are the flow's five parts, which cost less to make and to keep than one text; an address alone is the first of them.
        flow, parsed = summary_key(), F.col("parsed")
        parts = ("a", "a_port", "b", "b_port", "proto")
        seen = lambda kind, values: F.struct(F.lit(kind).alias("kind"), *[F.when(parsed, v).alias(n) for n, v in zip(parts, values, strict=True)])
        alone = lambda address: [F.col(address), *[F.when(F.lit(False), flow[n]) for n in parts[1:]]]
        keys = [seen(0, alone("src_ip")), seen(1, alone("dst_ip")), seen(2, [flow[n] for n in parts])]
        rows = every.select("event_time", "orig_len", F.explode(F.array(*keys)).alias("k")).groupBy(window, "k.kind", *[f"k.{n}" for n in parts]).agg(F.count(F.lit(1)).alias("packets"), F.sum("orig_len").alias("bytes"))
        first = F.col("kind") == 0
        counts = [F.count_if((F.col("kind") == i) & F.col("a").isNotNull()).alias(f"unique_{k}s") for i, k in enumerate(distinct)]
        rows = rows.groupBy(F.window(F.window_time("window"), f"{width_us} microseconds").alias("window")).agg(F.sum(F.when(first, F.col("packets"))).alias("total_packets"), F.sum(F.when(first, F.col("bytes"))).alias("total_l2_bytes"), *counts)
    else:
        rows = every.groupBy(window).agg(F.count(F.lit(1)).alias("total_packets"), F.sum("orig_len").alias("total_l2_bytes"))
    seconds = width_us / 1_000_000
    start = F.unix_micros("window.start") * 1000
    return rows.select(start.alias("start_timestamp_ns"), (start + width_us * 1000).alias("end_timestamp_ns_exclusive"), "total_packets", "total_l2_bytes", (F.col("total_packets") / seconds).alias("packets_per_second"), (F.col("total_l2_bytes") / seconds).alias("bytes_per_second"), *([f"unique_{k}s" for k in distinct] if unique else []))


def flow_stream(packets: DataFrame, timeout_ns: int = 120 * SECOND, activity_ns: int = 5 * SECOND, late: str = "1 minute") -> DataFrame:
    """Feature rows (operators.flows.ROW_DDL) of flows as they end: by RST or FINs, by a later packet, or when the watermark has passed the idle timeout.

    State is one open flow of running sums for each key.
    """
    keyed = with_event_time(packets, late).select(*flows.PACKET, "event_time", *flows.key_columns())
    names = ["path", *[f"_k{i}" for i in range(5)]]
    columns = [f.name for f in flows.ROW]

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        machine = flows.Machine(timeout_ns, activity_ns)
        machine.open = pickle.loads(state.get[0]) if state.exists else None
        done: list[dict] = []
        if state.hasTimedOut:
            done = [flows.row_of(f, None) for f in machine.end()]
            state.remove()
        else:
            rows = [r for f in frames for r in f.to_dict("records")]
            for p in sorted(rows, key=lambda r: r["frame_no"]):
                done += [flows.row_of(f, p["frame_no"]) for f in machine.add(p)]
            if machine.open is None:
                if state.exists:
                    state.remove()
            else:
                state.update((pickle.dumps(machine.open),))
                at = (machine.open.last + timeout_ns) // 1_000_000 + 1
                state.setTimeoutTimestamp(max(at, state.getCurrentWatermarkMs() + 1))
        if done:
            yield pd.DataFrame(done, columns=columns)

    return keyed.groupBy(*names).applyInPandasWithState(step, flows.ROW_DDL, "open binary", "append", GroupStateTimeout.EventTimeTimeout)
