"""Flow features that end by timeout alone, and the SQL that gives the same numbers.

The state machine of operators.flows also ends flows by RST and FIN, which depends on where
the flow before ended and has no plain SQL; here the packets' RST, SYN and FIN bits are
cleared, so sessions follow from gaps, and every other rule is the same.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from flowlake.operators import flows
from flowlake.plans.packets import packets

HOUR = 3_600_000_000_000
TIMEOUT, ACTIVITY = 120 * HOUR, 12 * HOUR

# Columns of the features, and what they are in the table f of FLOW_SQL; times are in microseconds.
COLUMNS = {
    "Flow Duration": "greatest(0, last_ns - first_ns) // 1000",
    "Total Fwd Packet": "nf",
    "Total Bwd packets": "nb",
    "Total Length of Fwd Packet": "coalesce(sf, 0)",
    "Total Length of Bwd Packet": "coalesce(sb, 0)",
    "Fwd Packet Length Max": "coalesce(maxf, 0)",
    "Fwd Packet Length Min": "coalesce(minf, 0)",
    "Fwd Packet Length Mean": "coalesce(sf / nf, 0)",
    "Fwd Packet Length Std": "coalesce(stdf, 0)",
    "Bwd Packet Length Max": "coalesce(maxb, 0)",
    "Bwd Packet Length Min": "coalesce(minb, 0)",
    "Bwd Packet Length Mean": "coalesce(sb / nullif(nb, 0), 0)",
    "Bwd Packet Length Std": "coalesce(stdb, 0)",
    "Flow Bytes/s": "CASE WHEN last_ns > first_ns THEN (coalesce(sf, 0) + coalesce(sb, 0)) * 1e9 / (last_ns - first_ns) ELSE 0 END",
    "Flow Packets/s": "CASE WHEN last_ns > first_ns THEN n * 1e9 / (last_ns - first_ns) ELSE 0 END",
    "Flow IAT Mean": "iat_mean",
    "Flow IAT Std": "coalesce(iat_std, 0)",
    "Flow IAT Max": "iat_max",
    "Flow IAT Min": "iat_min",
    "Fwd IAT Total": "coalesce(fiat_sum, 0)",
    "Fwd IAT Mean": "coalesce(fiat_mean, 0)",
    "Fwd IAT Std": "coalesce(fiat_std, 0)",
    "Fwd IAT Max": "coalesce(fiat_max, 0)",
    "Fwd IAT Min": "coalesce(fiat_min, 0)",
    "Bwd IAT Total": "coalesce(biat_sum, 0)",
    "Bwd IAT Mean": "coalesce(biat_mean, 0)",
    "Bwd IAT Std": "coalesce(biat_std, 0)",
    "Bwd IAT Max": "coalesce(biat_max, 0)",
    "Bwd IAT Min": "coalesce(biat_min, 0)",
    "Fwd PSH Flags": "pshf",
    "Bwd PSH Flags": "pshb",
    "Fwd URG Flags": "0",
    "Bwd URG Flags": "0",
    "Fwd Header Length": "coalesce(hf, 0)",
    "Bwd Header Length": "coalesce(hb, 0)",
    "Fwd Packets/s": "CASE WHEN last_ns > first_ns THEN nf * 1e9 / (last_ns - first_ns) ELSE 0 END",
    "Bwd Packets/s": "CASE WHEN last_ns > first_ns THEN nb * 1e9 / (last_ns - first_ns) ELSE 0 END",
    "Packet Length Min": "minp",
    "Packet Length Max": "maxp",
    "Packet Length Mean": "(coalesce(sf, 0) + coalesce(sb, 0)) / n",
    "Packet Length Std": "coalesce(stdp, 0)",
    "Packet Length Variance": "coalesce(varp, 0)",
    "FIN Flag Count": "0",
    "SYN Flag Count": "0",
    "RST Flag Count": "0",
    "PSH Flag Count": "pshf + pshb",
    "ACK Flag Count": "ack",
    "Down/Up Ratio": "nb / nf",
    "Average Packet Size": "(coalesce(sf, 0) + coalesce(sb, 0)) / n",
    "Fwd Segment Size Avg": "coalesce(sf / nf, 0)",
    "Bwd Segment Size Avg": "coalesce(sb / nullif(nb, 0), 0)",
    "Subflow Fwd Packets": "nf / subflows",
    "Subflow Fwd Bytes": "coalesce(sf, 0) / subflows",
    "Subflow Bwd Packets": "nb / subflows",
    "Subflow Bwd Bytes": "coalesce(sb, 0) / subflows",
    "FWD Init Win Bytes": "4096",
    "Bwd Init Win Bytes": "CASE WHEN nb > 0 THEN 4096 ELSE 0 END",
    "Fwd Act Data Pkts": "dataf",
    "Fwd Seg Size Min": "segf",
    "Active Mean": "coalesce(active_mean, 0)",
    "Active Std": "coalesce(active_std, 0)",
    "Active Max": "coalesce(active_max, 0)",
    "Active Min": "coalesce(active_min, 0)",
    "Idle Mean": "coalesce(idle_mean, 0)",
    "Idle Std": "coalesce(idle_std, 0)",
    "Idle Max": "coalesce(idle_max, 0)",
    "Idle Min": "coalesce(idle_min, 0)",
}
#: Microseconds are shown as seconds, so that doubles summed in another order round alike.
TIMES = [c for c in COLUMNS if " IAT " in c or c.startswith(("Active", "Idle"))]


def plain(name: str) -> str:
    return name.lower().replace("/", "_per_").replace(" ", "_")


def _stats(name: str, value: str, when: str = "true") -> str:
    x = f"FILTER ({when})"
    return f"sum({value}) {x} AS {name}_sum, avg({value}) {x} AS {name}_mean, stddev_samp({value}) {x} AS {name}_std, max({value}) {x} AS {name}_max, min({value}) {x} AS {name}_min"


_FIRST = "src_ip < dst_ip OR (src_ip = dst_ip AND src_port <= dst_port)"
FLOW_SQL = f""" , q AS (SELECT *, tcp_flags & 24 AS bits, CASE WHEN {_FIRST} THEN src_ip ELSE dst_ip END AS k0, CASE WHEN {_FIRST} THEN src_port ELSE dst_port END AS k1,
    CASE WHEN {_FIRST} THEN dst_ip ELSE src_ip END AS k2, CASE WHEN {_FIRST} THEN dst_port ELSE src_port END AS k3 FROM pk),
  g AS (SELECT *, ts_ns - lag(ts_ns) OVER (PARTITION BY k0, k1, k2, k3, proto ORDER BY frame_no) AS step FROM q),
  s AS (SELECT *, sum(CASE WHEN step > {TIMEOUT} THEN 1 ELSE 0 END) OVER (PARTITION BY k0, k1, k2, k3, proto ORDER BY frame_no) AS session FROM g),
  h AS (SELECT *, first_value(src_ip) OVER w AS from_ip, first_value(src_port) OVER w AS from_port, ts_ns - lag(ts_ns) OVER w AS gap FROM s WINDOW w AS (PARTITION BY k0, k1, k2, k3, proto, session ORDER BY frame_no)),
  dd AS (SELECT *, src_ip = from_ip AND src_port = from_port AS fwd FROM h),
  d AS (SELECT *, ts_ns - lag(ts_ns) OVER (PARTITION BY k0, k1, k2, k3, proto, session, fwd ORDER BY frame_no) AS back FROM dd),
  i AS (SELECT *, CASE WHEN gap IS NOT NULL THEN greatest(0, gap) / 1000.0 END AS iat, CASE WHEN back IS NOT NULL THEN greatest(0, back) / 1000.0 END AS own,
      sum(CASE WHEN gap > {ACTIVITY} THEN 1 ELSE 0 END) OVER (PARTITION BY k0, k1, k2, k3, proto, session ORDER BY frame_no) AS island FROM d),
  v AS (SELECT k0, k1, k2, k3, proto, session, island, (arg_max(ts_ns, frame_no) - arg_min(ts_ns, frame_no)) / 1000.0 AS span FROM i GROUP BY ALL),
  a AS (SELECT k0, k1, k2, k3, proto, session, {_stats('active', 'span', 'span > 0')} FROM v GROUP BY ALL),
  f0 AS (SELECT k0, k1, k2, k3, proto, session, any_value(from_ip) AS from_ip, any_value(from_port) AS from_port, arg_min(dst_ip, frame_no) AS to_ip, arg_min(dst_port, frame_no) AS to_port, count(*) AS n,
      arg_min(ts_ns, frame_no) AS first_ns, arg_max(ts_ns, frame_no) AS last_ns, count(*) FILTER (fwd) AS nf, count(*) FILTER (NOT fwd) AS nb, sum(payload) FILTER (fwd) AS sf, sum(payload) FILTER (NOT fwd) AS sb,
      max(payload) FILTER (fwd) AS maxf, min(payload) FILTER (fwd) AS minf, max(payload) FILTER (NOT fwd) AS maxb, min(payload) FILTER (NOT fwd) AS minb, max(payload) AS maxp, min(payload) AS minp,
      stddev_samp(payload) FILTER (fwd) AS stdf, stddev_samp(payload) FILTER (NOT fwd) AS stdb, stddev_samp(payload) AS stdp, var_samp(payload) AS varp,
      sum(header_len) FILTER (fwd) AS hf, sum(header_len) FILTER (NOT fwd) AS hb, count(*) FILTER (fwd AND bits & 8 > 0) AS pshf, count(*) FILTER (NOT fwd AND bits & 8 > 0) AS pshb, count(*) FILTER (bits & 16 > 0) AS ack,
      count(*) FILTER (gap > 1000000000) + 1 AS subflows, count(*) FILTER (fwd AND payload > 0) AS dataf, min(header_len) FILTER (fwd) AS segf,
      {_stats('iat', 'iat')}, {_stats('fiat', 'own', 'fwd')}, {_stats('biat', 'own', 'NOT fwd')}, {_stats('idle', 'iat', f'gap > {ACTIVITY}')}
    FROM i GROUP BY ALL HAVING count(*) > 1),
  f AS (SELECT * FROM f0 JOIN a USING (k0, k1, k2, k3, proto, session))
  SELECT concat_ws('-', concat_ws('.', from_ip >> 24 & 255, from_ip >> 16 & 255, from_ip >> 8 & 255, from_ip & 255), concat_ws('.', to_ip >> 24 & 255, to_ip >> 16 & 255, to_ip >> 8 & 255, to_ip & 255), from_port, to_port, proto) AS flow_id,
    first_ns, """ + ", ".join(f"CAST({v} AS BIGINT) AS {plain(c)}" if c in flows.WHOLE else f"round(CAST({v} AS DOUBLE){' / 1000000' if c in TIMES else ''}, 3) AS {plain(c)}" for c, v in COLUMNS.items()) + " FROM f"


def flow_timeout_features(spark, sf_dir):
    rows = packets(spark, sf_dir).withColumn("tcp_flags", F.col("tcp_flags").bitwiseAND(F.lit(24)))
    found = flows.flow_features(flows.from_ipv4_rows(rows), TIMEOUT, ACTIVITY)
    first = F.unix_micros(F.to_timestamp("Timestamp")) * 1000
    number = lambda c: F.col(f"`{c}`") if c in flows.WHOLE else F.round(F.col(f"`{c}`") / (1_000_000 if c in TIMES else 1), 3)
    return found.select(F.col("Flow ID").alias("flow_id"), first.alias("first_ns"), *[number(c).alias(plain(c)) for c in COLUMNS])
