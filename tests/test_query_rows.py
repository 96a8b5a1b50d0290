"""Queries without SQL against brute force over the rows of PACKETS_SQL."""

from collections import defaultdict

import duckdb
import pytest

from flowlake import registry
from flowlake.plans.packets import PACKETS_SQL

HOUR = 3_600_000_000_000
FIN, SYN, RST, PSH, ACK = 1, 2, 4, 8, 16


def packet_rows(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{sf_dir}/events.parquet'")
    found = con.execute(f"{PACKETS_SQL} SELECT * FROM pk ORDER BY frame_no")
    names = [c[0] for c in found.description]
    return [dict(zip(names, r, strict=True)) for r in found.fetchall()]


def text(ip):
    return ".".join(str(ip >> s & 255) for s in (24, 16, 8, 0))


def flow_table(rows, timeout=6 * HOUR):
    """A row for each flow of two packets or more, by all packets of each 5-tuple in capture order."""
    keys = defaultdict(list)
    for p in rows:
        a, b = (p["src_ip"], p["src_port"]), (p["dst_ip"], p["dst_port"])
        keys[min(a, b), max(a, b), p["proto"]].append(p)
    flows = []
    for of_key in keys.values():
        now, fins = [], set()
        for p in of_key:
            if now and p["ts_ns"] - now[-1]["ts_ns"] > timeout:
                flows.append((now, p["frame_no"]))
                now, fins = [], set()
            now.append(p)
            if p["tcp_flags"] & FIN:
                fins.add(p["src_ip"])
            if len(now) > 1 and (p["tcp_flags"] & RST or len(fins) == 2):
                flows.append((now, p["frame_no"]))
                now, fins = [], set()
        flows.append((now, None))
    out = []
    for ps, closed in flows:
        if len(ps) < 2:
            continue
        f = ps[0]
        fwd, bwd = [p for p in ps if p["src_ip"] == f["src_ip"]], [p for p in ps if p["src_ip"] != f["src_ip"]]
        ends = (text(f["src_ip"]), text(f["dst_ip"]), f["src_port"], f["dst_port"], f["proto"])
        out.append((closed, "-".join(map(str, ends)), *ends, max(0, ps[-1]["ts_ns"] - f["ts_ns"]) // 1000, len(fwd), len(bwd), *[float(sum(p["payload"] for p in x)) for x in (fwd, bwd)], *[sum(p["header_len"] for p in x) for x in (fwd, bwd)], *[sum(bool(p["tcp_flags"] & b) for p in ps) for b in (FIN, SYN, RST, PSH, ACK)]))
    return out


FLOW_COLUMNS = "closed_at,Flow ID,Src IP,Dst IP,Src Port,Dst Port,Protocol,Flow Duration,Total Fwd Packet,Total Bwd packets,Total Length of Fwd Packet,Total Length of Bwd Packet,Fwd Header Length,Bwd Header Length,FIN Flag Count,SYN Flag Count,RST Flag Count,PSH Flag Count,ACK Flag Count".split(",")


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_flows_of_real_ports(spark, size):
    sf_dir = f"/root/testdata/{size}"
    got = registry.QUERIES["flow_full_features"](spark, sf_dir).select(*[f"`{c}`" for c in FLOW_COLUMNS]).collect()
    want = flow_table(packet_rows(sf_dir))
    assert want and sorted(map(tuple, got), key=str) == sorted(want, key=str)
