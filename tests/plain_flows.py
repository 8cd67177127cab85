"""A slow, plain Python account of flows, as a second opinion for random packets."""

import math
from statistics import fmean, pstdev

PORTS = {80: "HTTP", 443: "HTTPS", 22: "SSH", 21: "FTP", 25: "SMTP", 53: "DNS", 67: "DHCP",
         68: "DHCP", 123: "NTP"}
BITS = [("S", 2), ("A", 16), ("F", 1), ("R", 4), ("P", 8), ("U", 32)]


def entropy(payload):
    n = len(payload)
    return -sum(c / n * math.log2(c / n) for c in (payload.count(b) for b in set(payload))) if n else 0.0


def flows(rows):
    seen = {}
    for _, seq, ts, version, src, sport, dst, dport, proto, size, flags, payload in sorted(
        rows, key=lambda r: r[1]
    ):
        if version != 4:
            continue
        forward = (src, sport or 0) <= (dst, dport or 0)
        key = (src, sport, dst, dport, proto) if forward else (dst, dport, src, sport, proto)
        seen.setdefault(key, []).append((seq, ts, forward, size, flags, payload))
    out = {}
    for key, packets in seen.items():
        times = [p[1] for p in packets]
        dts = [0.0] + [(b - a) / 1e6 for a, b in zip(times, times[1:])]
        gaps = [d for d in dts if d > 0]
        sizes = [p[3] for p in packets]
        entropies = [entropy(p[5]) for p in packets]
        flags = []
        if key[4] == 6:
            for p in packets:
                flags += [n for n, b in BITS if (p[4] or 0) & b and n not in flags]
        app = "UNKNOWN"
        if key[4] in (6, 17):
            app = PORTS.get(key[1]) or PORTS.get(key[3]) or "UNKNOWN"
        out[key] = {
            "first_seq": packets[0][0],
            "flow_duration": (times[-1] - times[0]) / 1e6,
            "total_bytes": float(sum(sizes)),
            "packet_count": float(len(packets)),
            "mean_pkt_size": fmean(sizes),
            "std_pkt_size": pstdev(sizes),
            "mean_dt": fmean(gaps) if gaps else 0.0,
            "std_dt": pstdev(gaps) if len(gaps) > 1 else 0.0,
            "entropy_mean": fmean(entropies),
            "entropy_std": pstdev(entropies),
            "byte_ratio": sum(p[3] for p in packets if p[2]) / sum(sizes) if sum(sizes) else 0.0,
            "flags_summary": "_".join(flags) or "NONE",
            "app_proto": app,
            "temporal": {
                "dt": dts,
                "pkt_size": [float(s) for s in sizes],
                "direction": [1.0 if p[2] else -1.0 for p in packets],
                "entropy": entropies,
            },
        }
    return out
