"""Per-packet and per-flow scalar functions."""

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F, types as T

# IP protocol numbers and their names.
PROTOCOL_NAMES = {6: "TCP", 17: "UDP", 1: "ICMP"}

# Well-known ports and the application protocol they stand for.
APP_PORTS = {
    80: "HTTP",
    443: "HTTPS",
    22: "SSH",
    21: "FTP",
    25: "SMTP",
    53: "DNS",
    67: "DHCP",
    68: "DHCP",
    123: "NTP",
}

# TCP flag letters in reporting order, with their header bits.
TCP_FLAG_BITS = [("S", 2), ("A", 16), ("F", 1), ("R", 4), ("P", 8), ("U", 32)]

# Vocabulary positions of transport and application protocols.
PROTO_IDS = {"TCP": 0, "UDP": 1, "ICMP": 2, "OTHER": 3}
APP_PROTO_IDS = {
    "HTTP": 0,
    "HTTPS": 1,
    "SSH": 2,
    "FTP": 3,
    "SMTP": 4,
    "DNS": 5,
    "DHCP": 6,
    "NTP": 7,
    "UNKNOWN": 8,
}


# The functions below build SQL text and parse it once: on the driver that is much
# quicker than composing the same expression call by call.


def _literal_map(values: dict) -> str:
    return "map(" + ", ".join(f"{k!r}, {v!r}" for k, v in values.items()) + ")"


def protocol_name(proto) -> Column:
    return F.expr(f"coalesce({_literal_map(PROTOCOL_NAMES)}[{proto}], 'OTHER')")


def app_protocol(src_port, dst_port, proto) -> Column:
    """Named by port for TCP and UDP; the source end is looked up first."""
    ports = _literal_map(APP_PORTS)
    return F.expr(
        f"CASE WHEN {proto} IN (6, 17) "
        f"THEN coalesce({ports}[{src_port}], {ports}[{dst_port}], 'UNKNOWN') ELSE 'UNKNOWN' END"
    )


def proto_id(name) -> Column:
    return F.expr(f"{_literal_map(PROTO_IDS)}[{name}]")


def app_proto_id(name) -> Column:
    return F.expr(f"{_literal_map(APP_PROTO_IDS)}[{name}]")


def tcp_flag_list(flags) -> Column:
    """The set flags of one packet, in reporting order; empty when not TCP."""
    letters = ", ".join(f"IF({flags} & {bit} <> 0, '{name}', NULL)" for name, bit in TCP_FLAG_BITS)
    return F.expr(f"array_compact(array({letters}))")


def iso_timestamp(ts_us) -> Column:
    """UTC, always with six fraction digits, whatever the session's time zone."""
    in_day = f"pmod({ts_us}, 86400000000)"
    second = f"({in_day} DIV 1000000)"
    return F.expr(
        f"format_string('%sT%02d:%02d:%02d.%06dZ', "
        f"CAST(date_from_unix_date(CAST(({ts_us} - {in_day}) DIV 86400000000 AS INT)) AS STRING), "
        f"{second} DIV 3600, {second} DIV 60 % 60, {second} % 60, {in_day} % 1000000)"
    )


def payload_entropies(payloads) -> np.ndarray:
    """Shannon entropy in bits of each byte string; 0 for a missing or empty one.

    All strings of a batch are counted in one pass over their joined bytes.
    """
    lengths = np.fromiter((len(p) if p else 0 for p in payloads), np.int64, len(payloads))
    out = np.zeros(len(payloads))
    filled = np.flatnonzero(lengths)
    # A row of 256 counters per payload: bound both the rows and the bytes of a step.
    step = np.cumsum(lengths[filled]) // (4 << 20) + np.arange(len(filled)) // 4096
    for part in np.split(filled, np.flatnonzero(np.diff(step)) + 1):
        if not len(part):
            continue
        data = np.frombuffer(b"".join(bytes(payloads[i]) for i in part), np.uint8)
        row = np.repeat(np.arange(len(part)), lengths[part])
        counts = np.bincount(row * 256 + data, minlength=len(part) * 256)
        p = counts.reshape(len(part), 256) / lengths[part][:, None]
        out[part] = -(p * np.log2(p, out=np.zeros_like(p), where=p > 0)).sum(axis=1)
    return out + 0.0


@F.pandas_udf(T.DoubleType())
def payload_entropy(payload: pd.Series) -> pd.Series:
    return pd.Series(payload_entropies(payload.to_numpy(dtype=object)))


def percent(count, total) -> Column:
    return F.coalesce(F.try_divide(count * F.lit(100.0), total), F.lit(0.0))


def bar(pct: Column, width=50) -> Column:
    """One full block for every two percent, padded to `width`."""
    full = F.floor(pct / 2).cast("int")
    return F.concat(F.repeat(F.lit("█"), full), F.repeat(F.lit("░"), F.lit(width) - full))
