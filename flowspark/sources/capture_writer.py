"""Packet rows as capture files: one file per partition, in arrival order.

Frames are made from the packet columns. A packet shorter than its `pkt_len` is filled up
with zeros; ports and flags of other protocols than TCP and UDP have no place in a frame.
"""

import struct

import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

FORMATS = ("pcap", "pcapng")
WRITTEN = "path string, packets long"
SNAP = 1 << 18


def _address(text):
    return bytes(int(x) for x in text.split(".")) if text else b"\0" * 4


def _network(p):
    """The packet from its IP header on."""
    payload = bytes(p.payload or b"")
    if p.proto == 6:
        payload = struct.pack(
            ">HHIIBBHHH", int(p.src_port or 0), int(p.dst_port or 0), 0, 0, 0x50, int(p.tcp_flags or 0), 0, 0, 0
        ) + payload
    elif p.proto == 17:
        payload = struct.pack(">HHHH", int(p.src_port or 0), int(p.dst_port or 0), 8 + len(payload), 0) + payload
    if p.ip_version == 6:
        return struct.pack(">IHBB", 6 << 28, len(payload) & 0xFFFF, int(p.proto or 59), 64) + b"\0" * 32 + payload
    head = struct.pack(">BBHHHBBH", 0x45, 0, (20 + len(payload)) & 0xFFFF, 0, 0, 64, int(p.proto or 0), 0)
    return head + _address(p.src_ip) + _address(p.dst_ip) + payload


def _ethernet(p):
    return b"\0" * 12 + (b"\x86\xdd" if p.ip_version == 6 else b"\x08\x00") + _network(p)


def _block(kind, body):
    body += b"\0" * (-len(body) % 4)
    size = 12 + len(body)
    return struct.pack("<II", kind, size) + body + struct.pack("<I", size)


def _pcap(packets):
    yield struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, SNAP, 1)
    for p in packets:
        frame = _ethernet(p).ljust(int(p.pkt_len), b"\0")
        yield struct.pack("<IIII", p.ts_us // 1_000_000, p.ts_us % 1_000_000, len(frame), len(frame)) + frame


def _pcapng(packets):
    """Two interfaces by turns: Ethernet in microseconds, bare IP in nanoseconds."""
    yield _block(0x0A0D0D0A, struct.pack("<IHHq", 0x1A2B3C4D, 1, 0, -1))
    yield _block(1, struct.pack("<HHI", 1, 0, SNAP))
    yield _block(1, struct.pack("<HHIHHBBBB", 101, 0, SNAP, 9, 1, 9, 0, 0, 0) + b"\0" * 4)
    for p in packets:
        bare = p.seq % 2
        frame = (_network(p) if bare else _ethernet(p)).ljust(int(p.pkt_len), b"\0")
        ticks = int(p.ts_us) * (1000 if bare else 1)
        head = struct.pack("<IIIII", bare, ticks >> 32, ticks & 0xFFFFFFFF, len(frame), len(frame))
        yield _block(6, head + frame)


def write_captures(packets: DataFrame, path: str, format="pcap", files=4) -> DataFrame:
    """Write below `path` and return (path, packets) of the files. Files are ranges of
    (capture, seq), their names in that order. A task that is repeated writes its file anew."""
    if format not in FORMATS:
        raise ValueError(f"unknown capture format: {format}")
    make = {"pcap": _pcap, "pcapng": _pcapng}[format]
    path = path.rstrip("/")

    def write(batches):
        import pandas as pd

        name = f"{path}/part-{TaskContext.get().partitionId():05d}.{format}"
        if "://" in name:
            fs, place = pafs.FileSystem.from_uri(name)
        else:
            fs, place = pafs.LocalFileSystem(), name.removeprefix("file:")
        fs.create_dir(place.rsplit("/", 1)[0], recursive=True)
        count = 0

        def rows():
            nonlocal count
            for batch in batches:
                for p in batch.astype(object).where(batch.notna(), None).itertuples(index=False):
                    count += 1
                    yield p

        with fs.open_output_stream(place) as out:
            for data in make(rows()):
                out.write(data)
        yield pd.DataFrame({"path": [name], "packets": [count]})

    order = [F.col("capture"), F.col("seq")]
    rows = packets.repartitionByRange(files, *order).sortWithinPartitions(*order)
    written = rows.mapInPandas(write, WRITTEN)
    return packets.sparkSession.createDataFrame(written.collect(), WRITTEN)  # a row per file
