"""Capture files (pcap and pcapng, plain or gzipped) as packet rows, read in parallel inside
a file.

A capture file is a chain of records, each header giving the length to the next, with no
marks to enter it in the middle. A large file is cut into byte ranges; each task guesses
the first record of its range from a run of plausible headers and follows the chain to
the end of the range. Where the chain before arrives at another place, the guess was
wrong and the range is followed again from there, so the result is exact. What a pcapng
file says of its sections and interfaces goes on to the ranges behind. A gzipped file has
no ranges: one task reads it as a stream.
"""

import numpy as np
import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from flowspark.schema import PACKET
from flowspark.session import cut
from flowspark.sources import pcapng

SPLIT_BYTES = 128 << 20
READ_BYTES = 4 << 20
GLOBAL_HEADER = 24
RECORD_HEADER = 16
MAX_RECORD = 1 << 18
RUN = 32

# Magic number as read little-endian -> (byte order, fractions per second).
MAGICS = {
    0xA1B2C3D4: ("<", 1_000_000),
    0xD4C3B2A1: (">", 1_000_000),
    0xA1B23C4D: ("<", 1_000_000_000),
    0x4D3CB2A1: (">", 1_000_000_000),
}

# Link types whose packets start with Ethernet, directly with IP, with a
# cooked header (protocol at, header length), or with an address family.
LINK_ETHERNET = 1
LINK_RAW = (12, 14, 101, 228, 229)
LINK_COOKED = {113: (14, 16), 276: (0, 20)}
LINK_FAMILY = (0, 108)
FAMILY_IPV4, FAMILIES_IPV6 = 2, (10, 24, 28, 30)
ETHERTYPE_IPV4, ETHERTYPE_IPV6 = 0x0800, 0x86DD
VLAN_TAGS = (0x8100, 0x88A8, 0x9100)
ETHERTYPE_PPPOE, PPP_IPV4, PPP_IPV6 = 0x8864, 0x0021, 0x0057
ETHERTYPE_MPLS = (0x8847, 0x8848)
TAGS = 8
GZIP = b"\x1f\x8b"
# An entry of a range: guess it, or begin with the file.
GUESS, BEGIN = -1, -2


def _open(path):
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    if "://" in path:
        fs, location = pafs.FileSystem.from_uri(path)
    else:
        fs, location = pafs.LocalFileSystem(), path
    source = fs.open_input_file(location)
    if source.read(2) == GZIP:
        source.close()
        return _Unzipped(fs.open_input_stream(location, compression="gzip"))
    source.seek(0)
    return source


class _Unzipped:
    """A stream that is read once from begin to end; what has been read last is kept, so that
    a record that was cut off by a read can be read again."""

    def __init__(self, stream):
        self.stream, self.at, self.begin, self.held = stream, 0, 0, b""

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.stream.close()

    def seek(self, at):
        self.at = at

    def read(self, n):
        self.held, self.begin = self.held[self.at - self.begin :], self.at
        parts, have = [self.held], len(self.held)
        while have < n:
            more = self.stream.read(n - have)
            if not more:
                break
            parts.append(more)
            have += len(more)
        self.held = b"".join(parts)
        data = self.held[:n]
        self.at += len(data)
        return data


def _size(source, length):
    """Bytes of a file as it is read; a gzipped one ends where it ends."""
    return 1 << 62 if isinstance(source, _Unzipped) else length


def _format(source, path):
    head = source.read(GLOBAL_HEADER)
    source.seek(0)
    return _Blocks() if head[:4] == b"\x0a\x0d\x0d\x0a" else _Format(head, path)


class _Blocks:
    """A pcapng file."""

    first = 0

    def __init__(self):
        self.state, self.met = pcapng.State(), []

    def after(self, blocks):
        """Knows the section and interface blocks before a range."""
        self.state = pcapng.State(blocks)

    def guess(self, source, start, end, size):
        return pcapng.guess(source, start, end, size)

    def packets(self, source, start, end, size):
        for data, at, found in pcapng.follow(source, start, end, size, self.state, self.met):
            if data is None:
                yield None, at, None
            else:
                columns = np.array(found, np.int64).reshape(-1, 4).T
                yield data, at, list(columns)


class _Format:
    """What the global header of a pcap file says."""

    first, met = GLOBAL_HEADER, ()

    def __init__(self, head: bytes, path: str):
        magic = int.from_bytes(head[:4], "little")
        if len(head) < GLOBAL_HEADER or magic not in MAGICS:
            raise ValueError(f"not a pcap file: {path}")
        self.order, self.fractions = MAGICS[magic]
        self.link = int.from_bytes(head[20:24], "little" if self.order == "<" else "big") & 0xFFFF
        self.u32 = np.dtype(f"{self.order}u4")

    def after(self, blocks):
        pass

    def guess(self, source, start, end, size):
        return _guess(source, start, end, size, self)

    def packets(self, source, start, end, size):
        """(bytes, their offset, (frame, bytes kept, microseconds, link) of the records)."""
        per_us = self.fractions // 1_000_000
        for data, at, found in _records(source, start, end, size, self):
            if data is None:
                yield None, at, None
                continue
            raw = np.frombuffer(data, np.uint8)
            seconds, fraction, kept = (_words(raw, found + k, self) for k in (0, 4, 8))
            link = np.full(len(found), self.link)
            yield data, at, [found + RECORD_HEADER, kept, seconds * 1_000_000 + fraction // per_us, link]


def _words(buffer, offsets, fmt):
    """32-bit words at any byte offsets of a byte array."""
    at = np.asarray(offsets)[:, None] + np.arange(4)
    return np.ascontiguousarray(buffer[at]).view(fmt.u32)[:, 0].astype(np.int64)


def _records(source, start, end, size, fmt):
    """Follow the chain from `start`; yields (bytes, their offset, record offsets) until
    a record begins at or after `end`, then the offset of that record."""
    at, want = start, READ_BYTES
    order = "little" if fmt.order == "<" else "big"
    while at < end and at + RECORD_HEADER <= size:
        source.seek(at)
        data = source.read(min(want, size - at))
        place, found = 0, []
        while at + place < end and place + RECORD_HEADER <= len(data):
            length = int.from_bytes(data[place + 8 : place + 12], order)
            if length > MAX_RECORD:
                raise ValueError(f"capture record of {length} bytes at offset {at + place}")
            after = place + RECORD_HEADER + length
            if after > len(data) and at + len(data) < size and len(data) == min(want, size - at):
                break
            found.append(place)
            place = after
        if not found and len(data) < min(want, size - at):
            break  # an unzipped file that ends inside a header
        if not found:
            want *= 2  # one record larger than the read
            continue
        yield data, at, np.array(found, np.int64)
        at += place
    yield None, max(at, start), None


def _guess(source, start, end, size, fmt):
    """The first offset in [start, end) that begins a run of plausible headers."""
    reach = RUN * 2048
    for base in range(start, end, READ_BYTES):
        source.seek(base)
        data = source.read(min(READ_BYTES + reach + MAX_RECORD, size - base))
        raw = np.frombuffer(data, np.uint8)
        places = np.arange(min(READ_BYTES, end - base, max(0, len(raw) - RECORD_HEADER + 1)))
        if not len(places):
            return end
        fraction, kept, whole = (_words(raw, places + k, fmt) for k in (4, 8, 12))
        good = (fraction < fmt.fractions) & (kept > 0) & (kept <= MAX_RECORD) & (kept <= whole)
        good &= whole <= 4 * MAX_RECORD
        order = "little" if fmt.order == "<" else "big"
        for place in np.flatnonzero(good):
            at, run = int(place), 0
            while run < RUN and at + RECORD_HEADER <= len(data):
                f, k, w = (int.from_bytes(data[at + j : at + j + 4], order) for j in (4, 8, 12))
                if not (f < fmt.fractions and 0 < k <= MAX_RECORD and k <= w):
                    break
                at += RECORD_HEADER + k
                run += 1
            if run == RUN or base + at == size:
                return base + int(place)
    return end


def _follow(batches):
    """(path, length, start, stop, entry) -> entry, next record after the range, count.

    Entry GUESS asks for a guess, BEGIN for the first record of the file; an entry at or after
    `stop` means no record begins here. `met` has the blocks that later ranges must know.
    """
    for pdf in batches:
        out = []
        for row in pdf.itertuples(index=False):
            entry, after, count = row.entry, row.entry, 0
            with _open(row.path) as source:
                fmt, size = _format(source, row.path), _size(source, row.length)
                if entry == BEGIN:
                    entry = fmt.first
                elif entry == GUESS and size == row.length:
                    entry = fmt.guess(source, row.start, row.stop, size)
                elif entry == GUESS:
                    entry = size  # the first range reads a gzipped file to its end
                after = entry
                stop = row.stop if size == row.length else size
                if entry < stop:
                    for data, at, found in fmt.packets(source, entry, stop, size):
                        if data is None:
                            after = at
                        else:
                            count += len(found[0])
                if stop == size and size != row.length:
                    after = size
            out.append((row.path, row.length, row.start, row.stop, entry, after, count, list(fmt.met)))
        yield pd.DataFrame(
            out, columns=["path", "length", "start", "stop", "entry", "after", "records", "met"]
        )


RANGES = (
    "path string, length long, start long, stop long, entry long, after long, records long, "
    "met array<binary>"
)


def _located(files: DataFrame, split_bytes) -> DataFrame:
    """Byte ranges of all files with the exact first record of each."""
    step = F.lit(split_bytes).cast("long")
    ranges = files.where(F.col("length") > GLOBAL_HEADER).select(
        "path",
        "length",
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, step)).alias("start"),
    )
    ranges = ranges.select(
        "path",
        "length",
        "start",
        F.least(F.col("start") + step, F.col("length")).alias("stop"),
        F.when(F.col("start") == 0, F.lit(BEGIN)).otherwise(GUESS).cast("long").alias("entry"),
    )
    tasks = max(1, min(ranges.count(), 20_000))
    order = Window.partitionBy("path").orderBy("start")
    known = cut(ranges.repartition(tasks, "path", "start").mapInPandas(_follow, RANGES))
    while True:
        expected = F.coalesce(F.lag("after").over(order), F.col("entry"))
        checked = known.withColumn("_from", expected)
        inside = F.col("_from") < F.col("stop")
        wrong = F.when(inside, F.col("entry") != F.col("_from")).otherwise(
            (F.col("records") > 0) | (F.col("after") != F.col("_from"))
        )
        checked = checked.withColumn("_wrong", wrong & (F.col("start") > 0))
        if checked.where("_wrong").isEmpty():
            return known
        again = checked.where("_wrong").select(
            "path", "length", "start", "stop", F.col("_from").alias("entry")
        )
        again = again.repartition("path", "start").mapInPandas(_follow, RANGES)
        known = cut(checked.where("not _wrong").select(*known.columns).unionByName(again))


def _ethernet(frame, byte, pair):
    """(version, begin of IP) of Ethernet frames: behind VLAN tags, PPPoE sessions and MPLS
    labels, too."""
    at = frame + 12
    for _ in range(TAGS):
        at = np.where(np.isin(pair(at), VLAN_TAGS), at + 4, at)
    kind, ip = pair(at), at + 2
    inner = pair(ip + 6)
    pppoe = kind == ETHERTYPE_PPPOE
    version = np.select([kind == ETHERTYPE_IPV4, kind == ETHERTYPE_IPV6, pppoe & (inner == PPP_IPV4),
                         pppoe & (inner == PPP_IPV6)], [4, 6, 4, 6], 0)
    ip = np.where(pppoe, ip + 8, ip)
    mpls = np.isin(kind, ETHERTYPE_MPLS)
    open_stack = mpls
    for _ in range(TAGS):
        last = (byte(ip + 2) & 1) == 1
        ip = np.where(open_stack, ip + 4, ip)
        open_stack = open_stack & ~last
    nibble = byte(ip) >> 4
    version = np.where(mpls & ~open_stack & np.isin(nibble, (4, 6)), nibble, version)
    return version, ip


def _packet_frame(data, frame, kept, ts_us, links, path, first):
    """The records of one read as packet rows; header fields are taken column-wise."""
    raw = np.frombuffer(data, np.uint8)
    padded = np.concatenate([raw, np.zeros(64, np.uint8)])
    last = len(padded) - 1
    stop = np.minimum(frame + kept, len(raw))

    def byte(where):
        return padded[np.minimum(where, last)].astype(np.int64)

    def pair(where):
        return byte(where) * 256 + byte(where + 1)

    n = len(frame)
    version, ip = np.zeros(n, np.int64), frame.copy()
    for link in np.unique(links).tolist():
        own = links == link
        at = frame[own]
        if link == LINK_ETHERNET:
            version[own], ip[own] = _ethernet(at, byte, pair)
        elif link in LINK_RAW:
            nibble = byte(at) >> 4
            version[own] = np.where(np.isin(nibble, (4, 6)), nibble, 0)
        elif link in LINK_COOKED:
            kind_at, header = LINK_COOKED[link]
            kind = pair(at + kind_at)
            version[own] = np.select([kind == ETHERTYPE_IPV4, kind == ETHERTYPE_IPV6], [4, 6], 0)
            ip[own] = at + header
        elif link in LINK_FAMILY:
            # In the byte order of the machine that wrote it: one of the ends holds the family.
            family = np.maximum(byte(at), byte(at + 3))
            version[own] = np.select([family == FAMILY_IPV4, np.isin(family, FAMILIES_IPV6)], [4, 6], 0)
            ip[own] = at + 4
        else:
            raise ValueError(f"unsupported link type {link} in {path}")
    version[(version == 4) & (ip + 20 > stop)] = 0
    v4 = version == 4

    l4 = np.minimum(ip + (byte(ip) & 15) * 4, stop)
    proto = byte(ip + 9)
    whole = (pair(ip + 6) & 0x1FFF) == 0
    tcp = v4 & (proto == 6) & whole & (l4 + 20 <= stop)
    udp = v4 & (proto == 17) & whole & (l4 + 8 <= stop)
    ports = tcp | udp

    def nullable(values, present):
        return pd.array(np.where(present, values, 0), dtype="Int32").copy(), ~present

    def column(values, present):
        array, missing = nullable(values, present)
        array[missing] = pd.NA
        return array

    def address(where):
        parts = np.stack([byte(where + k) for k in range(4)], axis=1)
        return [".".join(map(str, p)) if ok else None for p, ok in zip(parts.tolist(), v4)]

    return pd.DataFrame(
        {
            "capture": path,
            "seq": first + np.arange(n),
            "ts_us": ts_us,
            "ip_version": column(version, version > 0),
            "src_ip": address(ip + 12),
            "src_port": column(pair(l4), ports),
            "dst_ip": address(ip + 16),
            "dst_port": column(pair(l4 + 2), ports),
            "proto": column(proto, v4),
            "pkt_len": (stop - frame).astype(np.int32),
            "tcp_flags": column(byte(l4 + 13), tcp),
            "payload": [data[a:b] if ok else None for a, b, ok in zip(l4, stop, v4)],
        }
    )


def _decode(batches):
    """(path, length, stop, entry, first, known) -> packet rows."""
    for pdf in batches:
        for row in pdf.itertuples(index=False):
            if row.length <= GLOBAL_HEADER:
                continue
            with _open(row.path) as source:
                fmt, size = _format(source, row.path), _size(source, row.length)
                fmt.after(row.known if row.known is not None else ())
                entry = fmt.first if row.entry == BEGIN else row.entry
                number = row.first
                stop = row.stop if size == row.length else size
                for data, at, found in fmt.packets(source, entry, stop, size):
                    if data is None:
                        break
                    # A few thousand packets at a time keep the Arrow batches small.
                    n = len(found[0])
                    for begin in range(0, n, 4096):
                        part = [column[begin : begin + 4096] for column in found]
                        yield _packet_frame(data, *part, row.path, number)
                        number += len(part[0])


def decode_files(files: DataFrame) -> DataFrame:
    """Packets of whole files (`path`, `length`), one file at a time; also for streams."""
    rows = files.select(
        "path",
        "length",
        F.col("length").alias("stop"),
        F.lit(BEGIN).cast("long").alias("entry"),
        F.lit(0).cast("long").alias("first"),
        F.lit(None).cast("array<binary>").alias("known"),
    )
    return rows.mapInPandas(_decode, PACKET)


def read_pcap(spark: SparkSession, path: str, split_bytes=SPLIT_BYTES) -> DataFrame:
    """Packets of a capture file, folder or pattern. `seq` is the place in the file."""
    # The listing is Spark's own; the content column is not read.
    files = spark.read.format("binaryFile").load(path).select("path", "length")
    if files.where(F.col("length") > split_bytes).isEmpty():
        tasks = max(1, min(files.count(), 20_000))
        return decode_files(files.repartition(tasks, "path"))
    known = _located(files, split_bytes)
    order = Window.partitionBy("path").orderBy("start")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    ranges = known.withColumns({
        "first": F.coalesce(F.sum("records").over(earlier), F.lit(0)),
        # A few short blocks per file.
        "known": F.flatten(F.collect_list("met").over(earlier)),
    }).where("records > 0")
    ranges = ranges.select("path", "length", "stop", "entry", "first", "known")
    tasks = max(1, min(known.count(), 20_000))
    return ranges.repartition(tasks, "path", "entry").mapInPandas(_decode, PACKET)
