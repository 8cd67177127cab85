import struct

import pytest
from conftest import packet
from pyspark.sql import functions as F

from flowspark.operators import flows as fl
from flowspark.operators.embedding import with_features
from flowspark.sources.flow_files import read_flow_lines, write_flow_lines
from flowspark.sources.packets import packet_stream, packets
from flowspark.sources.pcap import read_pcap
from flowspark.sources.store import FlowStore

A, B = "1.1.1.1", "2.2.2.2"


def ip(text):
    return bytes(int(x) for x in text.split("."))


def ethernet(payload, kind=0x0800, vlan=False):
    tag = struct.pack(">HH", 0x8100, 5) if vlan else b""
    return b"\x00" * 12 + tag + struct.pack(">H", kind) + payload


def ipv4(proto, src, dst, body, fragment=0):
    return struct.pack(">BBHHHBBH", 0x45, 0, 20 + len(body), 0, fragment, 64, proto, 0) + ip(src) + ip(dst) + body


def tcp(sport, dport, flags, data=b""):
    return struct.pack(">HHIIBBHHH", sport, dport, 0, 0, 0x50, flags, 0, 0, 0) + data


def udp(sport, dport, data=b""):
    return struct.pack(">HHHH", sport, dport, 8 + len(data), 0) + data


def pcap(frames, order="<", nanos=False, link=1, cut=0):
    magic = 0xA1B23C4D if nanos else 0xA1B2C3D4
    out = struct.pack(order + "IHHiIII", magic, 2, 4, 0, 0, 262144, link)
    for (seconds, fraction), frame in frames:
        out += struct.pack(order + "IIII", seconds, fraction, len(frame), len(frame)) + frame
    return out[: len(out) - cut] if cut else out


FRAMES = [
    ((100, 5), ethernet(ipv4(6, A, B, tcp(1234, 80, 0x12, b"hello")))),
    ((100, 6), ethernet(ipv4(17, B, A, udp(53, 999, b"x")), vlan=True)),
    ((101, 7), ethernet(b"\x60" + b"\x00" * 39, kind=0x86DD)),
    ((101, 8), ethernet(ipv4(1, A, B, b"\x08\x00"))),
    ((101, 9), ethernet(b"arp", kind=0x0806)),
    ((102, 0), ethernet(ipv4(6, A, B, tcp(1234, 80, 0x10), fragment=100))),
]


@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("nanos", [False, True])
def test_pcap_fields(spark, tmp_path, order, nanos):
    frames = [((s, f * 1000 if nanos else f), frame) for (s, f), frame in FRAMES]
    (tmp_path / "a.pcap").write_bytes(pcap(frames, order, nanos))
    rows = read_pcap(spark, str(tmp_path / "a.pcap")).orderBy("seq").collect()
    assert [r.ts_us for r in rows] == [100_000_005, 100_000_006, 101_000_007, 101_000_008, 101_000_009, 102_000_000]
    assert [r.ip_version for r in rows] == [4, 4, 6, 4, None, 4]
    first = rows[0]
    assert (first.src_ip, first.src_port, first.dst_ip, first.dst_port) == (A, 1234, B, 80)
    assert (first.proto, first.tcp_flags, first.pkt_len) == (6, 0x12, len(FRAMES[0][1]))
    assert bytes(first.payload) == tcp(1234, 80, 0x12, b"hello")
    assert (rows[1].src_port, rows[1].dst_port, rows[1].tcp_flags) == (53, 999, None)
    assert rows[2].src_ip is None and rows[2].payload is None
    assert rows[3].src_port is None and rows[3].proto == 1
    assert rows[5].src_port is None and rows[5].tcp_flags is None


def test_pcap_cut_off_last_packet(spark, tmp_path):
    (tmp_path / "a.pcap").write_bytes(pcap(FRAMES[:2], cut=3))
    rows = read_pcap(spark, str(tmp_path)).orderBy("seq").collect()
    assert [r.pkt_len for r in rows] == [len(FRAMES[0][1]), len(FRAMES[1][1]) - 3]


def test_pcap_raw_ip(spark, tmp_path):
    (tmp_path / "a.pcap").write_bytes(pcap([((1, 1), ipv4(17, A, B, udp(1, 2)))], link=101))
    assert read_pcap(spark, str(tmp_path)).first().dst_port == 2


def test_not_a_pcap(spark, tmp_path):
    (tmp_path / "a.pcap").write_bytes(b"x" * 100)
    with pytest.raises(Exception, match="not a pcap file"):
        read_pcap(spark, str(tmp_path)).collect()


def test_large_pcap_is_read_in_ranges(spark, tmp_path):
    """Every range size gives the same rows, also when payloads hold whole captures."""
    inner = pcap([((7, i), b"\x01" * 10) for i in range(60)])
    frames = []
    for i in range(120):
        data = inner if i % 7 == 0 else bytes([i % 256]) * (i % 90)
        frames.append(((i, i), ethernet(ipv4(17, A, B, udp(i, 53, data)))))
    (tmp_path / "big.pcap").write_bytes(pcap(frames))
    (tmp_path / "small.pcap").write_bytes(pcap(FRAMES))
    want = [tuple(r) for r in read_pcap(spark, str(tmp_path)).orderBy("capture", "seq").collect()]
    assert len(want) == 126
    for split in (1500, 20_000):
        got = [tuple(r) for r in read_pcap(spark, str(tmp_path), split).orderBy("capture", "seq").collect()]
        assert got == want


def test_a_source_is_needed(spark):
    with pytest.raises(ValueError):
        packets(spark)
    with pytest.raises(ValueError):
        packet_stream(spark)


def test_packet_table_and_count(spark, packets, tmp_path):
    from flowspark.sources.packets import packets as source

    packets([packet(i, i, A, B) for i in (3, 1, 2)]).write.parquet(str(tmp_path / "p"))
    rows = source(spark, str(tmp_path / "p"), count=2).collect()
    assert [r.seq for r in rows] == [1, 2]
    assert source(spark, str(tmp_path / "p")).count() == 3


def test_flow_lines_skip_bad_ones(spark, packets, tmp_path):
    path = tmp_path / "flows"
    write_flow_lines(fl.flow_records(packets([packet(0, 0, A, B, 1)])).drop("first_seq", "capture"), str(path))
    text = next(path.glob("part-*")).read_text()
    assert '"src_port":null' in text
    (path / "extra.json").write_text("{broken\n\n" + text.replace('"timestamp"', '"label":"scan","timestamp"'))
    rows = read_flow_lines(spark, str(path))
    assert sorted(r.label for r in rows.collect()) == ["normal", "scan"]
    assert rows.count() == 2


def flows_of(packets, n, start=0):
    return with_features(
        fl.stored_flows(packets([packet(start + i, i, A, f"9.9.9.{i}") for i in range(n)])), "embedding"
    )


def test_store_ids_go_on_and_batches_replace(spark, packets, tmp_path):
    base = str(tmp_path / "s")
    store = FlowStore(spark, base, dimension=12)
    assert store.entries().count() == 0
    assert store.append(flows_of(packets, 3)) == 3
    assert store.append(flows_of(packets, 2, 10)) == 2
    assert store.append(flows_of(packets, 2, 10), batch_id=1) == 2  # the same batch again
    again = FlowStore.load(spark, base)
    assert (again.total_flows(), again.dimension, again.index_type) == (5, 12, "flatl2")
    rows = again.entries().orderBy("_id").collect()
    assert [r["_id"] for r in rows] == [0, 1, 2, 3, 4]
    assert [r.flow_id.dst_ip for r in rows] == ["9.9.9.0", "9.9.9.1", "9.9.9.2", "9.9.9.0", "9.9.9.1"]


def test_default_order_is_by_capture_first(spark, packets, tmp_path):
    both = flows_of(packets, 2).withColumn("capture", F.lit("b")).unionByName(
        flows_of(packets, 3).withColumn("capture", F.lit(None).cast("string")))
    store = FlowStore(spark, str(tmp_path / "s"), dimension=12)
    assert store.append(both) == 5
    rows = store.entries().orderBy("_id").collect()
    assert [r["_id"] for r in rows] == [0, 1, 2, 3, 4]
    assert [r.flow_id.dst_ip[-1] for r in rows] == ["0", "1", "2", "0", "1"]


def test_a_repeated_batch_may_shrink_or_empty(spark, packets, tmp_path):
    store = FlowStore(spark, str(tmp_path / "s"), dimension=12)
    store.append(flows_of(packets, 3))
    store.append(flows_of(packets, 4, 10))
    assert store.append(flows_of(packets, 2, 10), batch_id=1) == 2
    assert store.total_flows() == 5 == store.entries().count()
    assert store.append(flows_of(packets, 2, 10).limit(0), batch_id=1) == 0
    assert store.total_flows() == 3 == store.entries().count() and store.last_batch() == 1
    with pytest.raises(ValueError):  # ids of batch 1 would move
        store.append(flows_of(packets, 2, 10), batch_id=1) and store.append(flows_of(packets, 1), batch_id=0)
    assert sorted(r["_id"] for r in store.entries().collect()) == list(range(5))


def many_batches(spark, base, monkeypatch, batches=1000, each=10):
    """A store of many small parts, written at once."""
    from flowspark.schema import PART
    from flowspark.sources import store as st

    monkeypatch.setattr(st, "UNIT", each)
    rows = spark.range(batches * each, numPartitions=1).selectExpr(
        "id AS _id", "current_timestamp() AS _indexed_at",
        "named_struct('src_ip', concat('10.0.', id DIV 20, '.1'), 'src_port', CAST(id AS INT), 'dst_ip', '9.9.9.9', "
        "'dst_port', 53, 'protocol', 17) AS flow_id",
        "named_struct('proto', 'UDP', 'app_proto', 'DNS', 'flags_summary', 'NONE') AS protocol", f"lpad(id DIV {each}, 9, '0') AS folder")
    rows.write.partitionBy("folder").parquet(f"{base}/entries")
    store = st.FlowStore(spark, base, dimension=12)
    store._write_lookup(st.lookup_rows(rows, 0, batches * each - 1), "all")
    parts = [(b, b, f"folder={b:09d}", "all", each, b * each, 12, "flatl2", [("UDP", "DNS", each, b * each, 1.0, 2.0)])
             for b in range(batches)]
    store._commit(None, [], spark.createDataFrame(parts, PART))
    return store


def test_lookups_open_few_of_many_parts(spark, tmp_path, monkeypatch):
    from flowspark.operators import metadata as md

    store = many_batches(spark, str(tmp_path / "s"), monkeypatch)
    every = len(store.entries().inputFiles())
    assert every == 1000

    def opened(df, ids):
        assert [r["_id"] for r in df.orderBy("_id").collect()] == ids
        return len(df.inputFiles())

    assert opened(md.flow_by_id(store, 4321), [4321]) == 1
    assert opened(md.flows_by_ip(store, "10.0.77.1", 100), list(range(1540, 1560))) <= 0.01 * every
    assert opened(md.flows_by_port(store, 9999), [9999]) <= 0.01 * every
    assert opened(md.flows_by_ip(store, "10.99.99.99"), []) <= 0.01 * every
    # What all flows have is found in the first parts.
    assert opened(md.flows_by_ip(store, "9.9.9.9", 10), list(range(10))) <= 0.05 * every
    assert opened(md.flows_by_port(store, 53, 15), list(range(15))) <= 0.05 * every
    assert opened(md.flows_by_protocol(store, "dns", 5), list(range(5))) <= 0.05 * every
    assert md.flows_by_protocol(store, "http").count() == 0
    for index in (-1, 10_000):
        with pytest.raises(IndexError):
            md.flow_by_id(store, index)
    # Totals read no entries.
    for totals in (md.store_totals(store), md.protocol_distribution(store), md.statistics(store)):
        assert not any("/entries/" in f for f in totals.inputFiles())
    assert md.store_totals(store).first().total_packets == 2000.0


def test_compaction_of_many_parts(spark, tmp_path, monkeypatch):
    from flowspark.operators import metadata as md

    store = many_batches(spark, str(tmp_path / "s"), monkeypatch, batches=50)
    assert store.compact(rows_per_part=200) == 49
    assert [p["rows"] for p in store.parts()] == [200, 200, 90, 10]
    assert len({p["lookup"] for p in store.parts()}) == 2
    rows = md.flows_by_ip(store, "10.0.20.1", 100)
    assert [r["_id"] for r in rows.orderBy("_id").collect()] == list(range(400, 420))
    assert not any("/entries/000000000-" in f for f in rows.inputFiles())
    assert md.store_totals(store).first().total_packets == 100.0


def test_compaction_under_readers(spark, packets, tmp_path):
    from flowspark.operators import metadata as md

    store = FlowStore(spark, str(tmp_path / "s"), dimension=12)
    for b in range(5):
        store.append(flows_of(packets, 3, 10 * b))
    store.append(flows_of(packets, 3).limit(0))
    want = sorted((r["_id"], r.flow_id.dst_ip, r["_indexed_at"]) for r in store.entries().collect())
    reader, before = FlowStore.load(spark, store.base, store.version()), md.store_totals(store).collect()
    began = reader.entries()
    assert store.compact(rows_per_part=9) == 3  # of five, the newest stays
    for rows in (began, reader.entries(), store.entries()):
        assert sorted((r["_id"], r.flow_id.dst_ip, r["_indexed_at"]) for r in rows.collect()) == want
    assert [(p["batch_id"], p["until_batch"], p["rows"]) for p in store.parts()] == [(0, 2, 9), (3, 3, 3), (4, 4, 3)]
    assert md.store_totals(store).collect() == before
    assert [r["_id"] for r in md.flows_by_ip(store, "9.9.9.1").orderBy("_id").collect()] == [1, 4, 7, 10, 13]
    assert store.append(flows_of(packets, 2, 40), batch_id=4) == 2  # a restart after compaction
    with pytest.raises(ValueError):
        store.append(flows_of(packets, 3), batch_id=1)
    assert store.append(flows_of(packets, 1, 90)) == 1 and store.total_flows() == 15
    store.vacuum(keep=1)
    assert len(store.versions()) == 1 and store.entries().count() == 15
    assert len(list((tmp_path / "s" / "entries").iterdir())) == len(store.parts())
    assert [r["_id"] for r in md.flows_by_ip(store, "9.9.9.0").orderBy("_id").collect()] == [0, 3, 6, 9, 12, 14]


def test_a_lost_writer_leaves_no_version(spark, packets, tmp_path):
    store = FlowStore(spark, str(tmp_path / "s"), dimension=12)
    store.append(flows_of(packets, 3))
    (tmp_path / "s" / "versions" / "000000001").mkdir()
    assert store.version() == 0 and store.entries().count() == 3
    assert store.append(flows_of(packets, 2, 10)) == 2 and store.version() == 1


def test_many_protocol_names_are_counted_when_asked(spark, packets, tmp_path, monkeypatch):
    from flowspark.operators import metadata as md
    from flowspark.sources import store as st

    monkeypatch.setattr(st, "MOST_TALLIES", 0)
    store = FlowStore(spark, str(tmp_path / "s"), dimension=12)
    store.append(flows_of(packets, 3))
    assert store.parts() and md.store_totals(store).first().total_flows == 3
    assert md.flows_by_protocol(store, "tcp").count() == 3


def test_one_row_append(spark, packets, tmp_path):
    store = FlowStore(spark, str(tmp_path / "s"), dimension=12)
    assert store.append(flows_of(packets, 1)) == 1
    assert store.append(flows_of(packets, 1).limit(0)) == 0
    assert store.total_flows() == 1


def test_store_errors(spark, packets, tmp_path):
    with pytest.raises(ValueError):
        FlowStore(spark, str(tmp_path), index_type="other")
    with pytest.raises(FileNotFoundError):
        FlowStore.load(spark, str(tmp_path / "none"))
    with pytest.raises(ValueError):
        FlowStore(spark, str(tmp_path / "w"), dimension=64).append(flows_of(packets, 1))
    with pytest.raises(ValueError):
        bad = flows_of(packets, 1).withColumn("embedding", F.lit(None).cast("array<float>"))
        FlowStore(spark, str(tmp_path / "w"), dimension=12).append(bad)


def block(kind, body, order="<"):
    body += b"\0" * (-len(body) % 4)
    return struct.pack(order + "II", kind, 12 + len(body)) + body + struct.pack(order + "I", 12 + len(body))


def section(order="<"):
    return block(0x0A0D0D0A, struct.pack(order + "IHHq", 0x1A2B3C4D, 1, 0, -1), order)


def interface(link, order="<", resolution=None, shift=None):
    options = b""
    if resolution is not None:
        options += struct.pack(order + "HHBBBB", 9, 1, resolution, 0, 0, 0)
    if shift is not None:
        options += struct.pack(order + "HHq", 14, 8, shift)
    return block(1, struct.pack(order + "HHI", link, 0, 0) + options + (struct.pack(order + "HH", 0, 0) if options else b""), order)


def enhanced(number, ticks, frame, order="<"):
    return block(6, struct.pack(order + "IIIII", number, ticks >> 32, ticks & 0xFFFFFFFF, len(frame), len(frame)) + frame, order)


@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("zipped", [False, True])
def test_pcapng_fields(spark, tmp_path, order, zipped):
    import gzip

    inner = ipv4(17, A, B, udp(7, 8, b"abc"))
    other = {"<": ">", ">": "<"}[order]
    data = b"".join([
        section(order), interface(1, order), interface(101, order, resolution=9, shift=10),
        enhanced(0, 100_000_005, FRAMES[0][1], order), block(5, b"\1" * 40, order),
        enhanced(1, 2_000_000_123, inner, order), block(0x0BAD, b"note" * 9, order),
        block(3, struct.pack(order + "I", len(FRAMES[1][1])) + FRAMES[1][1], order),
        block(2, struct.pack(order + "HHIIII", 1, 0, 0, 5000, len(inner), len(inner)) + inner, order),
        # Another section: its own byte order, and interfaces from 0 again.
        section(other), interface(101, other, resolution=0x80 | 10), enhanced(0, 3 * 1024 + 512, inner, other),
    ])
    (tmp_path / "a.pcapng").write_bytes(gzip.compress(data) if zipped else data)
    rows = read_pcap(spark, str(tmp_path / "a.pcapng")).orderBy("seq").collect()
    assert [r.ts_us for r in rows] == [100_000_005, 12_000_000, 0, 10_000_005, 3_500_000]
    assert [(r.src_ip, r.src_port, r.dst_port) for r in rows] == [
        (A, 1234, 80), (A, 7, 8), (B, 53, 999), (A, 7, 8), (A, 7, 8)]
    assert rows[1].pkt_len == len(inner) and bytes(rows[1].payload) == udp(7, 8, b"abc")


def test_large_pcapng_is_read_in_ranges(spark, tmp_path):
    frames = [ethernet(ipv4(17, A, B, udp(i, 53, bytes([i % 256]) * (i % 90)))) for i in range(150)]
    hidden = section() + interface(1) + b"".join(enhanced(0, 5, f) for f in frames[:8])
    data = section() + interface(1)
    for i, frame in enumerate(frames):
        if i == 60:
            data += interface(101, resolution=3)
        if i == 110:
            data += section(">") + interface(1, ">")
        order = ">" if i >= 110 else "<"
        # Payloads that hold whole captures.
        frame = ethernet(ipv4(17, A, B, udp(i, 53, hidden))) if i % 29 == 3 else frame
        data += enhanced(1, i, frame[14:], order) if i in (70, 90) else enhanced(0, i, frame, order)
    (tmp_path / "big.pcapng").write_bytes(data)
    (tmp_path / "small.pcap").write_bytes(pcap(FRAMES))
    want = [tuple(r) for r in read_pcap(spark, str(tmp_path)).orderBy("capture", "seq").collect()]
    assert len(want) == 156 and [r[5] for r in want[:150]] == list(range(150))
    assert want[70][2] == 70_000 and want[71][2] == 71
    for split in (1500, 9000):
        got = [tuple(r) for r in read_pcap(spark, str(tmp_path), split).orderBy("capture", "seq").collect()]
        assert got == want


def test_gzipped_pcap_and_cut_off_blocks(spark, tmp_path):
    import gzip

    want = pcap(FRAMES * 30)
    (tmp_path / "a.pcap").write_bytes(want)
    (tmp_path / "b.pcap.gz").write_bytes(gzip.compress(want))
    (tmp_path / "c.pcap.gz").write_bytes(gzip.compress(want[:-5]))
    for split in (1 << 30, 400):
        rows = read_pcap(spark, str(tmp_path), split)
        by = {}
        for r in rows.orderBy("seq").collect():
            by.setdefault(r.capture.split("/")[-1], []).append(tuple(r)[1:])
        assert len(by["a.pcap"]) == 180 and by["a.pcap"] == by["b.pcap.gz"]
        assert by["c.pcap.gz"][:-1] == by["a.pcap"][:-1] and len(by["c.pcap.gz"]) == 180
    (tmp_path / "d.pcapng").write_bytes((section() + interface(1) + enhanced(0, 1, FRAMES[0][1]) * 2)[:-20])
    assert [r.pkt_len for r in read_pcap(spark, str(tmp_path / "d.pcapng")).orderBy("seq").collect()][0] == len(FRAMES[0][1])


@pytest.mark.parametrize("link, head", [
    (0, struct.pack("<I", 2)), (0, struct.pack(">I", 2)), (108, struct.pack(">I", 2)),
    (113, b"\0" * 14 + struct.pack(">H", 0x0800)), (276, struct.pack(">H", 0x0800) + b"\0" * 18),
    (1, b"\0" * 12 + struct.pack(">HHHHH", 0x88A8, 1, 0x8100, 2, 0x9100) + struct.pack(">HH", 3, 0x0800)),
    (1, b"\0" * 12 + struct.pack(">HBBHHH", 0x8864, 0x11, 0, 1, 30, 0x0021)),
    (1, b"\0" * 12 + struct.pack(">HII", 0x8847, 17 << 12 | 64, 18 << 12 | 0x100 | 64)),
])
def test_links_and_tunnels(spark, tmp_path, link, head):
    (tmp_path / "a.pcap").write_bytes(pcap([((1, 1), head + ipv4(6, A, B, tcp(5, 6, 2)))], link=link))
    row = read_pcap(spark, str(tmp_path)).first()
    assert (row.ip_version, row.src_ip, row.dst_port, row.tcp_flags) == (4, A, 6, 2)


def test_links_that_are_not_known(spark, tmp_path):
    (tmp_path / "a.pcap").write_bytes(pcap([((1, 1), b"x" * 60)], link=147))
    with pytest.raises(Exception, match="unsupported link type"):
        read_pcap(spark, str(tmp_path)).collect()
