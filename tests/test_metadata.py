import pytest
from conftest import packet

from flowspark.operators import flows as fl, metadata as md
from flowspark.operators.ids import dense_ids

A = "10.0.0.1"


@pytest.fixture
def entries(packets):
    rows = [
        packet(0, 0, A, "10.0.0.2", 6, 40000, 443, 1500),
        packet(1, 1, A, "10.0.0.3", 17, 40000, 53, 100),
        packet(2, 2, A, "10.0.0.4", 1, size=60),
        packet(3, 3, "10.0.0.5", "10.0.0.6", 6, 0, 80, 60),
        packet(4, 4, A, "10.0.0.2", 6, 40001, 443, 1500, flags=18),
    ]
    return dense_ids(fl.stored_flows(packets(rows)), ["first_seq"], "_id")


def ids(df):
    return [r["_id"] for r in df.orderBy("_id").collect()]


def test_lookups(entries):
    assert ids(md.flows_by_ip(entries, "10.0.0.2")) == [0, 4]
    assert ids(md.flows_by_ip(entries, A, k=2)) == [0, 1]
    assert ids(md.flows_by_port(entries, 443)) == [0, 4]
    assert ids(md.flows_by_port(entries, 0)) == [3]
    assert ids(md.flows_by_protocol(entries, "https")) == [0, 4]
    assert ids(md.flows_by_protocol(entries, "icmp")) == [2]
    assert ids(md.flow_by_id(entries, 3)) == [3]
    for index in (-1, 5):
        with pytest.raises(IndexError):
            md.flow_by_id(entries, index)


def test_distributions(entries):
    protos = [(r.proto, r.flows, r.pct) for r in md.protocol_distribution(entries).collect()]
    assert protos == [("ICMP", 1, 20.0), ("TCP", 3, 60.0), ("UDP", 1, 20.0)]
    bars = [r.bar for r in md.protocol_distribution(entries).collect()]
    assert bars[0] == "█" * 10 + "░" * 40
    apps = [(r.app_proto, r.flows) for r in md.app_protocol_distribution(entries).collect()]
    assert apps == [("HTTPS", 2), ("DNS", 1), ("UNKNOWN", 1), ("HTTP", 1)]
    assert md.app_protocol_distribution(entries, 1).count() == 1
    maps = md.statistics(entries).first()
    assert maps.protocol_distribution == {"TCP": 3, "UDP": 1, "ICMP": 1}
    assert md.protocol_distribution(entries.limit(0)).count() == 0


def test_totals(entries):
    row = md.store_totals(entries).first()
    assert (row.total_flows, row.total_bytes, row.avg_packets) == (5, 3220.0, 1.0)
    empty = md.store_totals(entries.limit(0)).first()
    assert (empty.total_flows, empty.total_bytes, empty.avg_bytes) == (0, 0.0, None)


def test_texts(entries):
    lines = [r.line for r in md.listing(entries, 3).orderBy("id").collect()]
    assert lines[0] == f"   0. {A + ':40000':30s} → {'10.0.0.2:443':30s} [TCP ]    1,500B    1pkts"
    assert f"{A}:None" in lines[2] and len(lines) == 3
    assert md.listing_totals(entries, 3).first().more == 2
    detail = {r.id: r for r in md.details(entries).collect()}
    assert detail[0].tcp_flags is None and detail[4].tcp_flags == "S_A"
    assert detail[0].total_bytes == "1,500" and detail[0].entropy == "0.000 (±0.000)"
    assert md.embeddable(entries).count() == 5
