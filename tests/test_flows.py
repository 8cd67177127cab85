import random

import pytest
from conftest import packet
from plain_flows import flows as plain

from flowspark.functions import packet as pk
from flowspark.operators import flows as fl
from pyspark.sql import functions as F

A, B = "10.0.0.9", "10.0.0.10"


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


def test_single_packet(packets):
    row = one(fl.flow_table(packets([packet(0, 5, A, B, sport=1, dport=2)])))
    assert row.flow_duration == row.std_pkt_size == row.mean_dt == row.std_dt == 0.0
    assert row.packet_count == 1.0 and row.entropy_std == 0.0


def test_arrival_order_not_time(packets):
    rows = [packet(i, t * 1_000_000, A, B) for i, t in enumerate((10, 9, 12))]
    row = one(fl.flow_table(packets(rows)))
    assert (row.flow_duration, row.mean_dt, row.std_dt) == (2.0, 3.0, 0.0)
    dts = [r.dt for r in fl.packet_sequence(packets(rows)).orderBy("pos").collect()]
    assert dts == [0.0, -1.0, 3.0]


def test_negative_duration(packets):
    rows = [packet(0, 10_000_000, A, B), packet(1, 9_000_000, A, B)]
    row = one(fl.flow_table(packets(rows)))
    assert row.flow_duration == -1.0 and row.mean_dt == 0.0


def test_addresses_compare_as_text(packets):
    row = one(fl.canonical(packets([packet(0, 0, A, B, sport=1, dport=2)])))
    assert (row.src_ip, row.src_port, row.direction) == (B, 2, -1.0)


def test_equal_ends_are_forward(packets):
    row = one(fl.canonical(packets([packet(0, 0, A, A, sport=5, dport=5)])))
    assert row.direction == 1.0


def test_icmp_both_ways_is_one_flow(packets):
    rows = [packet(0, 0, A, B, 1), packet(1, 1, B, A, 1)]
    row = one(fl.stored_flows(packets(rows)))
    assert row.flow_id.src_port is None and row.temporal.direction == [-1.0, 1.0]
    assert row.protocol.proto == "ICMP" and row.protocol.app_proto == "UNKNOWN"


@pytest.mark.parametrize(
    "sport, dport, proto, name",
    [(22, 80, 6, "SSH"), (5000, 80, 6, "HTTP"), (None, None, 1, "UNKNOWN"), (80, 443, 47, "UNKNOWN"),
     (67, 68, 17, "DHCP"), (5000, 5001, 17, "UNKNOWN")],
)
def test_application_protocol(packets, sport, dport, proto, name):
    row = one(fl.flow_table(packets([packet(0, 0, "1.1.1.1", "2.2.2.2", proto, sport, dport)])))
    assert row.app_proto == name


@pytest.mark.parametrize(
    "flags, text",
    [([18, 16, 24, 17], "S_A_P_F"), ([0], "NONE"), ([64], "NONE"), ([16, 2], "A_S"), ([63], "S_A_F_R_P_U")],
)
def test_flags(packets, flags, text):
    rows = [packet(i, i, A, B, flags=f, sport=1, dport=2) for i, f in enumerate(flags)]
    assert one(fl.flow_table(packets(rows))).flags_summary == text
    assert one(fl.flow_table(packets(rows), chunk=1)).flags_summary == text


def test_entropy_values():
    got = pk.payload_entropies([b"", None, b"aaaa", bytes(range(256)), b"ab" * 9])
    assert got.tolist() == [0.0, 0.0, 0.0, 8.0, 1.0]


def test_entropy_of_many_large_payloads_in_steps():
    payloads = [bytes(range(256)) * 1000] * 40
    assert set(pk.payload_entropies(payloads)) == {8.0}


def test_zero_length_frames(packets):
    assert one(fl.flow_table(packets([packet(0, 0, A, B, size=0)]))).byte_ratio == 0.0


def test_only_ipv4(packets):
    assert fl.flow_table(packets([packet(0, 0, "::1", "::2", version=6)])).count() == 0


def test_stored_lists_hold_the_first_ten(packets):
    rows = [packet(i, i * 1_000_000, A, B, size=i) for i in range(12)]
    for chunk in (fl.CHUNK, 5, 1):
        row = one(fl.stored_flows(packets(rows), chunk=chunk))
        assert row.temporal.pkt_size == [float(i) for i in range(10)]
        assert row.temporal.dt == [0.0] + [1.0] * 9


def test_timestamp_is_utc_with_six_digits(spark, packets):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        row = one(fl.flow_table(packets([packet(0, 1_700_000_000_000_042, A, B)])))
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert row.timestamp == "2023-11-14T22:13:20.000042Z"


def test_events_are_read_as_utc(spark):
    from flowspark.sources.packets import packets_from_events

    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        events = spark.sql(
            "SELECT 1L AS event_id, TIMESTAMP_NTZ'2023-07-14 22:13:20.000042' AS ts, 1L AS user_id, "
            "'view' AS event_type, 1.0D AS value, '{}' AS props"
        )
        assert packets_from_events(events).first().ts_us == 1_689_372_800_000_042
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_time_before_the_epoch(spark):
    df = spark.createDataFrame([(-1,)], "t long")
    assert df.select(pk.iso_timestamp("t")).first()[0] == "1969-12-31T23:59:59.999999Z"


def random_packets(seed, n=400):
    rng = random.Random(seed)
    clock, rows = 1_700_000_000_000_000, []
    for seq in range(n):
        clock += rng.choice([-500, 0, 3, 1000, 250_000, 7_000_000])
        # One pair of ends has about a third of all packets.
        if rng.random() < 0.33:
            ends = [("10.0.0.1", 40000), ("10.0.0.2", 443)]
            proto = 6
        else:
            ends = [(f"10.0.0.{rng.randint(1, 12)}", rng.choice([80, 53, 22, 40000])) for _ in range(2)]
            proto = rng.choice([6, 6, 17, 1, 47])
        if rng.random() < 0.5:
            ends.reverse()
        (src, sport), (dst, dport) = ends
        if proto not in (6, 17):
            sport = dport = None
        rows.append(
            packet(seq * 3, clock, src, dst, proto, sport, dport, rng.randint(0, 1500),
                   rng.randint(0, 255) if proto == 6 else None,
                   rng.randbytes(rng.choice([0, 1, 20, 300])), rng.choice([4] * 9 + [6]))
        )
    return rows


@pytest.mark.parametrize("seed, chunk", [(1, fl.CHUNK), (3, 7)])
def test_random_packets_against_plain_python(packets, seed, chunk):
    rows = random_packets(seed)
    want = plain(rows)
    got = fl.flow_records(packets(rows), chunk=chunk, segment=10_000).collect()
    assert len(got) == len(want)
    for row in got:
        expected = want[tuple(row.flow_id)]
        flat = {**row.statistical.asDict(), **row.protocol.asDict(), "first_seq": row.first_seq}
        for name, value in expected.items():
            if name == "temporal":
                for field, values in value.items():
                    assert row.temporal[field] == pytest.approx(values, abs=1e-9)
            elif isinstance(value, str):
                assert flat[name] == value
            else:
                assert flat[name] == pytest.approx(value, rel=1e-9, abs=1e-9), name


def test_long_flows_go_on_in_segments(packets):
    rows = random_packets(5)
    whole = {tuple(r.flow_id): r for r in fl.flow_records(packets(rows)).collect()}
    parts = {}
    for r in fl.flow_records(packets(rows), segment=16).orderBy("segment").collect():
        assert len(r.temporal.dt) <= 16
        parts.setdefault(tuple(r.flow_id), []).extend(r.temporal.dt)
    assert {k: r.temporal.dt for k, r in whole.items()} == parts


def test_windows_split_flows(packets):
    rows = [packet(i, t * 1_000_000, A, B) for i, t in enumerate((1, 9, 11, 19, 30))]
    got = fl.windowed_flows(packets(rows), 10).orderBy("window_us").collect()
    assert [(r.window_us // 1_000_000, r.packet_count, r.mean_dt) for r in got] == [
        (0, 2.0, 8.0), (10, 2.0, 8.0), (30, 1.0, 0.0)
    ]


def test_one_key_partitioning_per_level(packets):
    """Two shuffles: packets to stretches, partial rows to flows."""
    plan = fl.flow_table(packets([packet(0, 0, A, B)]))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2


def test_packets_without_a_capture_keep_their_sequence(packets):
    from conftest import packet

    from flowspark.operators.flows import flow_records, packet_sequence

    rows = packets([packet(i, i * 1000, "1.1.1.1", "2.2.2.2") for i in range(5)])
    rows = rows.withColumn("capture", F.lit(None).cast("string"))
    assert packet_sequence(rows).count() == 5
    assert flow_records(rows).count() == 1


@pytest.fixture
def no_broadcasts(spark):
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    yield
    spark.conf.set(key, before)


@pytest.mark.parametrize("name, most", [("temporal_sequences", 5), ("stored_ids", 4), ("label_groups", 7)])
def test_exchanges_of_queries(spark, no_broadcasts, name, most):
    """Null-safe keys cost no shuffle of their own."""
    import re

    from flowspark.plans.catalog import QUERIES

    plan = QUERIES[name][0](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    plan = plan.split("== Initial Plan ==")[0]
    assert len(re.findall(r"(?<!Broadcast)Exchange ", plan)) <= most
