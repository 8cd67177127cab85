import pandas as pd
import pytest
from conftest import packet
from pyspark.sql import functions as F

from flowspark.operators import embedding as emb, flows as fl
from flowspark.sources.packets import packet_stream
from flowspark.sources.store import FlowStore
from flowspark.streaming.intake import Intake, WindowedIntake

A, B = "1.1.1.1", "2.2.2.2"


def batch(start, n=6):
    return [packet(start + i, (start + i) * 1_000_000, A, f"9.9.9.{i % 3}", size=100 + i) for i in range(n)]


def land(df, folder, name):
    df.coalesce(1).write.parquet(str(folder / name))


def stream(spark, folder, **options):
    return packet_stream(spark, str(folder / "*"), max_files=1, **options)


def run(intake, packets):
    intake.start(packets, available_now=True).awaitTermination()


@pytest.fixture
def landing(packets, tmp_path):
    folder = tmp_path / "landing"
    folder.mkdir()
    land(packets(batch(0)), folder, "a")
    land(packets(batch(100)), folder, "b")
    return folder


def test_intervals_fill_the_store(spark, packets, landing, tmp_path):
    base, check = str(tmp_path / "store"), str(tmp_path / "check")
    weights = emb.seeded_weights()
    intake = Intake(spark, base, weights, check)
    run(intake, stream(spark, landing))
    store = FlowStore.load(spark, base)
    rows = store.entries().orderBy("_id").collect()
    assert [r["_id"] for r in rows] == list(range(6)) and store.dimension == 64
    # A flow that spans two intervals is two records, each as the batch job makes it.
    want = fl.flow_table(packets(batch(0))).orderBy("first_seq").collect()
    assert [r.statistical.mean_dt for r in rows[:3]] == [r.mean_dt for r in want]
    totals = intake.totals().first()
    assert (totals.total_packets, totals.total_flows) == (12, 6)

    # A restart goes on where it stopped and repeats nothing.
    land(packets(batch(200)), landing, "c")
    run(Intake(spark, base, weights, check), stream(spark, landing))
    assert store.entries().count() == 9 == store.total_flows()
    assert sorted(r["_id"] for r in store.entries().collect()) == list(range(9))


def test_a_repeated_batch_changes_nothing(spark, packets, tmp_path):
    intake = Intake(spark, str(tmp_path / "s"), emb.seeded_weights(), str(tmp_path / "c"))
    intake.process(packets(batch(0)), 0)
    intake.process(packets(batch(100)), 1)
    intake.process(packets(batch(100)), 1)
    assert intake.store.total_flows() == 6 == intake.store.entries().count()
    assert intake.progress().count() == 2


def test_empty_intervals_leave_the_store_alone(spark, packets, tmp_path):
    intake = Intake(spark, str(tmp_path / "s"), emb.seeded_weights(), str(tmp_path / "c"))
    intake.process(packets([]), 0)
    assert intake.store.total_flows() == 0 and intake.progress().count() == 0
    intake.process(packets([packet(0, 0, "::1", "::2", version=6)]), 1)
    assert intake.store.total_flows() == 0


def test_an_existing_store_is_loaded_or_refused(spark, packets, tmp_path):
    base, weights = str(tmp_path / "s"), emb.seeded_weights()
    Intake(spark, base, weights, str(tmp_path / "c1")).process(packets(batch(0)), 0)
    with pytest.raises(ValueError):
        Intake(spark, base, weights, str(tmp_path / "c2"))
    more = Intake(spark, base, weights, str(tmp_path / "c2"), load_existing=True)
    more.process(packets(batch(0)), 0)
    assert more.store.total_flows() == 6


def test_event_time_windows_do_not_depend_on_intervals(spark, packets, landing, tmp_path):
    land(packets([packet(300, 300_000_000, A, B)]), landing, "z")
    intake = WindowedIntake(spark, str(tmp_path / "w"), str(tmp_path / "wc"), seconds=4)
    run(intake, stream(spark, landing))
    every = batch(0) + batch(100) + [packet(300, 300_000_000, A, B)]
    want = fl.windowed_flows(packets(every), 4)

    def rows(df):
        return sorted(
            (r.window_us, r.dst_ip, r.packet_count, r.mean_dt, r.std_dt, r.flags_summary)
            for r in df.collect()
        )

    assert rows(intake.windows(closed_only=False)) == rows(want)
    assert rows(intake.windows()) == rows(want.where("window_us < 300000000"))


def test_windows_over_interval_borders(spark, packets, tmp_path):
    """One window whose packets arrive in three batches, in any order, equals the batch result."""
    rows = [packet(i, i * 700_000, A, B, size=60 + i * i, payload=bytes([i])) for i in range(12)]
    want = fl.windowed_flows(packets(rows), 60).first()
    for turn, parts in enumerate(((rows[:5], rows[5:6], rows[6:]), (rows[7:], rows[:3], rows[3:7]))):
        intake = WindowedIntake(spark, str(tmp_path / f"w{turn}"), str(tmp_path / f"wc{turn}"), seconds=60)
        for number, part in enumerate(parts):
            intake.process(packets(part), number)
        got = intake.windows(closed_only=False).first()
        for name in ("packet_count", "flow_duration", "mean_dt", "std_dt", "std_pkt_size", "entropy_std"):
            assert got[name] == pytest.approx(want[name], abs=1e-9)


def test_closed_windows_are_written_once_and_leave_the_state(spark, packets, tmp_path):
    """Shuffled within the delay: the same windows as the batch job; late packets are counted."""
    import random

    rows = [packet(i, i * 500_000, A, f"9.9.9.{i % 4}", size=60 + i, payload=bytes([i, 7])) for i in range(120)]
    mixed = sorted(rows, key=lambda r: r[2] + random.Random(r[1]).randint(0, 6_000_000))
    intake = WindowedIntake(spark, str(tmp_path / "w"), str(tmp_path / "wc"), seconds=5, delay_seconds=8)
    for number in range(8):
        intake.process(packets(mixed[15 * number:15 * number + 15]), number)
    intake.process(packets(mixed[105:]), 7)  # repeated
    late = packet(500, 0, A, "9.9.9.9")
    intake.process(packets([late]), 8)

    def flows(df):
        return sorted((r.window_us, r.dst_ip, r.packet_count, round(r.mean_dt, 9), round(r.entropy_mean, 9)) for r in df.collect())

    want = flows(fl.windowed_flows(packets(rows), 5))
    assert flows(intake.windows(closed_only=False)) == want
    closed = flows(intake.windows())
    assert len(closed) == len(set(closed)) and 0 < len(closed) < len(want) and set(closed) <= set(want)
    counts = intake.counts().orderBy("batch_id").collect()
    assert [r.late for r in counts] == [0] * 8 + [1] and sum(r.packets for r in counts) == 121
    # 13 seconds and the shuffling are open at most: the state does not grow with the stream.
    assert max(r.open_packets for r in counts) <= 2 * (5 + 5 + 8 + 6)
    assert len([p for p in (tmp_path / "w" / "open").iterdir() if p.name.startswith("batch")]) <= 3


def test_intervals_of_bounded_size(spark, packets, tmp_path):
    """What arrives at once is cut by packets; a restart in the middle of it doubles nothing."""
    rows = batch(0, 25)
    weights = emb.seeded_weights()
    intake = Intake(spark, str(tmp_path / "s"), weights, str(tmp_path / "c"), max_packets=10)
    intake.process(packets(rows), 0)
    intake.process(packets(rows), 0)
    progress = intake.progress().orderBy("interval").collect()
    assert [(r.packets, r.flows) for r in progress] == [(10, 3), (10, 3), (5, 3)]
    assert [r.protocols for r in progress] == [{"TCP": 10}, {"TCP": 10}, {"TCP": 5}]
    assert intake.protocol_counts().first().packets == 25
    got = intake.store.entries().orderBy("_id").collect()
    want = [r for part in (rows[:10], rows[10:20], rows[20:])
            for r in fl.flow_table(packets(part)).orderBy("first_seq").collect()]
    assert [(r.flow_id.dst_ip, r.statistical.packet_count) for r in got] == [(r.dst_ip, r.packet_count) for r in want]


def test_intake_joins_small_batches(spark, packets, tmp_path):
    intake = Intake(spark, str(tmp_path / "s"), emb.seeded_weights(), str(tmp_path / "c"), compact_every=2)
    for number in range(4):
        intake.process(packets(batch(100 * number)), number)
    assert len(intake.store.parts()) <= 3 and intake.store.total_flows() == 12
    assert sorted(r["_id"] for r in intake.store.entries().collect()) == list(range(12))


def events(spark, path, n):
    """An events table of n rows in a folder of tables."""
    spark.range(n).selectExpr(
        "id AS event_id", "CAST(timestamp_seconds(1700000000 + id * 600) AS TIMESTAMP_NTZ) AS ts",
        "id * 7 % 50 AS user_id", "element_at(array('view', 'click', 'signup', 'error'), CAST(id % 4 AS INT) + 1) AS event_type",
        "id % 300 + 0.5D AS value", "concat('{\"k\": ', id, '}') AS props",
    ).coalesce(1).write.parquet(f"{path}/events.parquet")
    return str(path)


def test_landing_is_shared_by_tasks_and_taken_as_one_batch(spark, tmp_path, monkeypatch):
    """No task writes or reads the whole landing folder, and the flows stay those of one batch."""
    from flowspark.plans import catalog

    sf = events(spark, tmp_path / "sf", 20_000)
    want = catalog.packets(spark, sf).groupBy("capture").count().first()["count"]
    folders = []
    stream = catalog.packet_stream
    monkeypatch.setattr(catalog, "packet_stream", lambda s, path, *a, **b: (folders.append(path), stream(s, path, *a, **b))[1])
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64k")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.minPartitionSize", "32k")
    try:
        got = catalog.stream_intake(spark, sf)
        flows = got.count()
        windows = catalog.stream_windows(spark, sf)
        n_windows = windows.count()
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.minPartitionSize")
    assert flows == catalog.fl.flow_table(catalog.packets(spark, sf)).count()
    assert n_windows == catalog.windowed_flows(spark, sf).count()
    assert len(set(folders)) == 2 and len(folders) == 4  # one batch; three batches in one folder
    for folder in set(folders):
        rows = spark.read.parquet(folder)
        sizes = [r["count"] for r in rows.groupBy(F.input_file_name()).count().collect()]
        assert sum(sizes) == want and max(sizes) < want * 0.7


def test_arrivals_keep_every_packet(spark):
    from flowspark.plans import catalog

    for seqs in ([], [None, 5, 5, 5], [None, *range(100)]):
        rows = spark.createDataFrame([(s,) for s in seqs], "seq long")
        parts = [sorted(((r.seq is not None), r.seq or 0) for r in p.collect()) for p in catalog._arrivals(rows, 3)]
        assert sum(parts, []) == sorted((s is not None, s or 0) for s in seqs)
    assert all(30 <= len(p) <= 37 for p in parts)


def test_flows_of_a_batch_are_worked_out_once(spark, tmp_path):
    """What an append numbers is a written table: its ranges are drawn from the rows of the
    order, without embedding every flow a second time."""
    from flowspark.sources.store import FlowStore

    worked = spark.sparkContext.accumulator(0)

    @F.pandas_udf("array<float>")
    def embed(ids: pd.Series) -> pd.Series:
        worked.add(len(ids))
        return pd.Series([[float(i)] for i in ids])

    rows = spark.range(500).repartition(4).select(F.col("id").alias("first_seq"), embed("id").alias("embedding"))
    FlowStore(spark, str(tmp_path / "store"), dimension=1).append(rows, order=("first_seq",))
    assert worked.value == 500
