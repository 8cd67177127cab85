import numpy as np
import pytest

from flowspark.operators import index, search as se
from flowspark.operators.blocks import knn_join
from flowspark.operators.metadata import matching
from flowspark.sources.store import FlowStore
from pyspark.sql import functions as F


def table(spark, vectors, protos=None, start=0):
    rows = [
        (start + i, [float(x) for x in v], ((protos[i] if protos else "TCP"),))
        for i, v in enumerate(vectors)
    ]
    return spark.createDataFrame(
        rows, "_id long, embedding array<float>, protocol struct<proto:string>"
    ).repartition(3)


def brute(vectors, queries, k, exclude_self=False):
    v = np.asarray(vectors, np.float32).astype(float)
    q = np.asarray(queries, np.float32).astype(float)
    out = {}
    for i, row in enumerate(q):
        d = ((v - row) ** 2).sum(1)
        order = [j for j in np.lexsort((np.arange(len(v)), d)) if not (exclude_self and j == i)]
        out[i] = [(int(j), d[j]) for j in order[:k]]
    return out


def as_dict(hits):
    out = {}
    for r in hits.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.id, r.distance))
    return out


def same(got, want):
    assert got.keys() == want.keys()
    for q in want:
        assert [i for i, _ in got[q]] == [i for i, _ in want[q]]
        assert [d for _, d in got[q]] == pytest.approx([d for _, d in want[q]], abs=1e-9)


@pytest.fixture(scope="module")
def clustered():
    """A third of all vectors in one tight cluster, some equal, the rest spread."""
    rng = np.random.default_rng(0)
    tight = 0.01 * rng.normal(size=(100, 8)) + 5
    tight[10:20] = tight[9]
    spread = np.concatenate([c + 0.3 * rng.normal(size=(40, 8)) for c in rng.normal(size=(5, 8)) * 4])
    return np.concatenate([tight, spread]).astype(np.float32)


def test_exact_search_with_ties(spark, clustered):
    entries = table(spark, clustered)
    same(as_dict(se.knn(entries, se.query_rows(entries), 5)), brute(clustered, clustered, 5))


@pytest.mark.parametrize("block_rows, pivots, self_out", [(16, 7, True), (1000, 16, False), (7, 1, True)])
def test_join_for_many_queries(spark, clustered, block_rows, pivots, self_out):
    entries = table(spark, clustered)
    hits = knn_join(se.query_rows(entries), entries, 4, self_out, pivots, block_rows)
    same(as_dict(hits), brute(clustered, clustered, 4, self_out))


def test_join_kernel_holds_few_distances():
    """The kernel of a block takes little memory beside it, with all vectors equal too."""
    import tracemalloc

    from flowspark.functions.vector import nearest

    rng = np.random.default_rng(2)
    rows = rng.normal(size=(16384, 4))
    for entries in (rows, np.ones((2048, 64))):
        queries = entries[:1024] if entries is rows else entries
        tracemalloc.start()
        at, ids, d = nearest(queries, entries, np.arange(len(entries)), 3)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 80e6
        apart = ((queries[777] - entries) ** 2).sum(1)
        want = np.lexsort((np.arange(len(entries)), apart))[:3]
        assert list(ids[at == 777]) == list(want) and d[at == 777] == pytest.approx(apart[want])


def test_join_plans_without_python_rows(spark, clustered):
    """Its small tables are made without tasks: those would leave further Python workers on
    the executors, of some 110 MB each."""
    from flowspark.operators.blocks import small_table

    rows = small_table(spark, [(1, 2, 0.5), (3, 4, 1.5)], "part int, n long, away double")
    assert rows.dtypes == [("part", "int"), ("n", "bigint"), ("away", "double")]
    assert [tuple(r) for r in rows.collect()] == [(1, 2, 0.5), (3, 4, 1.5)]
    assert "ExistingRDD" not in rows._jdf.queryExecution().executedPlan().toString()


def test_join_takes_over_beyond_the_broadcast_bound(spark, clustered):
    entries = table(spark, clustered)
    hits = se.knn(entries, se.query_rows(entries), 3, max_broadcast=10)
    same(as_dict(hits), brute(clustered, clustered, 3))


def test_k_above_total_and_empty_store(spark):
    entries = table(spark, [[0, 0], [3, 4]])
    query = se.query_vector(spark, [0, 0])
    assert as_dict(se.knn(entries, query, 10)) == {0: [(0, 0.0), (1, 25.0)]}
    assert as_dict(knn_join(query, entries, 10)) == {0: [(0, 0.0), (1, 25.0)]}
    assert se.knn(entries.limit(0), query, 10).count() == 0
    assert knn_join(query, entries.limit(0), 10).count() == 0


def test_filters_before_and_after(spark):
    vectors = [[i, 0] for i in range(60)]
    protos = ["UDP" if i in (5, 25, 55) else "TCP" for i in range(60)]
    entries = table(spark, vectors, protos)
    query = se.query_vector(spark, [0, 0])
    want = {"protocol.proto": "UDP"}
    ids = lambda hits: [i for i, _ in as_dict(hits).get(0, [])]
    assert ids(se.search(entries, query, 3, want)) == [5, 25, 55]
    assert ids(se.search(entries, query, 3, want, "post")) == [5, 25]  # of the 30 nearest
    assert ids(se.search(entries, query, 1, want, "post")) == [5]
    assert ids(se.nearest_zero_by_protocol(entries, "UDP", 2, 2)) == [5, 25]
    assert ids(se.nearest_zero_by_protocol(entries, "udp", 2, 2)) == []
    with pytest.raises(ValueError):
        se.search(entries, query, 3, want, "other")


def test_nested_filters(spark):
    entries = table(spark, [[0], [1], [2]], ["TCP", None, "UDP"])
    ids = lambda f: sorted(r["_id"] for r in matching(entries, f).collect())
    assert ids({"_x": 1}) == [0, 1, 2]
    assert ids({"protocol.proto": None}) == [1]
    assert ids({"protocol.proto.deeper": "TCP"}) == []
    assert ids({"protocol.proto.deeper": None}) == [0, 1, 2]
    assert ids({"protocol.proto": "UDP", "no.where": None}) == [2]


def test_find_similar(spark, clustered):
    entries = table(spark, clustered)
    assert as_dict(se.find_similar(entries, 9, 5))[9] == [(i, 0.0) for i in range(10, 15)]
    with pytest.raises(IndexError):
        se.find_similar(entries, 10_000)


def test_anomalies(spark):
    vectors = [[0, 0], [0, 0], [10, 0], [0, 30], [1, 0]]
    entries = table(spark, vectors)
    far = se.anomalies(entries, 2.0).collect()
    assert [(r.id, r.distance) for r in far] == [(3, 900.0), (2, 81.0)]
    assert [r.id for r in se.anomalies(entries, 2.0, sample_size=3).collect()] == [2]
    assert [r.id for r in se.anomalies(entries, 2.0, k=1, sample_size=None).collect()] == [3]
    assert se.anomalies_sampled(entries, 2.0).count() == 0  # fewer than ten
    more = table(spark, vectors + [[0, i / 10] for i in range(8)])
    assert [r.id for r in se.anomalies_sampled(more, 2.0, k=50).collect()] == [3, 2]
    assert {r.id for r in se.anomalies_sampled(more, 2.0, k=4).collect()} <= {2, 3}


def recall(hits, want):
    got = as_dict(hits)
    return np.mean([len({i for i, _ in got.get(q, [])} & {i for i, _ in want[q]}) / len(want[q]) for q in want])


def test_inverted_lists(spark, clustered, tmp_path):
    entries = table(spark, clustered)
    queries = se.query_rows(entries)
    want = brute(clustered, clustered, 10)
    lists = se.InvertedLists.build(entries, str(tmp_path / "ivf"), lists=8)
    assert recall(lists.search(queries, 10, probes=3), want) > 0.9
    again = se.InvertedLists.load(spark, str(tmp_path / "ivf"))
    same(as_dict(again.search(queries, 10, probes=8)), want)
    # Only the probed folders are read.
    one = again.search(se.query_vector(spark, clustered[0]), 5, probes=1)
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "list_id" in plan.split("PartitionFilters:")[1].split("]")[0]


@pytest.mark.parametrize("block_rows", [7, 1 << 14])
def test_many_queries_are_joined_with_lists_and_tables(spark, clustered, tmp_path, monkeypatch, block_rows):
    """No query goes through the driver; a third of all rows is in one list."""
    monkeypatch.setattr(se, "MAX_BROADCAST_QUERIES", 5)
    monkeypatch.setattr(index, "BLOCK_ROWS", block_rows)
    entries = table(spark, clustered)
    queries = se.query_rows(entries)
    queries = queries.unionByName(queries.limit(20))  # repeated rows are one query
    want = brute(clustered, clustered, 6)
    lists = se.InvertedLists.create(spark, str(tmp_path / "ivf"), clustered[[0, 120, 200]])
    lists.add(entries)
    same(as_dict(lists.search(queries, 6, probes=3)), want)
    rows = lists.rows().withColumn("bucket", F.col("list_id").cast("long"))
    routed = queries.crossJoin(spark.range(3).select(F.col("id").alias("bucket")))
    same(as_dict(index.join_buckets(routed, rows, 6, block_rows)), want)
    assert recall(se.knn_lsh(entries, queries, 6, width=3.0), want) > 0.9


def test_lists_grow_and_replaced_parts_are_not_found(spark, tmp_path):
    base = str(tmp_path / "ivf")
    lists = se.InvertedLists.create(spark, base, [[0, 0], [10, 10]])
    lists.add(table(spark, [[0, 1], [9, 10]]), "a")
    centres = se.InvertedLists.load(spark, base)
    centres.add(table(spark, [[0, 2], [11, 10]], start=10), "b")
    query = se.query_vector(spark, [0, 0])
    found = lambda parts=None, probes=2: [i for i, _ in as_dict(centres.search(query, 9, probes, parts)).get(0, [])]
    assert found() == [0, 10, 1, 11] and found(probes=1) == [0, 10] and found(["b"]) == [10, 11]
    centres.add(table(spark, [[0, 3]], start=20), "b")
    assert found() == [0, 1, 20] or found() == [0, 20, 1]
    assert found(["gone"]) == [] and centres.centres.tolist() == [[0, 0], [10, 10]]


def test_inverted_lists_of_few_rows_lose_nothing(spark, tmp_path):
    entries = table(spark, [[i] for i in range(5)])
    lists = se.InvertedLists.build(entries, str(tmp_path / "ivf"))
    assert lists.search(se.query_vector(spark, [0]), 10).count() == 5


def test_no_queries_and_no_rows(spark, clustered, tmp_path):
    entries = table(spark, clustered)
    none = se.query_rows(entries).limit(0)
    lists = se.InvertedLists.build(entries, str(tmp_path / "ivf"), lists=4)
    for hits in (se.knn(entries, none, 3), lists.search(none, 3), se.knn_lsh(entries, none, 3), knn_join(none, entries, 3)):
        assert hits.count() == 0
    assert se.knn_lsh(entries.limit(0), se.query_rows(entries), 3).count() == 0


def test_hashing_recall_and_share(spark, clustered, tmp_path):
    entries = table(spark, clustered)
    queries = se.query_rows(entries)
    want = brute(clustered, clustered, 10)
    tables = se.HashTables.build(entries, str(tmp_path / "h"), tables=8, projections=4, width=1.0)
    assert recall(tables.search(queries, 10, probes=4), want) > 0.9
    again = se.HashTables.load(spark, str(tmp_path / "h"))
    hits = again.routed(queries, 4).join(again.rows(), "bucket")
    pairs = hits.select("query_id", "_id").distinct().count()
    # Far from all pairs: a third of the rows is one cluster, so a ninth is needed for it alone.
    assert pairs < 0.35 * len(clustered) ** 2
    scaled = [[float(x) * 1000 for x in v] for v in clustered]
    moved = se.HashTables.build(table(spark, scaled), str(tmp_path / "h2"), tables=8, projections=4, width=1.0)
    assert np.allclose(moved.widths, 1000 * tables.widths, rtol=1e-3)


@pytest.mark.parametrize("kind", ["flatl2", "ivfflat", "hnsw"])
def test_store_search_by_index_type(spark, tmp_path, kind):
    rng = np.random.default_rng(1)
    vectors = rng.normal(size=(150, 4)).astype(np.float32)
    flows = table(spark, vectors).withColumn("first_seq", F.col("_id")).drop("_id")
    store = FlowStore(spark, str(tmp_path / kind), 4, kind)
    store.append(flows.drop("protocol"))
    query = se.query_vector(spark, vectors[7])
    for _ in range(2):
        hits = se.indexed_search(FlowStore.load(spark, store.base), query, 1)
        assert [(r.id, r.distance) for r in hits.collect()] == [(7, 0.0)]
    # Rows added later are found, rows that are replaced are not, and ids stay when parts are joined.
    late = table(spark, [vectors[7] + 9], start=500).withColumn("first_seq", F.col("_id")).drop("_id", "protocol")
    store.append(late)
    far = se.query_vector(spark, vectors[7] + 9)
    assert [(r.id, r.distance) for r in se.indexed_search(store, far, 1).collect()] == [(150, 0.0)]
    other = table(spark, [vectors[7] - 9], start=500).withColumn("first_seq", F.col("_id")).drop("_id", "protocol")
    store.append(other, batch_id=1)
    near = se.indexed_search(store, se.query_vector(spark, vectors[7] - 9), 1).collect()
    assert [(r.id, r.distance) for r in near] == [(150, 0.0)]
    assert all(r.distance > 1 for r in se.indexed_search(store, far, 200).collect())
    assert kind == "flatl2" or store.index_trained()


def test_context_text(spark):
    entries = spark.createDataFrame(
        [(0, [0.0], ("1.1.1.1", None, "2.2.2.2", 80, 6), (1.0005, 20.0, 2.0), ("TCP", "HTTP"))],
        "_id long, embedding array<float>, "
        "flow_id struct<src_ip:string,src_port:int,dst_ip:string,dst_port:int,protocol:int>, "
        "statistical struct<flow_duration:double,total_bytes:double,packet_count:double>, "
        "protocol struct<proto:string,app_proto:string>",
    )
    text = se.rag_context(entries, se.query_vector(spark, [0.5]), 5).first().context
    assert text.split("\n") == [
        "Here are the most relevant network flows:", "Flow 1:",
        "  - Connection: 1.1.1.1:None → 2.2.2.2:80", "  - Protocol: TCP / HTTP",
        "  - Duration: 1.001s", "  - Total bytes: 20", "  - Packets: 2", "  - Similarity score: 0.2500",
    ]
    none = se.rag_context(entries.limit(0), se.query_vector(spark, [0.5]), 5).first().context
    assert none == "No relevant flows found in the database."
