import numpy as np
import pytest

from flowspark.operators import learning as ln
from flowspark.operators.ids import dense_ids, numbered, offsets
from pyspark.sql import functions as F


def table(spark, vectors, labels):
    rows = [(i, [float(x) for x in v], l) for i, (v, l) in enumerate(zip(vectors, labels))]
    return spark.createDataFrame(rows, "id long, embedding array<float>, label string").repartition(3)


@pytest.fixture(scope="module")
def sample():
    rng = np.random.default_rng(3)
    labels = ["big"] * 30 + ["a"] * 10 + ["b"] * 9 + ["lone"]
    centre = {"big": 0, "a": 4, "b": -4, "lone": 9}
    vectors = np.array([centre[l] + rng.normal(size=3) for l in labels], np.float32)
    return vectors, labels


def test_dense_ids(spark):
    rows = [(x * 7919 % 1009, x % 3 if x % 5 else None) for x in range(300)]
    df = spark.createDataFrame(rows, "v long, g int").repartition(7)
    got = dense_ids(df, ["v"], "n", start=100).orderBy("v").collect()
    assert [r.n for r in got] == list(range(100, 400))
    inside = dense_ids(df, ["v"], "n", partition=["g"]).collect()
    for group in (None, 0, 1, 2):
        own = sorted((r.v, r.n) for r in inside if r.g == group)
        assert [n for _, n in own] == list(range(len(own))) and own
    assert dense_ids(df.limit(0), ["v"], "n").count() == 0


def test_dense_ids_gather_no_rows(spark):
    """One task only ever sees a row for each range, whatever the values of the key."""
    df = spark.range(5000).select(F.xxhash64("id").alias("v"))
    rows = numbered(df, ["v"])
    parts = rows.select("_part").distinct().count()
    plan = offsets(rows)._jdf.queryExecution().executedPlan().toString()
    single = plan[plan.index("SinglePartition"):]
    assert "HashAggregate" in single and parts <= 2
    assert [r.n for r in dense_ids(df, ["v"], "n").orderBy("v").collect()] == list(range(5000))


def test_label_index_is_sorted(spark, sample):
    rows = ln.label_index(table(spark, *sample)).orderBy("label_idx").collect()
    assert [(r.label, r.label_idx) for r in rows] == [("a", 0), ("b", 1), ("big", 2), ("lone", 3)]


def test_label_groups(spark, sample):
    groups = {(r.label_idx, r.part): r.ids for r in ln.label_groups(table(spark, *sample)).collect()}
    assert groups[(2, 0)] == list(range(30)) and groups[(3, 0)] == [49]
    split = ln.label_groups(table(spark, *sample), width=8).where("label_idx = 2").orderBy("part").collect()
    assert sum([r.ids for r in split], []) == list(range(30)) and len(split) == 4


@pytest.mark.parametrize("per_copy", [4096, 2])
def test_triplets(spark, sample, monkeypatch, per_copy):
    monkeypatch.setattr(ln, "ANCHORS_PER_COPY", per_copy)
    labels = sample[1]
    rows = ln.triplets(table(spark, *sample)).collect()
    assert sorted(r.id for r in rows) == list(range(50))
    for r in rows:
        assert labels[r.pos_id] == labels[r.id] and labels[r.neg_id] != labels[r.id]
        assert (r.pos_id == r.id) == (labels[r.id] == "lone")


def test_one_label_only(spark):
    rows = table(spark, [[0.0], [1.0], [3.0]], ["x"] * 3)
    got = ln.triplets(rows, carry=["embedding"])
    assert all(r.neg_id == r.id != r.pos_id for r in got.collect())
    assert ln.triplet_loss(got).first().loss >= 0.5
    with pytest.raises(ValueError):
        ln.silhouette_exact(rows, "label")


def scores(vectors, labels):
    """The textbook formulas, on the driver."""
    v, names = np.asarray(vectors, float), sorted(set(labels))
    labels = np.array(labels)
    centre = {n: v[labels == n].mean(0) for n in names}
    spread = {n: np.linalg.norm(v[labels == n] - centre[n], axis=1).mean() for n in names}
    db = np.mean([
        max((spread[i] + spread[j]) / np.linalg.norm(centre[i] - centre[j]) for j in names if j != i)
        for i in names
    ])
    n, k = len(v), len(names)
    ssb = sum((labels == c).sum() * ((centre[c] - v.mean(0)) ** 2).sum() for c in names)
    ssw = sum(((v[labels == c] - centre[c]) ** 2).sum() for c in names)
    d = np.linalg.norm(v[:, None] - v[None], axis=2)
    s = []
    for i in range(n):
        own = (labels == labels[i]).sum()
        if own == 1:
            s.append(0.0)
            continue
        a = d[i, labels == labels[i]].sum() / (own - 1)
        b = min(d[i, labels == c].mean() for c in names if c != labels[i])
        s.append((b - a) / max(a, b))
    return db, (ssb / (k - 1)) / (ssw / (n - k)), np.mean(s)


@pytest.mark.parametrize("block_rows", [16384, 11])
def test_cluster_scores(spark, sample, block_rows):
    rows = table(spark, *sample)
    db, ch, silhouette = scores(*sample)
    got = ln.silhouette_exact(rows, "label", block_rows=block_rows).first().silhouette
    assert got == pytest.approx(silhouette, abs=1e-9)
    assert ln.davies_bouldin(rows, "label").first().davies_bouldin == pytest.approx(db)
    assert ln.calinski_harabasz(rows, "label").first().calinski_harabasz == pytest.approx(ch)


def test_silhouette_kernel_holds_few_distances(spark, monkeypatch):
    """A block's kernel takes little memory beside the block, also with a label for each row."""
    import tracemalloc

    import pandas as pd

    kept = {}

    def block_matrix(left, right, kernel, *rest):
        kept["kernel"] = kernel
        return left.sparkSession.createDataFrame([], "id long, cluster string, other string, total double, n long")

    monkeypatch.setattr(ln, "block_matrix", block_matrix)
    ln.silhouette_exact(table(spark, [[0.0], [1.0]], ["a", "b"]), "label")
    rng = np.random.default_rng(1)
    n = 8192
    block = pd.DataFrame({"id": range(n), "cluster": [str(i % 10) for i in range(n)],
                          "v": list(rng.normal(size=(n, 4)).astype(np.float32))})
    tracemalloc.start()
    got = kept["kernel"](block, block)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 64e6  # the distances of 1,024 rows alone would be 67 MB
    v = np.stack(block["v"]).astype(float)
    for row in (0, 4711):
        d = np.linalg.norm(v - v[row], axis=1)
        own = got[got["id"] == row].set_index("other")
        for name in "07":
            members = (block["cluster"] == name).to_numpy()
            assert own.loc[name, "total"] == pytest.approx(d[members].sum())
            assert own.loc[name, "n"] == members.sum()


def test_kmeans_finds_clear_clusters(spark, sample):
    rows = ln.kmeans(table(spark, *sample).where("label <> 'lone'"), k=3, starts=2)
    per_label = rows.groupBy("label").agg(F.countDistinct("cluster").alias("n")).collect()
    assert all(r.n == 1 for r in per_label)
    xy = ln.reduce_2d(rows)
    assert xy.columns == ["id", "x", "y"] and xy.count() == 49


def test_rows_without_a_label_are_normal(spark):
    from flowspark.operators.learning import label_index, with_label_index

    rows = spark.createDataFrame([(1, "scan"), (2, None), (3, "normal")], "id long, label string")
    found = {r["id"]: (r["label"], r["label_idx"]) for r in with_label_index(rows).collect()}
    assert found == {1: ("scan", 1), 2: ("normal", 0), 3: ("normal", 0)}
    numbers = spark.createDataFrame([(1, 5), (2, None)], "id long, label int")
    assert with_label_index(numbers).count() == label_index(numbers).count() == 2
