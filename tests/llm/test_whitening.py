"""Whitening against plain NumPy and Python integers."""

import math

import numpy as np
import pytest

from flowspark.llm import whitening

SCHEMA = "vec_id long, embedding array<double>, width int, x string, n long"


def plain_version(rows):
    """Of rows (id, vector) of one width: n, deviations, covariance of the distinct vectors."""
    good = [(i, [math.floor(64 * c) + 1000000 for c in v]) for i, v in rows
            if v and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in good})
    n = len(fit)
    sums = [sum(x[j] for x in fit) for j in range(len(fit[0]))]
    deviations = [(i, sum((n * a - s) ** 2 for a, s in zip(x, sums))) for i, x in good]
    exact = [[sum((n * x[a] - sums[a]) * (n * x[b] - sums[b]) for x in fit) / n**3 for b in range(len(sums))]
             for a in range(len(sums))]
    centred = np.array([[(n * a - s) / n for a, s in zip(x, sums)] for _, x in good])
    return n, deviations, np.array(exact), centred


def check(rows, got, components=16):
    n, deviations, covariance, centred = plain_version(rows)
    some = min(components, len(covariance))
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1][:some], vectors[:, ::-1][:, :some]
    assert {r["n"] for r in got} == {n}
    own = sorted((repr(r["vec_id"]), int(r["deviation"])) for r in got if r["component"] == 1)
    assert own == sorted((repr(i), d) for i, d in deviations)
    assert len(got) == len(deviations) * some and {r["component"] for r in got} == set(range(1, some + 1))
    assert max(r["identity_error"] for r in got) < 1e-6
    ids = [repr(i) for i, _ in deviations]
    for k in range(some):
        mine = {repr(r["vec_id"]): r["whitened"] for r in got if r["component"] == k + 1}
        share = {r["explained"] for r in got if r["component"] == k + 1}
        assert len(share) == 1
        assert share.pop() == pytest.approx(max(values[k], 0) / covariance.trace(), rel=1e-9, abs=1e-12)
        want = centred @ vectors[:, k] / math.sqrt(values[k])
        found = np.array([mine[i] for i in ids])
        sign = np.sign(found @ want)
        assert np.allclose(found * sign, want, atol=1e-6)


def vectors(seed, n, width, scale=0.3):
    draw = np.random.default_rng(seed)
    mixed = draw.normal(size=(n, width)) @ np.diag(np.linspace(1, 3, width)) * scale
    return [(i, [float(c) for c in v]) for i, v in enumerate(mixed)]


@pytest.mark.parametrize("width, scale", [(20, 0.3), (3, 0.3), (5, 1e9), (17, 40.0)])
def test_whitening(spark, width, scale):
    rows = vectors(1, 200, width, scale)
    rows += [(1000 + i, v) for i, (_, v) in enumerate(rows[:50])]  # copies are one row of the fit list
    rows += [(900, None), (901, [math.nan] * width), (902, [1.0] * (width - 1) + [math.inf]),
             (903, [None] + [1.0] * (width - 1)), (904, [])]
    df = spark.createDataFrame([(i, v, 1, "x", 2) for i, v in rows], SCHEMA).repartition(5)
    check(rows, whitening.whiten(df).collect())


def test_lengths_apart_and_models_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(whitening, "MODEL_BYTES", 1)
    monkeypatch.setattr(whitening, "BLOCK_ROWS", 7)
    one, two = vectors(2, 60, 4), [(i + 500, v) for i, v in vectors(3, 90, 6)]
    two += [(None, two[0][1]), (501, two[1][1])]
    df = spark.createDataFrame([(i, v, None, None, None) for i, v in one + two], SCHEMA)
    got = whitening.whiten(df).collect()
    first = {i for i, _ in one}
    check(one, [r for r in got if r["vec_id"] in first])
    kept = [r for r in got if r["vec_id"] not in first and r["vec_id"] not in (None, 500, 501)]
    n, deviations, *_ = plain_version(two)
    assert {r["n"] for r in kept} == {n} == {90}
    assert len([r for r in got if r["vec_id"] is None]) == 6 and len([r for r in got if r["vec_id"] == 501]) == 12
    null = [r["deviation"] for r in got if r["vec_id"] is None]
    assert set(map(int, null)) == {dict(deviations)[500]}


def test_no_variance_and_empty(spark):
    same = spark.createDataFrame([(1, [0.5, 0.5]), (2, [0.5, 0.5])], "vec_id int, embedding array<float>")
    got = whitening.whiten(same).collect()
    assert {(r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in got} == {
        (1, 0, 0.0, 0.0, 0.0)} and len(got) == 4
    line = spark.createDataFrame([(i, [float(i), float(i)]) for i in range(9)], "vec_id int, embedding array<float>")
    got = whitening.whiten(line).collect()
    assert {r["whitened"] for r in got if r["component"] == 2} == {0.0}
    assert {round(r["explained"], 9) for r in got if r["component"] == 1} == {1}
    assert whitening.whiten(same.limit(0)).collect() == []
    huge = spark.createDataFrame([(1, [1e300, 0.0]), (2, [-1e300, 1.0])], "vec_id int, embedding array<double>")
    assert len(whitening.whiten(huge).collect()) == 4


@pytest.mark.parametrize("rows, low, high", [(1, 0, 1), (64, -5, 5), (200, 10**6 - 40, 10**6 + 40), (130, -2**62, 2**62)])
def test_cross_products(rows, low, high):
    x = np.random.default_rng(rows).integers(low, high, (rows, 6), np.int64)
    sums, cross = whitening.cross_products(x)
    exact = x.astype(object)
    assert (sums == exact.sum(0)).all()
    upper = np.triu_indices(6)
    assert ((exact.T @ exact)[upper] == cross[upper]).all()


def test_query(spark):
    where = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{where}/embeddings.parquet").select("vec_id", "embedding").collect()
    check([(i, list(v)) for i, v in rows], whitening.op11_whitening(spark, where).collect())
