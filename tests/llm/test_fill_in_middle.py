"""The fill-in-middle transformation against plain Python."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowspark.llm import fill_in_middle as fim

PATTERNS = {
    "line": r"[^\n]*\n|[^\n]+",
    "word": r"[^ \t\r\x0b\x0c\n]*[ \t\r\x0b\x0c\n]|[^ \t\r\x0b\x0c\n]+",
    "sentence": r"[^.!?\n]*[.!?\n]|[^.!?\n]+",
    "clause": r"[^,;:.!?\n]*[,;:.!?\n]|[^,;:.!?\n]+",
}
SCHEMA = "doc_id long, text string, n long, form string, output long"


def plain_version(doc_id, text, unit="line", rate=100, spm=50):
    text = text or ""
    units = re.findall(PATTERNS[unit], text)
    digest = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[i:i + 8], 16) for i in range(0, 32, 8)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return len(units), "plain", None, None, text
    if h[3] % 100 < spm:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def texts():
    draw = random.Random(3)
    pool = ["a", "é", "日本", "\n", " ", ". ", "<", "S>", "x, y", "\t", "😀", "7", "!"]
    made = ["".join(draw.choice(pool) for _ in range(draw.choice([1, 2, 5, 40, 300]))) for _ in range(150)]
    odd = ["", None, "\n", "\n\n\n", "no end", "end\n", "<", "a<\n<S", "has <P> in it\nx", "<M>", "\r\n\r\n",
           "long line " * 20000, "é\n" * 50000, "same", "same"]
    return made + odd


@pytest.mark.parametrize("block", [1, 500, 8 << 20])
@pytest.mark.parametrize("unit", list(PATTERNS))
def test_fill_in_middle(spark, monkeypatch, unit, block):
    monkeypatch.setattr(fim, "BLOCK_BYTES", block)
    rows = [(i, t, 1, "x", 2) for i, t in enumerate(texts())]
    got = fim.fill_in_middle(spark.createDataFrame(rows, SCHEMA), unit)
    got = got.withColumn("again", fim.restored(F.col("output"), F.col("form")))
    found = {r["doc_id"]: r for r in got.collect()}
    assert len(found) == len(rows)
    for i, text, *_ in rows:
        r = found[i]
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) == plain_version(i, text, unit)
        assert r["again"] == (text or "")
    assert {r["form"] for r in found.values()} == {"plain", "psm", "spm"}


def test_shares_and_odd_tables(spark):
    rows = [(i, "one\ntwo\nthree", None, None, None) for i in range(300)]
    rows += [(None, "a\nb", None, None, None), (None, None, None, None, None), (5, "one\ntwo\nthree", 1, "", 1)]
    got = fim.fill_in_middle(spark.createDataFrame(rows, SCHEMA), rate=40, spm=10).collect()
    want = sorted(map(repr, [(i, *plain_version(i, t, rate=40, spm=10)) for i, t, *_ in rows]))
    assert sorted(map(repr, map(tuple, got))) == want
    assert fim.fill_in_middle(spark.createDataFrame([], SCHEMA)).collect() == []
    renamed = spark.createDataFrame([(1, "a\nb")], "doc_id int, body string")
    assert fim.fill_in_middle(renamed, text_column="body").first()["n"] == 2


@pytest.mark.parametrize("marks", [("<P>", "<P>", "<M>"), ("", "b", "c"), ("aba", "x", "y"), ("ab", "bc", "z"), ("a", "xay", "z")])
def test_marks_that_could_not_be_told_apart(spark, marks):
    with pytest.raises(ValueError):
        fim.fill_in_middle(spark.createDataFrame([(1, "t")], "doc_id int, text string"), marks=marks)


def test_wavelet_matrix():
    draw = np.random.default_rng(5)
    for size in (0, 1, 63, 64, 65, 1000):
        codes = draw.integers(0, 7, size).astype(np.uint8)
        matrix = fim.WaveletMatrix(codes)
        at = np.arange(size + 1)
        for code in range(8):
            assert (matrix.rank(code, at) == np.concatenate([[0], np.cumsum(codes == code)])).all()
            places = np.flatnonzero(codes == code)
            if len(places):
                assert (matrix.select(code, np.arange(len(places))) == places).all()
        places = np.flatnonzero(np.isin(codes, (2, 5)))
        if len(places):
            assert (matrix.select_any((2, 5), np.arange(len(places))) == places).all()


def test_query(spark):
    import duckdb

    where = "/root/testdata/sf0.001"
    got = fim.op12_fill_in_middle(spark, where).orderBy("doc_id").toPandas()
    duckdb.execute(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{where}/documents.parquet'")
    want = duckdb.sql(fim.OP12_SQL).df().sort_values("doc_id").reset_index(drop=True)
    assert len(got) == len(want) > 0
    for c in want.columns:
        assert got[c].fillna(-1).tolist() == want[c].fillna(-1).tolist(), c
