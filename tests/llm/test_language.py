"""Language identification: the kernel against sets, and held-out accuracy."""

import pickle
import random
import re
import zlib

import numpy as np
import pytest

from flowspark.llm import language
from flowspark.llm.language import Kernel

SCHEMA = "doc_id long, text string, lang string, score double, place int, `row` string"


def grams(text):
    letters = "".join(c.lower()[0] if c.isalpha() else " " for c in text)
    line = re.sub(" +", " ", f" {letters} ")
    return {line[i:i + n] for n in range(1, language.ORDER + 1) for i in range(len(line) - n + 1)} - {" "}


PIECES = ["Der Hund, der bellt!", "the dog that barks", "ÄÖ über  Straße 12", "日本語 の 犬", "x"]
TEXTS = ["the cat", "", "  ", "12 .", "über den HUND", "日本 the", "ωμέγα", "x", "a\nb\tc", "ﬁne İstanbul"]


@pytest.mark.parametrize("most, table", [(1 << 20, 1 << 22), (5, 1 << 22), (3, 0)])
def test_kernel_equals_sets(monkeypatch, most, table):
    monkeypatch.setattr(language, "BLOCK_CHARS", most)
    monkeypatch.setattr(language, "_TABLE", table)
    monkeypatch.setattr(language, "_COLUMNS", 7)
    kernel = pickle.loads(pickle.dumps(Kernel(PIECES)))
    # Letters that no landmark holds are one class for the kernel.
    known = set(kernel.alphabet)
    seen = ["".join("ጀ" if c.isalpha() and c.lower()[0] not in known else c for c in t) for t in TEXTS]
    blocks = list(kernel.blocks(TEXTS))
    assert [b for b, _ in blocks] == [0, *[e for _, e in blocks[:-1]]] and blocks[-1][1] == len(TEXTS)
    for begin, end in blocks:
        found, letters = kernel.against(TEXTS[begin:end])
        for i in range(begin, end):
            own = grams(seen[i])
            want = [len(own & grams(p)) / max(1, len(own)) ** 0.5 / len(grams(p)) ** 0.5 for p in PIECES]
            assert np.allclose(found[i - begin], want, atol=1e-6), TEXTS[i]
            assert letters[i - begin] == any(c.isalpha() for c in TEXTS[i])


def made(n=240):
    draw = random.Random(4)
    stock = {"aa": "sch ein ung der und ich".split(), "bb": "tion eau les des ent que".split(),
             "cc": "ing the th and ed er".split()}
    rows = []
    for i in range(n):
        name = draw.choice(sorted(stock))
        words = ["".join(draw.choice(stock[name]) for _ in range(draw.randint(1, 3))) for _ in range(draw.randint(2, 60))]
        rows.append((i, " ".join(words), name, 1.0, 1, "r"))
    return rows


def held(i):
    return zlib.crc32(str(i).encode()) % 3 == 1


def test_accuracy_and_held_out_rows(spark):
    rows = made()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = {r["doc_id"]: r for r in language.languages(docs, language.train(docs)).collect()}
    assert all(got[i]["held_out"] == held(i) for i, *_ in rows)
    right = [got[i]["lang_pred"] == lang for i, _, lang, *_ in rows if held(i)]
    assert len(right) > 50 and sum(right) >= 0.97 * len(right)
    assert all(0 <= r["score"] <= 1 for r in got.values())
    # What held-out rows say of their language changes nothing.
    lied = spark.createDataFrame([(i, t, "zz" if held(i) else lang, 1.0, 1, "r") for i, t, lang, *_ in rows], SCHEMA)
    again = {r["doc_id"]: r for r in language.languages(lied, language.train(lied)).collect()}
    assert {i: (r["lang_pred"], round(r["score"], 9)) for i, r in got.items()} == {
        i: (r["lang_pred"], round(r["score"], 9)) for i, r in again.items()}


def test_odd_rows(spark):
    rows = made(60)
    rows += [(None, "der und", "aa", None, None, None), (900, None, "aa", None, None, None), (901, "", None, None, None, None),
             (902, "12 345 !?", "aa", None, None, None), (903, "der und ich sch ", None, None, None, None),
             (904, "ein und der " * 200000, "aa", None, None, None), (1, rows[1][1], rows[1][2], 1.0, 1, "r")]
    docs = spark.createDataFrame(rows, SCHEMA)
    model = language.train(docs)
    got = language.languages(docs, model).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    assert {by[i]["lang_pred"] for i in (900, 901, 902)} == {"und"} and by[900]["score"] == 0
    assert by[903]["lang_pred"] == by[904]["lang_pred"] == by[None]["lang_pred"] == "aa"
    assert by[None]["held_out"] is False
    assert language.train(docs.limit(0)) is None and language.train(docs.where("doc_id > 899")) is not None
    nothing = language.languages(docs, None).select("lang_pred", "score").distinct().collect()
    assert [tuple(r) for r in nothing] == [("und", 0.0)]
    assert language.languages(docs.limit(0), model).collect() == []


def test_query(spark):
    where = "/root/testdata/sf0.01"
    got = language.op13_language(spark, where).toPandas()
    truth = spark.read.parquet(f"{where}/documents.parquet").select("doc_id", "lang").toPandas()
    both = got.merge(truth, on="doc_id")
    assert len(got) == len(truth)
    own = both[both.held_out & both.lang.notna() & (both.lang_pred != "und")]
    assert (own.lang == own.lang_pred).mean() > 0.97
