"""The pipeline, stage by stage against plain Python, and the registered queries on small tables."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F
from test_operators import brute_contamination, grouped_lines, links, words

import corpus_pipeline
from flowspark.llm import queries, toxicity
from flowspark.llm.common import kept

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def made():
    draw = random.Random(31)
    stock = ["".join(draw.choice("abcdefghijklmno") for _ in range(draw.randint(3, 8))) for _ in range(300)]
    say = lambda n: " ".join(draw.choice(stock) for _ in range(n))
    test = say(14)
    texts = []
    for i in range(70):
        lines = [say(draw.randint(6, 14)) for _ in range(4)]
        if i % 4 == 0:
            lines[1] = "vile rotten scum " + lines[1]
        texts.append("\n".join(lines))
    texts += [texts[5], texts[5] + "\nmenu", texts[9].replace(texts[9].split(" ")[7], "qqq"), "menu\n" + say(10)]
    texts += [say(5) + "\n" + test + "\n" + say(5), "menu", "", None]
    docs = [(i, t, "en", f"s{i % 2}", len(t or "")) for i, t in enumerate(texts)]
    labels = [(i, 0, int(i % 4 == 0)) for i in range(70)]
    return docs, labels, [(1, test), (2, "not in any"), (3, None)]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    where = str(tmp_path_factory.mktemp("tables"))
    docs, labels, tests = made()
    for name, rows, schema in (("documents", docs, SCHEMA), ("labels", labels, "doc_id long, quality int, toxic int"),
                               ("benchmark", tests, "item_id long, text string")):
        spark.createDataFrame(rows, schema).repartition(2).write.parquet(f"{where}/{name}.parquet")
    vectors = [(i, [float(x) for x in random.Random(i).choices(range(-9, 9), k=6)], 0) for i in range(250)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").write.parquet(f"{where}/embeddings.parquet")
    return where


def test_stages(spark, tables):
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "line_dedup", "near_duplicates", "decontamination", "packing"]
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    labels = spark.read.parquet(f"{tables}/labels.parquet")
    before = {r["doc_id"]: r for r in docs.collect()}

    clean = kept(stages["toxicity"](spark, docs, tables))
    scored = toxicity.score_documents(docs, toxicity.trained(docs.select("doc_id", "text"), labels.select("doc_id", "toxic")))
    want = {r["doc_id"] for r in scored.where("predicted = 0").collect()}
    after = {r["doc_id"]: r for r in clean.collect()}
    assert clean.columns == COLUMNS and set(after) == want
    assert all(after[i] == before[i] for i in after)

    lines = kept(stages["line_dedup"](spark, clean, tables))
    gone = grouped_lines([(i, r["text"] or "") for i, r in after.items()])
    own = {r["doc_id"]: r for r in lines.collect()}
    assert lines.columns == COLUMNS and set(own) == set(after)
    for i, r in own.items():
        text = after[i]["text"]
        left = None if text is None else "\n".join(x for k, x in enumerate(text.split("\n")) if k not in gone[i])
        assert r["text"] == left and r["n_chars"] == (len(left) if gone[i] else after[i]["n_chars"])
    assert sum(map(len, gone.values())) > 5

    single = kept(stages["near_duplicates"](spark, lines, tables))
    roots = {i: root for i, (_, root) in links({i: r["text"] for i, r in own.items()}, 5, 80).items()}
    assert single.columns == COLUMNS and {r["doc_id"] for r in single.collect()} == {i for i in own if roots[i] == i}

    kept_docs = kept(stages["decontamination"](spark, single, tables))
    texts = {r["doc_id"]: r["text"] for r in single.collect()}
    hit = brute_contamination(texts, [tuple(r) for r in spark.read.parquet(f"{tables}/benchmark.parquet").collect()])
    assert {r["doc_id"] for r in kept_docs.collect()} == {i for i in texts if not hit[i][4]} and any(h[4] for h in hit.values())

    packed = stages["packing"](spark, kept_docs, tables)
    lengths = {r["doc_id"]: (r["doc_tokens"], r["s"]) for r in packed.groupBy("doc_id").agg(
        F.max("doc_tokens").alias("doc_tokens"), F.sum("length").alias("s")).collect()}
    assert set(lengths) == {r["doc_id"] for r in kept_docs.collect()} and all(a == b for a, b in lengths.values())
    whole = corpus_pipeline.run(spark, tables).drop("ids")
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    assert sorted(map(tuple, whole.select(columns).collect())) == sorted(map(tuple, packed.select(columns).collect()))


@pytest.mark.parametrize("name", [s for s, _ in corpus_pipeline.STAGES])
def test_stages_of_odd_and_empty_tables(spark, tables, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    empty = spark.createDataFrame([], SCHEMA)
    assert stage(spark, empty, tables).collect() == []
    rows = [(None, "some line", None, None, None), (901, None, None, None, None), (902, "", "x", "y", 0),
            (903, "a line that is here twice", "x", "y", 25), (903, "a line that is here twice", "x", "y", 25),
            (904, "z " * 60000, "x", "y", 120000)]
    out = stage(spark, spark.createDataFrame(rows, SCHEMA), tables)
    found = sorted({str(r["doc_id"]) for r in out.collect()})
    assert found == ["901", "902", "903", "904", "None"]


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_registered_queries_run_on_small_tables(spark, tables, name):
    """What each thin query returns for every row; the operators have tests of their own."""
    rows = queries.QUERIES[name][0](spark, tables).collect()
    docs, *_ = made()
    if name in ("op7_nearest", "op11_whitening"):
        queries_at = {i for i in range(250) if i % 100 == 0}
        assert {r["query_id"] for r in rows} == queries_at if name == "op7_nearest" else len(rows) == 250 * 6
        return
    assert {r["doc_id"] for r in rows} == {i for i, *_ in docs}
    if name != "op1_packing":
        assert len(rows) == len(docs)
    by = {r["doc_id"]: r for r in rows}
    text = {i: t or "" for i, t, *_ in docs}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    if name == "op2_decontaminate":
        assert [by[i]["n_words"] for i in text] == [len(words(t)) for t in text.values()]
    if name == "op4_suffix_dedup":
        assert [by[i]["n_bytes"] for i in text] == [len(t.encode()) for t in text.values()]
    if name == "op6_jaccard_join":
        assert {i: (r["n_shingles"], r["component_id"]) for i, r in by.items()} == links(text, 4, 85)
    if name == "op9_line_dedup":
        gone = grouped_lines(list(text.items()))
        assert {i: r["places_removed"] for i, r in by.items()} == gone
        assert all(by[i]["kept_sha256"] == sha("\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[i]))
                   for i, t, *_ in docs if t is not None)
    if name == "op12_fill_in_middle":
        assert [by[i]["restored_sha256"] for i in text] == [sha(t) for t in text.values()]
