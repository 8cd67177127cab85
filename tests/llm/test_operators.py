"""The operators on documents against brute force, and their results for odd tables."""

import hashlib
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from flowspark.llm import (
    decontaminate, jaccard_join, licenses, line_dedup, nearest, packing, suffix_dedup, token_counts,
    toxicity, unit_dedup,
)

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n long, id long, bucket string"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words(text):
    return WORD.findall((text or "").translate(LOW))


def corpus(seed=1):
    """Texts with copies, near copies, shared passages, odd bytes and very long ones."""
    draw = random.Random(seed)
    stock = ["".join(draw.choice("abcdefgéñ") for _ in range(draw.randint(2, 9))) for _ in range(400)]

    def text(n):
        return "".join(draw.choice(stock) + draw.choice([" ", " ", " ", ", ", ".\n"]) for _ in range(n)).strip()

    texts = [text(draw.choice([1, 3, 8, 30, 120])) for _ in range(40)]
    base = text(150)
    texts += [base] * 6
    for _ in range(8):  # near copies
        near = base.split(" ")
        near[draw.randrange(len(near))] = "changed"
        texts.append(" ".join(near))
    passage = text(60)
    texts += [text(20) + "\n" + passage + "\n" + text(20) for _ in range(4)]
    texts += ["", None, " \n\t ", "The MIT License, CC BY-NC; the Apache  License", "ab" * 3000, "x", text(6000)]
    return texts


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, None, "s", None, 1, 2, "b") for i, t in enumerate(corpus())]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls everywhere and repeated rows."""
    line = "one line of words that is repeated here and there"
    rows = [
        (None, line, None, None, None, None, None, None), (1, None, None, None, None, None, None, None),
        (2, line, "en", "s", 3, 1, 1, "b"), (2, line, "en", "s", 3, 1, 1, "b"), (3, "", None, None, None, None, None, None),
        (None, None, None, None, None, None, None, None), (4, line, None, None, None, None, None, None),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_packing(docs):
    from tokenizers import Tokenizer

    encoder = Tokenizer.from_file(packing.vocabulary())
    pieces = packing.pack(docs, size=64).collect()
    texts = dict(docs.select("doc_id", "text").collect())
    by_doc, by_sequence = {}, {}
    for p in pieces:
        by_doc.setdefault(p["doc_id"], []).append(p)
        by_sequence.setdefault(p["sequence_id"], []).append(p)
        assert p["length"] == len(p["ids"]) > 0
        assert p["ids_crc32"] == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in p["ids"]))
    for i, text in texts.items():
        ids = encoder.encode(text or "", add_special_tokens=False).ids + [2]
        own = sorted(by_doc[i], key=lambda p: p["start"])
        assert [x for p in own for x in p["ids"]] == ids
        assert {p["doc_tokens"] for p in own} == {len(ids)}
        assert [p["start"] for p in own] == [sum(q["length"] for q in own[:k]) for k in range(len(own))]
    sizes = []
    for s in sorted(by_sequence):
        own = sorted(by_sequence[s], key=lambda p: p["offset"])
        assert [p["offset"] for p in own] == [sum(q["length"] for q in own[:k]) for k in range(len(own))]
        sizes.append(sum(p["length"] for p in own))
    full = sum(sizes) // 64
    assert sizes[:full] == [64] * full and all(n & (n - 1) == 0 for n in sizes)


@pytest.mark.parametrize("text", ["don't STOP 'll ''s", "a\x1cb c\x85d e", "ÀÉ ß Σας İ ﬁ é", "x<|endoftext|>y <|z", "日本 語"])
def test_word_ids_equal_the_tokenizer(text):
    from tokenizers import Tokenizer

    from flowspark.llm.word_ids import word_ids

    encoder = word_ids(packing.vocabulary())
    packed = encoder.of([text.encode(), None])
    ids = [int.from_bytes(packed[0][i:i + 2], "little") for i in range(0, len(packed[0]), 2)]
    assert ids == Tokenizer.from_file(packing.vocabulary()).encode(text, add_special_tokens=False).ids
    assert packed[1] == b""


def brute_contamination(texts, items, n=10):
    found = {}
    for i, text in texts.items():
        own, hit, names = words(text), set(), set()
        for name, item in items:
            w = words(item)
            for k in range(max(1, len(w) - n + 1) if w else 0):
                window = w[k:k + n]
                for s in range(len(own) - len(window) + 1):
                    if own[s:s + len(window)] == window:
                        hit.update(range(s, s + len(window)))
                        names.add(str(name))
        digest = hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
        found[i] = (len(own), len(hit), len(names), digest, bool(hit))
    return found


@pytest.mark.parametrize("block", [1, 1 << 20])
def test_contamination(spark, docs, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block)
    texts = {i: t for i, t in docs.select("doc_id", "text").collect() if len(t or "") < 5000}
    some = [words(texts[i]) for i in (3, 41, 50, 60)]
    items = [(10, " ".join(some[1][20:60])), (9, " ".join(some[3][15:40]).upper()), (2, "x"), (3, None), (4, ""),
             (5, " ".join(some[1][50:90])), (9, "nowhere at all")]
    tests = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contamination(docs.where(F.col("doc_id").isin(list(texts))), tests)
    want = brute_contamination(texts, items)
    rows = by_id(got)
    assert {i: tuple(rows[i])[1:6] for i in rows} == want
    assert all(sum(s["length"] for s in r["spans"]) == r["n_hit"] for r in rows.values())


def test_phrases_and_proximity(spark, docs):
    index = decontaminate.build_index(docs, segment_bytes=2000)
    texts = {i: words(t) for i, t in docs.select("doc_id", "text").collect()}
    asked = texts[41][30:34]
    queries = spark.createDataFrame([(1, " ".join(asked)), (2, ""), (3, None)], "q int, text string")
    got = {tuple(r) for r in decontaminate.find(index, queries).collect()}
    assert got == {(1, i, s, 4) for i, w in texts.items() for s in range(len(w) - 3) if w[s:s + 4] == asked}
    turned = spark.createDataFrame([(1, " ".join(reversed(asked)))], "q int, text string")
    near = {(r["doc_id"], r["start"]) for r in decontaminate.find(index, turned, within=4).collect()}
    assert near >= {(i, s) for _, i, s, _ in got}
    assert all(sorted(texts[i][s:s + 4]) == sorted(asked) for i, s in near)


def test_strings(docs):
    rows = by_id(suffix_dedup.dedup_strings(docs))
    seen, removed = set(), 0
    for i, text in sorted(docs.select("doc_id", "text").collect()):
        data = (text or "").encode()
        cover = bytearray(len(data))
        for s in range(len(data) - 99):
            if data[s:s + 100] in seen:
                cover[s:s + 100] = b"\1" * 100
            seen.add(data[s:s + 100])
        runs = len(re.findall(rb"\x01+", bytes(cover)))
        want = (len(data), sum(cover), runs, bytes(b for b, c in zip(data, cover) if not c))
        assert (rows[i]["n_bytes"], rows[i]["n_removed"], rows[i]["n_spans"], bytes(rows[i]["kept"])) == want
        removed += sum(cover)
    assert removed > 5000


def test_strings_across_pieces(docs, monkeypatch):
    """The same when texts are looked at in small pieces."""
    whole = {i: r["n_removed"] for i, r in by_id(suffix_dedup.dedup_strings(docs)).items()}
    monkeypatch.setattr(suffix_dedup, "PIECE", 2000)
    assert {i: r["n_removed"] for i, r in by_id(suffix_dedup.dedup_strings(docs)).items()} == whole


@pytest.mark.parametrize("run_words", [1, 16])
@pytest.mark.parametrize("unit", ["line", "paragraph"])
def test_units(docs, unit, run_words):
    mark = {"line": "\n", "paragraph": "\n\n"}[unit]
    rows, seen = by_id(unit_dedup.dedup_units(docs, unit, run_words)), set()
    removed = 0
    for i, text in sorted(docs.select("doc_id", "text").collect()):
        parts = [] if text is None else text.split(mark)
        runs, run, repeated = [], [], 0
        for place, part in enumerate(parts):
            key = " ".join(words(part))
            if key in seen and key:
                run.append(place)
                repeated += 1
            elif key:
                runs.append(run)
                run = []
            seen.add(key)
        gone = {p for r in [*runs, run] if sum(len(words(parts[p])) for p in r) >= run_words for p in r}
        removed += len(gone)
        kept = [part for place, part in enumerate(parts) if place not in gone]
        assert rows[i]["text"] == (None if text is None else mark.join(kept))
        assert (rows[i]["n_units"], rows[i]["n_repeated"], rows[i]["n_removed"]) == (len(parts), repeated, len(gone))
        assert [s["place"] for s in rows[i]["spans"]] == sorted(gone)
        for s in rows[i]["spans"]:
            assert text.encode()[s["start"]:s["start"] + s["length"]].decode() == parts[s["place"]]
    assert removed


def links(texts, width, percent):
    sets = {}
    for i, text in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
        sets[i] = {tuple(w[k:k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()
    root = {i: i for i in sets}

    def find(i):
        return i if root[i] == i else find(root[i])

    for i in sets:
        for j in sets:
            if i < j and sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize("width, percent", [(4, 85), (5, 80), (2, 50)])
def test_jaccard(docs, width, percent):
    texts = dict(docs.select("doc_id", "text").collect())
    rows = by_id(jaccard_join.jaccard_components(docs, width, percent))
    assert {i: tuple(r)[1:] for i, r in rows.items()} == links(texts, width, percent)


def test_block_keys_keep_every_close_pair():
    import numpy as np

    draw = np.random.default_rng(2)
    for _ in range(300):
        n, percent = int(draw.integers(1, 400)), int(draw.choice([50, 80, 85]))
        a = np.unique(draw.integers(0, 1 << 63, n, dtype=np.uint64))
        lost = int(draw.integers(0, len(a) * (100 - percent) // 100 + 1))
        b = a[lost:]
        if len(b) and 100 * len(b) >= percent * len(a):
            keys = [set(jaccard_join.block_keys(x, percent).tolist()) for x in (a, np.sort(b))]
            assert keys[0] & keys[1]
            apart = sum(bin(int(x) & (1 << 64) - 1).count("1") for x in jaccard_join.bit_sketch(a) ^ jaccard_join.bit_sketch(b))
            assert apart <= lost


def test_nearest(spark):
    import numpy as np

    draw = np.random.default_rng(4)
    data = draw.standard_normal((600, 24)).astype(np.float32)
    data[100:140] = data[0]
    rows = [(i, v.tolist()) for i, v in enumerate(data)]
    rows += [(1000, None), (1100, [0.0] * 24), (1200, [float("nan")] * 24), (1300, [None] * 24), (1400, [1.0]), (100, data[100].tolist())]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got, hit = {}, 0
    for r in nearest.neighbours(table, "vec_id % 100 = 0", k=10).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert sorted(got) == list(range(0, 600, 100))
    for q, found in got.items():
        far = np.sqrt(((data.astype(np.float64) - data[q]) ** 2).sum(axis=1))
        want = [i for i in np.lexsort((np.arange(600), far)) if i != q][:10]
        assert [r for r, _, _ in sorted(found)] == list(range(1, 11))
        assert all(abs(far[v] - s) < 1e-9 for _, v, s in found)
        hit += len(set(want) & {v for _, v, _ in found})
    assert hit >= 0.9 * 60
    assert [v for _, v, _ in sorted(got[0])] == list(range(100, 110))
    assert nearest.neighbours(table.limit(0), "vec_id % 100 = 0").count() == 0


def test_nearest_does_not_broadcast_routed_queries(spark, monkeypatch):
    """A query goes to many lists: what small tables make small must not pass through the driver."""
    plans, written = [], nearest.kept

    def kept(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return written(df)

    monkeypatch.setattr(nearest, "kept", kept)
    draw = random.Random(3)
    rows = [(i, [draw.random() for _ in range(8)]) for i in range(300)]
    found = nearest.neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), "vec_id % 5 = 0", k=3)
    assert found.count() == 180
    (plan,) = [p for p in plans if "MapInArrow" in p]
    joined = plan[plan.index("MapInArrow"):].split("\n")
    assert next(x for x in joined if "Join" in x and "list" in x).strip(" :+-").startswith("SortMergeJoin")


def test_licenses(docs, spark):
    rows = by_id(licenses.scan(docs))
    for i, text in docs.select("doc_id", "text").collect():
        w, places, labels = words(text), [], set()
        for phrase, label in licenses.BASE.items():
            p = phrase.split()
            own = [s for s in range(len(w) - len(p) + 1) if w[s:s + len(p)] == p]
            places += own
            labels |= {label} if own else set()
        assert tuple(rows[i])[1:6] == (
            len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)))
    tagged = spark.createDataFrame(
        [(1, "// SPDX-License-Identifier: (MIT OR GPL-2.0-only WITH Classpath-exception-2.0) AND BSD-3-Clause\nx")],
        "doc_id int, text string")
    row = licenses.scan(tagged).first()
    assert "permissive" in row["labels"] and "spdx-gpl-2.0-only" in row["labels"] and row["n_base"] == 0


@pytest.mark.parametrize("expression, duties", [
    ("MIT", 0), ("MIT AND GPL-3.0", 2), ("MIT OR GPL-3.0", 0), ("MIT AND (GPL-2.0 OR MPL-2.0)", 1),
    ("GPL-2.0 WITH x-exception AND MIT", 1), ("(MIT", None), ("AND MIT", None), ("", None), ("MIT)", 0)])
def test_expressions(expression, duties):
    found = licenses.evaluate(expression)
    assert (found and found[1]) == duties


def test_line_dedup(spark):
    draw = random.Random(8)
    stock = ["".join(draw.choice("abcdefghij") for _ in range(draw.randint(3, 10))) for _ in range(3000)]
    lines = [" ".join(draw.choice(stock) for _ in range(40)) for _ in range(30)]
    near = [" ".join(w for k, w in enumerate(x.split()) if k != 7) for x in lines[:10]]
    texts = [(i, "\n".join([lines[i % 30], "short one", lines[(i + 1) % 30].upper()])) for i in range(40)]
    texts += [(100 + i, x) for i, x in enumerate(near)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    rows = by_id(line_dedup.dedup_lines(docs))
    seen, fuzzy = set(), 0
    for i, text in texts[:40]:
        gone = []
        for k, line in enumerate(text.split("\n")):
            if len(line.split()) >= 5 and line.lower() in seen:
                gone.append(k)
            seen.add(line.lower())
        assert rows[i]["places_removed"] == gone
        assert rows[i]["text"] == "\n".join(x for k, x in enumerate(text.split("\n")) if k not in gone)
    fuzzy = sum(rows[100 + i]["n_removed"] for i in range(10))
    assert fuzzy >= 5  # one word of forty is missing; most SimHashes stay within three bits
    plan = line_dedup.dedup_lines(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def test_line_recall(spark):
    """Pairs of lines that are alike by brute force: one word, several words, single letters."""
    draw = random.Random(12)
    stock = ["".join(draw.choice("abcdefghijklmno") for _ in range(draw.randint(2, 10))) for _ in range(2000)]
    pairs = []
    for i in range(300):
        line = [draw.choice(stock) for _ in range([6, 12, 20, 40][i % 4])]
        near, left = list(line), len(" ".join(line)) // 10
        for _ in range(1 if i % 3 == 0 else 30):
            k = draw.randrange(len(near))
            if i % 3 < 2 and len(near[k]) <= left:
                left -= len(near[k])
                near[k] = "".join(draw.choice("pqrst") for _ in near[k])
            elif i % 3 == 2 and draw.random() < 0.12 * len(near) / 30:
                near[k] = near[k][:1] + "x" + near[k][2:]
        a, b = " ".join(line), " ".join(near)
        if a != b and edit_distance(a, b) <= max(len(a), len(b)) // 10:
            pairs.append((a, b))
    rows = [(k * 1000 + i, x) for i, pair in enumerate(pairs) for k, x in enumerate(pair)]
    got = by_id(line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")))
    assert len(pairs) > 200 and not any(got[i]["n_removed"] for i in range(len(pairs)))
    assert sum(got[1000 + i]["n_removed"] for i in range(len(pairs))) >= 0.97 * len(pairs)


def test_short_lines_and_lines_without_blanks(spark, tmp_path):
    """Of the query: all copies of non-blank lines go. Of the function: blanks are not needed."""
    draw = random.Random(4)
    odd = ["".join(chr(draw.randrange(0x4E00, 0x9000)) for _ in range(90)), "tab\tand\tmany\tmore\tcolumns",
           "no\u00a0break\u00a0blanks\u00a0are\u00a0here", "https://example.org/" + "abcdefghij/" * 8]
    short = ["menu", "read more", "x", "\u4e00\u4e8c"]
    texts = ["\n".join([*odd, "", *short, "  "])] * 3
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    rows = by_id(line_dedup.op9_line_dedup(spark, str(tmp_path)))
    assert [rows[i]["places_removed"] for i in range(3)] == [[], *[[0, 1, 2, 3, 5, 6, 7, 8]] * 2]
    rows = by_id(line_dedup.dedup_lines(docs))
    assert [rows[i]["places_removed"] for i in range(3)] == [[], *[[0, 1, 2, 3]] * 2]


def test_long_lines(spark):
    """Beyond 4,000 characters: other order of the words is unlike, a letter in many words is alike."""
    draw = random.Random(9)
    line = ["".join(draw.choice("abcdefghijklmno") for _ in range(draw.randint(3, 9))) for _ in range(800)]
    mixed = draw.sample(line, len(line))
    other = ["".join(draw.choice("abcdefghijklmno") for _ in range(draw.randint(3, 9))) for _ in range(800)]
    changed = [w[:1] + "x" + w[2:] if k % 8 == 0 else w for k, w in enumerate(other)]
    rows = [(i, " ".join(x)) for i, x in enumerate([line, mixed, other, changed])]
    assert all(len(x) > 4000 for _, x in rows)
    got = by_id(line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")))
    assert [got[i]["n_removed"] for i in range(4)] == [0, 0, 0, 1]


def test_simhash_is_the_majority_of_bits(spark):
    draw = random.Random(5)
    rows = [(i, 1 + i % 8, [draw.getrandbits(64) - (1 << 63) if k <= i % 8 else 0 for k in range(8)]) for i in range(120)]
    got = spark.createDataFrame(rows, "id long, n int, hashes array<long>").select(
        "id", line_dedup.simhash([F.get("hashes", F.lit(i)) for i in range(8)], F.col("n")).alias("h")).collect()
    by = {r["id"]: r["h"] & (1 << 64) - 1 for r in got}
    for i, n, hashes in rows:
        assert by[i] == sum(1 << j for j in range(64) if 2 * sum(h >> j & 1 for h in hashes[:n]) > n)


def test_sketches_share_a_block(spark):
    """One word in the middle changed or gone leaves a fifth of the blocks, at every length; so
    does one letter without blanks."""
    draw = random.Random(6)
    rows, n = [], 0
    for size in [*range(5, 60), 200, 3000]:
        words = ["".join(draw.choice("abcdefgh") for _ in range(7)) for _ in range(size)]
        k = size // 2
        one = " ".join(words)
        for other in (" ".join([*words[:k], "other", *words[k + 1:]]), " ".join(words[:k] + words[k + 1:])):
            rows += [(n, one), (n + 1, other)]
            n += 2
    for alphabet in ("abcdefghijkl", [chr(0x4E00 + i) for i in range(3000)], "абвгдежзиклмн"):
        one = "".join(draw.choice(alphabet) for _ in range(300))
        rows += [(n, one), (n + 1, one[:140] + "x" + one[141:])]
        n += 2
    for one in ("x", "a b", "y " * 100, "word", "\u4e00"):
        rows += [(n, one), (n + 1, one)]
        n += 2
    found = {}
    for r in line_dedup.blocks(spark.createDataFrame(rows, "id long, line string")).collect():
        found.setdefault(r["id"], set()).add(r["key"])
    assert len(found) == n  # every line has a block
    for i in range(0, n, 2):
        assert 5 * len(found[i] & found[i + 1]) >= min(len(found[i]), len(found[i + 1])), rows[i]


def test_lines_that_share_one_block_are_compared(spark):
    """Lines within the bound are found by any block they share, also by fewer than a fifth of them."""
    draw, pairs = random.Random(17), []
    for size in [40] * 60:
        line = ["".join(draw.choice("abcdefghijklmno") for _ in range(7)) for _ in range(size)]
        near, left = list(line), (8 * size - 1) // 10
        at = draw.randrange(size - 9)
        for k in [*range(at), *range(at + 9, size)][:left]:
            near[k] = near[k][:3] + "x" + near[k][4:]
        pairs.append((" ".join(line), " ".join(near)))
    lines = [(2 * i + k, x) for i, pair in enumerate(pairs) for k, x in enumerate(pair)]
    own = {}
    for r in line_dedup.blocks(spark.createDataFrame(lines, "id long, line string")).collect():
        own.setdefault(r["id"], set()).add(r["key"])
    few = [pairs[i // 2] for i in range(0, len(lines), 2)
           if 0 < 5 * len(own[i] & own[i + 1]) < min(len(own[i]), len(own[i + 1]))]
    assert len(few) >= 5 and all(edit_distance(a, b) <= len(a) // 10 for a, b in few[:5])
    rows = [(2 * i + k, x) for i, pair in enumerate(few) for k, x in enumerate(pair)]
    got = by_id(line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")))
    assert [got[i]["n_removed"] for i, _ in rows] == [0, 1] * len(few)


def test_a_repeated_word_is_no_block(spark):
    """A word that a piece has twice among three does not make it equal to all such pieces."""
    rows = [(i, " ".join(f"the {w}{k} the" for k in range(5))) for i, w in enumerate(["harbour", "mountains"])]
    keys = line_dedup.blocks(spark.createDataFrame(rows, "id long, line string")).distinct().groupBy("key").count()
    assert keys.count() == 2 * 13 and keys.where("count > 1").isEmpty()


def grouped_lines(texts, min_words=1, percent=90):
    """Plain version: places that go, by all pairs of lines and connected groups."""
    lines = sorted((i, k, x.strip(" ").lower()) for i, t in texts for k, x in enumerate(t.split("\n")) if x.strip())
    names = sorted({x for *_, x in lines})
    root, bags = {x: x for x in names}, {x: Counter(x) for x in names}

    def find(x):
        return x if root[x] == x else find(root[x])

    for a in names:
        for b in names:
            most = max(len(a), len(b)) * (100 - percent) // 100
            # Letters that only one of them has must be edited.
            if a < b and max(sum((bags[a] - bags[b]).values()), sum((bags[b] - bags[a]).values())) <= most and (
                    edit_distance(a, b) <= most):
                root[find(a)] = find(b)
    seen, gone = set(), {i: [] for i, _ in texts}
    for i, k, x in lines:
        if find(x) in seen:
            gone[i].append(k)
        seen.add(find(x))
    return gone


def group_texts():
    draw = random.Random(21)
    stock = ["".join(draw.choice("abcdefghijklmno") for _ in range(draw.randint(3, 9))) for _ in range(500)]
    base = [[draw.choice(stock) for _ in range(draw.choice([4, 9, 18, 30]))] for _ in range(14)]
    texts = []
    for i in range(36):
        own = []
        for _ in range(3):
            line = list(draw.choice(base))
            for _ in range(draw.choice([0, 0, 1])):
                k = draw.randrange(len(line))
                line[k] = line[k][:-1] + draw.choice("xyz")
            own.append(" ".join(line).upper() if draw.random() < 0.2 else " ".join(line))
        texts.append((i, "\n".join([*own, "", "menu"])))
    return texts


@pytest.mark.parametrize("collide", [False, True])
def test_groups_equal_all_pairs(spark, monkeypatch, collide):
    """The groups and the line that stays, also where hashes of lines collide."""
    if collide:
        monkeypatch.setattr(line_dedup, "identities", lambda line: (F.pmod(F.xxhash64(line), F.lit(5)), F.xxhash64(F.lit(1), line)))
    texts = group_texts()
    got = by_id(line_dedup.dedup_lines(spark.createDataFrame(texts, "doc_id long, text string"), min_words=1))
    want = grouped_lines(texts)
    assert {i: r["places_removed"] for i, r in got.items()} == want
    for i, text in texts:
        assert got[i]["text"] == "\n".join(x for k, x in enumerate(text.split("\n")) if k not in want[i])
    assert sum(map(len, want.values())) > 50


def test_pairs_are_compared_in_parts(spark, monkeypatch):
    """The pairs' texts are joined a part at a time; the groups stay those of all pairs."""
    monkeypatch.setattr(line_dedup, "PAIRS", 3)
    compared, passing = [], line_dedup.passing
    monkeypatch.setattr(line_dedup, "passing", lambda *x: compared.append(1) or passing(*x))
    texts = group_texts()
    got = by_id(line_dedup.dedup_lines(spark.createDataFrame(texts, "doc_id long, text string"), min_words=1))
    assert {i: r["places_removed"] for i, r in got.items()} == grouped_lines(texts)
    assert len(compared) > 3


def test_clashing_columns(spark):
    names = ["doc_id", "text", "_doc", "_parts", "__places", "n_lines", "n_removed", "places_removed", "id", "place"]
    rows = [(i, "some line that is here\nmenu", *([7] * 8)) for i in range(2)]
    docs = spark.createDataFrame(rows, names)
    got = line_dedup.dedup_lines(docs)
    assert sorted(got.columns) == sorted(names)
    assert {r["doc_id"]: (r["n_lines"], r["n_removed"], r["_doc"]) for r in got.collect()} == {0: (2, 0, 7), 1: (2, 1, 7)}


def test_token_counts(docs, spark):
    counter = token_counts.Counter()
    draw = random.Random(3)
    texts = dict(docs.select("doc_id", "text").collect())
    edits = [(i, s, s + draw.choice([0, 1, 5, 400]), draw.choice(["", "'s", " ", "\n\n", "é", " many words " * 40, None]))
             for i, t in texts.items() for s in [draw.randint(0, len(t or "")) for _ in range(3)]]
    edits += [(0, None, None, None), (None, 1, 2, "x"), (10 ** 6, 0, 0, "x"), (1, -5, 10 ** 9, "all new")]
    trees = token_counts.build(docs)
    got = by_id(token_counts.apply_edits(trees, docs, spark.createDataFrame(edits, "doc_id long, start int, stop int, replacement string")))
    for i, text in texts.items():
        own, at = text or "", 0
        clean = []
        for s, e, r in sorted((max(0, s or 0), max(0, e or 0), r or "") for d, s, e, r in edits if d == i):
            s = min(max(s, at), len(own))
            at = min(max(e, s), len(own))
            clean.append((s, at, r))
        new = own
        for s, e, r in reversed(clean):
            new = new[:s] + r + new[e:]
        row = got[i]
        assert row["text"] == new
        assert row["n_tokens"] == len(counter.encoding.encode_ordinary(own))
        assert row["n_tokens_edited"] == len(counter.encoding.encode_ordinary(new)) == sum(row["leaf_tokens"])
    longest = max(texts, key=lambda i: len(texts[i] or ""))
    assert got[longest]["n_reencoded"] < 2000


def test_toxicity(spark):
    draw = random.Random(6)
    plain = ["".join(draw.choice("abcdefgh") for _ in range(draw.randint(2, 7))) for _ in range(300)]
    rows, labels = [], []
    for i in range(500):
        bad = i % 3 == 0
        text = [draw.choice(plain) for _ in range(draw.randint(5, 120))]
        if bad:
            for _ in range(3):
                text.insert(draw.randrange(len(text)), draw.choice(["vile", "rotten"]))
        rows.append((i, " ".join(text), "toxic" if bad else "x"))
        labels.append((i, 0, int(bad)))
    rows += [(600, "", "x"), (601, None, "x"), (None, "vile rotten", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(2)
    known = spark.createDataFrame([*labels, (None, None, 1), (5000, 1, None)], "doc_id long, quality int, toxic int")
    model = toxicity.trained(docs, known)
    got = by_id(toxicity.score_documents(docs, model))
    held = [i for i in range(500) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i]["held_out"] == (i in set(held)) for i in range(500))
    assert sum(got[i]["predicted"] == (i % 3 == 0) for i in held) >= 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got.values()) and got[600]["score"] == got[601]["score"]
    kept = toxicity.reject_toxic(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(r["predicted"] == 0 for r in got.values())
    none = toxicity.trained(docs, known.limit(0))
    assert none is None and toxicity.score_documents(docs, none).where("score <> 0").count() == 0


def test_network_gradients():
    """The way back against differences."""
    import numpy as np

    draw = np.random.default_rng(1)
    model = {k: v.astype(np.float64) for k, v in toxicity.initial(3).items()}
    vectors = draw.standard_normal((9, 2 * toxicity.WIDTH))
    ids = draw.integers(0, 9, (6, 4))
    mask = (np.arange(6)[:, None] < np.array([6, 4, 1, 5])).astype(np.float64)
    back = draw.standard_normal(4)
    grads, d_vectors = toxicity.logits(model, vectors, ids, mask, back)
    for name in ("u_f", "u_b", "in_f", "bias_b", "attend", "ask", "out"):
        place = tuple(draw.integers(0, n) for n in model[name].shape)
        values = []
        for step in (1e-3, -1e-3):
            changed = {**model, name: model[name].copy()}
            changed[name][place] += step
            values.append((toxicity.logits(changed, vectors, ids, mask) * back).sum())
        assert np.isclose((values[0] - values[1]) / 2e-3, grads[name][place], rtol=2e-2, atol=1e-3), name


CASES = {
    "packing": lambda d: packing.pack(d),
    "strings": lambda d: suffix_dedup.dedup_strings(d),
    "units": lambda d: unit_dedup.dedup_units(d),
    "jaccard": lambda d: jaccard_join.jaccard_components(d),
    "licenses": lambda d: licenses.scan(d),
    "lines": lambda d: line_dedup.dedup_lines(d),
    "trees": lambda d: token_counts.build(d),
    "edits": lambda d: token_counts.apply_edits(token_counts.build(d), d, d.sparkSession.createDataFrame(
        [(2, 0, 3, "two"), (None, 0, 1, "x"), (9, 0, 1, "x")], "doc_id long, start int, stop int, replacement string")),
    "contamination": lambda d: decontaminate.contamination(
        d, d.sparkSession.createDataFrame([(1, "line of words"), (None, "here and")], "item_id int, text string")),
    "toxicity": lambda d: toxicity.score_documents(d, None),
}


@pytest.mark.parametrize("name", CASES)
def test_odd_and_empty_tables(odd, empty, name):
    rows = [r for r in CASES[name](odd).collect() if name != "packing" or r["start"] == 0]
    assert sorted(str(r["doc_id"]) for r in rows) == ["1", "2", "2", "3", "4", "None", "None"]
    assert CASES[name](empty).collect() == []
    if name == "strings":
        assert all(r["n_removed"] == 0 for r in rows)
    if name == "units":
        # Ten words that are repeated: too short a run to go.
        assert {r["doc_id"]: (r["n_repeated"], r["n_removed"]) for r in rows} == {
            None: (0, 0), 1: (0, 0), 2: (0, 0), 3: (0, 0), 4: (1, 0)}
    if name == "jaccard":
        assert {(r["doc_id"], r["component_id"]) for r in rows} == {(None, None), (1, 1), (2, 2), (3, 3), (4, 2)}
    if name == "edits":
        assert {(r["doc_id"], (r["text"] or "-")[:4]) for r in rows} == {
            (None, "one "), (None, "-"), (1, "-"), (2, "two "), (3, "-"), (4, "one ")}
    if name == "lines":
        assert {r["doc_id"]: r["n_removed"] for r in rows} == {None: 0, 1: 0, 2: 0, 3: 0, 4: 1}
    if name == "contamination":
        assert {r["doc_id"]: (r["n_hit"], r["n_items"]) for r in rows if r["doc_id"]} == {
            1: (0, 0), 2: (5, 1), 3: (0, 0), 4: (5, 1)}


def test_line_sketches_lose_no_close_pair(spark):
    draw = random.Random(3)
    words = ["the", "of", "stone", "river", "été", "zu", "open", "ratio"]
    lines = [" ".join(draw.choices(words, k=draw.randint(3, 40))) for _ in range(40)]
    for line in list(lines):
        near = list(line)
        for _ in range(max(1, len(line) // 12)):
            near[draw.randrange(len(near))] = draw.choice("etaxqé ")
        lines.append("".join(near))
    rows = [(i, line, [7], 1) for i, line in enumerate(lines)]
    rows = spark.createDataFrame(rows, "id long, line string, keys array<long>, blocks int")
    counts = [line_dedup.letter_count("line", c).alias(f"count_{c}") for c in line_dedup.COUNTED]
    rows = rows.select("*", F.length("line").alias("n"), *counts)
    one, two = (rows.select(*[F.col(c).alias(c + n) for c in rows.columns]) for n in "12")
    both = one.join(two, F.col("id1") < F.col("id2")).select(
        line_dedup.similar(F.col("line1"), F.col("line2"), 90).alias("similar"), line_dedup.alike(90).alias("alike"))
    found = {(r["similar"], r["alike"]): r["count"] for r in both.groupBy("similar", "alike").count().collect()}
    assert found[True, True] > 20 and (True, False) not in found
    assert found[False, False] > 10 * found.get((False, True), 0)


def test_lines_meet_at_rare_blocks(spark):
    draw, blocks, rest = random.Random(4), {}, []
    for i in range(300):
        # Block 0 is in all lines; one line in ten has few others.
        own = {0} | {draw.randrange(1, 400) for _ in range(draw.randint(0, 3) if i % 10 == 0 else draw.randint(9, 30))}
        if i % 7 == 0 and i:
            own = set(list(blocks[i - 1][0])[: len(blocks[i - 1][0]) * 2 // 3]) | {0, 1000 + i}
        blocks[i] = (own, draw.randint(80, 120))
        rest += [(k, i, i // 2) for k in own]
    sketches = spark.createDataFrame(
        [(i, sorted(own), len(own), n) for i, (own, n) in blocks.items()], "id long, keys array<long>, blocks int, n int")
    rest = spark.createDataFrame(rest, "key long, id long, component long")
    met = line_dedup.meeting(line_dedup.ranks(rest), sketches, 90).select("id1", "id2").collect()
    got, expected = {tuple(sorted(r)) for r in met}, set()
    for i, (a, n) in blocks.items():
        for j, (b, m) in blocks.items():
            enough = 100 * len(a & b) >= line_dedup.AGREE * min(len(a), len(b))
            if i < j and i // 2 != j // 2 and enough and 100 * abs(n - m) <= 10 * max(n, m):
                expected.add((i, j))
    assert expected and expected <= got
    # The block that all hold brings no two lines of many blocks together.
    many = {i for i, (own, _) in blocks.items() if len(own) > 5}
    only = {(i, j) for i, j in got if {i, j} <= many and blocks[i][0] & blocks[j][0] == {0}}
    assert not only


def test_toxicity_vocabulary_is_bounded():
    """However many words a worker sees, it keeps few, and their vectors are worked out in parts."""
    import tracemalloc

    words = [b"word%07d" % i for i in range(150_000)]
    model = toxicity.initial()
    toxicity.features(words[:10])
    tracemalloc.start()
    found = toxicity.features(words)
    assert len(toxicity._rows()) <= 1 << 16
    tracemalloc.reset_peak()
    before = tracemalloc.get_traced_memory()[0]
    vectors = toxicity.inputs(model, found)
    peak = tracemalloc.get_traced_memory()[1] - before
    tracemalloc.stop()
    assert peak < 2.5 * vectors.nbytes
    for i in (0, 8191, 8192, 149_999):
        assert (vectors[i] == toxicity.inputs(model, toxicity.features([words[i]]))[0]).all()


def test_worker_keeps_tables_of_one_operator():
    from flowspark.llm import common

    one, two = {b"a": b"1"}, {b"b": b"2"}
    common.worker_tables("one", one)
    common.worker_tables("one", one)
    assert one
    common.worker_tables("two", two)
    assert not one and two
    two.clear()
    common.worker_tables("none")
