"""Benchmark decontamination by a positional inverted index (operator 2)."""

from functools import partial
from itertools import count

from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from flowspark.llm.common import kept, table, utf8, words

# A segment of the index covers so many bytes of text, or one longer document: what one
# task holds while it builds or searches.
SEGMENT_BYTES = 16 << 20
# Test texts are searched in blocks of at most about so many bytes, sent to every task.
BLOCK_BYTES = 8 << 20


def build_index(docs: DataFrame, segment_bytes=SEGMENT_BYTES, id_column="doc_id", text_column="text") -> DataFrame:
    """Written postings of all terms of whole texts.

    A row per (segment, term): n and the packed 32-bit positions; and a row per document
    (null term): doc_id, its first position and its number of words. The documents of a
    segment lie one after the other with an empty place in between, which no phrase spans.
    Segments never share a document, so no term's list over the corpus meets in one task.
    """
    docs = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    id_type = to_arrow_type(docs.schema["doc_id"].dataType)

    def index(batches):
        import numpy as np
        import pyarrow as pa

        names = ["segment", "term", "n", "positions", "doc_id", "start", "n_words"]
        part, number = TaskContext.get().partitionId(), 0

        def postings(codes, terms, starts):
            where = np.concatenate([start + np.arange(len(c), dtype=np.int32) for c, start in zip(codes, starts)])
            codes = np.concatenate(codes)
            order = np.argsort(codes, kind="stable")
            sizes = np.bincount(codes, minlength=len(terms))
            ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32) * 4
            packed = pa.BinaryArray.from_buffers(
                pa.binary(), len(terms), [None, pa.py_buffer(ends), pa.py_buffer(where[order].astype("<i4"))])
            nothing = pa.nulls(len(terms), pa.int64())
            return pa.array(list(terms), pa.binary()).cast(pa.string()), pa.array(sizes), packed, nothing

        def segments():
            codes = None
            for batch in batches:
                for row, text in enumerate(utf8(batch.column("text"))):
                    if codes is None:
                        numbers, codes, ids, starts, sizes, used, at = _Numbers(), [], [], [], [], 0, 1
                    found = words(text)
                    codes.append(np.fromiter(map(numbers.__getitem__, found), np.int32, len(found)))
                    ids.append(batch.column("doc_id")[row].as_py())
                    starts.append(at)
                    sizes.append(len(found))
                    at += len(found) + 1
                    used += len(text or b"")
                    if used >= segment_bytes:
                        yield numbers, codes, ids, starts, sizes
                        codes = None
            if codes is not None:
                yield numbers, codes, ids, starts, sizes

        for terms, codes, ids, starts, sizes in segments():
            segment = (part << 32) + number
            number += 1
            first, n = pa.array(starts, pa.int64()), pa.array(sizes, pa.int64())
            blank = len(ids)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(blank, segment)), pa.nulls(blank, pa.string()), pa.nulls(blank, pa.int64()),
                 pa.nulls(blank, pa.binary()), pa.array(ids, id_type), first, n], names)
            if len(terms):
                texts, n, packed, nothing = postings(codes, terms, starts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(texts), segment)), texts, n, packed,
                     pa.nulls(len(texts), id_type), nothing, nothing], names)

    return kept(docs.mapInArrow(
        index, f"segment long, term string, n long, positions binary, doc_id {kind}, start long, n_words long"))


class _Numbers(dict):
    """term -> number, given on first sight."""

    def __init__(self):
        super().__init__()
        self.counter = count()

    def __missing__(self, term):
        self[term] = number = next(self.counter)
        return number


def phrase_starts(lists, terms):
    """Starts of all places where `terms` stand consecutively. `lists`: term -> sorted
    positions. Lists are shifted by their term's offset and met from the rarest on."""
    import numpy as np

    if any(t not in lists for t in terms):
        return np.empty(0, np.int32)
    order = sorted(range(len(terms)), key=lambda i: len(lists[terms[i]]))
    starts = lists[terms[order[0]]] - order[0]
    for i in order[1:]:
        other = lists[terms[i]]
        at = np.searchsorted(other, starts + i)
        starts = starts[other[np.minimum(at, len(other) - 1)] == starts + i]
        if not len(starts):
            break
    return starts


def near_spans(lists, terms, within):
    """Spans (start, stop) of at most `within` words that hold all of `terms` (with their
    repeats), each from a place of the rarest term that such a span can have."""
    import numpy as np

    need = {t: terms.count(t) for t in terms}
    if any(len(lists.get(t, ())) < c for t, c in need.items()):
        return []
    rare = min(need, key=lambda t: len(lists[t]))
    found = set()
    for p in lists[rare].tolist():
        places = {t: lists[t][np.searchsorted(lists[t], p - within + 1):np.searchsorted(lists[t], p + within)] for t in need}
        for start in sorted(set(np.concatenate(list(places.values())).tolist())):
            if start > p:
                break
            ends = []
            for t, c in need.items():
                later = places[t][np.searchsorted(places[t], start):]
                if len(later) < c:
                    break
                ends.append(int(later[c - 1]))
            else:
                stop = max(*ends, p) + 1
                if stop - start <= within:
                    found.add((start, stop))
    least = sorted(found)
    return [s for i, s in enumerate(least) if not any(s[0] <= o[0] and o[1] <= s[1] and o != s for o in least[max(0, i - within):i + within])]


def _blocks(tests: DataFrame):
    """The test rows, in blocks of bounded size, one after the other."""
    block, used = [], 0
    for row in tests.toLocalIterator():
        block.append((row[0], row[1]))
        used += len(row[1] or "") * 4 + 64
        if used >= BLOCK_BYTES:
            yield block
            block, used = [], 0
    if block:
        yield block


def search(index: DataFrame, phrases: list[tuple[bytes, ...]], per_segment, schema) -> DataFrame:
    """`per_segment(lists, documents)` for every segment: the lists of the terms of
    `phrases`, and an Arrow table of its documents in order. Returns an Arrow table."""
    spark = index.sparkSession
    terms = sorted({t.decode() for p in phrases for t in p})
    asked = spark.createDataFrame([(t,) for t in terms], "term string")
    hits = index.where("term is not null").join(F.broadcast(asked), "term", "left_semi")
    rows = index.where("term is null").unionByName(hits)

    def one(segment):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        found = segment.filter(pc.is_valid(segment.column("term"))).select(["term", "positions"])
        lists = {
            term.encode(): np.frombuffer(positions, "<i4")
            for term, positions in zip(*[c.to_pylist() for c in found.columns])
        }
        documents = segment.filter(pc.is_null(segment.column("term"))).select(["doc_id", "start", "n_words"])
        out = per_segment(lists, documents.sort_by("start"))
        own = segment.column("segment")[0].as_py()
        return out.append_column("segment", pa.array(np.full(len(out), own, np.int64)))

    return rows.groupBy("segment").applyInArrow(one, schema + ", segment long")


def find(index: DataFrame, queries: DataFrame, within=None) -> DataFrame:
    """Places of whole queries (query_id, text): a row (query_id, doc_id, start, length).

    Exact phrases, or with `within` the smallest spans of at most so many words that hold
    all words of the query in any order. Queries without words are found nowhere. Queries
    go in blocks of bounded size.
    """
    kinds = [index.schema["doc_id"].dataType.simpleString(), queries.schema[0].dataType.simpleString()]
    schema = f"query_id {kinds[1]}, doc_id {kinds[0]}, start long, length long"
    query_type = to_arrow_type(queries.schema[0].dataType)
    out = None
    for block in _blocks(queries.select(queries.columns[0], F.col(queries.columns[1]).cast("string"))):
        asked = [(q, tuple(words((t or "").encode()))) for q, t in block]
        asked = [(q, p) for q, p in asked if p]

        def per_segment(lists, rows, asked=asked):
            import numpy as np
            import pyarrow as pa

            first, n = (rows.column(c).to_numpy() for c in ("start", "n_words"))
            found = []
            for query, phrase in asked:
                if within:
                    spans = near_spans(lists, list(phrase), within)
                else:
                    spans = [(s, s + len(phrase)) for s in phrase_starts(lists, phrase).tolist()]
                for start, stop in spans:
                    d = int(np.searchsorted(first, start, "right")) - 1
                    if stop <= first[d] + n[d]:
                        found.append((query, d, int(start - first[d]), stop - start))
            query, d, start, length = zip(*found) if found else ((), (), (), ())
            return pa.table({
                "query_id": pa.array(query, query_type), "doc_id": rows.column("doc_id").take(pa.array(d, pa.int64())),
                "start": pa.array(start, pa.int64()), "length": pa.array(length, pa.int64())})

        hits = search(index, [p for _, p in asked], per_segment, schema).drop("segment")
        out = hits if out is None else out.unionByName(hits)
    return index.sparkSession.createDataFrame([], schema) if out is None else out


def contamination(docs: DataFrame, tests: DataFrame, window=10, index=None, **columns) -> DataFrame:
    """Which words of whole documents lie in a window of `window` consecutive words of a
    test text. `tests`: (item_id, text); one of fewer words is one window, null or none no
    window. A row per row of `docs`: doc_id, n_words, n_hit, n_items, items_sha256,
    contaminated, spans (array of hit runs: first word, number of words).

    Null texts have no words. Repeated rows and null ids are judged each by itself; an
    empty table gives no rows. Test rows that repeat an id count as one item; items with a
    null id hit words but are not counted.
    """
    index = build_index(docs, **columns) if index is None else index
    kind = index.schema["doc_id"].dataType.simpleString()
    schema = (f"place long, doc_id {kind}, n_words long, items array<string>, "
              "spans array<struct<start:long,length:long>>")
    parts = []
    for block in _blocks(tests.select(F.col(tests.columns[0]).cast("string"), F.col(tests.columns[1]).cast("string"))):
        windows: dict[tuple[bytes, ...], set] = {}
        for item, text in block:
            found = words((text or "").encode())
            for at in range(max(1, len(found) - window + 1) if found else 0):
                windows.setdefault(tuple(found[at:at + window]), set()).add(item)

        parts.append(search(index, list(windows), partial(_judge, windows), schema))
    if not parts:
        parts = [search(index, [], partial(_judge, {}), schema)]
    if len(parts) == 1:
        found = parts[0]
    else:
        found = parts[0]
        for p in parts[1:]:
            found = found.unionByName(p)
        # Each block gives every document once: as many rows to a group as there are blocks.
        found = found.groupBy("segment", "place", "doc_id", "n_words").agg(
            F.sort_array(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
            F.flatten(F.collect_list("spans")).alias("spans"))
        found = found.withColumn("spans", _merged("spans"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["length"])
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"), "spans")


def _judge(windows, lists, rows):
    import numpy as np
    import pyarrow as pa

    first, sizes = (rows.column(c).to_numpy() for c in ("start", "n_words"))
    edge = np.zeros(int(first[-1] + sizes[-1]) + 2, np.int32)
    items = [set() for _ in first]
    for phrase, owners in windows.items():
        starts = phrase_starts(lists, phrase)
        if len(starts):
            np.add.at(edge, starts, 1)
            np.add.at(edge, starts + len(phrase), -1)
            for d in np.unique(np.searchsorted(first, starts, "right") - 1).tolist():
                items[d] |= owners
    hit = np.cumsum(edge) > 0
    turns = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]])))
    spans = [[] for _ in first]
    for start, stop in turns.reshape(-1, 2).tolist():
        d = int(np.searchsorted(first, start, "right")) - 1
        spans[d].append({"start": int(start - first[d]), "length": stop - start})
    run = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))
    return pa.table({
        "place": rows.column("start"), "doc_id": rows.column("doc_id"), "n_words": rows.column("n_words"),
        "items": pa.array([sorted(i for i in x if i is not None) for x in items], pa.list_(pa.string())),
        "spans": pa.array(spans, run)})


def _merged(column):
    """Overlapping runs of an array joined."""
    def add(done, s):
        last = F.element_at(done, -1)
        joins = (F.size(done) > 0) & (last["start"] + last["length"] >= s["start"])
        end = F.greatest(last["start"] + last["length"], s["start"] + s["length"])
        longer = F.struct(last["start"].alias("start"), (end - last["start"]).alias("length"))
        return F.when(joins, F.concat(F.slice(done, 1, F.size(done) - 1), F.array(longer))).otherwise(
            F.concat(done, F.array(s)))

    empty = F.slice(F.col(column), 1, 0)
    return F.aggregate(F.array_sort(column), empty, add)


def op2_decontaminate(spark: SparkSession, sf_dir) -> DataFrame:
    return contamination(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark", "item_id", "text")).drop("spans")

