"""Removal of repeated byte strings by refining buckets of suffixes (operator 4)."""

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowspark.llm.common import drop, kept, table, utf8

# Texts are looked at in pieces of so many bytes: what a task holds at once.
PIECE = 1 << 20


def _mix(x):
    import numpy as np

    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


@functools.lru_cache(maxsize=1)
def _powers():
    """Values of the bytes, powers of an odd base and of its inverse modulo 2^64."""
    import numpy as np

    base, n = 0x9E3779B97F4A7C15 | 1, PIECE + 4096
    inverse = pow(base, -1, 1 << 64)
    power = np.cumprod(np.full(n, base, np.uint64), dtype=np.uint64)
    back = np.cumprod(np.full(n, inverse, np.uint64), dtype=np.uint64)
    return _mix(np.arange(1, 257, dtype=np.uint64)), power, back


class Buckets:
    """Bucket identifiers of all suffixes of some bytes, by their first 1, 2, 4 … times q
    bytes. An identifier is made of two of the level before, that of the suffix and that
    of the suffix further on, so the same bytes get the same one in any document."""

    def __init__(self, data, q):
        import numpy as np

        values, power, self.back = _powers()
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(values[data] * power[:len(data)], out=self.sums[1:])
        self.levels = {q: self.string(np.arange(max(0, len(data) - q + 1)), q)}

    def string(self, start, length):
        """Identifier of the strings that start somewhere and have a length."""
        return _mix((self.sums[start + length] - self.sums[start]) * self.back[start])

    def refined(self, length):
        """Identifiers by `length` bytes, from those by half as many."""
        if length not in self.levels:
            half = self.refined(length // 2)
            first, later = half[:max(0, len(half) - length // 2)], half[length // 2:]
            self.levels[length] = _mix(first * 3 + _mix(later + 1))
        return self.levels[length]


def _least(keys, width):
    """Minimum of each `width` consecutive keys."""
    import numpy as np

    span = 1
    while 2 * span <= width:
        keys = np.minimum(keys[:-span], keys[span:])
        span *= 2
    return keys if span == width else np.minimum(keys[:len(keys) - (width - span)], keys[width - span:])


def _anchors(data, ends, length, q):
    """Sampled suffixes. `data`: bytes of several texts one after the other, which end at
    `ends`. Each string of `length` bytes inside a text belongs to its q-gram of least
    hash (the first of equals); a row per run of consecutive strings of one q-gram: start
    of the first string, number of strings, distance of the q-gram from the first start,
    bucket of the q-gram, identifier of all bytes of the run."""
    import numpy as np

    buckets = Buckets(data, q)
    grams = buckets.levels[q]
    n = len(data) - length + 1
    if n < 1:
        return [np.empty(0, np.int64)] * 3 + [np.empty(0, np.uint64)] * 2
    where = np.arange(len(grams), dtype=np.uint64)
    owner = (_least((_mix(grams) & np.uint64(0xFFFFFFFF00000000)) | where, length - q + 1)
             & np.uint64(0xFFFFFFFF)).astype(np.int64)
    inside = np.ones(n, bool)
    for e in ends:
        inside[max(0, e - length + 1):e] = False
    new = np.empty(n, bool)
    new[0] = True
    new[1:] = (owner[1:] != owner[:-1]) | (inside[1:] != inside[:-1])
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [n]]) - 1
    good = inside[first]
    first, last = first[good], last[good]
    at, count = owner[first], last - first + 1
    content = buckets.string(first, count + length - 1)
    content = _mix(content + _mix(((at - first) * 256 + count).astype(np.uint64)))
    return first, count, at - first, grams[at], content


def anchors(docs: DataFrame, length, q) -> DataFrame:
    """(doc_id, bucket, content, at): the sampled suffixes of all texts. `at` packs the
    first start (from bit 16), the number of starts less one (from bit 8) and the distance
    of the q-gram."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def scan(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            pieces, used = [], 0

            def rows(pieces):
                data = np.frombuffer(b"".join(p for _, _, p in pieces), np.uint8)
                ends = np.cumsum([len(p) for _, _, p in pieces])
                first, count, far, bucket, content = _anchors(data, ends, length, q)
                which = np.searchsorted(ends, first, "right")
                begin = ends - [len(p) for _, _, p in pieces]
                shift = np.array([s for _, s, _ in pieces], np.int64) - begin
                at = ((first + shift[which]) << 16) | ((count - 1) << 8) | far
                row = np.array([r for r, _, _ in pieces], np.int64)[which]
                return pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(pa.array(row)), pa.array(bucket.view(np.int64)),
                     pa.array(content.view(np.int64)), pa.array(at)], ["doc_id", "bucket", "content", "at"])

            for row, text in enumerate(utf8(batch.column("text"))):
                for start in range(0, len(text or b"") - length + 1, PIECE - length):
                    piece = text[start:start + PIECE - 1]
                    if used + len(piece) > PIECE:
                        yield rows(pieces)
                        pieces, used = [], 0
                    pieces.append((row, start, piece))
                    used += len(piece)
            if pieces:
                yield rows(pieces)

    return docs.mapInArrow(scan, f"doc_id {kind}, bucket long, content long, at long")


def _halves(docs: DataFrame, length, q) -> DataFrame:
    """The runs in `ats` of each text, by their buckets of twice q bytes: (key, doc_id,
    start, ids). Strings that start well before their q-gram share the bytes before it
    with any equal string, the others those after it; `ids` packs the identifiers of the
    run's strings on that side."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    middle = (length - q) // 2

    def refine(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            out = [[], [], [], []]
            for row, (text, ats) in enumerate(zip(utf8(batch.column("text")), batch.column("ats").to_pylist())):
                ats = np.sort(np.array(ats, np.int64))
                first, count, far = ats >> 16, ((ats >> 8) & 255) + 1, ats & 255
                for begin in range(0, len(text), PIECE - 4 * length):
                    mine = (first >= begin) & (first < begin + PIECE - 4 * length)
                    if not mine.any():
                        continue
                    data = np.frombuffer(text, np.uint8)[begin:begin + PIECE]
                    buckets = Buckets(data, q)
                    double, whole = buckets.refined(2 * q), buckets.refined(length).view(np.int64)
                    for s, n, d in zip((first[mine] - begin).tolist(), count[mine].tolist(), far[mine].tolist()):
                        gram, stop = s + d, s + n
                        border = min(max(gram - middle, s), stop)
                        for low, high, key_at, side in ((border, stop, gram, 0), (s, border, gram - q, 1)):
                            if low < high:
                                out[0].append(int(double[key_at]) >> 1 | side << 63)
                                out[1].append(row)
                                out[2].append(begin + low)
                                out[3].append(whole[low:high].tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.array(out[0], np.uint64).view(np.int64)),
                 batch.column("doc_id").take(pa.array(out[1], pa.int64())),
                 pa.array(out[2], pa.int64()), pa.array(out[3], pa.binary())], ["key", "doc_id", "start", "ids"])

    return docs.mapInArrow(refine, f"key long, doc_id {kind}, start long, ids binary")


def _strings(runs: DataFrame) -> DataFrame:
    """(id, doc_id, start) of every string of packed runs."""
    kind = runs.schema["doc_id"].dataType.simpleString()

    def unpack(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            ids = [np.frombuffer(x, np.int64) for x in batch.column("ids").to_pylist()]
            sizes = np.array([len(x) for x in ids], np.int64)
            row = np.repeat(np.arange(len(ids)), sizes)
            within = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([*ids, np.empty(0, np.int64)])), batch.column("doc_id").take(pa.array(row)),
                 pa.array(batch.column("start").to_numpy()[row] + within)], ["id", "doc_id", "start"])

    return runs.select("doc_id", "start", "ids").mapInArrow(unpack, f"id long, doc_id {kind}, start long")


def repeated_spans(docs: DataFrame, length=100) -> DataFrame:
    """(doc_id, spans), `spans` being an array of (start, stop): bytes of strings of `length` bytes that also start earlier.

    Bucket-pointer refinement on sampled suffixes. The q-grams (a quarter of `length`) of
    least hash in each string are the suffixes; equal strings have equal ones at equal
    places. Their q-gram buckets are the first; buckets of one suffix are dropped. Runs of
    strings with equal bytes throughout are settled by their earliest. What is left, one
    run of each content, is refined by the identifiers of later offsets, to 2q and to 4q
    bytes; buckets of one are dropped before the next level.
    """
    q = length // 4
    docs = docs.where("doc_id is not null")
    all_anchors = kept(anchors(docs, length, q))
    shared = all_anchors.groupBy("bucket").count().where("count > 1").select("bucket")
    active = kept(all_anchors.join(shared, "bucket"))
    drop(all_anchors)
    contents = kept(active.groupBy("bucket", "content").agg(
        F.min(F.struct("doc_id", "at")).alias("first"), F.count("*").alias("n")))
    again = active.join(contents.where("n > 1").select("bucket", "content", "first"), ["bucket", "content"])
    again = again.where(F.struct("doc_id", "at") != F.col("first"))
    start = F.shiftright("at", 16)
    whole = kept(again.select("doc_id", start.alias("start"), (
        start + F.shiftright("at", 8).bitwiseAND(F.lit(255)) + length).alias("stop")))
    drop(active)
    unlike = contents.groupBy("bucket").count().where("count > 1").select("bucket")
    runs = contents.join(unlike, "bucket").select("first.doc_id", "first.at")
    runs = runs.groupBy("doc_id").agg(F.collect_set("at").alias("ats"))
    halves = kept(_halves(docs.join(runs, "doc_id").select("doc_id", "text", "ats"), length, q))
    drop(contents)
    double = halves.groupBy("key").count().where("count > 1").select("key")
    strings = kept(_strings(halves.join(double, "key")))
    drop(halves)
    firsts = strings.groupBy("id").agg(F.min(F.struct("doc_id", "start")).alias("first"), F.count("*").alias("n"))
    later = strings.join(firsts.where("n > 1").select("id", "first"), "id").where(
        F.struct("doc_id", "start") != F.col("first"))
    later = later.select("doc_id", "start", (F.col("start") + length).alias("stop"))
    spans = kept(whole.unionByName(later).groupBy("doc_id").agg(
        F.collect_list(F.struct("start", "stop")).alias("spans")))
    drop(whole, strings)
    return spans


def dedup_strings(docs: DataFrame, length=100, id_column="doc_id", text_column="text") -> DataFrame:
    """Each row of `docs` without the bytes of strings of `length` bytes that start earlier,
    in a smaller doc_id or before in the same document: doc_id, n_bytes, n_removed, n_spans,
    spans (array of start, stop in the original bytes), kept (binary: cuts may fall inside
    a character).

    A null text is empty. Rows that repeat an id count as one document with one text; what
    goes from one goes from all. A null id takes no part and keeps its bytes. Strings never
    span documents; an empty table gives no rows; other columns are ignored. `length` is a
    multiple of four, 16 to 300.
    """
    docs = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    spans = repeated_spans(docs, length).hint("shuffle_hash")

    def cut(batches):
        import numpy as np
        import pyarrow as pa

        span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
        for batch in batches:
            gone, runs, texts, sizes = [], [], [], []
            lists = batch.column("spans")
            for row, text in enumerate(utf8(batch.column("text"))):
                text, found = text or b"", lists[row].values
                merged = []
                if found is not None and len(found):
                    start, stop = (found.field(i).to_numpy() for i in (0, 1))
                    order = np.argsort(start, kind="stable")
                    start, stop = start[order], np.maximum.accumulate(np.minimum(stop[order], len(text)))
                    new = np.flatnonzero(np.concatenate([[True], start[1:] > stop[:-1]]))
                    stops = stop[np.concatenate([new[1:] - 1, [len(stop) - 1]])]
                    merged = [(a, b) for a, b in zip(start[new].tolist(), stops.tolist()) if a < b]
                parts, at = [], 0
                for a, b in merged:
                    parts.append(text[at:a])
                    at = b
                parts.append(text[at:])
                texts.append(b"".join(parts))
                sizes.append(len(text))
                gone.append(len(text) - len(texts[-1]))
                runs.append([{"start": a, "stop": b} for a, b in merged])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(gone, pa.int64()),
                 pa.array([len(r) for r in runs], pa.int64()), pa.array(runs, span), pa.array(texts, pa.binary())],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "spans", "kept"])

    return docs.join(spans, "doc_id", "left").select("doc_id", "text", "spans").mapInArrow(
        cut, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, "
        "spans array<struct<start:bigint,stop:bigint>>, kept binary")


def op4_suffix_dedup(spark: SparkSession, sf_dir) -> DataFrame:
    done = dedup_strings(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
