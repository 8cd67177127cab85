"""Similarity join on word n-grams by parity sketches (operator 6)."""

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowspark.llm.common import few, kept, linked_components, passing, table, utf8

_KNOWN_WORDS = 1_000_000
SKETCH_BITS = 1024


class _Hashes(dict):
    """word -> 64-bit hash, the same everywhere."""

    def __missing__(self, word):
        import xxhash

        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


@functools.lru_cache(maxsize=1)
def _hashes():
    return _Hashes()


def _mix(x):
    import numpy as np

    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def shingle_sets(texts, width):
    """The sorted 64-bit hashes of the distinct `width`-word shingles of each text."""
    import numpy as np

    known = _hashes()
    if len(known) > _KNOWN_WORDS:
        known.clear()
    factors = _mix(np.arange(1, width + 1, dtype=np.uint64)) | np.uint64(1)
    sets = []
    for text in texts:
        found = text.lower().split() if text else []  # bytes: A-Z and ASCII white space only
        h = np.fromiter(map(known.__getitem__, found), np.uint64, len(found))
        if len(h) >= width:
            n = len(h) - width + 1
            total = np.zeros(n, np.uint64)
            for i in range(width):
                total += h[i:i + n] * factors[i]
            sets.append(np.unique(_mix(total)))
        elif len(h):
            sets.append(_mix((h * factors[:len(h)]).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(h))))
        else:
            sets.append(h)
    return sets


def differing(a, b, percent):
    """Most elements in which sets of a and b elements can differ and still link."""
    return (100 - percent) * (a + b) // (100 + percent)


@functools.lru_cache(maxsize=4096)
def _plan(n, percent):
    """Where a set of n elements takes part: (level, blocks of the level, blocks to keep).

    A level holds the pairs whose smaller set has 2^level to 2^(level+1)-1 elements. A set
    is in its own level, and one below if a smaller partner can be there.
    """
    def blocks(level):
        a = (2 << level) - 1
        most = differing(a, a * 100 // percent, percent)
        return most + 2 + most // 4

    own = n.bit_length() - 1
    plan = [(own, blocks(own), differing(n, n * 100 // percent, percent) + 1)]
    if own and (n * percent + 99) // 100 < 1 << own:
        plan.append((own - 1, blocks(own - 1), differing(n, (1 << own) - 1, percent) + 1))
    return plan


def block_keys(hashes, percent):
    """Join keys of one set: parities (XOR of hashes) of the blocks that are kept.

    An element lies in one block, so sets that differ in k elements have the same parity
    in all but k blocks. Of m blocks, at least m - k are equal; if each side keeps those
    that come first in an order of their contents, and all but m - k - 1, the first of the
    equal ones is kept by both. Blocks with more elements come first: they are rarer.
    """
    import numpy as np

    if not len(hashes):
        return np.empty(0, np.int64)
    out = []
    for level, blocks, keep in _plan(len(hashes), percent):
        block = ((hashes >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)  # sorted as the hashes are
        starts = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
        parity = np.bitwise_xor.reduceat(hashes, starts)
        size = np.diff(np.concatenate([starts, [len(hashes)]]))
        keys = _mix(parity + block[starts] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(level + 1))
        if keep < len(keys):
            keys = keys[np.lexsort((keys, -size))[:keep]]
        elif keep > len(keys):  # empty blocks come last and are equal in content
            empty = np.setdiff1d(np.arange(blocks, dtype=np.uint64), block[starts])[:keep - len(keys)]
            keys = np.concatenate([keys, _mix(empty * np.uint64(0x9E3779B97F4A7C15) + np.uint64(level + 1))])
        out.append(keys)
    return np.concatenate(out).view(np.int64)


def bit_sketch(hashes):
    """Bit j is the parity of the elements hashed to j: as 64-bit words."""
    import numpy as np

    odd = np.bincount((hashes & np.uint64(SKETCH_BITS - 1)).astype(np.int64), minlength=SKETCH_BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view("<i8")


def _lists(arrays):
    import numpy as np
    import pyarrow as pa

    ends = np.cumsum([0] + [len(a) for a in arrays]).astype(np.int32)
    values = np.concatenate([*arrays, np.empty(0, np.int64)]).astype(np.int64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values))


def jaccard_components(docs: DataFrame, width=5, percent=80, id_column="doc_id", text_column="text") -> DataFrame:
    """Connected components of texts whose sets of `width`-word shingles have a Jaccard
    similarity of at least `percent` in a hundred. A row per row of `docs`: doc_id,
    n_shingles, component_id (the smallest doc_id of its component).

    Words are runs without ASCII white space, A-Z lower-cased. A text of fewer than `width`
    words is one shingle; null, empty and blank texts have none and link with nothing.
    Rows that repeat an id count as one document (they share a component). Rows with a
    null id link with nothing; their component is null. An empty table gives no rows.
    """
    docs = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def sign(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                rows = batch.slice(at, 1000)
                sets = shingle_sets(utf8(rows.column("text")), width)
                yield pa.RecordBatch.from_arrays(
                    [rows.column("doc_id"), pa.array(np.array([len(s) for s in sets], np.int64)),
                     _lists([block_keys(s, percent) for s in sets])], ["doc_id", "n", "keys"])

    signed = kept(docs.mapInArrow(sign, f"doc_id {kind}, n long, keys array<long>"))
    members = signed.where("doc_id is not null").select(F.explode("keys").alias("key"), F.col("doc_id").alias("id"))

    def prepare(ids):
        def sets_of(batches):
            import numpy as np
            import pyarrow as pa

            for batch in batches:
                for at in range(0, batch.num_rows, 1000):
                    rows = batch.slice(at, 1000)
                    sets = shingle_sets(utf8(rows.column("text")), width)
                    yield pa.RecordBatch.from_arrays(
                        [rows.column("doc_id"), pa.array(np.array([len(s) for s in sets], np.int64)),
                         _lists([bit_sketch(s) for s in sets]), _lists([s.view(np.int64) for s in sets])],
                        ["id", "n", "sketch", "set"])

        texts = docs.join(few(ids.withColumnRenamed("id", "doc_id")), "doc_id", "left_semi")
        sets = kept(texts.mapInArrow(sets_of, f"id {kind}, n long, sketch array<long>, set array<long>"))

        words = SKETCH_BITS // 64
        sketches = sets.select("id", "n", *[F.col("sketch")[i].alias(f"s{i}_") for i in range(words)])
        apart = sum((F.bit_count(F.col(f"s{i}_1").bitwiseXOR(F.col(f"s{i}_2"))) for i in range(words)), F.lit(0))
        near = apart * (100 + percent) <= (100 - percent) * (F.col("n1") + F.col("n2"))

        def verify(pairs):
            def side(name, *columns):
                return sets.select(F.col("id").alias(name), *[F.col(c).alias(c + name) for c in columns])

            both = pairs.join(side("u", "n", "sketch"), "u").join(side("v", "n", "sketch"), "v")
            hamming = F.aggregate(
                F.zip_with("sketchu", "sketchv", lambda a, b: F.bit_count(a.bitwiseXOR(b))),
                F.lit(0), lambda total, n: total + n)
            total = F.col("nu") + F.col("nv")
            fits = (100 * F.least("nu", "nv") >= percent * F.greatest("nu", "nv")) & (
                hamming * (100 + percent) <= (100 - percent) * total)
            close = both.where(fits).select("u", "v").distinct()
            full = close.join(side("u", "n", "set"), "u").join(side("v", "n", "set"), "v")
            common = F.size(F.array_intersect("setu", "setv"))
            return passing(full, common * (100 + percent) >= percent * total)

        return verify, sketches, near

    found, _ = linked_components(members, prepare)
    return signed.select("doc_id", "n").join(found.withColumnRenamed("id", "doc_id"), "doc_id", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def op6_jaccard_join(spark: SparkSession, sf_dir) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), width=4, percent=85)
