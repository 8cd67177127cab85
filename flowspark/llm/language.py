"""Language identification by a string kernel with Nyström landmarks (operator 13)."""

import functools

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowspark.llm.common import few, kept, table

# The sample that is learned from: of each language, the texts of so many ids of least hash.
SAMPLE_PER_LANGUAGE = 400
SHARES = 64
# Landmarks in all, dealt out over the languages, and the length of the piece of a text
# that is one.
LANDMARKS, PIECE = 192, 2000
# N-grams of 1 to ORDER letters (and blanks between words) are blended.
ORDER = 3
RIDGE = 1e-3
# Characters and documents that are worked on at once; a longer text goes in slices.
BLOCK_CHARS, BLOCK_DOCS = 1 << 18, 256
# Rows that are decoded at once, and numbers of the table of their n-grams.
BLOCK_ROWS, BLOCK_CELLS = 500, 1 << 21
# Codes up to this number are looked up in a table, others by bisection.
_TABLE = 1 << 22
_COLUMNS = 8192

UNKNOWN = "und"
HELD_OUT = "crc32(cast(cast(doc_id as string) as binary)) % 3"


@functools.lru_cache(maxsize=2)
def _folded(alphabet):
    """Of each code point: 0 if it is no letter, the number of its lower case in `alphabet`
    (from 1), or one more than the last number."""
    import numpy as np

    fold = np.zeros(0x110000, np.int32)
    number = {c: i + 1 for i, c in enumerate(alphabet)}
    for code in range(0x110000):
        letter = chr(code)
        if letter.isalpha():
            fold[code] = number.get(letter.lower()[0], len(alphabet) + 1)
    return fold


def _points(text):
    import numpy as np

    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


class Kernel:
    """The blended-spectrum presence kernel against fixed landmarks: k(s, t) is the number of
    n-grams that both hold, over the root of the product of their own numbers."""

    def __init__(self, pieces):
        import numpy as np

        self.alphabet = "".join(sorted({c.lower()[0] for p in pieces for c in p if c.isalpha()}))
        self._prepare()
        at, codes = [], []
        for i, piece in enumerate(pieces):
            for _, _, found in self._grams([piece]):
                found = np.unique(found)
                codes.append(found)
                at.append(np.full(len(found), i))
        pairs = np.unique(np.stack([np.concatenate(codes), np.concatenate(at)]), axis=1)
        self.vocabulary, rows = np.unique(pairs[0], return_inverse=True)
        held = np.zeros((len(self.vocabulary), len(pieces)), bool)
        held[rows, pairs[1]] = True
        self.size, self.own = len(pieces), np.maximum(held.sum(0), 1)
        self.held = np.packbits(held, axis=1)  # a row per n-gram, a bit per landmark

    def __getstate__(self):
        return {k: v for k, v in vars(self).items() if k not in ("fold", "lookup")}

    def __setstate__(self, state):
        vars(self).update(state)
        self._prepare()

    def _prepare(self):
        self.fold, self.lookup = _folded(self.alphabet), None
        self.base = len(self.alphabet) + 2
        self.first = [sum(self.base**n for n in range(1, order)) for order in range(1, ORDER + 1)]
        self.space = sum(self.base**n for n in range(1, ORDER + 1))

    def _columns(self, codes):
        """The row of each code in the vocabulary, or -1."""
        import numpy as np

        if self.space <= _TABLE:
            if self.lookup is None:
                self.lookup = np.full(self.space, -1, np.int32)
                self.lookup[self.vocabulary] = np.arange(len(self.vocabulary))
            return self.lookup[codes]
        at = np.searchsorted(self.vocabulary, codes)
        known = at < len(self.vocabulary)
        known[known] = self.vocabulary[at[known]] == codes[known]
        return np.where(known, at, -1)

    def _windows(self, ids, doc):
        """(doc, code) of all n-grams: blanks count once, and once at either end."""
        import numpy as np

        begins = np.concatenate([[True], doc[1:] != doc[:-1]])
        kept_ids = (ids != 0) | begins | np.concatenate([[True], ids[:-1] != 0])
        ids, doc = ids[kept_ids].astype(np.int64), doc[kept_ids]
        code = ids
        yield doc[ids > 0], ids[ids > 0] + self.first[0]
        for order in range(2, ORDER + 1):
            code = code[:-1] * self.base + ids[order - 1:]
            inside = doc[:len(code)] == doc[order - 1:]
            yield doc[:len(code)][inside], code[inside] + self.first[order - 1]

    def _grams(self, texts):
        """(letters, doc, code) arrays of the n-grams of some texts, or of slices of a long
        one; an n-gram may come out twice."""
        import numpy as np

        if len(texts) == 1 and len(texts[0]) > BLOCK_CHARS:
            text, carried = texts[0], np.zeros(1, np.int32)
            for begin in range(0, len(text), BLOCK_CHARS):
                ids = np.concatenate([carried, self.fold[_points(text[begin:begin + BLOCK_CHARS])]])
                if begin + BLOCK_CHARS >= len(text):
                    ids = np.append(ids, np.int32(0))
                some = np.array([(ids != 0).any()])
                for doc, codes in self._windows(ids, np.zeros(len(ids), np.int64)):
                    yield some, doc, codes
                # Enough letters and single blanks for the n-grams across the border.
                single = ids[(ids != 0) | np.concatenate([[True], ids[:-1] != 0])]
                carried = single[-(ORDER - 1):]
            return
        size = np.array([len(t) + 2 for t in texts], np.int64)
        ids = self.fold[_points(" " + "  ".join(texts) + " ")]
        doc = np.repeat(np.arange(len(texts)), size)
        letters = np.bincount(doc[ids != 0], minlength=len(texts)) > 0
        for found, codes in self._windows(ids, doc):
            yield letters, found, codes

    def against(self, texts):
        """The kernel of each text with each landmark, and whether the text has a letter."""
        import numpy as np

        present = np.zeros((len(texts), len(self.vocabulary)), np.float32)
        letters, unknown = np.zeros(len(texts), bool), []
        for some, doc, codes in self._grams(texts):
            letters |= some
            column = self._columns(codes)
            present[doc[column >= 0], column[column >= 0]] = 1
            unknown.append(np.unique(doc[column < 0] * self.space + codes[column < 0]))
        unknown = np.unique(np.concatenate(unknown)) if unknown else np.zeros(0, np.int64)
        own = present.sum(1) + np.bincount(unknown // self.space, minlength=len(texts))
        both = np.zeros((len(texts), self.size), np.float32)
        for begin in range(0, len(self.vocabulary), _COLUMNS):
            held = np.unpackbits(self.held[begin:begin + _COLUMNS], axis=1, count=self.size)
            both += present[:, begin:begin + _COLUMNS] @ held.astype(np.float32)
        return both / np.sqrt(np.maximum(own, 1))[:, None] / np.sqrt(self.own), letters

    def blocks(self, texts):
        """(begin, end) of stretches of `texts` that fit the bounds; a long text stands alone."""
        most = max(1, min(BLOCK_DOCS, BLOCK_CELLS // max(1, len(self.vocabulary))))
        begin, held = 0, 0
        for i, text in enumerate(texts):
            if i > begin and (held + len(text) > BLOCK_CHARS or i - begin >= most):
                yield begin, i
                begin, held = i, 0
            held += len(text)
        if begin < len(texts):
            yield begin, len(texts)


def _decoded(batches):
    """Stretches of the batches, each with its texts."""
    import pyarrow as pa

    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK_ROWS):
            rows = batch.slice(at, BLOCK_ROWS)
            packed = rows.column("text").cast(pa.binary()).to_pylist()
            yield rows, [(t or b"").decode("utf-8", "replace") for t in packed]


def sample_of(docs: DataFrame, per_language) -> DataFrame:
    """Written: (lang, doc_id, place, text), of each language at most `per_language` ids, by
    the least hash; of rows that repeat an id, the least text. The ranking carries no texts.
    Each task ranks its own rows first, then each of SHARES parts of a language is ranked, so
    that no task gets more than so many times the sample of a language."""
    known = docs.where(f"lang is not null and text is not null and {HELD_OUT} <> 1")
    ids = known.groupBy("lang", "doc_id").agg(F.count("*").alias("rows"))
    picked = ids.withColumn("share", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(SHARES)))
    for keys in (["lang", "share"], ["lang"]):
        order = Window.partitionBy(*keys).orderBy(F.xxhash64("doc_id"), "doc_id")
        picked = picked.withColumn("place", F.row_number().over(order)).where(F.col("place") <= per_language)
    picked = kept(picked.select("lang", "doc_id", "place"))
    return kept(known.join(few(picked), ["lang", "doc_id"]).groupBy("lang", "doc_id", "place").agg(
        F.min("text").alias("text")))


def train(docs: DataFrame, per_language=SAMPLE_PER_LANGUAGE, landmarks=LANDMARKS):
    """(kernel, weights, languages) learned from (doc_id, text, lang), or None without a usable
    row. Ids whose crc32 modulo 3 is 1 are held out, null ids and null languages not used.

    The driver gets the landmarks (their number and length are bounded) and the weights. The
    sampled texts are turned into kernel rows where they lie; one task solves the ridge
    regression for them, at most `per_language` rows of `landmarks` numbers a language."""
    import pickle

    sample = sample_of(docs.select("doc_id", F.col("text").cast("string").alias("text"),
                                   F.col("lang").cast("string").alias("lang")), per_language)
    start = 1 + F.pmod(F.xxhash64("doc_id", "lang"), F.greatest(F.length("text") - PIECE + 1, F.lit(1)))
    piece = F.substring("text", start.cast("int"), F.lit(PIECE))
    first = sample.select("lang", "place", piece.alias("piece")).where("piece rlike '\\\\p{L}'").orderBy(
        "place", "lang").limit(landmarks).collect()
    if not first:
        return None
    kernel = Kernel([r["piece"] for r in first])
    shared = docs.sparkSession.sparkContext.broadcast(kernel)

    def rows_of(batches):
        import numpy as np
        import pyarrow as pa

        for batch, texts in _decoded(batches):
            for begin, end in shared.value.blocks(texts):
                found, _ = shared.value.against(texts[begin:end])
                packed = [r.tobytes() for r in found.astype(np.float64)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("lang").slice(begin, end - begin), pa.array(packed, pa.binary())], ["lang", "row"])

    landmark_rows = kernel.against([r["piece"] for r in first])[0]

    def solve(group):
        import numpy as np
        import pyarrow as pa

        table_ = group.sort_by([("lang", "ascending"), ("row", "ascending")])
        names = table_.column("lang").to_pylist()
        languages = sorted(set(names))
        rows = np.frombuffer(b"".join(table_.column("row").to_pylist()), "<f8").reshape(len(names), -1)
        # Nyström: the inverse root of the landmarks' own kernel makes features of the rows.
        values, vectors = np.linalg.eigh((landmark_rows + landmark_rows.T).astype(float) / 2)
        good = values > 1e-6 * values[-1]
        root = vectors[:, good] / np.sqrt(values[good])
        features = rows @ root
        target = np.array(names, object)[:, None] == np.array(languages, object)[None, :]
        inner = features.T @ features + RIDGE * len(rows) * np.eye(features.shape[1])
        weights = root @ np.linalg.solve(inner, features.T @ target.astype(float))
        return pa.table({"model": pa.array([pickle.dumps((weights, languages))], pa.binary())})

    spread = sample.repartition("doc_id").mapInArrow(rows_of, "lang string, row binary")
    solved = spread.withColumn("one", F.lit(0)).groupBy("one").applyInArrow(solve, "model binary").first()
    weights, languages = pickle.loads(solved["model"])
    return kernel, weights, languages


def languages(docs: DataFrame, model, id_column="doc_id", text_column="text") -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of each row of `docs`, from its whole text.

    The language with the highest value of its regression (each learned as one against the
    rest), and that value cut to 0 to 1. Null texts, texts without a letter, and all texts
    without a model are `und` with score 0. A null id is not held out; repeated rows get the
    same; other columns are ignored; an empty table gives no rows. Long texts go in slices,
    in bounded memory.
    """
    docs = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    # At most LANDMARKS * PIECE * ORDER n-grams of 32 bytes.
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches):
        import numpy as np
        import pyarrow as pa

        for batch, texts in _decoded(batches):
            best, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
            if shared.value is not None:
                kernel, weights, names = shared.value
                for begin, end in kernel.blocks(texts):
                    found, letters = kernel.against(texts[begin:end])
                    values = found.astype(np.float64) @ weights
                    top = values.argmax(1)
                    for i in np.flatnonzero(letters).tolist():
                        best[begin + i] = names[top[i]]
                        score[begin + i] = min(1.0, max(0.0, values[i, top[i]]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(best, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    held = F.coalesce(F.expr(HELD_OUT) == 1, F.lit(False))
    return docs.mapInArrow(predict, f"doc_id {kind}, lang_pred string, score double").select(
        "doc_id", held.alias("held_out"), "lang_pred", "score")


def op13_language(spark: SparkSession, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    return languages(docs, train(docs))
