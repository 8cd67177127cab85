"""Fill-in-middle transformation with a wavelet matrix over character classes (operator 12)."""

import hashlib
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowspark.llm.common import table

# Classes of the bytes of a UTF-8 text; every byte has one.
OTHER, CONTINUATION, NEWLINE, BLANK, STOP, PAUSE, DIGIT = range(7)
_BITS = 3
_MEMBERS = {NEWLINE: b"\n", BLANK: b" \t\r\x0b\x0c", STOP: b".!?", PAUSE: b",;:", DIGIT: b"0123456789"}
CLASS_OF = bytes(
    next((c for c, members in _MEMBERS.items() if b in members), CONTINUATION if 128 <= b < 192 else OTHER)
    for b in range(256)
)
# A unit goes on to the next byte of one of these classes, which it includes, or to the end.
UNITS = {
    "line": (NEWLINE,),
    "word": (BLANK, NEWLINE),
    "sentence": (STOP, NEWLINE),
    "clause": (PAUSE, STOP, NEWLINE),
}
# Texts of one matrix: so many bytes, or a single longer text.
BLOCK_BYTES = 8 << 20


class WaveletMatrix:
    """Ranks and places of small codes: a bit vector per bit of the code, the highest first,
    each in the order that the bits above have sorted the sequence into. With counts before
    each word of 64 bits, a rank costs two look-ups a level, whatever the length."""

    def __init__(self, codes, bits=_BITS):
        import numpy as np

        self.size, self.bits, self.levels = len(codes), bits, []
        for level in range(bits - 1, -1, -1):
            bit = (codes >> level & 1).astype(bool)
            # One word more than needed, so that the rank of the whole has a word too.
            packed = np.zeros((len(codes) // 64 + 1) * 8, np.uint8)
            found = np.packbits(bit, bitorder="little")
            packed[:len(found)] = found
            words = packed.view("<u8")
            before = np.zeros(len(words) + 1, np.int64)
            np.cumsum(np.bitwise_count(words), out=before[1:])
            self.levels.append((words, before, self.size - int(before[-1])))
            codes = np.concatenate([codes[~bit], codes[bit]])

    @staticmethod
    def _ones(words, before, at):
        import numpy as np

        word, inside = at >> 6, (at & 63).astype(np.uint64)
        mask = (np.uint64(1) << inside) - np.uint64(1)
        return before[word] + np.bitwise_count(words[word] & mask)

    def _down(self, code, at):
        """Where the first `at` members go: the place in the lowest order."""
        for level, (words, before, zeros) in zip(range(self.bits - 1, -1, -1), self.levels):
            ones = self._ones(words, before, at)
            at = zeros + ones if code >> level & 1 else at - ones
        return at

    def rank(self, code, at):
        """How many of the first `at` members (an array) are `code`."""
        import numpy as np

        return self._down(code, at) - self._down(code, np.zeros(1, np.int64))

    def select(self, code, number):
        """The place of the occurrence `number` (an array, from 0) of `code`."""
        import numpy as np

        at = self._down(code, np.zeros(1, np.int64)) + number
        for level, (words, before, zeros) in enumerate(reversed(self.levels)):
            if code >> level & 1:
                at = _place(words, before, at - zeros)
            else:
                at = _place(~words, np.arange(len(before)) * 64 - before, at)
        return at

    def rank_any(self, codes, at):
        return sum(self.rank(code, at) for code in codes)

    def select_any(self, codes, number):
        """The place of occurrence `number` of any of `codes`: by bisection on summed ranks."""
        import numpy as np

        if len(codes) == 1:
            return self.select(codes[0], number)
        low, high = np.zeros_like(number), np.full_like(number, self.size - 1)
        for _ in range(self.size.bit_length()):
            middle = (low + high) >> 1
            enough = self.rank_any(codes, middle + 1) > number
            low, high = np.where(enough, low, np.minimum(middle + 1, high)), np.where(enough, middle, high)
        return high


def _place(words, before, number):
    """Place of the set bit `number`: its word by bisection, its bit by halving the word."""
    import numpy as np

    at = np.searchsorted(before, number, side="right") - 1
    word, left = words[at], number - before[at]
    inside = np.zeros_like(number)
    for width in (32, 16, 8, 4, 2, 1):
        low = np.bitwise_count(word & np.uint64((1 << width) - 1)).astype(np.int64)
        over = left >= low
        left = np.where(over, left - low, left)
        word = np.where(over, word >> np.uint64(width), word)
        inside += np.where(over, width, 0)
    return at * 64 + inside


def _shares(seed, doc_id):
    """Four unsigned 32-bit numbers of a document."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[i:i + 8], 16) for i in range(0, 32, 8)]


def _check_marks(marks):
    """Marks that may be told from any text around them: no end of one begins another."""
    for a in marks:
        for b in marks:
            if a == "" or any(b.startswith(a[i:]) for i in range(1, len(a))):
                raise ValueError(f"marks that overlap: {marks}")
    if len(set(marks)) < 3 or any(a != b and a in b for a in marks for b in marks):
        raise ValueError(f"marks that contain each other: {marks}")


def fill_in_middle(docs: DataFrame, unit="line", rate=100, spm=50, seed=7, marks=("<P>", "<S>", "<M>"),
                   id_column="doc_id", text_column="text") -> DataFrame:
    """Each row's text cut in prefix, middle and suffix, and put together with the middle last.

    A unit is a run of characters up to and with an end of line (or one of the classes of
    `unit`), or what is left at the end. Of the n units, both cuts lie after a number of units
    drawn from the id. `rate` of 100 texts are transformed, of these `spm` of 100 with the
    suffix first. The texts of a batch are one sequence of classes in one wavelet matrix: n is
    a difference of ranks, the cuts are selected, and lengths in characters are lengths in
    bytes without the rank of continuation bytes.

    doc_id, n, form (plain, psm, spm), prefix_chars, middle_chars (null if plain), output.
    Null texts count as empty. Empty texts, and texts that hold a mark, are plain: output is
    the text itself. A null id draws as an empty one; rows that repeat an id are each
    transformed; other columns are ignored; an empty table gives no rows. A text of any length
    is transformed whole, in memory of a few times its size.
    """
    _check_marks(marks)
    docs = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    ends = UNITS[unit]

    def transform(batches):
        import numpy as np
        import pyarrow as pa

        p, s, m = (mark.encode() for mark in marks)

        def of(rows, texts):
            size = np.array([len(t) for t in texts], np.int64)
            stop = np.cumsum(size)
            start = stop - size
            codes = np.frombuffer(b"".join(texts).translate(CLASS_OF), np.uint8)
            matrix = WaveletMatrix(codes)
            first = matrix.rank_any(ends, start)
            whole = matrix.rank_any(ends, stop) - first
            # What follows the last end is a unit as well.
            open_end = np.isin(codes[np.maximum(stop - 1, 0)], ends, invert=True) & (size > 0) if len(codes) else size > 0
            n = whole + open_end
            draws = np.array([_shares(seed, i) for i in rows.column("doc_id").to_pylist()], np.int64)
            drawn = np.sort(draws[:, :2] % (n + 1)[:, None], axis=1)
            plain = (size == 0) | (draws[:, 2] % 100 >= rate)
            cuts = []
            for number in drawn.T:
                at = np.where(number == 0, start, stop)
                inner = (number > 0) & (number <= whole)
                at[inner] = matrix.select_any(ends, (first + number - 1)[inner]) + 1
                cuts.append(at)
            marked = [start, *cuts]
            chars = [at - matrix.rank(CONTINUATION, at) for at in marked]
            forms, outputs = [], []
            for text, a, b, is_plain, share in zip(texts, cuts[0] - start, cuts[1] - start, plain, draws[:, 3] % 100):
                if is_plain or p in text or s in text or m in text:
                    forms.append("plain")
                    outputs.append(text)
                elif share < spm:
                    forms.append("spm")
                    outputs.append(b"".join((s, text[b:], p, text[:a], m, text[a:b])))
                else:
                    forms.append("psm")
                    outputs.append(b"".join((p, text[:a], s, text[b:], m, text[a:b])))
            none = np.array([f == "plain" for f in forms], bool)
            return pa.RecordBatch.from_arrays(
                [rows.column("doc_id"), pa.array(n), pa.array(forms, pa.string()),
                 pa.array(chars[1] - chars[0], mask=none), pa.array(chars[2] - chars[1], mask=none),
                 pa.array(outputs, pa.binary()).cast(pa.string())],
                ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

        for batch in batches:
            texts = [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]
            begin, held = 0, 0
            for i, text in enumerate(texts):
                if held and held + len(text) > BLOCK_BYTES:
                    yield of(batch.slice(begin, i - begin), texts[begin:i])
                    begin, held = i, 0
                held += len(text)
            if begin < len(texts):
                yield of(batch.slice(begin), texts[begin:])

    return docs.mapInArrow(
        transform, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output, form, marks=("<P>", "<S>", "<M>")):
    """The text that `fill_in_middle` made `output` from, as a column."""
    either = "|".join(re.escape(mark) for mark in marks)
    parts = F.split(output, either, -1)
    first, second, middle = (F.get(parts, F.lit(i)) for i in (1, 2, 3))
    return (
        F.when(form == "plain", output)
        .when(form == "psm", F.concat(first, middle, second))
        .otherwise(F.concat(second, middle, first))
    )


def op12_fill_in_middle(spark: SparkSession, sf_dir) -> DataFrame:
    done = fill_in_middle(table(spark, sf_dir, "documents"))
    return done.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


OP12_SQL = r"""
WITH given AS (SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || doc_id) AS h FROM documents),
drawn AS (
  SELECT doc_id, text, string_split(text, chr(10)) AS parts,
    CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2,
    CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4
  FROM given),
counted AS (SELECT *, len(parts) - CAST(parts[len(parts)] = '' AS BIGINT) AS n FROM drawn),
placed AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b FROM counted),
cut AS (
  SELECT doc_id, text, n, h3, h4,
    CASE WHEN a = 0 THEN '' ELSE array_to_string(parts[1:a], chr(10)) || CASE WHEN a < len(parts) THEN chr(10) ELSE '' END END AS p,
    CASE WHEN b = 0 THEN '' ELSE array_to_string(parts[1:b], chr(10)) || CASE WHEN b < len(parts) THEN chr(10) ELSE '' END END AS pm
  FROM placed),
formed AS (
  SELECT *, substr(text, length(p) + 1, length(pm) - length(p)) AS m, substr(text, length(pm) + 1) AS s,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 100
      THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
  FROM cut)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
  CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
    ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(CASE WHEN form = 'plain' THEN text ELSE p || m || s END) AS restored_sha256
FROM formed
"""
