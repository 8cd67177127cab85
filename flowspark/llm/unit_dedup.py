"""Exact removal of repeated lines or paragraphs (operator 5)."""

import hashlib

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowspark.llm.common import kept, table, utf8, words

# A repeated unit goes if it stands in a run of repeated units of so many words together. A
# passage is such a run; a short line that other texts have by chance is not.
RUN_WORDS = 16
SEPARATORS = {"line": b"\n", "paragraph": b"\n\n"}


def removed_units(docs: DataFrame, unit="line", run_words=RUN_WORDS) -> DataFrame:
    """Spans to remove from (doc_id, text): a row per document that has any repeated unit, with
    `n_repeated` and `spans`, an array of (place, start, length) in bytes of the original text.

    Units are normalised to their lower-cased words; units without words are no copies of
    one another. The earliest occurrence by (doc_id, place) of a digest stays. Of the others,
    those go that stand in a run of at least `run_words` words: repeated units that follow one
    another, with no unit in between but such without words.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    mark = SEPARATORS[unit]

    def cut(batches):
        import pyarrow as pa

        for batch in batches:
            rows, place, start, length, digests, order, size = [], [], [], [], [], [], []
            for row, text in enumerate(utf8(batch.column("text"))):
                at, worded = 0, 0
                for number, part in enumerate((text or b"").split(mark)):
                    found = words(part)
                    if found:
                        rows.append(row)
                        place.append(number)
                        start.append(at)
                        length.append(len(part))
                        order.append(worded)
                        size.append(len(found))
                        worded += 1
                        digests.append(hashlib.blake2b(b" ".join(found), digest_size=16).digest())
                    at += len(part) + len(mark)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(rows, pa.int64())), pa.array(place, pa.int32()),
                 pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(digests, pa.binary()),
                 pa.array(order, pa.int32()), pa.array(size, pa.int32())],
                ["doc_id", "place", "start", "length", "digest", "order", "words"])

    units = kept(docs.where("doc_id is not null").mapInArrow(
        cut, f"doc_id {kind}, place int, start long, length long, digest binary, order int, words int"))
    copies = units.groupBy("digest").agg(
        F.min(F.struct("doc_id", "place")).alias("first"), F.count("*").alias("n")).where("n > 1")
    gone = units.join(copies, "digest").where(F.struct("doc_id", "place") != F.col("first"))
    # Rows that repeat an id may bring a place twice.
    gone = gone.groupBy("doc_id", "order").agg(
        F.max("words").alias("words"), F.collect_set(F.struct("place", "start", "length")).alias("places"))
    # A window holds no more than the repeated units of one document.
    run = F.col("order") - F.row_number().over(Window.partitionBy("doc_id").orderBy("order"))
    gone = gone.withColumn("run", run).withColumn(
        "long", F.sum("words").over(Window.partitionBy("doc_id", "run")) >= run_words)
    spans = F.array_sort(F.flatten(F.collect_list(F.when(F.col("long"), F.col("places")))))
    return gone.groupBy("doc_id").agg(F.sum(F.size("places")).cast("long").alias("n_repeated"), spans.alias("spans"))


def dedup_units(docs: DataFrame, unit="line", run_words=RUN_WORDS, id_column="doc_id", text_column="text") -> DataFrame:
    """Each row of `docs` without the lines (or paragraphs) that occur earlier in the corpus,
    where they do so in runs of at least `run_words` words (1: all of them).

    doc_id, n_units, n_repeated (units that occur earlier), n_removed, spans (what went: place, start, length in bytes of the
    original), text (the units that stay, joined again). A null text has no units and stays
    null. Rows that repeat an id count as one document: what goes from one goes from all.
    A null id takes no part and keeps its text. An empty table gives no rows; other columns
    are ignored.
    """
    docs = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    mark = SEPARATORS[unit]
    spans = "array<struct<place:int,start:bigint,length:bigint>>"

    def rebuild(batches):
        import pyarrow as pa

        for batch in batches:
            n, gone, texts = [], [], []
            for text, lost in zip(utf8(batch.column("text")), batch.column("spans").to_pylist()):
                parts = text.split(mark) if text is not None else []
                out = {s["place"] for s in lost or () if s["place"] < len(parts)}
                n.append(len(parts))
                gone.append(len(out))
                texts.append(None if text is None else mark.join(p for i, p in enumerate(parts) if i not in out))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), batch.column("n_repeated"), pa.array(gone, pa.int64()),
                 batch.column("spans"), pa.array(texts, pa.binary()).cast(pa.string())],
                ["doc_id", "n_units", "n_repeated", "n_removed", "spans", "text"])

    return docs.join(removed_units(docs, unit, run_words), "doc_id", "left").select(
        "doc_id", "text", F.coalesce("spans", F.array().cast(spans)).alias("spans"),
        F.coalesce("n_repeated", F.lit(0).cast("long")).alias("n_repeated"),
    ).mapInArrow(rebuild, f"doc_id {kind}, n_units long, n_repeated long, n_removed long, spans {spans}, text string")


def op5_unit_dedup(spark: SparkSession, sf_dir) -> DataFrame:
    done = dedup_units(table(spark, sf_dir, "documents"))
    offset = F.transform("spans", lambda s: s["start"].cast("string"))
    return done.select(
        "doc_id", "n_units", "n_repeated", "n_removed", F.array_join(offset, ",").alias("removed_starts"),
        F.octet_length("text").cast("long").alias("kept_bytes"), F.sha2("text", 256).alias("kept_sha256"))


OP5_SQL = r"""
WITH cut AS (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents),
units AS (SELECT doc_id, unnest(range(len(parts))) AS place, unnest(parts) AS part FROM cut),
placed AS (
  SELECT doc_id, place, part,
    coalesce(sum(strlen(part) + 1) OVER (PARTITION BY doc_id ORDER BY place
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start,
    array_to_string(regexp_extract_all(
      translate(part, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), ' ') AS words
  FROM units),
ranked AS (
  SELECT *, CASE WHEN words <> '' THEN len(string_split(words, ' ')) END AS n_words,
    sum(CAST(words <> '' AS INT)) OVER (PARTITION BY doc_id ORDER BY place) AS worded,
    words <> '' AND row_number() OVER (PARTITION BY words ORDER BY doc_id, place) > 1 AS repeated
  FROM placed),
runs AS (
  SELECT doc_id, place, worded - row_number() OVER (PARTITION BY doc_id ORDER BY worded) AS run, n_words
  FROM ranked WHERE repeated),
long AS (
  SELECT doc_id, place FROM (
    SELECT *, sum(n_words) OVER (PARTITION BY doc_id, run) AS together FROM runs) WHERE together >= 16),
marked AS (
  SELECT r.*, l.place IS NOT NULL AS gone FROM ranked r LEFT JOIN long l ON r.doc_id = l.doc_id AND r.place = l.place),
kept AS (
  SELECT doc_id, count(*) AS n_units, count(*) FILTER (repeated) AS n_repeated, count(*) FILTER (gone) AS n_removed,
    coalesce(string_agg(CAST(CAST(start AS BIGINT) AS VARCHAR), ',' ORDER BY place) FILTER (gone), '') AS removed_starts,
    coalesce(string_agg(part, chr(10) ORDER BY place) FILTER (NOT gone), '') AS text
  FROM marked GROUP BY doc_id)
SELECT doc_id, n_units, n_repeated, n_removed, removed_starts, strlen(text) AS kept_bytes, sha256(text) AS kept_sha256
FROM kept
"""
