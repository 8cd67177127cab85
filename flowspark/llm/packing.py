"""Packing by concatenating and cutting (operator 1)."""

import zlib

from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowspark.llm.common import kept, table, utf8, worker_tables
from flowspark.llm.word_ids import word_ids

PIECES = (
    "doc_id {id}, start long, length long, ids_crc32 long, doc_tokens long, "
    "sequence_id long, offset long, ids array<int>"
)


def vocabulary(name="word_bpe_49k.json"):
    import public_tokenizers

    return public_tokenizers.path(name)


def token_table(docs: DataFrame, path=None, end_id=2, id_column="doc_id", text_column="text") -> DataFrame:
    """Written: (part, before, doc_id, n, ids) with the packed ids of each document and
    `end_id`; `before` counts the ids of the earlier documents of the same partition."""
    docs = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def encode(batches):
        import numpy as np
        import pyarrow as pa

        encoder = word_ids(path or vocabulary())
        worker_tables("packing", encoder.chunks, encoder.pieces)
        end, width = np.array([end_id], encoder.dtype).tobytes(), encoder.dtype.itemsize
        part, before = TaskContext.get().partitionId(), 0
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                rows = batch.slice(at, 1000)
                ids = [x + end for x in encoder.of(utf8(rows.column("text")))]
                n = np.array([len(x) // width for x in ids], np.int64)
                first = before + np.cumsum(n) - n
                before += int(n.sum())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(n), part)), pa.array(first), rows.column("doc_id"), pa.array(n),
                     pa.array(ids, pa.binary()), pa.array(np.full(len(n), width, np.int32))],
                    ["part", "before", "doc_id", "n", "ids", "width"])

    return kept(docs.mapInArrow(encode, f"part long, before long, doc_id {kind}, n long, ids binary, width int"))


def pack(docs: DataFrame, path=None, size=4096, end_id=2, with_ids=True, **columns) -> DataFrame:
    """All documents in one line of token ids, cut into sequences of `size` ids.

    Pass one encodes and writes the ids with prefix sums inside each partition. The totals
    (one row per partition) are summed up and sent to every task: the number of partitions
    bounds them. Pass two cuts each document where its global offsets cross a border. What
    is left after the last full sequence is cut at powers of two, so nothing is padded.

    A row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids
    (null unless `with_ids`). A null or empty text is one piece of the end id. Repeated rows
    and null ids are packed as they come; other columns are ignored; an empty table gives
    no rows.
    """
    tokens = token_table(docs, path, end_id, **columns)
    totals = tokens.groupBy("part").agg(F.sum("n").alias("total"))
    line = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select(
        "part", F.coalesce(F.sum("total").over(line), F.lit(0)).alias("base"),
        F.sum("total").over(Window.partitionBy()).alias("all"))
    placed = tokens.join(F.broadcast(bases), "part").select(
        "doc_id", "n", "ids", "width", (F.col("base") + F.col("before")).alias("at"), "all")
    kind = docs.schema[columns.get("id_column", "doc_id")].dataType.simpleString()

    def cut(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            out, found = [[] for _ in range(7)], []
            for row, (n, ids, width, at, total) in enumerate(zip(
                    *[batch.column(c).to_pylist() for c in ("n", "ids", "width", "at", "all")])):
                ids = np.frombuffer(ids, f"<u{width}").astype("<u4")
                full, start = total // size * size, 0
                while start < n:
                    where = at + start
                    if where < full:
                        sequence, begin, length = where // size, where // size * size, size
                    else:
                        sequence, begin = full // size, full
                        for bit in range((total - full).bit_length() - 1, -1, -1):
                            length = 1 << bit
                            if (total - full) & length:
                                if where < begin + length:
                                    break
                                sequence, begin = sequence + 1, begin + length
                    stop = min(n, start + begin + length - where)
                    piece = ids[start:stop]
                    values = (row, start, stop - start, zlib.crc32(piece), n, sequence, where - begin)
                    for column, value in zip(out, values):
                        column.append(value)
                    if with_ids:
                        found.append(piece.astype(np.int32))
                    start = stop
            pieces = len(out[0])
            if with_ids:
                ends = np.cumsum([0] + [len(p) for p in found]).astype(np.int32)
                lists = pa.ListArray.from_arrays(
                    pa.array(ends), pa.array(np.concatenate([*found, np.empty(0, np.int32)]).astype(np.int32)))
            else:
                lists = pa.nulls(pieces, pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(out[0], pa.int64())),
                 *[pa.array(c, pa.int64()) for c in out[1:]], lists],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"])

    return placed.mapInArrow(cut, PIECES.format(id=kind))


def op1_packing(spark: SparkSession, sf_dir) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), with_ids=False).drop("ids")
