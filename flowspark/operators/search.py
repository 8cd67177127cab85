"""Nearest-neighbour search over store entries, and what is built on it.

Entries have `_id` and `embedding`, query frames `query_id` and `vector`. Distances
are squared Euclidean. Results have `query_id, rank, distance, id`; ties go to the
smaller id.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from flowspark.functions.vector import keep_nearest, nearest
from flowspark.operators.blocks import HITS, best_hits, knn_join
from flowspark.operators.ids import mixed
from flowspark.operators.index import HashTables, InvertedLists, store_index  # noqa: F401
from flowspark.operators.metadata import matching
from flowspark.session import scratch_dir

MAX_BROADCAST_QUERIES = 2048

# The wording of a context text, one line after the other.
CONTEXT_HEADER = "Here are the most relevant network flows:"
CONTEXT_LINES = [
    "Flow %d:",
    "  - Connection: %s:%s → %s:%s",
    "  - Protocol: %s / %s",
    "  - Duration: %.3fs",
    "  - Total bytes: %.0f",
    "  - Packets: %.0f",
    "  - Similarity score: %.4f",
]
CONTEXT_NONE = "No relevant flows found in the database."


def query_rows(entries: DataFrame) -> DataFrame:
    """Entries in the role of queries."""
    return entries.select(F.col("_id").alias("query_id"), F.col("embedding").alias("vector"))


def query_vector(spark, vector, query_id=0) -> DataFrame:
    return spark.createDataFrame(
        [(query_id, [float(x) for x in vector])], "query_id long, vector array<double>"
    )


def _bounded(queries, limit):
    """Query ids and vectors on the driver, or None when there are more than `limit`."""
    rows = queries.select("query_id", "vector").limit(limit + 1).collect()
    if len(rows) > limit:
        return None
    ids = np.array([r["query_id"] for r in rows], np.int64)
    if not rows:
        return ids, np.zeros((0, 0))
    return ids, np.array([r["vector"] for r in rows], np.float64)


def _rows_of(batch: pa.RecordBatch, column):
    """An Arrow list column without nulls as a matrix."""
    values = batch.column(column)
    return values.flatten().to_numpy(zero_copy_only=False).reshape(len(batch), -1).astype(
        np.float64
    )


def _scan(entries, ids, vectors, k, exclude_self=False, allowed=None, extra=()):
    """Each task keeps the k best of its rows for every query.

    `allowed(batch)` may mask pairs: a boolean matrix (queries × rows).
    """
    shared = entries.sparkSession.sparkContext.broadcast((ids, vectors))

    def top(batches):
        query_ids, q = shared.value
        best = None
        for batch in batches:
            if not len(batch) or not len(q):
                continue
            row_ids = batch.column("_id").to_numpy()
            mask = allowed(batch) if allowed is not None else None

            def forbidden(part, mask=mask, row_ids=row_ids):
                out = np.zeros((len(query_ids[part]), len(row_ids)), bool)
                if mask is not None:
                    out |= ~mask[part]
                if exclude_self:
                    out |= query_ids[part, None] == row_ids[None, :]
                return out

            used = forbidden if exclude_self or mask is not None else None
            hits = nearest(q, _rows_of(batch, "embedding"), row_ids, k, used)
            if best is not None:
                hits = keep_nearest(*[np.concatenate(p) for p in zip(best, hits)], k)
            best = hits
        if best is not None:
            at, found, d = best
            yield pa.RecordBatch.from_arrays(
                [pa.array(query_ids[at]), pa.array(found), pa.array(d)],
                names=["query_id", "id", "distance"],
            )

    rows = entries.where(F.col("embedding").isNotNull()).select("_id", "embedding", *extra)
    return rows.mapInArrow(top, HITS)


def knn(entries, queries, k=10, exclude_self=False, max_broadcast=MAX_BROADCAST_QUERIES):
    """Exact search. A counted, small query set is broadcast and the store scanned once
    with no shuffle but that of the hits; a larger one is joined by cells."""
    small = _bounded(queries, max_broadcast)
    if small is None:
        return knn_join(queries, entries, k, exclude_self)
    return best_hits(_scan(entries, *small, k, exclude_self), k)


def with_records(hits: DataFrame, entries: DataFrame, *columns) -> DataFrame:
    """Hits with the stored record of each (as `metadata`, or the named columns)."""
    if columns:
        records = entries.select(F.col("_id").alias("id"), *columns)
    else:
        rest = [c for c in entries.columns if c not in ("_id", "embedding")]
        records = entries.select(F.col("_id").alias("id"), F.struct(*rest).alias("metadata"))
    return hits.join(records, "id")


def search(entries, queries, k=10, filters=None, mode="pre", **options):
    """Search with equality filters on nested record fields.

    `pre` filters the store and then takes the k nearest, so it always finds k when
    there are k. `post` takes the 10·k nearest and filters those.
    """
    if not filters:
        return knn(entries, queries, k, **options)
    if mode == "pre":
        return knn(matching(entries, filters), queries, k, **options)
    if mode != "post":
        raise ValueError(f"unknown filter mode: {mode}")
    hits = knn(entries, queries, 10 * k, **options).drop("rank")
    kept = matching(entries, filters).select(F.col("_id").alias("id"))
    return best_hits(hits.join(kept, "id", "left_semi"), k)


def nearest_zero_by_protocol(entries, protocol, dimension, k=10):
    """Entries of a transport protocol, nearest to the zero vector first."""
    zero = query_vector(entries.sparkSession, [0.0] * dimension)
    return search(entries, zero, k, {"protocol.proto": protocol})


def find_similar(entries, index, k=5):
    """The k entries nearest to a stored one, without itself."""
    own = entries.where(F.col("_id") == index)
    if index < 0 or own.isEmpty():
        raise IndexError(f"no flow {index}")
    return knn(entries, query_rows(own), k, exclude_self=True)


def nearest_other(entries, sample):
    """For each sampled entry the nearest other one (`id`, `neighbour`, `distance`)."""
    hits = knn(entries, query_rows(sample), 1, exclude_self=True)
    return hits.select(
        F.col("query_id").alias("id"), F.col("id").alias("neighbour"), "distance"
    )


def _far(pairs, threshold, k):
    return pairs.where(F.col("distance") > threshold).orderBy(F.desc("distance"), "id").limit(k)


def anomalies(entries, threshold=2.0, k=10, sample_size=100):
    """Entries far from every other, the farthest first. Looks at the first
    `sample_size` entries, or at all of them with None."""
    sample = entries if sample_size is None else entries.orderBy("_id").limit(sample_size)
    return _far(nearest_other(entries, sample), threshold, k)


def anomalies_sampled(entries, threshold=2.0, k=50, seed=42, least=10):
    """The same over `k` entries drawn without replacement; none from a tiny store."""
    sample = entries.orderBy(mixed("_id", 48271, seed), "_id").limit(k)
    found = _far(nearest_other(entries, sample), threshold, k)
    if len(entries.select("_id").limit(least).collect()) < least:
        return found.limit(0)
    return found


def rag_context(entries, queries, k=5, sep="\n"):
    """One text per query that describes its nearest flows."""
    hits = with_records(
        knn(entries, queries, k), entries, "flow_id", "statistical", "protocol"
    )

    def text(path):
        return F.coalesce(F.col(path).cast("string"), F.lit("None"))

    def number(name):
        return F.coalesce(F.col(f"statistical.{name}"), F.lit(0.0))

    described = F.format_string(
        sep.replace("%", "%%").join(CONTEXT_LINES),
        F.col("rank"),
        *[text(f"flow_id.{f}") for f in ("src_ip", "src_port", "dst_ip", "dst_port")],
        text("protocol.proto"),
        text("protocol.app_proto"),
        *[number(f) for f in ("flow_duration", "total_bytes", "packet_count")],
        F.col("distance"),
    )
    # At most k short texts per query.
    parts = hits.groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", described.alias("text")))).alias("parts")
    )
    joined = F.concat_ws(sep, F.lit(CONTEXT_HEADER), F.transform("parts", lambda p: p["text"]))
    none = F.lit(CONTEXT_NONE)
    return (
        queries.select("query_id")
        .join(parts, "query_id", "left")
        .select("query_id", F.when(F.col("parts").isNull(), none).otherwise(joined).alias("context"))
    )


def knn_lsh(entries, queries, k=10, tables=8, width=2.0, seed=42, projections=4, probes=2):
    """Approximate search of rows that have no stored index: hash tables are written for this
    one search. A store keeps its tables (`indexed_search`)."""
    index = HashTables.build(
        entries, scratch_dir(entries.sparkSession), tables=tables, projections=projections, width=width, seed=seed
    )
    return index.search(queries, k, probes)


def indexed_search(store, queries, k=10, filters=None, probes=None, **options):
    """Search a `FlowStore` the way its index type says. Filtered search is exact.

    An index is trained once and kept beside the store; only parts that it does not have
    yet are added to it.
    """
    if filters or store.index_type == "flatl2":
        return search(store.entries(), queries, k, filters, **options)
    index, parts = store_index(store)
    probes = probes or (8 if store.index_type == "ivfflat" else 2)
    return index.search(queries, k, probes, parts)
