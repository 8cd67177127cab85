"""Work over pairs of rows, cut into blocks of bounded size.

Both sides are split into blocks by a hash of their id, so every task sees at most a
block of each, whatever the data's skew. Kernels return per-row results (a top-k, a
sum), never the pairs.
"""

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from flowspark.functions.vector import matrix, nearest, squared_distances, tiles
from flowspark.session import cut

BLOCK_ROWS = 1 << 14

HITS = "query_id long, id long, distance double"


def small_table(spark, rows, schema):
    """A table of a few tuples. By way of Arrow no task makes it: `createDataFrame` of a list
    would start further Python workers on each executor, which stay."""
    kinds = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64()}
    fields = [pa.field(name, kinds[kind]) for name, kind in (f.split() for f in schema.split(","))]
    values = list(zip(*rows)) or [()] * len(fields)
    columns = [pa.array(v, f.type) for v, f in zip(values, fields)]
    return spark.createDataFrame(pa.Table.from_arrays(columns, schema=pa.schema(fields)))


def _blocks_of(count, block_rows):
    return max(1, -(-count // block_rows))


def block_matrix(left, right, kernel, schema, left_id, right_id, block_rows=BLOCK_ROWS):
    """`kernel(left block, right block)` for every pair of blocks."""
    nl = _blocks_of(left.count(), block_rows)
    nr = _blocks_of(right.count(), block_rows)

    def split(df, column, own, n_own, other, n_other):
        return df.withColumns(
            {
                own: F.pmod(F.xxhash64(column), F.lit(n_own)),
                other: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_other - 1).cast("long"))),
            }
        )

    l = split(left, left_id, "_lb", nl, "_rb", nr)
    # Renamed to themselves, the columns of a table met with itself are told apart.
    r = split(right.toDF(*right.columns), right_id, "_rb", nr, "_lb", nl)
    cells = l.groupBy("_lb", "_rb").cogroup(r.groupBy("_lb", "_rb"))
    return cells.applyInPandas(kernel, schema)


def nearest_in_block(k, exclude_self=False):
    """A function of a block of queries and a block of entries: the k best hits of each query."""

    def top(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "id": [], "distance": []})
        query_ids, ids = left["query_id"].to_numpy(), right["_id"].to_numpy()

        def same(part):
            return query_ids[part, None] == ids[None, :]

        at, found, d = nearest(
            matrix(left["vector"]), matrix(right["embedding"]), ids, k, same if exclude_self else None
        )
        return pd.DataFrame({"query_id": query_ids[at], "id": found, "distance": d})

    return top


def best_hits(hits: DataFrame, k) -> DataFrame:
    """The k best hits of each query with their rank, ties by id."""
    order = Window.partitionBy("query_id").orderBy("distance", "id")
    return (
        hits.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "distance", "id")
    )


def without_surplus_copies(entries: DataFrame, copies) -> DataFrame:
    """Of equal vectors only the `copies` smallest ids: a search by (distance, id) needs
    no more. Each task drops its own surplus before the shuffle."""
    same = Window.partitionBy("embedding").orderBy("_id")
    return entries.withColumn("_rn", F.row_number().over(same)).where(
        F.col("_rn") <= copies
    ).drop("_rn")


def knn_join(
    queries, entries, k, exclude_self=False, pivots=128, block_rows=BLOCK_ROWS, rings=32
):
    """Exact k nearest entries for a query set of any size.

    Entries are grouped by their nearest pivot, and large groups into rings by their
    distance to it. A query first meets one block of its own ring, which bounds how far
    its k-th neighbour can be; then it is sent only to the rings that the triangle
    inequality cannot rule out under that bound. Rings with many entries, or many
    queries, are split into blocks on both sides.

    `queries` has `query_id` and `vector`, `entries` has `_id` and `embedding`.
    """
    spark = entries.sparkSession
    need = k + (1 if exclude_self else 0)
    entries = without_surplus_copies(
        entries.where(F.col("embedding").isNotNull()).select("_id", "embedding"), need
    )
    chosen = entries.orderBy(F.xxhash64("_id"), "_id").limit(pivots).collect()
    if not chosen:
        return best_hits(small_table(spark, [], HITS), k)
    number = len(chosen)
    centres = spark.sparkContext.broadcast(
        np.array([row["embedding"] for row in chosen], np.float64)
    )
    kind = T.StructType(
        [T.StructField("cell", T.IntegerType()), T.StructField("away", T.DoubleType())]
    )

    @F.pandas_udf(kind)
    def place(v: pd.Series) -> pd.DataFrame:
        if not len(v):
            return pd.DataFrame({"cell": [], "away": []})
        d = squared_distances(matrix(v), centres.value)
        cell = d.argmin(1)
        return pd.DataFrame({"cell": cell, "away": np.sqrt(d[np.arange(len(d)), cell])})

    # Met several times below, so written once.
    placed = cut(
        entries.withColumn("_p", place("embedding")).select(
            "_id", "embedding", "_p.cell", "_p.away"
        )
    )
    # One row per pivot, so no more than `pivots` rows.
    spans = {
        r["cell"]: r
        for r in placed.groupBy("cell")
        .agg(F.count(F.lit(1)).alias("n"), F.min("away").alias("lo"), F.max("away").alias("hi"))
        .collect()
    }
    ring_rows = []
    for cell in range(number):
        span = spans.get(cell)
        count = min(rings, _blocks_of(span["n"], block_rows)) if span else 1
        width = (span["hi"] - span["lo"]) / count if span else 0.0
        ring_rows.append((cell, count, span["lo"] if span else 0.0, width))
    # One row per pivot here too.
    shape = F.broadcast(small_table(spark, ring_rows, "cell int, _rings int, _lo double, _width double"))
    ring = F.when(F.col("_width") > 0, F.floor((F.col("away") - F.col("_lo")) / F.col("_width")))
    ring = F.least(F.greatest(F.coalesce(ring, F.lit(0)), F.lit(0)), F.col("_rings") - 1)

    def in_rings(df):
        return df.join(shape, "cell").withColumn("part", F.col("cell") * rings + ring.cast("int"))

    placed = in_rings(placed).select("_id", "embedding", "away", "part")
    # No more than `pivots` × `rings` rows.
    parts = sorted(
        placed.groupBy("part")
        .agg(F.count(F.lit(1)).alias("n"), F.min("away").alias("lo"), F.max("away").alias("hi"))
        .collect()
    )
    name, size = (np.array([r[i] for r in parts], np.int64) for i in (0, 1))
    low, high = (np.array([r[i] for r in parts]) for i in (2, 3))
    bounds = spark.sparkContext.broadcast((name, size, low, high))
    entry_blocks = {int(p): _blocks_of(int(n), block_rows) for p, n in zip(name, size)}

    def in_block_pairs(routed, one_block):
        """Top-k of each routed query in its part's blocks (or in one of them)."""
        asked = {r["part"]: r["count"] for r in routed.groupBy("part").count().collect()}
        plan = []
        for p, n in asked.items():
            blocks = entry_blocks.get(p, 1)
            share = -(-n // blocks) if one_block else n
            plan.append((p, blocks, _blocks_of(share, block_rows)))
        plan = F.broadcast(  # no more than `pivots` × `rings` rows
            small_table(spark, plan or [(-1, 1, 1)], "part int, _ne int, _nq int")
        )
        own_q = F.pmod(F.xxhash64("query_id"), F.col("_nq")).cast("int")
        own_e = F.pmod(F.xxhash64("_id"), F.col("_ne")).cast("int")
        if one_block:
            met = F.pmod(F.xxhash64("query_id", F.lit(1)), F.col("_ne")).cast("int")
        else:
            met = F.explode(F.sequence(F.lit(0), F.col("_ne") - 1))
        all_q = F.explode(F.sequence(F.lit(0), F.col("_nq") - 1))
        q = routed.join(plan, "part").select(
            "part", "query_id", "vector", own_q.alias("_qb"), met.alias("_eb")
        )
        e = placed.join(plan, "part").select(
            "part", "_id", "embedding", own_e.alias("_eb"), all_q.alias("_qb")
        )

        key = ["part", "_qb", "_eb"]
        top = nearest_in_block(k, exclude_self)
        return q.groupBy(*key).cogroup(e.groupBy(*key)).applyInPandas(top, HITS)

    queries = queries.select("query_id", "vector")
    home = queries.withColumn("_p", place("vector")).select(
        "query_id", "vector", "_p.cell", "_p.away"
    )
    home = in_rings(home).select("query_id", "vector", "part")
    first = best_hits(in_block_pairs(home, one_block=True), k)
    reach = first.groupBy("query_id").agg(
        F.when(F.count(F.lit(1)) >= k, F.sqrt(F.max("distance"))).alias("reach")
    )
    reach = cut(reach)

    def parts_within(vectors, found):
        name, size, low, high = bounds.value
        pivot, cell = centres.value, name // rings
        squared = squared_distances(vectors, pivot)
        d = np.sqrt(squared)
        to_part = d[:, cell]
        # Parts whose every entry is near enough to hold `need` entries.
        farthest = to_part + high
        order = np.argsort(farthest, axis=1)
        enough = np.cumsum(size[order], axis=1) >= need
        at = np.where(enough.any(1), enough.argmax(1), -1)
        reached = np.take_along_axis(farthest, order, 1)[np.arange(len(d)), at]
        bound = np.fmin(np.where(at >= 0, reached, np.inf), found)
        closest = np.maximum(to_part - high, np.maximum(low - to_part, 0.0))
        # Entries of another cell lie beyond the plane halfway to its pivot.
        apart = np.sqrt(squared_distances(pivot, pivot))[squared.argmin(1)]
        half = np.divide(
            squared - squared.min(1, keepdims=True),
            2 * apart,
            out=np.zeros_like(d),
            where=apart > 1e-9,
        )
        closest = np.maximum(closest, half[:, cell])
        wanted = closest <= (bound + 1e-7 * (1.0 + bound))[:, None]
        return [name[row].astype(np.int32) for row in wanted]

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def parts_in_reach(v: pd.Series, found: pd.Series) -> pd.Series:
        out, known = [], found.to_numpy(np.float64, na_value=np.nan)
        # A dozen numbers or so are worked out for each query and part.
        for tile in tiles(len(v), 4 * len(bounds.value[0])):
            out += parts_within(matrix(v.iloc[tile]), known[tile])
        return pd.Series(out, dtype=object)

    routed = queries.join(reach, "query_id", "left").select(
        "query_id", "vector", F.explode(parts_in_reach("vector", "reach")).alias("part")
    )
    return best_hits(in_block_pairs(routed, one_block=False), k)
