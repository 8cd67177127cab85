"""Approximate search through stored indexes: inverted lists and hash tables.

Both keep rows under a bucket: a list, or a cell of a hash table. An index is trained once;
after that every part of a store adds rows of its own, and a search names the parts it reads,
so what has been replaced is never found. Queries are sent to the buckets they probe and
joined there with the rows. A bucket with many rows, or many queries, is split on both sides.
"""

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, functions as F, types as T

from flowspark.functions.vector import matrix, squared_distances
from flowspark.operators.blocks import BLOCK_ROWS, HITS, best_hits, nearest_in_block
from flowspark.operators.ids import broadcast_if_small
from flowspark.session import cut
from flowspark.sources.store import folder_names

# Fixed value: inverted lists of an `ivfflat` store.
LISTS = 100
WHOLE = "all"
# Buckets whose blocks are counted out to every task; more are joined by a shuffle.
MOST_PLANNED = 100_000
ROUTED = "query_id long, vector array<double>, bucket long"


def join_buckets(routed: DataFrame, rows: DataFrame, k, block_rows=BLOCK_ROWS) -> DataFrame:
    """The k best hits of queries (query_id, vector, bucket) among the rows (bucket, _id,
    embedding) of the same buckets. A pair that meets in several buckets is one hit."""
    routed = cut(routed.select("query_id", "vector", "bucket").distinct())
    asked = routed.groupBy("bucket").agg(F.count(F.lit(1)).alias("_asked"))
    # Rows of buckets that nobody asks for go before anything is shuffled, if the list of
    # buckets is small.
    rows = rows.select("bucket", "_id", "embedding").where(F.col("embedding").isNotNull())
    rows = rows.join(broadcast_if_small(asked.select("bucket")), "bucket", "left_semi")
    held = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("_held"))

    def blocks(count):
        return F.ceil(F.col(count) / block_rows).cast("int")

    plan = asked.join(held, "bucket").select("bucket", blocks("_asked").alias("_nq"), blocks("_held").alias("_ne"))
    plan = cut(plan)
    small = plan.limit(MOST_PLANNED + 1).count() <= MOST_PLANNED

    def side(df, own, n_own, other, n_other, *key):
        # Renamed to themselves, the columns of a table met with itself are told apart.
        own_plan = plan.toDF(*plan.columns)
        return df.join(F.broadcast(own_plan) if small else own_plan, "bucket").withColumns({
            own: F.pmod(F.xxhash64(*key), F.col(n_own)).cast("int"),
            other: F.explode(F.sequence(F.lit(0), F.col(n_other) - 1)),
        })

    q = side(routed, "_qb", "_nq", "_eb", "_ne", "query_id", "vector")
    e = side(rows, "_eb", "_ne", "_qb", "_nq", "_id")
    key = ["bucket", "_qb", "_eb"]
    hits = q.groupBy(*key).cogroup(e.groupBy(*key)).applyInPandas(nearest_in_block(k), HITS)
    return best_hits(hits.groupBy("query_id", "id").agg(F.min("distance").alias("distance")), k)


def _routed(queries: DataFrame, buckets_of) -> DataFrame:
    """A row per query and bucket; `buckets_of` turns a matrix into a bucket matrix."""

    def route(batches):
        for batch in batches:
            if not len(batch):
                continue
            values = batch.column("vector")
            q = values.flatten().to_numpy(zero_copy_only=False).reshape(len(batch), -1)
            buckets = buckets_of(q)
            at = pa.array(np.repeat(np.arange(len(batch)), buckets.shape[1]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("query_id").take(at), values.take(at), pa.array(buckets.ravel().astype(np.int64))],
                names=["query_id", "vector", "bucket"])

    rows = queries.where(F.col("vector").isNotNull()).select("query_id", F.col("vector").cast("array<double>"))
    return rows.mapInArrow(route, ROUTED)


def _vectors(entries):
    rows = entries.where(F.col("embedding").isNotNull())
    return rows.select("_id", F.col("embedding").cast("array<float>").alias("embedding"))


class _Stored:
    """Folders of rows, one per part of a store."""

    def __init__(self, spark, base):
        self.spark, self.base = spark, base.rstrip("/")

    def parts(self) -> list:
        """Names of the parts that have been added completely."""
        names = folder_names(self.spark, f"{self.base}/rows")
        return [n.removeprefix("part=") for n in names
                if "_SUCCESS" in folder_names(self.spark, f"{self.base}/rows/{n}")]

    def _place(self, part):
        return f"{self.base}/rows/part={part}"

    def rows(self, parts=None) -> DataFrame:
        """The rows of the parts (of all, unless named)."""
        have = self.parts()
        parts = have if parts is None else [p for p in parts if p in set(have)]
        if not parts:
            return self.spark.createDataFrame([], self.SCHEMA)
        reader = self.spark.read.schema(f"{self.SCHEMA}, part string").option("basePath", f"{self.base}/rows")
        return reader.parquet(*map(self._place, parts)).drop("part")


class InvertedLists(_Stored):
    """Rows below one folder per part and list (`rows/PART/list_id=N`).

    A search reads only the folders of the lists it probes. With fewer rows than lists
    there is nothing to train: one list holds everything, and the search is exact.
    """

    SCHEMA = "_id long, embedding array<float>, list_id int"

    def __init__(self, spark, base, centres):
        super().__init__(spark, base)
        self.centres = centres

    @classmethod
    def create(cls, spark, base, centres):
        """Lists around given centres, without rows."""
        centres = np.asarray(centres, np.float64)
        spark.createDataFrame(
            [(i, [float(x) for x in c]) for i, c in enumerate(centres)], "list_id int, centre array<double>"
        ).coalesce(1).write.parquet(f"{base.rstrip('/')}/centres")
        return cls(spark, base, centres)

    @classmethod
    def train(cls, entries, base, lists=LISTS, seed=42):
        """Centres from all vectors of `entries`; they stay while rows are added."""
        spark, rows = entries.sparkSession, _vectors(entries)
        centres = np.zeros((1, 0))
        if rows.limit(lists).count() == lists:
            vectors = rows.select(array_to_vector(F.col("embedding").cast("array<double>")).alias("v"))
            centres = np.array(KMeans(k=lists, seed=seed, featuresCol="v").fit(vectors).clusterCenters())
        return cls.create(spark, base, centres)

    @classmethod
    def build(cls, entries, base, lists=LISTS, seed=42):
        """Trained on `entries`, with their rows as the one part."""
        index = cls.train(entries, base, lists, seed)
        index.add(entries)
        return index

    @classmethod
    def load(cls, spark, base):
        stored = spark.read.parquet(f"{base.rstrip('/')}/centres").orderBy("list_id").collect()
        return cls(spark, base, np.array([r["centre"] for r in stored], np.float64))

    def add(self, entries, part=WHOLE):
        """Rows of a part, each below its list. The same part again replaces its rows."""
        shared = self.spark.sparkContext.broadcast(self.centres)

        @F.pandas_udf(T.IntegerType())
        def list_of(v: pd.Series) -> pd.Series:
            centres = shared.value
            if not len(v) or not centres.shape[1]:
                return pd.Series(np.zeros(len(v), np.int32))
            return pd.Series(squared_distances(matrix(v), centres).argmin(1).astype("int32"))

        # The rebalance hint joins small pieces of a list and splits a large one.
        _vectors(entries).withColumn("list_id", list_of("embedding")).hint("rebalance", "list_id").write.mode(
            "overwrite"
        ).partitionBy("list_id").parquet(self._place(part))

    def probed(self, vectors, probes):
        """The `probes` nearest lists of each vector, nearest first."""
        if not self.centres.shape[1]:
            return np.zeros((len(vectors), 1), np.int64)
        return np.argsort(squared_distances(vectors, self.centres), axis=1, kind="stable")[:, :probes]

    def search(self, queries, k=10, probes=1, parts=None):
        """A counted, small query set goes to the tasks and each list is scanned where it is;
        a larger one is joined with the lists."""
        from flowspark.operators import search as se

        rows = self.rows(parts)
        small = se._bounded(queries, se.MAX_BROADCAST_QUERIES)
        if small is None:
            shared = self.spark.sparkContext.broadcast(self.centres)
            index = InvertedLists(None, self.base, None)

            def buckets_of(vectors, index=index):
                index.centres = shared.value
                return index.probed(vectors, probes)

            return join_buckets(_routed(queries, buckets_of), rows.withColumn("bucket", F.col("list_id").cast("long")), k)
        ids, vectors = small
        if not len(ids) or not self.centres.shape[1]:
            return best_hits(se._scan(rows, ids, vectors, k), k)
        probed = np.zeros((len(ids), len(self.centres)), bool)
        np.put_along_axis(probed, self.probed(vectors, probes), True, axis=1)
        mask = self.spark.sparkContext.broadcast(probed)

        def allowed(batch):
            return mask.value[:, batch.column("list_id").to_numpy()]

        wanted = [int(x) for x in np.flatnonzero(probed.any(0))]
        kept = rows.where(F.col("list_id").isin(wanted))
        return best_hits(se._scan(kept, ids, vectors, k, False, allowed, ["list_id"]), k)


class HashTables(_Stored):
    """Random projections: a row is stored once per table, under the cell that its projections
    fall in, sorted by cell. A query looks up its own cell of each table, and the cells next
    to it across the nearest borders.

    `directions` (tables × projections × dimensions), `offsets` and `widths` (tables ×
    projections) say where the borders are."""

    SCHEMA = "bucket long, _id long, embedding array<float>"

    def __init__(self, spark, base, directions, offsets, widths):
        super().__init__(spark, base)
        self.directions, self.offsets, self.widths = directions, offsets, widths

    @classmethod
    def create(cls, spark, base, directions, offsets, widths):
        """Tables with given borders, without rows."""
        directions, offsets, widths = (np.asarray(x, np.float64) for x in (directions, offsets, widths))
        rows = [(t, p, [float(x) for x in directions[t, p]], float(offsets[t, p]), float(widths[t, p]))
                for t in range(directions.shape[0]) for p in range(directions.shape[1])]
        spark.createDataFrame(
            rows, "hash_table int, projection int, direction array<double>, position double, width double"
        ).coalesce(1).write.parquet(f"{base.rstrip('/')}/borders")
        return cls(spark, base, directions, offsets, widths)

    @classmethod
    def load(cls, spark, base):
        rows = spark.read.parquet(f"{base.rstrip('/')}/borders").orderBy("hash_table", "projection").collect()
        shape = (rows[-1]["hash_table"] + 1, rows[-1]["projection"] + 1)
        directions = np.array([r["direction"] for r in rows]).reshape(*shape, -1)
        offsets, widths = (np.array([r[c] for r in rows]).reshape(shape) for c in ("position", "width"))
        return cls(spark, base, directions, offsets, widths)

    @classmethod
    def train(cls, entries, base, tables=8, projections=4, width=2.0, seed=42):
        """Random directions; a cell is `width` standard deviations of the vectors' own spread
        wide, so the scale of the data does not matter."""
        spark, rows = entries.sparkSession, _vectors(entries)
        first = rows.select(F.size("embedding").alias("n")).first()
        draw = np.random.default_rng(seed)
        directions = draw.normal(size=(tables, projections, first["n"] if first else 0))
        offsets = draw.random((tables, projections))
        flat = directions.reshape(tables * projections, -1)

        def moments(batches):
            total = np.zeros((2, len(flat)))
            n = 0
            for batch in batches:
                if len(batch):
                    p = _matrix_of(batch) @ flat.T
                    n, total = n + len(p), total + [p.sum(0), (p * p).sum(0)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(len(flat))), pa.array(np.full(len(flat), n)), *map(pa.array, total)],
                names=["i", "n", "s", "ss"])

        sums = rows.mapInArrow(moments, "i long, n long, s double, ss double").groupBy("i").agg(
            F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("ss").alias("ss")).orderBy("i").collect()
        spread = np.ones(len(flat))
        for r in sums:
            if r["n"]:
                spread[r["i"]] = max(r["ss"] / r["n"] - (r["s"] / r["n"]) ** 2, 0.0) ** 0.5
        widths = np.where(spread > 0, width * spread, 1.0).reshape(tables, projections)
        return cls.create(spark, base, directions, offsets, widths)

    @classmethod
    def build(cls, entries, base, **options):
        index = cls.train(entries, base, **options)
        index.add(entries)
        return index

    def _places(self, vectors):
        """(rows × tables × projections) places in units of cells."""
        return np.einsum("nd,tpd->ntp", vectors, self.directions) / self.widths + self.offsets

    @staticmethod
    def _bucket(cells):
        """A 64-bit number of (… × tables × projections) whole cell numbers. Cells that share
        one by chance only add candidates."""
        odd = np.uint64(0x9E3779B97F4A7C15)
        mixed = np.zeros(cells.shape[:-1], np.uint64)
        mixed += np.arange(1, cells.shape[-2] + 1, dtype=np.uint64) * odd
        for p in range(cells.shape[-1]):
            mixed = (mixed ^ cells[..., p].astype(np.int64).view(np.uint64)) * odd
            mixed ^= mixed >> np.uint64(32)
        return mixed.view(np.int64)

    def buckets(self, vectors):
        """The cell of each vector in each table."""
        return self._bucket(np.floor(self._places(vectors)))

    def probed(self, vectors, probes):
        """The own cell, and the `probes` next ones across the nearest borders, per table."""
        if not self.directions.shape[2]:
            return np.zeros((len(vectors), 0), np.int64)  # trained without rows
        places = self._places(vectors)
        own = np.floor(places)
        to_low = places - own
        # Distances to the lower and the upper border of each projection, in real units.
        gaps = np.concatenate([to_low * self.widths, (1 - to_low) * self.widths], axis=-1)
        order = np.argsort(gaps, axis=-1, kind="stable")[..., :probes]
        found = [self._bucket(own)]
        n = self.widths.shape[1]
        for i in range(order.shape[-1]):
            cells, at = own.copy(), order[..., i]
            step = np.where(at < n, -1.0, 1.0)
            place = (at % n)[..., None]
            np.put_along_axis(cells, place, np.take_along_axis(cells, place, -1) + step[..., None], axis=-1)
            found.append(self._bucket(cells))
        return np.concatenate(found, axis=-1)

    def add(self, entries, part=WHOLE):
        """Rows of a part, under their cell in each table. The same part again replaces them."""
        shared = self.spark.sparkContext.broadcast((self.directions, self.offsets, self.widths))

        def place(batches):
            index = HashTables(None, "", *shared.value)
            for batch in batches:
                if len(batch):
                    buckets = index.buckets(_matrix_of(batch))
                    at = pa.array(np.repeat(np.arange(len(batch)), buckets.shape[1]))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(buckets.ravel()), batch.column("_id").take(at), batch.column("embedding").take(at)],
                        names=["bucket", "_id", "embedding"])

        placed = _vectors(entries).mapInArrow(place, self.SCHEMA)
        placed.repartitionByRange("bucket", "_id").sortWithinPartitions("bucket", "_id").write.mode(
            "overwrite").parquet(self._place(part))

    def search(self, queries, k=10, probes=2, parts=None):
        return join_buckets(self.routed(queries, probes), self.rows(parts), k)

    def routed(self, queries, probes=2) -> DataFrame:
        shared = self.spark.sparkContext.broadcast((self.directions, self.offsets, self.widths))
        return _routed(queries, lambda vectors: HashTables(None, "", *shared.value).probed(vectors, probes))


def _matrix_of(batch):
    values = batch.column("embedding")
    return values.flatten().to_numpy(zero_copy_only=False).reshape(len(batch), -1).astype(np.float64)


KINDS = {"ivfflat": InvertedLists, "hnsw": HashTables}


def store_index(store):
    """The index of a store, trained when it is first asked for, with the rows of all parts of
    the version read. Parts that have been replaced or joined are not searched any more."""
    kind = KINDS[store.index_type]
    place = f"{store.base}/lists"
    trained = "centres" if kind is InvertedLists else "borders"
    if "_SUCCESS" in folder_names(store.spark, f"{place}/{trained}"):
        index = kind.load(store.spark, place)
    else:
        index = kind.train(store.entries(), place)
    have = set(index.parts())
    live = [p for p in store.parts() if p["rows"]]
    for p in live:
        if p["folder"] not in have:
            index.add(store.entries([(p["first_id"], p["first_id"] + p["rows"] - 1)]), p["folder"])
    return index, [p["folder"] for p in live]
