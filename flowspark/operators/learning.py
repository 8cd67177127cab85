"""Labels, triplets, and clustering with its quality scores."""

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, functions as F, types as T

from flowspark.functions.vector import euclidean, l2_squared, matrix, squared_distances, tiles
from flowspark.operators.blocks import BLOCK_ROWS, block_matrix
from flowspark.operators.ids import broadcast_if_small, dense_ids, given_back, mixed, never_null
from flowspark.session import cut

# Anchors that may share one copy of a negative row before it is copied again.
ANCHORS_PER_COPY = 4096

# Cluster centres are broadcast up to this number of clusters.
MAX_CENTRES = 4096


# Fixed value: the label of a row that has none.
NO_LABEL = "normal"


def labelled(rows: DataFrame, label="label") -> DataFrame:
    """A missing text label is `normal`; a missing number stays, as a label of its own."""
    if isinstance(rows.schema[label].dataType, T.StringType):
        return rows.withColumn(label, F.coalesce(label, F.lit(NO_LABEL)))
    return rows


def label_index(rows: DataFrame, label="label") -> DataFrame:
    """Each distinct label with its place in sorted order (`label_idx`)."""
    distinct = labelled(rows, label).select(label).distinct()
    return dense_ids(distinct, [label], "label_idx")


def with_label_index(rows: DataFrame, label="label") -> DataFrame:
    rows = labelled(rows, label)
    kind = rows.schema[label].dataType
    key, columns = {label: never_null(kind, label)}, rows.columns
    index = broadcast_if_small(label_index(rows, label).withColumns(key))
    joined = rows.withColumns(key).join(index, label).withColumns({label: given_back(kind, label)})
    return joined.select(*columns, "label_idx")


def label_groups(rows: DataFrame, id="id", label="label", width=1 << 20) -> DataFrame:
    """Row ids of each label, in order, at most `width` to a list.

    A label of up to `width` rows is one row, with `part` 0.
    """
    indexed = with_label_index(rows.select(F.col(id).alias("id"), label), label)
    numbered = dense_ids(indexed, ["id"], "_pos", partition=["label_idx"])
    return numbered.groupBy("label_idx", F.floor(F.col("_pos") / width).alias("part")).agg(
        F.array_sort(F.collect_list("id")).alias("ids")
    )


def ranked_in_label(rows: DataFrame, label="label", id="id", carry=()) -> DataFrame:
    """`id, label_idx, rank` with a dense rank inside each label, by id."""
    indexed = with_label_index(rows.select(F.col(id).alias("id"), label, *carry), label)
    ranked = dense_ids(indexed, ["id"], "rank", partition=["label_idx"])
    return ranked.select("id", "label_idx", "rank", *carry)


def triplets(rows: DataFrame, label="label", id="id", carry=(), seed=0) -> DataFrame:
    """One (anchor, positive, negative) per row, drawn by a scattered id.

    The positive is another row of the anchor's label (the anchor if it has none), the
    negative a row of another label drawn first (the anchor if there is no other).
    `carry` columns come along as `<name>`, `pos_<name>`, `neg_<name>`.
    """
    ranked = ranked_in_label(rows, label, id, carry)
    sizes = ranked.groupBy("label_idx").agg(F.count(F.lit(1)).alias("_n"))
    labels = sizes.agg(F.count(F.lit(1)).alias("_labels"), F.sum("_n").alias("_rows"))
    sizes = broadcast_if_small(sizes.join(F.broadcast(labels)))  # labels: one row

    anchors = ranked.join(sizes, "label_idx")
    other = F.greatest(F.col("_labels") - 1, F.lit(1))
    peers = F.greatest(F.col("_n") - 1, F.lit(1))
    step = F.when(F.col("_n") > 1, 1 + mixed("id", 48271, seed) % peers).otherwise(0)
    shift = F.when(F.col("_labels") > 1, 1 + mixed("id", 69621, seed) % other).otherwise(0)
    anchors = anchors.select(
        "id",
        "label_idx",
        *carry,
        F.col("rank").alias("_rank"),
        ((F.col("rank") + step) % F.col("_n")).alias("pos_rank"),
        ((F.col("label_idx") + shift) % F.col("_labels")).alias("neg_label_idx"),
    )
    partner = ranked.select(
        F.col("label_idx"),
        F.col("rank").alias("pos_rank"),
        F.col("id").alias("pos_id"),
        *[F.col(c).alias(f"pos_{c}") for c in carry],
    )
    with_pos = anchors.join(partner, ["label_idx", "pos_rank"])

    # A small label may be asked for by most anchors: its rows are copied so that a
    # join key meets no more than about ANCHORS_PER_COPY anchors.
    copies = F.ceil(F.col("_rows") / other / F.col("_n") / ANCHORS_PER_COPY)
    neg_sizes = sizes.select(
        F.col("label_idx").alias("neg_label_idx"),
        F.col("_n").alias("_neg_n"),
        F.greatest(copies, F.lit(1)).alias("_copies"),
        F.col("_labels").alias("_neg_labels"),
    )
    pick = F.when(F.col("_neg_labels") > 1, mixed("id", 16807, seed) % F.col("_neg_n"))
    asked = with_pos.join(neg_sizes, "neg_label_idx").withColumns(
        {
            "neg_rank": F.coalesce(pick, F.col("_rank")),
            "_copy": mixed("id", 40692, seed) % F.col("_copies"),
        }
    )
    offered = (
        ranked.withColumnRenamed("label_idx", "neg_label_idx")
        .join(neg_sizes, "neg_label_idx")
        .select(
            "neg_label_idx",
            F.col("rank").alias("neg_rank"),
            F.explode(F.sequence(F.lit(0).cast("long"), F.col("_copies") - 1)).alias("_copy"),
            F.col("id").alias("neg_id"),
            *[F.col(c).alias(f"neg_{c}") for c in carry],
        )
    )
    return asked.join(offered, ["neg_label_idx", "neg_rank", "_copy"]).select(
        "id",
        "label_idx",
        "pos_id",
        "neg_label_idx",
        "neg_id",
        *[c for name in carry for c in (name, f"pos_{name}", f"neg_{name}")],
    )


def triplet_loss(pairs: DataFrame, vector="embedding", margin=0.5, eps=1e-6) -> DataFrame:
    """Mean of max(0, d(anchor, positive) - d(anchor, negative) + margin)."""
    near = euclidean(vector, f"pos_{vector}", eps)
    far = euclidean(vector, f"neg_{vector}", eps)
    return pairs.agg(
        F.count(F.lit(1)).alias("triplets"),
        F.avg(F.greatest(F.lit(0.0), near - far + margin)).alias("loss"),
    )


def _as_vector(column):
    return array_to_vector(F.col(column).cast("array<double>"))


def kmeans(rows: DataFrame, k=3, starts=10, seed=42, vector="embedding", name="cluster"):
    """Rows with their cluster, from the best of `starts` runs (least cost)."""
    prepared = rows.withColumn("_v", _as_vector(vector)).persist()
    try:
        best = None
        for start in range(starts):
            model = KMeans(k=k, seed=seed + start, featuresCol="_v", predictionCol=name).fit(prepared)
            if best is None or model.summary.trainingCost < best.summary.trainingCost:
                best = model
    finally:
        prepared.unpersist()
    return best.transform(rows.withColumn("_v", _as_vector(vector))).drop("_v")


def _centroids(rows, cluster, vector):
    mean = rows.groupBy(cluster).agg(
        Summarizer.metrics("mean", "count").summary(_as_vector(vector)).alias("s")
    )
    return mean.select(
        cluster, vector_to_array("s.mean").alias("_centre"), F.col("s.count").alias("_n")
    )


def davies_bouldin(rows: DataFrame, cluster="cluster", vector="embedding") -> DataFrame:
    """Mean over clusters of the worst (spread i + spread j) / distance of centres."""
    rows = rows.select(cluster, vector)
    centres = broadcast_if_small(_centroids(rows, cluster, vector), MAX_CENTRES)
    # One row per cluster, written once: both sides and their counts start from it.
    spread = cut(
        rows.join(centres, cluster)
        .groupBy(cluster)
        .agg(F.avg(euclidean(vector, "_centre")).alias("_spread"), F.first("_centre").alias("_centre"))
    )

    def worst(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"cluster": [], "ratio": []})
        a, b = matrix(left["_centre"]), matrix(right["_centre"])
        apart = np.sqrt(((a[:, None, :] - b[None, :, :]) ** 2).sum(2))
        sums = left["_spread"].to_numpy()[:, None] + right["_spread"].to_numpy()[None, :]
        other = left[cluster].to_numpy()[:, None] != right[cluster].to_numpy()[None, :]
        ratio = np.divide(sums, apart, out=np.full_like(sums, np.inf), where=apart > 0)
        return pd.DataFrame(
            {"cluster": left[cluster], "ratio": np.where(other, ratio, 0.0).max(1)}
        )

    kind = rows.schema[cluster].dataType.simpleString()
    ratios = block_matrix(
        spread, spread, worst, f"cluster {kind}, ratio double", cluster, cluster, 256
    )
    return (
        ratios.groupBy("cluster")
        .agg(F.max("ratio").alias("ratio"))
        .agg(F.count(F.lit(1)).alias("clusters"), F.avg("ratio").alias("davies_bouldin"))
    )


def calinski_harabasz(rows: DataFrame, cluster="cluster", vector="embedding") -> DataFrame:
    """(spread between centres / (k-1)) / (spread inside / (n-k))."""
    rows = rows.select(cluster, vector)
    centres = _centroids(rows, cluster, vector)
    whole = rows.agg(Summarizer.mean(_as_vector(vector)).alias("m")).select(
        vector_to_array("m").alias("_all")
    )
    between = centres.join(F.broadcast(whole)).agg(  # whole: one row
        F.sum(F.col("_n") * l2_squared("_centre", "_all")).alias("ssb"),
        F.count(F.lit(1)).alias("k"),
        F.sum("_n").alias("n"),
    )
    inside = (
        rows.join(broadcast_if_small(centres, MAX_CENTRES), cluster)
        .agg(F.sum(l2_squared(vector, "_centre")).alias("ssw"))
    )
    score = F.try_divide(
        F.try_divide(F.col("ssb"), F.col("k") - 1), F.try_divide(F.col("ssw"), F.col("n") - F.col("k"))
    )
    return between.join(F.broadcast(inside)).select(  # inside: one row
        F.col("k").alias("clusters"), score.alias("calinski_harabasz")
    )


def _need_two(rows, cluster):
    if len(rows.select(cluster).where(F.col(cluster).isNotNull()).distinct().limit(2).collect()) < 2:
        raise ValueError("a silhouette needs at least two labels")


def silhouette_exact(
    rows: DataFrame, cluster="cluster", vector="embedding", id="id", block_rows=BLOCK_ROWS
) -> DataFrame:
    """Mean silhouette over Euclidean distances.

    Every pair of rows counts, by definition: the work is quadratic, in blocks of bounded
    size that hand on sums only. For large data use `silhouette_ml`.
    """
    _need_two(rows, cluster)
    rows = rows.select(F.col(id).alias("id"), F.col(cluster).alias("cluster"), F.col(vector).alias("v"))

    def sums(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"id": [], "cluster": [], "other": [], "total": [], "n": []})
        names, place, n = np.unique(right["cluster"].to_numpy(), return_inverse=True, return_counts=True)
        # Rows of a cluster stand together, so that sums over them need no table of members.
        right = right.iloc[np.argsort(place, kind="stable")]
        firsts = np.cumsum(n) - n
        ids, b = right["id"].to_numpy(), matrix(right["v"])
        total = np.empty((len(left), len(names)))
        for tile in tiles(len(left), len(right)):
            part = left.iloc[tile]
            d = squared_distances(matrix(part["v"]), b)
            d[part["id"].to_numpy()[:, None] == ids[None, :]] = 0.0
            total[tile] = np.add.reduceat(np.sqrt(d, out=d), firsts, axis=1)
        # A row without a distance to one of the block has none to its clusters.
        total[~np.isfinite(total).all(1)] = np.nan
        return pd.DataFrame(
            {
                "id": np.repeat(left["id"].to_numpy(), len(names)),
                "cluster": np.repeat(left["cluster"].to_numpy(), len(names)),
                "other": np.tile(names, len(left)),
                "total": total.ravel(),
                "n": np.tile(n, len(left)),
            }
        )

    kind = rows.schema["cluster"].dataType.simpleString()
    parts = block_matrix(
        rows,
        rows,
        sums,
        f"id long, cluster {kind}, other {kind}, total double, n long",
        "id",
        "id",
        block_rows,
    )
    per_cluster = parts.groupBy("id", "cluster", "other").agg(
        F.sum("total").alias("total"), F.sum("n").alias("n")
    )
    own = F.col("cluster") == F.col("other")
    per_row = per_cluster.groupBy("id").agg(
        F.max(F.when(own, F.try_divide(F.col("total"), F.col("n") - 1))).alias("a"),
        F.min(F.when(~own, F.col("total") / F.col("n"))).alias("b"),
    )
    value = F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b"))
    # A row alone in its cluster has no `a` and counts as 0.
    return per_row.agg(F.avg(F.coalesce(value, F.lit(0.0))).alias("silhouette"))


def silhouette_ml(rows: DataFrame, cluster="cluster", vector="embedding") -> DataFrame:
    """Silhouette over squared Euclidean distances: linear in the rows, another number."""
    _need_two(rows, cluster)
    prepared = rows.select(
        F.col(cluster).cast("double").alias("_c"), _as_vector(vector).alias("_v")
    )
    score = ClusteringEvaluator(
        featuresCol="_v", predictionCol="_c", metricName="silhouette"
    ).evaluate(prepared)
    return rows.sparkSession.createDataFrame([(score,)], "silhouette_squared double")


def reduce_2d(rows: DataFrame, vector="embedding", id="id") -> DataFrame:
    """Two principal coordinates per row."""
    prepared = rows.withColumn("_v", _as_vector(vector))
    model = PCA(k=2, inputCol="_v", outputCol="_xy").fit(prepared)
    xy = vector_to_array("_xy")
    return model.transform(prepared).select(id, xy[0].alias("x"), xy[1].alias("y"))
