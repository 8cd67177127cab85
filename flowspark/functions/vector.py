"""Vector column functions, and the NumPy kernels that run on Arrow batches."""

import numpy as np
from pyspark.sql import Column, functions as F

DOUBLES = "array<double>"


def l2_squared(a, b) -> Column:
    """Squared Euclidean distance in double precision, JVM side."""
    pairs = F.zip_with(
        F.col(a).cast(DOUBLES), F.col(b).cast(DOUBLES), lambda x, y: (x - y) * (x - y)
    )
    return F.aggregate(pairs, F.lit(0.0), lambda total, x: total + x)


def euclidean(a, b, eps=0.0) -> Column:
    """Euclidean distance; `eps` is added to every component difference."""
    pairs = F.zip_with(
        F.col(a).cast(DOUBLES),
        F.col(b).cast(DOUBLES),
        lambda x, y: (x - y + F.lit(eps)) * (x - y + F.lit(eps)),
    )
    return F.sqrt(F.aggregate(pairs, F.lit(0.0), lambda total, x: total + x))


def l2_normalized(v, floor=1e-12) -> Column:
    """The vector over its length (never over less than `floor`)."""
    doubles = F.col(v).cast(DOUBLES)
    squares = F.aggregate(doubles, F.lit(0.0), lambda total, x: total + x * x)
    norm = F.greatest(F.sqrt(squares), F.lit(floor))
    return F.transform(doubles, lambda x: x / norm)


def matrix(column, dtype=np.float64) -> np.ndarray:
    """A pandas column of equally long arrays as a 2-D array."""
    if not len(column):
        return np.zeros((0, 0), dtype)
    return np.stack(column.to_numpy()).astype(dtype, copy=False)


def squared_distances(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """All distances by one matrix product; good to about 1e-15 of the squared norms."""
    d = (queries**2).sum(1)[:, None] + (rows**2).sum(1)[None, :]
    d -= 2.0 * queries @ rows.T
    return np.maximum(d, 0.0, out=d)


# Distances held at once by a kernel: with what is worked out beside them, some 30 MB.
TILE = 1 << 20


def tiles(n, width):
    """Slices of `n` queries such that each has at most `TILE` distances to `width` rows."""
    step = max(1, TILE // max(1, width))
    return [slice(start, start + step) for start in range(0, n, step)]


DIFFERENCES = 1 << 19


def nearest(queries, rows, row_ids, k, forbidden=None):
    """For each query the k nearest rows as (query place, id, squared distance).

    The matrix product only picks candidates, with a margin wider than its error;
    their distances are then summed from the differences, so equal vectors get equal
    distances and ties fall to the smaller id. `forbidden`, given a slice of the queries,
    returns a mask of pairs to leave out.
    """
    out_q, out_i, out_d = [], [], []
    if not len(queries) or not len(rows):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    scale = (rows**2).sum(1).max()
    for tile in tiles(len(queries), len(rows)):
        block = queries[tile]
        approx = squared_distances(block, rows)
        margin = 1e-9 * (scale + (block**2).sum(1)) + 1e-12
        if forbidden is not None:
            approx[forbidden(tile)] = np.inf
        kth = np.partition(approx, min(k, len(rows)) - 1, axis=1)[:, min(k, len(rows)) - 1]
        q, r = np.nonzero((approx <= (kth + margin)[:, None]) & np.isfinite(approx))
        best = np.zeros(0, np.int64), np.zeros(0, row_ids.dtype), np.zeros(0)
        # Equal vectors make every pair a candidate: so many differences at a time.
        pairs = max(1, DIFFERENCES // max(1, rows.shape[1]))
        for at in range(0, len(q), pairs):
            own, other = q[at : at + pairs], r[at : at + pairs]
            exact = ((block[own] - rows[other]) ** 2).sum(1)
            found = own, row_ids[other], exact
            best = keep_nearest(*[np.concatenate(x) for x in zip(best, found)], k)
        out_q.append(best[0] + tile.start)
        out_i.append(best[1])
        out_d.append(best[2])
    return np.concatenate(out_q), np.concatenate(out_i), np.concatenate(out_d)


def keep_nearest(q, ids, d, k):
    """The k best of several lists of hits, per query, ties by id."""
    order = np.lexsort((ids, d, q))
    q, ids, d = q[order], ids[order], d[order]
    keep = np.arange(len(q)) - np.searchsorted(q, q, side="left") < k
    return q[keep], ids[keep], d[keep]
