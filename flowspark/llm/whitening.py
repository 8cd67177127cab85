"""Whitening of embeddings from bit-sliced cross-products (operator 11)."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowspark.llm.common import kept, table

# Fixed values of the contract: an entry c becomes floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 64, 1_000_000
# Entries beyond this, scaled, count as this.
LARGEST = float(1 << 62)
# Rows whose bit planes are packed at once.
BLOCK_ROWS = 1 << 14
# Models that go to the tasks at once, in bytes; a larger one goes alone.
MODEL_BYTES = 64 << 20
# Sums of products go through Spark in two parts, so that no sum of theirs overflows.
_PART = 60
_ROWS, _SUMS = -2, -1


def integers(vectors: DataFrame, id_column="vec_id", vector_column="embedding") -> DataFrame:
    """(vec_id, width, x): the vectors that are not null and hold only finite entries, as
    64-bit integers, packed little-endian."""
    vectors = vectors.select(
        F.col(id_column).alias("vec_id"), F.col(vector_column).cast("array<double>").alias("v"))
    kind = vectors.schema["vec_id"].dataType.simpleString()

    def pack(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in batches:
            column = batch.column("v")
            length = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            values = column.flatten().to_numpy(zero_copy_only=False)  # a null entry is NaN
            row = np.repeat(np.arange(len(length)), length)
            good = (length > 0) & (np.bincount(row[~np.isfinite(values)], minlength=len(length)) == 0)
            scaled = np.clip(SCALE * values[good[row]], -LARGEST, LARGEST)
            x = np.floor(scaled).astype("<i8") + SHIFT
            ends = np.concatenate([[0], np.cumsum(8 * length[good])])
            packed = pa.Array.from_buffers(
                pa.large_binary(), int(good.sum()), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(x)])
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id").filter(pa.array(good)), pa.array(length[good].astype(np.int32)),
                 packed.cast(pa.binary())], ["vec_id", "width", "x"])

    return vectors.mapInArrow(pack, f"vec_id {kind}, width int, x binary")


def cross_products(x):
    """Column sums and all sums of products of two columns of a matrix of 64-bit integers,
    as exact Python integers in object arrays.

    Each column, less its smallest value, is cut in bit planes; a plane's bits of all rows
    are packed in words. The rows in which bit b of one column and bit c of another are set
    are counted by AND and popcount, and count 2^(b + c) each."""
    import numpy as np

    rows, width = x.shape
    low = x.min(0)
    y = x.astype(np.uint64) - low.astype(np.uint64)  # modulo 2^64, so any distance fits
    most = [max(1, int(v).bit_length()) for v in y.max(0)]
    column = np.repeat(np.arange(width), most)
    bit = np.concatenate([np.arange(n) for n in most])
    padded = -(-rows // 64) * 64
    planes = np.zeros((len(column), padded // 8), np.uint8)
    for b in range(max(most)):
        of = np.flatnonzero(bit == b)
        set_bits = (y[:, column[of]] >> np.uint64(b) & np.uint64(1)).astype(bool)
        packed = np.packbits(set_bits.T, axis=1, bitorder="little")
        planes[of, :packed.shape[1]] = packed
    planes = planes.view("<u8")
    # Python integers where 64 bits would not hold the weighted counts.
    kind = np.int64 if 2 * max(most) + rows.bit_length() + max(most).bit_length() < 62 else object
    weight = bit.astype(kind)
    first = np.concatenate([[0], np.cumsum(most)[:-1]])
    products = np.zeros((width, width), kind)
    for i in range(width):
        begin = first[i]
        for p in range(begin, begin + most[i]):
            both = np.bitwise_count(planes[p] & planes[begin:]).sum(axis=1, dtype=np.int64).astype(kind)
            products[i, i:] += np.add.reduceat(both << weight[begin:], first[i:] - begin) << int(bit[p])
    ones = np.bitwise_count(planes).sum(axis=1, dtype=np.int64).astype(kind)
    above = np.add.reduceat(ones << weight, first).astype(object)
    low, products = low.astype(object), products.astype(object)
    cross = products + np.outer(low, above) + np.outer(above, low) + rows * np.outer(low, low)
    return above + rows * low, cross


def scatter(fit_list: DataFrame) -> DataFrame:
    """(width, i, j, high, low) of (width, x): sums over the rows, by width. i and j from 0
    are two columns (j >= i) and their sum of products; i = -1 is the sum of column j, and
    i = -2 the number of rows. The value is high * 2^60 + low."""

    def count(batches):
        from decimal import Decimal

        import numpy as np
        import pyarrow as pa

        waiting, totals = {}, {}

        def add(width):
            held = b"".join(waiting.pop(width))
            x = np.frombuffer(held, "<i8").reshape(-1, width)
            sums, cross = cross_products(x)
            n, s, c = totals.get(width, (0, 0, 0))
            totals[width] = (n + len(x), s + sums, c + cross)

        for batch in batches:
            for width, x in zip(batch.column("width").to_pylist(), batch.column("x").to_pylist()):
                rows = waiting.setdefault(width, [])
                rows.append(x)
                if len(rows) >= BLOCK_ROWS:
                    add(width)
        for width in list(waiting):
            add(width)
        number = pa.decimal128(38, 0)
        for width, (n, sums, cross) in totals.items():
            upper = np.triu_indices(width)
            values = [n, *sums, *cross[upper]]
            i = np.concatenate([[_ROWS], np.full(width, _SUMS), upper[0]])
            j = np.concatenate([[0], np.arange(width), upper[1]])
            parts = [divmod(int(v), 1 << _PART) for v in values]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(values), width, np.int32)), pa.array(i.astype(np.int32)),
                 pa.array(j.astype(np.int32)), *[pa.array([Decimal(p[k]) for p in parts], number) for k in (0, 1)]],
                ["width", "i", "j", "high", "low"])

    parts = fit_list.mapInArrow(count, "width int, i int, j int, high decimal(38,0), low decimal(38,0)")
    whole = "decimal(38,0)"
    return parts.groupBy("width", "i", "j").agg(
        F.sum("high").cast(whole).alias("high"), F.sum("low").cast(whole).alias("low"))


def models(sums: DataFrame, components=16) -> DataFrame:
    """A row per width of the vectors: n, sums, and of the first `components` axes the
    eigenvalues, their shares of the trace, and the axes themselves (packed doubles).

    n * cross - sum * sum is an integer, so the covariance is centred before anything is
    rounded. An axis without variance has eigenvalue and share 0. One task holds the matrix
    of one width."""

    def fit(group):
        import numpy as np
        import pyarrow as pa

        width = group.column("width")[0].as_py()
        sums, cross, n = np.zeros(width, object), np.zeros((width, width), object), 0
        for i, j, high, low in zip(*[group.column(c).to_pylist() for c in ("i", "j", "high", "low")]):
            value = int(high) * (1 << _PART) + int(low)
            if i == _ROWS:
                n = value
            elif i == _SUMS:
                sums[j] = value
            else:
                cross[i, j] = cross[j, i] = value
        centred = n * cross - np.outer(sums, sums)
        square = n * n
        # True division of Python integers rounds once, correctly.
        covariance = np.array([[v / square for v in row] for row in centred.tolist()])
        trace = sum(np.diagonal(centred).tolist()) / square
        values, vectors = np.linalg.eigh(covariance)
        some = min(components, width)
        values, vectors = values[::-1][:some], vectors[:, ::-1][:, :some]
        # The sign is free: the largest entry is positive.
        largest = np.abs(vectors).argmax(0)
        vectors = vectors * np.where(vectors[largest, np.arange(some)] < 0, -1.0, 1.0)
        values = np.where(values > trace * width * 2.0**-52, values, 0.0)
        explained = values / trace if trace else np.zeros(some)
        return pa.table({
            "width": pa.array([width], pa.int32()), "n": pa.array([n], pa.int64()),
            "sums": pa.array([[str(s) for s in sums]]), "values": pa.array([values.tolist()]),
            "explained": pa.array([explained.tolist()]),
            "axes": pa.array([np.ascontiguousarray(vectors, "<f8").tobytes()], pa.binary())})

    return sums.groupBy("width").applyInArrow(
        fit, "width int, n long, sums array<string>, values array<double>, explained array<double>, axes binary")


def _blocks(fitted: DataFrame):
    """The models as dictionaries of at most MODEL_BYTES each: one, unless there are many
    widths. The driver holds one block at a time."""
    block, held = {}, 0
    for row in fitted.toLocalIterator():
        size = len(row["axes"]) + 32 * row["width"]
        if block and held + size > MODEL_BYTES:
            yield block
            block, held = {}, 0
        block[row["width"]] = row.asDict()
        held += size
    if block:
        yield block


def _whitened(model, x):
    """Squared deviations (exact), and coordinates on the model's axes with variance 1, of
    a matrix of integers."""
    import numpy as np

    n, width = model["n"], model["width"]
    sums = np.array([int(s) for s in model["sums"]], object)
    # n * x - sum, taken around whole means so that the numbers stay small.
    middle = sums // n
    rest = sums - n * middle
    apart = x.astype(object) - middle if max(map(abs, middle)) > 1 << 61 or np.abs(x).max() > 1 << 61 else (
        x - middle.astype(np.int64))
    most = n * (int(np.abs(apart).max()) + 1)
    kind = np.int64 if width * most * most < 1 << 63 else object
    d = n * apart.astype(kind) - rest.astype(kind)
    values = np.array(model["values"])
    axes = np.frombuffer(model["axes"], "<f8").reshape(width, -1)
    scale = np.divide(1.0, np.sqrt(values), out=np.zeros(len(values)), where=values > 0)
    return (d * d).sum(axis=1), (d / n).astype(np.float64) @ axes * scale


def _by_width(batch, known):
    """(width, rows of the batch, their matrix) for the widths that have a model."""
    import numpy as np

    widths = batch.column("width").to_numpy()
    for width in np.unique(widths).tolist():
        if width in known:
            at = np.flatnonzero(widths == width)
            packed = b"".join(batch.column("x").take(at).to_pylist())
            yield width, at, np.frombuffer(packed, "<i8").reshape(-1, width)


def _worst(shared):
    def error(group):
        import numpy as np
        import pyarrow as pa

        width = group.column("width")[0].as_py()
        model = shared.value[width]
        own = np.array(model["values"]) > 0
        total = np.zeros(group.num_rows)
        total[group.column("at").to_numpy()] = group.column("value").to_numpy()
        total = total.reshape(len(own) + 1, -1) / model["n"]
        mean = total[:-1, -1]
        off = (total[:-1, :-1] - np.outer(mean, mean) - np.eye(len(own)))[own][:, own]
        worst = float(np.abs(off).max()) if own.any() else 0.0
        return pa.table({"width": pa.array([width], pa.int32()), "identity_error": pa.array([worst])})

    return error


def identity_errors(fit_list: DataFrame, fitted: DataFrame) -> DataFrame:
    """(width, identity_error): how far the covariance of the whitened fit list, as measured
    over its rows, is from the identity. Axes without variance do not count."""
    spark = fit_list.sparkSession
    out = None
    for block in _blocks(fitted):
        shared = spark.sparkContext.broadcast(block)

        def measure(batches, shared=shared):
            import numpy as np
            import pyarrow as pa

            known, totals = shared.value, {}
            for batch in batches:
                for width, _, x in _by_width(batch, known):
                    for begin in range(0, len(x), BLOCK_ROWS):
                        w = _whitened(known[width], x[begin:begin + BLOCK_ROWS])[1]
                        w = np.hstack([w, np.ones((len(w), 1))])
                        totals[width] = totals.get(width, 0) + w.T @ w
            for width, total in totals.items():
                size = total.size
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(size, width, np.int32)), pa.array(np.arange(size, dtype=np.int32)),
                     pa.array(total.ravel())], ["width", "at", "value"])

        parts = fit_list.mapInArrow(measure, "width int, at int, value double")
        found = parts.groupBy("width", "at").agg(F.sum("value").alias("value")).groupBy("width").applyInArrow(
            _worst(shared), "width int, identity_error double")
        out = found if out is None else out.unionByName(found)
    return out


def whiten(vectors: DataFrame, components=16, id_column="vec_id", vector_column="embedding") -> DataFrame:
    """Vectors as integers, centred and turned on the main axes of their covariance, each
    scaled to variance 1. A row per vector and component.

    vec_id, component (from 1), n, deviation (sum over the dimensions of (n*x - sum)^2, exact,
    null beyond 38 digits), whitened, explained, identity_error. The covariance is that of the
    distinct integer vectors.

    Vectors that are null, empty, or hold null or non-finite entries are left out. Vectors of
    another length are a table of their own, with its own n and axes. Fewer than `components`
    dimensions give as many components; one without variance has whitened and explained 0.
    Repeated rows and null ids come out as they go in; other columns are ignored; an empty
    table gives no rows. Entries beyond 2^62 / 64 count as that.
    """
    kind = vectors.schema[id_column].dataType.simpleString()
    spark = vectors.sparkSession
    given = kept(integers(vectors, id_column, vector_column))
    fit_list = kept(given.select("width", "x").distinct())
    fitted = kept(models(scatter(fit_list), components))
    schema = (f"vec_id {kind}, component int, n long, deviation decimal(38,0), whitened double, "
              "explained double, identity_error double")
    errors = identity_errors(fit_list, fitted)
    if errors is None:
        return spark.createDataFrame([], schema)
    out = None
    for block in _blocks(kept(fitted.join(errors, "width"))):
        shared = spark.sparkContext.broadcast(block)

        def apply(batches, shared=shared):
            from decimal import Decimal

            import numpy as np
            import pyarrow as pa

            known = shared.value
            for batch in batches:
                for width, at, x in _by_width(batch, known):
                    model = known[width]
                    some, n = len(model["values"]), len(x)
                    deviation, w = _whitened(model, x)
                    if deviation.dtype == object:
                        deviation = pa.array(
                            [Decimal(int(v)) if v < 10**38 else None for v in deviation], pa.decimal128(38, 0))
                    else:
                        deviation = pa.array(deviation).cast(pa.decimal128(38, 0))
                    row = pa.array(np.repeat(np.arange(n), some))
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("vec_id").take(pa.array(at)).take(row),
                         pa.array(np.tile(np.arange(1, some + 1, dtype=np.int32), n)),
                         pa.array(np.full(n * some, model["n"], np.int64)), deviation.take(row), pa.array(w.ravel()),
                         pa.array(np.tile(np.array(model["explained"], float), n)),
                         pa.array(np.full(n * some, model["identity_error"], float))],
                        ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

        found = given.mapInArrow(apply, schema)
        out = found if out is None else out.unionByName(found)
    return out


def op11_whitening(spark: SparkSession, sf_dir) -> DataFrame:
    done = whiten(table(spark, sf_dir, "embeddings"))
    # Null where 64 bits cannot hold it; the operator has up to 38 digits.
    return done.withColumn("deviation", F.expr("try_cast(deviation AS bigint)"))
