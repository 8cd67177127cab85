"""Dense numbering without gathering the rows in one task, and keys without nulls."""

from pyspark.sql import DataFrame, Window, functions as F, types as T

from flowspark.session import cut

# monotonically_increasing_id has the partition above this bit, the row's place below.
_PLACE_BITS = 33


def never_null(kind: T.DataType, name):
    """Column `name` without nulls, one to one, so that a plain equality also joins nulls and
    keeps the partitioning of a grouping before. `given_back` undoes it."""
    if isinstance(kind, T.StringType):
        return F.expr(f"coalesce(concat('=', {name}), '')").alias(name)
    return F.struct(F.col(name)).alias(name)


def given_back(kind: T.DataType, name):
    """Undoes `never_null`; `kind` is the type of the column then or since."""
    if isinstance(kind, T.StringType):
        return F.expr(f"IF({name} = '', NULL, substring({name}, 2))").alias(name)
    return F.col(f"{name}.{name}").alias(name)


def numbered(df: DataFrame, order) -> DataFrame:
    """Written: the rows of `df`, range-partitioned and sorted by `order`, with `_part` and
    `_place`: which partition a row is in, and its place there from 0.

    The ranges come from a sample, so they are drawn once and the table is what counts."""
    keys = [F.col(c).asc_nulls_first() for c in order]
    rows = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    at = F.monotonically_increasing_id()
    rows = cut(rows.withColumn("_at", at))
    part = F.shiftrightunsigned("_at", _PLACE_BITS).alias("_part")
    place = F.col("_at").bitwiseAND(F.lit((1 << _PLACE_BITS) - 1)).alias("_place")
    return rows.select(*df.columns, part, place)


def offsets(rows: DataFrame, count=None) -> DataFrame:
    """(_part, _offset): rows of the partitions before (or sums of `count`). One row per
    partition, so that the running sum takes one small task, and every task of a join can
    have the whole."""
    counts = rows.groupBy("_part").agg((F.sum(count) if count else F.count(F.lit(1))).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))


def dense_ids(df: DataFrame, order, name, start=0, partition=()) -> DataFrame:
    """Number the rows 0, 1, 2, … in `order`, nulls first, within `partition` if given.

    Rows are sorted in ranges of the order, numbered in their range, and moved on by the
    rows of the ranges before. Within `partition`, the first number of each is taken off."""
    rows = numbered(df, [*partition, *order])
    rows = rows.join(F.broadcast(offsets(rows)), "_part")
    rows = rows.withColumn(name, F.col("_offset") + F.col("_place"))
    if partition:
        kinds = {c: df.schema[c].dataType for c in partition}
        keys = [never_null(kind, c) for c, kind in kinds.items()]
        rows = rows.withColumns(dict(zip(kinds, keys)))
        first = rows.groupBy(*partition).agg(F.min(name).alias("_first"))
        rows = rows.join(first, list(partition)).withColumn(name, F.col(name) - F.col("_first"))
        rows = rows.withColumns({c: given_back(kind, c) for c, kind in kinds.items()})
    return rows.withColumn(name, F.col(name) + F.lit(start).cast("long")).select(*df.columns, name)


def broadcast_if_small(df: DataFrame, max_rows=100_000) -> DataFrame:
    """`df` as a broadcast side if it has at most `max_rows` rows, else unchanged.

    The rows are read once, to the driver and never more than the bound; beyond it the
    plain join stays, which Spark shuffles.
    """
    rows = df.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        return df
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema))


def mixed(id_column, multiplier, salt=0):
    """A scattered number in [0, 2^31 - 1) that depends on the id alone."""
    prime = F.lit(2147483647)
    return F.pmod(F.pmod(F.col(id_column), prime) * F.lit(multiplier) + F.lit(salt), prime)
