"""What the operators of this folder share: tables in the shared folder, words of a text,
links of a similarity join and their connected components."""

import contextlib
import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowspark.session import scratch_dir, ship

# Spark 4.1 can drop a finished query's shuffle files at once instead of at some later
# garbage collection of the driver; the tables written here no longer need them.
_DROP_SHUFFLE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def kept(df: DataFrame, partition_by=()) -> DataFrame:
    """`df` written below spark.checkpoint.dir and read back: later passes start from files
    that outlive any executor, and the shuffle files of the work so far can go."""
    spark = ship(df.sparkSession)
    path = f"{scratch_dir(spark)}/table"
    with setting(spark, _DROP_SHUFFLE, "true"):
        df.write.partitionBy(*partition_by).option("compression", "zstd").parquet(path)
    written = spark.read.schema(df.schema).parquet(path)
    written.kept_at = path
    return written


def drop(*tables: DataFrame):
    """Removes tables that `kept` wrote and that nothing reads any more."""
    for df in tables:
        context = df.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(df.kept_at)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


@contextlib.contextmanager
def setting(spark: SparkSession, key, value):
    before = spark.conf.get(key, None)
    try:
        spark.conf.set(key, value)
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def table(spark: SparkSession, sf_dir, name, *columns) -> DataFrame:
    rows = ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")
    return rows.select(*columns) if columns else rows


# Fixed by the contracts: a word is a run of digits, letters (A-Z lower-cased) and
# characters outside ASCII. In UTF-8 those are the bytes from 0x80 on, so bytes suffice.
WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32
    for b in range(256)
)


def words(text: bytes | None) -> list[bytes]:
    """Lower-cased words of a UTF-8 text; null has none."""
    return text.translate(WORD_BYTES).split() if text else []


def utf8(column):
    """The values of an Arrow string column as UTF-8 bytes, without decoding them."""
    import pyarrow as pa

    return column.cast(pa.binary()).to_pylist()


# Tables of a Python worker that outlive a task, by the operator that fills them.
_tables = {}


def worker_tables(owner, *tables):
    """Names the tables that `owner` fills in this worker. Those of another operator, which a
    worker would keep while it works for this one, are emptied."""
    for other in [x for x in _tables if x != owner]:
        for old in _tables.pop(other):
            old.clear()
    _tables[owner] = tables


@functools.lru_cache(maxsize=4)
def tokenizer(path):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of undirected edges (u, v): a row (id, component) for each id
    of an edge, `component` being the smallest id of its component.

    Alternating large and small stars: each step is a minimum per node (combined before the
    shuffle) and a join back, so a node with very many edges is never held in one task. The
    edges go through the shared folder after each round. Null ends and loops are ignored.
    """
    edges = kept(edges.where("u <> v").select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select("v", "m", "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            least.select("u", F.col("m").alias("v")))
        after = kept(small.where("u <> v").distinct())
        drop(edges)
        edges = after
        # Stars: no smallest id has a smaller neighbour itself.
        if edges.join(edges.select(F.col("v").alias("u")), "u", "left_semi").isEmpty():
            break
    roots = edges.select(F.col("v").alias("id")).distinct()
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(
        roots.select("id", F.col("id").alias("component")))


def passing(pairs: DataFrame, test) -> DataFrame:
    """The distinct (u, v) of `pairs` that meet `test`, a condition that takes long for each.

    Pairs are few and small, so that merged by size they might all end up in one task: they
    are dealt out again first. The test is the input of an aggregate, as a filter would be
    moved below that exchange."""
    tasks = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = pairs.repartition(tasks, "u", "v")
    return dealt.groupBy("u", "v").agg(F.bool_or(test).alias("passes")).where("passes").select("u", "v")


# Ids that go to every task: 16 MB at most; more are joined by a shuffle.
_FEW_IDS = 1_000_000


def few(ids: DataFrame) -> DataFrame:
    """A written table of one-column ids, marked for broadcast if counted to be small."""
    return F.broadcast(ids) if ids.count() <= _FEW_IDS else ids


# Orders in which the ids of a key name a hub: by size, and after flipping fixed bits
# (arbitrary constants).
_ORDERS = (0, -1, 0x5DEECE66D1234567, 0x1B873593CC9E2D51)


def _hub(order):
    return F.min(F.col("id").bitwiseXOR(F.lit(order))).bitwiseXOR(F.lit(order))


def linked_components(members: DataFrame, prepare) -> tuple[DataFrame, DataFrame]:
    """Components of all pairs that share a key and pass a test, and the links found true.

    `members`: (key, id). `prepare(ids)` gets the ids that share any key and returns three
    things: the test, which takes pairs (u, v) and returns those that link; a table of ids
    with their sketches; and a condition on the columns of two sketches (named with 1 and 2
    at the end) that all links meet, or a function of (key, id, component) that returns pairs
    (id, hub) of different components which share a key, all links among them. Pairs inside one component
    cannot change it. So each member of a key is tested with the key's smallest id first;
    then, of keys whose ids are still in different components, with other hubs in other
    components; and last with all ids of a key in other components that have a close sketch. No link between components
    is lost, and a group of many copies, one component after the first stars, costs its
    size and not its square. Hubs are minima, combined before the shuffle.
    """
    several = members.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    shared = kept(members.join(several, "key"))
    ids = kept(shared.select("id").distinct())
    verify, sketches, close = prepare(ids)
    done = [shared, ids]  # tables that nothing reads any more at the end
    tested = links = found = None
    rest = shared.withColumn("component", F.col("id"))
    for orders in (_ORDERS[:1], _ORDERS[1:], None):
        if orders:
            # XOR with -1 turns the order round: the largest id.
            hubs = rest.groupBy("key").agg(F.array_distinct(F.array(*[_hub(o) for o in orders])).alias("hubs"))
            hubs = hubs.select("key", F.explode("hubs").alias("hub"))
            hubs = hubs.join(rest.select("key", F.col("id").alias("hub"), F.col("component").alias("other")), ["key", "hub"])
            pairs = rest.join(hubs, "key").where("component <> other").select("id", "hub")
        elif callable(close):
            pairs = close(rest)
        else:
            # The sketches are compared within the join: only close pairs come out of it.
            rest = rest.join(sketches, "id")
            one, two = (rest.select("key", *[F.col(c).alias(c + n) for c in rest.columns if c != "key"]) for n in "12")
            pairs = one.join(two, "key").where("component1 < component2").where(close).select(
                F.col("id1").alias("id"), F.col("id2").alias("hub"))
        pairs = pairs.select(F.least("id", "hub").alias("u"), F.greatest("id", "hub").alias("v")).distinct()
        pairs = kept(pairs if tested is None else pairs.join(tested, ["u", "v"], "left_anti"))
        more = kept(verify(pairs))
        done.append(pairs)
        tested = pairs if tested is None else tested.unionByName(pairs)
        links = more if links is None else links.unionByName(more)
        if found is None or not more.isEmpty():
            done += [found] if found is not None else []
            found = kept(components(links))
        labelled = shared.join(found, "id", "left").select(
            "key", "id", F.coalesce("component", "id").alias("component"))
        mixed = labelled.groupBy("key").agg(
            F.min("component").alias("low"), F.max("component").alias("high")
        ).where("low <> high").select("key")
        if orders:
            rest = kept(labelled.join(mixed, "key"))
            done.append(rest)
            if rest.isEmpty():
                break
    drop(*done)
    return found, links
