"""Continuous intake: packets to flows to embeddings to the store.

A micro-batch is an interval of the intake: everything that has arrived since the one
before. Its flows are computed with the batch operators, so a flow that spans two
intervals gives two records. Each batch is written under its own number and replaced as
a whole when Spark repeats it.
"""

import hashlib

from pyspark.sql import DataFrame, SparkSession, functions as F

from flowspark.functions.packet import protocol_name
from flowspark.operators.embedding import embed_flows, output_dim
from flowspark.operators.flows import canonical, flow_table, in_windows, stored_flows, with_entropy
from flowspark.operators.ids import dense_ids
from flowspark.schema import FLOW_ID_FIELDS
from flowspark.session import cut
from flowspark.sources.store import FlowStore, folder_names, path_exists, remove

INTERVAL = "10 seconds"


class Intake:
    """A running intake into one store.

    With `load_existing`, batches are added after those already in the store; a store
    that exists is never overwritten otherwise. With `max_packets`, what arrives at once is
    cut in intervals of at most so many packets, each with flows of its own. With
    `compact_every`, so many parts of the store are joined.
    """

    def __init__(
        self,
        spark: SparkSession,
        base: str,
        weights: dict,
        checkpoint: str,
        index_type="flatl2",
        load_existing=False,
        scaler=None,
        variant="inference",
        max_packets=None,
        compact_every=None,
    ):
        self.spark, self.base = spark, base.rstrip("/")
        self.weights, self.scaler, self.variant = weights, scaler, variant
        self.checkpoint, self.max_packets, self.compact_every = checkpoint, max_packets, compact_every
        offset = self._stored_offset()
        if path_exists(spark, f"{self.base}/versions"):
            if offset is None and not load_existing:
                raise ValueError(f"{base} holds a store: load it or choose another place")
            self.store = FlowStore.load(spark, base)
        else:
            self.store = FlowStore(spark, base, output_dim(weights), index_type)
        if self.store.dimension != output_dim(weights):
            raise ValueError("the store's width is not the encoder's")
        if offset is None:
            last = self.store.last_batch()
            offset = 0 if last is None else last + 1
            spark.createDataFrame([(offset,)], "offset long").coalesce(1).write.mode(
                "overwrite"
            ).parquet(self._offset_path())
        self.offset = offset
        self.query = None

    def _offset_path(self):
        # Batch numbers of a checkpoint start at 0; this is where they go in the store.
        name = hashlib.sha256(self.checkpoint.encode()).hexdigest()[:16]
        return f"{self.base}/intake/{name}"

    def _stored_offset(self):
        if not path_exists(self.spark, self._offset_path()):
            return None
        return self.spark.read.schema("offset long").parquet(self._offset_path()).first()["offset"]

    def process(self, batch: DataFrame, batch_id: int):
        """One micro-batch, cut in intervals of at most `max_packets` packets by arrival. An
        interval without flows adds none; a micro-batch without packets leaves no trace."""
        # Read once: the payload goes, its entropy stays.
        packets = cut(with_entropy(batch))
        if packets.isEmpty():
            return
        scope, order = ["capture"], ["capture", "first_seq"]
        if self.max_packets:
            # The numbered packets are a written table already; an interval is its place there.
            numbers = dense_ids(packets, ["capture", "seq"], "_n")
            packets = numbers.withColumn("interval", F.expr(f"_n DIV {self.max_packets}")).drop("_n")
            scope, order = ["interval", *scope], ["interval", *order]
        else:
            packets = packets.withColumn("interval", F.lit(0).cast("long"))
        number = self.offset + batch_id
        flows = stored_flows(packets, tuple(scope))
        rows = embed_flows(flows, self.weights, self.scaler, self.variant)
        self.store.append(rows, number, order=order)
        self._report(number, packets)
        # Small batches are joined now and then; the newest may be repeated, and stays apart.
        if self.compact_every and len(self.store.parts()) > self.compact_every:
            self.store.compact()
            self.store.vacuum()

    def _report(self, number, packets):
        """A row per interval. Flows are counted again from the packets' keys: no flow is
        built for it."""
        name = F.coalesce(protocol_name("proto"), F.lit("OTHER"))
        by_name = packets.groupBy("interval", name.alias("name")).agg(F.count(F.lit(1)).alias("n"))
        counts = by_name.groupBy("interval").agg(
            F.sum("n").alias("packets"), F.map_from_entries(F.collect_list(F.struct("name", "n"))).alias("protocols")
        )
        keyed = canonical(packets).select("interval", "capture", *FLOW_ID_FIELDS).distinct()
        flows = keyed.groupBy("interval").agg(F.count(F.lit(1)).alias("flows"))
        total = self.store.total_flows()
        counts.join(flows, "interval", "left").select(
            "interval", "packets", F.coalesce("flows", F.lit(0)).alias("flows"),
            F.coalesce("flows", F.lit(0)).alias("embeddings"), F.lit(total).cast("long").alias("store_flows"),
            "protocols", F.current_timestamp().alias("finished"),
        ).coalesce(1).write.mode("overwrite").parquet(f"{self.base}/progress/batch_id={number}")

    def start(self, packets: DataFrame, interval=INTERVAL, available_now=False):
        """Start on a packet stream; with `available_now`, stop when it is read up."""
        trigger = {"availableNow": True} if available_now else {"processingTime": interval}
        self.query = (
            packets.writeStream.foreachBatch(self.process)
            .option("checkpointLocation", self.checkpoint)
            .trigger(**trigger)
            .start()
        )
        return self.query

    def stop(self):
        """Stop after the current interval; nothing is held outside the checkpoint."""
        if self.query is not None:
            self.query.stop()

    def progress(self) -> DataFrame:
        """One row per interval: packets, flows, embeddings, store size, packets by protocol,
        time."""
        if not path_exists(self.spark, f"{self.base}/progress"):
            return self.spark.createDataFrame(
                [],
                "interval long, packets long, flows long, embeddings long, store_flows long, "
                "protocols map<string,long>, finished timestamp, batch_id long",
            )
        return self.spark.read.parquet(f"{self.base}/progress")

    def protocol_counts(self) -> DataFrame:
        """Packets by protocol over all intervals."""
        each = self.progress().select(F.explode("protocols").alias("protocol", "n"))
        return each.groupBy("protocol").agg(F.sum("n").alias("packets"))

    def totals(self) -> DataFrame:
        return self.progress().agg(
            F.coalesce(F.sum("packets"), F.lit(0)).alias("total_packets"),
            F.coalesce(F.sum("flows"), F.lit(0)).alias("total_flows"),
            F.coalesce(F.sum("embeddings"), F.lit(0)).alias("total_embeddings"),
            F.max("finished").alias("last_batch_time"),
        )


class WindowedIntake:
    """Flows of event-time windows from a stream, whatever the interval borders and the order
    of arrival.

    Packets of open windows are kept (with the entropy of their payload in its place) as the
    state after each micro-batch. A window is closed once a packet came that is later than
    its end plus the delay: its flows are written, once, and its packets leave the state. What
    comes for a closed window is late: it is counted and left out. A micro-batch that is
    repeated begins from the state before it, and writes the same.
    """

    SCOPE = ("capture", "window_us")
    COUNTS = "newest_us long, limit_us long, packets long, late long, open_packets long"

    def __init__(self, spark: SparkSession, base: str, checkpoint: str, seconds=10, delay_seconds=0):
        self.spark, self.base, self.checkpoint = spark, base.rstrip("/"), checkpoint
        self.seconds, self.delay_seconds = seconds, delay_seconds

    def _batches(self):
        """Numbers of the micro-batches that are complete: their counts are written last."""
        names = [n for n in folder_names(self.spark, f"{self.base}/counts") if n.startswith("batch_id=")]
        return sorted(int(n.split("=")[1]) for n in names
                      if path_exists(self.spark, f"{self.base}/counts/{n}/_SUCCESS"))

    def _counts_of(self, batch_id):
        return self.spark.read.schema(self.COUNTS).parquet(f"{self.base}/counts/batch_id={batch_id}").first()

    def _state(self, batch_id, schema) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.base}/open/batch_id={batch_id}")

    def process(self, batch: DataFrame, batch_id: int):
        rows = cut(in_windows(with_entropy(batch), self.seconds))
        earlier = [b for b in self._batches() if b < batch_id]
        before = self._counts_of(earlier[-1]) if earlier else None
        limit = before["limit_us"] if before else None
        late = F.lit(False) if limit is None else F.coalesce(F.col("window_us") <= limit, F.lit(False))
        seen = rows.agg(
            F.max("ts_us").alias("newest"), F.count(F.lit(1)).alias("n"),
            F.coalesce(F.sum(late.cast("int")), F.lit(0)).alias("late")).first()
        newest = max((x for x in (seen["newest"], before and before["newest_us"]) if x is not None), default=None)
        rows = rows.where(~late)
        if before:
            rows = rows.unionByName(self._state(earlier[-1], rows.schema))
        # Windows begin at or before this are over.
        limit = None if newest is None else newest - int((self.seconds + self.delay_seconds) * 1_000_000)
        over = F.lit(False) if limit is None else F.coalesce(F.col("window_us") <= limit, F.lit(False))
        flow_table(rows.where(over), self.SCOPE).write.mode("overwrite").parquet(
            f"{self.base}/closed/batch_id={batch_id}")
        rows.where(~over).write.mode("overwrite").parquet(f"{self.base}/open/batch_id={batch_id}")
        kept = self._state(batch_id, rows.schema).count()
        self.spark.createDataFrame([(newest, limit, seen["n"], seen["late"], kept)], self.COUNTS).coalesce(1).write.mode(
            "overwrite").parquet(f"{self.base}/counts/batch_id={batch_id}")
        # Only the newest micro-batch can be repeated, and that from the state before it.
        for old in earlier[:-1]:
            remove(self.spark, f"{self.base}/open/batch_id={old}")

    def start(self, packets: DataFrame, interval=INTERVAL, available_now=False):
        trigger = {"availableNow": True} if available_now else {"processingTime": interval}
        return (
            packets.writeStream.foreachBatch(self.process)
            .option("checkpointLocation", self.checkpoint)
            .trigger(**trigger)
            .start()
        )

    def counts(self) -> DataFrame:
        """A row per micro-batch: packets, late ones, packets kept for open windows."""
        return self.spark.read.schema(f"{self.COUNTS}, batch_id long").parquet(f"{self.base}/counts")

    def windows(self, closed_only=True) -> DataFrame:
        """Flows per window: those of closed windows as they were written, and on demand those
        of the open ones so far."""
        batches = self._batches()
        if not batches:
            raise FileNotFoundError(f"no windows at {self.base}")
        closed = self.spark.read.parquet(*[f"{self.base}/closed/batch_id={b}" for b in batches])
        if closed_only:
            return closed
        schema = self.spark.read.parquet(f"{self.base}/open/batch_id={batches[-1]}").schema
        return closed.unionByName(flow_table(self._state(batches[-1], schema), self.SCOPE))
