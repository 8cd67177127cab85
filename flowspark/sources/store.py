"""A flow store: flow records with embeddings, in append order, as parquet.

A version is a small table with one row per part: a folder of entries with consecutive ids,
what it adds up to, and where its look-up table is. Parts are never changed. An append
writes a part and then a version that has it, so readers see whole batches only; a batch
that is repeated (by a restarted stream) takes the place of its earlier part. Compaction
joins small parts, under the same ids. A reader keeps the version it began with; `vacuum`
removes what the newest versions no longer use. One writer at a time: of two that write the
same version, the second fails.
"""

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from flowspark.operators.ids import numbered, offsets
from flowspark.schema import MANIFEST, PART, STORE_ENTRY
from flowspark.session import cut

# Index types a store may be created with.
INDEX_TYPES = ("flatl2", "ivfflat", "hnsw")

# Ids that share a look-up entry, at most.
UNIT = 1 << 20
# Bits of a look-up table per flow, in bitmaps of 32768.
BITS_PER_FLOW = 64
BITMAP = 1 << 15
# Protocol names a part is tallied by, at most; with more it is read when totals are asked for.
MOST_TALLIES = 1000
# Parts of fewer rows are joined by compaction, to at most so many.
PART_ROWS = 1 << 24
# Ranges of ids that are worth a condition; beyond, whole parts are read.
MOST_RANGES = 64

# Columns a lookup by value can ask for, by kind.
KINDS = {"ip": ("src_ip", "dst_ip"), "port": ("src_port", "dst_port")}


def _hadoop(spark, path):
    """Spark's own file system for a path, and the path in it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, path = _hadoop(spark, path)
    return fs.exists(path)


def folder_names(spark: SparkSession, path: str) -> list:
    """Names directly below a folder; none if it does not exist."""
    fs, path = _hadoop(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []


def remove(spark: SparkSession, path: str):
    fs, path = _hadoop(spark, path)
    fs.delete(path, True)


def _hash(kind, value):
    return F.xxhash64(F.lit(kind), value.cast("string"))


def _prefix(hashed):
    """The upper 32 bits of a hash, as a number from 0."""
    return F.shiftrightunsigned(hashed, 32)


def _position(hashed):
    return F.pmod(hashed, F.lit(BITMAP))


def lookup_rows(rows: DataFrame, lo: int, hi: int) -> DataFrame:
    """(lo, hi, kind, low, high, bits): for each unit of ids and each stretch of hashes, which
    hashes of its flows' values there are. With twice the flows, the stretches are twice as
    many, so a bitmap never fills up. Counts combine before the shuffle: a value that all
    flows share is one bit."""
    unit = F.floor((F.col("_id") - lo) / UNIT)
    values = [
        F.struct(F.lit(kind).alias("kind"), _hash(kind, F.col(f"flow_id.{c}")).alias("h"))
        for kind, columns in KINDS.items()
        for c in columns
    ]
    found = rows.select(unit.alias("unit"), F.explode(F.array(*values)).alias("v"))
    flows = F.least(F.lit(UNIT), F.lit(hi - lo + 1) - F.col("unit") * UNIT)
    # The number of stretches is a power of two, so that a stretch is a prefix of the hash.
    bits = F.ceil(F.log2(F.greatest(flows * BITS_PER_FLOW / BITMAP, F.lit(1.0))))
    width = F.pow(F.lit(2.0), 32 - bits).cast("long")
    found = found.select("unit", "v.kind", F.col("v.h").alias("h"), width.alias("width"))
    low = F.floor(_prefix(F.col("h")) / F.col("width")) * F.col("width")
    tables = found.groupBy("unit", "kind", "width", low.alias("low")).agg(
        F.bitmap_construct_agg(_position(F.col("h"))).alias("bits")
    )
    return tables.select(
        (F.col("unit") * UNIT + lo).alias("lo"),
        F.least(F.col("unit") * UNIT + (lo + UNIT - 1), F.lit(hi)).alias("hi"),
        "kind", "low", (F.col("low") + F.col("width") - 1).alias("high"), "bits",
    )


LOOKUP = "lo long, hi long, kind string, low long, high long, bits binary"


class FlowStore:
    """Handle on a store below `base`; the data stays in its tables."""

    def __init__(self, spark: SparkSession, base: str, dimension=128, index_type="flatl2", version=None):
        if index_type not in INDEX_TYPES:
            raise ValueError(f"unknown index type: {index_type}")
        self.spark = spark
        self.base = base.rstrip("/")
        self.dimension = dimension
        self.index_type = index_type
        self.fixed = version

    @classmethod
    def load(cls, spark: SparkSession, base: str, version=None) -> "FlowStore":
        """An existing store, as it is or as it was in `version`; width and index type come
        from its parts."""
        store = cls(spark, base, version=version)
        parts = store.parts()
        if not parts:
            raise FileNotFoundError(f"no flow store at {base}")
        store.dimension, store.index_type = parts[-1]["dimension"], parts[-1]["index_type"]
        return store

    # ---- versions ----------------------------------------------------------------

    def versions(self) -> list:
        """Numbers of the complete versions, oldest first."""
        return [v for v in self._begun() if self._complete(v)]

    def _begun(self):
        return sorted(int(n) for n in folder_names(self.spark, f"{self.base}/versions") if n.isdigit())

    def _complete(self, version):
        return path_exists(self.spark, f"{self.base}/versions/{version:09d}/_SUCCESS")

    def version(self):
        """The version read from: the fixed one or the newest; None in a new store."""
        if self.fixed is not None:
            return self.fixed
        return next((v for v in reversed(self._begun()) if self._complete(v)), None)

    def _version_table(self, version) -> DataFrame:
        return self.spark.read.schema(PART).parquet(f"{self.base}/versions/{version:09d}")

    def parts(self, version=None) -> list:
        """The parts in the order of their ids: one small row each."""
        version = self.version() if version is None else version
        if version is None:
            return []
        rows = self._version_table(version).drop("tallies").collect()
        return sorted((r.asDict() for r in rows), key=lambda p: p["batch_id"])

    def _commit(self, before, gone, rows: DataFrame):
        """A version with the parts of `before`, without those of the batches `gone`, and with
        the parts `rows`."""
        if before is not None:
            old = self._version_table(before).where(~F.col("batch_id").isin(list(gone) or [-1]))
            rows = old.unionByName(rows)
        number = 0 if before is None else before + 1
        if path_exists(self.spark, place := f"{self.base}/versions/{number:09d}") and not self._complete(number):
            remove(self.spark, place)  # of a writer that was lost
        rows.coalesce(1).write.parquet(place)

    def manifest(self) -> DataFrame:
        """A row per part: batch_id (the first, if joined), rows, total_flows up to it,
        dimension, index_type, index_trained."""
        total, rows = 0, []
        for p in self.parts():
            total += p["rows"]
            rows.append((p["batch_id"], p["rows"], total, p["dimension"], p["index_type"], self.index_trained()))
        return self.spark.createDataFrame(rows, MANIFEST)

    def last_batch(self):
        """Number of the newest batch, or None."""
        return max((p["until_batch"] for p in self.parts()), default=None)

    def total_flows(self) -> int:
        return sum(p["rows"] for p in self.parts())

    def index_trained(self) -> bool:
        """Whether a search may use the index: inverted lists must have been trained."""
        return self.index_type != "ivfflat" or path_exists(self.spark, f"{self.base}/lists/centres/_SUCCESS")

    # ---- reading -----------------------------------------------------------------

    def entries(self, ids=None) -> DataFrame:
        """The stored rows, or those with ids in the ranges `ids` ((first, last), …): only the
        parts that have such ids are opened."""
        parts = [p for p in self.parts() if p["rows"]]
        if ids is not None:
            ids = _merged(ids)
            parts = [p for p in parts if any(
                lo <= p["first_id"] + p["rows"] - 1 and hi >= p["first_id"] for lo, hi in ids)]
        if not parts:
            return self.spark.createDataFrame([], STORE_ENTRY)
        rows = self.spark.read.schema(STORE_ENTRY).parquet(
            *[f"{self.base}/entries/{p['folder']}" for p in parts])
        if ids is not None and len(ids) <= MOST_RANGES:
            wanted = F.lit(False)
            for lo, hi in ids:
                wanted = wanted | F.col("_id").between(lo, hi)
            rows = rows.where(wanted)
        return rows

    def ranges_with(self, kind, value) -> list:
        """Ranges of ids, in order, outside of which no flow has the value (an address or a
        port) at either end. A few may have none either."""
        parts = self.parts()
        places = sorted({p["lookup"] for p in parts if p["rows"]})
        if not places:
            return []
        hashed = self.spark.range(1).select(_hash(kind, F.lit(value)).alias("h"))
        prefix, at = hashed.select(_prefix(F.col("h")), _position(F.col("h"))).first()
        tables = self.spark.read.schema(LOOKUP).parquet(*[f"{self.base}/lookup/{p}" for p in places])
        byte = F.conv(F.hex(F.substring("bits", at // 8 + 1, 1)), 16, 10).cast("int")
        hit = F.getbit(byte, F.lit(at % 8)) == 1
        # At most one row per unit and look-up table.
        found = tables.where((F.col("kind") == kind) & (F.col("low") <= prefix) & (F.col("high") >= prefix))
        return _merged((r["lo"], r["hi"]) for r in found.where(hit).select("lo", "hi").distinct().collect())

    def ranges_of_protocol(self, name) -> list:
        """Ids of the parts that hold flows of a transport or application protocol."""
        version = self.version()
        if version is None:
            return []
        has = F.exists("tallies", lambda t: (t["proto"] == name) | (t["app_proto"] == name))
        hit = F.col("tallies").isNull() | F.coalesce(has, F.lit(False))
        rows = self._version_table(version).where("rows > 0").where(hit).select("first_id", "rows").collect()
        return sorted((r["first_id"], r["first_id"] + r["rows"] - 1) for r in rows)

    def tallies(self) -> DataFrame:
        """(proto, app_proto, flows, first_id, bytes, packets): kept with the parts, so that no
        entry is read, unless a part has too many names."""
        kind = PART["tallies"].dataType.elementType
        version = self.version()
        if version is None:
            return self.spark.createDataFrame([], kind)
        table = self._version_table(version)
        kept = table.where("tallies IS NOT NULL").select(F.inline("tallies"))
        open_parts = [p for p in table.where("rows > 0 AND tallies IS NULL").select("first_id", "rows").collect()]
        if open_parts:
            ids = [(p["first_id"], p["first_id"] + p["rows"] - 1) for p in open_parts]
            kept = kept.unionByName(_tallied(self.entries(ids), "_id"))
        return _added_up(kept)

    # ---- writing -----------------------------------------------------------------

    def append(self, flows: DataFrame, batch_id=None, order=None) -> int:
        """Add flow records that carry an `embedding`; returns how many.

        Ids go on from the batch before, dense and in `order`: by capture (where there is
        one) and first packet, unless stated. The same `batch_id` written again replaces its
        rows, also by none; only the newest batch may change its number of rows.
        """
        before = self.version()
        parts = self.parts(before) if before is not None else []
        if batch_id is None:
            batch_id = max((p["until_batch"] for p in parts), default=-1) + 1
        own = [p for p in parts if p["batch_id"] <= batch_id <= p["until_batch"]]
        if any(p["batch_id"] != p["until_batch"] for p in own):
            raise ValueError(f"batch {batch_id} is joined with others and cannot be written again")
        start = sum(p["rows"] for p in parts if p["batch_id"] < batch_id)
        later = [p for p in parts if p["batch_id"] > batch_id and p["rows"]]
        if order is None:
            order = [c for c in ("capture", "first_seq") if c in flows.columns]
        if not order:
            raise ValueError("flows without capture and first_seq need an order")
        wrong = F.col("embedding").isNull() | (F.size("embedding") != self.dimension)
        kept = [f.name for f in STORE_ENTRY.fields if f.name in flows.columns]
        columns = list(dict.fromkeys([*kept, *order]))
        flows = flows.withColumn("embedding", F.col("embedding").cast("array<float>"))
        # Written first: drawing the ranges of the order would work out every flow once more.
        rows = numbered(cut(flows.select(*columns, wrong.alias("_wrong"))), order)
        tallied = cut(_tallied(rows, "_place", "_part", F.sum(F.col("_wrong").cast("int")).alias("bad")))
        base = offsets(tallied, "flows")
        placed = tallied.join(F.broadcast(base), "_part").withColumn(
            "first_id", F.col("first_id") + F.col("_offset") + start)
        summary = _added_up(placed, F.sum("bad").alias("bad")).limit(MOST_TALLIES + 1).collect()
        if len(summary) > MOST_TALLIES:
            counts = placed.agg(F.sum("flows").alias("flows"), F.sum("bad").alias("bad")).first()
            n, bad = counts["flows"], counts["bad"]
        else:
            n, bad = (sum(r[c] for r in summary) for c in ("flows", "bad"))
        if bad:
            raise ValueError(f"{bad} rows without an embedding of width {self.dimension}")
        if later and n != sum(p["rows"] for p in own):
            raise ValueError(f"batch {batch_id} is not the newest and has another number of rows than before")
        if not n and not own:
            return 0
        folder = f"{batch_id:09d}-{uuid.uuid4().hex[:12]}"
        if n:
            entries = rows.join(F.broadcast(base), "_part").withColumn(
                "_id", F.col("_offset") + F.col("_place") + start)
            self._write_entries(entries.withColumn("_indexed_at", F.current_timestamp()).select(
                "_id", "_indexed_at", *kept).sortWithinPartitions("_id"), folder)
            if "flow_id" in kept:
                self._write_lookup(lookup_rows(entries.select("_id", "flow_id"), start, start + n - 1), folder)
            else:
                self._write_lookup(self.spark.createDataFrame([], LOOKUP), folder)
        tallies = None if len(summary) > MOST_TALLIES else [
            tuple(r[f] for f in PART["tallies"].dataType.elementType.names) for r in summary]
        part = (batch_id, batch_id, folder, folder, n, start, self.dimension, self.index_type, tallies)
        self._commit(before, [p["batch_id"] for p in own], self.spark.createDataFrame([part], PART))
        return n

    def _write_entries(self, rows: DataFrame, folder):
        writer = rows.write
        # Row groups that lack a value are passed over without being read.
        for field in ("src_ip", "dst_ip", "src_port", "dst_port"):
            writer = writer.option(f"parquet.bloom.filter.enabled#flow_id.{field}", "true")
        writer.option("parquet.bloom.filter.adaptive.enabled", "true").parquet(f"{self.base}/entries/{folder}")

    def _write_lookup(self, rows: DataFrame, folder):
        # Sorted by stretch, so that a lookup reads a few pages; bitmaps of few bits compress well.
        rows.repartitionByRange("kind", "low").sortWithinPartitions("kind", "low", "lo").write.option(
            "compression", "zstd").option("parquet.block.size", 8 << 20).parquet(f"{self.base}/lookup/{folder}")

    def compact(self, rows_per_part=PART_ROWS) -> int:
        """Join neighbouring parts of fewer rows into parts of at most `rows_per_part`, and all
        their look-up tables into one. The newest batch stays as it is, since it may be
        written again. Ids stay. Returns how many parts were joined."""
        before = self.version()
        parts = self.parts(before) if before is not None else []
        runs, run, held = [], [], 0
        for p in parts[:-1]:
            if run and held + p["rows"] > rows_per_part:
                runs.append(run)
                run, held = [], 0
            run, held = [*run, p], held + p["rows"]
        runs = [r for r in [*runs, run] if len(r) > 1]
        if not runs:
            return 0
        table = self._version_table(before)
        lookup = f"joined-{uuid.uuid4().hex[:12]}"
        olds = sorted({p["lookup"] for p in parts[:-1] if p["rows"]})
        if olds:
            self._write_lookup(self.spark.read.schema(LOOKUP).parquet(
                *[f"{self.base}/lookup/{o}" for o in olds]), lookup)
        added, gone = None, [p["batch_id"] for p in parts[:-1]]
        joined = {p["batch_id"] for r in runs for p in r}
        for run in runs:
            folder = f"{run[0]['batch_id']:09d}-{uuid.uuid4().hex[:12]}"
            full = [p for p in run if p["rows"]]
            if full:
                rows = self.spark.read.schema(STORE_ENTRY).parquet(
                    *[f"{self.base}/entries/{p['folder']}" for p in full])
                self._write_entries(rows.repartitionByRange("_id").sortWithinPartitions("_id"), folder)
            head = {k: run[0][k] for k in ("batch_id", "first_id", "dimension", "index_type")}
            own = table.where(F.col("batch_id").isin([p["batch_id"] for p in run]))
            names = PART["tallies"].dataType.elementType.names
            tallies = _added_up(own.select(F.inline("tallies"))).agg(
                F.collect_list(F.struct(*names)).alias("tallies"))
            # Parts with too many names stay open; so does a sum of too many.
            whole = own.agg(F.count("tallies").alias("known"))
            row = whole.join(F.broadcast(tallies)).select(
                F.when((F.col("known") == len(run)) & (F.size("tallies") <= MOST_TALLIES), F.col("tallies")).alias("tallies"))
            for name, value in {**head, "until_batch": run[-1]["until_batch"], "folder": folder, "lookup": lookup,
                                "rows": sum(p["rows"] for p in run)}.items():
                row = row.withColumn(name, F.lit(value).cast(PART[name].dataType))
            added = row if added is None else added.unionByName(row)
        alone = table.where(F.col("batch_id").isin([b for b in gone if b not in joined] or [-1]))
        added = added.unionByName(alone.withColumn("lookup", F.lit(lookup)))
        self._commit(before, gone, added.select(*PART.names))
        return len(joined)

    def vacuum(self, keep=2):
        """Remove parts and versions that the `keep` newest versions do not use."""
        numbers = self.versions()
        live = numbers[-max(1, keep):]
        used = [p for v in live for p in self.parts(v)]
        for kind, names in (("entries", {p["folder"] for p in used}), ("lookup", {p["lookup"] for p in used})):
            for name in folder_names(self.spark, f"{self.base}/{kind}"):
                if name not in names:
                    remove(self.spark, f"{self.base}/{kind}/{name}")
        for number in numbers[:-max(1, keep)]:
            remove(self.spark, f"{self.base}/versions/{number:09d}")


def _merged(ranges):
    """The ranges in order, with those that touch made one."""
    out = []
    for lo, hi in sorted(ranges):
        if out and lo <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def _tallied(rows: DataFrame, place, by=None, *more) -> DataFrame:
    """Flows by protocol names, with the least `place` of each; by `by` too, if given."""

    def of(field):
        return F.col(field) if field.split(".")[0] in rows.columns else F.lit(None).cast(
            "double" if "statistical" in field else "string")

    keys = [*([by] if by else []), of("protocol.proto").alias("proto"), of("protocol.app_proto").alias("app_proto")]
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("flows"), F.min(place).alias("first_id"),
        F.coalesce(F.sum(of("statistical.total_bytes")), F.lit(0.0)).alias("bytes"),
        F.coalesce(F.sum(of("statistical.packet_count")), F.lit(0.0)).alias("packets"), *more)


def _added_up(tallies: DataFrame, *more) -> DataFrame:
    return tallies.groupBy("proto", "app_proto").agg(
        F.sum("flows").alias("flows"), F.min("first_id").alias("first_id"), F.sum("bytes").alias("bytes"),
        F.sum("packets").alias("packets"), *more)
