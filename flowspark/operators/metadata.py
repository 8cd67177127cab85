"""Lookups, listings and distributions over store entries.

Every function takes a DataFrame of entries (`_id`, `flow_id`, `statistical`,
`protocol`, …) and returns one; a limited scan is a sort by `_id` with a limit, which
Spark runs as a per-task top-k.
"""

from pyspark.sql import DataFrame, functions as F, types as T

from flowspark.functions.packet import bar, percent
from flowspark.sources import store as stores
from flowspark.sources.store import FlowStore

# Ranges of ids a lookup begins with.
FIRST_RANGES = 8


def first_hits(entries: DataFrame, condition, k=10) -> DataFrame:
    return entries.where(condition).orderBy("_id").limit(k)


def flows_by_ip(entries, ip, k=10):
    """The first k flows with the address at either end. A store is asked through its look-up
    tables, and only the parts that may hold such flows are opened."""
    hit = (F.col("flow_id.src_ip") == ip) | (F.col("flow_id.dst_ip") == ip)
    if isinstance(entries, FlowStore):
        return _first_stored(entries, entries.ranges_with("ip", ip), hit, k)
    return first_hits(entries, hit, k)


def flows_by_port(entries, port, k=10):
    hit = (F.col("flow_id.src_port") == port) | (F.col("flow_id.dst_port") == port)
    if isinstance(entries, FlowStore):
        return _first_stored(entries, entries.ranges_with("port", port), hit, k)
    return first_hits(entries, hit, k)


def flows_by_protocol(entries, name, k=10):
    """Transport or application protocol, whatever the case of `name`."""
    wanted = F.upper(F.lit(name))
    hit = (F.col("protocol.proto") == wanted) | (F.col("protocol.app_proto") == wanted)
    if isinstance(entries, FlowStore):
        return _first_stored(entries, entries.ranges_of_protocol(name.upper()), hit, k)
    return first_hits(entries, hit, k)


def flow_by_id(entries, index):
    """The one row with this id; `IndexError` when there is none. A store knows its ids from
    the list of its parts, and opens one of them."""
    if isinstance(entries, FlowStore):
        if not 0 <= index < entries.total_flows():
            raise IndexError(f"no flow {index}")
        return entries.entries([(index, index)])
    row = entries.where(F.col("_id") == index)
    if index < 0 or row.isEmpty():
        raise IndexError(f"no flow {index}")
    return row


def _first_stored(store, ranges, condition, k):
    """The first k hits in a store. Ranges of ids are searched in order, twice as many each
    time, so a value that is everywhere is found in the first of them."""
    ranges, taken = _split(ranges), FIRST_RANGES
    while True:
        hits = first_hits(store.entries(ranges[:taken]), condition, k)
        if taken >= len(ranges) or hits.count() == k:
            return hits
        taken *= 2


def _split(ranges):
    """Long ranges in pieces of a unit, so that a few of them are few rows."""
    unit = stores.UNIT
    return [(b, min(b + unit - 1, hi)) for lo, hi in ranges for b in range(lo, hi + 1, unit)]


def _nested_field(schema: T.StructType, path: str):
    kind = schema
    for part in path.split("."):
        if not isinstance(kind, T.StructType) or part not in kind.names:
            return F.lit(None)
        kind = kind[part].dataType
    return F.col(path)


def matching(entries: DataFrame, filters=None) -> DataFrame:
    """Rows equal to every filter value. Keys are dotted paths; one that leads nowhere
    reads as null, null equals null, and keys that begin with `_` are left out."""
    for path, value in (filters or {}).items():
        if not path.startswith("_"):
            entries = entries.where(
                _nested_field(entries.schema, path).eqNullSafe(F.lit(value))
            )
    return entries


def _text(path, default="N/A"):
    return F.coalesce(F.col(path).cast("string"), F.lit(default))


def _stat(name):
    return F.coalesce(F.col(f"statistical.{name}"), F.lit(0.0))


def _end(side):
    return F.concat(_text(f"flow_id.{side}_ip"), F.lit(":"), _port(side))


def _port(side):
    return F.coalesce(F.col(f"flow_id.{side}_port").cast("string"), F.lit("None"))


def listing(entries: DataFrame, limit=10) -> DataFrame:
    """One line per flow for the first `limit` flows."""
    line = F.format_string(
        "%4d. %-30s → %-30s [%-4s] %sB %spkts",
        F.col("_id"),
        _end("src"),
        _end("dst"),
        _text("protocol.proto"),
        F.lpad(F.format_number(_stat("total_bytes"), 0), 8, " "),
        F.lpad(F.format_string("%.0f", _stat("packet_count")), 4, " "),
    )
    return entries.orderBy("_id").limit(limit).select(F.col("_id").alias("id"), line.alias("line"))


def listing_totals(entries: DataFrame, limit=10) -> DataFrame:
    total = F.count(F.lit(1))
    return entries.agg(
        total.alias("total_flows"),
        F.least(total, F.lit(limit)).alias("shown"),
        F.greatest(total - limit, F.lit(0)).alias("more"),
    )


def details(entries: DataFrame) -> DataFrame:
    """The fields of a flow as shown to a reader, formatted."""
    flags = F.col("protocol.flags_summary")
    return entries.select(
        F.col("_id").alias("id"),
        F.concat(_end("src"), F.lit(" → "), _end("dst")).alias("connection"),
        _text("protocol.proto").alias("transport"),
        _text("protocol.app_proto").alias("application"),
        F.when(flags != "NONE", flags).alias("tcp_flags"),
        F.format_string("%.3fs", _stat("flow_duration")).alias("duration"),
        F.format_number(_stat("total_bytes"), 0).alias("total_bytes"),
        F.format_string("%.0f", _stat("packet_count")).alias("packets"),
        F.format_string("%.1f bytes", _stat("mean_pkt_size")).alias("avg_pkt_size"),
        F.format_string("%.2f", _stat("byte_ratio")).alias("byte_ratio"),
        F.format_string("%.3f (±%.3f)", _stat("entropy_mean"), _stat("entropy_std")).alias(
            "entropy"
        ),
        _text("timestamp", "Unknown").alias("captured"),
    )


def _counts(entries, field, name):
    """Flows per protocol name, with the first id of each. A store has them with its parts."""
    if isinstance(entries, FlowStore):
        known, flows, first = entries.tallies(), F.sum("flows"), F.min("first_id")
    else:
        known, flows, first = entries.select(f"protocol.{field}", "_id"), F.count(F.lit(1)), F.min("_id")
    return known.groupBy(F.coalesce(F.col(field), F.lit("UNKNOWN")).alias(name)).agg(
        flows.alias("flows"), first.alias("first_id")
    )


def _distribution(entries, field, name):
    """Counts with their share of all flows; the total is taken from the counts."""
    counts = _counts(entries, field, name)
    # A handful of rows, one per protocol name.
    total = counts.agg(F.sum("flows").alias("_total"))
    return (
        counts.join(F.broadcast(total))
        .withColumn("pct", percent(F.col("flows"), F.col("_total")))
        .withColumn("bar", bar(F.col("pct")))
        .drop("_total")
    )


def protocol_distribution(entries: DataFrame) -> DataFrame:
    return _distribution(entries, "proto", "proto").drop("first_id").orderBy("proto")


def app_protocol_distribution(entries: DataFrame, top=10) -> DataFrame:
    """The most frequent application protocols; ties in the order first stored."""
    counts = _distribution(entries, "app_proto", "app_proto")
    return counts.orderBy(F.desc("flows"), "first_id").limit(top).drop("first_id")


def store_totals(entries: DataFrame, index_type="flatl2", dimension=64) -> DataFrame:
    """One row of totals. Of a store they are added up from its parts; no entry is read."""
    if isinstance(entries, FlowStore):
        index_type, dimension = entries.index_type, entries.dimension
        known, flows = entries.tallies(), F.coalesce(F.sum("flows"), F.lit(0))
        size, packets = F.sum("bytes"), F.sum("packets")
    else:
        known, flows = entries, F.count(F.lit(1))
        size, packets = F.sum(_stat("total_bytes")), F.sum(_stat("packet_count"))
    sums = known.agg(flows.alias("total_flows"), size.alias("size"), packets.alias("packets"))
    return sums.select(
        "total_flows",
        F.lit(index_type).alias("index_type"),
        F.lit(dimension).alias("dimension"),
        F.coalesce("size", F.lit(0.0)).alias("total_bytes"),
        F.coalesce("packets", F.lit(0.0)).alias("total_packets"),
        F.try_divide("size", "total_flows").alias("avg_bytes"),
        F.try_divide("packets", "total_flows").alias("avg_packets"),
    )


def statistics(entries: DataFrame) -> DataFrame:
    """Both count maps in one row."""

    def as_map(field, name):
        # A handful of rows, one per protocol name.
        counts = _counts(entries, field, "k")
        return counts.agg(F.map_from_entries(F.collect_list(F.struct("k", "flows"))).alias(name))

    return as_map("proto", "protocol_distribution").join(
        F.broadcast(as_map("app_proto", "app_protocol_distribution"))
    )


def embeddable(entries: DataFrame) -> DataFrame:
    """Stored rows from which a flow can be built again: those with a key."""
    return entries.where(F.col("flow_id").isNotNull())
