"""Packets to bidirectional flows.

A flow's features depend on the arrival order of its packets, and one flow may hold
a large share of a capture. So no step here gathers a whole flow in one task:

* packets are cut into stretches of `CHUNK` consecutive ordinals; the gap to the
  previous packet and all sums are taken per (flow, stretch), at most `CHUNK` rows;
* the partial rows of a flow are then put together, in order, in a second and much
  smaller shuffle. Counts, sums and moments merge exactly; the gap across a stretch
  border comes from the last time of the stretch before.

Inside, a missing port is -1 and a missing capture is marked, so that the key columns are
never null and one hash partitioning serves grouping, windows and joins. Results show
them as null again.
"""

from pyspark.sql import DataFrame, functions as F

from flowspark.functions.packet import (
    TCP_FLAG_BITS,
    app_protocol,
    iso_timestamp,
    payload_entropy,
    protocol_name,
)
from flowspark.schema import FLOW_ID_FIELDS, STATISTICAL_FIELDS, TEMPORAL_FIELDS
from flowspark.operators.ids import given_back, never_null

CHUNK = 1 << 20
SEGMENT = 1 << 16
STORED_PACKETS = 10
NO_PORT = -1


def ipv4(packets: DataFrame) -> DataFrame:
    return packets.where(F.col("ip_version") == 4)


def flow_keys(packets: DataFrame) -> DataFrame:
    """Directed 5-tuple of each IPv4 packet; ports only for TCP and UDP."""
    has_ports = F.col("proto").isin(6, 17)
    return ipv4(packets).select(
        "*",
        F.struct(
            "src_ip",
            F.when(has_ports, F.col("src_port")).alias("src_port"),
            "dst_ip",
            F.when(has_ports, F.col("dst_port")).alias("dst_port"),
            F.col("proto").alias("protocol"),
        ).alias("flow_id"),
    )


# Addresses compare as strings; a missing port counts as 0; a tie is forward.
IS_FORWARD = (
    "src_ip < dst_ip OR (src_ip = dst_ip AND coalesce(src_port, 0) <= coalesce(dst_port, 0))"
)


def canonical(packets: DataFrame) -> DataFrame:
    """Both directions under one key: the smaller (address, port) end comes first.

    Replaces the four end columns by the canonical ones and adds `protocol` and
    `direction` (1.0 forward, -1.0 backward).
    """
    ends = ["src_ip", "src_port", "dst_ip", "dst_port"]
    rest = [c for c in packets.columns if c not in (*ends, "proto")]
    turned = packets.where("ip_version = 4").selectExpr(
        *rest, *ends, "proto AS protocol", f"({IS_FORWARD}) AS _fwd"
    )
    return turned.selectExpr(
        *rest,
        "IF(_fwd, src_ip, dst_ip) AS src_ip",
        "IF(_fwd, src_port, dst_port) AS src_port",
        "IF(_fwd, dst_ip, src_ip) AS dst_ip",
        "IF(_fwd, dst_port, src_port) AS dst_port",
        "protocol",
        "IF(_fwd, 1.0D, -1.0D) AS direction",
    )


def with_entropy(packets: DataFrame) -> DataFrame:
    """Packets with the `entropy` of their payload in its place; they can be kept and used
    again without the bytes."""
    return packets.withColumn("entropy", payload_entropy("payload")).drop("payload")


def _keyed(packets, scope, entropy, chunk):
    """Canonical packets with -1 ports, entropy instead of the payload, and stretch.

    The entropy is taken here, before any shuffle: payload bytes are never moved.
    """
    keyed = canonical(packets)
    # Every IPv4 packet has addresses and a protocol. Saying so keeps the optimizer from
    # adding null tests, which would compute the ends once more for each test.
    defaults = {
        "src_ip": "''",
        "src_port": NO_PORT,
        "dst_ip": "''",
        "dst_port": NO_PORT,
        "protocol": NO_PORT,
    }
    rest = [c for c in keyed.columns if c not in ("payload", "entropy", *scope, *defaults)]
    columns = [
        *[F.col(c) for c in rest],
        *[never_null(keyed.schema[c].dataType, c) for c in scope],
        *[F.expr(f"coalesce({c}, {default})").alias(c) for c, default in defaults.items()],
        F.expr(f"coalesce(seq DIV {chunk}, 0L)").alias("stretch"),
    ]
    if entropy:
        known = "entropy" in keyed.columns
        columns.append(F.col("entropy") if known else payload_entropy("payload").alias("entropy"))
    return keyed.select(*columns)


def _over(key, order=None):
    """The text of a window over a flow."""
    return f"OVER (PARTITION BY {', '.join(key)}" + (f" ORDER BY {order})" if order else ")")


def _moments(name, value):
    """Count, mean and summed squared deviation of the non-null `value`."""
    return [
        f"count({value}) AS {name}_n",
        f"coalesce(avg({value}), 0.0D) AS {name}_mean",
        f"coalesce(var_pop({value}) * count({value}), 0.0D) AS {name}_m2",
    ]


def _aggregate(rows, key, expressions):
    return rows.groupBy(*key).agg(*[F.expr(e) for e in expressions])


def flow_partials(packets: DataFrame, scope=("capture",), entropy=True, head=0, chunk=CHUNK):
    """One mergeable row per (scope, flow, stretch).

    With `head`, also the first `head` packets of the stretch as an array.
    """
    key = [*scope, *FLOW_ID_FIELDS, "stretch"]
    arrival = _over(key, "seq")
    # The gap to the flow's previous packet in the stretch; null for the first.
    extra = [f"ts_us - lag(ts_us) {arrival} AS gap_us"]
    if head:
        extra.append(f"row_number() {arrival} AS _rn")
    rows = _keyed(packets, scope, entropy, chunk).selectExpr("*", *extra)
    aggs = [
        "count(1) AS packets",
        "sum(CAST(pkt_len AS BIGINT)) AS bytes",
        "sum(IF(direction > 0, CAST(pkt_len AS BIGINT), 0L)) AS forward_bytes",
        "min(seq) AS first_seq",
        "max(seq) AS last_seq",
        "min_by(ts_us, seq) AS first_us",
        "max_by(ts_us, seq) AS last_us",
        *_moments("size", "CAST(pkt_len AS DOUBLE)"),
        *_moments("gap", "IF(gap_us > 0, gap_us / 1e6D, NULL)"),
        *[
            f"min(IF(protocol = 6 AND tcp_flags & {bit} <> 0, seq * 8 + {place}, NULL)) AS flag_{name}"
            for place, (name, bit) in enumerate(TCP_FLAG_BITS)
        ],
    ]
    if entropy:
        aggs += _moments("entropy", "entropy")
    if head:
        fields = "seq, ts_us, pkt_len, direction" + (", entropy" if entropy else "")
        aggs.append(f"collect_list(IF(_rn <= {head}, struct({fields}), NULL)) AS head")
    return _aggregate(rows, key, aggs)


def merge_partials(partials: DataFrame, scope=("capture",), head=0) -> DataFrame:
    """Partial rows of each flow, in arrival order, to one row per flow."""
    key = [*scope, *FLOW_ID_FIELDS]
    entropy = "entropy_n" in partials.columns
    measures = ["size", "gap"] + (["entropy"] if entropy else [])
    order, whole = _over(key, "first_seq"), _over(key)

    # The positive gap over the border joins the stretch's own gaps as one more value.
    border = f"(first_us - lag(last_us) {order}) / 1e6D"
    before = f"coalesce(sum(packets) {order[:-1]} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0L)"
    rows = partials.selectExpr(
        "*",
        f"{border} AS _raw",
        *([f"{before} AS _before"] if head else []),
    )
    kept = [c for c in rows.columns if c not in ("gap_n", "gap_mean", "gap_m2", "_raw")]
    rows = rows.selectExpr(
        *kept,
        "gap_n + IF(_raw > 0, 1, 0) AS gap_n",
        "IF(_raw > 0, gap_mean + (_raw - gap_mean) / (gap_n + 1), gap_mean) AS gap_mean",
        "IF(_raw > 0, gap_m2 + pow(_raw - gap_mean, 2) * gap_n / (gap_n + 1), gap_m2) AS gap_m2",
    )
    # Deviations are taken around the flow's own mean, so that sums of them add up.
    centres = [
        f"coalesce(try_divide(sum({m}_n * {m}_mean) {whole}, sum({m}_n) {whole}), 0.0D) AS {m}_centre"
        for m in measures
    ]
    rows = rows.selectExpr("*", *centres)

    aggs = [
        "min(first_seq) AS first_seq",
        "min_by(first_us, first_seq) AS first_us",
        "max_by(last_us, last_seq) AS last_us",
        "sum(packets) AS packets",
        "sum(bytes) AS bytes",
        "sum(forward_bytes) AS forward_bytes",
        *[f"min(flag_{name}) AS flag_{name}" for name, _ in TCP_FLAG_BITS],
    ]
    for m in measures:
        aggs += [
            f"first({m}_centre) AS {m}_mean",
            f"coalesce(sqrt(try_divide(sum({m}_m2 + {m}_n * pow({m}_mean - {m}_centre, 2)), "
            f"sum({m}_n))), 0.0D) AS {m}_std",
        ]
    if head:
        # Only stretches that start within the first `head` packets bring theirs:
        # at most `head` arrays of at most `head` packets each.
        aggs.append(
            f"slice(array_sort(flatten(collect_list(IF(_before < {head}, head, NULL)))), 1, {head}) "
            "AS head"
        )
    return _finish(_aggregate(rows, key, aggs), scope, entropy, head)


def _flags_summary():
    seen = ", ".join(
        f"IF(flag_{name} IS NOT NULL, struct(flag_{name} AS spot, '{name}' AS name), NULL)"
        for name, _ in TCP_FLAG_BITS
    )
    joined = f"array_join(array_sort(array_compact(array({seen}))).name, '_')"
    return f"coalesce(nullif({joined}, ''), 'NONE') AS flags_summary"


def _finish(merged, scope, entropy, head):
    open_ports = {p: f"nullif({p}, {NO_PORT})" for p in ("src_port", "dst_port")}
    kept = [f"{open_ports.get(c, c)} AS {c}" for c in FLOW_ID_FIELDS]
    given = [given_back(merged.schema[c].dataType, c) for c in scope]
    columns = [
        *kept,
        "first_seq",
        "first_us",
        "(last_us - first_us) / 1e6D AS flow_duration",
        "CAST(bytes AS DOUBLE) AS total_bytes",
        "CAST(packets AS DOUBLE) AS packet_count",
        "size_mean AS mean_pkt_size",
        "size_std AS std_pkt_size",
        "gap_mean AS mean_dt",
        "gap_std AS std_dt",
        ("entropy_mean" if entropy else "0.0D AS entropy_mean"),
        ("entropy_std" if entropy else "0.0D AS entropy_std"),
        "coalesce(try_divide(CAST(forward_bytes AS DOUBLE), bytes), 0.0D) AS byte_ratio",
        "forward_bytes",
        "bytes - forward_bytes AS backward_bytes",
    ]
    names = [
        protocol_name("protocol").alias("proto"),
        # Inside, a missing port is -1, which names nothing.
        app_protocol("src_port", "dst_port", "protocol").alias("app_proto"),
        F.expr(_flags_summary()),
        iso_timestamp("first_us").alias("timestamp"),
    ]
    if head:
        names.append(F.expr(_temporal_of_head(entropy)))
    return merged.select(*given, *[F.expr(c) for c in columns], *names)


def _temporal_of_head(entropy):
    gap = "IF(i = 0, 0.0D, (x.ts_us - get(head, i - 1).ts_us) / 1e6D)"
    last = "x.entropy" if entropy else "0.0D"
    return (
        f"struct(transform(head, (x, i) -> {gap}) AS dt, "
        "transform(head, x -> CAST(x.pkt_len AS DOUBLE)) AS pkt_size, "
        "transform(head, x -> x.direction) AS direction, "
        f"transform(head, x -> {last}) AS entropy) AS temporal"
    )


def flow_table(packets: DataFrame, scope=("capture",), entropy=True, head=0, chunk=CHUNK):
    """One row per flow and scope: key, statistics, directional bytes, protocol names.

    `scope` names the columns that separate independent groupings (a capture, a
    micro-batch, a time window). There is no idle timeout.
    """
    partials = flow_partials(packets, scope, entropy, head, chunk)
    return merge_partials(partials, scope, head)


def windowed_flows(packets: DataFrame, seconds=10, entropy=True, chunk=CHUNK) -> DataFrame:
    """Flows split at tumbling event-time windows (`window_us` is the start)."""
    return flow_table(in_windows(packets, seconds), ("capture", "window_us"), entropy, 0, chunk)


def in_windows(packets: DataFrame, seconds=10) -> DataFrame:
    width = int(seconds * 1_000_000)
    return packets.selectExpr("*", f"ts_us - pmod(ts_us, {width}L) AS window_us")


def packet_sequence(packets: DataFrame, scope=("capture",), entropy=True, chunk=CHUNK):
    """One row per packet with its place in the flow (`pos`, from 0) and its `dt`.

    This is the temporal tier in long form, whole for flows of any length.
    """
    key = [*scope, *FLOW_ID_FIELDS]
    keyed = _keyed(packets, scope, entropy, chunk)
    stretches = _aggregate(
        keyed, [*key, "stretch"], ["count(1) AS _n", "max_by(ts_us, seq) AS _last_us"]
    )
    order, arrival = _over(key, "stretch"), _over([*key, "stretch"], "seq")
    rows_before = f"{order[:-1]} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    borders = stretches.selectExpr(
        *key,
        "stretch",
        f"coalesce(sum(_n) {rows_before}, 0L) AS _before",
        f"lag(_last_us) {order} AS _prev_us",
    )
    inside = keyed.selectExpr(
        "*", f"lag(ts_us) {arrival} AS _lag_us", f"row_number() {arrival} AS _rn"
    )
    columns = [
        "src_ip",
        f"nullif(src_port, {NO_PORT}) AS src_port",
        "dst_ip",
        f"nullif(dst_port, {NO_PORT}) AS dst_port",
        "protocol",
        "seq",
        "_before + _rn - 1 AS pos",
        "coalesce(ts_us - coalesce(_lag_us, _prev_us), 0L) / 1e6D AS dt",
        "CAST(pkt_len AS DOUBLE) AS pkt_size",
        "direction",
        "entropy" if entropy else "0.0D AS entropy",
    ]
    given = [given_back(keyed.schema[c].dataType, c) for c in scope]
    return inside.join(borders, [*key, "stretch"]).select(*given, *[F.expr(c) for c in columns])


def temporal_segments(sequence: DataFrame, scope=("capture",), segment=SEGMENT) -> DataFrame:
    """Ordered per-packet lists, `segment` packets to a row.

    A flow no longer than `segment` is one row with `segment` 0; a longer one goes on
    in further rows, so that no list outgrows a task.
    """
    fields = F.struct("pos", *TEMPORAL_FIELDS)
    lists = sequence.groupBy(
        *scope, *FLOW_ID_FIELDS, F.floor(F.col("pos") / segment).alias("segment")
    ).agg(F.array_sort(F.collect_list(fields)).alias("_rows"))
    return lists.select(
        *scope,
        *FLOW_ID_FIELDS,
        "segment",
        F.struct(
            *[
                F.transform("_rows", lambda x: x[f]).alias(f)
                for f in TEMPORAL_FIELDS
            ]
        ).alias("temporal"),
    )


def nest(flows: DataFrame, *extra) -> DataFrame:
    """Flat flow columns to the record structs."""
    return flows.select(
        F.struct(*FLOW_ID_FIELDS).alias("flow_id"),
        "temporal",
        F.struct(*STATISTICAL_FIELDS).alias("statistical"),
        F.struct("proto", "app_proto", "flags_summary").alias("protocol"),
        "timestamp",
        *extra,
    )


def flow_records(packets: DataFrame, scope=("capture",), chunk=CHUNK, segment=SEGMENT):
    """Full flow records: statistics plus the whole temporal lists.

    The flow row is repeated for each of its segments first, so the join key is
    unique on both sides and a long flow spreads over many tasks.
    """
    lists = temporal_segments(packet_sequence(packets, scope, True, chunk), scope, segment)
    last = F.floor((F.col("packet_count") - 1) / segment)
    flows = flow_table(packets, scope, True, 0, chunk).withColumn(
        "segment", F.explode(F.sequence(F.lit(0).cast("long"), last))
    )
    ports = ["src_port", "dst_port"]
    kinds = {c: flows.schema[c].dataType for c in scope}
    dense = {p: F.coalesce(p, F.lit(NO_PORT)) for p in ports}
    dense |= {c: never_null(kind, c) for c, kind in kinds.items()}
    joined = flows.withColumns(dense).join(
        lists.withColumns(dense), [*scope, *FLOW_ID_FIELDS, "segment"]
    )
    open_again = {p: F.nullif(p, F.lit(NO_PORT)) for p in ports}
    open_again |= {c: given_back(kind, c) for c, kind in kinds.items()}
    return nest(joined.withColumns(open_again), "segment", "first_seq", *scope)


def stored_flows(packets: DataFrame, scope=("capture",), chunk=CHUNK, head=STORED_PACKETS):
    """Flow records as a store keeps them: temporal lists cut to the first `head`."""
    flows = flow_table(packets, scope, True, head, chunk)
    return nest(flows, "first_seq", *scope)
