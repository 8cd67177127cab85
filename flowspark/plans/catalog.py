"""The registered queries: name -> (builder, SQL counterpart or None).

Packets are derived from `events`, vectors come from `embeddings`; every query runs over
the whole table. Doubles are compared on a grid of 1e-4, shifted a little so that exact
decimal halves do not fall on a rounding border.
"""

import numpy as np
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, functions as F

from flowspark.functions import packet as pk, vector as vec
from flowspark.operators import embedding as emb, flows as fl, learning as ln
from flowspark.operators import metadata as md, search as se
from flowspark.operators.blocks import knn_join
from flowspark.operators.ids import dense_ids
from flowspark.plans import counterparts as sql
from flowspark.schema import FLOW_ID_FIELDS, STATISTICAL_FIELDS
from flowspark.session import cut, scratch_dir
from flowspark.sources.capture_writer import write_captures
from flowspark.sources.flow_files import read_flow_lines, write_flow_lines
from flowspark.sources.packets import first_packets, packet_stream, packets_from_events
from flowspark.sources.pcap import read_pcap
from flowspark.sources.store import FlowStore
from flowspark.streaming.intake import Intake, WindowedIntake

KEY = FLOW_ID_FIELDS
DAY = 86_400
QUERIES = {}


def query(name, counterpart=None):
    def register(build):
        QUERIES[name] = (build, counterpart)
        return build

    return register


def r4(column):
    column = F.col(column) if isinstance(column, str) else column
    return F.round(column + F.lit(sql.SHIFT), 4)


def rounded(df: DataFrame, *names) -> DataFrame:
    return df.withColumns({n: r4(n) for n in names})


# ---- inputs ----------------------------------------------------------------------


def packets(spark, sf):
    return packets_from_events(spark.read.parquet(f"{sf}/events.parquet"))


def vectors(spark, sf):
    """The embeddings table in the shape of store entries."""
    rows = spark.read.parquet(f"{sf}/embeddings.parquet")
    return rows.select(
        F.col("vec_id").alias("_id"), "embedding", F.struct("label").alias("record"), "label"
    )


def labelled(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet")
    return rows.select(F.col("vec_id").alias("id"), "embedding", "label")


def entries(spark, sf, entropy=False):
    """Flow entries with dense ids, without lists and embeddings."""
    flows = fl.flow_table(packets(spark, sf), entropy=entropy)
    nested = fl.nest(flows.withColumn("temporal", F.lit(None)), "first_seq").drop("temporal")
    return dense_ids(nested, ["first_seq"], "_id")


_stores = {}


def batch_store(spark, sf):
    """A store of all flows, appended in batches of consecutive flows and partly compacted.
    One for a session and a folder of tables: several queries ask it."""
    key = spark.sparkContext.applicationId, sf
    if key not in _stores:
        flows = fl.flow_table(packets(spark, sf)).withColumn("temporal", F.lit(None))
        nested = cut(emb.with_features(fl.nest(flows, "first_seq").drop("temporal"), "embedding"))
        store = FlowStore(spark, scratch_dir(spark), dimension=len(emb.FEATURES))
        # Borders of the batches: one row.
        borders = nested.agg(F.percentile_approx("first_seq", [0.2, 0.4, 0.6, 0.8]).alias("b")).first()["b"] or []
        edges = [None, *sorted(set(borders)), None]
        for low, high in zip(edges, edges[1:]):
            rows = nested if low is None else nested.where(F.col("first_seq") > low)
            store.append(rows if high is None else rows.where(F.col("first_seq") <= high), order=("first_seq",))
        store.compact(rows_per_part=max(1, store.total_flows() // 2))
        _stores[key] = store
    return _stores[key]


def feature_entries(spark, sf):
    """Flow entries whose embedding is the standardised feature vector."""
    flows = entries(spark, sf, entropy=True)
    return emb.scale_features(flows, emb.fit_scaler(flows), "embedding")


def label_centres(spark, sf):
    mean = labelled(spark, sf).groupBy("label").agg(
        Summarizer.mean(ln._as_vector("embedding")).alias("m")
    )
    return mean.select(
        F.col("label").cast("long").alias("query_id"), vector_to_array("m").alias("vector")
    )


def overall_centre(spark, sf):
    mean = labelled(spark, sf).agg(Summarizer.mean(ln._as_vector("embedding")).alias("m"))
    return mean.select(F.lit(0).cast("long").alias("query_id"), vector_to_array("m").alias("vector"))


# ---- packets ---------------------------------------------------------------------


@query("ipv4_packets", sql.IPV4_PACKETS)
def ipv4_packets(spark, sf):
    return fl.ipv4(packets(spark, sf)).select(
        "seq", "ts_us", "src_ip", "src_port", "dst_ip", "dst_port", "proto", "pkt_len", "tcp_flags"
    )


def _captured(spark, sf, format):
    """The packets as capture files, read again; ids in the order of the files."""
    path = scratch_dir(spark)
    write_captures(packets(spark, sf), path, format)
    rows = dense_ids(read_pcap(spark, path, split_bytes=1 << 20), ["capture", "seq"], "id")
    return rows.select(
        "id", "ts_us", "ip_version", "src_ip", "src_port", "dst_ip", "dst_port", "proto", "pkt_len", "tcp_flags"
    )


@query("pcap_packets", sql.captured(False))
def pcap_packets(spark, sf):
    return _captured(spark, sf, "pcap")


@query("pcapng_packets", sql.captured(True))
def pcapng_packets(spark, sf):
    """Files of two interfaces with different links and clocks."""
    return _captured(spark, sf, "pcapng")


@query("packet_limit", sql.PACKET_LIMIT)
def packet_limit(spark, sf):
    return first_packets(packets(spark, sf), 100).select("seq", "ts_us", "ip_version", "pkt_len")


@query("flow_keys", sql.FLOW_KEYS)
def flow_keys(spark, sf):
    return fl.flow_keys(packets(spark, sf)).select("seq", "flow_id.*")


@query("canonical_flows", sql.CANONICAL_FLOWS)
def canonical_flows(spark, sf):
    return fl.canonical(packets(spark, sf)).select("seq", *KEY, "direction")


@query("payload_entropy", sql.PAYLOAD_ENTROPY)
def payload_entropy(spark, sf):
    rows = packets(spark, sf).select("seq", pk.payload_entropy("payload").alias("entropy"))
    return rounded(rows, "entropy")


@query("tcp_flags", sql.TCP_FLAGS)
def tcp_flags(spark, sf):
    rows = fl.ipv4(packets(spark, sf))
    return rows.select("seq", F.array_join(pk.tcp_flag_list("tcp_flags"), "_").alias("flags"))


@query("iso_timestamps", sql.ISO_TIMESTAMPS)
def iso_timestamps(spark, sf):
    return packets(spark, sf).select("seq", pk.iso_timestamp("ts_us").alias("timestamp"))


@query("sequence_without_capture", sql.INTERARRIVAL)
def sequence_without_capture(spark, sf):
    """A missing capture is a capture of its own: null keys are joined like others."""
    given = packets(spark, sf)
    missing = given.withColumn("capture", F.lit(None).cast(given.schema["capture"].dataType))
    rows = fl.packet_sequence(missing, entropy=False).where("capture IS NULL")
    return rows.select("seq", "pos", F.round("dt", 6).alias("dt"))


@query("interarrival", sql.INTERARRIVAL)
def interarrival(spark, sf):
    rows = fl.packet_sequence(packets(spark, sf), entropy=False)
    return rows.select("seq", "pos", F.round("dt", 6).alias("dt"))


# ---- flows -----------------------------------------------------------------------


@query("flow_table", sql.FLOW_TABLE)
def flow_table(spark, sf):
    flows = fl.flow_table(packets(spark, sf))
    rows = flows.select(
        *KEY, "first_seq", *STATISTICAL_FIELDS, "proto", "app_proto", "flags_summary", "timestamp"
    )
    return rounded(rows, *STATISTICAL_FIELDS)


@query("flow_statistics_no_payload", sql.FLOW_STATISTICS)
def flow_statistics(spark, sf):
    flows = fl.flow_table(packets(spark, sf), entropy=False)
    kept = [f for f in STATISTICAL_FIELDS if not f.startswith("entropy")]
    return rounded(flows.select(*KEY, "first_seq", *kept), *kept)


@query("flow_table_small_stretches", sql.FLOW_TABLE)
def flow_table_small_stretches(spark, sf):
    """The flagship with stretches so short that nearly every flow spans many."""
    rows = fl.flow_table(packets(spark, sf), chunk=512).select(
        *KEY, "first_seq", *STATISTICAL_FIELDS, "proto", "app_proto", "flags_summary", "timestamp"
    )
    return rounded(rows, *STATISTICAL_FIELDS)


@query("directional_bytes", sql.DIRECTIONAL_BYTES)
def directional_bytes(spark, sf):
    flows = fl.flow_table(packets(spark, sf), entropy=False)
    return flows.select(*KEY, "forward_bytes", "backward_bytes")


@query("entropy_stats", sql.ENTROPY_STATS)
def entropy_stats(spark, sf):
    flows = fl.flow_table(packets(spark, sf))
    return rounded(
        flows.select(*KEY, "entropy_mean", "entropy_std"), "entropy_mean", "entropy_std"
    )


@query("tcp_flags_summary", sql.TCP_FLAGS_SUMMARY)
def tcp_flags_summary(spark, sf):
    return fl.flow_table(packets(spark, sf), entropy=False).select(*KEY, "flags_summary")


@query("protocol_names", sql.PROTOCOL_NAMES)
def protocol_names(spark, sf):
    rows = fl.ipv4(packets(spark, sf))
    return rows.select("proto", pk.protocol_name("proto").alias("name")).groupBy("proto", "name").agg(
        F.count(F.lit(1)).alias("packets")
    )


@query("app_protocols", sql.APP_PROTOCOLS)
def app_protocols(spark, sf):
    return fl.flow_table(packets(spark, sf), entropy=False).select(*KEY, "app_proto")


@query("protocol_ids", sql.PROTOCOL_IDS)
def protocol_ids(spark, sf):
    flows = fl.flow_table(packets(spark, sf), entropy=False)
    return flows.select(
        *KEY, pk.proto_id("proto").alias("proto_id"), pk.app_proto_id("app_proto").alias("app_proto_id")
    )


@query("temporal_sequences", sql.TEMPORAL_SEQUENCES)
def temporal_sequences(spark, sf):
    rows = fl.packet_sequence(packets(spark, sf))
    lists = fl.temporal_segments(rows).select(*KEY, "segment", "temporal.*")
    return _elements(lists, "segment")


@query("stored_flows", sql.STORED_FLOWS)
def stored_flows(spark, sf):
    rows = fl.stored_flows(packets(spark, sf))
    return _elements(rows.select("flow_id.*", "first_seq", "temporal.*"), "first_seq")


def _elements(lists, *keep):
    """List columns as rows, so that their values can be compared one by one."""
    zipped = F.arrays_zip("dt", "pkt_size", "direction", "entropy")
    rows = lists.select(*KEY, *keep, F.posexplode(zipped).alias("pos", "e"))
    return rows.select(
        *KEY,
        *keep,
        F.col("pos").cast("long").alias("pos"),
        F.round("e.dt", 6).alias("dt"),
        "e.pkt_size",
        "e.direction",
        r4("e.entropy").alias("entropy"),
    )


@query("windowed_flows", sql.windowed_flows(DAY))
def windowed_flows(spark, sf):
    rows = fl.windowed_flows(packets(spark, sf), DAY, entropy=False)
    kept = [f for f in STATISTICAL_FIELDS if not f.startswith("entropy")]
    return rounded(rows.select("window_us", *KEY, "first_seq", *kept, "flags_summary"), *kept)


# ---- streams ---------------------------------------------------------------------


def _landed(rows, path):
    """The packets as files of a landing folder, as many as their size asks for; the stream
    takes those that are new together."""
    rows.repartitionByRange("seq").write.mode("append").parquet(path)
    return packet_stream(rows.sparkSession, path)


def _arrivals(rows, parts):
    """The packets in so many parts of the order of arrival."""
    # Borders of the parts: one row.
    shares = [i / parts for i in range(1, parts)]
    borders = rows.agg(F.percentile_approx("seq", shares, 100_000).alias("b")).first()["b"] or []
    part = F.lit(0)
    for border in borders:
        part = part + F.coalesce(F.col("seq") > border, F.lit(False)).cast("int")
    return [rows.where(part == i) for i in range(parts)]


@query("stream_windows", sql.windowed_flows(DAY))
def stream_windows(spark, sf):
    """Windows that the stream has closed, and those it has open at its end."""
    intake = WindowedIntake(spark, scratch_dir(spark), scratch_dir(spark), DAY, delay_seconds=30 * DAY)
    path = scratch_dir(spark)
    for rows in _arrivals(packets(spark, sf), 3):
        intake.start(_landed(rows, path), available_now=True).awaitTermination()
    kept = [f for f in STATISTICAL_FIELDS if not f.startswith("entropy")]
    rows = intake.windows(closed_only=False)
    return rounded(rows.select("window_us", *KEY, "first_seq", *kept, "flags_summary"), *kept)


@query("stream_intake", sql.STREAM_INTAKE)
def stream_intake(spark, sf):
    """Packets as they arrive to embedded flows in a store."""
    base = scratch_dir(spark)
    intake = Intake(spark, base, emb.seeded_weights(), scratch_dir(spark))
    intake.start(_landed(packets(spark, sf), scratch_dir(spark)), available_now=True).awaitTermination()
    rows = FlowStore.load(spark, base).entries()
    return rows.select(
        F.col("_id").alias("id"), "flow_id.*", "statistical.packet_count", "statistical.total_bytes",
        F.size("embedding").alias("dimension"), "timestamp",
    )


@query("stream_protocol_counts", sql.STREAM_PROTOCOL_COUNTS)
def stream_protocol_counts(spark, sf):
    """Packets by protocol as the intervals have counted them."""
    intake = Intake(spark, scratch_dir(spark), emb.seeded_weights(), scratch_dir(spark), max_packets=10_000)
    intake.start(_landed(packets(spark, sf), scratch_dir(spark)), available_now=True).awaitTermination()
    return intake.protocol_counts()


# ---- flow files and the store ----------------------------------------------------


@query("jsonl_roundtrip", sql.JSONL_ROUNDTRIP)
def jsonl_roundtrip(spark, sf):
    path = scratch_dir(spark)
    write_flow_lines(fl.flow_records(packets(spark, sf)).drop("first_seq", "capture"), path)
    rows = read_flow_lines(spark, path).select(
        "flow_id.*",
        F.size("temporal.dt").alias("dts"),
        "statistical.packet_count",
        "statistical.mean_dt",
        "protocol.app_proto",
        "timestamp",
        "label",
    )
    return rounded(rows, "mean_dt")


@query("store_roundtrip", sql.STORE_ROUNDTRIP)
def store_roundtrip(spark, sf):
    flows = emb.with_features(fl.stored_flows(packets(spark, sf)), "embedding")
    path = scratch_dir(spark)
    FlowStore(spark, path, dimension=12).append(flows, order=("first_seq",))
    rows = FlowStore.load(spark, path).entries()
    return rows.select(
        F.col("_id").alias("id"),
        "flow_id.*",
        F.size("temporal.dt").alias("kept_packets"),
        "statistical.total_bytes",
        F.size("embedding").alias("dimension"),
        F.element_at("embedding", 2).cast("double").alias("bytes_feature"),
    )


@query("stored_ids", sql.STORED_IDS)
def stored_ids(spark, sf):
    return entries(spark, sf).select(F.col("_id").alias("id"), "flow_id.*", "first_seq")


def _hit(df):
    return df.select(F.col("_id").alias("id"), "flow_id.*", "protocol.*")


@query("flows_by_ip", sql.flows_by_ip("10.0.0.7", 10))
def flows_by_ip(spark, sf):
    return _hit(md.flows_by_ip(entries(spark, sf), "10.0.0.7", 10))


@query("flows_by_port", sql.flows_by_port(53, 10))
def flows_by_port(spark, sf):
    return _hit(md.flows_by_port(entries(spark, sf), 53, 10))


@query("flows_by_protocol", sql.flows_by_protocol("https", 10))
def flows_by_protocol(spark, sf):
    return _hit(md.flows_by_protocol(entries(spark, sf), "https", 10))


@query("filter_nested", sql.FILTER_NESTED)
def filter_nested(spark, sf):
    wanted = {"protocol.proto": "UDP", "flow_id.dst_port": 53, "_ignored": 1, "nowhere.at": None}
    return _hit(md.matching(entries(spark, sf), wanted))


@query("flow_by_id", sql.flow_by_id(7))
def flow_by_id(spark, sf):
    return md.details(md.flow_by_id(entries(spark, sf, entropy=True), 7))


@query("flow_details", sql.FLOW_DETAILS)
def flow_details(spark, sf):
    return md.details(entries(spark, sf, entropy=True))


@query("flow_listing", sql.flow_listing(10))
def flow_listing(spark, sf):
    return md.listing(entries(spark, sf), 10)


@query("listing_totals", sql.listing_totals(10))
def listing_totals(spark, sf):
    return md.listing_totals(entries(spark, sf), 10)


@query("protocol_distribution", sql.PROTOCOL_DISTRIBUTION)
def protocol_distribution(spark, sf):
    return rounded(md.protocol_distribution(entries(spark, sf)).drop("bar"), "pct")


@query("protocol_bars", sql.PROTOCOL_BARS)
def protocol_bars(spark, sf):
    return md.protocol_distribution(entries(spark, sf)).select("proto", "bar")


@query("app_protocol_top10", sql.APP_PROTOCOL_TOP10)
def app_protocol_top10(spark, sf):
    return rounded(md.app_protocol_distribution(entries(spark, sf), 10).drop("bar"), "pct")


@query("store_totals", sql.STORE_TOTALS)
def store_totals(spark, sf):
    return rounded(md.store_totals(entries(spark, sf)), "avg_bytes", "avg_packets")


@query("store_lookup_ip", sql.flows_by_ip("10.0.0.7", 10))
def store_lookup_ip(spark, sf):
    return _hit(md.flows_by_ip(batch_store(spark, sf), "10.0.0.7", 10))


@query("store_lookup_port", sql.flows_by_port(53, 10))
def store_lookup_port(spark, sf):
    return _hit(md.flows_by_port(batch_store(spark, sf), 53, 10))


@query("store_lookup_protocol", sql.flows_by_protocol("https", 10))
def store_lookup_protocol(spark, sf):
    return _hit(md.flows_by_protocol(batch_store(spark, sf), "https", 10))


@query("store_lookup_id", sql.flow_by_id(7))
def store_lookup_id(spark, sf):
    return md.details(md.flow_by_id(batch_store(spark, sf), 7))


@query("store_kept_totals", sql.STORE_TOTALS.replace("64 AS dimension", f"{len(emb.FEATURES)} AS dimension"))
def store_kept_totals(spark, sf):
    """Totals that are kept with the parts of a store."""
    return rounded(md.store_totals(batch_store(spark, sf)), "avg_bytes", "avg_packets")


@query("store_kept_protocols", sql.PROTOCOL_DISTRIBUTION)
def store_kept_protocols(spark, sf):
    return rounded(md.protocol_distribution(batch_store(spark, sf)).drop("bar"), "pct")


@query("store_kept_applications", sql.APP_PROTOCOL_TOP10)
def store_kept_applications(spark, sf):
    return rounded(md.app_protocol_distribution(batch_store(spark, sf), 10).drop("bar"), "pct")


# ---- features and embeddings -----------------------------------------------------


def _feature_rows(df, name, id="first_seq"):
    cols = [r4(F.get(name, F.lit(i))).alias(f) for i, f in enumerate(emb.FEATURES)]
    return df.select(id, *cols)


@query("feature_vector", sql.FEATURE_VECTOR)
def feature_vector(spark, sf):
    return _feature_rows(emb.with_features(fl.flow_table(packets(spark, sf))), "features")


@query("scaled_features", sql.SCALED_FEATURES)
def scaled_features(spark, sf):
    flows = fl.flow_table(packets(spark, sf))
    return _feature_rows(emb.scale_features(flows, emb.fit_scaler(flows)), "features")


@query("training_rows", sql.TRAINING_ROWS)
def training_rows(spark, sf):
    """Scaled features with the label (here the application protocol) and its index."""
    flows = fl.flow_table(packets(spark, sf)).withColumn("label", F.col("app_proto"))
    rows = ln.with_label_index(emb.scale_features(flows, emb.fit_scaler(flows)))
    picked = [F.get("features", F.lit(i)) for i in range(len(emb.FEATURES))]
    return rows.select(
        "first_seq", "label", "label_idx", r4(sum(picked[1:], picked[0])).alias("feature_sum")
    )


@query("flow_embeddings")
def flow_embeddings(spark, sf):
    flows = fl.flow_table(packets(spark, sf))
    return emb.embed_flows(flows, emb.seeded_weights()).select("first_seq", *KEY, "embedding")


@query("flow_embeddings_normalized")
def flow_embeddings_normalized(spark, sf):
    flows = fl.flow_table(packets(spark, sf))
    rows = emb.embed_flows(flows, emb.seeded_weights(), None, "normalized")
    return rows.select("first_seq", *KEY, "embedding")


@query("dataset_embeddings")
def dataset_embeddings(spark, sf):
    flows = fl.flow_table(packets(spark, sf)).withColumn("label", F.col("app_proto"))
    rows = ln.with_label_index(flows)
    embedded = emb.embed_flows(rows, emb.seeded_weights(), emb.fit_scaler(flows), "normalized")
    return embedded.select("first_seq", "label", "label_idx", "embedding")


# ---- search ----------------------------------------------------------------------


@query("l2_distance", sql.L2_DISTANCE)
def l2_distance(spark, sf):
    """Distance of every vector to the centre of its label."""
    centres = label_centres(spark, sf).select(F.col("query_id").alias("label"), "vector")
    rows = vectors(spark, sf).join(centres, "label")
    return rows.select(
        F.col("_id").alias("id"), r4(vec.l2_squared("embedding", "vector")).alias("distance")
    )


@query("normalized_embeddings", sql.NORMALIZED_EMBEDDINGS)
def normalized_embeddings(spark, sf):
    """Vectors brought to length 1, after doubling them."""
    rows = vectors(spark, sf).withColumn("v", F.transform("embedding", lambda x: x * 2.0))
    unit = rows.select(F.col("_id").alias("id"), F.posexplode(vec.l2_normalized("v")).alias("i", "x"))
    return rounded(unit.select("id", F.col("i").cast("long").alias("i"), "x"), "x")


def _ranked(hits):
    return rounded(hits.select("query_id", "rank", "id", "distance"), "distance")


@query("knn_exact", sql.KNN_EXACT)
def knn_exact(spark, sf):
    """The 10 vectors nearest to the centre of each label."""
    return _ranked(se.knn(vectors(spark, sf), label_centres(spark, sf), 10))


@query("knn_join", sql.KNN_JOIN)
def knn_join_all(spark, sf):
    """The 5 nearest others of every vector, by the join for large query sets."""
    rows = vectors(spark, sf)
    return _ranked(knn_join(se.query_rows(rows), rows, 5, exclude_self=True))


@query("query_by_embedding", sql.QUERY_BY_EMBEDDING)
def query_by_embedding(spark, sf):
    return _ranked(se.knn(vectors(spark, sf), overall_centre(spark, sf), 10))


@query("hit_records", sql.HIT_RECORDS)
def hit_records(spark, sf):
    rows = vectors(spark, sf)
    hits = se.with_records(se.knn(rows, overall_centre(spark, sf), 10), rows, "label")
    return rounded(hits.select("query_id", "rank", "id", "label", "distance"), "distance")


@query("knn_pre_filter", sql.KNN_PRE_FILTER)
def knn_pre_filter(spark, sf):
    return _ranked(
        se.search(vectors(spark, sf), overall_centre(spark, sf), 10, {"record.label": 3})
    )


@query("knn_post_filter", sql.KNN_POST_FILTER)
def knn_post_filter(spark, sf):
    return _ranked(
        se.search(vectors(spark, sf), overall_centre(spark, sf), 10, {"record.label": 3}, "post")
    )


@query("knn_ivf", sql.KNN_IVF)
def knn_ivf(spark, sf):
    """Lists around the first vectors, so that SQL can say what is in them; rows are added in
    two parts."""
    rows = vectors(spark, sf)
    centres = rows.where(F.col("_id") < sql.IVF_LISTS).orderBy("_id").select("embedding").collect()
    lists = se.InvertedLists.create(spark, scratch_dir(spark), [r["embedding"] for r in centres])
    lists.add(rows.where("_id % 3 = 0"), "one")
    lists.add(rows.where("_id % 3 <> 0"), "two")
    return _ranked(lists.search(label_centres(spark, sf), 10, sql.IVF_PROBES))


@query("knn_lsh", sql.KNN_LSH)
def knn_lsh(spark, sf):
    """Stored hash tables whose directions are made by arithmetic, with the next cells of each
    query's own."""
    n, places = np.arange(64), np.arange(sql.LSH_PROJECTIONS)
    directions = [[(n * (3 * t + 7 * p + 1) + 5 * p + 11 * t) % 13 - 6.0 for p in places] for t in range(sql.LSH_TABLES)]
    shifts = [[(2 * t + p) % 5 / 5 + 0.05 for p in places] for t in range(sql.LSH_TABLES)]
    widths = np.full((sql.LSH_TABLES, sql.LSH_PROJECTIONS), sql.LSH_WIDTH)
    tables = se.HashTables.create(spark, scratch_dir(spark), directions, shifts, widths)
    tables.add(vectors(spark, sf))
    return _ranked(tables.search(label_centres(spark, sf), 10, sql.LSH_PROBES))


@query("nearest_zero_by_protocol", sql.NEAREST_ZERO)
def nearest_zero_by_protocol(spark, sf):
    return _ranked(
        se.nearest_zero_by_protocol(feature_entries(spark, sf), "UDP", len(emb.FEATURES), 10)
    )


@query("find_similar", sql.find_similar(0, 5))
def find_similar(spark, sf):
    return _ranked(se.find_similar(vectors(spark, sf), 0, 5))


@query("query_by_example")
def query_by_example(spark, sf):
    """Flows nearest to an example flow (the first one), through the encoder."""
    flows = emb.embed_flows(entries(spark, sf, entropy=True), emb.seeded_weights())
    flows = cut(flows.select("_id", "embedding"))
    example = se.query_rows(flows.where(F.col("_id") == 0))
    return _ranked(se.knn(flows, example, 10))


@query("anomalies", sql.anomalies(1.2, 10, 100))
def anomalies(spark, sf):
    found = se.anomalies(vectors(spark, sf), 1.2, 10)
    return rounded(found, "distance")


@query("anomalies_all", sql.anomalies(1.2, 50, None))
def anomalies_all(spark, sf):
    found = se.anomalies(vectors(spark, sf), 1.2, 50, sample_size=None)
    return rounded(found, "distance")


@query("anomalies_sampled", sql.ANOMALIES_SAMPLED)
def anomalies_sampled(spark, sf):
    found = se.anomalies_sampled(vectors(spark, sf), 1.2, 50)
    return rounded(found, "distance")


@query("rag_context", sql.RAG_CONTEXT)
def rag_context(spark, sf):
    """The flows nearest to the mean flow, as text."""
    rows = feature_entries(spark, sf)
    zero = se.query_vector(spark, np.zeros(len(emb.FEATURES)))
    return se.rag_context(rows, zero, 5)


# ---- labels, triplets, clustering ------------------------------------------------


@query("label_index", sql.LABEL_INDEX)
def label_index(spark, sf):
    return ln.label_index(labelled(spark, sf))


@query("label_groups", sql.LABEL_GROUPS)
def label_groups(spark, sf):
    groups = ln.label_groups(labelled(spark, sf))
    return groups.select("label_idx", "part", F.posexplode("ids").alias("pos", "id")).select(
        "label_idx", "part", F.col("pos").cast("long").alias("pos"), "id"
    )


@query("triplets", sql.TRIPLETS)
def triplets(spark, sf):
    return ln.triplets(labelled(spark, sf))


@query("triplet_loss", sql.TRIPLET_LOSS)
def triplet_loss(spark, sf):
    pairs = ln.triplets(labelled(spark, sf), carry=["embedding"])
    return rounded(ln.triplet_loss(pairs), "loss")


@query("kmeans_clusters")
def kmeans_clusters(spark, sf):
    rows = ln.kmeans(labelled(spark, sf))
    return rows.groupBy("cluster", "label").agg(F.count(F.lit(1)).alias("rows"))


@query("davies_bouldin", sql.DAVIES_BOULDIN)
def davies_bouldin(spark, sf):
    return rounded(ln.davies_bouldin(labelled(spark, sf), "label"), "davies_bouldin")


@query("calinski_harabasz", sql.CALINSKI_HARABASZ)
def calinski_harabasz(spark, sf):
    return rounded(ln.calinski_harabasz(labelled(spark, sf), "label"), "calinski_harabasz")


@query("silhouette_exact", sql.SILHOUETTE)
def silhouette_exact(spark, sf):
    return rounded(ln.silhouette_exact(labelled(spark, sf), "label"), "silhouette")


@query("silhouette_ml")
def silhouette_ml(spark, sf):
    return rounded(ln.silhouette_ml(labelled(spark, sf), "label"), "silhouette_squared")


@query("embedding_2d")
def embedding_2d(spark, sf):
    return rounded(ln.reduce_2d(labelled(spark, sf)), "x", "y")
