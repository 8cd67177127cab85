"""Fixed schemas. Nothing in this package infers a schema from data."""

from pyspark.sql import types as T

PACKET = T.StructType(
    [
        T.StructField("capture", T.StringType(), False),
        T.StructField("seq", T.LongType(), False),
        T.StructField("ts_us", T.LongType(), False),
        T.StructField("ip_version", T.IntegerType(), True),
        T.StructField("src_ip", T.StringType(), True),
        T.StructField("src_port", T.IntegerType(), True),
        T.StructField("dst_ip", T.StringType(), True),
        T.StructField("dst_port", T.IntegerType(), True),
        T.StructField("proto", T.IntegerType(), True),
        T.StructField("pkt_len", T.IntegerType(), False),
        T.StructField("tcp_flags", T.IntegerType(), True),
        T.StructField("payload", T.BinaryType(), True),
    ]
)

FLOW_ID_FIELDS = ["src_ip", "src_port", "dst_ip", "dst_port", "protocol"]

FLOW_ID = T.StructType(
    [
        T.StructField("src_ip", T.StringType()),
        T.StructField("src_port", T.IntegerType()),
        T.StructField("dst_ip", T.StringType()),
        T.StructField("dst_port", T.IntegerType()),
        T.StructField("protocol", T.IntegerType()),
    ]
)

TEMPORAL_FIELDS = ["dt", "pkt_size", "direction", "entropy"]

TEMPORAL = T.StructType(
    [T.StructField(f, T.ArrayType(T.DoubleType())) for f in TEMPORAL_FIELDS]
)

STATISTICAL_FIELDS = [
    "flow_duration",
    "total_bytes",
    "packet_count",
    "mean_pkt_size",
    "std_pkt_size",
    "mean_dt",
    "std_dt",
    "entropy_mean",
    "entropy_std",
    "byte_ratio",
]

STATISTICAL = T.StructType(
    [T.StructField(f, T.DoubleType()) for f in STATISTICAL_FIELDS]
)

PROTOCOL = T.StructType(
    [
        T.StructField("proto", T.StringType()),
        T.StructField("app_proto", T.StringType()),
        T.StructField("flags_summary", T.StringType()),
    ]
)

# One flow, as written to and read from JSON lines.
FLOW_RECORD = T.StructType(
    [
        T.StructField("flow_id", FLOW_ID),
        T.StructField("temporal", TEMPORAL),
        T.StructField("statistical", STATISTICAL),
        T.StructField("protocol", PROTOCOL),
        T.StructField("timestamp", T.StringType()),
        T.StructField("label", T.StringType()),
        T.StructField("segment", T.LongType()),
    ]
)

# One row of a flow store, without the partition column `batch_id`.
STORE_ENTRY = T.StructType(
    [
        T.StructField("_id", T.LongType()),
        T.StructField("_indexed_at", T.TimestampType()),
        T.StructField("flow_id", FLOW_ID),
        T.StructField("temporal", TEMPORAL),
        T.StructField("statistical", STATISTICAL),
        T.StructField("protocol", PROTOCOL),
        T.StructField("timestamp", T.StringType()),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
    ]
)

MANIFEST = T.StructType(
    [
        T.StructField("batch_id", T.LongType()),
        T.StructField("rows", T.LongType()),
        T.StructField("total_flows", T.LongType()),
        T.StructField("dimension", T.IntegerType()),
        T.StructField("index_type", T.StringType()),
        T.StructField("index_trained", T.BooleanType()),
    ]
)

# One part of a flow store: consecutive batches in one folder.
PART = T.StructType(
    [
        T.StructField("batch_id", T.LongType()),
        T.StructField("until_batch", T.LongType()),
        T.StructField("folder", T.StringType()),
        T.StructField("lookup", T.StringType()),
        T.StructField("rows", T.LongType()),
        T.StructField("first_id", T.LongType()),
        T.StructField("dimension", T.IntegerType()),
        T.StructField("index_type", T.StringType()),
        T.StructField(
            "tallies",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("proto", T.StringType()),
                        T.StructField("app_proto", T.StringType()),
                        T.StructField("flows", T.LongType()),
                        T.StructField("first_id", T.LongType()),
                        T.StructField("bytes", T.DoubleType()),
                        T.StructField("packets", T.DoubleType()),
                    ]
                )
            ),
        ),
    ]
)
