"""Packet sources: tables of packet rows, capture files, and the events adapter."""

from pyspark.sql import DataFrame, SparkSession

from flowspark.schema import PACKET


def packets(spark: SparkSession, path=None, format="parquet", count=0) -> DataFrame:
    """Packets of a file or folder; with `count`, the first so many in arrival order."""
    if not path:
        raise ValueError("a packet source needs a path")
    if format == "pcap":
        from flowspark.sources.pcap import read_pcap

        rows = read_pcap(spark, path)
    else:
        rows = spark.read.schema(PACKET).format(format).load(path)
    return first_packets(rows, count)


def first_packets(rows: DataFrame, count=0) -> DataFrame:
    return rows.orderBy("capture", "seq").limit(count) if count > 0 else rows


def packet_stream(spark: SparkSession, path=None, format="parquet", max_files=None) -> DataFrame:
    """Packets arriving as files in a landing folder, each file taken once.

    `max_files` bounds a micro-batch; what is left waits for the next one.
    """
    if not path:
        raise ValueError("a packet stream needs a landing path")
    reader = spark.readStream
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    if format == "pcap":
        from flowspark.sources.pcap import decode_files

        # Only names and sizes: the content column is never read.
        files = reader.format("binaryFile").load(path).select("path", "length")
        return decode_files(files)
    return reader.schema(PACKET).format(format).load(path)


def packets_from_events(events: DataFrame, capture="events") -> DataFrame:
    """Packet rows made from the `events` table by fixed arithmetic."""
    ends = events.selectExpr(
        "event_id AS seq",
        # The zone-less time stamp read as UTC, whatever the session's time zone.
        "unix_micros(from_utc_timestamp(CAST(ts AS TIMESTAMP), current_timezone())) AS ts_us",
        "event_id % 3 = 0 AS _back",
        "concat('10.0.0.', user_id % 20 + 1) AS _client",
        "concat('10.0.', user_id % 3, '.', 100 + user_id % 7) AS _server",
        "CAST(CASE WHEN event_type = 'error' THEN NULL WHEN user_id % 11 = 0 THEN 123 "
        "ELSE 40000 + user_id % 97 END AS INT) AS _client_port",
        "CASE event_type WHEN 'view' THEN 80 WHEN 'click' THEN 443 WHEN 'purchase' THEN 22 "
        "WHEN 'signup' THEN IF(user_id % 2 = 0, 53, 5201) END AS _server_port",
        "CASE WHEN event_type IN ('view', 'click', 'purchase') THEN 6 "
        "WHEN event_type = 'signup' THEN 17 WHEN user_id % 5 = 0 THEN 47 ELSE 1 END AS proto",
        "60 + CAST(floor(value) AS INT) % 1440 AS pkt_len",
        "CAST(IF(event_id % 10 = 0, '', concat(event_type, props)) AS BINARY) AS payload",
    )
    return ends.selectExpr(
        f"'{capture}' AS capture",
        "seq",
        "ts_us",
        "IF(seq % 50 = 0, 6, 4) AS ip_version",
        "IF(_back, _server, _client) AS src_ip",
        "IF(_back, _server_port, _client_port) AS src_port",
        "IF(_back, _client, _server) AS dst_ip",
        "IF(_back, _client_port, _server_port) AS dst_port",
        "proto",
        "pkt_len",
        "IF(proto = 6, get(array(2, 18, 16, 24, 17, 4, 0, 40), CAST(seq % 8 AS INT)), NULL) "
        "AS tcp_flags",
        "payload",
    )
