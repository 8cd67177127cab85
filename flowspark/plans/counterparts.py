"""The registered queries as plain SQL over the same tables."""

from flowspark.schema import STATISTICAL_FIELDS

# Added before rounding on both sides; see the catalog.
SHIFT = 3.7e-7

KEY = "src_ip, src_port, dst_ip, dst_port, protocol"

STEPS = {
    "packets": """
        SELECT event_id AS seq,
               epoch_us(ts) AS ts_us,
               CASE WHEN event_id % 50 = 0 THEN 6 ELSE 4 END AS ip_version,
               CASE WHEN event_id % 3 = 0 THEN s_ip ELSE c_ip END AS src_ip,
               CASE WHEN event_id % 3 = 0 THEN s_port ELSE c_port END AS src_port,
               CASE WHEN event_id % 3 = 0 THEN c_ip ELSE s_ip END AS dst_ip,
               CASE WHEN event_id % 3 = 0 THEN c_port ELSE s_port END AS dst_port,
               proto,
               CAST(60 + CAST(floor(value) AS INTEGER) % 1440 AS INTEGER) AS pkt_len,
               CASE WHEN proto = 6 THEN CASE event_id % 8
                    WHEN 0 THEN 2 WHEN 1 THEN 18 WHEN 2 THEN 16 WHEN 3 THEN 24
                    WHEN 4 THEN 17 WHEN 5 THEN 4 WHEN 6 THEN 0 ELSE 40 END END AS tcp_flags,
               CASE WHEN event_id % 10 = 0 THEN '' ELSE event_type || props END AS payload
        FROM (
            SELECT *,
                   '10.0.0.' || CAST(user_id % 20 + 1 AS VARCHAR) AS c_ip,
                   '10.0.' || CAST(user_id % 3 AS VARCHAR) || '.'
                       || CAST(100 + user_id % 7 AS VARCHAR) AS s_ip,
                   CAST(CASE WHEN event_type = 'error' THEN NULL
                        WHEN user_id % 11 = 0 THEN 123
                        ELSE 40000 + user_id % 97 END AS INTEGER) AS c_port,
                   CAST(CASE event_type WHEN 'view' THEN 80 WHEN 'click' THEN 443
                        WHEN 'purchase' THEN 22
                        WHEN 'signup' THEN CASE WHEN user_id % 2 = 0 THEN 53 ELSE 5201 END
                        END AS INTEGER) AS s_port,
                   CASE WHEN event_type IN ('view', 'click', 'purchase') THEN 6
                        WHEN event_type = 'signup' THEN 17
                        WHEN user_id % 5 = 0 THEN 47 ELSE 1 END AS proto
            FROM events)""",
    "directed": """
        SELECT *, (src_ip < dst_ip OR (src_ip = dst_ip
                   AND coalesce(src_port, 0) <= coalesce(dst_port, 0))) AS fwd
        FROM packets WHERE ip_version = 4""",
    "keyed": """
        SELECT seq, ts_us, pkt_len, tcp_flags, payload,
               CASE WHEN fwd THEN src_ip ELSE dst_ip END AS src_ip,
               CASE WHEN fwd THEN src_port ELSE dst_port END AS src_port,
               CASE WHEN fwd THEN dst_ip ELSE src_ip END AS dst_ip,
               CASE WHEN fwd THEN dst_port ELSE src_port END AS dst_port,
               proto AS protocol,
               CASE WHEN fwd THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS direction
        FROM directed""",
    "bytes": """
        SELECT seq, ch, count(*) AS c
        FROM (SELECT seq, unnest(string_split(payload, '')) AS ch FROM packets WHERE payload <> '')
        GROUP BY seq, ch""",
    "entropies": """
        SELECT seq, -sum(c / n * log2(c / n)) AS h
        FROM (SELECT seq, c::DOUBLE AS c, sum(c) OVER (PARTITION BY seq)::DOUBLE AS n FROM bytes)
        GROUP BY seq""",
    "sequence": f"""
        SELECT keyed.*, coalesce(h, 0.0) AS entropy,
               coalesce(ts_us - lag(ts_us) OVER flow, 0) / 1e6 AS dt,
               row_number() OVER flow - 1 AS pos
        FROM keyed LEFT JOIN entropies USING (seq)
        WINDOW flow AS (PARTITION BY {KEY} ORDER BY seq)""",
    "flag_seen": f"""
        SELECT {KEY}, flag, min(seq * 8 + place) AS spot
        FROM keyed, (VALUES ('S', 2, 0), ('A', 16, 1), ('F', 1, 2), ('R', 4, 3), ('P', 8, 4),
                            ('U', 32, 5)) AS f(flag, bit, place)
        WHERE tcp_flags & bit <> 0
        GROUP BY {KEY}, flag""",
    "flag_text": f"""
        SELECT {KEY}, string_agg(flag, '_' ORDER BY spot) AS flags
        FROM flag_seen GROUP BY {KEY}""",
    "grouped": f"""
        SELECT {KEY}, min(seq) AS first_seq, arg_min(ts_us, seq) AS first_us,
               (arg_max(ts_us, seq) - arg_min(ts_us, seq)) / 1e6 AS flow_duration,
               sum(pkt_len)::DOUBLE AS total_bytes,
               count(*)::DOUBLE AS packet_count,
               avg(pkt_len) AS mean_pkt_size,
               stddev_pop(pkt_len) AS std_pkt_size,
               coalesce(avg(dt) FILTER (dt > 0), 0.0) AS mean_dt,
               coalesce(stddev_pop(dt) FILTER (dt > 0), 0.0) AS std_dt,
               avg(entropy) AS entropy_mean,
               stddev_pop(entropy) AS entropy_std,
               coalesce(sum(pkt_len) FILTER (direction > 0), 0)::DOUBLE / sum(pkt_len) AS byte_ratio,
               coalesce(sum(pkt_len) FILTER (direction > 0), 0)::BIGINT AS forward_bytes,
               coalesce(sum(pkt_len) FILTER (direction < 0), 0)::BIGINT AS backward_bytes
        FROM sequence GROUP BY {KEY}""",
    "flows": """
        SELECT g.*, coalesce(t.flags, 'NONE') AS flags_summary,
               CASE g.protocol WHEN 6 THEN 'TCP' WHEN 17 THEN 'UDP' WHEN 1 THEN 'ICMP'
                    ELSE 'OTHER' END AS proto,
               CASE WHEN g.protocol IN (6, 17)
                    THEN coalesce(sp.name, dp.name, 'UNKNOWN') ELSE 'UNKNOWN' END AS app_proto,
               strftime(make_timestamp(first_us), '%Y-%m-%dT%H:%M:%S.%fZ') AS timestamp
        FROM grouped g
        LEFT JOIN flag_text t ON g.src_ip = t.src_ip AND g.dst_ip = t.dst_ip
             AND g.src_port IS NOT DISTINCT FROM t.src_port
             AND g.dst_port IS NOT DISTINCT FROM t.dst_port AND g.protocol = t.protocol
        LEFT JOIN ports sp ON sp.port = g.src_port
        LEFT JOIN ports dp ON dp.port = g.dst_port""",
    "ports": """
        SELECT * FROM (VALUES (80, 'HTTP'), (443, 'HTTPS'), (22, 'SSH'), (21, 'FTP'), (25, 'SMTP'),
                              (53, 'DNS'), (67, 'DHCP'), (68, 'DHCP'), (123, 'NTP')) AS p(port, name)""",
    "entries": """
        SELECT row_number() OVER (ORDER BY first_seq) - 1 AS id, * FROM flows""",
    "features": """
        SELECT *, CASE WHEN proto = 'TCP' THEN 1.0 ELSE 0.0 END::DOUBLE AS is_tcp,
               CASE WHEN proto = 'UDP' THEN 1.0 ELSE 0.0 END::DOUBLE AS is_udp
        FROM entries""",
    "vectors": "SELECT vec_id AS id, embedding::DOUBLE[] AS v, label FROM embeddings",
    "components": """
        SELECT id, label, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM vectors""",
    "centres": """
        SELECT label, list(m ORDER BY i) AS c, max(n) AS n
        FROM (SELECT label, i, avg(x) AS m, count(*) AS n FROM components GROUP BY label, i)
        GROUP BY label""",
    "centre": """
        SELECT list(m ORDER BY i) AS c
        FROM (SELECT i, avg(x) AS m FROM components GROUP BY i)""",
    "pairs": """
        SELECT a.id AS id, b.id AS other, a.label AS label, b.label AS other_label,
               list_distance(a.v, b.v) AS d
        FROM vectors a JOIN vectors b ON a.id <> b.id""",
    "to_centre": """
        SELECT 0::BIGINT AS query_id, id, label, list_distance(v, c) ** 2 AS distance
        FROM vectors, centre""",
}

FEATURES = [*STATISTICAL_FIELDS, "is_tcp", "is_udp"]

_scaled = ",\n               ".join(
    f"({f} - avg({f}) OVER ()) / CASE WHEN stddev_pop({f}) OVER () > 0"
    f" THEN stddev_pop({f}) OVER () ELSE 1 END AS {f}"
    for f in FEATURES
)
STEPS["scaled"] = f"""
        SELECT id, first_seq, proto AS transport, app_proto,
               {_scaled}
        FROM features"""

# Each step with the steps it reads, in the order they can be stated.
ORDER = [
    ("packets", []),
    ("directed", ["packets"]),
    ("keyed", ["directed"]),
    ("bytes", ["packets"]),
    ("entropies", ["bytes"]),
    ("sequence", ["keyed", "entropies"]),
    ("flag_seen", ["keyed"]),
    ("flag_text", ["flag_seen"]),
    ("grouped", ["sequence"]),
    ("ports", []),
    ("flows", ["grouped", "flag_text", "ports"]),
    ("entries", ["flows"]),
    ("features", ["entries"]),
    ("scaled", ["features"]),
    ("vectors", []),
    ("components", ["vectors"]),
    ("centres", ["components"]),
    ("centre", ["components"]),
    ("pairs", ["vectors"]),
    ("to_centre", ["vectors", "centre"]),
]


def over(step, select):
    """`select` after the steps it needs."""
    reads = dict(ORDER)
    needed = set()

    def need(name):
        if name not in needed:
            needed.add(name)
            for other in reads[name]:
                need(other)

    for name in step.split():
        need(name)
    parts = [f"{name} AS ({STEPS[name].strip()})" for name, _ in ORDER if name in needed]
    return "WITH " + ",\n".join(parts) + "\n" + select


def r4(expr, name=None):
    return f"round(({expr}) + {SHIFT}, 4)" + (f" AS {name}" if name else "")


def r4s(names):
    return ", ".join(r4(n, n) for n in names)


# ---- packets ---------------------------------------------------------------------

IPV4_PACKETS = over(
    "packets",
    "SELECT seq, ts_us, src_ip, src_port, dst_ip, dst_port, proto, pkt_len, tcp_flags "
    "FROM packets WHERE ip_version = 4",
)
def captured(two_links):
    """What a capture file keeps of a packet; with `two_links`, odd ones have no link header."""
    link = "CASE WHEN seq % 2 = 1 THEN 0 ELSE 14 END" if two_links else "14"
    return over(
        "packets",
        f"""SELECT row_number() OVER (ORDER BY seq) - 1 AS id, ts_us, ip_version,
            CASE WHEN v4 THEN src_ip END AS src_ip, CASE WHEN v4 AND proto IN (6, 17) THEN src_port END AS src_port,
            CASE WHEN v4 THEN dst_ip END AS dst_ip, CASE WHEN v4 AND proto IN (6, 17) THEN dst_port END AS dst_port,
            CASE WHEN v4 THEN proto END AS proto,
            greatest(pkt_len, {link} + CASE WHEN v4 THEN 20 ELSE 40 END
                + CASE proto WHEN 6 THEN 20 WHEN 17 THEN 8 ELSE 0 END + strlen(payload))::INTEGER AS pkt_len,
            CASE WHEN v4 THEN tcp_flags END AS tcp_flags
        FROM (SELECT *, ip_version = 4 AS v4 FROM packets)""",
    )


PACKET_LIMIT = over(
    "packets", "SELECT seq, ts_us, ip_version, pkt_len FROM packets ORDER BY seq LIMIT 100"
)
FLOW_KEYS = over(
    "packets",
    "SELECT seq, src_ip, CASE WHEN proto IN (6, 17) THEN src_port END AS src_port, dst_ip, "
    "CASE WHEN proto IN (6, 17) THEN dst_port END AS dst_port, proto AS protocol "
    "FROM packets WHERE ip_version = 4",
)
CANONICAL_FLOWS = over("keyed", f"SELECT seq, {KEY}, direction FROM keyed")
PAYLOAD_ENTROPY = over(
    "packets entropies",
    f"SELECT seq, {r4('coalesce(h, 0.0)', 'entropy')} FROM packets LEFT JOIN entropies USING (seq)",
)
TCP_FLAGS = over(
    "packets",
    """SELECT seq, concat_ws('_',
        CASE WHEN tcp_flags & 2 <> 0 THEN 'S' END, CASE WHEN tcp_flags & 16 <> 0 THEN 'A' END,
        CASE WHEN tcp_flags & 1 <> 0 THEN 'F' END, CASE WHEN tcp_flags & 4 <> 0 THEN 'R' END,
        CASE WHEN tcp_flags & 8 <> 0 THEN 'P' END, CASE WHEN tcp_flags & 32 <> 0 THEN 'U' END)
        AS flags FROM packets WHERE ip_version = 4""",
)
ISO_TIMESTAMPS = over(
    "packets",
    "SELECT seq, strftime(make_timestamp(ts_us), '%Y-%m-%dT%H:%M:%S.%fZ') AS timestamp FROM packets",
)
INTERARRIVAL = over("sequence", "SELECT seq, pos, round(dt, 6) AS dt FROM sequence")

# ---- flows -----------------------------------------------------------------------

FLOW_TABLE = over(
    "flows",
    f"SELECT {KEY}, first_seq, {r4s(STATISTICAL_FIELDS)}, proto, app_proto, flags_summary, "
    "timestamp FROM flows",
)
_plain = [f for f in STATISTICAL_FIELDS if not f.startswith("entropy")]
FLOW_STATISTICS = over("grouped", f"SELECT {KEY}, first_seq, {r4s(_plain)} FROM grouped")
DIRECTIONAL_BYTES = over("grouped", f"SELECT {KEY}, forward_bytes, backward_bytes FROM grouped")
ENTROPY_STATS = over(
    "grouped", f"SELECT {KEY}, {r4s(['entropy_mean', 'entropy_std'])} FROM grouped"
)
TCP_FLAGS_SUMMARY = over("flows", f"SELECT {KEY}, flags_summary FROM flows")
PROTOCOL_NAMES = over(
    "packets",
    "SELECT proto, CASE proto WHEN 6 THEN 'TCP' WHEN 17 THEN 'UDP' WHEN 1 THEN 'ICMP' "
    "ELSE 'OTHER' END AS name, count(*) AS packets FROM packets WHERE ip_version = 4 GROUP BY proto",
)
APP_PROTOCOLS = over("flows", f"SELECT {KEY}, app_proto FROM flows")
PROTOCOL_IDS = over(
    "flows",
    f"""SELECT {KEY},
        CASE proto WHEN 'TCP' THEN 0 WHEN 'UDP' THEN 1 WHEN 'ICMP' THEN 2 ELSE 3 END AS proto_id,
        CASE app_proto WHEN 'HTTP' THEN 0 WHEN 'HTTPS' THEN 1 WHEN 'SSH' THEN 2 WHEN 'FTP' THEN 3
             WHEN 'SMTP' THEN 4 WHEN 'DNS' THEN 5 WHEN 'DHCP' THEN 6 WHEN 'NTP' THEN 7
             ELSE 8 END AS app_proto_id
        FROM flows""",
)
_element = (
    f"pos, round(dt, 6) AS dt, pkt_len::DOUBLE AS pkt_size, direction, {r4('entropy', 'entropy')}"
)
TEMPORAL_SEQUENCES = over(
    "sequence", f"SELECT {KEY}, 0::BIGINT AS segment, {_element} FROM sequence"
)
STORED_FLOWS = over(
    "sequence",
    f"SELECT {KEY}, min(seq) OVER (PARTITION BY {KEY}) AS first_seq, {_element} "
    "FROM sequence QUALIFY pos < 10",
)


def windowed_flows(seconds):
    width = seconds * 1_000_000
    key = f"window_us, {KEY}"
    return over(
        "keyed",
        f"""SELECT w.*, coalesce(t.flags, 'NONE') AS flags_summary FROM (
            SELECT {key}, min(seq) AS first_seq,
               {r4('(arg_max(ts_us, seq) - arg_min(ts_us, seq)) / 1e6', 'flow_duration')},
               {r4('sum(pkt_len)', 'total_bytes')}, {r4('count(*)', 'packet_count')},
               {r4('avg(pkt_len)', 'mean_pkt_size')}, {r4('stddev_pop(pkt_len)', 'std_pkt_size')},
               {r4('coalesce(avg(dt) FILTER (dt > 0), 0.0)', 'mean_dt')},
               {r4('coalesce(stddev_pop(dt) FILTER (dt > 0), 0.0)', 'std_dt')},
               {r4('coalesce(sum(pkt_len) FILTER (direction > 0), 0)::DOUBLE / sum(pkt_len)', 'byte_ratio')}
            FROM (SELECT *, (ts_us - lag(ts_us) OVER (PARTITION BY {key} ORDER BY seq)) / 1e6 AS dt
                  FROM (SELECT *, ts_us - ts_us % {width} AS window_us FROM keyed))
            GROUP BY {key}) w
        LEFT JOIN (
            SELECT {key}, string_agg(flag, '_' ORDER BY spot) AS flags FROM (
                SELECT {key}, flag, min(seq * 8 + place) AS spot
                FROM (SELECT *, ts_us - ts_us % {width} AS window_us FROM keyed),
                     (VALUES ('S', 2, 0), ('A', 16, 1), ('F', 1, 2), ('R', 4, 3), ('P', 8, 4),
                             ('U', 32, 5)) AS f(flag, bit, place)
                WHERE tcp_flags & bit <> 0 GROUP BY {key}, flag) GROUP BY {key}) t
        ON w.window_us = t.window_us AND w.src_ip = t.src_ip AND w.dst_ip = t.dst_ip
           AND w.src_port IS NOT DISTINCT FROM t.src_port
           AND w.dst_port IS NOT DISTINCT FROM t.dst_port AND w.protocol = t.protocol""",
    )


# ---- flow files and the store ----------------------------------------------------

JSONL_ROUNDTRIP = over(
    "flows",
    f"SELECT {KEY}, packet_count::INTEGER AS dts, packet_count, {r4('mean_dt', 'mean_dt')}, "
    "app_proto, timestamp, 'normal' AS label FROM flows",
)
STORE_ROUNDTRIP = over(
    "entries",
    f"SELECT id, {KEY}, least(packet_count, 10)::INTEGER AS kept_packets, total_bytes, "
    "12 AS dimension, total_bytes::FLOAT::DOUBLE AS bytes_feature FROM entries",
)
STORED_IDS = over("entries", f"SELECT id, {KEY}, first_seq FROM entries")

_hit = f"SELECT id, {KEY}, proto, app_proto, flags_summary FROM entries "


STREAM_INTAKE = over(
    "entries", f"SELECT id, {KEY}, packet_count, total_bytes, 64 AS dimension, timestamp FROM entries")
STREAM_PROTOCOL_COUNTS = over(
    "packets",
    "SELECT coalesce(name, 'OTHER') AS protocol, count(*) AS packets FROM (SELECT CASE proto WHEN 6 THEN 'TCP' "
    "WHEN 17 THEN 'UDP' WHEN 1 THEN 'ICMP' END AS name FROM packets) GROUP BY name",
)


def flows_by_ip(ip, k):
    return over(
        "entries", _hit + f"WHERE src_ip = '{ip}' OR dst_ip = '{ip}' ORDER BY id LIMIT {k}"
    )


def flows_by_port(port, k):
    return over(
        "entries", _hit + f"WHERE src_port = {port} OR dst_port = {port} ORDER BY id LIMIT {k}"
    )


def flows_by_protocol(name, k):
    return over(
        "entries",
        _hit + f"WHERE proto = upper('{name}') OR app_proto = upper('{name}') ORDER BY id LIMIT {k}",
    )


FILTER_NESTED = over("entries", _hit + "WHERE proto = 'UDP' AND dst_port = 53")


def _text(fmt, expr):
    # Halves go up, as they do in the formatting on the other side.
    return f"printf('{fmt}', {expr} + 1e-7)"


def _end(side):
    return f"{side}_ip || ':' || coalesce({side}_port::VARCHAR, 'None')"


_details = f"""SELECT id, {_end('src')} || ' → ' || {_end('dst')} AS connection,
    proto AS transport, app_proto AS application,
    CASE WHEN flags_summary <> 'NONE' THEN flags_summary END AS tcp_flags,
    {_text('%.3f', 'flow_duration')} || 's' AS duration,
    format('{{:,}}', total_bytes::BIGINT) AS total_bytes,
    {_text('%.0f', 'packet_count')} AS packets,
    {_text('%.1f', 'mean_pkt_size')} || ' bytes' AS avg_pkt_size,
    {_text('%.2f', 'byte_ratio')} AS byte_ratio,
    {_text('%.3f', 'entropy_mean')} || ' (±' || {_text('%.3f', 'entropy_std')} || ')' AS entropy,
    timestamp AS captured FROM entries """
FLOW_DETAILS = over("entries", _details)


def flow_by_id(index):
    return over("entries", _details + f"WHERE id = {index}")


def flow_listing(limit):
    return over(
        "entries",
        f"""SELECT id, lpad(id::VARCHAR, 4, ' ') || '. ' || rpad({_end('src')}, 30, ' ') || ' → '
            || rpad({_end('dst')}, 30, ' ') || ' [' || rpad(proto, greatest(4, length(proto))::INTEGER, ' ') || '] '
            || lpad(format('{{:,}}', total_bytes::BIGINT), 8, ' ') || 'B '
            || lpad(packet_count::BIGINT::VARCHAR, 4, ' ') || 'pkts' AS line
            FROM entries ORDER BY id LIMIT {limit}""",
    )


def listing_totals(limit):
    return over(
        "entries",
        f"SELECT count(*) AS total_flows, least(count(*), {limit})::BIGINT AS shown, "
        f"greatest(count(*) - {limit}, 0)::BIGINT AS more FROM entries",
    )


_share = "count(*) * 100.0::DOUBLE / sum(count(*)) OVER ()"
PROTOCOL_DISTRIBUTION = over(
    "entries",
    f"SELECT proto, count(*) AS flows, {r4(_share, 'pct')} FROM entries GROUP BY proto",
)
PROTOCOL_BARS = over(
    "entries",
    """SELECT proto, repeat('█', n) || repeat('░', 50 - n) AS bar FROM (
        SELECT proto, floor(count(*) * 100.0::DOUBLE / sum(count(*)) OVER () / 2)::INTEGER AS n
        FROM entries GROUP BY proto)""",
)
APP_PROTOCOL_TOP10 = over(
    "entries",
    f"""SELECT app_proto, flows, pct FROM (
        SELECT app_proto, count(*) AS flows, min(id) AS first_id, {r4(_share, 'pct')}
        FROM entries GROUP BY app_proto) ORDER BY flows DESC, first_id LIMIT 10""",
)
STORE_TOTALS = over(
    "entries",
    f"""SELECT count(*) AS total_flows, 'flatl2' AS index_type, 64 AS dimension,
        sum(total_bytes) AS total_bytes, sum(packet_count) AS total_packets,
        {r4('avg(total_bytes)', 'avg_bytes')}, {r4('avg(packet_count)', 'avg_packets')}
        FROM entries""",
)

# ---- features --------------------------------------------------------------------

FEATURE_VECTOR = over("features", f"SELECT first_seq, {r4s(FEATURES)} FROM features")
SCALED_FEATURES = over("scaled", f"SELECT first_seq, {r4s(FEATURES)} FROM scaled")
TRAINING_ROWS = over(
    "scaled",
    f"SELECT first_seq, app_proto AS label, dense_rank() OVER (ORDER BY app_proto) - 1 AS label_idx, "
    f"{r4(' + '.join(FEATURES), 'feature_sum')} FROM scaled",
)

# ---- search ----------------------------------------------------------------------

L2_DISTANCE = over(
    "vectors centres",
    f"SELECT id, {r4('list_distance(v, c) ** 2', 'distance')} FROM vectors JOIN centres USING (label)",
)
NORMALIZED_EMBEDDINGS = over(
    "components",
    f"SELECT id, i - 1 AS i, {r4('x / sqrt(sum(x * x) OVER (PARTITION BY id))', 'x')} FROM components",
)
_ranked = (
    "SELECT query_id, rank, id, " + r4("distance", "distance") + " FROM ("
    "SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM ({}))"
    " WHERE rank <= {}"
)
KNN_EXACT = over(
    "vectors centres",
    _ranked.format(
        "SELECT centres.label::BIGINT AS query_id, id, list_distance(v, c) ** 2 AS distance "
        "FROM vectors, centres",
        10,
    ),
)
IVF_LISTS, IVF_PROBES = 16, 4
KNN_IVF = over(
    "vectors centres",
    _ranked.format(
        f"""WITH lists AS (SELECT id AS list_id, v AS centre FROM vectors WHERE id < {IVF_LISTS}),
        held AS (SELECT id, v, list_id FROM (
            SELECT id, v, list_id, row_number() OVER (PARTITION BY id ORDER BY list_distance(v, centre), list_id) AS n
            FROM vectors, lists) WHERE n = 1),
        probed AS (SELECT label, c, list_id FROM (
            SELECT label, c, list_id, row_number() OVER (PARTITION BY label ORDER BY list_distance(c, centre), list_id) AS n
            FROM centres, lists) WHERE n <= {IVF_PROBES})
        SELECT probed.label::BIGINT AS query_id, id, list_distance(v, c) ** 2 AS distance
        FROM probed JOIN held USING (list_id)""",
        10,
    ),
)
LSH_TABLES, LSH_PROJECTIONS, LSH_WIDTH, LSH_PROBES = 4, 4, 5.0, 2
KNN_LSH = over(
    "vectors centres",
    _ranked.format(
        f"""WITH dirs AS (
            SELECT t, p, list_transform(range(64), lambda n: ((n * (3 * t + 7 * p + 1) + 5 * p + 11 * t) % 13 - 6)::DOUBLE) AS dir,
                (2 * t + p) % 5 / 5::DOUBLE + 0.05::DOUBLE AS shift
            FROM range({LSH_TABLES}) a(t), range({LSH_PROJECTIONS}) b(p)),
        cells AS (
            SELECT id, t, list(floor(list_dot_product(v::DOUBLE[], dir) / {LSH_WIDTH}::DOUBLE + shift)::BIGINT ORDER BY p) AS cell
            FROM vectors, dirs GROUP BY id, t),
        asked AS (
            SELECT label, t, list(list_dot_product(c::DOUBLE[], dir) / {LSH_WIDTH}::DOUBLE + shift ORDER BY p) AS place
            FROM centres, dirs GROUP BY label, t),
        own AS (
            SELECT label, t, list_transform(place, lambda x: floor(x)::BIGINT) AS cell,
                list_transform(place, lambda x: x - floor(x)) AS part FROM asked),
        moves AS (
            SELECT label, t, cell, j, row_number() OVER (PARTITION BY label, t ORDER BY
                CASE WHEN j < {LSH_PROJECTIONS} THEN part[j + 1] ELSE 1 - part[j - {LSH_PROJECTIONS} + 1] END, j) AS n
            FROM own, range({2 * LSH_PROJECTIONS}) m(j)),
        probed AS (
            SELECT label, t, cell FROM own UNION ALL
            SELECT label, t, list_transform(cell, lambda x, i: x + CASE WHEN i = j % {LSH_PROJECTIONS} + 1
                THEN CASE WHEN j < {LSH_PROJECTIONS} THEN -1 ELSE 1 END ELSE 0 END) AS cell
            FROM moves WHERE n <= {LSH_PROBES}),
        met AS (SELECT DISTINCT label, id FROM probed JOIN cells USING (t, cell))
        SELECT label::BIGINT AS query_id, id, list_distance(v, c) ** 2 AS distance
        FROM met JOIN (SELECT id, v FROM vectors) USING (id) JOIN (SELECT label, c FROM centres) USING (label)""",
        10,
    ),
)
KNN_JOIN = over(
    "pairs", _ranked.format("SELECT id AS query_id, other AS id, d ** 2 AS distance FROM pairs", 5)
)
QUERY_BY_EMBEDDING = over("to_centre", _ranked.format("SELECT * FROM to_centre", 10))
HIT_RECORDS = over(
    "to_centre",
    f"""SELECT query_id, rank, id, label, {r4('distance', 'distance')} FROM (
        SELECT *, row_number() OVER (ORDER BY distance, id) AS rank FROM to_centre) WHERE rank <= 10""",
)
KNN_PRE_FILTER = over(
    "to_centre", _ranked.format("SELECT * FROM to_centre WHERE label = 3", 10)
)
KNN_POST_FILTER = over(
    "to_centre",
    _ranked.format(
        "SELECT * FROM (SELECT * FROM to_centre ORDER BY distance, id LIMIT 100) WHERE label = 3", 10
    ),
)
_from_zero = " + ".join(f"{f} * {f}" for f in FEATURES)
NEAREST_ZERO = over(
    "scaled",
    _ranked.format(
        f"SELECT 0::BIGINT AS query_id, id, {_from_zero} AS distance FROM scaled "
        "WHERE transport = 'UDP'",
        10,
    ),
)


def find_similar(index, k):
    return over(
        "pairs",
        _ranked.format(
            f"SELECT id AS query_id, other AS id, d ** 2 AS distance FROM pairs WHERE id = {index}", k
        ),
    )


_nearest = """SELECT id, arg_min(other, (d, other)) AS neighbour, min(d) ** 2 AS distance
    FROM pairs {} GROUP BY id"""


def _far(sample, threshold, k):
    return over(
        "vectors pairs",
        f"""SELECT id, neighbour, {r4('distance', 'distance')} FROM ({_nearest.format(sample)})
        WHERE distance > {threshold} ORDER BY distance DESC, id LIMIT {k}""",
    )


def anomalies(threshold, k, sample):
    if sample is None:
        return _far("", threshold, k)
    return _far(
        f"WHERE id IN (SELECT id FROM vectors ORDER BY id LIMIT {sample})", threshold, k
    )


ANOMALIES_SAMPLED = _far(
    "WHERE id IN (SELECT id FROM vectors ORDER BY (id % 2147483647 * 48271 + 42) % 2147483647, id "
    "LIMIT 50)",
    1.2,
    50,
)
RAG_CONTEXT = over(
    "entries scaled",
    f"""SELECT 0::BIGINT AS query_id, 'Here are the most relevant network flows:' || chr(10)
        || string_agg(line, chr(10) ORDER BY rank) AS context FROM (
        SELECT rank, concat_ws(chr(10), 'Flow ' || rank || ':',
            '  - Connection: ' || {_end('src')} || ' → ' || {_end('dst')},
            '  - Protocol: ' || proto || ' / ' || e.app_proto,
            '  - Duration: ' || {_text('%.3f', 'e.flow_duration')} || 's',
            '  - Total bytes: ' || {_text('%.0f', 'e.total_bytes')},
            '  - Packets: ' || {_text('%.0f', 'e.packet_count')},
            '  - Similarity score: ' || printf('%.4f', distance)) AS line
        FROM entries e JOIN (
            SELECT id, distance, row_number() OVER (ORDER BY distance, id) AS rank FROM (
                SELECT id, {_from_zero} AS distance FROM scaled)) h ON e.id = h.id
        WHERE rank <= 5)""",
)

# ---- labels, triplets, clustering ------------------------------------------------

LABEL_INDEX = (
    "SELECT label, row_number() OVER (ORDER BY label) - 1 AS label_idx "
    "FROM (SELECT DISTINCT label FROM embeddings)"
)
LABEL_GROUPS = """SELECT dense_rank() OVER (ORDER BY label) - 1 AS label_idx, 0::BIGINT AS part,
    row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS pos, vec_id AS id FROM embeddings"""


def _mixed(multiplier):
    return f"(id % 2147483647 * {multiplier}) % 2147483647"


_triplets = f"""
    ranked AS (SELECT id, v, dense_rank() OVER (ORDER BY label) - 1 AS label_idx,
                      row_number() OVER (PARTITION BY label ORDER BY id) - 1 AS rank FROM vectors),
    sizes AS (SELECT label_idx, count(*) AS n, count(*) OVER () AS labels FROM ranked
              GROUP BY label_idx),
    anchors AS (SELECT r.*, s.n, s.labels,
        (rank + CASE WHEN n > 1 THEN 1 + {_mixed(48271)} % greatest(n - 1, 1) ELSE 0 END) % n AS pos_rank,
        (r.label_idx + CASE WHEN labels > 1 THEN 1 + {_mixed(69621)} % greatest(labels - 1, 1)
         ELSE 0 END) % labels AS neg_label_idx
        FROM ranked r JOIN sizes s USING (label_idx)),
    chosen AS (SELECT a.id, a.label_idx, a.v, p.id AS pos_id, p.v AS pos_v, a.neg_label_idx,
        n.id AS neg_id, n.v AS neg_v
        FROM anchors a
        JOIN ranked p ON p.label_idx = a.label_idx AND p.rank = a.pos_rank
        JOIN sizes s ON s.label_idx = a.neg_label_idx
        JOIN ranked n ON n.label_idx = a.neg_label_idx AND n.rank =
            CASE WHEN a.labels > 1 THEN (a.id % 2147483647 * 16807) % 2147483647 % s.n ELSE a.rank END)"""

TRIPLETS = (
    over("vectors", "")
    + ","
    + _triplets
    + " SELECT id, label_idx, pos_id, neg_label_idx, neg_id FROM chosen"
)


def _moved(a, b):
    return (
        f"sqrt(list_sum(list_transform(list_zip({a}, {b}), "
        "lambda p: (p[1] - p[2] + 1e-6) ** 2)))"
    )


TRIPLET_LOSS = (
    over("vectors", "")
    + ","
    + _triplets
    + f""" SELECT count(*) AS triplets, {r4(f"avg(greatest(0.0, {_moved('v', 'pos_v')} - {_moved('v', 'neg_v')} + 0.5))", 'loss')}
    FROM chosen"""
)
DAVIES_BOULDIN = over(
    "vectors centres",
    f"""SELECT count(*) AS clusters, {r4('avg(worst)', 'davies_bouldin')} FROM (
        SELECT a.label, max((a.s + b.s) / list_distance(a.c, b.c)) AS worst
        FROM spread a JOIN spread b ON a.label <> b.label GROUP BY a.label)""",
).replace(
    "\nSELECT count(*)",
    """,
spread AS (SELECT label, any_value(c) AS c, avg(list_distance(v, c)) AS s
           FROM vectors JOIN centres USING (label) GROUP BY label)
SELECT count(*)""",
    1,
)
CALINSKI_HARABASZ = over(
    "vectors centres centre",
    f"""SELECT k AS clusters, {r4('(ssb / (k - 1)) / (ssw / (n - k))', 'calinski_harabasz')}
        FROM (SELECT count(*) AS k, sum(n)::DOUBLE AS n,
                     sum(n * list_distance(centres.c, centre.c) ** 2) AS ssb FROM centres, centre),
             (SELECT sum(list_distance(v, c) ** 2) AS ssw FROM vectors JOIN centres USING (label))""",
)
SILHOUETTE = over(
    "vectors pairs",
    f"""SELECT {r4('avg(coalesce((b - a) / greatest(a, b), 0.0))', 'silhouette')} FROM (
        SELECT id, max(m) FILTER (other_label = label) AS a, min(m) FILTER (other_label <> label) AS b
        FROM (SELECT id, label, other_label, avg(d) AS m FROM pairs GROUP BY id, label, other_label)
        GROUP BY id)""",
)
