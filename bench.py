"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR and BENCH_CPUS choose the tables and the local threads. Each query runs
once to warm up and then BENCH_RUNS times; the best run counts. BENCH_ONLY names the
queries to run (separated by commas); BENCH_RATES=1 adds the rates to them.
"""

import json
import os
import time

from flowspark.operators import embedding as emb, flows as fl, search as se
from flowspark.plans.catalog import QUERIES, packets, vectors
from flowspark.session import cut, scratch_dir, session

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "2"))

HEADLINE = [
    "windowed_flows",
    "temporal_sequences",
    "stored_flows",
    "flow_table",
    "flow_statistics_no_payload",
    "store_roundtrip",
    "jsonl_roundtrip",
    "flows_by_ip",
    "protocol_distribution",
    "scaled_features",
    "flow_embeddings",
    "knn_exact",
    "knn_join",
    "knn_ivf",
    "knn_lsh",
    "anomalies_all",
    "rag_context",
    "triplet_loss",
    "davies_bouldin",
    "calinski_harabasz",
    "silhouette_exact",
]


def best_of(build):
    times = []
    for _ in range(1 + RUNS):
        began = time.perf_counter()
        build().write.format("noop").mode("overwrite").save()
        times.append(time.perf_counter() - began)
    return min(times[1:])


def measured_rates(spark):
    """Throughput of single jobs on prepared input."""
    # Flows of one-hour windows: a flow count large enough to time the scoring job.
    flows = emb.with_features(fl.windowed_flows(packets(spark, SF_DIR), 3600))
    flows = cut(flows.select("features").repartition(int(CPUS)))
    weights = emb.seeded_weights()
    embed = best_of(lambda: emb.embed_features(flows, weights).select("embedding"))
    rows = vectors(spark, SF_DIR)
    queries = se.query_rows(rows)
    exact = best_of(lambda: se.knn(rows, queries, 10))
    lists = se.InvertedLists.build(rows, scratch_dir(spark))
    probed = best_of(lambda: lists.search(queries, 10, probes=10))
    pairs = ["query_id", "id"]
    true = se.knn(rows, queries, 10).select(pairs)
    found = lists.search(queries, 10, probes=10).select(pairs).join(true, pairs, "left_semi")
    return {
        "embedding_flows": flows.count(),
        "embedding_flows_per_sec": round(flows.count() / embed),
        "knn_exact_queries_per_sec": round(queries.count() / exact),
        "knn_lists_queries_per_sec": round(queries.count() / probed),
        "knn_lists_recall_at_10": round(found.count() / true.count(), 3),
    }


def main():
    spark = session(
        "flowspark-bench",
        master=f"local[{CPUS}]",
        spark__sql__shuffle__partitions=CPUS,
        spark__ui__enabled="false",
        spark__driver__memory="8g",
        spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    only = os.environ.get("BENCH_ONLY")
    names = only.split(",") if only else HEADLINE
    seconds = {}
    for name in names:
        build = QUERIES[name][0]
        seconds[name] = round(best_of(lambda: build(spark, SF_DIR)), 3)
    packet_count = spark.read.parquet(f"{SF_DIR}/events.parquet").count()
    rates = measured_rates(spark) if os.environ.get("BENCH_RATES", "0" if only else "1") == "1" else {}
    if "flow_table" in seconds:
        rates["flow_table_packets_per_sec"] = round(packet_count / seconds["flow_table"])
    print(
        json.dumps(
            {
                "metric": "total seconds of the headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "rates": rates,
                "sf": SF_DIR.rstrip("/").rsplit("sf", 1)[-1],
                "cpus": int(CPUS),
            }
        )
    )


if __name__ == "__main__":
    main()
