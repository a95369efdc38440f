"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "match_edges_contains", "match_edges_first", "resolve_keys_cli", "entity_details", "degrees", "relation_name_freq", "graph_digest",
    "search_op_logs", "ego_depth2", "ego_all", "shortest_paths", "all_paths", "infer_all", "recommend_purchases", "recommend_all_relations", "recommend_center",
    "jaccard_similar", "co_neighbors", "bridges", "keyword_search", "cosine_topk", "hybrid_search",
    "validate_relations", "apply_ops_entities", "cascade_delete", "chunk_documents", "chunk_sentences", "parse_model_json",
    "match_candidate_entities", "export_triples", "turtle_blocks", "stream_op_counts",
]


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true").config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "20g")).getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from graphloom.plans import all_queries
    from graphloom.plans.registry import store

    times = {}
    t = time.time()
    store(spark, sf_dir)
    times["load_graph"] = round(time.time() - t, 3)
    queries = all_queries()
    only = sys.argv[1:]
    for name in [n for n in HEADLINE if not only or n in only]:
        t = time.time()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf_dir.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
