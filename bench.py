"""Times the headline queries on local[$BENCH_CPUS] over $BENCH_SF_DIR; prints one JSON line."""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
os.environ["PYTHONPATH"] = os.pathsep.join([os.path.dirname(os.path.abspath(__file__)), os.environ.get("PYTHONPATH", "")])

HEADLINE = "hybrid_query vector_top_k bm25_top rrf adaptive_cut idf_weights capped_neighbours parent_coverage cascade_delete second_hop merge_incidence merge_entities token_chunks content_documents upsert_rows staging risk_groups similar_patients stratified_folds distributions rate_limiter metric_windows".split()


def main() -> None:
    from quillgraph.plans import registry
    from quillgraph.session import get_session

    d = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_session(f"local[{cpus}]", int(cpus), **{"spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    registry.QUERIES["rrf"](spark, d).count()  # starts the JVM's and Python's workers
    took = {}
    for name in HEADLINE:
        began = time.time()
        registry.QUERIES[name](spark, d).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
        spark.catalog.clearCache()
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": d.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
