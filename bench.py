"""Headline queries on local[$BENCH_CPUS] over $BENCH_SF_DIR; prints one JSON line.

Each query is timed once, with building, planning and a full write to the noop sink. One untimed run of the first query
starts the JVM before the clock does.
"""

import json
import os
import time

from tidewatch.plans.registry import QUERIES
from tidewatch.session import local_session

HEADLINE = ["event_score", "event_routing", "features_42", "keyword_techniques", "pattern_techniques", "threat_assessment",
            "session_correlation", "session_sizes", "open_incidents", "incident_rollup", "ml_investigation", "event_indicators",
            "document_indicators", "roc_auc", "psi_by_source", "psi_prices", "exact_quantiles", "page_hinkley", "rolling_windows",
            "stratified_split", "vector_top_k", "document_chunks", "provider_verdicts", "processing_metrics"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, "tidewatch-bench", shuffle=int(cpus) if cpus.isdigit() else 8)
    names = os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",")
    QUERIES[names[0]](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    n_events = spark.read.parquet(f"{sf_dir}/events.parquet").count()
    print(json.dumps({
        "metric": "headline queries, total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")), "events": n_events,
        "events_per_sec": {q: round(n_events / times[q]) for q in ("event_score", "open_incidents") if q in times}}))
    spark.stop()


if __name__ == "__main__":
    main()
