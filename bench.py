"""Seconds of the headline queries, as one JSON line."""

import json
import os
import sys
import time

from torsia.catalog import QUERIES, load
from torsia.session import get_spark

HEADLINE = (
    "dedup_exact", "kmer_counts_clean", "similar_items", "best_homologs", "blind_sites",
    "column_consensus", "column_association", "column_patterns", "family_composition", "subset_score",
    "torsion_histogram", "distance_by_divergence", "backbone_geometry", "nearest_named",
    "intervals", "interleave_tracks", "trace_summary", "expanding_tail",
    "ancestors", "tree_layout", "pure_clades", "score_sites", "hmm_loglik", "tree_site_loglik",
)


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_spark(cpus, int(cpus))
    spark.sparkContext.setLogLevel("ERROR")
    load()
    # Start-up of the engine is no part of any query.
    spark.read.parquet(f"{sf}/lineitem.parquet").groupBy("l_returnflag").count().collect()
    names = sys.argv[1:] or HEADLINE
    times = {}
    for name in names:
        start = time.time()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
        if sys.argv[1:]:
            print(name, times[name], file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "headline_total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf.rsplit("sf", 1)[-1],
    }))


if __name__ == "__main__":
    main()
