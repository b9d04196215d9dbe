"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line.

Every query runs once to warm up and once for the clock; all columns of the
result are produced by the ``noop`` sink.
"""

import json
import os
import sys
import time

from strandline.plans import QUERIES
from strandline.session import local_session

HEADLINE = [
    "JN1_interval_overlap", "JN4_extract_target_reads", "WIN4_merge_overlapping", "AGG1_file_qc", "AGG13_genome_coverage", "AGG14_target_coverage",
    "WIN9_coverage_over_time", "AGG4_mod_site_counts_combined", "AGG9_probe_calls", "AGG26_gene_tags", "AGG27_overlap_artifacts", "AGG32_validated_fusions",
    "AGG37_cnv_bin_counts", "AGG41_cnv_events", "AGG19_pileup", "AGG23_vcf_annotations", "AGG45_classifier_top",
    "AGG29_cluster_dbscan", "AGG31_master_bed_events", "AGG36_fusion_funnel", "AGG43_cytoband_states_data", "WIN16_rolling_median", "STM6_stream_fusion_tags",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    names = sys.argv[1:] or HEADLINE
    times = {}
    for name in names:
        for _ in range(2):
            spark.catalog.clearCache()
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "total seconds of the headline queries, second run", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).replace("sf", "")}))
    spark.stop()


if __name__ == "__main__":
    main()
