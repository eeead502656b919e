"""Time the headline queries: one JSON line.  BENCH_SF_DIR and BENCH_CPUS choose tables and cores."""

from __future__ import annotations

import json
import os
import time

HEADLINE = ["rel06_group_aggregate", "rel07_distinct", "rel12_row_number", "src04_explode_pairs", "nrm06_code_flags", "jon01_interval_join", "jon02_nearest_join", "jon03_asof_join", "jon09_pairs_within",
            "tim01_to_grid", "tim02_calendar_counts", "tim09_sessionize", "tim17_cusum", "tim24_transitions", "agg01_two_by_two", "agg02_disproportionality", "agg06_three_way", "agg08_cumulative_tables", "agg15_group_quantiles",
            "agg18_set_overlap", "agg27_rank_agreement", "srv02_kaplan_meier", "srv05_concordance", "srv07_landmark_dataset", "mod02_att_group_time", "mod08_ols", "evl01_auroc", "evl05_net_benefit", "evl12_permutation_test", "evl13_delong",
            "spl04_leakage_audit", "mul02_run_specs", "cln01_visit_cohort", "cln03_sofa", "cln05_kdigo", "rlt01_trajectories", "txt01_document_hits", "txt07_similar_documents", "txt08_coverage_scores", "grf02_depth", "grf05_tree_metrics", "spt03_morans_i", "spt05_matched_enrichment"]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from pyspark.sql import SparkSession

    from epiframe.catalog import QUERIES
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "16g")
             .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["rel06_group_aggregate"](spark, folder).write.format("noop").mode("overwrite").save()      # start the engine before the clock
    took = {}
    for name in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(","):
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - start, 3)
    sf = folder.rstrip("/").rsplit("sf", 1)[-1]
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": float(sf) if sf.replace(".", "").isdigit() else sf}))
    spark.stop()


if __name__ == "__main__":
    main()
