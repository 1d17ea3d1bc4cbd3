"""Headline queries, one JSON line. BENCH_SF_DIR and BENCH_CPUS choose data and cores."""

import json
import os
import time

from lodestat import catalog
from lodestat.session import forget_staged, get_spark

HEADLINE = ("latest_filed", "ytd_subtrahend", "per_tag_chain", "as_of_bundle", "asof_price", "split_restatement", "max_drawdown", "skew_kurtosis",
            "forward_return", "candidates_at", "score_ticks", "sector_percentile", "ttm_all_or_null", "evaluate", "score_universe", "scorecard", "verdict_ladder",
            "facts_to_grades", "scan_fact_csv", "site_model", "view_current_metric", "status_transitions", "snapshot_diff", "modified_dietz", "streak", "import_filing_statements", "correlation_matrix", "st_current_view")


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = get_spark("bench", int(os.environ.get("BENCH_CPUS", "8")))
    spark.sparkContext.setLogLevel("ERROR")
    queries, took = catalog.queries(), {}
    queries["view_v_price"](spark, sf_dir).write.format("noop").mode("overwrite").save()     # JVM warm-up, not counted
    for name in HEADLINE:
        forget_staged()      # every query pays for its own intermediate tables
        t0 = time.time()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - t0, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took,
                      "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
