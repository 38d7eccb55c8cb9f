"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line."""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "risk_by_source", "r15_rule_totals", "f8_features_v4", "f4_url_features", "t14_english_share", "t9_strip_reply_structure",
    "h9_header_signals", "j1_exact_dedup", "j4_near_copy_groups", "m1_word_tfidf", "a3_roc_auc", "a24_bootstrap_policies",
    "w10_plateau_threshold", "w11_min_cost_threshold", "q11_holdout_report",
)


def main():
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    from mailgrain import catalog
    from mailgrain.session import build_session
    spark = build_session("mailgrain-bench", master=f"local[{cpus}]", cores=cpus)
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()  # session start is not part of a query
    seconds = {}
    for name in HEADLINE:
        start = time.time()
        catalog.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": os.path.basename(folder).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
