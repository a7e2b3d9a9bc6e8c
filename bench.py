"""Time the headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS]; print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from gleanery.session import build_session  # noqa: E402
from gleanery.workload import load_all  # noqa: E402

HEADLINE = [
    "A1_A2_run_quality", "A1_source_quality", "A4_decision_counts", "W1_latest_per_key", "W3_global_rank", "W3_rank_in_hot_group", "W4_spread_sample", "W6_top_with_more",
    "W8_failure_streak", "T1_J4_lifecycle", "T9_stage_events", "J2_source_or_fallback", "J11_match_by_names", "J14_match_identity", "J16_longest_alias", "J16_longest_alias_by_join", "J15_allowed_hosts",
    "F8_demanded_portfolio", "F11_audience_gate", "F19_facet_filter", "F24_F31_date_predicates", "S6_unwrap_envelopes", "S9_feed_rows", "S11_paging_state", "P6_greenhouse_items", "X1_clean_text",
    "X4_normalize_locations", "X10_name_key", "H1_visible_text", "H7_H8_vendors_and_endpoints", "H11_O11_recruitment_links", "A5_O2_campaigns", "A9_A10_company_backlog", "Z1_clamp_ratio", "P33_landing_pages", "P36_page_counts", "H12_page_jobs", "P36_collected_pages", "H14_analyse_changed", "H15_company_of_pages",
    "PLAN_catalog_sources", "PLAN_catalog_rejects", "PLAN_catalog_decisions",
]


def main() -> None:
    root = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__ui__enabled="false", spark__driver__memory="12g")
    spark.sparkContext.setLogLevel("ERROR")
    registered = load_all()
    spark.range(1000).mapInPandas(lambda batches: batches, "id long").count()  # start Python workers once
    times: dict[str, float] = {}
    for name in HEADLINE:
        start = time.perf_counter()
        registered[name].run(spark, root).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(root.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
