"""Headline queries, timed. Prints one JSON line.

``BENCH_SF_DIR`` and ``BENCH_CPUS`` choose the data and the cores; a query's
time is the median of three after a first run; all result rows are computed.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "ag_13_supplier_totals", "ag_14_items_by_category", "ag_9_extraction_quality", "ag_10_check_errors_by_day",
    "ag_11_supplier_quality", "ag_12_missing_fields", "ag_15_ageing_report", "ag_16_cash_flow",
    "ag_19_field_confidence_by_client", "ag_20_sla_card", "ag_23_approver_performance", "ag_25_latency_percentiles",
    "ag_28_confidence_rollup", "ag_29_monthly_metric", "ag_3_run_summary", "ag_33_field_accuracy", "ag_36_weighted_confidence",
    "jn_4_vat_mismatches", "jn_12_duplicates", "jn_13_fiscal_collisions", "jn_14_resolution", "jn_16_tax_id_by_name",
    "jn_18_classification", "enr_1_issuer", "tax_1_bands", "val_1_rule_rows", "val_3_reconciled", "val_6_queue_rows",
    "sco_1_field_scores", "sco_4_parity_scores", "str_5_jaro_winkler", "src_2_collected", "src_10_xml_text",
    "snk_1_upserted_suppliers", "snk_9_change_images", "prj_10_public_id", "wn_3_nth_resolution",
]


def main() -> None:
    from tallywork.bindings import Tables
    from tallywork.catalog import QUERIES
    from tallywork.session import local_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    spark = local_session(cpus, "bench", memory="16g")

    def run(query) -> float:
        """Building a query counts too: some write numbered rows or an index first."""
        start = time.perf_counter()
        query(spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    tables = Tables(spark, sf_dir)
    start = time.perf_counter()
    rows = tables.invoices.count() + tables.items.count() + tables.invoices_with_copies.count()
    seconds = {"build_stored_tables": round(time.perf_counter() - start, 3)}
    for name in HEADLINE:
        run(QUERIES[name])
        times = [run(QUERIES[name]) for _ in range(3)]
        seconds[name] = round(statistics.median(times), 3)
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": seconds,
                      "sf": sf_dir.rsplit("sf", 1)[-1], "cpus": int(cpus), "stored_rows": rows}))


if __name__ == "__main__":
    main()
