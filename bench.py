"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

The star schema is built inside the timed ``build_star`` step (ledger, dimensions, fact and
panel from the raw tables, written as Parquet). The serving queries then read it, as they
would after a nightly load; ``fact_indicadores`` and ``panel_15`` start from the raw tables.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "fact_indicadores", "panel_15", "ranking_etl", "ranking_analyst", "kpis", "segment_comparison", "top5",
    "entity_history_24", "directory", "dim_entity", "upsert_entity", "load_report", "year_overview", "entity_matrix",
    "account_series_assets", "system_ratios", "entity_pivot", "traffic_light", "ingest_tree", "describe_by_segment",
    "indicator_profile", "compliance_alerts", "spearman_matrix", "spearman_target", "kruskal", "vif", "ols_hc3",
    "robust_scaled", "silhouette", "k_distance", "dbscan", "kmeans3", "pca_scores", "asof_monthly", "linear_trend",
    "forecast4", "forecast_frame", "holt", "adf", "adhoc_npl_over_10", "period_profile", "backtest_3m", "robust_distance",
]


def main() -> None:
    from balanza.plans import catalog
    from balanza.plans.star import star
    from balanza.session import build_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = build_session("bench", os.environ.get("BENCH_CPUS", "8"), os.environ.get("BENCH_MEMORY", "16g"))
    spark.sparkContext.setLogLevel("ERROR")
    catalog.load()
    wanted = sys.argv[1:] or HEADLINE
    spent: dict[str, float] = {}

    def timed(name, action):
        start = time.perf_counter()
        action()
        spent[name] = round(time.perf_counter() - start, 3)

    def build():
        for freq in ("quarter", "month"):
            s = star(spark, sf_dir, freq)
            for table in (s.ledger, s.fact):
                table.schema
        s = star(spark, sf_dir)
        for table in (s.dim_entity, s.dim_account, s.panel):
            table.schema

    spark.range(1000).selectExpr("sum(id)").collect()
    timed("build_star", build)
    for name in wanted:
        # Consume every row without moving it to the driver.
        timed(name, lambda: catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save())
    print(
        json.dumps(
            {
                "metric": "total time of headline queries",
                "value": round(sum(spent.values()), 3),
                "unit": "sec",
                "queries": spent,
                "sf": os.path.basename(sf_dir.rstrip("/")),
            }
        )
    )


if __name__ == "__main__":
    main()
