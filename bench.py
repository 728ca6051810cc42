"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Every query is run to completion by writing all its rows to the no-op sink, so
no column is pruned away and nothing is collected on the driver. Dashboards read
stored Gold tables; building them and folding the newest days again are timed by
themselves, as ``gold_build`` and ``gold_refresh_days``.
"""

from __future__ import annotations

import json
import os
import sys
import time

from harness.all_cases import CASES
from harness.cases import Tables
from harness.metric_cases import gold_inputs, stored
from orgpulse.session import build_session

HEADLINE = [
    "mtr_git_person_totals",
    "mtr_git_person_weekly",
    "pr_props",
    "jira_closed_tasks",
    "comms_daily",
    "collab_bullet_rows",
    "exec_summary",
    "team_member",
    "metric_team_members",
    "bullet_team_collab",
    "bullet_ic_collab",
    "query_metric",
    "class_focus_metrics",
    "stg_slack_chat",
    "stg_zoom_meetings",
    "stg_ai_api_usage",
    "snapshot_scd2",
    "fields_history",
    "resolve_aliases",
    "match_rules",
    "identity_components",
    "subordinates",
    "temporal_join",
    "cohort_benchmark",
    "field_history_full_values",
    "status_periods",
    "wip_snapshots",
    "communication_events",
    "comm_daily_trend",
    "support_metrics",
    "exact_upper_median",
    "as_of_lookup",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", int(cpus), **{"spark.driver.memory": "20g"})
    spark.sparkContext.setLogLevel("ERROR")
    # One small query first, so that no headline query pays for JVM start-up.
    CASES["union_all"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds = {}

    def timed(name, work):
        start = time.perf_counter()
        work()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)

    tables = Tables(spark, sf_dir)
    newest = spark.sql("SELECT explode(sequence(DATE '2024-01-29', DATE '2024-01-30')) AS metric_date")
    timed("gold_build", lambda: stored(tables))
    timed("gold_refresh_days", lambda: stored(tables).refresh(gold_inputs(tables), newest))
    for name in HEADLINE:
        timed(name, lambda name=name: CASES[name](spark, sf_dir).write.format("noop").mode("overwrite").save())
    spark.stop()
    total = round(sum(seconds.values()), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": seconds, "sf": float(sf)}))


if __name__ == "__main__":
    main()
