"""Benchmark of the headline queries.

Reads ``$BENCH_SF_DIR`` (default /root/testdata/sf0.1) on ``local[$BENCH_CPUS]``.
The ticket view of the test tables is written to Parquet first, so reading
the source tables is not mixed into the query times. Each query runs once cold,
then ``$BENCH_RUNS`` (default 3) warm times; the median warm time is reported.
Every query is forced through a ``noop`` sink: the whole plan runs, nothing is
collected. Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from ticketlab.operators import clean, durations, filters, issues, metrics, similar, trends, words  # noqa: E402
from ticketlab.plans.oracle import INTERNAL_ACCOUNTS  # noqa: E402
from ticketlab.plans.report import report_tables  # noqa: E402
from ticketlab.session import get_spark, materialize  # noqa: E402
from ticketlab.sources.tickets import tickets_from_tables  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = int(os.environ.get("BENCH_CPUS", "8"))
RUNS = int(os.environ.get("BENCH_RUNS", "3"))
CFG = clean.CleanConfig(excluded_accounts=INTERNAL_ACCOUNTS)


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def timed(fn) -> float:
    fn()  # cold
    times = []
    for _ in range(RUNS):
        t0 = time.perf_counter()
        fn()
        times.append(time.perf_counter() - t0)
    return statistics.median(times)


def main() -> None:
    spark = get_spark(f"local[{CPUS}]", app_name="ticketlab-bench", shuffle_partitions=2 * CPUS,
                      extra={"spark.driver.memory": os.environ.get("BENCH_DRIVER_MEMORY", "16g")})
    raw = materialize(tickets_from_tables(spark, SF_DIR), "bench-raw-tickets", num_files=4 * CPUS)
    t = clean.clean_tickets(raw, CFG)
    f = filters.filter_tickets(t, filters.TicketFilter.all_accounts())
    q = clean.quality_input(raw)

    def report():
        for df in report_tables(f).values():
            run(df)

    plan = {
        "clean_tickets": lambda: run(t),
        "overview_kpis": lambda: run(metrics.overview_kpis(f)),
        "monthly_volume": lambda: run(trends.monthly_volume(f)),
        "resolution_by_priority": lambda: run(durations.resolution_by_priority(f)),
        "words_description": lambda: run(words.word_frequencies(f, "description")),
        "dq_issues": lambda: run(issues.dq_issues(q)),
        "dq_terms": lambda: run(issues.dq_terms(issues.dq_issues(q, columns=issues.COLUMNS_FOR["dq_terms"]))),
        "similar_values": lambda: run(similar.similar_values(q, "rca")),
        "report_all_tables": report,
    }
    only = [n for n in os.environ.get("BENCH_ONLY", "").split(",") if n]
    results = {}
    for name, fn in plan.items():
        if only and name not in only:
            continue
        results[name] = round(timed(fn), 3)
        print(f"# {name}: {results[name]}s", file=sys.stderr, flush=True)
    sf = os.path.basename(SF_DIR.rstrip("/")).replace("sf", "")
    print(json.dumps({
        "metric": "sum_of_median_query_seconds",
        "value": round(sum(results.values()), 3),
        "unit": "sec",
        "queries": results,
        "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf,
        "cpus": CPUS,
        "runs": RUNS,
        "spark": spark.version,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
