"""Write PLANS.md: the final (adaptive) physical plan of each headline query,
reduced to the nodes that matter for scale: scans with their pushed filters
and read schema, exchanges, joins, aggregates, windows, Python evaluation.

Usage: python tools/plans.py [sf_dir] > PLANS.md
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from ticketlab.operators import clean, durations, filters, issues, metrics, similar, trends, words  # noqa: E402
from ticketlab.plans.oracle import INTERNAL_ACCOUNTS  # noqa: E402
from ticketlab.session import get_spark, materialize  # noqa: E402
from ticketlab.sources.tickets import tickets_from_tables  # noqa: E402

KEEP = ("Scan", "Exchange", "Join", "Aggregate", "Window", "EvalPython", "TakeOrdered", "Expand",
        "Generate", "Union", "Subquery", "AQEShuffleRead", "BroadcastQueryStage", "ShuffleQueryStage")


def summarize(plan: str) -> list[str]:
    out = []
    for line in plan.split("\n"):
        if not any(k in line for k in KEEP):
            continue
        line = re.sub(r"#\d+L?", "", line)
        line = re.sub(r"\[plan_id=\d+\]", "", line)
        line = re.sub(r"Location: [^,]+, ", "", line)
        line = re.sub(r"file:[^\]]+", "…", line)
        if "Scan parquet" in line or "FileScan" in line:
            m = re.search(r"PushedFilters: \[[^\]]*\]", line)
            r = re.search(r"ReadSchema: \S+", line)
            head = line.split("[")[0]
            line = head + (" " + m.group(0) if m else "") + (" " + r.group(0) if r else "")
        out.append(line.rstrip()[:220])
    return out


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = get_spark("local[8]", shuffle_partitions=16)
    raw = materialize(tickets_from_tables(spark, sf), "plans-raw-tickets", num_files=16)
    t = clean.clean_tickets(raw, clean.CleanConfig(excluded_accounts=INTERNAL_ACCOUNTS))
    f = filters.filter_tickets(t, filters.TicketFilter.all_accounts())
    q = clean.quality_input(raw)
    plans = {
        "clean_tickets (C17)": t,
        "filter_tickets, default top-10 accounts (F7)": filters.filter_tickets(t),
        "overview_kpis (A22)": metrics.overview_kpis(f),
        "csat_vs_overall (A8)": trends.csat_vs_overall(f),
        "rca_by_priority_top5 (A20)": metrics.rca_by_priority_top(f),
        "resolution_by_priority (A13)": durations.resolution_by_priority(f),
        "words_description (A21)": words.word_frequencies(f, "description"),
        "dq_issues (D10)": issues.dq_issues(q),
        "dq_terms (D16)": issues.dq_terms(issues.dq_issues(q, columns=issues.COLUMNS_FOR["dq_terms"])),
        "similar_values (D7)": similar.similar_values(q, "rca"),
    }
    print("# PLANS — final adaptive plans of the headline queries\n")
    print(f"Generated by `python tools/plans.py {sf}` (local[8], 16 shuffle partitions, AQE on;"
          " ticket view written to Parquet first). Each query is run once, then its final plan is"
          " reduced to scans, exchanges, joins, aggregates, windows and Python nodes.\n")
    for name, df in plans.items():
        df.write.format("noop").mode("overwrite").save()
        plan = df._jdf.queryExecution().executedPlan().toString()
        print(f"## {name}\n\n```")
        print("\n".join(summarize(plan)))
        print("```\n")
    spark.stop()


if __name__ == "__main__":
    main()
