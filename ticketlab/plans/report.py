"""The result-table sets behind the slide deck and the PDF.

The filtered tickets without their long text columns are written once to the
shared checkpoint folder, and so is the base cube (after its shuffle): a lost
executor re-reads them instead of recomputing. Count tables roll up from the
cube; duration tables and the words of short columns read the narrow copy (two
scans for both durations, one for all short columns); the words of the long texts
are read straight from the source plan (column pruning: one column each). The
data-quality issues are written once and every quality table reads them.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, Observation

from ..operators import durations, metrics, trends, words
from ..operators.clean import date_rejects
from ..operators.issues import IssueConfig, data_quality_issues
from ..session import materialize
from ..sources.sinks import write_result_csv, write_table

WORD_COLUMNS = ("subject", "description", "pod_name", "product_area", "product_feature")
LONG_TEXT = ("subject", "description")


def report_tables(t: DataFrame, persist: bool = True) -> dict[str, DataFrame]:
    """Every ticket report table, keyed by name, from filtered tickets ``t``. Runs
    the jobs that write what several tables share."""
    narrow = t.drop(*LONG_TEXT)
    if persist:
        narrow = materialize(narrow, "filtered-tickets-narrow")
    cube = metrics.ticket_cube(narrow)
    if persist:
        cube = materialize(cube, "ticket-cube")
    # both durations from two scans; one row a measure and priority, written for the summaries
    measures = [m for m, end in (("resolution", "closed_at"), ("first_response", "first_response_at")) if end in t.columns]
    medians = materialize(durations.duration_medians(narrow, measures), "durations")
    res = durations.of_measure(medians, "resolution")
    # words of the short columns: one pass, at most the top words of each
    short = [c for c in WORD_COLUMNS if c not in LONG_TEXT]
    tagged = materialize(words.word_tables(narrow, short), "short-words")
    out = {
        "overview_kpis": metrics.overview_kpis(cube),
        "top_accounts": metrics.top_accounts_labeled(cube),
        "monthly_csat_labeled": trends.monthly_csat_labeled(cube),
        "csat_vs_overall": trends.csat_vs_overall(cube),
        "monthly_volume": trends.monthly_volume(cube),
        "monthly_csat": trends.monthly_csat(cube),
        "priority_distribution": metrics.priority_distribution(cube),
        "escalation_by_priority": metrics.escalation_by_priority(cube),
        "resolution_by_priority": res,
        "resolution_summary": durations.summarize(res),
        "area_distribution": metrics.area_distribution(cube),
        "area_feature_rollup": metrics.area_feature_rollup(cube),
        "rca_distribution": metrics.rca_distribution(cube),
        "rca_by_priority_top5": metrics.rca_by_priority_top(cube),
    }
    if "first_response" in measures:
        first = durations.of_measure(medians, "first_response")
        out |= {"first_response_by_priority": first, "first_response_summary": durations.summarize(first)}
    for c in WORD_COLUMNS:
        out[f"words_{c}"] = words.of_column(tagged, c) if c in short else words.word_frequencies(t, c)
    return out


def quality_report_tables(q: DataFrame, cfg: IssueConfig = IssueConfig(),
                          rejects: Observation | None = None) -> dict[str, DataFrame]:
    """Every data-quality table from raw tickets with parsed dates ``q``. One
    scan of ``q`` writes the issues' candidates and counts the DP tickets; with
    ``rejects`` (given to :func:`ticketlab.operators.clean.quality_input`
    as well) it also counts the values that were no date: ``date_rejects``."""
    tables = data_quality_issues(q, cfg)
    if rejects is not None:
        tables["date_rejects"] = date_rejects(q.sparkSession, rejects)
    return tables


# tables that grow with the tickets: written as Parquet, never as one file
TICKET_SIZED = {"dq_issues"}
# tables that grow with accounts, owners, causes or months x accounts: CSV in
# as many files as the plan has partitions (no single-task write)
GROWS_WITH_DATA = {
    "monthly_volume", "monthly_csat", "monthly_csat_labeled", "csat_vs_overall",
    "area_feature_rollup", "area_distribution", "rca_distribution", "area_options", "dq_by_area", "dq_by_pod", "account_options", "owner_groups", "rca_options",
}


def write_report(tables: dict[str, DataFrame], out_dir: str) -> list[str]:
    """Write each result table under ``out_dir``: Parquet for ticket-sized
    tables, multi-file CSV for tables that grow with the data, and one CSV
    file for the small ones (bounded by fixed categories or a top-k)."""
    paths = []
    for name, df in tables.items():
        p = os.path.join(out_dir, name)
        if name in TICKET_SIZED:
            write_table(df, p, partition_by=())
        elif name in GROWS_WITH_DATA:
            write_table(df, p, fmt="csv", partition_by=())
        else:
            write_result_csv(df, p)
        paths.append(p)
    return paths
