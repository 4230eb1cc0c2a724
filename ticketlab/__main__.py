"""Command line: ticket file(s) in, every result table out.

    python -m ticketlab report --input tickets.csv --out results/ \\
        [--format csv|parquet|json] [--exclude-account NAME ...]
        [--accounts A ...] [--all-accounts] [--priorities P1 P2 ...]
        [--areas ...] [--start 2025-01-01] [--end 2025-03-31]
        [--owner-groups "TSE and PSE"] [--rcas ...] [--missing-label nan]
        [--column SOURCE=NAME ...] [--strict-dates]

Writes the dashboard tables (overview, trends, durations, distributions,
words, filter choices), the data-quality tables (totals, PODs, areas, months, sample, terms,
values that were no date; issue rows as Parquet), the cleaning funnel, and the filtered tickets
(Parquet by month) under ``--out``.
"""

from __future__ import annotations

import argparse
import datetime as dt
import os

from pyspark.sql import Observation

from .operators.clean import CleanConfig, cleaning_funnel, clean_tickets, quality_input
from .operators import filters as opt
from .operators.filters import TicketFilter, filter_tickets
from .plans.report import quality_report_tables, report_tables, write_report
from .session import get_spark, materialize
from .sources.sinks import write_table
from .sources.tickets import ColumnMapping, missing_columns, read_tickets


def _date(s: str | None) -> dt.date | None:
    return dt.date.fromisoformat(s) if s else None


def _opt(values):
    return None if values is None else tuple(values)


def parse_args(argv=None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="ticketlab")
    sub = p.add_subparsers(dest="command", required=True)
    r = sub.add_parser("report", help="clean, filter and write every result table")
    r.add_argument("--input", required=True, help="file or folder; a CSV file with quoted line ends is read by one task, "
                                                  "so give large inputs as many files or as Parquet")
    r.add_argument("--out", required=True)
    r.add_argument("--format", default="csv", choices=["csv", "parquet", "json", "orc"])
    r.add_argument("--master", default=None, help="Spark master (default: the launcher's)")
    r.add_argument("--column", action="append", default=[], metavar="SOURCE=NAME",
                   help="a column of the file that feeds a library column (group_id, ...) in place of the usual one; "
                        "the first of several that the file has is taken")
    r.add_argument("--strict-dates", action="store_true", help="stop at the first value that is no date (default: count them)")
    r.add_argument("--exclude-account", action="append", default=[], help="internal account to drop")
    r.add_argument("--missing-label", default=None)
    r.add_argument("--accounts", nargs="*", default=None, help="default: top 10 by volume")
    r.add_argument("--all-accounts", action="store_true")
    r.add_argument("--priorities", nargs="*", default=None)
    r.add_argument("--areas", nargs="*", default=None)
    r.add_argument("--start", default=None)
    r.add_argument("--end", default=None)
    r.add_argument("--owners", nargs="*", default=[])
    r.add_argument("--owner-groups", nargs="*", default=[])
    r.add_argument("--rcas", nargs="*", default=[])
    return p.parse_args(argv)


def run_report(args: argparse.Namespace) -> list[str]:
    spark = get_spark(args.master)
    raw = read_tickets(spark, args.input, args.format, mapping=ColumnMapping.parse(args.column))
    missing = missing_columns(raw)
    if missing:
        raise SystemExit(f"ticket file lacks columns: {', '.join(missing)}")
    if args.format in ("csv", "json"):
        raw = materialize(raw, "raw-tickets")  # parsed once; a multi-line CSV cannot be split or pruned
    cfg_kw = {"excluded_accounts": tuple(args.exclude_account)}
    if args.missing_label is not None:
        cfg_kw["missing_label"] = args.missing_label
    cfg = CleanConfig(**cfg_kw)
    t = clean_tickets(raw, cfg)
    flt = TicketFilter(
        accounts=() if args.all_accounts else _opt(args.accounts),
        priorities=_opt(args.priorities), areas=_opt(args.areas),
        start=_date(args.start), end=_date(args.end),
        owners=tuple(args.owners), owner_groups=tuple(args.owner_groups), rcas=tuple(args.rcas))
    f = filter_tickets(t, flt)
    tables = report_tables(f)
    tables["cleaning_funnel"] = cleaning_funnel(raw, cfg)
    # the choices the dashboard offers, from the cleaned (unfiltered) tickets
    tables.update({
        "top_accounts_default": opt.top_accounts(t),
        "account_options": opt.account_options(t),
        "priority_options": opt.priority_options(t),
        "area_options": opt.area_options(t),
        "owner_groups": opt.owner_groups(t, cfg.excluded_owners),
        "date_bounds": opt.date_bounds(t),
    })
    if "rca" in t.columns:
        tables["rca_options"] = opt.rca_options(t)
    rejects = Observation("date-rejects")
    tables.update(quality_report_tables(quality_input(raw, cfg.date_formats, args.strict_dates, rejects), rejects=rejects))
    paths = write_report(tables, os.path.join(args.out, "tables"))
    tickets_path = os.path.join(args.out, "filtered_tickets")
    write_table(f, tickets_path)
    return [*paths, tickets_path]


def main(argv=None) -> None:
    args = parse_args(argv)
    if args.command == "report":
        for p in run_report(args):
            print(p)


if __name__ == "__main__":
    main()
