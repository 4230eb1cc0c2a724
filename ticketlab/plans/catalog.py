"""Registered queries: one per operator of the inventory, over the ticket view
of the driver test tables (``sources.tickets.RAW_TICKETS_SQL``).

Each callable takes (spark, sf_dir) and returns a DataFrame whose column
names equal those of its DuckDB twin in :mod:`ticketlab.plans.oracle`.
Computed doubles are rounded to 6 places (the twins do the same).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .. import constants as K
from ..operators import clean, durations, filters, issues, metrics, profile, similar, trends, words
from ..session import scratch_path
from ..sources import sinks, tickets
from . import report
from .oracle import INTERNAL_ACCOUNTS

CFG = clean.CleanConfig(excluded_accounts=INTERNAL_ACCOUNTS)


def r6(df: DataFrame) -> DataFrame:
    """Round double columns to 6 places for the cross-engine comparison."""
    cols = {f.name: F.round(F.col(f.name), 6) for f in df.schema.fields
            if isinstance(f.dataType, DoubleType)}
    return df.withColumns(cols) if cols else df


def raw(spark: SparkSession, d: str) -> DataFrame:
    return tickets.tickets_from_tables(spark, d)


def cleaned(spark: SparkSession, d: str) -> DataFrame:
    return clean.clean_tickets(raw(spark, d), CFG)


def filtered(spark: SparkSession, d: str) -> DataFrame:
    """Cleaned tickets under the default filter with every account chosen."""
    return filters.filter_tickets(cleaned(spark, d), filters.TicketFilter.all_accounts())


def qinput(spark: SparkSession, d: str) -> DataFrame:
    return clean.quality_input(raw(spark, d))


def scan_tickets(spark: SparkSession, d: str) -> DataFrame:
    """The raw tickets written as a multi-line CSV by Spark, read back. Such files
    cannot be split in any case, so they are compressed: texts that many tickets share cost little."""
    path = scratch_path(spark, "tickets-csv")
    src = raw(spark, d)
    src.write.option("header", True).option("escape", '"').option("compression", "gzip").csv(path)
    return tickets.read_tickets(spark, path, "csv")


def export_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Filtered tickets written as month-partitioned Parquet, read back."""
    path = scratch_path(spark, "export")
    sinks.write_table(filtered(spark, d), path)
    return spark.read.parquet(path)


def export_zone_dropped(spark: SparkSession, d: str) -> DataFrame:
    """Tickets whose created time has a zone, exported and read back: wall time."""
    path = scratch_path(spark, "export-zone")
    t = cleaned(spark, d).select("id", "case_number", F.col("created_at").cast("timestamp").alias("created_at"))
    sinks.write_table(t, path, partition_by=())
    return spark.read.parquet(path)


def result_csv(spark: SparkSession, d: str) -> DataFrame:
    """A small result table written as one CSV file, read back."""
    path = scratch_path(spark, "result-csv")
    sinks.write_result_csv(metrics.priority_distribution(filtered(spark, d)), path)
    return spark.read.option("header", True).schema("priority string, ticket_count long, share double").csv(path)


def dq_date_rejects(spark: SparkSession, d: str) -> DataFrame:
    """D9-D17 input: values that were no date, counted by the scan that writes the
    issues' candidates."""
    rejects = Observation("date-rejects")
    issues.candidates(clean.quality_input(raw(spark, d), rejects=rejects))
    return clean.date_rejects(spark, rejects)


# tables of the report sets in long form: key columns and value of each
REPORT_KEYS = {
    "top_accounts": (("account_name",), "ticket_count"), "monthly_volume": (("month", "account_name"), "ticket_count"),
    "monthly_csat": (("month", "account_name"), "avg_csat"), "priority_distribution": (("priority",), "ticket_count"),
    "escalation_by_priority": (("priority",), "escalation_rate"), "resolution_summary": (("priority",), "median_days"),
    "first_response_summary": (("priority",), "median_hours"), "area_distribution": (("product_area",), "ticket_count"),
    "rca_distribution": (("rca",), "ticket_count"), "rca_by_priority_top5": (("priority", "rca"), "ticket_count"),
    "words_subject": (("word",), "word_count"),
}
QUALITY_KEYS = {
    "dq_totals": ((), "unique_data_quality_issues"), "dq_by_pod": (("pod_name",), "issue_count"), "dq_by_area": (("product_area",), "issue_count"),
    "dq_monthly": (("month",), "issue_count"), "dq_terms": (("term",), "term_count"),
}
FIELD_KEYS = {
    "case_variations": (("value_lower", "variation"), None), "value_counts": (("value",), "value_count"),
    "similar_values": (("value", "similar_value"), "ratio"),
}


def long_form(tables: dict[str, DataFrame], keys: dict) -> DataFrame:
    """(table_name, key, value) rows of several result tables."""
    out = None
    for name, (cols, value) in keys.items():
        v = F.round(F.col(value).cast("double"), 6) if value else F.lit(1.0)
        rows = tables[name].select(F.lit(name).alias("table_name"), F.concat_ws("|", *cols).alias("key"), v.alias("value"))
        out = rows if out is None else out.unionByName(rows)
    return out


def _cols(df: DataFrame, *cols: str) -> DataFrame:
    return df.select(*cols)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    # sources and sinks
    "scan_tickets": scan_tickets,
    "peek": lambda s, d: r6(tickets.peek(cleaned(s, d), 5)),
    "filtered_tickets": lambda s, d: r6(filtered(s, d)),
    "export_roundtrip": lambda s, d: r6(export_roundtrip(s, d)),
    "export_zone_dropped": export_zone_dropped,
    "result_csv": lambda s, d: r6(result_csv(s, d)),
    "report_set": lambda s, d: long_form(report.report_tables(filtered(s, d)), REPORT_KEYS),
    "quality_report_set": lambda s, d: long_form(report.quality_report_tables(qinput(s, d)), QUALITY_KEYS),
    "field_consistency": lambda s, d: long_form(similar.field_consistency(qinput(s, d), "product_feature"), FIELD_KEYS),
    # cleaning
    "clean_group_alias": lambda s, d: _cols(tickets.apply_group_alias(
        raw(s, d).withColumn("group_alias", F.concat(F.lit("GRP-"), F.col("case_number"))), "group_alias"),
        "id", "case_number", "group_id"),
    "clean_strings": lambda s, d: _cols(clean.label_strings(raw(s, d)), "id", "case_number", *K.LABELLED_COLUMNS),
    "drop_merged": lambda s, d: _cols(clean.drop_merged(raw(s, d)), "id", "case_number", "status"),
    "drop_accounts": lambda s, d: _cols(clean.drop_accounts(clean.label_strings(raw(s, d)), INTERNAL_ACCOUNTS),
                                        "id", "case_number", "account_name"),
    "drop_owners": lambda s, d: _cols(clean.drop_owners(clean.label_strings(raw(s, d))),
                                      "id", "case_number", "case_owner"),
    "parse_created": lambda s, d: _cols(clean.parse_dates(raw(s, d)).filter(F.col("created_at").isNotNull()),
                                        "id", "case_number", "created_at"),
    "parse_closed": lambda s, d: _cols(clean.parse_dates(raw(s, d)), "id", "case_number", "closed_at"),
    "parse_first_response": lambda s, d: _cols(clean.parse_dates(raw(s, d)), "id", "case_number", "first_response_at"),
    "clean_csat": lambda s, d: r6(_cols(clean.clean_numbers(raw(s, d)), "id", "case_number", "csat")),
    "clean_age_days": lambda s, d: r6(_cols(clean.clean_numbers(raw(s, d)), "id", "case_number", "age_days")),
    "clean_escalated": lambda s, d: _cols(clean.clean_numbers(raw(s, d)), "id", "case_number", "is_escalated"),
    "clean_priority": lambda s, d: _cols(clean.clean_priority(clean.label_strings(raw(s, d))),
                                        "id", "case_number", "priority"),
    "priority_rank": lambda s, d: cleaned(s, d).select("priority", "priority_rank").distinct(),
    "account_label": lambda s, d: cleaned(s, d).select(
        "account_name", clean.X.account_label("account_name").alias("account_label")).distinct(),
    "cleaning_funnel": lambda s, d: clean.cleaning_funnel(raw(s, d), CFG),
    "clean_tickets": lambda s, d: r6(cleaned(s, d)),
    # filters
    "top_accounts_default": lambda s, d: filters.top_accounts(cleaned(s, d)),
    "account_options": lambda s, d: filters.account_options(cleaned(s, d)),
    "owner_groups": lambda s, d: filters.owner_groups(cleaned(s, d)),
    "priority_options": lambda s, d: filters.priority_options(cleaned(s, d)),
    "area_options": lambda s, d: filters.area_options(cleaned(s, d)),
    "rca_options": lambda s, d: filters.rca_options(cleaned(s, d)),
    "filter_tickets": lambda s, d: r6(filters.filter_tickets(cleaned(s, d))),
    "date_bounds": lambda s, d: filters.date_bounds(cleaned(s, d)),
    "filter_by_owner_group": lambda s, d: r6(filters.filter_by_owner_group(
        filtered(s, d), cleaned(s, d), [K.OWNER_GROUP_SUPPORT])),
    # aggregates
    "overview_kpis": lambda s, d: r6(metrics.overview_kpis(filtered(s, d))),
    "distinct_by_month": lambda s, d: metrics.distinct_by_month(filtered(s, d)).select(
        "month", "n_tickets", "account_name", "product_area", "account_name_within", "product_area_within"),
    "active_accounts": lambda s, d: metrics.active_accounts(filtered(s, d)),
    "top_accounts": lambda s, d: metrics.top_accounts_labeled(filtered(s, d)),
    "monthly_csat_labeled": lambda s, d: r6(trends.monthly_csat_labeled(filtered(s, d))),
    "csat_vs_overall": lambda s, d: r6(trends.csat_vs_overall(filtered(s, d))),
    "monthly_volume": lambda s, d: trends.monthly_volume(filtered(s, d)),
    "monthly_csat": lambda s, d: r6(trends.monthly_csat(filtered(s, d))),
    "ticket_cube": lambda s, d: r6(metrics.ticket_cube(filtered(s, d))),
    "priority_distribution": lambda s, d: r6(metrics.priority_distribution(filtered(s, d))),
    "escalation_by_priority": lambda s, d: r6(metrics.escalation_by_priority(filtered(s, d))),
    "resolution_by_priority": lambda s, d: r6(durations.resolution_by_priority(filtered(s, d))),
    "resolution_summary": lambda s, d: durations.resolution_summary(filtered(s, d)),
    "first_response_by_priority": lambda s, d: r6(durations.first_response_by_priority(filtered(s, d))),
    "first_response_summary": lambda s, d: durations.first_response_summary(filtered(s, d)),
    "area_distribution": lambda s, d: r6(metrics.area_distribution(filtered(s, d))),
    "area_feature_rollup": lambda s, d: metrics.area_feature_rollup(filtered(s, d)),
    "rca_distribution": lambda s, d: metrics.rca_distribution(filtered(s, d)),
    "rca_by_priority_top5": lambda s, d: metrics.rca_by_priority_top(filtered(s, d)),
    "words_subject": lambda s, d: r6(words.word_frequencies(filtered(s, d), "subject")),
    "words_description": lambda s, d: r6(words.word_frequencies(filtered(s, d), "description")),
    "words_pod": lambda s, d: r6(words.word_frequencies(filtered(s, d), "pod_name")),
    "words_area": lambda s, d: r6(words.word_frequencies(filtered(s, d), "product_area")),
    "words_feature": lambda s, d: r6(words.word_frequencies(filtered(s, d), "product_feature")),
    # data quality
    "field_completeness": lambda s, d: r6(profile.field_completeness(qinput(s, d))),
    "subject_lengths": lambda s, d: r6(profile.subject_lengths(qinput(s, d))),
    "subject_starts": lambda s, d: profile.subject_starts(qinput(s, d)),
    "generic_subjects": lambda s, d: r6(profile.generic_subjects(qinput(s, d))),
    "case_variations": lambda s, d: profile.case_variations(qinput(s, d), "product_feature"),
    "value_counts": lambda s, d: profile.value_counts(qinput(s, d), "product_feature"),
    "similar_values": lambda s, d: r6(similar.similar_values(qinput(s, d), "rca")),
    "similar_features": lambda s, d: r6(similar.similar_values(qinput(s, d), "product_feature")),
    "dq_date_rejects": dq_date_rejects,
    "dp_tickets": lambda s, d: issues.dp_tickets(qinput(s, d)),
    "dq_issues": lambda s, d: issues.dq_issues(qinput(s, d)),
    "dq_totals": lambda s, d: issues.dq_totals(qinput(s, d)),
    "dq_by_pod": lambda s, d: issues.dq_by_pod(issues.dq_issues(qinput(s, d), columns=issues.COLUMNS_FOR["dq_by_pod"])),
    "dq_by_area": lambda s, d: issues.dq_by_area(issues.dq_issues(qinput(s, d), columns=issues.COLUMNS_FOR["dq_by_area"])),
    "dq_monthly": lambda s, d: issues.dq_monthly(issues.dq_issues(qinput(s, d), columns=issues.COLUMNS_FOR["dq_monthly"])),
    "dq_sample": lambda s, d: issues.dq_sample(issues.dq_issues(qinput(s, d), columns=issues.COLUMNS_FOR["dq_sample"])),
    "dq_terms": lambda s, d: issues.dq_terms(issues.dq_issues(qinput(s, d), columns=issues.COLUMNS_FOR["dq_terms"])),
}
