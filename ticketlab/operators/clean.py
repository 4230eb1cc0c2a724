"""Cleaning (C1-C17): one lazy projection/filter plan over raw tickets."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from .. import constants as K
from ..functions import columns as X


@dataclass(frozen=True)
class CleanConfig:
    missing_label: str = K.MISSING_LABEL
    # Internal account(s) to leave out; the caller names them.
    excluded_accounts: tuple[str, ...] = ()
    excluded_owners: tuple[str, ...] = K.EXCLUDED_OWNERS
    date_formats: tuple[str, ...] = K.DATE_FORMATS
    labelled_columns: tuple[str, ...] = field(default=K.LABELLED_COLUMNS)


def label_strings(raw: DataFrame, cfg: CleanConfig = CleanConfig()) -> DataFrame:
    """Labelled text columns become strings with missing -> label."""
    cols = {c: X.labelled(c, cfg.missing_label) for c in cfg.labelled_columns if c in raw.columns}
    return raw.withColumns(cols)


def drop_merged(df: DataFrame) -> DataFrame:
    """Drop merged tickets; a missing status is kept."""
    if "status" not in df.columns:
        return df
    return df.filter(~F.col("status").eqNullSafe(K.MERGED_STATUS))


def drop_accounts(df: DataFrame, accounts=()) -> DataFrame:
    """C4: drop the named (internal) accounts."""
    if not accounts or "account_name" not in df.columns:
        return df
    return df.filter(~F.coalesce(F.col("account_name").isin(list(accounts)), F.lit(False)))


def drop_owners(df: DataFrame, owners=K.EXCLUDED_OWNERS) -> DataFrame:
    """Drop queue owners, compared case-insensitively."""
    if not owners or "case_owner" not in df.columns:
        return df
    lowered = sorted({o.lower() for o in owners})
    return df.filter(~F.coalesce(F.lower("case_owner").isin(lowered), F.lit(False)))


DATE_COLUMNS = ("created_at", "closed_at", "first_response_at")


def parse_dates(df: DataFrame, formats=K.DATE_FORMATS, strict: bool = False,
                rejects: Observation | None = None) -> DataFrame:
    """Created / closed / first-response text -> ``timestamp_ntz``.

    A value that is no date becomes null. ``rejects`` counts those by column
    while the rows pass (read them with :func:`date_rejects` after the first
    action, no scan of their own); ``strict`` ends the job at the first one.
    """
    columns = [c for c in DATE_COLUMNS if c in df.columns]
    if rejects is not None and columns:
        df = df.observe(rejects, *[F.count_if(X.rejected_timestamp(c, formats)).alias(c) for c in columns])
    parse = X.strict_timestamp if strict else X.parse_timestamp
    return df.withColumns({c: parse(c, formats) for c in columns})


def date_rejects(spark: SparkSession, rejects: Observation) -> DataFrame:
    """(``field``, ``rejected``): how many values of each date column were no date,
    as counted by the first action over the observed frame. Make that action
    a plain write (no shuffle in its stage): then a task that is run again
    after a lost executor is counted once."""
    counts = rejects.get
    return spark.createDataFrame([(c, int(counts[c])) for c in DATE_COLUMNS if c in counts], "field string, rejected long")


def clean_numbers(df: DataFrame) -> DataFrame:
    """CSAT and age to numbers (by the column's type), escalated to boolean."""
    cols = {}
    for c in ("csat", "age_days"):
        if c in df.columns:
            numeric = isinstance(df.schema[c].dataType, NumericType)
            cols[c] = X.clean_numeric(c) if numeric else X.clean_number(c)
    if "is_escalated" in df.columns:
        cols["is_escalated"] = X.is_true_text("is_escalated")
    return df.withColumns(cols)


def clean_priority(df: DataFrame) -> DataFrame:
    """Invalid priority -> Unspecified; add ``priority_rank``."""
    df = df.withColumn("priority", X.clean_priority("priority"))
    return df.withColumn("priority_rank", X.priority_rank("priority"))


def with_month(df: DataFrame) -> DataFrame:
    """``yyyy-MM`` month of the created time."""
    return df.withColumn("month", X.month_of("created_at"))


def clean_tickets(raw: DataFrame, cfg: CleanConfig = CleanConfig()) -> DataFrame:
    """C17: the whole cleaning as one lazy plan (a single scan, no shuffle).

    Order follows the original: labels first (so a missing account or owner
    is a label, not a null, when the row filters run), then row filters, then
    parsing. Rows with an unparseable created date are dropped.
    """
    df = label_strings(raw, cfg)
    df = drop_merged(df)
    df = drop_accounts(df, cfg.excluded_accounts)
    df = drop_owners(df, cfg.excluded_owners)
    df = parse_dates(df, cfg.date_formats)
    df = df.filter(F.col("created_at").isNotNull())
    df = clean_numbers(df)
    df = clean_priority(df)
    return with_month(df)


def cleaning_funnel(raw: DataFrame, cfg: CleanConfig = CleanConfig()) -> DataFrame:
    """Rows left after each cleaning step, in one pass.

    One row per step: ``step_no``, ``step``, ``rows_left``, ``rows_removed``.
    """
    labelled = label_strings(raw, cfg)
    keep_status = (~F.col("status").eqNullSafe(K.MERGED_STATUS)) if "status" in raw.columns else F.lit(True)
    keep_account = (~F.coalesce(F.col("account_name").isin(list(cfg.excluded_accounts)), F.lit(False))
                    if cfg.excluded_accounts else F.lit(True))
    lowered = sorted({o.lower() for o in cfg.excluded_owners})
    keep_owner = (~F.coalesce(F.lower("case_owner").isin(lowered), F.lit(False))
                  if lowered and "case_owner" in raw.columns else F.lit(True))
    keep_date = X.parse_timestamp("created_at", cfg.date_formats).isNotNull()
    s1 = keep_status
    s2 = s1 & keep_account
    s3 = s2 & keep_owner
    s4 = s3 & keep_date
    agg = labelled.agg(
        F.count(F.lit(1)).alias("s0"),
        F.count_if(s1).alias("s1"),
        F.count_if(s2).alias("s2"),
        F.count_if(s3).alias("s3"),
        F.count_if(s4).alias("s4"),
    )
    steps = [("input", "s0"), ("drop_merged", "s1"), ("drop_accounts", "s2"),
             ("drop_owners", "s3"), ("drop_bad_created_date", "s4")]
    stack = ", ".join(f"{i}, '{name}', {c}" for i, (name, c) in enumerate(steps))
    out = agg.selectExpr(f"stack({len(steps)}, {stack}) as (step_no, step, rows_left)",
                         "s0", "s1", "s2", "s3")
    prev = (F.when(F.col("step_no") == 0, F.col("rows_left"))
            .when(F.col("step_no") == 1, F.col("s0")).when(F.col("step_no") == 2, F.col("s1"))
            .when(F.col("step_no") == 3, F.col("s2")).otherwise(F.col("s3")))
    return out.select(F.col("step_no").cast("int").alias("step_no"), "step",
                      F.col("rows_left").cast("long").alias("rows_left"),
                      (prev - F.col("rows_left")).cast("long").alias("rows_removed"))


def quality_input(raw: DataFrame, formats=K.DATE_FORMATS, strict: bool = False,
                  rejects: Observation | None = None) -> DataFrame:
    """Input of the data-quality report: raw tickets with parsed dates and a
    month; no other cleaning (missing values stay null). ``strict`` and
    ``rejects`` as in :func:`parse_dates`."""
    return with_month(parse_dates(raw, formats, strict, rejects))
