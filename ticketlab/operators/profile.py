"""Column-quality profile (D1-D6). Input: raw tickets with parsed dates
(:func:`ticketlab.operators.clean.quality_input`); missing values are null."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.columns import safe_rate


def field_completeness(df: DataFrame, fields=K.PROFILE_FIELDS,
                       empty_tokens=K.EMPTY_TOKENS) -> DataFrame:
    """Per field total, filled, missing, empty and completion rate (%).

    One aggregation over all fields (a single scan), then unpivoted to one
    row per field.
    """
    fields = [f for f in fields if f in df.columns]
    aggs = [F.count(F.lit(1)).alias("_total")]
    for i, f in enumerate(fields):
        c = F.col(f)
        aggs.append(F.count_if(c.isNull()).alias(f"_m{i}"))
        aggs.append(F.count_if(F.coalesce(c.cast("string").isin(list(empty_tokens)), F.lit(False))).alias(f"_e{i}"))
    a = df.agg(*aggs)
    stack = ", ".join(f"'{f}', _m{i}, _e{i}" for i, f in enumerate(fields))
    rows = a.selectExpr("_total", f"stack({len(fields)}, {stack}) as (field, missing, empty)")
    filled = F.col("_total") - F.col("missing") - F.col("empty")
    return rows.select(
        "field", F.col("_total").cast("long").alias("total"), filled.cast("long").alias("filled"),
        F.col("missing").cast("long").alias("missing"), F.col("empty").cast("long").alias("empty"),
        (safe_rate(filled, F.col("_total")) * 100).alias("completion_rate"))


def subject_lengths(df: DataFrame, column: str = "subject") -> DataFrame:
    """Mean / min / max length (characters) of non-missing subjects."""
    n = F.length(F.col(column))
    return df.filter(F.col(column).isNotNull()).agg(
        F.avg(n).alias("avg_length"), F.min(n).cast("long").alias("min_length"),
        F.max(n).cast("long").alias("max_length"))


def subject_starts(df: DataFrame, column: str = "subject", width: int = K.SUBJECT_START_LENGTH,
                   n: int = K.TOP_SUBJECT_STARTS) -> DataFrame:
    """D3: the ``n`` commonest ``width``-character beginnings (ties: text)."""
    return (df.filter(F.col(column).isNotNull())
            .groupBy(F.substring(F.col(column), 1, width).alias("subject_start"))
            .agg(F.count(F.lit(1)).alias("subject_count"))
            .orderBy(F.desc("subject_count"), F.asc("subject_start")).limit(n))


def generic_pattern(patterns=K.GENERIC_SUBJECT_PATTERNS) -> str:
    return "|".join(K.portable_regex(p) for p in patterns)


def generic_subjects(df: DataFrame, column: str = "subject",
                     patterns=K.GENERIC_SUBJECT_PATTERNS) -> DataFrame:
    """Number and % of subjects that start generically (lower-cased)."""
    s = F.col(column)
    hit = F.lower(s).rlike(generic_pattern(patterns))
    return df.filter(s.isNotNull()).agg(
        F.count_if(hit).alias("generic_count"),
        (safe_rate(F.count_if(hit), F.count(F.lit(1))) * 100).alias("generic_percentage"))


def case_variations(df: DataFrame, field: str) -> DataFrame:
    """Spellings of a value that differ only in letter case.

    Rows (``value_lower``, ``variation``) for every lower-cased value with more
    than one spelling. Counts per lower-cased value, then a semi join back:
    no group is collected into a list.
    """
    vals = df.select(F.col(field).cast("string").alias("variation")).filter(F.col("variation").isNotNull()).distinct()
    vals = vals.withColumn("value_lower", F.lower("variation"))
    multi = (vals.groupBy("value_lower").agg(F.count(F.lit(1)).alias("_k"))
             .filter(F.col("_k") > 1).select("value_lower"))
    return vals.join(multi, "value_lower", "left_semi").select("value_lower", "variation")


def value_counts(df: DataFrame, field: str) -> DataFrame:
    """Frequency of each value, descending (ties: value)."""
    return (df.filter(F.col(field).isNotNull())
            .groupBy(F.col(field).cast("string").alias("value"))
            .agg(F.count(F.lit(1)).alias("value_count"))
            .orderBy(F.desc("value_count"), F.asc("value")))
