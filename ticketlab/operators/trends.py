"""Monthly account trends (A7-A10). Accept tickets or the base cube."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.columns import account_label, safe_rate
from .metrics import measures


def monthly_volume(t: DataFrame) -> DataFrame:
    """Tickets per (month, account)."""
    return (measures(t).groupBy("month", "account_name")
            .agg(F.sum("n_tickets").cast("long").alias("ticket_count")))


def monthly_csat(t: DataFrame) -> DataFrame:
    """A10: mean CSAT and number of responses (CSAT != 0) per (month, account).
    Only months with a response appear."""
    g = (measures(t).groupBy("month", "account_name")
         .agg(F.sum("csat_sum").alias("s"), F.sum("csat_n").cast("long").alias("csat_count")))
    return (g.filter(F.col("csat_count") > 0)
            .select("month", "account_name",
                    (F.col("s") / F.col("csat_count")).alias("avg_csat"), "csat_count"))


def monthly_csat_labeled(t: DataFrame, label_length: int = K.ACCOUNT_LABEL_LENGTH) -> DataFrame:
    """A10 plus the display label. Grouped on the full name, labelled after,
    so two accounts with the same label stay apart."""
    return monthly_csat(t).withColumn("account_label", account_label("account_name", label_length))


def overall_csat(t: DataFrame) -> DataFrame:
    """One row: mean CSAT over all responses."""
    m = measures(t)
    return m.agg(safe_rate(F.sum("csat_sum"), F.sum("csat_n")).alias("overall_avg_csat"))


def csat_vs_overall(t: DataFrame, label_length: int = K.ACCOUNT_LABEL_LENGTH) -> DataFrame:
    """A7 rows with the overall mean as a reference line.

    The overall mean is a scalar subquery: Spark runs it once and inlines the
    value, so there is no join and no single-partition window.
    """
    return monthly_csat_labeled(t, label_length).withColumn(
        "overall_avg_csat", overall_csat(t).scalar())
