"""Count-based result tables (A1-A6, A11, A12, A17-A20, A22) and the base cube.

Every operator here accepts either cleaned tickets or the cube built by
:func:`ticket_cube`: both expose the same measures (:func:`measures`), so a
report can build the cube once and roll every table up from it. Means are
always sum / count, never a mean of means.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.columns import account_label, safe_rate
from ..session import materialize

CUBE_KEYS = ("month", "account_name", "priority", "priority_rank", "product_area",
             "product_feature", "rca")
MEASURES = ("n_tickets", "csat_sum", "csat_n", "escalated_n")
# Distinct sketches: 2 ** SKETCH_LG_K registers, so a standard error of
# 1.04 / sqrt(2 ** SKETCH_LG_K) = 1.6 % whatever the number of distinct values.
SKETCH_LG_K = 12
SKETCH_ERROR = 1.04 / 2 ** (SKETCH_LG_K / 2)


def measures(df: DataFrame) -> DataFrame:
    """Per-row measures of tickets; a cube already has them."""
    if "n_tickets" in df.columns:
        return df
    responded = F.col("csat") != 0
    return df.withColumns({
        "n_tickets": F.lit(1).cast("long"),
        "csat_sum": F.when(responded, F.col("csat")).otherwise(F.lit(0.0)),
        "csat_n": responded.cast("long"),
        "escalated_n": F.col("is_escalated").cast("long"),
    })


def ticket_cube(t: DataFrame, keys=CUBE_KEYS, distinct=()) -> DataFrame:
    """The base cube: measures summed by every key the count tables use.

    One scan and one shuffle (with map-side partial aggregation). Its size is
    the number of distinct key combinations, not the number of tickets.

    ``distinct`` columns are kept as mergeable sketches (``<column>_sketch``), so a
    cube need not be keyed by them to roll distinct counts up
    (:func:`distinct_rollup`): by month it has one row a month however many
    accounts there are. ``t`` may be such a cube of finer keys: sketches are merged.
    """
    m = measures(t)
    keys = [k for k in keys if k in m.columns]
    sketches = [F.hll_union_agg(f"{c}_sketch") if f"{c}_sketch" in m.columns else F.hll_sketch_agg(c, SKETCH_LG_K) for c in distinct]
    return m.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in MEASURES],
                                *[s.alias(f"{c}_sketch") for s, c in zip(sketches, distinct)])


def distinct_rollup(cube: DataFrame, by=()) -> DataFrame:
    """Tickets and estimated distinct counts (``<column>_estimate``) of a cube with
    sketches, by any of its keys (none: one row for all)."""
    columns = [c.removesuffix("_sketch") for c in cube.columns if c.endswith("_sketch")]
    rolled = ticket_cube(cube, by, columns)
    return rolled.select(*by, "n_tickets", *[F.hll_sketch_estimate(f"{c}_sketch").alias(f"{c}_estimate") for c in columns])


def distinct_by_month(t: DataFrame, columns=("account_name", "product_area"), sigmas: float = 3.0) -> DataFrame:
    """Exact distinct counts by month and over all months (``month`` = ``all``) beside
    the estimates that a by-month sketch cube rolls up to, and whether each
    estimate lies within ``sigmas`` standard errors."""
    exact = (t.groupingSets([["month"], []], "month")
             .agg(*[F.count_distinct(c).alias(c) for c in columns], F.grouping_id().alias("_g"))
             .withColumn("month", F.when(F.col("_g") == 1, F.lit("all")).otherwise(F.col("month"))).drop("_g"))
    # one row a month, written: both roll-ups read it
    cube = materialize(ticket_cube(t, ("month",), columns), "month-sketches")
    every = distinct_rollup(cube).select(F.lit("all").alias("month"), "*")
    estimate = distinct_rollup(cube, ("month",)).unionByName(every)
    out = exact.join(estimate, "month")
    for c in columns:
        off = F.abs(F.col(f"{c}_estimate") - F.col(c))
        out = out.withColumn(f"{c}_within", off <= F.ceil(F.col(c) * (sigmas * SKETCH_ERROR)))
    return out.orderBy("month")


def _sum_n() -> F.Column:
    return F.sum("n_tickets").cast("long").alias("ticket_count")


def overview_kpis(t: DataFrame, min_tickets: int = K.ACTIVE_ACCOUNT_MIN_TICKETS, approx: bool = False) -> DataFrame:
    """A22 (A1, A2, A3, A4, A5) as one row.

    One grouping-sets aggregation gives per-account and per-area rows in a
    single scan and shuffle; a second, tiny aggregation folds them. With
    ``approx`` the number of product areas is estimated from sketches that each
    account's row carries, so rows are not doubled for a second grouping.
    """
    m = measures(t)
    if approx:
        g = (ticket_cube(m, ("account_name",), ("product_area",))
             .withColumns({"gid": F.lit(1), "product_area": F.lit(None).cast("string")}))
        areas = F.coalesce(F.hll_sketch_estimate(F.hll_union_agg("product_area_sketch")), F.lit(0).cast("long"))
    else:
        m = m.select("account_name", "product_area", *MEASURES)
        g = (m.groupingSets([["account_name"], ["product_area"]], "account_name", "product_area")
             .agg(*[F.sum(c).alias(c) for c in MEASURES], F.grouping_id().alias("gid")))
        areas = F.count_if((F.col("gid") == 2) & F.col("product_area").isNotNull())
    per_account = F.col("gid") == 1  # product_area aggregated away
    return g.agg(
        F.coalesce(F.sum(F.when(per_account, F.col("n_tickets"))), F.lit(0)).cast("long").alias("total_tickets"),
        F.count_if(per_account & (F.col("n_tickets") >= min_tickets)
                   & F.coalesce(F.col("account_name") != K.UNSPECIFIED, F.lit(False))).alias("active_accounts"),
        areas.alias("product_areas"),
        safe_rate(F.sum(F.when(per_account, F.col("csat_sum"))),
                  F.sum(F.when(per_account, F.col("csat_n")))).alias("avg_csat"),
        (safe_rate(F.sum(F.when(per_account, F.col("escalated_n"))),
                   F.sum(F.when(per_account, F.col("n_tickets")))) * 100).alias("escalation_rate"),
    )


def account_volume(t: DataFrame) -> DataFrame:
    return measures(t).groupBy("account_name").agg(_sum_n())


def active_accounts(t: DataFrame, min_tickets: int = K.ACTIVE_ACCOUNT_MIN_TICKETS) -> DataFrame:
    """A2: accounts with at least ``min_tickets`` tickets, ``Unspecified`` excluded."""
    return (account_volume(t)
            .filter((F.col("ticket_count") >= min_tickets) & (F.col("account_name") != K.UNSPECIFIED))
            .agg(F.count(F.lit(1)).alias("active_accounts")))


def top_accounts_labeled(t: DataFrame, n: int = K.TOP_ACCOUNTS,
                         label_length: int = K.ACCOUNT_LABEL_LENGTH) -> DataFrame:
    """Top ``n`` accounts by volume with their display label (ties: name)."""
    return (account_volume(t).orderBy(F.desc("ticket_count"), F.asc("account_name")).limit(n)
            .withColumn("account_label", account_label("account_name", label_length)))


def _with_share(df: DataFrame) -> DataFrame:
    return df.withColumn("share", F.col("ticket_count") / df.agg(F.sum("ticket_count")).scalar())


def priority_distribution(t: DataFrame) -> DataFrame:
    """Tickets per priority (no ``Unspecified``) and pie share, rank order."""
    g = (measures(t).filter(F.col("priority") != K.UNSPECIFIED)
         .groupBy("priority").agg(_sum_n(), F.min("priority_rank").alias("priority_rank")))
    return _with_share(g).orderBy("priority_rank", "priority").drop("priority_rank")


def escalation_by_priority(t: DataFrame) -> DataFrame:
    """Escalation % per priority."""
    return (measures(t).filter(F.col("priority") != K.UNSPECIFIED)
            .groupBy("priority")
            .agg((safe_rate(F.sum("escalated_n"), F.sum("n_tickets")) * 100).alias("escalation_rate"),
                 F.min("priority_rank").alias("priority_rank"))
            .orderBy("priority_rank", "priority").drop("priority_rank"))


def area_distribution(t: DataFrame) -> DataFrame:
    """Tickets per product area and pie share."""
    g = measures(t).groupBy("product_area").agg(_sum_n())
    return _with_share(g).orderBy(F.desc("ticket_count"), "product_area")


def area_feature_rollup(t: DataFrame) -> DataFrame:
    """Tickets per (area, feature) and per area (treemap levels).

    ``is_area_total`` marks the area rows (feature null there).
    """
    m = measures(t)
    g = (m.groupingSets([["product_area", "product_feature"], ["product_area"]],
                        "product_area", "product_feature")
         .agg(_sum_n(), F.grouping("product_feature").alias("gf")))
    return g.select("product_area", "product_feature", "ticket_count",
                    (F.col("gf") == 1).alias("is_area_total"))


def rca_distribution(t: DataFrame) -> DataFrame:
    """Tickets per root cause (no ``Unspecified``), count order."""
    return (measures(t).filter(F.col("rca") != K.UNSPECIFIED)
            .groupBy("rca").agg(_sum_n()).orderBy("ticket_count", "rca"))


def top_causes(t: DataFrame, n: int = K.TOP_CAUSES) -> DataFrame:
    return (rca_distribution(t).orderBy(F.desc("ticket_count"), F.asc("rca")).limit(n)
            .select("rca"))


def rca_by_priority_top(t: DataFrame, n: int = K.TOP_CAUSES) -> DataFrame:
    """Tickets per (priority, cause) for the top ``n`` causes. The top
    causes are taken before the priority condition, as in the original."""
    top = top_causes(t, n)
    m = measures(t)
    g = (m.filter((F.col("rca") != K.UNSPECIFIED) & (F.col("priority") != K.UNSPECIFIED))
         .groupBy("priority", "rca").agg(_sum_n(), F.min("priority_rank").alias("priority_rank")))
    return (g.join(top, "rca", "left_semi")
            .orderBy("priority_rank", "priority", "rca").drop("priority_rank")
            .select("priority", "rca", "ticket_count"))
