"""Filter options and the compound ticket filter."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..session import materialize


def top_accounts(t: DataFrame, n: int = K.TOP_ACCOUNTS) -> DataFrame:
    """the ``n`` accounts with most tickets (ties: smaller name first)."""
    return (t.groupBy("account_name").agg(F.count(F.lit(1)).alias("ticket_count"))
            .orderBy(F.desc("ticket_count"), F.asc("account_name")).limit(n))


def _options(t: DataFrame, column: str) -> DataFrame:
    return (t.select(column).filter(F.col(column).isNotNull() & (F.col(column) != K.UNSPECIFIED))
            .distinct().orderBy(column))


def account_options(t: DataFrame) -> DataFrame:
    """distinct accounts, sorted, without ``Unspecified``."""
    return _options(t, "account_name")


def area_options(t: DataFrame) -> DataFrame:
    """F5."""
    return _options(t, "product_area")


def rca_options(t: DataFrame) -> DataFrame:
    """F6."""
    return _options(t, "rca")


def priority_options(t: DataFrame) -> DataFrame:
    """distinct priorities without ``Unspecified``, in rank order."""
    return (t.filter(F.col("priority") != K.UNSPECIFIED)
            .groupBy("priority").agg(F.min("priority_rank").alias("priority_rank"))
            .orderBy("priority_rank", "priority"))


def owner_groups(t: DataFrame, excluded_owners=K.EXCLUDED_OWNERS) -> DataFrame:
    """owner -> group. Owners with any support/service request are one
    group; all other owners, less ``Unspecified`` and the excluded names
    (compared case-sensitively here), are the other. One aggregation."""
    support = F.lower(F.col("case_type")).isin(list(K.SUPPORT_CASE_TYPES))
    g = t.groupBy("case_owner").agg(F.bool_or(F.coalesce(support, F.lit(False))).alias("has_support"))
    not_excluded = ~F.col("case_owner").isin([K.UNSPECIFIED, *excluded_owners])
    return (g.filter(F.col("has_support") | not_excluded)
            .select(F.when(F.col("has_support"), F.lit(K.OWNER_GROUP_SUPPORT))
                    .otherwise(F.lit(K.OWNER_GROUP_OTHER)).alias("owner_group"),
                    "case_owner"))


def date_bounds(t: DataFrame) -> DataFrame:
    """F8: first and last created day."""
    d = F.to_date("created_at")
    return t.agg(F.min(d).alias("min_date"), F.max(d).alias("max_date"))


@dataclass(frozen=True)
class TicketFilter:
    """User choices. ``None`` = the default choice; an empty list follows the
    original per field: "all but ``Unspecified``" for accounts, "all" for owners,
    owner groups and causes, "none" for priorities and areas. Owner groups
    that hold no owner do not filter either.

    Default accounts are the top 10 by volume; default priorities and areas
    are all values except ``Unspecified``; default range is all dates.
    """
    accounts: tuple[str, ...] | None = None
    priorities: tuple[str, ...] | None = None
    areas: tuple[str, ...] | None = None
    start: dt.date | None = None
    end: dt.date | None = None
    owners: tuple[str, ...] = ()
    owner_groups: tuple[str, ...] = ()
    rcas: tuple[str, ...] = ()
    top_n: int = K.TOP_ACCOUNTS

    @staticmethod
    def all_accounts(**kw) -> "TicketFilter":
        return TicketFilter(accounts=(), **kw)


def _member(df: DataFrame, column: str, values) -> DataFrame:
    """Rows whose value is in the caller's list: a semi join with a local table,
    whose size the optimizer knows."""
    keys = df.sparkSession.createDataFrame([(v,) for v in values], f"`{column}` string")
    return df.join(keys, column, "left_semi")


def _ntz(ts: dt.datetime):
    """A wall-time literal: from ISO text, so no time zone is involved (a
    Python datetime literal would be read in the driver's local zone)."""
    return F.lit(ts.isoformat(sep=" ")).cast("timestamp_ntz")


def filter_tickets(t: DataFrame, f: TicketFilter = TicketFilter()) -> DataFrame:
    """the compound filter as one predicate and semi joins. Owner groups run a
    job while the plan is built (:func:`filter_by_owner_group`)."""
    out = t
    if f.areas is None:
        out = out.filter(F.col("product_area") != K.UNSPECIFIED)
    else:
        out = _member(out, "product_area", f.areas)
    if f.priorities is None:
        out = out.filter(F.col("priority") != K.UNSPECIFIED)
    else:
        out = _member(out, "priority", f.priorities)
    if f.start is not None:
        out = out.filter(F.col("created_at") >= _ntz(dt.datetime.combine(f.start, dt.time())))
        if "month" in t.columns:  # lets a month-partitioned table prune files
            out = out.filter(F.col("month") >= F.lit(f.start.strftime("%Y-%m")))
    if f.end is not None:
        end = dt.datetime.combine(f.end, dt.time(23, 59, 59))
        out = out.filter(F.col("created_at") <= _ntz(end))
        if "month" in t.columns:
            out = out.filter(F.col("month") <= F.lit(f.end.strftime("%Y-%m")))
    if f.accounts is None:
        # default: top-N accounts of the unfiltered tickets; at most N rows
        top = top_accounts(t, f.top_n).select("account_name")
        out = out.join(top, "account_name", "left_semi")
    elif len(f.accounts) > 0:
        out = _member(out, "account_name", f.accounts)
    else:
        out = out.filter(F.col("account_name") != K.UNSPECIFIED)
    if f.owners:
        out = _member(out, "case_owner", f.owners)
    if f.owner_groups:
        out = filter_by_owner_group(out, t, f.owner_groups)
    if f.rcas:
        out = _member(out, "rca", f.rcas)
    return out


def filter_by_owner_group(df: DataFrame, t: DataFrame, groups) -> DataFrame:
    """keep tickets whose owner is in the chosen groups (derived from ``t``);
    all tickets if the groups hold no owner.

    Runs a job while the plan is built: the owner list is written first, so the planner knows its size: below the
    broadcast threshold no ticket is shuffled by owner.
    """
    owners = owner_groups(t).filter(F.col("owner_group").isin(list(groups))).select("case_owner").distinct()
    owners = materialize(owners, "chosen-owners")
    return df if owners.isEmpty() else df.join(owners, "case_owner", "left_semi")
