"""Time to resolve and to first response per priority.

The median is exact. Spark's ``median`` keeps every value of a group in one
task, and here the groups are priorities: a handful of groups, one of which
may hold a third of all tickets. :func:`exact_selection` instead brackets the
median with a mergeable quantile sketch, and then, in one more scan, counts
the rows below the bracket and the distinct values inside it. Both durations
go through the same two scans, as two rows of each ticket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..session import materialize
from ..functions.columns import days_between, hours_between, round_half_even

# Size of the sketch and its rank error: with k = 8192 a quantile's rank is off by
# less than 0.05 % of the rows (99 % of the time). A bracket three times as
# wide on either side holds the median; that it does is checked, not assumed.
SKETCH_K = 8192
BRACKET_HALF_WIDTH = 0.0015


def exact_selection(df: DataFrame, keys: list[str], value: str, extra_aggs: list | None = None) -> DataFrame:
    """Exact interpolated median of ``value`` per ``keys`` without holding a
    group in one task. Returns ``keys``, ``median`` and ``extra_aggs``.

    Scan 1: count, optional aggregates and a sketch per group -> bracket
    [lo, hi], one written row a group. Scan 2: distinct values inside the bracket
    with their counts, and one more entry for all rows below it; a running sum
    over a group's entries gives their ranks. A group whose median ranks lie
    outside its entries (its bracket missed) is done again from all its
    distinct values; the scan for that is run only if there is such a group.
    Runs jobs while the plan is built.
    """
    x = F.col(value)
    base = df.filter(x.isNotNull()).select(*keys, value)
    stats = df.filter(x.isNotNull()).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), F.kll_sketch_agg_double(x, F.lit(SKETCH_K)).alias("_q"), *(extra_aggs or []))
    extra = [c for c in stats.columns if c not in (*keys, "_n", "_q")]
    stats = stats.select(
        *keys, *extra,
        F.kll_sketch_get_quantile_double("_q", F.lit(max(0.0, 0.5 - BRACKET_HALF_WIDTH))).alias("_lo"),
        F.kll_sketch_get_quantile_double("_q", F.lit(min(1.0, 0.5 + BRACKET_HALF_WIDTH))).alias("_hi"),
        F.floor((F.col("_n") - 1) / 2).alias("_k1"), F.ceil((F.col("_n") - 1) / 2).alias("_k2"))
    # one row per group, written: the planner knows it is small, so the scans
    # below read the rows where they are and never shuffle them by group
    stats = materialize(stats, "median-stats")
    ranks = stats.select(*keys, "_k1", "_k2")

    def selected(entries: DataFrame) -> DataFrame:
        """Medians of the groups whose ranks are among the entries' (keys, value, _c);
        a null value stands for the rows below all others."""
        w = Window.partitionBy(*keys).orderBy(x.asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
        placed = entries.withColumn("_end", F.sum("_c").over(w)).join(ranks, keys)
        hit = lambda k: (F.col("_end") - F.col("_c") <= F.col(k)) & (F.col(k) < F.col("_end")) & x.isNotNull()
        first, second = hit("_k1"), hit("_k2")
        return (placed.filter(first | second).groupBy(*keys)
                .agg(F.max(F.when(first, x)).alias("_v1"), F.max(F.when(second, x)).alias("_v2"))
                .select(*keys, (F.col("_v1") + (F.col("_v2") - F.col("_v1")) * F.lit(0.5)).alias("median"))
                .filter(F.col("median").isNotNull()))

    inside = (base.join(stats.select(*keys, "_lo", "_hi"), keys).filter(x <= F.col("_hi"))
              .select(*keys, F.when(x >= F.col("_lo"), x).alias(value))
              .groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c")))
    medians = materialize(selected(inside), "median-selected")   # one row a group
    missed = stats.join(medians, keys, "left_anti").select(*keys)
    if not missed.isEmpty():
        every = base.join(materialize(missed, "median-missed"), keys).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c"))
        medians = medians.unionByName(selected(every))
    return stats.select(*keys, *extra).join(medians, keys)


def exact_median(df: DataFrame, keys: list[str], value: str,
                 extra_aggs: list | None = None) -> DataFrame:
    """As :func:`exact_selection`, its name in earlier releases."""
    return exact_selection(df, keys, value, extra_aggs)


def _measures() -> dict[str, tuple[str, str, Column]]:
    """End column, unit and value of each measure."""
    return {"resolution": ("closed_at", "days", days_between("created_at", "closed_at")),
            "first_response": ("first_response_at", "hours", hours_between("created_at", "first_response_at"))}


def duration_rows(t: DataFrame, measures) -> DataFrame:
    """(``measure``, ``priority``, ``priority_rank``, ``_v``): one row for each duration that a
    ticket with a priority has."""
    known = _measures()
    each = F.array(*[F.struct(F.lit(m).alias("measure"), known[m][2].alias("_v")) for m in measures])
    return (t.filter(F.col("priority") != K.UNSPECIFIED)
            .select("priority", "priority_rank", F.inline(each)).filter(F.col("_v").isNotNull()))


def duration_medians(t: DataFrame, measures=("resolution", "first_response")) -> DataFrame:
    """Both durations at once: ``measure``, ``priority``, ``priority_rank``, ``avg``, ``median``,
    ``ticket_count``, one row a measure and priority, from two scans of the
    tickets. Runs jobs while the plan is built."""
    extra = [F.avg("_v").alias("avg"), F.count(F.lit(1)).alias("ticket_count"), F.min("priority_rank").alias("priority_rank")]
    return exact_selection(duration_rows(t, measures), ["measure", "priority"], "_v", extra)


def of_measure(medians: DataFrame, measure: str) -> DataFrame:
    """The table of one measure (A13 or A15) from :func:`duration_medians`."""
    unit = _measures()[measure][1]
    return (medians.filter(F.col("measure") == measure).orderBy("priority_rank", "priority")
            .select("priority", F.col("avg").alias(f"avg_{unit}"), F.col("median").alias(f"median_{unit}"), "ticket_count"))


def _per_priority(t: DataFrame, measure: str, method: str) -> DataFrame:
    if method == "bracket":
        return of_measure(duration_medians(t, (measure,)), measure)
    median = {"builtin": F.median("_v"), "approx": F.percentile_approx("_v", 0.5).cast("double")}.get(method)
    if median is None:
        raise ValueError(f"unknown median method {method!r}")
    return of_measure(duration_rows(t, (measure,)).groupBy("measure", "priority").agg(
        F.avg("_v").alias("avg"), median.alias("median"), F.count(F.lit(1)).alias("ticket_count"),
        F.min("priority_rank").alias("priority_rank")), measure)


def resolution_by_priority(t: DataFrame, method: str = "bracket") -> DataFrame:
    """Days from created to closed per priority, closed tickets with a
    priority only: mean, exact median, count. ``method``: ``bracket``
    (exact, scales with hot groups; runs jobs while the plan is built),
    ``builtin`` (Spark's exact median) or ``approx``."""
    return _per_priority(t, "resolution", method)


def first_response_by_priority(t: DataFrame, method: str = "bracket") -> DataFrame:
    """Hours from created to first response per priority; ``method`` as in A13."""
    return _per_priority(t, "first_response", method)


def summarize(df: DataFrame) -> DataFrame:
    """A14/A16 from an A13/A15 result: means and medians rounded half to even."""
    prefix = "days" if "avg_days" in df.columns else "hours"
    return _summary(df, prefix)


def _summary(df: DataFrame, prefix: str) -> DataFrame:
    return df.select("priority",
                     round_half_even(f"avg_{prefix}", 1).alias(f"avg_{prefix}"),
                     round_half_even(f"median_{prefix}", 1).alias(f"median_{prefix}"),
                     "ticket_count")


def resolution_summary(t: DataFrame, method: str = "bracket") -> DataFrame:
    """A13 rounded to one decimal, half to even."""
    return _summary(resolution_by_priority(t, method), "days")


def first_response_summary(t: DataFrame, method: str = "bracket") -> DataFrame:
    """A15 rounded to one decimal, half to even."""
    return _summary(first_response_by_priority(t, method), "hours")
