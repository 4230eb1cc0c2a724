"""Data-quality tickets (D9-D17). Input: raw tickets with parsed dates
(:func:`ticketlab.operators.clean.quality_input`)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.columns import contains_ci, quoted
from ..session import materialize

# Sorts after every real time: a missing created date must not come "first".
FAR_FUTURE = "9999-12-31 23:59:59"


@dataclass(frozen=True)
class IssueConfig:
    dp_pattern: str = K.DP_ANALYTICS_PATTERN
    dp_pod_name: str = K.DP_POD_NAME
    dp_pod_prefix: str = K.DP_POD_PREFIX
    terms: tuple[str, ...] = K.DATA_QUALITY_TERMS
    fields: tuple[str, ...] = K.ISSUE_FIELDS
    sample_size: int = K.SAMPLE_ISSUES


def terms_regex(terms=K.DATA_QUALITY_TERMS) -> str:
    return "(?iu)" + "|".join(K.portable_regex(t) for t in terms)


def search_regex(terms=K.DATA_QUALITY_TERMS) -> str:
    """One pattern that finds any term, with the terms grouped by their first
    word (``data\\s*(?:quality|governance|...)``). It matches exactly where the
    plain alternation matches, but the engine tries ~10 branches per
    character instead of ~47."""
    ws = r"\s*"
    groups: dict[str, list[str]] = {}
    for t in terms:
        head, sep, rest = t.partition(ws)
        groups.setdefault(head, []).append(rest if sep else "")
    parts = []
    for head, rests in groups.items():
        rests = list(dict.fromkeys(rests))
        if "" in rests:  # the first word alone is a term: it covers the rest
            parts.append(head)
        elif len(rests) == 1:
            parts.append(head + ws + rests[0])
        else:
            parts.append(head + ws + "(?:" + "|".join(rests) + ")")
    return "(?iu)" + K.portable_regex("|".join(parts))


def anchor_words(cfg: IssueConfig) -> tuple[str, ...]:
    """Words of which every term contains one; known for the built-in terms only."""
    return K.DATA_QUALITY_ANCHORS if set(cfg.terms) <= set(K.DATA_QUALITY_TERMS) else ()


def _issue_fields(df: DataFrame, cfg: IssueConfig) -> list[str]:
    return [f for f in cfg.fields if f in df.columns]


def dp_mask(df: DataFrame, cfg: IssueConfig = IssueConfig()) -> Column:
    """D9 predicate: DP/analytics in area, feature, subject, description or
    cause (case-insensitive substring), or the POD is the analytics POD or
    starts with ``DP`` (case-sensitive).

    Spark evaluates OR left to right and stops at the first true term, so the
    cheap POD comparisons and the short fields come first and the long
    description last."""
    pod = F.col("pod_name")
    m = F.coalesce(pod == cfg.dp_pod_name, F.lit(False)) | F.coalesce(pod.startswith(cfg.dp_pod_prefix), F.lit(False))
    for f in ("product_area", "product_feature", "rca", "subject", "description"):
        if f in df.columns:
            m = m | contains_ci(f, cfg.dp_pattern)
    return m


def has_term(df: DataFrame, cfg: IssueConfig = IssueConfig()) -> Column:
    """A data-quality term in any issue field. Every built-in term contains an
    anchor word, so the short anchor pattern runs first and the long one only on
    fields that pass it (same matches, less regex work); a caller's own terms
    are searched as they are. Short fields are
    tried before the description (OR stops at the first true term)."""
    full = search_regex(cfg.terms)
    anchors = anchor_words(cfg)
    anchor = "(?iu)" + "|".join(anchors)
    fields = sorted(_issue_fields(df, cfg), key=lambda f: f == "description")
    m = F.lit(False)
    for f in fields:
        c = F.col(f)
        m = m | F.coalesce(c.rlike(anchor) & c.rlike(full) if anchors else c.rlike(full), F.lit(False))
    return m


def dp_tickets(df: DataFrame, cfg: IssueConfig = IssueConfig()) -> DataFrame:
    """The data-platform / analytics tickets."""
    return df.filter(dp_mask(df, cfg))


def candidates(df: DataFrame, cfg: IssueConfig = IssueConfig(), columns=None) -> tuple[DataFrame, int]:
    """The DP tickets with a data-quality term, and the number of all DP tickets.

    Runs one job: one scan that writes the candidates (``columns``, by default
    all, and a row number ``_row``) and counts the DP tickets as they pass. It
    has no shuffle, so a task run again after a lost executor counts once.
    """
    wanted = df.columns if columns is None else list(dict.fromkeys([*columns, "id", "created_at", "case_number"]))
    seen = Observation("dp-tickets")
    rows = dp_tickets(df, cfg).observe(seen, F.count(F.lit(1)).alias("n")).filter(has_term(df, cfg))
    rows = materialize(rows.select(*map(quoted, wanted), F.monotonically_increasing_id().alias("_row")), "dq-candidates")
    return rows, int(seen.get.get("n", 0))


def first_of_id(rows: DataFrame) -> DataFrame:
    """Of :func:`candidates`, the first row of each id in (created, case
    number) order. Missing ids form one group.

    The winner is found on narrow columns by a partial aggregate, so duplicates
    collapse on the map side and a hot id never lands in one task whole; the
    winners' row numbers then pick the whole rows (texts are not aggregated).
    """
    order = F.struct(F.coalesce(F.col("created_at"), F.lit(FAR_FUTURE).cast("timestamp_ntz")).alias("t"),
                     F.col("case_number"), F.col("_row"))
    first = rows.groupBy("id").agg(F.min(order).alias("_first")).select(F.col("_first._row").alias("_row"))
    return rows.join(first, "_row", "left_semi").drop("_row")


def dq_issues(df: DataFrame, cfg: IssueConfig = IssueConfig(), columns=None) -> DataFrame:
    """DP tickets with a data-quality term, one row per id: the first
    matching row in (created, case number) order. Missing ids form one group.

    ``columns`` limits what each issue row carries (default: every column); the
    scan then reads only those. With the description among them a job is run
    here: candidates are written once and picked by row number
    (:func:`first_of_id`). A few short columns go through a lazy ``min_by``,
    which also collapses duplicates on the map side.
    """
    wanted = df.columns if columns is None else list(dict.fromkeys([*columns, "created_at", "case_number"]))
    if "description" in wanted:
        return first_of_id(candidates(df, cfg, wanted)[0]).select("id", *[quoted(c) for c in wanted if c != "id"])
    keep = [quoted(c) for c in wanted if c != "id"]
    order = F.struct(F.coalesce(F.col("created_at"), F.lit(FAR_FUTURE).cast("timestamp_ntz")),
                     F.col("case_number"))
    cand = dp_tickets(df, cfg).filter(has_term(df, cfg))
    return (cand.groupBy("id").agg(F.min_by(F.struct(*keep), order).alias("_r"))
            .select("id", "_r.*"))


def dq_totals(df: DataFrame, cfg: IssueConfig = IssueConfig(), issues: DataFrame | None = None,
              total: int | None = None) -> DataFrame:
    """Number of DP tickets and of unique issues, in one aggregation
    per id followed by a tiny global one. Pass ``issues`` already materialised
    to count those instead of searching the texts again, and the ``total`` that
    :func:`candidates` counted to read no ticket at all."""
    if issues is not None:
        found = issues.agg(F.count(F.lit(1)).alias("unique_data_quality_issues"))
        if total is not None:
            return found.select(F.lit(total).cast("long").alias("total_dp_analytics_tickets"), "unique_data_quality_issues")
        count = dp_tickets(df, cfg).agg(F.count(F.lit(1)).alias("total_dp_analytics_tickets"))
        return count.withColumn("unique_data_quality_issues", found.scalar())
    per_id = (dp_tickets(df, cfg).groupBy("id")
              .agg(F.count(F.lit(1)).alias("_rows"), F.bool_or(has_term(df, cfg)).alias("_hit")))
    return per_id.agg(F.coalesce(F.sum("_rows"), F.lit(0)).cast("long").alias("total_dp_analytics_tickets"),
                      F.count_if("_hit").alias("unique_data_quality_issues"))


def _count_by(issues: DataFrame, key: str, name: str) -> DataFrame:
    return (issues.filter(F.col(key).isNotNull()).groupBy(key)
            .agg(F.count(F.lit(1)).alias("issue_count"))
            .orderBy(F.desc("issue_count"), F.asc(key)).withColumnRenamed(key, name))


def dq_by_pod(issues: DataFrame) -> DataFrame:
    """Issues per POD, descending."""
    return _count_by(issues, "pod_name", "pod_name")


def dq_by_area(issues: DataFrame) -> DataFrame:
    """Issues per product area, descending."""
    return _count_by(issues, "product_area", "product_area")


def dq_monthly(issues: DataFrame) -> DataFrame:
    """Issues per month (observed months only)."""
    return (issues.filter(F.col("created_at").isNotNull())
            .groupBy(F.date_format("created_at", "yyyy-MM").alias("month"))
            .agg(F.count(F.lit(1)).alias("issue_count")).orderBy("month"))


def dq_sample(issues: DataFrame, n: int = K.SAMPLE_ISSUES) -> DataFrame:
    """``n`` issues (earliest first), six columns."""
    return (issues.orderBy(F.col("created_at").asc_nulls_last(), F.col("case_number"))
            .limit(n).select(*K.SAMPLE_COLUMNS))


# what each result table needs from an issue row
COLUMNS_FOR = {
    "dq_by_pod": ("pod_name",),
    "dq_by_area": ("product_area",),
    "dq_monthly": ("created_at",),
    "dq_sample": K.SAMPLE_COLUMNS,
    "dq_terms": K.ISSUE_FIELDS,
}


def _symbols(pattern: str) -> list[str] | None:
    """A term as letters and digits, one by one, and optional white space between
    words; None for a pattern that is more than that."""
    words = pattern.split(r"\s*")
    if not all(w.isascii() and w.isalnum() for w in words):
        return None
    out: list[str] = []
    for i, w in enumerate(words):
        out += ([r"\s*"] if i else []) + list(w.lower())
    return out


def trie_pattern(terms=K.DATA_QUALITY_TERMS) -> str | None:
    """One pattern that finds, at each place where a term starts, the longest of
    the terms that do, looking ahead so that no hit hides another one.

    The terms are the paths of a trie: a node tries its branches before it
    ends. The longest hit starts with every other term that matches there, and
    a term's hits never overlap each other, so counting hits by what they start
    with equals counting each term by itself. None where that is not certain: a
    term of more than words with optional space between, two terms that only differ
    in where that space may be, or one whose end is its own beginning.
    """
    paths = [_symbols(t) for t in terms]
    if not paths or any(p is None for p in paths):
        return None
    letters = ["".join(c for c in p if c != r"\s*") for p in paths]
    for a, word in zip(paths, letters):
        if any(word.startswith(word[i:]) for i in range(1, len(word))):
            return None
        for b, other in zip(paths, letters):
            if other.startswith(word) and b[: len(a)] != a:
                return None
    root: dict = {}
    for p in paths:
        node = root
        for c in p:
            node = node.setdefault(c, {})
        node[""] = {}

    def written(node: dict) -> str:
        branches = [c + written(child) for c, child in node.items() if c]
        if not branches:
            return ""
        ends = "" in node
        if len(branches) == 1 and not ends:
            return branches[0]
        return "(?:" + "|".join(branches) + ")" + ("?" if ends else "")
    return "(?iu)(?=(" + K.portable_regex(written(root)) + "))"


def _distinct_terms(cfg: IssueConfig) -> list[tuple[str, str]]:
    """(name, pattern) of each term, by name, the first pattern of a name."""
    seen: dict[str, str] = {}
    for p in cfg.terms:
        seen.setdefault(K.term_name(p), p)
    return list(seen.items())


def _issue_text(issues: DataFrame, cfg: IssueConfig) -> Column:
    return F.concat_ws(" ", *[F.coalesce(F.col(f).cast("string"), F.lit("")) for f in _issue_fields(issues, cfg)])


def term_counts_by_pattern(issues: DataFrame, cfg: IssueConfig = IssueConfig()) -> DataFrame:
    """D16 for any patterns: one aggregation with one regex count per term, then an unpivot."""
    terms = _distinct_terms(cfg)
    t = issues.select(_issue_text(issues, cfg).alias("_text"))
    a = t.agg(*[F.sum(F.regexp_count(F.col("_text"), F.lit("(?iu)" + K.portable_regex(p)))).alias(f"_t{i}")
                for i, (_, p) in enumerate(terms)])
    rows = F.array(*[F.struct(F.lit(name).alias("term"), F.col(f"_t{i}").cast("long").alias("term_count")) for i, (name, _) in enumerate(terms)])
    return a.select(F.inline(rows))


def term_counts(issues: DataFrame, pattern: str, cfg: IssueConfig = IssueConfig()) -> DataFrame:
    """D16 by :func:`trie_pattern`: the text is searched once, equal hits are added up
    where they are found, and each of the few distinct hits is then told which
    terms it starts with."""
    space = K.portable_regex(r"\s") + "+"
    hits = (issues.select(F.explode(F.regexp_extract_all(_issue_text(issues, cfg), F.lit(pattern), F.lit(1))).alias("hit"))
            .groupBy(F.regexp_replace("hit", space, " ").alias("hit")).agg(F.count(F.lit(1)).alias("n")))
    implied = [F.when(F.col("hit").rlike("(?iu)^(?:" + K.portable_regex(p) + ")"), F.lit(name)) for name, p in _distinct_terms(cfg)]
    return (hits.select(F.explode(F.array_compact(F.array(*implied))).alias("term"), "n")
            .groupBy("term").agg(F.sum("n").alias("term_count")))


def dq_terms(issues: DataFrame, cfg: IssueConfig = IssueConfig()) -> DataFrame:
    """Occurrences of each term in the issue texts (terms may overlap);
    zero counts left out. One search of the text for all terms where their form
    allows it (the built-in ones do), else one count per term."""
    pattern = trie_pattern(cfg.terms)
    counts = term_counts_by_pattern(issues, cfg) if pattern is None else term_counts(issues, pattern, cfg)
    return counts.filter(F.col("term_count") > 0).orderBy(F.desc("term_count"), F.asc("term"))


def data_quality_issues(df: DataFrame, cfg: IssueConfig = IssueConfig(),
                        issues: DataFrame | None = None, total: int | None = None) -> dict[str, DataFrame]:
    """Every data-quality table. Pass ``issues`` already materialised
    (see :func:`ticketlab.session.materialize`), with the ``total`` of DP tickets if
    known; otherwise one scan is run here that writes and counts both."""
    if issues is None:
        rows, total = candidates(df, cfg)
        issues = materialize(first_of_id(rows).select(*map(quoted, df.columns)), "dq-issues")
    return {
        "dq_totals": dq_totals(df, cfg, issues, total),
        "dq_issues": issues,
        "dq_by_pod": dq_by_pod(issues),
        "dq_by_area": dq_by_area(issues),
        "dq_monthly": dq_monthly(issues),
        "dq_sample": dq_sample(issues, cfg.sample_size),
        "dq_terms": dq_terms(issues, cfg),
    }
