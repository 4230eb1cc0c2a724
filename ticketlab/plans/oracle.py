"""DuckDB twins of the registered queries (the independent check).

Each twin is plain SQL over the driver's test tables, written from the same
fixed values (patterns, word lists) as the Spark operators, but evaluated by
a different engine. Doubles are rounded to 6 places on both sides, as the
two engines sum in different orders.
"""

from __future__ import annotations

from .. import constants as K
from ..sources.tickets import raw_tickets_sql_for

INTERNAL_ACCOUNTS = ("Acme",)


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_list(values) -> str:
    return "(" + ", ".join(q(v) for v in values) + ")"


def duck_regex(pattern: str) -> str:
    return K.portable_regex(pattern)


def parse_ts(c: str) -> str:
    return (f"coalesce(try_cast({c} AS TIMESTAMP), try_strptime({c}, '%Y-%m-%d %H:%M:%S'), "
            f"try_strptime({c}, '%Y-%m-%d'), try_strptime({c}, '%m/%d/%Y %H:%M:%S'), "
            f"try_strptime({c}, '%m/%d/%Y'))")


def clean_num(c: str) -> str:
    return f"coalesce(try_cast(regexp_replace({c}, '[^0-9.]', '0', 'g') AS DOUBLE), 0.0)"


def r6(expr: str) -> str:
    return f"round({expr}, 6)"


LABELS = ", ".join(f"coalesce({c}, {q(K.MISSING_LABEL)}) AS {c}" for c in K.LABELLED_COLUMNS)
OWNERS_LOWER = sql_list(sorted({o.lower() for o in K.EXCLUDED_OWNERS}))

# raw -> lab (labels) -> kept (row filters) -> parsed -> t (clean) -> f (default filter, all accounts)
BASE = f"""
raw AS MATERIALIZED ({raw_tickets_sql_for()}),
lab AS (SELECT * REPLACE ({LABELS}) FROM raw),
kept AS (
  SELECT * FROM lab
  WHERE status IS DISTINCT FROM {q(K.MERGED_STATUS)}
    AND account_name NOT IN {sql_list(INTERNAL_ACCOUNTS)}
    AND lower(case_owner) NOT IN {OWNERS_LOWER}
),
parsed AS (
  SELECT * REPLACE ({parse_ts('created_at')} AS created_at, {parse_ts('closed_at')} AS closed_at,
                    {parse_ts('first_response_at')} AS first_response_at)
  FROM kept
),
t2 AS (
  SELECT * REPLACE (
    {clean_num('csat')} AS csat,
    {clean_num('age_days')} AS age_days,
    coalesce(lower(is_escalated) = 'true', false) AS is_escalated,
    CASE WHEN coalesce(regexp_matches(priority, '{K.PRIORITY_PATTERN}'), false) THEN priority
         ELSE {q(K.UNSPECIFIED)} END AS priority)
  FROM parsed WHERE created_at IS NOT NULL
),
t AS (
  SELECT *,
    coalesce(CASE WHEN starts_with(priority, 'P') THEN try_cast(substring(priority, 2) AS DECIMAL(38,0)) END,
             CAST({K.PRIORITY_RANK_DEFAULT} AS DECIMAL(38,0))) AS priority_rank,
    strftime(created_at, '%Y-%m') AS month
  FROM t2
),
f AS (SELECT * FROM t WHERE product_area <> {q(K.UNSPECIFIED)} AND priority <> {q(K.UNSPECIFIED)}
      AND account_name <> {q(K.UNSPECIFIED)}),
qi AS (
  SELECT * REPLACE ({parse_ts('created_at')} AS created_at, {parse_ts('closed_at')} AS closed_at,
                    {parse_ts('first_response_at')} AS first_response_at),
    strftime({parse_ts('created_at')}, '%Y-%m') AS month
  FROM raw
)"""


def w(body: str) -> str:
    return f"WITH {BASE}\n{body}"


# ---------------------------------------------------------------------------
# pieces reused by several twins
# ---------------------------------------------------------------------------
def _dp_mask() -> str:
    parts = [f"coalesce(regexp_matches({c}, {q(K.DP_ANALYTICS_PATTERN)}, 'i'), false)"
             for c in ("product_area", "product_feature", "subject", "description", "rca")]
    parts.append(f"coalesce(pod_name = {q(K.DP_POD_NAME)}, false)")
    parts.append(f"coalesce(starts_with(pod_name, {q(K.DP_POD_PREFIX)}), false)")
    return " OR ".join(parts)


def _has_term() -> str:
    pat = "|".join(duck_regex(p) for p in K.DATA_QUALITY_TERMS)
    return " OR ".join(f"coalesce(regexp_matches({c}, {q(pat)}, 'i'), false)" for c in K.ISSUE_FIELDS)


ISSUES = f"""issues AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY id ORDER BY
      coalesce(created_at, TIMESTAMP '9999-12-31 23:59:59'), case_number) AS rn
    FROM qi WHERE ({_dp_mask()}) AND ({_has_term()})
  ) WHERE rn = 1
)"""


def wi(body: str) -> str:
    return f"WITH {BASE},\n{ISSUES}\n{body}"


def _words(col: str, n: int = K.TOP_WORDS) -> str:
    stop = sql_list(K.all_stop_words())
    return w(f"""
, words AS (
  SELECT unnest(regexp_extract_all(lower({col}), {q(K.WORD_PATTERN)})) AS word FROM f
), top AS (
  SELECT word, count(*) AS word_count FROM words WHERE word NOT IN {stop}
  GROUP BY word ORDER BY word_count DESC, word ASC LIMIT {n}
)
SELECT word, word_count, {r6('word_count / max(word_count) OVER ()')} AS weight FROM top""")


# result tables in long form: key columns and value of each
REPORT_KEYS = {
    "top_accounts": ("account_name", "ticket_count"), "monthly_volume": ("month || '|' || account_name", "ticket_count"),
    "monthly_csat": ("month || '|' || account_name", "avg_csat"), "priority_distribution": ("priority", "ticket_count"),
    "escalation_by_priority": ("priority", "escalation_rate"), "resolution_summary": ("priority", "median_days"),
    "first_response_summary": ("priority", "median_hours"), "area_distribution": ("product_area", "ticket_count"),
    "rca_distribution": ("rca", "ticket_count"), "rca_by_priority_top5": ("priority || '|' || rca", "ticket_count"),
    "words_subject": ("word", "word_count"),
}
QUALITY_KEYS = {
    "dq_totals": ("''", "unique_data_quality_issues"), "dq_by_pod": ("pod_name", "issue_count"), "dq_by_area": ("product_area", "issue_count"),
    "dq_monthly": ("month", "issue_count"), "dq_terms": ("term", "term_count"),
}


def _long_form(sql: dict[str, str], keys: dict) -> str:
    return " UNION ALL ".join(
        f"SELECT '{name}' AS table_name, {key} AS key, round(CAST({value} AS DOUBLE), 6) AS value FROM ({sql[name]})"
        for name, (key, value) in keys.items())


def _durations(end_col: str, unit: float, prefix: str, rounded: bool) -> str:
    v = f"date_diff('microsecond', created_at, {end_col}) / {unit}"
    body = f"""
SELECT priority, avg({v}) AS a, quantile_cont({v}, 0.5) AS m, count(*) AS ticket_count
FROM f WHERE {end_col} IS NOT NULL AND priority <> {q(K.UNSPECIFIED)} GROUP BY priority"""
    if rounded:
        return w(f"SELECT priority, round_even(a * 10, 0) / 10 AS avg_{prefix}, "
                 f"round_even(m * 10, 0) / 10 AS median_{prefix}, ticket_count FROM ({body})")
    return w(f"SELECT priority, {r6('a')} AS avg_{prefix}, {r6('m')} AS median_{prefix}, ticket_count FROM ({body})")


def _label(c: str) -> str:
    n = K.ACCOUNT_LABEL_LENGTH
    return f"CASE WHEN length({c}) > {n} THEN substring({c}, 1, {n}) || '...' ELSE {c} END"


def _terms() -> str:
    seen: dict[str, str] = {}
    for p in K.DATA_QUALITY_TERMS:
        seen.setdefault(K.term_name(p), p)
    txt = "concat_ws(' ', " + ", ".join(f"coalesce({c}, '')" for c in K.ISSUE_FIELDS) + ")"
    sel = "\n  UNION ALL ".join(
        f"SELECT {q(name)} AS term, CAST(sum(len(regexp_extract_all(txt, {q(duck_regex(p))}, 0, 'i'))) AS BIGINT) AS term_count FROM texts"
        for name, p in seen.items())
    return wi(f", texts AS (SELECT {txt} AS txt FROM issues)\n"
              f"SELECT term, term_count FROM (\n  {sel}\n) WHERE term_count > 0")


def _completeness() -> str:
    empty = sql_list(K.EMPTY_TOKENS)
    parts = []
    for fld in K.PROFILE_FIELDS:
        parts.append(
            f"SELECT {q(fld)} AS field, count(*) AS total, count_if({fld} IS NULL) AS missing, "
            f"count_if(coalesce({fld} IN {empty}, false)) AS empty FROM qi")
    u = "\n  UNION ALL ".join(parts)
    return w(f"""
SELECT field, total, total - missing - empty AS filled, missing, empty,
  {r6('(total - missing - empty) * 100.0 / total')} AS completion_rate
FROM (
  {u}
)""")


def _generic() -> str:
    pat = "|".join(duck_regex(p) for p in K.GENERIC_SUBJECT_PATTERNS)
    return w(f"""
SELECT count_if(regexp_matches(lower(subject), {q(pat)})) AS generic_count,
  {r6(f"count_if(regexp_matches(lower(subject), {q(pat)})) * 100.0 / count(*)")} AS generic_percentage
FROM qi WHERE subject IS NOT NULL""")


def _similar(column: str) -> str:
    """Pairs of spellings by the matching-block ratio, as a recursion over segments: the
    longest common part of a segment pair (the earliest in the first text, then in the
    second) counts, and what lies before and after it in both is matched on.
    The original's ratio ignores very frequent characters from 200 characters on; the
    values here are shorter. Only pairs that lengths and common characters allow are taken up."""
    return w(f"""
, v AS (SELECT DISTINCT {column} AS v, lower({column}) AS s FROM qi WHERE {column} IS NOT NULL),
s AS (SELECT s, len(s) AS n, list_sort(string_split(s, '')) AS cs FROM (SELECT DISTINCT s FROM v)),
ch AS (SELECT s, n, c, count(*) AS k FROM (SELECT s, n, unnest(cs) AS c FROM s) GROUP BY ALL),
near AS (
  SELECT a.s AS x, b.s AS y, a.n + b.n AS t FROM ch a JOIN ch b ON a.c = b.c AND a.s < b.s AND 5 * least(a.n, b.n) > 2 * (a.n + b.n)
  GROUP BY a.s, b.s, a.n, b.n HAVING 5 * sum(least(a.k, b.k)) > 2 * (a.n + b.n)
),
seg(x, y, t, a, b, m) AS (
  SELECT x, y, t, x, y, 0::BIGINT FROM near
  UNION ALL
  SELECT x, y, t, CASE WHEN side THEN substr(a, 1, -best.i - 1) ELSE substr(a, best.k - best.i) END,
    CASE WHEN side THEN substr(b, 1, best.j - 1) ELSE substr(b, best.j + best.k) END, CASE WHEN side THEN best.k ELSE 0 END
  FROM (
    SELECT *, list_max(list_filter(flatten(list_transform(range(1, len(a) + 1), lambda i: list_transform(range(1, len(a) - i + 2),
      lambda k: {{'k': k, 'i': -i, 'j': instr(b, substr(a, i, k))}}))), lambda z: z.j > 0)) AS best
    FROM seg WHERE a <> '' AND b <> ''
  ), (VALUES (true), (false)) sides(side)
  WHERE best IS NOT NULL
),
ratios AS (SELECT x, y, 2.0::DOUBLE * sum(m) / t AS ratio FROM seg GROUP BY x, y, t)
SELECT least(p.v, r.v) AS value, greatest(p.v, r.v) AS similar_value, {r6('ratio')} AS ratio
FROM ratios JOIN v p ON p.s = x JOIN v r ON r.s = y WHERE ratio > {K.SIMILARITY_THRESHOLD} AND ratio < 1""").replace("WITH ", "WITH RECURSIVE ", 1)


RAW_COLS = ("id", "case_number", "account_name", "group_id", "subject", "description", "product_area",
            "product_feature", "pod_name", "created_at", "closed_at", "first_response_at", "case_type",
            "case_owner", "age_days", "is_escalated", "csat", "priority", "status", "rca")


def _scan() -> str:
    cols = ", ".join(f"CASE WHEN {c} IN {sql_list(K.NA_TOKENS)} THEN NULL ELSE {c} END AS {c}" for c in RAW_COLS)
    return w(f"SELECT {cols} FROM raw")


def oracle_sql() -> dict[str, str]:
    u = q(K.UNSPECIFIED)
    top10 = f"SELECT account_name FROM t GROUP BY account_name ORDER BY count(*) DESC, account_name LIMIT {K.TOP_ACCOUNTS}"
    owner_groups = f"""
SELECT CASE WHEN has_support THEN {q(K.OWNER_GROUP_SUPPORT)} ELSE {q(K.OWNER_GROUP_OTHER)} END AS owner_group, case_owner
FROM (SELECT case_owner, bool_or(coalesce(lower(case_type) IN {sql_list(K.SUPPORT_CASE_TYPES)}, false)) AS has_support
      FROM t GROUP BY case_owner)
WHERE has_support OR case_owner NOT IN {sql_list((K.UNSPECIFIED, *K.EXCLUDED_OWNERS))}"""
    csat_rows = f"""
SELECT month, account_name, {r6('avg(csat)')} AS avg_csat, count(*) AS csat_count
FROM f WHERE csat <> 0 GROUP BY month, account_name"""
    top5 = f"SELECT rca FROM f WHERE rca <> {u} GROUP BY rca ORDER BY count(*) DESC, rca LIMIT {K.TOP_CAUSES}"
    sql = {
        # sources and sinks
        "scan_tickets": _scan(),
        "peek": w("SELECT * FROM t ORDER BY created_at, case_number LIMIT 5"),
        "filtered_tickets": w("SELECT * FROM f"),
        "export_roundtrip": w("SELECT * FROM f"),
        # cleaning
        "clean_group_alias": w("SELECT id, case_number, 'GRP-' || case_number AS group_id FROM raw"),
        "clean_strings": w("SELECT id, case_number, " + ", ".join(K.LABELLED_COLUMNS) + " FROM lab"),
        "drop_merged": w(f"SELECT id, case_number, status FROM raw WHERE status IS DISTINCT FROM {q(K.MERGED_STATUS)}"),
        "drop_accounts": w(f"SELECT id, case_number, account_name FROM lab WHERE account_name NOT IN {sql_list(INTERNAL_ACCOUNTS)}"),
        "drop_owners": w(f"SELECT id, case_number, case_owner FROM lab WHERE lower(case_owner) NOT IN {OWNERS_LOWER}"),
        "parse_created": w(f"SELECT id, case_number, {parse_ts('created_at')} AS created_at FROM raw "
                           f"WHERE {parse_ts('created_at')} IS NOT NULL"),
        "parse_closed": w(f"SELECT id, case_number, {parse_ts('closed_at')} AS closed_at FROM raw"),
        "parse_first_response": w(f"SELECT id, case_number, {parse_ts('first_response_at')} AS first_response_at FROM raw"),
        "clean_csat": w(f"SELECT id, case_number, {clean_num('csat')} AS csat FROM raw"),
        "clean_age_days": w(f"SELECT id, case_number, {clean_num('age_days')} AS age_days FROM raw"),
        "clean_escalated": w("SELECT id, case_number, coalesce(lower(is_escalated) = 'true', false) AS is_escalated FROM raw"),
        "clean_priority": w(f"SELECT id, case_number, CASE WHEN coalesce(regexp_matches(priority, '{K.PRIORITY_PATTERN}'), false) "
                            f"THEN priority ELSE {u} END AS priority FROM lab"),
        "priority_rank": w("SELECT DISTINCT priority, priority_rank FROM t"),
        "account_label": w(f"SELECT DISTINCT account_name, {_label('account_name')} AS account_label FROM t"),
        "cleaning_funnel": w(f"""
, flags AS (
  SELECT status IS DISTINCT FROM {q(K.MERGED_STATUS)} AS k1,
         account_name NOT IN {sql_list(INTERNAL_ACCOUNTS)} AS k2,
         lower(case_owner) NOT IN {OWNERS_LOWER} AS k3,
         {parse_ts('created_at')} IS NOT NULL AS k4
  FROM lab
), c AS (
  SELECT count(*) AS s0, count_if(k1) AS s1, count_if(k1 AND k2) AS s2, count_if(k1 AND k2 AND k3) AS s3,
         count_if(k1 AND k2 AND k3 AND k4) AS s4 FROM flags
)
SELECT 0 AS step_no, 'input' AS step, s0 AS rows_left, 0::BIGINT AS rows_removed FROM c
UNION ALL SELECT 1, 'drop_merged', s1, s0 - s1 FROM c
UNION ALL SELECT 2, 'drop_accounts', s2, s1 - s2 FROM c
UNION ALL SELECT 3, 'drop_owners', s3, s2 - s3 FROM c
UNION ALL SELECT 4, 'drop_bad_created_date', s4, s3 - s4 FROM c"""),
        "clean_tickets": w("SELECT * FROM t"),
        # filters
        "top_accounts_default": w(f"SELECT account_name, count(*) AS ticket_count FROM t GROUP BY account_name "
                                  f"ORDER BY ticket_count DESC, account_name LIMIT {K.TOP_ACCOUNTS}"),
        "account_options": w(f"SELECT DISTINCT account_name FROM t WHERE account_name <> {u}"),
        "owner_groups": w(owner_groups),
        "priority_options": w(f"SELECT priority, min(priority_rank) AS priority_rank FROM t WHERE priority <> {u} GROUP BY priority"),
        "area_options": w(f"SELECT DISTINCT product_area FROM t WHERE product_area <> {u}"),
        "rca_options": w(f"SELECT DISTINCT rca FROM t WHERE rca <> {u}"),
        "filter_tickets": w(f"SELECT * FROM t WHERE product_area <> {u} AND priority <> {u} "
                            f"AND account_name IN ({top10})"),
        "date_bounds": w("SELECT min(CAST(created_at AS DATE)) AS min_date, max(CAST(created_at AS DATE)) AS max_date FROM t"),
        "filter_by_owner_group": w(f"""
, og AS ({owner_groups})
SELECT * FROM f WHERE case_owner IN (SELECT case_owner FROM og WHERE owner_group = {q(K.OWNER_GROUP_SUPPORT)})"""),
        # aggregates
        "overview_kpis": w(f"""
SELECT count(*) AS total_tickets,
  (SELECT count(*) FROM (SELECT account_name FROM f GROUP BY account_name
     HAVING count(*) >= {K.ACTIVE_ACCOUNT_MIN_TICKETS} AND account_name <> {u})) AS active_accounts,
  count(DISTINCT product_area) AS product_areas,
  {r6('avg(CASE WHEN csat <> 0 THEN csat END)')} AS avg_csat,
  {r6('avg(CAST(is_escalated AS INTEGER)) * 100')} AS escalation_rate
FROM f"""),
        "distinct_by_month": w("""
SELECT coalesce(month, 'all') AS month, count(*) AS n_tickets, count(DISTINCT account_name) AS account_name,
  count(DISTINCT product_area) AS product_area, true AS account_name_within, true AS product_area_within
FROM f GROUP BY GROUPING SETS ((month), ())"""),
        "active_accounts": w(f"""
SELECT count(*) AS active_accounts FROM (SELECT account_name FROM f GROUP BY account_name
  HAVING count(*) >= {K.ACTIVE_ACCOUNT_MIN_TICKETS} AND account_name <> {u})"""),
        "top_accounts": w(f"""
SELECT account_name, ticket_count, {_label('account_name')} AS account_label FROM (
  SELECT account_name, count(*) AS ticket_count FROM f GROUP BY account_name
  ORDER BY ticket_count DESC, account_name LIMIT {K.TOP_ACCOUNTS})"""),
        "monthly_csat_labeled": w(f"SELECT *, {_label('account_name')} AS account_label FROM ({csat_rows})"),
        "csat_vs_overall": w(f"SELECT *, {_label('account_name')} AS account_label, "
                             f"(SELECT {r6('avg(csat)')} FROM f WHERE csat <> 0) AS overall_avg_csat FROM ({csat_rows})"),
        "monthly_volume": w("SELECT month, account_name, count(*) AS ticket_count FROM f GROUP BY month, account_name"),
        "monthly_csat": w(csat_rows),
        "ticket_cube": w("""
SELECT month, account_name, priority, priority_rank, product_area, product_feature, rca,
  count(*) AS n_tickets, {s} AS csat_sum, count_if(csat <> 0) AS csat_n,
  count_if(is_escalated) AS escalated_n
FROM f GROUP BY ALL""".replace("{s}", r6("sum(CASE WHEN csat <> 0 THEN csat ELSE 0 END)"))),
        "priority_distribution": w(f"""
SELECT priority, ticket_count, {r6('ticket_count / sum(ticket_count) OVER ()')} AS share FROM (
  SELECT priority, count(*) AS ticket_count FROM f WHERE priority <> {u} GROUP BY priority)"""),
        "escalation_by_priority": w(f"SELECT priority, {r6('avg(CAST(is_escalated AS INTEGER)) * 100')} AS escalation_rate "
                                    f"FROM f WHERE priority <> {u} GROUP BY priority"),
        "resolution_by_priority": _durations("closed_at", 8.64e10, "days", False),
        "resolution_summary": _durations("closed_at", 8.64e10, "days", True),
        "first_response_by_priority": _durations("first_response_at", 3.6e9, "hours", False),
        "first_response_summary": _durations("first_response_at", 3.6e9, "hours", True),
        "area_distribution": w(f"""
SELECT product_area, ticket_count, {r6('ticket_count / sum(ticket_count) OVER ()')} AS share FROM (
  SELECT product_area, count(*) AS ticket_count FROM f GROUP BY product_area)"""),
        "area_feature_rollup": w("""
SELECT product_area, product_feature, count(*) AS ticket_count, false AS is_area_total
FROM f GROUP BY product_area, product_feature
UNION ALL
SELECT product_area, NULL, count(*), true FROM f GROUP BY product_area"""),
        "rca_distribution": w(f"SELECT rca, count(*) AS ticket_count FROM f WHERE rca <> {u} GROUP BY rca"),
        "rca_by_priority_top5": w(f"""
SELECT priority, rca, count(*) AS ticket_count FROM f
WHERE rca <> {u} AND priority <> {u} AND rca IN ({top5})
GROUP BY priority, rca"""),
        "words_subject": _words("subject"),
        "words_description": _words("description"),
        "words_pod": _words("pod_name"),
        "words_area": _words("product_area"),
        "words_feature": _words("product_feature"),
        # data quality
        "field_completeness": _completeness(),
        "subject_lengths": w(f"""
SELECT {r6('avg(length(subject))')} AS avg_length, min(length(subject)) AS min_length,
  max(length(subject)) AS max_length FROM qi WHERE subject IS NOT NULL"""),
        "subject_starts": w(f"""
SELECT substring(subject, 1, {K.SUBJECT_START_LENGTH}) AS subject_start, count(*) AS subject_count
FROM qi WHERE subject IS NOT NULL GROUP BY subject_start
ORDER BY subject_count DESC, subject_start LIMIT {K.TOP_SUBJECT_STARTS}"""),
        "generic_subjects": _generic(),
        "case_variations": w("""
, v AS (SELECT DISTINCT product_feature AS variation, lower(product_feature) AS value_lower
        FROM qi WHERE product_feature IS NOT NULL)
SELECT value_lower, variation FROM v
WHERE value_lower IN (SELECT value_lower FROM v GROUP BY value_lower HAVING count(*) > 1)"""),
        "value_counts": w("SELECT product_feature AS value, count(*) AS value_count FROM qi "
                          "WHERE product_feature IS NOT NULL GROUP BY product_feature"),
        "similar_values": _similar("rca"),
        "similar_features": _similar("product_feature"),
        "dq_date_rejects": w(" UNION ALL ".join(
            f"SELECT {q(c)} AS field, count_if({c} IS NOT NULL AND {c} NOT IN {sql_list(K.NA_TOKENS)} "
            f"AND {parse_ts(c)} IS NULL) AS rejected FROM raw" for c in ("created_at", "closed_at", "first_response_at"))),
        "dp_tickets": w(f"SELECT * FROM qi WHERE {_dp_mask()}"),
        "dq_issues": wi("SELECT * FROM issues"),
        "dq_totals": w(f"""
SELECT count(*) AS total_dp_analytics_tickets,
  count(DISTINCT CASE WHEN ({_has_term()}) THEN coalesce(id, '\u0001null') END) AS unique_data_quality_issues
FROM qi WHERE {_dp_mask()}"""),
        "dq_by_pod": wi("SELECT pod_name, count(*) AS issue_count FROM issues WHERE pod_name IS NOT NULL GROUP BY pod_name"),
        "dq_by_area": wi("SELECT product_area, count(*) AS issue_count FROM issues WHERE product_area IS NOT NULL GROUP BY product_area"),
        "dq_monthly": wi("SELECT strftime(created_at, '%Y-%m') AS month, count(*) AS issue_count FROM issues "
                         "WHERE created_at IS NOT NULL GROUP BY strftime(created_at, '%Y-%m')"),
        "dq_sample": wi("SELECT " + ", ".join(K.SAMPLE_COLUMNS) + " FROM issues ORDER BY created_at NULLS LAST, case_number "
                        f"LIMIT {K.SAMPLE_ISSUES}"),
        "dq_terms": _terms(),
    }
    sql["field_consistency"] = f"""
SELECT 'case_variations' AS table_name, value_lower || '|' || variation AS key, 1.0::DOUBLE AS value FROM ({sql["case_variations"]})
UNION ALL SELECT 'value_counts', value, value_count FROM ({sql["value_counts"]})
UNION ALL SELECT 'similar_values', value || '|' || similar_value, ratio FROM ({sql["similar_features"]})"""
    sql["export_zone_dropped"] = w("SELECT id, case_number, created_at FROM t")
    sql["result_csv"] = sql["priority_distribution"]
    sql["report_set"] = _long_form(sql, REPORT_KEYS)
    sql["quality_report_set"] = _long_form(sql, QUALITY_KEYS)
    return sql
