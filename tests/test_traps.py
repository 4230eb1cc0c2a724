"""One small hand-made frame per semantic trap."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from ticketlab import constants as K
from ticketlab.functions import columns as X
from ticketlab.operators import clean, durations, filters, issues, metrics, profile, similar
from ticketlab.sources.tickets import read_tickets


def _one(df, col):
    return [r[col] for r in df.orderBy("case_number").collect()]


def test_csat_text_to_number(make_raw):
    vals = ["4", "-4", "5 stars", "4.5/5", "1.2.3", "N/A", "", None]
    raw = make_raw([{"csat": v} for v in vals])
    got = _one(clean.clean_numbers(raw), "csat")
    assert got == [4.0, 4.0, 5000000.0, 4.505, 0.0, 0.0, 0.0, 0.0]


def test_na_tokens_become_null(spark):
    df = spark.createDataFrame([("N/A",), ("null",), ("x",), ("",)], ["c"])
    got = [r[0] for r in df.select(X.na_to_null("c")).collect()]
    assert got == [None, None, "x", None]


def test_escalated(make_raw):
    raw = make_raw([{"is_escalated": v} for v in ["TRUE", "true", "1", "yes", None]])
    assert _one(clean.clean_numbers(raw), "is_escalated") == [True, True, False, False, False]


def test_priority_and_rank(make_raw):
    raw = make_raw([{"priority": v} for v in ["P1", "P01", "p1", "P", None, "P99999999999999999999"]])
    out = clean.clean_priority(clean.label_strings(raw)).orderBy("case_number").collect()
    assert [r.priority for r in out] == ["P1", "P01", "Unspecified", "Unspecified", "Unspecified",
                                         "P99999999999999999999"]
    assert [int(r.priority_rank) for r in out] == [1, 1, 999, 999, 999, 99999999999999999999]


def test_merged_status_null_kept(make_raw):
    raw = make_raw([{"status": "Merged"}, {"status": None}, {"status": "F"}])
    assert _one(clean.drop_merged(raw), "status") == [None, "F"]


def test_missing_label_default_and_option(make_raw):
    raw = make_raw([{"rca": None}])
    assert _one(clean.label_strings(raw), "rca") == ["nan"]
    cfg = clean.CleanConfig(missing_label="Unspecified")
    assert _one(clean.label_strings(raw, cfg), "rca") == ["Unspecified"]


def test_owner_exclusion_case_insensitive(make_raw):
    raw = make_raw([{"case_owner": "SPAM"}, {"case_owner": "isr queue"}, {"case_owner": "Ann"}, {"case_owner": None}])
    assert _one(clean.drop_owners(clean.label_strings(raw)), "case_owner") == ["Ann", "nan"]


def test_dates_per_row(make_raw):
    vals = ["2025-01-28 10:00:00", "2025-01-28", "01/28/2025", "1/2/2025 07:08:09",
            "2025-01-28T10:00:00.000+05:30", "bad", None]
    got = _one(clean.parse_dates(make_raw([{"created_at": v} for v in vals])), "created_at")
    assert got == [dt.datetime(2025, 1, 28, 10), dt.datetime(2025, 1, 28), dt.datetime(2025, 1, 28),
                   dt.datetime(2025, 1, 2, 7, 8, 9), dt.datetime(2025, 1, 28, 10), None, None]


def test_clean_drops_bad_created(make_raw):
    raw = make_raw([{"created_at": "bad"}, {"created_at": "2025-02-01"}])
    t = clean.clean_tickets(raw)
    assert t.count() == 1
    assert t.first().month == "2025-02"


def test_date_range_end_is_235959(make_raw):
    raw = make_raw([{"created_at": "2025-01-31 23:59:59"}, {"created_at": "2025-01-31 23:59:59.5"},
                    {"created_at": "2025-01-01 00:00:00"}])
    t = clean.clean_tickets(raw)
    f = filters.filter_tickets(t, filters.TicketFilter(accounts=(), start=dt.date(2025, 1, 1),
                                                       end=dt.date(2025, 1, 31)))
    assert sorted(r.created_at for r in f.collect()) == [dt.datetime(2025, 1, 1), dt.datetime(2025, 1, 31, 23, 59, 59)]


def test_round_half_even(spark):
    df = spark.createDataFrame([(0.25,), (0.35,), (0.45,), (2.65,)], ["x"])
    assert [r[0] for r in df.select(X.round_half_even("x", 1)).collect()] == [0.2, 0.4, 0.4, 2.6]


@pytest.mark.parametrize("method", ["bracket", "builtin"])
def test_median_interpolates(make_raw, method):
    closes = ["2025-01-02 10:00:00", "2025-01-03 10:00:00", "2025-01-04 10:00:00", "2025-01-11 10:00:00"]
    raw = make_raw([{"closed_at": c, "created_at": "2025-01-01 10:00:00"} for c in closes])
    t = clean.clean_tickets(raw)
    r = durations.resolution_by_priority(t, method).first()
    assert r.median_days == 2.5 and r.avg_days == 4.0 and r.ticket_count == 4


def test_dedup_first_matching_row(spark, make_raw):
    raw = make_raw([
        {"id": "x", "created_at": "2025-01-01", "subject": "no match", "pod_name": "DP-1", "description": "plain"},
        {"id": "x", "created_at": "2025-01-02", "subject": "data quality", "pod_name": "DP-1"},
        {"id": "x", "created_at": "2025-01-03", "subject": "data quality again", "pod_name": "DP-1"},
        {"id": None, "created_at": "2025-01-04", "subject": "gdpr", "pod_name": "DP-1"},
        {"id": None, "created_at": "2025-01-05", "subject": "gdpr", "pod_name": "DP-1"},
    ])
    iss = issues.dq_issues(clean.quality_input(raw)).collect()
    by_id = {r.id: r for r in iss}
    assert len(iss) == 2
    assert by_id["x"].subject == "data quality"
    assert by_id[None].created_at == dt.datetime(2025, 1, 4)


def test_issue_selection(make_raw):
    raw = make_raw([
        {"subject": "endpoint down", "pod_name": "X"},
        {"description": "GDPR question", "pod_name": "X"},
        {"pod_name": "dp-x"},
        {"pod_name": "DP-x"},
        {"pod_name": "CI-Analytics"},
        {"pod_name": None, "product_area": None, "product_feature": None, "subject": None,
         "description": None, "rca": None},
    ])
    got = _one(issues.dp_tickets(clean.quality_input(raw)), "case_number")
    assert got == ["00000000", "00000001", "00000003", "00000004"]


def test_term_counts_overlap_and_unicode_space(make_raw):
    raw = make_raw([{"subject": "data quality check", "pod_name": "DP"},
                    {"subject": "data quality", "pod_name": "DP", "id": "i2"}])
    iss = issues.dq_issues(clean.quality_input(raw))
    got = {r.term: r.term_count for r in issues.dq_terms(iss).collect()}
    assert got["data quality"] == 2 and got["data quality check"] == 1


def test_search_regex_equals_plain_alternation(spark):
    texts = ["data quality", "DATA   governance", "bigdata sync error", "sync issue", "synchronization",
             "nothing here", "wrong data", "data protection regulation", "dataquality", "gdpr",
             "ſync error", "data privacy", "corrupt\ndata", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    a = [r[0] for r in df.select(F.col("t").rlike(issues.terms_regex())).collect()]
    b = [r[0] for r in df.select(F.col("t").rlike(issues.search_regex())).collect()]
    assert a == b


def test_top_causes_tie_smaller_name(make_raw):
    rows = []
    for name, n in [("a", 3), ("b", 3), ("c", 2), ("d", 2), ("e", 1), ("f", 1)]:
        rows += [{"rca": name}] * n
    t = clean.clean_tickets(make_raw(rows))
    assert [r.rca for r in metrics.top_causes(t, 5).collect()] == ["a", "b", "c", "d", "e"]


def test_csv_newlines_and_quotes(spark, tmp_path):
    p = os.path.join(tmp_path, "t.csv")
    with open(p, "w") as fh:
        fh.write('Id,Subject,Account.Account_Name__c,CSAT__c\n')
        fh.write('1,"line one\nline two ""quoted""",Acme,N/A\n')
        fh.write('2,plain,NA,5\n')
    df = read_tickets(spark, p, "csv").orderBy("id").collect()
    assert len(df) == 2
    assert df[0].subject == 'line one\nline two "quoted"'
    assert df[0].csat is None and df[1].account_name is None


def test_group_id_alias_column(spark, tmp_path):
    p = os.path.join(tmp_path, "g.csv")
    with open(p, "w") as fh:
        fh.write("Id,Group_Id__c,Parent__r.Group_Id__c\n1,old,new\n")
    r = read_tickets(spark, p, "csv", group_alias="Parent__r.Group_Id__c").first()
    assert r.group_id == "new" and "Parent__r.Group_Id__c" not in r.asDict()


def test_similar_values_and_case_variation(make_raw):
    raw = make_raw([{"rca": v} for v in ["red widget", "red widgets", "Red", "red", "blue"]])
    q = clean.quality_input(raw)
    pairs = {(r.value, r.similar_value) for r in similar.similar_values(q, "rca").collect()}
    assert pairs == {("red widget", "red widgets")}
    cv = {(r.value_lower, r.variation) for r in profile.case_variations(q, "rca").collect()}
    assert cv == {("red", "Red"), ("red", "red")}


def test_zero_rows_rates_null(make_raw):
    t = clean.clean_tickets(make_raw([{"created_at": "bad"}]))
    r = metrics.overview_kpis(t).first()
    assert r.total_tickets == 0 and r.avg_csat is None and r.escalation_rate is None
    q = clean.quality_input(make_raw([{"created_at": "bad"}])).filter("false")
    assert profile.field_completeness(q).first().completion_rate is None
    assert profile.generic_subjects(q).first().generic_percentage is None


def test_account_label(spark):
    df = spark.createDataFrame([("Customer#000000000",), ("Short",), (None,)], "a string")
    got = [r[0] for r in df.select(X.account_label("a")).collect()]
    assert got == ["Customer#000000...", "Short", None]


def test_generic_subjects(make_raw):
    raw = make_raw([{"subject": s} for s in ["Help  needed now", "Error in sync", "my error", "Question?", None]])
    r = profile.generic_subjects(clean.quality_input(raw)).first()
    assert r.generic_count == 3 and r.generic_percentage == 75.0


def test_owner_groups(make_raw):
    raw = make_raw([
        {"case_owner": "Ann", "case_type": "Support Request"},
        {"case_owner": "Ann", "case_type": "Bug"},
        {"case_owner": "Bob", "case_type": "Bug"},
        {"case_owner": "Unspecified", "case_type": "Bug"},
        {"case_owner": "Cy", "case_type": "service request"},
    ])
    t = clean.clean_tickets(raw, clean.CleanConfig(excluded_owners=()))
    got = {(r.owner_group, r.case_owner) for r in filters.owner_groups(t).collect()}
    assert got == {(K.OWNER_GROUP_SUPPORT, "Ann"), (K.OWNER_GROUP_SUPPORT, "Cy"), (K.OWNER_GROUP_OTHER, "Bob")}


def test_filter_empty_lists(make_raw):
    t = clean.clean_tickets(make_raw([{"account_name": "A"}, {"account_name": "B", "priority": "P2"}]))
    assert filters.filter_tickets(t, filters.TicketFilter(accounts=())).count() == 2
    assert filters.filter_tickets(t, filters.TicketFilter(accounts=(), priorities=())).count() == 0
    assert filters.filter_tickets(t, filters.TicketFilter(accounts=("B",))).count() == 1
    assert filters.filter_tickets(t, filters.TicketFilter(accounts=(), priorities=("P2",))).count() == 1


def test_optional_columns_missing(make_raw):
    raw = make_raw([{}, {"priority": "P2", "csat": "5"}]).drop("rca", "status", "case_owner", "first_response_at")
    t = clean.clean_tickets(raw)
    assert t.count() == 2 and "rca" not in t.columns
    f = filters.filter_tickets(t, filters.TicketFilter.all_accounts())
    assert metrics.overview_kpis(f).first().total_tickets == 2
    assert metrics.ticket_cube(f).count() == 2
    assert clean.cleaning_funnel(raw).count() == 5
    q = clean.quality_input(raw)
    assert issues.dp_tickets(q).count() == 0


def test_lists_are_semi_joins(make_raw):
    t = clean.clean_tickets(make_raw([{"account_name": f"A{i}"} for i in range(5)]))
    f = filters.filter_tickets(t, filters.TicketFilter(accounts=("A1", "A3", "A4", "zz")))
    assert sorted(r.account_name for r in f.collect()) == ["A1", "A3", "A4"]
    assert "LeftSemi" in f._jdf.queryExecution().executedPlan().toString()
    assert filters.filter_tickets(t, filters.TicketFilter(accounts=("A1",), areas=())).count() == 0


def test_empty_account_choice_excludes_unspecified(make_raw):
    t = clean.clean_tickets(make_raw([{"account_name": "A"}, {"account_name": "Unspecified"}]))
    got = filters.filter_tickets(t, filters.TicketFilter.all_accounts())
    assert [r.account_name for r in got.collect()] == ["A"] == [r.account_name for r in filters.account_options(t).collect()]


def test_owner_group_without_owners_is_no_filter(make_raw):
    t = clean.clean_tickets(make_raw([{"case_type": "Bug"}, {"case_type": "Bug", "case_owner": "B"}]))
    assert filters.filter_by_owner_group(t, t, ["Support"]).count() == 2
    assert filters.filter_by_owner_group(t, t, []).count() == 2


def test_own_terms_are_found(make_raw):
    q = clean.quality_input(make_raw([{"id": "x", "subject": "a broken  report", "pod_name": "DP-1"}]))
    assert issues.dq_issues(q, issues.IssueConfig(terms=(r"broken\s*report",))).count() == 1
    assert issues.dq_issues(q).count() == 0


def test_totals_from_materialised_issues(make_raw):
    q = clean.quality_input(make_raw([{"id": i, "subject": "data quality", "pod_name": "DP-1"} for i in ("x", "x", "y", None)] + [{"pod_name": "DP-1"}]))
    assert issues.dq_totals(q).collect() == issues.dq_totals(q, issues=issues.dq_issues(q)).collect()


def test_threshold_that_rounds_up_keeps_the_pair(spark):
    from ticketlab.operators import similar

    v = spark.createDataFrame([("abcdef",), ("abcdeg",)], "s string")
    assert similar.similar_pairs(v, 0.8333333).count() == 1
    assert similar.similar_pairs(v, 0.8333334).count() == 0


def test_numeric_csat_and_age(spark, make_raw, tmp_path):
    from ticketlab.sources.tickets import read_tickets

    nan, inf = float("nan"), float("inf")
    values = [1e7, 0.0005, -4.5, nan, inf, -inf, None, 12345678.0]
    want = [1e7, 0.0005, 4.5, 0.0, 0.0, 0.0, 0.0, 12345678.0]
    df = spark.createDataFrame([(i, v, i) for i, v in enumerate(values)], "n int, CSAT__c double, Age_days__c int").coalesce(1)
    df.write.parquet(f"{tmp_path}/p")
    got = clean.clean_numbers(read_tickets(spark, f"{tmp_path}/p", "parquet")).orderBy(F.col("n").cast("int")).collect()
    assert [r.csat for r in got] == want and [r.age_days for r in got] == [float(i) for i in range(8)]


def test_report_without_first_response(make_raw):
    from ticketlab.plans.report import report_tables

    t = clean.clean_tickets(make_raw([{"closed_at": "2025-02-01"}, {"priority": "P2"}]).drop("first_response_at"))
    tables = report_tables(t)
    assert "first_response_by_priority" not in tables and tables["resolution_by_priority"].count() == 1


def test_group_alias_is_the_named_column_only(spark):
    from ticketlab.sources.tickets import rename_source_columns

    df = spark.createDataFrame([("g", "a", "b")], "Group_Id__c string, `X__r.Group_Id__c` string, `Y__r.Group_Id__c` string")
    assert rename_source_columns(df).first()["group_id"] == "g"
    assert rename_source_columns(df, "Y__r.Group_Id__c").first()["group_id"] == "b"


def test_missing_columns(make_raw):
    from ticketlab.sources.tickets import missing_columns

    raw = make_raw([{}])
    assert missing_columns(raw) == []
    assert missing_columns(raw.drop("csat", "rca")) == ["csat"]


def test_month_first_dates_ignore_session_zone(spark, make_raw):
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        raw = make_raw([{"created_at": "03/09/2025 02:30:00"}, {"created_at": "13/45/2025"},
                        {"created_at": "3/9/2025"}])
        got = _one(clean.parse_dates(raw), "created_at")
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    assert got == [dt.datetime(2025, 3, 9, 2, 30), None, dt.datetime(2025, 3, 9)]
