"""Dates that are none: counted while rows pass, or the end of the job."""

import os

import pytest
from pyspark.sql import Observation

from ticketlab.operators import clean, issues
from ticketlab.plans import catalog
from ticketlab.plans.report import quality_report_tables

SF = "/root/testdata/sf0.001"
ROWS = [
    {"pod_name": "DP-1", "subject": "data quality", "created_at": "never", "closed_at": "2025-01-02", "first_response_at": "x"},
    {"pod_name": "DP-1", "subject": "gdpr", "id": "b", "created_at": "13/45/2025", "closed_at": None, "first_response_at": "2025-01-01 10:00"},
    {"pod_name": "other", "subject": "fine", "id": "c", "created_at": "1/31/2025", "closed_at": "N/A", "first_response_at": ""},
    {"pod_name": "other", "subject": "fine", "id": "d", "created_at": None, "closed_at": "2025-02-30", "first_response_at": None},
]
WANT = {"created_at": 2, "closed_at": 1, "first_response_at": 1}


def counted(raw):
    rejects = Observation("test-rejects")
    tables = quality_report_tables(clean.quality_input(raw, rejects=rejects), rejects=rejects)
    return {r.field: r.rejected for r in tables["date_rejects"].collect()}, tables


def test_rejects_of_all_rows_are_counted(make_raw):
    """Rows outside the DP selection count too; missing values are no rejects."""
    got, tables = counted(make_raw(ROWS))
    assert got == WANT
    assert tuple(tables["dq_totals"].first()) == (2, 2)


def test_no_rows_and_absent_column(spark, make_raw):
    got, tables = counted(make_raw(ROWS[:1]).drop("first_response_at"))
    assert got == {"created_at": 1, "closed_at": 0}
    got, tables = counted(make_raw([]))
    assert all(n == 0 for n in got.values()) and tuple(tables["dq_totals"].first()) == (0, 0)


def test_strict_names_the_column_and_the_value(make_raw):
    ok = clean.quality_input(make_raw(ROWS[2:3]).drop("first_response_at"), strict=True)
    assert ok.count() == 1 and ok.select("created_at").first().created_at.month == 1
    with pytest.raises(Exception, match="created_at is not a date: 13/45/2025"):
        clean.quality_input(make_raw(ROWS[1:2]), strict=True).select("created_at").collect()


def _scans(spark, tmp_path, fn):
    """What ``fn`` returns for the raw tickets, and the jobs of the group so far."""
    raw = str(tmp_path / "raw")
    catalog.raw(spark, SF).write.parquet(raw)
    before = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("rejects", "rejects")
    out = fn(spark.read.parquet(raw))
    jobs = before.getJobIdsForGroup("rejects")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return out, jobs


def test_counting_takes_no_scan_of_its_own(spark, tmp_path):
    """The jobs of the candidates' write are the same with and without counting."""
    def run(observe):
        def fn(raw):
            rejects = Observation("r") if observe else None
            rows, total = issues.candidates(clean.quality_input(raw, rejects=rejects))
            return rejects.get if observe else None
        return fn
    os.makedirs(tmp_path / "a"), os.makedirs(tmp_path / "b")
    counts, with_ = _scans(spark, tmp_path / "a", run(True))
    _, without = _scans(spark, tmp_path / "b", run(False))
    # the group of the second run holds both runs' jobs
    assert len(set(without)) == 2 * len(set(with_)) and counts["created_at"] > 0


def test_issues_do_not_aggregate_descriptions(spark, tmp_path):
    """Only narrow columns go through the aggregate; whole rows are picked by number."""
    plan = issues.dq_issues(catalog.qinput(spark, SF))._jdf.queryExecution().executedPlan().toString()
    for line in plan.split("\n"):
        if "Aggregate" in line:
            assert "description" not in line and "subject" not in line, line
    assert "left_semi" in plan.lower() or "LeftSemi" in plan


def test_equal_rows_of_an_id_leave_one(make_raw):
    row = {"id": "x", "created_at": "2025-01-02", "subject": "gdpr", "pod_name": "DP-1"}
    raw = make_raw([row, row, {**row, "id": None}, {**row, "id": None}]).withColumn("case_number", clean.F.lit("7"))
    got = issues.dq_issues(clean.quality_input(raw)).collect()
    assert sorted(str(r.id) for r in got) == ["None", "x"]
    short = issues.dq_issues(clean.quality_input(raw), columns=("pod_name",)).collect()
    assert sorted(str(r.id) for r in short) == ["None", "x"]


def test_one_id_with_most_rows(spark, make_raw):
    raw = make_raw([{"id": None if i % 3 else "y", "subject": "gdpr", "pod_name": "DP", "created_at": f"2025-01-{1 + i % 28:02d}"} for i in range(300)])
    got = {r.id: r.case_number for r in issues.dq_issues(clean.quality_input(raw)).collect()}
    assert got == {"y": "00000000", None: "00000028"}
