"""Streaming ingest (files -> cleaned month-partitioned Parquet) and the
report table sets."""

import os

from ticketlab import constants as K
from ticketlab.operators import clean
from ticketlab.plans import catalog
from ticketlab.plans.report import quality_report_tables, report_tables, write_report
from ticketlab.streaming.ingest import start_clean_ingest

SF = "/root/testdata/sf0.001"


def _source_named(df):
    return df.select(*[df[v].alias(k) for k, v in K.SOURCE_COLUMNS.items()])


def test_stream_ingest_equals_batch_clean(spark, tmp_path):
    raw = catalog.raw(spark, SF)
    src = str(tmp_path / "in")
    low = raw["case_number"].substr(8, 1) < "5"
    parts = [raw.filter(low), raw.filter(~low)]  # two files arriving apart
    for i, p in enumerate(parts):
        _source_named(p).write.mode("append").option("header", True).option("escape", '"').csv(src)
    dst = str(tmp_path / "out")
    q = start_clean_ingest(spark, src, dst, checkpoint=str(tmp_path / "ckpt"), once=True)
    q.awaitTermination(300)
    got = spark.read.parquet(dst)
    want = clean.clean_tickets(raw)
    assert got.count() == want.count()
    assert (sorted(r.case_number for r in got.select("case_number").collect())
            == sorted(r.case_number for r in want.select("case_number").collect()))
    assert {"month"} <= set(got.columns)


def test_report_tables_and_write(spark, tmp_path):
    f = catalog.filtered(spark, SF)
    tables = report_tables(f)
    assert {"overview_kpis", "words_description", "rca_by_priority_top5"} <= set(tables)
    for name, df in tables.items():
        assert df.count() > 0, name
    paths = write_report({k: tables[k] for k in ("overview_kpis", "priority_distribution")}, str(tmp_path / "rep"))
    for p in paths:
        assert any(n.endswith(".csv") for n in os.listdir(p))


def test_quality_report_tables(spark):
    q = catalog.qinput(spark, SF)
    tables = quality_report_tables(q)
    assert tables["dq_totals"].first().unique_data_quality_issues == tables["dq_issues"].count()
    assert tables["dq_terms"].count() > 0


def test_drop_time_zone_keeps_wall_time(spark):
    from pyspark.sql import functions as F

    from ticketlab.sources.sinks import drop_time_zone

    df = spark.createDataFrame([("2025-01-28 10:00:00",)], "s string").select(F.to_timestamp("s").alias("ts"))
    out = drop_time_zone(df)
    assert dict(out.dtypes)["ts"] == "timestamp_ntz"
    assert str(out.first().ts) == "2025-01-28 10:00:00"


def test_field_consistency_bundle(spark):
    from ticketlab.operators.similar import field_consistency

    q = catalog.qinput(spark, SF)
    out = field_consistency(q, "product_feature")
    assert set(out) == {"case_variations", "value_counts", "similar_values"}
    assert out["case_variations"].count() > 0 and out["value_counts"].count() > 0
    for r in out["similar_values"].collect():
        assert r.value < r.similar_value and 0.8 < r.ratio < 1.0


def test_cli_report_end_to_end(spark, tmp_path):
    from ticketlab.__main__ import parse_args, run_report

    src = str(tmp_path / "tickets")
    _source_named(catalog.raw(spark, SF)).write.option("header", True).option("escape", '"').csv(src)
    out = str(tmp_path / "out")
    paths = run_report(parse_args(["report", "--input", src, "--out", out, "--exclude-account", "Acme",
                                   "--all-accounts", "--start", "1995-01-01", "--end", "1999-12-31"]))
    names = {os.path.basename(p) for p in paths}
    assert {"overview_kpis", "dq_terms", "dq_issues", "cleaning_funnel", "filtered_tickets",
            "owner_groups", "date_bounds", "rca_options"} <= names
    back = spark.read.parquet(os.path.join(out, "filtered_tickets"))
    assert back.count() > 0 and "month" in back.columns
    kpi = spark.read.option("header", True).csv(os.path.join(out, "tables", "overview_kpis")).first()
    assert int(kpi.total_tickets) == back.count()
