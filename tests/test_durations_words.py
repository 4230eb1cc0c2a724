"""Two scans for both durations, one for the short columns' words, in plans and in the event log."""

import glob
import json
import os
import random
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from ticketlab.operators import durations, words
from ticketlab.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def f(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("f") / "tickets")
    catalog.filtered(spark, SF).write.parquet(path)
    return spark.read.parquet(path)


def table(df):
    return [tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect()]


def test_both_durations_equal_spark_medians(f):
    both = durations.duration_medians(f)
    for measure, fn in (("resolution", durations.resolution_by_priority), ("first_response", durations.first_response_by_priority)):
        assert table(durations.of_measure(both, measure)) == table(fn(f, "builtin")) == table(fn(f)) != []


def test_one_measure_of_tickets_without_the_other(f):
    t = f.drop("first_response_at")
    assert table(durations.resolution_by_priority(t)) == table(durations.resolution_by_priority(f, "builtin"))


@pytest.mark.parametrize("half_width", [-0.4, 0.0, 0.0015])
def test_missed_brackets_fall_back(spark, monkeypatch, half_width):
    """An inverted bracket misses every group, one of no width some, the usual one none."""
    monkeypatch.setattr(durations, "BRACKET_HALF_WIDTH", half_width)
    r = random.Random(3)
    data = [("hot", r.gauss(0, 9)) for _ in range(60000)] + [(f"g{i % 5}", float(r.randint(0, 9))) for i in range(999)]
    data += [("one", 1.5), ("two", 1.0), ("two", 4.0), (None, 2.0), ("none", None)]
    df = spark.createDataFrame(data, "k string, v double").repartition(7)
    want = {r.k: r.m for r in df.where("v is not null and k is not null").groupBy("k").agg(F.median("v").alias("m")).collect()}
    assert {r.k: r.median for r in durations.exact_selection(df, ["k"], "v").collect()} == pytest.approx(want)


def test_no_rows(spark, f):
    assert durations.duration_medians(f.limit(0)).count() == 0


def test_word_tables_equal_single_columns(f):
    columns = ("pod_name", "product_area", "product_feature", "rca")
    for n in (3, 100):
        tagged = words.word_tables(f, columns, n)
        for c in columns:
            assert table(words.of_column(tagged, c)) == table(words.word_frequencies(f, c, n).orderBy(F.desc("word_count"), "word"))


def test_word_tables_limit_before_the_shuffle(f):
    plan = words.word_tables(f, ("pod_name", "product_area"))._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and plan.count("FileScan") == 1


SCANS = """
import sys
from ticketlab.operators import durations
from ticketlab.plans import report
from ticketlab.session import get_spark
spark = get_spark("local[2]", shuffle_partitions=2, extra={"spark.eventLog.enabled": "true", "spark.eventLog.dir": sys.argv[2],
                  "spark.eventLog.compress": "false", "spark.eventLog.rolling.enabled": "false"})
t = spark.read.parquet(sys.argv[1])
if sys.argv[3] == "durations":
    durations.duration_medians(t).collect()
else:
    report.report_tables(t)      # what it writes before any table is asked for
spark.stop()
"""


def _rows_read(spark, f, tmp_path, what):
    """Rows that all tasks read from files, from the event log, over the tickets there are."""
    path, log = str(tmp_path / "t"), tmp_path / "log"
    f.coalesce(1).write.parquet(path)
    os.makedirs(log)
    env = {**os.environ, "PYTHONPATH": os.path.dirname(os.path.dirname(os.path.abspath(__file__)))}
    subprocess.run([sys.executable, "-c", SCANS, path, str(log), what], env=env, check=True, capture_output=True, timeout=300)
    read = 0
    for name in glob.glob(f"{log}/*"):
        with open(name) as lines:
            for event in map(json.loads, lines):
                if event["Event"] == "SparkListenerTaskEnd":
                    read += event["Task Metrics"]["Input Metrics"]["Records Read"]
    return read / f.count()


def test_event_log_durations_read_the_tickets_twice(spark, f, tmp_path):
    assert 2 <= _rows_read(spark, f, tmp_path, "durations") < 2.5


def test_event_log_report_reads_the_tickets_five_times(spark, f, tmp_path):
    """The narrow copy, from it the cube, both durations (twice) and the short columns' words."""
    assert 5 <= _rows_read(spark, f, tmp_path, "report") < 6.5
