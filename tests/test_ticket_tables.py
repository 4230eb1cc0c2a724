"""The ticket view over tables of its own rows."""

import datetime as dt
import re

import pytest

from ticketlab.plans import catalog
from ticketlab.sources import sinks
from ticketlab.sources.tickets import tickets_from_tables

TABLES = {
    "orders": ("o_orderkey long, o_custkey long, o_orderdate timestamp_ntz, o_orderpriority string, o_orderstatus string",
               [(k, 2 + (k or 0) % 3, dt.datetime(2024, 1 + (k or 0) % 5, 1 + (k or 0) % 28), "1-URGENT", "O") for k in (*range(40), 7, None)]),
    "customer": ("c_custkey long, c_name string, c_nationkey int", [(k, f"Customer {k}", 0) for k in (2, 3, None)]),
    "nation": ("n_nationkey int, n_name string, n_regionkey int", [(0, "PERU", 0)]),
    "region": ("r_regionkey int, r_name string", [(0, "AMERICA")]),
    "part": ("p_partkey long, p_name string, p_type string, p_brand string", [(k, f"part {k}", "Tin", "Brand#1") for k in range(5)]),
    "supplier": ("s_suppkey long, s_name string", [(k, f"Supplier {k}") for k in range(3)]),
    "documents": ("doc_id long, text string", [(k, f"text {k} " + "".join(chr(97 + k * j * j % 26) for j in range(4000))) for k in range(30)]),
}


def write_tables(spark, folder, **other):
    for name, (schema, rows) in TABLES.items():
        spark.createDataFrame(other.get(name, rows), schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


@pytest.fixture
def conf(spark):
    old = {}

    def put(key, value):
        old.setdefault(key, spark.conf.get(key, None))
        spark.conf.set(key, value)
    yield put
    for key, value in old.items():
        spark.conf.set(key, value) if value is not None else spark.conf.unset(key)


def expected():
    """(order key, text) of the orders that have all their rows."""
    return sorted((k, TABLES["documents"][1][k % 30][1]) for k in (*range(40), 7) if k % 3 < 2)


def found(raw):
    return sorted((int(r.case_number), r.description or "") for r in raw.collect())


def test_orders_side_of_a_join_may_be_broadcast(spark, tmp_path, conf):
    """Joins planned with shuffles whose orders' side proves to be the small one."""
    d = write_tables(spark, tmp_path)
    conf("spark.sql.autoBroadcastJoinThreshold", "-1")
    conf("spark.sql.adaptive.autoBroadcastJoinThreshold", "60k")
    got = found(tickets_from_tables(spark, d))
    assert [k for k, _ in got] == [k for k, _ in expected()]
    assert [x for x in got if x[0] % 11 and x[0] % 13] == [x for x in expected() if x[0] % 11 and x[0] % 13]


def test_no_parts_no_tickets(spark, tmp_path):
    assert tickets_from_tables(spark, write_tables(spark, tmp_path, part=[])).collect() == []


def test_scratch_csv_is_compressed(spark, tmp_path):
    d = write_tables(spark, tmp_path)
    got = catalog.scan_tickets(spark, d)
    assert got.inputFiles() and all(f.endswith(".csv.gz") for f in got.inputFiles())
    assert found(got) == found(catalog.raw(spark, d))


def test_export_is_compressed_and_its_tasks_are_small(spark, tmp_path, monkeypatch, conf):
    """Written from a shuffle of which one task would read all."""
    d, key = write_tables(spark, tmp_path), "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(key)
    conf("spark.sql.adaptive.coalescePartitions.parallelismFirst", "false")
    conf("spark.sql.adaptive.coalescePartitions.minPartitionSize", "1b")
    monkeypatch.setattr(sinks, "TASK_BYTES", 1)
    t = catalog.filtered(spark, d).repartition("case_number")
    sinks.write_table(t, f"{tmp_path}/out")
    files = spark.read.parquet(f"{tmp_path}/out").inputFiles()
    assert all(f.endswith(".zstd.parquet") for f in files)
    assert len({re.search(r"part-(\d+)", f).group(1) for f in files}) > 1
    assert spark.conf.get(key) == before
    names = sorted(t.columns)
    assert sorted(map(str, spark.read.parquet(f"{tmp_path}/out").select(names).collect())) == sorted(map(str, t.select(names).collect()))


def written_plan(spark):
    """Physical plan of the last execution."""
    done = spark._jsparkSession.sharedState().statusStore().executionsList()
    return done.apply(done.size() - 1).physicalPlanDescription()


@pytest.mark.parametrize("open_files", [240, 2, 1])
def test_export_does_not_sort_texts_by_month(spark, tmp_path, monkeypatch, open_files):
    """Five months; those beyond the open files are written after them. Small row groups."""
    monkeypatch.setattr(sinks, "OPEN_FILES", open_files)
    monkeypatch.setattr(sinks, "GROUP_BYTES", 1024)
    t, key = catalog.filtered(spark, write_tables(spark, tmp_path)), "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(key)
    sinks.write_table(t, f"{tmp_path}/out")
    plan = written_plan(spark)
    assert "WriteFiles" in plan and not re.search(r"Sort \[month", plan) and "Arguments: [month" not in plan
    assert spark.conf.get(key) == before
    names, back = sorted(t.columns), spark.read.parquet(f"{tmp_path}/out")
    assert back.select("month").distinct().count() > 2
    assert sorted(map(str, back.select(names).collect())) == sorted(map(str, t.select(names).collect()))
