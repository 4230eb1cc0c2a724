"""Column mapping through every entry: batch read, ingest, command line, stream."""

import os

import pytest

from ticketlab import constants as K
from ticketlab.plans import catalog
from ticketlab.sources.tickets import ColumnMapping, ingest_tickets, read_tickets

SF = "/root/testdata/sf0.001"
ALIAS = "Parent__r.Group_Id__c"
MAPPING = ColumnMapping.parse([f"{ALIAS}=group_id", "Group Name=group_id", "Kind=case_type"])


def test_parse():
    assert MAPPING.aliases == ((ALIAS, "group_id"), ("Group Name", "group_id"), ("Kind", "case_type"))
    assert ColumnMapping.parse(["a=b=c"]).aliases == (("a=b", "c"),)
    for bad in ("x", "=x", "x="):
        with pytest.raises(ValueError):
            ColumnMapping.parse([bad])


def test_precedence(spark):
    df = spark.createDataFrame([("usual", "first", "second", "own", "e", "x")],
                               f"Group_Id__c string, `{ALIAS}` string, `Group Name` string, group_id string, Id string, extra string")
    got = MAPPING.apply(df)
    assert got.columns == ["group_id", "id", "extra"] and got.first().group_id == "first"
    assert MAPPING.apply(df.drop(ALIAS)).first().group_id == "second"
    assert MAPPING.apply(df.drop(ALIAS, "Group Name")).first().group_id == "usual"
    assert MAPPING.apply(df.drop(ALIAS, "Group Name", "Group_Id__c")).first().group_id == "own"
    assert "group_id" not in MAPPING.apply(df.select("Id")).columns
    # unnamed in the mapping: kept as it is
    assert ColumnMapping().apply(df).columns == ["group_id", ALIAS, "Group Name", "id", "extra"]


def test_nulls_of_the_preferred_column_are_kept(spark):
    df = spark.createDataFrame([("usual", None)], f"Group_Id__c string, `{ALIAS}` string")
    assert MAPPING.apply(df).first().group_id is None


def _files(spark, path, both):
    """Ticket files whose group ids stand in the alias column (and wrong ones in the usual column)."""
    raw = catalog.raw(spark, SF)
    cols = []
    for source, name in K.SOURCE_COLUMNS.items():
        if name == "group_id":
            cols.append(raw[name].alias(ALIAS))
            if both:
                cols.append(raw["id"].alias(source))
        else:
            cols.append(raw[name].alias("Kind" if name == "case_type" else source))
    raw.select(cols).write.option("header", True).option("escape", '"').csv(path)
    return raw


def _groups(df):
    return sorted((r.case_number, r.group_id, r.case_type) for r in df.select("case_number", "group_id", "case_type").collect())


def test_batch_read_and_ingest(spark, tmp_path):
    raw = _files(spark, str(tmp_path / "in"), both=True)
    want = _groups(raw)
    assert _groups(read_tickets(spark, str(tmp_path / "in"), mapping=MAPPING)) == want
    out = ingest_tickets(spark, str(tmp_path / "in"), str(tmp_path / "out"), mapping=MAPPING)
    assert _groups(out) == want and set(out.columns) == set(raw.columns)


def test_stream(spark, tmp_path):
    from ticketlab.operators import clean
    from ticketlab.streaming.ingest import raw_ticket_schema, start_clean_ingest

    raw = _files(spark, str(tmp_path / "one"), both=False)
    want = _groups(clean.clean_tickets(raw))
    start_clean_ingest(spark, str(tmp_path / "one"), str(tmp_path / "out1"), checkpoint=str(tmp_path / "c1"), once=True,
                       mapping=MAPPING).awaitTermination(300)
    assert _groups(spark.read.parquet(str(tmp_path / "out1"))) == want
    # files with both columns: the schema names them, the mapping chooses
    _files(spark, str(tmp_path / "two"), both=True)
    names = MAPPING.source_columns()
    names.insert(names.index(ALIAS) + 1, "Group_Id__c")
    start_clean_ingest(spark, str(tmp_path / "two"), str(tmp_path / "out2"), checkpoint=str(tmp_path / "c2"), once=True,
                       mapping=MAPPING, schema=raw_ticket_schema(names)).awaitTermination(300)
    assert _groups(spark.read.parquet(str(tmp_path / "out2"))) == want


def test_command_line(spark, tmp_path):
    from ticketlab.__main__ import parse_args, run_report

    raw = _files(spark, str(tmp_path / "in"), both=True)
    out = str(tmp_path / "out")
    paths = run_report(parse_args(["report", "--input", str(tmp_path / "in"), "--out", out, "--all-accounts",
                                   "--column", f"{ALIAS}=group_id", "--column", "Kind=case_type"]))
    back = spark.read.parquet(os.path.join(out, "filtered_tickets"))
    want = {(c, g, "nan" if k is None else k) for c, g, k in _groups(raw)}
    assert back.count() > 0 and set(_groups(back)) <= want
    rejects = spark.read.option("header", True).csv(os.path.join(out, "tables", "date_rejects")).collect()
    bad = raw.where("created_at = 'not a date'").count()
    assert {r.field: int(r.rejected) for r in rejects} == {"created_at": bad, "closed_at": 0, "first_response_at": 0}
    assert any(p.endswith("date_rejects") for p in paths)
    with pytest.raises(Exception, match="created_at is not a date: not a date"):
        run_report(parse_args(["report", "--input", str(tmp_path / "in"), "--out", str(tmp_path / "strict"), "--all-accounts",
                               "--column", "Kind=case_type", "--strict-dates"]))
