"""Plan shape: pushdown, pruning, no pair explosions, top-k as
TakeOrderedAndProject, no row-at-a-time Python."""

from ticketlab import constants as K
from ticketlab.operators import clean, durations, filters, metrics, similar, words
from ticketlab.plans import catalog

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_clean_pushes_filter_and_prunes(spark, tmp_path):
    catalog.raw(spark, SF).write.parquet(f"{tmp_path}/raw")
    t = clean.clean_tickets(spark.read.parquet(f"{tmp_path}/raw"))
    p = plan(t.groupBy("priority").count())
    assert "PushedFilters: [Not(EqualNullSafe(status,Merged))" in p
    read = p.split("ReadSchema:")[1].split("\n")[0]
    assert "priority" in read and "description" not in read and "subject" not in read


def test_words_read_only_needed_columns(spark, tmp_path):
    raw = catalog.raw(spark, SF)
    p = str(tmp_path / "raw")
    raw.write.parquet(p)
    t = clean.clean_tickets(spark.read.parquet(p))
    pl = plan(words.word_frequencies(t, "description"))
    assert "TakeOrderedAndProject" in pl
    assert "subject" not in pl.split("ReadSchema:")[1].split("\n")[0]
    assert "PushedFilters: [Not(EqualNullSafe(status,Merged))" in pl


def test_similarity_join_has_no_cross_product(spark):
    q = clean.quality_input(catalog.raw(spark, SF))
    pl = plan(similar.similar_values(q, "rca"))
    assert "CartesianProduct" not in pl and "BroadcastNestedLoopJoin" not in pl
    assert "ArrowEvalPython" in pl and "BatchEvalPython" not in pl
    # the ratio runs once, after all pruning (not pushed below it)
    assert pl.count("ArrowEvalPython") == 1


def test_similarity_join_moves_little(spark):
    """Nothing broadcast: at most 12 exchanges (29 were planned before), no window, and no
    string in the blocking join, which has numbers only."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        pl = plan(similar.similar_values(clean.quality_input(catalog.raw(spark, SF)), "rca"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    lines = pl.split("\n")
    assert "Window" not in pl and sum(" Exchange " in f" {x.strip(' :+-')}" for x in lines) <= 12
    block = next(i for i, x in enumerate(lines) if "SortMergeJoin [tok" in x)
    depth = len(lines[block]) - len(lines[block].lstrip(" :+-"))
    below = [x for x in lines[block + 1:] if len(x) - len(x.lstrip(" :+-")) > depth]
    assert not any("Exchange hashpartitioning(tok" in x and " s#" in x for x in below)


def test_topk_is_take_ordered(spark):
    t = catalog.filtered(spark, SF)
    assert "TakeOrderedAndProject" in plan(metrics.top_accounts_labeled(t))


def test_no_python_in_ticket_queries(spark):
    for name, fn in catalog.QUERIES.items():
        if name in ("similar_values", "similar_features", "field_consistency", "scan_tickets", "export_roundtrip"):
            continue
        pl = plan(fn(spark, SF))
        assert "BatchEvalPython" not in pl and "ArrowEvalPython" not in pl, name
        assert "CartesianProduct" not in pl, name


def test_overview_single_scan(spark):
    pl = plan(metrics.overview_kpis(catalog.filtered(spark, SF)))
    assert "Expand" in pl  # grouping sets: one scan feeds both groupings


def test_written_statistics_keep_tickets_where_they_are(spark):
    """With a threshold far below the tickets' size, neither the duration passes
    nor the owner filter shuffle tickets by priority or owner."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "64k")
    try:
        t = catalog.filtered(spark, SF)
        pl = plan(durations.resolution_by_priority(t))
        assert "SortMergeJoin" not in pl and "hashpartitioning(priority" not in pl
        pl = plan(filters.filter_by_owner_group(t, t, [K.OWNER_GROUP_SUPPORT]))
        assert "BroadcastHashJoin [case_owner" in pl and "hashpartitioning(case_owner" not in pl
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
