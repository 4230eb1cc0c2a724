"""Bounded samples of labelled texts."""

import pytest
from pyspark.sql import functions as F

from ticketlab.llm import common as C
from ticketlab.llm import quality, toxicity

SCHEMA = "doc_id long, text string, label int"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def sample(docs, rows, size, per_label=False):
    got = C.training_sample(docs.select("doc_id", "text"), docs.select("doc_id", "label").distinct(), rows, size, per_label)
    return sorted(r.doc_id for r in got.collect())


@pytest.mark.parametrize("per_label", [False, True])
def test_one_long_text_does_not_end_the_sample(spark, per_label):
    """The text of the smallest hash is larger than the bound: all others are taken."""
    first = spark.range(200).orderBy(F.xxhash64(F.lit(17), "id")).first().id
    docs = frame(spark, [(i, "x" * (50_000 if i == first else 100), i % 2) for i in range(200)])
    assert sample(docs, 1000, 40_000, per_label) == [i for i in range(200) if i != first]


def test_models_learn_beside_a_long_text(spark):
    first = spark.range(400).orderBy(F.xxhash64(F.lit(17), "id")).first().id
    rows = [(i, ("you are a filthy idiot and a fool. " if i % 2 else "the garden was calm and the tea was warm. ") * 3, i % 2) for i in range(400)]
    rows[first] = (first, rows[first][1] * 2000, rows[first][2])
    docs = frame(spark, rows)
    size = 100 * max(len(t) for i, t, _ in rows if i != first)
    ids = docs.select("doc_id", "label")
    gam = quality.train(docs, ids, quality.GamConfig(sample_bytes=size))
    assert any(t.any() for t in gam.tables)
    mil = toxicity.train(docs, ids, toxicity.MilConfig(sample_bytes=size))
    scored = docs.select("label", toxicity.scorer(spark, mil)("text").alias("r")).select("label", "r.score").groupBy("label").agg(F.avg("score").alias("s"))
    by = {r.label: r.s for r in scored.collect()}
    assert by[1] > by[0] + 0.3


def test_smallest_of_each_label(spark):
    rows = [(i, "t", i % 3 if i < 3000 else 7) for i in range(9000)] + [(9001, "t", 9)]
    ids = frame(spark, rows).select("doc_id", "label")
    order = F.xxhash64(F.lit(17), "doc_id")
    got = sorted((r.label, r.doc_id) for r in C.smallest_of_each(ids, order, 50).collect())
    hashes = {r.doc_id: r.h for r in ids.select("doc_id", order.alias("h")).collect()}
    want = sorted((label, d) for label in {r[2] for r in rows} for d in sorted((r[0] for r in rows if r[2] == label), key=lambda d: (hashes[d], d))[:50])
    assert got == want
    plan = C.smallest_of_each(ids, order, 50)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("_last") and "Window" in plan
