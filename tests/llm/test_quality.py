"""The additive model: its parts by hand, held-out accuracy, edge cases."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ticketlab.llm import bytetext as B
from ticketlab.llm import quality as Q


def features(*texts):
    return np.concatenate([Q.features(s) for s in B.slices(pa.array(list(texts), pa.string()))])


def test_features_by_hand():
    f = dict(zip(Q.FEATURES, features("AB cd! 12\nAB cd! 12\ncd | é.")[0]))
    n = len("AB cd! 12\nAB cd! 12\ncd | é.".encode())
    assert f["log_words"] == pytest.approx(np.log1p(9)) and f["log_bytes"] == pytest.approx(np.log1p(n))
    assert f["upper"] == 4 / n and f["digit"] == 4 / n and f["marks"] == 2 / n and f["non_ascii"] == 2 / n
    assert f["repeated_lines"] == pytest.approx(1 / 3) and f["distinct_words"] == pytest.approx(6 / 9) and f["bars"] == pytest.approx(1 / 9)


def test_features_do_not_depend_on_the_neighbours():
    texts = ["one two three one two three", "", "x y", None, "one two three"]
    assert np.array_equal(features(*texts), np.concatenate([features(t) for t in texts]))


def test_learns_curves_and_an_interaction():
    rng = np.random.default_rng(3)
    x = rng.random((6000, len(Q.FEATURES)))
    z = 4 * np.abs(x[:, 0] - 0.5) - 1 + 6 * ((x[:, 1] > 0.5) ^ (x[:, 2] > 0.5)) - 3
    y = (rng.random(6000) < 1 / (1 + np.exp(-3 * z))).astype(float)
    m = Q.fit(x[:4000], y[:4000])
    assert {(2, 1)} <= {(i, j) for i, j, _ in m.pairs}
    assert np.mean((m.score(x[4000:]) >= 0.5) == (y[4000:] > 0)) > 0.9


def test_score_is_the_sum_of_the_tables():
    rng = np.random.default_rng(4)
    x = rng.random((500, len(Q.FEATURES)))
    m = Q.fit(x, (x[:, 0] + x[:, 3] * x[:, 4] > 0.7).astype(float))
    for row, got in zip(x[:20], m.score(x[:20])):
        z = m.intercept + sum(t[sum(v >= c for c in cuts)] for v, cuts, t in zip(row, m.cuts, m.tables))
        z += sum(t[sum(row[i] >= c for c in m.pair_cuts[i]), sum(row[j] >= c for c in m.pair_cuts[j])] for i, j, t in m.pairs)
        assert got == pytest.approx(1 / (1 + np.exp(-z)))


@pytest.mark.parametrize("labels, want", [([], 0.5), ([(1, 1), (2, 1)], 2.5 / 3), ([(None, 0), (1, None)], 0.5)])
def test_without_both_labels(spark, labels, want):
    docs = spark.createDataFrame([(1, "a b"), (2, "c d"), (3, None)], "doc_id long, text string")
    table = spark.createDataFrame(labels, "doc_id long, quality int")
    ids = Q.label_table(table, "quality")
    assert [r[0] for r in docs.select(Q.scorer(spark, Q.train(docs, ids))("text")).collect()] == pytest.approx([want] * 3)
    assert Q.drop_low(spark, docs, table).count() == 3


def test_edge_cases(spark):
    rows = [(i, "plain words in a row. " * 5 if i % 2 else "#$% &*( !!! ||| " * 5) for i in range(200)]
    rows += [(300, None), (301, ""), (302, " "), (None, "plain words"), (303, "x" * 200_000), (303, "x" * 200_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("_quality", F.lit(1)).withColumn("label", F.lit("z"))
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, quality int")
    score = [r[0] for r in docs.select(Q.learned(spark, docs, labels)("text")).collect()]
    assert all(0 <= s <= 1 for s in score) and score[1] > 0.9 and score[0] < 0.1
    assert score[200] == score[201] and score[204] == score[205]
    kept = Q.drop_low(spark, docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect() if r.doc_id is not None and r.doc_id < 200} == set(range(1, 200, 2))
    assert Q.drop_low(spark, docs.limit(0), labels).collect() == []


def test_query_on_the_small_tables(spark):
    sf = "/root/testdata/sf0.01"
    got = Q.op5_gam(spark, sf).collect()
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = [r for r in got if r.held_out and r.doc_id in labels]
    assert np.mean([r.predicted == labels[r.doc_id] for r in held]) > 0.95
