"""Noisy-or learning from document labels: held-out accuracy and edge cases."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ticketlab.llm import bytetext as B
from ticketlab.llm import toxicity as X

BAD = ["blorg", "snarf", "grumtz"]


def corpus(n, seed):
    """Clean prose; a toxic document has one bad word in one sentence."""
    rng = np.random.default_rng(seed)
    vocab = [f"word{i}" for i in range(300)]
    rows = []
    for i in range(n):
        sentences = [[vocab[j] for j in rng.integers(0, 300, rng.integers(4, 12))] for _ in range(rng.integers(1, 8))]
        toxic = int(rng.random() < 0.3)
        if toxic:
            s = sentences[rng.integers(0, len(sentences))]
            s.insert(int(rng.integers(0, len(s) + 1)), BAD[rng.integers(0, 3)] + ("x" if rng.random() < 0.3 else ""))
        rows.append((i, ". ".join(" ".join(s) for s in sentences), toxic))
    return rows


@pytest.fixture(scope="module")
def model(spark):
    rows = corpus(1500, 1)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    ids = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, label int")
    return X.train(docs, ids)


def test_held_out_accuracy_and_located_sentences(spark, model):
    rows = corpus(400, 2)
    score = X.scorer(spark, model)
    got = spark.createDataFrame(rows, "doc_id long, text string, toxic int").select("*", score("text").alias("t")).collect()
    wrong = sum((r.t.score >= 0.5) != bool(r.toxic) for r in got)
    assert wrong <= 8
    for r in got:
        spans = [r.text.encode()[o.start:o.end].decode() for o in r.t.offending]
        if r.toxic and r.t.score >= 0.9:
            assert len(spans) == 1 and any(b in spans[0] for b in BAD) and "." not in spans[0]


def test_score_is_the_noisy_or_of_the_sentences(spark, model):
    weights, b, leak = model
    cfg = X.MilConfig()
    text = "word1 blorg word2! word3 word4? Snarf word5\nword6. ... word7"
    g = X.bags(next(iter(B.slices(pa.array([text])))), cfg)
    assert len(g.doc) == 5
    p = []
    for a, e in zip(g.first[:-1], g.first[1:]):
        w = weights[g.words[a:e]].astype(float)
        p.append(1 / (1 + np.exp(-b - w.sum())) if (w != 0).any() else 0.0)
    assert p[0] > 0.5 and p[2] > 0.5 and p[1] == 0
    p = np.array(p)
    got = spark.createDataFrame([(text,)], "text string").select(X.scorer(spark, model, at_least=0.0)("text").alias("t")).first().t
    assert got.score == pytest.approx(1 - np.prod(1 - p) / (1 + np.exp(leak)), rel=1e-6) and [o.score for o in got.offending] == pytest.approx(list(p), rel=1e-6)
    assert text.encode()[got.offending[2].start:got.offending[2].end] == b"Snarf word5"


def test_edge_cases(spark, model):
    long = "word1 word2. " * 30_000 + "blorg"
    rows = [(1, None), (2, ""), (3, "...!?\n"), (None, "word1"), (5, long), (5, long), (6, "word1 word2. " * 30_000)]
    got = spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", X.scorer(spark, model)("text").alias("t")).collect()
    assert [r.t.score for r in got[:3]] == pytest.approx([1 / (1 + np.exp(-model[2]))] * 3) and [r.t.n_sentences for r in got[:3]] == [0, 0, 0]
    assert got[4].t.score == got[5].t.score > 0.9 and got[6].t.score < 0.1


@pytest.mark.parametrize("labels", [[], [(1, 0), (2, 0)], [(None, 1), (3, None)]])
def test_without_both_labels_nothing_is_toxic(spark, labels):
    docs = spark.createDataFrame([(1, "a b"), (2, "c d")], "doc_id long, text string")
    out = X.drop_toxic(spark, docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert out.count() == 2


def test_empty_table_and_clashing_names(spark):
    labels = spark.createDataFrame([(1, 1)], "doc_id long, toxic int")
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert X.drop_toxic(spark, docs, labels).collect() == []
    docs = spark.createDataFrame([(1, "a", 5, "t")], "doc_id long, text string, _toxicity int, label string").withColumn("score", F.lit(1))
    out = X.drop_toxic(spark, docs, labels)
    assert out.columns == docs.columns and out.count() == 1


def test_conflicting_labels_take_the_largest(spark):
    from ticketlab.llm.common import label_table
    t = label_table(spark.createDataFrame([(1, 0), (1, 1), (2, 0), (2, None), (None, 1)], "doc_id long, toxic int"), "toxic")
    assert sorted(map(tuple, t.collect())) == [(1, 1), (2, 0)]


def test_query_on_the_small_tables(spark):
    sf = "/root/testdata/sf0.01"
    got = X.op2_mil(spark, sf).collect()
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = [r for r in got if r.held_out and r.doc_id in labels]
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert sum(r.predicted and not labels[r.doc_id] for r in held) <= 1
    assert np.mean([r.predicted == labels[r.doc_id] for r in held]) > 0.95
