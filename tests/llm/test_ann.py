"""One-bit codes: recall against brute force, bounds, edge cases."""

import numpy as np
import pytest

from ticketlab.llm import ann as A

INF, NAN = float("inf"), float("nan")


def brute(rows, queries, k):
    out = {}
    for q_id, q in queries:
        score = [(-sum(a * b for a, b in zip(x, q)), i) for i, x in rows if i != q_id and len(x) == len(q)]
        out[q_id] = [(i, -s) for s, i in sorted(score)[:k]]
    return out


def search(spark, rows, cfg=A.CodeConfig()):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, code string, norm int")
    index = A.index(df, cfg)
    out = {}
    for r in A.search(index, index.where("vec_id % 20 = 0"), cfg).orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(out[r.query_id])
    return out


def wide(rows):
    return [(i, x, 0, "c", 1) for i, x in rows]


def test_recall_on_clustered_vectors(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(30, 64))
    x = (centres[rng.integers(0, 30, 3000)] + 0.4 * rng.normal(size=(3000, 64))) * rng.uniform(0.5, 2, (3000, 1))
    x = x.astype(np.float32).astype(float)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got = search(spark, wide(rows), A.CodeConfig(row_block=700, query_block=40))
    hit = 0
    for q in range(0, 3000, 20):
        score = x @ x[q]
        score[q] = -np.inf
        want = np.lexsort((np.arange(3000), -score))[:20]
        hit += len(set(want) & {i for i, _ in got[q]})
        assert [s for _, s in got[q]] == pytest.approx([score[i] for i, _ in got[q]], rel=1e-12)
    assert hit / (150 * 20) > 0.99


def test_bounds_leave_most_rows_out():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(8000, 64)) + 2 * rng.normal(size=(40, 64))[rng.integers(0, 40, 8000)]
    cfg = A.CodeConfig()
    codes, norm, s = A.encode(x, cfg.bits, cfg.seed)
    _, reranked = A.search_block(np.arange(50), x[:50], np.arange(8000), x, codes, norm, s, cfg)
    assert reranked < 0.25 * 50 * 8000


def test_estimate_is_unbiased():
    rng = np.random.default_rng(3)
    x, q = rng.normal(size=(4000, 32)), rng.normal(size=32)
    codes, norm, s = A.encode(x, 256, 7)
    signs = np.unpackbits(codes, axis=1) * 2.0 - 1
    guess = (signs @ (q @ A.rotation(256, 7)[:32])) / np.sqrt(256) / s * norm
    assert abs(np.mean(guess - x @ q)) < 0.03 * np.std(x @ q) and np.corrcoef(guess, x @ q)[0, 1] > 0.9


def test_edge_cases(spark):
    rows = [(0, [1.0, 0.0]), (20, [0.0, 1.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [NAN, 1.0]), (6, [INF, 1.0]),
            (7, [None, 1.0]), (8, []), (9, [1.0, 2.0, 3.0]), (40, [1.0, 1.0, 1.0]), (None, [5.0, 5.0]), (60, None), (80, [0.0, 0.0]), (10, [-1.0, -1.0])]
    good = sorted({(i, tuple(x)) for i, x in rows if i in (0, 20, 1, 2, 9, 40, 10)})
    got = search(spark, wide(rows))
    assert got == brute(good, [r for r in good if r[0] % 20 == 0], 20)


def test_ties_and_copies(spark):
    rows = [(i, [1.0, 2.0]) for i in range(60)] + [(100, [2.0, 4.0])]
    assert search(spark, wide(rows)) == brute(rows, [r for r in rows if r[0] % 20 == 0], 20)


def test_empty_table(spark):
    assert search(spark, []) == {}


def test_query_recall_on_the_small_tables(spark):
    sf = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    got = {}
    for r in A.op7_codes(spark, sf).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    recall = []
    for i in np.flatnonzero(ids % 20 == 0):
        score = x @ x[i]
        score[i] = -np.inf
        recall.append(len(got[ids[i]] & set(ids[np.lexsort((ids, -score))[:20]].tolist())) / 20)
    assert np.mean(recall) > 0.99
