"""Rendezvous shards against a plain computation of the same hash scores."""

import math
import struct
import zlib

import xxhash

from ticketlab.llm import sharding as S


def score(key, shard, weight):
    h = xxhash.xxh64(struct.pack("<q", key), seed=42).intdigest() if key is not None else 42
    h = xxhash.xxh64(struct.pack("<i", shard), seed=h).intdigest()
    return -weight / math.log(((h >> 11) + 0.5) / 2 ** 53)


def brute(key, weights):
    return max((score(key, s, w), s) for s, w in enumerate(weights) if w > 0)[1]


def shards(spark, keys, weights):
    df = spark.createDataFrame([(k,) for k in keys], "doc_id long")
    return [r[1] for r in S.place(df, ["doc_id"], weights).collect()]


def test_equals_brute_force(spark):
    keys = [None, -1, 0, *range(1, 400), 2 ** 62]
    for weights in ([1.0] * 8, [1.0, 0.0, 3.0]):
        assert shards(spark, keys, weights) == [brute(k, weights) for k in keys]


def test_weights_give_shares(spark):
    got = shards(spark, range(20_000), [1.0, 2.0, 5.0])
    for s, share in enumerate((1 / 8, 2 / 8, 5 / 8)):
        assert abs(got.count(s) / 20_000 - share) < 0.02


def test_growing_moves_rows_only_into_the_new_shard(spark):
    a, b = shards(spark, range(5000), [1.0] * 8), shards(spark, range(5000), [1.0] * 9)
    moved = [(x, y) for x, y in zip(a, b) if x != y]
    assert {y for _, y in moved} == {8} and abs(len(moved) / 5000 - 1 / 9) < 0.03


def test_query(spark, tmp_path):
    rows = [(i, f"text é {i % 7}") for i in range(300)] + [(5, "again"), (5, "again"), (None, None), (7, ""), (8, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = S.op8_rendezvous(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r.slot)
        assert r.shard == brute(r.doc_id, [1.0] * 8) and r.grown_shard in (r.shard, 8) and r.law == "key"
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    want = sorted(((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows), key=str)
    assert sorted(((r.doc_id, r["size"], r.text_crc32) for r in got), key=str) == want


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, shard string").write.parquet(f"{tmp_path}/documents.parquet")
    assert S.op8_rendezvous(spark, str(tmp_path)).collect() == []


def test_plan_has_no_python(spark, tmp_path):
    spark.createDataFrame([(1, "a")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    plan = S.op8_rendezvous(spark, str(tmp_path))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_write_shards(spark, tmp_path):
    df = spark.createDataFrame([(i, str(i)) for i in range(50)], "doc_id long, text string")
    S.write_shards(df, ["doc_id"], [1.0] * 3, f"{tmp_path}/out")
    back = spark.read.parquet(f"{tmp_path}/out")
    assert sorted((r.doc_id, r.shard) for r in back.collect()) == [(i, brute(i, [1.0] * 3)) for i in range(50)]
