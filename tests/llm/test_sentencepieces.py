"""Chunk-wise ids against the library on whole texts."""

import random
from hashlib import sha256

import pyarrow as pa
import pytest
import sentencepiece

from ticketlab.llm import bytetext as B
from ticketlab.llm import sentencepieces as S

LIB = sentencepiece.SentencePieceProcessor(model_file=S.default_path())
TEXTS = ["", " ", "  ", "a ", "a  ", " a", "  a  b  ", "é", "\x00 \x00", "日本 語 😀", "\t \n x", "</s> <s> <unk> <0x41>", "a▁b", "▁", " ▁ a", "a" * 5000,
         "word " * 3000, " " * 700 + "x", "same words same words", "Zz  　 ﬁ ａ", None]


def random_texts(seed, n):
    r = random.Random(seed)
    return ["".join(r.choice("  ab\té日😀.1▁\n") for _ in range(r.randrange(0, 60))) for _ in range(n)]


def whole(text):
    return LIB.encode(text or "") + [LIB.eos_id()]


def lists(table, texts, size):
    out = []
    for s in B.slices(pa.array([(t or "").replace("▁", " ") for t in texts]), size):
        ids, at = table.slice(s)
        out += [ids[a:z].tolist() for a, z in zip(at[:-1], at[1:])]
    return out


@pytest.mark.parametrize("size", [1, 200, 1 << 20])
def test_slices_equal_whole_texts(size):
    table = S.ChunkIds(S.default_path())
    assert table.by_chunk
    texts = TEXTS + random_texts(size, 400)
    assert lists(table, texts, size) == [whole(t) for t in texts]
    assert lists(table, texts[::-1], size) == [whole(t) for t in texts[::-1]]     # from the kept table


def test_each_distinct_chunk_is_segmented_once():
    table = S.ChunkIds(S.default_path())
    seen = []
    segment = table._segment
    table._segment = lambda raws: (seen.extend(raws), segment(raws))[1]
    lists(table, ["the cat the cat  the", "cat the", "the"], 1 << 20)
    lists(table, ["cat dog"], 1 << 20)
    assert sorted(seen) == [b" the", b"cat", b"dog", b"the"]


def test_a_full_table_still_gives_every_id(monkeypatch):
    monkeypatch.setattr(S, "KEPT", 3)
    table = S.ChunkIds(S.default_path())
    texts = random_texts(5, 300)
    assert lists(table, texts, 500) == [whole(t) for t in texts]
    assert len(table.kept) == 3


def test_a_model_without_chunks_takes_whole_texts():
    table = S.ChunkIds(S.default_path())
    table.by_chunk = False
    assert lists(table, TEXTS, 300) == [whole(t) for t in TEXTS]


def test_round_trip_columns(spark):
    rows = [(i, t, "mine", "also") for i, t in enumerate(TEXTS + ["twice", "twice"])]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string, decoded string")
    got = S.decode(S.encode(df, out="i"), "i", "d").orderBy("doc_id").collect()
    for r in got:
        assert r.i == whole(r.text) and r.d == LIB.decode(whole(r.text)) and (r.ids, r.decoded) == ("mine", "also")
    none = spark.createDataFrame([(None,), ([],), ([2],), ([259, 2, 0, 5],)], "ids array<int>")
    assert [r.decoded for r in S.decode(none).collect()] == [None, "", "", LIB.decode([259, 2, 0, 5])]


def test_query_equals_the_library(spark, tmp_path):
    texts = TEXTS + random_texts(9, 100) + ["x y" * 100_000]
    rows = [(i // 2, t, "mine", 1) for i, t in enumerate(texts)] + [(None, "no id", "x", 2)]
    spark.createDataFrame(rows, "doc_id long, text string, ids string, n_tokens long").write.parquet(str(tmp_path / "documents.parquet"))
    got = S.op12_sentencepiece(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    want = [(d, len(whole(t)), sha256(" ".join(map(str, whole(t))).encode()).hexdigest(), sha256(LIB.decode(whole(t)).encode()).hexdigest())
            for d, t, *_ in rows]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert S.op12_sentencepiece(spark, str(tmp_path)).collect() == []
