"""Language spans: Viterbi against the plain recursion, scripts, edge cases."""

import numpy as np
import pyarrow as pa
import pytest

from ticketlab.llm import langid as G
from ticketlab.llm.common import training_sample

CFG = G.LangConfig()
EN = "the quick brown fox jumps over the lazy dog while they think about nothing with that thing"
DE = "der schnelle braune fuchs springt über den faulen hund und schläft dann zwischen bäumen ein"
RU = "быстрая коричневая лиса прыгает через ленивую собаку и потом спит"
SR = "брза лисица прескаче преко лењог пса љубав њива"


def best(scores, switch):
    value = scores[0].copy()
    for s in scores[1:]:
        value = np.maximum(value, value.max() - switch) + s
    return value.max()


def worth(scores, path, switch):
    return scores[np.arange(len(path)), path].sum() - switch * (path[1:] != path[:-1]).sum()


@pytest.mark.parametrize("block", [1, 7, 64, 1000])
@pytest.mark.parametrize("k", [1, 2, 5])
def test_viterbi_is_optimal(block, k):
    scores = np.random.default_rng(block + k).normal(size=(903, k)) * 3
    first = np.array([0, 0, 1, 8, 8, 400, 903, 903])
    path = G.viterbi(scores, first, 4.0, block)
    for a, z in zip(first[:-1], first[1:]):
        if z > a:
            assert worth(scores[a:z], path[a:z], 4.0) == pytest.approx(best(scores[a:z], 4.0))


def test_no_words():
    assert len(G.viterbi(np.zeros((0, 3)), np.array([0, 0]), 1.0, 8)) == 0


@pytest.fixture(scope="module")
def model():
    texts = [EN, DE, RU, SR] * 5
    return G.fit(pa.array(texts), ["en", "de", "ru", "sr"] * 5)


def test_scripts_narrow_the_languages(model):
    latin, cyrillic = model.allowed[G.SCRIPTS.index("latin")], model.allowed[G.SCRIPTS.index("cyrillic")]
    assert model.langs == ["de", "en", "ru", "sr"]
    assert latin.tolist() == [True, True, False, False] and cyrillic.tolist() == [False, False, True, True]
    assert model.allowed[G.SCRIPTS.index("thai")].all()


def test_spans_of_mixed_text(spark, model):
    text = f"{EN}. {DE}. 12 {RU}!"
    got = spark.createDataFrame([(text,)], "text string").select(G.identifier(spark, model)("text").alias("f")).first().f
    raw = text.encode()
    assert [s.lang for s in got.spans] == ["en", "de", "ru"]
    assert raw[got.spans[0].start:got.spans[0].end].decode() == EN and raw[got.spans[2].start:got.spans[2].end].decode() == RU
    assert got.lang == "ru"   # most bytes
    assert 0 < got.score < 1


def documents(spark, tmp_path, rows):
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    return {(r.doc_id, i): r for i, r in enumerate(G.op9_viterbi(spark, str(tmp_path)).collect())}


def test_edge_cases(spark, tmp_path):
    rows = [(i, (EN, DE)[i % 2], ("en", "de")[i % 2], None) for i in range(40)]
    rows += [(50, None, "en", "s"), (51, "", None, "s"), (52, "123 !? ...", "de", "s"), (None, EN, None, None), (53, "。、 “”", "en", "s"),
             (54, f"{EN}. " * 4000, None, None), (54, f"{EN}. " * 4000, None, None)]
    got = list(documents(spark, tmp_path, rows).values())
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert len(got) == len(rows)
    assert [by[d][0].lang_pred for d in (50, 51, 52, 53)] == ["und"] * 4 and [by[d][0].score for d in (50, 51, 52, 53)] == [0] * 4
    assert by[None][0].lang_pred == "en" and [r.lang_pred for r in by[54]] == ["en", "en"]
    assert all(by[i][0].lang_pred == ("en", "de")[i % 2] for i in range(40))


@pytest.mark.parametrize("rows", [[], [(1, "some text", None, None)]])
def test_nothing_to_learn_from(spark, tmp_path, rows):
    got = documents(spark, tmp_path, rows)
    assert [r.lang_pred for r in got.values()] == ["und"] * len(rows)


def test_the_byte_bound_keeps_a_rare_language(spark):
    """Rows of two common languages fill the bound many times; one is 1000 times rarer."""
    docs = spark.range(12_006).selectExpr("id AS doc_id", "repeat('x', 100) AS text",
                                          "CASE WHEN id < 6 THEN 'rare' WHEN id % 2 = 0 THEN 'a' ELSE 'b' END AS label")
    got = training_sample(docs.select("doc_id", "text"), docs.select("doc_id", "label"), 3000, 100_000, per_label=True)
    n = {r["label"]: r["count"] for r in got.groupBy("label").count().collect()}
    assert n == {"rare": 6, "a": 497, "b": 497}


def test_query_on_the_small_tables(spark):
    sf = "/root/testdata/sf0.01"
    got = G.op9_viterbi(spark, sf).collect()
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    held = [r for r in got if r.held_out]
    assert len(got) == len(lang) and np.mean([r.lang_pred == lang[r.doc_id] for r in held]) > 0.97
