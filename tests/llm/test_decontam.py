"""Template matches on planted passages."""

import random

import pytest

from ticketlab.llm import decontam as D

ITEM = "A train leaves Paris at 9 and travels 120 km in 2 hours. Then Alice waits 2 hours before she travels another 60 km to Rome by bus."
SWAP = "A train leaves Oslo at 7 and travels 300 km in 5 hours. Then Bob waits 5 hours before she travels another 90 km to Bergen by bus."
CLASH = "A train leaves Oslo at 7 and travels 300 km in 5 hours. Then Bob waits 4 hours before she travels another 300 km to Bergen by bus."
FILL = "some quite ordinary filler sentence that has nothing to do with any exam at all"


def run(spark, docs, items, cfg=D.DecontamConfig()):
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    return sorted(((r.doc_id, r.item_id, r.kind, r.contaminated) for r in D.matches(d, b, cfg).collect()), key=str)


def test_kinds(spark):
    docs = [(1, f"{FILL}. {ITEM} {FILL}"), (2, f"{FILL}\n{SWAP}\n{FILL}"), (3, f"{FILL}. {CLASH}"), (4, FILL), (5, ITEM.replace(" ", "  ").replace(".", " ,;.\n")),
            (6, ITEM[: len(ITEM) // 2])]
    assert run(spark, docs, [(7, ITEM), (8, "nothing like it at all is in these documents here my friend")]) == [
        (1, 7, "exact", True), (2, 7, "reparameterised", True), (3, 7, "template", False), (5, 7, "exact", True), (6, 7, "exact", True)]


def test_thirteen_tokens_of_a_long_item_are_a_leak(spark):
    rng = random.Random(2)
    long = " ".join(f"z{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in rng.sample(range(600), 120))
    words = long.split()
    docs = [(1, FILL + " " + " ".join(words[40:53])), (2, FILL + " " + " ".join(words[40:52]))]
    assert run(spark, docs, [(7, long)]) == [(1, 7, "exact", True), (2, 7, "exact", False)]


def test_a_variant_does_not_hide_a_later_copy(spark):
    """A contradicting variant comes first, with as many windows or more."""
    docs = [(1, f"{CLASH}\n{FILL}\n{ITEM}"), (2, f"{CLASH}\n{SWAP}"), (3, f"{CLASH}\n{FILL}\n{ITEM[:80]}"), (4, f"{CLASH}\n{CLASH}")]
    assert run(spark, docs, [(7, ITEM)]) == [(1, 7, "exact", True), (2, 7, "reparameterised", True), (3, 7, "exact", True), (4, 7, "template", False)]


def test_short_items(spark):
    """One window whose first word stands after a colon; fewer tokens as whole sequences."""
    docs = [(1, f"{FILL}. Q: What is the capital of France? A: Paris"), (2, f"{FILL} (Who is the capital of France?)"), (3, "Q: Why do cats purr? A: ..."),
            (4, "I ask why do cats purr?"), (5, "why do cats purr"), (6, "Why do cats purr so?"), (7, "2) What is the capital of Spain?"),
            (8, f"{FILL}. What is the capital of France?"), (9, "Q: 7 times 8? Q: 7 times 9?")]
    items = [(1, "What is the capital of France?"), (2, "Why do cats purr?"), (3, "7 times 9?")]
    assert run(spark, docs, items) == [(1, 1, "exact", True), (3, 2, "exact", True), (5, 2, "exact", True), (7, 1, "reparameterised", True),
                                       (8, 1, "exact", True), (9, 3, "exact", True)]


def test_names_of_other_lengths(spark):
    """Names of one, two and three words for each other."""
    item = "A courier rides from Rome to Paris in 3 days and then from Paris to Milan in 2 days while Anna waits at home for news."
    swap = "A courier rides from New York to San Diego in 5 days and then from San Diego to Las Vegas in 4 days while Mary Jane Smith waits at home for news."
    clash = swap.replace("then from San Diego", "then from New Orleans")
    assert run(spark, [(1, f"{FILL}. {swap}"), (2, clash), (3, item)], [(7, item)]) == [
        (1, 7, "reparameterised", True), (2, 7, "template", False), (3, 7, "exact", True)]


def test_names_that_open_sentences(spark):
    item = "Carol sold 5 pens. Dave sold 7 more pens. Carol gave 2 pens to Dave. How many pens did Dave have?"
    swap = "Erin sold 6 pens. Frank sold 9 more pens. Erin gave 3 pens to Frank. How many pens did Frank have?"
    clash = "Erin sold 6 pens. Frank sold 9 more pens. George gave 3 pens to Frank. How many pens did Frank have?"
    assert run(spark, [(1, f"{FILL}. {swap} {FILL}"), (2, f"{FILL}. {clash}"), (3, item)], [(7, item)]) == [
        (1, 7, "reparameterised", True), (2, 7, "template", False), (3, 7, "exact", True)]


def test_copies_in_small_letters(spark):
    short = "Carol met Dave in Rome at noon."
    docs = [(1, f"{FILL}. {ITEM.lower()}"), (2, SWAP.lower()), (3, f"{FILL} {short.lower()}"), (4, ITEM.lower().replace("120", "77"))]
    got = run(spark, docs, [(7, ITEM), (8, short)])
    assert (1, 7, "exact", True) in got and (3, 8, "exact", True) in got and (4, 7, "reparameterised", True) in got
    assert not any(r[0] == 2 and r[2] == "exact" for r in got)     # other names are other words there


def test_items_of_little_but_names(spark):
    item = "Did Mary Jane Smith marry John Paul Jones?"
    docs = [(1, f"{FILL}. {item} {FILL}"), (2, f"{FILL}. Did Anna Bell marry Carl Dean?"), (3, item.lower())]
    assert run(spark, docs, [(7, item)]) == [(1, 7, "exact", True), (3, 7, "exact", True)]


def test_pipeline_stage_drops_them(spark):
    item = "Carol sold 5 pens in Rome. Dave sold 7 more pens in Oslo. How many pens did both of them sell in a day?"
    swap = "Erin sold 6 pens in New York. Frank sold 9 more pens in Las Vegas. How many pens did both of them sell in a day?"
    docs = spark.createDataFrame([(1, swap), (2, item.lower()), (3, FILL)], "doc_id long, text string")
    kept = D.decontaminate(docs, spark.createDataFrame([(7, item)], "item_id long, text string"))
    assert [r.doc_id for r in kept.collect()] == [3]


def test_edge_cases(spark):
    docs = [(1, None), (2, ""), (3, "...!!!\n"), (None, f"{FILL} {ITEM}"), (4, ITEM), (4, ITEM), (4, FILL), (5, "one two three four five six seven"),
            (6, "word " * 20_000 + ITEM)]
    items = [(1, ITEM), (1, ITEM), (None, FILL), (3, None), (4, ""), (5, "one two three four"), (6, "two three four five six seven")]
    got = run(spark, docs, items)
    assert (4, 1, "exact", True) in got and (6, 1, "exact", True) in got and (None, 1, "exact", True) in got
    assert (4, None, "exact", True) in got and (None, None, "exact", True) in got
    assert (5, 6, "exact", True) in got and not any(r[1] == 5 for r in got)


@pytest.mark.parametrize("docs, items", [([], [(1, ITEM)]), ([(1, ITEM)], []), ([], [])])
def test_empty_tables(spark, docs, items):
    assert run(spark, docs, items) == []


def test_equals_brute_force_on_plain_words(spark):
    """Without slots a match is a shared run of eight words."""
    rng = random.Random(5)
    vocab = [f"q{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(150)]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randrange(10, 30)))) for i in range(12)]
    docs = []
    for i in range(60):
        w = [rng.choice(vocab) for _ in range(40)]
        if i % 3 == 0:
            own = items[rng.randrange(12)][1].split()
            at, n = rng.randrange(len(own) - 7), rng.randrange(6, 30)
            w[10:10] = own[at: at + n]
        docs.append((i, " ".join(w)))

    def runs(t):
        w = t.split()
        return {tuple(w[i:i + 8]) for i in range(len(w) - 7)}
    want = sorted((d, i) for d, t in docs for i, b in items if runs(t) & runs(b))
    assert want and sorted(r[:2] for r in run(spark, docs, items)) == want


def test_decontaminate_keeps_clean_rows_and_columns(spark):
    docs = spark.createDataFrame([(1, ITEM, "a"), (1, FILL, "b"), (2, None, "c"), (3, CLASH, "d")], "doc_id long, text string, _k string")
    bench = spark.createDataFrame([(7, ITEM)], "item_id long, text string")
    got = D.decontaminate(docs, bench)
    assert got.columns == docs.columns and sorted(r["_k"] for r in got.collect()) == ["b", "c", "d"]


def test_plan_has_no_python(spark):
    docs = spark.createDataFrame([(1, ITEM)], "doc_id long, text string")
    bench = spark.createDataFrame([(7, ITEM)], "item_id long, text string")
    plan = D.matches(docs, bench)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
