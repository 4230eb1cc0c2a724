"""Near duplicates against brute force over full shingle sets."""

import random
import re

import pytest
from pyspark.sql import functions as F

from ticketlab.llm import minhash as M

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, k):
    w = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i:i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)])


def brute(rows, k, num, den):
    """(doc_id, n_shingles, component_id, kept) of each row."""
    sets = [shingles(t, k) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i
    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and den * len(a & b) >= num * len(a | b):
                parent[find(i)] = find(j)
    out = []
    for i, (d, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None] if sets[i] else [d]
        comp = min(ids) if ids and ids[0] is not None else None
        out.append((d, len(sets[i]), comp, d == comp))
    return sorted(out, key=str)


def corpus(seed):
    """Families of edited copies at similarities around the threshold, exact
    copies, shared passages and strangers."""
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    rows, next_id = [], iter(range(1000, 10_000))
    passage = [rng.choice(vocab) for _ in range(40)]
    for _ in range(12):
        base = [rng.choice(vocab) for _ in range(rng.randrange(20, 160))]
        for _ in range(rng.randrange(1, 7)):
            w = list(base)
            for _ in range(rng.randrange(0, 1 + len(w) // 25)):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            rows.append((next(next_id), " ".join(w)))
    for _ in range(8):
        rows.append((next(next_id), " ".join(passage + [rng.choice(vocab) for _ in range(rng.randrange(3, 30))])))
    rows += [(next(next_id), rows[0][1].upper().replace(" ", "\n")) for _ in range(5)]
    rng.shuffle(rows)
    return rows


def found(spark, rows, cfg):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = M.near_duplicates(docs, cfg).select("doc_id", "n_shingles", "component_id", "kept").collect()
    return sorted(map(tuple, got), key=str)


@pytest.mark.parametrize("seed, cfg", [
    (1, M.MinHashConfig()), (2, M.MinHashConfig(hot_bucket=2)), (3, M.MinHashConfig(shingle=5, num=80, bands=30, rows=4, slack=0.075)),
    (4, M.MinHashConfig(bits=2, hashes=512)),
])
def test_equals_brute_force(spark, seed, cfg):
    rows = corpus(seed)
    assert found(spark, rows, cfg) == brute(rows, cfg.shingle, cfg.num, cfg.den)


EDGES = [(5, None), (4, ""), (3, " \n\t"), (2, "one"), (9, "ONE"), (1, "one two"), (7, "two one"), (8, "a b c"), (8, "a b c"), (None, "a b c"),
         (None, None), (None, "alone here now too"), (6, "x " * 30_000), (10, "x " * 29_999)]


def test_edge_cases(spark):
    assert found(spark, EDGES, M.MinHashConfig()) == brute(EDGES, 3, 85, 100)


def test_empty_table(spark):
    assert found(spark, [], M.MinHashConfig()) == []


def test_chain_reaches_across(spark):
    """a~b and b~c but not a~c: one component."""
    w = [f"t{i}" for i in range(100)]
    b = " ".join(w)
    a, c = " ".join(w[:95]), " ".join(w[9:])
    rows = [(3, a), (2, b), (1, c)]
    assert {r[2] for r in found(spark, rows, M.MinHashConfig())} == {1} == {r[2] for r in brute(rows, 3, 85, 100)}


def test_estimate_is_unbiased(spark):
    a, b = [f"w{i}" for i in range(1000)], [f"w{i}" for i in range(200, 1200)]
    for bits, hashes in ((1, 1536), (2, 1024), (4, 512)):
        cfg = M.MinHashConfig(shingle=1, bits=bits, hashes=hashes)
        rows = spark.createDataFrame([(" ".join(a), " ".join(b))], "x string, y string")
        sig = M.signature_udf(cfg)
        got = rows.select(sig("x")["sig"].alias("p"), sig("y")["sig"].alias("q")).select(M.estimate(cfg, "p", "q")).first()[0]
        assert abs(got - 800 / 1200) < 0.1


def test_keep_one_keeps_columns_and_one_row_a_group(spark):
    rows = [(1, "a b c d e f", "x"), (2, "A b c d e f", "y"), (1, "a b c d e f", "z"), (3, None, "n"), (3, None, "n"), (4, "other words are here now", "o"),
            (1, "a  b c d e f", "w")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string").withColumn("_k", F.lit(1)).withColumn("component_id", F.lit("c"))
    got = M.keep_one(docs)
    assert got.columns == docs.columns
    out = [tuple(r)[:2] for r in got.collect()]
    assert sorted(d for d, _ in out if d in (1, 2)) == [1]
    assert sorted(out, key=str)[-3:] == sorted([(3, None), (3, None), (4, "other words are here now")], key=str)
