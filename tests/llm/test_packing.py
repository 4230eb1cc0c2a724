"""Packing: exactness of the pieces, little padding, the linear program."""

import itertools
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from ticketlab.llm import packing as P
from ticketlab.llm import tokens as T


def check(rows, got, length=2048):
    """Every id in exactly one piece, sequences gapless; the share of padding."""
    encode = T.piece_ids(T.default_path()).tokenizer.encode
    want = Counter()
    for d, t in rows:
        ids = encode(t or "", add_special_tokens=False).ids + [T.END_ID]
        want[(d, len(ids), np.array(ids, "<u4").tobytes())] += 1
    pieces = defaultdict(list)
    for r in got:
        pieces[(r.doc_id, r.doc_tokens)].append(r)
    for d, total, raw in want.elements():
        own = pieces[(d, total)]
        for start in range(0, total, length):
            size = min(length, total - start)
            crc = zlib.crc32(raw[4 * start: 4 * (start + size)])
            own.remove(next(r for r in own if (r.start, r["length"], r.ids_crc32) == (start, size, crc)))
    assert not any(pieces.values())
    used, sequences = 0, defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r["length"]))
    padding = 0
    for s in sequences.values():
        at = 0
        for offset, size in sorted(s):
            assert offset == at
            at += size
        assert at <= length
        padding += 0 if at & (at - 1) == 0 else length - at
        used += at
    assert sorted(sequences) == list(range(len(sequences)))
    return padding / max(used, 1)


def pack(spark, rows, **kw):
    return P.pack(spark.createDataFrame(rows, "doc_id long, text string, rank string, bar int, sequence_id int"), P.PackConfig(**kw)).collect()


def wide(rows):
    return [(d, t, "x", 1, 2) for d, t in rows]


def test_small_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = P.op6_cutting_stock(spark, "/root/testdata/sf0.01").collect()
    assert check([(r.doc_id, r.text) for r in docs.collect()], got) < 0.01


def test_edge_cases(spark):
    rows = [(1, None), (2, ""), (3, "a"), (3, "a"), (None, "b c"), (None, None), (4, "word " * 2047), (5, "word " * 2048), (6, "word " * 30_000), (7, " \n ")]
    check(rows, pack(spark, wide(rows)))


def test_empty_table(spark):
    assert pack(spark, []) == []


def test_many_rests(spark):
    rng = np.random.default_rng(4)
    rows = [(i, "word " * int(n)) for i, n in enumerate(rng.integers(1, 600, 400))]
    assert check(rows, pack(spark, wide(rows), unit=8)) < 0.02


def test_knapsack_is_exact():
    rng = np.random.default_rng(2)
    for _ in range(20):
        sizes = np.sort(rng.choice(np.arange(2, 14), 4, replace=False))
        value = rng.random(4)
        best = max(sum(v * a for v, a in zip(value, n)) for n in itertools.product(range(13), repeat=4) if sum(s * a for s, a in zip(sizes, n)) <= 24)
        worth, items = P.best_pattern(value, sizes, 24)
        assert worth == pytest.approx(best) == pytest.approx(sum(value[i] * a for i, a in items.items()))
        assert sum(sizes[i] * a for i, a in items.items()) <= 24


def test_linear_program_reaches_the_bound():
    """Sizes 60, 40 and 50 fill a capacity of 100 without waste."""
    sizes, counts = np.array([40, 50, 60]), np.array([300.0, 200.0, 300.0])
    basis = P.solve(sizes, counts, 100, P.PackConfig(gap=0))
    assert sum(x for x, _ in basis) == pytest.approx(400)
    held = np.zeros(3)
    for x, pattern in basis:
        for i, a in pattern.items():
            held[i] += x * a
    assert held == pytest.approx(counts)


def test_plan_holds_every_rest_once():
    rng = np.random.default_rng(6)
    histogram = {int(s): int(n) for s, n in zip(rng.choice(np.arange(1, 201), 150, replace=False), rng.integers(1, 500, 150))}
    held = Counter()
    patterns = P.plan(histogram, P.PackConfig())
    for times, pattern in patterns:
        assert sum(s * a for s, a in pattern.items()) <= 512
        for s, a in pattern.items():
            held[s] += times * a
    assert held == Counter(histogram)
    bound = sum(s * n for s, n in histogram.items()) / 512
    assert sum(t for t, _ in patterns) <= 1.01 * bound + 2
