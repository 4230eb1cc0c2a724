"""Merkle manifest against a plain recursion in Python."""

import zlib
from hashlib import sha256

import pytest

from ticketlab.llm import merkle as M

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, tree string, pos long, node string"


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def plain_levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i: i + 2]) for i in range(0, len(out[-1]), 2)])
    return out


def siblings(levels, at):
    """(side, digest) or None for each level, from the leaf up."""
    out = []
    for nodes in levels[:-1]:
        other = at ^ 1
        out.append((("L" if at % 2 else "R") + nodes[other]) if other < len(nodes) else "")
        at //= 2
    return out


def climb(node, proof):
    for s in proof:
        node = h(s[1:], node) if s[:1] == "L" else h(node, s[1:])
    return node


def brute(rows):
    trees = {}
    for doc_id, text, lang, source, n_chars, *_ in rows:
        leaf = h(*map(field, (doc_id, source, lang, n_chars, text)))
        other = leaf
        if doc_id is not None and n_chars is not None and zlib.crc32(str(doc_id).encode()) % 7 == 0:
            other = h(*map(field, (doc_id, source, lang, n_chars + 1, text)))
        trees.setdefault("n" if lang is None else "v" + lang, []).append((doc_id is not None, doc_id or 0, leaf, other, doc_id))
    keys = sorted(trees, key=str.encode)
    levels = {k: plain_levels([x[2] for x in sorted(trees[k])]) for k in keys}
    top = plain_levels([levels[k][-1][0] for k in keys])
    out = []
    for i, k in enumerate(keys):
        for at, (_, _, leaf, other, doc_id) in enumerate(sorted(trees[k])):
            proof = siblings(levels[k], at) + siblings(top, i)
            root = top[-1][0]
            folded = climb(other, proof)
            out.append((doc_id, leaf, levels[k][-1][0], root, h(*[s[1:] for s in proof]), folded, folded == root))
    return sorted(out, key=repr)


def run(spark, tmp_path, rows):
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    got = M.op11_merkle(spark, str(tmp_path))
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted([tuple(r) for r in got.collect()], key=repr)


def rows(n, lang, first=0):
    return [(first + i, f"text {i} é", lang, "web", 7 + i, "x", 1, "y") for i in range(n)]


def test_equals_plain_recursion(spark, tmp_path):
    data = [*rows(21, "de"), *rows(1, "en", 100), *rows(300, "fr", 200), *rows(5, None, 600), *rows(2, "", 700), *rows(16, "zh-é", 800)]
    data += [(3, None, "de", None, None, None, None, None), (None, "no id", "de", "web", 3, None, None, None), (14, "", "de", "", 0, None, None, None),
             *rows(2, "de"), (900, "-", "de", "-", None, None, None, None), (901, "x" * 300_000, "de", "web", 300_000, None, None, None)]
    got, want = run(spark, tmp_path, data), brute(data)
    assert got == want
    assert {r[-1] for r in got} == {True, False}


def test_lone_row_is_the_root(spark, tmp_path):
    (row,) = run(spark, tmp_path, [(5, "a", "en", "s", 1, None, None, None)])
    assert row[1] == row[2] == row[3] and row[4] == h() and (row[5] == row[3]) == row[6]


def test_empty_table(spark, tmp_path):
    assert run(spark, tmp_path, []) == []


@pytest.mark.parametrize("stride", [1, 2, 3, 8])
def test_stride_changes_nothing_but_the_written_levels(spark, stride):
    n = 37
    leaves = spark.createDataFrame([("va", i, h(str(i))) for i in range(n)], "tree string, id long, node string")
    trees = M.forest(leaves, ["id"], stride)
    want = plain_levels([h(str(i)) for i in range(n)])
    assert len(trees.levels) == 1 + -(-(len(want) - 1) // stride)
    for band, level in enumerate(trees.levels):
        stored = [r.node for r in level.orderBy("pos").collect()]
        assert stored == want[min(band * stride, len(want) - 1)]
    for r in trees.proofs().collect():
        assert r.proof == siblings(want, r.pos)


def test_wanted_leaves_read_only_their_subtrees(spark):
    leaves = spark.createDataFrame([("va", i, h(str(i))) for i in range(50)] + [("vb", 0, h("b"))], "tree string, id long, node string")
    manifest = M.build(leaves, ["id"], 2)
    wanted = spark.createDataFrame([("va", 7), ("va", 49), ("vb", 0), ("va", 7), ("va", 99)], "tree string, pos long")
    every = {(r.tree, r.pos): r for r in manifest.proofs(["id"]).collect()}
    some = manifest.proofs(["id"], wanted).collect()
    assert sorted((r.tree, r.pos) for r in some) == [("va", 7), ("va", 49), ("vb", 0)]
    root = manifest.root().first().root
    for r in some:
        assert r == every[r.tree, r.pos] and climb(r.node, r.proof) == root


def test_a_changed_leaf_is_found(spark):
    from pyspark.sql import functions as F

    leaves = spark.createDataFrame([("va", i, h(str(i))) for i in range(9)], "tree string, id long, node string")
    manifest = M.build(leaves, ["id"], 3)
    changed = F.when(F.col("pos") == 4, F.sha2(F.lit("else"), 256)).otherwise(F.col("node"))
    found = manifest.proofs().withColumn("node", changed).withColumn("to", M.fold("node", "proof"))
    bad = found.where(F.col("to") != manifest.root().scalar()).collect()
    assert [r.pos for r in bad] == [4]


def test_no_python_and_no_text_in_the_tree(spark):
    docs = spark.createDataFrame(rows(10, "de"), SCHEMA)
    plan = M.build(M.document_leaves(docs), ["doc_id"]).proofs(["doc_id"])._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "text#" not in plan and "CartesianProduct" not in plan
