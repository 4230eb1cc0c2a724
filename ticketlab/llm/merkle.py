"""Merkle manifest of a dataset: checkpoint every few levels, recompute the rest.

Rows are leaves, grouped into trees and ordered inside them. A parent is the hash
of its two children's digests (an odd last child is hashed alone); a tree of one
leaf is that leaf. The trees' roots, in the order of their keys, are the leaves of
one more tree, whose root names the dataset.

* Only levels 0, ``stride``, 2 * ``stride`` ... are written. 2 ** ``stride``
  neighbours of one written level form an aligned subtree; its top is one node of
  the next written level. A task sees one such subtree at a time, however large
  a tree is.
* Proofs are made from the top down. For each band of levels the aligned
  subtrees are read again from the written level below, their interior nodes
  are recomputed, each descendant gets its siblings inside the subtree and
  those that the subtree's top already had, and the interior is thrown away.
  With ``wanted`` leaves, only subtrees on their paths are read.
* A proof is an array with one entry a level, from the leaf up: ``L`` or ``R`` (the
  sibling's side) and the sibling's digest, or an empty text where there is none.

Every digest is the lower-case hex SHA-256 of concatenated texts. Leaves are hashed
where the rows are scanned, and written before they are numbered, so no text is
shuffled; the numbering (``common.ranked``) never holds a tree in one task.

Edge cases: an empty table has no leaf and no root. Missing values hash as ``-``
and differ from the text ``-`` (``1:-``). A null tree key is a tree of its own, the
first; rows with equal order keys are ordered by their leaf's digest, and equal
rows are leaves of their own. A null id is ordered first and never tampered with.
Columns that are not named take no part.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, ranked, read

#: Levels between two written ones: subtrees of 256 leaves, about 16 kB of digests.
STRIDE = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*parts: Column) -> Column:
    """Lower-case hex SHA-256 of the parts' concatenation."""
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """A value with its length before it, so that no two rows read the same."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(values: Sequence[Column]) -> Column:
    return digest(*[field(v) for v in values])


def tree_key(value: Column) -> Column:
    """The tree's key as text that is never null and sorts a null key first."""
    return F.coalesce(F.concat(F.lit("v"), value.cast("string")), F.lit("n"))


#: The next level of an array of digests.
PAIRED = ("transform(sequence(0, (size({0}) - 1) div 2), "
          "i -> sha2(concat({0}[2 * i], coalesce(get({0}, 2 * i + 1), '')), 256))")


def _levels(nodes: str, up: str, stride: int) -> str:
    """SQL: the array ``nodes`` and the ``up`` levels above it, each an array."""
    steps = f"slice(sequence(1, {stride}), 1, {up})"
    return (f"aggregate({steps}, array({nodes}), (seen, step) -> "
            f"concat(seen, transform(slice(seen, -1, 1), last -> {PAIRED.format('last')})))")


@dataclass
class Forest:
    """Trees of equal rules: written levels (tree, height, pos, node), from the leaves up."""
    levels: list[DataFrame]
    stride: int
    name: str

    def roots(self) -> DataFrame:
        """tree, node: one row a tree."""
        return self.levels[-1].select("tree", "node")

    def _subtrees(self, band: int, carried: Sequence[str] = ()) -> DataFrame:
        """Aligned subtrees of a band: tree, top (position above), up (levels to climb) and
        their nodes in order; at most 2 ** stride rows in each."""
        at = self.levels[band]
        rows = F.sort_array(F.collect_list(F.struct("pos", "node", *carried)))
        climbs = F.greatest(F.least(F.col("height") - band * self.stride, F.lit(self.stride)), F.lit(0))
        return (at.groupBy("tree", F.shiftright("pos", self.stride).alias("top"))
                .agg(rows.alias("rows"), F.max(climbs).alias("up"), F.max("height").alias("height")))

    def grow(self) -> None:
        """Write the levels above the leaves, every ``stride``-th one, up to the roots."""
        highest = self.levels[0].agg(F.max("height")).first()[0] or 0
        for band in range(math.ceil(highest / self.stride)):
            trees = self._subtrees(band).withColumn("seen", F.expr(_levels("rows.node", "up", self.stride)))
            above = trees.select("tree", "height", F.col("top").alias("pos"), F.expr("element_at(seen, -1)[0]").alias("node"))
            self.levels.append(materialize(above, f"{self.name}-level"))

    def proofs(self, carried: Sequence[str] = (), wanted: DataFrame | None = None, above: DataFrame | None = None) -> DataFrame:
        """tree, pos, node, ``carried`` columns of the leaf level, and ``proof``.

        ``wanted`` (tree, pos): the leaves to prove, all by default. ``above``
        (tree, proof): what follows each tree's root, nothing by default."""
        proof = self.roots().select("tree", F.lit(0).cast("long").alias("top"))
        if above is None:
            proof = proof.withColumn("rest", F.array().cast("array<string>"))
        else:
            proof = proof.join(above.select("tree", F.col("proof").alias("rest")), "tree")
        sibling = ("transform(slice(sequence(0, {k} - 1), 1, up), l -> coalesce(concat("
                   "if(shiftright(at, l) % 2 = 0, 'R', 'L'), get(seen[l], shiftright(at, l) ^ 1)), ''))")
        # the topmost written level holds the roots: position 0 of each tree
        for band in range(len(self.levels) - 2, -1, -1):
            keep = carried if band == 0 else ()
            trees = self._subtrees(band, keep)
            if wanted is not None:
                paths = wanted.select("tree", F.shiftright("pos", (band + 1) * self.stride).alias("top")).distinct()
                trees = trees.join(paths, ["tree", "top"], "left_semi")
            rows = (trees.join(proof, ["tree", "top"])
                    .withColumn("seen", F.expr(_levels("rows.node", "up", self.stride)))
                    .select("tree", "up", "seen", "rest", F.posexplode("rows").alias("at", "row"))
                    .select("tree", "row.*", F.concat(F.expr(sibling.format(k=self.stride)), "rest").alias("rest")))
            if band:
                proof = materialize(rows.select("tree", F.col("pos").alias("top"), "rest"), f"{self.name}-paths")
            else:
                proof = rows.select("tree", "pos", "node", *carried, F.col("rest").alias("proof"))
        if len(self.levels) == 1:   # every tree is a lone leaf, which is its root
            proof = (self.levels[0].select("tree", "pos", "node", *carried)
                     .join(proof.select("tree", F.col("rest").alias("proof")), "tree"))
        return proof if wanted is None else proof.join(wanted.select("tree", "pos").distinct(), ["tree", "pos"], "left_semi")


def forest(leaves: DataFrame, order: Sequence[str], stride: int = STRIDE, name: str = "merkle") -> Forest:
    """Trees of ``leaves`` (tree, node, other columns), each ordered by ``order`` and the
    digest. The leaf level keeps the other columns."""
    if not 1 <= stride <= 16:
        raise ValueError("a subtree has 2 ** stride leaves; stride must be from 1 to 16")
    placed = ranked(leaves, ["tree"], [*order, "node"], "pos")
    # ceil(log2(n)) by comparison, without rounding
    n = leaves.groupBy("tree").agg(F.count(F.lit(1)).alias("n"))
    heights = n.select("tree", F.expr("size(filter(sequence(0, 61), e -> shiftleft(1L, e) < n))").alias("height"))
    grown = Forest([materialize(placed.join(heights, "tree"), f"{name}-leaves")], stride, name)
    grown.grow()
    return grown


def fold(node: str, proof: str) -> Column:
    """The root that a leaf's digest and a proof lead to."""
    return F.expr(f"aggregate({proof}, {node}, (acc, s) -> sha2(case when s like 'L%' then concat(substring(s, 2), acc) "
                  f"when s like 'R%' then concat(acc, substring(s, 2)) else acc end, 256))")


def proof_digest(proof: str) -> Column:
    return digest(F.array_join(F.transform(proof, lambda s: F.substring(s, 2, 64)), ""))


@dataclass
class Manifest:
    trees: Forest     # one a key; leaves with their rows' carried columns
    top: Forest       # of the trees' roots; its single tree is named ``top``

    def root(self) -> DataFrame:
        """One row: ``root`` (none for an empty table)."""
        return self.top.roots().select(F.col("node").alias("root"))

    def proofs(self, carried: Sequence[str] = (), wanted: DataFrame | None = None) -> DataFrame:
        """tree, pos, node, carried columns, subroot, proof (from leaf to dataset root)."""
        above = self.top.proofs(["key"]).select(F.col("key").alias("tree"), F.col("node").alias("subroot"), "proof")
        above = materialize(above, "merkle-above")   # one row a tree
        return self.trees.proofs(carried, wanted, above).join(above.select("tree", "subroot"), "tree")


def build(leaves: DataFrame, order: Sequence[str], stride: int = STRIDE) -> Manifest:
    """Manifest of ``leaves``: tree (a :func:`tree_key`), node (a digest), order columns, others."""
    trees = forest(leaves, order, stride, "merkle-tree")
    keys = trees.roots().select(F.lit("top").alias("tree"), "node", F.col("tree").alias("key"))
    return Manifest(trees, forest(keys, ["key"], stride, "merkle-top"))


def document_leaves(docs: DataFrame) -> DataFrame:
    """tree (of the language), doc_id, node, and the digest of the row as tampered with: where
    7 divides the id's checksum, 1 is added to n_chars. Written: texts are read once."""
    columns = [F.col(c) for c in FIELDS]
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    other = [F.col("n_chars") + 1 if c == "n_chars" else F.col(c) for c in FIELDS]
    rows = docs.select(tree_key(F.col("lang")).alias("tree"), "doc_id", leaf_of(columns).alias("node"),
                       F.when(chosen & F.col("n_chars").isNotNull(), leaf_of(other)).alias("tampered"))
    return materialize(rows, "merkle-rows")


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    manifest = build(document_leaves(docs), ["doc_id"])
    found = manifest.proofs(["doc_id", "tampered"]).withColumn("root", manifest.root().scalar())
    return (found.select("doc_id", F.col("node").alias("leaf"), "subroot", "root", proof_digest("proof").alias("proof_sha256"),
                         fold("coalesce(tampered, node)", "proof").alias("folded_root"))
            .withColumn("verified", F.col("folded_root") == F.col("root")))


#: The same rows level by level; checksums bit by bit, as this dialect has no crc32.
ORACLE_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, lang, n_chars,
    coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS a,
    coalesce(strlen(text) || ':' || text, '-') AS z,
    coalesce(xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
      lambda crc, b: list_reduce(list_prepend(xor(crc, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
        lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)), 4294967295) % 7 = 0, false) AS chosen
  FROM documents),
l AS (SELECT *, coalesce('v' || lang, 'n') AS tree, sha256(a || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') || z) AS leaf,
        sha256(a || coalesce(strlen((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1), '-') || z) AS other FROM d),
p AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n FROM l),
t(tree, lvl, pos, n, h) AS (
  SELECT tree, 0, pos, n, leaf FROM p
  UNION ALL
  SELECT tree, lvl + 1, pos // 2, max((n + 1) // 2), sha256(string_agg(h, '' ORDER BY pos)) FROM t WHERE n > 1 GROUP BY tree, lvl, pos // 2),
s AS (SELECT tree, h AS subroot, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n FROM t WHERE n = 1),
u(lvl, pos, n, h) AS (
  SELECT 0, pos, n, subroot FROM s
  UNION ALL
  SELECT lvl + 1, pos // 2, max((n + 1) // 2), sha256(string_agg(h, '' ORDER BY pos)) FROM u WHERE n > 1 GROUP BY lvl, pos // 2),
hs AS (SELECT tree, max(lvl) AS height FROM t GROUP BY tree),
steps AS (
  SELECT p.tree, p.pos, t.lvl AS step, (p.pos >> t.lvl) % 2 = 1 AS at_left, t.h
  FROM p JOIN t ON t.tree = p.tree AND t.n > 1 AND t.pos = xor(p.pos >> t.lvl, 1)
  UNION ALL
  SELECT p.tree, p.pos, hs.height + u.lvl, (s.pos >> u.lvl) % 2 = 1, u.h
  FROM p JOIN s USING (tree) JOIN hs USING (tree) JOIN u ON u.n > 1 AND u.pos = xor(s.pos >> u.lvl, 1)),
sizes AS (SELECT height + (SELECT max(lvl) FROM u) AS total, tree FROM hs),
proof AS (SELECT tree, pos, list_filter(list(struct_pack(step := step, at_left := at_left, h := h) ORDER BY step), lambda x: x.h IS NOT NULL) AS path
  FROM steps GROUP BY tree, pos),
f(tree, pos, total, step, h) AS (
  SELECT tree, pos, total, 0, CASE WHEN chosen AND n_chars IS NOT NULL THEN other ELSE leaf END FROM p JOIN sizes USING (tree)
  UNION ALL
  SELECT f.tree, f.pos, total, f.step + 1, sha256(CASE WHEN s.h IS NULL THEN f.h WHEN s.at_left THEN s.h || f.h ELSE f.h || s.h END)
  FROM f LEFT JOIN steps s ON s.tree = f.tree AND s.pos = f.pos AND s.step = f.step WHERE f.step < total)
SELECT doc_id, leaf, subroot, u.h AS root,
  sha256(coalesce(array_to_string(list_transform(path, lambda x: x.h), ''), '')) AS proof_sha256, f.h AS folded_root, f.h = u.h AS verified
FROM p JOIN s USING (tree) JOIN u ON u.n = 1 JOIN f ON f.tree = p.tree AND f.pos = p.pos AND f.step = f.total
LEFT JOIN proof ON proof.tree = p.tree AND proof.pos = p.pos
"""
