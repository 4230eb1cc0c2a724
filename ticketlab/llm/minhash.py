"""Near-duplicate documents by b-bit MinHash.

1. Each text becomes its set of distinct k-word shingles (64-bit hashes). Texts
   with equal sets form one class, so copies cost one row each and no pair.
2. A class has ``hashes`` minima. The first ``bands * rows`` of them make band
   keys; of every minimum the low ``bits`` bits are kept, packed into longs.
3. In each bucket (classes of one band key) members are compared with the
   bucket's hub first: its member that meets most classes over all bands, such
   as the text that others were made from. Components of those links are formed;
   then members of one bucket that are still in different components are compared
   with each other. So each candidate pair is either compared or known to be
   connected, and a group of near copies costs about a pair a member.
4. A pair is compared by set sizes, then by the share of equal b-bit minima,
   corrected for chance collisions; if that estimate is not below the threshold
   by ``slack`` or more, the full shingle sets decide.
5. Buckets of over ``hot_bucket`` classes are split by a second band key before
   members are compared with each other, and dealt in blocks, two to a task.

Chance of losing a pair at a similarity of 0.85: (1 - 0.85^5)^24 < 1e-6 by the
bands, < 1e-6 by the estimate (its standard error is 0.0135 there). In a bucket
of over ``hot_bucket`` classes a pair that is not connected otherwise needs two
equal bands: with p = 0.85^5 it is lost with (1 - p)^24 + 24 p (1 - p)^23 = 1.6e-5.

Edge cases: a text with fewer words than k has its whole word sequence as one
shingle; a null, empty or all-space text has an empty set and is linked with
nothing. Rows are documents: repeated rows fall into one class. A null doc_id
never is a component's id unless all of its ids are null.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bytetext as B
from .common import bounded_batches, fresh, materialize, read

U32, U64 = np.uint32, np.uint64


@dataclass(frozen=True)
class MinHashConfig:
    shingle: int = 3       # words in a shingle
    num: int = 85          # link when den * |A & B| >= num * |A | B|
    den: int = 100
    bands: int = 24
    rows: int = 5
    bits: int = 1          # kept of each minimum (1, 2 or 4)
    hashes: int = 1536
    slack: float = 0.065    # estimates within this below the threshold are confirmed on full sets
    hot_bucket: int = 2000

    def __post_init__(self):
        assert self.bits in (1, 2, 4) and self.hashes * self.bits % 64 == 0
        assert self.bands * self.rows <= self.hashes

    @property
    def longs(self) -> int:
        return self.hashes * self.bits // 64


SIGNATURE = "struct<node:binary,n_shingles:bigint,sig:array<bigint>,bands:array<bigint>>"


def shingle_sets(s: B.Slice, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, and where each text's start."""
    w = B.words(s)
    n_words = np.diff(w.first)
    odd = B.splitmix(2, k) | U64(1)
    total = len(w.hashes)
    with np.errstate(over="ignore"):
        h = np.zeros(total, U64)
        for j in range(k):
            h[: total - j] += w.hashes[j:] * odd[j]
        h = B.finish(h)
        short = np.flatnonzero((n_words > 0) & (n_words < k))
        for d in short:
            own = w.hashes[w.first[d]: w.first[d + 1]]
            h[w.first[d]] = B.finish((own * odd[: len(own)]).sum(keepdims=True) + U64(len(own)))[0]
    ends = w.first[:-1] + np.where(n_words >= k, n_words - k + 1, np.minimum(n_words, 1))
    sets = [np.unique(h[a:b]) for a, b in zip(w.first[:-1], ends)]
    first = np.concatenate(([0], np.cumsum([len(x) for x in sets]))).astype(np.int64)
    return (np.concatenate(sets) if sets else h[:0]), first


def _digests(u: np.ndarray, first: np.ndarray) -> list[bytes | None]:
    """16 bytes for each set, whatever its order; None for the empty set."""
    with np.errstate(over="ignore"):
        size = np.diff(first).astype(U64)
        a = B.finish(B.per_text(B.finish(u), first) + size)
        b = B.finish(B.per_text(B.finish(u ^ U64(0xA5A5A5A5A5A5A5A5)), first) ^ (size << U64(32)))
    both = np.stack([a, b], 1).astype(">u8").tobytes()
    return [both[16 * i: 16 * i + 16] if n else None for i, n in enumerate(size)]


def _lists(values: np.ndarray, present: np.ndarray) -> pa.Array:
    """Rows of a matrix of longs as lists; null where not present."""
    width = values.shape[1]
    offsets = np.concatenate(([0], np.cumsum(present) * width)).astype(np.int32)
    out = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values[present].astype(np.int64).ravel()),
                                   mask=pa.array(~present))
    return out


def signature_udf(cfg: MinHashConfig) -> Column:
    def sign(texts: pa.Array) -> pa.Array:
        mul = (B.splitmix(3, cfg.hashes) >> U64(32)).astype(U32) | U32(1)
        xor = (B.splitmix(4, cfg.hashes) >> U64(32)).astype(U32)
        row_odd = B.splitmix(5, cfg.rows) | U64(1)
        parts = []
        for s in B.slices(texts):
            u, first = shingle_sets(s, cfg.shingle)
            size = np.diff(first)
            full = np.flatnonzero(size)
            banded = np.zeros((len(size), cfg.bands * cfg.rows), U64)
            sig = np.zeros((len(size), cfg.longs), U64)
            if len(full):
                x, at = (u >> U64(32)).astype(U32), first[:-1][full]
                y = np.empty_like(x)
                for i in range(cfg.hashes):
                    np.bitwise_xor(x, xor[i], out=y)
                    np.multiply(y, mul[i], out=y)
                    least = np.minimum.reduceat(y, at).astype(U64)
                    if i < cfg.bands * cfg.rows:
                        banded[full, i] = least
                    long, bit = divmod(i * cfg.bits, 64)
                    sig[full, long] |= (B.finish(least + U64(7)) & U64((1 << cfg.bits) - 1)) << U64(bit)
            with np.errstate(over="ignore"):
                banded = banded.reshape(-1, cfg.bands, cfg.rows)
                bands = B.finish((B.finish(banded + U64(1)) * row_odd).sum(2) + B.splitmix(6, cfg.bands))
            present = size > 0
            parts.append(pa.StructArray.from_arrays(
                [pa.array(_digests(u, first), pa.binary()), pa.array(size.astype(np.int64)),
                 _lists(sig.view(np.int64), present), _lists(bands.view(np.int64), present)],
                ["node", "n_shingles", "sig", "bands"]))
        return pa.concat_arrays(parts) if parts else pa.array([], pa.struct(
            [("node", pa.binary()), ("n_shingles", pa.int64()), ("sig", pa.list_(pa.int64())), ("bands", pa.list_(pa.int64()))]))
    return F.arrow_udf(sign, SIGNATURE)


def set_udf(cfg: MinHashConfig) -> Column:
    """Node and full shingle set of each text."""
    def sets(texts: pa.Array) -> pa.Array:
        parts = []
        for s in B.slices(texts):
            u, first = shingle_sets(s, cfg.shingle)
            lists = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(u.view(np.int64)))
            parts.append(pa.StructArray.from_arrays([pa.array(_digests(u, first), pa.binary()), lists], ["node", "items"]))
        return pa.concat_arrays(parts) if parts else pa.array([], pa.struct([("node", pa.binary()), ("items", pa.list_(pa.int64()))]))
    return F.arrow_udf(sets, "struct<node:binary,items:array<bigint>>")


def estimate(cfg: MinHashConfig, a: str, b: str) -> Column:
    """Similarity estimated from two packed signatures, corrected for chance:
    a share C = 2^-bits of different minima agree in the kept bits."""
    kept = {1: -1, 2: 0x5555555555555555, 4: 0x1111111111111111}[cfg.bits]
    differ = F.lit(0)
    for i in range(cfg.longs):
        x = F.col(a)[i].bitwiseXOR(F.col(b)[i])
        if cfg.bits > 1:
            x = x.bitwiseOR(F.shiftright(x, 1))
        if cfg.bits > 2:
            x = x.bitwiseOR(F.shiftright(x, 2))
        differ = differ + F.bit_count(x.bitwiseAND(F.lit(kept)))
    chance = 2.0 ** -cfg.bits
    return ((1.0 - differ / cfg.hashes) - chance) / (1.0 - chance)


def signatures(docs: DataFrame, cfg: MinHashConfig) -> DataFrame:
    """One row a document: doc_id, text_hash, node, n_shingles, sig, bands."""
    bounded_batches(docs.sparkSession)
    signed = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), signature_udf(cfg)("text").alias("s"))
    return materialize(signed.select("doc_id", "text_hash", "s.*"), "minhash-signatures")


def _may_link(cfg: MinHashConfig, a: str, b: str) -> Column:
    """Whether sizes and estimates of two classes (columns n_, sig_ with the
    suffixes) leave room for the threshold."""
    na, nb = F.col(f"n_{a}"), F.col(f"n_{b}")
    sizes = cfg.den * F.least(na, nb) >= cfg.num * F.greatest(na, nb)
    return sizes & (estimate(cfg, f"sig_{a}", f"sig_{b}") >= cfg.num / cfg.den - cfg.slack)


def _confirmed(docs: DataFrame, near: DataFrame, classes: DataFrame, cfg: MinHashConfig, name: str) -> DataFrame:
    """The pairs (a, b) of ``near`` whose full sets reach the threshold."""
    needed = (near.select(F.col("a").alias("node")).union(near.select("b")).distinct()
              .join(classes.select("node", "rep_doc"), "node"))
    needed = materialize(needed, f"{name}-needed")
    texts = docs.select("doc_id", "text").join(
        needed.select("rep_doc").distinct(), F.col("doc_id").eqNullSafe(F.col("rep_doc")), "left_semi")
    found = texts.select(set_udf(cfg)("text").alias("s")).select("s.*").join(needed, "node", "left_semi")
    sets = materialize(found.dropDuplicates(["node"]), f"{name}-sets")
    shared = F.size(F.array_intersect("xa", "xb"))
    union = F.size("xa") + F.size("xb") - shared
    links = (near.join(sets.toDF("a", "xa"), "a").join(sets.toDF("b", "xb"), "b")
             .where(cfg.den * shared >= cfg.num * union).select("a", "b"))
    return materialize(links, f"{name}-links")


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """Smallest node reachable over undirected links (a, b), for every node in
    them: columns node, comp. Each round takes the smallest label among a
    node's neighbours and then follows labels one step (pointer jumping), so
    rounds grow with the logarithm of a chain's length."""
    edges = materialize(links.select("a", "b").union(links.select("b", "a")).distinct(), f"{name}-edges")
    label = materialize(edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"))
                        .select("node", F.least("node", "m").alias("comp")), f"{name}-labels")
    while True:
        around = (edges.join(label.toDF("b", "lb"), "b").groupBy(F.col("a").alias("node")).agg(F.min("lb").alias("m"))
                  .join(label, "node").select("node", "comp", F.least("comp", "m").alias("step")))
        around = materialize(around, f"{name}-round")
        jump = around.select(F.col("node").alias("step"), F.col("step").alias("further"))
        moved = materialize(around.join(jump, "step", "left")
                            .select("node", F.col("comp").alias("old"),
                                    F.least("step", F.coalesce("further", "step")).alias("comp")), f"{name}-labels")
        label = moved.select("node", "comp")
        if moved.where(F.col("old") != F.col("comp")).isEmpty():
            return label


def _split_hot(buckets: DataFrame, classes: DataFrame, cfg: MinHashConfig) -> DataFrame:
    """Buckets (key, node, comp, split) of over ``hot_bucket`` classes, dealt anew by a
    further band key: two classes stay together if they share another band."""
    for _ in range(2):
        sizes = buckets.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > cfg.hot_bucket)
        sizes = materialize(sizes, "minhash-hot")
        if sizes.isEmpty():
            break
        cold = buckets.join(sizes, "key", "left_anti")
        hot = (buckets.join(sizes, "key", "left_semi").join(classes.select("node", "bands"), "node")
               .select("key", "node", "comp", F.explode("bands").alias("band")).where("band != key")
               .select(F.xxhash64("key", "band").alias("key"), "node", "comp", F.lit(True).alias("split")))
        buckets = materialize(cold.unionByName(hot), "minhash-buckets")
    return buckets


def _close_pairs(buckets: DataFrame, classes: DataFrame, cfg: MinHashConfig) -> DataFrame:
    """Pairs (a, b) of classes of one bucket and different components that may
    reach the threshold, by sizes and estimates.

    A bucket is dealt in blocks of about ``hot_bucket`` classes at most, and a
    group holds two blocks; a sorted partition is read group by group.
    """
    sizes = buckets.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / cfg.hot_bucket).cast("int").alias("blocks"))
    rows = buckets.join(sizes, "key").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("key", "split", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "node", "comp")
    rows = rows.join(classes.select("node", "n", "sig", "bands"), "node").repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")
    rows = rows.select("key", "lo", "hi", "own", "split", "node", "comp", "n", "sig", "bands")
    chance, least = 2.0 ** -cfg.bits, cfg.num / cfg.den - cfg.slack
    kept = U64({1: 2 ** 64 - 1, 2: 0x5555555555555555, 4: 0x1111111111111111}[cfg.bits])

    def compare(t: pa.Table) -> tuple[list, list]:
        key, lo, hi, own, split, _, comp, n, sig, bands = (t.column(c).combine_chunks() for c in range(10))
        key, lo, hi, own, n = (c.to_numpy() for c in (key, lo, hi, own, n))
        split = split.to_numpy(zero_copy_only=False)
        _, comp = np.unique(np.array(comp.to_pylist(), object), return_inverse=True)
        sig, bands = (c.flatten().to_numpy().reshape(len(n), -1) for c in (sig, bands))
        sig = sig.view(U64)
        left, right = [], []
        for i in range(len(n) - 1):
            j = np.arange(i + 1, len(n))
            across = own[j] != own[i] if lo[i] != hi[i] else np.ones(len(j), bool)   # pairs in one block meet in its own group
            j = j[across & (comp[j] != comp[i]) & (cfg.den * np.minimum(n[j], n[i]) >= cfg.num * np.maximum(n[j], n[i]))]
            x = sig[j] ^ sig[i]
            for shift in range(cfg.bits.bit_length() - 1):
                x |= x >> U64(1 << shift)
            differ = np.bitwise_count(x & kept).sum(1)
            j = j[((1 - differ / cfg.hashes) - chance) / (1 - chance) >= least]
            same = bands[j] == bands[i]
            j = j[split[i] | (bands[i][same.argmax(1)] == key[i])]   # once, not in each bucket that they share
            left += [i] * len(j)
            right += j.tolist()
        return left, right

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for b in itertools.chain(batches, [None]):
            t = None if b is None else pa.Table.from_batches([b])
            t = t if held is None else held if t is None else pa.concat_tables([held, t])
            if t is None or not t.num_rows:
                continue
            code = np.stack([t.column(c).to_numpy() for c in range(3)])
            ends = np.append(np.flatnonzero((code[:, 1:] != code[:, :-1]).any(0)) + 1, t.num_rows)
            begins = np.concatenate(([0], ends[:-1]))
            if b is not None:   # the last group may go on in the next batch
                held = t.slice(int(begins[-1]))
                begins, ends = begins[:-1], ends[:-1]
            for a, z in zip(begins.tolist(), ends.tolist()):
                group = t.slice(a, z - a)
                left, right = compare(group)
                node = group.column("node").combine_chunks()
                one, two = node.take(pa.array(left, pa.int64())), node.take(pa.array(right, pa.int64()))
                yield pa.record_batch([one, two], ["a", "b"])

    return rows.mapInArrow(pairs, "a binary, b binary").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def near_duplicates(docs: DataFrame, cfg: MinHashConfig = MinHashConfig()) -> DataFrame:
    """One row a document: doc_id, text_hash, n_shingles, component_id, kept."""
    signed = signatures(docs, cfg)
    classes = materialize(
        signed.where("node is not null").groupBy("node")
        .agg(F.min("doc_id").alias("rep_doc"), F.first("n_shingles").alias("n"), F.first("sig").alias("sig"), F.first("bands").alias("bands")),
        "minhash-classes")
    keys = classes.select(F.explode(F.array_distinct("bands")).alias("key"), "node")
    shared = materialize(keys.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "minhash-shared")
    buckets = materialize(keys.join(shared, "key").select("key", "size", "node"), "minhash-members")
    meets = materialize(buckets.groupBy("node").agg(F.sum("size").alias("meets")), "minhash-meets")
    hubs = (buckets.join(meets, "node").groupBy("key").agg(F.max(F.struct("meets", "node")).alias("hub"))
            .select("key", F.col("hub.node").alias("hub")))
    first = materialize(buckets.join(hubs, "key").where("hub != node").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct(), "minhash-hubs")
    sides = [classes.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("sig").alias(f"sig_{x}")) for x in "ab"]
    near = materialize(first.join(sides[0], "a").join(sides[1], "b").where(_may_link(cfg, "a", "b")).select("a", "b"), "minhash-near")
    links = _confirmed(docs, near, classes, cfg, "minhash-hub")
    label = components(links)

    # what is left: members of one bucket that are in different components
    members = (buckets.where("size > 2").join(label, "node", "left").select("key", "node", F.coalesce("comp", "node").alias("comp")))
    mixed = members.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo != hi")
    rest = materialize(members.join(mixed.select("key"), "key").withColumn("split", F.lit(False)), "minhash-rest")
    if not rest.isEmpty():
        second = _close_pairs(_split_hot(rest, classes, cfg), classes, cfg).distinct()
        second = second.join(first, (second["a"] == first["a"]) & (second["b"] == first["b"]), "left_anti")
        second = second.join(first, (second["a"] == first["b"]) & (second["b"] == first["a"]), "left_anti")
        second = materialize(second, "minhash-second")
        if not second.isEmpty():
            links = links.union(_confirmed(docs, second, classes, cfg, "minhash-cross"))
            label = components(links)

    ids = classes.select("node", "rep_doc").join(label, "node", "left").select("node", "rep_doc", F.coalesce("comp", "node").alias("comp"))
    smallest = ids.groupBy("comp").agg(F.min("rep_doc").alias("component_id"))
    component = materialize(ids.join(smallest, "comp").select("node", "component_id"), "minhash-component")
    return (signed.select("doc_id", "text_hash", "node", "n_shingles").join(component, "node", "left")
            .select("doc_id", "text_hash", "n_shingles",
                    F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
            .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id"))))


def keep_one(docs: DataFrame, cfg: MinHashConfig = MinHashConfig()) -> DataFrame:
    """``docs`` without near duplicates: of each component the row with the
    smallest doc_id stays (one of them if rows repeat that id); documents
    without words are no group and all stay."""
    found = materialize(near_duplicates(docs, cfg).where("kept"), "minhash-kept")
    keys = found.groupBy("doc_id", "text_hash", "component_id").agg(
        F.count(F.lit(1)).alias("_n"), F.max("n_shingles").alias("_size"))
    # rows that repeat an id within a component (or differ in text under it): keep one
    groups = keys.groupBy("component_id").agg(F.count(F.lit(1)).alias("_texts"), F.min("text_hash").alias("_first"), F.max("_size").alias("_words"))
    keys = keys.join(groups.where("_words > 0"), F.col("_size").cast("boolean") & keys["component_id"].eqNullSafe(groups["component_id"]), "left") \
        .where("_texts is null or text_hash = _first").select("doc_id", "text_hash", "_n", "_size")
    k = fresh(docs, "_k")
    keys = keys.select(F.struct("doc_id", "text_hash", F.expr("_n > 1 and _size > 0").alias("repeated")).alias(k))
    joined = docs.join(keys, docs["doc_id"].eqNullSafe(F.col(f"{k}.doc_id")) & (F.xxhash64(docs["text"]) == F.col(f"{k}.text_hash")))
    once = joined.where(f"not {k}.repeated").drop(k)
    again = joined.where(f"{k}.repeated").withColumn(k, F.struct(f"{k}.doc_id", f"{k}.text_hash")).dropDuplicates([k]).drop(k)
    return once.unionByName(again)


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return near_duplicates(docs).select("doc_id", "n_shingles", "component_id", "kept")


#: The same rows by full sets alone: every pair that shares a shingle is counted.
ORACLE_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                   '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
g AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) >= 3 THEN list_transform(range(1, len(words) - 1), lambda i: array_to_string(words[i : i + 2], ' '))
                                          WHEN len(words) > 0 THEN [array_to_string(words, ' ')] ELSE [] END) AS shingle FROM w),
n AS (SELECT doc_id, count(*) AS size FROM g GROUP BY doc_id),
links AS (SELECT a.doc_id AS x, b.doc_id AS y FROM g a JOIN g b USING (shingle) JOIN n p ON p.doc_id = a.doc_id JOIN n q ON q.doc_id = b.doc_id
          WHERE a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, p.size, q.size HAVING 100 * count(*) >= 85 * (p.size + q.size - count(*))),
reach AS (SELECT doc_id AS x, doc_id AS y FROM w UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x),
c AS (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY x)
SELECT doc_id, coalesce(size, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM c LEFT JOIN n USING (doc_id)
"""
