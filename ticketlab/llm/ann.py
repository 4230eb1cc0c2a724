"""Nearest neighbours by inner product from randomly rotated one-bit codes.

Index. A vector is scaled to length 1, padded with zeros to ``bits`` and turned
by a fixed random rotation; the sign of each coordinate is kept, packed into
longs. Besides the bits a row carries two numbers: the vector's length, and the
inner product s of the turned unit vector and its own code (as unit vector).

Search. For a query q, <code, turned q> / s is an unbiased estimate of <unit
vector, q>, with an error of at most ``bound`` * sqrt(1 - s^2) / s *
|q| / sqrt(bits - 1) but for a tiny chance. Queries and rows meet in blocks of
bounded size. In a block, rows whose upper bound is below the k-th largest lower
bound are out; the others are reranked by the exact product in double precision,
and each query's best k of the block go on to the merge. So the estimate only
chooses what is reranked; scores are exact.

Edge cases: rows with a null id or vector, a zero vector, or null or non-finite
components take no part; vectors meet only vectors of their own dimension; rows
that repeat id and vector count once; rows with the query's id are the query's own;
equal scores go by smaller id.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, read


@dataclass(frozen=True)
class CodeConfig:
    k: int = 20
    bits: int = 256          # raised to a multiple of 64 that holds the dimension
    bound: float = 4.0       # standard errors
    seed: int = 7
    row_block: int = 16384
    query_block: int = 2048


def rotation(width: int, seed: int) -> np.ndarray:
    """A random orthogonal matrix, equal in every process."""
    q, r = np.linalg.qr(np.random.Generator(np.random.PCG64(seed)).standard_normal((width, width)))
    return q * np.sign(np.diag(r))


def code_width(dim: int, bits: int) -> int:
    return -(-max(dim, bits) // 64) * 64


def encode(x: np.ndarray, bits: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed sign bits (uint8), lengths and code products s of the rows of x."""
    n, dim = x.shape
    width = code_width(dim, bits)
    norm = np.sqrt((x.astype(np.float64) ** 2).sum(1))
    turned = (x / norm[:, None]) @ rotation(width, seed)[:dim]
    return np.packbits(turned > 0, axis=1), norm, np.abs(turned).sum(1) / np.sqrt(width)


def usable(df: DataFrame) -> DataFrame:
    """vec_id, x (array of doubles): the rows that take part, each once."""
    x = F.col("embedding").cast("array<double>")
    good = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(x, lambda v: v != 0)
    return (df.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x"))
            .where(F.col("vec_id").isNotNull() & F.col("x").isNotNull()).where(good).dropDuplicates(["vec_id", "x"]))


def index(vectors: DataFrame, cfg: CodeConfig = CodeConfig()) -> DataFrame:
    """``usable`` rows with dim, code (packed bits), norm and s."""
    def codes(arr: pa.Array) -> pa.Array:
        rows = arr.to_numpy(zero_copy_only=False)
        out: list = [None] * len(rows)
        dims = np.array([len(r) for r in rows])
        for dim in np.unique(dims):
            at = np.flatnonzero(dims == dim)
            for i, bits, norm, s in zip(at, *encode(np.stack([rows[j] for j in at]), cfg.bits, cfg.seed)):
                out[i] = {"code": bits.tobytes(), "norm": float(norm), "s": float(s)}
        return pa.array(out, pa.struct([("code", pa.binary()), ("norm", pa.float64()), ("s", pa.float64())]))
    code = F.arrow_udf(codes, "struct<code:binary,norm:double,s:double>")
    return usable(vectors).withColumn("c", code("x")).select("vec_id", "x", F.size("x").alias("dim"), "c.*")


def search_block(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, codes: np.ndarray, norm: np.ndarray,
                 s: np.ndarray, cfg: CodeConfig) -> tuple[list[np.ndarray], int]:
    """Best k rows of the block for every query (positions), and how many rows
    were reranked in all."""
    width = codes.shape[1] * 8
    turn = rotation(width, cfg.seed)[: q.shape[1]].astype(np.float32)
    turned = q.astype(np.float32) @ turn
    length = np.sqrt((q ** 2).sum(1))
    weight = (norm / (s * np.sqrt(width))).astype(np.float32)
    spread = (cfg.bound * norm * np.sqrt(np.maximum(1 - s ** 2, 0)) / (s * np.sqrt(width - 1))).astype(np.float32)
    own = dict(zip(ids[::-1].tolist(), range(len(ids) - 1, -1, -1)))
    out, reranked = [], 0
    signs = np.unpackbits(codes, axis=1).astype(np.float32) * 2 - 1
    for lo in range(0, len(q), 256):
        guess = (turned[lo: lo + 256] @ signs.T) * weight
        for i, est in enumerate(guess, lo):
            err = spread * np.float32(length[i]) + np.float32(1e-5) * norm.astype(np.float32) * np.float32(length[i])
            lower = est - err
            if q_ids[i] in own:
                lower[ids == q_ids[i]] = -np.inf
            if len(lower) > cfg.k:
                kth = np.partition(lower, len(lower) - cfg.k)[len(lower) - cfg.k]
                pick = np.flatnonzero((est + err >= kth) & (ids != q_ids[i]))
            else:
                pick = np.flatnonzero(ids != q_ids[i])
            reranked += len(pick)
            score = (x[pick] * q[i]).sum(1)
            best = np.lexsort((ids[pick], -score))[: cfg.k]
            out.append((pick[best], score[best]))
    return out, reranked


def search(rows: DataFrame, queries: DataFrame, cfg: CodeConfig = CodeConfig()) -> DataFrame:
    """query_id, rank, vec_id, score: for every query of ``queries`` (indexed
    rows) its k best of ``rows`` (indexed rows)."""
    n_rows, n_queries = rows.count(), queries.count()
    row_blocks, query_blocks = max(1, -(-n_rows // cfg.row_block)), max(1, -(-n_queries // cfg.query_block))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = queries.select(F.col("vec_id").alias("q_id"), F.col("x").alias("q"), "dim",
                          F.pmod(F.xxhash64("vec_id", "x"), F.lit(query_blocks)).cast("int").alias("h"), every(row_blocks).alias("g"))
    right = rows.withColumn("g", F.pmod(F.xxhash64("vec_id", "x"), F.lit(row_blocks)).cast("int")).withColumn("h", every(query_blocks))
    schema = "query_id long, vec_id long, score double"

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        ids = {"query_id": [], "vec_id": [], "score": []}
        if a.num_rows and b.num_rows:
            def matrix(t, c):
                return t.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, -1)

            q_ids, vec = a.column("q_id").to_numpy(), b.column("vec_id").to_numpy()
            codes = np.stack([np.frombuffer(v, np.uint8) for v in b.column("code").to_pylist()])
            found, _ = search_block(q_ids, matrix(a, "q"), vec, matrix(b, "x"), codes, b.column("norm").to_numpy(), b.column("s").to_numpy(), cfg)
            for q_id, (at, score) in zip(q_ids, found):
                ids["query_id"].append(np.full(len(at), q_id))
                ids["vec_id"].append(vec[at])
                ids["score"].append(score)
        kinds = {"query_id": np.int64, "vec_id": np.int64, "score": np.float64}
        return pa.table({k: np.concatenate([np.zeros(0, kinds[k]), *v]).astype(kinds[k]) for k, v in ids.items()})

    met = left.groupBy("dim", "g", "h").cogroup(right.groupBy("dim", "g", "h")).applyInArrow(meet, schema)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return met.withColumn("rank", rank).where(F.col("rank") <= cfg.k).select("query_id", "rank", "vec_id", "score")


def op7_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = materialize(index(read(spark, sf_dir, "embeddings")), "ann-index")
    return search(rows, rows.where("vec_id % 20 = 0"))
