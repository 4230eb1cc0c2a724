"""Sharding by weighted rendezvous hashing (DataFrame functions only).

Every shard scores a record by a hash of (record key, shard number); the record
goes to the shard with the largest score ``-weight / ln(u)``, where u in (0, 1)
comes from the hash. A shard's share is its weight's share of all weights, and
since the scores of other shards do not change, one more shard takes rows only
into itself, and a removed shard's rows spread over the rest.

Edge cases: a null key hashes as a missing value and is placed like any other;
rows with equal keys go to one shard; a null text counts as empty. Slots number
a shard's rows from 0 without gaps, in key order (ties: text checksum, size).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ranked, read

#: The law of this placement: key and shards alone decide.
LAW = "key"


def shard_of(keys: Sequence[str], weights: Sequence[float]) -> Column:
    """Shard number (0-based) of a record key under the given shard weights.
    A shard with weight 0 gets nothing."""
    if not any(w > 0 for w in weights) or any(w < 0 for w in weights):
        raise ValueError("weights must be 0 or more, and one of them above 0")
    scores = []
    for shard, weight in enumerate(weights):
        if weight > 0:
            h = F.xxhash64(*keys, F.lit(shard))
            u = (F.shiftrightunsigned(h, 11).cast("double") + 0.5) / float(1 << 53)
            scores.append(F.struct((F.lit(-float(weight)) / F.ln(u)).alias("score"), F.lit(shard).alias("shard")))
    return F.array_max(F.array(*scores))["shard"]


def place(df: DataFrame, keys: Sequence[str], weights: Sequence[float], shard: str = "shard") -> DataFrame:
    """``df`` with a shard column, no shuffle."""
    return df.withColumn(shard, shard_of(keys, weights))


def write_shards(df: DataFrame, keys: Sequence[str], weights: Sequence[float], path: str, shard: str = "shard") -> None:
    """Write the rows as Parquet, one folder a shard. Each task appends files to
    the folders that its rows belong to, so nothing is shuffled and no shard
    has to fit a task."""
    place(df, keys, weights, shard).write.partitionBy(shard).parquet(path)


def op8_rendezvous(spark: SparkSession, sf_dir: str, shards: int = 8) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    text = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    rows = docs.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.lit(LAW).alias("law"),
        shard_of(["doc_id"], [1.0] * shards).alias("shard"),
        shard_of(["doc_id"], [1.0] * (shards + 1)).alias("grown_shard"))
    return (ranked(rows, ["shard"], ["doc_id", "text_crc32", "size"], "slot")
            .select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"))
