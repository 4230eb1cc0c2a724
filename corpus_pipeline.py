"""Five stages from raw documents to packed sequences.

Each stage takes (spark, docs, sf_dir), works on all that the stage before kept,
and returns a DataFrame; all but the last return the columns of documents.

1. toxicity: documents scored 0.5 or more go (labels.toxic outside the held-out fold teaches the scores);
2. quality: documents scored below 0.5 go (labels.quality likewise);
3. near duplicates: of documents linked by 5-word shingle sets of similarity 0.8 or more, directly
   or in a chain, the one with the smallest doc_id stays; documents without words all stay;
4. decontamination: documents that hold a benchmark item, with its own or exchanged values, go;
5. packing: the rest is cut and packed into sequences of 2048 tokens.

Edge cases: an empty table stays empty through all stages; a null text scores as an
empty one (never toxic; its quality as learned), is no duplicate, matches no item and packs as
the end id; extra columns pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ticketlab.llm import decontam, minhash, packing, quality, toxicity
from ticketlab.llm.common import materialize, read

#: Links at 0.8: a pair is lost by the 30 bands of 4 rows with a chance of 1.3e-7.
NEAR = minhash.MinHashConfig(shingle=5, num=80, den=100, bands=30, rows=4, slack=0.075)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(spark, docs, read(spark, sf_dir, "labels"))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.drop_low(spark, docs, read(spark, sf_dir, "labels"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.keep_one(docs, NEAR)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.decontaminate(docs, read(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: Trained scores and the packing have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
