"""Toxicity by multiple-instance learning.

A document is a bag of sentences; only documents are labelled. A sentence's
score is p = sigmoid(b + sum of the weights of its words and word beginnings);
the document's is the noisy-or 1 - (1 - leak) prod(1 - p): one bad sentence
makes it bad. The leak stands for all that words do not tell, however long the
text; a sentence without any word of weight scores 0.
The weights (a hashed table) are fitted on document labels alone, by full-batch
Adam on the likelihood of the noisy-or, over a bounded sample; the sentences
that carry a document's score can then be named. Words that are not clearly
more frequent in toxic documents of the sample (``z``) are no evidence and
keep weight 0.

Sentences end at ``. ! ?`` and line ends; words are runs of ASCII letters, digits
and non-ASCII bytes, A-Z lowered.

Edge cases: a null or empty text, or one without words, has no sentence and
scores the leak; equal texts score alike; without a labelled document of both
kinds the leak is the prior, and scores say nothing (all weights 0).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bytetext as B
from .common import bounded_batches, fold, fresh, label_table, materialize, read, training_sample


@dataclass(frozen=True)
class MilConfig:
    buckets: int = 1 << 18
    sample_rows: int = 16_000      # bounds of the training sample
    sample_bytes: int = 64 << 20
    min_documents: int = 3         # words in fewer sampled documents weigh nothing
    beginnings: tuple = (4, 5)     # bytes of the word beginnings used
    rounds: int = 250
    rate: float = 0.1
    z: float = 3.0                 # standard errors above the sample's toxic share
    l1: float = 1.0                # documents of evidence that a weight has to outweigh
    prior: float = -4.0            # b, and the leak's log odds, at the start


WORD = np.zeros(256, bool)
WORD[0x80:] = True
for lo, hi in ((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A)):
    WORD[lo: hi + 1] = True
STOP = np.zeros(256, bool)
STOP[[ord(c) for c in ".!?\n\r"]] = True


@dataclass
class Bags:
    """Sentences with words, and their words and word beginnings as table indices."""
    doc: np.ndarray       # text of each sentence
    starts: np.ndarray    # its bytes in the text
    ends: np.ndarray
    first: np.ndarray     # index of each sentence's first entry, and the number of entries
    words: np.ndarray


def bags(s: B.Slice, cfg: MilConfig) -> Bags:
    inside = WORD[s.data]
    starts, ends, of_text = B.runs(inside, s.offsets)
    low = B.lower(s.data)
    columns = [B.run_hashes(low, inside, starts, ends)]
    with np.errstate(over="ignore"):
        for n in cfg.beginnings:
            h = np.full(len(starts), n, np.uint64)
            for i in range(n):   # a shorter word ends in zeros, so it is its own beginning
                at = starts + i
                h = h * np.uint64(0x100000001B3) + np.where(at < ends, low[np.minimum(at, len(low) - 1)], 0).astype(np.uint64) + np.uint64(1)
            columns.append(B.finish(h))
    words = (np.stack(columns, 1) % np.uint64(cfg.buckets)).astype(np.int64)
    stops = np.flatnonzero(STOP[s.data])
    doc = np.repeat(np.arange(len(of_text) - 1), np.diff(of_text))
    sentence = np.searchsorted(stops, starts) + doc   # rises at every stop and every text
    at = np.flatnonzero(np.diff(sentence, prepend=-1))
    last = np.append(at[1:], len(sentence))[: len(at)] - 1
    own = s.offsets[doc[at]]
    return Bags(doc[at], starts[at] - own, ends[last] - own, np.append(at, len(sentence)) * len(columns), words.ravel())


def softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, z)


Weights = tuple[np.ndarray, float, float]   # of table entries, b, log odds of the leak


def fit(sentence_doc: np.ndarray, first: np.ndarray, words: np.ndarray, y: np.ndarray, cfg: MilConfig) -> Weights:
    """Sentences with evidence: their document (ascending) and where their
    entries of ``words`` begin; y: each document's label."""
    weights, b, leak, n = np.zeros(cfg.buckets), cfg.prior, cfg.prior, len(y)
    if n == 0 or y.min() == y.max():
        return weights.astype(np.float32), b, leak
    of_sentence = np.repeat(np.arange(len(first) - 1), np.diff(first))
    used, words = np.unique(words, return_inverse=True)
    w, m, v = np.zeros(len(used)), np.zeros(len(used) + 2), np.zeros(len(used) + 2)
    for t in range(1, cfg.rounds + 1):
        z = b + np.bincount(of_sentence, w[words], len(sentence_doc))
        p = 1 / (1 + np.exp(-z))
        total = np.maximum(np.bincount(sentence_doc, softplus(z), n) + softplus(leak), 1e-12)
        slope = np.where(y > 0, -1 / np.expm1(np.minimum(total, 500)), 1.0) / n
        each = slope[sentence_doc] * p
        grad = np.append(np.bincount(words, each[of_sentence], len(used)) + cfg.l1 / n * w / np.sqrt(w ** 2 + 1e-4),
                         [each.sum(), slope.sum() / (1 + np.exp(-leak))])
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad ** 2
        step = cfg.rate * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-9)
        w, b, leak = w - step[:-2], b - step[-2], leak - step[-1]
    weights[used] = w
    return weights.astype(np.float32), float(b), float(leak)


def evidence(sample: DataFrame, cfg: MilConfig) -> np.ndarray:
    """Table entries that are clearly more frequent in toxic documents of the
    sample (text, label). Tasks count documents by entry, a shuffle adds up."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, toxic = np.zeros(cfg.buckets), np.zeros(cfg.buckets)
        for batch in batches:
            y = batch.column(1).to_numpy(zero_copy_only=False).astype(float)
            for s in B.slices(batch.column(0)):
                g = bags(s, cfg)
                pairs = np.unique(np.repeat(g.doc, np.diff(g.first)) * cfg.buckets + g.words)
                seen += np.bincount(pairs % cfg.buckets, minlength=cfg.buckets)
                toxic += np.bincount(pairs % cfg.buckets, y[s.first + pairs // cfg.buckets], cfg.buckets)
        at = np.flatnonzero(seen)
        yield pa.record_batch([pa.array(at), pa.array(seen[at]), pa.array(toxic[at])], ["entry", "seen", "toxic"])
    share = sample.agg(F.avg("label")).first()[0] or 0.0
    counts = sample.select("text", "label").mapInArrow(count, "entry long, seen double, toxic double").groupBy("entry").agg(
        F.sum("seen").alias("seen"), F.sum("toxic").alias("toxic"))
    clear = F.col("toxic") - F.col("seen") * share >= cfg.z * F.sqrt(F.col("seen") * (share * (1 - share)))
    found = counts.where((F.col("seen") >= cfg.min_documents) & clear).select("entry").toArrow()   # at most cfg.buckets numbers
    return np.sort(found["entry"].to_numpy())


def train(docs: DataFrame, ids: DataFrame, cfg: MilConfig = MilConfig()) -> Weights:
    """Fit on a bounded sample of the labelled documents ``ids`` (doc_id, label
    0 or 1). Executors find the entries with evidence and the sentences that
    hold any; the driver gets those."""
    sample = materialize(training_sample(docs, ids, cfg.sample_rows, cfg.sample_bytes), "toxicity-sample")
    telling = np.zeros(cfg.buckets, bool)
    telling[evidence(sample, cfg)] = True
    held = docs.sparkSession.sparkContext.broadcast(telling)

    def index(texts: pa.Array) -> pa.Array:
        out = []
        for s in B.slices(texts):
            g = bags(s, cfg)
            keep = held.value[g.words]
            size = B.per_text(keep.astype(np.int64), g.first)
            words, first = g.words[keep], np.concatenate(([0], np.cumsum(size)))
            for a, z in zip(*(lambda x: (x[:-1], x[1:]))(np.searchsorted(g.doc, np.arange(len(s.offsets))))):
                own = size[a:z]
                out.append({"sizes": own[own > 0], "words": words[first[a]: first[z]]})
        return pa.array(out, pa.struct([("sizes", pa.list_(pa.int32())), ("words", pa.list_(pa.int32()))]))
    got = sample.select("doc_id", F.arrow_udf(index, "struct<sizes:array<int>,words:array<int>>")("text").alias("g"), "label") \
        .select("doc_id", "g.*", "label").toArrow().sort_by("doc_id")
    if got.num_rows == 0:
        return np.zeros(cfg.buckets, np.float32), cfg.prior, cfg.prior
    sizes = got["sizes"].combine_chunks()
    each = sizes.flatten().to_numpy().astype(np.int64)
    return fit(np.repeat(np.arange(got.num_rows), np.diff(sizes.offsets.to_numpy())), np.concatenate(([0], np.cumsum(each))),
               got["words"].combine_chunks().flatten().to_numpy().astype(np.int64), got["label"].to_numpy().astype(float), cfg)


RESULT = "struct<score:double,n_sentences:bigint,offending:array<struct<start:bigint,end:bigint,score:double>>>"


def scorer(spark: SparkSession, model: Weights, cfg: MilConfig = MilConfig(), at_least: float = 0.5):
    """UDF of a text: its score, number of sentences, and the sentences (byte
    places) that score ``at_least`` this much by themselves."""
    bounded_batches(spark)
    held = spark.sparkContext.broadcast(model)   # cfg.buckets floats

    def score(texts: pa.Array) -> pa.Array:
        weights, b, leak = held.value
        scores, counts, many, spans = [], [], [], []
        for s in B.slices(texts):
            g = bags(s, cfg)
            n = len(s.offsets) - 1
            w = weights[g.words]
            tells = B.per_text((w != 0).astype(np.int64), g.first) > 0
            z = np.where(tells, b + B.per_text(w.astype(np.float64), g.first), -np.inf)
            scores.append(-np.expm1(-np.bincount(g.doc, softplus(z), n) - softplus(leak)))
            counts.append(np.bincount(g.doc, minlength=n))
            p = 1 / (1 + np.exp(-z))
            bad = np.flatnonzero(p >= at_least)
            many.append(np.bincount(g.doc[bad], minlength=n))
            spans.append(np.stack([g.starts[bad], g.ends[bad], p[bad]]))
        if not scores:
            scores, counts, many, spans = [np.zeros(0)], [np.zeros(0, int)], [np.zeros(0, int)], [np.zeros((3, 0))]
        where = np.concatenate(spans, 1)
        items = pa.StructArray.from_arrays([pa.array(where[0].astype(np.int64)), pa.array(where[1].astype(np.int64)), pa.array(where[2])],
                                           ["start", "end", "score"])
        offsets = np.concatenate(([0], np.cumsum(np.concatenate(many)))).astype(np.int32)
        return pa.StructArray.from_arrays(
            [pa.array(np.concatenate(scores)), pa.array(np.concatenate(counts).astype(np.int64)),
             pa.ListArray.from_arrays(pa.array(offsets), items)], ["score", "n_sentences", "offending"])
    return F.arrow_udf(score, RESULT)


FOLDS, HELD_OUT = 5, 0


def learned(spark: SparkSession, docs: DataFrame, labels: DataFrame, cfg: MilConfig = MilConfig()):
    """The scorer learned from labels outside the held-out fold."""
    ids = label_table(labels, "toxic").where(fold("doc_id", FOLDS) != HELD_OUT)
    return scorer(spark, train(docs, ids, cfg), cfg)


def drop_toxic(spark: SparkSession, docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``docs`` without those scored at ``threshold`` or more."""
    t = fresh(docs, "_toxicity")
    return docs.withColumn(t, learned(spark, docs, labels)("text")).where(F.col(f"{t}.score") < threshold).drop(t)


def op2_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    t = learned(spark, docs, read(spark, sf_dir, "labels"))("text")
    return docs.select("doc_id", (fold("doc_id", FOLDS) == HELD_OUT).alias("held_out"), t.alias("t")).select(
        "doc_id", "held_out", F.col("t.score").alias("score"), (F.col("t.score") >= 0.5).cast("int").alias("predicted"),
        F.col("t.n_sentences").alias("n_sentences"), F.size("t.offending").alias("n_offending"))
