"""Quality classifier: a generalised additive model with pairwise interactions.

A text gives a few numeric features (lengths, shares of kinds of characters,
repetition). Each feature is cut into bins at its sample's quantiles. The score is
the sigmoid of an intercept, a table entry for each feature's bin, and a table
entry for some pairs of features, on coarser bins. Tables are learned by cyclic
boosting: in each round every feature in turn gets one shallow tree (at most
two cuts) fitted to the current logistic gradients and shrunk; then the pairs
that explain the residuals best are boosted the same way with two-way trees.
Scoring looks up bins and adds, over whole columns.

Training uses a bounded sample of the labelled documents (see ``GamConfig``).

Edge cases: a null or empty text has all features 0 and is scored like any other;
equal texts score alike; without labelled documents of both kinds every score is
the (smoothed) share of the labels seen, or 0.5 without any.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bytetext as B
from .common import bounded_batches, fold, fresh, label_table, read, training_sample


@dataclass(frozen=True)
class GamConfig:
    sample_rows: int = 16_000      # bounds of the training sample
    sample_bytes: int = 64 << 20
    bins: int = 48
    pair_bins: int = 8
    pairs: int = 12
    rounds: int = 150
    pair_rounds: int = 60
    rate: float = 0.1
    least: int = 15                # sampled documents on either side of a cut
    ridge: float = 1.0


FEATURES = (
    "log_words", "log_bytes", "word_bytes", "long_words", "short_words", "upper", "digit", "ascii_punct", "marks", "symbols",
    "bars", "non_ascii", "line_bytes", "repeated_lines", "distinct_words", "repeated_triples", "words_ending_marked", "sentence_words",
)


def _kind(chars: str) -> np.ndarray:
    table = np.zeros(256, bool)
    table[[ord(c) for c in chars]] = True
    return table


UPPER, DIGIT = _kind("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _kind("0123456789")
PUNCT, MARKS, SYMBOLS, BAR = _kind("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"), _kind("!?"), _kind("#$%&*+<=>@^_~\\{}[]"), _kind("|")
LINE = np.zeros(256, bool)
LINE[[0x0A, 0x0D]] = True


def _distinct(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Number of distinct values of each text."""
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    order = np.lexsort((values, doc))
    v, d = values[order], doc[order]
    new = np.ones(len(v), bool)
    new[1:] = (v[1:] != v[:-1]) | (d[1:] != d[:-1])
    return np.bincount(d[new], minlength=len(first) - 1)


def features(s: B.Slice) -> np.ndarray:
    """One row of ``FEATURES`` for each text of the slice."""
    n_bytes = np.diff(s.offsets).astype(float)
    w = B.words(s)
    n_words = np.diff(w.first).astype(float)
    share = lambda x, of: np.divide(x, of, out=np.zeros(len(of)), where=of > 0)
    count = lambda table: np.diff(np.concatenate(([0], np.cumsum(table[s.data])))[s.offsets]).astype(float)
    per_word = lambda flag: B.per_text(flag.astype(float), w.first)
    size = w.ends - w.starts
    lines_at, lines_end, line_first = B.runs(~LINE[s.data], s.offsets)
    line_hash = B.run_hashes(s.data, ~LINE[s.data], lines_at, lines_end)
    n_lines = np.diff(line_first).astype(float)
    triples = w.hashes.copy()
    if len(triples) > 2:
        with np.errstate(over="ignore"):
            triples[:-2] = B.finish(w.hashes[:-2] * B.U64(3) + w.hashes[1:-1] * B.U64(5) + w.hashes[2:] * B.U64(7))
    last = s.data[w.ends - 1] if len(size) else np.zeros(0, np.uint8)
    stops = _kind(".!?")
    return np.column_stack([
        np.log1p(n_words), np.log1p(n_bytes), share(per_word(size), n_words), share(per_word(size > 12), n_words),
        share(per_word(size <= 3), n_words), share(count(UPPER), n_bytes), share(count(DIGIT), n_bytes), share(count(PUNCT), n_bytes),
        share(count(MARKS), n_bytes), share(count(SYMBOLS), n_bytes), share(count(BAR), n_words), share(count(np.arange(256) >= 128), n_bytes),
        np.log1p(share(n_bytes, n_lines)), share(n_lines - _distinct(line_hash, line_first), n_lines),
        share(_distinct(w.hashes, w.first).astype(float), n_words), share(n_words - _distinct(triples, w.first), n_words),
        share(per_word((MARKS | SYMBOLS)[last]), n_words), np.log1p(share(n_words, per_word(stops[last]) + 1)),
    ])


@dataclass
class Gam:
    intercept: float = 0.0
    cuts: list = field(default_factory=list)            # of each feature
    tables: list = field(default_factory=list)
    pair_cuts: list = field(default_factory=list)       # coarser, of each feature
    pairs: list = field(default_factory=list)           # (i, j, table)

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.intercept)
        for c, t, v in zip(self.cuts, self.tables, x.T):
            z += t[np.searchsorted(c, v, "right")]
        for i, j, t in self.pairs:
            z += t[np.searchsorted(self.pair_cuts[i], x[:, i], "right"), np.searchsorted(self.pair_cuts[j], x[:, j], "right")]
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def quantile_cuts(v: np.ndarray, bins: int) -> np.ndarray:
    """Edges between bins of about equal numbers; ties stay in one bin."""
    return np.unique(np.quantile(v, np.arange(1, bins) / bins, method="higher"))


def _tree(g: np.ndarray, h: np.ndarray, n: np.ndarray, cfg: GamConfig) -> np.ndarray:
    """Leaf value of each bin: the best cut, then the best cut of either side."""
    def cut(lo: int, hi: int) -> tuple[float, int]:
        cg, ch, cn = np.cumsum(g[lo:hi]), np.cumsum(h[lo:hi]), np.cumsum(n[lo:hi])
        left, right = slice(0, -1), -1
        gain = (cg[left] ** 2 / (ch[left] + cfg.ridge) + (cg[right] - cg[left]) ** 2 / (ch[right] - ch[left] + cfg.ridge)
                - cg[right] ** 2 / (ch[right] + cfg.ridge))
        gain = np.where((cn[left] >= cfg.least) & (cn[right] - cn[left] >= cfg.least), gain, -1.0)
        at = int(gain.argmax()) if len(gain) else 0
        return (float(gain[at]), lo + at + 1) if len(gain) else (-1.0, lo)
    edges = [0, len(g)]
    gain, at = cut(*edges)
    if gain > 0:
        edges = [0, at, len(g)]
        gain, at = max(cut(0, at), cut(at, len(g)))
        if gain > 0:
            edges = sorted({*edges, at})
    out = np.zeros(len(g))
    for lo, hi in zip(edges[:-1], edges[1:]):
        out[lo:hi] = -g[lo:hi].sum() / (h[lo:hi].sum() + cfg.ridge)
    return out


def _two_way(g: np.ndarray, h: np.ndarray, cfg: GamConfig) -> tuple[float, np.ndarray]:
    """Gain and leaf values of the best tree with one cut on either axis."""
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    a, b = cg.shape
    best, leaf = 0.0, np.zeros_like(g)
    if a < 2 or b < 2:
        return best, leaf
    quarter = lambda c: np.stack([c[:-1, :-1], c[:-1, -1:] - c[:-1, :-1], c[-1:, :-1] - c[:-1, :-1],
                                  c[-1, -1] - c[:-1, -1:] - c[-1:, :-1] + c[:-1, :-1]])
    qg, qh = quarter(cg), quarter(ch)
    gain = (qg ** 2 / (qh + cfg.ridge)).sum(0)
    i, j = np.unravel_index(gain.argmax(), gain.shape)
    value = -qg[:, i, j] / (qh[:, i, j] + cfg.ridge)
    leaf[: i + 1, : j + 1], leaf[: i + 1, j + 1:], leaf[i + 1:, : j + 1], leaf[i + 1:, j + 1:] = value
    return float(gain[i, j]), leaf


def fit(x: np.ndarray, y: np.ndarray, cfg: GamConfig = GamConfig()) -> Gam:
    n, m = x.shape if len(x) else (0, len(FEATURES))
    share = (y.sum() + 0.5) / (n + 1)
    model = Gam(float(np.log(share / (1 - share))), [np.zeros(0)] * m, [np.zeros(1)] * m, [np.zeros(0)] * m)
    if n == 0 or y.min() == y.max():
        return model
    model.cuts = [quantile_cuts(v, cfg.bins) for v in x.T]
    model.tables = [np.zeros(len(c) + 1) for c in model.cuts]
    bins = [np.searchsorted(c, v, "right") for c, v in zip(model.cuts, x.T)]
    sizes = [np.bincount(b, minlength=len(t)) for b, t in zip(bins, model.tables)]
    z = np.full(n, model.intercept)
    for _ in range(cfg.rounds):
        for b, t, size in zip(bins, model.tables, sizes):
            p = 1 / (1 + np.exp(-z))
            step = cfg.rate * _tree(np.bincount(b, p - y, len(t)), np.bincount(b, p * (1 - p), len(t)), size, cfg)
            t += step
            z += step[b]
    model.pair_cuts = [quantile_cuts(v, cfg.pair_bins) for v in x.T]
    coarse = [np.searchsorted(c, v, "right") for c, v in zip(model.pair_cuts, x.T)]
    shape = lambda i, j: (len(model.pair_cuts[i]) + 1, len(model.pair_cuts[j]) + 1)

    def grids(i, j):
        a, b = shape(i, j)
        cell, p = coarse[i] * b + coarse[j], 1 / (1 + np.exp(-z))
        return cell, np.bincount(cell, p - y, a * b).reshape(a, b), np.bincount(cell, p * (1 - p), a * b).reshape(a, b)
    ranked = sorted(((_two_way(*grids(i, j)[1:], cfg)[0], i, j) for i in range(m) for j in range(i)), reverse=True)
    model.pairs = [(i, j, np.zeros(shape(i, j))) for _, i, j in ranked[: cfg.pairs]]
    for _ in range(cfg.pair_rounds):
        for i, j, t in model.pairs:
            cell, g, h = grids(i, j)
            step = cfg.rate * _two_way(g, h, cfg)[1]
            t += step
            z += step.ravel()[cell]
    return model


def train(docs: DataFrame, ids: DataFrame, cfg: GamConfig = GamConfig()) -> Gam:
    """Fit on a bounded sample of ``ids`` (doc_id, label 0 or 1); executors
    compute the features, the driver gets those."""
    def rows(texts: pa.Array) -> pa.Array:
        parts = [features(s) for s in B.slices(texts)]
        x = np.concatenate(parts) if parts else np.zeros((0, len(FEATURES)))
        offsets = np.arange(len(x) + 1, dtype=np.int32) * len(FEATURES)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(x.ravel()))
    sample = training_sample(docs, ids, cfg.sample_rows, cfg.sample_bytes)
    got = sample.select("doc_id", F.arrow_udf(rows, "array<double>")("text").alias("x"), "label").toArrow().sort_by("doc_id")
    x = got["x"].combine_chunks().flatten().to_numpy().reshape(-1, len(FEATURES)) if got.num_rows else np.zeros((0, len(FEATURES)))
    return fit(x, got["label"].to_numpy().astype(float), cfg)


def scorer(spark: SparkSession, model: Gam):
    """UDF of a text: its score."""
    bounded_batches(spark)
    held = spark.sparkContext.broadcast(model)   # some tables of at most 48 numbers

    def score(texts: pa.Array) -> pa.Array:
        parts = [held.value.score(features(s)) for s in B.slices(texts)]
        return pa.array(np.concatenate(parts) if parts else np.zeros(0))
    return F.arrow_udf(score, "double")


FOLDS, HELD_OUT = 3, 1


def learned(spark: SparkSession, docs: DataFrame, labels: DataFrame, cfg: GamConfig = GamConfig()):
    """The scorer learned from labels outside the held-out fold."""
    ids = label_table(labels, "quality").where(fold("doc_id", FOLDS) != HELD_OUT)
    return scorer(spark, train(docs, ids, cfg))


def drop_low(spark: SparkSession, docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``docs`` without those scored below ``threshold``."""
    q = fresh(docs, "_quality")
    return docs.withColumn(q, learned(spark, docs, labels)("text")).where(F.col(q) >= threshold).drop(q)


def op5_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    q = learned(spark, docs, read(spark, sf_dir, "labels"))("text")
    return docs.select("doc_id", (fold("doc_id", FOLDS) == HELD_OUT).alias("held_out"), q.alias("score")).withColumn(
        "predicted", (F.col("score") >= 0.5).cast("int"))
