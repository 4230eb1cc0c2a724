"""Language identification of mixed-language text.

Every word is scored under every language by the log likelihood of its byte
trigrams (word edges count as a byte). The script of a word's letters, found by
code-point ranges, first narrows the languages: only those that write a share of
at least ``script_share`` of their letters in it stay candidates. Viterbi then
chooses a language for each word: the sum of scores, less ``switch`` for
every change, is largest. Runs of a language are the spans; the language with
most bytes is the document's, and its share of them is the score.

Viterbi runs over blocks of ``block`` words, all blocks of a slice at once: a block
gives the best score from each entry language to each exit language, these are
chained along the document, and the paths are read off inside the blocks.
Texts of any length take the same number of steps, and the result is the
same as over the whole word sequence.

Edge cases: ``und`` with score 0 for a null text or one without a letter; without
any labelled text every document is ``und``; equal texts give equal results;
ties go to the language first in alphabetical order.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bytetext as B
from .common import bounded_batches, fold, read, training_sample


@dataclass(frozen=True)
class LangConfig:
    table: int = 1 << 16
    alpha: float = 0.1
    sample_rows: int = 3000        # of each language
    sample_bytes: int = 24 << 20
    script_share: float = 0.01
    outside: float = -30.0         # of a word in a language that does not use its script
    switch: float = 12.0
    block: int = 128


# ---------------------------------------------------------------------------
# First code point of each script range (0: letters that all Latin
# alphabets share, and marks that belong to no script).
# ---------------------------------------------------------------------------
RANGES = (
    (0x00, "latin"), (0x370, "greek"), (0x400, "cyrillic"), (0x530, "armenian"), (0x590, "hebrew"), (0x600, "arabic"),
    (0x700, "syriac"), (0x750, "arabic"), (0x900, "devanagari"), (0x980, "bengali"), (0xA00, "gurmukhi"), (0xA80, "gujarati"),
    (0xB00, "oriya"), (0xB80, "tamil"), (0xC00, "telugu"), (0xC80, "kannada"), (0xD00, "malayalam"), (0xD80, "sinhala"),
    (0xE00, "thai"), (0xE80, "lao"), (0xF00, "tibetan"), (0x1000, "myanmar"), (0x10A0, "georgian"), (0x1100, "hangul"),
    (0x1200, "ethiopic"), (0x1780, "khmer"), (0x1800, "mongolian"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "common"),
    (0x3040, "kana"), (0x3100, "han"), (0x3130, "hangul"), (0x3190, "han"), (0xA000, "other"), (0xAC00, "hangul"),
    (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "latin"), (0xFB1D, "hebrew"), (0xFB50, "arabic"), (0xFE00, "common"), (0x10000, "other"),
    (0x20000, "han"), (0x30000, "other"),
)
SCRIPTS = list(dict.fromkeys(["latin", "common", *[name for _, name in RANGES]]))
_STARTS = np.array([a for a, _ in RANGES])
_SCRIPT = np.array([SCRIPTS.index(name) for _, name in RANGES])
LETTER = np.zeros(256, bool)
LETTER[0x80:] = True
for a, z in ("AZ", "az"):
    LETTER[ord(a): ord(z) + 1] = True


@dataclass
class LangModel:
    langs: list[str]
    table: np.ndarray     # trigram bucket x language: log probability
    allowed: np.ndarray   # script x language


@dataclass
class Text:
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    grams: np.ndarray     # trigram bucket of every letter byte
    at: np.ndarray        # index of each word's first, and their number
    script: np.ndarray    # of each word


def analyse(s: B.Slice, table: int) -> Text:
    inside = LETTER[s.data]
    starts, ends, first = B.runs(inside, s.offsets)
    low = np.where(inside, B.lower(s.data), 0x20).astype(np.uint32)
    before, after = np.concatenate(([0x20], low[:-1])), np.concatenate((low[1:], [0x20]))
    if len(starts):
        before[starts], after[ends - 1] = 0x20, 0x20
    key = ((before << 16) | (low << 8) | after)[inside].astype(np.uint64)
    grams = (B.finish(key) % np.uint64(table)).astype(np.int64) if len(key) else np.zeros(0, np.int64)
    at = np.concatenate(([0], np.cumsum(ends - starts)))
    # code points of the non-ASCII letters, at their lead bytes
    script = np.zeros(len(starts), np.int64)
    lead = np.flatnonzero(s.data >= 0xC0)
    if len(lead):
        d = np.concatenate((s.data, np.zeros(3, np.uint8))).astype(np.int64)
        b0, b1, b2, b3 = (d[lead + i] for i in range(4))
        b1, b2, b3 = b1 & 0x3F, b2 & 0x3F, b3 & 0x3F
        cp = np.where(b0 < 0xE0, (b0 & 0x1F) << 6 | b1, np.where(b0 < 0xF0, (b0 & 0x0F) << 12 | b1 << 6 | b2,
                                                              (b0 & 0x07) << 18 | b1 << 12 | b2 << 6 | b3))
        np.maximum.at(script, np.searchsorted(starts, lead, "right") - 1, _SCRIPT[np.searchsorted(_STARTS, cp, "right") - 1])
    script[script == 1] = 0   # marks only
    return Text(starts, ends, first, grams, at, script)


def fit(texts: pa.Array, labels: list[str], cfg: LangConfig = LangConfig()) -> LangModel:
    langs = sorted(set(labels))
    of = np.array([langs.index(x) for x in labels], int)
    counts, written = np.zeros((cfg.table, len(langs))), np.zeros((len(SCRIPTS), len(langs)))
    for s in B.slices(texts):
        t = analyse(s, cfg.table)
        lang = np.repeat(of[s.first: s.first + len(s.offsets) - 1], np.diff(t.first))
        size = t.ends - t.starts
        for i in range(len(langs)):
            own = lang == i
            counts[:, i] += np.bincount(t.grams[np.repeat(own, size)], minlength=cfg.table)
            written[:, i] += np.bincount(t.script[own], size[own], len(SCRIPTS))
    table = np.log((counts + cfg.alpha) / (counts.sum(0) + cfg.alpha * cfg.table))
    share = written / np.maximum(written.sum(0), 1)
    allowed = share >= cfg.script_share
    allowed[~allowed.any(1)] = True    # a script that no language uses decides nothing
    return LangModel(langs, table.astype(np.float32), allowed)


def word_scores(t: Text, m: LangModel, cfg: LangConfig) -> np.ndarray:
    n, k = len(t.starts), len(m.langs)
    out = np.empty((n, k))
    for i in range(k):
        out[:, i] = np.add.reduceat(m.table[:, i][t.grams], t.at[:-1]) if n else 0
    out[~m.allowed[t.script]] += cfg.outside
    return out


def viterbi(scores: np.ndarray, first: np.ndarray, switch: float, block: int) -> np.ndarray:
    """Best language of every word. ``first``: index of each text's first word."""
    n, k = scores.shape
    if n == 0:
        return np.zeros(0, np.int64)
    words = np.diff(first)
    n_blocks = -(-words // block)
    text_of = np.repeat(np.arange(len(words)), n_blocks)
    head = np.concatenate(([0], np.cumsum(n_blocks)))
    number = np.arange(head[-1]) - head[text_of]            # of a block in its text
    start = first[text_of] + number * block
    size = np.minimum(block, first[text_of + 1] - start)
    order = np.argsort(-size, kind="stable")
    start, size, back = start[order], size[order], np.argsort(order)
    active = [int(np.searchsorted(-size, -t, "left")) for t in range(block)]   # blocks longer than t
    # best score from entry language i to exit language j
    cross = np.full((len(size), k, k), -np.inf)
    cross[:, np.arange(k), np.arange(k)] = 0
    for t in range(block):
        a = active[t]
        if a == 0:
            break
        c = cross[:a]
        np.maximum(c, c.max(2, keepdims=True) - switch, out=c)
        c += scores[start[:a] + t][:, None, :]
    cross = cross[back]
    # along each text: best score of entering each block in each language
    enter = np.zeros((len(size), k))
    deep = int(n_blocks.max())
    for b in range(1, deep):
        at = head[:-1][n_blocks > b] + b
        enter[at] = (enter[at - 1][:, :, None] + cross[at - 1]).max(1)
    # backwards: the languages that the best path enters and leaves each block in
    came, left = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
    total = enter[:, :, None] + cross
    for b in range(deep - 1, -1, -1):
        at = head[:-1][n_blocks > b] + b
        last = n_blocks[text_of[at]] == b + 1
        left[at] = np.where(last, total[at].max(1).argmax(1), came[np.minimum(at + 1, len(came) - 1)])
        came[at] = total[at, :, left[at]].argmax(1)
    # inside the blocks, from the known entry to the known exit
    came, left = came[order], left[order]
    best = np.full((len(size), k), -np.inf)
    best[np.arange(len(size)), came] = 0
    stay = np.zeros((block, len(size), k), bool)
    top = np.zeros((block, len(size)), np.int64)
    for t in range(block):
        a = active[t]
        if a == 0:
            break
        d = best[:a]
        peak = d.max(1)
        stay[t, :a] = d >= peak[:, None] - switch
        top[t, :a] = d.argmax(1)
        np.maximum(d, peak[:, None] - switch, out=d)
        d += scores[start[:a] + t]
    path = np.zeros(n, np.int64)
    now = left.copy()
    for t in range(block - 1, -1, -1):
        a = active[t]
        path[start[:a] + t] = now[:a]
        rows = np.arange(a)
        now[:a] = np.where(stay[t, rows, now[:a]], now[:a], top[t, :a])
    return path


RESULT = "struct<lang:string,score:double,spans:array<struct<start:bigint,end:bigint,lang:string>>>"


def identifier(spark: SparkSession, model: LangModel, cfg: LangConfig = LangConfig()):
    """UDF of a text: language, score, and spans (byte places) of languages."""
    bounded_batches(spark)
    held = spark.sparkContext.broadcast(model)   # cfg.table floats a language

    def identify(texts: pa.Array) -> pa.Array:
        m = held.value
        names = np.array([*m.langs, "und"], object)
        lang, score, many, spans = [], [], [], []
        for s in B.slices(texts):
            n = len(s.offsets) - 1
            t = analyse(s, cfg.table)
            if not m.langs or not len(t.starts):
                lang.append(np.full(n, len(m.langs)))
                score.append(np.zeros(n))
                many.append(np.zeros(n, int))
                continue
            path = viterbi(word_scores(t, m, cfg), t.first, cfg.switch, cfg.block)
            doc = np.repeat(np.arange(n), np.diff(t.first))
            k = len(m.langs)
            share = np.bincount(doc * k + path, t.ends - t.starts, n * k).reshape(n, k)
            total = share.sum(1)
            lang.append(np.where(total > 0, share.argmax(1), k))
            score.append(np.divide(share.max(1), total, out=np.zeros(n), where=total > 0))
            new = np.ones(len(path), bool)
            new[1:] = (path[1:] != path[:-1]) | (doc[1:] != doc[:-1])
            head = np.flatnonzero(new)
            tail = np.append(head[1:], len(path)) - 1
            own = s.offsets[doc[head]]
            many.append(np.bincount(doc[head], minlength=n))
            spans.append((t.starts[head] - own, t.ends[tail] - own, path[head]))
        cat = lambda x, kind: np.concatenate(x).astype(kind) if x else np.zeros(0, kind)
        a, z, l = (cat([x[i] for x in spans], np.int64) for i in range(3))
        items = pa.StructArray.from_arrays([pa.array(a), pa.array(z), pa.array(names[l], pa.string())], ["start", "end", "lang"])
        offsets = np.concatenate(([0], np.cumsum(cat(many, np.int64)))).astype(np.int32)
        return pa.StructArray.from_arrays(
            [pa.array(names[cat(lang, np.int64)], pa.string()), pa.array(cat(score, float)), pa.ListArray.from_arrays(pa.array(offsets), items)],
            ["lang", "score", "spans"])
    return F.arrow_udf(identify, RESULT)


FOLDS, HELD_OUT = 4, 2


def train(docs: DataFrame, cfg: LangConfig = LangConfig()) -> LangModel:
    """Fit on a bounded sample of each language, outside the held-out fold."""
    ids = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (fold("doc_id", FOLDS) != HELD_OUT))
    ids = ids.groupBy("doc_id").agg(F.min("lang").alias("label"))
    got = training_sample(docs, ids, cfg.sample_rows, cfg.sample_bytes, per_label=True).toArrow()
    return fit(got["text"].combine_chunks(), got["label"].to_pylist(), cfg)


def op9_viterbi(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    found = identifier(spark, train(docs))("text")
    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    out = docs.select("doc_id", (fold("doc_id", FOLDS) == HELD_OUT).alias("held_out"), found.alias("f"), letters.alias("letters"))
    return out.select("doc_id", "held_out", F.when(F.col("letters"), F.col("f.lang")).otherwise("und").alias("lang_pred"),
                      F.when(F.col("letters"), F.col("f.score")).otherwise(0.0).alias("score"), F.size("f.spans").alias("n_spans"))
