"""Packing documents into sequences as a cutting-stock problem.

1. Each document becomes token ids and an end id, cut into full sequences and one
   rest below the sequence length.
2. Rests are counted by length (in units of ``unit`` tokens, rounded up): a
   histogram of at most ``length / unit`` bars, whatever the number of documents.
3. A linear program over patterns (how many rests of each bar a sequence
   holds) minimises the number of sequences. Its columns are generated: an
   unbounded-knapsack dynamic program finds the pattern of largest value under
   the current dual prices, until none is worth more than one sequence.
4. Pattern counts are rounded down; the few rests left over (less than one
   pattern for each bar) are packed best-fit, longest first.
5. Rests are ranked within their bar, and the ranks of a bar are dealt to the
   patterns' sequences by a small table (bars x patterns, a fixed bound).
   Ranking, dealing and offsets are Spark jobs; only the histogram meets the driver.

Cut freely: documents over the length are cut, rests are not. Padding comes
from rounding lengths up to units and from the last sequences. Every
sequence is filled from offset 0 without gaps.

Edge cases: a null or empty text is the end id alone; rows that repeat a
doc_id are packed as documents of their own; an empty table gives no pieces.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import bytetext as B
from .common import bounded_batches, materialize, ranked, read
from .tokens import END_ID, SLICE_BYTES, default_path, piece_ids

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


@dataclass(frozen=True)
class PackConfig:
    length: int = 2048
    unit: int = 4
    gap: float = 0.002          # the linear program ends this near its lower bound
    smoothing: float = 0.8
    max_columns: int = 1500     # a stop for the linear program; any basis is a valid packing
    tokenizer: str | None = None


def pieces(docs: DataFrame, cfg: PackConfig) -> DataFrame:
    """Full sequences and the rest of every document, with the ids' checksum."""
    path, length = cfg.tokenizer or default_path(), cfg.length

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = piece_ids(path)
        for b in batches:
            doc_ids = b.column(0)
            for s in B.slices(b.column(1), SLICE_BYTES):
                ids, first = tokens.slice(s)
                view = memoryview(np.insert(ids, first[1:], END_ID).astype("<u4").tobytes())
                first = first + np.arange(len(first))
                total = np.diff(first)
                count = -(-total // length)
                doc = np.repeat(np.arange(len(total)), count)
                start = (np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)) * length
                size = np.minimum(length, total[doc] - start)
                crc = [zlib.crc32(view[4 * a: 4 * (a + n)]) for a, n in zip((first[doc] + start).tolist(), size.tolist())]
                yield pa.record_batch([doc_ids.take(pa.array(s.first + doc)), *map(pa.array, (start, size, np.array(crc, np.int64), total[doc]))],
                                      ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, PIECES)


def best_pattern(value: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[float, dict[int, int]]:
    """The multiset of items (by index) of largest total value that fits."""
    best, taken = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    order = np.argsort(sizes, kind="stable")
    s, v = sizes[order], value[order]
    upto = np.searchsorted(s, np.arange(capacity + 1), "right")
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        if upto[c]:
            gain = best[c - s[: upto[c]]] + v[: upto[c]]
            i = int(gain.argmax())
            if gain[i] > best[c] + 1e-12:
                best[c], taken[c] = gain[i], order[i]
    items: Counter = Counter()
    c = capacity
    while c > 0:
        if taken[c] < 0:
            c -= 1
        else:
            items[int(taken[c])] += 1
            c -= int(sizes[taken[c]])
    return float(best[capacity]), dict(items)


def first_basis(sizes: np.ndarray, counts: np.ndarray, capacity: int) -> tuple[list[dict[int, int]], np.ndarray]:
    """A basis to begin with: the fullest pattern of the sizes left, larger ones
    first, as often as they last, again and again. Each pattern uses a size up, and
    later ones do not hold it, so the patterns' matrix is triangular."""
    left, alive = counts.astype(float), np.ones(len(sizes), bool)
    basis: list[dict[int, int]] = [{} for _ in sizes]
    x = np.zeros(len(sizes))
    value = sizes * (1 + 0.05 * sizes / capacity)
    while alive.any():
        at = np.flatnonzero(alive)
        _, found = best_pattern(value[at], sizes[at], capacity)
        pattern = {int(at[i]): a for i, a in found.items()}
        end = min(pattern, key=lambda i: left[i] / pattern[i])
        times = left[end] / pattern[end]
        for i, a in pattern.items():
            left[i] = max(left[i] - times * a, 0.0)
        basis[end], x[end], alive[end] = pattern, times, False
        for i in np.flatnonzero(alive & (left <= 1e-9)):   # used up by the same pattern
            basis[i], alive[i] = {int(i): int(capacity // sizes[i])}, False
    return basis, x


def solve(sizes: np.ndarray, counts: np.ndarray, capacity: int, cfg: PackConfig) -> list[tuple[float, dict[int, int]]]:
    """Basis of the linear program: minimise the sum of x over patterns, subject
    to holding each size ``counts`` times. Revised simplex with an explicit
    inverse; sizes are at most ``capacity``.

    Dual prices swing widely from column to column, so columns are priced
    between the current prices and the best ones so far, those of the largest
    lower bound; at first a size's share of the capacity. The program ends when its
    value is within ``gap`` of that bound, or no pattern is worth more than 1.
    """
    basis, x = first_basis(sizes, counts, capacity)
    inverse = np.linalg.inv(np.array([[p.get(i, 0) for p in basis] for i in range(len(sizes))], float))
    centre, bound, weight = sizes / capacity, float((counts * sizes).sum() / capacity), cfg.smoothing
    for _ in range(cfg.max_columns):
        if x.sum() <= bound * (1 + cfg.gap):
            break
        price = inverse.sum(0)
        between = weight * centre + (1 - weight) * price
        worth, pattern = best_pattern(between, sizes, capacity)
        at, times = np.array(list(pattern)), np.array(list(pattern.values()), float)
        if worth > 0 and (counts * between).sum() / worth > bound:
            bound, centre = float((counts * between).sum() / worth), between / worth
        if not len(at) or (price[at] * times).sum() <= 1 + 1e-9:
            if weight == 0:
                break
            weight = weight / 2 if weight > 0.01 else 0.0
            continue
        weight = cfg.smoothing
        direction = inverse[:, at] @ times
        up = direction > 1e-9
        ratio = np.where(up, x / np.where(up, direction, 1), np.inf)
        leave = int(ratio.argmin())
        step = ratio[leave]
        x = np.maximum(x - step * direction, 0)
        x[leave] = step
        row = inverse[leave] / direction[leave]
        inverse -= np.outer(direction, row)
        inverse[leave] = row
        basis[leave] = pattern
    return list(zip(x, basis))


def plan(histogram: dict[int, int], cfg: PackConfig) -> list[tuple[int, Counter]]:
    """Patterns (times, {size in units: items}) that hold every rest."""
    if not histogram:
        return []
    capacity = cfg.length // cfg.unit
    sizes = np.array(sorted(histogram))
    counts = np.array([histogram[s] for s in sizes])
    left = counts.copy()
    out: list[tuple[int, Counter]] = []
    for x, pattern in solve(sizes, counts.astype(float), capacity, cfg):
        times = int(x + 1e-6)
        for i, a in pattern.items():
            times = min(times, int(left[i]) // a)
        if times > 0:
            for i, a in pattern.items():
                left[i] -= times * a
            out.append((times, Counter({int(sizes[i]): a for i, a in pattern.items()})))
    rooms: list[list[Counter]] = [[] for _ in range(capacity + 1)]  # sequences by free units
    for i in range(len(sizes) - 1, -1, -1):
        size = int(sizes[i])
        for _ in range(int(left[i])):
            free = next((f for f in range(size, capacity + 1) if rooms[f]), None)
            room = rooms[free].pop() if free is not None else Counter()
            room[size] += 1
            rooms[(capacity if free is None else free) - size].append(room)
    return out + [(1, room) for level in rooms for room in level]


def pack(docs: DataFrame, cfg: PackConfig = PackConfig()) -> DataFrame:
    """Columns of ``PIECES``, sequence_id and offset."""
    spark = docs.sparkSession
    bounded_batches(spark)
    cut = pieces(docs, cfg).withColumn("bar", F.ceil(F.col("length") / cfg.unit).cast("int"))
    cut = cut.withColumn("bar", F.when(F.col("length") < cfg.length, F.col("bar")).otherwise(-1))  # -1: full
    cut = materialize(cut, "pack-cut")   # ranking reads it twice; texts are tokenised once
    dealt = materialize(ranked(cut, ["bar"], ["doc_id", "start", "ids_crc32"], "rank"), "pack-pieces")
    bars = {r["bar"]: r["n"] for r in dealt.groupBy("bar").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most length / unit + 1 rows
    full = bars.pop(-1, 0)

    # ranks [low, high) of a bar go to a pattern's sequences, `each` to a sequence
    used: Counter = Counter()
    table, sequence = [], full
    for times, pattern in plan(bars, cfg):
        for place, (bar, each) in enumerate(sorted(pattern.items(), reverse=True)):
            table.append((bar, used[bar], used[bar] + times * each, each, sequence, place))
            used[bar] += times * each
        sequence += times
    rule = F.broadcast(spark.createDataFrame(table, "bar int, low long, high long, each int, first long, place int"))
    rests = (dealt.where("bar >= 0").join(rule, "bar").where("rank >= low and rank < high")
             .withColumn("sequence_id", F.col("first") + F.floor((F.col("rank") - F.col("low")) / F.col("each"))))
    before = Window.partitionBy("sequence_id").orderBy("place", "rank").rowsBetween(Window.unboundedPreceding, -1)
    rests = rests.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)))
    whole = dealt.where("bar < 0").withColumn("sequence_id", F.col("rank")).withColumn("offset", F.lit(0).cast("long"))
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    return whole.select(columns).unionByName(rests.select(columns))


def op6_cutting_stock(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"))
