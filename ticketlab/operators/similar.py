"""Near-duplicate spellings (D7) and the field-consistency bundle.

The original compares every pair of distinct values. Here the pairs come from
an equi-join on shared bigrams, which loses no accepted pair:

* ratio = 2M/T > 0.8 (M matched characters, T = both lengths) needs
  min(len)/max(len) > 2/3, and
* the two strings share more than 0.2*T - 1 bigrams (counted as a multiset:
  every unmatched character breaks at most two bigrams of a string, every
  inserted one at most one, so shared >= 3M - T - 1), hence at least
  max(1, floor(l/3)) for a string of length l, whatever the partner. With
  bigrams in one global order (rarest first), two such strings share a bigram
  among their first l - max(1, floor(l/3)) ("prefix filter").

Tokens are made inside the row: a string's bigrams (and characters), each with its
number among equal ones, as sorted arrays of hashes. Rarest-first needs no dictionary
join: a token's rank comes from the frequency of its hash bucket, a table of a
fixed size that reaches every task. Two tokens that share a hash or bucket can only
look more alike, so no pair is lost by that; the ratio decides.

Only candidate pairs reach the Python ratio (Arrow batches, stdlib difflib, the
exact function the original uses); everything else is Spark expressions.
"""

from __future__ import annotations

import difflib
import math
from fractions import Fraction

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

from .. import constants as K
from ..session import materialize
from .profile import case_variations, value_counts


@pandas_udf(DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series, t: pd.Series) -> pd.Series:
    """difflib's SequenceMatcher(None, a, b).ratio() per row when it can
    exceed ``t``, else -1. real_quick_ratio and quick_ratio are difflib's own
    upper bounds of ratio, so a pair they reject cannot pass."""
    out = []
    for x, y, th in zip(a, b, t):
        m = difflib.SequenceMatcher(None, x, y)
        out.append(m.ratio() if m.real_quick_ratio() > th and m.quick_ratio() > th else -1.0)
    return pd.Series(out, dtype="float64")


# Marked non-deterministic only so that Catalyst keeps it where it is written:
# otherwise the filter on its result is pushed below the candidate pruning and
# the Python ratio runs on every raw join row.
_RATIO = sequence_ratio.asNondeterministic()


# Hash buckets whose frequencies order the tokens (a row of 65,536 numbers).
BUCKETS = 1 << 16


CHARS = "regexp_extract_all(s, '(?s).', 0)"
BIGRAMS = f"transform(array({CHARS}), c -> transform(slice(c, 1, size(c) - 1), (x, i) -> concat(x, c[i + 1])))[0]"


def _tokens(found: str) -> Column:
    """Hashes of the elements of an array, each with its number among equal ones: the
    array is sorted, so that number is its place less the first equal one's. Bound
    once by the outer transform, or each element would sort it anew."""
    return F.expr(f"transform(array(sort_array({found})), g -> transform(g, (x, i) -> hash(x, i - array_position(g, x))))[0]")


def _bucket_ranks(strings: DataFrame) -> Column:
    """One array: the rank of each bucket, the rarest first (ties: bucket number)."""
    used = strings.select(F.explode("tk").alias("t")).select(F.col("t").bitwiseAND(BUCKETS - 1).alias("b"), F.lit(1).alias("n"))
    every = strings.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("b"), F.lit(0).alias("n"))
    counts = used.unionByName(every).groupBy("b").agg(F.sum("n").alias("n"))
    ranks = counts.agg(F.sort_array(F.collect_list(F.struct("n", "b"))).alias("o")).selectExpr(
        "transform(array_sort(transform(o, (e, i) -> struct(e.b as b, i as i))), e -> cast(e.i as bigint)) as ranks")
    return materialize(ranks, "similar-ranks").scalar()


def _fraction(threshold: float) -> tuple[int, int]:
    if not (0.8 <= threshold < 1.0):
        # below 0.8 a pair may share no bigram, so bigram blocking is not lossless
        raise ValueError("similarity threshold must be in [0.8, 1)")
    f = Fraction(int(Fraction(threshold) * 10**6), 10**6)  # rounded down: pruning keeps more, the ratio decides
    return f.numerator, f.denominator


def similar_pairs(values: DataFrame, threshold: float = K.SIMILARITY_THRESHOLD,
                  num_partitions: int | None = None) -> DataFrame:
    """Pairs (x, y), x < y, of distinct strings with threshold < ratio < 1.

    ``values`` has one string column ``s``. The ratio is taken as
    SequenceMatcher(None, x, y) with the smaller string first. With
    threshold = p/q, every test below is integer arithmetic:

    * length band: 2*min/T > p/q;
    * shared bigrams (multiset) > (3p - 2q)/(2q) * T - 1, at least
      t(l) = max(1, floor((3p - 2q) * l / (2q - p))) for a string of length l
      whatever its partner, so two such strings meet in their prefixes of
      l - t(l) rarest bigrams (the blocking equi-join);
    * positional filter: where a pair first meets, the bigrams left in each
      string bound the overlap (drops most pairs that meet on common bigrams);
    * the exact shared-bigram count of a candidate pair and its common
      characters (difflib's quick_ratio bound: 2*common/T > p/q), both from
      intersections of per-string token arrays, are checked before any Python
      runs.
    """
    p, q = _fraction(threshold)
    a_num, a_den = 3 * p - 2 * q, 2 * q - p
    # one row a distinct string, read by the steps below: written once
    strings = materialize(values.select("s").filter(F.length("s") >= 3).distinct().select(
        F.monotonically_increasing_id().alias("id"), "s", F.length("s").alias("l"),
        _tokens(BIGRAMS).alias("tk"), _tokens(CHARS).alias("ck")), "similar-strings")
    # a string's tokens as integers, rarest first
    ordered = strings.select("id", "l", "tk", _bucket_ranks(strings).alias("ranks")).withColumn("t", F.expr(
        f"sort_array(transform(tk, t -> shiftleft(ranks[t & {BUCKETS - 1}], 16) + shiftrightunsigned(t, 16)))"))
    need = F.greatest(F.lit(1), F.floor(F.col("l") * a_num / a_den).cast("int"))
    # Length band: an accepted pair has hi/lo < (2q - p)/p, so with bands
    # k = floor(log_base(l)) its two bands differ by at most one. The blocking
    # key is (token, band) and one side is also filed under the band below its
    # own: a hot bigram is split by length and only pairs whose lengths can
    # still match are compared (no pair is lost, each orientation is met once).
    band = F.floor(F.log(F.col("l").cast("double")) / math.log((2 * q - p) / p)).cast("int")
    prefix = ordered.select("id", "l", band.alias("k"), F.posexplode(F.slice("t", F.lit(1), F.col("l") - need)).alias("r", "tok"))
    # left = this token and the ones after it in the string's order
    left = F.col("l") - F.col("r") - 1
    a = prefix.select("tok", "k", F.col("id").alias("x"), F.col("l").alias("lx"), left.alias("rx"))
    b = prefix.select("tok", F.explode(F.array(F.col("k"), F.col("k") - 1)).alias("k"),
                      F.col("k").alias("ky"), F.col("id").alias("y"), F.col("l").alias("ly"), left.alias("ry"))
    n = num_partitions or int(values.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lo, hi = F.least("lx", "ly"), F.greatest("lx", "ly")
    total = F.col("lx") + F.col("ly")
    # Positional filter: at the pair's first shared token (rarest first) the
    # overlap is at most min(rx, ry); a valid pair passes there, so a join row
    # that fails it is dropped without losing the pair.
    ub = F.least("rx", "ry")
    # same band: both orientations meet, keep x < y; adjacent bands: only the
    # one with x in the lower band meets
    one_way = (F.col("k") < F.col("ky")) | (F.col("x") < F.col("y"))
    cand = (a.join(b, ["tok", "k"])
            .filter(one_way & (2 * q * lo > p * (lo + hi))
                    & (2 * q * (ub + 1) > a_num * total))
            .select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"), total.alias("T"))
            .repartition("x").distinct())   # the partitioning also serves the join below
    bag = strings.select("id", "s", "tk", "ck")
    bx = bag.toDF("x", "sx", "tx", "cx")
    by = bag.toDF("y", "sy", "ty", "cy")
    # common characters bound the matched ones (difflib's quick_ratio): 2*common/T > p/q
    common = F.size(F.array_intersect("cx", "cy"))
    shared = F.size(F.array_intersect("tx", "ty"))
    kept = (cand.join(bx, "x")
            .repartition(n, "y")  # explicit count: AQE keeps the Python work spread out
            .join(by, "y")
            .filter((2 * q * common > p * F.col("T")) & (2 * q * (shared + 1) > a_num * F.col("T")))
            .select(F.least("sx", "sy").alias("x"), F.greatest("sx", "sy").alias("y")))
    return (kept.withColumn("ratio", _RATIO("x", "y", F.lit(float(threshold))))
            .filter((F.col("ratio") > threshold) & (F.col("ratio") < 1.0)))


def similar_values(df: DataFrame, field: str, threshold: float = K.SIMILARITY_THRESHOLD) -> DataFrame:
    """Rows (``value``, ``similar_value``, ``ratio``): two distinct
    spellings whose lower-cased forms have ``threshold < ratio < 1``;
    ``value`` is the smaller spelling (code-point order)."""
    # distinct spellings, written: the tickets are read once
    vals = materialize(df.select(F.col(field).cast("string").alias("v")).filter(F.col("v").isNotNull())
                       .distinct().withColumn("s", F.lower("v")), "similar-values")
    pairs = similar_pairs(vals.select("s"), threshold)
    va = vals.select(F.col("v").alias("va"), F.col("s").alias("x"))
    vb = vals.select(F.col("v").alias("vb"), F.col("s").alias("y"))
    j = pairs.join(va, "x").join(vb, "y")
    return j.select(F.least("va", "vb").alias("value"), F.greatest("va", "vb").alias("similar_value"),
                    F.col("ratio"))


def field_consistency(df: DataFrame, field: str) -> dict[str, DataFrame]:
    """Case variations, value counts and similar values of one field."""
    return {
        "case_variations": case_variations(df, field),
        "value_counts": value_counts(df, field),
        "similar_values": similar_values(df, field),
    }
