"""Word frequencies of a text column (A21), the table behind a word cloud."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K


def word_frequencies(t: DataFrame, column: str, n: int = K.TOP_WORDS,
                     stop_words=None) -> DataFrame:
    """Top ``n`` words of ``column``: lower-cased, stop words removed, no
    bigrams. Columns ``word``, ``word_count``, ``weight`` (count / top count).

    Words are counted where they are (explode + partial aggregation before the
    shuffle); the top ``n`` is a TakeOrderedAndProject, so nothing is collected.
    """
    stop = sorted(set(stop_words if stop_words is not None else K.all_stop_words()))
    words = (t.select(F.explode(F.regexp_extract_all(F.lower(F.col(column)), F.lit(K.WORD_PATTERN), 0))
                      .alias("word"))
             .filter(~F.col("word").isin(stop)))
    top = (words.groupBy("word").agg(F.count(F.lit(1)).alias("word_count"))
           .orderBy(F.desc("word_count"), F.asc("word")).limit(n))
    # at most n rows here, so the global window is bounded
    return top.withColumn("weight", F.col("word_count") / F.max("word_count").over(Window.partitionBy()))


def word_tables(t: DataFrame, columns, n: int = K.TOP_WORDS, stop_words=None) -> DataFrame:
    """A21 for several short columns in one pass: ``column``, ``word``, ``word_count``, ``weight``.

    Each ticket gives one row a column, tagged with its name; equal values are
    counted before they are cut into words, so a word's count is a sum over
    values, of which category columns have few. The top ``n`` are limited
    inside each task before a column's rows meet.
    """
    stop = sorted(set(stop_words if stop_words is not None else K.all_stop_words()))
    tagged = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])
    values = (t.select(F.inline(tagged)).filter(F.col("value").isNotNull())
              .groupBy("column", "value").agg(F.count(F.lit(1)).alias("_n")))
    words = (values.select("column", "_n", F.explode(F.regexp_extract_all(F.lower("value"), F.lit(K.WORD_PATTERN), 0)).alias("word"))
             .filter(~F.col("word").isin(stop))
             .groupBy("column", "word").agg(F.sum("_n").alias("word_count")))
    order = Window.partitionBy("column").orderBy(F.desc("word_count"), F.asc("word"))
    top = words.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= n).drop("_rank")
    return top.withColumn("weight", F.col("word_count") / F.max("word_count").over(Window.partitionBy("column")))


def of_column(tables: DataFrame, column: str) -> DataFrame:
    """One column's table, as :func:`word_frequencies` gives it."""
    return (tables.filter(F.col("column") == column).orderBy(F.desc("word_count"), F.asc("word"))
            .select("word", "word_count", "weight"))
