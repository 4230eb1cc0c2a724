"""Helpers that several training-data operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir, materialize, scratch_path  # noqa: F401


#: Bytes of a batch sent to Python at most (or one row), whatever the texts' lengths.
BATCH_BYTES = 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def fold(doc_id: str, folds: int) -> Column:
    """crc32 of the id's decimal text, modulo ``folds`` (null id: empty text)."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % folds


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores added until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def label_table(labels: DataFrame, label: str) -> DataFrame:
    """doc_id, label: the largest label of each id; null ids and labels are none."""
    return (labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
            .groupBy("doc_id").agg(F.max(label).alias("label")))


def smallest_of_each(ids: DataFrame, order, rows: int) -> DataFrame:
    """Of each label the ``rows`` ids of the smallest hash ``order`` (ties: doc_id). Hashes are
    first counted in 4,096 ranges a label, so only ids up to the range that reaches
    ``rows`` are numbered: a label's rows never meet in one task."""
    ids = ids.withColumn("_h", order).withColumn("_range", F.shiftright("_h", 52))
    counts = ids.groupBy("label", "_range").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("label").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    last = (counts.withColumn("_before", F.coalesce(before, F.lit(0))).where(F.col("_before") < rows)
            .groupBy("label").agg(F.max("_range").alias("_last")))
    near = ids.join(materialize(last, "sample-ranges"), "label").where(F.col("_range") <= F.col("_last"))
    nth = F.row_number().over(Window.partitionBy("label").orderBy("_h", "doc_id"))
    return near.withColumn("_nth", nth).where(F.col("_nth") <= rows).select("doc_id", "label")


def training_sample(docs: DataFrame, ids: DataFrame, rows: int, max_bytes: int, per_label: bool = False) -> DataFrame:
    """doc_id, text, label of a bounded part of the labelled documents ``ids``
    (doc_id, label): at most ``rows`` ids, those of the smallest hash of the id
    (``per_label``: of each label), and of them as many as hold ``max_bytes`` of
    text; ``per_label`` takes them in the order of the bytes that their own label
    has up to them, so labels get equal bytes and one with less keeps all of its
    texts. Texts of over a hundredth of ``max_bytes`` take no part, or one of them
    could fill the sample. It is the same at any partitioning. An id with several
    texts gives the smallest text."""
    order = F.xxhash64(F.lit(17), "doc_id")
    ids = smallest_of_each(ids, order, rows) if per_label else ids.orderBy(order, "doc_id").limit(rows)
    ids = materialize(ids, "sample-ids")  # at most `rows` (of each label), so it may be broadcast
    texts = (docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").where(F.octet_length("text") <= max_bytes // 100)
             .groupBy("doc_id").agg(F.min("text").alias("text"), F.max("label").alias("label")))
    texts = materialize(texts, "sample-texts")
    sizes = texts.select("doc_id", "label", F.octet_length("text").alias("_size"))
    turn = [order, F.col("doc_id")]
    if per_label:
        # at most `rows` of a label in a task
        sizes = sizes.withColumn("_own", F.sum("_size").over(Window.partitionBy("label").orderBy(*turn).rowsBetween(Window.unboundedPreceding, 0)))
        turn = [F.col("_own"), *turn]
    sizes = sizes.select("doc_id", F.sum("_size").over(Window.orderBy(*turn)).alias("_upto"))
    return texts.join(sizes.where(F.col("_upto") <= max_bytes).select("doc_id"), "doc_id")


def ranked(df: DataFrame, group: list[str], order: list[str], out: str) -> DataFrame:
    """Number the rows of each group from 0, in ``order``, without a task ever
    holding a whole group.

    Rows are range-partitioned and sorted by group and order, and written with
    their partition and place in it. A row's rank is its place less the first
    place of its group there, plus the group's rows in earlier partitions:
    one row for each partition and each group boundary has to be added up.
    """
    keys = [F.col(c) for c in [*group, *order]]
    at, part = fresh(df, "_at"), fresh(df, "_part")
    rows = materialize(df.repartitionByRange(*keys).sortWithinPartitions(*keys)
                       .withColumn(at, F.monotonically_increasing_id())
                       .withColumn(part, F.shiftright(at, 33)), "ranked")
    spans = materialize(rows.groupBy(*group, part).agg(F.min(at).alias("_first"), F.count(F.lit(1)).alias("_rows")), "ranked-spans")
    before = Window.partitionBy(*group).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.select(*group, part, (F.coalesce(F.sum("_rows").over(before), F.lit(0)) - F.col("_first")).alias("_shift"))
    cond = F.lit(True)
    for c in [*group, part]:
        cond = cond & F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}"))
    return (rows.alias("l").join(spans.alias("r"), cond)
            .select(*[F.col(f"l.{c}") for c in df.columns], (F.col(f"l.{at}") + F.col("r._shift")).alias(out)))
