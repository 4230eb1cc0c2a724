"""Incremental ticket ingest with Structured Streaming.

The original takes one uploaded file at a time. As a stream, new ticket
files landing in a folder are cleaned with the same row-level plan as
:func:`ticketlab.operators.clean.clean_tickets` (no state is needed: every
cleaning rule looks at one row) and appended to a month-partitioned Parquet
table that the batch reports read.
"""

from __future__ import annotations

import hashlib
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StringType, StructField, StructType

from .. import constants as K
from ..functions.columns import na_to_null
from ..operators.clean import CleanConfig, clean_tickets
from ..session import ensure_checkpoint_dir
from ..sources.tickets import DEFAULT_MAPPING, ColumnMapping


def raw_ticket_schema(columns=K.SOURCE_COLUMNS) -> StructType:
    """All-string schema in source-column order (a stream needs it up front;
    files must carry these columns in this order). For files with other names
    pass ``mapping.source_columns()``."""
    return StructType([StructField(c, StringType(), True) for c in columns])


def read_ticket_stream(spark: SparkSession, src_dir: str, fmt: str = "csv",
                       schema: StructType | None = None, max_files_per_trigger: int | None = None,
                       mapping: ColumnMapping = DEFAULT_MAPPING) -> DataFrame:
    """Stream of raw tickets (library names, all strings) from files in ``src_dir``.

    Without a ``schema`` the files are expected to have the preferred source
    column of each library column; with one, the most preferred of its columns
    are taken, as in a batch read."""
    r = spark.readStream.schema(schema or raw_ticket_schema(mapping.source_columns()))
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    if fmt == "csv":
        # a stream needs its schema up front; enforceSchema=false makes Spark
        # check every file's header against it instead of trusting positions
        df = (r.option("header", True).option("multiLine", True).option("escape", '"')
              .option("enforceSchema", False).csv(src_dir))
    else:
        df = r.format(fmt).load(src_dir)
    renamed = mapping.apply(df)
    if fmt == "csv":
        renamed = renamed.select(*[na_to_null(c).alias(c) for c in renamed.columns])
    return renamed


def start_clean_ingest(spark: SparkSession, src_dir: str, dst_dir: str, fmt: str = "csv",
                       cfg: CleanConfig = CleanConfig(), checkpoint: str | None = None,
                       schema: StructType | None = None, once: bool = False,
                       mapping: ColumnMapping = DEFAULT_MAPPING) -> StreamingQuery:
    """Clean arriving tickets and append them to ``dst_dir`` (Parquet by month).

    The checkpoint (exactly-once file sink bookkeeping) goes under the shared
    ``spark.checkpoint.dir`` unless given, in a folder of this source and target.
    """
    own = hashlib.sha256(f"{src_dir}\n{dst_dir}".encode()).hexdigest()[:16]
    ckpt = checkpoint or os.path.join(ensure_checkpoint_dir(spark), f"stream-clean-ingest-{own}")
    cleaned = clean_tickets(read_ticket_stream(spark, src_dir, fmt, schema, mapping=mapping), cfg)
    w = (cleaned.writeStream.format("parquet").option("path", dst_dir)
         .option("checkpointLocation", ckpt).partitionBy("month").outputMode("append"))
    w = w.trigger(availableNow=True) if once else w.trigger(processingTime="1 minute")
    return w.start()
