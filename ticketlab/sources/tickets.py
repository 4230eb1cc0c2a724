"""Reading ticket files (S1), peeking (S2) and the ticket view of the test tables."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from .. import constants as K
from ..functions.columns import na_to_null


@dataclass(frozen=True)
class ColumnMapping:
    """Which source column feeds which library column.

    ``columns`` are the usual source names. ``aliases`` (source name, library name)
    are further names for a library column, the first ones preferred; any of them
    is preferred to the usual name. Of the names that a file has, the most preferred
    one is taken, its nulls included, and the others are dropped (C1). Columns
    that no name covers are kept as they are.
    """
    columns: tuple[tuple[str, str], ...] = tuple(K.SOURCE_COLUMNS.items())
    aliases: tuple[tuple[str, str], ...] = ()

    @staticmethod
    def parse(pairs) -> "ColumnMapping":
        """From texts ``source=library``; a source name may hold ``=``, a library name cannot."""
        aliases = []
        for text in pairs:
            source, sep, name = text.rpartition("=")
            if not sep or not source or not name:
                raise ValueError(f"column alias must be SOURCE=NAME, not {text!r}")
            aliases.append((source, name))
        return ColumnMapping(aliases=tuple(aliases))

    def chosen(self, present) -> dict[str, str]:
        """Library name by source name, of the columns taken from a file that has ``present``."""
        present, taken = list(present), {}
        # a file already in library names is read too; such a name is the least preferred
        own = [(name, name) for _, name in (*self.aliases, *self.columns)]
        for source, name in (*self.aliases, *self.columns, *own):
            if source in present and source not in taken and name not in taken.values():
                taken[source] = name
        return taken

    def known(self) -> set[str]:
        return {s for pair in (*self.aliases, *self.columns) for s in pair}

    def apply(self, df: DataFrame) -> DataFrame:
        """``df`` in library names, dropped where less preferred; order kept."""
        taken, known = self.chosen(df.columns), self.known()
        return df.select(*[F.col(f"`{c}`").alias(taken.get(c, c)) for c in df.columns if c in taken or c not in known])

    def source_columns(self) -> list[str]:
        """The preferred source name of each library column, in the usual order."""
        first: dict[str, str] = {}
        for source, name in (*self.aliases, *self.columns):
            first.setdefault(name, source)
        return [first.pop(name) for name in dict.fromkeys(n for _, n in self.columns)] + list(first.values())


DEFAULT_MAPPING = ColumnMapping()


def rename_source_columns(df: DataFrame, group_alias: str | None = None) -> DataFrame:
    """Source column names -> library names; the column named ``group_alias``, where
    a file has it, replaces the usual group column (C1). Others are kept as they are."""
    return ColumnMapping(aliases=((group_alias, "group_id"),) if group_alias else ()).apply(df)


def apply_group_alias(raw: DataFrame, alias_col: str) -> DataFrame:
    """C1 on frames that already use library names: the alias column overwrites
    ``group_id`` (nulls included) and is dropped."""
    if alias_col not in raw.columns:
        return raw
    return raw.withColumn("group_id", F.col(alias_col).cast("string")).drop(alias_col)


def read_tickets(spark: SparkSession, path: str, fmt: str = "csv",
                 na_tokens=K.NA_TOKENS, group_alias: str | None = None,
                 mapping: ColumnMapping = DEFAULT_MAPPING) -> DataFrame:
    """Read a ticket file set as string columns with library names (CSAT and
    age stay numeric where the file has them so).

    CSV: header row, quoted fields may hold newlines and doubled quotes, so the
    reader runs in multi-line mode (such files cannot be split; convert them
    once with :func:`ingest_tickets`). ``mapping`` names the columns of files with
    other headers (``group_alias``: one more name for the group column). Text a CSV reader treats as missing
    becomes null. Parquet/JSON: read as they are, other columns cast to string.
    """
    if fmt == "csv":
        df = (spark.read.option("header", True).option("multiLine", True)
              .option("escape", '"').option("inferSchema", False).csv(path))
    elif fmt in ("parquet", "json", "orc"):
        df = spark.read.format(fmt).load(path)
    else:
        raise ValueError(f"unknown ticket format {fmt!r}")
    if group_alias is not None:
        mapping = replace(mapping, aliases=((group_alias, "group_id"), *mapping.aliases))
    df = mapping.apply(df)
    cols = []
    for c in df.columns:
        x = F.col(f"`{c}`")
        if c not in ("csat", "age_days") or not isinstance(df.schema[c].dataType, NumericType):
            x = x.cast("string")
        if fmt == "csv":
            x = na_to_null(x, na_tokens)
        cols.append(x.alias(c))
    return df.select(*cols)


def ingest_tickets(spark: SparkSession, src: str, dst: str, fmt: str = "csv",
                   mapping: ColumnMapping = DEFAULT_MAPPING) -> DataFrame:
    """Convert a raw ticket file set to Parquet once (in library names); later reads split and prune."""
    read_tickets(spark, src, fmt, mapping=mapping).write.mode("overwrite").parquet(dst)
    return spark.read.parquet(dst)


def missing_columns(df: DataFrame) -> list[str]:
    """Expected ticket columns the frame lacks (library names). The optional
    ones (first response, owner, cause, status) are not reported."""
    return [c for c in K.REQUIRED_COLUMNS if c not in df.columns]


def peek(df: DataFrame, n: int = 5) -> DataFrame:
    """The first ``n`` tickets in (created, case number) order."""
    order = [c for c in ("created_at", "case_number") if c in df.columns]
    return df.orderBy(*[F.col(c).asc_nulls_last() for c in order]).limit(n)


# ---------------------------------------------------------------------------
# Ticket view of the driver test tables (FIXTURES.md F3). The text is valid
# Spark SQL and DuckDB SQL; ``{t}`` placeholders are table references.
# Every row of orders becomes one raw ticket; part, supplier and document are
# picked by key modulo the table's own size, so every row of those tables is
# used at every scale, and documents enter whole.
# ---------------------------------------------------------------------------
TICKET_TABLES = ("orders", "customer", "nation", "region", "part", "supplier", "documents")

RAW_TICKETS_SQL = """
select
  cast(case when o.o_orderkey % 20 = 1 then o.o_orderkey - 1 else o.o_orderkey end as string) as id,
  lpad(cast(o.o_orderkey as string), 8, '0') as case_number,
  case when o.o_orderkey % 17 = 0 then null when c.c_custkey % 25 = 0 then 'Acme'
    when c.c_custkey % 25 = 1 then 'Unspecified' else c.c_name end as account_name,
  'G' || cast(c.c_nationkey as string) as group_id,
  case o.o_orderkey % 9 when 0 then 'Error in sync' when 1 then 'Help  needed'
    when 2 then 'Data Quality check' when 3 then null when 4 then 'endpoint question'
    else p.p_name || ' ' || lower(p.p_type) || ' in ' || lower(n.n_name) end as subject,
  case when o.o_orderkey % 11 = 0 then 'mismatched data, GDPR, data  quality'
    when o.o_orderkey % 13 = 0 then null else d.text end as description,
  case when o.o_orderkey % 23 = 0 then null when o.o_orderkey % 23 = 1 then 'Unspecified'
    else p.p_type end as product_area,
  case when o.o_orderkey % 3 = 0 then upper(p.p_brand) else p.p_brand end as product_feature,
  case o.o_orderkey % 10 when 0 then 'CI-Analytics' when 1 then 'DP-' || r.r_name
    when 2 then null else r.r_name end as pod_name,
  case o.o_orderkey % 50 when 3 then 'not a date'
    when 4 then substring(cast(o.o_orderdate as string), 6, 2) || '/' || substring(cast(o.o_orderdate as string), 9, 2)
      || '/' || substring(cast(o.o_orderdate as string), 1, 4)
    else cast(o.o_orderdate as string) end as created_at,
  case when o.o_orderkey % 7 = 0 then null
    else cast(o.o_orderdate + interval '1' hour * (o.o_orderkey % 701) as string) end as closed_at,
  case when o.o_orderkey % 5 = 0 then null
    else cast(o.o_orderdate + interval '1' minute * (o.o_orderkey % 3001) as string) end as first_response_at,
  case s.s_suppkey % 4 when 0 then 'Support Request' when 1 then 'service request'
    when 2 then 'Bug' else null end as case_type,
  case when o.o_orderkey % 29 = 0 then 'SPAM' when o.o_orderkey % 29 = 1 then null
    else s.s_name end as case_owner,
  case when o.o_orderkey % 6 = 0 then 'n/a' else cast(o.o_orderkey % 90 as string) end as age_days,
  case o.o_orderkey % 6 when 0 then 'TRUE' when 1 then '1' when 2 then null else 'false' end as is_escalated,
  case o.o_orderkey % 8 when 0 then 'N/A' when 1 then '4.5' when 2 then '5' when 3 then null
    when 4 then '-3' when 5 then '1.2.3' else '2' end as csat,
  case when o.o_orderpriority = '4-NOT SPECIFIED' then 'p4'
    else 'P' || substring(o.o_orderpriority, 1, 1) end as priority,
  case when o.o_orderkey % 12 = 0 then 'Merged' when o.o_orderkey % 12 = 1 then null
    else o.o_orderstatus end as status,
  case when o.o_orderkey % 3 = 0 then null when o.o_orderkey % 31 = 1 then 'Unspecified'
    else p.p_name end as rca
from {orders} o
  join {customer} c on c.c_custkey = o.o_custkey
  join {nation} n on n.n_nationkey = c.c_nationkey
  join {region} r on r.r_regionkey = n.n_regionkey
  join {part} p on p.p_partkey = o.o_orderkey % (select count(*) from {part})
  join {supplier} s on s.s_suppkey = o.o_orderkey % (select count(*) from {supplier})
  join {documents} d on d.doc_id = o.o_orderkey % (select count(*) from {documents})
"""


def raw_tickets_sql_for(engine_tables: dict[str, str] | None = None) -> str:
    """The mapping text with plain table names (for DuckDB)."""
    names = engine_tables or {t: t for t in TICKET_TABLES}
    return RAW_TICKETS_SQL.format(**names)


def tickets_from_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw tickets (all strings, library names) built from the test tables.

    The keys of an order's part, supplier and document are columns of its row.
    Inside a join key their counts, which are subqueries, fail as soon as Spark
    broadcasts the orders' side: a broadcast does not wait for subqueries of its key.
    """
    frames = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TICKET_TABLES}
    text, keys = RAW_TICKETS_SQL, {}
    for t in ("part", "supplier", "documents"):
        rows = frames[t].agg(F.count(F.lit(1))).scalar()
        keys[f"{t}_key"] = F.col("o_orderkey") % F.nullif(rows, F.lit(0))
        text = text.replace(f"o.o_orderkey % (select count(*) from {{{t}}})", f"o.{t}_key")
    return spark.sql(text, **{**frames, "orders": frames["orders"].withColumns(keys)})
