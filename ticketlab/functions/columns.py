"""Column expressions for ticket cleaning. All built-in Spark functions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as K


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def quoted(name: str) -> str:
    """A column name that may hold dots, as text that names this column."""
    return "`" + name.replace("`", "``") + "`"


def na_to_null(c: str | Column, tokens: Iterable[str] = K.NA_TOKENS) -> Column:
    """Text that a CSV reader would read as missing becomes null."""
    c = col(c)
    return F.when(c.isin(list(tokens)), F.lit(None).cast("string")).otherwise(c)


def labelled(c: str | Column, missing_label: str = K.MISSING_LABEL) -> Column:
    """Text column with missing values replaced by a label."""
    return F.coalesce(col(c).cast("string"), F.lit(missing_label))


def clean_numeric(c: str | Column) -> Column:
    """A column that already is numeric: its absolute value as a double;
    missing, NaN and infinite values are 0."""
    x = F.abs(col(c).cast("double"))
    return F.when(x < float("inf"), x).otherwise(0.0)


def clean_number(c: str | Column) -> Column:
    """Text to a number: every character that is not a digit or a dot becomes ``0``; then to
    double, with anything unparseable or missing as 0.

    ``-4`` -> 4, ``5 stars`` -> 5000000, ``1.2.3`` -> 0, ``N/A`` -> 0.
    """
    return F.coalesce(
        F.regexp_replace(col(c).cast("string"), r"[^0-9.]", "0").try_cast("double"),
        F.lit(0.0),
    )


# Patterns the ISO cast already reads (zone-free), and month-first patterns
# rewritten to ISO text, so that no built-in format depends on the session
# time zone (a parse in a zone with daylight saving would move wall times that
# fall in the spring-forward gap).
_ISO_FORMATS = {"yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd"}
_MONTH_FIRST = {
    "M/d/yyyy": (r"^(\d{1,2})/(\d{1,2})/(\d{4})$", "$3-$1-$2"),
    "M/d/yyyy HH:mm:ss": (r"^(\d{1,2})/(\d{1,2})/(\d{4}) (\d{1,2}:\d{1,2}:\d{1,2})$", "$3-$1-$2 $4"),
}


def parse_timestamp(c: str | Column, formats: Iterable[str] = K.DATE_FORMATS) -> Column:
    """Text to ``timestamp_ntz`` per row: ISO-8601 first (an offset is dropped and
    the wall time kept), then each format in turn; null when nothing fits.

    The built-in formats never depend on the session time zone: ISO-like ones
    are read by the cast, month-first ones are rewritten to ISO text and cast.
    Other formats a caller adds are parsed with ``try_to_timestamp`` in the
    session zone (keep it UTC, as :func:`ticketlab.session.get_spark` does).
    """
    c = col(c).cast("string")
    tries = [c.try_cast("timestamp_ntz")]
    for fmt in formats:
        if fmt in _ISO_FORMATS:
            continue
        if fmt in _MONTH_FIRST:
            pat, iso = _MONTH_FIRST[fmt]
            tries.append(F.when(c.rlike(pat), F.regexp_replace(c, pat, iso)).try_cast("timestamp_ntz"))
        else:
            tries.append(F.try_to_timestamp(c, F.lit(fmt)).cast("timestamp_ntz"))
    return F.coalesce(*tries)


def rejected_timestamp(c: str | Column, formats: Iterable[str] = K.DATE_FORMATS) -> Column:
    """True for a value that is there (no missing-value text) but is no date."""
    c = col(c).cast("string")
    return na_to_null(c).isNotNull() & parse_timestamp(c, formats).isNull()


def strict_timestamp(c: str, formats: Iterable[str] = K.DATE_FORMATS) -> Column:
    """As :func:`parse_timestamp`, but a rejected value ends the job with an error
    that names the column and the value."""
    formats = tuple(formats)
    told = F.concat(F.lit(f"{c} is not a date: "), F.substring(col(c).cast("string"), 1, 100))
    return F.when(rejected_timestamp(c, formats), F.raise_error(told).cast("timestamp_ntz")).otherwise(parse_timestamp(c, formats))


def is_true_text(c: str | Column) -> Column:
    """Only the text ``true`` in any letter case is true; all else false."""
    return F.coalesce(F.lower(col(c).cast("string")) == F.lit("true"), F.lit(False))


def clean_priority(c: str | Column, pattern: str = K.PRIORITY_PATTERN) -> Column:
    c = col(c).cast("string")
    return F.when(F.coalesce(c.rlike(pattern), F.lit(False)), c).otherwise(F.lit(K.UNSPECIFIED))


def priority_rank(c: str | Column) -> Column:
    """Number after the ``P``; 999 for anything else. Unbounded, so decimal."""
    c = col(c)
    return F.coalesce(
        F.when(c.startswith("P"), F.substring(c, 2, 1 << 30).try_cast("decimal(38,0)")),
        F.lit(K.PRIORITY_RANK_DEFAULT).cast("decimal(38,0)"),
    )


def account_label(c: str | Column, max_length: int = K.ACCOUNT_LABEL_LENGTH) -> Column:
    """Display name: names over ``max_length`` characters are cut and get ``...``."""
    c = col(c)
    return F.when(F.length(c) > max_length, F.concat(F.substring(c, 1, max_length), F.lit("..."))).otherwise(c)


def month_of(ts: str | Column) -> Column:
    return F.date_format(col(ts), "yyyy-MM")


def round_half_even(x: str | Column, digits: int = 1) -> Column:
    """Round half to even (0.25 -> 0.2), as Python's round does."""
    scale = float(10 ** digits)
    return F.rint(col(x) * F.lit(scale)) / F.lit(scale)


def micros_between(start: str | Column, end: str | Column) -> Column:
    return F.timestamp_diff("MICROSECOND", col(start), col(end))


def days_between(start: str | Column, end: str | Column) -> Column:
    return micros_between(start, end).cast("double") / F.lit(86_400_000_000.0)


def hours_between(start: str | Column, end: str | Column) -> Column:
    return micros_between(start, end).cast("double") / F.lit(3_600_000_000.0)


def contains_ci(c: str | Column, pattern: str) -> Column:
    """Case-insensitive regex search, null as false."""
    return F.coalesce(col(c).rlike(f"(?iu){pattern}"), F.lit(False))


def safe_rate(num: Column, den: Column) -> Column:
    return F.try_divide(num.cast("double"), den.cast("double"))
