"""Cleaning and casting column functions.

All of these are built-in Spark expressions, so they stay inside whole-stage
code generation; none needs a Python UDF.  Functions that depend on the
source type take the ``DataType`` from ``df.schema`` and are applied through
:func:`to_number0` and friends, which read it for the caller.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from innsight.config import UNKNOWN

# A number as a lenient reader of text accepts it: optional sign, digits with
# an optional fraction (or a bare fraction), optional exponent, blanks around.
# Spark's own cast is laxer ("1d", "2f") so it is guarded by this pattern.
_NUMBER_TEXT = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
_INFINITY_TEXT = r"^[+-]?inf(inity)?$"


def numeric0(c: Column, source_type: T.DataType) -> Column:
    """Lenient numeric coercion: unparsable, NULL or NaN becomes 0.

    Text is parsed to DOUBLE; integral columns keep their type; floating and
    decimal columns become DOUBLE with NaN folded to 0 (Spark's ``sum`` would
    otherwise propagate NaN).
    """
    if isinstance(source_type, T.StringType):
        d = c.try_cast("double")
        parsed = F.when(F.lower(F.trim(c)).rlike(_INFINITY_TEXT), d).when(
            c.rlike(_NUMBER_TEXT) & (F.abs(d) < F.lit(float("inf"))), d
        )
        return F.coalesce(parsed, F.lit(0.0))
    if isinstance(source_type, T.IntegralType):
        return F.coalesce(c, F.lit(0).cast(source_type))
    if isinstance(source_type, (T.FloatType, T.DoubleType, T.DecimalType)):
        d = c.cast("double")
        return F.coalesce(F.nanvl(d, F.lit(None).cast("double")), F.lit(0.0))
    if isinstance(source_type, T.BooleanType):
        return F.coalesce(c.cast("bigint"), F.lit(0).cast("bigint"))
    return F.coalesce(c.try_cast("double"), F.lit(0.0))


def to_number0(df: DataFrame, cols: Iterable[str], only_present: bool = True) -> DataFrame:
    """Apply :func:`numeric0` to ``cols`` in one projection.

    With ``only_present`` a missing column is skipped (the optional measures of
    the email and GA4 sources); otherwise it is an error.
    """
    types = {f.name: f.dataType for f in df.schema.fields}
    todo = {}
    for c in cols:
        if c not in types:
            if only_present:
                continue
            raise KeyError(f"column {c!r} not in {sorted(types)}")
        todo[c] = numeric0(F.col(c), types[c])
    return df.withColumns(todo) if todo else df


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN becomes NULL in every floating column, so that sums and orders skip it."""
    floating = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.FloatType, T.DoubleType))]
    return df.withColumns({c: F.nanvl(F.col(f"`{c}`"), F.lit(None)) for c in floating}) if floating else df


def value_or(primary: Column, fallback: Column) -> Column:
    """``fallback`` where ``primary`` is NULL, NaN or zero, else ``primary``."""
    as_double = F.coalesce(F.nanvl(primary.cast("double"), F.lit(0.0)), F.lit(0.0))
    return F.when(as_double == 0.0, fallback).otherwise(primary)


def month_key(c: Column, source_type: T.DataType) -> Column:
    """``YYYYMM`` (integer or text) to the first day of that month; NULL if malformed."""
    if isinstance(source_type, (T.FloatType, T.DoubleType, T.DecimalType)):
        c = c.cast("bigint")
    text = F.concat(c.cast("string"), F.lit("01"))
    return F.to_date(F.try_to_timestamp(text, F.lit("yyyyMMdd")))


def require_months(df: DataFrame, column: str) -> DataFrame:
    """``df``, failing when run if any ``column`` is no month key.

    The check is a filter on every row.  Its last term is non-deterministic, so
    the optimizer neither prunes it with an unused column nor moves other
    filters below it, where they would hide a bad month.
    """
    c = F.col(column)
    bad = F.concat(F.lit("bad month key: "), F.coalesce(c.cast("string"), F.lit("NULL")))
    good = month_key(c, df.schema[column].dataType).isNotNull()
    return df.filter(F.when(~good, F.raise_error(bad).cast("boolean")).otherwise(F.rand(0) >= 0))


def month_label(c: Column) -> Column:
    """``yyyy-MM`` label of a date."""
    return F.date_format(c, "yyyy-MM")


def wall_clock(c: Column) -> Column:
    """Strict timestamp without time zone, keeping the written wall-clock time."""
    return c.cast("timestamp_ntz")


def lenient_timestamp(c: Column, source_type: T.DataType, formats: Iterable[str] = ("yyyyMMdd",)) -> Column:
    """Lenient date/time parse: unparsable becomes NULL.

    Typed columns are cast (a no-op for ``timestamp_ntz``).  Text is tried as
    an ISO timestamp first, then with each of ``formats`` in turn; no format is
    guessed from the data.
    """
    if isinstance(source_type, (T.TimestampNTZType, T.TimestampType, T.DateType)):
        return c.cast("timestamp_ntz")
    if isinstance(source_type, T.IntegralType):
        c = c.cast("string")
    attempts = [c.try_cast("timestamp_ntz")]
    attempts += [F.try_to_timestamp(c, F.lit(f)).cast("timestamp_ntz") for f in formats]
    return F.coalesce(*attempts)


def transaction_status(ti_status: Column, action: Column) -> Column:
    """``Refunded`` when the item status is 9 or the action is ``refund``, else ``Charged``.

    The status is compared as a number, so ``9``, ``'9'`` and ``9.0`` agree;
    NULLs fall through to ``Charged``.
    """
    refunded = (ti_status.try_cast("double") == F.lit(9.0)) | (action == F.lit("refund"))
    return F.when(refunded, F.lit("Refunded")).otherwise(F.lit("Charged"))


def fill_unknown(df: DataFrame, cols: Iterable[str], label: str = UNKNOWN) -> DataFrame:
    """NULL dimension values become ``label``."""
    return df.fillna(label, subset=list(cols))


def default_if_blank(c: Column, default: Column) -> Column:
    """``c`` unless it is NULL or empty, then ``default``."""
    return F.coalesce(F.nullif(c, F.lit("")), default)


def norm_key_lower(c: Column) -> Column:
    """Trimmed, lower-cased key (emails, customer keys)."""
    return F.lower(F.trim(c))


def norm_key_upper(c: Column) -> Column:
    """Trimmed, upper-cased key (table prefixes)."""
    return F.upper(F.trim(c))


def truncate_int(c: Column) -> Column:
    """Integer part of a number, truncated toward zero."""
    return c.cast("bigint")
