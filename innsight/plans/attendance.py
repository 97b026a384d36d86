"""Attendance by booking date ("Book Date") and by event date ("Event Date").

Pipeline: lenient numbers -> transaction status -> business names -> value
fallback -> ``Unknown`` dimensions -> lenient date -> closed date range ->
facet filters -> sum per (Item, Department) -> sort.  Facet picks on raw
dimensions and the date range are applied to the raw columns so that they
reach the scan.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from innsight.config import UNKNOWN
from innsight.functions.clean import fill_unknown, lenient_timestamp, to_number0, transaction_status, value_or
from innsight.operators.filters import DateLike, closed_range, facet_filter, facet_options, facet_predicate
from innsight.operators.measures import exact_sum0, grand_total, sum0, with_total_row

# Source column -> report column.
RENAME = {
    "TI_ITEMNAME": "Item", "PRODUCT_CATEGORY": "Department", "TB_GUESTS": "Net Attendance",
    "TB_SUBTOTALAGREE": "Net Value", "ADDED_PRICE": "ValueAdded", "SOURCE": "Source",
    "NETWORK": "Network", "VP_VENUENAME": "Venue", "P_CURRENTSTATUS": "Booking Status",
}
NUMERIC = ("TB_GUESTS", "TB_SUBTOTALAGREE", "ADDED_PRICE")
FILLED = ("Item", "Department", "Venue", "Source", "Network", "Booking Status")
FACETS = ("Source", "Network", "Department", "Venue", "Item", "Booking Status", "Transaction Status")
BOOK_DATE = "T_TRANSDATE"
EVENT_DATE = "TI_CALDATE"

_RAW = {label: raw for raw, label in RENAME.items()}

Picks = Mapping[str, Sequence[str]]
DateRange = tuple[DateLike, DateLike] | None


def clean_transactions(raw: DataFrame) -> DataFrame:
    """Typed, renamed, filled transaction rows with ``Transaction Status``."""
    df = to_number0(raw, NUMERIC, only_present=False)
    df = df.withColumn("Transaction Status", transaction_status(F.col("TI_STATUS"), F.col("TB_ACTION")))
    df = df.withColumnsRenamed(RENAME)
    df = df.withColumn("Net Value", value_or(F.col("Net Value"), F.col("ValueAdded")))
    return fill_unknown(df, FILLED)


def _typed_date(raw: DataFrame, date_col: str) -> bool:
    return isinstance(raw.schema[date_col].dataType, (T.DateType, T.TimestampType, T.TimestampNTZType))


def attendance_base(raw: DataFrame, date_col: str, date_range: DateRange = None) -> DataFrame:
    """Cleaned rows with ``Date``, restricted to the closed date range when given."""
    if date_range is not None and _typed_date(raw, date_col):
        raw = closed_range(raw, date_col, *date_range)  # reaches the scan
        date_range = None
    df = clean_transactions(raw).withColumn("Date", lenient_timestamp(F.col(date_col), raw.schema[date_col].dataType))
    if date_range is not None:
        df = closed_range(df, "Date", *date_range)
    return df


def attendance_rows(raw: DataFrame, date_col: str, date_range: DateRange = None, picks: Picks | None = None) -> DataFrame:
    """Rows after the date range and every facet pick."""
    picks = {k: v for k, v in (picks or {}).items() if v}
    pushed = {k: v for k, v in picks.items() if k in _RAW and k in FILLED}
    for label, vals in pushed.items():
        raw = raw.filter(facet_predicate(_RAW[label], vals, UNKNOWN))
    rest = {k: v for k, v in picks.items() if k not in pushed}
    return facet_filter(attendance_base(raw, date_col, date_range), rest)


def attendance_grouped(raw: DataFrame, date_col: str, date_range: DateRange = None, picks: Picks | None = None,
                       by: Sequence[str] = ()) -> DataFrame:
    """Unrounded sums per (Item, Department): the one aggregate behind the
    summary, the total and the export (small: one row per group)."""
    return _summary(attendance_rows(raw, date_col, date_range, picks), by)


def summary_of(grouped: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return grouped.orderBy(*by, *_order())


def total_of(grouped: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return grand_total(grouped, ["Net Attendance", "Net Value"], by=by)


def export_of(grouped: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return with_total_row(grouped, total_of(grouped, by), _order(), by)


def _summary(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return rows.groupBy(*by, "Item", "Department").agg(
        sum0("Net Attendance").alias("Net Attendance"),
        exact_sum0("Net Value").alias("Net Value"),
    )


def _order() -> list:
    return [F.desc_nulls_last("Net Attendance"), F.col("Item"), F.col("Department")]


def attendance_summary(raw: DataFrame, date_col: str, date_range: DateRange = None, picks: Picks | None = None,
                       by: Sequence[str] = ()) -> DataFrame:
    """Net attendance and net value per (Item, Department), largest attendance first.

    ``by`` adds leading group keys (e.g. ``tenant`` when tenants share a table).
    """
    return summary_of(attendance_grouped(raw, date_col, date_range, picks, by), by)


def attendance_total(raw: DataFrame, date_col: str, date_range: DateRange = None, picks: Picks | None = None,
                     by: Sequence[str] = ()) -> DataFrame:
    """Grand total of the summary (one row per ``by`` group), rounded half-even to 2 decimals."""
    return total_of(attendance_grouped(raw, date_col, date_range, picks, by), by)


def attendance_options(raw: DataFrame, date_col: str, date_range: DateRange = None, picks: Picks | None = None,
                       by: Sequence[str] = ()) -> DataFrame:
    """Cascading option lists of the seven facets (after the date range)."""
    return facet_options(attendance_base(raw, date_col, date_range), FACETS, picks, by)


def book_date(raw: DataFrame, date_range: DateRange = None, picks: Picks | None = None,
              by: Sequence[str] = ()) -> DataFrame:
    return attendance_summary(raw, BOOK_DATE, date_range, picks, by)


def event_date(raw: DataFrame, date_range: DateRange = None, picks: Picks | None = None,
               by: Sequence[str] = ()) -> DataFrame:
    return attendance_summary(raw, EVENT_DATE, date_range, picks, by)


def attendance_export(raw: DataFrame, date_col: str, date_range: DateRange = None, picks: Picks | None = None,
                      by: Sequence[str] = ()) -> DataFrame:
    """The CSV download: summary rows, then the grand-total row (blank labels, ``is_total``).

    The total is computed from the same grouped rows, so Spark reuses the one
    shuffle for both parts.
    """
    return export_of(attendance_grouped(raw, date_col, date_range, picks, by), by)
