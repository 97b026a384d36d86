"""Product performance: per-month item rows and their grand total.

Pipeline: full-row de-duplication -> ``Unknown`` dimensions -> month key ->
value fallback -> business names -> ``yyyy-MM`` label -> facet filters ->
sort by views.  The total sums every numeric column, then replaces the
conversion with the ratio of sums.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from innsight.config import UNKNOWN
from innsight.functions.clean import fill_unknown, month_key, month_label, nan_to_null, require_months, value_or
from innsight.operators.dedup import distinct_rows
from innsight.operators.filters import facet_filter, facet_options, facet_predicate
from innsight.operators.measures import exact_sum0, ratio, sum0, with_total_row

# Source column -> report column, and the report's column order.
RENAME = {
    "BOOKED_MONTH": "Booked Year Month", "ITEM_NAME": "Item Name",
    "PRODUCT_CATEGORY": "Department", "VIEWED": "View", "ITEMSPURCHASED": "Gross Quantity",
    "CONVERSION": "Conversion", "TRANSACTIONS": "Gross Booked", "ATTENDANCE": "Net Attendance",
    "VALUE": "Net Value", "CANCELLED": "Cancelled",
}
COLUMNS = (
    "Booked Year Month", "Item Name", "Department", "View", "Gross Booked",
    "Conversion", "Net Attendance", "Net Value", "Cancelled", "Gross Quantity",
)
SUMMED = ("View", "Gross Booked", "Net Attendance", "Cancelled", "Gross Quantity", "Net Value")
TOTAL_COLUMNS = ("View", "Gross Booked", "Overall Conversion", "Net Attendance", "Net Value", "Cancelled", "Gross Quantity")
FACETS = ("Booked Year Month", "Item Name", "Department")

Picks = Mapping[str, Sequence[str]]


def clean_report_items(raw: DataFrame) -> DataFrame:
    """Cleaned rows; a malformed month is NULL."""
    df = nan_to_null(distinct_rows(raw))
    df = fill_unknown(df, ["ITEM_NAME", "PRODUCT_CATEGORY"])
    df = df.withColumn("BOOKED_MONTH", month_key(F.col("BOOKED_MONTH"), raw.schema["BOOKED_MONTH"].dataType))
    df = df.withColumn("VALUE", value_or(F.col("VALUE"), F.col("VALUE_ADDED")))
    df = df.withColumnsRenamed(RENAME)
    return df.withColumn("Booked Year Month", month_label(F.col("Booked Year Month")))


def _push_picks(raw: DataFrame, picks: Picks) -> tuple[DataFrame, dict]:
    """Apply the picks that can be tested on raw columns; return the rest."""
    rest = {}
    for label, vals in picks.items():
        if label == "Item Name":
            raw = raw.filter(facet_predicate("ITEM_NAME", vals, UNKNOWN))
        elif label == "Department":
            raw = raw.filter(facet_predicate("PRODUCT_CATEGORY", vals, UNKNOWN))
        elif (label == "Booked Year Month" and isinstance(raw.schema["BOOKED_MONTH"].dataType, T.IntegralType)
              and all(re.fullmatch(r"\d{4}-\d{2}", str(v)) for v in vals)):
            months = [int(str(v).replace("-", "")) for v in vals]
            raw = raw.filter(F.col("BOOKED_MONTH").isin(months))
        else:
            rest[label] = vals
    return raw, rest


def checked_months(raw: DataFrame, on_bad_month: str = "fail") -> DataFrame:
    """``"fail"``: any malformed or NULL month fails the report, whatever is
    picked, as the application fails its whole page; ``"null"``: it has no month."""
    if on_bad_month not in ("fail", "null"):
        raise ValueError("on_bad_month must be 'fail' or 'null'")
    return require_months(raw, "BOOKED_MONTH") if on_bad_month == "fail" else raw


def bad_months(raw: DataFrame, by: Sequence[str]) -> DataFrame:
    """Groups with malformed months, and how many rows they have."""
    month = month_key(F.col("BOOKED_MONTH"), raw.schema["BOOKED_MONTH"].dataType)
    return raw.filter(month.isNull()).groupBy(*by).agg(F.count(F.lit(1)).alias("bad_months"))


def product_rows(raw: DataFrame, picks: Picks | None = None, on_bad_month: str = "fail") -> DataFrame:
    picks = {k: v for k, v in (picks or {}).items() if v}
    raw, rest = _push_picks(checked_months(raw, on_bad_month), picks)
    return facet_filter(clean_report_items(raw), rest)


def report_order() -> list:
    """Most-viewed first; ties by month, item, department, then the other columns."""
    ties = [c for c in COLUMNS if c != "View"]
    ties.sort(key=lambda c: c not in ("Booked Year Month", "Item Name", "Department"))
    return [F.desc_nulls_last("View"), *[F.col(f"`{c}`") for c in ties]]


def product_performance(raw: DataFrame, picks: Picks | None = None, on_bad_month: str = "fail",
                        by: Sequence[str] = (), ordered: bool = True) -> DataFrame:
    """The detail table, most-viewed first (within each ``by`` group).

    ``ordered=False`` skips the global sort (a full range shuffle of the
    table) where the order is not kept anyway, e.g. when written as Parquet.
    """
    rows = product_rows(raw, picks, on_bad_month).select(*by, *[F.col(f"`{c}`") for c in COLUMNS])
    return rows.orderBy(*by, *report_order()) if ordered else rows


def product_total(raw: DataFrame, picks: Picks | None = None, on_bad_month: str = "fail",
                  by: Sequence[str] = ()) -> DataFrame:
    """One row (per ``by`` group): sums of the numeric columns; ``Overall
    Conversion`` = Gross Booked / View * 100 (0 when no views); money and
    ratio rounded to 2."""
    return total_of(product_rows(raw, picks, on_bad_month), by)


def _sums(rows: DataFrame) -> list:
    """The total's sums, money and other fractions exactly."""
    return [(exact_sum0 if _fractional(rows, c) or c == "Net Value" else sum0)(f"`{c}`").alias(c) for c in SUMMED]


def _fractional(rows: DataFrame, c: str) -> bool:
    return isinstance(rows.schema[c].dataType, (T.FloatType, T.DoubleType, T.DecimalType))


def _rounded_total(sums: DataFrame, rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """The total's columns from its sums."""

    def rounded(c: str):
        return (F.bround(F.col(f"`{c}`"), 2) if _fractional(rows, c) or c == "Net Value" else F.col(f"`{c}`")).alias(c)

    overall = F.bround(ratio(F.col("`Gross Booked`"), F.col("View")) * F.lit(100.0), 2).alias("Overall Conversion")
    return sums.select(*by, *[overall if c == "Overall Conversion" else rounded(c) for c in TOTAL_COLUMNS])


def total_of(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """:func:`product_total` of already-cleaned rows, e.g. a written detail table."""
    return _rounded_total(rows.groupBy(*by).agg(*_sums(rows)), rows, by)


def observed_total(detail: DataFrame) -> tuple[DataFrame, Callable[[], DataFrame]]:
    """``detail`` that takes its total while it is written, and the total (to be called after the write).

    The sums are collected by the tasks that write the rows, so the total needs
    no pass and no shuffle of its own.  Write the returned frame as it is: its
    last operation must be in the job's result tasks, whose metrics count once
    even if tasks are repeated.
    """
    seen = Observation()
    sums = detail.agg(*_sums(detail)).schema

    def total() -> DataFrame:
        row = detail.sparkSession.createDataFrame([tuple(seen.get[f.name] for f in sums.fields)], sums)
        return _rounded_total(row, detail, ())

    return detail.observe(seen, *_sums(detail)), total


def product_options(raw: DataFrame, picks: Picks | None = None, on_bad_month: str = "fail",
                    by: Sequence[str] = ()) -> DataFrame:
    """Cascading option lists of month, item and department."""
    return facet_options(clean_report_items(checked_months(raw, on_bad_month)), FACETS, picks, by)


def product_export(raw: DataFrame, picks: Picks | None = None, on_bad_month: str = "fail",
                   by: Sequence[str] = ()) -> DataFrame:
    """The CSV download: detail rows, then the total row.

    ``is_total`` marks the total row.  As in the application's file, the total's labels are blank, its ratio sits
    in an extra last column ``Overall Conversion`` and its ``Conversion`` is
    blank.
    """
    detail = product_performance(raw, picks, on_bad_month, by, ordered=False)  # sorted once, with its total
    return export_of(detail, product_total(raw, picks, on_bad_month, by), by)


def export_of(detail: DataFrame, total: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Detail rows then the total row, as in the CSV download."""
    return with_total_row(detail, total, report_order(), by)
