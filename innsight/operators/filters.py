"""Row filters and predicates.

Every filter here is a built-in predicate.  Filters on raw columns reach the
Parquet scan as ``PushedFilters``; :func:`facet_predicate` keeps that true for
dimensions whose NULLs are shown as ``Unknown`` by testing the raw column.
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from innsight.config import UNKNOWN, TrafficRules

DateLike = _dt.date | _dt.datetime | str


# ---------------------------------------------------------------- facets (F1, F2)
def facet_predicate(column: str | Column, values: Sequence, null_label: str | None = None) -> Column:
    """``column IN values``; with ``null_label`` picked, NULL rows also match.

    Apply it to the raw column of an ``Unknown``-filled dimension: the
    predicate then stays push-down-able, where ``coalesce(c,'Unknown') IN``
    would not be.
    """
    c = F.col(column) if isinstance(column, str) else column
    vals = list(values)
    pred = c.isin(vals)
    if null_label is not None and null_label in vals:
        pred = pred | c.isNull()
    return pred


def facet_filter(
    df: DataFrame,
    picks: Mapping[str, Sequence] | None,
    null_labels: Mapping[str, str] | None = None,
) -> DataFrame:
    """AND of one multi-select filter per facet; an empty selection filters nothing."""
    preds = [
        facet_predicate(col, vals, (null_labels or {}).get(col))
        for col, vals in (picks or {}).items()
        if vals
    ]
    return df.filter(reduce(lambda a, b: a & b, preds)) if preds else df


def facet_options(
    df: DataFrame, facets: Sequence[str], picks: Mapping[str, Sequence] | None = None, by: Sequence[str] = ()
) -> DataFrame:
    """Cascading option lists: distinct non-NULL values of each facet, after the
    picks of the facets before it.

    One scan for all facets, two levels: the distinct combinations of all facet
    values first (partially aggregated map-side, so rows fall to combinations
    before anything is multiplied), then each combination emits one
    ``(position, facet, value)`` entry per facet it is eligible for.  Result is
    long, ordered by facet position then value (within each ``by`` group).
    """
    picks = picks or {}
    entries = []
    passed = F.lit(True)
    for pos, facet in enumerate(facets):
        entries.append(
            F.struct(
                F.lit(pos).alias("position"),
                F.lit(facet).alias("facet"),
                F.col(facet).cast("string").alias("value"),
                passed.alias("eligible"),
            )
        )
        if picks.get(facet):
            passed = passed & facet_predicate(facet, picks[facet])
    combinations = df.select(*by, *[F.col(f"`{f}`") for f in facets]).distinct()
    return (
        combinations.select(*by, F.inline(F.array(*entries)))
        .filter(F.col("eligible") & F.col("value").isNotNull())
        .select(*by, "position", "facet", "value")
        .distinct()
        .orderBy(*by, "position", "value")
    )


# ---------------------------------------------------------------- date ranges (F3, F4, F5)
def _as_date(d: DateLike) -> _dt.date:
    if isinstance(d, _dt.datetime):
        return d.date()
    if isinstance(d, _dt.date):
        return d
    return _dt.date.fromisoformat(str(d)[:10])


def _bound(df: DataFrame, column: str, d: _dt.date) -> Column:
    """Midnight of ``d`` as a literal of the column's type (so it can be pushed down)."""
    dtype = df.schema[column].dataType
    if isinstance(dtype, T.DateType):
        return F.lit(d)
    lit = F.lit(d.isoformat() + " 00:00:00")
    return lit.cast("timestamp" if isinstance(dtype, T.TimestampType) else "timestamp_ntz")


def closed_range(df: DataFrame, column: str, start: DateLike | None, end: DateLike | None) -> DataFrame:
    """``start <= column <= end`` at midnight, applied only when both ends are given.

    Rows later than 00:00 on ``end`` are excluded, and rows with a NULL
    ``column`` are dropped whenever the range applies.
    """
    if start is None or end is None:
        return df
    s, e = _as_date(start), _as_date(end)
    c = F.col(column)
    return df.filter((c >= _bound(df, column, s)) & (c <= _bound(df, column, e)))


def half_open_range(df: DataFrame, column: str, start: DateLike, end: DateLike) -> DataFrame:
    """``start <= column < end + 1 day``: the whole of the last day is included."""
    s, e = _as_date(start), _as_date(end) + _dt.timedelta(days=1)
    c = F.col(column)
    return df.filter((c >= _bound(df, column, s)) & (c < _bound(df, column, e)))


def date_bounds(df: DataFrame, column: str) -> tuple[_dt.date, _dt.date] | None:
    """Earliest and latest day of ``column`` (a two-value action), or None when empty."""
    row = df.agg(F.min(column).alias("lo"), F.max(column).alias("hi")).first()
    if row is None or row["lo"] is None:
        return None
    return _as_date(row["lo"]), _as_date(row["hi"])


# ---------------------------------------------------------------- text predicates (F6-F11)
def _ci(pattern: str) -> str:
    # Case-insensitive with Unicode case folding, so "É" matches "é".
    return "(?iu)" + pattern


def matches_ci(column: str | Column, pattern: str) -> Column:
    """Case-insensitive regular-expression containment; NULL counts as ``''``."""
    c = F.col(column) if isinstance(column, str) else column
    return F.coalesce(c.cast("string"), F.lit("")).rlike(_ci(pattern))


def subject_scope(df: DataFrame, column: str, pattern: str) -> DataFrame:
    """Rows whose subject contains ``pattern`` (a regex, case-insensitive)."""
    return df.filter(matches_ci(column, pattern))


def host_allow(column: str, pattern: str) -> Column:
    """Host contains ``pattern`` case-insensitively; a NULL host fails."""
    return matches_ci(column, pattern)


def source_deny(column: str, fragments: Iterable[str]) -> Column:
    """Lower-cased source matches none of ``fragments`` (one regex alternation);
    a NULL source passes."""
    alternation = "|".join(fragments)
    return ~F.lower(F.coalesce(F.col(column), F.lit(""))).rlike(alternation)


def traffic_predicate(df: DataFrame, rules: TrafficRules = TrafficRules()) -> Column:
    """Shared GA4 traffic filters, each applied only when its column exists."""
    preds = [F.lit(True)]
    if "HOSTNAME" in df.columns:
        preds.append(host_allow("HOSTNAME", rules.host_allow))
    if "SESSIONSOURCE" in df.columns and rules.source_exclude:
        preds.append(source_deny("SESSIONSOURCE", rules.source_exclude))
    return reduce(lambda a, b: a & b, preds)


def traffic_filter(df: DataFrame, rules: TrafficRules = TrafficRules()) -> DataFrame:
    """Rows that pass :func:`traffic_predicate`."""
    return df.filter(traffic_predicate(df, rules))


def not_equal_keep_null(column: str, value: str) -> Column:
    """``column != value`` where NULL is kept (compared as ``''``)."""
    return F.coalesce(F.col(column), F.lit("")) != F.lit(value)


def search_rows(df: DataFrame, pattern: str) -> DataFrame:
    """Rows where any column, as text, contains ``pattern`` (regex, case-insensitive).

    An empty pattern returns every row.  NULL cells never match.  Maps are
    searched in their text form, binary columns as UTF-8.
    """
    if not pattern:
        return df
    preds = [df[f"`{name}`"].isNotNull() & matches_ci(df[f"`{name}`"], pattern) for name in df.columns]
    return df.filter(reduce(lambda a, b: a | b, preds))


# ---------------------------------------------------------------- control rows (F12, F13)
def active_only(df: DataFrame, column: str = "ACTIVE") -> DataFrame:
    """Active rows; a NULL flag counts as active.  No-op when the column is absent."""
    if column not in df.columns:
        return df
    return df.filter(F.coalesce(F.col(column), F.lit(True)))


def non_blank(column: str) -> Column:
    """Key is neither NULL nor empty."""
    return F.coalesce(F.col(column), F.lit("")) != F.lit("")


__all__ = [
    "UNKNOWN",
    "active_only",
    "closed_range",
    "date_bounds",
    "facet_filter",
    "facet_options",
    "facet_predicate",
    "half_open_range",
    "host_allow",
    "matches_ci",
    "non_blank",
    "not_equal_keep_null",
    "search_rows",
    "source_deny",
    "subject_scope",
    "traffic_filter",
]
