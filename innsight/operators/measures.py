"""Aggregations, ratios, rankings and the detail + total pattern.

Everything is a hash aggregate with a map-side partial step, so a key that
holds a third of the rows is combined inside each task before the shuffle.
Sums are wrapped in ``coalesce(..., 0)``: an empty or all-NULL group sums to
0, as the reports show it.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

_RN = "__innsight_rank"


def sum0(c: str | Column) -> Column:
    """``sum`` that is 0 (not NULL) over no rows."""
    col = F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.sum(col), F.lit(0))


def ratio(num: Column, den: Column) -> Column:
    """``num / den``, 0 when ``den`` is 0 or NULL."""
    return F.coalesce(F.try_divide(num.cast("double"), den.cast("double")), F.lit(0.0))


def money(c: Column, digits: int = 2) -> Column:
    """Round half-even to cents (the reports' two decimals)."""
    return F.bround(c, digits)


def exact_sum0(c: str | Column) -> Column:
    """``sum`` of money as DOUBLE that does not depend on the order of the rows.

    Values below 10**15 are added as decimals with 12 digits after the point
    (as many as a double of that size shows), others as doubles.
    """
    col = (F.col(c) if isinstance(c, str) else c).cast("double")
    fits = F.abs(col) < F.lit(1e15)
    exact = F.sum(F.when(fits, col).cast("decimal(38,12)")).cast("double")
    return F.coalesce(exact, F.lit(0.0)) + F.coalesce(F.sum(F.when(~fits, col)), F.lit(0.0))


def keyed_sums(
    df: DataFrame,
    keys: Sequence[str],
    measures: Mapping[str, str | Column],
    drop_null_keys: bool = True,
) -> DataFrame:
    """Sum ``measures`` (output name -> column) per key; NULL keys dropped by default."""
    if drop_null_keys and keys:
        df = df.filter(_all_not_null(keys))
    return df.groupBy(*[F.col(f"`{k}`") for k in keys]).agg(
        *[sum0(c).alias(name) for name, c in measures.items()]
    )


def _all_not_null(keys: Sequence[str]) -> Column:
    pred = F.lit(True)
    for k in keys:
        pred = pred & F.col(f"`{k}`").isNotNull()
    return pred


def group_sizes(df: DataFrame, key: str, name: str = "Total", by: Sequence[str] = ()) -> DataFrame:
    """Rows per key value (per ``by`` group), NULL key dropped, ordered by key."""
    return (
        df.filter(F.col(key).isNotNull())
        .groupBy(*by, key)
        .agg(F.count(F.lit(1)).alias(name))
        .orderBy(*by, key)
    )


def daily_series(
    df: DataFrame, ts_col: str, measures: Mapping[str, str | Column], out_col: str = "DATE", by: Sequence[str] = ()
) -> DataFrame:
    """Sums per calendar day of ``ts_col`` (NULL days dropped), in day order; no gap filling."""
    day = F.to_date(F.col(ts_col))
    return (
        df.filter(F.col(ts_col).isNotNull())
        .groupBy(*by, day.alias(out_col))
        .agg(*[sum0(c).alias(name) for name, c in measures.items()])
        .orderBy(*by, out_col)
    )


def top_k(df: DataFrame, order: Sequence[Column], k: int, by: Sequence[str] = (), rank_col: str = "Rank") -> DataFrame:
    """First ``k`` rows by ``order`` with their rank (planned as
    ``TakeOrderedAndProject``; the rank numbers those k rows); with ``by``, the
    first ``k`` of each group (see :func:`top_k_per_group`)."""
    if by:
        return top_k_per_group(df, by, order, k, rank_col).orderBy(*by, rank_col)
    top = df.orderBy(*order).limit(k)
    return top.withColumn(rank_col, F.row_number().over(Window.orderBy(*order)))


def top_k_per_group(df: DataFrame, groups: Sequence[str], order: Sequence[Column], k: int, rank_col: str | None = None) -> DataFrame:
    """First ``k`` rows by ``order`` within each group.

    Planned with a partial ``WindowGroupLimit`` before the shuffle, so even a
    group holding most of the rows ships at most ``k`` rows per map task.
    """
    w = Window.partitionBy(*[F.col(f"`{g}`") for g in groups]).orderBy(*order)
    name = rank_col or _RN
    out = df.withColumn(name, F.row_number().over(w)).filter(F.col(name) <= k)
    return out if rank_col else out.drop(_RN)


def grand_total(df: DataFrame, columns: Sequence[str], digits: int | None = 2, by: Sequence[str] = ()) -> DataFrame:
    """One row (per ``by`` group): the sum of each of ``columns``, floating sums
    rounded half-even to ``digits``."""
    aggs = []
    for c in columns:
        fractional = isinstance(df.schema[c].dataType, (T.FloatType, T.DoubleType, T.DecimalType))
        s = exact_sum0(f"`{c}`") if fractional else sum0(f"`{c}`")
        if digits is not None and fractional:
            s = F.bround(s, digits)
        aggs.append(s.alias(c))
    return df.groupBy(*by).agg(*aggs)


def with_total_row(
    detail: DataFrame, total: DataFrame, order: Sequence[Column] = (), by: Sequence[str] = ()
) -> DataFrame:
    """Detail rows followed by the total row (missing columns NULL), per ``by`` group.

    ``is_total`` marks the total row, so that the order can be restored from
    a written report.

    When ``total`` is computed from ``detail`` the two branches share one
    shuffle (Spark reuses the exchange), so the source is read once.
    """
    marker = "is_total"
    d = detail.withColumn(marker, F.lit(False))
    t = total.withColumn(marker, F.lit(True))
    both = d.unionByName(t, allowMissingColumns=True)
    return both.orderBy(*by, F.col(marker), *order)


def conditional_segments(
    df: DataFrame,
    segments: Sequence[tuple[str, Column | None]],
    counts: Mapping[str, str],
    sums: Mapping[str, str],
    by: Sequence[str] = (),
) -> DataFrame:
    """Metrics of possibly overlapping row segments in one pass.

    ``segments`` is ``[(label, predicate or None for all rows), ...]``; each
    segment gets ``count(col)`` for ``counts`` and ``sum(col)`` for ``sums``
    as conditional aggregates of a single aggregation (global, or per ``by``
    group), then each wide row is turned into one row per segment
    (``position``, ``label``).  Segments need no join and no extra scan, and
    an empty segment still yields its row.
    """
    aggs = []
    for i, (_, cond) in enumerate(segments):
        for name, c in counts.items():
            x = F.col(c) if cond is None else F.when(cond, F.col(c))
            aggs.append(F.count(x).alias(f"s{i}__{name}"))
        for name, c in sums.items():
            x = F.col(c) if cond is None else F.when(cond, F.col(c))
            aggs.append(sum0(x).alias(f"s{i}__{name}"))
    wide = df.groupBy(*by).agg(*aggs)
    rows = [
        F.struct(
            F.lit(i).alias("position"),
            F.lit(label).alias("label"),
            *[F.col(f"s{i}__{name}").alias(name) for name in list(counts) + list(sums)],
        )
        for i, (label, _) in enumerate(segments)
    ]
    return wide.select(*by, F.inline(F.array(*rows)))
