"""De-duplication.

Keyed de-duplication uses ``row_number() = 1`` over the key.  Spark plans it
with a partial ``WindowGroupLimit`` before the shuffle, so each map task sends
at most one row per key: a key that holds a third of all rows (NULL ids, a
replayed message) costs one row per task, not one giant window partition.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

_RN = "__innsight_rn"


def distinct_rows(df: DataFrame) -> DataFrame:
    """Full-row de-duplication; NULL equals NULL.  Partially aggregated map-side."""
    return df.distinct()


def _orderable(df: DataFrame, exclude: Sequence[str]) -> list[Column]:
    return [
        F.col(f"`{f.name}`").asc_nulls_first()
        for f in df.schema.fields
        if f.name not in exclude and not isinstance(f.dataType, (T.MapType, T.VariantType))
    ]


def keep_first(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column] = (), order_names: Sequence[str] = ()
) -> DataFrame:
    """One row per key: the first by ``order``, ties broken by every other column
    (``order_names`` are the columns ``order`` already covers).

    NULL keys form one group, as in a dictionary keyed by value.  The tie-break
    makes the choice deterministic where the source order is not.
    """
    tie_break = _orderable(df, list(keys) + list(order_names))
    w = Window.partitionBy(*[F.col(f"`{k}`") for k in keys]).orderBy(*order, *tie_break)
    return df.withColumn(_RN, F.row_number().over(w)).filter(F.col(_RN) == 1).drop(_RN)


def keep_last(df: DataFrame, keys: Sequence[str], order_col: str) -> DataFrame:
    """One row per key: the latest by ``order_col`` (last write wins)."""
    return keep_first(df, keys, [F.col(f"`{order_col}`").desc_nulls_last()], [order_col])
