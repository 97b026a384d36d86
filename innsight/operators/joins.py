"""Joins: dictionary lookups of the application expressed as Spark joins.

No side is hinted: the optimizer broadcasts a side whose size in bytes it knows
to be small, and adaptive execution does so at run time from the bytes a
shuffled side turned out to have.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame


def lookup_join(left: DataFrame, right: DataFrame, on: str | Sequence[str], how: str = "left") -> DataFrame:
    """Join a (possibly huge) fact side to a lookup side."""
    return left.join(right, on=on, how=how)
