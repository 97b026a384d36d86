"""Set operations: name-aligned UNION ALL of frames with unequal columns."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql import functions as F


def union_all_by_name(frames: Sequence[DataFrame]) -> DataFrame:
    """UNION ALL by column name; a column missing from a branch is NULL there.

    No shuffle: the branches are simply concatenated, and a filter on a
    literal tag column later prunes whole branches.
    """
    if not frames:
        raise ValueError("nothing to union")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Project ``df`` onto ``schema``: same order, cast types, NULL for absent columns."""
    cols = []
    for f in schema.fields:
        if f.name in df.columns:
            cols.append(F.col(f"`{f.name}`").cast(f.dataType).alias(f.name))
        else:
            cols.append(F.lit(None).cast(f.dataType).alias(f.name))
    return df.select(*cols)
