"""Silver tables: sources landed once, laid out so that later runs read and move less.

* :func:`land_bucketed` - bucketed and sorted by a key.  What groups, ranks or
  joins by that key later needs no exchange: Spark takes the buckets as they
  are.  Batches append; a key's rows of all batches share a bucket.
* :func:`land_partitioned` - a folder per tenant, read through the catalog, so a
  tenant's scan lists and reads its own partition only.

Tables are external when a ``path`` is given; it must be shared storage.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from innsight.operators.dedup import distinct_rows, keep_first
from innsight.plans.email import TS
from innsight.sources.tables import check_identifier

PRODUCT_KEY = ("BOOKED_MONTH", "ITEM_NAME")
MESSAGE_KEY = ("DATA_ID",)


def _save(writer, table: str, path: str | None) -> None:
    if path is not None:
        writer = writer.option("path", path)
    writer.format("parquet").saveAsTable(check_identifier(table))


def land_bucketed(df: DataFrame, table: str, keys: Sequence[str], buckets: int, path: str | None = None) -> None:
    """Append ``df`` to ``table``, bucketed and sorted by ``keys``.

    Rows are dealt by the bucketing hash first, so each task writes one file of
    one bucket.  A bucket holds whole keys; collapse hot keys before
    (:func:`land_messages`, :func:`land_report_items`).  Choose ``buckets`` once
    for the table's expected size: about one per 256 MB.
    """
    dealt = df.repartition(buckets, *[F.col(f"`{k}`") for k in keys])
    _save(dealt.write.mode("append").bucketBy(buckets, *keys).sortBy(*keys), table, path)


def land_messages(raw: DataFrame, table: str, buckets: int, path: str | None = None) -> None:
    """One batch of messages, one row per ``DATA_ID``: a NULL or replayed id lands as one row.

    Over the table :func:`innsight.plans.email.email_base` de-duplicates across
    batches without an exchange; the first by time of the firsts is the first.
    """
    land_bucketed(keep_first(raw, MESSAGE_KEY, [F.col(TS).asc_nulls_last()], [TS]), table, MESSAGE_KEY, buckets, path)


def land_report_items(raw: DataFrame, table: str, buckets: int, path: str | None = None) -> None:
    """One batch of report items without its repeated rows; repeats across batches meet in their bucket."""
    land_bucketed(distinct_rows(raw), table, PRODUCT_KEY, buckets, path)


def land_partitioned(df: DataFrame, table: str, tenant_col: str = "tenant", path: str | None = None) -> None:
    """``df`` as a table with a partition per tenant; a large tenant is written by several tasks."""
    _save(df.hint("rebalance", tenant_col).write.mode("overwrite").partitionBy(tenant_col), table, path)
