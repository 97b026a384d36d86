"""Who sees what: users resolved to tenants, and each user's entitled pages.

The application resolves one signed-in email at a time through two
dictionaries; here the same lookups are joins over every user at once.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from innsight.config import PAGE_TITLES
from innsight.operators.joins import lookup_join


def resolve_tenants(users: DataFrame, registry: DataFrame) -> DataFrame:
    """Every user with their tenant; ``authorized`` is false when the customer is
    unknown, inactive or missing (the application's "access denied")."""
    reg = registry.select("customer", "label", "prefix", F.lit(True).alias("authorized"))
    joined = lookup_join(users, reg, "customer", "left")
    return joined.select(
        "email", "name", "customer", "label", "prefix",
        F.coalesce(F.col("authorized"), F.lit(False)).alias("authorized"),
    )


def page_catalogue(spark, titles: Mapping[str, str] = PAGE_TITLES) -> DataFrame:
    """The known pages (a fixed, library-defined list)."""
    schema = T.StructType([T.StructField("page", T.StringType(), False), T.StructField("title", T.StringType(), False)])
    return spark.createDataFrame(list(titles.items()), schema)


def tenant_pages(registry: DataFrame, titles: Mapping[str, str] = PAGE_TITLES) -> DataFrame:
    """Per tenant: configured pages that are known, in configured order (position)."""
    exploded = registry.select("customer", F.posexplode("pages").alias("position", "page"))
    return exploded.join(F.broadcast(page_catalogue(registry.sparkSession, titles)), "page", "inner")


def entitled_pages(
    resolved: DataFrame,
    registry: DataFrame,
    titles: Mapping[str, str] = PAGE_TITLES,
) -> DataFrame:
    """Per authorized user: the pages they see; ``position`` is the tenant's
    configured order.  No global sort: the output has one row per user and
    page (millions of rows for many users), and the order travels in
    ``position`` for whoever renders it."""
    pages = tenant_pages(registry, titles)
    users = resolved.filter(F.col("authorized")).select("email", "customer")
    return users.join(pages, "customer", "inner").select("email", "customer", "position", "page", "title")
