"""Control tables: the tenant registry and the dashboard users.

Both are small configuration tables.  They are decoded with fixed schemas
(``from_json``), normalised (trimmed, case-folded keys) and de-duplicated
deterministically.  Nothing here collects data to the driver except
:func:`tenant_configs`, which turns the (bounded) registry into config objects
for the batch job.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from innsight.config import TenantConfig
from innsight.functions.clean import default_if_blank, norm_key_lower, norm_key_upper
from innsight.operators.dedup import keep_last
from innsight.operators.filters import active_only, non_blank

PAGES_TYPE = T.ArrayType(T.StringType())
EMAIL_TYPE = T.StructType([
    T.StructField("table", T.StringType()),
    T.StructField("tag_field", T.StringType()),
    T.StructField("subject_field", T.StringType()),
    T.StructField("subject_match", T.StringType()),
    T.StructField("buckets", T.ArrayType(T.ArrayType(T.StringType()))),
])
GA4_TYPE = T.StructType([
    T.StructField("database", T.StringType()),
    T.StructField("schema", T.StringType()),
    T.StructField("report", T.StringType()),
])

# Schemas of the two control tables (JSON configuration kept as text).
CUSTOMERS_SCHEMA = T.StructType([
    T.StructField("CUSTOMER", T.StringType(), False),
    T.StructField("LABEL", T.StringType()),
    T.StructField("PREFIX", T.StringType(), False),
    T.StructField("PAGES", T.StringType()),
    T.StructField("EMAIL_CONFIG", T.StringType()),
    T.StructField("GA4_CONFIG", T.StringType()),
    T.StructField("ACTIVE", T.BooleanType()),
])
USERS_SCHEMA = T.StructType([
    T.StructField("EMAIL", T.StringType(), False),
    T.StructField("NAME", T.StringType()),
    T.StructField("CUSTOMER", T.StringType(), False),
    T.StructField("ACTIVE", T.BooleanType()),
    T.StructField("CREATED_AT", T.TimestampNTZType()),
])

TRAFFIC_TYPE = T.StructType([
    T.StructField("host_allow", T.StringType()),
    T.StructField("source_exclude", T.ArrayType(T.StringType())),
    T.StructField("excluded_city", T.StringType()),
])

REGISTRY_TYPE = T.StructType([
    T.StructField("customer", T.StringType()),
    T.StructField("label", T.StringType()),
    T.StructField("prefix", T.StringType()),
    T.StructField("pages", PAGES_TYPE),
    T.StructField("email", EMAIL_TYPE),
    T.StructField("ga4", GA4_TYPE),
    T.StructField("traffic", TRAFFIC_TYPE),
])


class DuplicateTenant(ValueError):
    """The registry holds the same customer key twice."""


def decode_json(df: DataFrame, column: str, dtype: T.DataType) -> "F.Column":
    """JSON text -> ``dtype``; already-decoded values are cast; malformed -> NULL."""
    if column not in df.columns:
        return F.lit(None).cast(dtype)
    src = df.schema[column].dataType
    if isinstance(src, T.StringType):
        text = F.col(column)
        # from_json alone turns malformed text into a struct of NULLs
        return F.when(F.try_parse_json(text).isNotNull(), F.from_json(text, dtype))
    if isinstance(src, T.VariantType):
        return F.try_variant_get(F.col(column), "$", dtype.simpleString())
    return F.col(column).cast(dtype)


def load_registry(customers: DataFrame, check_unique: bool = True) -> DataFrame:
    """Active tenants, one row each: customer, label, prefix, pages, email, ga4, traffic.

    NULL ``ACTIVE`` counts as active; a missing ``GA4_CONFIG`` column (an older
    table) gives NULL ``ga4``; an optional ``TRAFFIC_CONFIG`` column holds a
    tenant's own traffic rules.  Keys are trimmed and case-folded; the label
    defaults to the key.  Duplicate keys raise :class:`DuplicateTenant`: the
    table has no column that would say which one wins.
    """
    df = active_only(customers)
    customer = norm_key_lower(F.col("CUSTOMER"))
    out = df.select(
        customer.alias("customer"),
        default_if_blank(F.col("LABEL"), customer).alias("label"),
        norm_key_upper(F.col("PREFIX")).alias("prefix"),
        F.coalesce(decode_json(df, "PAGES", PAGES_TYPE), F.array().cast(PAGES_TYPE)).alias("pages"),
        decode_json(df, "EMAIL_CONFIG", EMAIL_TYPE).alias("email"),
        decode_json(df, "GA4_CONFIG", GA4_TYPE).alias("ga4"),
        decode_json(df, "TRAFFIC_CONFIG", TRAFFIC_TYPE).alias("traffic"),
    )
    if check_unique:
        dup = out.groupBy("customer").count().filter(F.col("count") > 1).limit(1).collect()
        if dup:
            raise DuplicateTenant(dup[0]["customer"])
    return out


def load_registry_or_fallback(
    spark: SparkSession, table: str, fallback: Sequence[TenantConfig]
) -> DataFrame:
    """The registry table, or ``fallback`` when the table is missing or has no active row."""
    if spark.catalog.tableExists(table):
        reg = load_registry(spark.table(table))
        if not reg.isEmpty():
            return reg
    return registry_frame(spark, fallback)


def registry_frame(spark: SparkSession, tenants: Sequence[TenantConfig]) -> DataFrame:
    """Registry rows (decoded form) from config objects."""
    rows = []
    for t in tenants:
        email = None
        if t.email is not None:
            e = t.email
            email = (e.table, e.tag_field, e.subject_field, e.subject_match, [list(b) for b in e.buckets])
        ga4 = (t.ga4.database, t.ga4.schema, t.ga4.report) if t.ga4 is not None else None
        rules = (t.traffic.host_allow, list(t.traffic.source_exclude), t.traffic.excluded_city)
        rows.append((t.customer, t.label, t.prefix, list(t.pages), email, ga4, rules))
    return spark.createDataFrame(rows, REGISTRY_TYPE)


def seed_customers(spark: SparkSession, tenants: Sequence[TenantConfig], active: bool = True) -> DataFrame:
    """Rows for the customers control table (configuration as JSON text).

    Append them with ``df.write.mode("append")`` to add tenants.
    """
    rows = []
    for t in tenants:
        email = None
        if t.email is not None:
            e = t.email
            email = json.dumps({"table": e.table, "tag_field": e.tag_field, "subject_field": e.subject_field,
                                "subject_match": e.subject_match, "buckets": [list(b) for b in e.buckets]})
        ga4 = None
        if t.ga4 is not None:
            ga4 = json.dumps({"database": t.ga4.database, "schema": t.ga4.schema, "report": t.ga4.report})
        rows.append((t.customer, t.label, t.prefix, json.dumps(list(t.pages)), email, ga4, active))
    return spark.createDataFrame(rows, CUSTOMERS_SCHEMA)


def iter_tenant_configs(registry: DataFrame) -> Iterator[TenantConfig]:
    """Config objects of the registry rows, one partition in memory at a time."""
    return (TenantConfig.from_row(r) for r in registry.toLocalIterator())


def tenant_configs(registry: DataFrame) -> list[TenantConfig]:
    """All config objects of a registry: as much memory as its JSON."""
    return list(iter_tenant_configs(registry))


def load_users(users: DataFrame, order_col: str = "CREATED_AT") -> DataFrame:
    """Active users, one row per normalised email: email, name, customer.

    A blank email is skipped; the name defaults to the email; the customer key
    is trimmed and lower-cased (blank -> NULL).  When an email appears more
    than once the latest row by ``order_col`` wins.
    """
    df = active_only(users)
    email = norm_key_lower(F.col("EMAIL"))
    df = df.withColumn("email", email).filter(non_blank("email"))
    df = keep_last(df.select("email", "NAME", "CUSTOMER", order_col), ["email"], order_col)
    return df.select(
        "email",
        default_if_blank(F.col("NAME"), F.col("email")).alias("name"),
        F.when(F.coalesce(F.col("CUSTOMER"), F.lit("")) == "", F.lit(None).cast("string"))
        .otherwise(norm_key_lower(F.col("CUSTOMER")))
        .alias("customer"),
    )
