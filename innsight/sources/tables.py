"""Tenant-scoped table scans.

Table names are built from server-side tenant configuration, never from user
input, and are validated as identifiers before use: no SQL text is ever
interpolated.  A :class:`TableCatalog` resolves a name to a DataFrame, from
explicitly registered frames or paths first, else from the session catalog.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from innsight.config import REPORT_ITEMS_SUFFIX, TRANSACTIONS_SUFFIX, TenantConfig

_IDENT = re.compile(r"^[A-Za-z_][A-Za-z0-9_$]*(\.[A-Za-z_][A-Za-z0-9_$]*){0,2}$")

Source = DataFrame | str | Callable[[], DataFrame]


class UnknownTable(LookupError):
    """A configured source table does not exist."""


class BadIdentifier(ValueError):
    """A configured table name is not a plain (optionally qualified) identifier."""


def check_identifier(name: str) -> str:
    if not isinstance(name, str) or not _IDENT.match(name):
        raise BadIdentifier(f"not a table identifier: {name!r}")
    return name


class TableCatalog:
    """Name -> DataFrame resolution for the tenant sources.

    ``tables`` maps a (case-insensitive) name to a DataFrame, a Parquet path or
    a zero-argument callable; a qualified name also matches its last part.
    Names not registered are read with ``spark.table`` (optionally under
    ``schema``).
    """

    def __init__(self, spark: SparkSession, tables: Mapping[str, Source] | None = None, schema: str | None = None):
        self.spark = spark
        self.schema = schema
        self._tables = {k.upper(): v for k, v in (tables or {}).items()}

    def register(self, name: str, source: Source) -> None:
        self._tables[check_identifier(name).upper()] = source

    def _load(self, source: Source) -> DataFrame:
        if isinstance(source, DataFrame):
            return source
        if isinstance(source, str):
            return self.spark.read.parquet(source)
        return source()

    def table(self, name: str) -> DataFrame:
        check_identifier(name)
        key = name.upper()
        for k in (key, key.split(".")[-1]):
            if k in self._tables:
                return self._load(self._tables[k])
        qualified = name if "." in name or not self.schema else f"{self.schema}.{name}"
        if not self.spark.catalog.tableExists(qualified):
            raise UnknownTable(qualified)
        return self.spark.table(qualified)


def scan_tenant(catalog: TableCatalog, cfg: TenantConfig, suffix: str) -> DataFrame:
    """``{PREFIX}_{suffix}`` of the tenant (report items, transactions)."""
    return catalog.table(f"{cfg.prefix}_{suffix}")


def scan_report_items(catalog: TableCatalog, cfg: TenantConfig) -> DataFrame:
    return scan_tenant(catalog, cfg, REPORT_ITEMS_SUFFIX)


def scan_transactions(catalog: TableCatalog, cfg: TenantConfig) -> DataFrame:
    return scan_tenant(catalog, cfg, TRANSACTIONS_SUFFIX)


def scan_email(catalog: TableCatalog, cfg: TenantConfig) -> DataFrame:
    """The email source named in the tenant's email configuration."""
    if cfg.email is None:
        raise UnknownTable(f"no email source configured for {cfg.customer!r}")
    return catalog.table(cfg.email.table)


def grain_table_name(cfg: TenantConfig, grain: str) -> str:
    g = cfg.ga4
    if g is None:
        raise UnknownTable(f"no GA4 source configured for {cfg.customer!r}")
    parts = [p for p in (g.database, g.schema) if p] + [f"{g.report}_GA4_{grain.upper()}"]
    return ".".join(parts)


def scan_grain(catalog: TableCatalog, cfg: TenantConfig, grain: str) -> DataFrame:
    """``{database}.{schema}.{report}_GA4_{grain}`` of the tenant."""
    return catalog.table(grain_table_name(cfg, grain))


def scan_shared(catalog: TableCatalog, name: str, tenants: Sequence[str], tenant_col: str = "tenant") -> DataFrame:
    """Rows of ``tenants`` in a table that all tenants share.

    The filter is on the plain column, so a table partitioned by it lists and
    reads those partitions only.  ``tenants`` comes from the registry, never
    from a user's choice.
    """
    return catalog.table(name).filter(F.col(tenant_col).isin(list(tenants)))
