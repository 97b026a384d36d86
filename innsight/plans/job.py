"""Batch jobs: every entitled report of every active tenant.

Replaces the application's per-request page rendering: for each tenant of the
registry and each page it is entitled to, the page's reports are computed on
Spark and written under ``{out}/{page}/{report}/tenant={customer}``.

Each page reads its source once.  What feeds several reports is cleaned,
projected and written once as a Parquet table in the shared checkpoint folder
(:class:`Silver`, dropped when the page is done): the cleaned DAILY grain, the
product detail, the grouped attendance, the de-duplicated messages.

Written reports keep their order as data: ``position``, ``Rank`` or
``is_total`` (CSV files, which have the application's columns only, are written
in that order).

Two layouts:

* :func:`build_marts` - one table per tenant (the application's layout).  The
  loop runs over configuration (tenants x pages, read in slices); with
  ``parallelism`` several tenants' jobs are submitted at once.
* :func:`build_shared_marts` - tenants share one table per source.  Each
  report is one job for every entitled tenant, grouped by tenant.  Sources are
  semi-joined with the entitlement table, so a source partitioned by tenant is
  read for the entitled tenants only (dynamic partition pruning) and once a page,
  however many tenants there are.

Whatever stops a page is recorded as its failure and the job goes on, as the
application shows an error for that page only.  A report without rows replaces
an earlier one.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from itertools import islice

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from innsight.config import PAGE_TITLES, EmailConfig, TenantConfig, TrafficRules
from innsight.plans import attendance as att
from innsight.plans import email as em
from innsight.plans import ga4
from innsight.plans import product as prod
from innsight.session import ensure_checkpoint_dir
from innsight.sinks.export import partition_folder, write_csv, write_empty, write_parquet
from innsight.sources.registry import iter_tenant_configs
from innsight.sources.tables import (
    TableCatalog, scan_email, scan_grain, scan_report_items, scan_transactions,
)

# write(report, df) writes one report; write(report, df, True) also returns it for reuse; order: a large report's in CSV.
Write = Callable[..., DataFrame]
Source = Callable[[str], DataFrame]
SLICE = 1000  # tenants whose configuration is held at once
#: Reports that may be large; the others have a row per group, item or day at most and make one CSV file.
LARGE = {("product_performance", "detail"), ("product_performance", "export")}


class Silver:
    """Intermediate Parquet tables of one page, in the shared checkpoint folder."""

    def __init__(self, spark: SparkSession):
        self._spark = spark
        self._folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/silver-{uuid.uuid4().hex}"
        self._n = 0

    def path(self) -> str:
        """A new folder name, deleted with the others."""
        self._n += 1
        return f"{self._folder}/{self._n}"

    def __call__(self, df: DataFrame) -> DataFrame:
        path = self.path()
        df.write.parquet(path)
        return self._spark.read.schema(df.schema).parquet(path)

    def __enter__(self) -> "Silver":
        return self

    def __exit__(self, *_) -> None:
        path = self._spark._jvm.org.apache.hadoop.fs.Path(self._folder)
        path.getFileSystem(self._spark._jsc.hadoopConfiguration()).delete(path, True)


@dataclass(frozen=True, order=True)
class BuildResult:
    tenant: str
    page: str
    report: str
    status: str  # "ok" | "failed" | "skipped"
    detail: str = ""


# ---------------------------------------------------------------- page builders
@dataclass
class Page:
    """What a page builder works with."""

    src: Source
    write: Write
    silver: Silver
    by: Sequence[str] = ()
    rules: Mapping[str, TrafficRules] | TrafficRules = TrafficRules()  # per tenant when ``by`` is set

    def traffic(self):
        return ga4.tenant_rules(self.rules, self.by[0]) if self.by else self.rules


def _product(p: Page) -> None:
    rows, total = prod.observed_total(prod.product_performance(p.src("REPORT_ITEMS"), ordered=False))
    detail = p.write("detail", rows, True, prod.report_order())
    p.write("export", prod.export_of(detail, p.write("total", total(), True)))


def _shared_product(p: Page, fail: Callable[[DataFrame], None]) -> None:
    """The page of all tenants; ``fail`` is given the tenants with malformed months, which get no reports."""
    rows = p.silver(prod.product_performance(p.src("REPORT_ITEMS"), on_bad_month="null", by=p.by, ordered=False))
    bad = rows.filter(F.col("`Booked Year Month`").isNull()).groupBy(*p.by).agg(F.count(F.lit(1)).alias("bad_months"))
    if not bad.isEmpty():
        bad = p.silver(bad)
        fail(bad)
        rows = rows.join(bad.select(*p.by), list(p.by), "left_anti")
    detail = p.write("detail", rows, landed=True)
    total = p.write("total", prod.total_of(detail, p.by))
    p.write("export", prod.export_of(detail, total, p.by))


def _attendance(date_col: str):
    def build(p: Page) -> None:
        grouped = p.silver(att.attendance_grouped(p.src("UVE_TRANSACTIONS_GROUPED"), date_col, by=p.by))
        p.write("summary", att.summary_of(grouped, p.by))
        p.write("total", att.total_of(grouped, p.by))
        p.write("export", att.export_of(grouped, p.by))
    return build


def _frames(p: Page, *grains: str) -> dict[str, DataFrame]:
    others = {g: p.src(f"GA4_{g}") for g in grains}
    return ga4.page_frames(p.src("GA4_DAILY"), others, rules=p.traffic(), by=p.by, keep=p.silver)


def _guest_portal(p: Page) -> None:
    f = _frames(p, "EVENTS", "ITEMS")
    groups = f.get(ga4.GROUPS)
    p.write("kpis", ga4.guest_kpis(f["DAILY"], p.by, groups))
    p.write("sessions", ga4.sessions_over_time(f["DAILY"], p.by))
    p.write("funnel", ga4.funnel(f["EVENTS"], by=p.by, groups=groups))
    viewed = p.silver(ga4.most_viewed(f["ITEMS"], by=p.by))
    p.write("top_items", ga4.top_items_of(viewed, by=p.by))
    p.write("most_visited", ga4.most_visited_of(viewed, by=p.by))


def _audience(p: Page) -> None:
    f = _frames(p, "DEVICE", "LOCATION")
    p.write("kpis", ga4.audience_kpis(f["DAILY"], p.by, f.get(ga4.GROUPS)))
    p.write("users", ga4.users_over_time(f["DAILY"], p.by))
    p.write("devices", ga4.devices(f["DEVICE"], p.by))
    p.write("acquisition", ga4.acquisition(f["DAILY"], by=p.by))
    p.write("locations", ga4.top_locations(f["LOCATION"], p.rules, by=p.by))


def _email_reports(base: DataFrame, cfg: TenantConfig, write: Write) -> None:
    scoped = em.email_in_scope(base, cfg.email)
    write("summary", em.email_summary(scoped, cfg.email))
    write("sections", em.email_sections(scoped, cfg.email))
    write("by_state", em.email_by_state(scoped))
    write("open_frequency", em.email_open_frequency(scoped))


_DATA_PAGES = {
    "product_performance": _product,
    "book_date": _attendance(att.BOOK_DATE),
    "event_date": _attendance(att.EVENT_DATE),
    "guest_portal": _guest_portal,
    "audience": _audience,
}
_GA4_PAGES = ("guest_portal", "audience")


def _why(e: Exception) -> str:
    return f"{type(e).__name__}: {str(e).strip().splitlines()[0][:300] if str(e).strip() else ''}"


# ---------------------------------------------------------------- one table per tenant
def _tenant_source(catalog: TableCatalog, cfg: TenantConfig) -> Source:
    def src(name: str) -> DataFrame:
        if name == "REPORT_ITEMS":
            return scan_report_items(catalog, cfg)
        if name == "UVE_TRANSACTIONS_GROUPED":
            return scan_transactions(catalog, cfg)
        return scan_grain(catalog, cfg, name.removeprefix("GA4_"))
    return src


def _tenant_writer(out: str, page: str, cfg: TenantConfig, fmt: str, results: list[BuildResult], silver: Silver) -> Write:
    def write(report: str, df: DataFrame, reuse: bool = False, order: Sequence[Column] = ()) -> DataFrame | None:
        # The tenant's own folder is overwritten as a whole, so an empty report replaces an earlier one.
        path = f"{out}/{page}/{report}/{partition_folder('tenant', cfg.customer)}"
        if fmt == "csv":
            df = silver(df) if reuse else df
            write_csv(df, path, single_file=(page, report) not in LARGE, order=order)
        else:
            df.write.mode("overwrite").parquet(path)
            df = df.sparkSession.read.schema(df.schema).parquet(path) if reuse else None
        results.append(BuildResult(cfg.customer, page, report, "ok"))
        return df
    return write


def _build_page(catalog: TableCatalog, cfg: TenantConfig, page: str, out: str, fmt: str) -> list[BuildResult]:
    results: list[BuildResult] = []
    try:
        with Silver(catalog.spark) as silver:
            write = _tenant_writer(out, page, cfg, fmt, results, silver)
            if page == "email_campaigns":
                if cfg.email is not None:
                    _email_reports(silver(em.email_base(scan_email(catalog, cfg), em.used_columns([cfg.email]))), cfg, write)
            elif page in _GA4_PAGES and cfg.ga4 is None:
                pass  # not configured: nothing to build, not an error
            elif page in _DATA_PAGES:
                _DATA_PAGES[page](Page(_tenant_source(catalog, cfg), write, silver, rules=cfg.traffic))
            else:
                results.append(BuildResult(cfg.customer, page, "", "skipped", "unknown page"))
    except Exception as e:  # whatever it is, it concerns this page of this tenant
        results.append(BuildResult(cfg.customer, page, "", "failed", _why(e)))
    return results


def _slices(items: Iterable, n: int) -> Iterator[list]:
    it = iter(items)
    while some := list(islice(it, n)):
        yield some


def build_marts(
    registry: DataFrame,
    catalog: TableCatalog,
    out_dir: str,
    fmt: str = "parquet",
    tenants: Sequence[str] | None = None,
    parallelism: int = 1,
) -> list[BuildResult]:
    """Build and write every entitled report; returns one status line per report.

    ``fmt`` is ``parquet`` or ``csv`` (the application's CSV conventions), one
    folder per tenant.  With ``parallelism`` > 1, that many (tenant, page) units
    submit their Spark jobs concurrently from driver threads, so many small
    tenants keep a large cluster busy; each unit writes only its own folders.
    """
    out = out_dir.rstrip("/")
    results: list[BuildResult] = []

    def configured() -> Iterator[TenantConfig]:
        return (c for c in iter_tenant_configs(registry) if tenants is None or c.customer in tenants)

    if fmt == "parquet":
        # Email sources are often shared by several properties (each scoped by
        # subject): one de-duplication and one scoping pass per source table.
        readers = {c.customer: c.email for c in configured() if "email_campaigns" in c.pages and c.email is not None}
        tables: dict[str, DataFrame | str] = {}
        for name in dict.fromkeys(e.table for e in readers.values()):
            try:
                tables[name] = catalog.table(name)
            except Exception as e:  # reported for each of its tenants
                tables[name] = _why(e)
        results += _shared_email(readers, tables, out, "tenant")
    for configs in _slices(configured(), SLICE):
        units = [(cfg, page) for cfg in configs for page in cfg.pages if fmt != "parquet" or page != "email_campaigns"]
        if parallelism <= 1:
            results += [r for cfg, page in units for r in _build_page(catalog, cfg, page, out, fmt)]
        else:
            with ThreadPoolExecutor(max_workers=parallelism) as pool:
                results += [r for rs in pool.map(lambda u: _build_page(catalog, u[0], u[1], out, fmt), units) for r in rs]
    return results


# ---------------------------------------------------------------- shared tables
SHARED_SOURCES = ("REPORT_ITEMS", "UVE_TRANSACTIONS_GROUPED", "GA4_DAILY", "GA4_EVENTS", "GA4_ITEMS",
                  "GA4_DEVICE", "GA4_LOCATION")


def entitlements(registry: DataFrame) -> DataFrame:
    """(tenant, page): the pages of each active tenant that are known and configured."""
    def has(c: str) -> Column:
        return F.coalesce(F.col(c), F.lit("")) != ""

    units = registry.select(F.col("customer").alias("tenant"), F.explode(F.array_distinct("pages")).alias("page"), "email", "ga4")
    page = F.col("page")
    configured = (~page.isin(*_GA4_PAGES) | has("ga4.report")) & ((page != "email_campaigns") | has("email.table"))
    return units.filter(page.isin(*PAGE_TITLES) & configured).select("tenant", "page")


def entitled_rows(table: DataFrame, entitled: DataFrame, page: str, tenant_col: str = "tenant") -> DataFrame:
    """Rows of the tenants entitled to ``page``.

    A semi-join: where ``table`` is partitioned by ``tenant_col``, the entitlement
    table's filter on ``page`` makes Spark prune the partitions at run time.
    """
    who = entitled.filter(F.col("page") == page).select(F.col("tenant").alias(tenant_col))
    return table.join(who, tenant_col, "left_semi")


def _shared_writer(out: str, page: str, keys: list[str], tenant_col: str, results: list[BuildResult], silver: Silver) -> Write:
    """``keys``: the tenants whose reports are written (configuration; a page may take out some that failed)."""
    def write(report: str, df: DataFrame, reuse: bool = False, order: Sequence[Column] = (), landed: bool = False) -> DataFrame:
        path = f"{out}/{page}/{report}"
        df = df.withColumn(tenant_col, F.col(tenant_col).cast("string"))
        df = df if landed else silver(df)
        write_parquet(df, path, (tenant_col,), rebalance=True)
        # Entitled tenants without rows: their earlier report is replaced by an empty one.
        some = {r[0] for r in df.select(tenant_col).distinct().toLocalIterator()}
        write_empty(df.drop(tenant_col), [f"{path}/{partition_folder(tenant_col, k)}" for k in keys if k not in some], silver.path())
        results.extend(BuildResult(k, page, report, "ok") for k in keys)
        return df
    return write


def build_shared_marts(
    registry: DataFrame,
    tables: dict[str, DataFrame],
    email_tables: dict[str, DataFrame] | None,
    out_dir: str,
    tenant_col: str = "tenant",
) -> list[BuildResult]:
    """Every entitled report of every tenant, from tables shared by all tenants.

    ``tables`` maps a source suffix (``SHARED_SOURCES``) to the shared table,
    whose ``tenant_col`` holds the customer key.  Each report is one Spark
    job over the tenants entitled to its page (:func:`entitled_rows`), grouped
    by tenant; a page scans each of its sources once, whatever the number of
    tenants.  A tenant with malformed months fails its own product page only.
    ``email_tables`` maps an email table name to its frame: its keyed
    de-duplication runs once per table, then each tenant applies its own
    subject scope and buckets.
    """
    results: list[BuildResult] = []
    out = out_dir.rstrip("/")
    with Silver(registry.sparkSession) as kept:
        entitled = kept(entitlements(registry))
        own_rules = registry.filter(F.col("traffic").isNotNull()).select("customer", "traffic")
        rules = {r["customer"]: TrafficRules.from_dict(r["traffic"].asDict(recursive=True)) for r in own_rules.toLocalIterator()}
        for page in PAGE_TITLES:
            if page == "email_campaigns":
                readers = {c.customer: c.email for c in iter_tenant_configs(registry) if page in c.pages and c.email is not None}
                results += _shared_email(readers, email_tables or {}, out, tenant_col)
                continue
            keys = [r[0] for r in entitled.filter(F.col("page") == page).select("tenant").toLocalIterator()]
            if not keys:
                continue
            built: list[BuildResult] = []
            try:
                _shared_page(tables, page, entitled, keys, rules, out, tenant_col, built)
            except Exception as e:
                built += [BuildResult(k, page, "", "failed", _why(e)) for k in keys]
            results += built
    return results


def _shared_page(tables, page: str, entitled: DataFrame, keys: list[str], rules: Mapping[str, TrafficRules], out: str, tenant_col: str,
                 built: list[BuildResult]) -> None:
    def src(name: str) -> DataFrame:
        return entitled_rows(tables[name], entitled, page, tenant_col)

    with Silver(entitled.sparkSession) as silver:
        p = Page(src, _shared_writer(out, page, keys, tenant_col, built, silver), silver, [tenant_col], rules)

        def fail(bad: DataFrame) -> None:
            for r in bad.toLocalIterator():
                built.append(BuildResult(r[0], page, "", "failed", f"{r[1]} rows with malformed months"))
                keys.remove(r[0])

        if page == "product_performance":
            _shared_product(p, fail)
        else:
            _DATA_PAGES[page](p)


def _shared_email(configs: Mapping[str, EmailConfig], email_tables: Mapping[str, DataFrame | str], out: str, tenant_col: str) -> list[BuildResult]:
    """Email reports of every tenant: per source table one de-duplication, one
    pass that scopes the messages to the tenants whose subject they match, and
    one job per report for all of them.  A table given as text is the reason why
    it could not be read."""
    results: list[BuildResult] = []
    readers: dict[str, dict[str, EmailConfig]] = {}
    page = "email_campaigns"
    for tenant, cfg in configs.items():
        table = email_tables.get(cfg.table, f"missing source: {cfg.table}")
        if isinstance(table, str):
            results.append(BuildResult(tenant, page, "", "failed", table))
        else:
            readers.setdefault(cfg.table, {})[tenant] = cfg
    for name, cfgs in readers.items():
        built: list[BuildResult] = []
        try:
            with Silver(email_tables[name].sparkSession) as silver:
                base = silver(em.email_base(email_tables[name], em.used_columns(list(cfgs.values()))))
                scoped = silver(em.scope_tenants(base, cfgs, tenant_col))
                write = _shared_writer(out, page, list(cfgs), tenant_col, built, silver)
                by = [tenant_col]
                write("summary", em.email_summary_by_tenant(scoped, cfgs, tenant_col))
                write("sections", em.email_sections_by_tenant(scoped, cfgs, tenant_col))
                write("by_state", em.email_by_state(scoped, by))
                write("open_frequency", em.email_open_frequency(scoped, by))
        except Exception as e:
            built += [BuildResult(t, page, "", "failed", _why(e)) for t in cfgs]
        results += built
    return results
