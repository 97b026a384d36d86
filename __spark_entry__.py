"""

``entry(spark)`` runs the flagship report (Book Date) on sf0.001.
``queries()`` maps every implemented report/operator to a callable
``(spark, sf_dir) -> DataFrame``; each reads the driver's tables whole,
through the fixtures of ``report_fixtures`` (the application's
source tables derived from them).  Tenant configuration comes from the
registry fixture, table names are resolved through a :class:`TableCatalog`,
exactly as the batch job does it.
``oracle_sql()`` holds, for each key, independent DuckDB SQL over the same
tables; column names match the Spark results.
"""

from __future__ import annotations

import functools
import importlib
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from innsight.config import FUNNEL_STEPS, PAGE_TITLES, SOURCE_EXCLUDE, TenantConfig
from innsight.operators.filters import search_rows
from innsight.plans import attendance as att
from innsight.plans import email as em
from innsight.plans import ga4
from innsight.plans import product as prod
from innsight.operators.union import union_all_by_name
from innsight.plans.job import SHARED_SOURCES, build_shared_marts
from innsight.plans.tenants import entitled_pages, resolve_tenants
from innsight.session import ensure_checkpoint_dir
from innsight.sinks.export import read_ordered_csv, write_csv
from report_fixtures import fixture, fixture_ctes
from innsight.sources.registry import load_registry, load_registry_or_fallback, load_users, seed_customers, tenant_configs
from innsight.sources.silver import land_messages, land_partitioned, land_report_items
from innsight.sources.tables import TableCatalog, scan_email, scan_grain, scan_report_items, scan_shared, scan_transactions

SMOKE_DIR = "/root/testdata/sf0.001"
TENANT = "aurora"

# Parameters of the registered reports (a user's selections on the page).
EVENT_RANGE = ("1995-01-01", "1996-12-31")
EVENT_PICKS = {"Network": ["BUILDING", "AUTOMOBILE"], "Booking Status": ["reserved", "Unknown"]}
STATUS_PICKS = {"Transaction Status": ["Refunded"]}
FACET_PICKS = {"Source": ["1-URGENT", "2-HIGH", "Unknown"], "Booking Status": ["reserved"]}
PRODUCT_PICKS = {"Booked Year Month": ["1996-01", "1996-02", "1996-03"], "Item Name": ["red widget", "Unknown"]}
SEARCH_PATTERN = "borealis|days:3"
MAIL_RANGE = ("2024-01-05", "2024-01-12")
GA4_RANGE = ("2024-01-03", "2024-01-20")


# ---------------------------------------------------------------- wiring
# Table name (as the registry and the application name it) -> fixture.
SOURCE_TABLES = {
    "AURORA_REPORT_ITEMS": "report_items",
    "AURORA_UVE_TRANSACTIONS_GROUPED": "transactions_grouped",
    "mail_notifications": "mail_notifications",
    "EMAIL_ANALYSIS": "mail_notifications",  # the legacy search page's table
    **{f"AURORA_GA4_{g}": f"ga4_{g.lower()}" for g in ("DAILY", "EVENTS", "ITEMS", "DEVICE", "LOCATION", "SLIDES")},
    "DASHBOARD_USERS": "dashboard_users",
    "DASHBOARD_CUSTOMERS": "dashboard_customers",
    # the same sources shared by all tenants (leading TENANT column)
    "SHARED_REPORT_ITEMS": "report_items_by_tenant",
    "SHARED_UVE_TRANSACTIONS_GROUPED": "transactions_by_tenant",
    "SHARED_GA4_DAILY": "ga4_daily_by_tenant",
    "SHARED_GA4_EVENTS": "ga4_events_by_tenant",
    "SHARED_GA4_ITEMS": "ga4_items_by_tenant",
    "SHARED_GA4_DEVICE": "ga4_device_by_tenant",
    "SHARED_GA4_LOCATION": "ga4_location_by_tenant",
    # sources in other forms: DAILY with a time of day, dates as text, a long registry
    "TIMED_GA4_DAILY": "ga4_daily_timed",
    "TEXT_UVE_TRANSACTIONS_GROUPED": "transactions_text_dates",
    "MANY_CUSTOMERS": "many_customers",
}
_LANDED: dict[str, str] = {}  # key -> folder of fixtures written as Parquet


def catalog(spark: SparkSession, sf_dir: str) -> TableCatalog:
    """Source tables of the test world, under the names the registry points at.

    Normally each table is its fixture, derived from the driver's tables on
    every use; after :func:`land_fixtures` the key it returns resolves to the
    written copies instead (as a warehouse would hold them).
    """
    landed = _LANDED.get(sf_dir)
    if landed:
        return TableCatalog(spark, {t: f"{landed}/{f}" for t, f in SOURCE_TABLES.items()})
    return TableCatalog(spark, {t: (lambda f=f: _view(spark, sf_dir, f)) for t, f in SOURCE_TABLES.items()})


@functools.lru_cache(maxsize=256)
def _view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    # A fixture is the test world's view definition: its (lazy, analysed) plan is
    # kept per session; every query still reads and computes it in full.
    return fixture(spark, sf_dir, name)


def land_fixtures(spark: SparkSession, sf_dir: str, out_dir: str) -> str:
    """Write every fixture once as Parquet under ``out_dir``; returns the key to
    pass to the query callables instead of ``sf_dir``."""
    for f in sorted(set(SOURCE_TABLES.values())):
        fixture(spark, sf_dir, f).write.mode("overwrite").parquet(f"{out_dir}/{f}")
    key = f"{sf_dir}#landed:{out_dir}"
    _LANDED[key] = out_dir
    return key


@functools.lru_cache(maxsize=16)
def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Loaded (and checked for duplicate keys) once per session and data folder.
    return load_registry(catalog(spark, sf_dir).table("DASHBOARD_CUSTOMERS"))


@functools.lru_cache(maxsize=16)
def _tenants(spark: SparkSession, sf_dir: str) -> dict[str, TenantConfig]:
    # Configuration is read once per session and data folder, like the
    # application's registry cache; reports then use the config objects.
    return {cfg.customer: cfg for cfg in tenant_configs(registry(spark, sf_dir))}


def tenant(spark: SparkSession, sf_dir: str, key: str = TENANT) -> TenantConfig:
    return _tenants(spark, sf_dir)[key]


def _tx(spark, sf):
    return scan_transactions(catalog(spark, sf), tenant(spark, sf))


def _items(spark, sf):
    return scan_report_items(catalog(spark, sf), tenant(spark, sf))


def _email(spark, sf, date_range=None):
    cfg = tenant(spark, sf)
    return em.email_scope(scan_email(catalog(spark, sf), cfg), cfg.email, date_range), cfg.email


def _ga4(spark, sf, *grains, date_range=None):
    """Cleaned GA4 grains of the tenant, restricted to DAILY's first..last day or a selected range."""
    cat, cfg = catalog(spark, sf), tenant(spark, sf)
    others = {g: scan_grain(cat, cfg, g) for g in grains if g != "DAILY"}
    frames = ga4.page_frames(scan_grain(cat, cfg, "DAILY"), others, date_range, cfg.traffic)
    return [frames[g] for g in grains]


def _ga4_long(spark, sf):
    cat, cfg = catalog(spark, sf), tenant(spark, sf)
    long = ga4.ga4_long({g.lower(): scan_grain(cat, cfg, g) for g in ("ITEMS", "EVENTS", "DAILY", "DEVICE", "LOCATION", "SLIDES")})
    # the 38-digit measures as text, so that every digit is compared
    return long.withColumns({c: long[c].cast("string") for c in ("KEY_EVENTS", "USER_ENGAGEMENT_DURATION")})


def _many_tenants(spark, sf):
    reg = load_registry(catalog(spark, sf).table("MANY_CUSTOMERS"))
    return reg.select("customer", "label", "prefix", F.array_join("pages", ",").alias("pages"), F.col("email.subject_match").alias("subject_match"),
                      F.size("email.buckets").alias("n_buckets"), F.col("ga4.report").alias("ga4_report"))


def _resolved(spark, sf):
    users = load_users(catalog(spark, sf).table("DASHBOARD_USERS"))
    return resolve_tenants(users, registry(spark, sf))


def _shared(spark, sf, *grains, date_range=None):
    """Cleaned GA4 grains shared by all tenants; each tenant's default range comes from its own DAILY rows."""
    cat = catalog(spark, sf)
    others = {g: cat.table(f"SHARED_GA4_{g}") for g in grains if g != "DAILY"}
    return ga4.page_frames(cat.table("SHARED_GA4_DAILY"), others, date_range, by=["TENANT"])


def _shared_funnel(spark, sf):
    f = _shared(spark, sf, "EVENTS")
    return ga4.funnel(f["EVENTS"], by=["TENANT"], groups=f[ga4.GROUPS])


def _shared_kpis(kpis):
    def run(spark, sf):
        f = _shared(spark, sf, "DAILY")
        return kpis(f["DAILY"], ["TENANT"], f[ga4.GROUPS])
    return run


def _email_by_tenant(spark, sf):
    """Email summary of every tenant reading the shared notifications table, in one pass."""
    cfgs = {c.customer: c.email for c in _tenants(spark, sf).values() if c.email and "email_campaigns" in c.pages}
    base = em.email_base(catalog(spark, sf).table("mail_notifications"), em.used_columns(list(cfgs.values())))
    return em.email_summary_by_tenant(em.scope_tenants(base, cfgs, "TENANT"), cfgs, "TENANT")


def _new_table(spark: SparkSession) -> tuple[str, str]:
    """Name and folder (shared) of a table of its own for one call."""
    name = f"landed_{uuid.uuid4().hex}"
    return name, f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}"


def _email_silver(spark, sf):
    """Email summary over messages landed in two overlapping batches, bucketed by id."""
    cfg, raw = tenant(spark, sf), catalog(spark, sf).table("mail_notifications")
    name, path = _new_table(spark)
    for batch in ("SENT = '1' OR DATA_STATE IS NULL", "coalesce(DATA_STATE, '') <> 'sent' OR SENT <> '1'"):
        land_messages(raw.filter(batch), name, 8, path)
    return em.email_summary(em.email_scope(spark.table(name), cfg.email), cfg.email)


def _product_silver(spark, sf):
    """Product total over report items landed in two overlapping batches, bucketed by month and item."""
    raw = _items(spark, sf)
    name, path = _new_table(spark)
    for batch in ("VIEWED % 2 = 0", "VIEWED % 3 = 0 OR VIEWED % 2 = 1"):
        land_report_items(raw.filter(batch), name, 8, path)
    return prod.product_total(spark.table(name))


def _book_date_partitioned(spark, sf):
    """Book Date of one tenant of a table partitioned by tenant."""
    name, path = _new_table(spark)
    land_partitioned(catalog(spark, sf).table("SHARED_UVE_TRANSACTIONS_GROUPED"), name, "TENANT", path)
    return att.book_date(scan_shared(TableCatalog(spark), name, [TENANT], "TENANT"))


def _product_csv(spark, sf):
    """The product detail as CSV files in the report's order, read back with each row's position."""
    detail = prod.product_performance(_items(spark, sf), ordered=False)
    _, path = _new_table(spark)
    write_csv(detail, path, order=prod.report_order(), rows_per_file=5000)
    return read_ordered_csv(spark, path, detail.schema)


def _job_reports(spark, sf):
    """The batch job over the shared tables of all tenants; four of its written reports, read back."""
    cat = catalog(spark, sf)
    _, out = _new_table(spark)
    tables = {s: cat.table(f"SHARED_{s}") for s in SHARED_SOURCES}
    results = build_shared_marts(registry(spark, sf), tables, {"mail_notifications": cat.table("mail_notifications")}, out, "TENANT")
    failed = [r for r in results if r.status == "failed"]
    if failed:
        raise RuntimeError(str(failed[0]))
    parts = [("book_date/summary", F.concat_ws("/", "Item", "Department"), "Net Attendance", "Net Value"), ("guest_portal/funnel", F.col("Step"), "Events", "position"),
             ("email_campaigns/summary", F.col("Segment"), "Emails Sent", "Delivered"), ("product_performance/total", F.lit("Total"), "View", "Net Value")]
    rows = [spark.read.parquet(f"{out}/{r}").select(F.col("TENANT").cast("string").alias("TENANT"), F.lit(r).alias("report"), label.alias("label"),
                                                    F.col(a).cast("double").alias("a"), F.col(b).cast("double").alias("b")) for r, label, a, b in parts]
    return union_all_by_name(rows)


def _registry_fallback(spark, sf):
    """The registry from a control table of seeded and appended tenants, and the fallback where it is missing or has no active row."""
    fallback = list(_tenants(spark, sf).values())
    many = catalog(spark, sf).table("MANY_CUSTOMERS")
    seeded = seed_customers(spark, fallback).unionByName(many.filter("length(CUSTOMER) % 2 = 0"), allowMissingColumns=True)
    name, path = _new_table(spark)
    seeded.write.option("path", path).saveAsTable(name)
    many.filter("length(CUSTOMER) % 2 = 1").write.mode("append").option("path", path).saveAsTable(name)
    closed, closed_path = _new_table(spark)
    many.withColumn("ACTIVE", F.lit(False)).write.option("path", closed_path).saveAsTable(closed)
    cases = {"table": name, "no active row": closed, "missing": "landed_missing"}
    return union_all_by_name([load_registry_or_fallback(spark, table, fallback).select(
        F.lit(case).alias("case"), "customer", "label", "prefix", F.array_join("pages", ",").alias("pages"), F.col("email.subject_match").alias("subject_match"))
        for case, table in cases.items()])


def entry(spark: SparkSession) -> DataFrame:
    """Flagship: Book Date attendance summary on sf0.001."""
    return att.book_date(_tx(spark, SMOKE_DIR))


def _corpus() -> list:
    """Modules of the optional corpus subpackage and its pipeline that add queries; none if they are absent."""
    found = []
    for name, parent in (("innsight.llm.queries", "innsight.llm"), ("corpus_pipeline", "corpus_pipeline")):
        try:
            found.append(importlib.import_module(name))
        except ModuleNotFoundError as e:
            if e.name not in (name, parent, "innsight.llm"):
                raise
    return found


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out = report_queries()
    for module in _corpus():
        out |= module.queries()
    return out


def report_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """The reports: every query but those of the corpus subpackage."""
    return {
        # attendance
        "book_date": lambda s, d: att.book_date(_tx(s, d)),
        "book_date_total": lambda s, d: att.attendance_total(_tx(s, d), att.BOOK_DATE),
        "event_date": lambda s, d: att.event_date(_tx(s, d), EVENT_RANGE, EVENT_PICKS),
        "event_date_total": lambda s, d: att.attendance_total(_tx(s, d), att.EVENT_DATE, EVENT_RANGE, EVENT_PICKS),
        "attendance_status": lambda s, d: att.book_date(_tx(s, d), None, STATUS_PICKS),
        "attendance_facets": lambda s, d: att.attendance_options(_tx(s, d), att.BOOK_DATE, None, FACET_PICKS),
        # product performance
        "product_performance": lambda s, d: prod.product_performance(_items(s, d)),
        "product_total": lambda s, d: prod.product_total(_items(s, d)),
        "product_facets": lambda s, d: prod.product_options(_items(s, d), PRODUCT_PICKS),
        # email campaigns
        "email_summary": lambda s, d: em.email_summary(*_email(s, d)),
        "email_sections": lambda s, d: em.email_sections(*_email(s, d)),
        "email_by_state": lambda s, d: em.email_by_state(_email(s, d)[0]),
        "email_open_frequency": lambda s, d: em.email_open_frequency(_email(s, d)[0]),
        # guest portal
        "guest_kpis": lambda s, d: ga4.guest_kpis(*_ga4(s, d, "DAILY")),
        "sessions_over_time": lambda s, d: ga4.sessions_over_time(*_ga4(s, d, "DAILY")),
        "funnel": lambda s, d: ga4.funnel(*_ga4(s, d, "EVENTS")),
        "top_items": lambda s, d: ga4.top_items(*_ga4(s, d, "ITEMS")),
        "most_visited": lambda s, d: ga4.most_visited(*_ga4(s, d, "ITEMS")),
        # audience
        "audience_kpis": lambda s, d: ga4.audience_kpis(*_ga4(s, d, "DAILY")),
        "users_over_time": lambda s, d: ga4.users_over_time(*_ga4(s, d, "DAILY")),
        "devices": lambda s, d: ga4.devices(*_ga4(s, d, "DEVICE")),
        "acquisition": lambda s, d: ga4.acquisition(*_ga4(s, d, "DAILY")),
        "top_locations": lambda s, d: ga4.top_locations(*_ga4(s, d, "LOCATION")),
        # long view, legacy search, tenants
        "ga4_long": _ga4_long,
        "search_rows": lambda s, d: search_rows(catalog(s, d).table("EMAIL_ANALYSIS"), SEARCH_PATTERN),
        "resolve_tenants": _resolved,
        "entitled_pages": lambda s, d: entitled_pages(_resolved(s, d), registry(s, d)),
        "registry_rows": _many_tenants,
        # downloads, selected ranges, other forms of the sources
        "product_export": lambda s, d: prod.product_export(_items(s, d)),
        "book_date_export": lambda s, d: att.attendance_export(_tx(s, d), att.BOOK_DATE),
        "book_date_text_range": lambda s, d: att.book_date(catalog(s, d).table("TEXT_UVE_TRANSACTIONS_GROUPED"), EVENT_RANGE),
        "email_summary_range": lambda s, d: em.email_summary(*_email(s, d, MAIL_RANGE)),
        "guest_kpis_range": lambda s, d: ga4.guest_kpis(*_ga4(s, d, "DAILY", date_range=GA4_RANGE)),
        "funnel_range": lambda s, d: ga4.funnel(*_ga4(s, d, "EVENTS", date_range=GA4_RANGE)),
        "guest_kpis_timed": lambda s, d: ga4.guest_kpis(ga4.page_frames(catalog(s, d).table("TIMED_GA4_DAILY"))["DAILY"]),
        # tenants sharing tables: one job for all tenants, grouped by tenant
        "book_date_by_tenant": lambda s, d: att.book_date(catalog(s, d).table("SHARED_UVE_TRANSACTIONS_GROUPED"),
                                                          by=["TENANT"]),
        "funnel_by_tenant": _shared_funnel,
        "guest_kpis_by_tenant": _shared_kpis(ga4.guest_kpis),
        "audience_kpis_by_tenant": _shared_kpis(ga4.audience_kpis),
        "sessions_by_tenant": lambda s, d: ga4.sessions_over_time(_shared(s, d, "DAILY")["DAILY"], ["TENANT"]),
        "top_items_by_tenant": lambda s, d: ga4.top_items(_shared(s, d, "ITEMS")["ITEMS"], by=["TENANT"]),
        "devices_by_tenant": lambda s, d: ga4.devices(_shared(s, d, "DEVICE")["DEVICE"], ["TENANT"]),
        "top_locations_by_tenant": lambda s, d: ga4.top_locations(_shared(s, d, "LOCATION")["LOCATION"], by=["TENANT"]),
        "email_summary_by_tenant": _email_by_tenant,
        # landed tables and written reports, read back
        "email_summary_bucketed": _email_silver,
        "product_total_bucketed": _product_silver,
        "book_date_partitioned": _book_date_partitioned,
        "product_csv": _product_csv,
        "job_reports": _job_reports,
        "registry_fallback": _registry_fallback,
    }


# ---------------------------------------------------------------- oracle SQL (DuckDB)
_NUM_TEXT = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def _num0(x: str) -> str:
    """Lenient text -> DOUBLE, 0 when unparsable (DuckDB)."""
    return (
        f"coalesce(CASE WHEN regexp_full_match(lower(trim({x})), '[+-]?inf(inity)?') THEN TRY_CAST({x} AS DOUBLE) "
        f"WHEN regexp_matches({x}, '{_NUM_TEXT}') AND abs(TRY_CAST({x} AS DOUBLE)) < 'inf'::DOUBLE "
        f"THEN TRY_CAST({x} AS DOUBLE) END, 0.0)"
    )


def _sql_list(vals) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in vals)


def _ratio(n: str, d: str) -> str:
    return f"coalesce(CAST({n} AS DOUBLE) / nullif(CAST({d} AS DOUBLE), 0), 0.0)"


def _pct(r: str) -> str:
    return f"printf('%.2f%%', ({r}) * 100)"


_TX = """, t AS (
  SELECT coalesce(TI_ITEMNAME, 'Unknown') AS Item, coalesce(PRODUCT_CATEGORY, 'Unknown') AS Department,
         coalesce(SOURCE, 'Unknown') AS Source, coalesce(NETWORK, 'Unknown') AS Network,
         coalesce(VP_VENUENAME, 'Unknown') AS Venue, coalesce(P_CURRENTSTATUS, 'Unknown') AS "Booking Status",
         CASE WHEN TRY_CAST(TI_STATUS AS DOUBLE) = 9 OR TB_ACTION = 'refund' THEN 'Refunded' ELSE 'Charged' END
           AS "Transaction Status",
         """ + _num0("TB_GUESTS") + """ AS na,
         CASE WHEN coalesce(TB_SUBTOTALAGREE, 0) = 0 THEN CAST(coalesce(ADDED_PRICE, 0) AS DOUBLE)
              ELSE TB_SUBTOTALAGREE END AS nv,
         T_TRANSDATE, TI_CALDATE
  FROM transactions_grouped)
"""


# Money with two decimals, added exactly.
_EXACT = "CAST(sum(CAST(nv AS DECIMAL(38, 4))) AS DOUBLE)"


def _tx_where(date_col: str | None, rng, picks) -> str:
    conds = ["TRUE"]
    if rng:
        conds.append(f"{date_col} >= TIMESTAMP '{rng[0]} 00:00:00' AND {date_col} <= TIMESTAMP '{rng[1]} 00:00:00'")
    for k, v in (picks or {}).items():
        conds.append(f'"{k}" IN ({_sql_list(v)})')
    return " AND ".join(conds)


def _att_sql(date_col=None, rng=None, picks=None, shared=False, table="transactions_grouped") -> str:
    if shared:
        tx = _TX.replace("SELECT coalesce(TI_ITEMNAME", "SELECT TENANT, coalesce(TI_ITEMNAME").replace(
            "FROM transactions_grouped", "FROM transactions_by_tenant")
        return (fixture_ctes(["transactions_by_tenant"]) + tx +
                'SELECT TENANT, Item, Department, sum(na) AS "Net Attendance", ' + _EXACT + ' AS "Net Value" '
                "FROM t GROUP BY TENANT, Item, Department")
    return (fixture_ctes([table]) + _TX.replace("FROM transactions_grouped", f"FROM {table}") +
            'SELECT Item, Department, sum(na) AS "Net Attendance", ' + _EXACT + ' AS "Net Value" '
            f"FROM t WHERE {_tx_where(date_col, rng, picks)} GROUP BY Item, Department")


def _att_total_sql(date_col=None, rng=None, picks=None) -> str:
    return (fixture_ctes(["transactions_grouped"]) + _TX +
            'SELECT round_even(coalesce(sum(na), 0), 2) AS "Net Attendance", '
            'round_even(coalesce(CAST(sum(CAST(nv AS DECIMAL(38, 4))) AS DOUBLE), 0), 2) AS "Net Value" '
            f"FROM t WHERE {_tx_where(date_col, rng, picks)}")


def _options_sql(table: str, facets, picks) -> str:
    parts = []
    conds = ["TRUE"]
    for i, f in enumerate(facets):
        parts.append(f"SELECT DISTINCT {i} AS position, '{f}' AS facet, \"{f}\" AS value FROM {table} "
                     f"WHERE \"{f}\" IS NOT NULL AND {' AND '.join(conds)}")
        if picks.get(f):
            conds.append(f'"{f}" IN ({_sql_list(picks[f])})')
    return " UNION ALL ".join(parts)


_PRODUCT = """, p AS (SELECT DISTINCT * FROM report_items),
c AS (
  SELECT strftime(strptime(CAST(BOOKED_MONTH AS VARCHAR) || '01', '%Y%m%d'), '%Y-%m') AS "Booked Year Month",
         coalesce(ITEM_NAME, 'Unknown') AS "Item Name", coalesce(PRODUCT_CATEGORY, 'Unknown') AS Department,
         VIEWED AS "View", TRANSACTIONS AS "Gross Booked", CONVERSION AS Conversion,
         ATTENDANCE AS "Net Attendance",
         CASE WHEN coalesce(CASE WHEN isnan(VALUE) THEN 0 ELSE VALUE END, 0) = 0 THEN CASE WHEN isnan(VALUE_ADDED) THEN NULL ELSE VALUE_ADDED END ELSE VALUE END
           AS "Net Value",
         CANCELLED AS Cancelled, ITEMSPURCHASED AS "Gross Quantity"
  FROM p)
"""

_EMAIL = """, m AS (
  SELECT * FROM mail_notifications
  QUALIFY row_number() OVER (PARTITION BY DATA_ID ORDER BY DATA_TS_DATE ASC NULLS LAST,
      SENT NULLS FIRST, OPEN NULLS FIRST, CLICKS NULLS FIRST, DATA_CLICKS NULLS FIRST, DATA_OPENS NULLS FIRST,
      DATA_STATE NULLS FIRST, NOTIFICATION_TAG NULLS FIRST, DATA_SUBJECT NULLS FIRST) = 1),
s AS (
  SELECT DATA_ID, DATA_TS_DATE, """ + _num0("SENT") + """ AS SENT, coalesce(OPEN, 0) AS OPEN,
         coalesce(CLICKS, 0) AS CLICKS, coalesce(DATA_CLICKS, 0) AS DATA_CLICKS,
         coalesce(DATA_OPENS, 0) AS DATA_OPENS, DATA_STATE, NOTIFICATION_TAG
  FROM m
  WHERE regexp_matches(coalesce(DATA_SUBJECT, ''), 'hotel aurora', 'i') AND DATA_TS_DATE IS NOT NULL)
"""

def _mail_where(rng) -> str:
    return f" AND DATA_TS_DATE >= TIMESTAMP '{rng[0]}' AND DATA_TS_DATE < TIMESTAMP '{rng[1]}' + INTERVAL 1 DAY" if rng else ""


_EMAIL_BUCKETS = [("days:15", "15 days"), ("days:0", "0 days"), ("days:99", "99 days")]


def _email_summary_sql(rng=None) -> str:
    segs = [(f"coalesce(NOTIFICATION_TAG, '') = '{v}'", lbl) for v, lbl in _EMAIL_BUCKETS] + [("TRUE", "Total")]
    branches = " UNION ALL ".join(
        f"SELECT {i} AS position, '{lbl}' AS Segment, count(DATA_ID) AS rec, "
        f"CAST(trunc(coalesce(sum(SENT), 0)) AS BIGINT) AS sent, CAST(coalesce(sum(OPEN), 0) AS BIGINT) AS opened, "
        f"CAST(coalesce(sum(CLICKS), 0) AS BIGINT) AS clicks, CAST(coalesce(sum(DATA_CLICKS), 0) AS BIGINT) AS dclicks "
        f"FROM s WHERE {cond}{_mail_where(rng)}"
        for i, (cond, lbl) in enumerate(segs)
    )
    return (fixture_ctes(["mail_notifications"]) + _EMAIL + f", seg AS ({branches})\n"
            'SELECT CAST(position AS INTEGER) AS position, Segment, rec AS "Emails Sent", sent AS "Delivered", opened AS "Opened", dclicks AS "Data Clicks", '
            f'clicks AS "Emails w/ >=1 Click", {_pct(_ratio("sent", "rec"))} AS "Delivery Rate", '
            f'{_pct(_ratio("opened", "sent"))} AS "Open Rate", {_pct(_ratio("clicks", "sent"))} AS "CTR" FROM seg')


# Email configuration of the two active tenants in the registry fixture.
_EMAIL_TENANTS = {
    "aurora": ("hotel aurora", _EMAIL_BUCKETS),
    "borealis": ("Hotel Borealis", [("days:30", "30 days")]),
}


def _email_summary_by_tenant_sql() -> str:
    dedup = _EMAIL.split(",\ns AS (")[0]  # the keyed de-duplication CTE
    scoped, finals = [], []
    for t, (pattern, buckets) in _EMAIL_TENANTS.items():
        scoped.append(f"""s_{t} AS (
  SELECT DATA_ID, {_num0('SENT')} AS SENT, coalesce(OPEN, 0) AS OPEN, coalesce(CLICKS, 0) AS CLICKS,
         coalesce(DATA_CLICKS, 0) AS DATA_CLICKS, NOTIFICATION_TAG FROM m
  WHERE regexp_matches(coalesce(DATA_SUBJECT, ''), '{pattern}', 'i') AND DATA_TS_DATE IS NOT NULL)""")
        segs = [(f"coalesce(NOTIFICATION_TAG, '') = '{v}'", lbl) for v, lbl in buckets] + [("TRUE", "Total")]
        for i, (cond, lbl) in enumerate(segs):
            finals.append(
                f"SELECT '{t}' AS TENANT, {i} AS position, '{lbl}' AS Segment, count(DATA_ID) AS rec, "
                f"CAST(trunc(coalesce(sum(SENT), 0)) AS BIGINT) AS sent, CAST(coalesce(sum(OPEN), 0) AS BIGINT) AS opened, "
                f"CAST(coalesce(sum(CLICKS), 0) AS BIGINT) AS clicks, CAST(coalesce(sum(DATA_CLICKS), 0) AS BIGINT) AS dclicks "
                f"FROM s_{t} WHERE {cond} HAVING (SELECT count(*) FROM s_{t}) > 0")
    return (fixture_ctes(["mail_notifications"]) + dedup + ",\n" + ",\n".join(scoped)
            + ",\nseg AS (" + " UNION ALL ".join(finals) + ")\n"
            'SELECT TENANT, CAST(position AS INTEGER) AS position, Segment, rec AS "Emails Sent", sent AS "Delivered", opened AS "Opened", '
            'dclicks AS "Data Clicks", clicks AS "Emails w/ >=1 Click", '
            f'{_pct(_ratio("sent", "rec"))} AS "Delivery Rate", {_pct(_ratio("opened", "sent"))} AS "Open Rate", '
            f'{_pct(_ratio("clicks", "sent"))} AS "CTR" FROM seg')


def _email_sections_sql() -> str:
    segs = [(f"coalesce(NOTIFICATION_TAG, '') = '{v}'", lbl) for v, lbl in _EMAIL_BUCKETS] + [("TRUE", "Total Emails")]
    branches = " UNION ALL ".join(
        f"SELECT {i} AS position, '{lbl}' AS Section, count(DATA_ID) AS rec, coalesce(sum(SENT), 0) AS sent, "
        f"coalesce(sum(OPEN), 0) AS opened, coalesce(sum(CLICKS), 0) AS clicks, coalesce(sum(DATA_CLICKS), 0) AS dclicks "
        f"FROM s WHERE {cond}"
        for i, (cond, lbl) in enumerate(segs)
    )
    return (fixture_ctes(["mail_notifications"]) + _EMAIL + f", seg AS ({branches})\n"
            'SELECT CAST(position AS INTEGER) AS position, Section, rec AS "Email Sent", CAST(trunc(sent) AS BIGINT) AS "Emails Delivered", '
            'CAST(trunc(opened) AS BIGINT) AS "Emails Opened", '
            f'{_ratio("sent", "rec")} AS "AVG Delivery Rate", CAST(trunc(dclicks) AS BIGINT) AS "Data Clicks", '
            'CAST(trunc(clicks) AS BIGINT) AS "Email With at Least 1 Click", '
            f'{_ratio("clicks", "sent")} AS "Click Rate (CTR)", {_ratio("opened", "sent")} AS "AVG Open Rate" FROM seg')


_SOURCE_RE = "|".join(SOURCE_EXCLUDE)
_HOST_OK = "regexp_matches(coalesce(HOSTNAME, ''), 'booketing', 'i')"
_SOURCE_OK = f"NOT regexp_matches(lower(coalesce(SESSIONSOURCE, '')), '{_SOURCE_RE}')"

_IN_RANGE = "DATE BETWEEN (SELECT lo FROM r) AND (SELECT hi FROM r)"
_GA4 = f""", d0 AS (SELECT * FROM ga4_daily WHERE {_HOST_OK} AND {_SOURCE_OK}),
r AS (SELECT min(DATE) AS lo, max(DATE) AS hi FROM d0),
d AS (SELECT DATE, SESSIONSOURCE, SESSIONS, TOTALUSERS, NEWUSERS, ENGAGEDSESSIONS,
             {_num0('KEYEVENTS')} AS KEYEVENTS, {_num0('USERENGAGEMENTDURATION')} AS DUR
      FROM d0 WHERE {_IN_RANGE}),
e AS (SELECT * FROM ga4_events WHERE {_HOST_OK} AND {_SOURCE_OK} AND {_IN_RANGE}),
i AS (SELECT * FROM ga4_items WHERE {_IN_RANGE}),
dev AS (SELECT * FROM ga4_device WHERE {_HOST_OK} AND {_IN_RANGE}),
loc AS (SELECT * FROM ga4_location WHERE {_HOST_OK} AND {_SOURCE_OK} AND {_IN_RANGE})
"""
_GA4_FIX = ["ga4_daily", "ga4_events", "ga4_items", "ga4_device", "ga4_location"]


def _ga4_sql(body: str) -> str:
    return fixture_ctes(_GA4_FIX) + _GA4 + body


def _item_sums(limit: int, extra: str = "") -> str:
    return ("SELECT ITEMNAME, CAST(sum(ITEMSVIEWED) AS BIGINT) AS v, CAST(sum(ITEMSPURCHASED) AS BIGINT) AS p, "
            'CAST(row_number() OVER (ORDER BY sum(ITEMSVIEWED) DESC, ITEMNAME) AS INTEGER) AS "Rank" '
            "FROM i WHERE ITEMNAME IS NOT NULL GROUP BY ITEMNAME ORDER BY v DESC, ITEMNAME LIMIT " + str(limit))


# The long view's contract: its columns and types, and what each report fills (long name: source expression).
_LONG_TYPES = {
    **dict.fromkeys(("ITEM_NAME", "EVENT_NAME", "DEVICE_CATEGORY", "CITY", "COUNTRY", "REGION", "LINK_URL", "LINK_TEXT",
                     "SESSION_SOURCE", "HOST_NAME", "KEY_EVENTS", "USER_ENGAGEMENT_DURATION"), "VARCHAR"),
    **dict.fromkeys(("SESSIONS", "ITEMS_VIEWED", "ITEMS_PURCHASED", "EVENT_COUNT", "ACTIVE_USERS", "TOTAL_USERS", "NEW_USERS",
                     "SCREEN_PAGE_VIEWS", "ENGAGED_SESSIONS"), "BIGINT"),
}


def _ga4_long_sql() -> str:
    def whole(c: str) -> str:
        return f"CAST(TRY_CAST({c} AS DECIMAL(38, 0)) AS VARCHAR)"

    def same(*columns: str) -> dict[str, str]:
        """Long names whose source has the same name without underscores."""
        return {c: c.replace("_", "") for c in columns}

    keys = {"KEY_EVENTS": whole("KEYEVENTS")}
    traffic = same("SESSION_SOURCE") | {"HOST_NAME": "HOSTNAME", "SESSIONS": "SESSIONS"}
    filled = {
        "slides": same("EVENT_NAME", "LINK_URL", "LINK_TEXT", "EVENT_COUNT"),
        "location": same("CITY", "COUNTRY", "REGION") | traffic | keys,
        "device": same("DEVICE_CATEGORY") | {"HOST_NAME": "HOSTNAME", "SESSIONS": "SESSIONS"},
        "daily": same("ACTIVE_USERS", "TOTAL_USERS", "NEW_USERS", "SCREEN_PAGE_VIEWS", "ENGAGED_SESSIONS") | traffic | keys
        | {"USER_ENGAGEMENT_DURATION": whole("USERENGAGEMENTDURATION")},
        "events": same("EVENT_NAME", "EVENT_COUNT") | traffic | keys,
        "items": same("ITEM_NAME", "ITEMS_VIEWED", "ITEMS_PURCHASED"),
    }
    empty = "SELECT NULL::VARCHAR AS REPORT, NULL::DATE AS DATE, " + ", ".join(f"NULL::{t} AS {c}" for c, t in _LONG_TYPES.items()) + " WHERE FALSE"
    parts = [f"SELECT '{r}' AS REPORT, DATE, " + ", ".join(f"{e} AS {c}" for c, e in cols.items()) + f" FROM ga4_{r}" for r, cols in filled.items()]
    return fixture_ctes([f"ga4_{r}" for r in filled]) + "\nUNION ALL BY NAME\n".join([empty, *parts])


_MAIL_COLS = ("DATA_ID", "DATA_TS_DATE", "SENT", "OPEN", "CLICKS", "DATA_CLICKS", "DATA_OPENS",
              "DATA_STATE", "NOTIFICATION_TAG", "DATA_SUBJECT")

_USERS = """, u AS (
  SELECT lower(trim(EMAIL)) AS email, NAME, CUSTOMER, CREATED_AT FROM dashboard_users
  WHERE coalesce(ACTIVE, TRUE) AND coalesce(lower(trim(EMAIL)), '') <> ''
  QUALIFY row_number() OVER (PARTITION BY lower(trim(EMAIL)) ORDER BY CREATED_AT DESC NULLS LAST,
      NAME NULLS FIRST, CUSTOMER NULLS FIRST) = 1),
us AS (SELECT email, coalesce(nullif(NAME, ''), email) AS name,
              CASE WHEN coalesce(CUSTOMER, '') = '' THEN NULL ELSE lower(trim(CUSTOMER)) END AS customer FROM u),
reg AS (SELECT lower(trim(CUSTOMER)) AS customer, coalesce(nullif(LABEL, ''), lower(trim(CUSTOMER))) AS label,
               upper(trim(PREFIX)) AS prefix, coalesce(from_json(PAGES, '["VARCHAR"]'), []) AS pages
        FROM dashboard_customers WHERE coalesce(ACTIVE, TRUE)),
res AS (SELECT us.email, us.name, us.customer, reg.label, reg.prefix, reg.customer IS NOT NULL AS authorized
        FROM us LEFT JOIN reg ON us.customer = reg.customer)
"""


def _shared_sql(grain: str, body: str) -> str:
    """SQL over a shared grain: ``g`` its cleaned rows in each tenant's own DAILY range, ``r`` the ranges."""
    dep = f"ga4_{grain}_by_tenant"
    traffic = {"items": "TRUE", "device": _HOST_OK}.get(grain, f"{_HOST_OK} AND {_SOURCE_OK}")
    return fixture_ctes(list(dict.fromkeys(["ga4_daily_by_tenant", dep]))) + f"""
, d0 AS (SELECT * FROM ga4_daily_by_tenant WHERE {_HOST_OK} AND {_SOURCE_OK}),
r AS (SELECT TENANT, min(DATE) AS lo, max(DATE) AS hi FROM d0 WHERE DATE IS NOT NULL GROUP BY TENANT),
g AS (SELECT x.* FROM {dep} x JOIN r ON x.TENANT = r.TENANT WHERE {traffic} AND x.DATE BETWEEN r.lo AND r.hi)
""" + body


def _shared_top_sql(grain: str, keys: dict[str, str], measures: dict[str, str], k: int, where: str) -> str:
    order = f"sum({next(iter(measures.values()))}) DESC, " + ", ".join(keys.values())
    return _shared_sql(grain, "SELECT TENANT, CAST(row_number() OVER (PARTITION BY TENANT ORDER BY " + order + ') AS INTEGER) AS "Rank", '
                       + ", ".join(f'{c} AS "{n}"' for n, c in keys.items()) + ", "
                       + ", ".join(f'CAST(sum({c}) AS BIGINT) AS "{n}"' for n, c in measures.items())
                       + f" FROM g WHERE {where} GROUP BY TENANT, " + ", ".join(keys.values()) + f' QUALIFY "Rank" <= {k}')


def _shared_funnel_sql() -> str:
    steps = ", ".join(f"({i}, '{k}', '{lbl}')" for i, (k, lbl) in enumerate(FUNNEL_STEPS))
    return _shared_sql("events", f""", f AS (SELECT * FROM (VALUES {steps}) v(position, EVENTNAME, Step)),
n AS (SELECT TENANT, EVENTNAME, sum(EVENTCOUNT) AS n FROM g GROUP BY TENANT, EVENTNAME)
SELECT r.TENANT, CAST(f.position AS INTEGER) AS position, f.Step, CAST(coalesce(n.n, 0) AS BIGINT) AS "Events"
FROM r CROSS JOIN f LEFT JOIN n ON n.TENANT = r.TENANT AND n.EVENTNAME = f.EVENTNAME""")


def _entitled_sql() -> str:
    cat = ", ".join(f"('{k}', '{v}')" for k, v in PAGE_TITLES.items())
    return (fixture_ctes(["dashboard_users", "dashboard_customers"]) + _USERS +
            ", tp AS (SELECT customer, unnest(pages) AS page, CAST(generate_subscripts(pages, 1) - 1 AS INTEGER) AS position FROM reg),\n"
            f"cat AS (SELECT * FROM (VALUES {cat}) v(page, title))\n"
            "SELECT res.email, res.customer, tp.position, tp.page, cat.title FROM res "
            "JOIN tp ON res.customer = tp.customer JOIN cat ON tp.page = cat.page WHERE res.authorized")


def oracle_sql() -> dict[str, str]:
    out = report_sql()
    for module in _corpus():
        out |= module.oracle_sql()
    return out


_KPIS = {
    "guest": 'SELECT CAST(coalesce(sum(SESSIONS), 0) AS BIGINT) AS "Sessions", '
            'CAST(trunc(coalesce(sum(KEYEVENTS), 0)) AS BIGINT) AS "Key Events", '
            f'{_ratio("sum(KEYEVENTS)", "sum(SESSIONS)")} AS "Conversion Rate", '
            'CAST(coalesce(sum(ENGAGEDSESSIONS), 0) AS BIGINT) AS "Engaged Sessions", '
            f'{_ratio("sum(DUR)", "sum(SESSIONS)")} AS "Avg Engagement" FROM d',
    "audience": 'SELECT CAST(coalesce(sum(TOTALUSERS), 0) AS BIGINT) AS "Total Users", '
            'CAST(coalesce(sum(NEWUSERS), 0) AS BIGINT) AS "New Users", '
            f'{_ratio("sum(NEWUSERS)", "sum(TOTALUSERS)")} AS "% New Users", '
            f'{_ratio("sum(SESSIONS)", "sum(TOTALUSERS)")} AS "Sessions / User", '
            f'{_ratio("sum(SESSIONS) - sum(ENGAGEDSESSIONS)", "sum(SESSIONS)")} AS "Bounce Rate" FROM d',
}
_NUMBERS = f", k AS (SELECT * REPLACE ({_num0('KEYEVENTS')} AS KEYEVENTS), {_num0('USERENGAGEMENTDURATION')} AS DUR FROM g)\n"
_PRODUCT_TOTAL = """
SELECT CAST(coalesce(sum("View"), 0) AS BIGINT) AS "View", CAST(coalesce(sum("Gross Booked"), 0) AS BIGINT) AS "Gross Booked",
       round_even(""" + _ratio('sum("Gross Booked")', 'sum("View")') + """ * 100, 2) AS "Overall Conversion",
       CAST(coalesce(sum("Net Attendance"), 0) AS BIGINT) AS "Net Attendance",
       round_even(coalesce(CAST(sum(CAST("Net Value" AS DECIMAL(38, 4))) AS DOUBLE), 0), 2) AS "Net Value",
       CAST(coalesce(sum(Cancelled), 0) AS BIGINT) AS Cancelled,
       CAST(coalesce(sum("Gross Quantity"), 0) AS BIGINT) AS "Gross Quantity"
FROM c"""


def _by_tenant(kpis: str) -> str:
    return kpis.replace("SELECT ", "SELECT TENANT, ", 1).replace("FROM d", "FROM k GROUP BY TENANT")


def _job_sql() -> str:
    """The four written reports of the entitled tenants, from the reports' own SQL."""
    parts = [("book_date/summary", _att_sql(shared=True), "Item || '/' || Department", "Net Attendance", "Net Value", "TENANT IN ('aurora', 'borealis')"),
             ("guest_portal/funnel", _shared_funnel_sql(), "Step", "Events", "position", "TENANT = 'aurora'"),
             ("email_campaigns/summary", _email_summary_by_tenant_sql(), "Segment", "Emails Sent", "Delivered", "TRUE")]
    for t in ("aurora", "borealis"):
        own = _PRODUCT.replace("FROM report_items", f"FROM (SELECT * EXCLUDE (TENANT) FROM report_items_by_tenant WHERE TENANT = '{t}')")
        total = fixture_ctes(["report_items_by_tenant"]) + own + _PRODUCT_TOTAL.replace("SELECT ", f"SELECT '{t}' AS TENANT, ", 1)
        parts.append(("product_performance/total", total, "'Total'", "View", "Net Value", "TRUE"))
    return " UNION ALL ".join(f"""SELECT TENANT, '{r}' AS report, {label} AS label, CAST("{a}" AS DOUBLE) AS a, CAST("{b}" AS DOUBLE) AS b FROM ({sql}) WHERE {where}"""
                              for r, sql, label, a, b, where in parts)


def _registry_columns(table: str) -> str:
    return f"""SELECT lower(trim(CUSTOMER)) AS customer, coalesce(nullif(LABEL, ''), lower(trim(CUSTOMER))) AS label, upper(trim(PREFIX)) AS prefix,
       coalesce(array_to_string(from_json(PAGES, '["VARCHAR"]'), ','), '') AS pages,
       CASE WHEN json_valid(EMAIL_CONFIG) THEN json_extract_string(CASE WHEN json_valid(EMAIL_CONFIG) THEN EMAIL_CONFIG END, '$.subject_match') END AS subject_match
FROM {table} WHERE coalesce(ACTIVE, TRUE)"""


def report_sql() -> dict[str, str]:
    funnel_values = ", ".join(f"({i}, '{k}', '{lbl}')" for i, (k, lbl) in enumerate(FUNNEL_STEPS))
    search_pred = " OR ".join(
        f"regexp_matches(coalesce(CAST({c} AS VARCHAR), ''), '{SEARCH_PATTERN}', 'i')" for c in _MAIL_COLS
    )
    return {
        "book_date": _att_sql(),
        "book_date_total": _att_total_sql(),
        "event_date": _att_sql("TI_CALDATE", EVENT_RANGE, EVENT_PICKS),
        "event_date_total": _att_total_sql("TI_CALDATE", EVENT_RANGE, EVENT_PICKS),
        "attendance_status": _att_sql(None, None, STATUS_PICKS),
        "attendance_facets": fixture_ctes(["transactions_grouped"]) + _TX
        + _options_sql("t", att.FACETS, FACET_PICKS),
        "product_performance": fixture_ctes(["report_items"]) + _PRODUCT + "SELECT * FROM c",
        "product_total": fixture_ctes(["report_items"]) + _PRODUCT + _PRODUCT_TOTAL,
        "product_facets": fixture_ctes(["report_items"]) + _PRODUCT
        + _options_sql("c", prod.FACETS, PRODUCT_PICKS),
        "email_summary": _email_summary_sql(),
        "email_sections": _email_sections_sql(),
        "email_by_state": fixture_ctes(["mail_notifications"]) + _EMAIL
        + "SELECT DATA_STATE, count(*) AS Total FROM s WHERE DATA_STATE IS NOT NULL GROUP BY DATA_STATE",
        "email_open_frequency": fixture_ctes(["mail_notifications"]) + _EMAIL
        + "SELECT DATA_OPENS, count(*) AS Total FROM s GROUP BY DATA_OPENS",
        "guest_kpis": _ga4_sql(_KPIS["guest"]),
        "sessions_over_time": _ga4_sql(
            'SELECT DATE, CAST(sum(SESSIONS) AS BIGINT) AS "Sessions" FROM d WHERE DATE IS NOT NULL GROUP BY DATE'),
        "funnel": _ga4_sql(
            ", tot AS (SELECT EVENTNAME, sum(EVENTCOUNT) AS total FROM e WHERE EVENTNAME IS NOT NULL GROUP BY EVENTNAME),\n"
            f"steps AS (SELECT * FROM (VALUES {funnel_values}) v(position, EVENTNAME, Step))\n"
            'SELECT CAST(position AS INTEGER) AS position, Step, CAST(coalesce(total, 0) AS BIGINT) AS "Events" FROM steps LEFT JOIN tot USING (EVENTNAME)'
        ).replace("\n, tot AS", ", tot AS"),
        "top_items": _ga4_sql(
            f'SELECT "Rank", ITEMNAME AS "Item", v AS "Viewed", p AS "Purchased" FROM ({_item_sums(15)})'),
        "most_visited": _ga4_sql(
            f'SELECT "Rank", ITEMNAME AS "Experience", v AS "Views", p AS "Purchased", '
            f"printf('%.1f%%', round_even({_ratio('p', 'v')} * 100, 1)) AS \"Conversion\" FROM ({_item_sums(20)})"),
        "audience_kpis": _ga4_sql(_KPIS["audience"]),
        "users_over_time": _ga4_sql(
            'SELECT DATE, CAST(sum(TOTALUSERS) AS BIGINT) AS "Total Users", CAST(sum(NEWUSERS) AS BIGINT) AS "New Users" '
            "FROM d WHERE DATE IS NOT NULL GROUP BY DATE"),
        "devices": _ga4_sql(
            'SELECT DEVICECATEGORY, CAST(sum(SESSIONS) AS BIGINT) AS "Sessions" FROM dev '
            "WHERE DEVICECATEGORY IS NOT NULL GROUP BY DEVICECATEGORY"),
        "acquisition": _ga4_sql(
            'SELECT SESSIONSOURCE, CAST(sum(SESSIONS) AS BIGINT) AS "Sessions", '
            'CAST(row_number() OVER (ORDER BY sum(SESSIONS) DESC, SESSIONSOURCE) AS INTEGER) AS "Rank" FROM d WHERE SESSIONSOURCE IS NOT NULL '
            'GROUP BY SESSIONSOURCE ORDER BY "Sessions" DESC, SESSIONSOURCE LIMIT 10'),
        "top_locations": _ga4_sql(
            'SELECT CITY AS "City", COUNTRY AS "Country", CAST(sum(SESSIONS) AS BIGINT) AS "Sessions", '
            'CAST(row_number() OVER (ORDER BY sum(SESSIONS) DESC, CITY, COUNTRY) AS INTEGER) AS "Rank" FROM loc '
            "WHERE coalesce(CITY, '') <> 'Morelia' AND CITY IS NOT NULL AND COUNTRY IS NOT NULL "
            'GROUP BY CITY, COUNTRY ORDER BY "Sessions" DESC, CITY, COUNTRY LIMIT 20'),
        "ga4_long": _ga4_long_sql(),
        "search_rows": fixture_ctes(["mail_notifications"]) + f"SELECT * FROM mail_notifications WHERE {search_pred}",
        "resolve_tenants": fixture_ctes(["dashboard_users", "dashboard_customers"]) + _USERS
        + "SELECT email, name, customer, label, prefix, authorized FROM res",
        "entitled_pages": _entitled_sql(),
        "book_date_by_tenant": _att_sql(shared=True),
        "funnel_by_tenant": _shared_funnel_sql(),
        "email_summary_by_tenant": _email_summary_by_tenant_sql(),
        "top_items_by_tenant": _shared_top_sql("items", {"Item": "ITEMNAME"}, {"Viewed": "ITEMSVIEWED", "Purchased": "ITEMSPURCHASED"}, 15,
                                               "ITEMNAME IS NOT NULL"),
        "top_locations_by_tenant": _shared_top_sql("location", {"City": "CITY", "Country": "COUNTRY"}, {"Sessions": "SESSIONS"}, 20,
                                                   "coalesce(CITY, '') <> 'Morelia' AND CITY IS NOT NULL AND COUNTRY IS NOT NULL"),
        "devices_by_tenant": _shared_sql("device", 'SELECT TENANT, DEVICECATEGORY, CAST(sum(SESSIONS) AS BIGINT) AS "Sessions" FROM g '
                                         "WHERE DEVICECATEGORY IS NOT NULL GROUP BY ALL"),
        "sessions_by_tenant": _shared_sql("daily", 'SELECT TENANT, DATE, CAST(sum(SESSIONS) AS BIGINT) AS "Sessions" FROM g GROUP BY ALL'),
        "guest_kpis_by_tenant": _shared_sql("daily", _NUMBERS + _by_tenant(_KPIS["guest"])),
        "audience_kpis_by_tenant": _shared_sql("daily", _NUMBERS + _by_tenant(_KPIS["audience"])),
        "guest_kpis_range": _ga4_sql(_KPIS["guest"] + f" WHERE DATE BETWEEN DATE '{GA4_RANGE[0]}' AND DATE '{GA4_RANGE[1]}'"),
        "guest_kpis_timed": fixture_ctes(["ga4_daily_timed"]) + f""", d0 AS (SELECT * FROM ga4_daily_timed WHERE {_HOST_OK} AND {_SOURCE_OK}),
r AS (SELECT CAST(CAST(min(DATE) AS DATE) AS TIMESTAMP) AS lo, CAST(CAST(max(DATE) AS DATE) AS TIMESTAMP) AS hi FROM d0),
d AS (SELECT SESSIONS, ENGAGEDSESSIONS, {_num0('KEYEVENTS')} AS KEYEVENTS, {_num0('USERENGAGEMENTDURATION')} AS DUR FROM d0, r
      WHERE DATE BETWEEN lo AND hi)
""" + _KPIS["guest"],
        "funnel_range": _ga4_sql(
            f", tot AS (SELECT EVENTNAME, sum(EVENTCOUNT) AS total FROM ga4_events WHERE {_HOST_OK} AND {_SOURCE_OK} "
            f"AND DATE BETWEEN DATE '{GA4_RANGE[0]}' AND DATE '{GA4_RANGE[1]}' GROUP BY EVENTNAME),\n"
            f"steps AS (SELECT * FROM (VALUES {funnel_values}) v(position, EVENTNAME, Step))\n"
            'SELECT CAST(position AS INTEGER) AS position, Step, CAST(coalesce(total, 0) AS BIGINT) AS "Events" FROM steps LEFT JOIN tot USING (EVENTNAME)'
        ).replace("\n, tot AS", ", tot AS"),
        "email_summary_range": _email_summary_sql(MAIL_RANGE),
        "book_date_text_range": _att_sql("TRY_CAST(T_TRANSDATE AS TIMESTAMP)", EVENT_RANGE, table="transactions_text_dates"),
        "book_date_export": _att_sql().replace("SELECT Item, Department, sum(na)", ", a AS (SELECT Item, Department, sum(na)") + """)
SELECT *, FALSE AS is_total FROM a UNION ALL
SELECT NULL, NULL, round_even(sum("Net Attendance"), 2), round_even(CAST(sum(CAST("Net Value" AS DECIMAL(38, 4))) AS DOUBLE), 2), TRUE FROM a""",
        "product_export": fixture_ctes(["report_items"]) + _PRODUCT + ", g AS (" + _PRODUCT_TOTAL + """)
SELECT *, FALSE AS is_total FROM c UNION ALL BY NAME SELECT *, TRUE AS is_total FROM g""",
        "email_summary_bucketed": _email_summary_sql(),
        "product_total_bucketed": fixture_ctes(["report_items"]) + _PRODUCT + _PRODUCT_TOTAL,
        "book_date_partitioned": "SELECT * EXCLUDE (TENANT) FROM (" + _att_sql(shared=True) + ") WHERE TENANT = 'aurora'",
        "product_csv": fixture_ctes(["report_items"]) + _PRODUCT + """SELECT row_number() OVER (ORDER BY "View" DESC NULLS LAST,
  "Booked Year Month" NULLS FIRST, "Item Name" NULLS FIRST, Department NULLS FIRST, "Gross Booked" NULLS FIRST, Conversion NULLS FIRST, "Net Attendance" NULLS FIRST,
  "Net Value" NULLS FIRST, Cancelled NULLS FIRST, "Gross Quantity" NULLS FIRST) - 1 AS position, * FROM c""",
        "job_reports": _job_sql(),
        "registry_fallback": fixture_ctes(["dashboard_customers", "many_customers"]) + f""", own AS ({_registry_columns("dashboard_customers")}),
many AS ({_registry_columns("many_customers")})
SELECT 'table' AS "case", * FROM own UNION ALL SELECT 'table', * FROM many UNION ALL SELECT 'no active row', * FROM own UNION ALL SELECT 'missing', * FROM own""",
        "registry_rows": fixture_ctes(["many_customers"]) + """
SELECT lower(trim(CUSTOMER)) AS customer, coalesce(nullif(LABEL, ''), lower(trim(CUSTOMER))) AS label, upper(trim(PREFIX)) AS prefix,
       coalesce(array_to_string(from_json(PAGES, '["VARCHAR"]'), ','), '') AS pages,
       CASE WHEN json_valid(EMAIL_CONFIG) THEN json_extract_string(CASE WHEN json_valid(EMAIL_CONFIG) THEN EMAIL_CONFIG END, '$.subject_match') END AS subject_match,
       CASE WHEN json_valid(EMAIL_CONFIG) THEN CAST(json_array_length(CASE WHEN json_valid(EMAIL_CONFIG) THEN EMAIL_CONFIG END, '$.buckets') AS INTEGER) END AS n_buckets,
       json_extract_string(GA4_CONFIG, '$.report') AS ga4_report
FROM many_customers WHERE coalesce(ACTIVE, TRUE)""",
    }
