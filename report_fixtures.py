"""Test fixtures: the application's source tables, derived from the driver's data.

The application has no sample data, so each of its sources is derived by SQL
from the TPC-H-like tables under ``/root/testdata`` (see ``FIXTURES.md``).
The same text runs in Spark (tables passed as DataFrames to ``spark.sql``)
and in DuckDB (plain table names), which is what the oracle queries use.
Work grows with the input tables: every fixture reads them whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

BASE_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

# name -> (SQL text with {table} placeholders, tables it reads)
FIXTURES: dict[str, tuple[str, tuple[str, ...]]] = {
    "report_items": ("""
WITH g AS (
  SELECT year(l_shipdate) * 100 + month(l_shipdate) AS bm, p_name, p_type,
         count(*) AS n, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS q,
         CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS cents,
         CAST(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS BIGINT) AS r
  FROM {lineitem} JOIN {part} ON l_partkey = p_partkey
  GROUP BY year(l_shipdate) * 100 + month(l_shipdate), p_name, p_type),
b AS (
  SELECT bm AS BOOKED_MONTH,
         CASE WHEN n % 11 = 0 THEN NULL ELSE p_name END AS ITEM_NAME,
         CASE WHEN n % 9 = 0 THEN NULL ELSE p_type END AS PRODUCT_CATEGORY,
         q AS VIEWED, n AS TRANSACTIONS, n + r AS ITEMSPURCHASED,
         CAST(n AS DOUBLE) / CAST(q AS DOUBLE) * 100 AS CONVERSION,
         q - r AS ATTENDANCE,
         CASE WHEN n % 5 = 0 THEN NULL WHEN n % 4 = 0 THEN CAST(0 AS DOUBLE)
              ELSE CAST(cents AS DOUBLE) / 100 END AS VALUE,
         CASE WHEN n % 5 = 0 AND q % 3 = 0 THEN CAST('NaN' AS DOUBLE) ELSE CAST(n AS DOUBLE) * 10 END AS VALUE_ADDED, r AS CANCELLED
  FROM g)
SELECT * FROM b UNION ALL SELECT * FROM b WHERE VIEWED % 5 = 0
""", ("lineitem", "part")),
    "transactions_grouped": ("""
SELECT CASE WHEN l_partkey % 29 = 0 THEN NULL ELSE p_name END AS TI_ITEMNAME,
       CASE WHEN l_partkey % 31 = 0 THEN NULL ELSE p_type END AS PRODUCT_CATEGORY,
       CASE WHEN l_partkey % 19 = 0 THEN 'n/a' WHEN l_partkey % 23 = 0 THEN NULL
            ELSE CAST(CAST(l_quantity AS INT) AS STRING) END AS TB_GUESTS,
       CASE WHEN l_linenumber = 3 THEN CAST(0 AS DOUBLE) WHEN l_linenumber = 5 THEN NULL
            ELSE l_extendedprice END AS TB_SUBTOTALAGREE,
       CAST(round(l_tax * 100) AS INT) AS ADDED_PRICE,
       CASE WHEN l_suppkey % 7 = 0 THEN NULL ELSE o_orderpriority END AS SOURCE,
       c_mktsegment AS NETWORK, n_name AS VP_VENUENAME,
       CASE o_orderstatus WHEN 'O' THEN 'reserved' WHEN 'F' THEN 'used' ELSE NULL END AS P_CURRENTSTATUS,
       CASE WHEN l_returnflag = 'R' THEN 9 WHEN l_returnflag = 'A' THEN 1 ELSE NULL END AS TI_STATUS,
       CASE WHEN l_linenumber = 1 AND o_orderpriority LIKE '1%' THEN 'refund'
            WHEN l_linenumber = 2 THEN NULL ELSE 'charge' END AS TB_ACTION,
       o_orderdate AS T_TRANSDATE, l_shipdate AS TI_CALDATE
FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN {part} ON l_partkey = p_partkey
JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey
""", ("lineitem", "orders", "part", "customer", "nation")),
    "mail_notifications": ("""
WITH e AS (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k FROM {events}),
b AS (
  SELECT 'm' || CAST(event_id AS STRING) AS DATA_ID, ts AS DATA_TS_DATE,
         CASE WHEN event_type = 'error' THEN '0' WHEN k = 7 THEN 'bad' ELSE '1' END AS SENT,
         CASE WHEN event_type IN ('view', 'click', 'purchase') THEN 1 ELSE 0 END AS OPEN,
         CASE WHEN event_type IN ('click', 'purchase') THEN 1 ELSE 0 END AS CLICKS,
         CASE WHEN event_type IN ('click', 'purchase') THEN k % 4 + 1 ELSE 0 END AS DATA_CLICKS,
         CASE WHEN event_type IN ('view', 'click', 'purchase') THEN k % 6 ELSE NULL END AS DATA_OPENS,
         CASE event_type WHEN 'error' THEN 'bounced' WHEN 'signup' THEN NULL ELSE 'sent' END AS DATA_STATE,
         CASE k % 5 WHEN 0 THEN 'days:15' WHEN 1 THEN 'days:0' WHEN 2 THEN 'days:30' WHEN 3 THEN '' ELSE NULL END AS NOTIFICATION_TAG,
         CASE user_id % 4 WHEN 0 THEN 'Your stay at HOTEL AURORA' WHEN 1 THEN 'hotel aurora - reminder'
              WHEN 2 THEN 'Hotel Borealis' ELSE NULL END AS DATA_SUBJECT
  FROM e)
SELECT * FROM b UNION ALL SELECT * FROM b WHERE DATA_ID LIKE '%3'
""", ("events",)),
    "ga4_base": ("""
SELECT CAST(ts AS DATE) AS DATE, user_id, event_type, CAST(floor(value) AS BIGINT) AS v,
       CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k,
       CASE user_id % 8 WHEN 0 THEN 'google' WHEN 1 THEN '(direct)' WHEN 2 THEN 'newsletter'
            WHEN 3 THEN 'TagAssistant.google.com' WHEN 4 THEN 'evaluation-partner'
            WHEN 5 THEN 'officeXnet' WHEN 6 THEN NULL ELSE 'facebook' END AS SESSIONSOURCE,
       CASE CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) % 9 WHEN 0 THEN 'staging.example.com'
            WHEN 1 THEN NULL WHEN 2 THEN 'WWW.Booketing.COM' ELSE 'aurora.booketing.com' END AS HOSTNAME
FROM {events}
""", ("events",)),
    "ga4_daily": ("""
SELECT DATE, SESSIONSOURCE, HOSTNAME, count(*) AS SESSIONS,
       count(DISTINCT user_id) AS ACTIVEUSERS, count(DISTINCT user_id) AS TOTALUSERS,
       CAST(sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) AS BIGINT) AS NEWUSERS,
       CAST(sum(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END) AS BIGINT) AS SCREENPAGEVIEWS,
       CAST(sum(CASE WHEN event_type IN ('click', 'purchase') THEN 1 ELSE 0 END) AS BIGINT) AS ENGAGEDSESSIONS,
       CAST(sum(v) AS STRING) AS USERENGAGEMENTDURATION,
       CAST(sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS STRING) AS KEYEVENTS
FROM {ga4_base} GROUP BY DATE, SESSIONSOURCE, HOSTNAME
""", ("ga4_base",)),
    "ga4_events": ("""
WITH b AS (SELECT *, CASE event_type WHEN 'signup' THEN 'guest_portal_loaded' WHEN 'view' THEN 'view_item'
                WHEN 'click' THEN CASE WHEN k < 30 THEN 'add_to_cart' ELSE 'select_item' END
                WHEN 'purchase' THEN 'purchase' ELSE NULL END AS EVENTNAME FROM {ga4_base})
SELECT DATE, EVENTNAME, SESSIONSOURCE, HOSTNAME, count(DISTINCT user_id) AS SESSIONS,
       count(*) AS EVENTCOUNT, '0' AS KEYEVENTS
FROM b GROUP BY DATE, EVENTNAME, SESSIONSOURCE, HOSTNAME
""", ("ga4_base",)),
    "ga4_items": ("""
WITH b AS (SELECT *, CASE WHEN k = 99 THEN NULL ELSE 'Experience ' || CAST(k AS STRING) END AS ITEMNAME FROM {ga4_base})
SELECT DATE, ITEMNAME,
       CAST(sum(CASE WHEN event_type = 'view' AND k <> 5 THEN 1 ELSE 0 END) AS BIGINT) AS ITEMSVIEWED,
       CAST(sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS BIGINT) AS ITEMSPURCHASED
FROM b GROUP BY DATE, ITEMNAME
""", ("ga4_base",)),
    "ga4_device": ("""
WITH b AS (SELECT *, CASE user_id % 3 WHEN 0 THEN 'mobile' WHEN 1 THEN 'desktop' ELSE 'tablet' END AS DEVICECATEGORY FROM {ga4_base})
SELECT DATE, DEVICECATEGORY, HOSTNAME, count(*) AS SESSIONS FROM b GROUP BY DATE, DEVICECATEGORY, HOSTNAME
""", ("ga4_base",)),
    "ga4_location": ("""
WITH b AS (SELECT g.*, CASE WHEN user_id % 25 = 4 THEN 'Morelia' WHEN user_id % 25 = 9 THEN NULL
                ELSE 'City ' || CAST(user_id % 50 AS STRING) END AS CITY, n_name AS COUNTRY, r_name AS REGION
           FROM {ga4_base} g JOIN {nation} ON n_nationkey = user_id % 25 JOIN {region} ON n_regionkey = r_regionkey)
SELECT DATE, CITY, COUNTRY, REGION, SESSIONSOURCE, HOSTNAME, count(*) AS SESSIONS,
       CAST(sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS STRING) AS KEYEVENTS
FROM b GROUP BY DATE, CITY, COUNTRY, REGION, SESSIONSOURCE, HOSTNAME
""", ("ga4_base", "nation", "region")),
    "ga4_slides": ("""
SELECT DATE, event_type AS EVENTNAME, '' AS LINKURL, '' AS LINKTEXT, count(*) AS EVENTCOUNT
FROM {ga4_base} GROUP BY DATE, event_type
""", ("ga4_base",)),
    # GA4 items of every tenant in one table (tenant as a leading column); one
    # tenant holds half of the rows, to exercise skew in per-tenant rankings.
    "ga4_items_by_tenant": ("""
WITH b AS (SELECT *, CASE WHEN user_id % 2 = 0 THEN 'aurora' WHEN user_id % 4 = 1 THEN 'borealis' ELSE 'closed' END AS TENANT,
                  CASE WHEN k = 99 THEN NULL ELSE 'Experience ' || CAST(k AS STRING) END AS ITEMNAME FROM {ga4_base})
SELECT TENANT, DATE, ITEMNAME,
       CAST(sum(CASE WHEN event_type = 'view' AND k <> 5 THEN 1 ELSE 0 END) AS BIGINT) AS ITEMSVIEWED,
       CAST(sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS BIGINT) AS ITEMSPURCHASED
FROM b GROUP BY TENANT, DATE, ITEMNAME
""", ("ga4_base",)),
    "dashboard_users": ("""
SELECT CASE WHEN c_custkey % 2 = 0 THEN ' User' ELSE 'user' END
         || CAST(c_custkey - c_custkey % 2 * CASE WHEN c_custkey % 10 = 1 THEN 1 ELSE 0 END AS STRING) || '@Example.com ' AS EMAIL,
       c_name AS NAME, CASE c_nationkey % 4 WHEN 0 THEN 'Aurora ' WHEN 1 THEN 'borealis' WHEN 2 THEN 'ghost' ELSE 'AURORA' END AS CUSTOMER,
       CASE WHEN c_custkey % 7 = 0 THEN FALSE WHEN c_custkey % 7 = 1 THEN NULL ELSE TRUE END AS ACTIVE,
       c_custkey AS CREATED_AT
FROM {customer}
""", ("customer",)),
    # The registry is configuration (three properties), not derived data.
    "dashboard_customers": ("""
SELECT * FROM (VALUES
 ('aurora', 'Hotel Aurora', 'aurora', '["product_performance","book_date","event_date","email_campaigns","guest_portal","audience","retired_page"]',
  '{"table":"mail_notifications","tag_field":"NOTIFICATION_TAG","subject_field":"DATA_SUBJECT","subject_match":"hotel aurora","buckets":[["days:15","15 days"],["days:0","0 days"],["days:99","99 days"]]}',
  '{"database":"ga","schema":"dest","report":"AURORA"}', TRUE),
 ('borealis', 'Hotel Borealis', 'BOREALIS', '["product_performance","book_date","event_date","email_campaigns"]',
  '{"table":"mail_notifications","tag_field":"NOTIFICATION_TAG","subject_field":"DATA_SUBJECT","subject_match":"Hotel Borealis","buckets":[["days:30","30 days"]]}',
  NULL, CAST(NULL AS BOOLEAN)),
 ('closed', NULL, 'CLOSED', '[]', '{}', NULL, FALSE))
 AS t(CUSTOMER, LABEL, PREFIX, PAGES, EMAIL_CONFIG, GA4_CONFIG, ACTIVE)
""", ()),
}


# Tenants sharing one table per source: the same sources with a leading
# TENANT column; one tenant holds half of the rows (skew).
_TENANT_OF_CUSTOMER = "CASE WHEN c_custkey % 2 = 0 THEN 'aurora' WHEN c_custkey % 4 = 1 THEN 'borealis' ELSE 'closed' END"
_TENANT_OF_USER = "CASE WHEN user_id % 2 = 0 THEN 'aurora' WHEN user_id % 4 = 1 THEN 'borealis' ELSE 'closed' END"
FIXTURES["report_items_by_tenant"] = ("""
SELECT 'aurora' AS TENANT, * FROM {report_items} UNION ALL SELECT 'borealis', * FROM {report_items} WHERE VIEWED % 2 = 0
""", ("report_items",))
FIXTURES["transactions_by_tenant"] = (
    FIXTURES["transactions_grouped"][0].replace(
        "SELECT CASE WHEN l_partkey % 29", f"SELECT {_TENANT_OF_CUSTOMER} AS TENANT,\n       CASE WHEN l_partkey % 29", 1),
    FIXTURES["transactions_grouped"][1],
)
FIXTURES["ga4_daily_by_tenant"] = ("""
WITH b AS (SELECT *, """ + _TENANT_OF_USER + """ AS TENANT FROM {ga4_base})
SELECT TENANT, DATE, SESSIONSOURCE, HOSTNAME, count(*) AS SESSIONS,
       count(DISTINCT user_id) AS ACTIVEUSERS, count(DISTINCT user_id) AS TOTALUSERS,
       CAST(sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) AS BIGINT) AS NEWUSERS,
       CAST(sum(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END) AS BIGINT) AS SCREENPAGEVIEWS,
       CAST(sum(CASE WHEN event_type IN ('click', 'purchase') THEN 1 ELSE 0 END) AS BIGINT) AS ENGAGEDSESSIONS,
       CAST(sum(v) AS STRING) AS USERENGAGEMENTDURATION,
       CAST(sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS STRING) AS KEYEVENTS
FROM b GROUP BY TENANT, DATE, SESSIONSOURCE, HOSTNAME
""", ("ga4_base",))
FIXTURES["ga4_events_by_tenant"] = ("""
WITH b AS (SELECT *, """ + _TENANT_OF_USER + """ AS TENANT,
                  CASE WHEN user_id % 4 = 3 THEN 'scroll' WHEN event_type = 'signup' THEN 'guest_portal_loaded'
                  WHEN event_type = 'view' THEN 'view_item' WHEN event_type = 'purchase' THEN 'purchase'
                  WHEN event_type = 'click' THEN CASE WHEN k < 30 THEN 'add_to_cart' ELSE 'select_item' END ELSE NULL END AS EVENTNAME
           FROM {ga4_base})
SELECT TENANT, DATE, EVENTNAME, SESSIONSOURCE, HOSTNAME, count(DISTINCT user_id) AS SESSIONS,
       count(*) AS EVENTCOUNT, '0' AS KEYEVENTS
FROM b GROUP BY TENANT, DATE, EVENTNAME, SESSIONSOURCE, HOSTNAME
""", ("ga4_base",))

FIXTURES["ga4_device_by_tenant"] = ("""
WITH b AS (SELECT *, """ + _TENANT_OF_USER + """ AS TENANT,
                  CASE user_id % 3 WHEN 0 THEN 'mobile' WHEN 1 THEN 'desktop' ELSE 'tablet' END AS DEVICECATEGORY FROM {ga4_base})
SELECT TENANT, DATE, DEVICECATEGORY, HOSTNAME, count(*) AS SESSIONS FROM b GROUP BY TENANT, DATE, DEVICECATEGORY, HOSTNAME
""", ("ga4_base",))
FIXTURES["ga4_location_by_tenant"] = ("""
WITH b AS (SELECT g.*, """ + _TENANT_OF_USER + """ AS TENANT, CASE WHEN user_id % 25 = 4 THEN 'Morelia' WHEN user_id % 25 = 9 THEN NULL
                ELSE 'City ' || CAST(user_id % 50 AS STRING) END AS CITY, n_name AS COUNTRY
           FROM {ga4_base} g JOIN {nation} ON n_nationkey = user_id % 25)
SELECT TENANT, DATE, CITY, COUNTRY, SESSIONSOURCE, HOSTNAME, count(*) AS SESSIONS
FROM b GROUP BY TENANT, DATE, CITY, COUNTRY, SESSIONSOURCE, HOSTNAME
""", ("ga4_base", "nation"))
# DAILY with a time of day in DATE, as a connector may deliver it.
FIXTURES["ga4_daily_timed"] = (
    FIXTURES["ga4_daily"][0].replace("SELECT DATE,", "SELECT HOUR AS DATE,").replace("GROUP BY DATE,", "GROUP BY HOUR,").replace("{ga4_base}", "{ga4_timed}"),
    ("ga4_timed",),
)
FIXTURES["ga4_timed"] = (
    FIXTURES["ga4_base"][0].replace("SELECT CAST(ts AS DATE) AS DATE,", "SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS HOUR,"),
    ("events",),
)
# Transactions whose booking date is text, some of it unreadable.
FIXTURES["transactions_text_dates"] = (
    FIXTURES["transactions_grouped"][0].replace(
        "o_orderdate AS T_TRANSDATE", "CASE WHEN l_linenumber = 4 THEN 'soon' ELSE substr(CAST(o_orderdate AS STRING), 1, 10) END AS T_TRANSDATE"),
    FIXTURES["transactions_grouped"][1],
)
# A registry as large as the customer table, its configuration as JSON text.
FIXTURES["many_customers"] = ("""
SELECT ' Hotel' || CAST(c_custkey AS STRING) || ' ' AS CUSTOMER, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_name END AS LABEL,
       ' h' || CAST(c_custkey AS STRING) AS PREFIX,
       CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE '["book_date","audience"]' END AS PAGES,
       CASE WHEN c_custkey % 4 = 0 THEN '{{broken' ELSE '{{"table":"mail","subject_match":"' || c_mktsegment || '","buckets":[["a","A"]]}}' END AS EMAIL_CONFIG,
       CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE '{{"database":"d","schema":"s","report":"R' || CAST(c_custkey AS STRING) || '"}}' END AS GA4_CONFIG,
       CASE WHEN c_custkey % 11 = 0 THEN FALSE WHEN c_custkey % 11 = 1 THEN NULL ELSE TRUE END AS ACTIVE
FROM {customer}
""", ("customer",))


def read_base(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's Parquet tables."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Spark DataFrame of fixture ``name`` over the tables in ``sf_dir``."""
    text, deps = FIXTURES[name]
    if not deps:
        return spark.sql(text)
    frames = {d: read_base(spark, sf_dir, d) if d in BASE_TABLES else fixture(spark, sf_dir, d) for d in deps}
    return spark.sql(text, **frames)


def _closure(names: list[str]) -> list[str]:
    """``names`` plus the fixtures they read, dependencies first."""
    out: list[str] = []

    def visit(n: str) -> None:
        if n in out or n in BASE_TABLES:
            return
        for d in FIXTURES[n][1]:
            visit(d)
        out.append(n)

    for n in names:
        visit(n)
    return out


def fixture_ctes(names: list[str]) -> str:
    """``WITH`` clause defining ``names`` (and what they read) over plain table names,
    for DuckDB oracle queries."""
    parts = []
    for n in _closure(names):
        text, deps = FIXTURES[n]
        body = text.format(**{d: d for d in deps}) if deps else text
        parts.append(f"{n} AS ({body.strip()})")
    return "WITH " + ",\n".join(parts) + "\n"
