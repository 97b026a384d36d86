"""Tenants sharing tables: each report grouped by tenant equals the report of
that tenant alone (adding another tenant's rows changes nothing)."""

from pyspark.sql import functions as F

import __spark_entry__ as entry
from innsight.plans import attendance as att
from innsight.plans import ga4
from innsight.plans import product as prod
from innsight.plans.job import build_shared_marts
from report_fixtures import fixture


def _rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def _two_tenants(df, other_filter):
    a = df.withColumn("tenant", F.lit("aurora"))
    b = df.filter(other_filter).withColumn("tenant", F.lit("borealis"))
    return a.unionByName(b)


def test_attendance_and_product_by_tenant(spark, sf_dir):
    tx = fixture(spark, sf_dir, "transactions_grouped")
    shared = _two_tenants(tx, "TI_STATUS = 9")
    alone = att.attendance_summary(tx, att.BOOK_DATE)
    grouped = att.attendance_summary(shared, att.BOOK_DATE, by=["tenant"])
    assert _rows(grouped.filter("tenant = 'aurora'").drop("tenant")) == _rows(alone)
    tot = {r.tenant: r for r in att.attendance_total(shared, att.BOOK_DATE, by=["tenant"]).collect()}
    assert tot["aurora"]["Net Value"] == att.attendance_total(tx, att.BOOK_DATE).first()["Net Value"]
    items = fixture(spark, sf_dir, "report_items")
    shared_items = _two_tenants(items, "VIEWED % 2 = 0")
    ptot = prod.product_total(shared_items, by=["tenant"]).filter("tenant = 'aurora'").drop("tenant")
    assert _rows(ptot) == _rows(prod.product_total(items))


def test_ga4_by_tenant_uses_each_tenants_range(spark, sf_dir):
    daily = fixture(spark, sf_dir, "ga4_daily")
    items = fixture(spark, sf_dir, "ga4_items")
    # the other tenant only has the first days: its range is narrower
    d_shared = _two_tenants(daily, "DATE < DATE'2024-01-05'")
    i_shared = _two_tenants(items, "TRUE")
    f = ga4.page_frames(d_shared, {"ITEMS": i_shared}, by=["tenant"])
    single = ga4.page_frames(daily, {"ITEMS": items})
    got = ga4.top_items(f["ITEMS"], by=["tenant"])
    assert _rows(got.filter("tenant = 'aurora'").drop("tenant")) == _rows(ga4.top_items(single["ITEMS"]))
    other = ga4.page_frames(daily.filter("DATE < DATE'2024-01-05'"), {"ITEMS": items})
    assert _rows(got.filter("tenant = 'borealis'").drop("tenant")) == _rows(ga4.top_items(other["ITEMS"]))
    none = f["DAILY"].limit(0).select("DATE", "tenant").withColumn("EVENTNAME", F.lit("x")).withColumn("EVENTCOUNT", F.lit(1))
    fun = ga4.funnel(none, by=["tenant"], groups=f[ga4.GROUPS]).collect()
    assert [(r.tenant, r.position, r.Events) for r in fun] == [(t, i, 0) for t in ("aurora", "borealis") for i in range(6)]
    far = ga4.page_frames(d_shared, date_range=("1999-01-01", "1999-01-02"), by=["tenant"])
    kpis = ga4.guest_kpis(far["DAILY"], ["tenant"], far[ga4.GROUPS]).collect()
    assert sorted((r.tenant, r.Sessions, r["Conversion Rate"]) for r in kpis) == [("aurora", 0, 0.0), ("borealis", 0, 0.0)]
    k = ga4.guest_kpis(f["DAILY"], by=["tenant"]).filter("tenant = 'aurora'").drop("tenant")
    assert _rows(k) == _rows(ga4.guest_kpis(single["DAILY"]))


def test_build_shared_marts(spark, sf_dir, scratch):
    tables = {
        "REPORT_ITEMS": _two_tenants(fixture(spark, sf_dir, "report_items"), "VIEWED % 2 = 0"),
        "UVE_TRANSACTIONS_GROUPED": _two_tenants(fixture(spark, sf_dir, "transactions_grouped"), "TI_STATUS = 9"),
    }
    for g in ("daily", "events", "items", "device", "location"):
        tables[f"GA4_{g.upper()}"] = _two_tenants(fixture(spark, sf_dir, f"ga4_{g}"), "TRUE")
    emails = {"mail_notifications": fixture(spark, sf_dir, "mail_notifications")}
    out = f"{scratch}/shared"
    res = build_shared_marts(entry.registry(spark, sf_dir), tables, emails, out)
    ok = {(r.tenant, r.page, r.report) for r in res if r.status == "ok"}
    assert ("aurora", "guest_portal", "funnel") in ok and ("borealis", "book_date", "summary") in ok
    assert ("borealis", "guest_portal", "funnel") not in ok  # not entitled
    assert not [r for r in res if r.status == "failed"], res
    funnel = spark.read.parquet(f"{out}/guest_portal/funnel")
    assert funnel.select("tenant").distinct().collect()[0].tenant == "aurora" and funnel.count() == 6
    summ = spark.read.parquet(f"{out}/email_campaigns/summary")
    assert {r.tenant for r in summ.collect()} == {"aurora", "borealis"}


def test_email_all_tenants_in_one_pass(spark, sf_dir):
    from innsight.config import EmailConfig
    from innsight.plans import email as em

    cfgs = {
        "aurora": EmailConfig("m", subject_match="hotel aurora",
                              buckets=(("days:15", "15 days"), ("days:0", "0 days"), ("days:99", "99 days"))),
        "borealis": EmailConfig("m", subject_match="Hotel Borealis", buckets=(("days:30", "30 days"),)),
        "nobody": EmailConfig("m", subject_match="no such hotel", buckets=(("days:15", "15"),)),
    }
    mail = fixture(spark, sf_dir, "mail_notifications")
    base = em.email_base(mail, em.used_columns(list(cfgs.values())))
    scoped = em.scope_tenants(base, cfgs)
    summary = em.email_summary_by_tenant(scoped, cfgs)
    sections = em.email_sections_by_tenant(scoped, cfgs)
    states = em.email_by_state(scoped, by=["tenant"])
    assert summary.filter("tenant = 'nobody'").count() == 0  # no messages: nothing shown
    for t in ("aurora", "borealis"):
        alone = em.email_in_scope(base, cfgs[t])
        assert summary.filter(F.col("tenant") == t).drop("tenant").collect() == em.email_summary(alone, cfgs[t]).collect()
        assert sections.filter(F.col("tenant") == t).drop("tenant").collect() == em.email_sections(alone, cfgs[t]).collect()
        assert _rows(states.filter(F.col("tenant") == t).drop("tenant")) == _rows(em.email_by_state(alone))


def test_default_range_ends_at_midnight_of_the_last_day(spark):
    rows = [("2024-01-01 00:00:00", 1), ("2024-01-02 15:00:00", 2), ("2024-01-03 00:00:00", 4), ("2024-01-03 09:30:00", 8)]
    daily = spark.createDataFrame(rows, "d string, SESSIONS bigint").select(F.col("d").cast("timestamp_ntz").alias("DATE"), "SESSIONS")
    items = daily.select("DATE", F.lit("i").alias("ITEMNAME"), F.col("SESSIONS").alias("ITEMSVIEWED"), F.lit(0).alias("ITEMSPURCHASED"))
    one = ga4.page_frames(daily, {"ITEMS": items})
    shared = ga4.page_frames(daily.withColumn("tenant", F.lit("t")), {"ITEMS": items.withColumn("tenant", F.lit("t"))}, by=["tenant"])
    assert one["DAILY"].agg(F.sum("SESSIONS")).first()[0] == 7 == shared["DAILY"].agg(F.sum("SESSIONS")).first()[0]
    assert ga4.top_items(one["ITEMS"]).first().Viewed == 7 == ga4.top_items(shared["ITEMS"], by=["tenant"]).first().Viewed


def test_tenants_with_their_own_traffic_rules(spark):
    from innsight.config import TrafficRules

    df = spark.createDataFrame([("a", "x.booketing.com", "g"), ("a", "x.other.com", "g"), ("b", "x.booketing.com", "g"), ("b", "x.other.com", "uat")],
                               "tenant string, HOSTNAME string, SESSIONSOURCE string")
    clean = ga4.tenant_rules({"a": TrafficRules(), "b": TrafficRules(host_allow="other", source_exclude=())}, "tenant")
    assert sorted((r.tenant, r.HOSTNAME) for r in clean(df).collect()) == [("a", "x.booketing.com"), ("b", "x.other.com")]
