"""Physical-plan checks: the plan shapes the library relies on at scale."""

from pyspark.sql import functions as F

from innsight.config import EmailConfig
from innsight.plans import attendance as att
from innsight.plans import email as em
from innsight.plans import ga4
from innsight.plans.tenants import resolve_tenants
from report_fixtures import fixture
from innsight.sources.registry import load_registry, load_users

from conftest import plan_text


def _landed(spark, sf_dir, scratch, name):
    path = f"{scratch}/{name}"
    fixture(spark, sf_dir, name).write.parquet(path)
    return spark.read.parquet(path)


def test_facet_and_range_reach_the_scan(spark, sf_dir, scratch):
    tx = _landed(spark, sf_dir, scratch, "transactions_grouped")
    df = att.event_date(tx, ("1995-01-01", "1996-12-31"), {"Booking Status": ["reserved", "Unknown"]})
    plan = plan_text(df)
    assert "Or(In(P_CURRENTSTATUS, [Unknown,reserved]),IsNull(P_CURRENTSTATUS))" in plan
    assert "GreaterThanOrEqual(TI_CALDATE" in plan and "LessThanOrEqual(TI_CALDATE" in plan
    # column pruning: columns the report does not use are not read
    assert "VP_VENUENAME" not in plan.split("ReadSchema:")[1].split("\n")[0]


def test_keyed_dedup_limits_before_shuffle(spark, sf_dir, scratch):
    mail = _landed(spark, sf_dir, scratch, "mail_notifications")
    cfg = EmailConfig("m", subject_match="aurora", buckets=(("days:15", "15"),))
    plan = plan_text(em.email_summary(em.email_scope(mail, cfg), cfg))
    assert "WindowGroupLimit" in plan and "Partial" in plan
    # the subject filter must stay above the dedup (it changes which ids survive)
    tree = plan.split("\n\n")[0]
    assert tree.index("Filter") < tree.index("WindowGroupLimit")


def test_per_tenant_top_k_is_partial(spark, sf_dir):
    df = ga4.top_items(fixture(spark, sf_dir, "ga4_items_by_tenant"), by=["TENANT"])
    plan = plan_text(df)
    assert plan.count("WindowGroupLimit") >= 2 and "Partial" in plan


def test_top_k_is_take_ordered(spark, sf_dir):
    items = ga4.ga4_grain(fixture(spark, sf_dir, "ga4_items"))
    assert "TakeOrderedAndProject" in plan_text(ga4.top_items(items))


def test_funnel_is_one_conditional_aggregate(spark, sf_dir, scratch):
    ev = _landed(spark, sf_dir, scratch, "ga4_events")
    plan = plan_text(ga4.funnel(ga4.ga4_clean(ev)))
    tree = plan.split("\n\n")[0]
    assert "Join" not in tree and tree.count("HashAggregate") == 2  # partial + final, no join
    assert "In(EVENTNAME, [" in plan  # step names pushed into the scan


def test_long_view_prunes_branches(spark, sf_dir, scratch):
    grains = {g: _landed(spark, sf_dir, scratch, f"ga4_{g}") for g in ("items", "daily", "device")}
    df = ga4.ga4_long(grains).filter(F.col("REPORT") == "device")
    plan = plan_text(df)
    assert "ga4_device" in plan and "ga4_items" not in plan and "ga4_daily" not in plan


def test_tenant_resolution_broadcasts_small_registry(spark, sf_dir):
    users = load_users(fixture(spark, sf_dir, "dashboard_users"))
    reg = load_registry(fixture(spark, sf_dir, "dashboard_customers"))
    df = resolve_tenants(users, reg)
    df.collect()
    assert "BroadcastHashJoin" in plan_text(df)  # chosen by size, without a hint


def test_daily_is_cleaned_and_pruned_before_it_is_kept(spark, sf_dir, scratch):
    daily = _landed(spark, sf_dir, scratch, "ga4_daily").withColumn("BODY", F.lit("x"))
    kept = []
    ga4.page_frames(daily, keep=lambda df: kept.append(df) or df)
    assert len(kept) == 1 and not {"BODY", "HOSTNAME"} & set(kept[0].columns)
    assert "rlike" in plan_text(kept[0]).lower()  # traffic filters come before


def test_many_tenants_scope_messages_by_distinct_subjects(spark, sf_dir, scratch):
    mail = _landed(spark, sf_dir, scratch, "mail_notifications")
    cfgs = {f"t{i}": EmailConfig("m", subject_match=f"hotel {i}x", buckets=(("days:15", "15"),)) for i in range(1998)}
    cfgs |= {"aurora": EmailConfig("m", subject_match="hotel aurora", buckets=(("days:15", "15"),)),
             "borealis": EmailConfig("m", subject_match="Hotel (Borealis|None)", buckets=(("days:30", "30"),))}
    base = em.email_base(mail, em.used_columns(list(cfgs.values())))
    scoped = em.scope_tenants(base, cfgs)
    assert len(plan_text(scoped)) < 100_000
    summary = em.email_summary_by_tenant(scoped, cfgs).cache()
    assert {r.tenant for r in summary.collect()} == {"aurora", "borealis"}
    for t in ("aurora", "borealis"):
        alone = em.email_summary(em.email_in_scope(base, cfgs[t]), cfgs[t]).collect()
        assert summary.filter(F.col("tenant") == t).drop("tenant").orderBy("position").collect() == alone


def test_detail_and_total_one_scan(spark, sf_dir, scratch):
    tx = _landed(spark, sf_dir, scratch, "transactions_grouped")
    plan = plan_text(att.attendance_options(tx, att.BOOK_DATE, None, {"Source": ["1-URGENT"]}))
    assert plan.split("\n\n")[0].count("Scan parquet") == 1


def test_email_dedup_reads_only_used_columns(spark, sf_dir, scratch):
    path = f"{scratch}/mail_wide"
    fixture(spark, sf_dir, "mail_notifications").withColumn("BODY", F.lit("x" * 100)).write.parquet(path)
    cfg = EmailConfig("m", subject_match="aurora", buckets=(("days:15", "15"),))
    plan = plan_text(em.email_summary(em.email_scope(spark.read.parquet(path), cfg), cfg))
    read_schema = plan.split("ReadSchema:")[1].split("\n")[0]
    assert "BODY" not in read_schema and "DATA_ID" in read_schema


def test_detail_and_total_share_one_shuffle(spark, sf_dir, scratch):
    tx = _landed(spark, sf_dir, scratch, "transactions_grouped")
    df = att.attendance_export(tx, att.BOOK_DATE)
    df.collect()  # the adaptive plan is final once this DataFrame has run
    plan = plan_text(df)
    assert "isFinalPlan=true" in plan and "ReusedExchange" in plan  # the total reads the detail's shuffle
