"""Landed tables: later runs need no exchange, tenants read their own partition, the shared job scans each source once."""

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from innsight.config import EmailConfig, Ga4Config, TenantConfig
from innsight.plans import attendance as att
from innsight.plans import email as em
from innsight.plans import product as prod
from innsight.plans.job import build_shared_marts, entitled_rows, entitlements
from innsight.sinks.export import read_ordered_csv, write_csv
from innsight.sources.registry import registry_frame
from innsight.sources.silver import land_messages, land_partitioned, land_report_items
from innsight.sources.tables import TableCatalog, scan_shared
from report_fixtures import fixture

from conftest import plan_text


def _name():
    return f"silver_{uuid.uuid4().hex}"


def _tree(df):
    return plan_text(df).split("\n\n")[0]


def test_messages_dedup_without_exchange(spark, sf_dir, scratch):
    raw = fixture(spark, sf_dir, "mail_notifications")
    raw = raw.unionByName(raw.limit(200).withColumn("DATA_ID", F.lit(None).cast("string")))  # a hot NULL id
    name = _name()
    for b in (0, 1, 1):
        land_messages(raw.filter(F.pmod(F.hash("DATA_OPENS"), F.lit(2)) == b), name, 8, f"{scratch}/mail")
    base = em.email_base(spark.table(name), em.used_columns([EmailConfig("m")]))
    tree = _tree(base)
    assert "Exchange" not in tree and "Window" in tree
    want = em.email_base(raw, em.used_columns([EmailConfig("m")]))
    assert sorted(map(repr, base.collect())) == sorted(map(repr, want.collect()))


def test_report_items_dedup_without_exchange(spark, sf_dir, scratch):
    raw = fixture(spark, sf_dir, "report_items")
    name = _name()
    for batch in ("VIEWED % 2 = 0", "VIEWED % 2 = 1 OR VIEWED % 5 = 0"):
        land_report_items(raw.filter(batch), name, 8, f"{scratch}/items")
    rows = prod.product_rows(spark.table(name))
    assert "Exchange" not in _tree(rows)
    assert sorted(map(repr, rows.collect())) == sorted(map(repr, prod.product_rows(raw).collect()))


def test_tenant_scan_prunes_partitions(spark, sf_dir, scratch):
    name = _name()
    land_partitioned(fixture(spark, sf_dir, "transactions_by_tenant"), name, "TENANT", f"{scratch}/tx")
    df = att.book_date(scan_shared(TableCatalog(spark), name, ["aurora"], "TENANT"))
    partition = plan_text(df).split("PartitionFilters:")[1].split("\n")[0]
    assert "TENANT" in partition and "aurora" in partition
    alone = att.book_date(fixture(spark, sf_dir, "transactions_by_tenant").filter("TENANT = 'aurora'"))
    assert sorted(map(tuple, df.collect())) == sorted(map(tuple, alone.collect()))


def _many(n, pages=("book_date",)):
    return [TenantConfig(f"t{i}", f"T{i}", f"T{i}", pages if i % 2 else ("retired_page",), ga4=Ga4Config("", "", "r")) for i in range(n)]


def test_entitled_rows_prune_partitions_at_run_time(spark, sf_dir, scratch):
    """5,000 tenants: the plan holds no list of them, and the scan a dynamic pruning filter."""
    entitlements(registry_frame(spark, _many(5000))).write.parquet(f"{scratch}/entitled")
    entitled = spark.read.parquet(f"{scratch}/entitled")
    assert entitled.count() == 2500
    raw = spark.range(6000).select(F.concat(F.lit("t"), F.col("id").cast("string")).alias("tenant"), F.col("id").alias("x"))
    raw.filter("x % 500 < 2").write.partitionBy("tenant").parquet(f"{scratch}/shared")
    df = entitled_rows(spark.read.parquet(f"{scratch}/shared"), entitled, "book_date")
    assert {r.x for r in df.collect()} == {x for x in range(5000) if x % 500 < 2 and x % 2}
    plan = plan_text(df)
    assert "dynamicpruning" in plan.split("PartitionFilters:")[1].split("\n")[0] and "t4999" not in plan and len(plan) < 20_000


def test_shared_job_scans_each_source_once(spark, sf_dir, scratch):
    """Rows are counted as they are read: each source row once a page; tenants without rows get empty reports."""
    seen = {n: spark.sparkContext.accumulator(0) for n in ("REPORT_ITEMS", "UVE_TRANSACTIONS_GROUPED")}
    tables, size = {}, {}
    for n, f in (("REPORT_ITEMS", "report_items"), ("UVE_TRANSACTIONS_GROUPED", "transactions_grouped")):
        raw = fixture(spark, sf_dir, f).limit(90).withColumn("tenant", F.element_at(F.array(F.lit("t1"), F.lit("t3"), F.lit("t5")), (F.pmod(F.monotonically_increasing_id(), F.lit(3)) + 1).cast("int")))
        raw.write.parquet(f"{scratch}/{f}")
        size[n] = spark.read.parquet(f"{scratch}/{f}").count()

        def counted(batches, acc=seen[n]):
            for b in batches:
                acc.add(len(b))
                yield b

        landed = spark.read.parquet(f"{scratch}/{f}")
        tables[n] = landed.mapInPandas(counted, landed.schema)
    small = registry_frame(spark, _many(12, ("product_performance", "book_date")))  # six entitled, three of them without rows
    results = build_shared_marts(small, tables, None, f"{scratch}/out")
    assert {r.status for r in results} == {"ok"} and len(results) == 6 * 6
    assert {n: a.value for n, a in seen.items()} == size
    assert spark.read.parquet(f"{scratch}/out/book_date/summary/tenant=t7").count() == 0
    assert spark.read.parquet(f"{scratch}/out/book_date/summary/tenant=t1").count() > 0


def test_observed_total_is_the_total(spark, sf_dir, scratch):
    raw = fixture(spark, sf_dir, "report_items")
    for rows in (raw, raw.limit(0)):
        detail, total = prod.observed_total(prod.product_performance(rows))
        detail.write.parquet(f"{scratch}/{uuid.uuid4().hex}")
        assert total().collect() == prod.product_total(rows).collect()
        assert total().schema.simpleString() == prod.product_total(rows).schema.simpleString()


def test_product_export_sorts_once(spark, sf_dir):
    tree = _tree(prod.product_export(fixture(spark, sf_dir, "report_items")))
    assert tree.count("Exchange rangepartitioning") <= 1 and tree.count("Sort ") <= 1


def test_large_csv_files_are_the_report_in_name_order(spark, sf_dir, scratch):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # several ranges
    try:
        detail = prod.product_performance(fixture(spark, sf_dir, "report_items"), ordered=False)
        write_csv(detail, f"{scratch}/csv", order=prod.report_order(), rows_per_file=100)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    read = read_ordered_csv(spark, f"{scratch}/csv", detail.schema)
    want = [tuple(r) for r in detail.orderBy(*prod.report_order()).collect()]
    assert [tuple(r)[1:] for r in read.orderBy("position").collect()] == want
    assert [r.position for r in read.orderBy("position").collect()] == list(range(len(want)))


def test_ordered_csv_of_odd_fields(spark, scratch):
    rows = [(1, 'say "hi", you', None), (2, "a,b", 0.5), (3, "plain", 1e20)]
    df = spark.createDataFrame(rows, T.StructType([T.StructField("n", T.LongType()), T.StructField("a text", T.StringType()), T.StructField("x", T.DoubleType())]))
    write_csv(df, f"{scratch}/odd", order=[F.desc("n")])
    assert [tuple(r) for r in read_ordered_csv(spark, f"{scratch}/odd", df.schema).orderBy("position").collect()] == [(i, *r) for i, r in enumerate(reversed(rows))]


def test_facet_rows_fall_to_combinations(spark, sf_dir, scratch):
    """The entries of the option lists are made after the first distinct, not per source row."""
    fixture(spark, sf_dir, "transactions_grouped").write.parquet(f"{scratch}/tx")
    tree = _tree(att.attendance_options(spark.read.parquet(f"{scratch}/tx"), att.BOOK_DATE, None, {"Source": ["1-URGENT"]}))
    lines = tree.splitlines()
    generate = next(i for i, line in enumerate(lines) if "Generate" in line)
    assert sum("HashAggregate" in line for line in lines[generate:]) == 2  # combinations first (partial, final)
