from pyspark.sql import functions as F

from innsight.config import EmailConfig, FUNNEL_STEPS
from innsight.operators.dedup import distinct_rows, keep_first, keep_last
from innsight.operators.measures import grand_total, group_sizes, keyed_sums, top_k, top_k_per_group, with_total_row
from innsight.plans import email as em
from innsight.plans import ga4


def test_keyed_sums_drop_null_keys(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), (None, 5)], "k string, v int")
    got = keyed_sums(df, ["k"], {"s": "v"}).collect()
    assert [(r.k, r.s) for r in got] == [("a", 3)]


def test_group_sizes_ordered_null_dropped(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,), ("b",)], "k string")
    assert [(r.k, r.Total) for r in group_sizes(df, "k").collect()] == [("a", 1), ("b", 2)]


def test_grand_total_equals_sum_of_detail(spark):
    df = spark.createDataFrame([("a", 1.005), ("b", 2.0), ("c", None)], "k string, v double")
    total = grand_total(df, ["v"]).first()
    assert total.v == round(1.005 + 2.0, 2)
    both = with_total_row(df, grand_total(df, ["v"]), [F.col("k")]).collect()
    assert len(both) == 4 and both[-1].k is None and [r.is_total for r in both] == [False] * 3 + [True]


def test_top_k_tie_break(spark):
    df = spark.createDataFrame([("b", 5), ("a", 5), ("c", 9), ("d", 1)], "k string, v int")
    got = top_k(df, [F.desc("v"), F.asc("k")], 3).collect()
    assert [(r.k, r.Rank) for r in got] == [("c", 1), ("a", 2), ("b", 3)]


def test_top_k_per_group_isolated(spark):
    rows = [("t1", "a", 3), ("t1", "b", 2), ("t1", "c", 1), ("t2", "z", 1)]
    df = spark.createDataFrame(rows, "g string, k string, v int")
    got = top_k_per_group(df, ["g"], [F.desc("v"), F.asc("k")], 2, rank_col="r").orderBy("g", "r").collect()
    assert [(r.g, r.k, r.r) for r in got] == [("t1", "a", 1), ("t1", "b", 2), ("t2", "z", 1)]
    # adding rows of another group leaves t1's ranking unchanged
    more = df.unionByName(spark.createDataFrame([("t3", "q", 99)], "g string, k string, v int"))
    again = top_k_per_group(more, ["g"], [F.desc("v"), F.asc("k")], 2, rank_col="r").filter("g = 't1'")
    assert sorted((r.k, r.r) for r in again.collect()) == [("a", 1), ("b", 2)]


def test_dedup(spark):
    df = spark.createDataFrame([(1, "x"), (1, "x"), (None, "y"), (None, "z")], "id int, v string")
    assert distinct_rows(df).count() == 3
    first = keep_first(df, ["id"]).orderBy("v").collect()
    assert [(r.id, r.v) for r in first] == [(1, "x"), (None, "y")]  # NULL ids collapse to one row
    assert keep_first(keep_first(df, ["id"]), ["id"]).count() == 2  # idempotent
    seq = spark.createDataFrame([("e", 1, "old"), ("e", 2, "new")], "k string, s int, n string")
    assert keep_last(seq, ["k"], "s").first().n == "new"


def _mail(spark):
    rows = [
        ("m1", "2024-01-01 10:00:00", "1", 1, 1, 2, 3, "sent", "days:15", "Hotel Aurora"),
        ("m1", "2024-01-01 10:00:00", "1", 1, 1, 2, 3, "sent", "days:15", "Hotel Aurora"),  # duplicate id
        ("m2", "2024-01-02 23:30:00", "bad", 1, 0, 0, None, "sent", None, "hotel aurora!"),
        ("m3", "2024-01-03 08:00:00", "0", 0, 0, 0, None, None, "days:0", "HOTEL AURORA"),
        ("m4", "2024-01-03 09:00:00", "1", 1, 0, 0, 1, "sent", "days:15", "Other hotel"),
    ]
    df = spark.createDataFrame(rows, "DATA_ID string, ts string, SENT string, OPEN int, CLICKS int, "
                                     "DATA_CLICKS int, DATA_OPENS int, DATA_STATE string, NOTIFICATION_TAG string, "
                                     "DATA_SUBJECT string")
    return df.withColumn("DATA_TS_DATE", F.col("ts").cast("timestamp_ntz")).drop("ts")


def test_email_segments_overlap_and_empty(spark):
    cfg = EmailConfig("t", subject_match="hotel aurora",
                      buckets=(("days:15", "15"), ("days:15", "again 15"), ("days:99", "empty")))
    scoped = em.email_scope(_mail(spark), cfg)
    rows = em.email_summary(scoped, cfg).collect()
    assert [r.Segment for r in rows] == ["15", "again 15", "empty", "Total"]
    s15, _, empty, total = rows
    assert (s15["Emails Sent"], s15.Delivered, s15.Opened, s15["Data Clicks"]) == (1, 1, 1, 2)
    assert (empty["Emails Sent"], empty["Delivery Rate"], empty.CTR) == (0, "0.00%", "0.00%")
    assert total["Emails Sent"] == 3 and total.Delivered == 1  # 'bad' counts 0, m4 out of scope
    assert total["Delivery Rate"] == f"{1 / 3:.2%}"
    assert total["Emails Sent"] >= max(r["Emails Sent"] for r in rows[:-1])
    freq = {r.DATA_OPENS: r.Total for r in em.email_open_frequency(scoped).collect()}
    assert freq == {0: 2, 3: 1}  # NULL opens count as 0


def test_email_range_includes_whole_last_day(spark):
    cfg = EmailConfig("t", subject_match="aurora")
    scoped = em.email_scope(_mail(spark), cfg, ("2024-01-01", "2024-01-02"))
    assert scoped.count() == 2  # includes the 23:30 message on the last day


def test_funnel_has_every_step_in_order(spark):
    df = spark.createDataFrame([("view_item", 4), ("purchase", 1), ("other", 9), (None, 3), ("view_item", 1)],
                               "EVENTNAME string, EVENTCOUNT bigint")
    got = ga4.funnel(df).collect()
    assert [r.Step for r in got] == [lbl for _, lbl in FUNNEL_STEPS]
    assert [r.position for r in got] == list(range(6))
    assert dict((r.Step, r.Events) for r in got)["Viewed Item"] == 5
    assert dict((r.Step, r.Events) for r in got)["Checkout"] == 0


def test_most_visited_zero_views_and_null_items(spark):
    items = spark.createDataFrame(
        [("A", 0, 3), ("B", 4, 1), (None, 9, 9), ("B", 4, 0)], "ITEMNAME string, ITEMSVIEWED bigint, ITEMSPURCHASED bigint"
    )
    got = [(r.Experience, r.Views, r.Purchased, r.Conversion) for r in ga4.most_visited(items).collect()]
    assert got == [("B", 8, 1, "12.5%"), ("A", 0, 3, "0.0%")]


def test_email_sections_use_untruncated_sums(spark):
    cfg = EmailConfig("t", subject_match="", buckets=(("x", "X"),))
    df = spark.createDataFrame(
        [("1", "0.5", 1, 1, 1, "x"), ("2", "0.5", 0, 0, 0, "x"), ("3", "1", 1, 0, 0, "y")],
        "DATA_ID string, SENT string, OPEN int, CLICKS int, DATA_CLICKS int, NOTIFICATION_TAG string",
    ).withColumn("DATA_TS_DATE", F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"))
    scoped = em.email_scope(df, cfg)
    x, total = em.email_sections(scoped, cfg).collect()
    assert (x.Section, x["Emails Delivered"], x["AVG Delivery Rate"]) == ("X", 1, 0.5)
    assert total.Section == "Total Emails" and total["AVG Open Rate"] == 2 / 2.0
    xs = em.email_summary(scoped, cfg).collect()[0]
    assert (xs.Delivered, xs["Delivery Rate"]) == (1, "50.00%")
