import datetime as dt


from innsight.config import SOURCE_EXCLUDE, TrafficRules
from innsight.operators.filters import (
    active_only, closed_range, date_bounds, facet_filter, facet_options, half_open_range,
    search_rows, subject_scope, traffic_filter,
)


def _ts(spark, values):
    return spark.createDataFrame([(v,) for v in values], "t timestamp_ntz")


def test_closed_vs_half_open_range(spark):
    last_day_late = dt.datetime(2024, 1, 31, 23, 30)
    df = _ts(spark, [dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 31), last_day_late, None])
    closed = closed_range(df, "t", "2024-01-01", "2024-01-31").collect()
    half = half_open_range(df, "t", "2024-01-01", "2024-01-31").collect()
    assert len(closed) == 2 and last_day_late not in [r.t for r in closed]
    assert len(half) == 3 and last_day_late in [r.t for r in half]
    # no range: nothing dropped, not even NULL dates
    assert closed_range(df, "t", None, "2024-01-31").count() == 4


def test_date_bounds(spark):
    df = _ts(spark, [dt.datetime(2024, 1, 3, 8), dt.datetime(2024, 1, 9, 23), None])
    assert date_bounds(df, "t") == (dt.date(2024, 1, 3), dt.date(2024, 1, 9))
    assert date_bounds(df.filter("false"), "t") is None


def test_facet_filter_unknown_matches_null(spark):
    df = spark.createDataFrame([("a",), (None,), ("b",), ("Unknown",)], "c string")
    got = facet_filter(df, {"c": ["a", "Unknown"]}, {"c": "Unknown"}).collect()
    assert sorted(r.c or "<null>" for r in got) == ["<null>", "Unknown", "a"]
    assert facet_filter(df, {"c": []}).count() == 4


def test_facet_options_cascade(spark):
    df = spark.createDataFrame(
        [("x", "p"), ("x", "q"), ("y", "r"), (None, "s")], "f1 string, f2 string"
    )
    got = [(r.position, r.facet, r.value) for r in facet_options(df, ["f1", "f2"], {"f1": ["x"]}).collect()]
    assert got == [(0, "f1", "x"), (0, "f1", "y"), (1, "f2", "p"), (1, "f2", "q")]


def test_subject_scope_regex_unicode(spark):
    df = spark.createDataFrame([("Séjour à l'ABBÉ",), ("autre",), (None,)], "s string")
    assert subject_scope(df, "s", "abbé").count() == 1
    assert subject_scope(df, "s", "s.jour").count() == 1  # regex, not literal


def test_traffic_filter_quirks(spark):
    rows = [
        ("google", "a.booketing.com"), ("evaluation-x", "a.booketing.com"), ("officeXnet", "a.booketing.com"),
        (None, "WWW.BOOKETING.COM"), ("google", None), ("google", "other.com"), ("TagAssistant.google.com", "x.booketing"),
    ]
    df = spark.createDataFrame(rows, "SESSIONSOURCE string, HOSTNAME string")
    kept = traffic_filter(df, TrafficRules()).collect()
    assert sorted((r.SESSIONSOURCE or "", r.HOSTNAME) for r in kept) == [("", "WWW.BOOKETING.COM"), ("google", "a.booketing.com")]
    assert "office.net" in SOURCE_EXCLUDE
    # a grain without source only gets the host rule
    host_only = traffic_filter(df.drop("SESSIONSOURCE"), TrafficRules())
    assert host_only.count() == 5


def test_search_rows_null_never_matches(spark):
    df = spark.createDataFrame([("none", 1), (None, 2), ("Borealis", 3)], "a string, b int")
    assert search_rows(df, "none").count() == 1
    assert search_rows(df, "BOREALIS|^2$").count() == 2
    assert search_rows(df, "").count() == 3


def test_active_only(spark):
    df = spark.createDataFrame([(True,), (None,), (False,)], "ACTIVE boolean")
    assert active_only(df).count() == 2
    assert active_only(df.withColumnRenamed("ACTIVE", "x")).count() == 3


def test_facet_options_are_values_of_the_data(spark, sf_dir):
    from innsight.plans import attendance as att
    from report_fixtures import fixture

    tx = fixture(spark, sf_dir, "transactions_grouped")
    opts = att.attendance_options(tx, att.BOOK_DATE, None, {"Source": ["1-URGENT"]}).collect()
    clean = att.attendance_base(tx, att.BOOK_DATE)
    for facet in att.FACETS:
        have = {r[0] for r in clean.select(facet).distinct().collect()}
        assert {o.value for o in opts if o.facet == facet} <= have


def test_text_match_folds_unicode_case(spark):
    """What a case-insensitive regular expression matches, plain patterns included."""
    from innsight.operators.filters import matches_ci

    for text, pattern in [("ΟΔΟΣ", "οδοσ"), ("ſtay", "stay"), ("ÉTÉ", "été"), ("HOTEL AURORA", "hotel aurora"), ("www.Booketing.COM", "booketing")]:
        df = spark.createDataFrame([(text,)], "s string")
        assert df.select(matches_ci("s", pattern)).first()[0], (text, pattern)
    df = spark.createDataFrame([("xyz",), (None,)], "s string")
    assert [r[0] for r in df.select(matches_ci("s", "a|b")).collect()] == [False, False]


def test_search_reads_maps_and_binary(spark):
    from innsight.operators.filters import search_rows

    df = spark.createDataFrame([(1, {"k": "Needle"}, bytearray(b"x"), None), (2, {}, bytearray(b"a NEEDLE"), None), (3, None, None, None)],
                               "i int, m map<string,string>, b binary, s string")
    assert sorted(r.i for r in search_rows(df, "needle").collect()) == [1, 2]
    assert search_rows(df, ".*").count() == 3 and search_rows(df, "").count() == 3
