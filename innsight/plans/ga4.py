"""GA4 web analytics: guest portal, audience, and the tagged long view.

Each grain is typed (lenient date, lenient numbers), then traffic-filtered
(host allow-list, source deny-list; only where the grain has those columns).
The date range defaults to the first..last day of the cleaned DAILY grain and
is applied to every grain of the page.  The range is found with one small
action (two values), so the bounds are literals that reach the scans.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from innsight.config import (
    ACQUISITION_K, FUNNEL_STEPS, GA4_NUMERIC, MOST_VISITED_K, TOP_ITEMS_K, TOP_LOCATIONS_K,
    TrafficRules,
)
from innsight.functions.clean import lenient_timestamp, to_number0, truncate_int
from innsight.functions.formats import one_decimal_pct
from innsight.operators.filters import (
    DateLike, closed_range, date_bounds, not_equal_keep_null, traffic_filter, traffic_predicate,
)
from innsight.operators.measures import daily_series, keyed_sums, ratio, sum0, top_k
from innsight.operators.union import conform, union_all_by_name
from innsight.session import cut_lineage

DateRange = tuple[DateLike, DateLike]


# ---------------------------------------------------------------- shared cleaning
def ga4_grain(raw: DataFrame) -> DataFrame:
    """Typed grain: a text ``DATE`` is parsed leniently (typed dates are kept, so
    range filters still reach the scan); GA4 measures become numbers, 0 when bad."""
    df = raw
    if "DATE" in df.columns and not isinstance(df.schema["DATE"].dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        df = df.withColumn("DATE", lenient_timestamp(F.col("DATE"), df.schema["DATE"].dataType))
    return to_number0(df, GA4_NUMERIC)


def ga4_clean(raw: DataFrame, rules: TrafficRules = TrafficRules()) -> DataFrame:
    """Typed and traffic-filtered grain."""
    return traffic_filter(ga4_grain(raw), rules)


def in_range(df: DataFrame, rng: DateRange | None) -> DataFrame:
    """Closed range on ``DATE`` (midnight bounds); no range -> no rows are dropped."""
    return closed_range(df, "DATE", *rng) if rng else df


GROUPS = "GROUPS"


def page_frames(
    daily_raw: DataFrame,
    others: dict[str, DataFrame] | None = None,
    date_range: DateRange | None = None,
    rules: TrafficRules | Callable[[DataFrame], DataFrame] = TrafficRules(),
    by: Sequence[str] = (),
    keep: Callable[[DataFrame], DataFrame] = lambda df: df,
) -> dict[str, DataFrame]:
    """Cleaned grains of a GA4 page, each restricted to the page's date range.

    ``others`` maps grain name to raw frame; ``ITEMS`` is range-filtered only,
    every other grain is also traffic-filtered (``rules``, or a function that
    filters a typed grain by each tenant's own rules).  Without a selected
    range, the range is midnight of DAILY's first day to midnight of its last.
    A DAILY of plain dates keeps every dated row then, so it needs no bounds.
    For one tenant the bounds are two literals (one small action, then pushed
    into the scans); with ``by`` (tenants sharing tables) each group has its
    own, computed once into a table of one row per group and joined to the
    grains on the group keys.  With ``by``, :data:`GROUPS` holds the keys of
    the groups that have DAILY rows.  ``keep`` may write the cleaned DAILY, cut
    to the columns that reports read, as a table of its own.
    """
    clean = rules if callable(rules) else lambda df: traffic_filter(df, rules)
    daily = clean(ga4_grain(daily_raw))
    daily = keep(daily.select([c for c in daily.columns if c in {*by, "DATE", "SESSIONSOURCE", *GA4_NUMERIC}]))
    dated = daily.filter(F.col("DATE").isNotNull())
    plain = isinstance(daily.schema["DATE"].dataType, T.DateType)
    typed = {g: ga4_grain(raw) if g == "ITEMS" else clean(ga4_grain(raw)) for g, raw in (others or {}).items()}
    if by:
        bounds = cut_lineage(dated.groupBy(*by).agg(
            F.to_date(F.min("DATE")).alias("__lo"), F.to_date(F.max("DATE")).alias("__hi")))

        def within(df: DataFrame) -> DataFrame:
            if date_range is not None:
                return in_range(df, date_range)
            d = F.col("DATE")
            mid = [F.col(c).cast(df.schema["DATE"].dataType) for c in ("__lo", "__hi")]
            return df.join(bounds, on=list(by), how="inner").filter((d >= mid[0]) & (d <= mid[1])).drop("__lo", "__hi")

        out = {"DAILY": dated if plain and date_range is None else within(daily)}
        out |= {g: within(f) for g, f in typed.items()}
        return out | {GROUPS: bounds.select(*by)}
    rng = date_range
    if rng is None and (typed or not plain):
        rng = date_bounds(daily, "DATE")
        if rng is None:  # DAILY has no dated row: neither has the page
            return {"DAILY": dated} | {g: f.filter(F.lit(False)) for g, f in typed.items()}
    return {"DAILY": in_range(dated, rng)} | {g: in_range(f, rng) for g, f in typed.items()}


def tenant_rules(rules: Mapping[str, TrafficRules], tenant_col: str) -> Callable[[DataFrame], DataFrame]:
    """Traffic filter of a grain shared by tenants with their own rules.

    Tenants with equal rules share one predicate, so the expression grows with
    the number of different rules, not of tenants; most have the default's.
    """
    default = TrafficRules()
    different: dict[TrafficRules, list[str]] = {}
    for tenant, r in rules.items():
        if r != default:
            different.setdefault(r, []).append(tenant)

    def clean(df: DataFrame) -> DataFrame:
        if not different:
            return traffic_filter(df, default)
        own = [t for ts in different.values() for t in ts]
        keep = ~F.col(tenant_col).isin(own) & traffic_predicate(df, default)
        for r, tenants in different.items():
            keep = keep | (F.col(tenant_col).isin(tenants) & traffic_predicate(df, r))
        return df.filter(keep)

    return clean


def _with_groups(df: DataFrame, groups: DataFrame | None, by: Sequence[str]) -> DataFrame:
    """One row per group: those without rows in ``df`` get zeros."""
    return df if groups is None else groups.join(df, on=list(by), how="left").na.fill(0)


# ---------------------------------------------------------------- guest portal
def guest_kpis(daily: DataFrame, by: Sequence[str] = (), groups: DataFrame | None = None) -> DataFrame:
    """Sessions, key events, conversion rate, engaged sessions, average engagement (s).

    ``groups`` (with ``by``): every group gets a row, of zeros where it has none.
    """
    s = daily.groupBy(*by).agg(
        sum0("SESSIONS").alias("s"),
        sum0("KEYEVENTS").alias("k"),
        sum0("ENGAGEDSESSIONS").alias("e"),
        sum0("USERENGAGEMENTDURATION").alias("d"),
    )
    s = _with_groups(s, groups, by)
    return s.select(
        *by,
        truncate_int(F.col("s")).alias("Sessions"),
        truncate_int(F.col("k")).alias("Key Events"),
        ratio(F.col("k"), F.col("s")).alias("Conversion Rate"),
        truncate_int(F.col("e")).alias("Engaged Sessions"),
        ratio(F.col("d"), F.col("s")).alias("Avg Engagement"),
    )


def sessions_over_time(daily: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Sessions per calendar day."""
    return daily_series(daily, "DATE", {"Sessions": "SESSIONS"}, by=by)


def funnel(events: DataFrame, steps: Sequence[tuple[str, str]] = FUNNEL_STEPS, by: Sequence[str] = (),
           groups: DataFrame | None = None) -> DataFrame:
    """Event counts of the ordered funnel steps (``position``); a step with no events shows 0.

    One conditional aggregate: each step is ``sum(EVENTCOUNT)`` over its event
    name, so every step gets a row even without events.  The events are first
    restricted to the step names (an IN filter that reaches the scan).
    ``groups`` (with ``by``): every group gets its steps, events or not.
    """
    name = F.col("EVENTNAME")
    sums = [F.coalesce(F.sum(F.when(name == F.lit(k), F.col("EVENTCOUNT"))), F.lit(0)).cast("bigint").alias(f"s{i}")
            for i, (k, _) in enumerate(steps)]
    wide = _with_groups(events.filter(name.isin([k for k, _ in steps])).groupBy(*by).agg(*sums), groups, by)
    rows = [F.struct(F.lit(i).alias("position"), F.lit(label).alias("Step"), F.col(f"s{i}").alias("Events"))
            for i, (_, label) in enumerate(steps)]
    return wide.select(*by, F.inline(F.array(*rows))).orderBy(*by, "position")


def _item_sums(items: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return keyed_sums(items, [*by, "ITEMNAME"], {"v": "ITEMSVIEWED", "p": "ITEMSPURCHASED"})


def _item_order() -> list:
    return [F.desc_nulls_last("v"), F.asc("ITEMNAME")]


def most_viewed(items: DataFrame, k: int = MOST_VISITED_K, by: Sequence[str] = ()) -> DataFrame:
    """The ``k`` items with the most views: one aggregate behind both item reports."""
    return top_k(_item_sums(items, by), _item_order(), k, by)


def top_items(items: DataFrame, k: int = TOP_ITEMS_K, by: Sequence[str] = ()) -> DataFrame:
    """Items with the most views (viewed and purchased)."""
    return top_items_of(most_viewed(items, k, by), k, by)


def top_items_of(viewed: DataFrame, k: int = TOP_ITEMS_K, by: Sequence[str] = ()) -> DataFrame:
    """:func:`top_items` from :func:`most_viewed` of ``k`` items or more."""
    return viewed.filter(F.col("Rank") <= k).select(
        *by, "Rank", F.col("ITEMNAME").alias("Item"), F.col("v").alias("Viewed"), F.col("p").alias("Purchased"))


def most_visited(items: DataFrame, k: int = MOST_VISITED_K, by: Sequence[str] = ()) -> DataFrame:
    """Most-viewed experiences with their conversion (purchased / viewed) as text."""
    return most_visited_of(most_viewed(items, k, by), k, by)


def most_visited_of(viewed: DataFrame, k: int = MOST_VISITED_K, by: Sequence[str] = ()) -> DataFrame:
    """:func:`most_visited` from :func:`most_viewed` of ``k`` items or more."""
    return viewed.filter(F.col("Rank") <= k).select(
        *by,
        "Rank",
        F.col("ITEMNAME").alias("Experience"),
        F.col("v").alias("Views"),
        F.col("p").alias("Purchased"),
        one_decimal_pct(ratio(F.col("p"), F.col("v"))).alias("Conversion"),
    )


# ---------------------------------------------------------------- audience
def audience_kpis(daily: DataFrame, by: Sequence[str] = (), groups: DataFrame | None = None) -> DataFrame:
    """Total users, new users, share of new users, sessions per user, bounce rate.

    ``groups`` (with ``by``): every group gets a row, of zeros where it has none.
    """
    s = daily.groupBy(*by).agg(
        sum0("TOTALUSERS").alias("t"),
        sum0("NEWUSERS").alias("n"),
        sum0("SESSIONS").alias("s"),
        sum0("ENGAGEDSESSIONS").alias("e"),
    )
    s = _with_groups(s, groups, by)
    return s.select(
        *by,
        truncate_int(F.col("t")).alias("Total Users"),
        truncate_int(F.col("n")).alias("New Users"),
        ratio(F.col("n"), F.col("t")).alias("% New Users"),
        ratio(F.col("s"), F.col("t")).alias("Sessions / User"),
        ratio(F.col("s") - F.col("e"), F.col("s")).alias("Bounce Rate"),
    )


def users_over_time(daily: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Total and new users per calendar day."""
    return daily_series(daily, "DATE", {"Total Users": "TOTALUSERS", "New Users": "NEWUSERS"}, by=by)


def devices(device: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Sessions per device category, most first (no limit)."""
    sums = keyed_sums(device, [*by, "DEVICECATEGORY"], {"Sessions": "SESSIONS"})
    return sums.orderBy(*by, F.desc_nulls_last("Sessions"), "DEVICECATEGORY")


def acquisition(daily: DataFrame, k: int = ACQUISITION_K, by: Sequence[str] = ()) -> DataFrame:
    """Sessions of the top session sources (NULL source dropped)."""
    sums = keyed_sums(daily, [*by, "SESSIONSOURCE"], {"Sessions": "SESSIONS"})
    top = top_k(sums, [F.desc_nulls_last("Sessions"), F.asc("SESSIONSOURCE")], k, by)
    return top.select(*by, "Rank", "SESSIONSOURCE", "Sessions")


def top_locations(location: DataFrame, rules: TrafficRules | Mapping[str, TrafficRules] = TrafficRules(),
                  k: int = TOP_LOCATIONS_K, by: Sequence[str] = ()) -> DataFrame:
    """Sessions of the top (city, country) pairs, one city left out (with ``by``,
    ``rules`` may map the first key's values to their own)."""
    if isinstance(rules, TrafficRules):
        kept = location.filter(not_equal_keep_null("CITY", rules.excluded_city))
    else:
        tenants: dict[str, list[str]] = {}
        for tenant, r in rules.items():
            tenants.setdefault(r.excluded_city, []).append(tenant)
        out = F.lit(False)
        for city, some in tenants.items():
            out = out | (~not_equal_keep_null("CITY", city) & F.col(by[0]).isin(some))
        kept = location.filter(~out)
    sums = keyed_sums(kept, [*by, "CITY", "COUNTRY"], {"Sessions": "SESSIONS"})
    top = top_k(sums, [F.desc_nulls_last("Sessions"), F.asc("CITY"), F.asc("COUNTRY")], k, by)
    return top.select(*by, "Rank", F.col("CITY").alias("City"), F.col("COUNTRY").alias("Country"), "Sessions")


# ---------------------------------------------------------------- long view
# The long view's columns, and each grain's source -> long names.
LONG_SCHEMA = T.StructType([
    T.StructField("REPORT", T.StringType()),
    T.StructField("DATE", T.DateType()),
    T.StructField("ITEM_NAME", T.StringType()),
    T.StructField("EVENT_NAME", T.StringType()),
    T.StructField("DEVICE_CATEGORY", T.StringType()),
    T.StructField("CITY", T.StringType()),
    T.StructField("COUNTRY", T.StringType()),
    T.StructField("REGION", T.StringType()),
    T.StructField("LINK_URL", T.StringType()),
    T.StructField("LINK_TEXT", T.StringType()),
    T.StructField("SESSION_SOURCE", T.StringType()),
    T.StructField("HOST_NAME", T.StringType()),
    T.StructField("SESSIONS", T.LongType()),
    T.StructField("KEY_EVENTS", T.DecimalType(38, 0)),
    T.StructField("ITEMS_VIEWED", T.LongType()),
    T.StructField("ITEMS_PURCHASED", T.LongType()),
    T.StructField("EVENT_COUNT", T.LongType()),
    T.StructField("ACTIVE_USERS", T.LongType()),
    T.StructField("TOTAL_USERS", T.LongType()),
    T.StructField("NEW_USERS", T.LongType()),
    T.StructField("SCREEN_PAGE_VIEWS", T.LongType()),
    T.StructField("ENGAGED_SESSIONS", T.LongType()),
    T.StructField("USER_ENGAGEMENT_DURATION", T.DecimalType(38, 0)),
])
LONG_BRANCHES: dict[str, dict[str, str]] = {
    "items": {"DATE": "DATE", "ITEMNAME": "ITEM_NAME", "ITEMSVIEWED": "ITEMS_VIEWED", "ITEMSPURCHASED": "ITEMS_PURCHASED"},
    "events": {"DATE": "DATE", "EVENTNAME": "EVENT_NAME", "SESSIONSOURCE": "SESSION_SOURCE", "HOSTNAME": "HOST_NAME",
               "SESSIONS": "SESSIONS", "KEYEVENTS": "KEY_EVENTS", "EVENTCOUNT": "EVENT_COUNT"},
    "daily": {"DATE": "DATE", "SESSIONSOURCE": "SESSION_SOURCE", "HOSTNAME": "HOST_NAME", "SESSIONS": "SESSIONS",
              "KEYEVENTS": "KEY_EVENTS", "ACTIVEUSERS": "ACTIVE_USERS", "TOTALUSERS": "TOTAL_USERS",
              "NEWUSERS": "NEW_USERS", "SCREENPAGEVIEWS": "SCREEN_PAGE_VIEWS", "ENGAGEDSESSIONS": "ENGAGED_SESSIONS",
              "USERENGAGEMENTDURATION": "USER_ENGAGEMENT_DURATION"},
    "device": {"DATE": "DATE", "DEVICECATEGORY": "DEVICE_CATEGORY", "HOSTNAME": "HOST_NAME", "SESSIONS": "SESSIONS"},
    "location": {"DATE": "DATE", "CITY": "CITY", "COUNTRY": "COUNTRY", "REGION": "REGION",
                 "SESSIONSOURCE": "SESSION_SOURCE", "HOSTNAME": "HOST_NAME", "SESSIONS": "SESSIONS",
                 "KEYEVENTS": "KEY_EVENTS"},
    "slides": {"DATE": "DATE", "EVENTNAME": "EVENT_NAME", "LINKURL": "LINK_URL", "LINKTEXT": "LINK_TEXT",
               "EVENTCOUNT": "EVENT_COUNT"},
}
# Text measures parsed like TRY_TO_NUMBER: rounded to whole numbers of up to 38
# digits; NULL when unparsable or out of range.
_TRY_NUMBER = {"KEY_EVENTS", "USER_ENGAGEMENT_DURATION"}


def ga4_long(grains: dict[str, DataFrame]) -> DataFrame:
    """All grains in one 23-column table tagged by ``REPORT``; absent columns are NULL.

    ``grains`` maps the report tag (``items``, ``events``, ``daily``,
    ``device``, ``location``, ``slides``) to that grain's raw frame.  A filter
    on ``REPORT`` prunes the other branches before any scan.
    """
    frames = []
    for report, mapping in LONG_BRANCHES.items():
        if report not in grains:
            continue
        g = grains[report]
        cols = [F.lit(report).alias("REPORT")]
        for src, dst in mapping.items():
            c = F.col(src)
            if dst in _TRY_NUMBER:
                c = c.try_cast(T.DecimalType(38, 0))
            cols.append(c.alias(dst))
        frames.append(g.select(*cols))
    return conform(union_all_by_name(frames), LONG_SCHEMA)
