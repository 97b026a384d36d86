"""Email campaigns: segment metrics, sends by state, open frequency.

Pipeline: keyed de-duplication on ``DATA_ID`` (before anything else) ->
lenient numbers -> wall-clock timestamps -> subject scope (the source may hold
several properties) -> half-open date range (default: the data's own first
and last day) -> one conditional aggregate for every bucket and the total.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from innsight.config import EMAIL_NUMERIC, EmailConfig
from innsight.functions.clean import to_number0, truncate_int, wall_clock
from innsight.functions.formats import pct
from innsight.operators.dedup import keep_first
from innsight.operators.filters import DateLike, half_open_range, subject_scope
from innsight.operators.measures import conditional_segments, group_sizes, ratio, sum0
from innsight.operators.pattern_index import constant_table, matching_patterns

TS = "DATA_TS_DATE"
SUMMARY_COLUMNS = (
    "Segment", "Emails Sent", "Delivered", "Opened", "Data Clicks",
    "Emails w/ >=1 Click", "Delivery Rate", "Open Rate", "CTR",
)


def used_columns(cfgs: Sequence[EmailConfig]) -> list[str]:
    """Columns the email reports read (for every config in ``cfgs``)."""
    cols = ["DATA_ID", TS, *EMAIL_NUMERIC, "DATA_STATE"]
    for c in cfgs:
        cols += [c.tag_field, c.subject_field]
    return list(dict.fromkeys(cols))


def email_base(raw: DataFrame, keep: Sequence[str] | None = None) -> DataFrame:
    """One row per ``DATA_ID`` (first by timestamp), measures as numbers,
    wall-clock timestamps.  Independent of the tenant: when several tenants
    read the same source it is computed once and shared.

    ``keep`` projects the source to the columns the reports read before the
    de-duplication shuffle (the tie-break then covers those columns only:
    rows that tie on all of them give the same reports whichever is kept).
    """
    if keep is not None:
        raw = raw.select(*[F.col(f"`{c}`") for c in keep if c in raw.columns])
    df = keep_first(raw, ["DATA_ID"], [F.col(TS).asc_nulls_last()], [TS])
    df = to_number0(df, EMAIL_NUMERIC)
    return df.withColumn(TS, wall_clock(F.col(TS)))


def email_scope(raw: DataFrame, cfg: EmailConfig, date_range: tuple[DateLike, DateLike] | None = None) -> DataFrame:
    """Messages of this property within the date range, one row per ``DATA_ID``."""
    return email_in_scope(email_base(raw, used_columns([cfg])), cfg, date_range)


def email_in_scope(base: DataFrame, cfg: EmailConfig, date_range: tuple[DateLike, DateLike] | None = None) -> DataFrame:
    """Subject scope and date range over :func:`email_base` rows.

    Without a range the default is the first..last day of the scoped data,
    which keeps every message that has a timestamp; no extra pass is needed
    to find those days.
    """
    df = base
    if cfg.subject_match:
        df = subject_scope(df, cfg.subject_field, cfg.subject_match)
    if date_range is None:
        return df.filter(F.col(TS).isNotNull())
    return half_open_range(df, TS, *date_range)


def _segments(scoped: DataFrame, cfg: EmailConfig, total_label: str) -> DataFrame:
    """Count and sums of every bucket (tag equality, NULL tag as '') and of all
    messages, in one conditional aggregate."""
    tag = F.coalesce(F.col(cfg.tag_field), F.lit(""))
    segments = [(label, tag == F.lit(value)) for value, label in cfg.buckets] + [(total_label, None)]
    return conditional_segments(
        scoped,
        segments,
        counts={"rec": "DATA_ID"},
        sums={"sent": "SENT", "opened": "OPEN", "clicks": "CLICKS", "data_clicks": "DATA_CLICKS"},
    )


def _section_columns(seg: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    rec, sent, opened = F.col("rec"), F.col("sent"), F.col("opened")
    clicks, data_clicks = F.col("clicks"), F.col("data_clicks")
    out = seg.select(
        *by,
        "position",
        F.col("label").alias("Section"),
        rec.alias("Email Sent"),
        truncate_int(sent).alias("Emails Delivered"),
        truncate_int(opened).alias("Emails Opened"),
        ratio(sent, rec).alias("AVG Delivery Rate"),
        truncate_int(data_clicks).alias("Data Clicks"),
        truncate_int(clicks).alias("Email With at Least 1 Click"),
        ratio(clicks, sent).alias("Click Rate (CTR)"),
        ratio(opened, sent).alias("AVG Open Rate"),
    )
    return out.orderBy(*by, "position")


def _summary_columns(seg: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    rec = F.col("rec")
    sent, opened = truncate_int(F.col("sent")), truncate_int(F.col("opened"))
    clicks, data_clicks = truncate_int(F.col("clicks")), truncate_int(F.col("data_clicks"))
    out = seg.select(
        *by,
        "position",
        F.col("label").alias("Segment"),
        rec.alias("Emails Sent"),
        sent.alias("Delivered"),
        opened.alias("Opened"),
        data_clicks.alias("Data Clicks"),
        clicks.alias("Emails w/ >=1 Click"),
        pct(ratio(sent, rec)).alias("Delivery Rate"),
        pct(ratio(opened, sent)).alias("Open Rate"),
        pct(ratio(clicks, sent)).alias("CTR"),
    )
    return out.orderBy(*by, "position")


def email_sections(scoped: DataFrame, cfg: EmailConfig) -> DataFrame:
    """The page's metric sections: one per bucket and ``Total Emails``.

    Counts are shown as integers; the rates are fractions of the untruncated
    sums (delivered / sent, clicks / delivered, opened / delivered).
    """
    return _section_columns(_segments(scoped, cfg, "Total Emails"))


def email_summary(scoped: DataFrame, cfg: EmailConfig) -> DataFrame:
    """One row per configured bucket (in order) and a ``Total`` of every scoped message.

    Buckets may overlap or be empty (an empty bucket shows zeros); a message in
    no bucket still counts in the total.  Counts are integers (truncated sums)
    and the rates are computed from those integers, as text like ``12.34%``.
    """
    return _summary_columns(_segments(scoped, cfg, "Total"))


# ---------------------------------------------------------------- many tenants, one source
TAG = "__tag"


def scope_tenants(base: DataFrame, cfgs: Mapping[str, EmailConfig], tenant_col: str = "tenant") -> DataFrame:
    """Messages of every tenant reading ``base``.

    Each message gets one row per tenant whose subject pattern it matches (a
    message may belong to several, as when each tenant scopes the source on
    its own), with that tenant's tag value.  Patterns are looked up in an index
    of the distinct subjects (see :mod:`innsight.operators.pattern_index`), and
    the matches joined back to the messages.  The patterns travel as one
    constant, so the plan does not grow with the tenants.  The default date
    range keeps every dated message, as for one tenant.
    """
    dated = base.filter(F.col(TS).isNotNull())
    by_field: dict[str, dict[str, EmailConfig]] = {}
    for tenant, cfg in cfgs.items():
        by_field.setdefault(cfg.subject_field, {})[tenant] = cfg
    tags = F.create_map(*[x for f in dict.fromkeys(c.tag_field for c in cfgs.values())
                          for x in (F.lit(f), F.coalesce(F.col(f"`{f}`").cast("string"), F.lit("")))])
    out = None
    for field, some in by_field.items():
        dealt = dated.withColumn("__subject", F.coalesce(F.col(f"`{field}`").cast("string"), F.lit("")))
        found = matching_patterns(dealt, "__subject", [c.subject_match for c in some.values()])
        readers = constant_table(dated.sparkSession, [{"pattern": c.subject_match, "tenant": t, "tag": c.tag_field} for t, c in some.items()],
                                 {"pattern": "string", "tenant": "string", "tag": "string"})
        hits = found.join(readers, "pattern").select("text", F.struct("tenant", "tag").alias("__p"))
        scoped = dealt.join(hits, F.col("__subject") == F.col("text")).select(
            *[F.col(f"`{c}`") for c in base.columns], F.col("__p.tenant").alias(tenant_col), F.element_at(tags, F.col("__p.tag")).alias(TAG))
        out = scoped if out is None else out.unionByName(scoped)
    return out


def _tenant_segments(scoped: DataFrame, cfgs: Mapping[str, EmailConfig], total_label: str,
                     tenant_col: str) -> DataFrame:
    """Bucket and total segments of every tenant, in order of ``position``.

    Sums per (tenant, tag) first (a few rows per tenant), then each tenant's
    configured buckets - a small table built from configuration - are joined
    to them, so an empty bucket still yields its row; the total sums all tags.
    """
    per_tag = scoped.groupBy(tenant_col, TAG).agg(
        F.count("DATA_ID").alias("rec"), sum0("SENT").alias("sent"), sum0("OPEN").alias("opened"),
        sum0("CLICKS").alias("clicks"), sum0("DATA_CLICKS").alias("data_clicks"))
    measures = ["rec", "sent", "opened", "clicks", "data_clicks"]
    spark = scoped.sparkSession
    schema = T.StructType([T.StructField(tenant_col, T.StringType()), T.StructField("position", T.IntegerType()),
                           T.StructField("label", T.StringType()), T.StructField(TAG, T.StringType())])
    buckets = spark.createDataFrame(
        [(t, i, label, value) for t, c in cfgs.items() for i, (value, label) in enumerate(c.buckets)], schema)
    ends = spark.createDataFrame([(t, len(c.buckets)) for t, c in cfgs.items()], T.StructType(schema.fields[:2]))
    totals = per_tag.groupBy(tenant_col).agg(*[sum0(m).alias(m) for m in measures])
    bucket_rows = (
        buckets.join(totals.select(tenant_col), tenant_col, "inner")
        .join(per_tag, [tenant_col, TAG], "left")
        .select(tenant_col, "position", "label", *[F.coalesce(F.col(m), F.lit(0)).alias(m) for m in measures])
    )
    return bucket_rows.unionByName(totals.join(ends, tenant_col).select(tenant_col, "position", F.lit(total_label).alias("label"), *measures))


def email_summary_by_tenant(scoped: DataFrame, cfgs: Mapping[str, EmailConfig], tenant_col: str = "tenant") -> DataFrame:
    """:func:`email_summary` of every tenant of :func:`scope_tenants` rows."""
    return _summary_columns(_tenant_segments(scoped, cfgs, "Total", tenant_col), [tenant_col])


def email_sections_by_tenant(scoped: DataFrame, cfgs: Mapping[str, EmailConfig], tenant_col: str = "tenant") -> DataFrame:
    """:func:`email_sections` of every tenant of :func:`scope_tenants` rows."""
    return _section_columns(_tenant_segments(scoped, cfgs, "Total Emails", tenant_col), [tenant_col])


def email_by_state(scoped: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Messages per delivery state (NULL state dropped), by state."""
    return group_sizes(scoped, "DATA_STATE", by=by)


def email_open_frequency(scoped: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Messages per number of opens (missing opens count as 0), by opens."""
    return group_sizes(scoped, "DATA_OPENS", by=by)
