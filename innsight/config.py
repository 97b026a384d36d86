"""Tenant configuration objects and the fixed values the reports depend on."""

from __future__ import annotations

from dataclasses import dataclass, field

# ---------------------------------------------------------------------------
# Fixed values.  These must equal the dashboard application's for the reports
# to agree with it; they are defaults that a caller may override per tenant.
# ---------------------------------------------------------------------------

# Page key -> title, in the application's order.
PAGE_TITLES: dict[str, str] = {
    "product_performance": "Product Performance",
    "book_date": "Book Date",
    "event_date": "Event Date",
    "email_campaigns": "Email Campaigns",
    "guest_portal": "Guest Portal",
    "audience": "Audience",
}

# Ordered guest-portal conversion funnel: (GA4 event name, label shown).
FUNNEL_STEPS: tuple[tuple[str, str], ...] = (
    ("guest_portal_loaded", "Guest Portal Loaded"),
    ("view_item", "Viewed Item"),
    ("select_item", "Selected Item"),
    ("add_to_cart", "Add to Cart"),
    ("init_checkoutpay", "Checkout"),
    ("purchase", "Purchase"),
)

# Session-source fragments treated as internal / QA traffic.  They are joined
# into one regular-expression alternation, so "." in "office.net" matches any
# character, as in the application.
SOURCE_EXCLUDE: tuple[str, ...] = (
    "tagassistant", "uat", "localhost", "staging", "atlassian", "office.net",
)

# Host-name fragment a GA4 row must contain (case-insensitive).
HOST_ALLOW = "booketing"

# City left out of the top-locations list.
EXCLUDED_CITY = "Morelia"

# Label given to NULL dimension values.
UNKNOWN = "Unknown"

# Top-k sizes of the GA4 widgets.
TOP_ITEMS_K = 15
MOST_VISITED_K = 20
ACQUISITION_K = 10
TOP_LOCATIONS_K = 20

# GA4 grains of the connector views, in the long view's branch order.
GA4_GRAINS: tuple[str, ...] = ("ITEMS", "EVENTS", "DAILY", "DEVICE", "LOCATION", "SLIDES")

# GA4 measures that may arrive as text and are coerced to numbers.
GA4_NUMERIC: tuple[str, ...] = (
    "SESSIONS", "ACTIVEUSERS", "TOTALUSERS", "NEWUSERS", "SCREENPAGEVIEWS",
    "ENGAGEDSESSIONS", "USERENGAGEMENTDURATION", "KEYEVENTS", "EVENTCOUNT",
    "ITEMSVIEWED", "ITEMSPURCHASED",
)

# Email measures coerced to numbers (when present).
EMAIL_NUMERIC: tuple[str, ...] = ("SENT", "OPEN", "CLICKS", "DATA_CLICKS", "DATA_OPENS")

# Table suffixes of the per-tenant sources.
REPORT_ITEMS_SUFFIX = "REPORT_ITEMS"
TRANSACTIONS_SUFFIX = "UVE_TRANSACTIONS_GROUPED"


@dataclass(frozen=True)
class EmailConfig:
    """Where a tenant's email notifications live and how they are scoped."""

    table: str
    tag_field: str = "NOTIFICATION_TAG"
    subject_field: str = "DATA_SUBJECT"
    subject_match: str = ""
    buckets: tuple[tuple[str, str], ...] = ()

    @classmethod
    def from_dict(cls, d: dict | None) -> "EmailConfig | None":
        if not d or not d.get("table"):
            return None
        return cls(
            table=d["table"],
            tag_field=d.get("tag_field") or "NOTIFICATION_TAG",
            subject_field=d.get("subject_field") or "DATA_SUBJECT",
            subject_match=d.get("subject_match") or "",
            buckets=tuple((str(b[0]), str(b[1])) for b in (d.get("buckets") or [])),
        )


@dataclass(frozen=True)
class Ga4Config:
    """Location of a tenant's GA4 connector views: ``{database}.{schema}.{report}_GA4_{grain}``."""

    database: str
    schema: str
    report: str

    @classmethod
    def from_dict(cls, d: dict | None) -> "Ga4Config | None":
        if not d or not d.get("report"):
            return None
        return cls(database=d.get("database") or "", schema=d.get("schema") or "", report=d["report"])


@dataclass(frozen=True)
class TrafficRules:
    """GA4 traffic filters shared by every GA4 widget."""

    host_allow: str = HOST_ALLOW
    source_exclude: tuple[str, ...] = SOURCE_EXCLUDE
    excluded_city: str = EXCLUDED_CITY

    @classmethod
    def from_dict(cls, d: dict | None) -> "TrafficRules":
        """Rules given for a tenant; what is left out keeps its default."""
        d = {k: v for k, v in (d or {}).items() if v is not None}
        if "source_exclude" in d:
            d["source_exclude"] = tuple(d["source_exclude"])
        return cls(**d)


@dataclass(frozen=True)
class TenantConfig:
    """One property: its key, display label, table prefix, pages and sources."""

    customer: str
    label: str
    prefix: str
    pages: tuple[str, ...] = ()
    email: EmailConfig | None = None
    ga4: Ga4Config | None = None
    traffic: TrafficRules = field(default_factory=TrafficRules)

    @classmethod
    def from_row(cls, row) -> "TenantConfig":
        """Build from a row of :func:`innsight.sources.registry.load_registry`."""
        d = row.asDict(recursive=True) if hasattr(row, "asDict") else dict(row)
        return cls(
            customer=d["customer"],
            label=d["label"],
            prefix=d["prefix"],
            pages=tuple(d.get("pages") or ()),
            email=EmailConfig.from_dict(d.get("email")),
            ga4=Ga4Config.from_dict(d.get("ga4")),
            traffic=TrafficRules.from_dict(d.get("traffic")),
        )
